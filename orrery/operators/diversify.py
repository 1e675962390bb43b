"""Order-dependent selections, one grouped-map call a theme over frames that are bounded before (a few hundred rows),
and in rounds over whole tables and many themes at once.

In the first form each group is one theme's candidate list; many themes run in parallel. Lists
that are not bounded by their own operator must be cut by rank first, or take the second form.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.lineage import cut
from orrery.operators import dedup


def _per_theme(rows: DataFrame, pick: Callable[[pd.DataFrame], list[int]], theme: str) -> DataFrame:
    """rows in the picked order, with slot (from 0)."""
    schema = rows.withColumn("slot", F.lit(0)).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pick(pdf)
        out = pdf.iloc[order].copy()
        out["slot"] = range(len(order))
        return out

    return rows.groupBy(theme).applyInPandas(run, schema)


def _jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def farthest_first(rows: DataFrame, k: int, *, theme: str = "theme", pos: str = "pos", names: str = "names") -> DataFrame:
    """k rows that are mutually most distant by concept names: the first, then always the one least similar to those chosen."""

    def pick(pdf: pd.DataFrame) -> list[int]:
        order = pdf[pos].argsort(kind="stable").tolist()
        if len(order) <= k:
            return order
        sets = [set(v) if v is not None else set() for v in pdf[names]]
        chosen, left = [order[0]], order[1:]
        near = {i: _jaccard(sets[i], sets[order[0]]) for i in left}
        while len(chosen) < k:
            best = min(left, key=near.__getitem__)
            chosen.append(best)
            left.remove(best)
            for i in left:
                near[i] = max(near[i], _jaccard(sets[i], sets[best]))
        return chosen

    return _per_theme(rows, pick, theme)


#: Themes whose chosen rows are broadcast in a round; more are joined by theme. Rounds between two cuts of the lineage.
BROADCAST_THEMES, CUT_EVERY = 50_000, 8


def farthest_first_rounds(rows: DataFrame, k: int, *, theme: str = "theme", pos: str = "pos", names: str = "names") -> DataFrame:
    """farthest_first over whole tables: rows of any number a theme, pos unique in it. No Python, one aggregation a round.

    Every row carries its similarity to the nearest row chosen so far; a round takes the least of each theme (ties to the
    smaller pos) and compares that one row with all others through the names they share.
    """
    named = rows.withColumn("__names", F.array_distinct(F.coalesce(names, F.array().cast("array<string>"))))
    sizes = rows.groupBy(theme).agg(F.count("*").alias("__n"))
    few = sizes.where(F.col("__n") <= k).select(theme)
    short = rows.join(few, theme, "left_semi").withColumn("slot", (F.row_number().over(W.partitionBy(theme).orderBy(pos)) - 1).cast("int"))
    live = cut(named.join(few, theme, "left_anti").select(theme, pos, "__names", F.lit(0.0).alias("__near")))
    small = F.broadcast if sizes.count() <= BROADCAST_THEMES else (lambda d: d)
    chosen = None
    for slot in range(k):
        first = F.struct("__near", pos)
        pick = cut(live.groupBy(theme).agg(F.min(first).getField(pos).alias("__pos"), F.min_by("__names", first).alias("__own"), F.lit(slot).alias("slot")))
        chosen = pick.drop("__own") if chosen is None else chosen.unionByName(pick.drop("__own"))
        shared = F.size(F.array_intersect("__names", "__own"))
        near = F.when(shared > 0, shared / (F.size("__names") + F.size("__own") - shared)).otherwise(0.0)
        live = live.join(small(pick.drop("slot")), theme).where(F.col(pos) != F.col("__pos")).withColumn("__near", F.greatest("__near", near)).select(theme, pos, "__names", "__near")
        if slot % CUT_EVERY == CUT_EVERY - 1:
            live = cut(live)
    taken = chosen.select(F.col(theme).alias("__theme"), "__pos", "slot") if chosen is not None else None
    if taken is None:
        return short.where("false")
    long = rows.join(taken, (F.col(theme) == F.col("__theme")) & (F.col(pos) == F.col("__pos"))).drop("__theme", "__pos")
    return short.unionByName(long.select(*short.columns))


def assigned_in_rounds(pairs: DataFrame, *order: Column, quota: int, theme: str = "theme", turn: str = "turn", key: str = "id") -> DataFrame:
    """The pairs by which bridges in turn take up to quota candidates each that no earlier bridge took, best first in the given order.

    pairs: theme, turn, id (once a bridge) and what the order needs. Every candidate proposes to its first bridge that has not
    turned it down, every bridge keeps its best; who is turned down proposes to the next in the round after. That ends
    in what bridges would take one after another, for all themes at once, in as many rounds as there are turns at most.
    """
    live = cut(pairs)
    proposal = F.row_number().over(W.partitionBy(theme, key).orderBy(turn)) == 1
    place = F.row_number().over(W.partitionBy(theme, turn).orderBy(*order, key))
    while True:
        asked = live.withColumn("__asked", proposal)
        placed = asked.where("__asked").withColumn("__place", place)
        lost = cut(placed.where(F.col("__place") > quota).select(theme, turn, key))
        if lost.isEmpty():
            return placed.drop("__asked", "__place")
        live = cut(live.join(lost, [theme, turn, key], "left_anti"))


def fair_shares(pages: DataFrame, spare: DataFrame, *, quota: int, limit: int, theme: str = "theme") -> DataFrame:
    """theme, slot, id, bridge (null: from the spare list): collect.fair_share for many themes at once.

    pages: theme, turn (int), kind, pos, id; spare: theme, pos, id. Bridges take their share in turn, lower kinds first; the spare list
    fills up to the limit.
    """
    best = (F.col("kind").asc(), F.col("pos").asc())
    taken = assigned_in_rounds(pages.select(theme, "turn", "kind", "pos", "id"), *best, quota=quota, theme=theme)
    return _filled(taken, spare.select(theme, F.lit(None).cast("int").alias("turn"), F.lit(0).alias("kind"), "pos", "id"), limit=limit, theme=theme)


def bridge_quotas(pairs: DataFrame, *, per_bridge: int, limit: int, theme: str = "theme") -> DataFrame:
    """theme, slot, id, bridge_pos: bridge_quota for many themes at once. pairs: theme, bridge_pos, pos, id."""
    rows = pairs.select(theme, F.col("bridge_pos").alias("turn"), F.lit(0).alias("kind"), "pos", "id")
    taken = assigned_in_rounds(rows, F.col("pos").asc(), quota=per_bridge, theme=theme)
    return _filled(taken, rows, limit=limit, theme=theme).withColumnRenamed("bridge", "bridge_pos")


def _filled(taken: DataFrame, spare: DataFrame, *, limit: int, theme: str) -> DataFrame:
    """Taken pairs by turn, then what the spare pairs add, each id once, up to the limit."""
    both = taken.withColumn("__late", F.lit(0)).unionByName(spare.withColumn("__late", F.lit(1)))
    order = (F.col("__late"), F.col("turn"), F.col("kind"), F.col("pos"), F.col("id"))
    once = both.withColumn("__rn", F.row_number().over(W.partitionBy(theme, "id").orderBy(*order))).where("__rn = 1")
    slot = F.row_number().over(W.partitionBy(theme).orderBy(*order)) - 1
    return once.withColumn("slot", slot.cast("int")).where(F.col("slot") < limit).select(theme, "slot", "id", F.col("turn").alias("bridge"))


def mmr(rows: DataFrame, count: int, *, lam: float = 0.7, same_facet: float = 0.18, theme: str = "theme", pos: str = "pos", score: str = "score", names: str = "names", facet: str = "facet") -> DataFrame:
    """Maximal marginal relevance: score against the highest redundancy with what is chosen."""

    def pick(pdf: pd.DataFrame) -> list[int]:
        order = pdf[pos].argsort(kind="stable").tolist()
        sets = [set(v) if v is not None else set() for v in pdf[names]]
        scores, facets = pdf[score].tolist(), pdf[facet].tolist()

        def redundancy(i: int, j: int) -> float:
            if sets[i] and sets[j]:
                return _jaccard(sets[i], sets[j])
            return same_facet if facets[i] and facets[i] == facets[j] else 0.0

        chosen: list[int] = []
        worst = dict.fromkeys(order, 0.0)
        left = list(order)
        while left and len(chosen) < count:
            best = max(left, key=lambda i: scores[i] if not chosen else lam * scores[i] - (1 - lam) * worst[i])
            chosen.append(best)
            left.remove(best)
            for i in left:
                worst[i] = max(worst[i], redundancy(i, best))
        return chosen

    return _per_theme(rows, pick, theme)


def head_window(rows: DataFrame, *, window: int = 10, per_bridge: int = 2, strict: bool = False, theme: str = "theme", pos: str = "pos", bridges: str = "bridges") -> DataFrame:
    """No bridge takes more than its cap of the first places; who waits keeps its order behind them, and fills places left over."""

    def pick(pdf: pd.DataFrame) -> list[int]:
        lists = [set(v) if v is not None else set() for v in pdf[bridges]]
        taken: dict = {}
        head, later = [], []
        full = any if strict else all
        for i in pdf[pos].argsort(kind="stable").tolist():
            own = lists[i]
            if len(head) >= window or own and full(taken.get(b, 0) >= per_bridge for b in own):
                later.append(i)
                continue
            head.append(i)
            for b in own:
                taken[b] = taken.get(b, 0) + 1
        return head + later

    return _per_theme(rows, pick, theme)


def pool_three_tiers(seed_refs: DataFrame, *, cap: int = 50, share: int = 4, theme: str = "theme") -> DataFrame:
    """theme, slot, ref: shared references under a quota, then round-robin over seed groups, then whatever came first.

    seed_refs: theme, grp (0, 1, ...), ref, pos (order of mention).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        mentions = list(zip(pdf["grp"], pdf["ref"], strict=True))
        owner: dict = {}
        per: dict[int, list] = {}
        for g, r in mentions:
            owner.setdefault(r, g)
            if r not in per.setdefault(g, []):
                per[g].append(r)
        shared = {r: sum(r in refs for refs in per.values()) for r in owner}
        groups = sorted(per)
        quota = cap if len(groups) <= 1 else max(1, cap // share)
        used, out, taken = dict.fromkeys(groups, 0), [], set()

        def seat(r, g) -> None:
            out.append(r)
            taken.add(r)
            used[g] += 1

        for r in sorted((r for r in owner if shared[r] >= 2), key=lambda r: -shared[r]):
            if len(out) < cap and used[owner[r]] < quota:
                seat(r, owner[r])
        queues = {g: iter(per[g]) for g in groups}
        moved = True
        while moved and len(out) < cap:
            moved = False
            for g in groups:
                if len(out) < cap and used[g] < quota and (r := next((x for x in queues[g] if x not in taken), None)) is not None:
                    seat(r, g)
                    moved = True
        for r in owner:
            if len(out) < cap and r not in taken:
                seat(r, owner[r])
        return pd.DataFrame({theme: [pdf[theme].iloc[0]] * len(out), "slot": range(len(out)), "ref": out})

    kind = dict(seed_refs.dtypes)
    return seed_refs.groupBy(theme).applyInPandas(run, f"{theme} {kind[theme]}, slot int, ref {kind['ref']}")


def bridge_quota(pairs: DataFrame, *, per_bridge: int, limit: int, theme: str = "theme") -> DataFrame:
    """A candidate goes to the first bridge with room; what no bridge had room for fills up at the end.

    pairs: theme, bridge_pos, pos (within the bridge), id; each bridge cut to a page by rank before.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bridge_pos", "pos"], kind="stable")
        got: dict = {}
        spare = []
        room: dict = {}
        for b, i in zip(pdf["bridge_pos"], pdf["id"], strict=True):
            if i in got:
                continue
            if room.get(b, 0) < per_bridge and len(got) < limit:
                got[i] = b
                room[b] = room.get(b, 0) + 1
            else:
                spare.append((b, i))
        for b, i in spare:
            if len(got) >= limit:
                break
            got.setdefault(i, b)
        return pd.DataFrame({theme: [pdf[theme].iloc[0]] * len(got), "slot": range(len(got)), "id": list(got), "bridge_pos": list(got.values())})

    kind = dict(pairs.dtypes)
    return pairs.groupBy(theme).applyInPandas(run, f"{theme} {kind[theme]}, slot int, id {kind['id']}, bridge_pos {kind['bridge_pos']}")


def keep_first_of_keys(rows: DataFrame, keys: Sequence[str], *, theme: str = "theme", pos: str = "pos", standing: str = "standing") -> DataFrame:
    """Sequential dedupe on several keys: a row that meets a held row on any non-empty key goes, without
    registering its other keys, but takes over the slot if its standing is higher. Adds slot."""

    def pick(pdf: pd.DataFrame) -> list[int]:
        cols = [pdf[k].tolist() for k in keys]
        rank = pdf[standing].tolist()
        slots: list[int] = []
        seen: list[dict] = [{} for _ in keys]
        for i in pdf[pos].argsort(kind="stable").tolist():
            at = next((s[c[i]] for s, c in zip(seen, cols, strict=True) if c[i] and c[i] in s), None)
            if at is None:
                at = len(slots)
                slots.append(i)
            elif rank[i] > rank[slots[at]]:
                slots[at] = i
            else:
                continue
            for s, c in zip(seen, cols, strict=True):
                if c[i]:
                    s.setdefault(c[i], at)
        return slots

    return _per_theme(rows, pick, theme)


def keep_first_in_components(rows: DataFrame, keys: Sequence[str], *, key: str = "id", pos: str = "pos", standing: str = "standing") -> DataFrame:
    """keep_first_of_keys over a whole table of distinct ids and positions: theme is the component of rows that share
    keys, so rows that can meet are in one list and others need not be.

    A row goes before if it surely changes nothing: the first row of its first key is the first of its other keys too, so
    it holds the key, and its standing is no lower. Large groups of copies are one row then; what is left of a component
    is one list.
    """
    lead = keys[0]
    # whether a row is the first of each of its other keys
    sure = rows
    for i, k in enumerate(keys[1:]):
        firsts = rows.where(F.col(k) != "").groupBy(F.col(k).alias("__k")).agg(F.min(pos).alias(f"__first{i}"))
        sure = sure.join(firsts, F.col(k) == F.col("__k"), "left").drop("__k")
    first = [F.coalesce(F.col(pos) == F.col(f"__first{i}"), F.lit(True)) for i in range(len(keys) - 1)]
    sure = sure.withColumn("__sure", reduce(lambda a, b: a & b, first, F.lit(True))).select(*rows.columns, "__sure")
    heads = sure.where(F.col(lead) != "").groupBy(F.col(lead).alias("__k")).agg(F.min(F.struct(F.col(pos).alias("at"), "__sure", F.col(standing).alias("standing"))).alias("__head"))
    same = sure.drop("__sure").join(heads, F.col(lead) == F.col("__k"), "left")
    idle = F.col("__head.__sure") & (F.col(pos) > F.col("__head.at")) & (F.col(standing) <= F.col("__head.standing"))
    live = cut(same.where(~F.coalesce(idle, F.lit(False))).select(*rows.columns))
    groups = dedup.duplicate_groups(live.select(key), dedup.key_edges(live, keys, key=key), key=key).select(F.col("id").alias("__id"), F.col("grp").alias("theme"))
    sizes = groups.groupBy("theme").agg(F.count("*").alias("__n"))
    listed = live.join(groups, F.col(key) == F.col("__id")).drop("__id").join(sizes, "theme")
    alone = listed.where("__n = 1").drop("__n").withColumn("slot", F.lit(0))
    return alone.unionByName(keep_first_of_keys(listed.where("__n > 1").drop("__n"), keys, pos=pos, standing=standing))
