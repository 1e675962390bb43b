"""Two-hop reference graph: seed -> shared reference (bridge) <- candidate.

works: id, field (nullable), cites. refs: id, ref, one row for each distinct reference. A
roster of seeds or a pool of bridges is a few dozen rows by construction (its limit is the
operator's own), so it may be broadcast; works and refs never are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.lineage import cut

#: Pool size, share of one seed group, shared references that make a duplicate record.
POOL, SHARE, DUP_JACCARD_PERCENT, DUP_MIN_REFS = 50, 4, 90, 10
#: Works whose pairs one task counts at a time.
BLOCK = 256


def top_seeds(works: DataFrame, n: int = 20, *, by: str = "cites") -> DataFrame:
    return works.orderBy(F.col(by).desc(), "id").limit(n)


def dominant(works: DataFrame, key: str, *, top: int = 2, least: int = 2) -> DataFrame:
    """The most frequent non-null keys with at least so many works; ties by key."""
    return works.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.col("n").desc(), key).limit(top)


def edges_of(works: DataFrame, refs: DataFrame) -> DataFrame:
    return refs.join(F.broadcast(works.select("id")), "id", "left_semi")


def bridge_pool_by_citers(seeds: DataFrame, refs: DataFrame, *, cap: int = POOL) -> DataFrame:
    """ref, seed_citers: the references most seeds share."""
    return edges_of(seeds, refs).groupBy("ref").agg(F.countDistinct("id").alias("seed_citers")).orderBy(F.col("seed_citers").desc(), "ref").limit(cap)


def bridge_pool_tier1(seed_refs: DataFrame, *, cap: int = POOL, share: int = SHARE) -> DataFrame:
    """ref, n: references of two or more seed groups, a quota for each owning group, most shared first.

    seed_refs: grp (seed group, in seed order), ref, pos (place of the first mention).
    """
    per = seed_refs.groupBy("ref").agg(F.countDistinct("grp").alias("n"), F.min(F.struct("pos", "grp")).alias("f")).select("ref", "n", F.col("f.pos").alias("first_seen"), F.col("f.grp").alias("owner"))
    rn = F.row_number().over(W.partitionBy("owner").orderBy(F.col("n").desc(), "first_seen"))
    kept = per.where("n >= 2").withColumn("rn", rn).where(F.col("rn") <= max(1, cap // share))
    return kept.orderBy(F.col("n").desc(), "first_seen").limit(cap).select("ref", "n")


def hits(candidates: DataFrame, refs: DataFrame, pool: DataFrame) -> DataFrame:
    """id, ref of all references into the pool."""
    into = refs.join(F.broadcast(pool.select("ref")), "ref", "left_semi")
    return into.join(candidates.select("id"), "id", "left_semi").select("id", "ref")


def bridge_signals(candidates: DataFrame, found: DataFrame, pool: DataFrame) -> DataFrame:
    """candidates plus shared_bridge_count, bridge_betweenness (most fields behind one bridge) and bridge_strength.

    found: id, ref of the candidates; pool: ref, seed_citers. A null field adds presence, not diversity.
    """
    tagged = found.join(candidates.select("id", "field"), "id")
    reach = tagged.groupBy("ref").agg(F.countDistinct("field").alias("diversity"))
    side = pool.select("ref", "seed_citers").join(reach, "ref", "left")
    per = found.join(F.broadcast(side), "ref").groupBy("id").agg(F.countDistinct("ref").alias("shared_bridge_count"), F.max(F.coalesce("diversity", F.lit(0))).alias("bridge_betweenness"), F.max("seed_citers").alias("bridge_strength"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return candidates.join(per, "id", "left").select(*candidates.columns, zero("shared_bridge_count"), zero("bridge_betweenness"), zero("bridge_strength"))


def two_hop(works: DataFrame, refs: DataFrame, seeds: DataFrame, pool: DataFrame, home: DataFrame, *, limit: int | None = 60) -> DataFrame:
    """Candidates that cite the pool, without seeds and home fields, with their signals, best first."""
    into = refs.join(F.broadcast(pool.select("ref")), "ref", "left_semi").join(F.broadcast(seeds.select("id")), "id", "left_anti")
    home = F.broadcast(home.select(F.col(home.columns[0]).alias("__home")))
    cited = works.join(into.select("id").distinct(), "id").join(home, F.col("field") == F.col("__home"), "left_anti")
    found = into.join(cited.select("id"), "id", "left_semi")
    ranked = bridge_signals(cited, found, pool).orderBy(*rank_keys())
    return ranked.limit(limit) if limit else ranked


def rank_keys() -> list[Column]:
    return [F.col("bridge_betweenness").desc(), F.col("shared_bridge_count").desc(), F.col("cites").desc(), F.col("id").asc()]


def bridge_usage(pool: DataFrame, seed_hits: DataFrame, cand_hits: DataFrame) -> DataFrame:
    """ref, seed_citers, cand_citers; unused bridges stay at 0."""
    n = lambda d, c: d.groupBy("ref").agg(F.countDistinct("id").alias(c))
    out = pool.select("ref").join(n(seed_hits, "seed_citers"), "ref", "left").join(n(cand_hits, "cand_citers"), "ref", "left")
    return out.select("ref", F.coalesce("seed_citers", F.lit(0)).alias("seed_citers"), F.coalesce("cand_citers", F.lit(0)).alias("cand_citers"))


def bridge_concentration(cand_hits: DataFrame) -> DataFrame:
    """One row: the busiest bridge and its candidates, bridges used, candidates, their references, those with one bridge only."""
    per_ref = cand_hits.groupBy("ref").agg(F.countDistinct("id").alias("n"))
    top = per_ref.agg(F.max_by("ref", F.struct("n", "ref")).alias("top_bridge"), F.max("n").alias("top_candidates"), F.count("*").alias("bridges_used"))
    per_id = cand_hits.groupBy("id").agg(F.countDistinct("ref").alias("k"))
    rest = per_id.agg(F.count("*").alias("candidates"), F.sum("k").alias("shared_total"), F.count_if(F.col("k") == 1).alias("single_bridge"))
    return top.join(rest, how="cross")  # one row each


def route_split(tagged: DataFrame, key: str, tag: str, names: tuple[str, str]) -> DataFrame:
    """key, route: which of two legs reach it (first, second, both)."""
    a, b = (F.max((F.col(tag) == n).cast("int")) for n in names)
    got = tagged.groupBy(key).agg(a.alias("a"), b.alias("b"))
    return got.select(key, F.when((F.col("a") == 1) & (F.col("b") == 1), "both").when(F.col("a") == 1, names[0]).when(F.col("b") == 1, names[1]).otherwise("none").alias("route"))


def filing(candidates: DataFrame, roster_topics: DataFrame, pool_topics: DataFrame, topic: str) -> DataFrame:
    """candidates plus filed: roster, pool, new or none (no topic)."""
    a = roster_topics.select(F.col(roster_topics.columns[0]).alias("__a")).distinct()
    b = pool_topics.select(F.col(pool_topics.columns[0]).alias("__b")).distinct()
    j = candidates.join(a, F.col(topic) == F.col("__a"), "left").join(b, F.col(topic) == F.col("__b"), "left")
    filed = F.when(F.col(topic).isNull(), "none").when(F.col("__a").isNotNull(), "roster").when(F.col("__b").isNotNull(), "pool").otherwise("new")
    return j.withColumn("filed", filed).drop("__a", "__b")


def live_bridges(pool: DataFrame, works: DataFrame) -> DataFrame:
    """Bridges that resolve; all of them if none does."""
    from orrery.operators.gates import fallback_if_empty

    return fallback_if_empty(pool.join(works.select(F.col("id").alias("ref")), "ref", "left_semi"), pool)


def small_bridges_first(pool: DataFrame, *, pos: str = "pos", size: str = "size", tail: str = "tail") -> DataFrame:
    return pool.orderBy(F.col(tail).asc(), F.col(size).asc_nulls_last(), F.col(pos).asc())


def seed_coverage(seeds: DataFrame, seed_hits: DataFrame) -> DataFrame:
    """id, pool_refs: how much of the pool each seed contributes; absent seeds stay at 0."""
    n = seed_hits.groupBy("id").agg(F.countDistinct("ref").alias("pool_refs"))
    return seeds.select("id").join(n, "id", "left").select("id", F.coalesce("pool_refs", F.lit(0)).alias("pool_refs"))


def bridge_sizes(cand_hits: DataFrame, sizes: DataFrame) -> DataFrame:
    """id, smallest, largest: citers of the bridges that a candidate goes through."""
    return cand_hits.join(F.broadcast(sizes), "ref").groupBy("id").agg(F.min("size").alias("smallest"), F.max("size").alias("largest"))


def shared_reference_pairs(refs: DataFrame, *, percent: int = DUP_JACCARD_PERCENT, least: int = DUP_MIN_REFS, block: int = BLOCK) -> DataFrame:
    """a, b: works with near-identical reference lists, through their rarest references only.

    Works with the same list are one node: they give a star to the smallest of them, and only that one is
    compared with other lists, so n equal lists give n - 1 rows. Lists of similarity p share one of the
    n - ceil(p n) + 1 rarest references of either, so only those meet; a hub that every list has is
    never paired out. Pairs are counted where their smaller work's block is and never travel; full lists are
    joined for pairs only whose count, with all that lies behind the rarest, can still reach p.
    """
    lists = cut(refs.groupBy("id").agg(F.sort_array(F.collect_list("ref")).alias("list")).where(F.size("list") >= least))
    # works in their own order, each with a number: neighbours share a block
    nodes = lists.groupBy("list").agg(F.min("id").alias("a"), F.count("*").alias("works"))
    nodes = cut(nodes.repartitionByRange("a").sortWithinPartitions("a").select(F.monotonically_increasing_id().alias("no"), "a", "works", "list"))
    stars = lists.join(nodes.where("works > 1").select("a", "list"), "list").where("a <> id").select("a", F.col("id").alias("b"))
    refs = nodes.select("no", F.size("list").alias("n"), F.explode("list").alias("ref"))
    df = refs.groupBy("ref").agg(F.count("*").alias("df"))
    rn = F.row_number().over(W.partitionBy("no").orderBy("df", "ref"))
    rare = refs.join(df, "ref").withColumn("rn", rn).where((F.col("rn") <= F.col("n") - F.ceil(F.col("n") * percent / 100.0) + 1) & (F.col("df") > 1))
    met = rare.groupBy("ref").agg(F.sort_array(F.collect_list(F.struct("no", "n"))).alias("m")).where(F.size("m") > 1)
    blocks = F.array_distinct(F.transform("m", lambda e: F.floor(e["no"] / block)))
    # of each block's members the pairs with all that follow
    sent = met.select(F.explode(blocks).alias("block"), "m").select("block", F.filter("m", lambda e: e["no"] >= F.col("block") * block).alias("m"))
    sent = sent.select("block", F.col("m.no").alias("no"), F.col("m.n").alias("n")).where(F.size("no") > 1)

    def count(rows: pa.Table) -> pa.Table:
        return _counted(rows, percent, block)

    cand = cut(sent.groupBy("block").applyInArrow(count, "x long, y long"))
    side = lambda c, a, m: nodes.select(F.col("no").alias(c), F.col("a").alias(a), F.col("list").alias(m))
    both = cand.join(side("x", "a", "la"), "x").join(side("y", "b", "lb"), "y")
    k = F.size(F.array_intersect("la", "lb"))
    return stars.unionByName(both.where(k * 100 >= (F.size("la") + F.size("lb") - k) * percent).select("a", "b"))


def _counted(rows: pa.Table, percent: int, width: int) -> pa.Table:
    """x, y: pairs of a block's works and later ones whose shared rare references, with all references behind the rare ones, can reach the similarity.

    A list shows the n - ceil(p n) + 1 rarest; references shared behind the place where the first of two lists ends its rarest are
    among the ceil(p n) - 1 that this list does not show.
    """
    block = rows["block"][0].as_py()
    offs, flat = (lambda c: (np.append(0, np.cumsum(pc.list_value_length(c).to_numpy())), c.combine_chunks().flatten().to_numpy()))(rows["no"])
    sizes = rows["n"].combine_chunks().flatten().to_numpy().astype(np.int64)
    works, first = np.unique(flat, return_index=True)
    size, at = sizes[first], np.searchsorted(works, flat)
    here = int(np.searchsorted(works, (block + 1) * width))
    # members of one reference are in order, those of the block first
    ref = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    mine = np.flatnonzero(at < here)
    mine = mine[np.argsort(at[mine], kind="stable")]
    cuts = np.searchsorted(at[mine], np.arange(here + 1))
    behind = -(-size * percent // 100) - 1
    out = [np.zeros((2, 0), np.int64)]
    for x in range(here):
        own = mine[cuts[x] : cuts[x + 1]]
        ends = offs[ref[own] + 1]
        spans = ends - own - 1
        k = np.bincount(at[np.repeat(own + 1 - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())], minlength=len(works))
        y = np.flatnonzero(k)
        near = (size[x] * 100 >= size[y] * percent) & (size[y] * 100 >= size[x] * percent)
        most = k[y] + np.maximum(behind[x], behind[y])
        y = y[near & (most * 100 >= (size[x] + size[y] - most) * percent)]
        out.append(np.stack([np.full(len(y), works[x]), works[y]]))
    x, y = np.concatenate(out, 1)
    return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})
