"""Collection across shared references as it is composed: seed groups, the three-tier pool, a fair share a bridge, backfill.

works: id, field, domain, topic (nullable), type, n_refs, retracted, cites. Rosters, pools and pages are
bounded by their own limits (some dozens of rows each), so only they are broadcast and walked in order;
works and references are filtered, joined and cut to pages as whole tables.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators import dedup, diversify, gates, graph

#: Share of one bridge, references of an article at most, rows of a page, pages of the backfill.
QUOTA_DIVISOR, MAX_REFS, PER_PAGE, MAX_PAGES = 10, 100, 50, 3
#: The four domains by their fields.
FIELD_DOMAINS = {"1": ("11", "13", "24", "28", "30"), "2": ("12", "14", "18", "20", "32", "33"), "3": ("15", "16", "17", "19", "21", "22", "23", "25", "26", "31"), "4": ("27", "29", "34", "35", "36")}
DOMAIN_NAMES = {"1": "Life Sciences", "2": "Social Sciences", "3": "Physical Sciences", "4": "Health Sciences"}


def domain_of(field: Column) -> Column:
    """The domain of a field; null where there is none."""
    out = F.lit(None).cast("string")
    for domain, fields in FIELD_DOMAINS.items():
        out = F.when(field.cast("string").isin(*fields), domain).otherwise(out)
    return out


def seed_groups(seeds: DataFrame, refs: DataFrame, *, percent: int = graph.DUP_JACCARD_PERCENT, least: int = graph.DUP_MIN_REFS) -> DataFrame:
    """id, grp (0, 1, ... in the order of seeds): records of one work share a group.

    seeds: id, pos, dk (DOI key), tk (title key). One work is who shares a DOI key, a title key or nearly all
    references; groups are the components of all three relations together.
    """
    keyed = dedup.key_edges(seeds.select(F.col("pos").alias("id"), "dk", "tk"), ["dk", "tk"])
    at = seeds.select("id", "pos")
    own = graph.edges_of(seeds, refs)
    near = graph.shared_reference_pairs(own, percent=percent, least=least)
    near = near.join(at.select(F.col("id").alias("a"), F.col("pos").alias("pa")), "a").join(at.select(F.col("id").alias("b"), F.col("pos").alias("pb")), "b")
    edges = keyed.unionByName(near.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")))
    groups = dedup.duplicate_groups(at.select(F.col("pos").alias("id")), edges).select(F.col("id").alias("pos"), F.col("grp").alias("root"))
    # a roster's groups in the order of their first seeds
    return at.join(groups, "pos").withColumn("grp", F.dense_rank().over(W.orderBy("root")) - 1).select("id", "pos", "grp")


def pool_of_groups(groups: DataFrame, seed_refs: DataFrame, *, cap: int = graph.POOL, share: int = graph.SHARE) -> DataFrame:
    """slot, ref: the three-tier pool over seed groups. seed_refs: id, ref, at (place in the seed's list)."""
    rows = groups.join(seed_refs, "id")
    order = F.row_number().over(W.orderBy("pos", "at", "ref"))  # some dozens of seeds' references
    return diversify.pool_three_tiers(rows.select(F.lit(0).alias("theme"), "grp", "ref", order.alias("pos")), cap=cap, share=share).select("slot", "ref")


def home_concepts(seed_tags: DataFrame) -> DataFrame:
    """name: the root concepts (level 0) of the seeds; seed_tags: id, name, level."""
    return seed_tags.where("level = 0").select("name").where("name <> ''").distinct()


def citation_scope(works: DataFrame, seeds: DataFrame, *, home_fields: DataFrame, home_topics: DataFrame | None = None, concepts: DataFrame | None = None, tags: DataFrame | None = None, used: DataFrame | None = None, max_refs: int = MAX_REFS, work_type: str | None = "article") -> DataFrame:
    """The works a candidate may be: an article of fewer than max_refs references, neither retracted, seed nor used,
    outside the home fields and topics; where the seeds have no field, outside their root concepts instead.

    A work without field or topic stays, as a filter that excludes values keeps it.
    """
    rows = works.where(~F.coalesce(F.col("retracted"), F.lit(False)) & (F.col("n_refs") < max_refs))
    if work_type is not None:
        rows = rows.where(gates.type_allowed(F.col("type"), work_type))
    rows = rows.join(seeds.select("id"), "id", "left_anti")
    if used is not None:
        rows = rows.join(used.select(F.col(used.columns[0]).alias("id")), "id", "left_anti")
    for home, c in ((home_fields, "field"), (home_topics, "topic")):
        if home is not None:
            rows = rows.join(F.broadcast(home.select(F.col(home.columns[0]).alias("__home"))), F.col(c) == F.col("__home"), "left_anti")
    if concepts is not None and tags is not None:
        fieldless = home_fields.agg((F.count("*") == 0).alias("__none"))  # one row
        root = concepts.join(F.broadcast(fieldless), how="cross").where("__none").select("name")
        rows = rows.join(tags.join(F.broadcast(root), "name").select("id").distinct(), "id", "left_anti")
    return rows


def bridge_pages(scope: DataFrame, refs: DataFrame, pool: DataFrame, *, page: int) -> DataFrame:
    """slot, ref, pos, id and the work's columns: each bridge's first page of citers, most cited first."""
    into = refs.join(F.broadcast(pool.select("slot", "ref")), "ref")
    rn = F.row_number().over(W.partitionBy("ref").orderBy(F.col("cites").desc(), "id"))
    return into.join(scope, "id").withColumn("pos", rn).where(F.col("pos") <= page)


def any_bridge_pages(scope: DataFrame, refs: DataFrame, pool: DataFrame, *, rows: int) -> DataFrame:
    """pos, id and the work's columns: the first rows of all citers of any bridge, most cited first."""
    citers = refs.join(F.broadcast(pool.select("ref")), "ref", "left_semi").select("id").distinct()
    top = scope.join(citers, "id", "left_semi").orderBy(F.col("cites").desc(), "id").limit(rows)
    return top.withColumn("pos", F.row_number().over(W.orderBy(F.col("cites").desc(), "id")))


def fair_share(pages: DataFrame, backfill: DataFrame, *, quota: int, limit: int, kinds: Column | None = None) -> DataFrame:
    """slot, id, bridge (null: from the backfill): bridges take their share in pool order, the backfill what is left.

    With kinds a bridge's share goes to the lower kinds of its page first. Every list is bounded by its pages.
    """
    kind = F.lit(0) if kinds is None else kinds
    listed = pages.select(F.col("slot").alias("turn"), kind.alias("kind"), "pos", "id").unionByName(backfill.select(F.lit(None).cast("int").alias("turn"), F.lit(0).alias("kind"), "pos", "id"))
    listed = listed.withColumn("theme", F.lit(0))
    name = dict(listed.dtypes)["id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got: dict = {}
        for turn, page in pdf[pdf["turn"].notna()].sort_values(["turn", "kind", "pos"]).groupby("turn", sort=True):
            taken = 0
            for i in page["id"]:
                if taken >= quota or len(got) >= limit:
                    break
                if i not in got:
                    got[i] = int(turn)
                    taken += 1
        for i in pdf[pdf["turn"].isna()].sort_values("pos")["id"]:
            if len(got) >= limit:
                break
            got.setdefault(i, None)
        return pd.DataFrame({"slot": range(len(got)), "id": list(got), "bridge": pd.array(list(got.values()), dtype="Int64")})

    return listed.groupBy("theme").applyInPandas(run, f"slot int, id {name}, bridge int")


def collect_candidates(works: DataFrame, refs: DataFrame, seeds: DataFrame, pool: DataFrame, *, home_fields: DataFrame, home_topics: DataFrame | None = None, home_domains: DataFrame | None = None, concepts: DataFrame | None = None, tags: DataFrame | None = None, used: DataFrame | None = None, limit: int = 60, quota: int | None = None, max_refs: int = MAX_REFS, work_type: str | None = "article", per_page: int = PER_PAGE, max_pages: int = MAX_PAGES) -> DataFrame:
    """slot, id, bridge: candidates over the pool (slot, ref), by a fair share a bridge and a backfill over all bridges.

    With home_domains a bridge's share goes to other domains first, then to the home ones, then to works without one.
    A quota of 0 leaves the backfill alone.
    """
    quota = max(1, limit // QUOTA_DIVISOR) if quota is None else quota
    scope = citation_scope(works, seeds, home_fields=home_fields, home_topics=home_topics, concepts=concepts, tags=tags, used=used, max_refs=max_refs, work_type=work_type)
    page = max(quota, min(per_page, quota * (4 if home_domains is not None else 2)))
    pages = bridge_pages(scope, refs, pool, page=page)
    kinds = None
    if home_domains is not None:
        home = F.broadcast(home_domains.select(F.col(home_domains.columns[0]).alias("__home")))
        pages = pages.join(home, F.col("domain") == F.col("__home"), "left")
        kinds = F.when(F.col("domain").isNull(), 2).when(F.col("__home").isNotNull(), 1).otherwise(0)
    if not quota:
        pages = pages.where("false")
    return fair_share(pages, any_bridge_pages(scope, refs, pool, rows=per_page * max_pages), quota=quota, limit=limit, kinds=kinds)


def facet_stages(returned: DataFrame, used: DataFrame, *, home_share: int = 60, least: int = 3) -> DataFrame:
    """returned plus stage: what a facet's record meets on its way into the facet's list.

    returned: facet, pos, id, title, home (bool), type_ok, retracted, supplement, has_abstract. Facets of too few records
    or with too many home ones are rejected whole; then home works, supplements, used ids and works without abstract go.
    """
    kept = F.coalesce(F.col("type_ok"), F.lit(True)) & ~F.coalesce(F.col("retracted"), F.lit(False))
    raw = returned.where(kept)
    per = raw.groupBy("facet").agg(F.count("*").alias("__n"), F.count_if("home").alias("__home"))
    n, h = F.col("__n"), F.col("__home")
    verdict = F.when(n < least, "too_few").when(h * 100 > n * home_share, "home_converged").when(n - h < 1, "no_distant")
    known = used.select(F.col(used.columns[0]).alias("__used")).distinct()
    rows = raw.join(F.broadcast(per.withColumn("__verdict", verdict).select("facet", "__verdict")), "facet").join(known, F.col("id") == F.col("__used"), "left")
    stage = F.coalesce(F.col("__verdict"), F.when(F.col("home"), "home").when(F.col("supplement"), "supplement").when(F.col("__used").isNotNull(), "used").when(~F.col("has_abstract"), "no_abstract"), F.lit("kept"))
    return rows.withColumn("stage", stage).drop("__verdict", "__used")


def facet_buckets(kept: DataFrame, keys: list[str], *, standing: str = "standing", off_language: Column | None = None) -> DataFrame:
    """facet, slot in the facet's list, id: records that share a key take one slot, in the facet and at the place of the first and held by the better one.

    kept: facet, pos, id, the keys and standing, of one theme (some dozens of records a facet). A record that meets a held one
    registers no further key unless it takes the slot over. With off_language such records go to the end of their facet's
    list, in order.
    """
    off = F.lit(False) if off_language is None else F.coalesce(off_language, F.lit(False))
    listed = kept.select(F.lit(0).alias("theme"), "facet", "pos", "id", *keys, F.col(standing).alias("__standing"), off.alias("__off"))
    kinds = dict(listed.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["facet", "pos"], kind="stable").reset_index(drop=True)
        cols = [pdf[k].tolist() for k in keys]
        better = pdf["__standing"].tolist()
        first: list[int] = []
        held: list[int] = []
        seen: list[dict] = [{} for _ in keys]
        for i in range(len(pdf)):
            at = next((s[c[i]] for s, c in zip(seen, cols, strict=True) if c[i] and c[i] in s), None)
            if at is None:
                at = len(held)
                first.append(i)
                held.append(i)
            elif better[i] > better[held[at]]:
                held[at] = i
            else:
                continue
            for s, c in zip(seen, cols, strict=True):
                if c[i]:
                    s.setdefault(c[i], at)
        return pd.DataFrame({"facet": pdf["facet"].iloc[first].tolist(), "place": first, "id": pdf["id"].iloc[held].tolist(), "off": pdf["__off"].iloc[held].astype(int).tolist()})

    rows = listed.groupBy("theme").applyInPandas(run, f"facet {kinds['facet']}, place int, id {kinds['id']}, off int")
    slot = F.row_number().over(W.partitionBy("facet").orderBy("off", "place")) - 1
    return rows.withColumn("slot", slot).select("facet", "slot", "id", F.col("off").alias("off_language"))


def facet_select(buckets: DataFrame, *, limit: int, fair: bool = True) -> DataFrame:
    """facet, slot, id, place: round-robin over facets in their order, or facet after facet."""
    order = ["slot", "facet"] if fair else ["facet", "slot"]
    top = buckets.orderBy(*order).limit(limit)
    return top.withColumn("place", F.row_number().over(W.orderBy(*order)))


def facet_counts(stages: DataFrame, buckets: DataFrame, selected: DataFrame) -> DataFrame:
    """facet, returned, home_excluded, supplement_excluded, kept, off_language, selected, status."""
    n = lambda s: F.count_if(F.col("stage") == s)
    a = stages.groupBy("facet").agg(F.count("*").alias("returned"), n("home").alias("home_excluded"), n("supplement").alias("supplement_excluded"), F.max(F.when(F.col("stage").isin("too_few", "home_converged", "no_distant"), F.col("stage"))).alias("verdict"))
    b = buckets.groupBy("facet").agg(F.count("*").alias("kept"), F.sum("off_language").alias("off_language"))
    c = selected.groupBy("facet").agg(F.count("*").alias("selected"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x)
    out = reduce(lambda x, y: x.join(y, "facet", "left"), (b, c), a)
    return out.select("facet", "returned", "home_excluded", "supplement_excluded", zero("kept"), zero("off_language"), zero("selected"), F.coalesce("verdict", F.lit("ok")).alias("status"))


def track_b_select(candidates: DataFrame, scores: DataFrame, *, count: int = 1, cap: int = 60, fallback: bool = True) -> tuple[DataFrame, DataFrame]:
    """(selected rows in order, one row of what each stage rejected): farthest-first to the cap, post-gates, diversity.

    candidates: id, pos, names, facet of one theme; scores: id and the judgements of post_gates.
    """
    rows = candidates.withColumn("theme", F.lit(0))
    listed = diversify.farthest_first(rows, cap)
    gated = gates.post_gates(scores.join(F.broadcast(listed.select("id")), "id", "left_semi"))
    kept = gates.with_fallback(gated) if fallback else gated.where("rejected_by IS NULL")
    ranked = kept.join(listed.select("id", "names", "facet", "theme"), "id")
    ranked = ranked.withColumn("pos", F.row_number().over(W.orderBy(F.col("serendipity").desc(), "id")))
    return diversify.mmr(ranked, count, score="serendipity"), gates.saturation(gated)
