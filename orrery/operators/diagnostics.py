"""What a run can say about itself: seeds, head window, routes, coverage, topics; and the lines that render it.

Tables here are rosters, pools and candidate lists, bounded by their own limits, or one-row summaries; the
summaries over references are aggregated before anything small is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import text as T


def seed_rows(seeds: DataFrame, seed_hits: DataFrame) -> DataFrame:
    """seeds plus bridge_contribution: how many of a seed's references are in the pool."""
    n = seed_hits.groupBy("id").agg(F.countDistinct("ref").alias("bridge_contribution"))
    return seeds.join(n, "id", "left").withColumn("bridge_contribution", F.coalesce("bridge_contribution", F.lit(0)))


def top_topics(works: DataFrame, key: str, *, top: int | None = None) -> DataFrame:
    """key, n: how often each non-empty key occurs, most frequent first."""
    counts = works.where(T.text_or_empty(F.col(key)) != "").groupBy(key).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), key)
    return counts.limit(top) if top else counts


def head_share(ranked: DataFrame, cand_hits: DataFrame, *, window: int = 10, pos: str = "pos") -> DataFrame:
    """One row: the busiest bridge, its candidates among all and within the first places, the mean number of bridges.

    ranked: id, pos (from 0).
    """
    hits = cand_hits.join(ranked.select("id", F.col(pos).alias("__pos")), "id")
    per = hits.groupBy("ref").agg(F.countDistinct("id").alias("n"), F.count_distinct(F.when(F.col("__pos") < window, F.col("id"))).alias("head"))
    top = per.agg(F.max_by("ref", F.struct("n", -F.col("ref"))).alias("top_bridge"), F.max("n").alias("top_candidates"), F.max_by("head", F.struct("n", -F.col("ref"))).alias("top_in_head"))
    size = ranked.agg(F.count("*").alias("candidates"), F.count_if(F.col(pos) < window).alias("window"))
    mean = hits.agg(F.count_distinct("id", "ref").alias("shared_total"))
    return size.join(top, how="cross").join(mean, how="cross")  # one row each


def lexical_bridges_last(pool: DataFrame, routes: DataFrame, *, lexical: str = "lexical") -> DataFrame:
    """pool (slot, ref) with new slots and moved: bridges that only the lexical leg cites go behind the others, both in order.

    Nothing moves where no bridge is cited by the other leg. routes: ref, route.
    """
    tagged = pool.join(routes, "ref", "left")
    any_other = F.max((~F.col("route").isin(lexical, "none")).cast("int")).over(W.partitionBy()) == 1  # a pool's few dozen rows
    moved = F.coalesce((F.col("route") == lexical) & any_other, F.lit(False))
    tagged = tagged.withColumn("moved", moved)
    return tagged.withColumn("slot", F.row_number().over(W.orderBy(F.col("moved").cast("int"), "slot")) - 1).select("slot", "ref", "moved")


def candidate_routes(candidates: DataFrame, cand_hits: DataFrame, routes: DataFrame) -> DataFrame:
    """id, route: the leg whose bridges alone a candidate came through, both, or none."""
    got = cand_hits.join(F.broadcast(routes), "ref").groupBy("id").agg(F.collect_set("route").alias("__r"))
    j = candidates.select("id").join(got, "id", "left")
    return j.select("id", F.when(F.coalesce(F.size("__r"), F.lit(-1)) < 1, "none").when(F.size("__r") == 1, F.element_at("__r", 1)).otherwise("both").alias("route"))


def coverage_summary(seeds: DataFrame, refs: DataFrame, seed_hits: DataFrame, pool: DataFrame) -> DataFrame:
    """One row: pool size, references that several seeds share, the two largest contributions and all, seeds with references but none in the pool."""
    per = seed_hits.groupBy("id").agg(F.countDistinct("ref").alias("k"))
    shared = seed_hits.groupBy("ref").agg(F.countDistinct("id").alias("n")).agg(F.count_if(F.col("n") >= 2).alias("shared"))
    top = per.agg(F.slice(F.sort_array(F.collect_list("k"), asc=False), 1, 2).alias("__top"), F.coalesce(F.sum("k"), F.lit(0)).alias("contributed"))  # one number a seed
    absent = refs.join(F.broadcast(seeds.select("id")), "id", "left_semi").select("id").distinct().join(per.select("id"), "id", "left_anti").agg(F.count("*").alias("absent"))
    n = pool.agg(F.count("*").alias("pool"))
    out = n.join(shared, how="cross").join(top, how="cross").join(absent, how="cross")  # one row each
    return out.select("pool", "shared", F.aggregate("__top", F.lit(0).cast("long"), lambda a, x: a + x).alias("top2"), "contributed", "absent")


def stability(values: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, mean, std (population; 0 for one value), low, high over repeated scores, rounded to three places."""
    v = F.col(value)
    got = values.where(v.isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(v), 3).alias("mean"), F.round(F.stddev_pop(v), 3).alias("std"), F.round(F.min(v), 3).alias("low"), F.round(F.max(v), 3).alias("high"))
    return values.select(key).distinct().join(got, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def two_piers(rows: DataFrame, a: str = "match_a", b: str = "match_b", *, least: float = 0.45) -> DataFrame:
    """rows plus weaker (the smaller match), product, and whether both piers stand."""
    return rows.withColumn("weaker", F.least(a, b)).withColumn("product", F.col(a) * F.col(b)).withColumn("stands", (F.least(a, b) >= least) & ~F.coalesce(F.col("false_bridge"), F.lit(False)))


def percent(part: Column, whole: Column) -> Column:
    return F.concat(F.bround(part * 100 / F.greatest(whole, F.lit(1)), 0).cast("int").cast("string"), F.lit("%"))


def head_note(head: DataFrame, *, per_bridge: int = 2) -> DataFrame:
    """line: what ordering the first places achieved, from head_share's row."""
    share = percent(F.col("top_in_head"), F.col("window"))
    held = F.col("top_in_head") * F.greatest("window", F.lit(1)) <= per_bridge * F.col("window")
    why = F.when(F.col("shared_total") > F.col("candidates"), "candidates cite several bridges, and only those whose bridges are all full wait").otherwise("nearly all candidates hang on one bridge")
    text = F.when(F.coalesce("top_in_head", F.lit(0)) == 0, "head window: nothing to order").when(held, F.concat(F.lit(f"head window: at most {per_bridge} of a bridge, the busiest holds "), share)).otherwise(F.concat(F.lit("head window: not diverse, the busiest bridge holds "), share, F.lit("; "), why))
    return head.select(text.alias("line"))


def alignment_line(rows: DataFrame, *, level: str) -> DataFrame:
    """line: how many known seeds sit at home, from stats.alignment's row (known, home_n, unknown)."""
    return rows.select(F.concat_ws("", F.lit(f"roster at {level}: "), F.col("home_n"), F.lit(" of "), F.col("known"), F.lit(" at home ("), percent(F.col("home_n"), F.col("known")), F.lit("), "), F.col("unknown"), F.lit(" not filed")).alias("line"))


def routes_line(bridges: DataFrame, candidates: DataFrame) -> DataFrame:
    """line: bridges and candidates by route. bridges, candidates: route."""
    n = lambda df, p: df.agg(*[F.count_if(F.col("route") == r).alias(f"{p}_{r}") for r in ("lexical", "semantic", "both", "none")])
    said = lambda p: [x for r in ("lexical", "semantic", "both", "none") for x in (F.lit(f" {r} "), F.col(f"{p}_{r}"))]
    return n(bridges, "b").join(n(candidates, "c"), how="cross").select(F.concat_ws("", F.lit("bridges:"), *said("b"), F.lit("; candidates:"), *said("c")).alias("line"))  # one row each


def filing_line(filed: DataFrame) -> DataFrame:
    """line: candidates by where their topic was seen. filed: filed."""
    n = filed.agg(*[F.count_if(F.col("filed") == f).alias(f) for f in ("roster", "pool", "new", "none")])
    return n.select(F.concat_ws("", F.lit("topics seen in the roster "), F.col("roster"), F.lit(", in the pool "), F.col("pool"), F.lit(", nowhere "), F.col("new"), F.lit(", not filed "), F.col("none")).alias("line"))


def coverage_line(cov: DataFrame) -> DataFrame:
    return cov.select(F.concat_ws("", F.lit("pool of "), F.col("pool"), F.lit(", shared by several seeds "), F.col("shared"), F.lit(", two seeds give "), percent(F.col("top2"), F.col("contributed")), F.lit(", seeds without a bridge "), F.col("absent")).alias("line"))


def facet_line(counts: DataFrame) -> DataFrame:
    """line: one text over all facets in order, from collect.facet_counts. A run has a handful of facets."""
    one = F.concat_ws("", F.lit("facet "), F.col("facet"), F.lit(": "), F.col("returned"), F.lit(" returned, "), F.col("kept"), F.lit(" kept, "), F.col("selected"), F.lit(" selected"), F.when(F.col("status") != "ok", F.concat(F.lit(" ("), F.col("status"), F.lit(")"))))
    return counts.select("facet", one.alias("s")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("facet", "s"))), lambda x: x["s"]), " / ").alias("line"))


def keyword_line(matched: Column, include: list[str]) -> Column:
    """Which of the theme's keywords a record matches."""
    return F.when(F.size(matched) > 0, F.concat(F.lit("matches "), F.size(matched).cast("string"), F.lit(f" of {len(include)}: "), F.array_join(matched, ", "))).otherwise(F.lit(f"matches none of {len(include)} keywords"))


def legs_line(legs: DataFrame) -> DataFrame:
    """line: totals and turns of search legs in order. legs: leg, keyword, total, turns."""
    one = F.concat_ws("", F.col("keyword"), F.lit(" "), F.coalesce(F.col("total").cast("string"), F.lit("?")), F.lit(" ("), F.col("turns"), F.lit(")"))
    return legs.select("leg", one.alias("s")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("leg", "s"))), lambda x: x["s"]), " / ").alias("line"))


def home_line(themes: DataFrame, resolved: DataFrame, fields: DataFrame, parents: DataFrame, *, key: str = "theme", text: str = "scope_field") -> DataFrame:
    """key, line: the fields that a theme's scope resolved to; else the fields above a subfield it names; else that it resolved to none.

    resolved: key, field_id; fields: field_id, name; parents: key, name.
    """
    names = resolved.join(F.broadcast(fields), "field_id").groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("name")), " / ").alias("names"))
    above = parents.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("name")), " / ").alias("above"))
    scope = T.collapse_ws(F.col(text))
    line = F.when(F.col("names").isNotNull(), F.concat(F.lit("home "), scope, F.lit(": "), F.col("names"))).when(F.col("above").isNotNull(), F.concat(F.lit("home "), scope, F.lit(": a subfield of "), F.col("above"), F.lit(", not a field"))).otherwise(F.concat(F.lit("home "), scope, F.lit(": no field")))
    return themes.join(names, key, "left").join(above, key, "left").select(key, line.alias("line"))


def ids_line(rows: DataFrame, *, pos: str = "pos") -> DataFrame:
    """line: every candidate's short id in order. A candidate list is bounded by its limit."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), T.short_id(F.col("id")).alias("i")))), lambda x: x["i"])
    return rows.agg(F.concat_ws("", F.lit("candidates ("), F.count("*"), F.lit("): "), F.array_join(ids, ", ")).alias("line"))


def home_domain_line(candidates: DataFrame, home: DataFrame, *, deferred: int, domain: str = "domain") -> DataFrame:
    """line: how many candidates lie in the home domains, and how many of those waited. One row."""
    h = home.select(F.col(home.columns[0]).alias("__h")).distinct()
    j = candidates.join(F.broadcast(h), F.col(domain) == F.col("__h"), "left")
    return j.agg(F.concat_ws("", F.lit("home domain: "), F.count("__h"), F.lit(" of "), F.count("*"), F.lit(f" candidates inside, {deferred} deferred")).alias("line"))


def title_only_line(rows: DataFrame, *, cls: str = "class") -> DataFrame:
    """line: the candidates whose abstract only restates the title (null: none)."""
    hit = F.collect_list(F.when(F.col(cls).isNotNull(), T.short_id(F.col("id"))))
    return rows.agg(F.when(F.count(cls) > 0, F.concat_ws("", F.lit("abstracts that restate the title: "), F.array_join(F.sort_array(hit), ", "))).alias("line"))


def score_only_line(report: DataFrame) -> DataFrame:
    """line: how many candidates came as scores alone (null: none), from contract.submission_report."""
    n = F.count_if(F.col("what") == "score_only")
    return report.agg(F.when(n > 0, F.concat_ws("", n, F.lit(" candidates sent as scores alone count for the gate and are not rendered"))).alias("line"))


def saturation_text(run: DataFrame) -> DataFrame:
    """line: why a run gave nothing new, or what it kept, from gates.saturation."""
    kept = F.concat_ws("", F.lit("kept "), F.col("qualified"), F.lit(" of "), F.col("scored"))
    lost = F.concat_ws("", F.lit(" (anomaly "), F.col("anomaly"), F.lit(", hollow "), F.col("hollow"), F.lit(", gate "), F.col("gated"), F.lit(", floor "), F.col("floored"), F.lit(")"))
    return run.select(F.when(F.col("status") == "ok", F.concat(kept, lost)).otherwise(F.concat(F.lit("saturated, "), F.col("status"), F.lit(": nothing new this run"), lost)).alias("line"))


def block(*lines: DataFrame) -> DataFrame:
    """pos, line: one-row lines under each other, without the empty ones."""
    out = None
    for i, one in enumerate(lines):
        row = one.select(F.lit(i).alias("pos"), "line").where("line IS NOT NULL AND line <> ''")
        out = row if out is None else out.unionByName(row)
    return out
