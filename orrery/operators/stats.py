"""Aggregations: salient terms, theme profile, alignment, keyword breakdown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOKEN = r"[a-z][a-z\-]{2,}"


def salient_terms(docs: DataFrame, *, text: str = "text", stop: Sequence[str] = (), known: Sequence[str] = (), top: int = 6, least: int = 2) -> DataFrame:
    """term, df, tf: terms of two or more documents, without stop words and known terms, best first."""
    words = docs.select("id", F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))).alias("term"))
    per_doc = words.groupBy("term", "id").agg(F.count("*").alias("c"))
    got = per_doc.groupBy("term").agg(F.count("*").alias("df"), F.sum("c").alias("tf")).where(F.col("df") >= least)
    drop = sorted({*stop, *known})
    got = got.where(~F.col("term").isin(*drop)) if drop else got
    return got.orderBy(F.col("df").desc(), F.col("tf").desc(), "term").limit(top)


def salient_terms_by(docs: DataFrame, group: str, known: DataFrame, *, text: str = "text", stop: Sequence[str] = (), top: int = 6, least: int = 2) -> DataFrame:
    """group, rank (from 0), term: salient_terms of every group at once; known: group, term to leave out. docs: group, id, text."""
    words = docs.select(group, "id", F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))).alias("term"))
    words = words.where(~F.col("term").isin(*stop)) if stop else words
    per_doc = words.groupBy(group, "term", "id").agg(F.count("*").alias("c"))
    got = per_doc.groupBy(group, "term").agg(F.count("*").alias("df"), F.sum("c").alias("tf")).where(F.col("df") >= least)
    order = W.partitionBy(group).orderBy(F.col("df").desc(), F.col("tf").desc(), "term")
    return got.join(known, [group, "term"], "left_anti").withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < top).select(group, "rank", "term")


def theme_profile(tags: DataFrame, *, top: int = 20) -> DataFrame:
    """name, weight, broad: broad names (level 0 or 1) and the heaviest names of level 1 and deeper. tags: name, level, score."""
    tags = tags.where("name <> ''")
    heavy = tags.where("level >= 1").groupBy("name").agg(F.sum("score").alias("weight")).orderBy(F.col("weight").desc(), "name").limit(top)
    broad = tags.where("level <= 1").select("name").distinct().withColumn("broad", F.lit(True))
    return heavy.join(broad, "name", "full").select("name", "weight", F.coalesce("broad", F.lit(False)).alias("broad"))


def near_domain(work_tags: DataFrame, profile: DataFrame, *, percent: int = 30) -> DataFrame:
    """id, inter, union_n, near: share of broad names that work and theme have in common. A profile has a few dozen rows."""
    broad = profile.where("broad").select("name")
    own = work_tags.where("level <= 1 AND name <> ''").select("id", "name").distinct()
    inter = own.join(F.broadcast(broad.withColumn("hit", F.lit(1))), "name", "left").groupBy("id").agg(F.count("*").alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("inter"))
    size = broad.agg(F.count("*").alias("m"))
    got = inter.join(F.broadcast(size), how="cross")  # one row
    return got.select("id", "inter", (F.col("n") + F.col("m") - F.col("inter")).alias("union_n")).withColumn("near", (F.col("union_n") > 0) & (F.col("inter") * 100 > F.col("union_n") * percent))


def jaccard_pairs(tags: DataFrame, *, least: int = 1) -> DataFrame:
    """a, b, inter, union_n of works that share a name; through an inverted list, for bounded rosters of works."""
    own = tags.select("id", "name").distinct()
    n = own.groupBy("id").agg(F.count("*").alias("n"))
    pairs = own.alias("x").join(own.alias("y"), (F.col("x.name") == F.col("y.name")) & (F.col("x.id") < F.col("y.id"))).groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.count("*").alias("inter")).where(F.col("inter") >= least)
    return pairs.join(n.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b").select("a", "b", "inter", (F.col("na") + F.col("nb") - F.col("inter")).alias("union_n"))


def alignment(rows: DataFrame, key: Column, home: Sequence) -> DataFrame:
    """One row: known, home_n, unknown. Unknown keys leave the denominator."""
    hit = key.isin(*home) if home else F.lit(False)
    return rows.agg(F.count(key).alias("known"), F.count_if(hit).alias("home_n"), F.count_if(key.isNull()).alias("unknown"))


def keyword_breakdown(rows: DataFrame, include: Sequence[str], strong: Column, body: Column) -> DataFrame:
    """keyword, strong, readme, total: how many records match each keyword, by surface."""
    from orrery.functions import text as T

    normal = F.struct(T.padded(strong).alias("s"), T.padded(body).alias("b"))
    kinds = lambda r: F.array(*[F.struct(F.lit(k).alias("keyword"), T.phrase_in(r["s"], T.padded(F.lit(k))).alias("s"), T.phrase_in(r["b"], T.padded(F.lit(k))).alias("b")) for k in include])
    e = rows.select(F.explode(T.once(normal, kinds)).alias("e")).select("e.*")
    return e.groupBy("keyword").agg(F.count_if("s").alias("strong"), F.count_if(~F.col("s") & F.col("b")).alias("readme"), F.count_if(F.col("s") | F.col("b")).alias("total"))


def facet_validity(rows: DataFrame, *, least: int = 3, home_percent: int = 60, distant: int = 1) -> DataFrame:
    """facet, n, home_n, valid: enough rows, not too many at home, at least one distant. rows: facet, home (a null is not home)."""
    got = rows.groupBy("facet").agg(F.count("*").alias("n"), F.count_if(F.coalesce("home", F.lit(False))).alias("home_n"))
    return got.withColumn("valid", (F.col("n") >= least) & (F.col("home_n") * 100 <= F.col("n") * home_percent) & (F.col("n") - F.col("home_n") >= distant))


def depletion(rows: DataFrame, run: str, key: str) -> DataFrame:
    """run, fetched, recycled, fresh: keys that earlier runs had already surfaced."""
    first = F.min(run).over(W.partitionBy(key))
    per = rows.select(run, key).distinct().withColumn("__first", first)
    return per.groupBy(run).agg(F.count("*").alias("fetched"), F.count_if(F.col("__first") < F.col(run)).alias("recycled"), F.count_if(F.col("__first") == F.col(run)).alias("fresh"))
