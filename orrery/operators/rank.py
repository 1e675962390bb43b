"""Rankings: z-scores, the hybrid score, round-robin merges, quotas and anchors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.lineage import cut

CITATION_WEIGHT = 0.15


def z_score(value: Column, *group: str) -> Column:
    """Population z-score; 0 where all values are equal."""
    w = W.partitionBy(*group) if group else W.partitionBy(F.lit(1))
    sd = F.stddev_pop(value).over(w)
    return F.when(sd == 0, 0.0).otherwise((value - F.avg(value).over(w)) / sd)


def z_scores(rows: DataFrame, value: str, *, group: Sequence[str] = (), name: str = "z") -> DataFrame:
    """rows plus the z_score of a column; means and deviations are aggregated and joined, so no task gathers a group."""
    aggs = [F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s")]
    joined = rows.join(rows.groupBy(*group).agg(*aggs), list(group)) if group else rows.crossJoin(F.broadcast(rows.agg(*aggs)))  # one row without groups
    return joined.withColumn(name, F.when(F.col("__s") == 0, 0.0).otherwise((F.col(value) - F.col("__m")) / F.col("__s"))).select(*rows.columns, name)


def hybrid_score(rows: DataFrame, channels: Sequence[str], cites: str, *, weight: float = CITATION_WEIGHT, group: Sequence[str] = ()) -> DataFrame:
    """rows plus hybrid: mean z-score of the channels that have any signal, with the citations' z-score at a small weight.

    Means and deviations are aggregated first and joined back, one row a group, so no task gathers a group.
    """
    values = {c: F.col(c).cast("double") for c in channels} | {"__log": F.log1p(F.greatest(F.col(cites).cast("double"), F.lit(0.0)))}
    aggs = [f(v).alias(f"__{n}{i}") for i, v in enumerate(values.values()) for n, f in (("m", F.avg), ("s", F.stddev_pop), ("x", F.max))]
    joined = rows.crossJoin(F.broadcast(rows.agg(*aggs))) if not group else rows.join(rows.groupBy(*group).agg(*aggs), list(group))  # one row without groups
    z = [F.when(F.col(f"__s{i}") == 0, 0.0).otherwise((v - F.col(f"__m{i}")) / F.col(f"__s{i}")) for i, v in enumerate(values.values())]
    on = [F.col(f"__x{i}") > 0 for i in range(len(channels))]
    n = sum((x.cast("int") for x in on), F.lit(0))
    total = sum((F.when(x, v).otherwise(0.0) for x, v in zip(on, z, strict=False)), F.lit(0.0))
    hybrid = F.when(n == 0, 0.0).otherwise((1 - weight) * total / n + weight * z[-1])
    return joined.withColumn("hybrid", hybrid).select(*rows.columns, "hybrid")


def interleave(rows: DataFrame, bucket: str, *order: str | Column, limit: int) -> DataFrame:
    """Round-robin over buckets in bucket order: rows plus turn. A bucket is cut to the limit by rank, in each partition first."""
    turn = F.row_number().over(W.partitionBy(bucket).orderBy(*order))
    return rows.withColumn("turn", turn).where(F.col("turn") <= limit).orderBy("turn", bucket).limit(limit)


def merge_pools(first: DataFrame, second: DataFrame, *, key: str = "id", pos: str = "pos", limit: int) -> DataFrame:
    """Round-robin of two pools, the second without what the first has."""
    rest = second.join(first.select(key), key, "left_anti")
    return interleave(first.withColumn("leg", F.lit(0)).unionByName(rest.withColumn("leg", F.lit(1))), "leg", pos, key, limit=limit)


def first_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key: the first in the given order."""
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("__rn = 1").drop("__rn")


def anchor_order(relevance: str = "relevance", score: str = "anchor_rank_score", key: str = "id") -> list[Column]:
    """Anchors with any keyword match first, then by score."""
    return [(F.col(relevance) > 0).cast("int").desc(), F.col(score).desc(), F.col(key).asc()]


def anchor_places(rows: DataFrame, *, relevance: str = "relevance", score: str = "anchor_rank_score", key: str = "id", steps: int = 64) -> DataFrame:
    """rows plus place: every row's number (from 1) in anchor_order.

    A histogram of (tier, score in steps of 1/64) gives each bin its first place, and only a bin's rows are
    sorted; scores of 0..100 give at most 12,802 bins, whatever the rows.
    """
    tier = F.coalesce((F.col(relevance) > 0).cast("int"), F.lit(-1))
    rows = rows.withColumn("__t", tier).withColumn("__b", F.coalesce(F.floor(F.col(score) * steps), F.lit(-1)))
    bins = rows.groupBy("__t", "__b").agg(F.count("*").alias("__n"))
    before = W.orderBy(F.col("__t").desc(), F.col("__b").desc()).rowsBetween(W.unboundedPreceding, -1)
    starts = bins.select("__t", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(W.partitionBy("__t", "__b").orderBy(F.col(score).desc(), F.col(key).asc()))
    placed = rows.withColumn("__own", own).join(F.broadcast(starts), ["__t", "__b"])
    return placed.withColumn("place", F.col("__start") + F.col("__own")).drop("__t", "__b", "__start", "__own")


def places(rows: DataFrame, *order: Column) -> DataFrame:
    """rows plus place (from 1) in a total order, whatever the rows: ranges are sorted by themselves and counted.

    One row a range, so the counts' window is as small as the number of partitions.
    """
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_ = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id()).withColumn("__own", own))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = sorted_.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return sorted_.join(F.broadcast(starts), "__range").withColumn("place", F.col("__start") + F.col("__own") + 1).drop("__range", "__own", "__start")


def leg_turns(legs: DataFrame, or_total: Column, n_legs: Column) -> DataFrame:
    """legs(keyword, total) plus own_turn: a keyword rarer than an equal share of the OR total keeps its own turn."""
    return legs.withColumn("own_turn", F.col("total") * n_legs < or_total)


def rarity_weights(rows: DataFrame, own: str, or_total: Column, *, floor: float = 0.1) -> DataFrame:
    """rows plus weight: log of the OR total over the own total, floored, normalised to sum 1."""
    raw = F.greatest(F.ln(or_total.cast("double") / F.greatest(F.col(own), F.lit(1))), F.lit(floor))
    weighed = rows.withColumn("__raw", raw)
    total = weighed.agg(F.sum("__raw").alias("__total"))  # one row
    return weighed.join(F.broadcast(total), how="cross").withColumn("weight", F.col("__raw") / F.col("__total")).drop("__raw", "__total")


def domain_first(rows: DataFrame, domain: str, home: Column, *order: str) -> list[Column]:
    """Order within a bridge's share: other domains, then the home domain, then unfiled."""
    kind = F.when(F.col(domain).isNull(), 2).when(home, 1).otherwise(0)
    return [kind.asc(), *[F.col(o).asc() for o in order]]
