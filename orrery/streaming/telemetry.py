"""Request telemetry as a stream (an extension: the batch operators need none of it)."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_rates(events: DataFrame, *, window: str = "1 day", late: str | None = "1 hour") -> DataFrame:
    """start, event_type, n, total by tumbling window; the same plan for batch and stream."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    stamped = stamped.withWatermark("ts", late) if late and events.isStreaming else stamped
    got = stamped.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def dedupe_stream(rows: DataFrame, keys: list[str], *, late: str = "1 day") -> DataFrame:
    """First sight of each key within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def budget(events: DataFrame, prices: dict[str, float], limit: float, *, group: Sequence[str] = ()) -> DataFrame:
    """One row (or one a group): spent, remaining, exhausted, of priced event types. Prices are added as decimals, so no sum rounds."""
    price = F.lit(Decimal("0.000000"))
    for kind, p in prices.items():
        price = F.when(F.col("event_type") == kind, F.lit(Decimal(str(p)).quantize(Decimal("0.000001")))).otherwise(price)
    spent = events.groupBy(*group).agg(F.sum(price).alias("spent"))
    whole = F.lit(Decimal(str(limit)).quantize(Decimal("0.000001")))
    return spent.select(*group, F.col("spent").cast("double").alias("spent"), (whole - F.col("spent")).cast("double").alias("remaining"), (F.col("spent") >= whole).alias("exhausted"))


def token_usage(calls: DataFrame, *, group: Sequence[str] = ("model",)) -> DataFrame:
    """group, calls, input_tokens, output_tokens, total_tokens over the calls of external models; missing counts are 0."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    got = calls.groupBy(*group).agg(F.count("*").alias("calls"), n("input_tokens"), n("output_tokens"))
    return got.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
