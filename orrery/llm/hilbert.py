"""Sharding along a Hilbert curve, in DataFrame operations only.

Source, language and size are quantised, their cell's place on the curve is the sort key,
and the sorted rows are cut into runs. The law is ``rows``: shard counts are at most one
apart. Ranks come from a histogram of (curve place, sub-bucket), so that no task ever
sorts more than one bucket and a hot cell is dealt over as many buckets as its rows need; texts are
never shuffled: from them a narrow table is written that the ranks are made from. Strings are quantised by the seven bytes behind what all of a column's values share.

Defined results: null text has size 16 and the crc32 of no bytes; null metadata sorts
first; ties and repeated rows take neighbouring slots; an empty table gives no rows and
extra columns are ignored.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm.common import materialize

BITS = 3
BUCKET_ROWS, BUCKETS = 256, 1 << 17  # rows that a task sorts together, and how many such buckets at most beside one a cell
ROW_BYTES = 16


def hilbert_place(cell: tuple[int, ...], bits: int) -> int:
    """Place on the curve of a cell (each coordinate below 2^bits): gray-code walk from the coarsest bit down."""
    x, n = list(cell), len(cell)
    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = 0
    for b in range(bits - 1, 0, -1):
        if x[n - 1] & (1 << b):
            t ^= (1 << b) - 1
    place = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            place = place << 1 | ((v ^ t) >> b & 1)
    return place


def _string_code(c: Column) -> Column:
    """A number in the order of the strings' first seven bytes."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long"), F.lit(-1))


def string_dims(rows: DataFrame, names: list[str]) -> dict[str, Column]:
    """Order-keeping numbers of string columns: what all strings of a column begin with is left out (one narrow pass)."""
    got = rows.agg(*[f(F.col(c).cast("string")).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    shared = [len(os.path.commonprefix([got[f"lo{i}"] or "", got[f"hi{i}"] or ""])) for i in range(len(names))]
    return {c: _string_code(F.substring(F.col(c).cast("string"), n + 1, 7)) for c, n in zip(names, shared, strict=True)}


def _bin(value: Column, cuts: list[int]) -> Column:
    return F.aggregate(F.array(*[F.lit(c).cast("long") for c in cuts]), F.lit(0), lambda n, c: n + (value > c).cast("int")) if cuts else F.lit(0)


def curve_places(rows: DataFrame, dims: dict[str, Column], *, bits: int = BITS) -> Column:
    """Quantile cuts of each dimension (one narrow pass), then the curve place of a row's cell."""
    side = 1 << bits
    got = rows.agg(*[F.percentile_approx(v, [i / side for i in range(1, side)], 10_000).alias(k) for k, v in dims.items()]).first()
    table = [hilbert_place(tuple(i >> bits * d & side - 1 for d in range(len(dims))), bits) for i in range(side ** len(dims))]
    cell = F.lit(0)
    for d, (k, v) in enumerate(dims.items()):
        cell = cell + _bin(v, sorted(set(got[k] or []))) * (1 << bits * d)
    return F.element_at(F.lit(table), (cell + 1).cast("int"))


def hilbert_shards(docs: DataFrame, *, shards: int = 40, dims: dict[str, Column] | None = None, bits: int = BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the row's place on the curve."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = (F.octet_length(text) + ROW_BYTES).cast("long")
    dims = dims or {**string_dims(docs, ["source", "lang"]), "size": size}
    place = curve_places(docs, dims, bits=bits)
    rows = materialize(docs.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), place.alias("place")), what="cells")
    # a cell's rows are dealt over as many buckets as they need; both tables have a bounded number of rows
    cells = rows.groupBy("place").agg(F.count("*").alias("m"))
    least = F.greatest(F.lit(bucket_rows), F.floor(F.sum("m").over(W.partitionBy()) / BUCKETS))
    cells = cells.select("place", F.ceil(F.col("m") / least).cast("int").alias("subs"))
    spread = F.xxhash64("doc_id", "text_crc32")
    rows = rows.join(F.broadcast(cells), "place").withColumn("sub", F.pmod(spread, F.col("subs")).cast("int")).drop("subs")
    counts = rows.groupBy("place", "sub").agg(F.count("*").alias("n"))
    before = W.orderBy("place", "sub").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("place", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(W.orderBy("place", "sub").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"))
    ranked = rows.withColumn("rn", F.row_number().over(W.partitionBy("place", "sub").orderBy("text_crc32", "doc_id", "size")))
    placed = ranked.join(F.broadcast(starts), ["place", "sub"])
    shard = F.expr(f"(start + rn - 1) * {shards} div total")
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return (
        placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), "place", "start", "rn", "total")
        .withColumn("slot", (F.col("start") + F.col("rn") - 1 - first).cast("long"))
        .select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("place").cast("int").alias("place"))
    )
