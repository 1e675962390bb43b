"""How far the sources of a language differ in their vocabulary: two-dimensional group-block tiling.

A group is a (lang, source). Its counts over the language's kept terms are packed into one
vector a vocabulary chunk. Groups fall into blocks; every pair of blocks is a task (one for
each stretch of chunks, where a language has many), to which the vectors of its groups are
replicated. The task reads them chunk by chunk and adds up the submatrix of its pairs, so it
holds two blocks of one chunk at a time, and columns that no vector of the two blocks has are
settled by their number. All arithmetic is in whole numbers:
shares are divided digit by digit (three at a time), so they are exact for sums below 9.2e15.

Null text, lang and source count as empty; every (lang, source) that occurs has rows of the
part pair, with terms or without. Repeated rows count as documents of their own; equal values
are ranked by the item's bytes. Extra columns are ignored, an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import arrow_map, flat, materialize, release
from orrery.llm.words import FOLD

#: Bytes of terms: ASCII letters and everything beyond ASCII.
LETTER = np.ones(256, bool)
LETTER[np.r_[0x00:0x41, 0x5B:0x61, 0x7B:0x80]] = False
SCALE_DIGITS = 3  # of thousands: shares are parts of 10^9
MIN_DOCS = 3
TOP_TERMS = 200
#: Terms of a chunk and groups of a block, about.
CHUNK, BLOCK = 32768, 16
#: Chunks that one task reads, one after another.
STRETCH = 8
#: Rows of (lang, source) in a broadcast; where there are more, they are joined by shuffle.
BROADCAST_GROUPS = 100_000

COUNTS = "lang string, source string, term string, n bigint, docs bigint"
TILES = "lang string, source string, item string, value bigint"


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and document numbers of a batch's terms by group, and a row with term null for each group."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lang, source = (batch.column(i).dictionary_encode() for i in (1, 2))
        group = np.asarray(lang.indices).astype(np.int64) * len(source.dictionary) + np.asarray(source.indices)
        data, offs = flat(batch.column(0))
        low = FOLD[data]
        inside = LETTER[low]
        begin, stop = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        stop[:-1] &= ~inside[1:]
        borders = offs[1:-1]
        borders = borders[(borders > 0) & (borders < len(data))]
        begin[borders], stop[borders - 1] = inside[borders], inside[borders - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        letters = low[inside]
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(0, np.cumsum(ends - starts))), pa.py_buffer(letters)).dictionary_encode()
        terms = len(words.dictionary)
        pair, times = np.unique((np.searchsorted(offs, starts, "right") - 1) * max(1, terms) + np.asarray(words.indices), return_counts=True)
        key, at = np.unique(group[pair // max(1, terms)] * max(1, terms) + pair % max(1, terms), return_inverse=True)
        n, docs = (np.bincount(at, weights=w, minlength=len(key)).astype(np.int64) for w in (times, None))
        of = np.concatenate([key // max(1, terms), seen := np.unique(group)])
        none = np.zeros(len(seen), np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                lang.dictionary.take(pa.array(of // len(source.dictionary))),
                source.dictionary.take(pa.array(of % len(source.dictionary))),
                pa.concat_arrays([words.dictionary.take(pa.array(key % max(1, terms))).cast(pa.string()), pa.nulls(len(seen), pa.string())]),
                pa.array(np.append(n, none)),
                pa.array(np.append(docs, none)),
            ],
            ["lang", "source", "term", "n", "docs"],
        )


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / total), exactly."""
    out, rest = F.lit(0).cast("long"), count + 1
    for _ in range(SCALE_DIGITS):
        more = rest * 1000
        out, rest = out * 1000 + F.call_function("div", more, total), more % total
    return out + 1


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The same over arrays."""
    out, rest = np.zeros(counts.shape, np.int64), counts + 1
    for _ in range(SCALE_DIGITS):
        more, rest = np.divmod(rest * 1000, totals)
        out = out * 1000 + more
    return out + 1


class Tile:
    """The pairs of two blocks of one language's groups, added up chunk by chunk."""

    def __init__(self, lang: str, rows: int, columns: int, stretch: int):
        self.lang, self.blocks, self.stretch, self.terms, self.seen = lang, (rows, columns), stretch, 0, 0
        self.names: dict[int, list[str]] = {rows: [], columns: []}
        self.totals: dict[int, list[int]] = {rows: [], columns: []}
        self.slots: dict[tuple[int, int], int] = {}
        self.value: tuple[np.ndarray, np.ndarray] | None = None
        self.waiting: list[tuple[int, int, np.ndarray, np.ndarray]] = []

    def group(self, block: int, slot: int, source: str, total: int, terms: int) -> None:
        self.slots[block, slot] = len(self.names[block])
        self.names[block].append(source)
        self.totals[block].append(total + terms)
        self.terms = terms

    def vector(self, block: int, slot: int, at: np.ndarray, n: np.ndarray) -> None:
        self.waiting.append((block, self.slots[block, slot], at, n))

    def chunk(self) -> None:
        """Add the waiting vectors, which are all that the two blocks have in one chunk."""
        if not self.waiting:
            return
        columns = np.unique(np.concatenate([at for _, _, at, _ in self.waiting]))
        counts = {b: np.zeros((len(self.names[b]), len(columns)), np.int64) for b in self.blocks}
        for block, i, at, n in self.waiting:
            counts[block][i, np.searchsorted(columns, at)] = n
        self.waiting = []
        self.seen += len(columns)
        self._add(*(counts[b] for b in self.blocks), 1)

    def _add(self, rows: np.ndarray, columns: np.ndarray, times: int) -> None:
        a, b = self.blocks
        p, q = (shares(c, np.array(self.totals[x], np.int64)[:, None]) for x, c in ((a, rows), (b, columns)))
        if self.value is None:
            self.value = np.zeros((len(p), len(q)), np.int64), np.zeros((len(p), len(q)), np.int64)
        for i in range(len(p)):
            square = (p[i] - q) ** 2
            self.value[0][i] += (square // q).sum(1) * times
            if a != b:
                self.value[1][i] += (square // p[i]).sum(1) * times

    def rows(self) -> Iterator[tuple[str, str, str, int]]:
        a, b = self.blocks
        if self.terms:
            # all columns count as absent once, in the first stretch; those that were there don't
            left = (self.terms if self.stretch == 0 else 0) - self.seen
            self._add(np.zeros((len(self.names[a]), 1), np.int64), np.zeros((len(self.names[b]), 1), np.int64), left)
        for i, x in enumerate(self.names[a]):
            for j, y in enumerate(self.names[b]):
                if x != y:
                    yield self.lang, x, y, int(self.value[0][i, j]) if self.terms else 0
                    if a != b:
                        yield self.lang, y, x, int(self.value[1][i, j]) if self.terms else 0


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tile, at_chunk = None, None

    def done() -> Iterator[pa.RecordBatch]:
        if tile is not None:
            tile.chunk()
            found = list(tile.rows())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), (pa.string(),) * 3 + (pa.int64(),))] if found else [pa.array([], t) for t in (pa.string(),) * 3 + (pa.int64(),)], ["lang", "source", "item", "value"])

    for batch in batches:
        columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        narrow = {n: columns[n].to_pylist() for n in ("lang", "low", "high", "stretch", "chunk", "block", "slot", "source", "total", "terms")}
        for i in range(batch.num_rows):
            row = {n: v[i] for n, v in narrow.items()}
            key = (row["lang"], row["low"], row["high"], row["stretch"])
            if tile is None or (tile.lang, *tile.blocks, tile.stretch) != key:
                yield from done()
                tile, at_chunk = Tile(*key), -1
            if row["chunk"] != at_chunk:
                tile.chunk()
                at_chunk = row["chunk"]
            if at_chunk < 0:
                tile.group(row["block"], row["slot"], row["source"], row["total"], row["terms"])
            else:
                tile.vector(row["block"], row["slot"], columns["at"][i].values.to_numpy(), columns["n"][i].values.to_numpy())
    yield from done()


def divergence(docs: DataFrame, *, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, chunk: int = CHUNK, block: int = BLOCK, stretch: int = STRETCH) -> DataFrame:
    """lang, source, part, item, value, rank: how each source of a language differs from the others, and by which terms.

    Part pair: the other sources of the language with the divergence from them, largest first.
    Part term: the group's top_terms terms that it uses more than its language does.
    """
    spark = docs.sparkSession
    texts = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts = materialize(arrow_map(texts, _term_counts, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), what="counts")
    words = counts.where("term IS NOT NULL")
    kept = materialize(words.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= min_docs).drop("docs"), what="kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    groups = counts.where("term IS NULL").select("lang", "source")
    chunks = 1 + (langs.agg(F.max("terms")).first()[0] or 0) // chunk
    blocks = 1 + (groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0) // block

    in_chunk = Window.partitionBy("lang", "chunk").orderBy("term")
    places = kept.withColumn("chunk", F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int")).withColumn("at", F.row_number().over(in_chunk))
    held = materialize(words.select("lang", "source", "term", "n").join(places, ["lang", "term"]), what="held")
    sums = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    in_block = Window.partitionBy("lang", "block").orderBy("source")
    roster = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
    roster = materialize(roster.withColumn("block", F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")).withColumn("slot", F.row_number().over(in_block)), what="groups")
    small = F.broadcast(roster) if roster.count() <= BROADCAST_GROUPS else roster

    heads = roster.select("lang", "block", "slot", F.lit(-1).alias("chunk"), "source", "total", "terms", F.lit(None).cast("array<int>").alias("at"), F.lit(None).cast("array<bigint>").alias("n"))
    heads = heads.withColumn("stretch", F.explode(F.sequence(F.lit(0), F.lit((chunks - 1) // stretch))))
    packed = held.groupBy("lang", "source", "chunk").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("v"))
    vectors = packed.join(small.select("lang", "source", "block", "slot"), ["lang", "source"]).select(
        "lang", "block", "slot", "chunk", F.lit(None).cast("string").alias("source"), F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("terms"), F.col("v.at").alias("at"), F.col("v.n").alias("n"), F.floor(F.col("chunk") / stretch).cast("int").alias("stretch")
    )
    sent = heads.unionByName(vectors).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")
    tasks = ("lang", "low", "high", "stretch")
    pairs = arrow_map(sent.repartition(*tasks).sortWithinPartitions(*tasks, "chunk", "block", "slot"), _tiles, TILES).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    p, q = share(F.col("n"), F.col("total") + F.col("terms")), share(F.col("lang_n"), F.col("lang_total") + F.col("terms"))
    of_group = held.select("lang", "source", "term", "n", "lang_n").join(small.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    terms = of_group.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = ("lang", "source", "part", "item", "value", "rank")
    pair_rows = pairs.withColumn("rank", F.row_number().over(ranked)).withColumn("part", F.lit("pair"))
    term_rows = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top_terms).withColumn("part", F.lit("term"))
    result = materialize(pair_rows.select(*out).unionByName(term_rows.select(*out)), what="divergence")
    release(counts, kept, held, roster)
    return result
