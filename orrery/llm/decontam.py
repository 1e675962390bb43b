"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words that ignores some positions. Seeds of all
benchmark items and of all training texts are hashed; where a training hash is one of the
benchmark's, the two texts are aligned at the hit and the overlap around it is verified
word by word: some window of ``window`` words (or the whole item, if shorter) must agree
in ``share`` of its places. With the masks below, every window of 12 words with up to two
substitutions holds at least one seed, so no such overlap is missed. Items below the window
have masks of their own length, which meet every set of substitutions that ``share`` allows.

Words are runs of letters, digits and marks by Unicode category, lower-cased, so punctuation of any
script does not matter.

Defined results: null and empty texts, and items below ``least`` words, take no part; one row per text and item, with the
best window; rows that repeat are reported one by one; items that repeat each count; extra
columns are ignored; ties of the best window go to the earliest place in the document, then in the item; an empty benchmark
or corpus gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import arrow_map, extended, flat, materialize, pieces, ranges
from orrery.llm.words import mix, tokens

#: Three masks of six words; together they meet any two substitutions in twelve words.
MASKS = ((0, 2, 5, 6, 7, 8), (0, 1, 4, 5, 7, 9), (0, 1, 2, 3, 4, 8))
WINDOW, SHARE, LEAST = 12, 0.8, 5
STRETCH = 1 << 20  # postings or compared words at a time
BLOCK_BYTES = 32 << 20  # of benchmark text that one pass over the corpus takes along


def seeds(h: np.ndarray, first: np.ndarray, mask: tuple[int, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, hash) of every seed that lies within one text."""
    span = mask[-1] + 1
    room = np.maximum(np.diff(first) - span + 1, 0)
    at = ranges(first[:-1], room)
    out = np.full(len(at), salt + 1, np.uint64)
    for o in mask:
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[at + o]
    return at, mix(out)


def least_equal(w: int, share: float) -> int:
    """Places that must agree in a window of w words."""
    return int(np.ceil(share * w - 1e-9))


def short_masks(w: int, off: int) -> list[tuple[int, ...]]:
    """Masks over w words of which at least one misses any off places.

    Each mask leaves out a part of the places, chosen greedily until every set of off places lies in a part;
    beyond two substitutions one of off + 1 blocks is always whole.
    """
    off = min(off, w - 1)
    if off > 2:
        return [tuple(range(w * i // (off + 1), w * (i + 1) // (off + 1))) for i in range(off + 1)]
    left = set(combinations(range(w), off))
    out = []
    while left:
        part = max(combinations(range(w), max(off, w * off // (off + 2))), key=lambda p: len(left.intersection(combinations(p, off))))
        left -= set(combinations(part, off))
        out.append(tuple(i for i in range(w) if i not in part))
    return out


class SeedIndex:
    """The seeds of a block of benchmark items, with the items' words for verification."""

    def __init__(self, ids: pa.Array, texts: pa.Array, masks: tuple[tuple[int, ...], ...] = MASKS, least: int = LEAST, window: int = WINDOW, share: float = SHARE) -> None:
        texts = pc.utf8_lower(texts)
        _, _, self.words, self.first = tokens(*flat(texts), None)
        self.ids = ids
        n = np.diff(self.first)
        full = max(window, *(m[-1] + 1 for m in masks))  # items from here on hold the given masks
        width = np.minimum(window, n)
        widths = np.unique(width[(n >= least) & (n < full)]).tolist()
        short = [(w, m) for w in widths for m in short_masks(w, w - least_equal(w, share))]
        self.masks = [*masks, *(m for _, m in short)]
        found = []
        for i, mask in enumerate(self.masks):
            at, h = seeds(self.words, self.first, mask, i)
            item = np.searchsorted(self.first, at, "right") - 1
            if i < len(masks):
                fit = n[item] >= full
            else:  # where a whole window begins
                w = short[i - len(masks)][0]
                fit = (n[item] >= least) & (n[item] < full) & (width[item] == w) & (at - self.first[item] + w <= n[item])
            found += [(h[fit], at[fit], item[fit])]
        h, at, item = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(h, kind="stable")
        self.hashes, self.at, self.item = h[order], at[order], item[order]
        bits = max(16, min(26, int(len(h)).bit_length() + 6))
        self.shift = np.uint64(64 - bits)
        self.coarse = np.zeros(1 << bits, bool)
        self.coarse[self.hashes >> self.shift] = True

    def hits(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text, item, place of the item's first word in the words) of all seed hits.

        Seeds that many items share are spread out a bounded number of postings at a time; what repeats a diagonal folds at once.
        """
        out = [np.zeros((0, 3), np.int64)]
        for i, mask in enumerate(self.masks):
            at, h = seeds(words, first, mask, i)
            maybe = self.coarse[h >> self.shift]
            at, h = at[maybe], h[maybe]
            lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            for s, e in stretches(n):
                which = ranges(lo[s:e], n[s:e])
                place = np.repeat(at[s:e], n[s:e])
                item = self.item[which]
                text = np.searchsorted(first, place, "right") - 1
                out.append(np.unique(np.stack([text, item, place - (self.at[which] - self.first[item])], 1), axis=0))
        got = np.unique(np.concatenate(out), axis=0)
        return got[:, 0], got[:, 1], got[:, 2]

    def overlaps(self, words: np.ndarray, first: np.ndarray, window: int, share: float) -> np.ndarray:
        """Rows text, item, equal words, window, place in the text, place in the item: the best window of each pair that suffices."""
        text, item, at = self.hits(words, first)
        length = np.diff(self.first)[item]
        lo, hi = np.maximum(0, first[text] - at), np.minimum(length, first[text + 1] - at)
        w = np.minimum(window, length)
        ok = hi - lo >= w
        text, item, at, lo, size, w = text[ok], item[ok], at[ok], lo[ok], (hi - lo)[ok], w[ok]
        need = np.array([least_equal(int(x), share) for x in range(window + 1)], np.int64)[w]
        out = [np.zeros((0, 6), np.int64)]
        for s, e in stretches(size):
            z, begin = size[s:e], np.cumsum(size[s:e]) - size[s:e]
            same = words[ranges((at + lo)[s:e], z)] == self.words[ranges((self.first[item] + lo)[s:e], z)]
            total = np.concatenate([[0], np.cumsum(same)])
            rooms = z - w[s:e] + 1
            start = ranges(begin, rooms)
            inside = total[start + np.repeat(w[s:e], rooms)] - total[start]
            heads = np.cumsum(rooms) - rooms
            best = np.maximum.reduceat(inside, heads)
            spot = np.flatnonzero(inside == np.repeat(best, rooms))
            of = np.searchsorted(heads, spot, "right") - 1
            _, lead = np.unique(of, return_index=True)  # the first of equal windows
            k = start[spot[lead]] - begin
            rows = np.stack([text[s:e], item[s:e], best, w[s:e], (at + lo - first[text])[s:e] + k, lo[s:e] + k], 1)
            out.append(rows[best >= need[s:e]])
        got = np.concatenate(out)
        got = got[np.lexsort((got[:, 5], got[:, 4], -got[:, 2], got[:, 1], got[:, 0]))]
        lead = np.ones(len(got), bool)
        lead[1:] = (got[1:, :2] != got[:-1, :2]).any(1)
        return got[lead]


def stretches(sizes: np.ndarray, limit: int = STRETCH) -> list[tuple[int, int]]:
    """Cut rows into stretches of bounded total size; a row over the limit stands alone."""
    ends, out, s = np.cumsum(sizes), [], 0
    while s < len(sizes):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + limit, "right")))
        out.append((s, e))
        s = e
    return out


def verify(words: np.ndarray, start: int, end: int, item: np.ndarray, at: int, window: int, share: float) -> tuple[int, int, int, int] | None:
    """One diagonal of ``overlaps`` by itself: best (equal words, window, place in the text, place in the item) on this diagonal, if it suffices; ties go to the first place."""
    lo, hi = max(0, start - at), min(len(item), end - at)
    w = min(window, len(item))
    if hi - lo < w:
        return None
    same = np.concatenate([[0], np.cumsum(words[at + lo : at + hi] == item[lo:hi])])
    inside = same[w:] - same[:-w]
    best = int(inside.argmax())
    return (int(inside[best]), w, at + lo + best - start, lo + best) if inside[best] >= least_equal(w, share) else None


def contaminated(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", masks: tuple[tuple[int, ...], ...] = MASKS, window: int = WINDOW, share: float = SHARE, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, n_equal, n_window, doc_word, item_word for every overlap that holds."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text")).where(F.length("text") > 0)
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = int(size // block_bytes) + 1  # each pass takes a bounded block of the benchmark along
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([*source.select("doc_id").schema, *items.select("item_id").schema])
    schema = extended(schema, "n_equal int, n_window int, doc_word int, item_word int")

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index: SeedIndex = shared.value
            for batch in batches:
                for piece in pieces(batch, "text"):
                    _, _, words, first = tokens(*flat(pc.utf8_lower(piece.column(1))), None)
                    found = index.overlaps(words, first, window, share)
                    if len(found):
                        cols = [pa.array(c, pa.int32()) for c in found[:, 2:].T]
                        yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(found[:, 0])), index.ids.take(pa.array(found[:, 1])), *cols], names=schema.names)

        return run

    out = None
    for b in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        got = block.toArrow()
        if not got.num_rows:
            continue
        shared = spark.sparkContext.broadcast(SeedIndex(got["item_id"].combine_chunks(), got["text"].combine_chunks(), masks, least, window, share))
        found = arrow_map(source, scan(shared), schema)
        if blocks > 1:  # a pass is written before the next block is sent, so one block is out at a time
            found = materialize(found, what="overlaps")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the texts that overlap an item; documents are told apart by id and text together."""
    key = F.xxhash64("doc_id", "text")
    hits = materialize(contaminated(docs.withColumn("__key", key), benchmark, doc_id="__key").select(F.col("doc_id").alias("__key")).distinct(), what="leaks")
    return docs.withColumn("__key", key).join(hits, "__key", "left_anti").drop("__key")
