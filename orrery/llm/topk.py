"""Exact top-k inner-product search over an impact-ordered, score-at-a-time index.

Vectors become integers. A block of vectors is indexed by impact: a posting (vector, value) stands
under its dimension and the level of its size, where two levels halve from the block's largest
value down. Posting segments are processed level by level from the largest impact down, each
adding its value times the query's to the scores. What a vector can still gain is at most the
smaller of two bounds: the query's absolute sum over the dimensions that have postings left
times the next level's ceiling, and the query's length times the length of the vector's own
remaining values. Vectors whose score plus bound falls below the k-th proven score cannot be
members; the proof starts from the k best that earlier blocks of the task gave. A query stops
when few enough possible members are left that scoring them exactly costs less than going on,
or none; it never stops without that proof. Possible members are then scored exactly.

Queries travel in chunks of bounded size to all blocks, each task returns its k best per
query, and the k best of those are kept.

Defined results: vectors that are null or hold null or non-finite components, and rows
without id, take no part; ties go to the smaller id; a query is never its own candidate,
nor are rows that repeat its id; queries that repeat an id and vector count once, and of
different usable vectors under one id the smallest stands; only vectors of the query's own
length are compared; empty tables give no rows; extra columns are ignored. Vectors so large that
sums of products could pass 2^53 are scored in exact wide integers, every one of them; a reported
score beyond 64 bits fails the job.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm.common import arrow_map, materialize, release

CHUNK_BYTES = 32 << 20  # of query vectors a pass takes along
BLOCK = 4096  # vectors an index block
LEVELS = 20
STRIP = 256  # queries scored together
FEW = 12  # one possible member in so many vectors is cheaper to score than to go on


class ImpactIndex:
    """A block's postings: segments[level] lists (dimension, vectors, values), largest values first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS) -> None:
        self.ids, self.vectors = ids, vectors
        size = np.abs(vectors)
        top = int(size.max(initial=0))
        # two levels halve the ceiling; the last level takes all the rest, zeros have no posting
        self.ceilings = [int(top * 2.0 ** (-i / 2)) for i in range(levels)]
        self.segments: list[list[tuple[int, np.ndarray, np.ndarray]]] = []
        self.lengths = []  # of what each vector has left after a level
        for i in range(levels):
            low = self.ceilings[i + 1] if i + 1 < levels else 0
            at = (size > low) & (size <= self.ceilings[i]) if i else size > low
            d, v = np.nonzero(at.T)
            values = vectors[v, d].astype(np.float64)
            cuts = np.searchsorted(d, np.arange(vectors.shape[1] + 1))
            self.segments.append([(j, v[s:e], values[s:e]) for j, (s, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if e > s])
            rest = np.where(size <= low, size, 0).astype(np.float64)
            self.lengths.append(np.sqrt((rest * rest).sum(1)) * (1 + 1e-9))
        self.postings = int(np.count_nonzero(vectors))
        self.processed = 0

    def _left(self, queries: np.ndarray, level: int) -> np.ndarray:
        """For each query the most that any vector can still gain by ceilings."""
        out = np.zeros(len(queries))
        for later in range(len(self.segments) - 1, level, -1):
            for d, _, _ in self.segments[later]:  # a dimension's largest value left is below its highest level's ceiling
                self._top[d] = self.ceilings[later]
        out = np.abs(queries) @ self._top
        self._top[:] = 0
        return out * (1 + 1e-9)

    def search(self, qids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, vector position, exact score) of the possible members; floor: scores that k others have already."""
        n = len(self.ids)
        self._top = np.zeros(self.vectors.shape[1])
        floor = np.full(len(qids), -np.inf) if floor is None else floor
        alive = self.ids[:, None] != qids[None, :]
        going = np.arange(len(qids))
        score = np.zeros((n, len(qids)))
        q = queries.astype(np.float64)
        length = np.sqrt((q * q).sum(1)) * (1 + 1e-9)
        for level, segments in enumerate(self.segments):
            part = score if len(going) == len(qids) else score[:, going]
            for d, vectors, values in segments:
                part[vectors] += values[:, None] * q[going, d][None, :]
                self.processed += len(vectors) * len(going)
            if part is not score:
                score[:, going] = part
            bound = np.minimum(self._left(q[going], level)[None, :], self.lengths[level][:, None] * length[going][None, :])
            own = alive[:, going]
            proven = floor[going]
            if n > k:
                low = np.where(own, part - bound, -np.inf)
                proven = np.maximum(proven, np.partition(low, n - k, axis=0)[n - k])
            own &= part + bound >= proven[None, :]
            alive[:, going] = own
            going = going[own.sum(0) > max(k, n // FEW)]
            if not len(going):
                break
        cols, rows = np.nonzero(alive)
        return rows, cols, np.einsum("ij,ij->i", queries[rows], self.vectors[cols])


def usable(v: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integers(lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: row positions and floor(1024 x) of usable vectors, as doubles' exact integers."""
    sizes = lists.value_lengths().to_numpy()
    values = lists.flatten().to_numpy()
    starts = np.cumsum(sizes) - sizes
    out = {}
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        out[n] = (at, values[starts[at][:, None] + np.arange(n)[None, :]])
    return out


def narrow_limit(dims: int) -> float:
    """Components up to here keep sums of products exact in doubles."""
    return float(int(np.sqrt((1 << 53) / max(dims, 1))) - 1)


def floors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(floor(1024 x) as int64, rows that are too large for it to be exact: these are left as zero)."""
    scaled = np.floor(1024 * np.where(np.abs(x) < 1e300, x, 1e300 * np.sign(x)))
    wide = (np.abs(scaled) > narrow_limit(x.shape[1])).any(1) if x.size else np.zeros(len(x), bool)
    return np.where(wide[:, None], 0, scaled).astype(np.int64), wide


def wide_floors(row: np.ndarray) -> list[int]:
    return [int(x) * 1024 if abs(x) >= 2.0**53 else int(np.floor(x * 1024)) for x in row.tolist()]


def wide_scores(qids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> list[tuple[int, int, int]]:
    """(query position, id, exact score) of all pairs; for the few vectors beyond the narrow range."""
    q, v = [wide_floors(x) for x in queries], [wide_floors(x) for x in vectors]
    return [(i, int(b), sum(x * y for x, y in zip(q[i], v[j], strict=True))) for i, a in enumerate(qids.tolist()) for j, b in enumerate(ids.tolist()) if a != b]


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best by (score down, id up)."""
    order = np.lexsort((ids, -scores, rows))
    r = rows[order]
    first = np.searchsorted(r, r, "left")
    return order[np.arange(len(r)) - first < k]


def exact_top_k(rows: DataFrame, queries: DataFrame, *, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", chunk_bytes: int = CHUNK_BYTES, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score."""
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    asked = materialize(clean(queries).groupBy("id").agg(F.min("v").alias("v")), what="queries")
    size = asked.agg(F.coalesce(F.sum(F.size("v") * 8 + 16), F.lit(0))).first()[0]
    chunks = int(size // chunk_bytes) + 1
    vectors = clean(rows)
    found = []
    for c in range(chunks):  # each pass holds a bounded chunk of the query set
        got = (asked if chunks == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == c)).toArrow()
        ids = got["id"].to_numpy()
        sets = {d: (ids[at], x) for d, (at, x) in integers(got["v"].combine_chunks()).items()} if got.num_rows else {}
        found.append(_pass(vectors, rows.sparkSession.sparkContext.broadcast(sets), k, block))
    release(asked)
    every = reduce(DataFrame.unionByName, found)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


class _Chunk:
    """A task's view of the queries of one length, with the k best found so far."""

    def __init__(self, qids: np.ndarray, x: np.ndarray, k: int) -> None:
        self.qids, self.x, self.k = qids, x, k
        self.ints, self.wide = floors(x)
        self.floor = np.full(len(qids), -np.inf)
        self.kept = [(np.zeros(0, np.int64),) * 3]
        self.large: list[tuple[int, int, int]] = []

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        ints, wide = floors(x)
        if wide.any():
            self.large += wide_scores(self.qids, self.x, ids[wide], x[wide])
        plain, asked = np.flatnonzero(~wide), np.flatnonzero(~self.wide)
        if self.wide.any():
            at = np.flatnonzero(self.wide)
            self.large += [(int(at[i]), b, s) for i, b, s in wide_scores(self.qids[at], self.x[at], ids[plain], x[plain])]
        if len(plain) and len(asked):
            index = ImpactIndex(ids[plain], ints[plain])
            for s in range(0, len(asked), STRIP):
                part = asked[s : s + STRIP]
                r, c, score = index.search(self.qids[part], self.ints[part], self.k, self.floor[part])
                keep = _best(r, index.ids[c], score, self.k)
                self.kept.append((part[r[keep]], index.ids[c][keep], score[keep]))
            self._merge()
        if len(self.large) > 100_000:
            self._trim()

    def _merge(self) -> None:
        r, i, s = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        keep = _best(r, i, s, self.k)
        self.kept = [(r[keep], i[keep], s[keep])]
        n = np.bincount(r[keep], minlength=len(self.qids))
        least = np.full(len(self.qids), np.inf)
        np.minimum.at(least, r[keep], s[keep])
        self.floor = np.where(n >= self.k, least, -np.inf)

    def _trim(self) -> None:
        self.large.sort(key=lambda x: (x[0], -x[2], x[1]))
        n: dict[int, int] = {}
        kept = []
        for x in self.large:
            n[x[0]] = n.get(x[0], 0) + 1
            if n[x[0]] <= self.k:
                kept.append(x)
        self.large = kept

    def rows(self) -> pa.RecordBatch:
        self._merge()
        self.large += [(int(r), int(i), int(s)) for r, i, s in zip(*(x.tolist() for x in self.kept[0]), strict=True)] if self.large else []
        if self.large:
            self._trim()
            r, i, s = (list(x) for x in zip(*self.large, strict=True))
        else:
            r, i, s = (x.tolist() for x in self.kept[0])
        return pa.RecordBatch.from_arrays([pa.array(self.qids[np.array(r, np.int64)], pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"])


def _pass(vectors: DataFrame, shared, k: int, block: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = {d: _Chunk(ids, x, k) for d, (ids, x) in shared.value.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                piece = batch.slice(at, block)
                ids = piece.column(0).to_numpy()
                for d, (here, x) in integers(piece.column(1)).items():
                    if d in chunks:
                        chunks[d].meet(ids[here], x)
        for c in chunks.values():
            yield c.rows()

    return arrow_map(vectors, run, "query_id long, vec_id long, score long")
