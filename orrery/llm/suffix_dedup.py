"""Exact substring dedup over a suffix array built by difference cover.

Every string of ``length`` bytes that also starts earlier (in a smaller doc_id, or earlier in
the same text) is removed from the later place. Equal strings are found as neighbours in
a suffix array: the suffixes at places 1 and 2 modulo 3 are sorted by their triples,
triples are named and the names sorted by recursion, the remaining suffixes are sorted by
their first byte and the next one's rank, the two orders are merged, and the
prefixes of adjacent suffixes are compared.

The array is distributed by content: every string of ``length`` bytes has an anchor, the
smallest k-gram hash in it, so equal strings have equal anchors and meet in one bucket.
Anchors that occur once in the whole corpus rule their strings out before any text moves.
Equal contexts are folded inside a piece of texts and again inside a bucket, so a passage
that a third of the corpus shares is one context a piece. Contexts of one anchor that
outgrow a suffix array are split by the strings' second anchors, third ones, and so on; only what six
anchors leave in one group beyond an array's size is compared in the order of the strings' hashes.

Defined results: null and empty texts have no bytes and nothing removed; texts below
``length`` bytes stay whole; a whole text that also stands under a smaller doc_id is removed
from the later one; rows that repeat a doc_id are one document, so equal places of theirs
don't count as earlier; a null doc_id counts as the largest; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import arrow_map, bucket_runs, files_for, free_shuffles, give_back, materialize, ranges, release
from orrery.llm.words import mix, powers, prefix_hashes, span_hashes

LENGTH, GRAM = 100, 24
PIECE = 256 << 10  # bytes of text a piece: rows stay far below a JVM heap region
SLICE_PIECES = 8192  # pieces whose contexts of one bucket are folded together
BUCKET = 8 << 20  # bytes of the corpus a bucket of anchors stands for
DEEPEST = 6  # anchors that split a group of strings one after another
ARRAY = 400_000  # bytes a suffix array holds: about 100 MB of work space; cubes of its names stay below 2^63
LAST = (1 << 63) - 1


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by the difference cover {1, 2} modulo 3; values are positive."""
    n = len(t)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    p = np.concatenate([t.astype(np.int64), [0, 0, 0]])
    base = int(p.max()) + 1
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    # sort sampled triples and name them
    triples = (p[sample] * base + p[sample + 1]) * base + p[np.minimum(sample + 2, n + 2)]
    names, at = np.unique(triples, return_inverse=True)
    del triples
    # recurse on the names where they don't tell all apart
    order = suffix_array(at + 1) if len(names) < len(sample) else np.argsort(at)
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    ordered = sample[order]
    ordered = ordered[ordered < n]
    # sort the remaining suffixes by first value and the rank behind it
    span = len(sample) + 1
    rest = np.arange(0, n, 3)
    key = p[rest] * span + rank[rest + 1]
    by = np.argsort(key)
    rest, key = rest[by], key[by]
    # merge: how many sampled suffixes stand before each remaining one
    first, second = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    ahead = np.searchsorted(p[first] * span + rank[first + 1], key)
    wide = lambda i: (p[i] * base + p[i + 1]) * span + rank[i + 2]
    ahead += np.searchsorted(wide(second), wide(rest))
    out = np.empty(n, np.int64)
    place = np.arange(len(rest)) + ahead
    free = np.ones(n, bool)
    free[place] = False
    out[place] = rest
    out[free] = ordered
    return out


def gram_hashes(data: np.ndarray, gram: int, banned: np.ndarray | None) -> np.ndarray:
    """A hash for the gram at each place; the largest number where none begins or it is banned."""
    n = len(data)
    grams = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    h = prefix_hashes(data)
    grams[: n - gram + 1] = mix((h[gram:] - h[: n - gram + 1]) * powers(n)[1][: n - gram + 1])
    if banned is not None:
        grams[banned] = np.iinfo(np.uint64).max
    return grams


def anchors(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM, banned: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts that share an anchor: (first start, number of starts, text, anchor hash). Banned grams are no anchors."""
    n, width = len(data), length - gram + 1
    ends = np.repeat(offs[1:], np.diff(offs))
    if n < length:
        return (*(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64))
    grams = gram_hashes(data, gram, banned)
    x = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    done = 1
    while done < width:  # minimum over done places from each place on; ties go left
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    starts = np.flatnonzero(np.arange(len(x)) + length <= ends[: len(x)])
    if not len(starts):
        return (*(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64))
    at = (x[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = at[1:] != at[:-1]
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(starts)))
    first = starts[begin]
    # minima crowd at the low end of their hash, so anchors are named by another one: buckets come out even
    return first, count, np.searchsorted(offs, first, "right") - 1, mix(grams[at[begin]] ^ np.uint64(0x5851F42D4C957F2D))


def later_strings(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each start (ascending): the smallest start of the same string of this length."""
    order = suffix_array(text.astype(np.int64) + 1)
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    order = order[wanted[order]]
    h = prefix_hashes(text)
    s = span_hashes(h, order, order + length)
    same = np.flatnonzero(s[1:] == s[:-1]) + 1
    view = np.lib.stride_tricks.sliding_window_view(text, length)
    equal = np.zeros(len(order), bool)
    for i in range(0, len(same), 20_000):  # adjacent prefixes, byte by byte
        part = same[i : i + 20_000]
        equal[part] = (view[order[part]] == view[order[part - 1]]).all(1)
    heads = np.flatnonzero(~equal)
    least = np.minimum.reduceat(order, heads)
    out = np.empty(len(text), np.int64)
    out[order] = np.repeat(least, np.diff(np.append(heads, len(order))))
    return out[starts]


class Contexts:
    """Contexts of anchors: bytes around the strings of a run, with where they stand.

    A group of one anchor's contexts that outgrows a suffix array is split by the strings' next anchors, the smallest
    grams besides those used already, and so on ``DEEPEST`` times.
    """

    def __init__(self, head: np.ndarray, data: np.ndarray, length: int, *, banned: np.ndarray | None = None, depth: int = 0) -> None:
        self.banned, self.depth = banned, depth
        # rows of head: anchor, doc, piece, text in the piece, first start, number of starts
        order = np.lexsort((head[4], head[1], head[0]))
        sizes = head[5] + length - 1
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.head, self.sizes, self.begins, self.data, self.length = head[:, order], sizes[order], begins[order], data, length

    def fold(self) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray]:
        """(which contexts are the first of their bytes, which are later copies, which stand in groups of several, where groups begin)."""
        head, n = self.head, self.head.shape[1]
        folded: list[int] = []
        raw = self.data.tobytes()
        distinct = np.ones(n, bool)
        groups = np.flatnonzero(np.append(True, head[0][1:] != head[0][:-1])) if n else np.zeros(0, np.int64)
        many = np.zeros(n, bool)
        for s, e in zip(groups.tolist(), [*groups[1:].tolist(), n], strict=True):
            seen: dict[bytes, int] = {}
            for i in range(s, e):
                b = int(self.begins[i])
                k = seen.setdefault(raw[b : b + int(self.sizes[i])], i)
                if k != i:
                    distinct[i] = False
                    if (head[1, k], head[4, k]) != (head[1, i], head[4, i]):
                        folded.append(i)
            many[s:e] = len(seen) > 1
        return distinct, folded, many, groups

    def spans_of(self, rows: list[int]) -> np.ndarray:
        head = self.head
        return np.stack([head[2, rows], head[3, rows], head[4, rows], head[4, rows] + self.sizes[rows]])

    def later(self) -> np.ndarray:
        """Rows piece, text, first byte, end of the bytes to remove."""
        head, n = self.head, self.head.shape[1]
        distinct, folded, many, groups = self.fold()
        found = [self.spans_of(folded)]
        left = np.flatnonzero(distinct & many)
        # a group that is too large is split by further anchors
        bounds = [*groups.tolist(), n]
        weight = np.add.reduceat(np.where(distinct & many, self.sizes + 1, 0), groups) if n else np.zeros(0, np.int64)
        if self.depth < DEEPEST:
            for g in np.flatnonzero(weight > ARRAY).tolist():
                own = np.arange(bounds[g], bounds[g + 1])
                found.append(self._refined(own[distinct[own]]).later())
                distinct[own] = False
            left = np.flatnonzero(distinct & many)
        # whole groups fill suffix arrays of bounded size
        edges, size = [0], 0
        for j, i in enumerate(left.tolist()):
            if j and size + self.sizes[i] > ARRAY and head[0, i] != head[0, left[j - 1]]:
                edges.append(j)
                size = 0
            size += int(self.sizes[i]) + 1
        for s, e in zip(edges, [*edges[1:], len(left)], strict=True):
            found.append(self._one(left[s:e]))
        return np.concatenate(found, 1)

    def _refined(self, rows: np.ndarray) -> Contexts:
        """The strings of these contexts as contexts of their next anchors."""
        sizes, head = self.sizes[rows], self.head[:, rows]
        at = ranges(self.begins[rows], sizes)
        data = self.data[at]
        banned = np.zeros(len(data), bool) if self.banned is None else self.banned[at]
        offs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        tail = offs[1:, None] - np.arange(1, GRAM)[None, :]  # grams that would reach into the next context
        grams = gram_hashes(data, GRAM, banned)
        grams[tail.ravel()] = np.iinfo(np.uint64).max
        least = np.minimum.reduceat((grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(data), dtype=np.uint64), offs[:-1])
        banned[(least & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
        first, count, own, h = anchors(data, offs, self.length, banned=banned)
        part = ranges(first, count + self.length - 1)
        narrow = np.stack([h.view(np.int64), head[1][own], head[2][own], head[3][own], head[4][own] + first - offs[own], count])
        return Contexts(narrow, data[part], self.length, banned=banned[part], depth=self.depth + 1)

    def _one(self, rows: np.ndarray) -> np.ndarray:
        head, sizes = self.head[:, rows], self.sizes[rows]
        if not len(rows):
            return np.zeros((4, 0), np.int64)
        by = np.lexsort((head[4], head[1]))  # so places in the array's text follow doc and start
        head, sizes, begins = head[:, by], sizes[by], self.begins[rows][by]
        owner = np.repeat(np.arange(len(by)), head[5])
        offset = ranges(np.zeros(len(by), np.int64), head[5])
        if int(sizes.sum()) + len(by) <= ARRAY:
            text = np.zeros(int(sizes.sum()) + len(by), np.uint8)
            at = np.cumsum(sizes + 1) - (sizes + 1)
            text[ranges(at, sizes)] = self.data[ranges(begins, sizes)]
            starts = at[owner] + offset
            least = np.searchsorted(starts, later_strings(text, starts, self.length))
        else:
            least = self._by_string(begins, sizes, head[5])
        doc, start = head[1][owner], head[4][owner] + offset
        gone = (doc != doc[least]) | (start != start[least])
        # runs of strings that go, as byte spans
        run = gone.copy()
        run[1:] &= ~(gone[:-1] & (owner[1:] == owner[:-1]))
        stop = gone.copy()
        stop[:-1] &= ~(gone[1:] & (owner[1:] == owner[:-1]))
        f, t = np.flatnonzero(run), np.flatnonzero(stop)
        return np.stack([head[2][owner[f]], head[3][owner[f]], start[f], start[t] + self.length])

    def _by_string(self, begins: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """One anchor with more contexts than an array holds: its strings are sorted by their hashes
        and adjacent ones compared byte by byte; for each string the first one like it, by their order."""
        places = ranges(begins, counts)
        h, done, row = np.empty(len(places), np.uint64), 0, 0
        ends = np.cumsum(sizes)
        while row < len(sizes):  # hashes over a bounded stretch of contexts at a time
            stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + PIECE, "right")))
            size, count = sizes[row:stop], counts[row:stop]
            starts = ranges(np.cumsum(size) - size, count)
            text = prefix_hashes(self.data[ranges(begins[row:stop], size)])
            h[done : done + len(starts)] = span_hashes(text, starts, starts + self.length)
            done, row = done + len(starts), stop
        order = np.argsort(h, kind="stable")
        same = np.flatnonzero(h[order[1:]] == h[order[:-1]]) + 1
        view = np.lib.stride_tricks.sliding_window_view(self.data, self.length)
        equal = np.zeros(len(order), bool)
        for i in range(0, len(same), 20_000):
            part = same[i : i + 20_000]
            equal[part] = (view[places[order[part]]] == view[places[order[part - 1]]]).all(1)
        out = np.empty(len(places), np.int64)
        heads = np.flatnonzero(~equal)
        out[order] = np.repeat(order[heads], np.diff(np.append(heads, len(order))))  # stable: a head is its string's first place
        clash = same[~equal[same]]
        if len(clash):  # two strings under one hash: fold those few by their bytes
            seen: dict[bytes, int] = {}
            for i in np.flatnonzero(np.isin(h, h[order[clash]])).tolist():
                out[i] = seen.setdefault(view[places[i]].tobytes(), i)
        return out


def _packed(b: bytes) -> bytes:
    """Texts travel and rest as zstd: half of what the shuffle's own compression leaves."""
    return zstandard.ZstdCompressor(level=3).compress(b)


def _unpacked(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


def _piece_table(docs: DataFrame, leaders: DataFrame) -> DataFrame:
    """piece, ids, offsets, data: the leading texts, packed; each once, however many rows repeat it.

    Rows meet their leader by id and a hash of the text (h), so many texts without id, or under one, are dealt out too.
    """
    rows = docs.join(leaders.where("copies = 1"), ["doc", "h"]).select("doc", "text", "sha")
    again = leaders.where("copies > 1")
    if not again.isEmpty():  # only these texts are dealt by their key
        repeats = docs.join(again, ["doc", "h"]).where(F.sha2("text", 256) == F.col("sha")).select("doc", "text", "sha")
        rows = rows.unionByName(repeats.groupBy("doc", "sha").agg(F.min("text").alias("text")).select("doc", "text", "sha"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, str]] = []
        size, n = 0, 0
        task = TaskContext.get().partitionId()

        def pack() -> pa.RecordBatch:
            ids = np.array([d for d, _, _ in held], np.int64)
            offs = np.concatenate([[0], np.cumsum([len(b) for _, b, _ in held])]).astype(np.int64)
            cols = [ids.tobytes(), offs.tobytes(), _packed(b"".join(b for _, b, _ in held)), "".join(s for _, _, s in held)]
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + n], pa.int64()), *(pa.array([c], pa.binary()) for c in cols[:3]), pa.array([cols[3]], pa.string())], names=["piece", "ids", "offs", "data", "shas"])

        for batch in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
            for d, text, sha in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b = text.encode("utf-8", "surrogatepass")
                if hashlib.sha256(b).hexdigest() != sha:
                    continue  # an id that also stands for another text
                if held and size + len(b) > PIECE:
                    yield pack()
                    held, size, n = [], 0, n + 1
                held.append((d, b, sha))
                size += len(b)
        if held:
            yield pack()

    return materialize(arrow_map(rows, run, "piece long, ids binary, offs binary, data binary, shas string"), what="pieces")


def _open(row: dict) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    raw = _unpacked(row["data"])
    return raw, np.frombuffer(raw, np.uint8), np.frombuffer(row["offs"], np.int64), np.frombuffer(row["ids"], np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the anchors' hashes."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def repeated_anchors(pieces: DataFrame, *, buckets: int, length: int) -> DataFrame:
    """piece, bucket, bits: which of a piece's distinct anchors (in order) occur again anywhere."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, data, offs, _ = _open(row)
            h, n = np.unique(anchors(data, offs, length)[3], return_counts=True)
            part = bucket_runs(_bucket(h, buckets))
            cols = [pa.array([b for b, _, _ in part], pa.int64()), pa.array([row["piece"]] * len(part), pa.int64()), pa.array([h[s:e].tobytes() for _, s, e in part], pa.binary()), pa.array([(n[s:e] > 1).tobytes() for _, s, e in part], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["bucket", "piece", "hashes", "again"])

    def answer(rows: pa.Table) -> pa.Table:
        hs = [np.frombuffer(b, np.uint64) for b in rows["hashes"].to_pylist()]
        again = np.concatenate([np.frombuffer(b, bool) for b in rows["again"].to_pylist()])
        h = np.concatenate(hs)
        _, at, n = np.unique(h, return_inverse=True, return_counts=True)
        hit = (n[at] > 1) | again
        ends = np.cumsum([len(x) for x in hs])
        bits = [np.packbits(hit[e - len(x) : e]).tobytes() for e, x in zip(ends, hs, strict=True)]
        return pa.table({"piece": rows["piece"], "bucket": rows["bucket"], "bits": pa.chunked_array([pa.array(bits, pa.binary())])})

    asked = arrow_map(pieces.select("piece", "ids", "offs", "data"), ask, "bucket long, piece long, hashes binary, again binary")
    return asked.groupBy("bucket").applyInArrow(answer, "piece long, bucket long, bits binary")


def spans_to_remove(pieces: DataFrame, repeated: DataFrame, *, buckets: int, length: int, slices: int = 1) -> DataFrame:
    """piece, spans (packed rows of text, first byte, end). With slices a bucket's contexts are folded slice by slice first,
    so a passage that all pieces share meets its bucket as few contexts."""
    said = repeated.groupBy("piece").agg(F.sort_array(F.collect_list(F.struct("bucket", "bits"))).alias("said"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            raw, data, offs, ids = _open(row)
            first, count, text, h = anchors(data, offs, length)
            uniq, at = np.unique(h, return_inverse=True)
            own = _bucket(uniq, buckets)
            hit = np.zeros(len(uniq), bool)
            for x in row["said"]:
                s, e = np.searchsorted(own, [x["bucket"], x["bucket"] + 1])
                hit[s:e] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=e - s).astype(bool)
            keep = hit[at]
            first, count, text, h = first[keep], count[keep], text[keep], h[keep]
            if not len(first):
                continue
            # fold equal contexts inside the piece: only the earliest travels
            size = count + length - 1
            order = np.lexsort((first - offs[text], ids[text]))
            seen: dict[bytes, int] = {}
            send, local = [], []
            for i in order.tolist():
                f = int(first[i])
                k = seen.setdefault(raw[f : f + int(size[i])], i)
                if k == i:
                    send.append(i)
                elif (ids[text[k]], first[k] - offs[text[k]]) == (ids[text[i]], first[i] - offs[text[i]]):
                    send.append(i)  # a repeated row: as early as the other
                else:
                    local.append((text[i], f - offs[text[i]], f - offs[text[i]] + size[i]))
            send_at = np.array(send)
            b = _bucket(h[send_at], buckets)
            by = np.argsort(b, kind="stable")
            send_at, b = send_at[by], b[by]
            cuts = np.flatnonzero(np.append(True, b[1:] != b[:-1])).tolist() + [len(b)]
            out = []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                i = send_at[s:e]
                head = np.stack([h[i].view(np.int64), ids[text[i]], np.full(len(i), row["piece"]), text[i], first[i] - offs[text[i]], count[i]]).astype(np.int64)
                out.append((int(b[s]), row["piece"], _packed(head.tobytes()), _packed(data[ranges(first[i], size[i])].tobytes())))
            if local:
                out.append((int(b[0]), row["piece"], b"", np.array(local, np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "piece", "head", "data"])

    def gathered(rows: pa.Table) -> tuple[list[tuple[int, bytes]], Contexts | None]:
        """(spans found on the way, the contexts)."""
        got = rows.select(["piece", "head", "data"]).to_pylist()
        out = [(r["piece"], r["data"]) for r in got if not r["head"]]
        sent = [r for r in got if r["head"]]
        if not sent:
            return out, None
        head = np.concatenate([np.frombuffer(_unpacked(r["head"]), np.int64).reshape(6, -1) for r in sent], 1)
        return out, Contexts(head, np.frombuffer(b"".join(_unpacked(r["data"]) for r in sent), np.uint8), length)

    def by_piece(gone: np.ndarray) -> list[tuple[int, bytes]]:
        gone = gone[:, np.argsort(gone[0], kind="stable")]
        return [(int(gone[0, s]), np.ascontiguousarray(gone[1:, s:e].T).tobytes()) for _, s, e in bucket_runs(gone[0])]

    def fold(rows: pa.Table) -> pa.Table:
        """A slice of a bucket: of equal contexts only the earliest goes on."""
        spans, c = gathered(rows)
        out = [(rows["bucket"][0].as_py(), p, b"", d) for p, d in spans]
        if c is not None:
            first, folded, _, _ = c.fold()
            out += [(rows["bucket"][0].as_py(), p, b"", d) for p, d in by_piece(c.spans_of(folded))]
            kept = np.flatnonzero(first)
            out.append((rows["bucket"][0].as_py(), 0, _packed(np.ascontiguousarray(c.head[:, kept]).tobytes()), _packed(c.data[ranges(c.begins[kept], c.sizes[kept])].tobytes())))
        del c
        give_back()
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "piece", "head", "data"])

    def find(rows: pa.Table) -> pa.Table:
        out, c = gathered(rows)
        if c is not None:
            out += by_piece(c.later())
        del c
        give_back()
        return pa.table({"piece": pa.array([p for p, _ in out], pa.int64()), "spans": pa.array([s for _, s in out], pa.binary())})

    sent = arrow_map(pieces.select("piece", "ids", "offs", "data").join(said, "piece"), contexts, "bucket long, piece long, head binary, data binary")
    if slices > 1:
        salt = F.pmod(F.xxhash64("piece"), F.lit(slices))
        sent = sent.withColumn("slice", salt).groupBy("bucket", "slice").applyInArrow(lambda _, rows: fold(rows), "bucket long, piece long, head binary, data binary")
    return sent.groupBy("bucket").applyInArrow(find, "piece long, spans binary")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        raw, data, offs, ids = _open(row)
        gone = np.zeros(len(data) + 1, np.int32)
        for s in row["spans"] or []:
            text, first, end = np.frombuffer(s, np.int64).reshape(-1, 3).T
            np.add.at(gone, offs[text] + first, 1)
            np.add.at(gone, offs[text] + end, -1)
        removed = np.cumsum(gone)[:-1] > 0
        cols: list[list] = [[], [], [], [], [], []]
        for i, (s, e) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
            r = removed[s:e]
            n = int(r.sum())
            spans = int(np.count_nonzero(r[1:] & ~r[:-1]) + (len(r) and r[0])) if n else 0
            kept = data[s:e][~r].tobytes() if n else raw[s:e]
            sha = row["shas"][64 * i : 64 * i + 64]
            for c, v in zip(cols, (int(ids[i]), sha, n, spans, hashlib.sha256(kept).hexdigest() if n else sha, kept), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["doc", "sha", "n_removed", "n_spans", "kept_sha256", "kept"])


def suffix_dedup(docs: DataFrame, *, length: int = LENGTH, with_kept: bool = False, slice_pieces: int = SLICE_PIECES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes) of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select("doc_id", F.coalesce(F.col("doc_id"), F.lit(LAST)).alias("doc"), text.alias("text"))
    keys = materialize(source.select("doc_id", "doc", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"), F.xxhash64("text").alias("h")), what="keys")
    n = keys.count()
    per_doc = keys.groupBy("sha", "doc").agg(F.max("n_bytes").alias("n_bytes"), F.max("h").alias("h"), F.count("*").alias("copies"))
    lead = per_doc.groupBy("sha").agg(F.min(F.struct("doc", "copies")).alias("lead"), F.max("n_bytes").alias("n_bytes"), F.max("h").alias("h"))
    leaders = materialize(lead.select("sha", "lead.doc", "lead.copies", "n_bytes", "h"), what="leaders", files=files_for(n))
    total = leaders.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = int(total // BUCKET) + 8
    long = leaders.where(F.col("n_bytes") >= length).select("doc", "sha", "h", "copies")
    pieces = _piece_table(source.select("doc", "text", F.xxhash64("text").alias("h")), long)
    free_shuffles(spark)
    repeated = materialize(repeated_anchors(pieces, buckets=buckets, length=length), what="anchors", files=files_for(n))
    free_shuffles(spark)
    slices = pieces.count() // slice_pieces + 1
    spans = materialize(spans_to_remove(pieces, repeated, buckets=buckets, length=length, slices=slices), what="spans", files=files_for(n))
    release(repeated)
    free_shuffles(spark)
    by_piece = spans.groupBy("piece").agg(F.collect_list("spans").alias("spans"))
    done = arrow_map(pieces.join(by_piece, "piece", "left").select("ids", "offs", "data", "shas", "spans"), _kept, "doc long, sha string, n_removed long, n_spans long, kept_sha256 string, kept binary")
    if not with_kept:
        done = done.drop("kept")
    done = materialize(done, what="done", files=files_for(n, 20_000) if with_kept else files_for(n))
    release(pieces, spans)
    free_shuffles(spark)
    first = leaders.select(F.col("doc").alias("first"), "sha")
    # rows: leaders with their result; copies of an earlier text go whole; short texts stay whole
    rows = keys.drop("h").join(first, "sha").join(done, ["doc", "sha"], "left")
    copy = (F.col("doc") != F.col("first")) & (F.col("n_bytes") >= length)
    empty = hashlib.sha256(b"").hexdigest()
    out = rows.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"), F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, empty).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"), *([F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_kept else []),
    )
    return out
