"""Language ID by prediction by partial matching.

Each language has a variable-order byte context tree, up to ``ORDER`` bytes deep. A symbol seen
in the longest context that the tree holds is coded by its share there; else an escape is
coded and the next shorter context, without the symbols already ruled out, takes over, down to a
uniform byte. Counts are frozen after learning, so every (context, byte) has one exact code
length and a text costs the sum of them. The language with the shortest code wins.

All text of all training rows is counted. A context of two bytes or more enters its
language's tree if at least a ``SHARE`` part of the language's bytes stand behind it (or, with many
languages, if so many that all trees together keep below ``CONTEXTS`` contexts an order), so the model
is bounded whatever the size of the corpus, the alphabet and the number of languages.
Bytes before a text's first one count as NUL.

Defined results: null text, empty text and text without a letter are ``und`` with score 0;
ties go to the alphabetically first language; repeated rows are judged one by one; a
learned table of no rows makes every prediction ``und``; extra columns are ignored; every distinct
value of the language column is a language with a tree of its own, so it must be a column of languages.
Bytes that no training text has cost a uniform byte after all escapes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import arrow_map, flat, id_crc, materialize, pieces, release

ORDER = 4
SHARE, CONTEXTS = 2.0**-17, 1 << 20
PIECE_BYTES = 256 << 10
MEMO_BYTES = 24 << 20  # what a task keeps of code lengths at hand


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(key, offsets): each byte with the ORDER bytes before it in its text, the byte itself lowest."""
    data, offs = flat(texts)
    key = data.astype(np.int64)
    for back in range(1, ORDER + 1):
        before = np.zeros(len(data), np.int64)
        before[back:] = data[:-back] if len(data) > back else 0
        for i in range(back):  # not over the text's start
            at = offs[:-1] + i
            before[at[at < offs[1:]]] = 0
        key |= before << 8 * back
    return key, offs


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)

    for batch in batches:
        langs = batch.column(0)
        for lang in langs.unique().to_pylist():
            for piece in pieces(batch.filter(pc.equal(langs, lang)), "text", PIECE_BYTES):
                held.setdefault(lang, []).append(np.unique(grams(piece.column(1))[0], return_counts=True))
                if len(held[lang]) >= 32:
                    held[lang] = [merged(held[lang])]
    for lang, parts in held.items():
        k, n = merged(parts)
        for s in range(0, len(k), 200_000):
            e = min(s + 200_000, len(k))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (e - s), pa.string()), pa.array(k[s:e], pa.int64()), pa.array(n[s:e], pa.int64())], names=["lang", "key", "n"])


def low_bytes(key: np.ndarray, n: int) -> np.ndarray:
    return key & (1 << 8 * n) - 1


class Tree:
    """One language's contexts: code lengths in bits of (order, context, byte) and of leaving (order, context)."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """counts: for each order the (context, byte) keys, ordered, and how often each came."""
        seen, leave = [], []
        shorter: tuple[np.ndarray, np.ndarray] | None = None
        for k, (key, n) in enumerate(counts):
            context, first = np.unique(key >> 8, return_index=True)
            if not len(key):
                break
            kinds = np.diff(np.append(first, len(key)))
            total = np.add.reduceat(n, first)
            p = n / np.repeat(total + kinds, kinds)
            # what the shorter context gives to the bytes that this one rules out
            before = np.full(len(key), 1 / 256) if shorter is None else shorter[1][np.searchsorted(shorter[0], low_bytes(key, k))]
            left = np.maximum(1 - np.add.reduceat(before, first), 1e-9)
            seen.append((k << 40 | key, -np.log2(p)))
            leave.append((k << 40 | context, -np.log2(np.clip(kinds / (total + kinds) / left, 1e-30, None))))
            shorter = key, p
        join = lambda parts, i, kind: np.concatenate([x[i] for x in parts]).astype(kind) if parts else np.zeros(0, kind)
        self.seen, self.bits = join(seen, 0, np.int64), join(seen, 1, np.float32)
        self.contexts, self.escape = join(leave, 0, np.int64), join(leave, 1, np.float32)

    def code_lengths(self, keys: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each key after the bytes before it."""
        out = np.zeros(len(keys))
        rest = np.arange(len(keys))
        for k in range(ORDER, -1, -1):
            want = k << 40 | low_bytes(keys[rest], k + 1)
            at = np.minimum(np.searchsorted(self.seen, want), max(len(self.seen) - 1, 0))
            hit = self.seen[at] == want if len(self.seen) else np.zeros(len(rest), bool)
            out[rest[hit]] += self.bits[at[hit]]
            rest = rest[~hit]
            want = k << 40 | low_bytes(keys[rest] >> 8, k)
            at = np.minimum(np.searchsorted(self.contexts, want), max(len(self.contexts) - 1, 0))
            hit = self.contexts[at] == want if len(self.contexts) else np.zeros(len(rest), bool)
            out[rest[hit]] += self.escape[at[hit]]
        out[rest] += 8
        return out


class Model:
    """A tree for each language, frozen."""

    def __init__(self, langs: list[str], trees: list[Tree]) -> None:
        self.langs, self.trees = langs, trees

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores texts, with code lengths met before at hand: a table of fixed size, one key a slot."""

    def __init__(self, model: Model) -> None:
        self.model = model
        bits = int(MEMO_BYTES // (8 + 4 * max(len(model.langs), 1))).bit_length() - 1
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.bits = np.zeros((1 << bits, len(model.langs)), np.float32)

    def code_lengths(self, keys: np.ndarray) -> np.ndarray:
        """One row a key, one column a language."""
        slot = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
        out = self.bits[slot]
        miss = np.flatnonzero(self.keys[slot] != keys)
        if len(miss):
            uniq, at, inverse = np.unique(keys[miss], return_index=True, return_inverse=True)
            fresh = np.stack([t.code_lengths(uniq) for t in self.model.trees], 1).astype(np.float32)
            out[miss] = fresh[inverse]
            self.keys[slot[miss[at]]] = uniq
            self.bits[slot[miss[at]]] = fresh
        return out

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and its share of the likelihood, for each text (non-null)."""
        keys, offs = grams(texts)
        lens = np.diff(offs)
        if not self.model.langs:
            return np.zeros(len(lens), np.int64), np.zeros(len(lens))
        total = np.zeros((len(lens), len(self.model.langs)))
        full = np.flatnonzero(lens)
        if len(full):
            for s in range(0, len(keys), PIECE_BYTES):  # a long text is coded in stretches
                e = min(s + PIECE_BYTES, len(keys))
                first, last = np.searchsorted(offs, s, "right") - 1, np.searchsorted(offs, e, "left")
                here = np.arange(first, last)
                here = here[lens[here] > 0]
                total[here] += np.add.reduceat(self.code_lengths(keys[s:e]), np.maximum(offs[here], s) - s, axis=0, dtype=np.float64)
        best = total.argmin(1)
        share = 1 / np.exp2(np.clip(total.min(1)[:, None] - total, -1000, 0)).sum(1)
        return best, share


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", share: float = SHARE, contexts: int = CONTEXTS) -> Model:
    """Count every (context, byte) of all rows with a language, then freeze the code lengths.

    Counting, adding up and choosing contexts are Spark's; only the chosen trees reach the driver.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")
    counts = materialize(arrow_map(rows, _counts, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")), what="grams")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    place = {x: i for i, x in enumerate(langs)}
    least = max(share, len(langs) / contexts)
    held: list[dict[str, tuple[np.ndarray, np.ndarray]]] = []
    for k in range(ORDER + 1):
        own = counts.groupBy("lang", F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("key")).agg(F.sum("n").alias("n")) if k < ORDER else counts
        if k >= 2:
            bars = F.broadcast(counts.groupBy("lang").agg((F.sum("n") * least).alias("bar")))  # one row a language
            context = F.shiftright("key", 8).alias("context")
            often = own.groupBy("lang", context).agg(F.sum("n").alias("c")).join(bars, "lang").where("c >= bar").select("lang", "context")
            own = own.withColumn("context", context).join(often, ["lang", "context"], "left_semi").select("lang", "key", "n")
        got = own.select("lang", "key", "n").toArrow()
        which, key, n = np.array([place[x] for x in got["lang"].to_pylist()], np.int64), got["key"].to_numpy(), got["n"].to_numpy()
        order = np.lexsort((key, which))
        cuts = np.searchsorted(which[order], np.arange(len(langs) + 1))
        held.append({x: (key[order[s:e]], n[order[s:e]]) for x, s, e in zip(langs, cuts[:-1], cuts[1:], strict=True)})
    release(counts)
    return Model(langs, [Tree([h[x] for h in held]) for x in langs])


def predict(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns to keep) plus lang_pred and score; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "__letters")]
    held = kept if text in kept else [*kept, text]
    ready = docs.select(*held, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letters"))
    schema = ready.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    at = held.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = m.scorer()
        for batch in batches:
            for piece in pieces(batch, text, PIECE_BYTES):
                best, share = scorer.score(piece.column(at))
                ok = piece.column(len(held)).to_numpy(zero_copy_only=False).astype(bool) & bool(m.langs)
                names = pa.array([m.langs[b] if k else "und" for b, k in zip(best, ok, strict=True)], pa.string())
                cols = [*piece.columns[: len(kept)], names, pa.array(np.where(ok, share, 0.0), pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return arrow_map(ready, run, schema)


def language_id(docs: DataFrame, *, folds: int = 4, held_out: int = 2) -> DataFrame:
    """Learn on the rows outside the held-out fold, predict all rows: doc_id, held_out, lang_pred, score."""
    out = F.pmod(id_crc(), F.lit(folds)) == held_out
    model = learn(docs.where(~out))
    return predict(docs.select("doc_id", out.alias("held_out"), F.col("text").cast("string").alias("text")), model, keep=["doc_id", "held_out"])
