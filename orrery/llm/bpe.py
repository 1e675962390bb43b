"""BPE encoding and decoding through a table of distinct words.

Texts are split into words by numpy over whole batches; each distinct word is encoded once by
the public tokenizer's model, and its ids are joined to the vocabulary's pieces once; ids and
pieces come back to the texts by the words' positions. A text decodes to its pieces, joined by
one space, as the tokenizer (which has no decoder) does it.

Words meet the table by 64-bit hashes. Every hash that is looked up must be in the table, else
the job fails; words that share a hash are told apart by their bytes.

The word table is broadcast as packed arrays only while its counted size is under
``broadcast_bytes``; a larger table is joined to the (bucket, word) pairs of the texts
and texts meet their own bucket's words, so no task holds more than one bucket.

Defined results: null and empty texts have no ids and decode to the empty text; special
tokens written in a text are encoded as such, as the library does; repeated rows are
encoded one by one; extra columns are ignored, and columns named like the results are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from orrery.llm.common import arrow_map, extended, flat, give_back, materialize, pieces, ranges, release
from orrery.llm.words import prefix_hashes, second_prefix_hashes, span_hashes

BROADCAST_BYTES = 128 << 20
BUCKET_BYTES = 16 << 20
PIECE_BYTES = 256 << 10
SENT = 50_000  # words a task remembers to have sent
#: The pre-tokenizer's word pattern of the vocabulary file, and its contractions.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SHORT = ("s", "t", "re", "ve", "m", "ll", "d")
SPACE, LETTER, DIGIT, SIGN, UNUSUAL = range(5)


@lru_cache(1)
def _plain_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of ASCII bytes; classes and lower-case bytes of U+0080 to U+017F as two-byte sequences.

    Plain are ASCII without control characters, letters and signs of Latin-1 and Latin Extended-A:
    composed already, lower-cased one to one. Digits, spaces and whatever else is left to the library.
    """
    ascii_class = np.full(256, UNUSUAL, np.uint8)
    for c in range(32, 127):
        ascii_class[c] = LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else SIGN
    ascii_class[[9, 10, 13, 32]] = SPACE
    wide_class = np.full(0x180, UNUSUAL, np.uint8)
    lower = np.zeros((0x180, 2), np.uint8)
    for c in range(0xA1, 0x180):
        low = chr(c).lower().encode()
        if chr(c).isnumeric() or not chr(c).isprintable() or len(low) != 2 or chr(c) == "ſ":
            continue
        wide_class[c] = LETTER if chr(c).isalpha() else SIGN
        lower[c] = np.frombuffer(low, np.uint8)
    return ascii_class, wide_class, lower


class Words:
    """The words of a batch of texts: bytes, starts, ends, hashes; those of text i are first[i]:first[i + 1]."""

    def __init__(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> None:
        self.low, self.starts, self.ends, self.first = low, starts, ends, first
        self.hashes = span_hashes(prefix_hashes(low), starts, ends)

    def second_hashes(self) -> np.ndarray:
        return span_hashes(second_prefix_hashes(self.low), self.starts, self.ends)

    def strings(self, at: np.ndarray) -> pa.Array:
        sizes = self.ends[at] - self.starts[at]
        offs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offs), pa.py_buffer(self.low[ranges(self.starts[at], sizes)].tobytes()))


class Splitter:
    """Words of texts, exactly as the tokenizer splits them; special tokens stand as words of their own."""

    def __init__(self, path: str) -> None:
        from tokenizers import Regex, Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.exact = Split(Regex(WORD), "removed", invert=True)
        # the byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on
        own = [b for b in range(256) if chr(b).isprintable() and chr(b) != " "]
        self.letters = {b: b for b in own} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in own)}

    def slow(self, text: str) -> list[str]:
        """The library's own way, for any text."""
        part = lambda s: [w for w, _ in self.exact.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(s))]
        if self.cut is None:
            return part(text)
        return [w for p in self.cut.split(text) for w in ([p] if p in self.special else part(p))]

    def words(self, texts: pa.Array) -> Words:
        data, offs = flat(texts)
        n = len(data)
        if not n:
            return Words(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64))
        ascii_class, wide_class, lower = _plain_tables()
        kind, low = ascii_class[data], data + ((data >= 65) & (data <= 90)).astype(np.uint8) * 32
        beyond = np.flatnonzero(data >= 128)
        if len(beyond):
            two = beyond[(data[beyond] >= 0xC2) & (data[beyond] <= 0xC5)]
            code = (data[two].astype(np.int64) & 31) << 6 | data[two + 1] & 63
            kind[two] = kind[two + 1] = wide_class[code]
            low[two], low[two + 1] = lower[code, 0], lower[code, 1]
            three = beyond[data[beyond] == 0xE2]  # U+2010 to U+2027: dashes, quotes, bullets, dots
            three = three[(data[three + 1] == 0x80) & (data[three + 2] >= 0x90) & (data[three + 2] <= 0xA7)]
            kind[three] = kind[three + 1] = kind[three + 2] = SIGN
        text_of = lambda at: np.searchsorted(offs, at, "right") - 1
        odd = set(np.unique(text_of(np.flatnonzero(kind == UNUSUAL))).tolist())
        raw = data.tobytes() if self.special else b""
        for s in self.special:
            b = s.encode()
            at = raw.find(b)
            while at >= 0:  # over a border of texts it does no harm
                odd.add(int(text_of(at)))
                at = raw.find(b, at + 1)
        for i in odd:
            kind[offs[i] : offs[i + 1]] = SPACE
        edge = np.ones(n + 1, bool)
        edge[1:-1] = (kind[1:] != kind[:-1])
        edge[:-1] |= kind == DIGIT
        edge[offs] = True
        cuts = np.flatnonzero(edge)
        word = kind[cuts[:-1]] != SPACE
        starts, ends = cuts[:-1][word], cuts[1:][word]
        starts, ends = self._contracted(low, kind, offs, starts, ends)
        if not odd:
            return Words(low, starts, ends, np.searchsorted(starts, offs))
        owner, extra, size = text_of(starts), [], n
        for i in sorted(odd):
            for w in self.slow(texts[i].as_py()):
                b = w.encode("utf-8", "surrogatepass")
                extra.append((i, size, size + len(b), b))
                size += len(b)
        low = np.concatenate([low, np.frombuffer(b"".join(x[3] for x in extra), np.uint8)])
        more = np.array([x[:3] for x in extra], np.int64).reshape(-1, 3)
        owner = np.concatenate([owner, more[:, 0]])
        order = np.argsort(owner, kind="stable")
        return Words(low, np.concatenate([starts, more[:, 1]])[order], np.concatenate([ends, more[:, 2]])[order], np.searchsorted(owner[order], np.arange(len(offs))))

    @staticmethod
    def _contracted(low: np.ndarray, kind: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An apostrophe alone before letters takes those of a contraction along."""
        lone = np.flatnonzero((ends - starts == 1) & (low[starts] == 39))
        lone = lone[lone + 1 < len(starts)]
        lone = lone[(starts[lone + 1] == ends[lone]) & (kind[starts[lone + 1]] == LETTER)]
        lone = lone[~np.isin(ends[lone], offs)]
        if not len(lone):
            return starts, ends
        starts, ends = starts.copy(), ends.copy()
        begin = starts[lone + 1]
        long = ends[lone + 1] - begin > 1
        c, d = low[begin], low[np.minimum(begin + 1, len(low) - 1)]
        take = np.zeros(len(lone), np.int64)
        for s in SHORT:
            take[(c == ord(s)) if len(s) == 1 else (c == ord(s[0])) & long & (d == ord(s[1]))] = len(s)
        ends[lone] += take
        starts[lone + 1] += take
        some = ends > starts
        return starts[some], ends[some]

    def ids(self, words: list[str]) -> list[list[int]]:
        """Each word's ids, straight from the model."""
        tokenize = self.tokenizer.model.tokenize
        out = []
        for w in words:
            if w in self.special:
                out.append([self.special[w]])
            else:
                out.append([t.id for t in tokenize(w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters))])
        return out


@lru_cache(2)
def splitter(path: str) -> Splitter:
    return Splitter(path)


@lru_cache(2)
def vocabulary(path: str) -> list[str]:
    """Pieces by id, all of them."""
    t = splitter(path).tokenizer
    return [t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))]


class Joined:
    """Strings, each followed by a space, as packed bytes."""

    def __init__(self, strings: list[str]) -> None:
        blobs = [s.encode("utf-8", "surrogatepass") + b" " for s in strings]
        self.sizes = np.array([len(b) for b in blobs], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(blobs), np.uint8)

    def texts(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """For each text (ids first[i]:first[i + 1]) its ids' strings, joined by one space."""
        sizes = self.sizes[ids]
        whole = self.data[ranges(self.starts[ids], sizes)].tobytes()
        at = np.concatenate([[0], np.cumsum(sizes)])[first].tolist()
        return [whole[s : max(s, e - 1)] for s, e in zip(at[:-1], at[1:], strict=True)]


@lru_cache(2)
def decimals(path: str) -> Joined:
    """Ids as decimal numbers."""
    return Joined([str(i) for i in range(len(vocabulary(path)))])


def hash_words(words: pa.Array) -> np.ndarray:
    data, offs = flat(words)
    return span_hashes(prefix_hashes(data), offs[:-1], offs[1:])


def distinct_words(docs: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """Every word that any text has, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, sent = splitter(path), {}
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                words = split.words(piece.column(0))
                if not len(words.hashes):
                    continue
                h, second = words.hashes, words.second_hashes()
                _, at, inverse = np.unique(h, return_index=True, return_inverse=True)
                clash = np.flatnonzero(second != second[at][inverse])  # other words under the same hash
                keys, seconds = h[at].tolist(), second[at].tolist()
                fresh = [i for i, k, s in zip(at.tolist(), keys, seconds, strict=True) if sent.get(k) != s]
                if len(sent) > SENT:
                    sent.clear()
                sent.update(zip(keys, seconds, strict=True))
                yield pa.RecordBatch.from_arrays([words.strings(np.array([*fresh, *clash.tolist()], np.int64))], names=["word"])

    return arrow_map(docs.select(F.col(text).cast("string").alias("text")), run, "word string").distinct()


def word_table(words: DataFrame, path: str) -> DataFrame:
    """word, ids (int32 packed), said: each word is encoded once, and its ids are joined to the vocabulary's pieces once.

    said is the word's pieces joined by one space. The vocabulary is a table of fixed size, and the only broadcast side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = splitter(path).ids
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                words = batch.slice(at, 20_000).column(0)
                yield pa.RecordBatch.from_arrays([words, pa.array(ids(words.to_pylist()), pa.list_(pa.int32()))], names=["word", "ids"])

    encoded = arrow_map(words, run, "word string, ids array<int>")
    at = encoded.select("word", F.posexplode_outer("ids").alias("pos", "id"))
    met = at.join(F.broadcast(_piece_rows(words.sparkSession, path)), F.col("id") == F.col("__id"), "left")
    # gathered by word again: its ids in order, and what they are joined to
    own = met.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "__piece"))).alias("e")).select("word", F.filter("e", lambda e: e["id"].isNotNull()).alias("e"))
    return arrow_map(own.select("word", F.transform("e", lambda e: e["id"]).alias("ids"), F.array_join(F.transform("e", lambda e: e["__piece"]), " ").alias("said")), _with_packed_ids, "word string, ids binary, said string")


def _with_packed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers = batch.column(1)
        first = np.asarray(numbers.offsets).astype(np.int64) * 4
        blobs = pa.Array.from_buffers(pa.binary(), len(numbers), [None, pa.py_buffer((first - first[0]).astype(np.int32)), pa.py_buffer(np.asarray(numbers.flatten()).astype(np.int32).tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column(0), blobs, batch.column(2)], names=["word", "ids", "said"])


def _piece_rows(spark: SparkSession, path: str) -> DataFrame:
    """__id, __piece of the whole vocabulary."""
    return spark.createDataFrame(list(enumerate(vocabulary(path))), "__id int, __piece string")


class _Spans:
    """Runs of numbers or bytes, one a word, in packed arrays; the last words stand in the order in which they come."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray, order: np.ndarray, extra: list) -> None:
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        starts, sizes = starts[order], sizes[order]
        # a bounded part of the words at a time, so that no index of all values stands beside them
        parts = [values[ranges(starts[i : i + 100_000], sizes[i : i + 100_000].astype(np.int64))] for i in range(0, len(order), 100_000)]
        self.values = np.concatenate([values[:0], *parts, np.array([x for e in extra for x in e], values.dtype)])
        more = np.array([len(e) for e in extra], np.int64)
        most = max(int(sizes.max(initial=0)), int(more.max(initial=0)))
        self.sizes = np.concatenate([sizes.astype(np.min_scalar_type(most)), more.astype(np.min_scalar_type(most))])

    def at(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the words' values one after another, how many each word has)."""
        if not hasattr(self, "starts"):
            self.starts = (np.cumsum(self.sizes, dtype=np.int64) - self.sizes).astype(np.uint32 if len(self.values) < 1 << 32 else np.int64)
        sizes = self.sizes[entry].astype(np.int64)
        return self.values[ranges(self.starts[entry].astype(np.int64), sizes)], sizes


class PackedTable:
    """word -> ids and pieces in packed arrays by the words' hashes; words whose hashes meet stand apart, by their bytes.

    said: every word's pieces as bytes, each word's with a space behind.
    """

    def __init__(self, keys: np.ndarray, ids: Callable[[], tuple[np.ndarray, np.ndarray]], said: Callable[[], tuple[np.ndarray, np.ndarray]], apart: dict[bytes, tuple[list[int], bytes]]) -> None:
        """ids and said give values and sizes by word; each is asked for when the one before is packed and gone."""
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        extra = list(apart.values())
        values, sizes = ids()
        most = max([int(values.max(initial=0)), *(max(i, default=0) for i, _ in extra)])
        self.ids = _Spans(values.astype(np.min_scalar_type(most), copy=False), sizes, order, [i for i, _ in extra])
        del values, sizes
        give_back()
        self.said = _Spans(*said(), order, [s for _, s in extra])
        self.apart = {w: len(keys) + i for i, w in enumerate(apart)}
        self.shared = hash_words(pa.array(list(apart), pa.binary())) if apart else np.zeros(0, np.uint64)

    def look_up(self, words: Words) -> np.ndarray:
        """The entry of every word."""
        uniq, inverse = np.unique(words.hashes, return_inverse=True)
        at = np.searchsorted(self.keys, uniq)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == uniq[known]
        if not known.all():
            raise RuntimeError(f"{int((~known).sum())} words are not in the word table")
        entry = at[inverse]
        for k in np.flatnonzero(np.isin(words.hashes, self.shared)).tolist() if self.apart else ():
            entry[k] = self.apart.get(words.low[words.starts[k] : words.ends[k]].tobytes(), -1)
        if (entry < 0).any():
            raise RuntimeError(f"{int((entry < 0).sum())} words are not in the word table")
        return entry


def _clashes(keys: np.ndarray) -> set[int]:
    ordered = np.sort(keys)
    return set(ordered[1:][ordered[1:] == ordered[:-1]].tolist())


def packed(table: DataFrame) -> PackedTable:
    """The whole table in packed arrays, made on the executors as narrow as its numbers allow; ids and pieces come one after the other."""
    few, long = table.agg(F.max(F.length("ids")), F.max(F.octet_length("said"))).first()
    size_kind, said_kind = np.min_scalar_type((few or 0) // 4), np.min_scalar_type((long or 0) + 1)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, offs = flat(batch.column(1))
            ids = np.frombuffer(blobs.tobytes(), np.int32)
            short = ids.max(initial=0) < 1 << 16
            cols = [hash_words(batch.column(0)).tobytes(), (np.diff(offs) // 4).astype(size_kind).tobytes(), (ids.astype(np.uint16) if short else ids).tobytes()]
            yield pa.RecordBatch.from_arrays([*(pa.array([c], pa.binary()) for c in cols), pa.array([short], pa.bool_())], names=["keys", "sizes", "ids", "short"])

    def spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.bitwise_xor.reduce(hash_words(batch.column(0)), keepdims=True)
            cols = [keys.tobytes(), *(c.tobytes() for c in _spaced(batch.column(2), np.diff(flat(batch.column(1))[1]), said_kind))]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cols], names=["mark", "said", "said_sizes"])

    whole = lambda c, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in c)])
    words = table.select("word", "ids", "said")
    got = arrow_map(words, coded, "keys binary, sizes binary, ids binary, short boolean").toArrow()
    marks = [int(np.bitwise_xor.reduce(np.frombuffer(x.as_buffer(), np.uint64))) for x in got["keys"]]
    keys, sizes = whole(got["keys"], np.uint64), whole(got["sizes"], size_kind)
    ids = np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(x.as_buffer(), np.uint16 if s.as_py() else np.int32) for x, s in zip(got["ids"], got["short"], strict=True))])
    del got
    give_back()
    behind = lambda s, n: s.encode("utf-8", "surrogatepass") + b" " * (n > 0)
    apart: dict[bytes, tuple[list[int], bytes]] = {}
    if twice := _clashes(keys):  # two words with one hash: fetch those few by their words
        same = F.udf(lambda w: int(hash_words(pa.array([w], pa.string()))[0]) in twice, "boolean")
        apart = {r.word.encode("utf-8", "surrogatepass"): (np.frombuffer(r.ids, np.int32).tolist(), behind(r.said, len(r.ids))) for r in table.where(same("word")).collect()}
    held = [(ids, sizes)]
    del ids, sizes

    def said_of() -> tuple[np.ndarray, np.ndarray]:
        got = arrow_map(words, spoken, "mark binary, said binary, said_sizes binary").toArrow()
        if [int(np.frombuffer(x.as_buffer(), np.uint64)[0]) for x in got["mark"]] != marks:
            raise RuntimeError("the word table came in another order")
        return whole(got["said"], np.uint8), whole(got["said_sizes"], said_kind)

    out = PackedTable(keys, held.pop, said_of, apart)
    del keys
    give_back()
    return out


def _spaced(said: pa.Array, n_ids: np.ndarray, kind: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the words' pieces with a space behind each word that has ids, their sizes)."""
    data, offs = flat(said)
    spaces = np.cumsum(n_ids > 0)
    out = np.full(len(data) + int(spaces[-1] if len(spaces) else 0), 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(spaces - (n_ids > 0), np.diff(offs))] = data
    return out, (np.diff(offs) + (n_ids > 0)).astype(kind)


def packed_words(words: pa.Array, ids: list[bytes], said: pa.Array) -> PackedTable:
    """The same from words at hand."""
    keys = hash_words(words)
    twice = _clashes(keys)
    rows = zip(words.to_pylist(), ids, said.to_pylist(), keys.tolist(), strict=True)
    apart = {w.encode("utf-8", "surrogatepass"): (np.frombuffer(i, np.int32).tolist(), s.encode("utf-8", "surrogatepass") + b" " * (len(i) > 0)) for w, i, s, k in rows if k in twice} if twice else {}
    sizes = np.array([len(i) // 4 for i in ids], np.int64)
    return PackedTable(keys, lambda: (np.frombuffer(b"".join(ids), np.int32), sizes), lambda: _spaced(said, sizes), apart)


class Coded:
    """The words of some texts with their entries in the table."""

    def __init__(self, words: Words, table: PackedTable) -> None:
        self.first, self.table, self.entry = words.first, table, table.look_up(words)

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the ids of text i are first[i]:first[i + 1]."""
        ids, sizes = self.table.ids.at(self.entry)
        return ids.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])[self.first]

    def decoded(self) -> list[bytes]:
        """Each text's pieces, joined by one space."""
        said, sizes = self.table.said.at(self.entry)
        at, whole = np.concatenate([[0], np.cumsum(sizes)])[self.first].tolist(), said.tobytes()
        return [whole[s : max(s, e - 1)] for s, e in zip(at[:-1], at[1:], strict=True)]


def _digest_rows(coded: Coded, path: str) -> list[pa.Array]:
    ids, first = coded.ids()
    sha = lambda texts: pa.array([hashlib.sha256(b).hexdigest() for b in texts], pa.string())
    return [pa.array(np.diff(first), pa.int64()), sha(decimals(path).texts(ids, first)), sha(coded.decoded())]


def _id_rows(coded: Coded, path: str) -> list[pa.Array]:
    ids, first = coded.ids()
    return [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))]


#: What encode() can return: its columns and how they are made.
OUTPUTS = {"ids": ("ids array<int>", _id_rows), "digests": ("n_tokens long, ids_sha256 string, decoded_sha256 string", _digest_rows)}


def encode(docs: DataFrame, path: str, *, text: str = "text", keep: list[str] | None = None, output: str = "ids", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The kept columns plus ids (or their digests) of every text."""
    columns, rows = OUTPUTS[output]
    names = [c.split()[0] for c in columns.split(", ")]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    held = kept if text in kept else [*kept, text]
    source = docs.select(*[F.col(c).cast("string").alias(c) if c == text else c for c in held])
    schema = extended(source.select(*kept).schema, columns)
    at = held.index(text)

    table = materialize(word_table(distinct_words(docs, path, text=text), path), what="words")
    size = table.agg(F.coalesce(F.sum(F.length("ids") / 2 + F.octet_length("said") + 15), F.lit(0))).first()[0]

    def emit(piece: pa.RecordBatch, own: PackedTable) -> pa.RecordBatch:
        got = rows(Coded(splitter(path).words(piece.column(at)), own), path)
        return pa.RecordBatch.from_arrays([*piece.columns[: len(kept)], *got], names=schema.names)

    if size <= broadcast_bytes:
        shared = docs.sparkSession.sparkContext.broadcast(packed(table))
        release(table)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in pieces(batch, text, PIECE_BYTES):
                    yield emit(piece, shared.value)

        return arrow_map(source, run, schema)
    return _encode_by_bucket(source, table, path, text, emit, schema)


def _encode_by_bucket(source: DataFrame, table: DataFrame, path: str, text: str, emit: Callable, schema) -> DataFrame:
    """Texts in buckets of about BUCKET_BYTES; a bucket's distinct words are joined to the table, then meet its texts."""
    total = source.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n = int(total // BUCKET_BYTES) + 1
    dealt = source.withColumn("__bucket", F.pmod(F.xxhash64(*source.columns), F.lit(n)).cast("int"))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(path)
        for batch in batches:
            for piece in pieces(batch, text, PIECE_BYTES):
                words = split.words(piece.column(1))
                if len(words.hashes):
                    bucket = np.repeat(piece.column(0).to_numpy().astype(np.int64), np.diff(words.first))
                    order = np.lexsort((words.second_hashes(), words.hashes, bucket))
                    mark = np.stack([bucket.view(np.uint64), words.hashes, words.second_hashes()])[:, order]
                    at = order[np.append(True, (mark[:, 1:] != mark[:, :-1]).any(0))]
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int32()), words.strings(at)], names=["__bucket", "word"])

    pairs = arrow_map(dealt.select("__bucket", text), words_of, "__bucket int, word string").distinct().join(table, "word")

    def meet(docs: pa.Table, words: pa.Table) -> pa.Table:
        own = packed_words(words["word"].combine_chunks(), words["ids"].to_pylist(), words["said"].combine_chunks())
        rows = docs.drop_columns(["__bucket"]).combine_chunks().to_batches()
        out = [emit(p, own) for b in rows for p in pieces(b, text, PIECE_BYTES)]
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([], to_arrow_schema(schema))

    return dealt.groupBy("__bucket").cogroup(pairs.groupBy("__bucket")).applyInArrow(meet, schema)


def decode(rows: DataFrame, path: str, *, ids: str = "ids") -> DataFrame:
    """rows plus decoded: ids are numbered by position, joined to the vocabulary's (id, piece) rows and gathered again.

    The vocabulary is a table of fixed size and the only broadcast side. Null ids give null,
    null members and ids outside the vocabulary give nothing, no ids give the empty text.
    """
    spark = rows.sparkSession
    kept = [c for c in rows.columns if c != "decoded"]
    numbered = materialize(rows.select(*kept).withColumn("__row", F.monotonically_increasing_id()), what="rows")
    at = numbered.select("__row", F.posexplode(ids).alias("__pos", "__id"))
    own = at.join(F.broadcast(_piece_rows(spark, path)), "__id").groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("__pos", "__piece"))).alias("__pieces"))
    text = F.array_join(F.transform(F.coalesce("__pieces", F.array().cast("array<struct<__pos:int,__piece:string>>")), lambda p: p.getField("__piece")), " ")
    return numbered.join(own, "__row", "left").select(*kept, F.when(F.col(ids).isNotNull(), text).alias("decoded"))
