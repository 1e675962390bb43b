"""URL filters by a Bloom filter cascade.

Listed keys go into the first filter. The keys of the corpus that pass it wrongly go into
the second, the listed keys that pass the second go into the third, and so on until a
level lets nothing wrong pass. Over the corpus's complete key universe membership is then
exact, and judging a url needs no join: only the filters travel, about ten bits a listed
key plus fewer for each further level.

A url's keys are (host suffix, path prefix) pairs; prefixes are tried at the lengths the
rules have. The longest listed key decides; urls without one are blocked if their host
or a parent of it is on the list of blocked hosts, else allowed.

Defined results: null urls and urls without ``://`` have empty host and path, no rule and
the default verdict; repeated rows are judged one by one; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import materialize, release

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())
BITS_A_KEY = 10
HASHES = 7
LEVELS = 64


@lru_cache(1 << 16)
def _digest(key: str) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"))
    return d & (1 << 64) - 1, d >> 64 | 1


class Bloom:
    """One level: bits are placed by double hashing, turned by the level's number."""

    def __init__(self, level: int, words: np.ndarray) -> None:
        self.level, self.words, self.m = level, words, len(words) * 64

    @staticmethod
    def places(key: str, level: int, m: int) -> list[int]:
        a, b = _digest(key)
        a = (a + (2 * level + 1) * 0x9E3779B97F4A7C15 + (b >> (level % 32))) & (1 << 64) - 1
        return [(a + i * b + i * i * (level + 1)) % (1 << 64) % m for i in range(HASHES)]

    def __contains__(self, key: str) -> bool:
        return all(self.words[p >> 6] >> np.uint64(p & 63) & np.uint64(1) for p in self.places(key, self.level, self.m))


class Cascade:
    """Exact over the universe it was built for."""

    def __init__(self, levels: list[Bloom]) -> None:
        self.levels = levels

    def __contains__(self, key: str) -> bool:
        for i, level in enumerate(self.levels):
            if key not in level:
                return i % 2 == 1
        return len(self.levels) % 2 == 1


def _bloom(keys: DataFrame, level: int) -> Bloom | None:
    """A level over these keys; bits are set and merged in Spark, the driver gets the words."""
    n = keys.count()
    if not n:
        return None
    m = max(64, -(-n * BITS_A_KEY // 64) * 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [p for k in b.column(0).to_pylist() for p in Bloom.places(k, level, m)]
            yield pa.RecordBatch.from_arrays([pa.array([p >> 6 for p in at], pa.int64()), pa.array(np.left_shift(np.uint64(1), np.array([p & 63 for p in at], np.uint64)).view(np.int64))], names=["word", "bits"])

    got = keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(m // 64, np.uint64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return Bloom(level, words)


def _passing(keys: DataFrame, level: Bloom) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([k in level for k in b.column(0).to_pylist()], pa.bool_()))

    return keys.mapInArrow(run, "key string")


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """Both tables hold one column ``key`` of distinct, non-null strings."""
    inside, outside, levels, held = listed, universe.join(listed, "key", "left_anti"), [], []
    while (level := _bloom(inside, len(levels))) is not None:
        if len(levels) == LEVELS:
            raise RuntimeError("the cascade does not end: more levels than hashes can tell apart")
        levels.append(level)
        held.append(materialize(_passing(outside, level), what="keys"))
        inside, outside = held[-1], inside
        if len(held) > 2:
            release(held[-3])  # a level reads the two before it
    release(*held[-2:])
    return Cascade(levels)


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host from the first :// up to / ? # or the end; path up to ? # or the end."""
    _, there, rest = (url or "").partition("://")
    if not there:
        return "", ""
    end = m.start() if (m := re.search("[/?#]", rest)) else len(rest)
    return rest[:end].translate(LOWER), re.match("[^?#]*", rest[end:], re.S)[0]


def host_suffixes(host: str) -> list[str]:
    parts = host.split(".")
    return [".".join(parts[i:]) for i in range(len(parts))] if host else []


def url_keys(host: str, path: str, lengths: tuple[int, ...]) -> list[str]:
    """Host suffix + path prefix, for the prefix lengths that rules have."""
    heads = [path[:n] for n in lengths if n <= len(path)]
    return [h + p for h in host_suffixes(host) for p in heads]


def judge_urls(pages: DataFrame, rules: dict[str, str], *, blocked_hosts: DataFrame | tuple[str, ...] = (), url: str = "url") -> DataFrame:
    """pages plus host, path, rule, verdict. rules: host and path in one string -> allow or block; blocked_hosts: a table with one column of hosts, of any size, or a few of them."""
    spark = pages.sparkSession
    lengths = tuple(sorted({len(r) - r.index("/") for r in rules if "/" in r}))
    if not isinstance(blocked_hosts, DataFrame):
        blocked_hosts = spark.createDataFrame([(h,) for h in blocked_hosts], "host string")
    # a host by itself is marked, apart from rules
    marks = blocked_hosts.select(F.concat(F.lit("\0"), F.translate(F.col(blocked_hosts.columns[0]), UPPER, UPPER.lower())).alias("key")).where("key IS NOT NULL")

    def keys_of(u: str | None) -> list[str]:
        host, path = split_url(u)
        return url_keys(host, path, lengths) + [f"\0{h}" for h in host_suffixes(host)]

    def run_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            have = {k for u in b.column(0).to_pylist() for k in keys_of(u)}
            yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.string())], names=["key"])

    listed = materialize(spark.createDataFrame([(k,) for k in rules], "key string").union(marks).distinct(), what="listed")
    universe = pages.select(F.col(url).cast("string")).mapInArrow(run_keys, "key string").distinct()
    shared = spark.sparkContext.broadcast(build_cascade(listed, universe))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    schema = pages.select(*kept).schema.add("host", "string").add("path", "string").add("rule", "string").add("verdict", "string")
    at = kept.index(url)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = shared.value
        for b in batches:
            out: list[list[str | None]] = [[], [], [], []]
            for u in b.column(at).to_pylist():
                host, path = split_url(u)
                rule = max((k for k in url_keys(host, path, lengths) if k in cascade), key=len, default=None)
                verdict = rules[rule] if rule is not None else "block" if any(f"\0{h}" in cascade for h in host_suffixes(host)) else "allow"
                for o, v in zip(out, (host, path, rule, verdict), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(o, pa.string()) for o in out)], names=schema.names)

    return pages.select(*kept).mapInArrow(run, schema)
