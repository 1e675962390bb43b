"""Collocations: phrases that occur more often than their parts let expect.

Identical pieces of text are deduplicated into multiplicities. Every word of a piece starts a
window of up to five words; each phrase's count is the weighted number of windows that begin
with it. Windows go, packed and compressed, to the hash bucket of their first two words, where
duckdb counts them out of core, level by level: a window stays only while its beginning is
frequent enough. Where the first words are all hot (at most 1,000 words are), the bucket is
that of one word more, so that no hot pair fills a bucket; the few phrases of hot words alone
that this spreads over buckets are summed afterwards. The counts of a candidate's parts come
back by a shuffled join of look-up requests; those for single words are salted.

Null text counts as empty, null lang as ``und``; repeated rows count as often as they occur.
Equal scores are ordered by count, then by the phrase's bytes. Extra columns are ignored, an
empty table gives an empty result.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import arrow_map, bucket_runs, files_for, flat, materialize, pieces, ranges, release, shared_dir
from orrery.llm.words import prefix_hashes, span_hashes, tokens

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[.,;:!?\x0A-\x0D]"
LONGEST = 5
LEAST, TOP = 100, 2000
#: A longer phrase with this percentage of a phrase's count takes its place.
CONTAINED = 100
#: A word is hot from one in so many occurrences on: so many words are hot at most.
HOT = 1000
#: Requests for a single word's count go to so many places.
SALTS = 16
#: Windows of a bucket, at least; duckdb's memory for one.
BUCKET_WINDOWS, BUCKET_MEMORY = 1_500_000, "160MB"
#: Bytes of pieces that a task expands into windows at once.
EXPAND = 1 << 20
#: Languages in a broadcast; where there are more, they are joined by shuffle.
BROADCAST_LANGS = 100_000

WORD = np.ones(256, bool)
WORD[0x20] = False
WINDOWS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("rest", pa.string()), ("hot", pa.int8()), ("times", pa.int64())])


def weighted_pieces(docs: DataFrame) -> DataFrame:
    """lang, piece, times: pieces with words joined by one space, and how often each occurs."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    piece = F.trim(F.regexp_replace("piece", r"[\x20\x09]+", " "))
    cut = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split(text, BREAKS)).alias("piece"))
    return cut.select("lang", piece.alias("piece")).where("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("times"))


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans of UTF-8 bytes as strings."""
    lengths = ends - starts
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.py_buffer(data[ranges(starts, lengths)]))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "piece", EXPAND):
            data, offs = flat(part.column(1))
            starts, ends, _, first = tokens(data, offs, WORD)
            lang = part.column(0).dictionary_encode()
            word = _strings(data, starts, ends).dictionary_encode()
            owner = np.repeat(np.arange(part.num_rows), np.diff(first))
            key, at = np.unique(np.asarray(lang.indices).astype(np.int64)[owner] * len(word.dictionary) + np.asarray(word.indices), return_inverse=True)
            times = np.zeros(len(key), np.int64)
            np.add.at(times, at, part.column(2).to_numpy()[owner])
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(key // len(word.dictionary))), word.dictionary.take(pa.array(key % len(word.dictionary))), pa.array(times)], ["lang", "phrase", "f"])


def windows(part: pa.RecordBatch, hot: np.ndarray, buckets: int) -> tuple[np.ndarray, pa.RecordBatch]:
    """(bucket of each row, rows of WINDOWS) for pieces (lang, piece, times): different windows of two words or more.

    phrase: the first two words; rest: what follows; hot: how many leading words are hot.
    """
    data, offs = flat(part.column(1))
    starts, ends, hashes, first = tokens(data, offs, WORD)
    owner = np.repeat(np.arange(part.num_rows), np.diff(first))
    i = np.arange(len(starts))
    last = np.minimum(i + LONGEST - 1, first[owner + 1] - 1)
    cold = np.where(np.isin(hashes, hot), len(starts), i)
    leading = np.minimum(np.minimum.accumulate(cold[::-1])[::-1], last + 1) - i
    i = i[last > i]
    last, leading, owner = last[i], leading[i], owner[i]

    whole = _strings(data, starts[i], ends[last]).dictionary_encode()
    lang = part.column(0).dictionary_encode()
    key = np.asarray(lang.indices).astype(np.int64)[owner] * max(1, len(whole.dictionary)) + np.asarray(whole.indices)
    _, one, at = np.unique(key, return_index=True, return_inverse=True)
    times = np.zeros(len(one), np.int64)
    np.add.at(times, at, part.column(2).to_numpy()[owner])
    i, last, leading, owner = i[one], last[one], leading[one], owner[one]
    until = i + np.clip(leading + 1, 2, last - i + 1) - 1
    bucket = (span_hashes(prefix_hashes(data), starts[i], ends[until]) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    i, last, leading, owner = i[order], last[order], leading[order], owner[order]
    third = np.minimum(i + 2, last)
    rest = _strings(data, np.where(last >= i + 2, starts[third], ends[last]), ends[last])
    rows = [lang.dictionary.take(lang.indices.take(pa.array(owner))), _strings(data, starts[i], ends[i + 1]), rest, pa.array(leading.astype(np.int8)), pa.array(times[order])]
    return bucket[order], pa.RecordBatch.from_arrays(rows, schema=WINDOWS)


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _bucket_counts(packed: Iterator[bytes], least: int, scratch: str | None) -> Iterator[pa.RecordBatch]:
    """lang, phrase, words, f of one bucket's frequent phrases of two words or more; phrases of hot words alone whatever their count."""
    folder = scratch and os.path.join(scratch, f"duckdb-{uuid.uuid4().hex}")
    db = duckdb.connect(config={"threads": 1, "preserve_insertion_order": False, "memory_limit": BUCKET_MEMORY, "temp_directory": folder} if folder else {"threads": 1, "preserve_insertion_order": False})
    try:
        rows = pa.RecordBatchReader.from_batches(WINDOWS, (b for blob in packed for b in pa.ipc.open_stream(blob)))
        db.register("rows", rows)
        db.execute("CREATE TEMP TABLE level AS SELECT * FROM rows")
        db.unregister("rows")
        for words in range(2, LONGEST + 1):
            db.execute(f"CREATE OR REPLACE TEMP TABLE found AS SELECT lang, phrase, sum(times)::BIGINT AS f FROM level GROUP BY lang, phrase HAVING sum(times) >= {least} OR max(hot) >= {words}")
            yield from db.sql(f"SELECT lang, phrase, {words}::INTEGER AS words, f FROM found").to_arrow_reader(10_000)
            if words < LONGEST:
                db.execute(
                    "CREATE OR REPLACE TEMP TABLE level AS SELECT lang, phrase || ' ' || split_part(rest, ' ', 1) AS phrase, substr(rest, length(split_part(rest, ' ', 1)) + 2) AS rest, hot, times "
                    "FROM level SEMI JOIN found USING (lang, phrase) WHERE rest <> ''"
                )
    finally:
        db.close()
        if folder:
            shutil.rmtree(folder, ignore_errors=True)


def _spill_folder(spark: SparkSession) -> str | None:
    """The shared folder as a path, if it is mounted; where it is a store without a path, buckets are counted in memory."""
    path = shared_dir(spark)
    path = path[len("file:") :] if path.startswith("file:") else path
    return "/" + path.lstrip("/") if "://" not in path else None


def phrase_counts(docs: DataFrame, *, least: int = LEAST, hot_share: int = HOT, bucket_windows: int = BUCKET_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f: all phrases of up to five words with f >= least; lang, n: occurrences of words), written tables."""
    spark = docs.sparkSession
    texts = materialize(weighted_pieces(docs), what="pieces")
    words = materialize(arrow_map(texts, _word_counts, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f")), what="words")
    langs = materialize(words.groupBy("lang").agg(F.sum("f").alias("n")), what="langs")
    total = langs.agg(F.sum("n")).first()[0] or 0
    frequent = words.groupBy("phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= max(least, 1 + total // hot_share)).select("phrase").toPandas()["phrase"]
    data = np.frombuffer("".join(frequent).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in frequent]).astype(np.int64)
    hot = span_hashes(prefix_hashes(data), np.append(0, ends[:-1]) if len(ends) else ends, ends)
    buckets = 1 + total // max(bucket_windows, int((2000 * total) ** 0.5))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "piece", EXPAND):
                bucket, rows = windows(part, hot, buckets)
                runs = bucket_runs(bucket)
                for some in (runs[k : k + 64] for k in range(0, len(runs), 64)):
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in some], pa.int32()), pa.array([_pack(rows.slice(s, e - s)) for _, s, e in some], pa.binary())], ["bucket", "packed"])

    scratch = _spill_folder(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b.column(0)[i].as_py(), b.column(1)[i].as_py()) for b in batches for i in range(b.num_rows))
        ahead = next(rows, None)
        while ahead is not None:
            bucket = ahead[0]

            def of_bucket() -> Iterator[bytes]:
                nonlocal ahead
                while ahead is not None and ahead[0] == bucket:
                    yield ahead[1]
                    ahead = next(rows, None)

            yield from _bucket_counts(of_bucket(), least, scratch)

    packed = arrow_map(texts, expand, "bucket int, packed binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    longer = arrow_map(packed, count, "lang string, phrase string, words int, f bigint").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    single = words.select("lang", "phrase", F.lit(1).alias("words"), "f")
    found = materialize(single.unionByName(longer).where(F.col("f") >= least), what="phrases")
    release(texts, words)
    return found, langs


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)) over decimals of 38 digits."""
    a, n, left, right = (c.cast("decimal(19,0)") for c in (a, n, left, right))
    return F.call_function("div", a * n * F.lit(1000).cast("decimal(4,0)"), left * right)


def collocations(docs: DataFrame, *, least: int = LEAST, top: int = TOP, contained: int = CONTAINED, **counting: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's top phrases by the score of their weakest cut."""
    found, langs = phrase_counts(docs, least=least, **counting)
    few = F.broadcast(langs) if langs.count() <= BROADCAST_LANGS else langs
    candidates = found.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    word = F.split("phrase", " ")
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    parts = F.array(
        F.struct(F.lit("l").alias("side"), F.col("k").alias("of"), F.array_join(F.slice(word, F.lit(1), F.col("k")), " ").alias("part")),
        F.struct(F.lit("r").alias("side"), (F.col("words") - F.col("k")).alias("of"), F.array_join(F.slice(word, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("part")),
    )
    asked = cut.select("lang", "phrase", "words", "a", "k", F.inline(parts)).withColumn("salt", F.when(F.col("of") == 1, F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).otherwise(0).cast("int"))
    salts = F.when(F.col("words") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    answers = found.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"), F.explode(salts).alias("salt"))
    known = materialize(asked.join(answers, ["lang", "part", "salt"]).select("lang", "phrase", "words", "a", "k", "side", "of", "part", "part_f"), what="parts")

    # a phrase inside a longer one is inside one that is a single word longer, which occurs at least as often
    covered = known.where((F.col("of") == F.col("words") - 1) & (F.col("of") > 1) & (100 * F.col("a") >= contained * F.col("part_f"))).select("lang", F.col("part").alias("phrase")).distinct()
    of = lambda side, k: F.max(F.when((F.col("side") == side) & (F.col("k") == k), F.col("part_f")))
    wide = known.groupBy("lang", "phrase", "a").agg(*[of(side, k).alias(f"{side}{k}") for side in "lr" for k in range(1, LONGEST)])
    cuts = [F.when(F.col(f"l{k}").isNotNull(), F.struct(_score(F.col("a"), F.col("n"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, LONGEST)]
    scored = wide.join(covered, ["lang", "phrase"], "left_anti").join(few, "lang").withColumn("weakest", F.array_min(F.array(*cuts)))
    by_score = (F.desc("score"), F.desc("a"), F.col("phrase"))
    rows = scored.select("lang", "phrase", "a", "n", "weakest.l", "weakest.r", "weakest.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    # a language's first ones are among the first of its salts, so no task ranks all of a language
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*by_score))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by_score))).where(F.col("rank") <= top)
    result = materialize(rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), what="collocations", files=files_for(top))
    release(found, langs, known)
    return result
