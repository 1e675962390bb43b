"""Divergence of sources, collocations and exact duplicates against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from conftest import DOC, words

from orrery.llm import collocations, divergence, exact_dedup
from orrery.llm.queries import ORACLE_SQL


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


@pytest.fixture(scope="module")
def corpus(spark, rows):
    """The common rows, and skewed ones: a source with a third of all, groups without terms, null languages, a hot pair of words."""
    rng = random.Random(8)
    names = ["Ab", "ab", "c", "dé", "éa", "日本", "x-y", "to", "be"]
    more = []
    for i in range(400):
        text = " ".join(rng.choice(names[: rng.choice([3, 9])]) + rng.choice(["", "", ",", "\t", ".\n"]) for _ in range(rng.randint(0, 30)))
        more.append((1000 + i, rng.choice([text, "to be or not to be to be", text]), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "s1", "s2", "S", "", None]), 1, 0.5, "k", "x"))
    more.append((2000, "12 34", "en", "no terms", 1, 0.5, "k", "x"))
    more.append((2001, None, "empty", "only", 1, 0.5, "k", "x"))
    more.append((2001, "", "empty", "other", 1, 0.5, "k", "x"))
    return rows + more


@pytest.fixture(scope="module")
def frame(spark, corpus):
    return spark.createDataFrame(corpus, DOC).repartition(5).persist()


def plain_divergence(rows, min_docs, top):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    counts, langs, docs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        found = term.findall(lower(text))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    kept = {lang: {t for t, n in c.items() if n >= min_docs} for lang, c in docs.items()}
    for (lang, _), c in counts.items():
        langs[lang].update(c)
    total = lambda c, lang: sum(n for t, n in c.items() if t in kept[lang]) + len(kept[lang])
    share = lambda c, lang, t: 1 + 10**9 * (c[t] + 1) // total(c, lang)
    out = set()
    shares = {g: {t: share(c, g[0], t) for t in kept[g[0]]} for g, c in counts.items()}
    whole = {lang: {t: share(c, lang, t) for t in kept[lang]} for lang, c in langs.items()}
    f = lambda p, q: (p - q) ** 2 // q
    for g in counts:
        pairs = [(sum(f(shares[g][t], shares[h][t]) for t in kept[g[0]]), h[1]) for h in counts if h[0] == g[0] and h != g]
        terms = [(f(shares[g][t], whole[g[0]][t]), t) for t in kept[g[0]] if counts[g][t] and shares[g][t] > whole[g[0]][t]]
        for part, found in (("pair", pairs), ("term", terms)):
            for i, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                if part == "pair" or i <= top:
                    out.add((*g, part, item, value, i))
    return out


@pytest.mark.parametrize("sizes", [{}, {"chunk": 2, "block": 1}, {"chunk": 3, "block": 2, "stretch": 2}])
def test_divergence_equals_plain_python(frame, corpus, sizes):
    got = [tuple(r) for r in divergence.divergence(frame, top_terms=5, **sizes).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_divergence(corpus, 3, 5)


def test_divergence_of_large_counts_is_exact():
    import numpy as np

    rng = random.Random(1)
    for _ in range(2000):
        total = rng.randint(1, 10 ** rng.randint(1, 15))
        count = rng.randint(0, total - 1)
        assert int(divergence.shares(np.array([count]), np.array([total]))[0]) == 1 + 10**9 * (count + 1) // total


def test_share_as_a_column(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, t - 1), t) for t in (rng.randint(1, 10 ** rng.randint(1, 15)) for _ in range(500))]
    got = spark.createDataFrame(rows, "c long, t long").select("c", "t", divergence.share(divergence.F.col("c"), divergence.F.col("t")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.c + 1) // r.t for r in got)


def test_divergence_of_nothing(spark, no_docs):
    assert divergence.divergence(no_docs).collect() == []
    one = spark.createDataFrame([(1, None, None, None)], "doc_id long, text string, lang string, source string")
    assert divergence.divergence(one).collect() == []


def plain_collocations(rows, least, top, contained=100):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + m]) for m in range(1, 6) for i in range(len(w) - m + 1))
    out = set()
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + m] for p, b in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * b >= contained * counts[p[i : i + m]]}
        ranked = []
        for p in found.keys() - gone:
            score, _, left, right = min((1000 * found[p] * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -found[p], " ".join(p).encode(), left, right))
        for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.add((lang, i, p.decode(), -a, left, right, n[lang], -s))
    return out


@pytest.mark.parametrize("least,top,contained,counting", [(3, 2000, 100, {}), (2, 40, 100, {"hot_share": 4}), (5, 2000, 60, {"hot_share": 20, "bucket_windows": 50}), (1, 2000, 100, {"hot_share": 10**9, "bucket_windows": 300})])
def test_collocations_equal_plain_python(frame, corpus, least, top, contained, counting, monkeypatch):
    if counting:
        monkeypatch.setattr(collocations, "EXPAND", 200)  # many cuts; some pieces are larger
    got = [tuple(r) for r in collocations.collocations(frame, least=least, top=top, contained=contained, **counting).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_collocations(corpus, least, top, contained)


def test_collocations_of_nothing(spark, no_docs):
    assert collocations.collocations(no_docs).collect() == []
    blank = spark.createDataFrame([(None, None), (" \t.,", None)], "text string, lang string")
    assert collocations.collocations(blank, least=1).collect() == []


def test_scores_beyond_64_bits(spark):
    a, n, left, right = 3 * 10**9, 9 * 10**12, 4 * 10**9, 5 * 10**9
    got = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long").select(collocations._score(*(collocations.F.col(c) for c in "anlr"))).first()[0]
    assert got == 1000 * a * n // (left * right)


def test_buckets_spill_and_leave_nothing(tmp_path):
    """One bucket far beyond duckdb's memory: the counts are right, and its folder is gone."""
    import pyarrow as pa

    n = 400_000
    phrases = [f"word{i % 7} word{i}" for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * n), pa.array(phrases), pa.array(["and so on"] * n), pa.array([0] * n, pa.int8()), pa.array([2] * n)], schema=collocations.WINDOWS)
    blobs = [collocations._pack(batch)] * 2
    got = pa.Table.from_batches(collocations._bucket_counts(iter(blobs), 4, str(tmp_path)))
    assert Counter(got["words"].to_pylist()) == {m: n for m in range(2, 6)} and set(got["f"].to_pylist()) == {4}
    assert list(tmp_path.iterdir()) == []


def want_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    return Counter((d, max((x for x in ids if x is not None), default=None), len(ids), sha(t)) for t, ids in groups.items() for d in ids), groups


@pytest.mark.parametrize("settings", [{}, {"hot": 0.001, "shortest": 4, "longest": 64}, {"hot": 0.5}])
def test_exact_duplicates_equal_plain_python(frame, corpus, settings, monkeypatch):
    if settings.get("hot") == 0.5:
        monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", 0)
    got = exact_dedup.exact_duplicates(frame, **settings).collect()
    want, groups = want_groups(corpus)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_identifiers_are_verified(spark, frame, corpus):
    """An identifier that different chunks share is never used; without one that holds, nothing is returned."""
    from pyspark.sql import functions as F

    weak = lambda c: F.pmod(F.xxhash64(c), F.lit(7))
    got = exact_dedup.exact_duplicates(frame, identifiers=(weak, *exact_dedup.IDENTIFIERS[1:])).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want_groups(corpus)[0]
    assert exact_dedup.exact_duplicates(frame, identifiers=(weak, exact_dedup.IDENTIFIERS[2])).where("kept").count() == len(want_groups(corpus)[1])
    with pytest.raises(ValueError):
        exact_dedup.exact_duplicates(frame, identifiers=(weak,))


def test_chunks_are_content_defined(spark):
    """Chunks are the whole text, none too long, and two texts with a common middle share chunks of it."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("aeinrstdlh") for _ in range(rng.randint(2, 8))) for _ in range(300)] + ["and", "the", "con"]
    middle = words(rng, 4000, vocabulary)
    texts = ["one start " + middle, "another, longer start of it " + middle + " end", "x" * 20_000, "", "日😀" * 9000, "\n\r  \x00"]
    from pyspark.sql import functions as F

    got = [r.c for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(exact_dedup.chunks(F.col("t")).alias("c")).collect()]
    assert ["".join(c) for c in got] == texts and all(0 < len(x) <= exact_dedup.LONGEST for c in got for x in c)
    assert len(set(got[0]) & set(got[1])) > 0.8 * len(got[0])


def test_exact_duplicates_normalise_and_stay_native(spark, frame):
    from pyspark.sql import functions as F

    got = exact_dedup.exact_duplicates(frame, normalise=lambda t: F.lower(F.trim(t)))
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()
    assert exact_dedup.exact_duplicates(frame.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_collocations", "op13_exact_dedup"])
def test_sql_gives_the_same(spark, frame, corpus, name):
    import pyarrow as pa

    from orrery.llm import queries

    db = duckdb.connect()
    unique = [r for r in {r[0]: r for r in corpus if r[0] is not None}.values()]
    db.register("documents", pa.table({c: [r[i] for r in unique] for i, c in enumerate(["doc_id", "text", "lang", "source"])}))
    want = db.sql(ORACLE_SQL[name])
    of = spark.createDataFrame(unique, DOC)
    got = {"op11_source_divergence": divergence.divergence, "op12_collocations": collocations.collocations, "op13_exact_dedup": exact_dedup.exact_duplicates}[name](of).select(*want.columns)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall()) and name in queries.QUERIES
