"""Url filters, top-k search and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from orrery.llm import quality, topk, url_filter
from orrery.llm.queries import BLOCKED_HOSTS, URL_RULES


def brute_rule(host, path):
    fit = [r for r in URL_RULES if (host == (h := r[: r.index("/")]) or host.endswith("." + h)) and path.startswith(r[r.index("/") :])]
    return max(fit, key=len, default=None)


def test_url_filter(spark):
    urls = [
        "http://www.example.com/en/1", "https://m.example.com/en/x?y#z", "http://EXAMPLE.com/EN/", "http://com/", "ftp://a.net/es/q", "x.net/es/", None, "", "http://", "http://a.com?x=/en/", "http://a.com:80/", "http://spam-farm.example.org/a",
        "http://b.spam-farm.example.org", "//a.com/", "http://example.com/en", "http://www.example.com/en/1", "http://a.net/fr/#" + "x" * 9000, "http://..com//", "http://com", "http://a.com/\nx?y",
    ]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, html string, path string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, URL_RULES, blocked_hosts=BLOCKED_HOSTS).collect()}
    for i, u in enumerate(urls):
        host, path = url_filter.split_url(u)
        rule = brute_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (URL_RULES[rule] if rule else "block" if host.endswith("spam-farm.example.org") else "allow")
    assert (got[1].host, got[1].path, got[1].rule) == ("m.example.com", "/en/x", "example.com/en/")
    assert (got[9].host, got[9].path, got[9].rule) == ("a.com", "", None)
    assert url_filter.judge_urls(pages.where("false"), URL_RULES).count() == 0


def test_blocked_hosts_may_be_a_table(spark):
    hosts = spark.createDataFrame([(f"Bad{i}.Example.org",) for i in range(300)] + [(None,)], "host string")
    pages = spark.createDataFrame([(i, f"http://x.bad{i}.example.org/p", "kept") for i in range(0, 600, 3)], "page_id long, url string, note string")
    got = url_filter.judge_urls(pages, {"com/": "allow"}, blocked_hosts=hosts).collect()
    assert all(r.verdict == ("block" if r.page_id < 300 else "allow") and r.note == "kept" for r in got) and len(got) == 200


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"k{i}" for i in range(3000)]
    listed = keys[::7]
    frame = lambda ks: spark.createDataFrame([(k,) for k in ks], "key string")
    c = url_filter.build_cascade(frame(listed), frame(keys))
    assert [k for k in keys if k in c] == listed
    assert len(c.levels) > 1


@pytest.mark.parametrize("chunk", [1 << 20, 300])
def test_top_k(spark, chunk):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist(), 1) for i in range(300)]
    rows += [(400, None, 1), (500, [1.0] * 15 + [None], 1), (600, [float("nan")] * 16, 1), (700, [1.0] * 5, 1), (None, [1.0] * 16, 1), (701, rows[3][1], 1), (702, rows[3][1], 1), (100, rows[100][1], 1), (800, [1.0] * 5, 1)]
    # an unusable vector of a query does not displace its usable one; a smaller one of two usable ones stands
    rows += [(200, [None] + [9.0] * 15, 1), (0, [float("-inf")] * 16, 1), (900, [2.0] * 16, 1), (900, [-2.0] * 16, 1)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(3)
    got = topk.exact_top_k(e, e.where("vec_id % 100 = 0"), k=5, chunk_bytes=chunk, block=64)
    good = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    least = {}
    for i, v in good:
        least[i] = min((tuple(v), v), least.get(i, (tuple(v), v)), key=lambda x: (len(x[0]), x[0]))
    for q, (_, v) in {i: v for i, v in least.items() if i % 100 == 0}.items():
        best = sorted(((-int(v @ w), i) for i, w in good if i != q and len(w) == len(v)))[:5]
        for n, (s, i) in enumerate(best):
            want[q, n + 1] = (i, -s)
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got.collect()} == want
    assert topk.exact_top_k(e.where("false"), e.where("false")).count() == 0


def test_impact_index_stops_on_proof_only():
    rng = np.random.default_rng(2)
    vectors = rng.integers(-2000, 2000, (500, 8))
    vectors[7] = 3000
    index = topk.ImpactIndex(np.arange(500), vectors)
    q = np.vstack([np.full(8, 1000), rng.integers(-2000, 2000, (5, 8))])
    rows, cols, scores = index.search(np.full(6, -1), q, 3)
    exact = q @ vectors.T
    for i in range(6):
        best = set(np.argsort(-exact[i], kind="stable")[:3].tolist())
        assert best <= set(cols[rows == i].tolist())
    assert (scores == exact[rows, cols]).all()


def test_top_k_of_huge_components(spark):
    """Beyond exact doubles scores are wide integers; a reported score beyond 64 bits fails."""
    big = [(0, [3e4, -2e4]), (1, [2.5e4, 1.0]), (2, [1e5, 7e4]), (3, [-1e5, 3.0]), (4, [0.5, 0.25]), (100, [1.0, 1.0]), (5, [12345678.0, 1e7])]
    e = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.exact_top_k(e, e.where("vec_id % 100 = 0"), k=3).collect()}
    ints = {i: [int(np.floor(1024 * x)) for x in v] for i, v in big}
    want = {}
    for q in (0, 100):
        best = sorted((-sum(a * b for a, b in zip(ints[q], w, strict=True)), i) for i, w in ints.items() if i != q)[:3]
        want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(best)}
    assert got == want
    far = spark.createDataFrame([(0, [1e300]), (1, [1e300])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large|too big|overflow|Overflow"):
        topk.exact_top_k(far, far.where("vec_id = 0")).collect()


def test_index_skips_postings():
    """On skewed and on dense vectors fewer postings are processed than all queries have."""
    rng = np.random.default_rng(1)
    for vectors, most in ((np.floor(rng.pareto(1.2, (4000, 32)) * 20 * rng.choice([-1, 1], (4000, 32))).clip(-(10**5), 10**5).astype(np.int64), 0.9), (np.floor(rng.normal(size=(4000, 64)) * 1024 / 8).astype(np.int64), 0.95)):
        index = topk.ImpactIndex(np.arange(4000), vectors)
        rows, cols, scores = index.search(np.arange(50), vectors[:50], 10)
        exact = vectors[:50] @ vectors.T
        exact[np.arange(50), np.arange(50)] = exact.min() - 1
        for i in range(50):
            best = np.sort(exact[i])[-10:]
            assert np.array_equal(np.sort(scores[rows == i])[-10:], best)
        assert index.processed < most * 50 * index.postings


def test_pipeline_stages(spark, docs, rows, tmp_path):
    import corpus_pipeline as p

    d = docs.withColumn("text", F.when(F.col("doc_id") == 5, "password = hunter2222 and some more words here").otherwise(F.col("text")))
    d.drop("score").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(rows[3][1].split()[:40]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for i, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, now, str(tmp_path))
        assert i == len(p.STAGES) - 1 or out.columns == list(p.COLUMNS)
        out.write.parquet(str(tmp_path / f"s{i}"))
        now = spark.read.parquet(str(tmp_path / f"s{i}"))
        left[name] = now.collect()
    ids = lambda n: [r.doc_id for r in left[n]]
    assert not {20, 21, 22, 29} & set(ids("language_id"))
    assert 24 not in ids("near_duplicates") and 25 not in ids("near_duplicates") and ids("near_duplicates").count(23) == 1 and 27 not in ids("near_duplicates")
    assert 3 in ids("near_duplicates") and 3 not in ids("decontamination")
    assert [r.text for r in left["secret_scan"] if r.doc_id == 5] == ["[secret] and some more words here"]
    assert sorted(ids("bpe"), key=str) == sorted(ids("decontamination"), key=str)
    assert p.run(spark, str(tmp_path)).count() == len(left["bpe"])


def test_pipeline_of_nothing_and_of_repeated_rows(spark, tmp_path):
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "a plain text of some words that stands here for itself and for nobody else"
    for name, rows in (("none", []), ("twice", [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, text, "en", "s", 5), (None, None, None, None, None), (3, "other words altogether in this one", "en", None, 1)])):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    assert p.run(spark, str(tmp_path / "none")).count() == 0
    assert sorted(r.doc_id for r in p.run(spark, str(tmp_path / "twice")).collect()) == [1, 3]


def test_quality_of_repeated_rows_and_without_id(spark):
    rows = [(i % 40, ("good words here " if i % 2 else "BAD!! ") * (i % 5 + 1)) for i in range(40)] * 2 + [(None, "no id here"), (None, None)]
    docs = spark.createDataFrame([(*r, 0.5, 7) for r in rows], "doc_id long, text string, score double, predicted int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (None, 1)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels, pairs=2000).collect()
    assert len(got) == len(rows) and len({(r.doc_id, r.score) for r in got if r.doc_id is not None}) == 40
    assert sum(r.doc_id is None for r in got) == 2 and all(0 <= r.score <= 1 for r in got)


def test_queries_have_their_contract():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
