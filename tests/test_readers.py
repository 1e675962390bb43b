"""Paged readers over fetchers that are not there: pages, retries, budget, isolation, lookups."""

import json
import sys
import time

import pytest

from orrery.sources import readers


def answers(script):
    """A fetcher that gives what the script says, one after another, and remembers what it was asked."""
    asked = []

    def fetch(params):
        asked.append(params)
        got = script[min(len(asked), len(script)) - 1]
        if isinstance(got, Exception):
            raise got
        return got

    return fetch, asked


def client(script, **config):
    fetch, asked = answers(script)
    slept = []
    clock = [0.0]

    def sleep(s):
        slept.append(s)
        clock[0] += s

    return readers.Client(fetch, readers.ReadConfig(**config), sleep=sleep, now=lambda: clock[0]), asked, slept


OK = (200, {"X-RateLimit-Remaining-USD": "0.05", "X-RateLimit-Limit-USD": "0.1", "X-RateLimit-Cost-USD": "0.0001"}, '{"results": [1, 2]}')


def test_retries_and_waits():
    c, asked, slept = client([(503, {}, "busy"), OSError("reset"), OK])
    assert c.get({"a": 1}) == {"results": [1, 2]} and len(asked) == 3
    assert slept == [1.0, 2.0] and c.stats == {"requests": 1, "retried": 2, "gave_up": 0, "gateway": 0}
    c, asked, slept = client([OK])
    c.get({})
    c.get({})
    assert slept == [0.2]  # paced
    c, asked, _ = client([(400, {}, "bad filter")])
    with pytest.raises(readers.ReadError, match="bad filter"):
        c.get({})
    assert len(asked) == 1
    c, asked, _ = client([(500, {}, "x")])
    with pytest.raises(readers.ReadError, match="gave up after 3"):
        c.get({})


def test_gateway_patience():
    c, asked, slept = client([(504, {}, "")] * 6 + [OK], patience=30.0)
    assert c.get({})["results"] == [1, 2] and c.stats["gateway"] == 6
    c, asked, _ = client([(504, {}, "")], patience=10.0)
    with pytest.raises(readers.ReadError):
        c.get({})
    assert len(asked) == 4


def test_budget():
    spent = (429, {"x-ratelimit-remaining-usd": "0.0005", "retry-after": "3600"}, "")
    c, asked, _ = client([spent])
    with pytest.raises(readers.ReadError) as e:
        c.get({})
    assert e.value.exhausted and len(asked) == 1
    m = readers.meter(OK[1])
    assert readers.searches_left(m) == 50 and not readers.exhausted(m) and not readers.low_budget(m)
    assert readers.low_budget({**m, "remaining": 0.02}) and readers.meter({}) is None and readers.searches_left(None) is None


def by_query(params):
    if params["q"] == "broken":
        return 400, {}, "no"
    n = {"many": 3, "few": 1, "none": 0}[params["q"]]
    page = params["page"]
    return 200, {}, json.dumps({"results": [{"id": f"{params['q']}-{page}-{i}"} for i in range(params["per-page"])] if page <= n else []})


@pytest.mark.parametrize("lanes", [1, 2, 8])
def test_pages_of_queries(spark, lanes):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    got = readers.read_pages(spark, by_query, [{"q": "many"}, {"q": "few"}, {"q": "none"}], per_page=2, max_pages=5, lanes=lanes, config=readers.ReadConfig(interval=0.0), name=f"pages_{lanes}")
    rows = sorted((r.query, r.page, r.pos, json.loads(r.payload)["id"]) for r in got.collect())
    assert rows == [(0, p, i, f"many-{p}-{i}") for p in (1, 2, 3) for i in (0, 1)] + [(1, 1, i, f"few-1-{i}") for i in (0, 1)]
    assert got.rdd.getNumPartitions() == min(lanes, 3)


def test_failures_stay_apart(spark):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    quick = readers.ReadConfig(interval=0.0, backoff=0.0)
    got = readers.read_pages(spark, by_query, [{"q": "broken"}, {"q": "few"}], per_page=1, max_pages=2, isolate=True, config=quick, name="apart").collect()
    assert sorted((r.query, r.error is None) for r in got) == [(0, False), (1, True)]
    with pytest.raises(Exception, match="refused with status 400"):
        readers.read_pages(spark, by_query, [{"q": "broken"}], config=quick, name="fails").collect()
    both = readers.read_with_fallback(spark, by_query, {"q": "none"}, {"q": "few"}, per_page=2, max_pages=2, config=quick, name="spare")
    assert both.count() == 2


def test_one_request_a_key(spark):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    keys = spark.createDataFrame([("a",), ("a",), ("gone",), ("bad",), (None,)], "key string")
    got = readers.fetch_each(keys, by_key, config=readers.ReadConfig(interval=0.0, backoff=0.0))
    assert sorted((r.key, r.payload, r.error is None) for r in got.collect() if r.key != "bad") == [("a", '{"name": "a"}', True), ("gone", None, True)]
    assert "status 403" in next(r.error for r in got.collect() if r.key == "bad")


def by_key(params):
    k = params["key"]
    return (200, {}, json.dumps({"name": k})) if k == "a" else (404, {}, "") if k == "gone" else (403, {}, "no")


def test_lookups_and_names(spark):
    from pyspark.sql import functions as F

    ids = spark.createDataFrame([(f"https://openalex.org/W{i}",) for i in range(700)] + [("W1",), (None,)], "id string")
    got = readers.id_lookups(ids, size=5).collect()
    every = [x for r in got for x in r.ids.split("|")]
    assert sorted(every) == sorted(f"W{i}" for i in range(700)) and max(len(r.ids.split("|")) for r in got) <= 5 and len({r.lookup for r in got}) == len(got)
    works = spark.createDataFrame([("W1", "one", 5)], "id string, title string, cited_by_count int")
    assert {(r.id, r.title) for r in readers.labelled(spark.createDataFrame([("https://x.org/W1",), ("W2",)], "id string"), works).collect()} == {("https://x.org/W1", "one"), ("W2", None)}
    files = [("application/pdf", [("http://a.org/1",), ("https://web.archive.org/2",)]), ("text/html", [("x",)]), ("application/x-pdf", [("https://archive.org/3",), (None,)])]
    row = spark.createDataFrame([(files,)], "f array<struct<mimetype:string,urls:array<struct<url:string>>>>")
    assert row.select(readers.archived_pdfs(F.col("f")).alias("u")).first().u == ["https://web.archive.org/2", "https://archive.org/3", "http://a.org/1"]
    keys = spark.createDataFrame([("https://openalex.org/W12",), ("a b/é",), ("",)], "id string").select(readers.cache_key(F.col("id")).alias("k"), readers.repository_text(F.repeat(F.lit("x "), 200)).alias("t"))
    assert [r.k for r in keys.collect()] == ["W12", "_", "work"] and keys.first().t is None


def noted(path, by=None):
    """A fetcher that writes down when it was asked for what, whichever process asks."""

    def fetch(params):
        with open(path, "a") as f:
            f.write(json.dumps([time.time(), params]) + "\n")
        return (by or by_query)(params)

    return fetch


def notes(path):
    return sorted(json.loads(line) for line in open(path))


def by_value():
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_eight_lanes_keep_to_one_rate_and_one_budget(spark, tmp_path):
    """16 queries of three pages in 8 partitions: requests come one interval apart over all of them, and no more than paid for."""
    by_value()
    log = str(tmp_path / "log")
    got = readers.read_pages(spark, noted(log), [{"q": "many"}] * 16, per_page=1, max_pages=9, lanes=8, requests=37, isolate=True, config=readers.ReadConfig(interval=0.05), name="lanes_8")
    assert got.rdd.getNumPartitions() == 8
    open(log, "w").close()
    rows = got.collect()
    times = [t for t, _ in notes(log)]
    assert len(times) == 37 == sum(r.error is None for r in rows)
    gaps = [b - a for a, b in zip(times, times[1:])]
    assert sum(g < 0.03 for g in gaps) <= 2  # the machine may wake a lane late
    depth = {q: max(r.page for r in rows if r["query"] == q and r.error is None) for q in range(16)}
    assert set(depth.values()) <= {2, 3} and sorted(r["query"] for r in rows if r.error) == list(range(16))


def test_failed_attempts_are_paid_for(spark, tmp_path):
    by_value()
    log = str(tmp_path / "log")
    got = readers.read_pages(spark, noted(log, lambda p: (503, {}, "busy")), [{"q": i} for i in range(4)], lanes=2, requests=5, isolate=True, config=readers.ReadConfig(interval=0.0, backoff=0.0), name="paid").collect()
    assert len(notes(log)) == 5 and all(r.error for r in got) and {r["query"] for r in got} == {0, 1, 2, 3}
    with pytest.raises(Exception, match="the budget is spent"):
        readers.read_pages(spark, by_query, [{"q": "many"}], requests=1, per_page=1, config=readers.ReadConfig(interval=0.0), name="unpaid").collect()


def test_slots_never_meet():
    assert [x.requests for x in readers.deal(3, 10)] == [4, 3, 3] and readers.deal(2, None)[1].requests is None
    lanes = readers.deal(3, None, start=100.0)
    clock = [100.0]
    clients = [readers.Client(lambda p: OK, readers.ReadConfig(interval=0.5), lane=x, sleep=lambda s: clock.__setitem__(0, clock[0] + s), now=lambda: clock[0]) for x in lanes]
    begun = []
    for i in range(9):
        clients[i % 3].get({})
        begun.append(round(clock[0], 6))
    assert begun == [100.0 + 0.5 * i for i in range(9)]
    clock[0] = 1000.1
    clients[1].get({})
    assert clock[0] == pytest.approx(1000.5) and readers.Lane(1, 3, 100.0).begins(600, 0.5) == pytest.approx(1000.5)


@pytest.mark.parametrize("body", ["{broken", "[1]", "null", '{"results": 5}', "[" * 100_000])
def test_a_broken_body_costs_its_own_query(spark, body):
    by_value()
    fetch = lambda p: (200, {}, body) if p["q"] == "bad" else by_query(p)
    got = readers.read_pages(spark, fetch, [{"q": "bad"}, {"q": "few"}], per_page=1, max_pages=2, isolate=True, config=readers.ReadConfig(interval=0.0), name="bodies").collect()
    assert sorted((r["query"], r.error is None) for r in got) == [(0, False), (1, True)]


def record(params):
    """Works by year and type; reads the request's filter for years only."""
    years = range(2000, 2010)
    for part in params.get("filter", "").split(","):
        if part.startswith("publication_year:>"):
            years = [y for y in years if y > int(part.split(">")[1])]
    return 200, {}, json.dumps({"results": [{"id": f"W{y}", "publication_year": y, "type": "article" if y % 2 else "review", "primary_topic": {"field": {"id": "https://x.org/fields/17"}}} for y in years] if params["page"] == 1 else []})


def test_filters_become_request_parameters(spark, tmp_path, capsys):
    """Filters on query and page leave the plan, those on record columns are in the requests too; what can't be pushed stays behind the scan."""
    from pyspark.sql import functions as F

    by_value()
    log = str(tmp_path / "log")
    all_ = readers.read_pages(spark, noted(log, record), [{"filter": "type:x", "q": 0}, {"q": 1}, {"q": 2}], columns=readers.RECORD_COLUMNS, config=readers.ReadConfig(interval=0.0), name="pushed")
    got = all_.where((F.col("query") < 9) & F.col("query").isin(0, 2) & (F.col("page") <= 1) & (F.col("publication_year") >= 2004) & (F.col("type") != "review") & (F.length("payload") > 3) & (F.col("field_id") == "17"))
    rows = got.collect()
    assert sorted((r["query"], r.publication_year) for r in rows) == [(q, y) for q in (0, 2) for y in (2005, 2007, 2009)] and {r.field_id for r in rows} == {"17"}
    asked = [p for _, p in notes(log)]
    assert {(p["q"], p["page"]) for p in asked} == {(0, 1), (2, 1)}
    for p in asked:
        parts = p["filter"].split(",")
        assert set(parts) == ({"type:x"} if p["q"] == 0 else set()) | {"publication_year:>2003", "type:!review", "primary_topic.field.id:17"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "length(payload" in plan and "publication_year" in plan and "query#" in plan and "IN (0,2)" not in plan.split("BatchScan")[0]


def test_request_filters():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan, LessThanOrEqual, Not, StringContains

    f = readers.request_filter
    assert f(EqualTo(("type",), "article")) == "type:article" and f(Not(EqualTo(("type",), "a"))) == "type:!a" and f(EqualTo(("is_retracted",), False)) == "is_retracted:false"
    assert f(In(("topic_id",), ("T1", "T2"))) == "primary_topic.id:T1|T2" and f(LessThanOrEqual(("cited_by_count",), 5)) == "cited_by_count:<6" and f(LessThan(("publication_year",), 5)) == "publication_year:<5" and f(GreaterThan(("cited_by_count",), 5)) == "cited_by_count:>5"
    assert f(EqualTo(("type",), "a|b")) is None and f(StringContains(("type",), "a")) is None and f(EqualTo(("payload",), "x")) is None and f(Not(In(("type",), ("a",)))) is None and f(In(("type",), ("a", "b,c"))) is None


def test_themes_are_scanned_by_their_ladders(spark, tmp_path):
    from orrery.operators import percolate

    by_value()
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", ["deep", "nets"], None, "goal", ["17"]), ("b", [], "field", None, None)], "theme string, keywords_include array<string>, scope_field string, goal string, ids array<string>")
    got = readers.theme_scan(spark, noted(log, record), percolate.ladders(rows, field_ids="ids"), config=readers.ReadConfig(interval=0.0), per_page=5, name="ladders")
    kept = got.where("publication_year > 2007").collect()
    assert {(r.theme, r.rung) for r in kept} == {("a", 0), ("a", 1), ("a", 2), ("b", 0)} and {r.publication_year for r in kept} == {2008, 2009}
    first = next(p for _, p in notes(log) if "deep nets" in p["filter"])
    assert first["filter"] == "title_and_abstract.search:deep nets,primary_topic.field.id:17,publication_year:>2007" and first["per-page"] == 5
    with pytest.raises(ValueError):
        readers.theme_scan(spark, record, percolate.ladders(rows), most=2, name="many")


def test_keys_share_rate_and_requests(spark, tmp_path):
    by_value()
    log = str(tmp_path / "log")
    keys = spark.createDataFrame([(f"k{i}",) for i in range(30)], "key string")
    got = readers.fetch_each(keys, noted(log, lambda p: (200, {}, "{}")), config=readers.ReadConfig(interval=0.02), lanes=4, requests=12).collect()
    times = [t for t, _ in notes(log)]
    assert len(times) <= 12 and len(got) == 30 and sum(r.error is None for r in got) == len(times) and all(r.error == "the budget is spent" for r in got if r.error)
