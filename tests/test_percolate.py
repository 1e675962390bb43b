"""Tables of queries against one query at a time."""

import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import gates, percolate, themes

QUERY = "query int, rung int, route string, anchor string, field_ids array<string>, exclude_field_ids array<string>, concept_ids array<string>, exclude_concept_ids array<string>, exclude_topic_ids array<string>, cites array<string>, year_from int, year_to int, work_type string, max_refs int"
WORK = "id int, title string, abstract string, field_id string, topic_id string, concept_ids array<string>, refs array<string>, year int, type string, is_retracted boolean, pos int"


@pytest.fixture(scope="module")
def works(spark):
    rng = random.Random(2)
    words = ["Deep", "nets", "state-of-the-art", "graphs", "Zürich", "c3po", "of", "the", "art", "state", "日本"]
    some = lambda n, k: [rng.choice(n) for _ in range(rng.randint(0, k))]
    rows = [(i, " ".join(some(words, 4)), rng.choice([None, " ".join(some(words, 12))]), rng.choice([None, "17", "13", "2"]), rng.choice([None, "T1", "T2"]), rng.choice([None, some(["c1", "c2", "c3"], 3)]), rng.choice([None, some(["W1", "W2", "W3", "W4"], 4)]), rng.choice([None, 1999, 2005, 2010]), rng.choice([None, "article", "review"]), rng.random() < 0.1, i) for i in range(300)]
    return spark.createDataFrame(rows, WORK).repartition(3).persist()


def asked():
    rng = random.Random(4)
    some = lambda n: rng.choice([None, [], rng.sample(n, rng.randint(1, len(n)))])
    out = []
    for i in range(60):
        anchor = " ".join(rng.choice(["deep", "Nets", "state-of-the-art", "graphs", "the", "art", "Zürich", "日本", "x!"]) for _ in range(rng.randint(0, 3)))
        row = (anchor, some(["17", "13"]), some(["2", "13"]), some(["c1", "c2"]), some(["c3"]), some(["T1"]), some(["W1", "W2"]), rng.choice([None, 2000]), rng.choice([None, 2006]), rng.choice([None, "article"]), rng.choice([None, 3]))
        few = tuple(v if rng.random() < 0.4 else None for v in row[1:])
        out.append((i, i % 3, rng.choice(["filter", "filter", "search", "semantic"]), row[0], *few))
    return out


def as_query(row):
    _, _, route, anchor, fields, not_fields, concepts, not_concepts, not_topics, cites, since, until, kind, refs = row
    t = lambda v: tuple(v or ())
    return gates.StructuredQuery(anchor_terms=(anchor,) if anchor else (), field_ids=t(fields), exclude_field_ids=t(not_fields), concept_ids=t(concepts), exclude_concept_ids=t(not_concepts), exclude_topic_ids=t(not_topics), cites=t(cites), year_from=since, year_to=until, work_type=kind, max_refs=refs, route=route)


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_percolate_equals_each_query(spark, works, broadcast):
    rows = asked()
    got = {}
    for r in percolate.percolate(spark.createDataFrame(rows, QUERY), works, broadcast=broadcast).collect():
        got.setdefault(r["query"], []).append(r.id)
    for row in rows:
        assert sorted(got.get(row[0], [])) == sorted(r.id for r in as_query(row).apply(works).select("id").collect()), row


def test_twins_take_over_where_a_query_finds_nothing(spark, works):
    rows = [(1, 0, None, "deep", None, None, None, None, None, None, 2090, None, None, None), (2, 0, None, "deep", None, None, None, None, None, None, 2000, None, None, None)]
    got = percolate.with_twins(spark.createDataFrame(rows, QUERY), works)
    want = {1: gates.StructuredQuery(anchor_terms=("deep",), route="search"), 2: gates.StructuredQuery(anchor_terms=("deep",), year_from=2000)}
    for q, s in want.items():
        assert sorted(r.id for r in got.where(F.col("query") == q).collect()) == sorted(r.id for r in s.apply(works).collect())


def test_one_job_for_any_number_of_themes(spark, works):
    """The plan reads works twice (to meet and to test) and does not grow with the themes."""
    plans = []
    for n in (2, 200):
        q = spark.range(n).select(F.col("id").cast("int").alias("query"), F.lit(0).alias("rung"), F.lit("deep graphs").alias("anchor"))
        plans.append(percolate.percolate(q, works)._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation"))
    assert plans[0] == plans[1] == 2


@pytest.mark.parametrize("expand", [False, True])
def test_near_fields_equals_near_field_of_each_theme(spark, works, expand):
    rows = [("a", ["deep", "nets", "graphs"], "art", "the"), ("b", ["c3po", "zürich"], None, "state-of-the-art"), ("c", [], "graphs", "deep"), ("d", ["nowhere", "of"], "", None), ("e", ["absent"], None, None)]
    schema = "theme string, keywords_include array<string>, scope_field string, goal string"
    df = spark.createDataFrame(rows, schema).withColumn("scope", F.when(F.col("theme") == "a", F.array(F.lit("17"), F.lit("13")))).withColumn("told", F.when(F.col("theme") == "b", F.array(F.lit("state art"))))
    got = percolate.near_fields(works, df, limit=25, field_ids="scope", assumptions="told", expand=expand)
    mine = {t: [(r.id, r.rung, r.step) for r in got.where(F.col("theme") == t).orderBy("place").collect()] for t, *_ in rows}
    for theme, words, field, goal in rows:
        spec = {"keywords_include": words, "scope_field": field, "goal": goal}
        one = themes.near_field(works, spec, limit=25, field_ids=("17", "13") if theme == "a" else (), assumptions=("state art",) if theme == "b" else (), expand=expand)
        order = {"ladder": 0, "expansion": 1}
        want = sorted(((order[r.step], r.rung, r.pos, r.id, r.step) for r in one.collect()))
        assert mine[theme] == [(i, rung, step) for _, rung, _, i, step in want], theme


def test_nothing_to_percolate(spark, works):
    none = spark.createDataFrame([], QUERY)
    assert percolate.percolate(none, works).collect() == []
    assert percolate.percolate(spark.createDataFrame(asked(), QUERY), works.limit(0)).collect() == []


def _shuffled(df) -> int:
    """Rows that the plan's exchanges wrote."""
    df.collect()
    sizes, todo = [], [df._jdf.queryExecution().executedPlan().finalPhysicalPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "ShuffleQueryStageExec":
            sizes.append(node.shuffle().metrics().apply("shuffleRecordsWritten").value())
            node = node.plan()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return sum(sizes)


@pytest.mark.parametrize("block", [10**6, 7])
def test_first_rungs_are_settled_in_the_row_of_a_work(spark, works, block):
    """Every pair, and none travels; blocks of classes give the same."""
    q = spark.createDataFrame(asked(), QUERY).withColumn("rung", F.col("query")).withColumn("query", F.col("query") % 6)
    rows = [(r["query"], r.rung, *r[2:]) for r in q.collect()]
    want = {}
    for r in sorted(rows, key=lambda r: r[1]):
        for w in as_query(r).apply(works).select("id").collect():
            want.setdefault((r[0], w.id), r[1])
    got = percolate.percolate(q, works, block=block, first=True)
    found = [(r["query"], r.id, r.rung) for r in got.collect()]
    assert len(found) == len(want) and {(a, b): c for a, b, c in found} == want
    assert _shuffled(got) == 0


def test_first_matches_of_works_whose_id_repeats(spark):
    works = spark.createDataFrame([(1, "deep", "x"), (1, "deep nets", "x"), (2, "deep", "x"), (3, "nets", "x")], "id int, title string, abstract string")
    rows = spark.createDataFrame([("t", ["deep", "nets"])], "theme string, keywords_include array<string>").withColumn("scope_field", F.lit("")).withColumn("goal", F.lit("nets"))
    assert sorted((r.id, r.rung) for r in percolate.first_matches(percolate.ladders(rows), works).collect()) == [(1, 0), (2, 1), (3, 2)]


def test_equal_queries_are_one_class_until_their_matches_are_found(spark, works):
    q = spark.range(500).select(F.col("id").alias("query"), F.lit(0).alias("rung"), F.array(F.lit("17"), F.lit("13")).alias("field_ids"))
    got = percolate.percolate(q, works)
    assert got.count() == 500 * works.where("field_id IN ('17', '13')").count() and _shuffled(got) == 0


@pytest.mark.parametrize("head", [20, 10**6])
def test_first_places_in_rounds(spark, works, head):
    """Rounds by position find what one pass over all works finds, and hold few matches."""
    rows = spark.createDataFrame([(i, a) for i, a in enumerate([["deep", "nets", "graphs"], ["of"], ["absent", "art"], ["c3po", "state"]])], "theme int, keywords_include array<string>").withColumn("scope_field", F.lit("")).withColumn("goal", F.lit("the"))
    q = percolate.ladders(rows)
    every = percolate.first_rungs(percolate.percolate(q, works)).join(works.select("id", "pos"), "id").collect()
    got = percolate.first_places(q, works, limit=12, head=head).collect()
    for t in range(4):
        want = sorted((r.rung, r.pos, r.id) for r in every if r["query"] == t)[:12]
        assert [(r.rung, r.pos, r.id) for r in sorted((r for r in got if r["query"] == t), key=lambda r: r.place)] == want


@pytest.mark.parametrize(("first", "steps"), [(False, 10**6), (True, 10**6), (True, 3)])
def test_words_alone_are_looked_up_once_a_work(spark, works, first, steps):
    """Words, phrases, repeated words and equal queries; no pair of a work and a filed query is made."""
    anchors = ["deep", "state-of-the-art graphs", "graphs graphs", "the art of", "Zürich", "absent", "deep nets", "nets", "日本", " ".join(f"nets {w}" for w in "deep graphs of the art state c3po zürich deep".split())]
    rows = [(f"q{i % 4}", i, a) for i, a in enumerate([*anchors, *anchors])]
    q = spark.createDataFrame(rows, "query string, rung int, anchor string")
    want = []
    for query, rung, anchor in rows:
        want += [(query, rung, r.id) for r in gates.StructuredQuery(anchor_terms=(anchor,)).apply(works).select("id").collect()]
    if first:
        least = {}
        for query, rung, i in sorted(want, key=lambda r: r[1]):
            least.setdefault((query, i), rung)
        want = [(query, rung, i) for (query, i), rung in least.items()]
    got = percolate.percolate(q, works, first=first, steps=steps)
    assert sorted((r["query"], r.rung, r.id) for r in got.collect()) == sorted(want) and want
    assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString() and _shuffled(got) == 0


def test_queries_without_anchors_are_written_once(spark, works, monkeypatch):
    """No table of single queries is written where there are no words to look up: only their classes."""
    written, plain = [], percolate.cut
    monkeypatch.setattr(percolate, "cut", lambda d: written.append(d.columns) or plain(d))
    q = spark.range(20).select(F.col("id").alias("query"), F.lit(0).alias("rung"), F.array(F.lit("W1"), F.lit("W2")).alias("cites"))
    got = percolate.percolate(q, works, broadcast=0)
    assert got.count() == 20 * works.where("array_contains(refs, 'W1') OR array_contains(refs, 'W2')").count()
    assert written == [["file", "q", "members", "kind"]]
