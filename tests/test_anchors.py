"""Anchor sources, taxonomy and the composed lifecycles on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from orrery import pipelines
from orrery.operators import taxonomy
from orrery.sources import anchors

def as_of():
    return F.lit("2024-06-01").cast("date")


def test_sources_and_search_text():
    assert anchors.sources_of(["hf", "gh", "HF", "nope"]) == ["huggingface", "github"] and anchors.sources_of(None) == list(anchors.SOURCES)
    assert anchors.search_terms(["a b", "A B", "c-d", ""], quote_hyphen=True) == ['"a b"', '"c-d"']
    assert anchors.search_text(["x", '"a b"'], ["no"], dt.date(2024, 6, 1)) == 'x OR "a b" in:name,description,readme NOT no pushed:>2022-11-29'
    assert anchors.leg_turns([900, 100, 500, None]) == [2, 1, 0, 0] and anchors.leg_turns([None, 1]) == [1, 1] and anchors.leg_turns([5]) == [1]


def test_seats_by_turns(spark):
    rows = [(0, i, f"o{i}") for i in range(4)] + [(1, 0, "o1"), (1, 1, "k1")]
    got = anchors.seat_by_turns(spark.createDataFrame(rows, "leg int, pos int, full_name string"), [2, 1], limit=5)
    assert sorted(r.full_name for r in got.collect()) == ["k1", "o0", "o1", "o2", "o3"]


def test_issue_signal_looks_behind_pull_requests(spark):
    cols = "repo string, owner string, pos int, state string, body string, login string, labels array<string>, is_pr boolean"
    rows = [("r", "me", i, "open", "", "me", [], True) for i in range(5)] + [("r", "me", 5, "closed", "text", "you", ["bug"], False)] + [("q", "me", 0, "open", None, "me", [" "], False)]
    got = {r.repo: r for r in anchors.issue_signal(spark.createDataFrame(rows, cols)).collect()}
    assert (got["r"].issues, got["r"].closed, got["r"].with_body, got["r"].labelled, got["r"].reporters) == (1, 1, 1, 1, 1)
    assert (got["q"].issues, got["q"].opened, got["q"].labelled, got["q"].reporters) == (1, 1, 0, 0)


def test_reliability_and_rank(spark):
    repos = spark.createDataFrame([("o/a", "https://h/a", "o", "trend following paper", 300, 40, "MIT", "2024-05-30T00:00:00Z", "", ["x"], "Install. Usage. ```a```")], "full_name string, html_url string, owner string, description string, stars long, forks long, license_name string, updated_at string, pushed_at string, topics array<string>, readme string")
    none = lambda ddl: spark.createDataFrame([], ddl)
    got = anchors.attach_signals(
        repos, issues=none("repo string, owner string, pos int, state string, body string, login string, labels array<string>, is_pr boolean"), releases=spark.createDataFrame([("o/a", "2024")] * 3, "repo string, published_at string"),
        runs=spark.createDataFrame([("o/a", "success")] * 4, "repo string, conclusion string"), contributors=spark.createDataFrame([("o/a", "o"), ("o/a", "p")], "repo string, login string"),
    )
    plain, rich = (anchors.reliability(got, as_of(), rich=r).first() for r in (False, True))
    assert plain.impl_doc_score == 8 + 5 and rich.impl_doc_score == 3 + 2 + 4 + 6 + 1
    assert plain.lma_score == 25 and plain.community_score == 10 + 0 and plain.security_score == 15
    works = anchors.repos_to_works(anchors.reliability(got, as_of(), rich=False), ["trend following"])
    hub = anchors.hub_to_works(spark.createDataFrame([('{"modelId":"m/x","tags":["license:mit"],"downloads":20000,"likes":60,"lastModified":"2024-05-20T00:00:00Z"}', "")], "payload string, card string"), as_of(), ["other"])
    assert hub.first().reliability_score == 20 + 8 + 25 + 15 and hub.first().id.endswith("/m/x")
    top = pipelines.rank_anchors(anchors.union_sources(works, hub), count=2).collect()
    assert [t.title for t in top] == ["o/a", "m/x"] and top[0].anchor_rank_score == pytest.approx(63.0) and top[0].level == "高"


def test_kaggle_items(spark):
    d = anchors.datasets_to_works(spark.createDataFrame([('{"ref":"u/d","title":"T","tags":[{"name":"finance"}],"downloadCount":1500,"voteCount":55,"usabilityRating":0.5,"licenseName":"other","lastUpdated":"2024-05-25T00:00:00Z"}',)], "payload string"), as_of(), ["finance"]).first()
    assert d.reliability_score == 12 + 6 + 3 + 25 + 7 + 20 and d.abstract == "finance"
    n = anchors.notebooks_to_works(spark.createDataFrame([('{"ref":"u/n","author":"me","totalVotes":31,"medal":"Gold","lastRunTime":"bad"}',)], "payload string"), as_of(), []).first()
    assert n.reliability_score == 15 + 12 and n.abstract == "Kaggle notebook by me" and n.year == 0


def test_taxonomy(spark, tmp_path):
    (tmp_path / "t.json").write_text('[["2003", "Finance", "20"], ["2002", "Economics and Econometrics", "20"]]')
    t = taxonomy.load_taxonomy(spark, str(tmp_path / "t.json"))
    themes = spark.createDataFrame([(1, "Quantitative finance and asset pricing"), (2, "medicine"), (3, None)], "theme int, scope_field string")
    assert [(r.theme, r.subfield_id) for r in taxonomy.resolve_strict(themes, t).collect()] == [(1, "2003")]
    fields = spark.createDataFrame([("27", "Medicine"), ("17", "Computer Science")], "field_id string, name string")
    aliases = spark.createDataFrame([("cs", "17")], "alias string, field_id string")
    assert [(r.theme, r.field_id) for r in taxonomy.resolve_fields(themes, fields, aliases).collect()] == [(2, "27")]
    pool = spark.createDataFrame([("p", "T1", "s1"), ("q", "T2", "s1")], "id string, topic_id string, subfield_id string")
    roster = spark.createDataFrame([("a", "T1"), ("b", None), ("c", "T9"), ("p", "T1")], "id string, topic_id string")
    assert tuple(taxonomy.leg_agreement(roster, pool).first()) == (3, 2, 1)
    assert taxonomy.landed_elsewhere(pool, spark.createDataFrame([("s2",)], "s string")).first().elsewhere


def test_finalize(spark):
    cols = "id string, purpose_sim double, mechanism_dist double, structural_depth double, has_causal_pm boolean, near boolean, purpose_pct int, relationship string, serendipity_rationale string, theme_quote string, source_quote string, title string, abstract string, concepts array<string>, facet string"
    base = ("claim", None, "long enough quote", "another source quote", "t", "Another source quote.", ["A"], "f")
    rows = [("x", 0.8, 0.9, 0.8, True, False, 80, *base), ("y", 0.7, 0.8, 0.1, True, False, 70, *base), ("z", 0.1, 0.9, 0.9, True, False, 10, *base[:3], "not in the text", *base[4:])]
    picked, log = pipelines.finalize(spark.createDataFrame(rows, cols), "a LONG enough quote")
    assert [(r.id, r.relationship) for r in picked.collect()] == [("x", "claim")]
    assert {r.id: r.floor for r in log.collect()} == {"y": "hollow", "z": "anomaly"}


def test_collect_bridges(spark):
    works = spark.createDataFrame([(i, i % 5, float(100 - i)) for i in range(40)], "id long, field int, cites double")
    refs = spark.createDataFrame([(i, j) for i in range(40) for j in range(6) if (i + j) % 3 == 0], "id long, ref long")
    got = pipelines.collect_bridges(works, refs, works.where("id < 6"), limit=20).collect()
    assert len(got) == 20 and [r.slot for r in sorted(got, key=lambda r: r.slot)] == list(range(20)) and not {r.id for r in got} & set(range(6))
