"""Hubs, archives and the documents made of them, over fetchers that answer from memory."""

import datetime as dt
import json
import sys
import zlib

import pytest
from pyspark.sql import functions as F

from orrery import pipelines
from orrery.operators import gates
from orrery.sources import hubs, readers

QUICK = {"config": readers.ReadConfig(interval=0.0, backoff=0.0)}


@pytest.fixture(autouse=True)
def by_value():
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture
def theme(spark):
    return hubs.one_theme(spark, theme_overview="o", goal="g", keywords_include=["drift net", "x"], keywords_exclude=[], assumptions=["a1"], concern="")


def lists(params):
    made = [{"id": f"org/{params['path'][5:]}-{i}", "tags": ["drift", "net", "license:mit"] if i == 1 else [], "downloads": 10 ** i, "likes": 5, "lastModified": "2026-01-01T00:00:00Z"} for i in range(4)]
    assert params["search"] == "drift net" and params["sort"] == "downloads"
    return 200, {}, json.dumps(made if "models" in params["path"] else {"datasets": [*made, "no object", {"id": ""}]})


def cards(params):
    return (200, {}, json.dumps({"text": "drift net card"})) if params["path"].endswith("models-0/raw/main/README.md") else (403, {}, "no")


def as_of():
    return F.lit(dt.date(2026, 2, 1))


def test_hub_records_of_both_kinds(spark, theme):
    got = hubs.collect_hub(theme, lists, as_of(), ["drift net"], limit=3, most=5, cards=cards, **QUICK).collect()
    assert len(got) == 5 and [r.reliability_score for r in got] == sorted((r.reliability_score for r in got), reverse=True)
    assert {r.publication_type for r in got} == {"huggingface_model", "huggingface_dataset"} and all(r.id.startswith("https://huggingface.co/") for r in got)
    carded = next(r for r in got if r.id.endswith("models-0"))
    assert carded.abstract == "drift net card" and carded.theme_fit_score > 0
    assert hubs.collect_hub(hubs.one_theme(spark), lists, as_of(), []) is None


def sets(params):
    if params["path"] == "/kernels/list":
        return 200, {}, json.dumps([{"ref": "me/book", "title": "Drift net", "totalVotes": 7, "languageName": "python", "lastRunTime": "2026-01-20"}])
    return 200, {}, json.dumps([{"ref": "me/set", "title": "t", "subtitle": "drift net", "downloadCount": 5, "voteCount": 2, "licenseName": "MIT", "lastUpdated": "2026-01-20"}])


def never(params):
    raise AssertionError("nothing may be asked")


def test_sets_and_notebooks_need_credentials(spark, theme):
    got = {r.publication_type: r for r in hubs.collect_sets(theme, sets, as_of(), ["drift net"], credentials="key", **QUICK).collect()}
    assert set(got) == {"kaggle_dataset", "kaggle_kernel"} and got["kaggle_dataset"].abstract == "drift net"
    assert hubs.collect_sets(theme, never, as_of(), [], credentials=None) is None


def test_a_source_that_fails_costs_only_itself(spark, theme):
    bad = lambda p: (401, {}, "who")
    works, failed = hubs.collect_anchors(theme, {"hub": lambda: hubs.collect_hub(theme, lists, as_of(), ["drift net"], **QUICK), "sets": lambda: hubs.collect_sets(theme, bad, as_of(), [], credentials="k", **QUICK), "none": lambda: hubs.collect_sets(theme, never, as_of(), [], credentials="")})
    assert {r.anchor_source for r in works.collect()} == {"hub"} and list(failed) == ["sets"] and "status 401" in failed["sets"]
    with pytest.raises(ValueError):
        hubs.collect_anchors(theme, {"sets": lambda: hubs.collect_sets(theme, bad, as_of(), [], credentials="k", **QUICK)})


def pdf(text):
    return b"%PDF-1.4\n1 0 obj<<>>\nstream\n" + zlib.compress(b"BT (" + text.encode("latin-1") + b") Tj ET") + b"\nendstream\n"


def test_archived_copies_one_after_another(spark, tmp_path):
    log, good = str(tmp_path / "log"), "Plain prose of an archived copy. " * 30
    file = lambda *urls: {"files": [{"mimetype": "application/pdf", "urls": [{"url": u} for u in urls]}]}
    releases = {"10.1/a": file("http://x.org/a", "https://web.archive.org/a"), "10.1/b": file("https://archive.org/thin", "http://x.org/b"), "10.1/c": file("http://x.org/gone")}

    def lookup(params):
        return (200, {}, json.dumps(releases[params["doi"]])) if params["doi"] in releases else (404, {}, "")

    def fetch(url):
        with open(log, "a") as f:
            f.write(url + "\n")
        return {"https://web.archive.org/a": pdf(good + "from the archive"), "http://x.org/a": pdf(good), "https://archive.org/thin": pdf("thin"), "http://x.org/b": pdf(good)}.get(url)

    works = spark.createDataFrame([("A", "https://doi.org/10.1/A"), ("B", "10.1/b"), ("C", "doi:10.1/c"), ("D", "10.1/d"), ("E", None)], "id string, doi string")
    got = {r.id: (r.url, r.text[-16:]) for r in hubs.archived_texts(works, lookup, fetch, **QUICK).collect()}
    assert got == {"A": ("https://web.archive.org/a", "from the archive"), "B": ("http://x.org/b", good.strip()[-16:])}
    assert sorted(open(log).read().split()) == ["http://x.org/b", "http://x.org/gone", "https://archive.org/thin", "https://web.archive.org/a"]


def test_a_document_of_anchors(spark, theme):
    works = hubs.collect_hub(theme, lists, as_of(), ["drift net"], limit=3, **QUICK)
    spec = theme.select(F.lit("t").alias("theme"), "*", *[F.lit("x").alias(c) for c in ("approach_type", "scale", "time_range")])
    text = pipelines.anchor_document(works, spec, count=2).first().document
    assert text.count("### ") == 2 and "## Track A\n" in text and "- **関係軸**: 実装アンカー" in text and "Adoption" not in text
    assert "2) テーマとの関連性: 関係軸「実装アンカー」で関係度「" in text and "前提「a1」が成り立つか要確認。" in text and text.endswith("- フィルタ条件: TBD\n")


def test_open_access(spark):
    rows = spark.createDataFrame([(True, None, None), (None, "http://x", ""), (False, "", "1234.5678"), (None, None, None)], "oa boolean, url string, arxiv string")
    assert [r.o for r in rows.select(gates.open_access(F.col("oa"), F.col("url"), F.col("arxiv")).alias("o")).collect()] == [True, True, True, False]
