"""Reports as blocks, search texts and requests of tables of themes, models' rows."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import contract, gates, percolate, render, themes
from orrery.sources import anchors

ENTRY = "theme string, section int, track string, pos int, id string, doi string, title string, year int, venue string, cited_by_count long, publication_type string, label string, level string, summary string, relationship string, hypothesis string, caution string, meta map<string,string>, matched array<struct<keyword:string,where:string,credit:double>>, n_keywords int"
TEXTS = ("sum", "rel", "hyp", "cau")


def entry(theme, section, track, pos, id, doi, title, kind, label, level, meta, matched=None, year=2020, venue="GitHub"):
    return (theme, section, track, pos, id, doi, title, year, venue, 7, kind, label, level, *TEXTS, meta, matched, 3 if matched is not None else None)


def body(s, e):
    tag = lambda name, edge: f"<!-- AUTO_SECTION:S{s:02d}-E{e:03d}:{name}:{edge} -->"
    heads = {"SUMMARY": "1) 概要: sum", "RELATIONSHIP": "2) テーマとの関連性: rel", "HYPOTHESIS": "3) 役に立つ可能性の仮説: hyp", "CAUTION": "4) 注意点: cau"}
    return "\n".join(x for name, text in heads.items() for x in (tag(name, "START"), text, tag(name, "END"))) + "\n"


def test_a_report_of_both_tracks(spark):
    repo = {"relevance": "0.5", "anchor_rank_score": "58.2", "relevance_tier": "1", "reliability_score": "86", "impl_doc_score": "20", "lma_score": "25", "community_score": "16", "security_score": "25", "license_name": "MIT", "has_rich_signals": "true", "verified_maturity_score": "9", "release_count": "4", "ci_recent_success": "5", "ci_runs_sampled": "6", "third_party_score": "3", "external_contributor_count": "2", "issue_signal_summary": "calm"}
    hub = {"relevance": "0.0", "anchor_rank_score": "10", "relevance_tier": "0", "reliability_score": "30", "adoption_score": "1", "activity_score": "2", "license_score": "3", "theme_fit_score": "4", "downloads": "99", "likes": "5", "hf_kind": "model"}
    rows = [
        entry("t", 0, "A", 0, "https://x/r", None, "Repo", "github_repository", "axis", "中", repo, [("drift", "name/description/topics", 1.0), ("net", "readme", 0.4)]),
        entry("t", 0, "A", 1, "hf/x", None, "Hub", "huggingface_model", None, None, hub, [], venue="HuggingFace"),
        entry("t", 0, "A", 2, "kg/x", None, "Set", "kaggle_dataset", "axis", "低", {"votes": "8", "kaggle_kind": "dataset", "downloads": "6", "reliability_score": "44"}, year=0, venue="Kaggle"),
        entry("t", 1, "B", 0, "W1", "10.1/x", "Paper", "article", "tie", None, {"serendipity_score": "0.56", "distance_score": "0.8", "structure_score": "0.7", "structural_depth": "0.61"}, venue="Venue"),
    ]
    entries = spark.createDataFrame(rows, ENTRY)
    spec = [("t", "Field", "over", "goal", "why", "theory", ["a1", "a2"], "small", "last_10_years", ["drift", "net"], [], "worry", "2026-01-01", None), ("u", None, "o", "g", "w", "x", None, "s", "no_limit", None, ["no"], "", None, None)]
    th = spark.createDataFrame(spec, "theme string, scope_field string, theme_overview string, goal string, why_problem string, approach_type string, assumptions array<string>, scale string, time_range string, keywords_include array<string>, keywords_exclude array<string>, concern string, collected_at string, filter_policy string")
    sections = spark.createDataFrame([("t", 0, "Track A"), ("t", 1, "Track B"), ("u", 0, "Nothing yet")], "theme string, section int, title string")
    got = {r.theme: r.document for r in render.documents(render.document_blocks(th, sections, entries)).collect()}
    head = "# 視座拡張レポート（ホーム分野: Field）\n\n## 入力サマリ\n\n- テーマ概要: over\n- 目的: goal\n- 問題意識: why\n- アプローチ: theory\n- 前提・仮説:\n  - a1\n  - a2\n- スコープ:\n  - 分野: Field\n  - スケール: small\n  - 時代: last_10_years（記録のみ。出版年では絞らないので、これより古い文献も返る）\n- include: drift, net\n- 不安点: worry\n"
    a0 = "### 1. Repo\n\n- **関係度**: 中（theme関連度 0.5）\n- **関係軸**: axis\n- **順位スコア**: 58.2 = Reliability × 関連度係数 (theme関連度 0.5)\n- **一致キーワード 2/3: drift（名前/説明/topics） / net（README・部分 0.4）**\n- 更新年: 2020  |  種別: GitHub  |  stars: 7\n- Reliability Score: 86/100 [rich: time+people] (Impl/Doc: 20/30, LMA: 25/25, Comm: 16/20, Sec: 25/25)  |  License: MIT\n- Verified Maturity: 9/12 (releases: 4, CI: 5/6 passing)\n- Third-Party Signal: 3/6 (ext. contributors: 2, non-owner reporters: —)\n- Issue Signal: calm\n- リンク: https://x/r\n\n"
    a1 = "### 2. Hub\n\n- **関係度**: —（theme関連度 0.0）\n- **関係軸**: —\n- **順位スコア**: 10 = Reliability × 関連度係数 (theme関連度 0.0・一致キーワード 0 件のため、一致のあるアンカーすべての後ろに並ぶ)\n- **一致キーワード なし（0/3）**\n- 更新年: 2020  |  種別: HuggingFace/model  |  DL: 99  |  likes: 5\n- Reliability Score: 30/100 (Adoption: 1/40, Activity: 2/25, License: 3/15, Theme-fit: 4/20)  |  License: —\n- Task/Pipeline: —\n- リンク: hf/x\n\n"
    a2 = "### 3. Set\n\n- **関係度**: 低\n- **関係軸**: axis\n- 更新年: —  |  種別: Kaggle/dataset  |  votes: 8  |  DL: 6\n- Reliability Score: 44/100\n- リンク: kg/x\n\n"
    b0 = "### 1. Paper\n\n- **接続点**: tie\n- **セレンディピティ・スコア**: 0.56（距離 0.8 × 目的の一致 0.7＝purpose_sim）／構造の深さ 0.61（structural_depth・hollow ゲートにだけ使い、点数には入らない）\n- 年: 2020  |  掲載: Venue  |  被引用: 7\n- リンク: 10.1/x\n\n"
    want = "\n".join([head, "## 目次\n\n- Track A\n- Track B\n", "## Track A\n", a0 + body(0, 0), a1 + body(0, 1), a2 + body(0, 2), "## Track B\n", b0 + body(1, 0), "## 付録\n\n- 取得日: 2026-01-01\n- 検索条件: TBD\n- フィルタ条件: TBD\n"])
    assert got["t"] == want
    assert "- （未収集）\n" in got["u"] and "# 視座拡張レポート（ホーム分野: ）" in got["u"] and "  - 時代: no_limit\n- exclude: no\n" in got["u"] and "不安点" not in got["u"]


def test_search_texts_of_tables(spark):
    rng = random.Random(1)
    some = lambda n: [rng.choice([" deep  learning", "drift", "Drift", "", None, "self-play", 'q"uoted', "a" * 90, "b" * 90, "c" * 90, "x y z", "n1", "n2"]) for _ in range(rng.randint(0, n))]
    rows = [(i, some(9), some(4)) for i in range(150)] + [(150, None, None)]
    df = spark.createDataFrame(rows, "theme int, keywords_include array<string>, keywords_exclude array<string>")
    as_of = dt.date(2000, 1, 2)
    got = {}
    for r in anchors.legs_of(df, F.lit(as_of)).orderBy("theme", "leg").collect():
        got.setdefault(r.theme, []).append((r.label, r.text))
    for t, inc, exc in rows:
        assert got[t] == anchors.search_legs(inc or [], exc or [], as_of), (inc, exc)
    totals = [(t, leg, rng.choice([None, 0, rng.randint(1, 100)])) for t in range(60) for leg in range(rng.randint(1, 5))]
    turns = {(r.theme, r.leg): r.turns for r in anchors.turns_of(spark.createDataFrame(totals, "theme int, leg int, total int")).collect()}
    for t in range(60):
        own = [n for th, _, n in totals if th == t]
        assert [turns[t, leg] for leg in range(len(own))] == anchors.leg_turns(own)
    names = spark.createDataFrame([(" GH ",), ("kg",), ("?",), (None,)], "n string").select(anchors.known_source(F.col("n")).alias("s"))
    assert [r.s for r in names.collect()] == ["github", "kaggle", None, None]


def test_requests_of_tables(spark):
    from test_percolate import QUERY, as_query, asked

    rows = asked()
    got = {r["query"]: r.params for r in percolate.requests(spark.createDataFrame(rows, QUERY), per_page=80).collect()}
    for row in rows:
        want = {k: str(v) for k, v in themes.route_params(as_query(row), per_page=80).items()}
        assert {k: v for k, v in got[row[0]].items()} == {k: " ".join(v.split()) if k.startswith("search") else v for k, v in want.items()}, row


def test_models_rows(spark):
    items = [
        {"id": "a", "purpose_level": " Strong ", "purpose_sim": 0.1, "mechanism_dist": 0.8, "purpose_pct": 85, "connection_label": "tie", "serendipity_rationale": "why", "paper_purpose": "p"},
        {"id": "b", "purpose_level": "unheard", "purpose_sim": 1.7, "mechanism_dist": "0.5", "purpose_pct": 140},
        {"id": "c", "purpose_sim": "much", "mechanism_dist": -2, "purpose_pct": "x", "connection_label": "tie"},
        {"id": "d", "mechanism_dist": "far"}, {"purpose_sim": 1}, "text", None, {"id": "e"}, {"id": "", "mechanism_dist": 1},
    ]
    got = {r.id: r for r in contract.model_rows(spark.createDataFrame([(1, json.dumps(items)), (2, "broken"), (3, None), (4, "{}")], "chunk int, payload string")).collect()}
    assert sorted(got) == ["a", "b", "c", "e"] and {r.chunk for r in got.values()} == {1}
    a, b, c, e = (got[k] for k in "abce")
    assert (a.purpose_sim, a.mechanism_dist, a.purpose_pct, a.fine_rank, a.complete, a.paper_purpose) == (gates.LEVELS["strong"], 0.8, 85, pytest.approx(0.68), True, "p")
    assert (b.purpose_sim, b.mechanism_dist, b.purpose_pct, b.fine_rank, b.connection_label, b.complete) == (1.0, 0.5, 100, 0.5, contract.UNLABELLED, False)
    assert (c.purpose_sim, c.mechanism_dist, c.purpose_pct, c.complete) == (0.0, 0.0, 0, False) and (e.purpose_sim, e.mechanism_dist) == (0.0, 0.0)


def test_missing_fields_are_an_error(spark):
    rows = spark.createDataFrame([("a", 0, 0.5, 0.5), ("b", 1, None, 0.5), (None, 2, 0.1, None)], "id string, pos int, purpose_sim double, mechanism_dist double")
    assert [(r.pos, r.missing) for r in contract.missing_fields(rows).orderBy("pos").collect()] == [(1, ["purpose_sim"]), (2, ["id", "mechanism_dist"])]
    with pytest.raises(ValueError, match="#1 lacks the required field 'purpose_sim'"):
        contract.checked(rows)
    assert contract.checked(rows.where("pos = 0")).count() == 1


def test_pool_lines(spark):
    counts = spark.createDataFrame([("b", 0, 3, 3), ("a", 5, 1, 6), ("c", 0, 0, 0)], "keyword string, strong int, readme int, total int")
    totals = spark.createDataFrame([(6, 2, 0, "403")], "measured int, readme_failed int, issue_failed int, first_error string")
    legs = spark.createDataFrame([("legs",)], "line string")
    got = [r.line for r in render.pool_lines(["a", "b", "c"], counts, totals, legs=legs).orderBy("pos").collect()]
    assert got == ["legs", "プール内訳（取得 6 件のうち各キーワードに一致した件数。括弧内は 名前/説明/topics・README）: a 6（5・1） / b 3（0・3） / c 0（0・0）", "名前/説明/topics に一致したものがプールに 1 件も無いキーワード: b（README の言及のみ 3 件） / c（README を含め 0 件）", "取得失敗: README 2 件・issue 0 件（403）"]
    assert render.pool_lines(["a"], counts.limit(0), totals.withColumn("measured", F.lit(0)), legs=legs).collect() == []


def test_material_options():
    from orrery import sinks

    assert [sinks.material_options(1, c)["abstract_chars"] for c in (None, 0, "x", -5, 50, "300")] == [None, None, None, None, 200, 300] and sinks.material_options()["lean"] is False
