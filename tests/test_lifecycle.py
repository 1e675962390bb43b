"""Composed lifecycles: golden cases of collection, diagnostics, documents and themes."""

from pyspark.sql import functions as F

from orrery import sinks
from orrery.operators import collect, contract, diagnostics, documents, themes


def test_pool_keeps_room_for_every_group(spark):
    seeds = spark.createDataFrame([("a", 0, "10.1/x", "one"), ("b", 1, "", "two"), ("c", 2, "10.1/x", "three"), ("d", 3, "", "two")], "id string, pos int, dk string, tk string")
    refs = spark.createDataFrame([(s, f"{s}{i}") for s in "abcd" for i in range(12)] + [(s, "all") for s in "abcd"], "id string, ref string")
    groups = collect.seed_groups(seeds, refs)
    assert {r.id: r.grp for r in groups.collect()} == {"a": 0, "c": 0, "b": 1, "d": 1}
    at = refs.withColumn("at", F.lit(0))
    pool = collect.pool_of_groups(groups, at, cap=8)
    rows = [r.ref for r in pool.orderBy("slot").collect()]
    assert len(rows) == 8 and rows[0] == "all" and {r[0] for r in rows[1:]} >= {"a", "b"}


def test_near_identical_references_are_one_work(spark):
    seeds = spark.createDataFrame([("a", 0, "", ""), ("b", 1, "", ""), ("c", 2, "", "")], "id string, pos int, dk string, tk string")
    refs = spark.createDataFrame([("a", i) for i in range(20)] + [("b", i) for i in range(1, 20)] + [("c", i) for i in range(10, 30)], "id string, ref int")
    assert {r.id: r.grp for r in collect.seed_groups(seeds, refs).collect()} == {"a": 0, "b": 0, "c": 1}


def _works(spark, rows):
    return spark.createDataFrame(rows, "id int, field string, domain string, topic string, n_refs int, retracted boolean, type string, cites int")


def test_a_hub_does_not_take_the_pool(spark):
    """One bridge with many citers gets its share, the others theirs; the backfill fills what is left, other domains first."""
    rows = [(i, "f1", "home" if i % 2 else "far", None, 5, False, "article", 1000 - i) for i in range(100)]
    rows += [(200, "f2", "far", None, 5, False, None, 1), (201, "home", "far", None, 5, False, "article", 9999), (202, "f2", None, None, 5, False, "conference-paper", 3), (203, "f2", "far", None, 500, False, "article", 3), (204, "f2", "far", None, 5, True, "article", 3), (205, "f2", "far", None, 5, False, "review", 3), (206, "f2", "far", "t", 5, False, "article", 3), (207, "f2", "far", None, 5, False, "article", 3)]
    works = _works(spark, rows)
    refs = spark.createDataFrame([(i, "hub") for i in range(100)] + [(i, "small") for i in range(200, 208)], "id int, ref string")
    seeds = spark.createDataFrame([(999,)], "id int")
    pool = spark.createDataFrame([(0, "hub"), (1, "small")], "slot int, ref string")
    one = lambda v, c: spark.createDataFrame([(v,)], f"{c} string")
    got = collect.collect_candidates(works, refs, seeds, pool, home_fields=one("home", "field"), home_topics=one("t", "topic"), home_domains=one("home", "domain"), used=spark.createDataFrame([(207,)], "id int"), limit=8, quota=3)
    rows = [(r.id, r.bridge) for r in got.orderBy("slot").collect()]
    assert rows[:5] == [(0, 0), (2, 0), (4, 0), (200, 1), (202, 1)]  # far first, unfiled last
    assert [b for _, b in rows[5:]] == [None] * 3 and [i for i, _ in rows[5:]] == [1, 3, 5]
    bare = collect.collect_candidates(works, refs, seeds, pool, home_fields=one("home", "field"), limit=8, quota=0)
    assert [r.id for r in bare.orderBy("slot").collect()] == list(range(8))
    tags = spark.createDataFrame([(0, "root"), (1, "other")], "id int, name string")
    none = spark.createDataFrame([], "field string")
    scope = collect.citation_scope(works, seeds, home_fields=none, concepts=one("root", "name"), tags=tags)
    assert 0 not in {r.id for r in scope.collect()} and 1 in {r.id for r in scope.collect()}


def test_starved_facet_gets_its_share(spark):
    kept = spark.createDataFrame([(f, p, f * 100 + p, f"{f}-{p}", 1) for f in (1, 2, 3) for p in range(50)], "facet int, pos int, id int, tk string, standing int")
    buckets = collect.facet_buckets(kept, ["tk"])
    fair = collect.facet_select(buckets, limit=60).groupBy("facet").count()
    assert {r.facet: r["count"] for r in fair.collect()} == {1: 20, 2: 20, 3: 20}
    legacy = collect.facet_select(buckets, limit=60, fair=False).groupBy("facet").count()
    assert {r.facet: r["count"] for r in legacy.collect()} == {1: 50, 2: 10}


def test_a_better_copy_takes_the_slot_and_its_facet(spark):
    kept = spark.createDataFrame([(1, 0, 10, "same", 1), (1, 1, 11, "own", 1), (2, 0, 20, "same", 5), (2, 1, 21, "", 1)], "facet int, pos int, id int, tk string, standing int")
    got = {(r.facet, r.slot): r.id for r in collect.facet_buckets(kept, ["tk"]).collect()}
    assert got == {(1, 0): 20, (1, 1): 11, (2, 0): 21}


def test_a_chain_of_keys_does_not_move_records(spark):
    """A record that meets a held one by one key and drops out does not tie its other key to that slot."""
    kept = spark.createDataFrame([(1, 0, 10, "a", "x", 5), (1, 1, 11, "a", "y", 1), (2, 0, 20, "b", "y", 1), (2, 1, 21, "c", "", 1)], "facet int, pos int, id int, tk string, ak string, standing int")
    got = {(r.facet, r.slot): r.id for r in collect.facet_buckets(kept, ["tk", "ak"]).collect()}
    assert got == {(1, 0): 10, (2, 0): 20, (2, 1): 21}


def test_track_b_selection(spark):
    cand = spark.createDataFrame([(i, i, [f"n{i}"], "f") for i in range(6)], "id int, pos int, names array<string>, facet string")
    scores = spark.createDataFrame([(i, 0.8 - i * 0.1, 0.9, 0.8, True, False) for i in range(6)], "id int, purpose_sim double, mechanism_dist double, structural_depth double, has_causal_pm boolean, near boolean")
    picked, run = collect.track_b_select(cand, scores, count=2)
    assert [r.id for r in picked.orderBy("slot").collect()] == [0] and run.first().status == "ok"  # the gate is the 30 % rank
    none, run = collect.track_b_select(cand, scores.withColumn("purpose_sim", F.lit(0.1)), count=2)
    assert none.count() == 0 and run.first().status == "all_anomaly"


def test_title_only_abstracts(spark):
    rows = [("A study of rivers", "AUTHORS; A Study of Rivers, Journal, 12(3)", "title_echo"), ("El test empírico", "test empírico", "title_fragment"), ("x", "THE TITLE TRANSLATED INTO ENGLISH IN CAPITALS", "caps_heading"), ("A study of rivers", "Rivers are a study of their own.", None), ("t", "", None), ("t", None, None)]
    got = spark.createDataFrame([(i, t, a) for i, (t, a, _) in enumerate(rows)], "i int, t string, a string").select("i", contract.title_only_class(F.col("t"), F.col("a")).alias("c"))
    assert {r.i: r.c for r in got.collect()} == {i: c for i, (_, _, c) in enumerate(rows)}


def test_abstract_tail(spark):
    t = "First part is long. It ends! (Then) more comes here and goes on to the end of it"  # 52 characters from the bracket on
    got = spark.createDataFrame([(t,)], "t string").select(sinks.abstract_tail(F.col("t"), 60).alias("a"), sinks.abstract_tail(F.col("t"), 20).alias("b"), sinks.abstract_tail(F.col("t"), 500).alias("c")).first()
    assert got.a == t[t.index("(") :] and got.b == "on to the end of it" and got.c == t


def test_fine_rank_needs_a_percentage(spark):
    rows = spark.createDataFrame([(0.5, 0.8, None), (0.5, 0.8, 250), (2.0, 0.123456, 33)], "purpose_sim double, mechanism_dist double, purpose_pct int")
    got = [(r.purpose_sim, r.purpose_pct, r.fine_rank) for r in contract.score_row(rows).collect()]
    assert got == [(0.5, None, None), (0.5, 100, 0.8), (1.0, 33, 0.0407)]


def test_entries_and_filled_texts(spark):
    chosen = spark.createDataFrame([(0, "a", 3, 2), (1, "b", 1, 1)], "slot int, id string, shared_bridge_count int, bridge_betweenness int")
    overlap = spark.createDataFrame([("a", 1, 4)], "id string, inter int, union_n int")
    got = {r.id: r for r in documents.bridge_entries(chosen, overlap).collect()}
    assert got["a"].label == "引用ブリッジ（共有 3 本 / 異分野 2）" and got["a"].distance == 0.75 and got["b"].distance == 1.0
    rows = spark.createDataFrame([("B", "L", None, "", None, None, "said", "One. Two. Three. Four."), ("A", "L", "高", None, "mine", "h", None, None), ("B", "L", None, "own", None, None, None, "…the end. Of it.")], "track string, label string, level string, relationship string, summary string, hypothesis string, caution string, abstract string")
    out = documents.fill(rows, concern=F.lit(""), assumptions=F.array(F.lit("p"))).collect()
    assert out[0].relationship == "（記入なし）接続点ラベルのみ: L" and out[0].summary == "（記入なし）原文の冒頭の抜粋: One. Two. Three." and out[0].caution == "（呼び手の記述・原文と未照合）said" and out[0].hypothesis == "（記入なし）"
    assert out[1].relationship == "関係軸「L」で関係度「高」の関連性がある。" and out[1].summary == "（呼び手の記述・原文と未照合）mine" and out[1].caution == "（個別の注意点は記入なし）前提「p」が成り立つか要確認。"
    assert out[2].relationship == "own" and out[2].summary.startswith("（記入なし）原文の末尾の抜粋: …the end.")
    shown = spark.createDataFrame([("L", None), ("", False), (None, True)], "l string, c boolean").select(documents.connection_label(F.col("l"), F.col("c")).alias("x")).collect()
    assert [r.x for r in shown] == ["【接続点: L】", "【接続点（構造対応ゆるめ・思考のタネ）: 構造的接続】", "【接続点: 構造的接続】"]


def test_lines(spark):
    head = spark.createDataFrame([(60, 10, 1, 40, 8, 60), (60, 10, 1, 10, 2, 90), (0, 0, None, None, None, 0)], "candidates int, window int, top_bridge int, top_candidates int, top_in_head int, shared_total int")
    lines = [r.line for r in diagnostics.head_note(head).collect()]
    assert "not diverse, the busiest bridge holds 80%" in lines[0] and "one bridge" in lines[0] and "holds 20%" in lines[1] and "nothing" in lines[2]
    filed = spark.createDataFrame([("roster",), ("new",), ("new",)], "filed string")
    assert diagnostics.filing_line(filed).first().line == "topics seen in the roster 1, in the pool 0, nowhere 2, not filed 0"
    counts = spark.createDataFrame([("b", 2, 1, 1, "ok"), ("a", 5, 0, 0, "home_converged")], "facet string, returned int, kept int, selected int, status string")
    assert diagnostics.facet_line(counts).first().line == "facet a: 5 returned, 0 kept, 0 selected (home_converged) / facet b: 2 returned, 1 kept, 1 selected"
    legs = spark.createDataFrame([(1, "k", 7, 1), (0, "or", None, 2)], "leg int, keyword string, total int, turns int")
    assert diagnostics.legs_line(legs).first().line == "or ? (2) / k 7 (1)"
    align = spark.createDataFrame([(8, 2, 1)], "known int, home_n int, unknown int")
    assert diagnostics.alignment_line(align, level="field").first().line == "roster at field: 2 of 8 at home (25%), 1 not filed"
    th = spark.createDataFrame([(1, "Biology"), (2, "Botany"), (3, "?")], "theme int, scope_field string")
    lines = diagnostics.home_line(th, spark.createDataFrame([(1, "11")], "theme int, field_id string"), spark.createDataFrame([("11", "Life")], "field_id string, name string"), spark.createDataFrame([(2, "Life")], "theme int, name string"))
    assert {r.theme: r.line for r in lines.collect()} == {1: "home Biology: Life", 2: "home Botany: a subfield of Life, not a field", 3: "home ?: no field"}


def test_near_field_widens_a_thin_result(spark):
    text = lambda *w: " ".join(w)
    rows = [(i, "t", text("diffusion", "cascade", "influence", f"u{i}"), False, i, None) for i in range(4)]
    rows += [(10, "diffusion cascade", "far away words", False, 10, None), (11, "cascade", "no head word", False, 11, None), (12, "RETRACTED: diffusion", "cascade", False, 12, None), (13, "diffusion", "", False, 13, None)]
    works = spark.createDataFrame(rows, "id int, title string, abstract string, is_retracted boolean, pos int, field_id string")
    theme = {"keywords_include": ["diffusion influence"], "scope_field": "", "goal": ""}
    got = themes.near_field(works, theme, limit=50)
    assert {(r.id, r.step) for r in got.collect()} == {(i, "ladder") for i in range(4)} | {(10, "expansion")} or {r.id for r in got.collect()} >= {0, 1, 2, 3}
    ladder = themes.theme_ladder({"keywords_include": ["a", "b"], "scope_field": "f", "goal": "g"}, assumptions=["a b", "long sentence"], field_ids=["17"])
    assert [(q.anchor(), q.route) for q in ladder] == [("a b", "filter"), ("a", "filter"), ("f g", "filter"), ("long sentence", "search")] and all(q.field_ids == ("17",) for q in ladder)


def test_themes_from_files(spark, tmp_path):
    import json

    (tmp_path / "a.json").write_text(json.dumps({"_comment": "x", "theme_overview": "o", "goal": "g", "why_problem": "w", "assumptions": ["p", "q"], "scope": {"field": "f"}, "keywords": {"include": ["k1", "k2"]}, "concern": "c"}))
    t = themes.load_themes(spark, str(tmp_path / "a.json"))
    r = t.select(themes.query_text().alias("q"), themes.summary_text().alias("s"), F.array_join(themes.rungs(), "|").alias("r"), contract.theme_text({c: F.col(c) for c in ("theme_overview", "goal", "why_problem", "assumptions", "concern")}).alias("g"), themes.history_key(F.lit(" mine ")).alias("h")).first()
    assert (r.q, r.s, r.r, r.g) == ("k1 k2", "o / g / w / 懸念: c", "k1 k2|k1|f g", "o g w p q c") and len(r.h) == 16
    cut = spark.createDataFrame([("Structure here", "Body one. " + "x" * 40)], "s string, p string").select(themes.semantic_text(F.col("s"), F.col("p"), chars=40).alias("t")).first()
    assert cut.t == "Structure here Body one."


def test_documents_without_an_external_model(spark):
    from orrery import pipelines

    works = spark.createDataFrame([(i, i % 5, float(100 - i), f"title {i}", "One. Two.") for i in range(40)], "id long, field int, cites double, title string, abstract string")
    refs = spark.createDataFrame([(i, j) for i in range(40) for j in range(6) if (i + j) % 3 == 0], "id long, ref long")
    overlap = works.select("id", F.lit(1).alias("inter"), F.lit(4).alias("union_n"), (F.col("id") % 2 == 0).alias("near"))
    got = pipelines.bridge_document(works, refs, works.where("id < 6"), overlap, count=3, concern="c").orderBy("pos").collect()
    assert len(got) == 3 and all(r.id % 2 for r in got) and got[0].distance == 0.75 and got[0].summary.endswith("One. Two.") and "不安点" in got[0].caution
    cols = "id string, purpose_sim double, mechanism_dist double, structural_depth double, has_causal_pm boolean, near boolean, purpose_pct int, relationship string, serendipity_rationale string, summary string, caution string, theme_quote string, source_quote string, title string, abstract string, year int, venue string, cited_by_count int, concepts array<string>, facet string"
    prose = ("claim", "why", "short", "careful")
    rows = [("x", 0.45, 0.9, 0.8, False, False, 80, *prose, "long enough quote", "another source quote", "t", "Another source quote. More.", 1999, "", 3, ["A"], "f"), ("bad", 0.45, 0.9, 0.8, True, False, 80, *prose, "not in the theme at all", "x", "t", "Other. More.", 1999, "v", None, ["B"], "f"), ("only", 0.1, 0.9, 0.9, True, False, 10, None, None, None, None, None, None, None, None, None, None, None, None, None)]
    entries, log, report = pipelines.delegated_document(spark.createDataFrame(rows, cols), "a LONG enough quote", count=2)
    by = {r.id: r for r in entries.collect()}
    assert by["x"].relationship == "claim" and by["x"].hypothesis == "why" and by["x"].caution.endswith("careful") and "ゆるめ" in by["x"].label
    assert by["bad"].relationship.startswith("（記入なし）") and by["bad"].summary.startswith("（記入なし）原文の冒頭") and by["bad"].hypothesis == "（記入なし）"
    assert {(r.id, r.what, tuple(r.fields)) for r in report.collect()} == {("x", "upstream_empty", ("venue",)), ("bad", "missing", ("cited_by_count",)), ("only", "score_only", ())}
    assert {r.id for r in log.collect()} == {"only"}


def test_repositories_from_search_to_rank(spark):
    import json

    from orrery import pipelines

    repo = lambda name, stars, pushed: json.dumps({"full_name": name, "html_url": f"https://h.org/{name}", "owner": {"login": "o"}, "description": "drift tool" if stars > 50 else "other", "stargazers_count": stars, "forks_count": 5, "pushed_at": pushed, "updated_at": pushed, "license": {"spdx_id": "MIT"}, "topics": []})
    found = spark.createDataFrame([(0, i, repo(f"o/r{i}", 100 - i * 30, f"2024-0{i + 1}-01")) for i in range(4)] + [(1, 0, repo("o/r0", 100, "2024-01-01")), (1, 1, repo("o/k", 60, "2024-05-01"))], "leg int, pos int, payload string")
    signals = {"issues": spark.createDataFrame([("o/r0", "o", 0, "closed", "b", "x", ["bug"], False)], "repo string, owner string, pos int, state string, body string, login string, labels array<string>, is_pr boolean"), "releases": spark.createDataFrame([("o/r0", "2024-01-01")], "repo string, published_at string"), "runs": spark.createDataFrame([("o/k", "success")], "repo string, conclusion string"), "contributors": spark.createDataFrame([("o/k", "x"), ("o/k", "o")], "repo string, login string")}
    readmes = spark.createDataFrame([("o/r0", "install usage ``` a ``` ``` b ``` ``` c ```")], "full_name string, readme string")
    got = pipelines.collect_repositories(found, signals, readmes, include=["drift"], as_of=F.lit("2024-06-01").cast("date"), turns=(1, 1), limit=4, count=4).collect()
    assert len(got) == 4 and len({r.id for r in got}) == 4 and {"https://h.org/o/r0", "https://h.org/o/k"} <= {r.id for r in got}
    assert [r.relevance > 0 for r in got] == sorted((r.relevance > 0 for r in got), reverse=True) and got[0].relevance > 0


def test_facets_are_rejected_or_shared_out(spark):
    from orrery import pipelines

    rows = [(f, p, f * 100 + p, f == 2 and p < 9, True, False, f == 1 and p == 0, p != 1, f"t{p % 9}" if f == 3 else f"{f}-{p}", p) for f in (1, 2, 3) for p in range(10)]
    returned = spark.createDataFrame(rows, "facet int, pos int, id int, home boolean, type_ok boolean, retracted boolean, supplement boolean, has_abstract boolean, tk string, standing int")
    chosen, counts = pipelines.collect_facets(returned, spark.createDataFrame([(102,)], "id int"), ["tk"], limit=6)
    assert {r.facet: (r.status, r.kept, r.selected, r.supplement_excluded) for r in counts.collect()} == {1: ("ok", 7, 3, 1), 2: ("home_converged", 0, 0, 0), 3: ("ok", 8, 3, 0)}
    assert [r.id for r in chosen.orderBy("place").collect()][:2] == [103, 309]  # the better record of a key takes the first one's place
