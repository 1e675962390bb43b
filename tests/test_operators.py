"""Golden cases of the discovery operators on literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from orrery.functions import scores as S
from orrery.functions import text as T
from orrery.operators import contract, dedup, diversify, gates, graph, history, rank, stats
from orrery.sources import parse

SCORE = "id string, purpose_sim double, mechanism_dist double, structural_depth double, has_causal_pm boolean, near boolean"


def one(spark, col, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} string" for k in values) or "x int")
    return row.select(col.alias("v")).first().v


@pytest.fixture(scope="module")
def refs(spark):
    rows = [("A", "B1"), ("A", "B2"), ("A", "X"), ("B", "B1"), ("C", "B2")]
    return spark.createDataFrame(rows, "id string, ref string")


def test_bridge_signals(spark, refs):
    works = spark.createDataFrame([("A", 17, 5.0), ("B", 13, 9.0), ("C", None, 1.0), ("D", 1, 2.0)], "id string, field int, cites double")
    pool = spark.createDataFrame([("B1", 3), ("B2", 2), ("B3", 1)], "ref string, seed_citers int")
    got = {r.id: (r.shared_bridge_count, r.bridge_betweenness, r.bridge_strength) for r in graph.bridge_signals(works, graph.hits(works, refs, pool), pool).collect()}
    assert got == {"A": (2, 2, 3), "B": (1, 2, 3), "C": (1, 1, 2), "D": (0, 0, 0)}
    usage = {r.ref: (r.seed_citers, r.cand_citers) for r in graph.bridge_usage(pool, graph.hits(works.where("id = 'A'"), refs, pool), graph.hits(works, refs, pool)).collect()}
    assert usage == {"B1": (1, 2), "B2": (1, 2), "B3": (0, 0)}


def test_pool_takes_shared_references_first(spark):
    rows = [(0, 0, "W100", 0), (0, 0, "W101", 1), (0, 0, "W102", 2), (0, 1, "W100", 3), (0, 1, "W200", 4)]
    got = diversify.pool_three_tiers(spark.createDataFrame(rows, "theme int, grp int, ref string, pos int"), cap=3, share=1).orderBy("slot").collect()
    assert [r.ref for r in got] == ["W100", "W101", "W200"]


def test_duplicate_reference_lists(spark):
    rows = [("a", f"r{i}") for i in range(20)] + [("b", f"r{i}") for i in range(19)] + [("c", f"r{i}") for i in range(12)] + [("d", "r1")]
    got = graph.shared_reference_pairs(spark.createDataFrame(rows, "id string, ref string")).collect()
    assert [(r.a, r.b) for r in got] == [("a", "b")]


def test_post_gates(spark):
    rows = [("pass", 0.7, 0.8, 0.8, True, False), ("low", 0.1, 0.9, 0.9, True, False), ("flat", 0.7, 0.8, 0.2, True, False), ("near", 0.7, 0.9, 0.8, None, True), ("loose", 0.8, 0.7, None, False, False)]
    got = {r.id: r for r in gates.post_gates(spark.createDataFrame(rows, SCORE)).collect()}
    assert got["pass"].serendipity == pytest.approx(0.56) and got["pass"].rejected_by is None
    assert got["low"].rejected_by == "anomaly" and got["flat"].rejected_by == "hollow"
    assert got["near"].mech == 0.5 and got["near"].serendipity == pytest.approx(0.35) and got["near"].near_but_useful
    assert got["loose"].purpose_used == 0.45 and got["loose"].serendipity == pytest.approx(0.45 * 0.7)


def test_fallback_and_saturation(spark):
    gated = gates.post_gates(spark.createDataFrame([("x", 0.5, 0.4, 0.9, True, False), ("y", 0.5, 0.1, 0.9, True, False)], SCORE))
    assert [r.id for r in gates.with_fallback(gated).collect()] == ["x"]
    assert gates.saturation(gated).first().status == "no_qualified"
    assert gates.saturation(gated.where("false")).first().status == "no_candidates"


def test_percentile_gate_takes_the_rank(spark):
    rows = [(str(i), 0.05 * i) for i in range(1, 11)]
    got = gates.percentile_gate(spark.createDataFrame(rows, "id string, v double"), "v").first().gate
    assert got == pytest.approx(0.40)


def test_structured_query(spark):
    works = spark.createDataFrame([("1", "Deep nets", "x", "17", "T1", ["C1"], ["W1"], 2000, "article"), ("2", "Other", "deep", None, None, [], [], 2001, "article"), ("3", "Deep sea", "", "18", "T2", ["C2"], [], 1990, "book")], "id string, title string, abstract string, field_id string, topic_id string, concept_ids array<string>, refs array<string>, year int, type string")
    ids = lambda q: [r.id for r in q.apply(works).orderBy("id").collect()]
    assert ids(gates.StructuredQuery(anchor_terms=("deep",))) == ["1", "2", "3"]
    assert ids(gates.StructuredQuery(exclude_field_ids=("17",))) == ["2", "3"]
    assert ids(gates.StructuredQuery(cites=("W1", "W9"), year_from=1999)) == ["1"]
    assert ids(gates.StructuredQuery(max_refs=1)) == ["2", "3"]
    q = gates.StructuredQuery(anchor_terms=("a|b",), field_ids=("17",), year_from=2000, year_to=2001, work_type="article")
    assert q.filter_text() == "title_and_abstract.search:a b,primary_topic.field.id:17,publication_year:2000-2001,type:article"
    assert q.fallback().field_ids == ("17",) and gates.StructuredQuery().is_empty()
    assert [r.id for r in gates.first_rung(works.withColumn("pos", F.col("id").cast("int")), gates.relaxation_ladder(["deep", "nets"], "other", gates.StructuredQuery()), limit=9).collect()] == ["1", "2", "3"]


@pytest.mark.parametrize(
    ("title", "key"),
    [("A&amp;B: x!", "a b"), ("On imperfect information in games. Working paper", "on imperfect information in games"), ("On stuttering chains of things. Part II", "on stuttering chains of things part ii"), (None, "")],
)
def test_title_match_key(spark, title, key):
    assert one(spark, T.title_match_key(F.col("t")), t=title) == key


def test_text_keys(spark):
    assert one(spark, T.doi_key(F.col("t")), t=" https://DOI.org/10.1/X ") == "10.1/x"
    assert one(spark, T.doi_key(F.col("t")), t="http://dx.doi.org/10.1/x") == "http://dx.doi.org/10.1/x"
    assert len(one(spark, T.abstract_key(F.col("t")), t="Abstract: " + "word " * 60)) == 200
    assert one(spark, T.abstract_key(F.col("t")), t="short") == ""
    assert one(spark, T.phrase_count(T.padded(F.col("t")), F.lit(" a ")), t="a a a") == 2
    assert one(spark, T.short_id(F.col("t")), t="https://openalex.org/W12") == "W12"
    assert one(spark, T.clean_query(F.col("t")), t='"graphs x music × art"') == "graphs music art"
    assert one(spark, T.unsupported_numbers(F.col("a"), F.col("b")), a="3,5 of 7", b="7 days") == ["3.5"]
    assert one(spark, T.is_supplement_title(F.col("t")), t="Additional file 3: of Something") is True
    assert one(spark, T.is_supplement_title(F.col("t")), t="Tables of critical values") is False
    assert one(spark, T.cap_at_sentence(F.col("t"), 20), t="One two three. Four five six.") == "One two three."


def test_keyword_fit(spark):
    fit = T.keyword_fit(F.col("s"), F.col("b"), ["trend following", "cuped"], ["cups"], scale=30)
    got = one(spark, fit, s="Trend-following kit", b="cuped " + "x" * 995)
    assert got.credit_e6 == 2_000_000 and got.score == 30 and got.matched == ["trend following", "cuped"]
    got = one(spark, fit, s="cups", b="")
    assert got.score == 0 and got.exclude_hits == 1


def test_tiers(spark):
    assert one(spark, S.hub_adoption(F.lit(12_000), F.lit(55))) == 28
    assert one(spark, S.maintenance(F.lit(900), F.lit(300), F.lit(0), F.lit(1), F.lit(4))) == 15
    assert one(spark, S.maintenance(F.lit(None).cast("int"), F.lit(300), F.lit(0), F.lit(1), F.lit(4))) == 0
    assert one(spark, S.code_blocks(F.col("t")), t="```a``` ```b``` ```c```") == 10
    assert one(spark, S.readme_completeness(F.col("t")), t="Install. Usage. Why not? Roadmap.") == 18
    assert one(spark, S.anchor_score(F.lit(80), F.lit(1.0))) == pytest.approx(80.0)


def test_anchor_order_prefers_matches(spark):
    a = spark.createDataFrame([("first", 86, 0), ("second", 83, 10)], "id string, reliability int, fit int")
    a = a.withColumn("relevance", S.relevance(F.col("fit"), 30)).withColumn("anchor_rank_score", S.anchor_score(F.col("reliability"), F.col("relevance")))
    assert [r.id for r in a.orderBy(*rank.anchor_order()).collect()] == ["second", "first"]


def test_hybrid_without_signal_is_zero(spark):
    rows = spark.createDataFrame([("a", 0, 5.0), ("b", 0, 9.0)], "id string, strength int, cites double")
    assert {r.hybrid for r in rank.hybrid_score(rows, ["strength"], "cites").collect()} == {0.0}


def test_greedy_selections(spark):
    rows = [(0, 0, "W0", ["A", "B"], 0.9, "f"), (0, 1, "dup1", ["A", "B"], 0.8, "f"), (0, 2, "far", ["X", "Y"], 0.5, "g"), (0, 3, "dup2", ["A", "B"], 0.7, "f")]
    d = spark.createDataFrame(rows, "theme int, pos int, id string, names array<string>, score double, facet string")
    pick = lambda f: [r.id for r in f.orderBy("slot").collect()]
    assert pick(diversify.farthest_first(d, 3)) == ["W0", "far", "dup1"]
    assert pick(diversify.mmr(d, 3)) == ["W0", "far", "dup1"]
    assert pick(diversify.head_window(d.withColumnRenamed("names", "bridges"), window=3)) == ["W0", "dup1", "far", "dup2"]


def test_sequential_dedupe_and_upgrade(spark):
    rows = [(0, 0, "A", "t1", "d1", 0), (0, 1, "B", "t2", "d1", 0), (0, 2, "C", "t2", "d3", 0), (0, 3, "D", "t1", "", 5)]
    d = spark.createDataFrame(rows, "theme int, pos int, id string, t string, d string, standing int")
    got = [r.id for r in diversify.keep_first_of_keys(d, ["t", "d"]).orderBy("slot").collect()]
    assert got == ["D", "C"]


def test_interleave_and_merge(spark):
    rows = [("a", 0, "1"), ("a", 1, "2"), ("a", 2, "3"), ("b", 0, "4")]
    got = rank.interleave(spark.createDataFrame(rows, "bucket string, pos int, id string"), "bucket", "pos", limit=3)
    assert [r.id for r in got.orderBy("turn", "bucket").collect()] == ["1", "4", "2"]


def test_components_follow_chains(spark):
    nodes = spark.range(12)
    edges = spark.createDataFrame([(i, i + 1) for i in range(7)] + [(9, 10)], "a long, b long")
    got = {r.id: r.grp for r in dedup.duplicate_groups(nodes, edges).collect()}
    assert got == {**dict.fromkeys(range(8), 0), 8: 8, 9: 9, 10: 9, 11: 11}


def test_salient_terms(spark):
    docs = spark.createDataFrame([(1, "influence cascade diffusion"), (2, "cascade influence"), (3, "cascade diffusion other")], "id int, text string")
    assert [r.term for r in stats.salient_terms(docs, known=["diffusion"]).collect()] == ["cascade", "influence"]


def test_restore_abstract(spark):
    raw = '{"id":"https://openalex.org/W5","title":"WITHDRAWN: x","abstract_inverted_index":{"hello":[0,3],"world":[1],"late":[1,5]},"referenced_works":["W1",null],"authorships":[{"institutions":[{"display_name":"U"},{"display_name":"U"}]}],"primary_topic":{"id":"https://x/T9","field":{"id":"https://x/17"}}}'
    got = parse.normalize_works(spark.createDataFrame([(raw,), ("nonsense",)], "payload string")).collect()
    assert (got[0].abstract, got[0].id, got[0].is_retracted, got[0].refs, got[0].affiliations) == ("hello world  hello  late", "W5", True, ["W1"], ["U"])
    assert (got[0].topic_id, got[0].field_id, got[0].subfield_id) == ("T9", "17", None)
    assert (got[1].id, got[1].abstract, got[1].year, got[1].concepts) == ("", "", 0, [])


def test_restored_places_of_any_index(spark):
    """Against the plain loop: gaps, places of several words, words without a place."""
    rng = random.Random(3)
    maps = [None, {}, {"a": []}, {"a": [5]}, {"": [0, 2]}, {" ": [1], "x y": [0]}] + [{w: [rng.randint(0, 20) for _ in range(rng.randint(0, 5))] for w in rng.sample(["a", "b", "", "é", " ", "zz"], rng.randint(0, 5))} for _ in range(100)]

    def plain(entries):
        at = {}
        for word, places in entries or []:
            for p in places:
                at.setdefault(p, word)
        return " ".join(at.get(i, "") for i in range(max(at, default=-1) + 1))

    got = spark.createDataFrame([(m,) for m in maps], "m map<string,array<int>>").select(F.map_entries("m").alias("m"), parse.restore_abstract(F.col("m")).alias("v")).collect()
    assert [r.v for r in got] == [plain(r.m) for r in got] and [r.m if r.m is None else {w: p for w, p in r.m} for r in got] == maps


def test_markup_and_readme(spark):
    assert one(spark, parse.html_text(F.col("t")), t="<p>a &amp; b</p><script>x<y</script><b>c</b>") == "a & b c"
    assert one(spark, parse.decode_readme(F.col("t")), t="aGVs\nbG8=") == "hello"
    assert one(spark, parse.decode_readme(F.col("t")), t="%%%") == ""
    assert one(spark, parse.clean_latex(F.col("t")), t="\\begin{document}A \\emph{b} $x^2$ c.%no\n\\cite{k}\\end{document}") == "A b c."
    assert one(spark, parse.strip_front_matter(F.col("t")), t="---\na: 1\n---\nbody") == "body"


def test_grounding(spark):
    cols = "relationship string, serendipity_rationale string, theme_quote string, source_quote string, title string, abstract string"
    rows = [("r", None, "a long theme quote", "source words here", "T", "some Source  words here"), ("r", None, "short", "source words here", "", None), (None, None, None, None, "", "")]
    got = [r.v for r in spark.createDataFrame(rows, cols).select(contract.grounding(F.lit("It is A LONG theme quote.")).alias("v")).collect()]
    assert got == [[], ["theme_missing", "source_unverifiable"], []]


def test_history_merge_and_exclusion(spark, tmp_path):
    cols = history.SCHEMA.replace("generated_at timestamp", "generated_at string")
    mk = lambda rows: spark.createDataFrame(rows, cols).withColumn("generated_at", F.col("generated_at").cast("timestamp"))
    merged = history.merge_history(mk([("t", "id", "a", 0, None), ("t", "id", "b", 1, None)]), mk([("t", "id", "b", 0, None), ("t", "id", "c", 1, None)]))
    path = str(tmp_path / "h")
    assert history.load_history(spark, path, "t").count() == 0
    history.save_history(merged, path)
    assert [(r.value, r.pos) for r in history.load_history(spark, path, "t").orderBy("pos").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    rows = spark.createDataFrame([("1", "x", ""), ("2", "y", "d"), ("3", "z", "")], "id string, tk string, dk string")
    used = spark.createDataFrame([("1", "z", "")], "a string, b string, c string")
    got = dedup.exclude_used(rows, used.select("a"), used.select("b"), used.select("c"), id_key="id", title_key="tk", doi_key="dk")
    assert [r.id for r in got.collect()] == ["2"]


def test_null_open_filters(spark):
    w = spark.createDataFrame([("a", "17", "en"), ("b", None, None), ("c", "3", "de")], "id string, f string, lang string")
    home = spark.createDataFrame([("17",)], "f string")
    assert sorted(r.id for r in gates.exclude_home(w, home, "f").collect()) == ["b", "c"]
    assert sorted(r.id for r in gates.keep_home(w, home, "f").collect()) == ["a", "b"]
    assert sorted(r.id for r in w.where(gates.language_matches(F.col("lang"), "EN")).collect()) == ["a", "b"]
    assert gates.fallback_if_empty(w.where("false"), w).count() == 3 and gates.fallback_if_empty(w.limit(1), w).count() == 1


def test_fulltext_chain_keeps_misses(spark):
    ids = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    a = spark.createDataFrame([("1", "a", "x"), ("2", "a", "")], "id string, source string, text string")
    b = spark.createDataFrame([("1", "b", "y"), ("2", "b", "z")], "id string, source string, text string")
    got = {r.id: (r.source, r.resolved) for r in parse.fulltext_chain(a, b, ids=ids).collect()}
    assert got == {"1": ("a", True), "2": ("b", True), "3": (None, False)}


def test_streamed_telemetry_equals_batch(spark, tmp_path):
    from orrery.streaming import telemetry

    e = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts, if(id % 2 = 0, 'a', 'b') AS event_type, double(id) AS value FROM range(50)")
    e.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = telemetry.windowed_rates(stream, window="10 minutes").writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in telemetry.windowed_rates(e, window="10 minutes").collect()}
    assert {tuple(r) for r in spark.table("rates").collect()} == want
