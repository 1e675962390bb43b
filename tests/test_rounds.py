"""Order-dependent operators in rounds over whole tables, against the pass in order."""

import collections
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import dedup, diversify, graph, rank, themes


def in_order(rows):
    """(theme, pos, keys) kept by the pass in order."""
    held, kept = set(), []
    for t, p, ks in sorted(rows):
        own = {(t, i, k) for i, k in enumerate(ks) if k}
        if held.isdisjoint(own):
            held |= own
            kept.append((t, p))
    return kept


@pytest.mark.parametrize("tail", [0, 20, 10**6])
def test_first_of_all_keys_equals_the_pass(spark, tail):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), p, (rng.choice(["", None, *"uvwxyz"]), str(rng.randint(0, 150)), rng.choice(["", str(rng.randint(0, 40))]))) for p in range(400)]
    rows += [("c", 400 + i, (f"n{i}", f"n{i + 1}", "")) for i in range(8)] + [("d", 500 + i, ("hot", "", f"u{i}")) for i in range(200)]
    df = spark.createDataFrame([(t, p, *ks) for t, p, ks in rows], "theme string, pos long, x string, y string, z string").repartition(5)
    got = dedup.first_of_all_keys(df, ["x", "y", "z"], theme="theme", tail=tail).collect()
    assert sorted((r.theme, r.pos) for r in got) == in_order(rows)


def test_first_of_all_keys_over_one_large_component(spark):
    """100,000 rows that hang together: what rounds leave, a pass ends; a chain in order is one that rounds alone would not end."""
    n = 100_000
    rng = random.Random(5)
    rows = [(None, p, (f"a{rng.randint(0, n // 3)}", f"b{rng.randint(0, n // 3)}")) for p in range(n)]
    df = spark.createDataFrame([(p, *ks) for _, p, ks in rows], "pos long, x string, y string")
    got = sorted(r.pos for r in dedup.first_of_all_keys(df, ["x", "y"], tail=20_000).select("pos").collect())
    assert got == [p for _, p in in_order([("", p, ks) for _, p, ks in rows])]
    chain = spark.range(n).select(F.col("id").alias("pos"), F.concat(F.lit("l"), "id").alias("x"), F.concat(F.lit("l"), (F.col("id") + 1)).alias("y"))
    links = chain.select("pos", F.when(F.col("pos") % 2 == 0, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(F.col("pos") % 2 == 0, F.col("x")).otherwise(F.col("y")).alias("y"))
    assert dedup.first_of_all_keys(links, ["x", "y"]).count() == n // 2


def test_lexical_baseline_keeps_what_a_dropped_record_would_have_removed(spark):
    rows = [("q", 0, "a", "x"), ("q", 1, "b", "x"), ("q", 2, "b", "y")]
    found = spark.createDataFrame(rows, "query string, pos long, id string, doi string").withColumn("abstract", F.lit("text"))
    got = themes.lexical_baseline(found, ["doi"], per_query=5, limit=9).orderBy("place").collect()
    assert [(r.place, r.id, r.doi) for r in got] == [(1, "a", "x"), (2, "b", "y")]


def baseline_in_order(rows, per_query, limit, per_page):
    out = []
    for theme in sorted({r[0] for r in rows}):
        seen, works = set(), []
        for q in sorted({r[1] for r in rows if r[0] == theme}):
            count, mine = 0, sorted(r for r in rows if r[:2] == (theme, q))
            for page in range(1 + max(r[2] for r in mine) // per_page):
                for _, _, pos, i, tk, dk, abstract in mine:
                    own = {("id", i), *([("t", tk)] if tk else []), *([("d", dk)] if dk else [])}
                    if pos // per_page == page and abstract and seen.isdisjoint(own):
                        seen |= own
                        works.append((theme, q, pos, i))
                        count += 1
                if count >= per_query:
                    break
            if len(works) >= limit:
                break
        out += [(*w, n) for n, w in enumerate(works[:limit], 1)]
    return out


@pytest.mark.parametrize("per_query,limit", [(5, 1000), (12, 40), (1000, 1000)])
def test_lexical_baseline_equals_the_pass(spark, per_query, limit):
    rng = random.Random(per_query)
    rows = []
    for theme in range(4):
        for q in range(4):
            rows += [(theme, q, p, f"w{rng.randint(0, 150)}", rng.choice(["", f"t{rng.randint(0, 60)}"]), rng.choice(["", None, f"d{rng.randint(0, 60)}"]), rng.choice(["text", "text", " ", None])) for p in range(40)]
    rows = [(*r[:6], (r[6] or "").strip() or None) for r in rows]
    found = spark.createDataFrame(rows, "theme int, query int, pos int, id string, tk string, dk string, abstract string").repartition(3)
    got = themes.lexical_baseline(found, ["tk", "dk"], per_query=per_query, limit=limit, theme="theme", per_page=10).collect()
    assert sorted((r.theme, r["query"], r.pos, r.id, r.place) for r in got) == sorted(baseline_in_order(rows, per_query, limit, 10))


def test_places_number_every_row(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 5), rng.choice([None, rng.random()])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, kind int, v double").repartition(7)
    got = rank.places(df, F.col("kind").desc(), F.col("v").asc_nulls_last(), F.col("id").asc()).collect()
    want = sorted(rows, key=lambda r: (-r[1], r[2] is None, r[2] or 0, r[0]))
    assert [r.id for r in sorted(got, key=lambda r: r.place)] == [r[0] for r in want] and sorted(r.place for r in got) == list(range(1, 3001))


def test_farthest_first_rounds_equal_the_list(spark):
    rng = random.Random(8)
    rows = [(t, p, f"{t}{p}", [rng.choice("abcdefghij") for _ in range(rng.randint(0, 5))] if rng.random() < 0.9 else None) for t, n in (("x", 60), ("y", 7), ("z", 12), ("one", 1)) for p in rng.sample(range(500), n)]
    df = spark.createDataFrame(rows, "theme string, pos int, id string, names array<string>").repartition(4)
    for k in (1, 12):
        want = {(r.theme, r.slot, r.id) for r in diversify.farthest_first(df, k).collect()}
        got = diversify.farthest_first_rounds(df, k)
        assert {(r.theme, r.slot, r.id) for r in got.collect()} == want and "Python" not in got._jdf.queryExecution().toString()


def shares_in_turn(pages, spare, quota, limit):
    got = {}
    for turn in sorted({r[0] for r in pages}):
        taken = 0
        for _, _, _, i in sorted(r for r in pages if r[0] == turn):
            if taken >= quota or len(got) >= limit:
                break
            if i not in got:
                got[i] = turn
                taken += 1
    for _, i in sorted(spare):
        if len(got) >= limit:
            break
        got.setdefault(i, None)
    return [(slot, i, b) for slot, (i, b) in enumerate(got.items())]


def test_fair_shares_of_a_thousand_themes(spark):
    rng = random.Random(2)
    pages, spare, want = [], [], []
    for theme in range(1000):
        mine = [(turn, rng.randint(0, 2), pos, i) for turn in range(rng.randint(0, 6)) for pos, i in enumerate(rng.sample(range(15), rng.randint(0, 8)))]
        rest = list(enumerate(rng.sample(range(25), rng.randint(0, 12))))
        pages += [(theme, *r) for r in mine]
        spare += [(theme, *r) for r in rest]
        want += [(theme, *r) for r in shares_in_turn(mine, rest, 2, 9)]
    got = diversify.fair_shares(spark.createDataFrame(pages, "theme int, turn int, kind int, pos int, id int"), spark.createDataFrame(spare, "theme int, pos int, id int"), quota=2, limit=9)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_bridge_quotas_equal_the_list(spark):
    rng = random.Random(3)
    rows = [(t, b, pos, i) for t in range(40) for b in range(rng.randint(1, 6)) for pos, i in enumerate(rng.sample(range(12), rng.randint(0, 9)))]
    df = spark.createDataFrame(rows, "theme int, bridge_pos int, pos int, id int").repartition(3)
    for quota, limit in ((1, 100), (3, 7)):
        assert sorted(map(tuple, diversify.bridge_quotas(df, per_bridge=quota, limit=limit).collect())) == sorted(map(tuple, diversify.bridge_quota(df, per_bridge=quota, limit=limit).collect()))


def test_equal_reference_lists_are_one_node(spark):
    """10,000 equal lists give 9,999 edges, and one more to a list nearly the same."""
    same = spark.range(10_000).select(F.format_string("W%05d", "id").alias("id"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: i.cast("string"))).alias("ref"))
    near = spark.range(1).select(F.lit("X").alias("id"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(21)), lambda i: i.cast("string"))).alias("ref"))
    got = graph.shared_reference_pairs(same.unionByName(near)).collect()
    assert len(got) == 10_000 and {r.a for r in got} == {"W00000"} and len({r.b for r in got}) == 10_000


def test_components_are_finished_or_refused(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    nodes = spark.range(303).toDF("id")
    got = {r.id: r.grp for r in dedup.duplicate_groups(nodes, edges).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 301: 301, 302: 302}
    with pytest.raises(RuntimeError):
        dedup.duplicate_groups(nodes, edges, max_rounds=2)


def test_test_files_have_names_of_their_own():
    names = collections.Counter(os.path.basename(f) for f in glob.glob(os.path.join(os.path.dirname(__file__), "**", "test_*.py"), recursive=True))
    assert max(names.values()) == 1
