"""Queries that must return every row of their job: small tables that hold what the driver tables lack."""

import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from orrery.plans import catalog
from orrery.sources import parse

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def stored(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


def test_anchor_rank_places_every_supplier(spark, tmp_path):
    import duckdb

    sf = stored(spark, tmp_path, "supplier", [(i,) for i in range(1, 4001)], "s_suppkey long")
    got = sorted(tuple(r) for r in catalog.anchor_rank(spark, sf).select("id", "score_e4", "level", "place").collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE supplier AS SELECT range AS s_suppkey FROM range(1, 4001)")
    whole = catalog.ORACLE_SQL["anchor_rank"].removesuffix(" ORDER BY place LIMIT 100")  # the registered SQL stops at 100
    assert got == sorted(con.execute(f"SELECT id, score_e4, level, place FROM ({whole})").fetchall())
    assert len(got) == 4000


def test_rejection_log_has_all_four_stages(spark, tmp_path):
    import duckdb

    keys = [i for i in range(1, 3000) if (i * 37 % 100) * (i * 53 % 100) < 4500]  # few high products: the gate is below the output floor
    sf = stored(spark, tmp_path, "orders", [(i,) for i in keys], "o_orderkey long")
    got = sorted((r.id, r.floor, int(r.value * 1e6 + 0.5), int(r.threshold * 1e6 + 0.5)) for r in catalog.rejection_log(spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{sf}/orders.parquet/*.parquet')")
    want = con.execute(catalog.GATE_SQL + """SELECT id, rejected_by, CAST(floor(1e6 * CASE rejected_by WHEN 'anomaly' THEN ps WHEN 'hollow' THEN depth ELSE ser END + 0.5) AS BIGINT),
        CAST(floor(1e6 * CASE rejected_by WHEN 'anomaly' THEN 0.2 WHEN 'hollow' THEN 0.5 WHEN 'percentile_gate' THEN gate ELSE 0.35 END + 0.5) AS BIGINT) FROM r WHERE rejected_by IS NOT NULL""").fetchall()
    assert got == sorted(want)
    assert {r[1] for r in got} == {"anomaly", "hollow", "percentile_gate", "output_floor"}


def test_non_latin_share_of_every_document(spark, tmp_path):
    texts = {1: "plain words", 2: "мир и peace", 3: "日本語 abc", 4: "12345 --- !!!", 5: "", 6: None, 7: "größe Ǆ ɐ"}
    sf = stored(spark, tmp_path, "documents", [(i, t, "en", "s", 1) for i, t in texts.items()], DOCS)
    got = {r.id: (r.letters, r.non_latin) for r in catalog.non_latin_share(spark, sf).collect()}
    assert got == {i: (sum(c.isalpha() for c in t or ""), sum(c.isalpha() and ord(c) > 0x24F for c in t or "")) for i, t in texts.items()}
    assert got[2] == (9, 4) and got[4] == got[6] == (0, 0)


def test_duplicate_components_chain_across_keys(spark, tmp_path):
    long = {c: c * 3 + " " + " ".join(f"{c}{i}" for i in range(90)) for c in "xyz"}
    # one chain: 1 and 2 by title, 2 and 3 by abstract key (a label before it), 3 and 4 by title; 5 and 6 by title only
    texts = {1: "Abstract\n" + long["x"], 2: "ABSTRACT\n" + long["y"], 3: long["y"] + "\n", 4: long["y"] + "\n" + long["z"], 5: "Short title\none", 6: "short  TITLE!\ntwo", 7: "\nno title", 8: "\nnor here"}
    sf = stored(spark, tmp_path, "documents", [(i, t, "en", "s", 1) for i, t in texts.items()], DOCS)
    got = {r.id: r.grp for r in catalog.duplicate_components(spark, sf).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7, 8: 8}


def test_multi_key_first_wins_is_the_sequential_rule(spark, tmp_path):
    """Against one pass over the whole table in order: keys in other case, behind a label, in other languages."""
    import random

    from orrery.functions import text as T

    rng = random.Random(11)
    bodies = [" ".join(f"{c}{i}" for i in range(90)) for c in "abcdefgh"]
    rows = []
    for i in range(300):
        title = rng.choice(["", *(f"title number {n} of them" for n in range(60))])
        title = rng.choice([title, title.upper(), title.title()])
        body = rng.choice([f"own {i}", f"own {i}", f"own {i}", *bodies])
        text = rng.choice(["", "", "Abstract: "]) + (title + "\n" + body if rng.random() < 0.8 else body)
        rows.append((i, text, rng.choice(["en", "de"]), "s", rng.randint(1, 9)))
    rows += [(300 + i, rows[7][1], "fr", "s", rng.randint(1, 9)) for i in range(40)]
    sf = stored(spark, tmp_path, "documents", rows, DOCS)
    keyed = spark.createDataFrame(rows, DOCS).select("doc_id", "n_chars", T.title_match_key(F.split_part("text", F.lit("\n"), F.lit(1))), T.abstract_key(F.col("text")))
    slots, seen = [], ({}, {})
    for i, standing, *keys in sorted(map(tuple, keyed.collect())):
        at = next((s[k] for s, k in zip(seen, keys, strict=True) if k and k in s), None)
        if at is None:
            at = len(slots)
            slots.append((standing, i))
        elif standing > slots[at][0]:
            slots[at] = (standing, i)
        else:
            continue
        for s, k in zip(seen, keys, strict=True):
            if k:
                s.setdefault(k, at)
    got = catalog.multi_key_first_wins(spark, sf).collect()
    assert sorted(r.id for r in got) == sorted(i for _, i in slots)
    assert len({(r.theme, r.slot) for r in got}) == len(got)


def test_restored_texts_stay_in_their_rows(spark, tmp_path):
    """Null texts, rows without an id and rows that share one are all there, and nothing is shuffled for the index."""
    rng = random.Random(8)
    texts = [None, "", " ", "  a  a ", "a", "b a b\na b", "é e é É", " ".join(rng.choice(["x", "y", "", "zé", "\t"]) for _ in range(3000)), " ".join(map(str, range(3000)))]
    rows = [(i // 2 if i else None, t, "en", "web", 0) for i, t in enumerate(texts + texts)]
    got = catalog.inverted_index_restore(spark, stored(spark, tmp_path, "documents", rows, DOCS))
    assert sorted(map(repr, got.collect())) == sorted(repr(Row(id=r[0], restored=r[1])) for r in rows)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_index_holds_every_place_of_every_word(spark):
    texts = ["the end of the day of", "", " a", "one", None, "w " * 50]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(parse.inverted_index(F.col("text")).alias("index")).collect()]
    assert got == [None if t is None else {w: [i for i, x in enumerate(t.split(" ")) if x == w] for w in t.split(" ")} for t in texts]
