"""Operators and stages over repeated ids, short items and repeated rows against brute force."""


def test_pipeline_near_duplicates_by_id_and_text(spark):
    import corpus_pipeline as p

    a, b, c = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(1, a), (7, a), (7, b), (None, a), (None, c), (9, c), (3, "own text"), (3, "own text")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = p.drop_near_duplicates(spark, docs, "").select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == [(1, a), (3, "own text"), (7, b), (9, c)]


def test_decontamination_meets_every_allowed_substitution(spark):
    """Items of 5 to 12 words, each set of substituted places once: found up to the share, not beyond."""
    from itertools import combinations

    from orrery.llm import decontam

    items, docs, want = [], [], set()
    for w in range(5, 13):
        words = [f"w{w}x{i}" for i in range(w)]
        items.append((w, " ".join(words)))
        allowed = w - -(-4 * w // 5)
        for n in range(allowed + 2):
            for off in combinations(range(w), n):
                if n <= allowed:
                    want.add((len(docs), w))
                docs.append((len(docs), "before it " + " ".join("zz" if i in off else x for i, x in enumerate(words)) + " behind"))
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)
    got = decontam.contaminated(d, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert len(want) == sum(1 + w for w in range(5, 10)) + sum(w * (w - 1) // 2 + w + 1 for w in (10, 11, 12))


def test_suffix_dedup_of_repeated_rows(spark, monkeypatch):
    """Rows that repeat id and text around passages of earlier documents, against brute force, in whatever order a table is read."""
    import hashlib
    import random

    from orrery.llm import suffix_dedup

    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    rows = []
    for i in range(25):
        shared = text(rng.randint(120, 400))
        rows.append((i, text(150) + shared + text(150)))
        rows += [(100 + i, text(150) + shared + text(150))] * 3
    seen: dict[str, tuple] = {}
    for d, t in sorted(set(rows)):
        for j in range(len(t) - 99):
            seen.setdefault(t[j : j + 100], (d, j))
    want = []
    for d, t in rows:
        gone = bytearray(len(t))
        for j in range(len(t) - 99):
            if seen[t[j : j + 100]] < (d, j):
                gone[j : j + 100] = b"\1" * 100
        want.append((d, sum(gone), hashlib.sha256("".join(c for c, g in zip(t, gone, strict=True) if not g).encode()).hexdigest()))
    real = suffix_dedup.materialize
    least_first = lambda df, *, what="", files=None: real(df.orderBy("n_removed").coalesce(1), what=what) if what == "done" else real(df, what=what, files=files)
    monkeypatch.setattr(suffix_dedup, "materialize", least_first)
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffix_dedup.suffix_dedup(docs).select("doc_id", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
