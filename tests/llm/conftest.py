import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, lang_pred string"


def words(rng, n, vocabulary=None):
    vocabulary = vocabulary or [a + b for a in ("ta", "re", "mo", "li", "su", "ke") for b in ("n", "rin", "vo", "sta", "mi")]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls everywhere, empty and very long texts, copies, near copies, repeated rows, clashing extra columns."""
    rng = random.Random(4)
    base = words(rng, 300)
    near = base.replace("tan", "tax", 1)
    out = [(i, words(rng, rng.randint(1, 120)), "en", "a", 1) for i in range(20)]
    out += [(20, None, "en", "a", None), (21, "", "en", None, 0), (22, "  \n\t", None, "a", 3), (23, base, "en", "a", 1), (24, base, "fr", "b", 1), (25, near, "en", "a", 1)]
    out += [(26, "one", "en", "a", 3), (27, "one", "en", "a", 3), (28, words(rng, 30000), "en", "a", 9), (29, "12345 --- !!!", "en", "a", 9), (23, base, "en", "a", 1), (None, base, "en", "a", 1), (None, "null id alone here", None, None, None)]
    out += [(30, "Über größe straße für übung schön " * 20, "de", "c", 7), (31, "Écouté déjà là où été forêt " * 20, "fr", "c", 7), (32, "日本語 текст 😀 ½ Ⅷ " * 9, "en", "c", 7), (33, "aaaa" * 900, "en", "c", 7), (34, words(rng, 50) + base[40:900] + words(rng, 9), "en", "c", 7)]
    return [(*r, 0.5, "k", "xx") for r in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3).persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
