"""Rows that once crashed an operator or made it quadratic."""

import base64
import random
import time

from orrery.llm import secrets, suffix_dedup


def token(header):
    return base64.urlsafe_b64encode(header.encode()).decode().rstrip("=") + ".payload.signature"


def test_deeply_nested_token_headers(spark):
    """A header 200,000 lists deep is no header and costs nobody else their spans; in the pipeline too."""
    import corpus_pipeline

    deep = token('{"a":' + "[" * 200_000 + "]" * 200_000 + ',"alg":"HS256"}')
    flat = token('{"typ":"JWT","alg":"HS256","x":[1,{"y":2}]}')
    rows = [(1, deep, "en", "a", 1), (2, f"see {flat} and password=hunter22", "en", "a", 1), (3, deep + " secret: abcdefgh", "en", "a", 1), (4, token("{" * 150), "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: [(s.kind, s.start) for s in r.spans] for r in secrets.find_secrets(docs, keep=["doc_id"]).collect()}
    assert got[2] == [("jwt", 4), ("assign", len(flat) + 9)]
    assert ("assign", len(deep) + 1) in got[3] and not any(k == "jwt" for i in (1, 3, 4) for k, _ in got[i])
    assert corpus_pipeline.mask_secrets(spark, docs, "").where("text = 'see [secret] and [secret]'").count() == 1


def test_many_key_blocks_in_one_text():
    """Thousands of key blocks: each found once, nothing inside them again, in linear time."""
    der = bytes([0x30, 27]) + b"\x02\x01\x00" * 9
    block = "-----BEGIN PRIVATE KEY-----\n" + base64.b64encode(der).decode() + "\n-----END PRIVATE KEY-----\n"
    began = time.monotonic()
    found = secrets.scan((block + "and text between\n") * 20_000)
    assert [k for k, _, _ in found] == ["pem"] * 20_000 and time.monotonic() - began < 20


def test_many_elements_of_one_key():
    big = b"\x02\x01\x00" * 300_000
    began = time.monotonic()
    assert secrets.is_der_key(b"\x30\x83" + len(big).to_bytes(3, "big") + big) and time.monotonic() - began < 10


def test_many_texts_without_id_or_under_one(spark):
    """20,000 texts without id and 5,000 under one id, each its own text with a shared passage: the first of all keeps it."""
    rng = random.Random(6)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(130))
    own = lambda i: f"{i:06d} " + f"{rng.getrandbits(560):0140x}"
    rows = [(None, own(i)) for i in range(20_000)] + [(5, own(i)) for i in range(20_000, 25_000)] + [(1, own(30_000) + shared), (None, own(30_001) + shared), (5, own(30_002) + shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    began = time.monotonic()
    got = suffix_dedup.suffix_dedup(docs).collect()
    assert len(got) == len(rows) and time.monotonic() - began < 120
    removed = [(r.doc_id, r.n_removed >= 130) for r in got if r.n_removed]
    assert sorted(removed, key=str) == [(5, True), (None, True)]


def test_benchmark_in_many_blocks(spark, docs):
    """A benchmark in blocks gives the rows that one block gives, with one broadcast out at a time."""
    from orrery.llm import decontam

    rng = random.Random(7)
    texts = [r.text for r in docs.where("text IS NOT NULL").collect() if len(r.text.split()) > 20]
    items = [(i, " ".join(rng.choice(texts).split()[3:17])) for i in range(40)] + [(40, None), (41, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontam.contaminated(docs, bench).collect()), key=str)
    assert whole and sorted(map(tuple, decontam.contaminated(docs, bench, block_bytes=500).collect()), key=str) == whole
