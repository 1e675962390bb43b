"""The operators' methods on the cases that are easy to lose."""

import base64
import hashlib
import json
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from orrery.llm import bpe, decontam, hilbert, lang_id, quality, secrets, suffix_dedup
from orrery.llm.queries import tokenizer_path


def at_hand(known, split, path):
    """The packed table of words at hand."""
    ids, names = split.ids(known), bpe.vocabulary(path)
    return bpe.packed_words(pa.array(known, pa.string()), [np.array(x, np.int32).tobytes() for x in ids], pa.array([" ".join(names[i] for i in x) for x in ids], pa.string()))


def test_words_equal_the_library():
    """Fuzzed texts: words, ids and both digests as the library gives them."""
    path = tokenizer_path()
    split = bpe.splitter(path)
    rng = random.Random(5)
    letters = list("abcst'''''  \n\t.,-!09reveLLM_éÉßŸŁłĿıſİ²½×÷µªº·“”—–…’ \u0085日x\u0301\x1c") + ["'s", "'re", "<|endoftext|>", "<|startoftext|>", "'LL "]
    texts = ["".join(rng.choice(letters[: rng.choice([20, 30, len(letters)])]) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + [None, ""]
    w = split.words(pa.array(texts, pa.string()))
    words = [[w.low[w.starts[k] : w.ends[k]].tobytes().decode() for k in range(w.first[i], w.first[i + 1])] for i in range(len(texts))]
    assert words == [split.slow(x or "") for x in texts]
    known = sorted({x for ws in words for x in ws})
    table = at_hand(known, split, path)
    coded = bpe.Coded(w, table)
    ids, first = coded.ids()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    _, a, b = bpe._digest_rows(coded, path)
    for i, x in enumerate(texts):
        want = split.tokenizer.encode(x or "", add_special_tokens=False).ids
        assert ids[first[i] : first[i + 1]].tolist() == want
        assert (a[i].as_py(), b[i].as_py()) == (sha(" ".join(map(str, want))), sha(split.tokenizer.decode(want, skip_special_tokens=False)))


def test_words_that_share_a_hash_stand_apart(monkeypatch):
    """With hashes of three values every word clashes; ids stay right, and unknown words fail."""
    path = tokenizer_path()
    real = bpe.span_hashes
    monkeypatch.setattr(bpe, "span_hashes", lambda *x: real(*x) % np.uint64(3))
    split = bpe.splitter(path)
    known = ["one", "two", "three", "four", "five", "sixteen", "unhelpful"]
    table = at_hand(known, split, path)
    coded = bpe.Coded(split.words(pa.array(["five two unhelpful", "one sixteen"])), table)
    ids, first = coded.ids()
    want = split.tokenizer.encode("five two unhelpful", add_special_tokens=False).ids
    assert ids[: first[1]].tolist() == want and coded.decoded()[0].decode() == split.tokenizer.decode(want, skip_special_tokens=False)
    with pytest.raises(RuntimeError):
        table.look_up(split.words(pa.array(["absent from it", "or this"])))
    monkeypatch.undo()
    whole = at_hand(known, split, path)
    with pytest.raises(RuntimeError):
        whole.look_up(split.words(pa.array(["absent"])))


def test_a_word_without_ids_leaves_no_space():
    path = tokenizer_path()
    split = bpe.splitter(path)
    ids = split.ids(["one", "two"])
    names = bpe.vocabulary(path)
    said = pa.array([" ".join(names[i] for i in ids[0]), "", " ".join(names[i] for i in ids[1])], pa.string())
    table = bpe.packed_words(pa.array(["one", "gap", "two"], pa.string()), [np.array(x, np.int32).tobytes() for x in (ids[0], [], ids[1])], said)
    assert bpe.Coded(split.words(pa.array(["one gap two", "gap", "gap one gap"])), table).decoded() == [f"{said[0]} {said[2]}".encode(), b"", str(said[0]).encode()]


@pytest.mark.parametrize("n", range(5, 13))
def test_short_items_meet_every_allowed_substitution(n):
    """All sets of substitutions that the share allows, for every item length, through the index itself."""
    item = [f"w{i}" for i in range(n)]
    index = decontam.SeedIndex(pa.array([1]), pa.array([" ".join(item)]))
    off = n - decontam.least_equal(n, 0.8)
    for bad in combinations(range(n), off):
        text = " ".join(["before", *("zz" if i in bad else w for i, w in enumerate(item)), "after"])
        _, _, words, first = decontam.tokens(*decontam.flat(pa.array([text])), None)
        hits = [(t, i, at) for t, i, at in zip(*index.hits(words, first), strict=True)]
        assert any(decontam.verify(words, 0, len(words), index.words, at, 12, 0.8) for _, _, at in hits), (n, bad)


def test_punctuation_of_any_script_parts_words(spark):
    item = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    texts = ["“the quick” brown—fox jumps… over the–lazy\u00a0dog «and» runs far、away from。here today", "the quick brown fox", item.upper(), "über " + item + " straße"]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(2, item.upper(), "x")], "doc_id long, text string, item_id string")
    got = decontam.contaminated(d, spark.createDataFrame([(1, item, 5), (1, item, 6)], "item_id long, text string, doc_id long"))
    rows = sorted((r.doc_id, r.item_id, r.n_equal, r.n_window, r.doc_word, r.item_word) for r in got.collect())
    # rows and items that repeat each count; the earliest of equal windows is reported
    assert rows == [(0, 1, 12, 12, 0, 0)] * 2 + [(2, 1, 12, 12, 0, 0)] * 4 + [(3, 1, 12, 12, 1, 0)] * 2


def der(tag, *parts):
    b = b"".join(parts)
    n = len(b)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + b


def ssh(*fields):
    return b"".join(len(f).to_bytes(4, "big") + f for f in fields)


def test_only_private_structures_are_secrets(spark):
    oid = lambda h: der(6, bytes.fromhex(h))
    number = lambda i: der(2, bytes([1 + i]) * 20)
    private = der(0x30, der(2, b"\0"), der(0x30, oid("2a864886f70d010101"), b"\5\0"), der(4, der(0x30, *map(number, range(9)))))
    locked = der(0x30, der(0x30, oid("2a864886f70d01050d"), der(0x30, b"\5\0")), der(4, bytes(range(64))))
    digest = der(0x30, der(0x30, oid("608648016503040201"), b"\5\0"), der(4, bytes(range(32))))
    public = der(0x30, der(0x30, oid("2a864886f70d010101"), b"\5\0"), der(3, b"\0" + der(0x30, number(3), number(4))))
    blob = ssh(b"ssh-ed25519", bytes(range(32)))
    file = b"openssh-key-v1\0" + ssh(b"none", b"none", b"") + (1).to_bytes(4, "big") + ssh(blob, bytes(range(90)))
    b64 = lambda b: base64.b64encode(b).decode()
    url = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    dashed = next(x for i in range(200) if "-" in (x := url(der(0x30, der(2, b"\0"), der(0x30, oid("2a864886f70d010101")), der(4, bytes([250, i] * 40))))) or "_" in x)
    none = url(json.dumps({"alg": "none"}, separators=(",", ":")).encode())
    texts = {
        "private": "k " + b64(private) + " z", "locked": b64(locked), "digest": b64(digest), "public": b64(public), "authorized": "ssh-ed25519 " + b64(blob) + " me@host", "file": b64(file), "dashed": f"key:{dashed}",
        "short token": f"{none}.e30.", "hex": private.hex(), "clean": "nothing to see here at all",
    }
    assert len(none) == 19
    table = spark.createDataFrame([(i, t, "spans of another") for i, t in enumerate(texts.values())] * 2, "doc_id long, text string, spans string")
    got = {}
    for r in secrets.find_secrets(table).collect():
        got.setdefault(r.doc_id, []).append({s.kind for s in r.spans} - set(secrets.BASE_KINDS))
    kinds = {name: got[i] for i, name in enumerate(texts)}
    assert kinds == {"private": [{"der"}] * 2, "locked": [{"der"}] * 2, "digest": [set()] * 2, "public": [set()] * 2, "authorized": [set()] * 2, "file": [{"ssh"}] * 2, "dashed": [{"der"}] * 2, "short token": [{"jwt"}] * 2, "hex": [{"der"}] * 2, "clean": [set()] * 2}


def test_the_query_finds_what_a_scan_finds(spark):
    """Generated tokens, keys and keywords: the prefilter drops nothing, and base spans follow a reading of their own."""
    rng = random.Random(11)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
    token = lambda n, a=alphabet: "".join(rng.choice(a) for _ in range(n))
    header = lambda: base64.urlsafe_b64encode(json.dumps(rng.choice([{"alg": "none"}, {"alg": "HS256", "typ": "JWT"}, {"typ": "x"}]), separators=(",", ":")).encode()).decode().rstrip("=")
    make = [
        lambda: rng.choice(["password", "PASSWD", "Secret", "tOken", "api_key", "APIKEY", "api-key"]) + rng.choice(["'", '"', ""]) + " " * rng.randint(0, 2) + rng.choice([":", "=", ";"]) + " " * rng.randint(0, 2) + rng.choice(["'", '"', ""]) + token(rng.randint(1, 9)),
        lambda: "AKIA" + token(rng.randint(10, 20), "ABCDEFGHIJ0123456789"),
        lambda: token(rng.randint(18, 30), "0123456789abcdef"),
        lambda: f"{header()}.{token(rng.randint(1, 5), alphabet[:62])}.{token(rng.randint(0, 4), alphabet[:62])}",
        lambda: "é " + token(3),
    ]
    texts = [rng.choice([" ", "\n", "é", ""]).join(rng.choice(make)() for _ in range(rng.randint(0, 4))) for _ in range(600)]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keep=["doc_id"]).collect()}
    assert got == {i: secrets.scan(t) for i, t in enumerate(texts)}
    assert any(s[0] == "jwt" for v in got.values() for s in v)
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[0] in secrets.BASE_KINDS] == by_hand(t)


def by_hand(t):
    """The base spans, character by character."""
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    out, low = [], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    i = 0
    while i < len(t):
        word = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if low.startswith(w, i)), None)
        j = i + len(word or "")
        if word:
            j += t[j : j + 1] in ("'", '"') and t[j : j + 1] != ""
            while t[j : j + 1] == " ":
                j += 1
            if t[j : j + 1] in (":", "=") and t[j : j + 1]:
                j += 1
                while t[j : j + 1] == " ":
                    j += 1
                j += t[j : j + 1] in ("'", '"') and t[j : j + 1] != ""
                e = j
                while e < len(t) and t[e] in value:
                    e += 1
                if e > j:
                    if e - j >= 6:
                        out.append(("assign", i, e))
                    i = e
                    continue
        i += 1
    for kind, start, inside, least in (("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), ("hex", "", set("0123456789abcdef"), 24)):
        i = 0
        while i < len(t):
            if t.startswith(start, i) and i + len(start) < len(t) and t[i + len(start)] in inside:
                e = i + len(start)
                while e < len(t) and t[e] in inside:
                    e += 1
                if e - i >= least:
                    out.append((kind, i, e))
                i = e
            else:
                i += 1
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_hilbert_places_follow_the_data(spark):
    """Sources with a shared beginning part; boxes over two dimensions touch few shards; a hot cell is dealt out."""
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 4000), rng.choice(["en", "de", "fr", "es"]), f"https://common-{rng.randint(0, 63):02d}.org") for i in range(4000)]
    rows += [(10_000 + i, "hot", "en", "https://common-00.org") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in hilbert.hilbert_shards(docs, shards=64, bucket_rows=500).collect()}
    assert len(got) == len(rows) and len({r.place for r in got.values()}) > 100
    shards = {}
    for i, t, _, s in rows[:4000]:
        shards.setdefault(got[i].shard, []).append((s, len(t)))
    boxes = {k: (min(s for s, _ in v), max(s for s, _ in v), min(n for _, n in v), max(n for _, n in v)) for k, v in shards.items()}
    touched = [sum(b[0] <= f"https://common-{a + 7:02d}.org" and b[1] >= f"https://common-{a:02d}.org" and b[2] <= c + 500 and b[3] >= c for b in boxes.values()) for a in range(0, 64, 8) for c in range(0, 4000, 500)]
    # a table in random order touches all shards with every query
    assert np.mean(touched) < 0.35 * len(boxes)
    slots = {}
    for r in got.values():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_thirty_languages_of_the_full_alphabet(spark):
    """No table limit: thirty languages over many scripts are told apart; ties go to the first name."""
    rng = random.Random(9)
    rows = []
    for n in range(30):
        words = ["".join(chr(0x80 + n * 60 + rng.randrange(60)) for _ in range(rng.randint(2, 6))) for _ in range(40)]
        rows += [(n * 100 + i, " ".join(rng.choice(words) for _ in range(30)), f"l{n:02d}") for i in range(6)]
    docs = spark.createDataFrame(rows + [(9000, bytes(range(1, 128)).decode(), "aa"), (9001, bytes(range(1, 128)).decode(), "ab")], "doc_id long, text string, lang string")
    model = lang_id.learn(docs.where("doc_id % 100 < 4 or doc_id >= 9000"))
    assert model.langs[:2] == ["aa", "ab"] and len(model.langs) == 32
    got = lang_id.predict(docs.where("doc_id % 100 >= 4 and doc_id < 9000"), model).collect()
    lettered = [r for r in got if r.lang_pred != "und"]
    assert len(lettered) > 50 and np.mean([r.lang_pred == r.lang for r in lettered]) >= 0.95
    tie = lang_id.predict(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).first()
    assert tie.lang_pred == "aa"


def test_rare_contexts_leave_the_tree(spark):
    """Contexts below the share are left out; code lengths then are those of the shorter contexts."""
    docs = spark.createDataFrame([("x", "abababab" * 50 + "qrs")], "lang string, text string")
    small = lang_id.learn(docs, share=0.05).trees[0]
    whole = lang_id.learn(docs).trees[0]
    assert len(small.contexts) < len(whole.contexts)
    keys, _ = lang_id.grams(pa.array(["abab"]))
    assert np.isfinite(small.code_lengths(keys)).all()


def test_held_out_languages(spark):
    """Held-out accuracy on invented prose in four languages."""
    rng = random.Random(1)
    made = {}
    for lang, ends in (("en", ["ing", "ed", "th"]), ("de", ["ung", "en", "sch"]), ("fr", ["eux", "ait", "é"]), ("es", ["ción", "os", "ar"])):
        made[lang] = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(2)) + rng.choice(ends) for _ in range(200)]
    rows = [(i, " ".join(rng.choice(made[x]) for _ in range(rng.randint(3, 60))), x) for i, x in enumerate(rng.choice(list(made)) for _ in range(800))]
    got = lang_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("held_out").collect()
    truth = {i: x for i, _, x in rows}
    assert len(got) > 150 and np.mean([r.lang_pred == truth[r.doc_id] for r in got]) >= 0.97


def test_decode_joins_ids_to_pieces(spark):
    path = tokenizer_path()
    t = bpe.splitter(path).tokenizer
    rows = [(1, [320, 1125, 5], "d", 7), (1, [320, 1125, 5], "d", 7), (2, [], "d", 7), (3, None, "d", 7), (4, [None, 320, 10**6], "d", 7)]
    got = bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>, decoded string, n_tokens int"), path)
    assert sorted((r.doc_id, r.decoded) for r in got.collect() if r.decoded is not None) == sorted([(1, t.decode([320, 1125, 5])), (1, t.decode([320, 1125, 5])), (2, ""), (4, t.decode([320]))])
    again = bpe.encode(spark.createDataFrame(rows[:1], "doc_id long, ids array<int>, text string, n_tokens int"), path, output="digests")
    assert again.columns == ["doc_id", "ids", "text", "n_tokens", "ids_sha256", "decoded_sha256"]


def brute_removed(texts, length):
    seen, out = {}, []
    for d, t in enumerate(texts):
        gone = bytearray(len(t))
        for j in range(len(t) - length + 1):
            if seen.setdefault(t[j : j + length], (d, j)) != (d, j):
                gone[j : j + length] = b"\1" * length
        out.append(bytes(gone))
    return out


@pytest.mark.parametrize("deepest", [0, 1, 6])
def test_hot_anchors_are_split_by_further_anchors(monkeypatch, deepest):
    """One passage among many different neighbours and with small changes: groups far beyond an array, against brute force."""
    rng = random.Random(8)
    text = lambda n: bytes(rng.choice(b"abcdefghij ") for _ in range(n))
    passage = text(260)
    texts = []
    for _ in range(120):
        p = bytearray(passage)
        for _ in range(rng.randint(0, 2)):
            p[rng.randrange(len(p))] = rng.choice(b"xyz")
        texts.append(text(rng.randint(0, 60)) + bytes(p) + text(rng.randint(0, 60)))
    texts += [b"a" * 700, b"ab" * 300, texts[3], texts[5] + texts[6]]
    monkeypatch.setattr(suffix_dedup, "ARRAY", 3000)
    monkeypatch.setattr(suffix_dedup, "DEEPEST", deepest)
    data = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    first, count, own, h = suffix_dedup.anchors(data, offs)
    head = np.stack([h.view(np.int64), own, np.zeros(len(own), np.int64), own, first - offs[own], count])
    part = suffix_dedup.ranges(first, count + 99)
    spans = suffix_dedup.Contexts(head, data[part], 100).later()
    got = [bytearray(len(t)) for t in texts]
    for _, i, s, e in spans.T.tolist():
        got[i][s:e] = b"\1" * (e - s)
    assert [bytes(g) for g in got] == brute_removed(texts, 100)


def plain_features(text):
    """The surface features, text by text, in plain Python."""
    b = (text or "").encode()
    if not b:
        return [0.0] * len(quality.FEATURES)
    space, stops = b" \t\n\x0b\x0c\r", b".,;:?'\"()-"
    kind = lambda c: 0 if c in space else 1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c in stops else 5 if c >= 128 else 6
    share = [sum(kind(c) == k for c in b) / len(b) for k in range(7)]
    words = b.split()
    low = [w.lower() for w in words]
    n = max(len(words), 1)
    lines = [x.lower() for x in b.split(b"\n") if x]
    letters = max(share[1] + share[2] + share[5], 1e-9)
    per = lambda c: sum(c) / n
    return [
        np.log1p(len(b)), np.log1p(len(words)), share[2] / letters, share[3], share[4], share[5], share[6], b.count(b"!") / n, b.count(b"|") / n, share[0], len(b) * (1 - share[0]) / n, len(set(low)) / n,
        per(a == c for a, c in zip(low, low[1:], strict=False)), per(kind(w[-1]) == 6 for w in words), per(len(w) > 1 and kind(w[0]) == 2 and kind(w[1]) == 2 for w in words), b.count(b"\n") / n,
        (len(lines) - len(set(lines))) / max(len(lines), 1), per(kind(w[-1]) == 4 for w in words), per(len(w) > 24 for w in words),
    ]


def test_features_against_plain_python():
    rng = random.Random(4)
    alphabet = "abcXYZ019 \n\t.,;!|#é日-" + " " * 6
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(200)] + [None, "", "AB cd ab ab\nx\nx\n", "w" * 30]
    got = quality.features(pa.array(texts, pa.string()))
    assert np.allclose(got, [plain_features(t) for t in texts], atol=1e-9)


def test_ranking_nears_the_best_pairwise_loss():
    """The fit against full-batch descent on all pairs: nearly its loss, and its order of texts."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(160, 5))
    y = (x @ np.array([2.0, -1.0, 0.5, 0.0, 0.0]) + rng.normal(size=160) > 0).astype(int)
    fit = quality.fit_ranker(x, y, pairs=40_000)
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, 5)
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean()
    w = np.zeros(5)
    for _ in range(4000):
        w += 0.5 * (d / (1 + np.exp(d @ w))[:, None]).mean(0)
    assert loss(fit.w) < loss(w) + 0.02 < loss(np.zeros(5)) - 0.2
    assert np.corrcoef(np.argsort(np.argsort(fit.raw(x))), np.argsort(np.argsort(z @ w)))[0, 1] > 0.98
    assert abs(np.mean(fit.score(x) < 0.5) - np.mean(y == 0)) < 0.02  # the quantile that the bad labels' share names


def test_overlaps_are_the_best_windows_of_all_diagonals(monkeypatch):
    """In small stretches and with a phrase that many items share, against every diagonal by itself."""
    rng = random.Random(6)
    phrase = [f"p{i}" for i in range(9)]
    text = lambda n: [rng.choice(["a", "b", "c", *phrase[:3]]) if rng.random() < 0.2 else f"u{rng.randint(0, 60)}" for _ in range(n)]
    items = [text(rng.randint(3, 30)) + phrase + text(rng.randint(0, 20)) for _ in range(25)] + [phrase[:5], ["solo"] * 20]
    docs = [text(rng.randint(0, 40)) + (rng.choice(items) if rng.random() < 0.6 else phrase) + text(rng.randint(0, 30)) for _ in range(40)] + [[], ["solo"] * 50]
    index = decontam.SeedIndex(pa.array(range(len(items))), pa.array([" ".join(x) for x in items]))
    _, _, words, first = decontam.tokens(*decontam.flat(pa.array([" ".join(x) for x in docs])), None)
    real = decontam.stretches
    whole = index.overlaps(words, first, 12, 0.8)
    monkeypatch.setattr(decontam, "stretches", lambda sizes: real(sizes, 50))
    assert (index.overlaps(words, first, 12, 0.8) == whole).all()
    want = {}
    for t in range(len(docs)):
        for i in range(len(items)):
            for at in range(int(first[t]) - len(items[i]), int(first[t + 1])):
                got = decontam.verify(words, int(first[t]), int(first[t + 1]), index.words[index.first[i] : index.first[i + 1]], at, 12, 0.8)
                if got and ((t, i) not in want or (-got[0], *got[2:]) < (-want[t, i][0], *want[t, i][2:])):
                    want[t, i] = got
    assert {(t, i): tuple(rest) for t, i, *rest in whole.tolist()} == want and len(want) > 30
