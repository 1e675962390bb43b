"""Secret scans with structural confirmation.

Base patterns (assignments, access keys, hex runs) are always reported. Beyond them,
base64 (standard and url-safe) and hex candidates are decoded and reported only when their
structure holds: private keys in DER whose nested lengths close exactly (PKCS#1, SEC1, PKCS#8 plain
and encrypted), OpenSSH private keys whose length-prefixed fields fill the blob, and signed tokens whose
header is JSON that names an algorithm. Public keys are no secrets and are not reported.

Defined results: null and empty texts have no span; spans count code points, end
exclusive; repeated rows are scanned one by one; extra columns are ignored; texts are
scanned whole. A candidate whose decoding or structure fails is not reported.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import arrow_map, flat, pieces

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "der", "ssh", "jwt")
#: The base patterns and their shortest lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST = {"assign": 6, "access": 20, "hex": 24}

PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{20,}={0,2}")
BASE64_URL = re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9]*[_-])[A-Za-z0-9_-]{20,}={0,2}")
HEX_BLOB = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])")
LONG_RUN = 20  # only assign, signed tokens and PEM blocks fit into shorter runs of these characters
MARKS = (b"eyJ", b"PRIVATE KEY-----")  # what signed tokens and PEM blocks hold
NESTED = 100  # lists and objects of a token header at most; deeper texts are no headers
#: The object identifiers that name an encryption by password.
PASSWORD_OIDS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
RUN_BYTES = np.zeros(256, bool)
RUN_BYTES[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", np.uint8)] = True
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def der_length(b: bytes, at: int, until: int) -> tuple[int, int] | None:
    """(start of the content, end of the content) of the DER element at this place, which ends there at the latest."""
    if at + 2 > until:
        return None
    n, at = b[at + 1], at + 2
    if n >= 128:
        k = n & 127
        if not 1 <= k <= 4 or at + k > until:
            return None
        n, at = int.from_bytes(b[at : at + k], "big"), at + k
        if n < 128:
            return None
    return (at, at + n) if at + n <= until else None


def der_parts(b: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the elements that fill the range exactly."""
    out = []
    while start < end:
        span = der_length(b, start, end)
        if span is None:
            return None
        out.append((b[start], *span))
        start = span[1]
    return out


def is_der_key(b: bytes) -> bool:
    """A private key in PKCS#1, PKCS#8 (plain or encrypted) or SEC1, with nested lengths that close exactly."""
    top = der_length(b, 0, len(b)) if b[:1] == b"\x30" else None
    if top is None or top[1] != len(b):
        return False
    parts = der_parts(b, *top)
    if not parts:
        return False
    tags = [t for t, _, _ in parts]
    if len(tags) >= 9 and set(tags[:9]) == {2} or tags[:2] == [2, 4] and b[parts[0][1] : parts[0][2]] == b"\x01":
        return True
    named = 1 if tags[:3] == [2, 48, 4] else 0 if tags == [48, 4] else None
    if named is None:
        return False
    inner = der_parts(b, parts[named][1], parts[named][2])
    if not inner or inner[0][0] != 6:
        return False
    return named == 1 or b[inner[0][1] : inner[0][2]].startswith(PASSWORD_OIDS)


def is_ssh_key(b: bytes) -> bool:
    """An OpenSSH private key file: every field's length fits and the fields fill the blob."""
    magic = b"openssh-key-v1\0"
    if not b.startswith(magic):
        return False
    at, fields = len(magic), 0
    while at < len(b):
        if fields == 3:  # the number of keys stands bare
            n = 0
        elif at + 4 > len(b):
            return False
        else:
            n = int.from_bytes(b[at : at + 4], "big")
        if at + 4 + n > len(b):
            return False
        at, fields = at + 4 + n, fields + 1
    return fields >= 6


def unbase64(s: str, *, url: bool = False) -> bytes | None:
    s = s.rstrip("=")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def is_token_header(s: str) -> bool:
    b = unbase64(s, url=True)
    if not b or b.count(b"[") + b.count(b"{") > NESTED:
        return False
    try:
        head = json.loads(b)
    except ValueError:
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def confirmed(text: str) -> list[tuple[str, int, int]]:
    """Spans that decoding and structure confirm; PEM blocks first, nothing is reported inside them again."""
    out = [("pem", *m.span()) for m in PEM.finditer(text) if (b := unbase64(re.sub(r"\s", "", m[2]))) and (is_der_key(b) or is_ssh_key(b))]
    begins, ends = [s for _, s, _ in out], [e for _, _, e in out]  # in order, apart from each other
    out += [("jwt", *m.span()) for m in JWT.finditer(text) if is_token_header(m[1])]
    for pattern, decode in ((BASE64, unbase64), (BASE64_URL, lambda s: unbase64(s, url=True)), (HEX_BLOB, bytes.fromhex)):
        for m in pattern.finditer(text):
            k = bisect_right(begins, m.start()) - 1
            if k >= 0 and m.end() <= ends[k]:
                continue
            b = decode(m[0])
            if b and (kind := "der" if is_der_key(b) else "ssh" if is_ssh_key(b) else ""):
                out.append((kind, *m.span()))
    return out


def scan(text: str, worded: bool = True, runs: bool = True) -> list[tuple[str, int, int]]:
    """All spans of a text, by start, then kind as listed; the flags say what it can hold at all."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]] if worded else []
    if runs:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
        out += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
        out += confirmed(text)
    return sorted(set(out), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def possible(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text: has it a keyword, has it a long run of key characters or the mark of a token or key block."""
    data, offs = flat(texts)
    n = len(offs) - 1
    low = data.tobytes().translate(LOWER)
    worded = np.zeros(n, bool)
    for w in WORDS:
        at = low.find(w)
        while at >= 0:
            i = int(np.searchsorted(offs, at, "right")) - 1
            worded[i] = True
            at = low.find(w, int(offs[i + 1]))
    runs = np.zeros(n, bool)
    raw = data.tobytes()
    for w in MARKS:
        at = raw.find(w)
        while at >= 0:  # over a border of texts it does no harm
            i = int(np.searchsorted(offs, at, "right")) - 1
            runs[i] = True
            at = raw.find(w, int(offs[i + 1]))
    inside = np.concatenate([[False], RUN_BYTES[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    long = edges[::2][edges[1::2] - edges[::2] >= LONG_RUN]
    # a run over a border of texts marks both; PEM lines are long runs too
    first = np.searchsorted(offs, long, "right") - 1
    runs[first] = True
    last = np.searchsorted(offs, edges[1::2][edges[1::2] - edges[::2] >= LONG_RUN] - 1, "right") - 1
    for a, b in zip(first[first < last], last[first < last], strict=True):
        runs[a : b + 1] = True
    return worded, runs


def find_secrets(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, redact: str | None = None) -> DataFrame:
    """The kept columns plus spans array<struct<kind,start,end>>; with redact, the text has each span replaced. No shuffle."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != "spans"]
    held = kept if text in kept else [*kept, text]
    source = docs.select(*[F.col(c).cast("string").alias(c) if c == text else c for c in held])
    schema = source.select(*kept).schema.add("spans", SPANS)
    at, kind = held.index(text), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                worded, runs = possible(piece.column(at))
                texts: list = [None] * piece.num_rows
                maybe = np.flatnonzero(worded | runs)
                found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
                for i in maybe.tolist():
                    texts[i] = piece.column(at)[i].as_py()
                    found[i] = scan(texts[i], bool(worded[i]), bool(runs[i]))
                cols = list(piece.columns[: len(kept)])
                if redact is not None and any(found) and at < len(kept):
                    whole = piece.column(at).to_pylist()
                    cols[at] = pa.array([redacted(x, f, redact) if f else x for x, f in zip(whole, found, strict=True)], pa.string())
                spans = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in f] for f in found], kind)
                yield pa.RecordBatch.from_arrays([*cols, spans], names=schema.names)

    return arrow_map(source, run, schema)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """Every maximal union of spans becomes one mark."""
    out, at, end = [], 0, -1
    for _, s, e in sorted(spans, key=lambda x: (x[1], x[2])):
        if s > end:
            out += [text[at:s] if end < 0 else text[end:s], mark]
            end = e
        end = max(end, e)
        at = end
    return "".join([*out, text[max(end, 0) :]])


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, digest of their spans, and all spans as text."""
    shown = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s.kind, s.start, s.getField("end"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s.kind.isin(*BASE_KINDS))
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
