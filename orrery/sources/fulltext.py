"""Full texts from bytes: e-print archives, JATS, PDF streams. Arrow-batched Python, one pass, no shuffle.

Bytes that cannot be read give the empty text, never an error; a quality gate decides what
resolves.
"""

from __future__ import annotations

import io
import re
import tarfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.sources.parse import clean_latex
from orrery.sources.pdf import text_of_pdf

#: Limits of excerpts and of texts taken from PDF.
EXCERPT, PDF_LEAST, PDF_PROSE, MEMBER_BYTES, ARCHIVE_BYTES = 4000, 400, 0.85, 8 << 20, 64 << 20
#: Parts of an article that are not prose.
NOT_PROSE = frozenset({"ref-list", "fig", "table-wrap", "disp-formula", "inline-formula", "math", "tex-math", "xref", "fn", "ack", "label"})


def gunzipped(data: bytes, limit: int) -> bytes:
    """At most so many bytes of a gzip stream; other bytes as they are."""
    if data[:2] != b"\x1f\x8b":
        return data
    try:
        return zlib.decompressobj(31).decompress(data, limit)
    except zlib.error:
        return data


def tex_of_eprint(data: bytes) -> str:
    """TeX of a gzip or tar archive: bodies of main files in the archive's order, then the fragments they include."""
    inner = gunzipped(data, ARCHIVE_BYTES)
    if b"%PDF-" in (data[:5], inner[:5]):
        return ""
    try:
        with tarfile.open(fileobj=io.BytesIO(inner)) as tar:
            files = [tar.extractfile(m).read(MEMBER_BYTES).decode("utf-8", "replace") for m in tar if m.isfile() and m.name.lower().endswith((".tex", ".txt"))]
    except (tarfile.TarError, EOFError):
        files = [inner.decode("utf-8", "replace")]
    body = lambda t: re.search(r"(?s)\\begin\{document\}(.*?)(?:\\end\{document\}|\Z)", t)[1]
    main = [f for f in files if "\\begin{document}" in f]
    return "\n".join([*map(body, main), *(f for f in files if "\\begin{document}" not in f)])


def prose_of_jats(data: bytes) -> str:
    """Abstract and body, paragraph texts in order, without references, figures and mathematics."""
    if re.search(rb"<!ENTITY", data):  # expansions have no bound
        return ""
    try:
        root = ElementTree.fromstring(data)
    except ElementTree.ParseError:
        return ""
    local = lambda e: e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""
    out: list[str] = []

    def walk(e: ElementTree.Element) -> None:
        if local(e) not in NOT_PROSE and isinstance(e.tag, str):
            out.append(e.text or "")
            for child in e:
                walk(child)
                out.append(child.tail or "")

    for part in root.iter():
        if local(part) in ("abstract", "body"):
            walk(part)
    return " ".join(" ".join(out).split())


READERS: dict[str, Callable[[bytes], str]] = {"eprint": tex_of_eprint, "jats": prose_of_jats, "pdf": text_of_pdf}


def read_bytes(rows: DataFrame, kind: str, *, content: str = "content") -> DataFrame:
    """rows without content, plus raw_text."""
    kept = [c for c in rows.columns if c not in (content, "raw_text")]
    schema = rows.select(*kept).schema.add("raw_text", "string")
    reader = READERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [reader(x) if x else "" for x in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(texts, pa.string())], names=schema.names)

    return rows.select(*kept, content).mapInArrow(run, schema)


def excerpt(c: Column, limit: int = EXCERPT) -> Column:
    # the white space of a text is collapsed once, not for every look at it
    return T.once(T.collapse_ws(c), lambda t: T.cap_at_sentence(t, limit))


def full_texts(rows: DataFrame, kind: str, *, source: str, content: str = "content") -> DataFrame:
    """id, source, text (null where the quality gate fails), truncated. rows: id and bytes."""
    raw = read_bytes(rows.select("id", content), kind, content=content)
    text = clean_latex(F.col("raw_text")) if kind == "eprint" else F.col("raw_text")
    good = (F.length("text") >= PDF_LEAST) & (T.prose_ratio(F.col("text")) >= PDF_PROSE) if kind == "pdf" else F.length("text") > 0
    out = raw.select("id", text.alias("text"))
    return out.select("id", F.lit(source).alias("source"), F.when(good, excerpt(F.col("text"))).alias("text"), (F.length("text") > EXCERPT).alias("truncated"))


def effective_abstract(abstract: Column, excerpt_text: Column) -> Column:
    """500 characters of the abstract, and 1,200 of the excerpt where there is one."""
    a = F.substring(T.text_or_empty(abstract), 1, 500)
    return F.when(T.text_or_empty(excerpt_text) == "", a).otherwise(F.concat(a, F.lit("\n"), F.substring(excerpt_text, 1, 1200)))
