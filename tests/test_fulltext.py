"""Full texts from bytes."""

import gzip
import io
import tarfile
import zlib

from orrery.sources import fulltext


def archive(files):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as tar:
        for name, text in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            tar.addfile(info, io.BytesIO(text.encode()))
    return buf.getvalue()


def pdf(text):
    return b"%PDF-1.4\n1 0 obj<<>>\nstream\n" + zlib.compress(b"BT (" + text.encode("latin-1").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj ET") + b"\nendstream\n"


def test_eprints(spark):
    data = archive({"b.tex": "Second \\emph{part}.", "main.tex": "\\documentclass{a}\\begin{document}First $x$ part.\\end{document}", "x.bib": "no"})
    # main files by their bodies, then the fragments they include; plain text is a text, PDF is none
    assert fulltext.tex_of_eprint(data) == "First $x$ part.\nSecond \\emph{part}."
    assert fulltext.tex_of_eprint(gzip.compress(b"\\section{One} text")) == "\\section{One} text"
    assert fulltext.tex_of_eprint(b"%PDF-1.4 x") == "" == fulltext.tex_of_eprint(gzip.compress(b"%PDF-1.4 x"))
    sample = archive({"m.tex": "\\documentclass{article}\n\\begin{document}\n\\section{Start} We study $x = y^2$ here.\n% gone\nIt holds~\\cite{foo}.\n\\begin{gather} a \\end{gather}\\textcolor{red}{seen}\\begin{center}\\textbf{Bold} end.\\end{center}\n\\end{document} tail"})
    rows = spark.createDataFrame([("1", data), ("2", None), ("3", b"plain text"), ("4", sample), ("5", b"%PDF-1.4")], "id string, content binary")
    got = {r.id: r.text for r in fulltext.full_texts(rows, "eprint", source="arxiv").collect()}
    assert got == {"1": "First part. Second part.", "2": None, "3": "plain text", "4": "Start. We study here. It holds~ . seen Bold end.", "5": None}


def test_jats():
    xml = b"<article><front><abstract><p>One <italic>two</italic>.</p></abstract></front><body><sec><label>1</label><p>Three<xref>[1]</xref> four.</p><fig><p>no</p></fig></sec></body><back><ref-list><ref>no</ref></ref-list></back></article>"
    assert fulltext.prose_of_jats(xml) == "One two . Three four."
    assert fulltext.prose_of_jats(b"<broken") == ""
    assert fulltext.prose_of_jats(b"<article><body><p>a<italic>b</italic>c</p></body></article>") == "a b c"
    assert fulltext.prose_of_jats(b'<!DOCTYPE a [<!ENTITY x "y">]><a><body>&x;</body></a>') == ""


def test_pdf_gate(spark):
    good = "Plain prose with (brackets) and words. " * 20
    rows = spark.createDataFrame([("good", pdf(good)), ("short", pdf("too short")), ("odd", pdf("\x01\x02~^|" * 200)), ("bad", b"nothing")], "id string, content binary")
    got = {r.id: r.text for r in fulltext.full_texts(rows, "pdf", source="oa").collect()}
    assert got["good"].startswith("Plain prose with (brackets)") and got["short"] is None and got["odd"] is None and got["bad"] is None
