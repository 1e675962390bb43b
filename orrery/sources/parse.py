"""Nested records to flat works: explicit schemas, permissive JSON, defaults for what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import text as T

NAMED = "struct<id:string,display_name:string>"
WORK = (
    "struct<id:string,display_name:string,title:string,publication_year:int,cited_by_count:long,doi:string,language:string,type:string,type_crossref:string,is_retracted:boolean,"
    "abstract_inverted_index:map<string,array<int>>,primary_location:struct<source:struct<display_name:string>,pdf_url:string,landing_page_url:string>,"
    "locations:array<struct<landing_page_url:string,pdf_url:string>>,open_access:struct<is_oa:boolean,oa_url:string>,"
    f"primary_topic:struct<id:string,display_name:string,subfield:{NAMED},field:{NAMED}>,concepts:array<struct<id:string,display_name:string,level:int,score:double>>,"
    f"authorships:array<struct<institutions:array<struct<display_name:string>>>>,referenced_works:array<string>>"
)
REPO = (
    "struct<full_name:string,html_url:string,owner:struct<login:string>,description:string,stargazers_count:long,forks_count:long,watchers_count:long,open_issues_count:long,"
    "license:struct<spdx_id:string,name:string>,default_branch:string,updated_at:string,pushed_at:string,topics:array<string>>"
)


def inverted_index(text: Column) -> Column:
    """Each word of a text, split at single spaces, with its places from 0 in order; null for a null text.

    Expressed on the text itself: (word, place) pairs are sorted, and each run of one word is cut out as an entry.
    Nothing leaves the row.
    """
    pairs = F.sort_array(F.transform(F.split(text, " "), lambda w, i: F.struct(w.alias("w"), i.alias("p"))))

    def entries(pairs: Column) -> Column:
        n = F.size(pairs)
        later = F.filter(F.slice(F.sequence(F.lit(0), n - 1), 2, n), lambda i: pairs[i]["w"] != pairs[i - 1]["w"])  # where runs begin, but the first
        run = lambda a, b: F.struct(pairs[a]["w"].alias("word"), F.transform(F.slice(pairs, a + 1, b - a), lambda q: q["p"]).alias("at"))
        return T.once(later, lambda h: F.zip_with(F.concat(F.array(F.lit(0)), h), F.concat(h, F.array(n)), run))

    return F.map_from_entries(T.once(pairs, entries))


def restore_abstract(index: Column) -> Column:
    """Words back in their places: the first word of the index wins a place, holes are empty words.

    Expressed on the map itself: entries become (place, order, word), sorted once; each one is zipped with the one
    before it, repeats of a place vanish and gaps become the spaces between empty words. Nothing leaves the row.
    """
    entries = F.map_entries(index)
    flat = F.flatten(F.transform(entries, lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("p"), i.alias("o"), e["key"].alias("w")))))
    start = F.array(F.struct(F.lit(-1).alias("p"), F.lit(0).alias("o"), F.lit("").alias("w")))

    def step(s: Column, q: Column) -> Column:
        gap = s["p"] - q["p"]
        return F.when(gap == 1, s["w"]).when(gap != 0, F.concat(F.repeat(F.lit(" "), gap - 1), s["w"]))

    words = T.once(F.sort_array(flat), lambda spots: F.when(F.get(spots, F.lit(0))["p"].isNotNull(), F.zip_with(spots, F.concat(start, spots), step)))
    return F.when(index.isNull(), "").otherwise(F.coalesce(F.array_join(words, " "), F.lit("")))


def normalize_works(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """One work a row from JSON payloads; malformed payloads give a row of defaults."""
    w = raw.withColumn("w", F.from_json(payload, WORK, {"mode": "PERMISSIVE"}))
    title = F.coalesce(F.col("w.display_name"), F.col("w.title"), F.lit(""))
    head = F.upper(title)
    concepts = F.filter(F.coalesce("w.concepts", F.array().cast("array<struct<id:string,display_name:string,level:int,score:double>>")), lambda c: F.coalesce(c.display_name, F.lit("")) != "")
    names = F.flatten(F.transform(F.coalesce("w.authorships", F.array().cast("array<struct<institutions:array<struct<display_name:string>>>>")), lambda a: F.transform(F.coalesce(a.institutions, F.array().cast("array<struct<display_name:string>>")), lambda i: i.display_name)))
    urls = F.flatten(F.transform(F.coalesce("w.locations", F.array().cast("array<struct<landing_page_url:string,pdf_url:string>>")), lambda x: F.array(x.landing_page_url, x.pdf_url)))
    return w.select(
        T.short_id(F.col("w.id")).alias("id"), title.alias("title"), T.text_or_empty(F.col("w.primary_location.source.display_name")).alias("venue"), F.coalesce("w.publication_year", F.lit(0)).alias("year"),
        F.coalesce("w.cited_by_count", F.lit(0)).alias("cited_by_count"), F.col("w.doi").alias("doi"), restore_abstract(F.col("w.abstract_inverted_index")).alias("abstract"),
        F.coalesce("w.type", "w.type_crossref").alias("publication_type"), F.col("w.language").alias("language"),
        (F.coalesce("w.is_retracted", F.lit(False)) | head.startswith("RETRACTED:") | head.startswith("WITHDRAWN:")).alias("is_retracted"),
        F.transform(concepts, lambda c: c.display_name).alias("concepts"),
        F.transform(concepts, lambda c: F.struct(c.display_name.alias("name"), F.coalesce(c.level, F.lit(0)).alias("level"), F.coalesce(c.score, F.lit(0.0)).alias("score"), T.strip_id(c.id).alias("id"))).alias("concept_tags"),
        F.array_distinct(F.filter(names, lambda n: F.coalesce(n, F.lit("")) != "")).alias("affiliations"),
        F.filter(F.coalesce("w.referenced_works", F.array().cast("array<string>")), lambda r: r.isNotNull()).alias("refs"),
        F.coalesce("w.open_access.is_oa", F.lit(False)).alias("is_oa"), F.coalesce(F.col("w.open_access.oa_url"), F.col("w.primary_location.pdf_url")).alias("oa_url"),
        F.try_element_at(F.filter(urls, lambda u: F.coalesce(u.contains("arxiv.org"), F.lit(False))), F.lit(1)).alias("arxiv_url"),
        *[F.nullif(T.strip_id(F.col(f"w.primary_topic.{p}id")), F.lit("")).alias(n) for p, n in (("", "topic_id"), ("subfield.", "subfield_id"), ("field.", "field_id"))],
    )


def explode_page(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """One row a work from pages {"results": [...]}, in page order."""
    page = F.from_json(F.col(payload), f"struct<results:array<{WORK}>>")
    return raw.select(F.posexplode(page["results"]).alias("pos", "work"))


def normalize_repos(raw: DataFrame, payload: str = "payload") -> DataFrame:
    r = raw.withColumn("r", F.from_json(payload, REPO))
    n = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(0)).alias(c.removesuffix("_count").replace("stargazers", "stars"))
    return r.select(
        T.text_or_empty(F.col("r.full_name")).alias("full_name"), T.text_or_empty(F.col("r.html_url")).alias("html_url"), T.text_or_empty(F.col("r.owner.login")).alias("owner"), T.text_or_empty(F.col("r.description")).alias("description"),
        n("stargazers_count"), n("forks_count"), n("watchers_count"), n("open_issues_count"), F.coalesce(F.nullif(F.col("r.license.spdx_id"), F.lit("")), F.col("r.license.name"), F.lit("")).alias("license_name"),
        T.text_or_empty(F.col("r.updated_at")).alias("updated_at"), T.text_or_empty(F.col("r.pushed_at")).alias("pushed_at"), F.coalesce("r.topics", F.array().cast("array<string>")).alias("topics"),
    )


def decode_readme(content: Column) -> Column:
    """Base64 with line breaks to text; empty where it cannot be decoded."""
    return F.coalesce(F.decode(F.try_to_binary(F.regexp_replace(T.text_or_empty(content), r"\s+", ""), F.lit("base64")), "UTF-8"), F.lit(""))


def strip_front_matter(card: Column) -> Column:
    return F.ltrim(F.regexp_replace(T.text_or_empty(card), r"(?s)\A---\n.*?\n---\n?", ""))


def hub_license(tags: Column) -> Column:
    hit = F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.startswith("license:"))
    return F.coalesce(F.substring(F.try_element_at(hit, F.lit(1)), 9, 1000), F.lit(""))


def html_text(html: Column) -> Column:
    """Text of markup: scripts, styles, references, figures and tags dropped, a few entities restored."""
    t = F.regexp_replace(T.text_or_empty(html), r"(?is)<(script|style|ref-list|fig|table-wrap|math)\b.*?</\1>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    return T.collapse_ws(t)


#: Environments and commands that carry no prose, commands whose argument is a heading.
TEX_FLOATS = "equation|align|eqnarray|figure|table|tabular|thebibliography|displaymath|gather|multline"
TEX_SILENT = (
    "cite[a-z]*|ref|eqref|autoref|label|usepackage|documentclass|input|include|includepdf|includepdfmerge|pdfimport|bibliography|bibliographystyle|includegraphics|"
    "newcommand|renewcommand|hypersetup|color|textcolor|colorbox|definecolor|pagecolor|setlength|vspace|hspace|setcounter|pagestyle|thispagestyle"
)
TEX_HEADINGS = "section|subsection|subsubsection|paragraph|title|chapter"


def clean_latex(tex: Column) -> Column:
    """Prose of a TeX source: the body, without comments, maths, floats and silent commands; headings become sentences and other commands leave their argument."""
    t = T.text_or_empty(tex)
    body = F.regexp_extract(t, r"(?s)\\begin\{document\}(.*?)(?:\\end\{document\}|\z)", 1)
    t = F.when(t.contains("\\begin{document}"), body).otherwise(F.regexp_replace(t, r"(?s)\\end\{document\}.*", ""))
    for pattern, by in (
        (r"(?<!\\)%.*", ""), (rf"(?s)\\begin\{{({TEX_FLOATS})\*?\}}.*?\\end\{{\1\*?\}}", " "), (rf"\\(?:{TEX_SILENT})\b\s*(?:\[[^\]]*\])?\s*(?:\{{[^}}]*\}})?", " "),
        (r"\\(?:begin|end)\*?\s*(?:\[[^\]]*\])?\s*\{[^{}]*\}", " "), (rf"\\(?:{TEX_HEADINGS})\*?\s*\{{([^{{}}]*)\}}", " $1. "), (r"\\(?:textbf|textit|emph|texttt|mathrm|textrm|text|mbox)\s*\{([^{}]*)\}", "$1"),
        (r"\$[^$]*\$", " "), (r"\\@?[a-zA-Z]+\*?\s*(?:\[[^\]]*\])?\s*\{([^{}]*)\}", "$1"), (r"\\@?[a-zA-Z]+\*?", " "), (r"[{}\\]", " "),
    ):
        t = F.regexp_replace(t, pattern, by)
    return T.collapse_ws(t)


def fulltext_chain(*providers: DataFrame, ids: DataFrame) -> DataFrame:
    """id, source, text, resolved: the first provider that resolves an id; an unresolved id stays as a miss. providers: id, source, text."""
    every = None
    for i, p in enumerate(providers):
        one = p.select("id", "source", "text", F.lit(i).alias("__p")).where("text IS NOT NULL AND text <> ''")
        every = one if every is None else every.unionByName(one)
    best = every.groupBy("id").agg(F.min_by(F.struct("source", "text"), "__p").alias("b"))
    return ids.select("id").join(best, "id", "left").select("id", F.col("b.source").alias("source"), F.col("b.text").alias("text"), F.col("b").isNotNull().alias("resolved"))
