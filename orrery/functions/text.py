"""Text keys and normal forms as Column expressions; everything stays inside codegen."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths and thresholds of the text rules.
ABSTRACT_KEY_CHARS = 200
QUOTE_MIN_CHARS = 10
EXCERPT_CHARS = 4000
PROSE_MARKS = ".,;:!?()[]-'\"%/&@+=°ãμ "
DOI_PREFIX = r"^(https://doi\.org/|http://doi\.org/|https://dx\.doi\.org/|doi:)"
ABSTRACT_LABEL = r"^(?:(?:abstract|summary|preliminary and incomplete|preliminary draft)\b[\s:.\-–—]*)+"
TITLE_TAIL = r"\.\s+([^.]{1,60})$"
TITLE_TAIL_PART = r"(?i)^(?:part|vol|volume|chapter|section|[ivx]+|\d)\b"
SUPPLEMENT_TITLE = (
    r"(?i)^\s*(?:additional\s+files?|supplement(?:ary|al)\s+(?:materials?|files?|tables?|figures?|data|information)"
    r"|supporting\s+information|(?:figure|fig\.?|table|movie|video|data|appendix)(?=\s+s?\d)"
    r"|\S*moesm\d+(?:_esm)?)"
    r"(?:\s+s?\d+[a-z]?)?\s*[:.]?\s+(?:of|from|for)\s"
)


#: Letters whose case folding is more than their lower case.
FOLDS = {"ß": "ss", "ſ": "s", "ς": "σ", "µ": "μ", "ŉ": "ʼn", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value evaluated one time, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def collapse_ws(c: Column) -> Column:
    """One space for every run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text_or_empty(c), r"\s+", " "))


def title_head(c: Column) -> Column:
    """Lower case, the part before the first colon."""
    return collapse_ws(F.split_part(F.lower(text_or_empty(c)), F.lit(":"), F.lit(1)))


def title_key(c: Column) -> Column:
    """Letters and digits of a title, entities dropped."""
    t = F.regexp_replace(F.lower(text_or_empty(c)), "&[a-z]+;", " ")
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def _n_words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def title_match_key(c: Column) -> Column:
    """Title key without a short version tail after a full stop, unless the tail numbers a part."""
    t = text_or_empty(c)
    tail = F.regexp_extract(t, TITLE_TAIL, 1)
    head = F.regexp_replace(t, TITLE_TAIL, "")
    cut = (tail != "") & (_n_words(tail) <= 6) & (_n_words(head) >= 4) & ~tail.rlike(TITLE_TAIL_PART)
    return title_key(title_head(F.when(cut, head).otherwise(t)))


def doi_key(c: Column) -> Column:
    """Lower case, resolver prefix dropped; empty if there is none."""
    return F.regexp_replace(F.lower(F.trim(text_or_empty(c))), DOI_PREFIX, "")


def abstract_key(c: Column) -> Column:
    """First 200 letters and digits behind any leading label; empty if there are fewer."""
    a = F.regexp_replace(F.ltrim(F.lower(text_or_empty(c))), ABSTRACT_LABEL, "")
    a = F.regexp_replace(a, "[^a-z0-9]+", "")
    return F.when(F.length(a) >= ABSTRACT_KEY_CHARS, F.substring(a, 1, ABSTRACT_KEY_CHARS)).otherwise("")


def padded(c: Column) -> Column:
    """Lower case, every other run than letters and digits one space, padded for whole-phrase matches."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9]+", " ")), F.lit(" "))


def phrase_in(hay: Column, needle: Column) -> Column:
    """Whole-phrase containment of padded texts."""
    return (F.trim(needle) != "") & hay.contains(needle)


def phrase_count(hay: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a padded phrase."""
    n = F.trim(needle)
    one = F.concat(F.lit(" "), n, F.lit(" "))
    return F.when(n == "", 0).otherwise(((F.length(hay) - F.length(F.replace(hay, one, F.lit("")))) / F.length(one)).cast("int"))


def quote_form(c: Column) -> Column:
    """All white space removed, case folded."""
    t = F.lower(F.regexp_replace(text_or_empty(c), r"(?U)\s+", ""))
    for sign, folded in FOLDS.items():
        t = F.replace(t, F.lit(sign), F.lit(folded))
    return t


def cap_at_sentence(c: Column, limit: int) -> Column:
    """At most limit characters; cut behind the last full stop past the middle, if there is one."""
    t = text_or_empty(c)
    cut = F.substring(t, 1, limit)
    back = F.greatest(
        F.when(F.locate(" .", F.reverse(cut)) > 0, limit - F.locate(" .", F.reverse(cut)) - 1).otherwise(-1),
        F.when(F.locate("。", F.reverse(cut)) > 0, limit - F.locate("。", F.reverse(cut))).otherwise(-1),
    )
    return F.when(F.length(t) <= limit, t).otherwise(F.when(back > limit // 2, F.substring(cut, F.lit(1), back + 1)).otherwise(cut))


def prose_ratio(c: Column) -> Column:
    """Share of letters, digits, white space and plain punctuation."""
    t = text_or_empty(c)
    marks = "".join("\\" + m if m in "[]-&" else m for m in PROSE_MARKS)
    good = F.length(F.regexp_replace(t, rf"[^\p{{L}}\p{{N}}\s{marks}]", ""))
    return F.when(F.length(t) == 0, 0.0).otherwise(good / F.length(t))


def letter_counts(c: Column) -> tuple[Column, Column]:
    """Number of letters, and of letters beyond code point 0x24F."""
    letters = F.regexp_replace(text_or_empty(c), r"[^\p{L}]", "")
    return F.length(letters), F.length(F.regexp_replace(letters, "[\\x{0}-\\x{24F}]", ""))


def non_latin_share(c: Column) -> Column:
    """Share of letters beyond code point 0x24F."""
    letters, far = letter_counts(c)
    return F.when(letters == 0, 0.0).otherwise(far / letters)


def sentences(c: Column) -> Column:
    """Trimmed, non-empty sentences."""
    return F.filter(F.transform(F.split(text_or_empty(c), r"\.(?=\s|$)"), lambda s: F.trim(s)), lambda s: s != "")


def number_tokens(c: Column) -> Column:
    """Numbers in a text, decimal commas as points."""
    return F.transform(F.regexp_extract_all(text_or_empty(c), F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(".")))


def unsupported_numbers(claim: Column, source: Column) -> Column:
    """Numbers that the claim has and the source does not."""
    return F.array_except(number_tokens(claim), number_tokens(source))


def short_id(c: Column) -> Column:
    """The W-number of an id or url, else the id itself."""
    t = text_or_empty(c)
    w = F.regexp_extract(t, r"(W\d+)", 1)
    return F.when(w != "", w).otherwise(t)


def strip_id(c: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(text_or_empty(c), "/", -1)


def theme_hash(c: Column) -> Column:
    return F.substring(F.sha2(text_or_empty(c), 256), 1, 16)


def clean_query(c: Column) -> Column:
    """Quotes at the ends and cross-product signs dropped."""
    q = F.trim(F.trim(F.trim(text_or_empty(c)), F.lit('"')), F.lit("'"))
    for sign in (" x ", " X ", " × ", "×"):
        q = F.replace(q, F.lit(sign), F.lit(" "))
    return collapse_ws(q)


def sanitize_filter_value(c: Column) -> Column:
    return collapse_ws(F.translate(text_or_empty(c), ",|!:", "    "))


def is_supplement_title(c: Column) -> Column:
    return F.coalesce(c.rlike(SUPPLEMENT_TITLE), F.lit(False))


def arxiv_id(c: Column) -> Column:
    """An arXiv id in a DOI or url: the old form first, then the new one; null if there is none."""
    t = text_or_empty(c)
    old = F.regexp_extract(t, r"(?i)(?:arxiv[.:/]|/abs/|/pdf/)([a-z\-]+(?:\.[a-z]{2})?/\d{7})", 1)
    new = F.regexp_extract(t, r"(?i)(?:arxiv[.:/]|/abs/|/pdf/)(\d{4}\.\d{4,5})", 1)
    return F.when(old != "", old).when(new != "", new)


def simple_summary(c: Column, *, chars: int = 120) -> Column:
    """The first characters, with dots where the text goes on."""
    t = text_or_empty(c)
    return F.when(F.length(t) <= chars, t).otherwise(F.concat(F.substring(t, 1, chars), F.lit("...")))


def seed_text(overview: Column, problem: Column, abstract: Column, *, far: float = 0.5) -> Column:
    """The prose that a semantic search starts from: overview and problem, or an abstract where they are mostly non-Latin."""
    own = F.concat_ws(" ", F.nullif(collapse_ws(overview), F.lit("")), F.nullif(collapse_ws(problem), F.lit("")))
    return F.when((non_latin_share(own) > far) & (collapse_ws(abstract) != ""), collapse_ws(abstract)).otherwise(own)


def structured_summary(c: Column, *, n: int = 3, chars: int = 160) -> Column:
    """The first sentences, cut at a word."""
    joined = F.array_join(F.slice(sentences(c), 1, n), ". ")
    whole = F.when(joined != "", F.concat(joined, F.lit("."))).otherwise("")
    cut = F.regexp_replace(F.substring(whole, 1, chars), r"\s+\S*$", "")
    return F.when(F.length(whole) <= chars, whole).otherwise(F.concat(cut, F.lit("...")))


def keyword_fit(strong: Column, body: Column, include: Sequence[str], exclude: Sequence[str] = (), *, scale: int, penalty: int = 10, most: int = 20) -> Column:
    """struct(credit_e6, score, exclude_hits, matched): how much of the keyword set a record covers.

    A keyword in the identity text earns full credit, in the body text its density a 10,000
    characters, at most one. credit_e6 is the sum in millionths.
    """
    terms = [t.strip() for t in include if t and t.strip()]
    drop = [t.strip() for t in exclude if t and t.strip()]

    def credit(r: Column, t: str) -> Column:
        n = padded(F.lit(t))
        part = F.least(phrase_count(r["b"], n) / r["u"], F.lit(1.0))
        return F.when(phrase_in(r["s"], n), 1.0).when(F.trim(r["b"]) != "", part).otherwise(0.0)

    def parts(r: Column, credits: Column) -> Column:
        total = F.aggregate(credits, F.lit(0.0), lambda x, y: x + y)
        hits = sum(((phrase_in(r["s"], padded(F.lit(t))) | phrase_in(r["b"], padded(F.lit(t)))).cast("int") for t in drop), F.lit(0))
        covered = total / len(terms) if terms else F.lit(0.0)
        score = F.greatest(F.bround(covered * scale, 0).cast("int") - F.least(hits * penalty, F.lit(most)), F.lit(0))
        names = F.array(*map(F.lit, terms)).cast("array<string>")
        matched = F.array_compact(F.zip_with(names, credits, lambda n, c: F.when(c > 0, n)))
        return F.struct(F.floor(total * 1_000_000 + 0.5).cast("long").alias("credit_e6"), score.alias("score"), hits.alias("exclude_hits"), matched.alias("matched"))

    unit = F.greatest(F.length(text_or_empty(body)), F.lit(1000)) / F.lit(10000.0)
    normal = F.struct(padded(strong).alias("s"), padded(body).alias("b"), unit.alias("u"))
    return once(normal, lambda r: once(F.array(*[credit(r, t) for t in terms]).cast("array<double>"), lambda c: parts(r, c)))
