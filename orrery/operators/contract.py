"""Contracts on what a caller sends back: grounding, echo completeness, classes of thin abstracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.operators import gates

ECHO = ("title", "abstract", "year", "venue", "cited_by_count")


def grounding(theme_text: Column) -> Column:
    """array<string> of failures of relationship/serendipity_rationale against theme_quote and source_quote; empty if grounded.

    An empty text to match against is unverifiable, which is not a mismatch.
    """
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    prose = filled("relationship") | filled("serendipity_rationale")
    theme, theme_q = T.quote_form(theme_text), T.quote_form(F.col("theme_quote"))
    own = T.quote_form(F.concat(T.text_or_empty(F.col("title")), F.lit(" "), T.text_or_empty(F.col("abstract"))))
    own_q = T.quote_form(F.col("source_quote"))

    def side(name: str, quote: Column, hay: Column) -> Column:
        return F.when(F.length(quote) < T.QUOTE_MIN_CHARS, f"{name}_missing").when(hay == "", f"{name}_unverifiable").when(~hay.contains(quote), f"{name}_mismatch")

    return F.when(prose, F.array_compact(F.array(side("theme", theme_q, theme), side("source", own_q, own)))).otherwise(F.array().cast("array<string>"))


def unverifiable(failures: Column) -> Column:
    return F.exists(failures, lambda f: f.endswith("_unverifiable"))


def empty_echo() -> Column:
    """Recommended fields that came back empty (blank counts for title, abstract and venue)."""
    blank = lambda c: F.col(c).isNull() | ((F.trim(F.col(c).cast("string")) == "") if c in ("title", "abstract", "venue") else F.lit(False))
    return F.array_compact(F.array(*[F.when(blank(c), F.lit(c)) for c in ECHO]))


#: Words that an echo may add to its title, words and letters of a heading, its share of capitals.
ECHO_WORDS, HEADING_WORDS, HEADING_LETTERS, HEADING_CAPITALS = 25, 40, 20, 0.9


def title_only_class(title: Column, abstract: Column) -> Column:
    """title_echo: the abstract holds the title as one run and little more; title_fragment: it has no word beside the
    title's; caps_heading: a short text in capitals; else null."""
    words = lambda c: F.regexp_extract_all(F.lower(T.text_or_empty(c)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    run = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    letters = F.regexp_replace(T.text_or_empty(abstract), r"\P{L}", "")
    capitals = F.length(F.regexp_replace(letters, r"\P{Lu}", ""))

    def judged(t: Column, a: Column) -> Column:
        echo = (F.size(t) >= 3) & (F.size(a) <= F.size(t) + ECHO_WORDS) & run(a).contains(run(t))
        fragment = (F.size(t) > 0) & (F.size(F.array_except(a, t)) == 0) & (F.size(a) <= F.size(t))
        heading = (F.size(a) <= HEADING_WORDS) & (F.length(letters) >= HEADING_LETTERS) & (capitals >= HEADING_CAPITALS * F.length(letters))
        return F.when(F.size(a) == 0, None).when(echo, "title_echo").when(fragment, "title_fragment").when(heading, "caps_heading")

    return T.once(F.struct(words(title).alias("t"), words(abstract).alias("a")), lambda r: judged(r["t"], r["a"]))


def score_row(rows: DataFrame) -> DataFrame:
    """rows plus purpose_pct between 0 and 100 and fine_rank (null without a percentage), scores between 0 and 1."""
    unit = lambda c: F.greatest(F.least(F.col(c).cast("double"), F.lit(1.0)), F.lit(0.0))
    rows = rows.withColumn("purpose_sim", unit("purpose_sim")).withColumn("mechanism_dist", unit("mechanism_dist"))
    pct = F.when(F.col("purpose_pct").isNotNull(), F.greatest(F.least(F.col("purpose_pct"), F.lit(100)), F.lit(0)))
    return rows.withColumn("purpose_pct", pct).withColumn("fine_rank", F.round(pct / 100.0 * F.col("mechanism_dist"), 4))


def theme_text(theme: dict[str, Column]) -> Column:
    """The submitted text that a theme quote may come from: overview, goal, problem, assumptions, concern."""
    parts = [theme[c] for c in ("theme_overview", "goal", "why_problem") if c in theme]
    parts += [F.array_join(theme["assumptions"], " ")] if "assumptions" in theme else []
    parts += [theme["concern"]] if "concern" in theme else []
    return F.concat_ws(" ", *[F.nullif(T.text_or_empty(p), F.lit("")) for p in parts])


def score_only() -> Column:
    """Neither title nor abstract came back, and the source did not mark them as empty."""
    marked = F.coalesce(F.col("upstream_empty"), F.array().cast("array<string>"))
    gone = lambda c: F.col(c).isNull() & ~F.array_contains(marked, c)
    return gone("title") & gone("abstract")


def echo_gaps() -> Column:
    """struct(upstream, missing): which recommended fields are empty because the source was, and which the caller left out.

    A field that came back blank, or that the source marked, is the source's; one that did not come back is the caller's.
    """
    marked = F.coalesce(F.col("upstream_empty"), F.array().cast("array<string>"))
    return T.once(empty_echo(), lambda e: F.struct(_of_source(e, marked).alias("upstream"), F.array_except(e, _of_source(e, marked)).alias("missing")))


def _of_source(empty: Column, marked: Column) -> Column:
    there = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in ECHO]))
    return F.filter(empty, lambda c: F.array_contains(marked, c) | F.array_contains(there, c))


#: What a model's row must have, and the label of a connection without one.
REQUIRED, UNLABELLED = ("id", "purpose_sim", "mechanism_dist"), "構造的接続"
MODEL_ROW = "struct<id:string,purpose_level:string,purpose_sim:string,mechanism_dist:string,purpose_pct:string,connection_label:string,serendipity_rationale:string,paper_purpose:string,paper_mechanism:string,paper_finding:string>"


def model_rows(answers: DataFrame, payload: str = "payload") -> DataFrame:
    """The score rows of models' answers (a JSON array each), with the answers' other columns: id, purpose_sim, mechanism_dist, purpose_pct, fine_rank, the texts, complete.

    A named level gives its value, else the number, 0 where there is none; a row without an id or with a distance that is no
    number goes; complete rows have a label and a rationale. An answer that is no array gives no rows.
    """
    kept = [c for c in answers.columns if c != payload]
    rows = answers.select(*kept, F.explode(F.from_json(payload, "array<string>")).alias("one")).select(*kept, F.from_json("one", MODEL_ROW).alias("m"))  # an item that is no object spoils only itself
    m = lambda c: F.col(f"m.{c}")
    number = lambda c, instead: F.coalesce(F.when(m(c).isNull(), instead), F.expr(f"try_cast(m.{c} AS DOUBLE)"))
    unit = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    level = F.lit(None).cast("double")
    for name, v in gates.LEVELS.items():
        level = F.when(F.lower(F.trim(m("purpose_level"))) == name, v).otherwise(level)
    purpose = unit(F.coalesce(level, number("purpose_sim", 0.0), F.lit(0.0)))
    pct = F.greatest(F.least(F.coalesce(F.expr("try_cast(try_cast(m.purpose_pct AS DOUBLE) AS INT)"), F.lit(0)), F.lit(100)), F.lit(0))
    text = lambda c: T.text_or_empty(m(c))
    rows = rows.where(m("id").isNotNull() & (m("id") != "")).withColumn("__d", number("mechanism_dist", 0.0)).where("__d IS NOT NULL AND NOT isnan(__d)")
    return rows.select(
        *kept, m("id").alias("id"), purpose.alias("purpose_sim"), unit(F.col("__d")).alias("mechanism_dist"), pct.alias("purpose_pct"), F.round(pct / 100.0 * unit(F.col("__d")), 4).alias("fine_rank"),
        F.when(text("connection_label") == "", UNLABELLED).otherwise(m("connection_label")).alias("connection_label"), text("serendipity_rationale").alias("serendipity_rationale"),
        text("paper_purpose").alias("paper_purpose"), text("paper_mechanism").alias("paper_mechanism"), text("paper_finding").alias("paper_finding"), ((text("connection_label") != "") & (text("serendipity_rationale") != "")).alias("complete"),
    )


def missing_fields(rows: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """rows' id, pos and missing (array): those that lack a required field."""
    gaps = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    return rows.select("id", "pos", gaps.alias("missing")).where(F.size("missing") > 0)


def checked(rows: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """rows, unless one lacks a required field: then an error that names the first one and its field. An action."""
    first = missing_fields(rows, required).orderBy("pos").limit(1).collect()
    if first:
        raise ValueError(f"candidate #{first[0].pos} lacks the required field '{first[0].missing[0]}'")
    return rows


def submission_report(rows: DataFrame, rendered: DataFrame) -> DataFrame:
    """id, what, fields of what a caller should know of its rows: score_only, unwritten, upstream_empty, missing.

    rendered: id, failed (its quotes did not hold, so its prose was dropped on purpose). A row of scores alone that is not
    rendered gets one line and no list of fields.
    """
    shown = rendered.select(F.col("id").alias("__id"), F.coalesce("failed", F.lit(False)).alias("__failed"))
    j = rows.join(F.broadcast(shown), F.col("id") == F.col("__id"), "left").withColumn("__gaps", echo_gaps()).withColumn("__only", score_only() & F.col("__id").isNull())
    none = F.array().cast("array<string>")
    unwritten = F.col("__id").isNotNull() & ~F.col("__failed") & (F.trim(T.text_or_empty(F.col("relationship"))) == "")
    said = [
        F.when(F.col("__only"), F.struct(F.lit("score_only").alias("what"), none.alias("fields"))), F.when(unwritten, F.struct(F.lit("unwritten").alias("what"), none.alias("fields"))),
        F.when(~F.col("__only") & (F.size("__gaps.upstream") > 0), F.struct(F.lit("upstream_empty").alias("what"), F.col("__gaps.upstream").alias("fields"))),
        F.when(~F.col("__only") & (F.size("__gaps.missing") > 0), F.struct(F.lit("missing").alias("what"), F.col("__gaps.missing").alias("fields"))),
    ]
    return j.select("id", F.explode(F.array_compact(F.array(*said))).alias("e")).select("id", "e.what", "e.fields")


def envelope(c: Column) -> Column:
    """Untrusted text between marks that it cannot close itself."""
    inner = F.replace(F.replace(T.text_or_empty(c), F.lit("<<<"), F.lit("< < <")), F.lit(">>>"), F.lit("> > >"))
    return F.concat(F.lit("<<<external\n"), inner, F.lit("\nexternal>>>"))


def theme_errors() -> Column:
    """array<string>: what a theme row breaks (overview 200 to 1200 characters, 2 to 5 assumptions, 5 keywords a list, three enums)."""
    n = F.length(F.trim(T.text_or_empty(F.col("theme_overview"))))
    size = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>")))
    checks = [
        ("theme_overview", (n < 200) | (n > 1200)), ("goal", F.trim(T.text_or_empty(F.col("goal"))) == ""), ("why_problem", F.trim(T.text_or_empty(F.col("why_problem"))) == ""),
        ("assumptions", (size("assumptions") < 2) | (size("assumptions") > 5)), ("keywords_include", size("keywords_include") > 5), ("keywords_exclude", size("keywords_exclude") > 5),
        ("approach_type", ~F.coalesce(F.col("approach_type").isin("theory", "experiment", "application"), F.lit(False))), ("scale", ~F.coalesce(F.col("scale").isin("small", "large", "theoretical"), F.lit(False))),
        ("time_range", ~F.coalesce(F.col("time_range").isin("last_10_years", "no_limit"), F.lit(False))),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]))
