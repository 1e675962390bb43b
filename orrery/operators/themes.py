"""Themes as rows: query texts, anchors and route parameters, and the near-field collection that starts from them.

A theme row: theme (key), theme_overview, goal, why_problem, concern, assumptions, scope_field, keywords_include,
keywords_exclude.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.lineage import cut
from orrery.operators import dedup, gates, stats

THEME = "struct<theme_overview:string,goal:string,why_problem:string,approach_type:string,assumptions:array<string>,scope:struct<field:string,scale:string,time_range:string>,keywords:struct<include:array<string>,exclude:array<string>>,concern:string>"
#: Characters of a semantic query and of its shorter retry, facets of a theme, seeds that expansion needs and takes.
SEMANTIC_CHARS, SEMANTIC_RETRY_CHARS, FACETS, PRF_LEAST, PRF_POOL = 1200, 600, 3, 3, 20


def load_themes(spark: SparkSession, path: str) -> DataFrame:
    """One theme a JSON file; unknown keys are ignored, a file that is no object gives nulls."""
    return parse_themes(spark.read.text(path, wholetext=True))


def parse_themes(raw: DataFrame, value: str = "value") -> DataFrame:
    """raw's other columns and the theme that each JSON text holds."""
    kept = [c for c in raw.columns if c != value]
    return raw.select(*kept, F.from_json(value, THEME).alias("t")).select(*kept, "t.theme_overview", "t.goal", "t.why_problem", "t.approach_type", "t.assumptions", F.col("t.scope.field").alias("scope_field"), F.col("t.scope.scale").alias("scale"), F.col("t.scope.time_range").alias("time_range"), F.col("t.keywords.include").alias("keywords_include"), F.col("t.keywords.exclude").alias("keywords_exclude"), "t.concern")


def _terms(c: Column) -> Column:
    return F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda t: T.text_or_empty(t) != "")


def anchor_terms() -> Column:
    """The keywords; without any, field and goal."""
    words = _terms(F.col("keywords_include"))
    return F.when(F.size(words) > 0, words).otherwise(_terms(F.array("scope_field", "goal")))


def query_text() -> Column:
    return F.array_join(anchor_terms(), " ")


def theme_anchor() -> Column:
    """The first keyword, else the goal, else the field."""
    return F.coalesce(F.try_element_at(_terms(F.col("keywords_include")), F.lit(1)), F.nullif(T.text_or_empty(F.col("goal")), F.lit("")), T.text_or_empty(F.col("scope_field")))


def hub_query() -> Column:
    """What a hub that matches one fuzzy string is asked: the first keyword, else the field, else the goal."""
    return F.trim(F.coalesce(F.try_element_at(_terms(F.col("keywords_include")), F.lit(1)), F.nullif(T.text_or_empty(F.col("scope_field")), F.lit("")), T.text_or_empty(F.col("goal"))))


def rungs() -> Column:
    """array<string>: keyword prefixes from longest to shortest, then field and goal; each distinct text once, whatever its case."""
    words = _terms(F.col("keywords_include"))
    prefixes = F.when(F.size(words) > 0, F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))).otherwise(F.array().cast("array<string>"))
    every = F.filter(F.concat(prefixes, F.array(F.array_join(_terms(F.array("scope_field", "goal")), " "))), lambda s: s != "")
    return F.filter(every, lambda s, i: F.array_position(F.transform(every, lambda e: F.lower(e)), F.lower(s)) == i + 1)


def summary_text() -> Column:
    concern = F.when(T.text_or_empty(F.col("concern")) != "", F.concat(F.lit("懸念: "), F.col("concern")))
    return F.concat_ws(" / ", *[F.nullif(T.text_or_empty(F.col(c)), F.lit("")) for c in ("theme_overview", "goal", "why_problem")], concern)


def history_key(name: Column) -> Column:
    """The hash of the caller's own name of the history, else of the overview."""
    own = F.trim(T.text_or_empty(name))
    return T.theme_hash(F.when(own != "", own).otherwise(F.col("theme_overview")))


def route_params(q: gates.StructuredQuery, *, per_page: int = 50, page: int = 1) -> dict[str, Any]:
    """Request parameters of a query's route: filters, a generic search that keeps the field, or a semantic search by years only."""
    if q.route == "semantic":
        years = gates.StructuredQuery(year_from=q.year_from, year_to=q.year_to).filter_text()
        return {"per-page": min(per_page, 50), "page": page, "search.semantic": q.anchor(), **({"filter": years} if years else {})}
    base: dict[str, Any] = {"per-page": per_page, "page": page}
    if q.route == "filter" and (text := q.filter_text()):
        return {**base, "filter": text}
    fields = {"filter": "primary_topic.field.id:" + "|".join(q.field_ids)} if q.field_ids else {}
    return {**base, "search": q.anchor(), **fields}


def theme_query(theme: dict[str, Any], *, route: str = "filter") -> gates.StructuredQuery:
    """The single best query of one theme."""
    words = tuple(w for w in theme.get("keywords_include") or () if w)
    return gates.StructuredQuery(anchor_terms=words or tuple(t for t in (theme.get("scope_field"), theme.get("goal")) if t), route=route)


def theme_ladder(theme: dict[str, Any], *, assumptions: Sequence[str] = (), field_ids: Sequence[str] = ()) -> list[gates.StructuredQuery]:
    """Keyword prefixes, field and goal, then assumption sentences by generic search; all keep the theme's field."""
    base = gates.StructuredQuery(field_ids=tuple(field_ids))
    rest = " ".join(t for t in (theme.get("scope_field"), theme.get("goal")) if t)
    ladder = gates.relaxation_ladder(theme.get("keywords_include") or (), rest, base)
    known = {q.anchor() for q in ladder}
    return [*ladder, *(gates.StructuredQuery(anchor_terms=(a,), field_ids=tuple(field_ids), route="search") for a in assumptions if a and a not in known)]


def near_field(works: DataFrame, theme: dict[str, Any], *, assumptions: Sequence[str] = (), field_ids: Sequence[str] = (), limit: int = 500, expand: bool = True, stop: Sequence[str] = (), pos: str = "pos") -> DataFrame:
    """works with rung and step (ladder or expansion), in order, up to the limit: retracted ones and those without abstract go,
    the ladder and the assumptions collect first, and a thin result is widened by salient terms of its first seeds.

    works: id, title, abstract, is_retracted, pos and what StructuredQuery asks for.
    """
    rows = gates.drop_retracted(works).where(gates.has_abstract())
    first = gates.first_rung(rows, theme_ladder(theme, assumptions=assumptions, field_ids=field_ids), limit=limit, pos=pos).withColumn("step", F.lit("ladder"))
    if not expand:
        return first
    n = first.count()
    if not PRF_LEAST <= n < limit:
        return first
    seeds = first.orderBy("rung", pos, "id").limit(PRF_POOL)
    known = [w for w in (*(theme.get("keywords_include") or ()), theme.get("scope_field"), theme.get("goal")) if w]
    text = seeds.select("id", F.concat_ws(" ", "title", "abstract").alias("text"))
    terms = [r.term for r in stats.salient_terms(text, stop=tuple(stop) + tuple(x.lower() for w in known for x in w.split())).collect()]  # at most six
    if not terms:
        return first
    head = next(iter(w for w in theme.get("keywords_include") or () if w), theme.get("scope_field") or "")
    wider = [gates.StructuredQuery(anchor_terms=(head, t), field_ids=tuple(field_ids)) for t in terms]
    more = gates.first_rung(rows.join(first.select("id"), "id", "left_anti"), wider, limit=limit - n, pos=pos).withColumn("step", F.lit("expansion"))
    return first.unionByName(more)


def facets(items: Column, *, most: int = FACETS) -> Column:
    """The first facets with a text, one a domain whatever its case. items: array<struct<domain, pseudo_abstract>>."""
    clean = F.transform(F.coalesce(items, F.array().cast("array<struct<domain:string,pseudo_abstract:string>>")), lambda f: F.struct(F.trim(T.text_or_empty(f["domain"])).alias("domain"), F.trim(T.text_or_empty(f["pseudo_abstract"])).alias("pseudo_abstract")))
    real = F.filter(clean, lambda f: f["pseudo_abstract"] != "")
    return T.once(real, lambda r: F.slice(F.filter(r, lambda f, i: F.array_position(F.transform(r, lambda g: F.lower(g["domain"])), F.lower(f["domain"])) == i + 1), 1, most))


def semantic_text(structure: Column, pseudo_abstract: Column, *, chars: int = SEMANTIC_CHARS) -> Column:
    """What the semantic route is asked: structure and facet, cut at a sentence below the limit."""
    both = F.concat_ws(" ", F.nullif(T.collapse_ws(structure), F.lit("")), F.nullif(T.collapse_ws(pseudo_abstract), F.lit("")))
    return F.trim(T.cap_at_sentence(both, chars))


def semantic_leg(returned: DataFrame, *, work_type: str = "article") -> tuple[DataFrame, DataFrame]:
    """(seeds, one row of counts by stage) of a semantic search's records: retracted, other type, no abstract go in this order.

    returned: id, pos, title, abstract, is_retracted, type.
    """
    t = F.upper(T.text_or_empty(F.col("title")))
    withdrawn = F.coalesce(F.col("is_retracted"), F.lit(False)) | t.startswith("RETRACTED:") | t.startswith("WITHDRAWN:")
    stage = F.when(withdrawn, "retracted").when(~gates.type_allowed(F.col("type"), work_type), "other_type").when(~gates.has_abstract(), "no_abstract").otherwise("kept")
    rows = returned.withColumn("stage", stage)
    counts = rows.agg(F.count("*").alias("returned"), *[F.count_if(F.col("stage") == s).alias(s) for s in ("retracted", "other_type", "no_abstract", "kept")])
    return rows.where("stage = 'kept'").drop("stage"), counts


def lexical_baseline(found: DataFrame, keys: Sequence[str], *, per_query: int, limit: int, theme: str | None = None, per_page: int = 50) -> DataFrame:
    """The records that queries collect one after another, with place (from 1): found (query, pos from 0, id, keys, abstract) in order of query and pos.

    A record stays if it has an abstract and no record kept before has its id or one of its keys; a record that goes
    holds no key. A query ends behind the page with which it has kept ``per_query`` records, and what it then leaves
    unread holds no key either; ``limit`` ends a theme. Pages are settled for all themes at once; as a record depends on
    earlier ones only, the queries' ends are found from the first query on, a round each at most.
    """
    t = [theme] if theme else []
    rows = found.where(gates.has_abstract()).withColumn("__id", F.col("id").cast("string")).withColumn("__page", F.floor(F.col("pos") / per_page))
    rows = cut(rows.withColumn("__at", F.struct(*t, "query", "pos", "id")))
    while True:
        kept = cut(dedup.first_of_all_keys(rows, ["__id", *keys], pos="__at", theme=theme))
        pages = kept.groupBy(*t, "query", "__page").agg(F.count("*").alias("n"))
        upto = pages.withColumn("n", F.sum("n").over(W.partitionBy(*t, "query").orderBy("__page")))
        ends = upto.where(F.col("n") >= per_query).groupBy(*t, "query").agg(F.min("__page").alias("__end"))
        unread = rows.join(ends, [*t, "query"]).where("__page > __end").groupBy(*t).agg(F.min("query").alias("query"))
        # of each theme the first query that reads too far; the ends of later ones may still move
        over = cut(unread.join(ends, [*t, "query"]))
        if over.isEmpty():
            break
        cuts = over.select(*t, F.col("query").alias("__q"), "__end")
        met = rows.join(cuts, t) if t else rows.join(F.broadcast(cuts), how="cross")  # one row without themes
        rest = rows.join(cuts, t, "left_anti") if t else rows.where("false")
        rows = cut(met.where((F.col("query") != F.col("__q")) | (F.col("__page") <= F.col("__end"))).select(*rows.columns).unionByName(rest))
    place = F.row_number().over(W.partitionBy(*(t or [F.lit(0)])).orderBy("query", "pos"))
    if not t:
        kept = kept.orderBy("query", "pos").limit(limit)
    return kept.withColumn("place", place).where(F.col("place") <= limit).drop("__id", "__page", "__at")
