"""Sinks: JSON lines of candidate materials and text reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import text as T


#: Fixed value: characters that a cut abstract keeps at least.
ABSTRACT_LEAST = 200


def material_options(lean: object = None, chars: object = None) -> dict[str, object]:
    """Options of material() from what a caller asks for: no cut for 0, nothing or what is no number, else at least ABSTRACT_LEAST."""
    try:
        cut = int(chars or 0)
    except (TypeError, ValueError):
        cut = 0
    return {"lean": bool(lean), "abstract_chars": max(cut, ABSTRACT_LEAST) if cut > 0 else None}


def material(*, abstract_chars: int | None = None, lean: bool = False) -> Column:
    """A work as one JSON text; lean leaves out concepts and references; a cut abstract carries its full length."""
    whole = T.text_or_empty(F.col("abstract"))
    cut = F.substring(whole, 1, abstract_chars) if abstract_chars else whole
    cols = [F.col("id"), F.col("title"), cut.alias("abstract"), F.col("year"), F.col("venue"), F.col("doi"), F.col("cited_by_count")]
    if abstract_chars:
        cols.append(F.when(F.length(whole) > abstract_chars, F.length(whole)).alias("abstract_full_chars"))
    if not lean:
        cols += [F.col("concepts"), F.col("refs")]
    return F.to_json(F.struct(*cols))


#: Schema of a material that comes back.
MATERIAL = "struct<id:string,title:string,abstract:string,year:int,venue:string,doi:string,cited_by_count:long,abstract_full_chars:int,concepts:array<string>,refs:array<string>>"


def works_of_materials(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Works from materials as they come back; what is missing has the defaults of a work."""
    m = rows.select(F.from_json(payload, MATERIAL).alias("m")).select("m.*")
    none = F.array().cast("array<string>")
    return m.select(T.text_or_empty(F.col("id")).alias("id"), T.text_or_empty(F.col("title")).alias("title"), "abstract", F.coalesce("year", F.lit(0)).alias("year"), T.text_or_empty(F.col("venue")).alias("venue"), "doi", F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"), F.coalesce("concepts", none).alias("concepts"), F.coalesce("refs", none).alias("refs"))


def spread_material(**options) -> Column:
    """A material with one field a line."""
    return F.to_json(F.from_json(material(**options), MATERIAL), {"pretty": "true"})


def abstract_tail(c: Column, limit: int) -> Column:
    """The last characters, from a sentence that starts in their first fifth, else from the first word that does in their first 30."""
    t = T.text_or_empty(c)
    end = F.right(t, F.lit(limit))
    head = F.length(F.regexp_extract(end, r"""(?s)^(.*?[.!?]\s+)(?=[A-Z0-9("'])""", 1))
    space = F.locate(" ", F.substring(end, 1, 30))
    inside = ~F.substring(t, F.length(t) - limit, F.lit(1)).rlike(r"^\s$")
    cut = F.when((head > 0) & (head <= limit // 5), head).when((space > 0) & inside, space).otherwise(0)
    return F.when(F.length(t) <= limit, t).otherwise(F.substring(end, cut + 1, F.lit(limit)))


def cut_for_budget(rows: DataFrame, *, budget: int, text: str = "abstract", other: int = 0) -> DataFrame:
    """One row: the longest cut of every text so that all rows together keep within a budget of characters (null: no cut needed).

    A histogram of lengths decides, so no text travels: with n texts above the cut and s characters in the others,
    the cut is the largest c with s + n c below what is left.
    """
    sizes = rows.select(F.length(T.text_or_empty(F.col(text))).alias("len")).groupBy("len").agg(F.count("*").alias("n"))
    up = W.orderBy("len").rowsBetween(W.unboundedPreceding, W.currentRow)  # lengths are few, whatever the rows
    below = sizes.withColumn("shorter", F.sum(F.col("len") * F.col("n")).over(up)).withColumn("longer", F.sum("n").over(W.orderBy(F.col("len").desc())) - F.col("n"))
    left = F.lit(budget - other)
    fits = below.where((F.col("longer") > 0) & (F.col("shorter") + F.col("longer") * F.col("len") <= left))
    best = fits.agg(F.max(F.floor((left - F.col("shorter")) / F.col("longer"))).alias("cut"), F.max("len").alias("at"))
    whole = sizes.agg(F.coalesce(F.sum(F.col("len") * F.col("n")), F.lit(0)).alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    flat = F.greatest(F.floor(left / F.greatest(F.col("rows"), F.lit(1))), F.lit(0))
    return whole.join(best, how="cross").select(F.when(F.col("total") > left, F.coalesce("cut", flat)).cast("long").alias("cut"))  # one row each


def write_materials(works: DataFrame, path: str, **options) -> None:
    works.select(material(**options).alias("value")).write.mode("overwrite").text(path)


def markdown_rows(ranked: DataFrame, *, pos: str = "pos") -> DataFrame:
    """One Markdown block a ranked row; ordered by pos."""
    head = F.concat(F.lit("## "), (F.col(pos) + 1).cast("string"), F.lit(". "), T.text_or_empty(F.col("title")))
    meta = F.concat_ws(" / ", F.col("year").cast("string"), F.nullif(T.text_or_empty(F.col("venue")), F.lit("")), F.concat(F.lit("cited by "), F.col("cited_by_count").cast("string")))
    return ranked.select(pos, F.concat_ws("\n", head, meta, T.structured_summary(F.col("abstract"))).alias("block"))


def render_markdown(ranked: DataFrame, title: str, *, pos: str = "pos", limit: int = 200) -> str:
    """A report of a bounded ranking; an action that collects at most limit blocks."""
    blocks = [r.block for r in markdown_rows(ranked, pos=pos).orderBy(pos).limit(limit).collect()]
    return "\n\n".join([f"# {title}", *blocks]) + "\n"


def size_by_field(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """field, chars: how much each field weighs in JSON."""
    sums = rows.agg(*[F.sum(F.length(F.to_json(F.struct(c)))).alias(c) for c in fields])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("chars")) for c in fields])).alias("e")).select("e.*")
