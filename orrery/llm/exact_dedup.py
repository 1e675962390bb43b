"""Exact duplicates by content-defined chunk recipes; built-in functions only.

A text is cut into chunks where its own characters say so. Chunks are deduplicated to
identifiers: a 64-bit hash, which counts as an identifier only after all different chunks of
the corpus have been seen to have different hashes (else the next, wider hash is tried). A
text's recipe is the ordered list of its chunks' identifiers, so equal recipes mean equal
texts, to the byte. Texts move once, as different chunks; what is grouped, joined and
compared after that are the recipes.

Null text counts as empty, an empty text has the empty recipe. A null id is smaller than
every other; a group of null ids only keeps one of its rows under keep_id null. Of rows
that repeat an id and a text one stays: the others have the same keep_id and kept = false. Extra
columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import materialize

#: A chunk ends behind a space between these letters (about one place in a thousand of prose), at the latest after LONGEST characters.
BORDER = r"[aelnst][dehnrst]\x20(?=[a-dA-DtÀ-ɏ])"
SHORTEST, LONGEST = 256, 8192
#: A group of at least this share of all rows is joined by broadcast: there are at most 1 / HOT of them.
HOT = 1 / 1000
#: Bytes of recipes in such a broadcast; beyond it they are joined as the others are.
BROADCAST_BYTES = 32 << 20

#: Identifiers in the order in which they are tried.
IDENTIFIERS: tuple[Callable[[Column], Column], ...] = (
    lambda chunk: F.xxhash64(chunk),
    lambda chunk: F.xxhash64(F.lit("orrery"), chunk),
    lambda chunk: F.unhex(F.sha2(chunk, 256)),
)


def chunks(text: Column, *, border: str = BORDER, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """The text's chunks in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{shortest},{longest}}}?(?:{border})|.{{1,{longest}}}"), F.lit(0))


def verified(pieces: DataFrame, name: Callable[[Column], Column]) -> bool:
    """Whether all different chunks (column chunk) have different identifiers; chunks are compared as they are."""
    different = pieces.select(name(F.col("chunk")).alias("id"), "chunk").groupBy("id", "chunk").agg(F.lit(1).alias("one"))
    return different.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def recipes(texts: DataFrame, identifiers: Sequence[Callable[[Column], Column]] = IDENTIFIERS, **cut: object) -> DataFrame:
    """texts with the column recipe: the ordered, verified identifiers of each text's chunks."""
    pieces = texts.select(F.explode(chunks(F.col("text"), **cut)).alias("chunk"))
    for name in identifiers:
        if verified(pieces, name):
            return texts.withColumn("recipe", F.transform(chunks(F.col("text"), **cut), name))
    raise ValueError("different chunks share an identifier of every kind")


def exact_duplicates(
    docs: DataFrame,
    *,
    normalise: Callable[[Column], Column] = lambda text: text,
    hot: float = HOT,
    identifiers: Sequence[Callable[[Column], Column]] = IDENTIFIERS,
    **cut: object,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs (doc_id, text).

    Texts are equal when they are the same after normalise; of equal texts the row with the
    largest doc_id stays. Groups of at least the share hot of all rows meet their rows by
    broadcast, so that no task gets a whole group; all others by a shuffled join.
    """
    texts = docs.select("doc_id", F.coalesce(normalise(F.col("text")), F.lit("")).alias("text"))
    rows = recipes(texts, identifiers, **cut).select("doc_id", F.monotonically_increasing_id().alias("row"), "recipe", F.unhex(F.sha2("text", 256)).alias("sha"))
    rows = materialize(rows, what="recipes")
    groups = rows.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("stays"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = materialize(groups, what="groups")
    large = F.col("group_size") >= max(2, int(rows.count() * hot))
    size = groups.where(large).agg(F.sum(F.size("recipe") * 32 + 64)).first()[0] or 0
    if size > BROADCAST_BYTES:
        found = rows.join(groups, "recipe", "left")
    else:
        few = F.broadcast(groups.where(large))
        found = rows.join(few, "recipe").unionByName(rows.join(few, "recipe", "left_anti").join(groups.where(~large), "recipe", "left"))
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("stays.row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
