"""Duplicate records: single keys by windows, several keys by components, or in order by rounds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.lineage import cut

#: Rows that a last pass in order may hold; while more are open, rounds go on.
TAIL = 200_000


def key_edges(rows: DataFrame, keys: Sequence[str], *, key: str = "id") -> DataFrame:
    """a, b: each row with the smallest row that has the same non-empty key; a key of any size gives a star, not pairs."""
    out = None
    for k in keys:
        named = rows.select(F.col(key).alias("b"), F.col(k).alias("k")).where("k <> ''")
        hub = named.groupBy("k").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1")
        edge = named.join(hub, "k").where("a <> b").select("a", "b")
        out = edge if out is None else out.unionByName(edge)
    return out.distinct()


def duplicate_groups(nodes: DataFrame, edges: DataFrame, *, key: str = "id", max_rounds: int = 50) -> DataFrame:
    """id, grp: the smallest id reachable. Rounds of min labels with pointer jumping; each round's labels are written.

    Edges inside one label are dropped as rounds go, and only nodes with an edge take part. A number of
    rounds that would take more than max_rounds is an error: groups are never left unfinished.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    touched = both.select(F.col("a").alias("id")).distinct()
    labels = cut(touched.select("id", F.col("id").alias("grp")))
    for _ in range(max_rounds):
        said = both.join(labels, both.a == labels.id).groupBy(F.col("b").alias("id")).agg(F.min("grp").alias("said"))
        near = labels.join(said, "id", "left").select("id", F.col("grp").alias("old"), F.least("grp", F.coalesce("said", "grp")).alias("near"))
        jump = labels.select(F.col("id").alias("near"), F.col("grp").alias("far"))
        new = cut(near.join(jump, "near", "left").select("id", F.least("near", F.coalesce("far", "near")).alias("grp"), "old"))
        labels = new.select("id", "grp")
        if new.where("grp <> old").isEmpty():
            break
    else:
        raise RuntimeError(f"groups are not finished after {max_rounds} rounds")
    alone = nodes.select(F.col(key).alias("id")).join(labels.select("id"), "id", "left_anti")
    return labels.unionByName(alone.select("id", F.col("id").alias("grp")))


def first_of_all_keys(rows: DataFrame, keys: Sequence[str], *, pos: str = "pos", theme: str | None = None, tail: int = TAIL) -> DataFrame:
    """The rows that a pass in the order of pos (unique) keeps: a row goes if a kept row has one of its non-empty keys; what goes holds no key.

    In rounds: a row that is the first open one of all its keys stays, and the open rows that share a key with it go.
    Which rows stay depends on all before them, so an ill-ordered chain needs a round for every two rows: once at most
    ``tail`` rows are open, one task passes over what is left of them in order. Keys of different themes never meet.
    """
    own = [F.when(T.text_or_empty(F.col(k)) != "", F.concat_ws("\x1f", *([F.col(theme).cast("string")] if theme else []), F.lit(str(i)), F.col(k))) for i, k in enumerate(keys)]
    named = rows.withColumn("__keys", F.filter(F.array(*own), lambda k: k.isNotNull()))
    open_ = cut(named.select(F.col(pos).alias("p"), F.explode("__keys").alias("k")))
    stay = None
    while (left := open_.agg(F.count_distinct("p")).first()[0]) > tail:
        marked = open_.join(open_.groupBy("k").agg(F.min("p").alias("first")), "k")
        won = cut(marked.groupBy("p").agg(F.bool_and(F.col("p") == F.col("first")).alias("won")).where("won").select("p"))
        beaten = marked.where("p <> first").join(won.select(F.col("p").alias("first")), "first", "left_semi").select("p")
        open_ = cut(open_.join(won.unionByName(beaten).distinct(), "p", "left_anti"))
        stay = won if stay is None else stay.unionByName(won)
    if left:
        listed = open_.groupBy("p").agg(F.collect_list("k").alias("k")).coalesce(1).sortWithinPartitions("p")
        last = listed.mapInArrow(_pass, f"p {dict(open_.dtypes)['p']}")
        stay = last if stay is None else stay.unionByName(last)
    free = named.where(F.size("__keys") == 0).drop("__keys")
    if stay is None:
        return free
    return free.unionByName(named.where(F.size("__keys") > 0).drop("__keys").join(stay.select(F.col("p").alias(pos)), pos, "left_semi").select(*free.columns))


def _pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: set[str] = set()
    for batch in batches:
        kept = []
        for i, ks in enumerate(batch.column(1).to_pylist()):
            if held.isdisjoint(ks):
                held.update(ks)
                kept.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64()))], ["p"])


def exclude_used(rows: DataFrame, used_ids: DataFrame, used_titles: DataFrame, used_dois: DataFrame, *, id_key: str, title_key: str, doi_key: str) -> DataFrame:
    """Rows whose id, title key and DOI key are all unused: three hash anti-joins, no OR-join; empty keys never match."""
    for used, c in ((used_ids, id_key), (used_titles, title_key), (used_dois, doi_key)):
        names = used.select(F.col(used.columns[0]).alias("__used")).where("__used <> ''").distinct()
        rows = rows.join(names, F.col(c) == F.col("__used"), "left_anti")
    return rows
