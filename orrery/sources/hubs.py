"""Anchors from hubs of models, data sets and notebooks, and archived full texts, read through injected fetchers.

A hub matches one fuzzy string, so a theme asks it with one query a kind. A source that fails raises, and the caller keeps
sources apart (anchors.collect_sources); a card that fails leaves its record without one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.lineage import cut
from orrery.operators import themes as themes_of
from orrery.sources import anchors, fulltext, readers

#: Records asked for a kind, and anchors kept.
ASKED, KEPT = 20, 30
#: Where a hub lists its kinds, how it is asked to sort them, and the names under which it may wrap a list.
HUB_LISTS = {"model": "/api/models", "dataset": "/api/datasets"}
SET_LISTS = {"dataset": ("/datasets/list", "votes"), "kernel": ("/kernels/list", "voteCount")}
WRAPPED = ("models", "datasets", "kernels", "items")


class SourceError(RuntimeError):
    pass


def items(payload: Column, wrapped: Sequence[str] = WRAPPED) -> Column:
    """array<string>: the records of an answer, a list or an object that wraps one; what is no object is left out."""
    lists = [F.from_json(payload, "array<string>"), *[F.from_json(F.get_json_object(payload, f"$.{w}"), "array<string>") for w in wrapped]]
    is_list = F.substring(F.ltrim(payload), 1, 1) == "["
    got = F.coalesce(F.when(is_list, lists[0]), *[F.when(~is_list, one) for one in lists[1:]], F.array().cast("array<string>"))
    return F.filter(got, lambda i: F.coalesce(F.substring(F.ltrim(i), 1, 1) == "{", F.lit(False)))


def _listed(asked: DataFrame, fetch: readers.Fetch, limit: int, options: dict[str, Any]) -> DataFrame:
    """kind, pos, payload: the first limit records of each list. asked: key (the kind), params."""
    got = readers.fetch_rows(asked, fetch, absent=frozenset(), **options).collect()  # one row a kind
    failed = [r for r in got if r.error is not None]
    if failed:
        raise SourceError("; ".join(f"{r.key}: {r.error}" for r in failed))
    rows = asked.sparkSession.createDataFrame([(r.key, r.payload) for r in got], "kind string, answer string")
    return rows.select("kind", F.posexplode(F.slice(items(F.col("answer")), 1, max(limit, 0))).alias("pos", "payload"))


def _query(theme: DataFrame) -> str:
    rows = theme.select(themes_of.hub_query().alias("q")).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("one theme is asked for")
    return rows[0].q


def _ranked(works: DataFrame, most: int) -> DataFrame:
    return works.orderBy(F.col("reliability_score").desc(), "kind_pos", "pos").limit(max(most, 0)).drop("kind_pos", "pos")


def collect_hub(theme: DataFrame, fetch: readers.Fetch, as_of: Column, include: Sequence[str], exclude: Sequence[str] = (), *, kinds: Sequence[str] = ("model", "dataset"), cards: readers.Fetch | None = None, limit: int = ASKED, most: int = KEPT, **options: Any) -> DataFrame | None:
    """The best hub records of one theme as works, models and data sets alike; None where the theme has nothing to ask.

    fetch answers {path, search, sort, direction, limit, full}; cards answers {path} with {"text": card}. A card is cut at 2,000
    characters by hub_to_works; one that cannot be read is empty.
    """
    query = _query(theme)
    if not query or not kinds:
        return None
    spark = theme.sparkSession
    asked = spark.createDataFrame([(k, {"path": HUB_LISTS[k], "search": query, "sort": "downloads", "direction": "-1", "limit": str(limit), "full": "true"}) for k in kinds], "key string, params map<string,string>")
    found = _listed(asked, fetch, limit, options).withColumn("name", F.coalesce(*[F.get_json_object("payload", f"$.{n}") for n in ("id", "modelId", "_id")])).where("name <> ''")
    if cards is not None:
        path = F.concat(F.when(F.col("kind") == "dataset", "/datasets/").otherwise("/"), "name", F.lit("/raw/main/README.md"))
        got = readers.fetch_each(found.select(path.alias("key")), cards, param="path", **options)
        found = found.withColumn("key", path).join(got.select("key", F.get_json_object("payload", "$.text").alias("card")), "key", "left")
    else:
        found = found.withColumn("card", F.lit(""))
    out = None
    for i, kind in enumerate(kinds):
        rows = found.where(F.col("kind") == kind)
        works = anchors.hub_to_works(rows.withColumn("card", F.coalesce("card", F.lit(""))), as_of, include, exclude, kind=kind)
        at = rows.select(F.concat(F.lit(f"https://huggingface.co/{'datasets/' if kind == 'dataset' else ''}"), "name").alias("id"), F.lit(i).alias("kind_pos"), "pos")
        works = works.join(at, "id")
        out = works if out is None else out.unionByName(works)
    return _ranked(out, most)


def collect_sets(theme: DataFrame, fetch: readers.Fetch, as_of: Column, include: Sequence[str], exclude: Sequence[str] = (), *, credentials: str | None, kinds: Sequence[str] = ("dataset", "kernel"), limit: int = ASKED, most: int = KEPT, **options: Any) -> DataFrame | None:
    """The best data sets and notebooks of one theme as works; None, and no request, without credentials or without a query."""
    query = _query(theme) if credentials else ""
    if not query or not kinds:
        return None
    spark = theme.sparkSession
    asked = spark.createDataFrame([(k, {"path": SET_LISTS[k][0], "search": query, "sortBy": SET_LISTS[k][1]}) for k in kinds], "key string, params map<string,string>")
    found = _listed(asked, fetch, limit, options).withColumn("ref", F.coalesce(F.get_json_object("payload", "$.ref"), F.get_json_object("payload", "$.id"))).where("ref <> ''")
    made = {"dataset": (anchors.datasets_to_works, "https://www.kaggle.com/datasets/"), "kernel": (anchors.notebooks_to_works, "https://www.kaggle.com/code/")}
    out = None
    for i, kind in enumerate(kinds):
        rows = found.where(F.col("kind") == kind)
        to_works, base = made[kind]
        works = to_works(rows, as_of, include, exclude).join(rows.select(F.concat(F.lit(base), "ref").alias("id"), F.lit(i).alias("kind_pos"), "pos"), "id")
        out = works if out is None else out.unionByName(works)
    return _ranked(out, most)


def fetch_bytes(keys: DataFrame, fetch: Callable[[str], bytes | None], *, key: str = "url", config: readers.ReadConfig = readers.ReadConfig(), lanes: int = 8) -> DataFrame:
    """key, content: the bytes of every distinct key, null where there are none or the request fails."""
    one = keys.select(F.col(key).cast("string").alias("key")).where("key IS NOT NULL").distinct().repartition(lanes)
    own = readers.deal(lanes, None)

    def answer(params: dict[str, Any]) -> tuple[int, dict[str, str], str]:
        got = fetch(params["key"])
        return (404, {}, "") if got is None else (200, {}, '{"hex": "' + got.hex() + '"}')

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = readers.Client(answer, config, lane=own[TaskContext.get().partitionId() % lanes])
        for batch in batches:
            content = []
            for k in batch.column(0).to_pylist():
                try:
                    content.append(bytes.fromhex(client.get({"key": k})["hex"]))
                except readers.ReadError:
                    content.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], names=["key", "content"])

    return one.mapInArrow(run, "key string, content binary")


def archived_texts(works: DataFrame, lookup: readers.Fetch, fetch: Callable[[str], bytes | None], *, most: int = 3, source: str = "ia_scholar", **options: Any) -> DataFrame:
    """id, source, url, text, truncated of the works (id, doi) whose archived copy resolves: the archive's release of a DOI names its PDF
    copies, those of the archive itself first; they are asked for one after another, the next one only where the last gave no prose.
    """
    named = works.select("id", T.doi_key(F.col("doi")).alias("doi")).where("doi <> ''")
    found = readers.fetch_each(named.select("doi"), lookup, key="doi", param="doi", **options).select(F.col("key").alias("doi"), F.from_json("payload", "struct<files:array<struct<mimetype:string,urls:array<struct<url:string>>>>>")["files"].alias("files"))
    copies = named.join(found, "doi").select("id", F.posexplode(F.slice(readers.archived_pdfs(F.coalesce("files", F.array().cast("array<struct<mimetype:string,urls:array<struct<url:string>>>>"))), 1, most)).alias("n", "url"))
    copies = cut(copies)  # what was asked for is not asked for again
    done = None
    for n in range(most):
        ask = copies.where(F.col("n") == n)
        if done is not None:
            ask = ask.join(done.select("id"), "id", "left_anti")
        got = fetch_bytes(ask, fetch, **options)
        read = fulltext.full_texts(got.select(F.col("key").alias("id"), "content"), "pdf", source=source).where("text IS NOT NULL")
        met = cut(ask.join(read.withColumnRenamed("id", "url"), "url").select("id", "source", "url", "text", "truncated"))
        done = met if done is None else done.unionByName(met)
    return done


def collect_anchors(theme: DataFrame, asked: dict[str, Callable[[], DataFrame | None]]) -> tuple[DataFrame, dict[str, str]]:
    """(works of all sources with anchor_source, what failed): asked names each source's collection; one that has nothing to ask is left out."""
    works: dict[str, DataFrame] = {}
    failures: dict[str, str] = {}
    for name, collect in asked.items():
        try:
            got = collect()
        except (SourceError, readers.ReadError) as e:
            failures[name] = str(e)
            continue
        if got is not None:
            works[name] = got
    return anchors.collect_sources(works, failures)


def one_theme(spark: SparkSession, **fields: Any) -> DataFrame:
    """A theme row from its fields."""
    kinds = {"theme_overview": "string", "goal": "string", "why_problem": "string", "concern": "string", "scope_field": "string", "assumptions": "array<string>", "keywords_include": "array<string>", "keywords_exclude": "array<string>"}
    return spark.createDataFrame([tuple(fields.get(k) for k in kinds)], ", ".join(f"{k} {v}" for k, v in kinds.items()))
