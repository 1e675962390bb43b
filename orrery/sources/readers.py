"""Paged readers over an injected fetcher, as a Spark data source: retries, one rate and one budget, failures kept apart.

A fetcher takes the request's parameters and gives (status, headers, body); it runs on the executors. Queries are dealt
to lanes, a partition each. All lanes share one rate: time is cut into slots of the pacing interval, and slot n belongs
to lane n modulo the number of lanes. All lanes share one budget: it is dealt to them before the read begins, attempts
that fail count too. A lane reads in rounds, the next page of each of its queries that had results on the page before,
so a budget that ends early has read all queries to the same depth, and no page behind an empty one is asked for. A task
that Spark starts again spends its share again.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, Not

from orrery.functions import text as T

Fetch = Callable[[dict[str, Any]], tuple[int, dict[str, str], str]]
#: Statuses that may pass by themselves, price of a search, share of the budget that is called low, ids a lookup takes.
TRANSIENT, SEARCH_USD, LOW_SHARE, IDS_A_LOOKUP = frozenset({429, 500, 502, 503, 504}), 0.001, 0.25, 50


@dataclass(frozen=True)
class ReadConfig:
    """Pacing and patience of a reader: seconds between requests, further attempts, first wait (then doubled), and how long a gateway time-out is waited for."""

    interval: float = 0.2
    retries: int = 2
    backoff: float = 1.0
    patience: float = 0.0
    patience_interval: float = 5.0


class ReadError(RuntimeError):
    def __init__(self, message: str, *, status: int | None = None, exhausted: bool = False) -> None:
        super().__init__(message)
        self.status, self.exhausted = status, exhausted

    def __reduce__(self):
        return _read_error, (type(self), str(self), self.status, self.exhausted)


def _read_error(kind: type[ReadError], message: str, status: int | None, exhausted: bool) -> ReadError:
    return kind(message, status=status, exhausted=exhausted)


class Unread(ReadError):
    """The share of the budget is spent; what is left stays unread."""


def meter(headers: dict[str, str]) -> dict[str, float | None] | None:
    """remaining, limit, cost, reset and retry_after from a response's headers; None where there is no meter."""
    low = {str(k).lower(): v for k, v in (headers or {}).items()}

    def number(*names: str) -> float | None:
        for n in names:
            try:
                return float(low[n.lower()])
            except (KeyError, TypeError, ValueError):
                continue
        return None

    got = {"remaining": number("X-RateLimit-Remaining-USD"), "limit": number("X-RateLimit-Limit-USD"), "cost": number("X-RateLimit-Cost-Required-USD", "X-RateLimit-Cost-USD"), "reset": number("X-RateLimit-Reset"), "retry_after": number("Retry-After")}
    return None if got["remaining"] is None and got["retry_after"] is None else got


def exhausted(m: dict[str, float | None] | None) -> bool:
    """The budget cannot pay for one more request."""
    return bool(m) and m["remaining"] is not None and m["remaining"] < (m["cost"] or SEARCH_USD)


def searches_left(m: dict[str, float | None] | None) -> int | None:
    """At the price of a search, or of the dearest request seen."""
    if not m or m["remaining"] is None:
        return None
    return int(m["remaining"] / max(SEARCH_USD, m["cost"] or 0.0) + 1e-9)


def low_budget(m: dict[str, float | None] | None, share: float = LOW_SHARE) -> bool:
    return bool(m) and m["remaining"] is not None and bool(m["limit"]) and m["remaining"] < share * m["limit"]


def run_caveat(stats: dict[str, int], m: dict[str, float | None] | None) -> str:
    """One line where requests failed for a time or for good; empty for a clean run."""
    if not stats["retried"] and not stats["gave_up"]:
        return ""
    left = searches_left(m)
    parts = [f"{stats['requests']} requests", f"{stats['retried']} retried"] + [f"{stats['gave_up']} given up: a thin result may be a failed fetch"] * bool(stats["gave_up"]) + [f"budget for {left} more searches"] * (left is not None)
    return ", ".join(parts)


def budget_caveat(m: dict[str, float | None] | None) -> str:
    return f"low budget: {m['remaining']:g} of {m['limit']:g} left, {searches_left(m)} searches" if low_budget(m) else ""


@dataclass(frozen=True)
class Lane:
    """One reader's part of a shared rate and budget: every lanes-th slot from start (seconds of the epoch) on, and so many requests (None: any)."""

    index: int = 0
    lanes: int = 1
    start: float = 0.0
    requests: int | None = None

    def next_slot(self, now: float, interval: float, last: int) -> int:
        """The number of the first own slot that has not begun to pass, behind the last one used."""
        due = math.ceil(((now - self.start) / interval - self.index) / self.lanes - 1e-6)
        return max(due, last + 1)

    def begins(self, slot: int, interval: float) -> float:
        return self.start + (slot * self.lanes + self.index) * interval


def deal(lanes: int, requests: int | None, *, start: float | None = None) -> list[Lane]:
    """So many lanes that together make at most so many requests."""
    shares = [None] * lanes if requests is None else [requests // lanes + (i < requests % lanes) for i in range(lanes)]
    begin = time.time() if start is None else start
    return [Lane(i, lanes, begin, n) for i, n in enumerate(shares)]


class Client:
    """Requests one after another, paced, with bounded retries; counts what happened. With a lane it keeps to the lane's slots and share."""

    def __init__(self, fetch: Fetch, config: ReadConfig = ReadConfig(), *, lane: Lane | None = None, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] | None = None) -> None:
        self.fetch, self.config, self.sleep, self.lane = fetch, config, sleep, lane
        self.now = now or (time.time if lane else time.monotonic)
        self.last, self.meter, self.slot, self.sent = None, None, -1, 0
        self.stats = {"requests": 0, "retried": 0, "gave_up": 0, "gateway": 0}

    def _paced(self, params: dict[str, Any]) -> tuple[int | None, str]:
        lane, interval = self.lane, self.config.interval
        if lane is not None and lane.requests is not None and self.sent >= lane.requests:
            raise Unread("the budget is spent", exhausted=True)
        self.sent += 1
        if lane is not None and interval > 0:
            self.slot = lane.next_slot(self.now(), interval, self.slot)
            wait = lane.begins(self.slot, interval) - self.now()
        else:
            wait = 0 if self.last is None else interval - (self.now() - self.last)
        if wait > 0:
            self.sleep(wait)
        self.last = self.now()
        try:
            status, headers, body = self.fetch(params)
        except OSError as e:  # time-outs and broken connections pass too
            return None, str(e)
        self.meter = meter(headers) or self.meter
        return status, body

    def get(self, params: dict[str, Any], shapes: tuple[type, ...] = (dict,)) -> Any:
        """The JSON that answers a request, of one of these shapes."""
        self.stats["requests"] += 1
        began, tried = self.now(), 0
        while True:
            status, body = self._paced(params)
            tried += 1
            if status == 200:
                try:
                    got = json.loads(body)
                except (TypeError, ValueError, RecursionError):
                    got = None
                if not isinstance(got, shapes):
                    raise ReadError(f"answered with a broken body: {str(body)[:300]}", status=200)
                return got
            if status == 429 and exhausted(self.meter):
                self.stats["gave_up"] += 1
                raise ReadError("the budget is exhausted", status=429, exhausted=True)
            if status is not None and status not in TRANSIENT:
                raise ReadError(f"refused with status {status}: {body[:300]}", status=status)
            self.stats["gateway"] += status == 504
            if tried <= self.config.retries:
                wait = self.config.backoff * 2 ** (tried - 1)
            elif status == 504 and self.now() - began + self.config.patience_interval <= self.config.patience:
                wait = self.config.patience_interval
            else:
                self.stats["gave_up"] += 1
                raise ReadError(f"gave up after {tried} attempts (status {status}): {body[:300]}", status=status)
            self.stats["retried"] += 1
            self.sleep(wait)

    def pages(self, params: dict[str, Any], *, per_page: int, first: int = 1, last: int) -> Iterator[tuple[int, list]]:
        """(page, results) until a page has none."""
        for page in range(first, last + 1):
            results = self.page(params, per_page=per_page, page=page)
            if not results:
                return
            yield page, results

    def page(self, params: dict[str, Any], *, per_page: int, page: int) -> list:
        results = self.get({**params, "per-page": per_page, "page": page}).get("results") or []
        if not isinstance(results, list):
            raise ReadError("answered with results that are no list", status=200)
        return results


class _LanePart(InputPartition):
    def __init__(self, lane: Lane, queries: list[int]) -> None:
        super().__init__(lane.index)
        self.lane, self.queries = lane, queries


#: Record columns of the source: name -> (type, path in a record, name of the request filter that asks for equal values).
RECORD_COLUMNS: dict[str, tuple[str, tuple[str, ...], str]] = {
    "publication_year": ("int", ("publication_year",), "publication_year"),
    "type": ("string", ("type",), "type"),
    "field_id": ("string", ("primary_topic", "field", "id"), "primary_topic.field.id"),
    "topic_id": ("string", ("primary_topic", "id"), "primary_topic.id"),
    "is_retracted": ("boolean", ("is_retracted",), "is_retracted"),
    "cited_by_count": ("int", ("cited_by_count",), "cited_by_count"),
    "referenced_works_count": ("int", ("referenced_works_count",), "referenced_works_count"),
}
PAGE_COLUMNS = "query int, page int, pos int, payload string, error string"


def _at(record: Any, path: tuple[str, ...], kind: str) -> Any:
    for p in path:
        record = record.get(p) if isinstance(record, dict) else None
    if kind == "string":
        return None if record is None else str(record).rsplit("/", 1)[-1]
    return record if isinstance(record, bool if kind == "boolean" else int) and isinstance(record, bool) == (kind == "boolean") else None


def _shown(v: Any) -> str | None:
    """A value as request filters write it; None where it has signs that mean something there."""
    text = str(v).lower() if isinstance(v, bool) else str(v)
    return text if isinstance(v, (bool, int, str)) and text and not set(text) & set(",|:!<>") else None


def request_filter(f: Filter, columns: dict[str, tuple[str, tuple[str, ...], str]] = RECORD_COLUMNS) -> str | None:
    """The part of the request's filter that asks for what a pushed filter on a record column keeps; None where there is none."""
    negated, f = (True, f.child) if isinstance(f, Not) else (False, f)
    known = columns.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
    if known is None:
        return None
    name, number = known[2], known[0] == "int"
    if isinstance(f, EqualTo) and (v := _shown(f.value)) is not None:
        return f"{name}:{'!' * negated}{v}"
    if negated:
        return None
    if isinstance(f, In):
        values = [_shown(v) for v in f.value]
        return f"{name}:{'|'.join(values)}" if values and None not in values else None
    if number and isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and isinstance(f.value, int):
        return f"{name}:>{f.value - isinstance(f, GreaterThanOrEqual)}" if isinstance(f, (GreaterThan, GreaterThanOrEqual)) else f"{name}:<{f.value + isinstance(f, LessThanOrEqual)}"
    return None


class _Reader(DataSourceReader):
    def __init__(self, fetch: Fetch, config: ReadConfig, queries: Sequence[dict[str, Any]], per_page: int, max_pages: int, lanes: int, requests: int | None, isolate: bool, columns: dict) -> None:
        self.fetch, self.config, self.queries, self.per_page, self.max_pages, self.lanes, self.requests, self.isolate, self.columns = fetch, config, list(queries), per_page, max_pages, lanes, requests, isolate, columns
        self.asked, self.wanted = range(len(self.queries)), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on query and page limit what is read, those on record columns become request filters. The latter are
        still evaluated behind the scan, where a server may read them more loosely; all others stay there alone."""
        for f in filters:
            at = getattr(f, "attribute", None)
            if at == ("query",) and isinstance(f, (EqualTo, In)):
                among = set(f.value) if isinstance(f, In) else {f.value}
                self.asked = [q for q in self.asked if q in among]
            elif at == ("page",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.max_pages = min(self.max_pages, f.value - isinstance(f, LessThan))
            else:
                if self.columns and (part := request_filter(f, self.columns)) is not None:
                    self.wanted.append(part)
                yield f

    def partitions(self) -> list[InputPartition]:
        n = max(1, min(self.lanes, len(self.asked)))
        return [_LanePart(lane, list(self.asked[lane.index :: n])) for lane in deal(n, self.requests)]

    def params(self, query: int) -> dict[str, Any]:
        own = self.queries[query]
        every = ",".join([*([own["filter"]] if own.get("filter") else []), *self.wanted])
        return {**own, "filter": every} if every else own

    def read(self, partition: _LanePart) -> Iterator[tuple]:
        client = Client(self.fetch, self.config, lane=partition.lane)
        none = (None,) * len(self.columns)
        open_, spent = list(partition.queries), None
        for page in range(1, self.max_pages + 1):
            going = []
            for q in open_:
                try:
                    if spent is not None:
                        raise spent
                    results = client.page(self.params(q), per_page=self.per_page, page=page)
                except ReadError as e:
                    if not self.isolate or e.exhausted and not isinstance(e, Unread):
                        raise
                    spent = e if isinstance(e, Unread) else None
                    yield q, page, -1, None, str(e), *none  # one query that fails or stays unread does not cost the others
                    continue
                for pos, r in enumerate(results):
                    yield q, page, pos, json.dumps(r, ensure_ascii=False), None, *(_at(r, path, kind) for kind, path, _ in self.columns.values())
                if results:
                    going.append(q)
            open_ = going


def paged_source(fetch: Fetch, queries: Sequence[dict[str, Any]], *, config: ReadConfig = ReadConfig(), per_page: int = 50, max_pages: int = 4, lanes: int = 8, requests: int | None = None, isolate: bool = False, columns: dict | None = None, name: str = "paged_json") -> type[DataSource]:
    """A data source over these queries: query, page, pos, payload, error, and record columns (RECORD_COLUMNS or others) where they are asked for.

    Together the lanes keep to config.interval and to the number of requests. With ``isolate`` a query that fails, or that the
    requests don't reach, gives a row with its error instead of ending the read. Register it, then spark.read.format(name).load().
    """
    held = dict(columns or {})

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ", ".join([PAGE_COLUMNS, *(f"{c} {kind}" for c, (kind, *_) in held.items())])

        def reader(self, schema) -> DataSourceReader:
            return _Reader(fetch, config, queries, per_page, max_pages, lanes, requests, isolate, held)

    return Paged


def read_pages(spark: SparkSession, fetch: Fetch, queries: Sequence[dict[str, Any]], **options: Any) -> DataFrame:
    """The source, loaded. Filters on its columns are pushed where spark.sql.python.filterPushdown.enabled is set, which this does."""
    source = paged_source(fetch, queries, **options)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    return spark.read.format(source.name()).load()


def theme_scan(spark: SparkSession, fetch: Fetch, queries: DataFrame, *, most: int = 1000, **options: Any) -> DataFrame:
    """The pages of a table of queries (percolate.ladders: query, rung, anchor, route, field_ids), with theme and rung for query.

    Each query costs a request at least, so more than ``most`` are refused. Filters on theme and rung don't reach the requests;
    those on query, page and record columns do.
    """
    rows = queries.orderBy("query", "rung").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} queries")
    from orrery.operators import gates, themes

    asked = [themes.route_params(gates.StructuredQuery(anchor_terms=(r.anchor,), field_ids=tuple(r.field_ids or ()), route=r.route or "filter"), per_page=options.get("per_page", 50)) for r in rows]
    names = spark.createDataFrame([(i, r["query"], r.rung) for i, r in enumerate(rows)], types.StructType([types.StructField("query", types.IntegerType()), types.StructField("theme", queries.schema["query"].dataType), types.StructField("rung", types.IntegerType())]))
    return read_pages(spark, fetch, asked, **{"columns": RECORD_COLUMNS, "isolate": True} | options).join(F.broadcast(names), "query")


def fetch_each(keys: DataFrame, fetch: Fetch, *, key: str = "key", param: str = "key", config: ReadConfig = ReadConfig(), absent: frozenset[int] = frozenset({404}), lanes: int = 8, requests: int | None = None) -> DataFrame:
    """key, payload, error: one request a distinct key, as read-me files, releases, runs and full texts are asked for.

    What is absent gives null and no error; a key that fails, or that the requests don't reach, costs only itself; an exhausted
    budget of the server ends the read. All lanes keep to one rate.
    """
    one = keys.select(F.col(key).cast("string").alias("key")).where("key IS NOT NULL").distinct()
    return fetch_rows(one.select("key", F.create_map(F.lit(param), F.col("key")).alias("params")), fetch, config=config, absent=absent, lanes=lanes, requests=requests)


def fetch_rows(asked: DataFrame, fetch: Fetch, *, config: ReadConfig = ReadConfig(), absent: frozenset[int] = frozenset({404}), lanes: int = 8, requests: int | None = None) -> DataFrame:
    """key, payload, error: one request a row of asked (key, params: map<string,string>); bodies may be lists as well as objects."""
    one = asked.select(F.col("key").cast("string").alias("key"), "params").repartition(lanes)
    own = deal(lanes, requests)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        client = Client(fetch, config, lane=own[TaskContext.get().partitionId() % lanes])
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for k, params in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                payload, error = None, None
                try:
                    payload = json.dumps(client.get(dict(params or []), (dict, list)), ensure_ascii=False)
                except ReadError as e:
                    if e.exhausted and not isinstance(e, Unread):
                        raise
                    error = None if e.status in absent else str(e)
                for c, v in zip(out, (k, payload, error), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=["key", "payload", "error"])

    return one.mapInArrow(run, "key string, payload string, error string")


def read_with_fallback(spark: SparkSession, fetch: Fetch, precise: dict[str, Any], generic: dict[str, Any], **options: Any) -> DataFrame:
    """The precise query's pages; if they are empty, the generic one's."""
    from orrery.operators.gates import fallback_if_empty

    name = options.pop("name", "paged_json")
    first, second = (read_pages(spark, fetch, [q], name=f"{name}_{i}", **options) for i, q in enumerate((precise, generic)))
    return fallback_if_empty(first, second)


def id_lookups(ids: DataFrame, *, key: str = "id", size: int = IDS_A_LOOKUP) -> DataFrame:
    """lookup, ids: the distinct ids joined by a bar, at most so many a lookup. Lookups are cut inside hash buckets, so no task sees all ids."""
    one = ids.select(T.short_id(F.col(key)).alias("id")).where("id <> ''").distinct().withColumn("b", F.pmod(F.xxhash64("id"), F.lit(64)))
    n = F.floor((F.row_number().over(W.partitionBy("b").orderBy("id")) - 1) / size)
    return one.withColumn("n", n).groupBy("b", "n").agg(F.array_join(F.sort_array(F.collect_list("id")), "|").alias("ids")).select(F.concat_ws("-", "b", "n").alias("lookup"), "ids")


def labelled(ids: DataFrame, works: DataFrame, *, key: str = "id") -> DataFrame:
    """ids plus title and cited_by_count; null where an id does not resolve."""
    return ids.withColumn("__w", T.short_id(F.col(key))).join(works.select(F.col("id").alias("__w"), "title", "cited_by_count"), "__w", "left").drop("__w")


def archived_pdfs(files: Column) -> Column:
    """Urls of archived PDF copies, those of the archive itself first. files: array<struct<mimetype, urls: array<struct<url>>>>."""
    pdf = F.filter(files, lambda f: F.lower(F.coalesce(f["mimetype"], F.lit(""))).isin("application/pdf", "application/x-pdf"))
    urls = F.flatten(F.transform(pdf, lambda f: F.filter(F.transform(f["urls"], lambda u: u["url"]), lambda u: T.text_or_empty(u) != "")))
    own = lambda u: u.contains("archive.org")
    return F.concat(F.filter(urls, own), F.filter(urls, lambda u: ~own(u)))


def repository_text(text: Column, *, least: int = 400) -> Column:
    """The text of a repository of open papers, if it is long enough to be one."""
    t = T.collapse_ws(text)
    return F.when(F.length(t) >= least, t)


def cache_key(c: Column) -> Column:
    """A file name's worth of an id: what follows its last slash, other signs as underscores."""
    tail = T.strip_id(c)
    safe = F.regexp_replace(F.when(tail == "", T.text_or_empty(c)).otherwise(tail), r"[^A-Za-z0-9_.-]", "_")
    return F.when(safe == "", "work").otherwise(safe)


def with_config(config: ReadConfig, **changes: Any) -> ReadConfig:
    return replace(config, **changes)
