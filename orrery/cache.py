"""The full-text cache as a data source with commits: what a job writes is seen whole when it is done, or not at all.

Tasks write their rows under ``staged/<run>``; the commit moves nothing but adds one small file that names the run's files, and
readers read the files that commits name. A job that fails deletes what it has staged; what its last tasks still add, or a
driver that dies leaves, nobody reads, and swept() deletes it. Misses are kept like hits, so nothing is asked for again. The folder is reached through the file systems of
Arrow, so that a store can hold it as well as a mounted folder.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, types
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

COLUMNS = "id string, source string, source_id string, url string, text string, resolved boolean, truncated boolean, fetched_at string"
FORMAT = "fulltext_cache"
ROWS_A_FILE = 50_000


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path.rstrip("/")
    fs, at = pafs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs, at.rstrip("/")


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path, self.run = path, f"{time.time_ns():020d}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = _place(self.path)
        folder = f"{root}/staged/{self.run}"
        fs.create_dir(folder, recursive=True)
        files, held, rows = [], [], 0

        def put() -> None:
            name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.parquet"  # another one for each attempt
            pq.write_table(pa.Table.from_batches(held), f"{folder}/{name}", filesystem=fs)
            files.append(f"staged/{self.run}/{name}")

        for batch in iterator:
            held.append(batch)
            rows += batch.num_rows
            if rows >= ROWS_A_FILE:
                put()
                held, rows = [], 0
        if rows:
            put()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, root = _place(self.path)
        fs.create_dir(f"{root}/commits", recursive=True)
        named = json.dumps([f for m in messages if m is not None for f in m.files]).encode()
        with fs.open_output_stream(f"{root}/commits/.{self.run}") as out:
            out.write(named)
        fs.move(f"{root}/commits/.{self.run}", f"{root}/commits/{self.run}.json")

    def abort(self, messages: list[_Written | None]) -> None:
        fs, root = _place(self.path)
        if fs.get_file_info(f"{root}/staged/{self.run}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/staged/{self.run}")


class FulltextCache(DataSource):
    """The writing side; options: path."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return COLUMNS

    def writer(self, schema: types.StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("the cache is appended to; entries are replaced by newer ones")
        return _Writer(self.options["path"])


def store(rows: DataFrame, path: str) -> None:
    """Add entries: id, source, text, resolved, and where they are known source_id, url, truncated, fetched_at."""
    rows.sparkSession.dataSource.register(FulltextCache)
    wanted = [c.split()[:2] for c in COLUMNS.split(", ")]
    full = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in wanted])
    full.write.format(FORMAT).mode("append").option("path", path).save()


def committed(path: str) -> list[str]:
    """The files of all commits, in their order."""
    fs, root = _place(path)
    if fs.get_file_info(f"{root}/commits").type == pafs.FileType.NotFound:
        return []
    runs = sorted(i.path for i in fs.get_file_info(pafs.FileSelector(f"{root}/commits")) if i.base_name.endswith(".json"))
    return [f for run in runs for f in json.loads(fs.open_input_stream(run).read())]


def entries(spark: SparkSession, path: str) -> DataFrame:
    """One row an id: its newest entry, a hit or a miss."""
    files = committed(path)
    if not files:
        return spark.createDataFrame([], COLUMNS)
    rows = spark.read.schema(COLUMNS).parquet(*[f"{path.rstrip('/')}/{f}" for f in files])
    run = F.regexp_extract(F.col("_metadata.file_path"), r"staged/([0-9a-f]+-[0-9a-f]+)/", 1)
    others = [c.split()[0] for c in COLUMNS.split(", ")][1:]
    newest = rows.groupBy("id").agg(F.max_by(F.struct(*others), F.struct(run, F.coalesce("fetched_at", F.lit("")), F.coalesce("text", F.lit("")))).alias("e"))
    return newest.select("id", "e.*")


def lookup(ids: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids with their entries, hits and misses; ids that are not in the cache)."""
    return ids.join(cached, "id"), ids.join(cached.select("id"), "id", "left_anti")


def swept(path: str, *, older: float = 86_400.0) -> int:
    """Delete staged runs that no commit names and that are older than so many seconds; how many there were."""
    fs, root = _place(path)
    if fs.get_file_info(f"{root}/staged").type == pafs.FileType.NotFound:
        return 0
    known = {f.split("/")[1] for f in committed(path)}
    gone = [i for i in fs.get_file_info(pafs.FileSelector(f"{root}/staged")) if i.base_name not in known and time.time() - int(i.base_name.split("-")[0]) / 1e9 > older]
    for i in gone:
        fs.delete_dir(i.path)
    return len(gone)
