"""The full-text cache: whole jobs or nothing."""

import os
import time

import pytest
from pyspark.sql import functions as F

from orrery import cache


def files(path):
    return [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def rows(spark, n, text="text", resolved=True):
    return spark.range(0, n, 1, 4).select(F.concat(F.lit("W"), "id").alias("id"), F.lit("arxiv").alias("source"), F.when(F.lit(resolved), F.concat(F.lit(text + " "), "id")).alias("text"), F.lit(resolved).alias("resolved"))


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_a_failed_job_leaves_no_half_cache(spark, tmp_path, scheme):
    path = scheme + str(tmp_path / "cache")
    assert cache.entries(spark, path).count() == 0
    cache.store(rows(spark, 100), path)
    before, named = sorted(files(tmp_path)), cache.committed(path)
    assert len(before) == len(named) == 4 and cache.entries(spark, path).count() == 100

    broken = rows(spark, 400, "never").withColumn("text", F.when(F.col("id") == "W399", F.raise_error(F.lit("the task fails"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="the task fails"):
        cache.store(broken, path)
    assert cache.committed(path) == named and cache.entries(spark, path).where("text LIKE 'never%'").count() == 0
    time.sleep(1)  # tasks that were still writing
    cache.swept(path, older=0)
    assert sorted(files(tmp_path)) == before
    with pytest.raises(Exception, match="appended"):
        rows(spark, 1).select(*[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in cache.COLUMNS.split(", ")]).write.format(cache.FORMAT).mode("overwrite").option("path", path).save()


def test_newest_entries_hits_and_misses(spark, tmp_path):
    path = str(tmp_path / "cache")
    cache.store(rows(spark, 10, resolved=False), path)
    cache.store(rows(spark, 4, "newer"), path)
    got = {r.id: (r.resolved, r.text) for r in cache.entries(spark, path).collect()}
    assert got["W3"] == (True, "newer 3") and got["W4"] == (False, None) and len(got) == 10
    known, asked = cache.lookup(spark.createDataFrame([("W1",), ("W9",), ("W77",)], "id string"), cache.entries(spark, path))
    assert sorted((r.id, r.resolved) for r in known.collect()) == [("W1", True), ("W9", False)] and [r.id for r in asked.collect()] == ["W77"]


def test_what_a_dead_driver_staged_is_not_read(spark, tmp_path):
    path = str(tmp_path / "cache")
    cache.store(rows(spark, 5), path)
    left = tmp_path / "cache" / "staged" / f"{1:020d}-abc"
    left.mkdir()
    rows(spark, 50).toPandas().to_parquet(left / "x.parquet")
    assert cache.entries(spark, path).count() == 5
    assert cache.swept(path) == 1 and not left.exists() and cache.entries(spark, path).count() == 5 and cache.swept(path) == 0
