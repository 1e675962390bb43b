"""Run history: one table partitioned by theme hash, merged in order, first mention wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = "theme_hash string, kind string, value string, pos long, generated_at timestamp"


def empty_history(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def load_history(spark: SparkSession, path: str, theme: str) -> DataFrame:
    """The theme's history; empty where there is none. Reads the path's listing."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        return empty_history(spark)
    return spark.read.schema(SCHEMA).parquet(path).where(F.col("theme_hash") == theme)


def merge_history(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old values in their order, then new ones; each value once a theme and kind."""
    both = old.withColumn("__leg", F.lit(0)).unionByName(new.withColumn("__leg", F.lit(1)))
    rn = F.row_number().over(W.partitionBy("theme_hash", "kind", "value").orderBy("__leg", "pos"))
    first = both.withColumn("__rn", rn).where("__rn = 1")
    pos = F.row_number().over(W.partitionBy("theme_hash", "kind").orderBy("__leg", "pos", "value")) - 1
    return first.withColumn("pos", pos.cast("long")).select("theme_hash", "kind", "value", "pos", "generated_at")


def save_history(rows: DataFrame, path: str) -> None:
    """Overwrite only the themes that rows hold."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("theme_hash").parquet(path)
