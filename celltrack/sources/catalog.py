"""Stored tables of a run: a catalog by mode and day, what is still to be done, and clearing up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODES = ("track", "forecast")


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def store(table: DataFrame, root: str, mode: str, ts: str = "ts", compression: str = "gzip") -> None:
    """Write a tracking table below ``root`` by mode and day; days that are there already are replaced, others stay."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    out = table.withColumns({"mode": F.lit(mode), "day": F.to_date(ts)})
    out.write.option("partitionOverwriteMode", "dynamic").option("compression", compression).mode("overwrite").partitionBy("mode", "day").parquet(root)


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """``(mode, day, n_files, n_bytes)`` of what is stored, from the listing alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(root).select("path", "length")
    part = lambda k: F.regexp_extract("path", rf"/{k}=([^/]+)/", 1)
    return files.groupBy(part("mode").alias("mode"), part("day").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))


def read(spark: SparkSession, root: str, mode: str | None = None, where: Column | None = None) -> DataFrame:
    """The stored table, columns united by name over files; ``mode`` and conditions on ``day`` prune directories."""
    t = spark.read.option("mergeSchema", True).parquet(root)
    if mode is not None:
        t = t.filter(F.col("mode") == mode)
    return t if where is None else t.filter(where)


def remaining(frames: DataFrame, done: DataFrame, key: str = "ts") -> DataFrame:
    """The frames whose time no stored row has: where a run that was stopped goes on."""
    return frames.join(done.select(key).distinct(), key, "left_anti")


def clear(spark: SparkSession, root: str) -> bool:
    """Delete a run's folder; whether there was one."""
    fs, at = _fs(spark, root)
    return bool(fs.delete(at, True))
