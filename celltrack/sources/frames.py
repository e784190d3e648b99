"""Frames and cells from tables, arrays, files and a generator.

Canonical relations: ``frames(frame, ts)`` and ``cells(frame, y, x, value)``; a cell without data has no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sliding_frames(spark: SparkSession, start: str, count: int, step_hours: int) -> DataFrame:
    begin = F.to_timestamp_ntz(F.lit(start))
    return spark.range(count).select(F.col("id").cast("int").alias("frame"), (begin + F.make_interval(hours=(F.col("id") * step_hours).cast("int"))).cast("timestamp_ntz").alias("ts"))


def window_cells(events: DataFrame, start: str, count: int, step_hours: int, span_hours: int, width: int) -> DataFrame:
    """Cells of sliding windows over an event table: each event goes to every window that covers it, without a join."""
    step, span = step_hours * 3600, span_hours * 3600
    since = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(start).cast("timestamp"))
    last = F.floor(since / (step * 1_000_000)).cast("int")
    first = (F.floor((since - span * 1_000_000) / (step * 1_000_000)) + 1).cast("int")
    lo, hi = F.greatest(first, F.lit(0)), F.least(last, F.lit(count - 1))
    return (
        events.filter(F.col("ts").isNotNull() & F.col("value").isNotNull())
        .select(
            F.when(lo <= hi, F.sequence(lo, hi)).alias("__f"),
            (F.col("event_id") % width).cast("int").alias("y"),
            (F.col("user_id") % width).cast("int").alias("x"),
            "value",
        )
        .select(F.explode("__f").alias("frame"), "y", "x", "value")
        .groupBy("frame", "y", "x")
        .agg(F.max("value").alias("value"))
    )


def array_cells(df: DataFrame, frame: str, array: str, x_dim: int) -> DataFrame:
    """Cells of flat array columns, row by row of the grid."""
    return df.select(F.col(frame).cast("int").alias("frame"), F.posexplode(array).alias("pos", "value")).select(
        "frame", F.floor(F.col("pos") / x_dim).cast("int").alias("y"), (F.col("pos") % x_dim).cast("int").alias("x"), F.col("value").cast("double").alias("value")
    )


def file_timestamp(file: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    """Time in a file name: the first (regular expression with one group, format) that reads it; else null."""
    return F.coalesce(*(F.try_to_timestamp(F.regexp_replace(F.nullif(F.regexp_extract(file, rx, 1), F.lit("")), "/", ""), F.lit(fmt)) for rx, fmt in patterns))


def read_frames(spark: SparkSession, path: str, read_function: Callable[[bytes], np.ndarray], patterns: tuple[tuple[str, str], ...]) -> DataFrame:
    """``(file, ts, y, x, value, failed)`` of all files below ``path``.

    ``read_function`` turns a file's bytes into a 2-D array. A file it cannot read gives one row with failed set
    and no cell, so the frame stays known. NaN cells have no row.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = raw.select("path", file_timestamp(F.col("path"), patterns).alias("ts"), "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, ts, content in zip(b["path"], b["ts"], b["content"]):
                try:
                    a = np.asarray(read_function(bytes(content)), float)
                    y, x = np.nonzero(~np.isnan(a))
                    yield pd.DataFrame({"file": file, "ts": ts, "y": y.astype("int32"), "x": x.astype("int32"), "value": a[y, x], "failed": False})
                except Exception:
                    yield pd.DataFrame({"file": [file], "ts": [ts], "y": pd.array([None], "Int32"), "x": pd.array([None], "Int32"), "value": [None], "failed": [True]})

    return named.mapInPandas(decode, "file string, ts timestamp, y int, x int, value double, failed boolean")


def last_frames(frames: DataFrame, k: int, until: str | None = None) -> DataFrame:
    """The last ``k`` frames, up to and with ``until``."""
    kept = frames if until is None else frames.filter(F.col("ts") <= F.lit(until).cast("timestamp_ntz"))
    return kept.orderBy(F.col("ts").desc()).limit(k)


def bubble_specs(size: int, count: int = 6, seed: int = 1) -> list[tuple[float, ...]]:
    """Centre, speed, radii and phase of each ellipse."""
    rng = np.random.default_rng(seed)
    return [tuple(float(v) for v in row) for row in np.c_[rng.uniform(0, size, (count, 2)), rng.uniform(-1.5, 1.5, (count, 2)), rng.uniform(size / 14, size / 7, (count, 2)), rng.uniform(0, 6.28, count)]]


def bubbles(spark: SparkSession, frames: int, size: int, count: int = 6, seed: int = 1) -> DataFrame:
    """Synthetic cells: ellipses that drift, steer, grow and fade, some meeting and parting."""
    specs = bubble_specs(size, count, seed)
    names = ("cx", "cy", "vx", "vy", "rx", "ry", "phase")
    blobs = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, spec))) for spec in specs))
    t = F.col("frame")
    at = spark.range(frames).select(F.col("id").cast("int").alias("frame"), F.explode(blobs).alias("b")).select("frame", "b.*")
    moved = at.select(
        "frame",
        (F.col("cx") + t * F.col("vx") + 2 * F.sin(t / 5 + F.col("phase"))).alias("mx"),
        (F.col("cy") + t * F.col("vy") + 2 * F.cos(t / 7 + F.col("phase"))).alias("my"),
        (F.col("rx") * (1 + 0.3 * F.sin(t / 4 + F.col("phase")))).alias("rx"),
        (F.col("ry") * (1 + 0.3 * F.cos(t / 4 + F.col("phase")))).alias("ry"),
    )
    rows = moved.withColumn("y", F.explode(F.sequence(F.greatest(F.lit(0), F.ceil(F.col("my") - F.col("ry"))).cast("int"), F.greatest(F.lit(0), F.ceil(F.col("my") - F.col("ry"))).cast("int") + F.floor(2 * F.col("ry")).cast("int"))))
    cells = rows.withColumn("x", F.explode(F.sequence(F.greatest(F.lit(0), F.ceil(F.col("mx") - F.col("rx"))).cast("int"), F.greatest(F.lit(0), F.ceil(F.col("mx") - F.col("rx"))).cast("int") + F.floor(2 * F.col("rx")).cast("int"))))
    d = F.pow((F.col("x") - F.col("mx")) / F.col("rx"), 2) + F.pow((F.col("y") - F.col("my")) / F.col("ry"), 2)
    inside = cells.withColumn("d", d).filter((F.col("d") <= 1) & (F.col("x") < size) & (F.col("y") < size))
    return inside.groupBy("frame", "y", "x").agg(F.max(50 * (1 - F.col("d")) + 10).alias("value"))
