"""Joining other data to tracks by time and place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from celltrack.operators.proximity import containing_region


def asof(left: DataFrame, times: DataFrame, mode: str = "nearest", tolerance_minutes: float | None = None, ts: str = "ts") -> DataFrame:
    """``left`` with ``match_ts``: the entry of ``times(ts)`` that belongs to each row, null where none does.

    nearest: smallest distance, the earlier on a tie, within the tolerance if one is given. fixed: equal times only.
    The times before and after each row come from a sweep over the distinct times of both sides day by day, and from
    the last and first times of other days, so no pair of rows is ever formed and only days meet in one task.
    """
    known = times.select(F.col("ts").alias("k")).filter("k IS NOT NULL").distinct()
    if mode == "fixed":
        return left.join(known.select(F.col("k").alias(ts), F.col("k").alias("match_ts")), ts, "left")
    if mode != "nearest":
        raise ValueError("mode must be nearest or fixed")
    both = left.select(F.col(ts).alias("t"), F.lit(None).cast("timestamp_ntz").alias("k")).filter("t IS NOT NULL").distinct().unionByName(known.select(F.col("k").alias("t"), "k"))
    each = both.groupBy("t").agg(F.max("k").alias("k"), F.count(F.when(F.col("k").isNull(), 1)).alias("asked")).withColumn("day", F.to_date("t"))
    w = Window.partitionBy("day").orderBy("t")
    inside = each.select("day", "t", "asked", F.last("k", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("lo"), F.first("k", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("hi"))
    days = Window.orderBy("day")  # one row for each day
    carried = each.groupBy("day").agg(F.max("k").alias("last"), F.min("k").alias("first")).select(
        "day", F.last("last", True).over(days.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("first", True).over(days.rowsBetween(1, Window.unboundedFollowing)).alias("after")
    )
    near = inside.join(carried, "day").select("t", "asked", F.coalesce("lo", "before").alias("lo"), F.coalesce("hi", "after").alias("hi"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    down, up = micros("t") - micros("lo"), micros("hi") - micros("t")
    best = F.when(F.col("hi").isNull() | (down <= up), F.col("lo")).otherwise(F.col("hi"))
    if tolerance_minutes is not None:
        best = F.when(F.least(F.coalesce(down, up), F.coalesce(up, down)) <= tolerance_minutes * 60e6, best)
    return left.join(near.filter("asked > 0").select(F.col("t").alias(ts), best.alias("match_ts")), ts, "left")


def zonal(pixels: DataFrame, raster: DataFrame, keys: list[str], percentiles: tuple[int, ...] = (25, 90)) -> DataFrame:
    """Statistics of the raster cells under each cluster: ``pixels(keys, match_ts, y, x)`` and ``raster(ts, y, x, value)``.

    Clusters without any raster cell have no row; null and NaN cells count as missing. The mode is the smallest of
    the most frequent values.
    """
    r = raster.filter(F.col("value").isNotNull() & ~F.isnan("value")).select(F.col("ts").alias("match_ts"), "y", "x", "value")
    j = pixels.join(r, ["match_ts", "y", "x"])
    v = F.col("value")
    top = j.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.min_by("value", F.struct(-F.col("n"), v)).alias("mode"))
    stats = j.groupBy(*keys).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        *(F.percentile(v, p / 100).alias(f"percentile_{p}") for p in percentiles), F.sort_array(F.collect_list(v)).alias("values"),
    )
    return stats.join(top, keys)


def largest_box(pixels: DataFrame, boxes: DataFrame, keys: list[str], cell: int = 32) -> DataFrame:
    """``keys, box_id, share``: the box that holds most of a cluster's pixels, the smaller id on a tie.

    ``boxes(box_id, x0, x1, y0, y1)`` are half open. Boxes are laid out on coarse cells and met by an equi-join.
    """
    spread = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(b) - 1e-9) / cell))
    laid = boxes.filter("x1 > x0 AND y1 > y0").withColumn("by", F.explode(spread("y0", "y1"))).withColumn("bx", F.explode(spread("x0", "x1")))
    at = pixels.withColumns({"by": F.floor(F.col("y") / cell), "bx": F.floor(F.col("x") / cell)})
    hit = at.join(laid, ["by", "bx"]).filter("x >= x0 AND x < x1 AND y >= y0 AND y < y1")
    n = hit.groupBy(*keys, "box_id").agg(F.count(F.lit(1)).alias("share"))
    best = n.groupBy(*keys).agg(F.min_by(F.struct("box_id", "share"), F.struct(-F.col("share"), F.col("box_id"))).alias("b"))
    return best.select(*keys, "b.box_id", "b.share")


STATISTICS = ("count", "mean", "median", "std", "min", "max", "mode")


def resample(raster: DataFrame, origin: tuple[float, float], step: tuple[float, float], grid_origin: tuple[float, float], grid_step: tuple[float, float], y_dim: int, x_dim: int) -> DataFrame:
    """``(ts, y, x, value)`` on another grid: each grid cell takes the raster cell that its centre lies in.

    Origins are the lower corners (x, y), steps the cell sizes. Each raster cell is spread over the grid cells whose
    centres it holds, so no pair of cells is compared. Cells beyond the grid are left out.
    """
    lo = lambda c, k: F.ceil(round_off((origin[k] + F.col(c) * step[k] - grid_origin[k]) / grid_step[k] - 0.5))
    hi = lambda c, k: F.ceil(round_off((origin[k] + (F.col(c) + 1) * step[k] - grid_origin[k]) / grid_step[k] - 0.5)) - 1
    span = lambda c, k, n: F.when(F.greatest(lo(c, k), F.lit(0)) <= F.least(hi(c, k), F.lit(n - 1)), F.sequence(F.greatest(lo(c, k), F.lit(0)), F.least(hi(c, k), F.lit(n - 1))))
    spread = raster.select("ts", "value", F.explode(span("y", 1, y_dim)).alias("ny"), span("x", 0, x_dim).alias("xs"))
    return spread.select("ts", F.col("ny").cast("int").alias("y"), F.explode("xs").alias("x"), "value").withColumn("x", F.col("x").cast("int"))


def round_off(c: Column) -> Column:
    """Sums of decimals next to a whole number made that number."""
    return F.round(c, 9)


def add_raster(table: DataFrame, pixels: DataFrame, frames: DataFrame, raster: DataFrame, name: str, statistics: tuple[str, ...] = ("mean",), mode: str = "nearest", tolerance_minutes: float | None = None, values: bool = False) -> DataFrame:
    """``table`` with ``<name>_<statistic>`` of the raster cells under each cluster at its matching time, and their list if asked.

    Rows without a match or without a cell keep nulls. ``pixels`` and ``table`` go by frame, level and label.
    """
    unknown = [x for x in statistics if x not in STATISTICS and not x.startswith("percentile_")]
    if unknown:
        raise ValueError(f"unknown statistics: {unknown}")
    keys = ["frame", "level", "label"]
    shares = tuple(int(x.split("_")[1]) for x in statistics if x.startswith("percentile_"))
    at = asof(frames.select("frame", "ts"), raster, mode, tolerance_minutes).select("frame", "match_ts")
    z = zonal(pixels.join(at, "frame").select(*keys, "match_ts", "y", "x"), raster, keys, shares or (25, 90))
    cols = [F.col(x).alias(f"{name}_{x}") for x in statistics] + ([F.col("values").alias(f"{name}_values")] if values else [])
    return table.join(z.select(*keys, *cols), keys, "left")


def polygons_of_points(points: DataFrame, polygons: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``(*keys, region_id, region_name, share)``: how many of the points ``(*keys, lon, lat)`` of each key lie in each polygon ``(region_id, name, geometry)``."""
    hit = containing_region(points, polygons, keys)
    return hit.groupBy(*keys, "region_id", "region_name").agg(F.count(F.lit(1)).alias("share"))


def add_polygons(table: DataFrame, points: DataFrame, polygons: DataFrame, keys: tuple[str, ...], name: str = "region") -> DataFrame:
    """``table`` with ``<name>_id, <name>``: the polygon that holds most of a row's points, the smaller id on a tie, null without any."""
    n = polygons_of_points(points, polygons, keys)
    best = n.groupBy(*keys).agg(F.min_by(F.struct("region_id", "region_name"), F.struct(-F.col("share"), F.col("region_id"))).alias("__b"))
    return table.join(best.select(*keys, F.col("__b.region_id").alias(f"{name}_id"), F.col("__b.region_name").alias(name)), list(keys), "left")
