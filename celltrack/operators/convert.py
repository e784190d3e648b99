"""Tracks as rasters, vectors, outlines and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from celltrack.functions import physics as ph
from celltrack.operators.tracking import KEY

METHODS = ("", "spl", "mrg", "inc", "opt", "elp")  # what follows u_ and v_ in the vector columns


def raster_columns(pixels: DataFrame, table: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``(frame, level, y, x, *columns)``: numeric columns of the clusters drawn on their pixels; text is refused."""
    kinds = dict(table.dtypes)
    text = [c for c in columns if kinds[c] == "string"]
    if text:
        raise ValueError(f"not numeric: {text}")
    return pixels.select(*KEY, "y", "x").join(table.select(*KEY, *columns), KEY).select("frame", "level", "y", "x", *columns)


def raster_lists(table: DataFrame, values: str, y: str = "array_y", x: str = "array_x") -> DataFrame:
    """``(frame, level, y, x, value)`` of value lists that stand beside pixel lists; lists of other lengths end with the shortest."""
    at = F.explode(F.arrays_zip(F.col(y).alias("y"), F.col(x).alias("x"), F.col(values).alias("value")))
    long = table.select("frame", "level", at.alias("p")).select("frame", "level", "p.*")
    return long.filter("y IS NOT NULL AND x IS NOT NULL AND value IS NOT NULL")


def vector_cells(table: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """``(frame, level, method, y, x, u, v)``: each method's vector at the cell of its cluster's centre ``cx, cy``.

    Where centres share a cell the largest components stand. Methods without columns are passed over.
    """
    there = [m for m in methods if f"u_{m}" in table.columns]
    each = F.explode(F.array(*(F.struct(F.lit(m or "noc").alias("method"), F.col(f"u_{m}").alias("u"), F.col(f"v_{m}").alias("v")) for m in there))).alias("m")
    long = table.select("frame", "level", F.floor("cy").cast("int").alias("y"), F.floor("cx").cast("int").alias("x"), each).select("frame", "level", "y", "x", "m.*")
    return long.filter("u IS NOT NULL AND v IS NOT NULL").groupBy("frame", "level", "method", "y", "x").agg(F.max("u").alias("u"), F.max("v").alias("v"))


def angles(table: DataFrame, methods: tuple[str, ...] = METHODS) -> dict[str, Column]:
    """``ang_<method>`` for every vector pair of a table."""
    return {f"ang_{m}": ph.angle(F.col(f"u_{m}"), F.col(f"v_{m}")) for m in methods if f"u_{m}" in table.columns}


def boundaries(table: DataFrame, outlines: DataFrame) -> DataFrame:
    """The table with outlines and the angle of every vector pair."""
    t = table if "geometry" in table.columns else table.join(outlines.select(*KEY, "geometry"), KEY)
    return t.withColumns(angles(t))


def vectorfield(points: DataFrame, origin: tuple[float, float] = (0.0, 0.0), step: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """``(frame, level, label, u, v, geometry)``: flow points of clusters as lines from each point along its vector."""
    x, y = origin[0] + F.col("x") * step[0], origin[1] + F.col("y") * step[1]
    line = F.format_string("LINESTRING (%.6f %.6f, %.6f %.6f)", x.cast("double"), y.cast("double"), (x + F.col("u") * step[0]).cast("double"), (y + F.col("v") * step[1]).cast("double"))
    return points.select(*KEY, "y", "x", "u", "v", line.alias("geometry"))


def coordinates(wkt: Column) -> Column:
    """Coordinates of a polygon or multipolygon text as polygons of rings of points."""
    text = F.regexp_replace(wkt, r"^\s*[A-Z]+\s*", "")
    text = F.when(wkt.startswith("POLYGON"), F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)
    numbers = F.regexp_replace(F.regexp_replace(text, r"(-?[0-9.]+(?:e-?[0-9]+)?) (-?[0-9.]+(?:e-?[0-9]+)?)", "[$1,$2]"), r"\(", "[")
    return F.from_json(F.regexp_replace(numbers, r"\)", "]"), "array<array<array<array<double>>>>")


def write_geojson(df: DataFrame, path: str, properties: tuple[str, ...], geometry: str = "geometry") -> None:
    """One feature a line, each a MultiPolygon with its holes."""
    shape = F.struct(F.lit("MultiPolygon").alias("type"), coordinates(F.col(geometry)).alias("coordinates"))
    df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value")).write.text(path)


def write_grid(cells: DataFrame, path: str, y_dim: int, x_dim: int, keys: tuple[str, ...] = ("frame", "level")) -> None:
    """Cells as rows of the grid, ``(*keys, y, row array<double>)`` in Parquet by the first key; cells without data are NaN.

    A row of the grid, not the whole grid, is the largest value, so a grid may be of any height. Of several values of a
    cell the largest is written; rows without a place, or beyond the grid, are left out.
    """
    held = cells.filter((F.col("y") >= 0) & (F.col("y") < y_dim) & (F.col("x") >= 0) & (F.col("x") < x_dim)).repartition(*keys, "y")
    one = held.groupBy(*keys, "y", "x").agg(F.max(F.col("value").cast("double")).alias("value"))  # stays where it is
    at = F.map_from_entries(F.collect_list(F.struct("x", "value")))
    rows = one.groupBy(*keys, "y").agg(at.alias("m"))
    out = rows.select(*keys, "y", F.transform(F.sequence(F.lit(0), F.lit(x_dim - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(float("nan")))).alias("row"))
    out.repartition(keys[0]).sortWithinPartitions(*keys, "y").write.partitionBy(keys[0]).parquet(path)


def read_grid(spark: SparkSession, path: str, keys: str) -> DataFrame:
    """``write_grid`` undone: cells that are not NaN. ``keys`` names the key columns with their types."""
    rows = spark.read.schema(f"{keys}, y int, row array<double>").parquet(path)
    cols = [c.split()[0] for c in keys.split(",")]
    return rows.select(*cols, "y", F.posexplode("row").alias("x", "value")).filter("NOT isnan(value)")


def clean(df: DataFrame, undefined: float = -999.99) -> DataFrame:
    """Undefined values of every column made one mark: null, NaN and infinite numbers, empty or 'null' texts."""
    out = {}
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if kind in ("double", "float"):
            out[f.name] = F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(undefined)).otherwise(c)
        elif kind in ("int", "bigint", "smallint", "tinyint"):
            out[f.name] = F.coalesce(c.cast("double"), F.lit(undefined))
        elif kind == "string":
            out[f.name] = F.when(c.isNull() | F.lower(F.trim(c)).isin("", "null", "nan", "none"), F.lit(str(undefined))).otherwise(c)
    return df.withColumns(out)


def family_report(table: DataFrame) -> DataFrame:
    """``(uid, k, line)``: fixed-width lines for each uid, its head in line 0 and a line for each of its rows in order of time.

    The head gives the uid, its number of rows, its first and last time and its hours; a row gives time, level, size, centre,
    mean and largest value and expansion, undefined ones as -999.99.
    """
    t = clean(table.select("uid", "ts", "level", "label", F.col("size").cast("double").alias("size"), "cx", "cy", "mean", "max", "expansion"))
    t = t.withColumns({c: F.col(c).cast("bigint") for c in ("uid", "level", "label")})
    w = Window.partitionBy("uid").orderBy("ts", "level", "label")
    row = F.format_string("%s %2d %8d %10.3f %10.3f %10.2f %10.2f %12.3f", F.date_format("ts", "yyyyMMdd HHmm"), F.col("level"), F.col("size").cast("int"), "cx", "cy", "mean", "max", "expansion")
    body = t.select("uid", F.row_number().over(w).cast("bigint").alias("k"), row.alias("line"))
    hours = F.timestamp_diff("MINUTE", F.min("ts"), F.max("ts")) / 60.0
    line = F.format_string("FAMILY %8d %6d %s %s %8.2f", F.col("uid"), F.count(F.lit(1)), F.date_format(F.min("ts"), "yyyyMMdd HHmm"), F.date_format(F.max("ts"), "yyyyMMdd HHmm"), hours)
    return t.groupBy("uid").agg(F.lit(0).cast("bigint").alias("k"), line.alias("line")).unionByName(body)


KINDS = ("boundaries", "trajectories", "vectorfield", "clusters")


def convert(tracker, kind: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """A tracker's result between two times as one of ``KINDS``; geographic kinds need the grid's bounds."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    if kind != "clusters" and not tracker.cfg.grid.geographic:
        raise ValueError("this kind needs the bounds of the grid")
    keep = F.lit(True)
    if start is not None:
        keep = keep & (F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        keep = keep & (F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    rows = tracker.tracks.filter(keep)
    if kind == "boundaries":
        return boundaries(rows, tracker.outlines())
    if kind == "trajectories":
        return rows.filter("trajectory IS NOT NULL").select("ts", "uid", "iuid", "level", "trajectory")
    if kind == "clusters":
        value = F.when(F.col("level") == 0, F.col("uid").cast("double")).otherwise(F.col("iuid"))
        return raster_columns(tracker.labelled, rows.withColumn("value", value), ("value",))
    g = tracker.cfg.grid
    return vectorfield(tracker.flow_points.join(rows.select(*KEY), KEY, "left_semi"), (g.x0 + g.x_res / 2, g.y0 + g.y_res / 2), (g.x_res, g.y_res))


def split_dateline(pixels: DataFrame, x_dim: int) -> DataFrame:
    """Pixels beyond the last column taken round to the first, ``part`` telling the turns made: 0 for those that stay."""
    return pixels.withColumns({"x": F.pmod(F.col("x"), F.lit(x_dim)), "part": F.floor(F.col("x") / x_dim).cast("int")})


def lists_by_time(table: DataFrame, columns: tuple[str, ...], order: tuple[str, ...], by: tuple[str, ...] = ("frame",)) -> DataFrame:
    """``(*by, *columns)``: each column as a list for each time, in ``order``."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *(F.col(c).alias(f"__{c}") for c in columns))))
    pick = lambda c: F.transform("r", lambda r: r[f"__{c}"]).alias(c)
    return table.groupBy(*by).agg(rows.alias("r")).select(*by, *map(pick, columns))
