"""Points near other points, and the region that holds a point.

Neighbours: latitude is cut into strips somewhat higher than the search distance
(and longitude into wide blocks, so that one crowded time step still spreads over
many tasks). A point is copied into each strip and block within reach. Every cell
is sorted by longitude and swept with an active window; distances are verified on
the sphere. A pair belongs to the home cell of its smaller id, so it comes out once.

Regions: polygons are laid out on grid cells once; a point meets only the regions of its cell, and a cell wholly inside
a region decides without a test. A region list below ``REGION_BYTES`` of text (checked by a count over the table) travels
with the tasks; a larger one is equi-joined by cell, and its polygons are sent once to each share of the points at their rims.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celltrack.functions import wkt
from celltrack.runtime import cut

EARTH_KM = 6371.0
STRIP_REACHES = 4.0  # strip height in search distances
BLOCK_DEGREES = 20.0
REGION_BYTES = 16 << 20
CELL_DEGREES = 1.0
SHARES = 16  # parts into which the points at a large region's rim are cut
PAIRS_AT_ONCE = 1 << 20


def locate(df: DataFrame, geometry: str = "geometry", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` plus ``lon, lat``: the area centroid of a WKT column.

    lon is in [-180, 180). Null, empty and unreadable geometries give null lon and lat.
    Longitudes are equal modulo 360, also among the pieces of one geometry.
    """
    picked = df.select(*keep, F.col(geometry).alias("__wkt"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "__wkt"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lon, lat = wkt.centroids(b["__wkt"])
            out = b.drop(columns="__wkt")
            out["lon"] = np.mod(lon + 180.0, 360.0) - 180.0
            out["lat"] = lat
            yield out

    return picked.mapInPandas(parse, ", ".join([*fields, "lon double, lat double"])).withColumns(
        {c: F.when(~F.isnan(c), F.col(c)) for c in ("lon", "lat")}
    )


def _lon_reach(lat_abs: float, angle: float) -> float:
    """Degrees of longitude that ``angle`` (radians) can span at up to this latitude."""
    if math.radians(lat_abs) + angle >= math.pi / 2:
        return 360.0
    return math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat_abs))))) + 1e-9


def distance_km(lon1, lat1, lon2, lat2):
    """Great circle by the haversine formula, on numpy arrays of degrees."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(a)))


def near_pairs(points: DataFrame, km: float, group: tuple[str, ...] = (), id_col: str = "id") -> DataFrame:
    """Pairs ``(a_id, b_id)``, a_id < b_id, at most ``km`` apart within equal ``group`` columns.

    Rows with null id, lon, lat or group are left out; repeated rows count once; points at
    equal places are near. Any further columns are ignored. An empty input gives no pairs.
    """
    angle = km / EARTH_KM
    reach = math.degrees(angle) + 1e-9
    high = max(reach * STRIP_REACHES, 1e-6)
    blocks = int(360 // BLOCK_DEGREES)
    lat, lon = F.col("lat"), F.col("lon")
    own_strip, own_block = F.floor(lat / high), F.floor((lon + 180.0) / BLOCK_DEGREES).cast("int")
    span = F.when(F.abs(lat) + reach >= 90, F.lit(180.0)).otherwise(
        F.degrees(F.asin(F.least(F.lit(1.0), math.sin(angle) / F.cos(F.radians(lat))))) + 1e-9
    )
    keys = [f"g{i}" for i in range(len(group))]
    base = points.select(
        F.col(id_col).cast("bigint").alias("id"), lon, lat, *(F.col(g).alias(k) for g, k in zip(group, keys))
    ).na.drop()
    copies = (
        base.withColumn("strip", F.explode(F.sequence(F.floor((lat - reach) / high), F.floor((lat + reach) / high))))
        .withColumn(
            "b0",
            F.explode(
                F.array_distinct(
                    F.transform(
                        F.sequence(
                            F.floor((lon + 180.0 - span) / BLOCK_DEGREES).cast("int"),
                            F.floor((lon + 180.0 + span) / BLOCK_DEGREES).cast("int"),
                        ),
                        lambda b: F.pmod(b, F.lit(blocks)),
                    )
                )
            ),
        )
        .withColumn("home", (F.col("strip") == own_strip) & (F.col("b0") == F.pmod(own_block, F.lit(blocks))))
    )
    centre = (F.col("b0") + 0.5) * BLOCK_DEGREES - 180.0
    copies = copies.withColumn("lon", lon + 360.0 * F.round((centre - lon) / 360.0))
    cell = ["strip", "b0", *keys]
    placed = (
        copies.repartition(*cell)
        .dropDuplicates([*cell, "id", "lon", "lat"])
        .sortWithinPartitions(*cell, "lon")
        .select(*cell, "id", "lon", "lat", "home")
    )
    n_cell = len(cell)

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for new in batches:
            if not len(new):
                continue
            old = 0 if held is None else len(held)
            rows = new if held is None else pd.concat([held, new], ignore_index=True)
            change = np.zeros(len(rows), bool)
            change[0] = True
            for c in cell:
                v = rows[c].to_numpy()
                change[1:] |= v[1:] != v[:-1]
            cell_no = np.cumsum(change) - 1
            x, y = rows["lon"].to_numpy(float), rows["lat"].to_numpy(float)
            strip = rows["strip"].to_numpy()
            widest = {
                s: _lon_reach(min(90.0, max(abs(s * high - reach), abs((s + 1) * high + reach))), angle)
                for s in np.unique(strip)
            }
            width = np.array([widest[s] for s in strip])
            line = cell_no * 2000.0 + x  # lon spans less than 1000 within a cell
            last = np.searchsorted(line, np.minimum(line + width, cell_no * 2000.0 + 999), "right")
            i = np.arange(len(rows))
            count = np.maximum(last - i - 1, 0)
            ids, home = rows["id"].to_numpy(), rows["home"].to_numpy(bool)
            edges = np.r_[0, np.cumsum(count)]
            at = 0
            while at < len(rows):
                to = max(at + 1, int(np.searchsorted(edges, edges[at] + PAIRS_AT_ONCE, "right")) - 1)
                k = count[at:to]
                a = np.repeat(i[at:to], k)
                b = a + 1 + (np.arange(k.sum()) - np.repeat(edges[at:to] - edges[at], k))
                ok = (b >= old) & (ids[a] != ids[b]) & (np.abs(y[a] - y[b]) <= reach)
                a, b = a[ok], b[ok]
                ok = home[np.where(ids[a] < ids[b], a, b)]
                a, b = a[ok], b[ok]
                ok = distance_km(x[a], y[a], x[b], y[b]) <= km
                a, b = a[ok], b[ok]
                if len(a):
                    yield pd.DataFrame({"a_id": np.minimum(ids[a], ids[b]), "b_id": np.maximum(ids[a], ids[b])})
                at = to
            active = (cell_no == cell_no[-1]) & (x >= x[-1] - width)
            held = rows[active].reset_index(drop=True)

    assert n_cell == len(set(cell))
    return placed.mapInPandas(sweep, "a_id bigint, b_id bigint").distinct()


def cell_of(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Number of the ``CELL_DEGREES`` cell of each place, longitudes modulo 360."""
    turn = int(360 / CELL_DEGREES)
    return np.floor(lat / CELL_DEGREES).astype(np.int64) * turn + np.mod(np.floor(lon / CELL_DEGREES).astype(np.int64), turn)


def region_cells(r: wkt.Rings) -> tuple[np.ndarray, np.ndarray]:
    """The cells that a geometry reaches, and which of them lie in it wholly, no side coming near them."""
    if not len(r.row):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    nxt = np.arange(1, len(r.x) + 1)
    nxt[r.start + r.length - 1] = r.start
    eps = 1e-9
    floor = lambda v: np.floor(v / CELL_DEGREES).astype(np.int64)
    x0, x1 = floor(np.minimum(r.x, r.x[nxt]) - eps), floor(np.maximum(r.x, r.x[nxt]) + eps)
    y0, y1 = floor(np.minimum(r.y, r.y[nxt]) - eps), floor(np.maximum(r.y, r.y[nxt]) + eps)
    turn = int(360 / CELL_DEGREES)
    touched: set[tuple[int, int]] = set()
    reached: set[tuple[int, int]] = set()
    for a, b, c, d in zip(x0.tolist(), x1.tolist(), y0.tolist(), y1.tolist()):
        touched.update((cy, cx % turn) for cx in range(a, b + 1) for cy in range(c, d + 1))
    for s, k in zip(r.start.tolist(), r.length.tolist()):
        reached.update((cy, cx % turn) for cx in range(int(x0[s : s + k].min()), int(x1[s : s + k].max()) + 1) for cy in range(int(y0[s : s + k].min()), int(y1[s : s + k].max()) + 1))
    free = np.array(sorted(reached - touched), np.int64).reshape(-1, 2)
    inner = free[wkt.inside(r, (free[:, 1] + 0.5) * CELL_DEGREES, (free[:, 0] + 0.5) * CELL_DEGREES)]
    rim = np.array(sorted(touched), np.int64).reshape(-1, 2)
    both = np.concatenate([rim, inner])
    return both[:, 0] * turn + both[:, 1], np.arange(len(both)) >= len(rim)


def containing_region(points: DataFrame, regions: DataFrame, id_cols: tuple[str, ...], region_bytes: int = REGION_BYTES) -> DataFrame:
    """``id_cols`` plus ``region_id, region_name`` for points with lon/lat that lie in a region.

    Points without location or outside every region have no row. Regions without a readable
    geometry hold nothing; a point in several overlapping regions has a row for each.
    """
    spark = points.sparkSession
    listed = regions.select(F.col("region_id").cast("bigint").alias("region_id"), F.col("name").alias("region_name"), F.col("geometry").alias("__wkt")).filter(
        F.col("region_id").isNotNull() & F.col("__wkt").isNotNull()
    )
    picked = points.select(*id_cols, "lon", "lat").filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name in id_cols)
    schema = f"{fields}, region_id bigint, region_name string"
    weight = listed.agg(F.coalesce(F.sum(F.length("__wkt") + F.coalesce(F.length("region_name"), F.lit(0)) + 16), F.lit(0))).first()[0]
    if weight <= region_bytes:
        small = [(int(i), n, w) for i, n, w in listed.toLocalIterator()]
        sent = spark.sparkContext.broadcast(small)

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parsed = [(i, n, wkt.rings([w])) for i, n, w in sent.value]
            at = [region_cells(r) for _, _, r in parsed]
            cell = np.concatenate([c for c, _ in at]) if at else np.zeros(0, np.int64)
            region = np.repeat(np.arange(len(at)), [len(c) for c, _ in at])
            whole = np.concatenate([w for _, w in at]) if at else np.zeros(0, bool)
            order = np.argsort(cell, kind="stable")
            cell, region, whole = cell[order], region[order], whole[order]
            for b in batches:
                lon, lat = b["lon"].to_numpy(float), b["lat"].to_numpy(float)
                own = cell_of(lon, lat)
                lo, hi = np.searchsorted(cell, own, "left"), np.searchsorted(cell, own, "right")
                n = hi - lo
                point = np.repeat(np.arange(len(b)), n)
                entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                hit = whole[entry].copy()
                for k in np.unique(region[entry[~hit]]).tolist():
                    some = np.flatnonzero((region[entry] == k) & ~whole[entry])
                    hit[some] = wkt.inside(parsed[k][2], lon[point[some]], lat[point[some]])
                if hit.any():
                    of = region[entry[hit]]
                    out = b.iloc[point[hit]][list(id_cols)].reset_index(drop=True)
                    yield out.assign(region_id=[parsed[k][0] for k in of], region_name=[parsed[k][1] for k in of])

        return picked.mapInPandas(search, schema)

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, name, text in b.itertuples(index=False, name=None):
                cell, whole = region_cells(wkt.rings([text]))
                if len(cell):
                    yield pd.DataFrame({"region_id": i, "region_name": name, "cell": cell, "whole": whole})

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(cell=cell_of(b["lon"].to_numpy(float), b["lat"].to_numpy(float)))

    covered = listed.mapInPandas(cover, "region_id bigint, region_name string, cell bigint, whole boolean")
    met = cut(picked.mapInPandas(number, f"{fields}, lon double, lat double, cell bigint").join(covered, "cell").drop("cell"))
    sure = met.filter("whole").select(*id_cols, "region_id", "region_name")
    # each polygon's text goes once to each of its shares of points, ahead of them, and never on a point's row
    nothing = {c: F.lit(None).cast(t) for c, t in met.dtypes}
    doubtful = met.filter("NOT whole").select(*met.columns, F.pmod(F.xxhash64("lon", "lat"), F.lit(SHARES)).alias("share"), F.lit(None).cast("string").alias("__wkt"))
    shapes = listed.select(*(F.col(c) if c == "region_id" else nothing[c].alias(c) for c in met.columns), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SHARES - 1).cast("bigint"))).alias("share"), "__wkt")
    lined = doubtful.unionByName(shapes).repartition("region_id", "share").sortWithinPartitions("region_id", "share", F.col("__wkt").desc_nulls_last())

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapes_of: dict[int, list[wkt.Rings]] = {}
        for b in batches:
            rid = b["region_id"].to_numpy()
            edge = np.flatnonzero(np.r_[True, rid[1:] != rid[:-1]])
            for lo, hi in zip(edge, np.r_[edge[1:], len(b)]):
                part, k = b.iloc[lo:hi], int(rid[lo])
                if k not in shapes_of:
                    shapes_of = {k: []}  # regions come one after another
                text = part["__wkt"].notna()
                shapes_of[k] += [wkt.rings([t]) for t in dict.fromkeys(part.loc[text, "__wkt"])]
                part = part[~text]
                lon, lat = part["lon"].to_numpy(float), part["lat"].to_numpy(float)
                for r in shapes_of[k]:
                    hit = wkt.inside(r, lon, lat) if len(part) else np.zeros(0, bool)
                    if hit.any():
                        yield part.loc[hit, [*id_cols, "region_id", "region_name"]]

    return sure.unionByName(lined.mapInPandas(test, schema))


def proximity_report(tracking: DataFrame, regions: DataFrame, km: float = 60.0) -> DataFrame:
    """``(kind, a_id, b_id)``: near pairs of equal time and level, and missing or wrong regions.

    ``near``: two different cindex of equal timestamp and threshold_level at most ``km`` apart,
    smaller first. ``region``: the region_id that holds a row whose region is null or not
    exactly that region's name, and the row's cindex.
    """
    where = cut(
        locate(
            tracking.filter(F.col("cindex").isNotNull() & F.col("geometry").isNotNull())
            .select(F.col("cindex").cast("bigint").alias("id"), F.unix_micros("timestamp").alias("t"), "threshold_level", F.col("region").alias("given"), "geometry"),
            keep=("id", "t", "threshold_level", "given"),
        ).filter(F.col("lon").isNotNull())
    )
    near = near_pairs(where, km, ("t", "threshold_level"))
    held = containing_region(where, regions, ("id", "given"))
    wrong = held.filter(~F.col("given").eqNullSafe(F.col("region_name"))).select(
        F.lit("region").alias("kind"), F.col("region_id").alias("a_id"), F.col("id").alias("b_id")
    )
    return near.select(F.lit("near").alias("kind"), "a_id", "b_id").unionByName(wrong.distinct())
