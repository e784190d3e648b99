"""Outlines of pixel sets: boundary polygons and convex hulls as WKT."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from celltrack.config import GridSpec


def boundary_rings(y: np.ndarray, x: np.ndarray) -> list[list[tuple[int, int]]]:
    """Closed rings (x, y) around unit pixels: shells anticlockwise, holes clockwise; pixels that touch at a corner stay apart."""
    y, x = np.asarray(y, np.int64), np.asarray(x, np.int64)
    wide = int(x.max()) + 3 if len(x) else 3
    code = np.unique((y + 1) * wide + x + 1)
    cy, cx = code // wide - 1, code % wide - 1
    nxt: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for step, (ax, ay), (bx, by) in ((-wide, (0, 0), (1, 0)), (1, (1, 0), (1, 1)), (wide, (1, 1), (0, 1)), (-1, (0, 1), (0, 0))):
        at = np.searchsorted(code, code + step)
        free = code[np.minimum(at, len(code) - 1)] != code + step  # sides without a neighbour
        for px, py in zip(cx[free].tolist(), cy[free].tolist()):
            nxt.setdefault((px + ax, py + ay), []).append((px + bx, py + by))
    rings = []
    while nxt:
        start = min(nxt)
        ring, at, came = [start], start, None
        while True:
            options = nxt[at]
            if came is None or len(options) == 1:
                to = options.pop()
            else:  # two ways out: turn left, around this pixel
                d = (at[0] - came[0], at[1] - came[1])
                to = next(o for o in options if (o[0] - at[0], o[1] - at[1]) == (-d[1], d[0]))
                options.remove(to)
            if not options:
                del nxt[at]
            came, at = at, to
            if at == start:
                break
            ring.append(at)
        corner = [p for i, p in enumerate(ring) if (p[0] - ring[i - 1][0]) * (ring[(i + 1) % len(ring)][1] - p[1]) != (p[1] - ring[i - 1][1]) * (ring[(i + 1) % len(ring)][0] - p[0])]
        rings.append([*corner, corner[0]])
    return rings


def _area(ring: list[tuple[int, int]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def _holds(ring: list[tuple[int, int]], px: float, py: float) -> bool:
    odd = False
    for (x0, y0), (x1, y1) in zip(ring, ring[1:]):
        if (y0 > py) != (y1 > py) and px < (x1 - x0) * (py - y0) / (y1 - y0) + x0:
            odd = not odd
    return odd


def polygon_wkt(y: np.ndarray, x: np.ndarray, g: GridSpec) -> str:
    """POLYGON or MULTIPOLYGON of a pixel set in map units, each hole in the shell around it."""
    rings = boundary_rings(y, x)
    shells = [[r] for r in rings if _area(r) > 0]
    for hole in (r for r in rings if _area(r) < 0):
        around = [s for s in shells if _holds(s[0], hole[0][0] + 1e-3, hole[0][1] + 1e-3) or _holds(s[0], hole[0][0] - 1e-3, hole[0][1] - 1e-3)]
        min(around or shells, key=lambda s: _area(s[0])).append(hole)
    text = ["(" + ", ".join("(" + ", ".join(f"{p[0] * g.x_res + g.x0:.10g} {p[1] * g.y_res + g.y0:.10g}" for p in r) + ")" for r in s) + ")" for s in shells]
    return f"POLYGON {text[0]}" if len(text) == 1 else f"MULTIPOLYGON ({', '.join(text)})"


def hull(y: np.ndarray, x: np.ndarray) -> list[tuple[int, int]]:
    """Convex hull of the pixel corners, anticlockwise and closed."""
    rows, row = np.unique(y, return_inverse=True)  # a row's outermost pixels are enough
    low, high = np.full(len(rows), np.iinfo(np.int64).max), np.full(len(rows), np.iinfo(np.int64).min)
    np.minimum.at(low, row, x)
    np.maximum.at(high, row, x)
    pts = sorted({(a, b + j) for a, b in zip([*low.tolist(), *(high + 1).tolist()], [*rows.tolist()] * 2) for j in (0, 1)})

    def half(seq) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(pts) + half(reversed(pts))
    return [*ring, ring[0]]


def outlines(arrays: DataFrame, g: GridSpec) -> DataFrame:
    """``(frame, level, label, geometry, hull_area)`` from the pixel lists of clusters."""

    def draw(batches):
        for b in batches:
            geo = [polygon_wkt(np.asarray(y), np.asarray(x), g) for y, x in zip(b["array_y"], b["array_x"])]
            area = [_area(hull(np.asarray(y), np.asarray(x))) * g.x_res * g.y_res for y, x in zip(b["array_y"], b["array_x"])]
            yield pd.DataFrame({"frame": b["frame"], "level": b["level"], "label": b["label"], "geometry": geo, "hull_area": area})

    return arrays.select("frame", "level", "label", "array_y", "array_x").mapInPandas(draw, "frame int, level int, label bigint, geometry string, hull_area double")


def hull_pixels(labelled: DataFrame) -> DataFrame:
    """``(frame, level, label, y, x)`` of the pixels whose centres lie in the convex hull of a cluster's pixels."""
    from pyspark.sql import functions as F

    arrays = labelled.groupBy("frame", "level", "label").agg(F.collect_list("y").alias("ys"), F.collect_list("x").alias("xs"))

    def fill(batches):
        for b in batches:
            for frame, level, label, ys, xs in b.itertuples(index=False, name=None):
                ring = np.array(hull(np.asarray(ys), np.asarray(xs)))
                gy, gx = np.mgrid[min(ys) : max(ys) + 1, min(xs) : max(xs) + 1]
                ok = np.ones(gy.shape, bool)
                for (x0, y0), (x1, y1) in zip(ring[:-1], ring[1:]):
                    ok &= (x1 - x0) * (gy + 0.5 - y0) - (y1 - y0) * (gx + 0.5 - x0) >= 0
                yield pd.DataFrame({"frame": frame, "level": level, "label": label, "y": gy[ok].astype("int32"), "x": gx[ok].astype("int32")})

    return arrays.mapInPandas(fill, "frame int, level int, label bigint, y int, x int")
