"""Image filters on cells. A stencil works on tiles with a rim as wide as its reach, so a cell travels once, rims apart."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 256


def _stencil(cells: DataFrame, weights: dict[tuple[int, int], float], combine: Callable[[np.ndarray, np.ndarray], np.ndarray], tile: int = TILE) -> DataFrame:
    """``combine(values, weights)`` at every cell over its present neighbours.

    ``values`` holds, for each of n cells, one row of a value per offset, NaN where there is no cell; cells without a value are
    not there, and of cells at one place the largest counts.
    """
    reach = max(max(abs(dy), abs(dx)) for dy, dx in weights)
    offsets, w = np.array(list(weights)), np.array(list(weights.values()), float)
    span = lambda c: F.sequence(F.floor((F.col(c) - reach) / tile).cast("int"), F.floor((F.col(c) + reach) / tile).cast("int"))
    placed = cells.filter(F.col("value").isNotNull() & ~F.isnan("value")).select("frame", "y", "x", "value").withColumn("ty", F.explode(span("y"))).withColumn("tx", F.explode(span("x")))

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(rows["ty"].iat[0]), int(rows["tx"].iat[0])
        y, x = rows["y"].to_numpy() - ty * tile + reach, rows["x"].to_numpy() - tx * tile + reach
        v = rows["value"].to_numpy(float)
        size = tile + 2 * reach
        grid = np.full((size + 2 * reach, size + 2 * reach), np.nan)
        order = np.argsort(v, kind="stable")
        grid[y[order] + reach, x[order] + reach] = v[order]
        own = np.unique((y * size + x)[(y >= reach) & (y < reach + tile) & (x >= reach) & (x < reach + tile)])
        oy, ox = own // size, own % size
        around = grid[oy[:, None] + reach + offsets[:, 0], ox[:, None] + reach + offsets[:, 1]]
        out = combine(around, w) if len(own) else np.zeros(0)
        return pd.DataFrame({"frame": rows["frame"].iat[0], "y": (oy - reach + ty * tile).astype("int32"), "x": (ox - reach + tx * tile).astype("int32"), "value": out})

    return placed.groupBy("frame", "ty", "tx").applyInPandas(work, "frame int, y int, x int, value double")


SQUARE = {(dy, dx): 1.0 for dy in (-1, 0, 1) for dx in (-1, 0, 1)}


def _weighted_sum(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.nansum(v * w, axis=1)


def gaussian_blur(cells: DataFrame, sigma: float = 1.0) -> DataFrame:
    w = {(dy, dx): math.exp(-(dy * dy + dx * dx) / (2 * sigma * sigma)) for dy, dx in SQUARE}
    return _stencil(cells, w, lambda v, k: _weighted_sum(v, k) / ((~np.isnan(v)) * k).sum(1))


def median(cells: DataFrame) -> DataFrame:
    return _stencil(cells, SQUARE, lambda v, k: np.nanmedian(v, axis=1))


def dilate(cells: DataFrame) -> DataFrame:
    return _stencil(cells, SQUARE, lambda v, k: np.nanmax(v, axis=1))


def erode(cells: DataFrame) -> DataFrame:
    return _stencil(cells, SQUARE, lambda v, k: np.nanmin(v, axis=1))


def sharpen(cells: DataFrame) -> DataFrame:
    """Centre by 5, its four neighbours by -1; a missing neighbour counts as the centre does not."""
    w = {(0, 0): 5.0, (1, 0): -1.0, (-1, 0): -1.0, (0, 1): -1.0, (0, -1): -1.0}
    return _stencil(cells, w, _weighted_sum)


def by_frame(cells: DataFrame, f: Callable[[Column, Column, Column, Column, Column], Column]) -> DataFrame:
    """``f(value, min, max, mean, std)`` of each cell, statistics taken from its frame by a small aggregate."""
    s = cells.groupBy("frame").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    return cells.join(s, "frame").select("frame", "y", "x", f(F.col("value"), F.col("lo"), F.col("hi"), F.col("mu"), F.col("sd")).alias("value"))


def normalize(cells: DataFrame) -> DataFrame:
    return by_frame(cells, lambda v, lo, hi, mu, sd: F.when(hi > lo, (v - lo) / (hi - lo) * 255.0).otherwise(0.0))


def zscore(cells: DataFrame) -> DataFrame:
    return by_frame(cells, lambda v, lo, hi, mu, sd: F.when(sd > 0, (v - mu) / sd).otherwise(0.0))


def binarize(cells: DataFrame, threshold: float, high: float = 255.0) -> DataFrame:
    return cells.select("frame", "y", "x", F.when(F.col("value") > threshold, high).otherwise(0.0).alias("value"))


def equalize(cells: DataFrame) -> DataFrame:
    """Histogram equalisation over the 256 grey values of the normalised frame."""
    grey = normalize(cells).withColumn("bin", F.floor("value").cast("int"))
    hist = grey.groupBy("frame", "bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("frame").orderBy("bin")
    all_ = Window.partitionBy("frame")
    cum = hist.withColumn("cdf", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(all_)).withColumn("c0", F.min("cdf").over(all_))
    out = cum.select("frame", "bin", F.when(F.col("total") > F.col("c0"), (F.col("cdf") - F.col("c0")) * 255.0 / (F.col("total") - F.col("c0"))).otherwise(0.0).alias("value"))
    return grey.drop("value").join(out, ["frame", "bin"]).select("frame", "y", "x", "value")


def dense(y: np.ndarray, x: np.ndarray, v: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    a = np.zeros(shape)
    a[y, x] = v
    return a


def _box(a: np.ndarray, reach: int) -> np.ndarray:
    """Sums over squares of ``reach`` cells each way, cut off at the edges."""
    c = np.pad(a, ((reach + 1, reach), (reach + 1, reach))).cumsum(0).cumsum(1)
    n = 2 * reach + 1
    return c[n:, n:] - c[:-n, n:] - c[n:, :-n] + c[:-n, :-n]


def _halved(a: np.ndarray) -> np.ndarray:
    a = np.pad(a, ((0, a.shape[0] % 2), (0, a.shape[1] % 2)), mode="edge")
    return (a[::2, ::2] + a[1::2, ::2] + a[::2, 1::2] + a[1::2, 1::2]) / 4


def _pyramid(before: np.ndarray, after: np.ndarray, levels: int, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Both images, each level half the size of the one before, down to ``least`` cells a side."""
    out = [(before, after)]
    while len(out) < levels and min(out[-1][0].shape) >= 2 * least:
        out.append((_halved(out[-1][0]), _halved(out[-1][1])))
    return out


def _doubled(flow: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    return 2 * np.repeat(np.repeat(flow, 2, 0), 2, 1)[: shape[0], : shape[1]]


def _moved(a: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The image seen from each cell along its vector, bilinear."""
    h, w = a.shape
    y, x = np.mgrid[:h, :w]
    sy, sx = np.clip(y + v, 0, h - 1), np.clip(x + u, 0, w - 1)
    y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = sy - y0, sx - x0
    return a[y0, x0] * (1 - fy) * (1 - fx) + a[y1, x0] * fy * (1 - fx) + a[y0, x1] * (1 - fy) * fx + a[y1, x1] * fy * fx


DAMPING = 0.02
FARTHEST = 5.0  # cells that one level of the pyramid may move


def lucas_kanade(before: np.ndarray, after: np.ndarray, window: int = 2, steps: int = 30, levels: int = 3, settled: float = 0.01) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense least-squares flow by iterated warping from coarse to fine; ``(u, v, quality)``, quality being the smaller eigenvalue.

    Each of up to ``levels`` levels takes at most ``steps`` steps, or stops once none moves by ``settled`` cells.
    """
    if min(before.shape) < 3:
        return np.zeros_like(before), np.zeros_like(before), np.zeros_like(before)
    u = v = quality = np.zeros((1, 1))
    for one, two in reversed(_pyramid(before, after, levels, 8)):
        reach = min(window, (min(one.shape) - 1) // 2)
        u, v = (_doubled(f, one.shape) if f.size > 1 else np.zeros(one.shape) for f in (u, v))
        gy, gx = np.gradient(one)
        xx, yy, xy = _box(gx * gx, reach), _box(gy * gy, reach), _box(gx * gy, reach)
        trace, det = xx + yy, xx * yy - xy * xy
        quality = trace / 2 - np.sqrt(np.maximum(trace**2 / 4 - det, 0))
        damp = DAMPING * max(quality.max(), 1e-12)  # a place that shows its movement across an edge only stays put along it
        ax, ay = xx + damp, yy + damp
        full = ax * ay - xy * xy
        lead = np.maximum(quality, 1e-6 * max(quality.max(), 1e-12))
        total = _box(lead, reach)
        u0, v0 = u, v
        for _ in range(steps):
            t = _moved(two, u, v) - one
            bx, by = _box(gx * t, reach), _box(gy * t, reach)
            du = np.clip(-(ay * bx - xy * by) / full, -1, 1)
            dv = np.clip(-(ax * by - xy * bx) / full, -1, 1)
            # neighbours that share a window must share its flow, the clearer ones leading
            du, dv = _box(du * lead, reach) / total, _box(dv * lead, reach) / total
            u, v = np.clip(u + du, u0 - FARTHEST, u0 + FARTHEST), np.clip(v + dv, v0 - FARTHEST, v0 + FARTHEST)
            if max(np.abs(du).max(), np.abs(dv).max()) < settled:
                break
        u, v = _box(u * lead, reach) / total, _box(v * lead, reach) / total
    return u, v, quality


def flow_vectors(cells: DataFrame, labelled: DataFrame, pairs: DataFrame, y_dim: int, x_dim: int, least: float = 0.01, method: str = "lucas-kanade") -> DataFrame:
    """``(frame, level, label, u_opt, v_opt)``: mean flow of the previous to the present image over a cluster.

    A point counts for the cluster of the highest level that holds it.
    """
    points = flow_points(cells, labelled, pairs, y_dim, x_dim, least, method)
    return points.groupBy("frame", "level", "label").agg(F.avg("u").alias("u_opt"), F.avg("v").alias("v_opt"))


def flow_points(cells: DataFrame, labelled: DataFrame, pairs: DataFrame, y_dim: int, x_dim: int, least: float = 0.01, method: str = "lucas-kanade") -> DataFrame:
    """``(frame, level, label, y, x, u, v)``: flow of the previous to the present image at the points of clusters.

    A task holds the two images of one frame pair. With lucas-kanade, points of less than ``least`` of the best quality
    do not count; with farneback, points that move by a cell or less.
    """
    now = cells.join(pairs.select("frame"), "frame").select("frame", "y", "x", "value", F.lit(1).alias("now"))
    old = cells.select(F.col("frame").alias("prev_frame"), "y", "x", "value").join(pairs.select("frame", "prev_frame"), "prev_frame").select("frame", "y", "x", "value", F.lit(0).alias("now"))

    def flow(rows: pd.DataFrame) -> pd.DataFrame:
        part = lambda k: dense(*(rows.loc[rows["now"] == k, c].to_numpy() for c in ("y", "x", "value")), (y_dim, x_dim))
        if method == "farneback":
            u, v = polynomial_flow(part(0), part(1), window=min(20, min(y_dim, x_dim) // 3))
            y, x = np.nonzero(np.hypot(u, v) > 1)
        else:
            u, v, q = lucas_kanade(part(0), part(1), max(2, min(y_dim, x_dim) // 20))
            y, x = np.nonzero(q >= least * max(q.max(), 1e-12))
        return pd.DataFrame({"frame": rows["frame"].iat[0], "y": y.astype("int32"), "x": x.astype("int32"), "u": u[y, x], "v": v[y, x]})

    field = now.unionByName(old).groupBy("frame").applyInPandas(flow, "frame int, y int, x int, u double, v double")
    top = labelled.groupBy("frame", "y", "x").agg(F.max(F.struct("level", "label")).alias("c"))
    return top.join(field, ["frame", "y", "x"]).select("frame", "c.level", "c.label", "y", "x", "u", "v")


def gabor(cells: DataFrame, size: int = 3, sigma: float = 2.0, theta: float = 0.0, wavelength: float = 5.0, gamma: float = 0.5) -> DataFrame:
    """Gabor response; cells outside the data count as absent."""
    w = {}
    for dy in range(-size, size + 1):
        for dx in range(-size, size + 1):
            a, b = dx * math.cos(theta) + dy * math.sin(theta), -dx * math.sin(theta) + dy * math.cos(theta)
            w[dy, dx] = math.exp(-(a * a + gamma * gamma * b * b) / (2 * sigma * sigma)) * math.cos(2 * math.pi * a / wavelength)
    return _stencil(cells, w, _weighted_sum)


def scale(cells: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    return by_frame(cells, lambda v, lo, hi, mu, sd: F.when(hi > lo, low + (v - lo) / (hi - lo) * (high - low)).otherwise(low))


def noise(cells: DataFrame, sd: float = 1.0, seed: int = 0) -> DataFrame:
    """Gaussian noise that depends on the place only, so every run adds the same."""
    u = lambda k: (F.pmod(F.xxhash64("frame", "y", "x", F.lit(seed + k)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    return cells.select("frame", "y", "x", (F.col("value") + sd * F.sqrt(-2 * F.log(u(0))) * F.cos(2 * math.pi * u(1))).alias("value"))


def canny(cells: DataFrame, low: float, high: float) -> DataFrame:
    """``(frame, y, x, value)``: 255 on edges, 0 elsewhere. A task holds one frame."""

    def edges(rows: pd.DataFrame) -> pd.DataFrame:
        y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
        a = dense(y, x, rows["value"].to_numpy(), (int(y.max()) + 1, int(x.max()) + 1))
        gy, gx = np.gradient(a) if min(a.shape) > 1 else (np.zeros_like(a), np.zeros_like(a))
        m = np.hypot(gx, gy)
        p = np.pad(m, 1)
        sector = (np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int)) % 4
        ridge = np.zeros(a.shape, bool)
        for k, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
            ahead = p[1 + dy : 1 + dy + a.shape[0], 1 + dx : 1 + dx + a.shape[1]]
            back = p[1 - dy : 1 - dy + a.shape[0], 1 - dx : 1 - dx + a.shape[1]]
            ridge |= (sector == k) & (m >= ahead) & (m >= back)
        weak, keep = ridge & (m >= low), ridge & (m >= high)
        while True:
            q = np.pad(keep, 1)
            grown = weak & np.any([q[1 + dy : 1 + dy + a.shape[0], 1 + dx : 1 + dx + a.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
            if (grown == keep).all():
                break
            keep = grown
        return pd.DataFrame({"frame": rows["frame"], "y": rows["y"], "x": rows["x"], "value": np.where(keep[y, x], 255.0, 0.0)})

    return cells.groupBy("frame").applyInPandas(edges, "frame int, y int, x int, value double")


def polynomial_flow(before: np.ndarray, after: np.ndarray, sigma: float = 1.2, radius: int = 3, window: int = 20, steps: int = 4, levels: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Dense flow from local quadratic fits of both images, averaged over a window and refined from coarse to fine by moving the second fit."""
    d = np.arange(-radius, radius + 1)
    g = np.exp(-(d**2) / (2 * sigma**2))
    yy, xx = np.meshgrid(d, d, indexing="ij")
    basis = np.stack([np.ones_like(xx), xx, yy, xx * xx, yy * yy, xx * yy]).reshape(6, -1).astype(float)
    weight = np.outer(g, g).ravel()
    solve = np.linalg.inv((basis * weight) @ basis.T) @ (basis * weight)

    def fit(a: np.ndarray) -> np.ndarray:
        views = np.lib.stride_tricks.sliding_window_view(np.pad(a, radius, mode="edge"), (2 * radius + 1,) * 2)
        return views.reshape(*a.shape, -1) @ solve.T

    u = v = np.zeros((1, 1))
    for one, two in reversed(_pyramid(before, after, levels, 24)):
        reach = min(window, (min(one.shape) - 1) // 2)
        u, v = (_doubled(f, one.shape) if f.size > 1 else np.zeros(one.shape) for f in (u, v))
        p, q = fit(one), fit(two)
        y0, x0 = np.mgrid[: one.shape[0], : one.shape[1]]
        for _ in range(steps):
            ry, rx = np.rint(v).astype(int), np.rint(u).astype(int)
            there = q[np.clip(y0 + ry, 0, one.shape[0] - 1), np.clip(x0 + rx, 0, one.shape[1] - 1)]
            axx, ayy, axy = (p[..., 3] + there[..., 3]) / 2, (p[..., 4] + there[..., 4]) / 2, (p[..., 5] + there[..., 5]) / 4
            bx = (p[..., 1] - there[..., 1]) / 2 + axx * rx + axy * ry
            by = (p[..., 2] - there[..., 2]) / 2 + axy * rx + ayy * ry
            g11, g22, g12 = _box(axx**2 + axy**2, reach), _box(ayy**2 + axy**2, reach), _box(axy * (axx + ayy), reach)
            h1, h2 = _box(axx * bx + axy * by, reach), _box(axy * bx + ayy * by, reach)
            det = g11 * g22 - g12**2
            ok = det > 1e-9 * np.maximum((g11 + g22) ** 2, 1e-12)
            with np.errstate(all="ignore"):
                u = np.where(ok, (g22 * h1 - g12 * h2) / det, 0)
                v = np.where(ok, (g11 * h2 - g12 * h1) / det, 0)
    return u, v
