"""Implausible readings per source, by state-space forecasting.

Each source's field follows a local-level model. A Kalman filter forecasts the next reading;
an innovation beyond ``THRESHOLD`` standard deviations is flagged and its update withheld. Flags
that are not followed by a return within ``LASTING`` readings are a change of level: they are taken back
and the filter starts again there. Impossible readings, and runs over which the innovation variance
vanishes (equal values), are flagged and withheld before. The noise is the source's own robust
spread, widened where readings are few.

All sources of a batch are filtered side by side, one step of numpy for the t-th reading of every source;
long sources are cut into chunks with run-in and look-ahead, so a step is wide and a chunk short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 6.0
GAIN_RATIO = 0.15  # state noise over reading noise, as variances
LASTING = 4
STUCK = 5
START = 7
FEW = 6.0  # readings by which the spread of a short source is widened
CHUNK, CONTEXT = 512, 64
PIECE_FRAMES, PIECE_CONTEXT = 2048, 128
BATCH_ROWS = 60_000
BLOCK_ROWS, BLOCK_CONTEXT = 1 << 17, 1024


def stuck(value: np.ndarray, series: np.ndarray, least: int = STUCK, tolerance: float = 0.0) -> np.ndarray:
    """Members of runs of ``least`` or more readings of one series over which the innovation variance vanishes.

    The innovations of a random walk are its steps; their variance over a window vanishes when none exceeds ``tolerance``,
    which at 0 means equal values.
    """
    if not len(value):
        return np.zeros(0, bool)
    with np.errstate(invalid="ignore", over="ignore"):
        new = np.r_[True, ~(np.abs(value[1:] - value[:-1]) <= tolerance) | (series[1:] != series[:-1])]
    run = np.cumsum(new) - 1
    return np.bincount(run)[run] >= least


def _spread(v: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Robust standard deviation of reading noise of each padded row, from first differences."""
    d = np.abs(np.diff(v, axis=1))
    d[np.arange(1, v.shape[1])[None] >= length[:, None]] = np.nan
    out = np.full(len(v), np.nan)
    some = length >= 3
    if some.any():
        out[some] = 1.4826 * np.nanmedian(d[some], axis=1) / np.sqrt(2)
    return out


def kalman_flags(v: np.ndarray, length: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Flags for padded series (rows, longest first); ``length`` gives each row's readings.

    Rows of fewer than three readings have no flags.
    """
    rows, steps = v.shape
    flag = np.zeros(v.shape, bool)
    if not rows or steps < 3:
        return flag
    own = _spread(v, length)
    middle = np.nanmedian(np.where(np.arange(steps)[None] < length[:, None], v, np.nan), axis=1)
    sd = np.where(np.isfinite(own), own, 0.0) * np.sqrt(1 + FEW / np.maximum(length, 1))
    sd = np.maximum(sd, 1e-6 * (1 + np.abs(middle)))
    r = sd**2
    q = GAIN_RATIO * r
    head = np.where(np.arange(min(START, steps))[None] < length[:, None], v[:, :START], np.nan)
    level, p = np.nanmedian(head, axis=1), r.copy()
    pending = np.zeros(rows, np.int64)
    for t in range(steps):
        k = int(np.searchsorted(-length, -t, "left"))  # rows with a reading at t
        if not k:
            break
        y = v[:k, t]
        away = pending[:k] > 0
        p[:k] += np.where(away, 0.0, q[:k])  # a source that is away must come back to where it was
        s = p[:k] + r[:k]
        innovation = y - level[:k]
        out = innovation**2 > np.where(away, threshold / 2, threshold) ** 2 * s
        gain = np.where(out, 0.0, p[:k] / s)
        level[:k] += gain * innovation
        p[:k] *= 1 - gain
        flag[:k, t] = out & (innovation**2 > threshold**2 * s) & (pending[:k] < t)  # one before it at least
        pending[:k] = np.where(out, pending[:k] + 1, 0)
        for i in np.flatnonzero(pending[:k] >= LASTING):
            run = slice(t + 1 - int(pending[i]), t + 1)
            flag[i, run] = False
            level[i], p[i], pending[i] = np.median(v[i, run]), r[i], 0
    for i in np.flatnonzero(pending):  # the source never returned
        flag[i, int(length[i] - pending[i]) : int(length[i])] = False
    flag[length < 3] = False
    return flag


def flag_series(series: np.ndarray, value: np.ndarray, limit: float, threshold: float = THRESHOLD) -> np.ndarray:
    """Flags over concatenated series (``series`` ascending numbers, values without nulls)."""
    bad = ~np.isfinite(value) | (np.abs(value) > limit)
    bad |= stuck(value, series) & ~bad
    at = np.flatnonzero(~bad)
    if not len(at):
        return bad
    s, x = series[at], value[at]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    last = np.r_[first[1:], len(s)]
    lo, hi, mid_lo, mid_hi = [], [], [], []
    for a, b in zip(first, last):
        for c in range(a, b, CHUNK):
            e = min(b, c + CHUNK)
            if b - e < CONTEXT:
                e = b
            lo.append(max(a, c - CONTEXT)), hi.append(min(b, e + CONTEXT)), mid_lo.append(c), mid_hi.append(e)
            if e == b:
                break
    lo, hi, mid_lo, mid_hi = map(np.array, (lo, hi, mid_lo, mid_hi))
    order = np.argsort(lo - hi, kind="stable")
    lo, hi, mid_lo, mid_hi = lo[order], hi[order], mid_lo[order], mid_hi[order]
    for begin in range(0, len(lo), 512):
        a, b = lo[begin : begin + 512], hi[begin : begin + 512]
        length = b - a
        steps = int(length.max())
        pad = np.minimum(a[:, None] + np.arange(steps)[None], len(x) - 1)
        flags = kalman_flags(x[pad], length, threshold)
        for i in np.flatnonzero(flags.any(1)):
            where = a[i] + np.flatnonzero(flags[i])
            where = where[(where >= mid_lo[begin + i]) & (where < mid_hi[begin + i])]
            bad[at[where]] = True
    return bad


def flag_implausible(readings: DataFrame, source: str, order: tuple[str, str], limits: dict[str, float], threshold: float = THRESHOLD) -> DataFrame:
    """``(*order, field)`` of each implausible reading.

    ``limits`` gives each field's largest possible absolute value. Rows without source or order
    are no readings; nulls are skipped field by field; repeated rows count once. Time runs by
    ``order``. Readings more than ``PIECE_FRAMES`` apart in the first order column are judged apart.
    """
    a, b = order
    fields = list(limits)
    names = [f"f{i}" for i in range(len(fields))]
    base = (
        readings.select(F.col(source).alias("src"), F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b"), *(F.col(f).cast("double").alias(n) for f, n in zip(fields, names)))
        .filter(F.col("src").isNotNull() & F.col("a").isNotNull() & F.col("b").isNotNull())
        .withColumn(
            "piece",
            F.explode(
                F.sequence(
                    F.floor((F.col("a") - PIECE_CONTEXT) / PIECE_FRAMES),
                    F.floor((F.col("a") + PIECE_CONTEXT) / PIECE_FRAMES),
                )
            ),
        )
        .repartition("src", "piece")
        .dropDuplicates(["src", "piece", "a", "b", *names])
        .sortWithinPartitions("src", "piece", "a", "b", *names)
    )

    def judge(rows: pd.DataFrame, lo: int, hi: int) -> Iterator[pd.DataFrame]:
        """Flags of rows lo to hi; the others are context."""
        src, piece = rows["src"].to_numpy(), rows["piece"].to_numpy()
        number = np.cumsum(np.r_[True, (src[1:] != src[:-1]) | (piece[1:] != piece[:-1])])
        home = rows["a"].to_numpy() // PIECE_FRAMES == piece
        home[:lo] = home[hi:] = False
        for n, f in zip(names, fields):
            v = rows[n].to_numpy(float)
            at = np.flatnonzero(rows["h" + n].to_numpy(bool))
            hit = at[flag_series(number[at], v[at], limits[f], threshold)]
            hit = hit[home[hit]]
            if len(hit):
                yield pd.DataFrame({"a": rows["a"].to_numpy()[hit], "b": rows["b"].to_numpy()[hit], "field": f})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole pieces together; one of more than ``BLOCK_ROWS`` rows in blocks cut at fixed numbers of its rows."""
        held: list[pd.DataFrame] = []
        size, done, skip = 0, 0, 0  # of the piece at hand: rows judged, of them kept as context
        for b in batches:
            held.append(b)
            size += len(b)
            if size < BATCH_ROWS:
                continue
            rows = pd.concat(held, ignore_index=True)
            src, piece = rows["src"].to_numpy(), rows["piece"].to_numpy()
            begins = np.r_[0, np.flatnonzero((src[1:] != src[:-1]) | (piece[1:] != piece[:-1])) + 1]
            calm = 0  # whole small pieces up to here
            for k, start in enumerate(begins.tolist()):
                end = int(begins[k + 1]) if k + 1 < len(begins) else None
                own = (end if end is not None else len(rows)) - start
                if end is not None and not done and own <= BLOCK_ROWS + BLOCK_CONTEXT:
                    continue
                if start > calm:
                    yield from judge(rows.iloc[calm:start], 0, start - calm)
                part = rows.iloc[start : start + own]
                while len(part) - skip > BLOCK_ROWS + BLOCK_CONTEXT:
                    yield from judge(part.iloc[: skip + BLOCK_ROWS + BLOCK_CONTEXT], skip, skip + BLOCK_ROWS)
                    done += BLOCK_ROWS
                    part = part.iloc[skip + BLOCK_ROWS - BLOCK_CONTEXT :]
                    skip = BLOCK_CONTEXT
                if end is None:
                    held = [part]
                    calm = len(rows)
                else:
                    yield from judge(part, skip, len(part))
                    done, skip, calm = 0, 0, end
            size = sum(map(len, held))
        if size:
            rows = pd.concat(held, ignore_index=True)
            src, piece = rows["src"].to_numpy(), rows["piece"].to_numpy()
            other = np.flatnonzero((src != src[0]) | (piece != piece[0]))
            own = int(other[0]) if len(other) else len(rows)
            part = rows.iloc[:own]
            while len(part) - skip > BLOCK_ROWS + BLOCK_CONTEXT:
                yield from judge(part.iloc[: skip + BLOCK_ROWS + BLOCK_CONTEXT], skip, skip + BLOCK_ROWS)
                part = part.iloc[skip + BLOCK_ROWS - BLOCK_CONTEXT :]
                skip = BLOCK_CONTEXT
            yield from judge(part, skip, len(part))
            if own < len(rows):
                yield from judge(rows.iloc[own:], 0, len(rows) - own)

    present = base.withColumns({"h" + n: F.col(n).isNotNull() for n in names})
    return present.mapInPandas(walk, "a bigint, b bigint, field string").distinct().select(F.col("a").cast("int").alias(a), F.col("b").cast("int").alias(b), "field")


def track_anomalies(spatial: DataFrame, linked: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(frame, cidx, field)`` of implausible u_, v_ and expansion, a source being one iuid."""
    source = linked.filter(F.col("uid").isNotNull() & F.col("iuid").isNotNull()).select("frame", "cidx", F.col("iuid").alias("src")).distinct()
    joined = spatial.select("frame", "cidx", "u_", "v_", "expansion").join(source, ["frame", "cidx"])
    return flag_implausible(joined, "src", ("frame", "cidx"), {"u_": 360.0, "v_": 360.0, "expansion": 2e6 / 600}, threshold)
