"""Irregular readings onto a regular grid, gaps filled by iterated singular spectra.

Readings are averaged per source and slot (partial aggregation before the shuffle, so
a source holding a third of all rows shrinks to at most one row per slot), sorted
by source and slot, and streamed. A long source is handled in stretches between fixed multiples of
``STRETCH`` slots with ``CONTEXT`` slots on both sides, so neither memory nor one group grows with the data, and the result does
not depend on how rows arrive.

Filling: each stretch with empty slots is embedded as a Hankel trajectory matrix, its
leading singular vectors are kept (through the small lag covariance), the diagonals are averaged,
empty entries are replaced, and this is repeated until they settle or ``ROUNDS`` are over, which is told. Stretches of like
window and length class are solved together as stacked matrices, each on its own numbers alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOT_SECONDS = 600
WINDOW = 12
ENERGY = 0.95
ROUNDS = 30
TOLERANCE = 1e-3
STRETCH = 2048
LONGEST_FILL = 288
CONTEXT = LONGEST_FILL + 4 * WINDOW
STACK = 1 << 19  # entries of trajectory matrices at once


def slot_of(ts: Column, seconds: int = SLOT_SECONDS) -> Column:
    """Epoch second of the slot nearest to a timestamp, halves going up."""
    return F.floor((F.unix_seconds(ts) + seconds // 2) / seconds) * seconds


def ssa_fill(series: list[np.ndarray], window: int = WINDOW) -> tuple[list[np.ndarray], np.ndarray]:
    """Fill the NaN entries of each series, and whether each has settled; a series without any value stays NaN.

    Series of fewer than four entries or three values have no spectrum and are filled along straight lines.
    """
    out: list[np.ndarray] = [s.astype(float).copy() for s in series]
    settled = np.ones(len(series), bool)
    todo: dict[tuple[int, int], list[int]] = {}
    for i, s in enumerate(out):
        hole = np.isnan(s)
        if not hole.any() or hole.all():
            continue
        known = np.flatnonzero(~hole)
        if len(s) < 4 or len(known) < 3:
            out[i] = np.interp(np.arange(len(s)), known, s[known])
            continue
        todo.setdefault((min(window, len(s) // 2), 1 << max(4, int(len(s) - 1).bit_length())), []).append(i)
    for (size, length), members in todo.items():
        take = max(1, STACK // (length * size))
        for at in range(0, len(members), take):
            part = members[at : at + take]
            filled, ok = _solve([out[i] for i in part], size, length)
            settled[part] = ok
            for i, f in zip(part, filled):
                out[i] = f
    return out, settled


def _solve(series: list[np.ndarray], size: int, longest: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Series padded to ``longest``, whatever the others are, so that each is reckoned alike in any company."""
    lengths = np.array([len(s) for s in series])
    x = np.zeros((len(series), longest))
    hole = np.zeros(x.shape, bool)
    for k, s in enumerate(series):
        nan = np.isnan(s)
        known = np.flatnonzero(~nan)
        x[k, : len(s)] = np.interp(np.arange(len(s)), known, s[known])
        hole[k, : len(s)] = nan
    valid = np.arange(longest)[None] < lengths[:, None]
    mean = (x * valid).sum(1) / lengths
    scale = np.sqrt((((x - mean[:, None]) * valid) ** 2).sum(1) / lengths)
    scale[scale == 0] = 1
    z = np.where(valid, (x - mean[:, None]) / scale[:, None], 0.0)
    columns = longest - size + 1
    column_ok = np.arange(columns)[None] <= (lengths - size)[:, None]
    cover = np.zeros_like(z)
    for j in range(size):
        cover[:, j : j + columns] += column_ok
    live = np.arange(len(series))
    for _ in range(ROUNDS):
        part = z[live]
        hankel = np.lib.stride_tricks.sliding_window_view(part, size, axis=1) * column_ok[live][:, :, None]
        value, vector = np.linalg.eigh(np.matmul(hankel.transpose(0, 2, 1), hankel))
        share = np.cumsum(value[:, ::-1], 1)
        rank = 1 + (share < ENERGY * np.maximum(share[:, -1:], 1e-12)).sum(1)
        rank = np.minimum(rank, max(1, size // 2))
        vector = vector[:, :, ::-1] * (np.arange(size)[None, None] < rank[:, None, None])
        low = np.matmul(np.matmul(hankel, vector), vector.transpose(0, 2, 1))
        total = np.zeros_like(part)
        for j in range(size):
            total[:, j : j + columns] += low[:, :, j]
        new = np.where(hole[live], total / np.maximum(cover[live], 1), part)
        moved = np.abs(new - part).max(1)
        z[live] = new
        live = live[moved > TOLERANCE]
        if not len(live):
            break
    back = z * scale[:, None] + mean[:, None]
    ok = np.ones(len(series), bool)
    ok[live] = False
    return [np.where(np.isnan(s), back[k, : len(s)], s) for k, s in enumerate(series)], ok


def regular_grid(df: DataFrame, source: str, ts: str, values: tuple[str, ...], seconds: int = SLOT_SECONDS) -> DataFrame:
    """``(uid-like source, slot_epoch, filled, readings, *values, settled)``: one row for every slot.

    Slots run from the first to the last reading of each source. ``filled`` marks slots without
    a reading; their values come from the singular spectrum of the stretch around them, or stay
    null where a gap is longer than ``LONGEST_FILL`` slots. ``settled`` is false where a value was still moving after
    ``ROUNDS``. Readings without source or timestamp do not count; null, NaN and infinite values count as missing values
    of a slot that is not empty and stay null. Several readings of a slot are averaged. Other columns are ignored.
    """
    finite = {v: F.when(~F.isnan(F.col(v).cast("double")) & (F.abs(F.col(v).cast("double")) != float("inf")), F.col(v).cast("double")) for v in values}
    slots = (
        df.filter(F.col(source).isNotNull() & F.col(ts).isNotNull())
        .select(F.col(source).cast("bigint").alias("src"), slot_of(F.col(ts), seconds).alias("slot"), *(c.alias(f"v{i}") for i, c in enumerate(finite.values())))
        .groupBy("src", "slot")
        .agg(F.count(F.lit(1)).alias("n"), *(F.avg(f"v{i}").alias(f"v{i}") for i in range(len(values))))
        .repartition("src")
        .sortWithinPartitions("src", "slot")
    )
    names = [f"v{i}" for i in range(len(values))]

    def frame(src, slot, filled, n, v, settled) -> pd.DataFrame:
        return pd.DataFrame({"src": src, "slot": slot, "filled": filled, "n": n, **{c: v[i] for i, c in enumerate(names)}, "settled": settled})

    def gaps(src: np.ndarray, slot: np.ndarray, seen: int) -> Iterator[pd.DataFrame]:
        """Gaps too long to fill that end after row ``seen``: marked only."""
        for b in np.flatnonzero((src[1:] == src[:-1]) & (slot[1:] - slot[:-1] > LONGEST_FILL)) + 1:
            if b > seen:
                for at in range(slot[b - 1] + 1, slot[b], 1 << 17):
                    run = np.arange(at, min(slot[b], at + (1 << 17)))
                    yield frame(src[b], run * seconds, True, 0, np.full((len(names), len(run)), np.nan), True)

    def stretches(rows: pd.DataFrame, least: int, most: int | None) -> Iterator[pd.DataFrame]:
        """Grid of ``rows``; of the last source only the stretches from number ``least`` to before ``most``."""
        src, slot = rows["src"].to_numpy(), rows["slot"].to_numpy() // seconds
        value = rows[names].to_numpy(float).T if names else np.zeros((0, len(rows)))
        first = np.flatnonzero(np.r_[True, (src[1:] != src[:-1]) | (slot[1:] - slot[:-1] > LONGEST_FILL)])
        last = np.r_[first[1:], len(rows)] - 1
        k0, k1 = slot[first] // STRETCH, slot[last] // STRETCH
        pieces = k1 - k0 + 1
        run = np.repeat(np.arange(len(first)), pieces)
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces) + k0[run]
        here = (src[first[run]] != src[-1]) | ((k >= least) & (k < (most if most is not None else k.max(initial=0) + 1)))
        run, k = run[here], k[here]
        if not len(run):
            return
        low = int(slot.min()) - CONTEXT - 1
        wide = np.int64(int(slot.max()) - low + 2 * (STRETCH + CONTEXT))
        line = np.repeat(np.arange(len(first)), last - first + 1) * wide + (slot - low)
        at_line = lambda s: run * wide + np.clip(s - low, 0, wide - 1)
        a, b = np.searchsorted(line, at_line(k * STRETCH - CONTEXT)), np.searchsorted(line, at_line((k + 1) * STRETCH + CONTEXT))
        start, stop = slot[a], slot[b - 1]
        length = stop - start + 1
        origin = np.r_[0, np.cumsum(length)]
        size = int(origin[-1])
        take = b - a
        row = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take) + np.repeat(a, take)
        unit = np.repeat(np.arange(len(run)), take)
        place = origin[unit] + slot[row] - start[unit]
        grid = np.full((len(names), size), np.nan)
        grid[:, place] = value[:, row]
        count = np.zeros(size, np.int64)
        count[place] = rows["n"].to_numpy()[row]
        of = np.repeat(np.arange(len(run)), length)
        when = np.arange(size) - origin[of] + start[of]
        home = when // STRETCH == k[of]
        empty = count == 0
        settled = np.ones(size, bool)
        todo = np.unique(of[home & empty])
        jobs = [(c, u) for u in todo.tolist() for c in range(len(names))]
        done, ok = ssa_fill([grid[c, origin[u] : origin[u + 1]] for c, u in jobs])
        for (c, u), filled, good in zip(jobs, done, ok):
            at = slice(origin[u], origin[u + 1])
            grid[c, at] = np.where(empty[at], filled, grid[c, at])
            settled[at] &= good | ~empty[at]
        yield frame(src[first[run]][of][home], when[home] * seconds, empty[home], count[home], grid[:, home], settled[home])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, seen, least = None, 0, -(1 << 40)
        for b in batches:
            rows = b if held is None else pd.concat([held, b], ignore_index=True)
            if not len(rows):
                continue
            src, slot = rows["src"].to_numpy(), rows["slot"].to_numpy() // seconds
            yield from gaps(src, slot, seen)
            tail = int(np.flatnonzero(src != src[-1])[-1]) + 1 if src[0] != src[-1] else 0  # where the last source begins
            if tail:
                # the source that was open is complete now; its first stretches came out before
                own = int(np.searchsorted(src != src[0], True))
                yield from stretches(rows.iloc[:own].reset_index(drop=True), least, None)
                if own < tail:
                    yield from stretches(rows.iloc[own:tail].reset_index(drop=True), -(1 << 40), None)
                least = -(1 << 40)
            held = rows.iloc[tail:].reset_index(drop=True)
            at = slot[tail:]
            most = int((at[-1] - CONTEXT) // STRETCH)  # stretches whose context has all come
            if most > max(least, int(at[0] // STRETCH)):
                yield from stretches(held, least, most)
                least = most
                held = held.iloc[min(len(at) - 1, int(np.searchsorted(at, most * STRETCH - CONTEXT - LONGEST_FILL))) :].reset_index(drop=True)
            seen = len(held) - 1
        if held is not None and len(held):
            yield from stretches(held, least, None)

    schema = "src bigint, slot bigint, filled boolean, n bigint" + "".join(f", {c} double" for c in names) + ", settled boolean"
    out = slots.mapInPandas(walk, schema)
    return out.select(
        F.col("src").alias(source), F.col("slot").alias("slot_epoch"), "filled", F.col("n").alias("readings"),
        *(F.when(~F.isnan(c), F.col(c)).alias(v) for c, v in zip(names, values)), "settled",
    )
