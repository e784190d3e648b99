"""Well-known text in bulk: a whole Arrow batch is scanned as one byte array.

The scanner finds rings by their brackets and coordinates by the commas between
them, so extra spaces, lower case, SRID prefixes, Z/M ordinates and missing
closing vertices all read alike. Rings whose opening bracket follows another
opening bracket are shells, the others are holes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

OPEN, CLOSE, COMMA, NEWLINE = 40, 41, 44, 10

_NUMERIC = np.zeros(256, bool)
_NUMERIC[[ord(c) for c in "0123456789.+-"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[[ord(c) for c in "0123456789."]] = True


@dataclass
class Rings:
    """Rings of many geometries, laid end to end."""

    row: np.ndarray  # the geometry each ring belongs to
    shell: np.ndarray  # False for holes
    start: np.ndarray  # first vertex of each ring
    length: np.ndarray
    x: np.ndarray
    y: np.ndarray


def _body(text) -> str:
    if not isinstance(text, str):
        return ""
    at = text.find("(")
    return text[at:].replace("\n", " ") if at >= 0 and "POLYGON" in text[:at].upper() else ""


def rings(texts) -> Rings:
    """Parse an iterable of WKT polygons; null, empty and unreadable ones have no rings, nor have rings of fewer than three points."""
    return _scan([_body(t) for t in texts])


def _scan(bodies: list[str]) -> Rings:
    raw = np.frombuffer("\n".join(bodies).encode("ascii", "replace"), np.uint8)
    none = Rings(*(np.zeros(0, t) for t in (int, bool, int, int, float, float)))
    if not len(raw):
        return none
    numeric = _NUMERIC[raw].copy()
    e = np.flatnonzero(((raw | 32) == 101) & np.r_[False, _DIGIT[raw[:-1]]])
    numeric[e] = True
    begins = numeric & ~np.r_[False, numeric[:-1]]
    event = np.flatnonzero(begins | (raw == OPEN) | (raw == CLOSE) | (raw == COMMA))
    what = raw[event]
    is_num = begins[event]
    if not is_num.any():
        return none
    try:
        values = np.fromstring(np.where(numeric, raw, 32).astype(np.uint8).tobytes(), sep=" ")
    except ValueError:  # something like 1-2 among the numbers
        values = np.zeros(0)
    if len(values) != int(is_num.sum()):
        # one unreadable number spoils the bulk scan: drop that row, keep the others
        good = [b if _readable(b) else "" for b in bodies]
        return _scan(good) if good != bodies else none
    number_at = np.cumsum(is_num) - 1
    before_num = np.r_[False, is_num[:-1]]
    xs = np.flatnonzero(is_num & ~before_num)
    has_y = (xs + 1 < len(event)) & is_num[np.minimum(xs + 1, len(event) - 1)]
    xs = xs[has_y]
    following = np.r_[is_num[1:], False]
    opens = np.flatnonzero((what == OPEN) & ~is_num & following)
    bracket = np.flatnonzero(~is_num & ((what == OPEN) | (what == CLOSE)))
    rank = np.searchsorted(bracket, opens)
    shell = (rank > 0) & (what[bracket[np.maximum(rank - 1, 0)]] == OPEN)
    ring_of = np.searchsorted(opens, xs, "right") - 1
    keep = ring_of >= 0
    xs, ring_of = xs[keep], ring_of[keep]
    if not len(xs):
        return none
    used, start, length = np.unique(ring_of, return_index=True, return_counts=True)
    enough = length >= 3
    xs = xs[np.repeat(enough, length)]
    used, length = used[enough], length[enough]
    if not len(used):
        return none
    start = np.cumsum(length) - length
    breaks = np.flatnonzero(raw == NEWLINE)
    row = np.searchsorted(breaks, event[opens[used]])
    return Rings(row, shell[used], start, length, values[number_at[xs]], values[number_at[xs] + 1])


def _readable(body: str) -> bool:
    for piece in body.replace("(", " ").replace(")", " ").replace(",", " ").split():
        if piece.upper() != "EMPTY":
            try:
                float(piece)
            except ValueError:
                return False
    return True


def unwrap(r: Rings) -> np.ndarray:
    """x with every vertex moved by whole turns next to the first vertex of its geometry."""
    if not len(r.x):
        return r.x
    first_of_row = np.r_[True, r.row[1:] != r.row[:-1]]
    anchor = r.x[r.start][np.maximum.accumulate(np.where(first_of_row, np.arange(len(r.row)), 0))]
    anchor = np.repeat(anchor, r.length)
    return r.x - 360.0 * np.round((r.x - anchor) / 360.0)


def centroids(texts, n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Area centroid of each geometry in the lon/lat plane; NaN where there is none.

    Holes count negatively whatever their orientation. A geometry without area has
    the mean of its vertices.
    """
    texts = list(texts)
    n = len(texts) if n is None else n
    lon, lat = np.full(n, np.nan), np.full(n, np.nan)
    r = rings(texts)
    if not len(r.row):
        return lon, lat
    x = unwrap(r)
    first_of_row = np.r_[True, r.row[1:] != r.row[:-1]]
    lead = np.maximum.accumulate(np.where(first_of_row, np.arange(len(r.row)), 0))
    ox, oy = x[r.start][lead], r.y[r.start][lead]
    px, py = x - np.repeat(ox, r.length), r.y - np.repeat(oy, r.length)
    nxt = np.arange(1, len(px) + 1)
    nxt[r.start + r.length - 1] = r.start
    cross = px * py[nxt] - px[nxt] * py
    area = np.add.reduceat(cross, r.start) / 2
    sx = np.add.reduceat((px + px[nxt]) * cross, r.start) / 6
    sy = np.add.reduceat((py + py[nxt]) * cross, r.start) / 6
    sign = np.where(area < 0, -1.0, 1.0) * np.where(r.shell, 1.0, -1.0)
    total = np.bincount(r.row, area * sign, n)
    gx, gy = np.bincount(r.row, sx * sign, n), np.bincount(r.row, sy * sign, n)
    ref_x, ref_y = np.zeros(n), np.zeros(n)
    ref_x[r.row], ref_y[r.row] = ox, oy
    count = np.bincount(r.row, r.length, n)
    mx = np.bincount(np.repeat(r.row, r.length), px, n)
    my = np.bincount(np.repeat(r.row, r.length), py, n)
    some, flat = count > 0, np.abs(total) < 1e-12
    with np.errstate(all="ignore"):
        lon[some] = (ref_x + np.where(flat, mx / count, gx / np.where(flat, 1, total)))[some]
        lat[some] = (ref_y + np.where(flat, my / count, gy / np.where(flat, 1, total)))[some]
    return lon, lat


def inside(r: Rings, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Even-odd test of points against all rings of one geometry, longitudes modulo 360."""
    hit = np.zeros(len(lon), bool)
    for s, k in zip(r.start, r.length):
        x, y = r.x[s : s + k], r.y[s : s + k]
        low = x.min()
        turned = low + np.mod(lon - low, 360.0)
        near = np.flatnonzero((turned <= x.max()) & (lat >= y.min()) & (lat <= y.max()))
        if not len(near):
            continue
        px, py = turned[near], lat[near]
        odd = np.zeros(len(near), bool)
        for x0, y0, x1, y1 in zip(x, y, np.roll(x, -1), np.roll(y, -1)):
            if y0 != y1:
                odd ^= ((y0 > py) != (y1 > py)) & (px < (x1 - x0) * (py - y0) / (y1 - y0) + x0)
        hit[near] ^= odd
    return hit


def measures(texts) -> dict[str, np.ndarray]:
    """Area, length of all rings and bounds of each geometry; NaN where there is none. Holes count negatively."""
    texts = list(texts)
    n, r = len(texts), rings(texts)
    names = ("area", "perimeter", "x0", "x1", "y0", "y1")
    out = {k: np.full(n, np.nan) for k in names}
    if not len(r.row):
        return out
    nxt = np.arange(1, len(r.x) + 1)
    nxt[r.start + r.length - 1] = r.start
    area = np.abs(np.add.reduceat(r.x * r.y[nxt] - r.x[nxt] * r.y, r.start) / 2) * np.where(r.shell, 1, -1)
    side = np.add.reduceat(np.hypot(r.x[nxt] - r.x, r.y[nxt] - r.y), r.start)
    some = np.bincount(r.row, minlength=n) > 0
    out["area"][some], out["perimeter"][some] = np.bincount(r.row, area, n)[some], np.bincount(r.row, side, n)[some]
    rows, first = np.unique(np.repeat(r.row, r.length), return_index=True)
    for k, f, v in (("x0", np.minimum, r.x), ("x1", np.maximum, r.x), ("y0", np.minimum, r.y), ("y1", np.maximum, r.y)):
        out[k][rows] = f.reduceat(v, first)
    return out
