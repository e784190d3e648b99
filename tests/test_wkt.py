import numpy as np
import pytest

from celltrack.config import GridSpec
from celltrack.functions import outline, wkt

SQUARE = "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"


@pytest.mark.parametrize(
    "text, lon, lat",
    [
        (SQUARE, 1, 1),
        ("polygon  ((0 0,0 2,2 2,2 0))", 1, 1),  # other way round, not closed
        ("SRID=4326;POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))", 1, 1),
        ("POLYGON Z ((0 0 9, 2 0 9, 2 2 9, 0 2 9, 0 0 9))", 1, 1),
        ("MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((4 0, 6 0, 6 2, 4 2, 4 0)))", 3, 1),
        ("POLYGON ((0 0, 4 0, 4 2, 0 2, 0 0), (2 0, 4 0, 4 2, 2 2, 2 0))", 1, 1),  # hole on the right half
        ("POLYGON ((1e0 0, 3 0, 3 2.0E+0, 1 2, 1 0))", 2, 1),
        ("MULTIPOLYGON (((179 0, 180 0, 180 1, 179 1, 179 0)), ((-180 0, -179 0, -179 1, -180 1, -180 0)))", 180, 0.5),
    ],
)
def test_centroid(text, lon, lat):
    x, y = wkt.centroids(["junk", text, None])
    assert (x[1], y[1]) == pytest.approx((lon, lat))
    assert np.isnan(x[[0, 2]]).all()


def test_nothing_to_find():
    x, y = wkt.centroids([None, "", "POLYGON EMPTY", "POINT (1 2)", "POLYGON ((1 2, x y))", "POLYGON (("])
    assert np.isnan(x).all() and np.isnan(y).all()
    assert len(wkt.centroids([])[0]) == 0


def test_one_bad_row_spares_the_others():
    x, _ = wkt.centroids([SQUARE, "POLYGON ((0 0, 1-2 3, 4 4, 0 0))", SQUARE])
    assert list(x[[0, 2]]) == [1, 1] and np.isnan(x[1])


def test_inside_counts_holes_and_turns():
    r = wkt.rings(["POLYGON ((170 0, 190 0, 190 20, 170 20, 170 0), (178 8, 182 8, 182 12, 178 12, 178 8))"])
    lon, lat = np.array([-175.0, 175, 180, 0, 185]), np.array([5.0, 5, 10, 5, 25])
    assert wkt.inside(r, lon, lat).tolist() == [True, True, False, False, False]


def test_outline_round_trip():
    rng = np.random.default_rng(3)
    for _ in range(40):
        mask = rng.random((7, 8)) < 0.55
        y, x = np.nonzero(mask)
        if not len(y):
            continue
        text = outline.polygon_wkt(y, x, GridSpec(8, 7))
        r = wkt.rings([text])
        px, py = np.meshgrid(np.arange(8), np.arange(7))
        got = wkt.inside(r, px.ravel().astype(float), py.ravel().astype(float)).reshape(7, 8)
        assert (got == mask).all()
