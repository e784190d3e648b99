import io

import numpy as np
from pyspark.sql import functions as F

from celltrack.operators import imaging
from celltrack.sources import frames as S

PATTERNS = ((r"(\d{8}_\d{6})", "yyyyMMdd_HHmmss"), (r"(\d{4}/\d{2}/\d{2}/\d{6})", "yyyyMMddHHmmss"))


def test_files_with_a_bad_one(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    np.save(tmp_path / "sub" / "a_20200101_001000.npy", np.array([[1.0, np.nan], [3.0, 4.0]]))
    (tmp_path / "b_20200101_002000.npy").write_bytes(b"junk")
    got = S.read_frames(spark, str(tmp_path), lambda b: np.load(io.BytesIO(b)), PATTERNS).collect()
    assert {(r.y, r.x, r.value) for r in got if not r.failed} == {(0, 0, 1.0), (1, 0, 3.0), (1, 1, 4.0)}
    assert [(r.ts.minute, r.y) for r in got if r.failed] == [(20, None)]


def test_file_times(spark):
    df = spark.createDataFrame([("x_20120101_235959.nc",), ("s/2012/01/02/000001.nc",), ("none.nc",), (None,), ("x_20129999_000000",)], "f string")
    got = [r[0] for r in df.select(F.date_format(S.file_timestamp(F.col("f"), PATTERNS), "yyyyMMdd HHmmss")).collect()]
    assert got == ["20120101 235959", "20120102 000001", None, None, None]


def moving(dx, dy):
    y, x = np.mgrid[:48, :48]
    at = lambda cx, cy: 200 * np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / 60)
    return at(22, 22), at(22 + dx, 22 + dy)


def test_flows_follow_a_blob():
    before, after = moving(1.5, -1.0)
    core = before > 60
    u, v, _ = imaging.lucas_kanade(before, after)
    assert abs(u[core].mean() - 1.5) < 0.3 and abs(v[core].mean() + 1.0) < 0.3
    u, v = imaging.polynomial_flow(before, after)
    assert abs(u[core].mean() - 1.5) < 0.4 and abs(v[core].mean() + 1.0) < 0.4


def test_canny_draws_a_frame(spark):
    cells = spark.createDataFrame([(0, y, x, 100.0 if 4 <= y <= 9 and 4 <= x <= 9 else 0.0) for y in range(14) for x in range(14)], "frame int, y int, x int, value double")
    on = {(r.y, r.x) for r in imaging.canny(cells, 10, 30).filter("value > 0").collect()}
    assert on and all(not (6 <= y <= 7 and 6 <= x <= 7) for y, x in on) and (0, 0) not in on
