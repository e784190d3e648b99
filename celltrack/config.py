"""Settings of a tracking run."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

OPERATORS = (">=", "<=", ">", "<", "==", "!=")
IGNORED = ("mean_dbz", "temp_folder", "epsg", "speed_units", "a_memory", "n_jobs", "num_prev_skip")


@dataclass(frozen=True)
class GridSpec:
    """Size of the grid and, for geographic grids, its bounds."""

    x_dim: int
    y_dim: int
    lon_min: float | None = None
    lon_max: float | None = None
    lat_min: float | None = None
    lat_max: float | None = None

    @property
    def geographic(self) -> bool:
        return None not in (self.lon_min, self.lon_max, self.lat_min, self.lat_max)

    @property
    def x_res(self) -> float:
        return abs(self.lon_min - self.lon_max) / self.x_dim if self.geographic else 1.0

    @property
    def y_res(self) -> float:
        return abs(self.lat_min - self.lat_max) / self.y_dim if self.geographic else 1.0

    @property
    def x0(self) -> float:
        return self.lon_min if self.geographic else -0.5

    @property
    def y0(self) -> float:
        return self.lat_min if self.geographic else -0.5


@dataclass(frozen=True)
class Level:
    level: int
    threshold: float
    min_size: int


@dataclass(frozen=True)
class TrackConfig:
    """``delta_time`` and ``delta_tolerance`` are minutes, ``min_overlap`` per cent of the earlier cluster.

    ``convex_hull`` compares frames by the pixels whose centres lie in the clusters' hulls instead of their own.
    ``opt_correction`` scores the optical-flow vector of ``opt_mtd`` beside the others; ``validation`` writes the vector of
    least far into u_ and v_ of the tracks. Both are off unless asked for.
    """

    grid: GridSpec
    levels: tuple[Level, ...]
    delta_time: int
    operator: str = ">="
    delta_tolerance: int = 0
    cluster_method: str = "ndimage"
    eps: float = 1.0
    min_overlap: float = 10.0
    convex_hull: bool = False
    edges: bool = False
    preserv_split: bool = False
    mrg_expansion: bool = False
    spl_expansion: bool = False
    mrg_agg: str = "sum"
    opt_correction: bool = False
    opt_mtd: str = "lucas-kanade"
    validation: bool = False
    initial_uid: int = 1
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.operator not in OPERATORS:
            raise ValueError(f"operator must be one of {OPERATORS}")
        if self.cluster_method not in ("ndimage", "dbscan"):
            raise ValueError("cluster_method must be ndimage or dbscan")
        if self.opt_mtd not in ("lucas-kanade", "farneback"):
            raise ValueError("opt_mtd must be lucas-kanade or farneback")
        for k in self.extra:
            if k in IGNORED:
                warnings.warn(f"{k} has no effect", stacklevel=2)
            else:
                raise ValueError(f"unknown setting {k}")

    @property
    def radius(self) -> int:
        return int(self.eps) if self.cluster_method == "dbscan" else 1

    @property
    def floor_size(self) -> int:
        return 3 if self.cluster_method == "dbscan" else 1
