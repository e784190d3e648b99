"""Spark-first engine for tracking objects in time series of 2-D fields."""

from celltrack.api import Tracker
from celltrack.config import GridSpec, Level, TrackConfig

__all__ = ["GridSpec", "Level", "TrackConfig", "Tracker"]
__version__ = "0.1.0"
