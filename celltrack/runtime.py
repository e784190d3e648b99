"""Session helpers shared by every operator: table access and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs on this machine alone (tests) is a local temporary folder made, and it
    is then set for the whole session; a cluster must name one.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="celltrack-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: no lineage, no inherited constraints.

    A checkpoint keeps the constraints of the plan it cuts, which grow with every
    round of an iteration; a table has none, and its size is known to the optimizer. Tables are
    dropped by ``drop`` or when the application ends.
    """
    spark = df.sparkSession
    path = new_path(spark, "stage")
    df.write.parquet(path)
    _written[path] = spark
    back = spark.read.schema(df.schema).parquet(path)
    back._celltrack_path = path
    return back


def drop(df: DataFrame) -> None:
    """Delete the table behind a ``cut`` that nothing reads any more."""
    path = getattr(df, "_celltrack_path", None)
    if path in _written:
        _delete(path)


@contextmanager
def scratch() -> Iterator[Callable[..., None]]:
    """Tables cut inside are deleted at the end of the block, but for those of the DataFrames passed to what it gives.

        with scratch() as keep:
            out = cut(...)
            keep(out)
    """
    before, kept = set(_written), set()
    yield lambda *dfs: kept.update(getattr(df, "_celltrack_path", None) for df in dfs)
    for path in [p for p in _written if p not in before and p not in kept]:
        _delete(path)


def _delete(path: str) -> None:
    spark = _written.pop(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _drop_all() -> None:
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the application is gone already; the folder's owner cleans it
            return


def keep_until_end(spark: SparkSession, path: str) -> None:
    """Delete what lies at ``path`` when the application ends."""
    _written[path] = spark


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/celltrack-{label}-{uuid.uuid4().hex}"
