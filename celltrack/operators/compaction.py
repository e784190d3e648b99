"""Many small files into few of good size, each record exactly once.

A record's target partition follows from the record itself (its frame), so copies that lie
in different files meet in one partition. Only partitions with too many small files or with
copies are rewritten, each into as many files as its size asks for. A table keeps numbered snapshots: a snapshot lists
the live directories of every partition, and readers see only those. A rewrite goes to directories of its own by dynamic
partition overwrite and becomes visible by its last step alone, the exclusive create of the next snapshot; if another
writer took that number meanwhile, the rewrite is set upon the new snapshot or, where a partition it read has changed,
given up. A writer that is lost leaves files that no snapshot lists, which ``vacuum`` clears away.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from celltrack.runtime import cut, keep_until_end, new_path

TARGET_BYTES = 128 << 20
SMALL_BYTES = 32 << 20
MAX_SMALL_FILES = 8
FRAMES_A_PARTITION = 144


class Conflict(RuntimeError):
    """Another writer changed the table since its snapshot was read."""


def pixel_set(y: str = "array_y", x: str = "array_x", value: str = "array_values") -> Column:
    """The distinct pixels of a features record in a fixed order; null arrays are empty."""
    empty = lambda c, t: F.coalesce(F.col(c), F.array().cast(f"array<{t}>"))
    return F.array_sort(F.array_distinct(F.arrays_zip(empty(y, "int"), empty(x, "int"), empty(value, "double"))))


def content_columns(df: DataFrame, ignore: tuple[str, ...]) -> list[Column]:
    """Every column but ``ignore``, lists in a fixed order."""
    out = []
    for f in df.schema:
        if f.name not in ignore:
            out.append(F.array_sort(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`"))
    return out


def fingerprint(parts: list[Column]) -> tuple[Column, Column]:
    """128 bits over columns, nulls told from values by their place."""
    tagged = [x for p in parts for x in (p, p.isNull())]
    return F.xxhash64(F.lit(1), *tagged), F.xxhash64(F.lit("b"), *reversed(tagged))


def record_prints(stage: str, df: DataFrame) -> tuple[Column, Column]:
    """What makes two rows of a stage the same record."""
    if stage == "features":
        return fingerprint([F.col("frame"), F.col("cidx"), pixel_set()])
    return fingerprint(content_columns(df, ("file",)))


def record_copies(stage: str, df: DataFrame) -> DataFrame:
    """``(stage, part, frame, cidx, h1, h2, copies, files)``: one row for each record.

    Null frame or cidx compare equal to null. An empty table gives no rows.
    """
    h1, h2 = record_prints(stage, df)
    return (
        df.select("frame", "cidx", h1.alias("h1"), h2.alias("h2"), F.xxhash64("file").alias("f"))
        .groupBy("frame", "cidx", "h1", "h2")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("f").alias("f0"), F.max("f").alias("f1"))
        .select(F.lit(stage).alias("stage"), partition_of(F.col("frame")).alias("part"), "frame", "cidx", "h1", "h2", "copies", (F.col("f0") != F.col("f1")).alias("in_several_files"))
    )


def partition_of(frame: Column) -> Column:
    return F.coalesce(F.floor(frame / FRAMES_A_PARTITION), F.lit(-1)).cast("int")


def once(stage: str, df: DataFrame, copies: str | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """Each record exactly once: of its copies the one in the first file by name stays; ``copies`` names a column for how many there were.

    ``within`` names columns that follow from frame and cidx; rows already spread by them are not moved again.
    """
    h1, h2 = record_prints(stage, df)
    same = Window.partitionBy(*within, "frame", "cidx", "__h1", "__h2")
    ranked = df.withColumns({"__h1": h1, "__h2": h2}).withColumn("__k", F.row_number().over(same.orderBy(F.col("file").asc_nulls_last())))
    if copies:  # over the same order, so that one sort serves both
        whole = same.orderBy(F.col("file").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ranked = ranked.withColumn(copies, F.count(F.lit(1)).over(whole))
    return ranked.filter("__k = 1").drop("__h1", "__h2", "__k")


def small_file_plan(stored: DataFrame, target_bytes: int = TARGET_BYTES, small_bytes: int = SMALL_BYTES, max_small: int = MAX_SMALL_FILES) -> DataFrame:
    """Partitions of a file listing and what to do with them.

    ``(stage, day, n_files, small_files, n_rows, n_bytes, target_files, rewrite)``; the day comes
    from the eight digits in the file name, 'none' without them. Null sizes count as 0.
    """
    size = F.coalesce(F.col("n_bytes"), F.lit(0))
    day = F.regexp_extract(F.coalesce(F.col("file"), F.lit("")), r"(\d{8})_\d{6}", 1)
    return (
        stored.select("stage", F.when(day == "", F.lit("none")).otherwise(day).alias("day"), size.alias("b"), F.coalesce(F.col("n_rows"), F.lit(0)).alias("r"))
        .groupBy("stage", "day")
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            F.count(F.when(F.col("b") < small_bytes, 1)).alias("small_files"),
            F.sum("r").cast("bigint").alias("n_rows"),
            F.sum("b").cast("bigint").alias("n_bytes"),
        )
        .withColumn("target_files", F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / target_bytes)).cast("bigint"))
        .withColumn("rewrite", F.col("small_files") > max_small)
    )


@dataclass(frozen=True)
class Snapshot:
    """``live`` is the manifest's path: one row ``(part, ver)`` for each live directory; none before the first version."""

    version: int
    live: str | None
    note: dict


COPIES, VERSION = "__copies", "__ver"
MOST_BROADCAST = 1 << 20  # rows of a manifest that travel with the tasks


class StoredTable:
    """A table of ``data/<part>/<ver>`` directories, manifests in ``live`` and numbered snapshots in ``versions``.

    ``schema`` is that of the records, without the partition column, which follows from ``frame`` by ``partition_of``.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @property
    def data(self) -> str:
        return f"{self.path}/data"

    def _version_path(self, n: int):
        return self._Path(f"{self.path}/versions/{n:012d}.json")

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A version, by default the last; 0 for a table without any."""
        at = self._Path(f"{self.path}/versions")
        if version is None:
            there = self._fs.listStatus(at) if self._fs.exists(at) else []
            version = max((int(s.getPath().getName()[:12]) for s in there if s.getPath().getName()[:12].isdigit()), default=0)
        if not version:
            return Snapshot(0, None, {})
        note = json.loads("\n".join(r.value for r in self.spark.read.text(self._version_path(version).toString()).collect()))  # one short line
        return Snapshot(version, f"{self.path}/live/{note['live']}", note)

    def live(self, at: Snapshot | None = None) -> DataFrame:
        at = at or self.snapshot()
        schema = f"part int, {VERSION} string"
        return self.spark.read.schema(schema).parquet(at.live) if at.live else self.spark.createDataFrame([], schema)

    def claim(self, base: Snapshot, live: DataFrame, note: dict) -> Snapshot:
        """Publish ``live`` as the version after ``base``; Conflict if someone has that number already."""
        nxt, name = base.version + 1, uuid.uuid4().hex
        live.select("part", VERSION).coalesce(1).write.parquet(f"{self.path}/live/{name}")
        try:
            stream = self._fs.create(self._version_path(nxt), False)
        except Exception as e:  # FileAlreadyExistsException arrives wrapped
            if self._fs.exists(self._version_path(nxt)):
                raise Conflict(f"version {nxt} is taken") from e
            raise
        stream.write(bytearray(json.dumps(note | {"live": name}), "utf-8"))
        stream.close()
        return Snapshot(nxt, f"{self.path}/live/{name}", note | {"live": name})

    def _stored(self) -> DataFrame:
        full = T.StructType([*self.schema, T.StructField(COPIES, T.LongType()), T.StructField("part", T.IntegerType()), T.StructField(VERSION, T.StringType())])
        if not self._fs.exists(self._Path(self.data)):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(self.data)

    def _only(self, listed: DataFrame) -> DataFrame:
        """The stored rows of the directories that ``listed(part, __ver, ...)`` names; other directories are not read."""
        few = listed.count() <= MOST_BROADCAST
        return self._stored().join(F.broadcast(listed) if few else listed, ["part", VERSION])

    def read(self, at: Snapshot | None = None) -> DataFrame:
        """The records of a snapshot, with their partition in ``part``."""
        return self._only(self.live(at)).drop(VERSION, COPIES)

    def merged(self) -> DataFrame:
        """``(frame, cidx, copies)`` of the records whose copies the rewrites of the live directories merged."""
        return self._only(self.live()).filter(F.col(COPIES) > 1).select("frame", "cidx", F.col(COPIES).alias("copies"))

    def files(self, at: Snapshot | None = None) -> DataFrame:
        """``(part, __ver, file_path, file_size)`` of every live data file, from the listing alone."""
        schema = f"part int, {VERSION} string, file_path string, file_size bigint"
        if not self._fs.exists(self._Path(self.data)):
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(self.data).select(F.col("path").alias("file_path"), F.col("length").alias("file_size"))
        at_dir = lambda name: F.regexp_extract("file_path", rf"/{name}=([^/]+)/", 1)
        listed = found.select(at_dir("part").cast("int").alias("part"), at_dir(VERSION).alias(VERSION), "file_path", "file_size")
        return listed.join(self.live(at), ["part", VERSION], "left_semi")

    def write(self, rows: DataFrame, ver: str) -> None:
        """Rows with ``part`` into directories of version ``ver``; overwriting is dynamic, so a repeated attempt replaces only its own."""
        out = rows if COPIES in rows.columns else rows.withColumn(COPIES, F.lit(None).cast("bigint"))
        out.withColumn(VERSION, F.lit(ver)).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("part", VERSION).parquet(self.data)

    def written(self, ver: str) -> DataFrame:
        """The directories of version ``ver``."""
        if not self._fs.exists(self._Path(self.data)):
            return self.live(Snapshot(0, None, {}))
        return self._stored().filter(F.col(VERSION) == ver).select("part", VERSION).distinct()

    def append(self, df: DataFrame, tries: int = 20) -> Snapshot:
        """Add records as they come; takes the next free version."""
        ver = uuid.uuid4().hex
        self.write(df.select(*self.schema.names).withColumn("part", partition_of(F.col("frame"))), ver)
        new = cut(self.written(ver))
        for _ in range(tries):
            base = self.snapshot()
            try:
                return self.claim(base, self.live(base).unionByName(new), {"op": "append", "ver": ver})
            except Conflict:
                continue
        raise Conflict(f"no version was free in {tries} tries")

    def vacuum(self, keep: int = 2) -> int:
        """Delete data directories that none of the last ``keep`` snapshots lists; how many there were. No writer may be at work."""
        last = self.snapshot().version
        wanted = self.live()
        for n in range(max(1, last - keep + 1), last):
            wanted = wanted.unionByName(self.live(self.snapshot(n)))
        there = self._stored().select("part", VERSION).distinct()
        gone = 0
        for r in there.join(wanted, ["part", VERSION], "left_anti").toLocalIterator():
            self._fs.delete(self._Path(f"{self.data}/part={r['part']}/{VERSION}={r[VERSION]}"), True)
            gone += 1
        return gone


def compact(table: StoredTable, stage: str, max_small: int = MAX_SMALL_FILES, small_bytes: int = SMALL_BYTES, target_bytes: int = TARGET_BYTES, before_publish=None) -> DataFrame:
    """Rewrite the partitions of ``table`` that hold more than ``max_small`` small files or any record twice.

    Gives ``(part, files_before, files_after, version)``. Other partitions are not touched. Each partition is written in
    the number of files that its bytes need at ``target_bytes`` each. Raises Conflict, leaving the table as it was, if
    another writer changed a chosen partition meanwhile; changes of others are kept. ``before_publish`` is a hook for tests.
    """
    spark, base = table.spark, table.snapshot()
    empty = "part int, files_before bigint, files_after bigint, version bigint"
    state = cut(table.files(base).groupBy("part").agg(
        F.count(F.lit(1)).alias("files_before"), F.count(F.when(F.col("file_size") < small_bytes, 1)).alias("small"), F.sum("file_size").alias("bytes"),
    ))
    live = table.live(base)
    crowded = state.filter(F.col("small") > max_small).select("part")
    quiet = live.join(crowded, "part", "left_anti")
    if not quiet.isEmpty():  # copies in the others
        rest = table._only(quiet).drop(VERSION, COPIES)
        h1, h2 = record_prints(stage, rest)
        twice = rest.select("part", "frame", "cidx", h1.alias("h1"), h2.alias("h2")).groupBy("part", "frame", "cidx", "h1", "h2").count().filter("count > 1")
        crowded = crowded.unionByName(twice.select("part")).distinct()
    need = F.greatest(F.lit(1), F.ceil(F.col("bytes") / target_bytes)).cast("int")
    first = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    plan = cut(state.join(crowded, "part", "left_semi").withColumn("n", need).withColumn("first", first))  # one row for each partition
    tasks = plan.agg(F.sum("n")).first()[0]
    if not tasks:
        return spark.createDataFrame([], empty)
    listed = live.join(plan.select("part", "n", "first"), "part")
    slot = F.col("first") + F.pmod(F.xxhash64("frame", "cidx"), F.col("n")).cast("int")
    spread = table._only(listed).withColumn("__slot", slot).drop(VERSION, COPIES, "n", "first").repartitionById(int(tasks), F.col("__slot"))
    ver = uuid.uuid4().hex
    table.write(once(stage, spread, COPIES, ("part", "__slot")).drop("__slot"), ver)  # sorted by part already
    if before_publish:
        before_publish()
    new, now = cut(table.written(ver)), base
    read = cut(live.join(plan, "part", "left_semi"))
    while True:
        current = table.live(now)
        if now != base:
            there = current.join(plan, "part", "left_semi")
            if not there.exceptAll(read).isEmpty() or not read.exceptAll(there).isEmpty():
                raise Conflict("a partition changed while it was compacted")
        try:
            done = table.claim(now, current.join(plan, "part", "left_anti").unionByName(new), {"op": "compact", "base": base.version, "ver": ver})
            break
        except Conflict:
            now = table.snapshot()
    after = table.files(done).groupBy("part").agg(F.count(F.lit(1)).alias("files_after"))
    return plan.select("part", "files_before").join(after, "part").select("part", "files_before", "files_after", F.lit(done.version).cast("bigint").alias("version"))


def stored_twice(features: DataFrame, linked: DataFrame) -> DataFrame:
    """``(stage, frame, cidx)`` of each record stored more than once, by counting; for comparison."""
    both = record_copies("features", features).unionByName(record_copies("linked", linked))
    return both.filter(F.col("copies") > 1).select("stage", "frame", "cidx").distinct()


def consolidate(stage: str, df: DataFrame) -> tuple[StoredTable, DataFrame]:
    """The stage as a table of small files in the shared folder, compacted, and what ``compact`` reports of it."""
    spark, path = df.sparkSession, new_path(df.sparkSession, stage)
    keep_until_end(spark, path)
    table = StoredTable(spark, path, df.schema)
    table.append(df)
    return table, compact(table, stage)


def consolidation(features: DataFrame, linked: DataFrame) -> DataFrame:
    """``(stage, part, files_before, files_after, version)`` of each partition that consolidation rewrote."""
    done = [consolidate(s, df)[1].select(F.lit(s).alias("stage"), "part", "files_before", "files_after", "version") for s, df in (("features", features), ("linked", linked))]
    return done[0].unionByName(done[1])


def merged_records(features: DataFrame, linked: DataFrame) -> DataFrame:
    """``(stage, frame, cidx)`` of each record whose copies consolidation merged."""
    merged = [consolidate(s, df)[0].merged().select(F.lit(s).alias("stage"), "frame", "cidx") for s, df in (("features", features), ("linked", linked))]
    return merged[0].unionByName(merged[1]).distinct()


def consolidated(features: DataFrame, linked: DataFrame) -> DataFrame:
    """``(stage, frame, cidx, records)``: how many records each cluster has in the consolidated tables."""
    kept = [consolidate(s, df)[0].read().groupBy("frame", "cidx").agg(F.count(F.lit(1)).alias("records")).select(F.lit(s).alias("stage"), "frame", "cidx", "records") for s, df in (("features", features), ("linked", linked))]
    return kept[0].unionByName(kept[1])
