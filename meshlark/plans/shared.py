"""Lineage cuts in the shared folder, and guards against plans that grow with the square of their input."""

from __future__ import annotations

import tempfile
import uuid
import warnings
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_ALL_PAIRS_VERTICES = 5_000
ADVISORY_BYTES = 512 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
HOT_KEYS = 4096
_LOCAL: dict[str, str] = {}
_PATHS: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset and the session is local."""
    if (found := spark.conf.get("spark.checkpoint.dir", None)) is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="meshlark-"))
    return found.rstrip("/")


def materialize(df: DataFrame, what: str, tidy: bool = False, by: str | None = None, batch: int = BATCH_ROWS) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage. ``tidy``: the plan's shuffle files go as soon as it is written. ``by``: a folder for each value of this
    column, so a filter on it reads no others. ``batch``: rows that a Python worker is handed at once at most, fewer where a row is a block. ``discard`` deletes the table."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/meshlark/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    with held(spark, tidy, batch):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    _PATHS[id(out)] = path
    weakref.finalize(out, _PATHS.pop, id(out), None)
    return out


@contextmanager
def held(spark: SparkSession, tidy: bool = True, batch: int = BATCH_ROWS) -> Iterator[None]:
    """While a table is written: batches for Python workers are small, so neither side holds many long texts, and with ``tidy`` shuffle files go with the plan."""
    want = {BATCH: str(min(batch, int(spark.conf.get(BATCH, "10000"))))} | ({CLEANUP: "true"} if tidy else {})  # Spark before 4.1 does not know the last one, and ignores it
    before = {k: spark.conf.get(k, None) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def discard(*tables: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote for these tables; nothing that is still to run may read them."""
    for df in tables:
        if df is not None and (path := _PATHS.get(id(df))) is not None:
            spark = df.sparkSession
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


class Rounds:
    """Rows that rounds add to one folder of the shared store: ``all`` reads them in one scan, however many rounds there were."""

    def __init__(self, first: DataFrame, what: str):
        self.spark, self.schema, self.n = first.sparkSession, first.schema, 0
        self.path = f"{shared_dir(self.spark)}/meshlark/{self.spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
        self.last = self.add(first)

    def add(self, rows: DataFrame) -> DataFrame:
        """Write a round's rows and read them again."""
        rows.select(*self.schema.names).write.parquet(at := f"{self.path}/round={self.n}")
        self.n += 1
        self.last = self.spark.read.schema(self.schema).parquet(at)
        return self.last

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)


def average_ranks(df: DataFrame, c: str) -> DataFrame:
    """c, rank: the average rank (from 1, ties share theirs) of each distinct value. Values are sorted in ranges; only the ranges' sizes, one row each, meet."""
    x = materialize(df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).repartitionByRange(F.col(c)).withColumn("part", F.spark_partition_id()), "ranges")
    size = x.groupBy("part").agg(F.sum("n").alias("size"))
    before = size.alias("a").join(F.broadcast(size.alias("b")), F.col("a.part") > F.col("b.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.size"), F.lit(0)).alias("before"))  # a row for each range
    own = F.sum("n").over(Window.partitionBy("part").orderBy(c).rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("upto", own).join(F.broadcast(before), "part").select(c, (F.col("before") + F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"))


def join_counted(rows: DataFrame, values: DataFrame, key: list[str], total: int) -> DataFrame:
    """Inner join of ``rows`` with ``values``, one row for each key with ``count``, how many of the ``total`` rows have it. Keys with more than a
    4096th of the rows are fewer than 4096, so they are broadcast; the rest is joined by shuffle. No task gets all rows of a hot key."""
    most = max(total // HOT_KEYS, 1)
    hot = values.where(F.col("count") > most).drop("count")
    names = [*rows.columns, *(c for c in values.columns if c not in key and c != "count")]
    near = rows.join(F.broadcast(hot), key).select(*names)
    rest = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(values.where(F.col("count") <= most).drop("count"), key).select(*names)
    return near.unionByName(rest)


def guard_all_pairs(n: int, most: int = MAX_ALL_PAIRS_VERTICES) -> None:
    if n > most:
        raise ValueError(f"all pairs of {n} vertices are more than the limit of {most} allows; use pivots or landmarks")


def estimate_preparation(n: int, mode: str = "all_pairs", edges: int = 0, local: int = 0, landmarks: int = 0) -> dict:
    """Pairs and bytes that a preparation holds at least: the dense distances unless only edges are kept."""
    pairs = {"all_pairs": n * (n - 1) // 2, "landmark_sparse": min(n * (n - 1) // 2, n * (local + landmarks)), "distance_matrix_only": 0, "edge_only": edges}
    if mode not in pairs:
        raise ValueError(f"unknown mode {mode!r}")
    size = 0 if mode == "edge_only" else 8 * n * n
    if size > ADVISORY_BYTES:
        warnings.warn(f"the dense distances of {n} vertices take {size / 2**30:.2f} GiB", stacklevel=2)
    return {"mode": mode, "n": n, "pairs": pairs[mode], "bytes": size, "gib": size / 2**30}
