"""Helpers that keep jobs safe at scale: stored intermediate tables, salted joins, distributed ranks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Places of a salted key where all keys are salted, and the least number of places elsewhere.
SALTS = 16


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only in local mode, one under the warehouse folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    sc.setCheckpointDir(folder)


class Scratch:
    """The tables that one job stores. They go when it ends, also by an error; ``keep`` stores a result beyond that."""

    def __init__(self, spark: SparkSession, outer: Scratch | None):
        self.spark, self.outer, self.folders = spark, outer, []

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, computed and stored for whoever called the job: a job around it, or the caller."""
        token = _OPEN.set(self.outer)
        try:
            return materialize(df)
        finally:
            _OPEN.reset(token)

    def clear(self) -> None:
        for folder in self.folders:
            _delete(self.spark, folder)
        self.folders.clear()


_OPEN: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Owns all tables materialized inside; what leaves has to be kept or read by then."""
    own = Scratch(spark, _OPEN.get())
    token = _OPEN.set(own)
    try:
        yield own
    finally:
        _OPEN.reset(token)
        own.clear()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"
    if (own := _OPEN.get()) is not None:
        own.folders.append(folder)
    return folder


def _path(spark: SparkSession, folder: str):
    """A folder and the file system it is on."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(sc._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, folder: str) -> None:
    path, system = _path(spark, folder)
    system.delete(path, True)


def exists(spark: SparkSession, folder: str) -> bool:
    path, system = _path(spark, folder)
    return system.exists(path)


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a table in the shared folder and go on from there.

    The table survives the loss of any executor, so later steps re-read it instead of re-running
    what made it. Its size is known, so joins with it are planned by size.
    """
    return materialize_counted(df)[0]


def materialize_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """The same, with the number of rows as seen by the write."""
    folder, seen = scratch_folder(df.sparkSession), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(folder)
    stored = df.sparkSession.read.schema(df.schema).parquet(folder)
    stored._scratch_folder = folder
    return stored, seen.get["rows"]


def drop_materialized(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more.

    ``df`` is what ``materialize`` returned, or read from it.
    """
    kept = getattr(df, "_scratch_folder", None)
    for folder in [kept] if kept else {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def heavy_keys(counts: DataFrame, keys: list[str], count: str, share: int = 1000) -> DataFrame:
    """Keys with more than one in ``share`` of all rows, so fewer than ``share`` of them.

    ``counts`` has one row per key with its number of rows.
    """
    total = counts.agg(F.sum(count)).scalar()
    return materialize(counts.filter(F.col(count) * share > total).select(*keys))


def salted_join(
    big: DataFrame, small: DataFrame, keys: list[str], spread_by: list[str], how: str = "inner",
    salts: int | None = None, heavy: DataFrame | None = None,
) -> DataFrame:
    """Join where one key may hold a large share of ``big``.

    Rows of ``big`` with one key go to ``salts`` places, chosen by a hash of ``spread_by``;
    ``small`` (unique or nearly unique per key) is repeated once per place. Needed where the
    keys are also the next grouping, because adaptive skew splitting then stays off to avoid
    a second shuffle. NULL keys do not match, as in any equi-join.

    Without ``heavy`` all keys are salted, which suits a ``small`` far smaller than ``big``, such as
    a catalog. With ``heavy``, a list from ``heavy_keys``, only those keys are, over as many places as a shuffle has.
    """
    if salts is None:
        salts = SALTS if heavy is None else max(SALTS, int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    place = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    places = F.sequence(F.lit(0), F.lit(salts - 1))
    if heavy is not None:
        flags = F.broadcast(heavy.select(*keys, F.lit(True).alias("_heavy")))
        big, small = big.join(flags, keys, "left"), small.join(flags, keys, "left")
        place = F.when(F.col("_heavy"), place).otherwise(0)
        places = F.when(F.col("_heavy"), places).otherwise(F.array(F.lit(0)))
    salted = big.withColumn("_salt", place).drop("_heavy")
    spread = small.withColumn("_salt", F.explode(places)).drop("_heavy")
    return salted.join(spread, keys + ["_salt"], how).drop("_salt")


def with_rank(df: DataFrame, key: str, name: str = "id") -> DataFrame:
    """Number the rows 1..n in the order of the unique column ``key``, without a global sort task.

    Rows are range-partitioned, numbered inside each range, and shifted by the sizes of the
    ranges before it; the only table seen by a single task has one row per range.
    """
    ranged = materialize(
        df.repartitionByRange(F.col(key)).withColumn("_range", F.spark_partition_id())
    )
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    shifts = (
        ranged.groupBy("_range").agg(F.count("*").alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    inside = F.row_number().over(W.partitionBy("_range").orderBy(key))
    return (
        ranged.withColumn("_at", inside)
        .join(F.broadcast(shifts), "_range")
        .withColumn(name, (F.col("_at") + F.col("_shift")).cast("long"))
        .drop("_range", "_at", "_shift")
    )
