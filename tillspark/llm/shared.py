"""What several operators need: bounded Arrow batches, spare column names, connected components."""

from __future__ import annotations

import ctypes
import gc
import io
import zipfile
from collections.abc import Callable, Hashable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillspark.runtime import drop_materialized, ensure_checkpoint_dir, heavy_keys, materialize, salted_join

#: An Arrow batch holds at most so many bytes and rows, so a Python worker's memory is bounded.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, by a file in the shared folder.

    Functions here keep caches in their modules, so they go by name, not by value.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package, packed = Path(__file__).parent.parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.writestr(str(Path(package.name) / file.relative_to(package)), file.read_bytes())
    ensure_checkpoint_dir(spark)
    path = f"{sc.getCheckpointDir()}/{package.name}-{sc.applicationId}.zip"
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, True)
    stream.write(packed.getvalue())
    stream.close()
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def bound_batches(spark: SparkSession) -> None:
    """Make the session ready for the workers here: they get this package, and Arrow batches of the size they are meant for.

    The limits stay lowered in the session, as the functions run when its caller reads the results.
    """
    ship(spark)
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name, None)
        now = int(now) if now and now.lstrip("-").isdigit() else 0
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


_HELD: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], object]):
    """What ``make`` gives, kept in this Python process until another key is asked for.

    Workers live on from one operator to the next; so each holds the caches of one operator only, and what the last one
    held is given back to the system.
    """
    if key not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[key] = make()
    return _HELD[key]


def give_back() -> None:
    """Return freed memory of this process to the system, as far as its libraries can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than GNU's
        pass


class ByWord(dict):
    """What a function gives for words; kept for words of up to ``longest`` characters, up to ``most`` of them."""

    def __init__(self, function: Callable[[str], object], most: int = 200_000, longest: int = 64):
        super().__init__()
        self.function, self.most, self.longest = function, most, longest

    def __missing__(self, word: str):
        out = self.function(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = out
        return out


def spare(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A bitmap has sixteen places per key, between these.
LEAST_PLACES, MOST_PLACES = 1 << 15, 1 << 26


def bitmap(keys: DataFrame, n: int, number: Column) -> np.ndarray:
    """Bits of the ``number`` (a whole number, such as a hash) of each of the ``n`` keys, modulo the size of the bitmap.

    The size has a bound, so it can be broadcast. What has no bit is no key; what has one may be none, and more so in a
    full bitmap: it only saves work ahead of a join.
    """
    places = min(max(LEAST_PLACES, 1 << (16 * n).bit_length()), MOST_PLACES)
    # Buckets of 2^15 places; Spark counts the places from 1.
    place = F.pmod(number, F.lit(places)) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros((places >> 15, 1 << 12), np.uint8)
    for r in rows:
        out[r.bucket - 1] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def has_bit(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whether the bitmap has a bit for each of ``numbers``."""
    places = np.mod(numbers, 8 * len(bits))
    return (bits[places >> 3] >> (places & 7)) & 1 > 0


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over ``edges`` (a, b), for every id in an edge.

    Large-star and small-star rounds: each replaces links by links to smaller ids, keeps what is
    reachable, and ends with stars around the smallest ids: every id has one link, to an id without one.
    A round is two grouped minima and two joins, all shuffled; the driver sees a count. Each round is a written table.
    """
    a, b = F.col("a"), F.col("b")
    links = materialize(edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    while True:
        # Minima are partial sums. They are stored, so that a hub, which has one, meets its many links spread over tasks.
        both = links.unionByName(links.select(b.alias("a"), a.alias("b")))
        low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n")))
        large = salted_join(both, low.drop("n"), ["a"], ["b"], heavy=heavy_keys(low, ["a"], "n")).filter(b > a)
        large = materialize(large.select(b.alias("a"), F.col("m").alias("b")).distinct())
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
        small = (
            salted_join(large, least.drop("n"), ["a"], ["b"], heavy=heavy_keys(least, ["a"], "n"))
            .filter(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(a != b).distinct()
        )
        after = materialize(small)
        for done in (links, low, large, least):
            drop_materialized(done)
        links = after
        # An id as the start of a link counts 1, as its end 0: a star has 1 at its points only.
        starts = links.select(a.alias("id"), F.lit(1).alias("out")).unionByName(links.select(b.alias("id"), F.lit(0).alias("out")).distinct())
        ends = starts.groupBy("id").agg(F.sum("out").alias("out"), F.count_if(F.col("out") == 0).alias("ins"))
        if not ends.filter("out > 1 OR (out > 0 AND ins > 0)").agg(F.count(F.lit(1))).first()[0]:
            break
    stars = links.select(a.alias("id"), b.alias("component"))
    return stars.unionByName(links.select(b.alias("id"), b.alias("component"))).groupBy("id").agg(
        F.min("component").alias("component"))
