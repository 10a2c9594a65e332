"""Shared pieces: scratch tables, batch slicing and vectorised word hashing."""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

WORD = r"[^\x20\x09-\x0D]+"
U = np.uint64


# --------------------------------------------------------------------------- scratch tables
def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a fresh local one only for local masters."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = spark.conf.get("shiftglass.scratch", None)
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            spark.conf.set("shiftglass.scratch", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage, dropped when no longer read."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root, self.n = spark, f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as Parquet and read it back; the path is in ``.path`` of the result."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for f in frames:
            p = jvm.org.apache.hadoop.fs.Path(f.path)
            p.getFileSystem(conf).delete(p, True)


def freed(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished jobs: it waits for the driver's collector, which may not run for half an hour."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where this machine keeps a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def widened(df: DataFrame, *columns: str) -> StructType:
    """The schema of ``df`` and further columns, each as "name type"."""
    return StructType([*df.schema.fields, *StructType.fromDDL(", ".join(columns)).fields])


# --------------------------------------------------------------------------- Arrow batches
def slices(batches, column: str, limit: int = 2 << 20):
    """Arrow batches cut so that ``column`` holds about ``limit`` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lens = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
        cut = np.flatnonzero(np.diff((np.cumsum(lens) - lens) // limit)) + 1
        for a, b in zip([0, *cut], [*cut, batch.num_rows]):
            yield batch.slice(a, b - a)


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its n + 1 offsets; null counts as empty."""
    a = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type)
    _, offsets, data = a.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


# --------------------------------------------------------------------------- words and hashes
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = U(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_KEYS = _rng.integers(1, 2**64, 256, dtype=np.uint64)
END_TOKEN = U(0xD6E8FEB86659FD93)


@functools.lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inv = U(pow(int(BASE), -1, 2**64))
    up, down = np.full(n, BASE), np.full(n, inv)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    up, down = _powers(1 << max(10, int(n - 1).bit_length()))
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_spans(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words of each row."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs) - 1, np.int64)
    gap = SPACE[raw]
    row_start = np.zeros(n + 1, bool)
    row_start[offs] = True
    first = ~gap
    first[1:] &= gap[:-1] | row_start[1:n]
    last = ~gap
    last[:-1] &= gap[1:] | row_start[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.diff(np.searchsorted(s, offs))


def word_hashes(raw: np.ndarray, offs: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word's bytes, and the number of words of each row."""
    s, e, counts = word_spans(raw, offs)
    if not len(s):
        return np.zeros(0, np.uint64), counts
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((BYTE_KEYS[LOWER] if lower else BYTE_KEYS)[raw] * up[:-1], out=sums[1:])
    return mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * BASE), counts


def run_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of h[i : i + width] for every i that has so many; rows are not told apart."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    up, down = powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:-1], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[: len(h) - width + 1])


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c in turn."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


# --------------------------------------------------------------------------- joins with hot keys
HOT_KEYS = 4096


def hot_join(left: DataFrame, facts: DataFrame, keys: list[str], n: str, total: int, spread: list[str]) -> DataFrame:
    """``left`` with the columns of ``facts``, null where it has none of ``keys`` (null matches nothing).

    ``facts`` has one row a key, and in ``n`` how many rows of ``left`` hold it, ``total`` in
    all. Keys of over ``total`` / ``HOT_KEYS`` rows, of which there are fewer than
    ``HOT_KEYS``, are broadcast; their rows are dealt by ``spread`` and never meet in a task.
    """
    more = [c for c in facts.columns if c not in keys]
    hot = facts.where(F.col(n) * HOT_KEYS > total).select(*keys, F.struct(*more).alias("__hot"))
    cold = facts.where(F.col(n) * HOT_KEYS <= total).select(*keys, F.struct(*more).alias("__cold"), F.lit(0).cast("long").alias("__spread"))
    dealt = F.when(F.col("__hot").isNotNull() | F.col(keys[0]).isNull(), F.xxhash64(*spread)).otherwise(F.lit(0).cast("long"))
    both = left.join(F.broadcast(hot), keys, "left").withColumn("__spread", dealt).join(cold, [*keys, "__spread"], "left")
    return both.select(*left.columns, *[F.coalesce(F.col(f"__hot.{c}"), F.col(f"__cold.{c}")).alias(c) for c in more])


def numbered(df: DataFrame, order: list, name: str, scratch: Scratch) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in the order of the columns ``order``, by a range-partitioned sort and the partitions' sizes."""
    placed = scratch.keep(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n")).withColumn("__from", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return placed.withColumn("__part", part).join(F.broadcast(sizes), "__part").withColumn(name, F.col("__from") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__part", "__at", "__from")
