"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a bitmap at most: 8 MB.
BITMAP = 1 << 26
#: Code points that the contracts call white space.
BLANKS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in the one that driver and executors share, spark.checkpoint.dir; it can be deleted when the application has ended.

    Where the setting is missing, a local session (as in tests) gets a folder of its own; on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = sys.__dict__.setdefault("_tallyweave_shared", None) or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sys._tallyweave_shared = at
    return f"{at.rstrip('/')}/tallyweave-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tallyweave_path = path
    return out


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Gives disk back: deletes written() tables that nothing reads any more, and has the driver collect garbage, upon which Spark's cleaner removes the shuffle files of what is gone."""
    import gc

    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t._tallyweave_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_dealt_anew(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join that deals out both sides for itself, even one that an aggregate has just dealt out by the same keys.

    Adaptive execution splits a hot key only where both sides come straight from an exchange of the join's own.
    """
    k = F.xxhash64(*keys)
    return left.withColumn("_k", k).join(right.withColumn("_k", k), ["_k", *keys], how).drop("_k")


def offsets(counts: DataFrame, key: str, n: str, block: int = 1024) -> DataFrame:
    """Exclusive running sum of n in ascending order of the non-negative integer key, as column `base`.

    Two levels: sums within blocks of keys in parallel, then over one row a block.
    """
    from pyspark.sql import Window

    counts = counts.withColumn("_b", F.floor(F.col(key) / block))
    inner = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tops = counts.groupBy("_b").agg(F.sum(n).alias("_n")).select("_b", F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_top"))
    return counts.withColumn("_in", F.coalesce(F.sum(n).over(inner), F.lit(0))).join(tops, "_b").withColumn("base", F.col("_in") + F.col("_top")).drop("_b", "_in", "_top")


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text as an array (null: none), JVM-side."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def worker_cache() -> dict:
    """A dictionary that outlives a task in a reused Python worker."""
    return sys.__dict__.setdefault("_tallyweave_worker", {})


def bitmap(keys: DataFrame, each: int = 16, of=None):
    """A broadcast bitmap of the column k of keys, two bits a key, and its size; about `each` bits a key, at most BITMAP, whatever the number of keys."""
    n = keys.count()
    bits = 1 << 12
    while bits < min(each * n, BITMAP):
        bits *= 2
    places = F.explode(F.array(*(of or bitmap_places)(bits))).alias("p")
    words = keys.select(places).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v")).toArrow()
    held = np.zeros(bits // 64, np.int64)
    held[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(held), bits


def bitmap_places(bits: int) -> tuple[Column, Column]:
    return F.pmod("k", F.lit(bits)), F.pmod(F.xxhash64("k"), F.lit(bits))


def plain_places(bits: int) -> tuple[Column, Column]:
    """Places that numpy finds as well, for keys that are hashes."""
    return F.col("k").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("k", 29).bitwiseAND(F.lit(bits - 1))


def plain_maybe_in(held: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    """Which of the unsigned hashes h the bitmap of plain_places may hold."""
    at = lambda x: (held[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63)).astype(np.int64)) & 1 > 0
    return at(h & np.uint64(bits - 1)) & at((h >> np.uint64(29)) & np.uint64(bits - 1))


def maybe_in(held: np.ndarray, p: pa.Array, q: pa.Array) -> np.ndarray:
    at = lambda x: (held[x >> 6] >> (x & 63)) & 1 > 0
    return at(p.to_numpy(zero_copy_only=False)) & at(q.to_numpy(zero_copy_only=False))
