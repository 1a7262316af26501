"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: 64 majority bits over the XXH64 of each word shingle. Search: each bit gets a
non-zero label of radius+1 bits; table v (a non-zero vector) keeps the bits whose label has an odd
product with v. Any `radius` differing bits leave some v orthogonal to all their labels, so each pair
within the radius agrees in that table: no pair is missed.

At scale: one row per distinct fingerprint and table (7 at radius 2) is shuffled, copies collapse
first. A bucket of two is checked in place; members of larger buckets are grouped by the values at
distance up to one, where a group never holds more than 65 fingerprints, whatever the bucket's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_dealt_anew, table, written
from .components import connected_components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
PIECE = 1 << 16


def fingerprint_of(text: str | None, k: int, seed: int) -> bytes:
    """The eight bytes of a text's fingerprint, most significant first; zero for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return bytes(8)
    if len(words) < k:
        hashes = [xxhash.xxh64_digest(b" ".join(words), seed)]
    else:
        line, digest = b" ".join(words), xxhash.xxh64_digest
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = [digest(line[s:e], seed) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PIECE):  # bounded memory for very long texts
        bits = np.unpackbits(np.frombuffer(b"".join(hashes[at : at + PIECE]), np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long), one row per row of docs, nulls and repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b"".join(fingerprint_of(t.as_py(), k, seed) for t in b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.frombuffer(raw, ">i8").astype(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks as signed longs; labels are dealt evenly over the bits."""
    n = 2 ** (radius + 1) - 1
    masks = [sum(1 << i for i in range(bits) if bin((i % n + 1) & v).count("1") % 2) for v in range(1, n + 1)]
    return [m - (1 << bits) if m >> (bits - 1) else m for m in masks]


def bucket_rows(fps: DataFrame, radius: int) -> DataFrame:
    """fps with a column fp -> one row per covering table: adds (t, key)."""
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(covering_masks(radius))])
    return fps.withColumn("_x", F.explode(keys)).select(*fps.columns, "_x.t", "_x.key")


def links(distinct_fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fingerprints at `radius` or fewer differing bits.

    At radius 2, the values at distance one of two such fingerprints meet, and any two fingerprints
    that share such a value are within 2: a star within each value's group is exact, and a group is bounded. At radius 1 the star's centre is
    the value itself, where it is a fingerprint; at radius 0 distinct fingerprints have no link.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    rows = bucket_rows(distinct_fps.select("fp"), radius)
    buckets = written(rows.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "buckets")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = buckets.where("n = 2").where(near).select("a", "b")
    big = join_dealt_anew(rows, buckets.where("n > 2").select("t", "key"), ["t", "key"]).select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
    around = big.select("fp", F.explode(flips).alias("value")).groupBy("value").agg(F.min("fp").alias("b"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    if radius < 2:
        around = around.where(F.array_contains("all", F.col("value")) & F.lit(radius == 1)).withColumn("b", F.col("value"))
    return pairs.union(around.select(F.explode("all").alias("a"), "b").where("a <> b"))


def simhash_components(docs: DataFrame, k: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (least doc_id of its component).

    Null texts and texts without words share the fingerprint zero. Null ids keep their row; a component of
    null ids only has a null component_id. Repeated rows stay repeated; an empty table gives no row; further
    columns are ignored.
    """
    fps = written(fingerprints(docs, k, seed), "fingerprints")
    reps = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "representatives")
    roots = connected_components(links(reps, radius)).select(F.col("node").alias("fp"), "root")
    rooted = join_dealt_anew(reps, roots, ["fp"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(join_dealt_anew(rooted, ids, ["root"]).select("fp", "component_id"), "components")
    return join_dealt_anew(fps, named, ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
