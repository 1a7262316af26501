"""Two-pass external shuffle, in built-in functions only.

Pass one scatters records uniformly over buckets of about `bucket_bytes` by a seeded hash. Pass two brings each bucket
into one task's memory, permutes it by Fisher-Yates swaps drawn from seeded hashes, and writes it. The
buckets' records in order, one bucket after the other, are the new order; shard s holds the places from
ceil(s * n / shards) on, so the shards' counts differ by one at most.

At scale: one exchange of the records, to as many tasks as buckets of a stated size ask for, whatever the session's setting. The hash covers
id, text and the number among rows equal in both, so neither a hot source, nor copies, nor repeated rows are hot here. Repeated
rows are counted first, narrow; only they are collapsed to one row and a count before they are numbered. Offsets of the
buckets come from two-level sums over one row a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import offsets, table, written

SHARDS = 24
SEED = 20
#: A bucket's expected size at most, in bytes and in rows.
BUCKET_BYTES, BUCKET_ROWS = 4 << 20, 1024
#: Buckets that one task permutes.
BUCKETS_A_TASK = 16


def fisher_yates(n: Column, *seeds: Column) -> Column:
    """A permutation of 0..n-1: for i from n-1 down to 1, swap i with a hashed place j in 0..i."""

    def swap(a: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(*seeds, i), i + 1).cast("int")
        parts = F.concat(F.slice(a, F.lit(1), j), F.array(F.get(a, i)), F.slice(a, j + 2, i - j - 1), F.array(F.get(a, j)), F.slice(a, i + 2, n - i - 1))
        return F.when(i == j, a).otherwise(parts)

    return F.when(n < 2, F.sequence(F.lit(0), n - 1)).otherwise(F.aggregate(F.sequence(n - 1, F.lit(1), F.lit(-1)), F.sequence(F.lit(0), n - 1), swap))


def two_pass_shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs in a new order: its columns under `record`, and size, bucket, place, shard, slot.

    Null texts have size 8. Null ids are scattered by their text. Rows equal in all columns are numbered, and each number has a
    bucket and place of its own. An empty table gives no row. Columns of any name pass, inside `record`; maps are no column type for it.
    """
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 8).cast("long")
    rows, total = docs.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    n = max(1, -(-total // bucket_bytes), -(-rows // bucket_rows))
    plain = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)] + ["doc_id", "text"])
    every = [F.col(f"c{i}") for i in range(len(docs.columns))]
    record = F.struct(*[c.alias(name) for c, name in zip(every, docs.columns, strict=True)])
    rows_of = plain.select(record.alias("record"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"), F.xxhash64(F.lit(seed), "doc_id", F.coalesce("text", F.lit("")), *every).alias("h"), F.xxhash64(F.lit(seed + 1), *every, "text").alias("g"))
    again = written(rows_of.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1").select("h", "g"), "repeated")
    once = rows_of.join(again, ["h", "g"], "left_anti").withColumn("number", F.lit(0))
    many = rows_of.join(again, ["h", "g"], "left_semi").groupBy("h", "g").agg(F.count("*").alias("n"), F.first(F.struct("record", "bytes")).alias("x"))
    many = many.select("x.record", "x.bytes", "h", "g", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("number"))
    sized = once.unionByName(many).select("record", (F.col("bytes") + 8).alias("size"), F.xxhash64("h", "number").alias("h"))
    scattered = sized.withColumn("bucket", F.pmod("h", F.lit(n)).cast("long")).repartition(-(-n // BUCKETS_A_TASK), "bucket")
    # in order of the hash first: the permutation then doesn't depend on how the records arrived
    by_hash = lambda x, y: F.when(x["h"] < y["h"], -1).when(x["h"] > y["h"], 1).otherwise(0)
    held = scattered.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("h", "size", "record")), by_hash).alias("rows"))
    held = held.withColumn("order", fisher_yates(F.size("rows"), F.lit(seed), F.col("bucket")))
    mixed = held.select("bucket", F.posexplode(F.transform("order", lambda i: F.get("rows", i))).alias("at", "row"))
    out = written(mixed.select("bucket", "at", "row.size", "row.record"), "buckets")
    base = written(offsets(out.groupBy("bucket").agg(F.count("*").alias("n")), "bucket", "n").select("bucket", "base"), "bases")
    placed = out.join(base, "bucket").withColumn("place", F.col("base") + F.col("at"))
    placed = placed.withColumn("shard", F.expr(f"cast(place * {shards} div {max(rows, 1)} as int)"))
    return placed.withColumn("slot", F.expr(f"place - (shard * {rows}L + {shards - 1}) div {shards}")).select("record", "size", "bucket", "place", "shard", "slot")


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder a shard; within it, files of whole stretches in order of slot."""
    shuffled.write.option("compression", "zstd").partitionBy("shard").parquet(path)


def op5_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffles documents and takes size and crc32 from the records as they were written."""
    got = two_pass_shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("record.text", F.lit(""))
    return got.select("record.doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
