"""Near-duplicate removal on top of the covering SimHash search: five-word shingles, similarity 0.8 or more.

Texts with the same words are one node. Two searches give candidates, which are compared exactly. The covering search: nodes get
SEEDS independent fingerprints of their distinct words, each searched with the covering tables of radius 2. The prefix search, which
misses no pair: in any one order of all shingles, two sets of similarity 0.8 share one of their first n - ceil(0.8 n) + 1 members.
The order is by count in a sample, then by hash; the sample decides the cost, not the result. It is a fixed share of the texts: in a
sample of fixed size, shingles of buckets that grow with the input would soon count as rare, and their pairs grow with the square.

The first round compares the members of the covering and of the prefix buckets with leaders. The second
compares all pairs of the prefix buckets whose ends the first left in different components: pairs within one add nothing to it. So no link is lost, whatever
a bucket's size.

At scale: rows shuffled are narrow (node and bucket), buckets are counted with partial sums, and texts are shuffled only where
a bitmap of bounded size says that they are candidates, or copies to be dropped; what is compared travels as compressed text, since sets of hashes don't shrink.
Tables and shuffle files are given back as soon as nothing reads them any more, so the disk holds one search at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, bitmap_places, join_dealt_anew, maybe_in, plain_maybe_in, plain_places, release, written
from .components import connected_components
from .op8_simhash import LOWER, PIECE, covering_masks

SHINGLE = 5
#: Least similarity as a fraction of integers, so that no pair at the bound is lost to rounding.
OVER, UNDER = 4, 5
SEEDS = tuple(0x9E3779B97F4A7C15 * (2 * i + 1) & (1 << 64) - 1 for i in range(6))
RADIUS = 2
NONE = -(1 << 63)
#: One text in RATE is sampled for the order of shingles; those with a count of OFTEN in the sample come after the others. From COMMON on,
#: or COMMON in each SAMPLE texts of a larger sample, they go by the count itself.
RATE, OFTEN, COMMON, SAMPLE = 8, 2, 10, 20_000
#: Leaders that a prefix bucket's node may have, by the bucket's key.
LEADERS = 8
BASE = 0x9E3779B97F4A7C15


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def shingles(words: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words make one shingle, none make none."""
    if not words:
        return np.zeros(0, np.int64)
    k, h = min(k, len(words)), np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), np.uint64)
    n = len(words) - k + 1
    x = np.full(n, k, np.uint64)
    for j in range(k):
        x = x * np.uint64(BASE) + h[j : j + n]
    x ^= x >> np.uint64(29)
    return np.unique((x * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64))


def prefix(s: np.ndarray, common: np.ndarray, counts: np.ndarray, often: np.ndarray, bits: int) -> np.ndarray:
    """The first members of s by rank and hash: a similar set has one of them among its own first. Ranks: none for those of no bitmap, then the bitmap, then the counts of common (sorted)."""
    rank = plain_maybe_in(often, bits, s.view(np.uint64)).astype(np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        rank = np.where(common[at] == s, counts[at], rank)
    return s[np.lexsort((s, rank))[: len(s) + OVER * -len(s) // UNDER + 1]]


def word_fingerprints(words: list[bytes]) -> list[int]:
    """A majority fingerprint of the distinct words for each seed, as signed longs."""
    if not words:
        return [0] * len(SEEDS)
    h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, set(words))), np.uint64)
    out = []
    for seed in SEEDS:
        x = (h ^ (h >> np.uint64(31))) * np.uint64(seed)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(x), PIECE):
            ones += np.add.reduce(np.unpackbits(x[at : at + PIECE].view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.int32)
        out.append(int(np.packbits(2 * ones > len(x)).view(np.int64)[0]))
    return out


def _order(keyed: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The order by the counts in one text of RATE. What reaches the driver is bounded whatever the number of texts: a bitmap, and the shingles of the highest counts."""
    some = keyed.where(F.pmod(F.xxhash64("k"), F.lit(RATE)) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(_words(t.as_py())))], ["k"])

    often = written(some.mapInArrow(run, "k long").groupBy("k").count().where(F.col("count") >= OFTEN), "often")
    held, bits = bitmap(often, of=plain_places)
    got = often.where(F.col("count") >= max(COMMON, COMMON * some.count() // SAMPLE)).toArrow()
    release(keyed.sparkSession, often)
    key, count = got.column("k").to_numpy(), got.column("count").to_numpy()
    at = np.argsort(key)
    return key[at], count[at], held.value, bits


def _features(keyed: DataFrame) -> DataFrame:
    """(d, k, node, n, f, p): node names the words of a text in order, n counts its distinct shingles, f are its fingerprints, p its prefix."""
    held = keyed.sparkSession.sparkContext.broadcast(_order(keyed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n, f, p = [], [], [], []
            for t in b.column(2):
                words = _words(t.as_py())
                node.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
                s = shingles(words)
                n.append(max(1, len(s)))
                f.append(word_fingerprints(words))
                p.append(prefix(s, *held.value))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(f, pa.list_(pa.int64())), pa.array(p, pa.list_(pa.int64()))], ["d", "k", "node", "n", "f", "p"])

    return keyed.select("d", "k", "text").mapInArrow(run, "d long, k long, node long, n long, f array<long>, p array<long>")


def _fits(n: str, m: str) -> Column:
    return UNDER * F.least(n, m) >= OVER * F.greatest(n, m)


def _reach(n: str, i: str, m: str, j: str) -> Column:
    """Whether sets of n and m members whose first common one is at i and j can be similar."""
    return (OVER + UNDER) * F.least(F.col(n) - F.col(i), F.col(m) - F.col(j)) >= OVER * (F.col(n) + F.col(m))


def _shared(nodes: DataFrame) -> DataFrame:
    """(node, n, i, key) for the prefixes' keys that two nodes or more have, and a few that pass the bitmap besides."""
    twice = nodes.select(F.explode("p").alias("k")).groupBy("k").count().where("count > 1").select("k")
    twice = written(twice, "twice")
    held, bits = bitmap(twice)
    release(nodes.sparkSession, twice)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(b.columns[:4], ["node", "n", "i", "key"]).filter(pa.array(maybe_in(held.value, b.column(4), b.column(5))))

    p, q = bitmap_places(bits)
    rows = nodes.select("node", "n", F.posexplode("p").alias("i", "k")).select("node", "n", F.col("i").cast("long").alias("i"), "k", p.alias("p"), q.alias("q"))
    return written(rows.mapInArrow(pick, "node long, n long, i long, key long"), "shared")


def _members(nodes: DataFrame) -> DataFrame:
    """(key, node, n, i, b, m, j) for each node in a prefix bucket of two or more: b, m, j are the bucket's leader."""
    rows = _shared(nodes)
    # the drawn number gives the node back, so only one of them is moved; both tables are read from files, so a plain join deals them out for itself
    draw = F.xxhash64(F.pmod("key", F.lit(LEADERS)))
    leader = F.min(F.struct(F.col("node").bitwiseXOR(draw).alias("h"), F.col("n").alias("m"), F.col("i").alias("j"))).alias("leader")
    buckets = written(rows.groupBy("key").agg(F.count("*").alias("size"), leader).where("size > 1").select("key", "leader"), "leaders")
    release(nodes.sparkSession)
    out = written(rows.join(buckets, "key").select("key", "node", "n", "i", F.col("leader.h").bitwiseXOR(draw).alias("b"), "leader.m", "leader.j"), "prefixes")
    release(nodes.sparkSession, rows, buckets)
    return out


def _led(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of a node and a leader of its prefix buckets."""
    ok = (F.col("node") != F.col("b")) & _fits("n", "m") & _reach("n", "i", "m", "j")
    return members.where(ok).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))


def _rest(members: DataFrame, roots: DataFrame, done: DataFrame) -> DataFrame:
    """All pairs (a, b) of the prefix buckets that can be similar and whose ends have different roots, but those of done."""
    named = join_dealt_anew(members.select("key", "node", "n", "i"), roots, ["node"], "left").withColumn("root", F.coalesce("root", "node"))
    named = written(named, "rooted")
    mixed = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    x = written(join_dealt_anew(named, mixed, ["key"]), "mixed")
    y = x.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("root").alias("other"))
    ok = (F.col("node") < F.col("b")) & (F.col("root") != F.col("other")) & _fits("n", "m") & _reach("n", "i", "m", "j")
    release(members.sparkSession, named)
    out = written(join_dealt_anew(x, y, ["key"]).where(ok).select(F.col("node").alias("a"), "b").distinct().join(done, ["a", "b"], "left_anti"), "pairs")
    release(members.sparkSession, x)
    return out


def _candidates(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of a node and the leader of a covering bucket that it is in, where their sizes allow the similarity."""
    # a bucket goes by one hash of its table and key: two that meet by chance add candidates, which are compared like others
    keys = F.array(*[F.xxhash64(F.lit(len(SEEDS) * i + j), F.get("f", j).bitwiseAND(F.lit(m))) for i, m in enumerate(covering_masks(RADIUS)) for j in range(len(SEEDS))])
    rows = nodes.select("node", "n", F.explode(keys).alias("key"))
    draw = F.xxhash64("key")
    leader = F.min(F.struct(F.col("node").bitwiseXOR(draw).alias("h"), F.col("n").alias("m"))).alias("leader")
    buckets = written(rows.groupBy("key").agg(F.count("*").alias("size"), leader).where("size > 1").select("key", "leader"), "buckets")
    release(nodes.sparkSession)
    member = rows.join(buckets, "key").select("node", "n", F.col("leader.h").bitwiseXOR(draw).alias("b"), "leader.m")
    member = member.where(_fits("n", "m") & (F.col("node") != F.col("b"))).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))
    out = written(member.distinct(), "candidates")
    release(nodes.sparkSession, buckets)
    return out


def _texts(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (d, k, ...) with the text of each: only texts that a bitmap lets through are shuffled."""
    held, bits = bitmap(rows.select("k"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(b.columns[:3], ["text", "d", "k"]).filter(pa.array(maybe_in(held.value, b.column(3), b.column(4))))

    p, q = bitmap_places(bits)
    return keyed.select("text", "d", "k", p.alias("p"), q.alias("q")).mapInArrow(pick, "text string, d long, k long").join(rows, ["d", "k"])


def _similar(pairs: DataFrame, keyed: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard similarity of 0.8 or more."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = written(join_dealt_anew(nodes.select("node", "first.*"), ends, ["node"]), "wanted")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([zlib.compress(b" ".join(_words(t.as_py())), 1) for t in b.column(1)], pa.binary())], ["node", "s"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lru_cache(8)(lambda z: shingles(zlib.decompress(z).split()))
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                u, v = one(x.as_py()), one(y.as_py())
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append((OVER + UNDER) * both >= OVER * (len(u) + len(v)))
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # rows equal in id and text give a text twice; one is enough
    s = written(_texts(keyed, wanted).select("node", "text").mapInArrow(pack, "node long, s binary"), "packed")
    release(keyed.sparkSession, wanted)
    first = written(pairs.join(s.withColumnsRenamed({"node": "a", "s": "x"}), "a"), "sides")
    release(keyed.sparkSession)
    both = first.join(s.withColumnsRenamed({"node": "b", "s": "y"}), "b")
    out = written(both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "similar")
    release(keyed.sparkSession, s, first)
    return out


def keep_one_each(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: of each group the row with the least doc_id stays, all columns as they were.

    Groups are components of all pairs at similarity 0.8 or more. Texts with the same words in order are one, texts without words
    (null ones too) among themselves; null ids come last; of rows equal in id and text one stays, whichever. An empty
    table gives no row.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    doc = F.col("doc_id").cast("long")
    key = [F.coalesce(doc, F.lit(NONE)).alias("d"), F.xxhash64("doc_id", "text").alias("k")]
    keyed = docs.select("text", *key)
    spark = docs.sparkSession
    release(spark)
    features = written(_features(keyed), "features")
    # null ids, kept as the least long, come last
    order = F.struct((F.col("d") == NONE).alias("late"), "d", "k")
    wide = written(features.groupBy("node").agg(F.min(order).alias("first"), F.max("n").alias("n"), F.max_by("f", "n").alias("f"), F.max_by("p", "n").alias("p")), "nodes")
    rows, nodes = written(features.select("node", "d", "k"), "rows"), written(wide.select("node", "first"), "nodes")
    release(spark, features)
    members, covering = _members(wide), _candidates(wide)
    release(spark, wide)
    pairs = written(covering.union(_led(members)).distinct(), "pairs")
    release(spark, covering)
    edges = _similar(pairs, keyed, nodes)
    more = _rest(members, connected_components(edges), pairs)
    release(spark, members, pairs)
    edges = edges.union(_similar(more, keyed, nodes))
    roots = written(connected_components(edges), "roots")
    release(spark, more)
    rooted = join_dealt_anew(nodes.select("node", "first"), roots, ["node"], "left").withColumn("root", F.coalesce("root", "node"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("kept"))
    heads = written(join_dealt_anew(rooted.select("node", "root"), firsts, ["root"]).select("node", "kept"), "heads")
    judged = join_dealt_anew(rows.select("node", "d", "k"), heads, ["node"])
    out = written(judged.where(F.struct(F.col("d") == NONE, "d", "k") != F.col("kept")).select("d", "k").distinct(), "dropped")
    held, bits = bitmap(out.select("k"))
    p, q = bitmap_places(bits)
    plain = docs.select([F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)] + [*key])
    plain = plain.select(*names, "d", "k", p.alias("_p"), q.alias("_q"))
    schema = plain.select(*names, "d", "k").schema

    def split(hit: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = maybe_in(held.value, b.column(b.num_columns - 2), b.column(b.num_columns - 1))
                yield pa.RecordBatch.from_arrays(b.columns[:-2], b.schema.names[:-2]).filter(pa.array(m if hit else ~m))

        return plain.mapInArrow(run, schema)

    stay = split(False).unionByName(split(True).join(out, ["d", "k"], "left_anti"))
    if rows.groupBy("d", "k").count().where("count > 1").limit(1).count():
        stay = stay.dropDuplicates(["d", "k"])
    return stay.select([F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
