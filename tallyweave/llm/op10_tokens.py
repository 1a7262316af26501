"""Token-id files with canonical length-limited Huffman codes.

Ids are counted over the whole corpus; code lengths come from package-merge with a limit of LIMIT bits, codes are
canonical, so the table of lengths is the whole dictionary. Documents are dealt out in ranges of doc_id; each range
becomes one file of blocks. A block holds whole documents and can be decoded by itself: a bit stream, the documents'
numbers of ids, and the bit offset of every STEP-th id. Decoding looks up LIMIT bits in a table, one id for every
checkpoint at a time.

At scale: texts are tokenized once, into a narrow table of ids; only ids are shuffled. Counts are summed per task, then
by id: no more rows than the vocabulary has reach the driver. A block's size is bounded but for a single long document.
"""

from __future__ import annotations

import heapq
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import offsets, shared_dir, table, written
from .tokens import Encoder, vocabulary_path

END = 2
LIMIT = 18
STEP = 64
BLOCK = 1 << 17
#: Bytes of ids in one range of documents, about one file.
RANGE_BYTES = 16 << 20
FILE_SCHEMA = "part int, block int, first long, doc_ids array<long>, lengths array<long>, bits binary, checkpoints binary"


def code_lengths(counts: list[tuple[int, int]], limit: int = LIMIT) -> dict[int, int]:
    """Optimal code lengths of at most `limit` bits, by package-merge. counts: (symbol, count > 0); ties go by symbol."""
    if not counts:
        return {}
    if len(counts) == 1:
        return {counts[0][0]: 1}
    if len(counts) > 1 << limit:
        raise ValueError("limit is too small for so many symbols")
    order = sorted(counts, key=lambda c: (c[1], c[0]))
    weight = [c for _, c in order]
    # levels of merged lists; an entry is the weight and whether it is a leaf
    levels, pairs = [], []
    for _ in range(limit):
        merged = list(heapq.merge(((w, 0) for w in weight), ((w, 1) for w in pairs)))
        levels.append([kind for _, kind in merged])
        pairs = [merged[i][0] + merged[i + 1][0] for i in range(0, len(merged) - 1, 2)]
    lengths, take = [0] * len(order), 2 * len(order) - 2
    for kinds in reversed(levels):
        packages = sum(kinds[:take])
        for i in range(take - packages):  # the lightest leaves
            lengths[i] += 1
        take = 2 * packages
    return {s: n for (s, _), n in zip(order, lengths, strict=True)}


def canonical(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols in canonical order (length, symbol), their lengths and codes."""
    order = sorted(lengths.items(), key=lambda x: (x[1], x[0]))
    codes, code, last = [], 0, 0
    for _, n in order:
        code <<= n - last
        codes.append(code)
        code, last = code + 1, n
    return np.array([s for s, _ in order], np.uint32), np.array([n for _, n in order], np.uint8), np.array(codes, np.uint64)


class Code:
    """Encoder and decoder of one code."""

    def __init__(self, lengths: dict[int, int], limit: int = LIMIT) -> None:
        self.limit = limit
        symbols, bits, codes = canonical(lengths)
        size = int(symbols.max()) + 1 if len(symbols) else 1
        self.bits, self.codes = np.zeros(size, np.uint8), np.zeros(size, np.uint64)
        self.bits[symbols], self.codes[symbols] = bits, codes
        # canonical codes fill the table from the left, in order
        spans = np.left_shift(1, limit - bits.astype(np.int64))
        fill = np.zeros((1 << limit) - int(spans.sum()), np.uint32)
        self.symbol = np.concatenate([np.repeat(symbols, spans), fill])
        self.length = np.concatenate([np.repeat(bits, spans), fill.astype(np.uint8) + 1])

    def encode(self, ids: np.ndarray, step: int = STEP) -> tuple[bytes, bytes]:
        """Bit stream and checkpoints (little-endian unsigned 64-bit bit offsets of each step-th id)."""
        if not len(ids):
            return bytes(8), b""
        n = self.bits[ids].astype(np.uint64)
        end = np.cumsum(n)
        start = end - n
        word, free = (start >> np.uint64(5)).astype(np.int64), np.uint64(64) - (start & np.uint64(31)) - n
        placed = self.codes[ids] << free  # a code spans two 32-bit words at most
        total = int(end[-1] + np.uint64(31)) // 32 + 2
        first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        out = np.zeros(total, np.uint32)
        out[word[first]] |= np.bitwise_or.reduceat((placed >> np.uint64(32)).astype(np.uint32), first)
        out[word[first] + 1] |= np.bitwise_or.reduceat(placed.astype(np.uint32), first)
        return out.astype(">u4").tobytes(), start[::step].astype("<u8").tobytes()

    def decode(self, bits: bytes, checkpoints: bytes, n: int, step: int = STEP) -> np.ndarray:
        """The n ids, as little-endian unsigned 32-bit."""
        if not n:
            return np.zeros(0, "<u4")
        words = np.append(np.frombuffer(bits, ">u4").astype(np.uint64), np.zeros(2, np.uint64))
        at = np.frombuffer(checkpoints, "<u8").astype(np.uint64)
        out = np.zeros((len(at), step), "<u4")
        shift = np.uint64(64 - self.limit)
        last = np.uint64(32 * (len(words) - 2))
        for j in range(step):
            w = (at >> np.uint64(5)).astype(np.int64)
            window = ((words[w] << np.uint64(32)) | words[w + 1]) << (at & np.uint64(31)) >> shift
            out[:, j] = self.symbol[window]
            at = np.minimum(at + self.length[window], last)
        return out.reshape(-1)[:n]


def _tokenized(docs: DataFrame, path: str, end: int) -> DataFrame:
    """(doc_id, ids): little-endian ids of 2 or 4 bytes each, with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of_worker(path)
        tail = np.array([end], enc.dtype).tobytes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.ids(t.as_py()).tobytes() + tail for t in b.column(1)], pa.binary())], ["doc_id", "ids"])
        enc.forget()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary")


def _counts(ids: DataFrame, dtype: str) -> list[tuple[int, int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for b in batches:
            got = np.bincount(np.frombuffer(b"".join(x.as_py() for x in b.column(0)), dtype))
            if len(got) > len(total):
                got[: len(total)] += total
                total = got
            else:
                total[: len(got)] += got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    return [(r[0], r[1]) for r in ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n")).collect()]


def write_token_files(docs: DataFrame, out: str, path: str | None = None, end: int = END, limit: int = LIMIT, step: int = STEP) -> None:
    """Tokenizes docs and writes out/ids (the blocks, in ascending doc_id) and out/code (one row: limit, step and the code lengths).

    Null and empty texts have the end id only. Null ids come first; rows with equal ids lie next to each other, by their
    ids' bytes. An empty table writes empty files. Further columns are ignored.
    """
    path = path or vocabulary_path()
    enc = np.dtype(Encoder(path).dtype).newbyteorder("<").str
    ids = written(_tokenized(docs, path, end), "ids")
    lengths = code_lengths(_counts(ids, enc), limit)
    spark = docs.sparkSession
    rows = [(limit, step, sorted(lengths), [lengths[s] for s in sorted(lengths)])]
    spark.createDataFrame(rows, "limit int, step int, symbols array<long>, bits array<int>").write.parquet(f"{out}/code")
    size = ids.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0]
    parts = max(1, -(-size // RANGE_BYTES))
    ordered = ids.withColumn("tie", F.xxhash64("ids")).repartitionByRange(int(parts), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids").select("doc_id", "ids", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths, limit)
        part, block, first, docs_in, pieces, held = 0, 0, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            sizes = [len(p) for p in pieces]
            bits, marks = code.encode(np.concatenate(pieces), step)
            cols = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([docs_in], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([bits], pa.binary()), pa.array([marks], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["part", "block", "first", "doc_ids", "lengths", "bits", "checkpoints"])

        for b in batches:
            for d, x, p in zip(b.column(0), b.column(1), b.column(2), strict=True):
                part = p.as_py()
                docs_in.append(d.as_py())
                pieces.append(np.frombuffer(x.as_py(), enc))
                held += len(pieces[-1])
                if held >= BLOCK:
                    yield flush()
                    block, first, docs_in, pieces, held = block + 1, first + held, [], [], 0
        if pieces:
            yield flush()

    ordered.mapInArrow(run, FILE_SCHEMA).write.option("compression", "none").parquet(f"{out}/ids")


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary): decodes each block; start is the number of ids of all documents before."""
    limit, step, symbols, bits = spark.read.parquet(f"{out}/code").first()
    lengths = dict(zip(symbols, bits, strict=True))
    blocks = spark.read.schema(FILE_SCHEMA).parquet(f"{out}/ids")
    n = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)
    totals = blocks.groupBy("part").agg(F.sum(n).alias("n"))
    base = written(offsets(totals, "part", "n").select("part", "base"), "starts")  # a row a file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths, limit)
        for b in batches:
            for r in b.to_pylist():
                ends = np.cumsum(np.array(r["lengths"], np.int64))
                ids, at = code.decode(r["bits"], r["checkpoints"], int(ends[-1]), step), r["base"] + r["first"]
                for lo in range(0, len(ends), 2000):
                    e = ends[lo : lo + 2000]
                    s = np.concatenate([[ends[lo - 1] if lo else 0], e[:-1]])
                    cols = [pa.array(r["doc_ids"][lo : lo + 2000], pa.int64()), pa.array(at + s, pa.int64()), pa.array(e - s, pa.int64()), pa.array([ids[x:y].tobytes() for x, y in zip(s.tolist(), e.tolist(), strict=True)], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids"])

    return blocks.join(base, "part").select("doc_ids", "lengths", "bits", "checkpoints", "first", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), out)
    return read_token_files(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
