"""Repeated substrings by prefix-free parsing, distributed.

A rolling hash over 16 bytes triggers at its least value in each run of W places, so a text is cut into phrases of bounded
length that depend on nothing but the bytes around them. Each 400-byte window has one trigger, the one that its own
first W places give; equal windows have it at the same place. The dictionary holds each trigger's context once, by
hash, with its count; the parse is the list of (document, trigger). A window recurs if and only if its trigger's context
recurs around it, so it is enough to compare contexts in the dictionary:

1. Triggers whose probe (the bytes that all their windows share) occurs once have no recurring window.
2. Contexts that recur whole have all their windows covered.
3. What is left, the edges of repeats, is halved to blocks of BLOCK windows (their common bytes, their joint bytes), and only
   blocks on an edge go to single windows.

The suffix arrays of dictionary and parse are not built: only equality over 400 bytes matters here, and an order of
contexts would move 400 bytes a trigger where grouping by hash moves 16. Hashes of windows and contexts are taken together with the
probe's, 128 bits in all, so results are exact up to a collision of those.

The same parse over words instead of bytes, with windows of 51 words, finds the passages of over 50 words that other documents have too; its
columns follow the contract's, as many such passages are shorter than 400 bytes.

At scale: grouping is by hash with partial sums, hot contexts are joined by joins that adaptive execution splits. Texts are read three times, and
only those in which something was found are shuffled: a bitmap of bounded size tells them on the map side; where
it is full it lets too much through, never too little.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, bitmap_places, join_dealt_anew, maybe_in, table, written



class Units(NamedTuple):
    """What windows are made of: bytes in a unit, places of which the least hash is a trigger (a power of two), units in the rolling hash (so too)."""

    size: int
    w: int
    gram: int


BYTES, WORDS = Units(1, 256, 16), Units(8, 32, 4)
LENGTH = 400
#: Words of the least passage: over 50.
PASSAGE = 51
BLOCK = 32
SLICE = 1 << 20
TABLE = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)
NONE = -(1 << 63)


def triggers(text: bytes, length: int = LENGTH, units: Units = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triggers of the windows of `length` units: place, first and last start of a window that has it."""
    w, starts = units.w, len(text) // units.size - length + 1
    found: list[list[np.ndarray]] = [[], [], []]
    for at in range(0, max(starts, 0), SLICE):
        n = min(SLICE, starts - at)
        many = n + w - 1 + units.gram - 1
        h = TABLE[np.frombuffer(text, np.uint8, many, at)] if units.size == 1 else np.frombuffer(text, np.uint32, 2 * many, 8 * at)[::2]
        p, s = 0x9E3779B1, 1
        while s < units.gram:
            h = h[:-s] * np.uint32(p) + h[s:]
            p, s = p * p & 0xFFFFFFFF, 2 * s
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        top = (1 << 32) - 1
        # the rightmost of equal values is the least
        k = (h.astype(np.uint64) << np.uint64(32)) | np.arange(top, top - len(h), -1, dtype=np.uint64)
        s = 1
        while s < w:
            k = np.minimum(k[:-s], k[s:])
            s *= 2
        a = top - (k & np.uint64(top)).astype(np.int64)
        cut = np.flatnonzero(np.diff(a))
        lo = np.concatenate([[0], cut + 1])
        for got, new in zip(found, (a[lo], lo, np.append(cut, len(a) - 1)), strict=True):
            got.append(new + at)
    if not found[0]:
        return (np.zeros(0, np.int64),) * 3
    a, lo, hi = (np.concatenate(x) for x in found)
    cut = np.flatnonzero(np.diff(a))  # a trigger on both sides of a slice's end is one
    return a[np.append(cut, len(a) - 1)], lo[np.concatenate([[0], cut + 1])], hi[np.append(cut, len(a) - 1)]


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _words(text: str | None) -> bytes:
    """The hashes of a text's words, eight bytes each."""
    return b"".join(map(xxhash.xxh64_digest, _raw(text).split()))


HASH = xxhash.xxh3_64_intdigest


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, d, k): d and k name a row for the joins; rows equal in both are equal."""
    doc = F.col("doc_id").cast("long")
    return docs.select(doc.alias("doc_id"), "text", F.coalesce(doc, F.lit(NONE)).alias("d"), F.xxhash64("doc_id", "text").alias("k"))


def _contexts(keyed: DataFrame, length: int, units: Units) -> DataFrame:
    """The parse: (ph, xh, d, k, a, lo, hi), a row a trigger."""
    names = ["ph", "xh", "d", "k", "a", "lo", "hi"]
    probe, u, read = length - units.w + 1, units.size, _raw if units == BYTES else _words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ph, xh, rows, many = [], [], [], 0
            for t, d, k in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                text = read(t.as_py())
                a, lo, hi = triggers(text, length, units)
                # units that each window with the trigger holds, from the trigger on
                ph += [HASH(text[u * i : u * (i + probe)]) for i in a.tolist()]
                xh += [HASH(text[u * i : u * j], s) for i, j, s in zip(lo.tolist(), (hi + length).tolist(), (a - lo).tolist(), strict=True)]
                rows.append((np.full(len(a), d), np.full(len(a), k), a, lo, hi))
                many += len(a)
                if many > 50_000:
                    yield pa.RecordBatch.from_arrays([_signed(ph), _signed(xh), *(pa.array(np.concatenate(c), pa.int64()) for c in zip(*rows, strict=True))], names)
                    ph, xh, rows, many = [], [], [], 0
            if many:
                yield pa.RecordBatch.from_arrays([_signed(ph), _signed(xh), *(pa.array(np.concatenate(c), pa.int64()) for c in zip(*rows, strict=True))], names)

    return keyed.select("text", "d", "k").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _visit(keyed: DataFrame, listed: DataFrame, visit: Callable, schema: str, names: list[str], units: Units) -> DataFrame:
    """visit(text, d, k, list) -> rows, for the documents of listed (d, k, list). Only texts that the bitmap lets through are shuffled."""
    held, bits = bitmap(listed.select("k"))
    read = _raw if units == BYTES else _words

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(b.columns[:3], ["text", "d", "k"]).filter(pa.array(maybe_in(held.value, b.column(3), b.column(4))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for t, d, k, items in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                rows += visit(read(t.as_py()), d, k, items.as_py())
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    p, q = bitmap_places(bits)
    texts = keyed.select("text", "d", "k", p.alias("p"), q.alias("q")).mapInArrow(pick, "text string, d long, k long")
    return texts.join(listed, ["d", "k"]).select("text", "d", "k", "list").mapInArrow(run, schema)


def _s64(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def repeated_spans(keyed: DataFrame, length: int = LENGTH, units: Units = BYTES, across: bool = False) -> DataFrame:
    """(d, k, start, end): stretches of units whose windows of `length` all recur (across: in a document of another id or text); they may overlap."""
    u = units.size
    # 1: found once; 2: recurs
    n = (F.when(F.min("k") != F.max("k"), 2).otherwise(1) if across else F.count("*")).alias("n")
    parse = written(_contexts(keyed, length, units), "parse")
    probes = parse.groupBy("ph").agg(n).where("n > 1").select("ph")
    some = written(join_dealt_anew(parse, probes, ["ph"]), "contexts")
    first = F.min(F.struct("d", "k", "a", "lo", "hi")).alias("first")
    dictionary = written(some.groupBy("ph", "xh").agg(n, first), "dictionary")
    whole = join_dealt_anew(some, dictionary.where("n > 1").select("ph", "xh"), ["ph", "xh"]).select("d", "k", F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))
    # probes with a context that doesn't recur, and all their distinct contexts
    open_ = dictionary.where("n = 1").select("ph").distinct()
    lone = join_dealt_anew(some, dictionary.where("n = 1").select("ph", "xh"), ["ph", "xh"]).select("d", "k", "a", "lo", "hi", "ph", F.lit(1).alias("lone"))
    rest = lone.union(join_dealt_anew(dictionary.where("n > 1"), open_, ["ph"]).select("first.*", "ph", F.lit(0).alias("lone")))
    listed = written(rest.groupBy("d", "k").agg(F.collect_list(F.struct("a", "lo", "hi", "ph", "lone")).alias("list")), "listed")

    def blocks(text: bytes, d: int, k: int, items: list[dict]) -> list[tuple]:
        out = []
        for x in items:
            a = x["a"]
            for c in range((a - x["hi"]) // BLOCK, (a - x["lo"]) // BLOCK + 1):
                last = a - BLOCK * c  # the block's last start
                lo, hi = last - BLOCK + 1, last + length
                joint = _s64(HASH(text[u * lo : u * hi], c)) if lo >= 0 and u * hi <= len(text) else None
                out.append((x["ph"], c, _s64(HASH(text[u * last : u * (hi - BLOCK + 1)], c)), joint, d, k, a, max(lo, x["lo"]), min(last, x["hi"]), x["lone"]))
        return out

    names = ["ph", "c", "ih", "uh", "d", "k", "a", "lo", "hi", "lone"]
    cut = written(_visit(keyed, listed, blocks, ", ".join(f"{x} long" for x in names), names, units), "blocks")
    common = cut.groupBy("ph", "c", "ih").agg(n).where("n > 1").select("ph", "c", "ih")
    shared = written(join_dealt_anew(cut, common, ["ph", "c", "ih"]), "shared")
    joint = shared.where("uh is not null").groupBy("ph", "c", "uh").agg(n, F.min(F.struct("d", "k", "a")).alias("first"))
    judged = join_dealt_anew(shared, joint, ["ph", "c", "uh"], "left").withColumn("twin", F.coalesce(F.col("n") > 1, F.lit(False)))
    judged = written(judged.select(*names, "twin", F.coalesce((F.col("first") == F.struct("d", "k", "a")) | ~F.col("twin"), F.lit(True)).alias("leads")), "judged")
    end = F.col("a") - BLOCK * F.col("c")
    full = judged.where("twin and lone = 1").select("d", "k", (end - BLOCK + 1).alias("start"), (end + length).alias("end"))
    edges = judged.where("not twin and lone = 1").select("ph", "c", "ih").distinct()
    todo = join_dealt_anew(judged.where("leads"), edges, ["ph", "c", "ih"])
    mine = (~F.col("twin") & (F.col("lone") == 1)).cast("int")
    todo = written(todo.groupBy("d", "k").agg(F.collect_list(F.struct("a", "lo", "hi", "ph", mine.alias("mine"))).alias("list")), "todo")

    def singles(text: bytes, d: int, k: int, items: list[dict]) -> list[tuple]:
        return [(x["ph"], _s64(HASH(text[u * s : u * (s + length)], x["a"] - s)), d, k, s, x["mine"]) for x in items for s in range(x["lo"], x["hi"] + 1)]

    names = ["ph", "wh", "d", "k", "start", "mine"]
    one = written(_visit(keyed, todo, singles, ", ".join(f"{x} long" for x in names), names, units), "windows")
    twice = one.groupBy("ph", "wh").agg(n).where("n > 1").select("ph", "wh")
    found = join_dealt_anew(one.where("mine = 1"), twice, ["ph", "wh"]).select("d", "k", "start", (F.col("start") + length).alias("end"))
    return whole.union(full).union(found)


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal runs of bytes."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end), n_passages and n_passage_words.

    The last two count the maximal runs of words, and words, in stretches of PASSAGE words that a document of another id or text has too. Null and empty texts have no bytes and nothing to remove; so have texts shorter than `length`. Rows that are equal in
    id and text are documents like others, and so recur. Null ids keep their rows; an empty table gives no row;
    further columns are ignored. length must be 272 or more.
    """
    if length < BYTES.w + BYTES.gram:
        raise ValueError(f"length must be {BYTES.w + BYTES.gram} or more")
    keyed = _keyed(docs)
    spans = repeated_spans(keyed, length).withColumn("words", F.lit(False)).union(repeated_spans(keyed, PASSAGE, WORDS, True).withColumn("words", F.lit(True)))
    listed = written(spans.groupBy("d", "k").agg(F.collect_list(F.struct("words", "start", "end")).alias("list")), "spans")
    held, bits = bitmap(listed.select("k"))

    def done(doc: int | None, text: bytes, found: list[dict]) -> tuple:
        runs, passages = (merged([(x["start"], x["end"]) for x in found if x["words"] == words]) for words in (False, True))
        kept = hashlib.sha256()
        at = 0
        for a, b in runs:
            kept.update(text[at:a])
            at = b
        kept.update(text[at:])
        return doc, len(text), sum(b - a for a, b in runs), len(runs), kept.hexdigest(), [{"start": a, "end": b} for a, b in runs], len(passages), sum(b - a for a, b in passages)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int64(), pa.int64()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "n_passages", "n_passage_words"]

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = maybe_in(held.value, b.column(4), b.column(5))
            rows = [(i, *[None] * 7) if h else done(i, _raw(t.as_py()), []) for i, t, h in zip(b.column(0).to_pylist(), b.column(1), hit.tolist(), strict=True)]
            texts = [t.as_py() if h else None for t, h in zip(b.column(1), hit.tolist(), strict=True)]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), b.column(2), b.column(3)], [*names, "text", "d", "k"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["kept_sha256"] is None:
                    rows.append(done(r["doc_id"], _raw(r["text"]), r["list"] or []))
                else:
                    rows.append(tuple(r[c] for c in names))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, n_passages long, n_passage_words long"
    p, q = bitmap_places(bits)
    ready = keyed.select("doc_id", "text", "d", "k", p.alias("p"), q.alias("q")).mapInArrow(prepare, schema + ", text string, d long, k long")
    return ready.join(listed, ["d", "k"], "left").select(*names, "text", "list").mapInArrow(finish, schema)


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")
