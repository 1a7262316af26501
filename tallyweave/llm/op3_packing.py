"""Hierarchical multi-length packing.

Each document is its ids plus an end id. Within a packing unit (a partition of the input) documents are routed to
tiers of context size: whole windows of the longest tier are cut from a document first, what is left goes to the
smallest tier that holds it. Each tier is packed best-fit; the gaps of long windows are filled from the shorter
tiers, longest first, cutting a document only where a gap remains that no whole one fills; sequences of the shorter
tiers are closed the same way. Only a unit's last sequence can stay short. Sequences of a tier are dealt to step groups
in turn, so that each group gets like numbers of tokens of each size.

At scale: one pass, no shuffle; a unit's state is bounded by `unit_tokens`, after which the packer closes its
sequences and starts anew, so memory doesn't grow with the partition.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import Encoder, vocabulary_path

TIERS = (256, 512, 1024, 2048)
END = 1
UNIT_TOKENS = 4_000_000
GROUPS = 8


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS, groups: int = GROUPS) -> list[tuple[int, int, int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset, tier, step group) of documents of the given lengths.

    Every id lies in exactly one piece; a sequence holds at most its tier's ids, and is full but for the last one.
    """
    top = tiers[-1]
    full, short = [], {t: [] for t in tiers}  # short[t]: sorted (length, document, start)
    for d, n in enumerate(lengths):
        cut = n - n % top
        full += [(d, s) for s in range(0, cut, top)]
        if n > cut:
            short[next(t for t in tiers if t >= n - cut)].append((n - cut, d, cut))
    for rows in short.values():
        rows.sort()

    def best(room: int, limit: int) -> tuple[int, int, int] | None:
        """Takes the longest piece of `room` or less from the tiers up to limit."""
        for t in reversed(tiers):
            if t <= limit and short[t] and (i := bisect_left(short[t], (room + 1,))):
                return short[t].pop(i - 1)
        return None

    def cut(room: int, limit: int) -> tuple[int, int, int] | None:
        """Cuts `room` ids off the shortest longer piece."""
        for t in tiers:
            if t <= limit and short[t] and (i := bisect_left(short[t], (room + 1,))) < len(short[t]):
                n, d, s = short[t].pop(i)
                left = n - room
                insort(short[next(x for x in tiers if x >= left)], (left, d, s + room))
                return room, d, s
        return None

    out, seq, dealt = [], 0, dict.fromkeys(tiers, 0)

    def close(pieces: list[tuple[int, int, int]], tier: int) -> None:
        nonlocal seq
        at, group = 0, dealt[tier] % groups
        dealt[tier] += 1
        for n, d, s in pieces:
            out.append((d, s, n, seq, at, tier, group))
            at += n
        seq += 1

    for d, s in full:
        close([(top, d, s)], top)
    for tier in reversed(tiers):  # the longest tier first: it fills its gaps from the shorter ones
        while short[tier]:
            pieces, room = [], tier
            while room and (got := best(room, tier) or cut(room, tier)):
                pieces.append(got)
                room -= got[0]
            used = tier - room
            if room and used > tiers[0]:
                # nothing is left to fill with: fill a smaller window exactly, and put the rest back for windows below
                tier_now = max(t for t in tiers if t <= used)
                room, kept = tier_now, []
                for n, d, s in pieces:
                    if take := min(n, room):
                        kept.append((take, d, s))
                        room -= take
                    if n > take:
                        insort(short[next(x for x in tiers if x >= n - take)], (n - take, d, s + take))
                close(kept, tier_now)
            else:
                close(pieces, tier)
    return out


def packed(docs: DataFrame, path: str | None = None, end: int = END, tiers: tuple[int, ...] = TIERS, unit_tokens: int = UNIT_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, tier, step_group.

    Null and empty texts have the end id only. Null ids keep their rows; repeated rows are packed each for itself; an
    empty table gives no row; further columns are ignored. sequence_id is unique, not gapless.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, unit = Encoder.of_worker(path), 0
        ids: list[np.ndarray] = []
        doc: list[int | None] = []
        part, tokens = 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            pieces = pack([len(x) for x in ids], tiers)
            for at in range(0, len(pieces), 1000):
                rows = pieces[at : at + 1000]
                base = (part << 40) + (unit << 24)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc[p[0]] for p in rows], pa.int64()),
                        pa.array([p[1] for p in rows], pa.int64()),
                        pa.array([p[2] for p in rows], pa.int64()),
                        pa.array([ids[p[0]][p[1] : p[1] + p[2]].astype("<u4").tobytes() for p in rows], pa.binary()),
                        pa.array([len(ids[p[0]]) for p in rows], pa.int64()),
                        pa.array([base + p[3] for p in rows], pa.int64()),
                        pa.array([p[4] for p in rows], pa.int64()),
                        pa.array([p[5] for p in rows], pa.int32()),
                        pa.array([p[6] for p in rows], pa.int32()),
                    ],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"],
                )

        for b in batches:
            for i, t, p in zip(b.column(0), b.column(1), b.column(2), strict=True):
                part = p.as_py()
                got = enc.ids(t.as_py())
                ids.append(np.append(got, np.array([end], got.dtype)))
                doc.append(i.as_py())
                tokens += len(ids[-1])
                if tokens >= unit_tokens:
                    yield from flush()
                    ids, doc, tokens, unit = [], [], 0, unit + 1
        if ids:
            yield from flush()
        enc.forget()

    return docs.select(F.col("doc_id").cast("long"), "text", F.spark_partition_id().alias("part")).mapInArrow(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group int"
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the packed table: ids_crc32 in place of the ids."""
    return packed(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")
