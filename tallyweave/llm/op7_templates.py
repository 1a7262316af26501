"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders (a run of names is one), other words lose case and edge
punctuation. Windows of eight template tokens of documents and benchmark are joined by hash. Hits in
order make an occurrence: a run, a diagonal, or the longest chain that goes on in both texts, as a window can stand more than once in
an item. It counts if it covers half the item's windows and its slots are consistent: a value of the
benchmark's slots stands for one value of the document's. So re-parameterised questions are caught as well as copies.
Windows of eight words as they are, without placeholders, are joined beside them: so copies of items that are mostly
placeholders count, and copies whose first word is no name in the item but one in the document.

At scale: documents are read once, whatever the size of the benchmark, and never shuffled; a bitmap of bounded size lets through the windows that the
benchmark may hold, with the values in their slots. These hits and the benchmark's windows are hash-joined as tables (adaptive execution splits a hot
window), grouped by document and item, and checked. Only sizes of windows, sixteen at most, reach the driver.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, join_dealt_anew, plain_maybe_in, plain_places, table, written

WINDOW = 8
COVER = 0.5
#: A window needs so many tokens that aren't placeholders.
LITERALS = 4
MEMO = 150_000
EDGE = "\"'`.,;:!?()[]{}<>*_~«»“”‘’…-–—"
NUMBER = re.compile(r"[+\-]?[$€£¥]?[+\-]?\d[\d.,/:]*(?:%|st|nd|rd|th)?|[$€£¥]?\d[\d.,]*[km]?", re.I)
MEASURE = re.compile(r"([+\-]?[$€£¥]?\d[\d.,/]*)([a-zµ°]+\d?)", re.I)
# Units of measure and money that follow a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons oz lb lbs pound pounds ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years c f k kb mb gb tb hz khz mhz ghz w kw mw v kv a ma j kj cal kcal mph kph percent percentage cent cents dollar dollars euro euros usd eur gbp yen million billion trillion thousand hundred dozen".split()
)
BASE = np.uint64(0x9E3779B97F4A7C15)
# flags in the low bits of a word's number
NUM, CAP, STOP, UNIT, NUMUNIT = 1, 2, 4, 8, 16
MASK = np.uint64(31)
SLOT = {NUM: np.uint64(0x1D8E4E27C47D124F << 5 & (2**64 - 1)), CAP: np.uint64(0x2545F4914F6CDD1D << 5 & (2**64 - 1)), UNIT: np.uint64(0x3C6EF372FE94F82B << 5 & (2**64 - 1)), NUMUNIT: np.uint64(0x4528E69F97F4A7C5 << 5 & (2**64 - 1))}


class Words(dict):
    """word -> 59 bits of the hash of its bare lower form, and flags."""

    def __missing__(self, word: str) -> int:
        bare = word.strip(EDGE)
        flags = STOP if word.rstrip("\"')]}»”’")[-1:] in tuple(".!?:") else 0
        low = bare.lower()
        if NUMBER.fullmatch(bare):
            flags |= NUM
        elif (m := MEASURE.fullmatch(bare)) and m[2].lower() in UNITS:
            flags |= NUMUNIT
        else:
            if low in UNITS:
                flags |= UNIT
            if len(bare) > 1 and bare[0].isupper() and not bare.isupper():
                flags |= CAP
        value = (xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")) << 5 & (2**64 - 1)) | flags
        if len(self) >= MEMO:
            self.clear()
        self[word] = value
        return value


def template(text: str | None, memo: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Template tokens, whether each is a slot, the place of its first word, the words, and the words' hashes."""
    words = (text or "").split()
    v = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    flags = (v & MASK).astype(np.uint8)
    plain = v & ~MASK
    token = plain.copy()
    if len(words):
        after = np.empty(len(words), bool)  # starts a sentence
        after[0] = True
        after[1:] = flags[:-1] & STOP > 0
        num = flags & NUM > 0
        name = (flags & CAP > 0) & ~after
        unit = (flags & UNIT > 0)
        unit[0] = False
        unit[1:] &= num[:-1]
        slot = num | name | unit | (flags & NUMUNIT > 0)
        if slot.any():
            token[num], token[name], token[unit], token[flags & NUMUNIT > 0] = SLOT[NUM], SLOT[CAP], SLOT[UNIT], SLOT[NUMUNIT]
            keep = np.ones(len(words), bool)
            keep[1:] = ~(name[1:] & name[:-1])
            at = np.flatnonzero(keep)
            return token[at], slot[at], at, words, plain
        return token, slot, np.arange(len(words)), words, plain
    return token, np.zeros(0, bool), np.zeros(0, np.int64), words, plain


def windows(token: np.ndarray, slot: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of k template tokens, and which of them have enough plain words."""
    n = len(token) - k + 1
    if n <= 0 or k <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h = np.full(n, np.uint64(k))
    for j in range(k):
        h = h * BASE + token[j : j + n]
    h ^= h >> np.uint64(29)
    slots = np.concatenate([[0], np.cumsum(slot)])
    return h, slots[k : k + n] - slots[:n] <= max(0, k - min(LITERALS, k))


TEMPLATE, PLAIN = 0, 1
#: What tells the hashes of the two kinds of windows apart.
KIND = (np.uint64(0), np.uint64(0x5851F42D4C957F2D))


def values(slot: np.ndarray, place: np.ndarray, words: list[str]) -> list[str | None]:
    """What stands in each token's slot; None for a plain word."""
    ends = np.append(place[1:], len(words))[: len(place)].tolist()
    return [" ".join(w.strip(EDGE).lower() for w in words[a:b]) if s else None for s, a, b in zip(slot.tolist(), place.tolist(), ends, strict=True)]


def item_windows(text: str, memo: Words, k: int = WINDOW) -> list[tuple]:
    """(kind, length of a window, number of windows, tokens, hash, place, [(offset, value)] of the slots in it) for each window of a benchmark item."""
    token, slot, place, words, plain = template(text, memo)
    firsts = dict.fromkeys(place[slot].tolist(), "")
    out = []
    for kind, tokens, slots, said in ((TEMPLATE, token, slot, values(slot, place, words)), (PLAIN, plain, np.zeros(len(plain), bool), [firsts.get(i) for i in range(len(plain))])):
        size = min(k, len(tokens))
        h, ok = windows(tokens, slots, size)
        at = np.flatnonzero(ok).tolist()
        out += [(kind, size, len(at), len(tokens), int(h[q] ^ KIND[kind]), q, [(j, said[q + j]) for j in range(size) if said[q + j] is not None]) for q in at]
    return out


def text_windows(text: str | None, memo: Words, sizes: list[tuple[int, int]], maybe) -> list[tuple]:
    """(hash, place, [(offset, value)]) for each window of a text whose hash `maybe` lets through; sizes are those of the benchmark, by kind."""
    token, slot, place, words, plain = template(text, memo)
    none, said, out = np.zeros(len(plain), bool), None, []
    for kind, size in sizes:
        h, ok = windows(token, slot, size) if kind == TEMPLATE else windows(plain, none, size)
        h = h ^ KIND[kind]
        at = np.flatnonzero(ok & maybe(h)).tolist() if len(h) else []
        if at and kind == TEMPLATE and said is None:
            said = values(slot, place, words)
        out += [(int(h[p]), p, [(j, said[p + j]) for j in range(size) if said[p + j] is not None] if kind == TEMPLATE else []) for p in at]
    return out


def verdict(hits: list[tuple], cover: float = COVER) -> tuple[int, int, int, int] | None:
    """(windows found, windows of the item, slots, slots with another value) if the text holds the item.

    hits: (kind, length of a window, number of windows, tokens, p, q, the item's slots, the text's slots), of one text and item.
    """
    best = None
    found = {(h[4], h[5]): h for h in hits if h[0] == TEMPLATE}
    if found:
        _, k, total, size = next(iter(found.values()))[:4]
        for run in alignments(list(found), size):
            n = len({q for _, q in run})
            if n < cover * total or best and n <= best[0]:
                continue
            pairs = {}
            for p, q in run:
                theirs = dict(found[p, q][7])
                pairs |= {q + j: (mine, theirs[j]) for j, mine in found[p, q][6]}
            first: dict[str, str] = {}
            clash = sum(first.setdefault(a, b) != b for a, b in pairs.values())
            if 3 * clash <= len(pairs) - len(first):
                best = (n, total, len(pairs), sum(a != b for a, b in pairs.values()))
    found = {(h[4], h[5]): h for h in hits if h[0] == PLAIN}
    if found and not best:
        _, k, total, size = next(iter(found.values()))[:4]
        run = max(alignments(list(found), size), key=lambda run: len({q for _, q in run}))
        n = len({q for _, q in run})
        if n >= cover * total:
            best = (n, total, len({q + j for p, q in run for j, _ in found[p, q][6]}), 0)
    return best


def alignments(found: list[tuple[int, int]], size: int) -> Iterator[list[tuple[int, int]]]:
    """Runs in order of the text; where those can cut a copy, as a window stands more than once, diagonals and longest chains too."""
    runs = list(occurrences(found, size))
    yield from runs
    if len(runs) == 1 and len({p for p, _ in found}) == len({q for _, q in found}) == len(found):
        return
    diagonals: dict[int, list[tuple[int, int]]] = {}
    for p, q in sorted(found):
        diagonals.setdefault(p - q, []).append((p, q))
    yield from diagonals.values()
    near: list[tuple[int, int]] = []
    for p, q in sorted(found, key=lambda x: (x[0], -x[1])):
        if near and p - near[-1][0] > size:
            yield chain(near)
            near = []
        near.append((p, q))
    yield chain(near)


def chain(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest chain of hits in which both places grow; found is in order of p, and for one p of falling q."""
    ends: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for i, (_, q) in enumerate(found):
        at = bisect_left(ends, q)
        before.append(last[at - 1] if at else -1)
        ends[at : at + 1], last[at : at + 1] = [q], [i]
    out, i = [], last[-1]
    while i >= 0:
        out.append(found[i])
        i = before[i]
    return out[::-1]


def occurrences(found: list[tuple[int, int]], size: int) -> Iterator[list[tuple[int, int]]]:
    """Hits in order of the text, cut where the item begins again or a gap is longer than the item."""
    run: list[tuple[int, int]] = []
    for p, q in sorted(found):
        if run and (q < run[-1][1] or p - run[-1][0] > size):
            yield run
            run = []
        run.append((p, q))
    yield run


SAID = "array<struct<at:int,said:string>>"


def _hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(r, doc_id, k, j, item_id, n_windows, item_windows, n_slots, n_changed): r numbers the rows of docs, k and j are hashes of id and text."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, names = Words(), ["item_id", "number", "kind", "size", "total", "tokens", "k", "q", "mine"]
        for b in batches:
            rows = [(i.as_py(), n.as_py(), *w) for i, n, t in zip(b.column(0), b.column(1), b.column(2), strict=True) if t.as_py() is not None for w in item_windows(t.as_py(), memo)]
            yield _batch(rows, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.uint64(), pa.int64(), SLOTS], names)

    asked = benchmark.select(F.col("item_id").cast("long"), F.monotonically_increasing_id().alias("number"), "text")
    asked = written(asked.mapInArrow(items, f"item_id long, number long, kind int, size int, total long, tokens long, k long, q long, mine {SAID}"), "items")
    sizes = sorted((r[0], r[1]) for r in asked.select("kind", "size").distinct().collect())
    held, bits = bitmap(asked.select("k").distinct(), 64, plain_places)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, names = Words(), ["r", "doc_id", "k", "j", "h", "p", "theirs"]
        maybe = lambda h: plain_maybe_in(held.value, bits, h)
        for b in batches:
            rows = [(r, i, k, j, *w) for r, i, k, j, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for w in text_windows(t, memo, sizes, maybe)]
            yield _batch(rows, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.uint64(), pa.int64(), SLOTS], names)

    keyed = docs.select(F.monotonically_increasing_id().alias("r"), F.col("doc_id").cast("long"), *_keys(), "text")
    found = written(keyed.mapInArrow(texts, f"r long, doc_id long, k long, j long, h long, p long, theirs {SAID}"), "hits")
    both = join_dealt_anew(found.withColumn("w", F.col("h")).drop("h"), asked.withColumnsRenamed({"k": "w"}), ["w"])
    pairs = both.groupBy("r", "number").agg(*[F.first(c).alias(c) for c in ("doc_id", "k", "j", "item_id")], F.collect_list(F.struct("kind", "size", "total", "tokens", "p", "q", "mine", "theirs")).alias("all"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = lambda x: [(s["at"], s["said"]) for s in x]
        for b in batches:
            rows = []
            for *ids, every in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got = verdict([(h["kind"], h["size"], h["total"], h["tokens"], h["p"], h["q"], slots(h["mine"]), slots(h["theirs"])) for h in every])
                if got:
                    rows.append((*ids, *got))
            yield _batch(rows, [pa.int64()] * 9, ["r", *FOUND[:1], "k", "j", *FOUND[1:]])

    columns = ["r", "doc_id", "k", "j", *FOUND[1:]]
    return pairs.select("r", "doc_id", "k", "j", "item_id", "all").mapInArrow(check, ", ".join(f"{c} long" for c in columns))


SLOTS = pa.list_(pa.struct([("at", pa.int32()), ("said", pa.string())]))
FOUND = ["doc_id", "item_id", "n_windows", "item_windows", "n_slots", "n_changed"]


def _keys() -> list:
    return [F.xxhash64("doc_id", "text").alias("k"), F.xxhash64(F.lit(2), "text", "doc_id").alias("j")]


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    slots = lambda c: [[{"at": a, "said": s} for a, s in x] for x in c]
    arrays = [pa.array(slots(c) if t == SLOTS else c, t) for c, t in zip(cols, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([a.view(pa.int64()) if a.type == pa.uint64() else a for a in arrays], names)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of docs and item that it holds: doc_id, item_id, n_windows, item_windows, n_slots, n_changed.

    Null and empty texts hold nothing; items that are null match nothing. An item found only by its words as they are has its word
    windows counted instead, and no slot changed. Items shorter than a window are matched whole. Repeated rows of docs give repeated rows; items with equal text each give a
    row. Null ids keep their rows. An empty table on either side gives no row; further columns are ignored.
    """
    return _hits(docs, benchmark).select(*FOUND)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item of the benchmark, all columns as they were.

    Null and empty texts stay, as do all rows where the benchmark is empty; repeated rows are judged alike; null ids keep their rows; an empty table gives no row.
    """
    gone = written(_hits(docs, benchmark).select("k", "j").distinct(), "contaminated")
    named = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)] + [*_keys()])
    stay = named.join(gone, ["k", "j"], "left_anti")
    return stay.select([F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op7_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
