"""Tokens, scores, rankings and marks of reports' own chunks, for an Arrow batch of reports at a time, in Python workers.

Spark interprets a lambda a node at a time; here a batch's chunks stand in flat arrays, `of` says whose each is, and numbers stand for tokens. Scores, orders and ties are those of
the long forms in retrieval and assembly. Sums are made in an order of their own values, so a score doesn't depend on the batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How many reports are worked on at a time: what a worker holds beside Spark's batch.
ROWS = 2000
_MICRO = Decimal("0.000001")
# a byte's class: letters, digits, others
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_KEPT = re.compile(r"[^a-z0-9.%\-\x00]+")
_BROKEN = re.compile("2019(?<=[a-z]2019)(?=[a-z])")
_BLANKS = bytes(i if not i or _CLASS[i] or chr(i) in ".%-" else ord(" ") for i in range(256))


def flat(a: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists, and the row of each; null lists have none."""
    return a.flatten(), np.repeat(np.arange(len(a)), pa.compute.fill_null(pa.compute.list_value_length(a), 0).to_numpy())


def listed(values: pa.Array, of: np.ndarray, rows: int) -> pa.Array:
    """The values as a column of lists, the other way round of flat()."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate([[0], np.bincount(of, minlength=rows)])), pa.int32()), values)


def in_column(run: Callable[..., pa.Array], kind: str) -> Callable[..., Column]:
    """run(arrays of some rows) -> array, as a function of Columns."""

    def batch(*columns: pa.Array) -> pa.Array:
        return pa.concat_arrays([run(*[c.slice(at, ROWS) for c in columns]) for at in range(0, max(len(columns[0]), 1), ROWS)])

    return F.arrow_udf(batch, kind)


def in_batches(rows: DataFrame, run: Callable[..., dict], schema: str) -> DataFrame:
    """run(each column's array of some rows) -> columns of `schema`, over all rows."""

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in given:
            for at in range(0, b.num_rows, ROWS):
                yield pa.RecordBatch.from_pydict(run(*b.slice(at, ROWS).columns))

    return rows.mapInArrow(batches, schema)


def integers(a: pa.Array) -> list[int | None]:
    return a.to_pylist() if a.null_count else a.to_numpy(zero_copy_only=False).tolist()


def strings(a: pa.Array) -> list[str]:
    return pa.compute.fill_null(a, "").to_numpy(zero_copy_only=False).tolist()


def _joined(texts: list[str]) -> str:
    """All texts in lower case, parted by NUL; a NUL within a text parts words as a blank does."""
    s = "\x00".join(texts)
    return (s if s.count("\x00") < max(len(texts), 1) else "\x00".join(t.replace("\x00", " ") for t in texts)).lower()


def normed(texts: list[str]) -> list[str]:
    """text.norm_corpus() of each text."""
    if not texts:
        return []
    s = _joined(texts)
    s = _BROKEN.sub("'", s) if "2019" in s else s
    s = s.encode().translate(_BLANKS).decode() if s.isascii() else _KEPT.sub(" ", s)
    while "  " in s:
        s = s.replace("  ", " ")
    return [t.strip(" ") for t in s.split("\x00")]


def tokens(texts: list[str], signed: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The tokens of text.bm25_tokens(), or of text.signed_tokens(), of all texts, and the text of each; in no order."""
    b = np.frombuffer(f"\x00{_joined(texts)}\x00".encode(), np.uint8)
    kind = _CLASS[b]
    dots = np.flatnonzero(b == ord("."))
    dots = dots[(kind[dots - 1] == 2) & (kind[dots + 1] == 2)]
    if len(dots):
        # of a chain of points between digits every other one joins them: 1.2.3 reads 1.2 and 3
        before = np.cumsum(kind == 2)[dots]
        apart = np.concatenate([[True], np.diff(before) != np.diff(dots) - 1])
        order = np.arange(len(dots))
        kind[dots[(order - np.maximum.accumulate(np.where(apart, order, 0))) % 2 == 0]] = 2
    # the stretches of a class; a NUL stands at both ends
    turns = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    of_turn = kind[turns]
    letters, numbers = ((turns[at], turns[at + 1]) for at in (np.flatnonzero(of_turn == 1), np.flatnonzero(of_turn == 2)))
    if signed:
        start, end = numbers
        spans = [letters, (start - np.isin(b[start - 1], [ord("-"), ord("+")]), end + (b[end] == ord("%")))]
    else:
        single = np.flatnonzero((b == ord("%")) | (b == ord("$")))
        spans = [letters, numbers, (single, single + 1)]
    start, end = np.concatenate([s for s, _ in spans]), np.concatenate([e for _, e in spans])
    ends = np.cumsum(end - start)
    held = b[np.arange(ends[-1] if len(ends) else 0) + np.repeat(end - ends, end - start)]
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(held)])
    # the first NUL stands before the first text
    return words, np.cumsum(b == 0, dtype=np.int32)[start].astype(np.int64) - 1


def numbered(*words: pa.Array) -> list[np.ndarray]:
    """A number for each token, equal ones alike over all arrays."""
    codes = pa.concat_arrays(words).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(codes, np.cumsum([len(w) for w in words])[:-1])


def rounded(x: np.ndarray) -> np.ndarray:
    """Six decimals as Spark rounds them: halves of the shortest digits up."""
    y = x * 1e6
    n = np.floor(y + 0.5)
    out = n / 1e6
    for i in np.flatnonzero((np.abs(y - n) > 0.499999) | (np.abs(y) > 1e9)).tolist():
        out[i] = float(Decimal(repr(float(x[i]))).quantize(_MICRO, ROUND_HALF_UP))
    return out


def bm25_scores(words: np.ndarray, chunk: np.ndarray, of: np.ndarray, asked: np.ndarray, whose: np.ndarray, rows: int, k1: float = 1.5, b: float = 0.75, eps: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
    """bm25() of reports' own chunks: a score for each chunk, and the share of the question's distinct tokens that it has. words and asked: numbers of tokens, with the chunk and the report of each."""
    v = 1 + max(words.max(initial=0), asked.max(initial=0))
    size, n = np.bincount(chunk, minlength=len(of)), np.bincount(of, minlength=rows)
    avgdl = np.bincount(of, size, rows) / np.maximum(n, 1)
    pairs, tf = np.unique(chunk * v + words, return_counts=True)
    at = pairs // v
    key = of[at] * v + pairs % v
    terms, df = np.unique(key, return_counts=True)
    # words that as many chunks of a report have are of one idf
    row = terms // v
    most = 1 + df.max(initial=0)
    kinds, alike = np.unique(row * most + df, return_counts=True)
    idf_of = lambda n, df: np.log(n - df + 0.5) - np.log(df + 0.5)
    mean = np.bincount(kinds // most, alike * idf_of(n[kinds // most], kinds % most), rows) / np.maximum(np.bincount(row, minlength=rows), 1)
    q, times = np.unique(whose * v + asked, return_counts=True)
    found = _place(terms, q)
    known = np.flatnonzero(found >= 0)
    weight = np.zeros(len(q))
    raw = idf_of(n[q[known] // v], df[found[known]])
    weight[known] = times[known] * np.where(raw < 0, eps * mean[q[known] // v], raw)
    j = _place(q, key)
    hit = np.flatnonzero(j >= 0)
    at, tf, w = at[hit], tf[hit], weight[j[hit]]
    part = w * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[at] / avgdl[of[at]]))
    order = np.lexsort((part, at))
    score = rounded(np.bincount(at[order], part[order], len(of)))
    return score, np.bincount(at, minlength=len(of)) / np.maximum(np.bincount(q // v, minlength=rows), 1)[of]


def _place(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key in the ordered known ones; -1: not there."""
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    return np.where(known[at] == keys, at, -1) if len(known) else np.full(len(keys), -1)


def id_order(ids: pa.Array) -> np.ndarray:
    """Numbers in the order of the ids."""
    return pa.compute.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of each report's k greatest scores, ties by id, and their ranks from 1."""
    order = np.lexsort((ids, -scores, of))
    whose = of[order]
    rank = np.arange(len(order)) - np.searchsorted(whose, whose) + 1
    return order[rank <= k], rank[rank <= k]


def fused_best(share: np.ndarray, scores: np.ndarray, ids: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """fused_rerank() of reports' own chunks: share of the question's tokens, and the score before."""
    return best(rounded(share + 0.05 * scores), ids, of, k)


def z_scores(v: np.ndarray, of: np.ndarray, rows: int) -> np.ndarray:
    """Each value's distance from its report's mean in population deviations; a deviation below 1e-8: 0."""
    n = np.maximum(np.bincount(of, minlength=rows), 1)
    off = v - (np.bincount(of, v, rows) / n)[of]
    spread = np.sqrt(np.bincount(of, off * off, rows) / n)[of]
    flat = spread < 1e-8
    return np.where(flat, 0.0, off / np.where(flat, 1.0, spread))


def score_fused(a: np.ndarray, b: np.ndarray, has_b: np.ndarray, ids: np.ndarray, of: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """score_fusion() of the k best by each of two scores of reports' own chunks (has_b: whether the second has one): the places of the k best by the sum of both z-scores, in order of place, and that sum."""
    in_a, in_b, there = np.zeros(len(of), bool), np.zeros(len(of), bool), np.flatnonzero(has_b)
    in_a[best(a, ids, of, k)[0]] = True
    in_b[there[best(b[there], ids[there], of[there], k)[0]]] = True
    some = np.flatnonzero(in_a | in_b)
    z = lambda v, held: z_scores(np.where(held, v, 0.0)[some], of[some], rows)
    total = rounded(z(a, in_a) + z(b, in_b))
    top = np.sort(best(total, ids[some], of[some], k)[0])
    return some[top], total[top]


def dealt(lists: pa.Array, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What stands in each report's list at a chunk's place, and whether something does."""
    values, whose = flat(lists)
    known = np.append(~np.array(values.is_null()), False)
    values = np.append(pa.compute.fill_null(values, 0.0).to_numpy(), 0.0)
    n, chunks = np.bincount(whose, minlength=len(lists)), np.bincount(of, minlength=len(lists))
    place = np.arange(len(of)) - (np.cumsum(chunks) - chunks)[of]
    at = np.where(place < n[of], (np.cumsum(n) - n)[of] + place, len(values) - 1)
    return values[at], known[at]


def gold_flags(texts: list[str], ordinals: list[int | None], of: np.ndarray, golds: list[str], whose: np.ndarray, least: int = 12) -> np.ndarray:
    """gold_by_ordinal() of reports' own chunks and gold texts: a flag for each chunk."""
    own: dict[int, tuple[set[int], list[str]]] = {}
    for i, g in zip(whose.tolist(), normed(golds), strict=True):
        named, long = own.setdefault(i, (set(), []))
        if g.isdigit():
            named.add(int(g))
        if len(g) >= least:
            long.append(g)
    none, flags = (set(), []), []
    for t, o, i in zip(normed(texts), ordinals, of.tolist(), strict=True):
        named, long = own.get(i, none)
        hit = o in named
        for g in () if hit else long:
            hit = hit or g in t or t in g
        flags.append(hit)
    return np.array(flags, bool)


def words_used(words: np.ndarray, rank: np.ndarray, of: np.ndarray, rows: int, budget: int) -> np.ndarray:
    """word_budget()'s total of each report, over words with their ranks."""
    used, kept = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for r in range(1, rank.max(initial=0) + 1):
        at, w = of[rank == r], words[rank == r]
        fits = ~((used[at] >= budget) | ((kept[at] > 0) & (used[at] + w > budget)))
        used[at[fits]] += w[fits]
        kept[at[fits]] += 1
    return used


def recalled(texts: list[str], gold: np.ndarray, of: np.ndarray, places: np.ndarray, rank: np.ndarray, rows: int) -> dict[str, pa.Array]:
    """Of each report with chunks: how many, whether some are gold, the first rank of a gold one, and the words of eight within 700."""
    n = np.bincount(of, minlength=rows)
    some = np.bincount(of[gold], minlength=rows) > 0
    first = np.full(rows, np.iinfo(np.int32).max, np.int32)
    np.minimum.at(first, of[places[gold[places]]], rank[gold[places]].astype(np.int32))
    near = places[rank <= 8]
    used = words_used(np.array([texts[i].count(" ") + 1 for i in near.tolist()], np.int64), rank[rank <= 8], of[near], rows, 700)
    has = n > 0
    return {"n": pa.array(n[has], pa.int32()), "some": pa.array(some[has]), "first": pa.array(first[has], mask=first[has] == np.iinfo(np.int32).max), "used": pa.array(used[has])}
