"""Phrase collocations by SETM: relations of occurrences, kept sorted and joined with themselves at the next place.

The relation of length one holds each document's words as (place, id) in order of place; pieces are a place apart, so places follow each other only
within a piece. For each further length: (1) merge-join: occurrences at places p and p + 1 make one of the next length; (2) group-count: short hashes of pairs
are counted first, packed, so that rare pairs, most of all, cost a few bytes; then the pairs of ids that may be frequent, exactly: partial counts per task, then their sums, of which those of LEAST or more are the frequent groups; (3) semi-join: occurrences of frequent groups only
are written as the next relation. The ids of a document's occurrences stay in one row, sorted, so the merge-join needs no shuffle and the relation is
written as Parquet arrays.

The semi-join asks a broadcast bitmap of bounded size, which lets a few infrequent groups through and never stops a frequent one; what it lets
through can't become a result, since counts are exact and both parts of a frequent group are frequent and joined by id to its name. Ids are hashes of 63 bits,
groups are counted by two of them.

At scale: texts are read once; partial counts are what is shuffled; a frequent group carries the counts of all its beginnings and ends, so that scores need no
further join. A relation is deleted when the next one is written, and shuffle files are
released as it goes, so the disk holds one length at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bitmap, join_dealt_anew, plain_maybe_in, plain_places, release, table, written

LEAST, LONGEST, TOP = 100, 5, 2000
_LOWER = {**{b: b for b in range(256)}, **{b: b + 32 for b in range(65, 91)}, **{b: 10 for b in b".,;:!?\x0a\x0b\x0c\x0d"}, 9: 32}
PLAIN = bytes(_LOWER[b] for b in range(256))
BLANK, BREAK = -1, -2
#: Bits of a pair's short hash, whole bytes.
SHORT = 48
#: Distinct words that a task remembers, and occurrences that it counts, before it passes counts on; occurrences in a piece of its output; rows of its input looked at together.
MEMO, HELD, PIECE, ROWS = 300_000, 4_000_000, 500_000, 1_000


class Ids(dict):
    """Word -> id within a language."""

    def __init__(self, lang: str) -> None:
        super().__init__({b"": BLANK, b"\n": BREAK})
        self.seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))

    def __missing__(self, word: bytes) -> int:
        self[word] = xxhash.xxh3_64_intdigest(word, self.seed) >> 1
        return self[word]


def pair_id(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Id of the group that has p at a place and q at the next."""
    x = p.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + q.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return (x >> np.uint64(1)).astype(np.int64)


def _lists(ends: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


WORD = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))


def occurrences(docs: DataFrame) -> DataFrame:
    """The first relation: (at, id) arrays a document; beside it rows of (lang, words) with a task's counts."""

    def counts(lang: str, ids: Ids, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        # in order, so that neighbours are alike and pack well
        words = sorted(w for w, i in ids.items() if i >= 0)
        n = n[np.searchsorted(found, [ids[w] for w in words])]
        ids.clear()
        for s in range(0, len(words), 20_000):  # a row holds a bounded number of words
            said = pa.array([w.decode("utf-8", "surrogatepass") for w in words[s : s + 20_000]], pa.string())
            each = pa.ListArray.from_arrays(pa.array([0, len(said)], pa.int32()), pa.StructArray.from_arrays([said, pa.array(n[s : s + 20_000], pa.int64())], ["word", "n"]))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int64())), pa.array([lang], pa.string()), each], ["at", "id", "lang", "words"])

    def rows(ends: list[int], at: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        cols = [_lists(np.array(ends), np.concatenate(at), pa.int32()), _lists(np.array(ends), np.concatenate(ids), pa.int64())]
        return pa.RecordBatch.from_arrays([*cols, pa.nulls(len(at), pa.string()), pa.nulls(len(at), WORD)], ["at", "id", "lang", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[Ids, list[np.ndarray]]] = {}
        many = 0
        for b in batches:
            at, ids, ends = [], [], [0]
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                memo, held = known.setdefault(lang, (Ids(lang), []))
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(PLAIN).replace(b"\n", b" \n ").split(b" ")
                got = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
                got = got[got != BLANK]
                place = np.flatnonzero(got >= 0)
                at.append(place)
                ids.append(got[place])
                held.append(ids[-1])
                ends.append(ends[-1] + len(place))
                many += len(place)
                if ends[-1] > PIECE:
                    yield rows(ends, at, ids)
                    at, ids, ends = [], [], [0]
                if many > HELD or sum(len(m) for m, _ in known.values()) > MEMO:
                    for tongue in list(known):
                        yield from counts(tongue, *known.pop(tongue))
                    many = 0
            if at:
                yield rows(ends, at, ids)
        for tongue in list(known):
            yield from counts(tongue, *known.pop(tongue))

    schema = "at array<int>, id array<long>, lang string, words array<struct<word:string,n:long>>"
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, schema)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from (b.slice(i, ROWS) for i in range(0, b.num_rows, ROWS))


def _adjacent(b: pa.RecordBatch, held: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    """Merge-join of a relation's frequent part with itself: row, place, p, q of what stands at a place and the next."""
    at, ids = b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy()
    ends = np.diff(b.column(0).offsets.to_numpy())
    row = np.repeat(np.arange(len(ends)), ends)
    some = np.flatnonzero(plain_maybe_in(held, bits, ids.astype(np.uint64)))
    at, ids, row = at[some], ids[some], row[some]
    i = np.flatnonzero((at[1:] == at[:-1] + 1) & (row[1:] == row[:-1]))
    return row[i], at[i], ids[i], ids[i + 1]


def _summed(h: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and their counts up to LEAST."""
    every, many = np.concatenate(h), np.concatenate(n)
    order = np.argsort(every)
    every, many = every[order], many[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[first], np.minimum(np.add.reduceat(many.astype(np.int64), first), LEAST).astype(np.uint8)


def _split(words: int) -> int:
    """Bits of a range's number: ranges of about 500,000 words each, 2^16 at most."""
    return min(16, (words // 500_000).bit_length())


def possible_pairs(relation: DataFrame, frequent: tuple, words: int) -> DataFrame:
    """(k): hashes of SHORT bits that stand for LEAST or more pairs, in place of the pairs themselves.

    Most pairs of a task are rare everywhere. Of those only hashes are dealt out: in order, as differences, packed by ranges of hashes, a few bytes each, with counts that stop at LEAST.
    `words` sets the number of ranges, so that what meets in one place doesn't grow with the input (up to 2^16 ranges).
    """
    held, bits = frequent
    split = _split(words)
    width = 1 << (SHORT - split)

    def packed(h: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, n = np.unique(np.concatenate(h), return_counts=True)
        h.clear()
        n = np.minimum(n, LEAST).astype(np.uint8)
        cuts = np.searchsorted(keys, np.arange((1 << split) + 1, dtype=np.int64) * width)
        rows = []
        for b in range(1 << split):
            own = keys[cuts[b] : cuts[b + 1]]
            if len(own):
                steps = np.diff(own, prepend=b * width).view(np.uint8).reshape(-1, 8)[:, : SHORT // 8].T.tobytes()
                rows.append((b, len(own), pa.compress(steps + n[cuts[b] : cuts[b + 1]].tobytes(), "zstd", asbytes=True)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["range", "size", "packed"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, many = [], 0
        for b in _pieces(batches):
            _, _, p, q = _adjacent(b, held.value, bits)
            h.append(pair_id(p, q) >> (63 - SHORT))
            many += len(p)
            if many > HELD:
                yield from packed(h)
                many = 0
        if many:
            yield from packed(h)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h, n, many = None, [], [], 0
        often = lambda: (lambda k, c: pa.RecordBatch.from_arrays([pa.array(k[c >= LEAST])], ["k"]))(*_summed(h, n))
        for b in batches:
            for where, size, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if where != at:
                    if h:
                        yield often()
                    at, h, n, many = where, [], [], 0
                raw = np.frombuffer(pa.decompress(raw, size * (SHORT // 8 + 1), "zstd", asbytes=True), np.uint8)
                steps = np.zeros((size, 8), np.uint8)
                steps[:, : SHORT // 8] = raw[: size * (SHORT // 8)].reshape(SHORT // 8, size).T
                h.append(np.cumsum(steps.view(np.int64)[:, 0]) + where * width)
                n.append(raw[size * (SHORT // 8) :])
                many += size
                if many > HELD:  # distinct ones again
                    k, c = _summed(h, n)
                    h, n, many = [k], [c], len(k) // 2
        if h:
            yield often()

    dealt = relation.select("at", "id").mapInArrow(deal, "range int, size int, packed binary")
    return dealt.repartition("range").sortWithinPartitions("range").mapInArrow(meet, "k long")


def _pairs_summed(p: list[np.ndarray], q: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and their counts."""
    a, b, many = np.concatenate(p), np.concatenate(q), np.concatenate(n)
    order = np.lexsort((b, a))
    a, b, many = a[order], b[order], many[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    return a[first], b[first], np.add.reduceat(many, first) if len(a) else many


def pair_counts(relation: DataFrame, frequent: tuple, possible: tuple, words: int) -> DataFrame:
    """(p, q, a): counts of the possible pairs, LEAST or more: partial ones packed by ranges of the pair's id, like possible_pairs(), and summed exactly."""
    held, bits = frequent
    maybe, maybe_bits = possible

    split = _split(words)

    def packed(p: list[np.ndarray], q: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        a, b, n = _pairs_summed(p, q, [np.ones(len(x), np.int64) for x in p])
        p.clear()
        q.clear()
        where = pair_id(a, b) >> (63 - split) if split else np.zeros(len(a), np.int64)
        order = np.argsort(where, kind="stable")
        a, b, n, where = a[order], b[order], n[order], where[order]
        cuts = np.searchsorted(where, np.arange((1 << split) + 1))
        rows = [(r, e - s, pa.compress(a[s:e].tobytes() + b[s:e].tobytes() + n[s:e].tobytes(), "zstd", asbytes=True)) for r, s, e in zip(range(1 << split), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if e > s]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["range", "size", "packed"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ps, qs, many = [], [], 0
        for b in _pieces(batches):
            _, _, p, q = _adjacent(b, held.value, bits)
            some = plain_maybe_in(maybe.value, maybe_bits, (pair_id(p, q) >> (63 - SHORT)).astype(np.uint64))
            ps.append(p[some])
            qs.append(q[some])
            many += len(ps[-1])
            if many > HELD:
                yield from packed(ps, qs)
                many = 0
        if many:
            yield from packed(ps, qs)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, many = None, [], 0

        def often() -> pa.RecordBatch:
            a, b, n = _pairs_summed(*map(list, zip(*parts, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(x[n >= LEAST]) for x in (a, b, n)], ["p", "q", "a"])

        for b in batches:
            for where, size, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if where != at:
                    if parts:
                        yield often()
                    at, parts, many = where, [], 0
                three = np.frombuffer(pa.decompress(raw, 24 * size, "zstd", asbytes=True), np.int64)
                parts.append((three[:size], three[size : 2 * size], three[2 * size :]))
                many += size
                if many > HELD:  # distinct ones again
                    parts = [_pairs_summed(*map(list, zip(*parts, strict=True)))]
                    many = len(parts[0][0]) // 2
        if parts:
            yield often()

    dealt = relation.select("at", "id").mapInArrow(deal, "range int, size int, packed binary")
    return dealt.repartition("range").sortWithinPartitions("range").mapInArrow(meet, "p long, q long, a long")


def extended(relation: DataFrame, frequent: tuple, longer: tuple) -> DataFrame:
    """The relation of the next length: occurrences of its frequent groups (semi-join)."""
    held, bits = frequent
    held2, bits2 = longer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            row, at, p, q = _adjacent(b, held.value, bits)
            ids = pair_id(p, q)
            some = np.flatnonzero(plain_maybe_in(held2.value, bits2, ids.astype(np.uint64)))
            rows, first = np.unique(row[some], return_index=True)
            ends = np.append(first, len(some))
            if len(rows):
                yield pa.RecordBatch.from_arrays([_lists(ends, at[some], pa.int32()), _lists(ends, ids[some], pa.int64())], ["at", "id"])

    return relation.select("at", "id").mapInArrow(run, "at array<int>, id array<long>")


def with_ids(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, q = (b.column(i).to_numpy() for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pair_id(p, q))], ["p", "q", "a", "id"])

    return pairs.mapInArrow(run, "p long, q long, a long, id long")


def with_word_ids(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Ids] = {}
        for b in batches:
            ids = [known.setdefault(lang, Ids(lang)).__missing__(w.encode("utf-8", "surrogatepass")) for lang, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            known.clear()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.int64())], ["lang", "phrase", "a", "id"])

    return words.mapInArrow(run, "lang string, phrase string, a long, id long")


def least_cut(a: Column, n: Column, before: Column, after: Column) -> Column:
    """(score, k, l, r) of the lowest floor(1000 a n / (l r)), ties to the smallest k; exact up to 38 digits."""
    big = lambda c: c.cast("decimal(19,0)")
    top = (big(a) * big(n)).cast("decimal(38,0)") * F.lit(1000).cast("decimal(4,0)")
    size = F.size(before)

    def cut(k: Column) -> Column:
        left, right = F.get(before, k - 1), F.get(after, size - k - 1)
        score = F.call_function("div", top.cast("decimal(38,0)"), (big(left) * big(right)).cast("decimal(38,0)"))
        return F.struct(score.cast("long").alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), size - 1), cut))


def collocations(docs: DataFrame, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of two to `longest` words.

    A null lang is `und`; null and empty texts have no words; repeated rows count as often as they stand; an empty table gives no row; further columns
    are ignored; equal scores go by a, then by the phrase's bytes.
    """
    spark = docs.sparkSession
    relation = written(occurrences(docs), "occurrences")
    partial = relation.where("words is not null").select("lang", F.inline("words"))
    totals = written(partial.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    n_words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = partial.repartition("lang", "word").groupBy("lang", F.col("word").alias("phrase")).agg(F.sum("n").alias("a")).where(F.col("a") >= LEAST)
    one = F.array("a")
    groups = [written(with_word_ids(words).select("lang", "id", "phrase", F.col("phrase").alias("last"), "a", one.alias("before"), one.alias("after")), "frequent1")]
    del partial, words
    release(spark)
    held, frequent = relation, bitmap(groups[0].select(F.col("id").alias("k")), of=plain_places)
    relation = held.where("at is not null")
    for size in range(2, longest + 1):
        possible = bitmap(written(possible_pairs(relation, frequent, n_words), f"possible{size}"), of=plain_places)
        pairs = written(with_ids(pair_counts(relation, frequent, possible, n_words)), f"pairs{size}")
        p, q = groups[-1].select(F.col("id").alias("p"), "lang", "phrase", "before"), groups[-1].select(F.col("id").alias("q"), "last", "after")
        named = join_dealt_anew(join_dealt_anew(pairs, p, ["p"]), q, ["q"])
        joined = named.select("lang", "id", "p", "q", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "a", F.concat("before", one).alias("before"), F.concat("after", one).alias("after"))
        groups.append(written(joined, f"frequent{size}"))
        if size < longest:
            longer = bitmap(pairs.select(F.col("id").alias("k")), of=plain_places)
            wider, frequent = written(extended(relation, frequent, longer), f"occurrences{size}"), longer
            del pairs, named, joined, relation
            release(spark, held)
            held = relation = wider
    del relation
    release(spark, held)
    kept = []
    for group, wider in zip(groups[1:], [*groups[2:], None], strict=True):
        if wider is not None:
            # a phrase within a longer one of the same count is within one that is a word longer, of that count too
            part = wider.select(F.explode(F.array("p", "q")).alias("id"), "a").distinct()
            group = join_dealt_anew(group, part, ["id", "a"], "left_anti")
        kept.append(group.select("lang", "phrase", "a", "before", "after"))
    every = kept[0]
    for more in kept[1:]:
        every = every.union(more)
    scored = every.join(totals, "lang").withColumn("_x", least_cut(F.col("a"), F.col("n"), F.col("before"), F.col("after")))
    scored = scored.select("lang", "phrase", "a", F.col("_x.l").alias("l"), F.col("_x.r").alias("r"), "n", F.col("_x.score").alias("score"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return scored.withColumn("rank", place.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, [x FOR x IN string_split_regex(piece, '[ \t]+') IF x <> ''] AS w
 FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
tot AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
f AS (SELECT lang, m, phrase, count(*) AS a FROM (SELECT lang, m, unnest([array_to_string(w[i + 1 : i + m], ' ') FOR i IN range(0, len(w) - m + 1)]) AS phrase FROM p, range(1, 6) r(m) WHERE len(w) >= m)
 GROUP BY lang, m, phrase HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
held AS (SELECT lang, unnest([array_to_string(w[i + 1 : i + s], ' ') FOR i IN range(0, m - s + 1)]) AS phrase, a FROM c, range(2, 5) r(s) WHERE s < m),
drops AS (SELECT lang, phrase, max(a) AS a FROM held GROUP BY lang, phrase),
cuts AS (SELECT lang, phrase, m, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM c, range(1, 5) r(k) WHERE k < m),
sc AS (SELECT cuts.lang, cuts.phrase, cuts.a, k, x.a AS l, y.a AS r, n, (1000::HUGEINT * cuts.a * n) // (x.a::HUGEINT * y.a) AS score
 FROM cuts JOIN tot USING (lang) JOIN f x ON x.lang = cuts.lang AND x.phrase = lp AND x.m = k JOIN f y ON y.lang = cuts.lang AND y.phrase = rp AND y.m = cuts.m - k),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank FROM best b LEFT JOIN drops d ON d.lang = b.lang AND d.phrase = b.phrase WHERE d.a IS NULL OR 100 * d.a < 100 * b.a)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000"""
