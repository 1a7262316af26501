"""Spelling variants: near words by a variable-length gram index.

Words are framed by QMIN - 1 marks on both sides. The gram dictionary holds grams of more than QMIN characters: one is kept if the gram without its last
character is in over `often` words (so frequent grams are told apart by longer ones) and it is itself in over a quarter of that. At each place of a word the
longest gram of the dictionary counts, else the one of QMIN characters, unless an earlier gram covers it. How many of a word's grams one edit can
change at most is found by trying each place of an edit (`affected`): a gram that holds it, one that ends just before it and could grow, or one behind it
that a new gram could cover. Two near words share all but so many grams, so by the prefix filter each has one of its rarest (bound + 1) grams in
common with the other. Lists are merged by (gram, place, length): grams before the edit keep their place, those behind it move with the length. Words of
which an edit can change all grams are indexed once more, by grams of QMIN characters only, of which an edit changes QMIN at most. Candidates are verified by
edit distance in the JVM, so none is missed and none is wrong.

At scale: texts are read once; partial counts per task; the index has a few rows a distinct word. `often` grows with the vocabulary, so that the
dictionary has at most 4 * SIZE grams a length, which are broadcast; it changes no result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_dealt_anew, table, written

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
RUN = re.compile("[a-zÀ-ÿ]{6,}")
LEAST_LENGTH, LEAST_COUNT, EVERY, FACTOR = 6, 5, 199, 5
QMIN, QMAX = 3, 5
FRAME = "\x02" * (QMIN - 1), "\x03" * (QMIN - 1)
#: Frequent grams of a length at most.
SIZE = 16_384
#: Distinct words that a task counts before it passes them on.
HELD = 500_000


def runs_of(doc: int | None, text: str | None) -> Counter:
    """Words (with the deletions by hash) of a text with their counts; a null id is written as nothing before the colon."""
    low = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass")
    out: Counter = Counter()
    start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
    for run, n in Counter(RUN.findall(low)).items():
        h = zlib.crc32(run.encode(), start)
        if h % EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        out[run] += n
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that count."""

    def batch(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.update(runs_of(doc, text.as_py()))
                if len(held) > HELD:
                    yield batch(held)
                    held = Counter()
        yield batch(held)

    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Grams:
    """The gram dictionary: how many words have a gram (0 for those it doesn't know: rarer than all it knows)."""

    def __init__(self, counts: dict[str, int], often: int) -> None:
        self.n = counts
        self.long = {g for g in counts if len(g) > QMIN and counts.get(g[:-1], 0) > often}
        # what one more character can make longer, and what can stand behind another character within a gram
        self.grow = {g[:-1] for g in self.long}
        self.tails = {g[i:j] for g in self.long for i in range(1, len(g)) for j in range(i + QMIN, len(g) + 1)}

    def of(self, s: str) -> list[tuple[int, int]]:
        """(start, end) of the grams of a framed word, in order."""
        out, reach, long = [], 0, self.long
        for p in range(len(s) - QMIN + 1):
            e = p + QMIN
            while e < len(s) and e < p + QMAX and s[p : e + 1] in long:
                e += 1
            if e > reach:
                out.append((p, e))
                reach = e
        return out

    def affected(self, s: str, grams: list[tuple[int, int]]) -> int:
        """Grams that one inserted, deleted or replaced character changes at most."""
        most, first, last = 0, QMIN - 1, len(s) - QMIN + 1
        for i in range(first, last + 1):  # before character i; and, for gap 1, at it
            for gap in (0, 1) if i < last else (0,):
                after = i + gap
                n = 0
                for p, e in grams:
                    if p >= after:
                        n += s[after:e] in self.tails
                    elif e > i:
                        n += p < i or gap
                    else:
                        n += e == i and s[p:e] in self.grow
                most = max(most, n)
        return most


def index_rows(words: DataFrame, counts: dict[str, int], often: int, base: bool) -> DataFrame:
    """(key, kind, word, n): list entries (kind 0) and what longer words look up (1: a place less or the same, in lists of a character less).

    base: the words whose bound leaves no gram, by grams of QMIN characters only; else all words.
    """
    known = words.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, short = Grams(known.value, often), Grams({g: n for g, n in known.value.items() if len(g) <= QMIN}, often)
        for b in batches:
            rows: list[tuple[int, int, str, int]] = []
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = FRAME[0] + word + FRAME[1]
                grams = full.of(s)
                bound = full.affected(s, grams)
                if base:
                    if bound < len(grams):
                        continue
                    grams = short.of(s)
                    bound = short.affected(s, grams)
                rare = sorted(((full.n.get(s[p:e], 0), s[p:e], p) for p, e in grams))[: bound + 1]
                for _, g, p in rare:
                    key = lambda at, size, g=g: xxhash.xxh3_64_intdigest(f"{g}\x00{at}\x00{size}\x00{base}".encode("utf-8", "surrogatepass")) >> 1
                    rows.append((key(p, len(word)), 0, word, n))
                    rows.append((key(p, len(word) - 1), 1, word, n))
                    rows.append((key(p - 1, len(word) - 1), 1, word, n))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["key", "kind", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "key long, kind int, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, an, b, bn): each pair of near words once."""
    spread = words.select(F.concat(F.lit(FRAME[0]), "word", F.lit(FRAME[1])).alias("s"))
    places = lambda q: F.transform(F.sequence(F.lit(1), F.char_length("s") - (q - 1)), lambda i: F.substring("s", i, F.lit(q)))
    grams = spread.select(F.explode(F.array_distinct(F.concat(*[places(q) for q in range(QMIN, QMAX + 1)]))).alias("g"))
    counted = written(grams.groupBy("g").agg(F.count("*").alias("n")), "grams")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = max(32, total // SIZE)
    # grams of a length over a quarter of total / SIZE: 4 * SIZE at most
    counts = {r["g"]: r["n"] for r in counted.where(F.col("n") > often // 4).toLocalIterator()}
    rows = written(index_rows(words, counts, often, False).union(index_rows(words, counts, often, True)), "gram_index")
    lists = rows.where("kind = 0").select("key", F.col("word").alias("b"), F.col("n").alias("bn"))
    met = join_dealt_anew(rows.select("key", "kind", F.col("word").alias("a"), F.col("n").alias("an")), lists, ["key"])
    near = met.where("(kind = 1 or a < b) and levenshtein(a, b, 1) = 1")
    return written(near.select("a", "an", "b", "bn").distinct(), "near")


def spelling_forms(docs: DataFrame) -> DataFrame:
    """One row a distinct word: word, form, root, n, n_near, form_n.

    Null and empty texts have no words; repeated rows count as often as they stand; a null id counts as the empty string in the hash; an empty
    table gives no row; further columns are ignored.
    """
    words = written(vocabulary(docs), "vocabulary")
    pairs = near_pairs(words)
    both = pairs.union(pairs.select("b", "bn", "a", "an")).toDF("word", "n", "other", "other_n")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("other"))).alias("best"))
    top = -F.col("best.m")
    linked = join_dealt_anew(words, best, ["word"], "left").withColumn("is_form", F.coalesce(top >= FACTOR * F.col("n"), F.lit(False)))
    linked = written(linked.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("is_form"), F.col("best.other")).alias("form"), F.when(F.col("is_form"), top).alias("form_n")), "forms")
    roots = linked.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # a form has five times the count, so a chain is short; each round doubles the steps
        ahead = join_dealt_anew(roots, roots.select(F.col("word").alias("root"), F.col("root").alias("next")), ["root"], "left")
        step = written(ahead.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    done = join_dealt_anew(linked, roots, ["word"], "left")
    return done.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(table(spark, sf_dir, "documents"))


#: crc32 by its table; near words share what is left when a character is deleted at the same place, or in the longer of the two.
OP11_SQL = rf"""
WITH RECURSIVE tab AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT CAST(doc_id AS VARCHAR) AS doc, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
e AS (SELECT doc, run, count(*) AS c FROM d WHERE length(run) >= 6 GROUP BY doc, run),
h AS (SELECT run, c, xor(list_reduce(list_concat([4294967295], [CAST('0x' || hx[2 * i + 1 : 2 * i + 2] AS BIGINT) FOR i IN range(0, length(hx) // 2)]), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) AS h
 FROM (SELECT run, c, hex(encode(coalesce(doc, '') || ':' || run)) AS hx FROM e), tab),
w AS (SELECT word, sum(c)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, c FROM h)
 WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
x AS (SELECT word, n, length(word) AS len, i, left(word, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)),
p AS (SELECT a.word AS word, b.word AS other, b.n AS m FROM x a JOIN x b ON a.less = b.less AND a.len = b.len AND a.i = b.i AND a.word <> b.word
 UNION SELECT a.word, b.word, b.n FROM x a JOIN w b ON a.less = b.word UNION SELECT b.word, a.word, a.n FROM x a JOIN w b ON a.less = b.word),
g AS (SELECT word, count(*) AS n_near, min({{'m': -m, 'o': other}}) AS best FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 5 * w.n THEN best.o END AS form, CASE WHEN -best.m >= 5 * w.n THEN -best.m END AS form_n FROM w LEFT JOIN g USING (word)),
r AS (SELECT word, word AS cur, 0 AS depth FROM f UNION ALL SELECT r.word, f.form, depth + 1 FROM r JOIN f ON r.cur = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, z.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM f JOIN (SELECT word, max_by(cur, depth) AS root FROM r GROUP BY word) z USING (word)"""
