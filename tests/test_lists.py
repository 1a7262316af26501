"""Tokens, marks, scores and rankings over Arrow batches against the long forms in Spark."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyweave.functions import text as T
from tallyweave.operators import assembly as B
from tallyweave.operators import lists as L
from tallyweave.operators import retrieval as R
from tallyweave.plans import registry
from tallyweave.plans import reports as P

ODD = [
    "", " ", "A1b2 3.4.5.6 .7 8. 9..1 1.2x3.4", "5%-3 +-4.5% --6%% $7.8$ 1-2", "x\x002019y\x00 z", "the company2019s 2019 a2019 2019b c2019d2019e", "Kelvin İstanbul 4٤ café 5", "a b\n\tc", "!!!", "-.%", "1.2.3.4.5 6.7.8",
    "Order 12 was placed by customer 7.", "-" * 5 + "9.9.9.9%", "퟿%1",
]


def test_tokens_and_normal_forms_of_odd_texts(spark):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("ab Z19.%$+-\x00\né") for _ in range(rng.randrange(30))) for _ in range(400)]
    for some in (texts, [t for t in texts if t.isascii()], [], [""]):
        rows = spark.createDataFrame(list(enumerate(some)), "i int, t string").select("i", T.bm25_tokens(F.col("t")).alias("plain"), T.signed_tokens(F.col("t")).alias("signed"), T.norm_corpus(F.col("t")).alias("n")).orderBy("i").collect()
        for signed in (False, True):
            words, of = L.tokens(some, signed)
            got = sorted(zip(of.tolist(), (w.decode() for w in words.to_pylist()), strict=True))
            assert got == sorted((r.i, w) for r in rows for w in (r.signed if signed else r.plain))
        assert L.normed(some) == [r.n for r in rows]


def test_rounding(spark):
    rng = random.Random(5)
    xs = [rng.randrange(10**8) * 0.05e-6 + rng.randrange(9) / 8 for _ in range(2000)] + [0.0, 1e10 + 0.5, -2.5e-6, 0.0000005, 1.0000005, -1.0000005, 123456.7890125]
    want = [r.y for r in spark.createDataFrame(list(enumerate(xs)), "i int, x double").select("i", F.round("x", 6).alias("y")).orderBy("i").collect()]
    assert L.rounded(np.array(xs)).tolist() == want


def made(rng, n):
    """Reports (id, question, gold, chunks); words are few, so that scores tie."""
    words = ["total", "order", "a1", "2.5", "x%", "Price", "of", "the", "2", "$"]
    said = lambda m: " ".join(rng.choice(words) for _ in range(rng.randrange(1, m)))
    chunks = lambda: [(rng.choice(["pre", "row", "row"]), i, said(12)) for i in range(rng.choice([0, 1, 3, 9, 60]))]
    return [(i, said(9) if i % 7 else "", rng.choice([None, [], ["2"], [None, "", "2", said(12)], [said(40), "99999999999999999999", "4"]]), chunks()) for i in range(n)]


def test_rankings_and_marks(spark):
    reports = made(random.Random(3), 150)
    df = spark.createDataFrame(reports, "id long, question string, gold array<string>, chunks array<struct<chunk_type: string, chunk_index: long, text: string>>")
    long = df.select(F.col("id").alias("sample_id"), "question", "gold", F.inline("chunks")).withColumn("chunk_id", F.concat_ws(":", "chunk_type", F.col("chunk_index").cast("string"))).cache()
    first = R.bm25(df.select(F.col("id").alias("query_id"), F.col("id").alias("sample_id"), F.col("question").alias("text")), long, 40)
    texts = long.select(F.col("sample_id").alias("query_id"), "chunk_id", F.col("question").alias("query"), "text")
    want = {(r.query_id, r.chunk_id): r["rank"] for r in R.fused_rerank(first.select("query_id", "chunk_id", "score").join(texts, ["query_id", "chunk_id"]), 15).collect()}
    golds = df.select(F.col("id").alias("sample_id"), F.explode("gold").alias("gold"))
    marks = {(r.sample_id, r.chunk_id): r.is_gold for r in B.gold_by_ordinal(long.select("sample_id", "chunk_id", F.col("chunk_index").alias("ordinal"), "text"), golds).collect()}
    assert any(marks.values()) and not all(marks.values())

    column = B.marked(F.col("chunks"), F.col("gold"), "chunk_index")
    assert {(r.id, f"{c.chunk_type}:{c.chunk_index}"): c.is_gold for r in df.select("id", column.alias("c")).collect() for c in r.c} == marks
    assert df.limit(0).select(column).collect() == []

    flat = [(i, c) for i, r in enumerate(reports) for c in r[3]]
    of, text = np.array([i for i, _ in flat]), [c[2] for _, c in flat]
    names = [f"{c[0]}:{c[1]}" for _, c in flat]
    ids = L.id_order(pa.array(names))
    (words, chunk), (asked, whose) = L.tokens(text), L.tokens([r[1] for r in reports])
    words, asked = L.numbered(words, asked)
    scores, share = L.bm25_scores(words, chunk, of, asked, whose, len(reports))
    top = np.sort(L.best(scores, ids, of, 40)[0])
    places, rank = L.fused_best(share[top], scores[top], ids[top], of[top], 15)
    assert {(int(of[p]), names[p]): int(k) for p, k in zip(top[places], rank, strict=True)} == want
    # of each report alone: the batch doesn't count
    one = next(i for i, r in enumerate(reports) if len(r[3]) == 9 and r[1])
    mine = np.flatnonzero(of == one)
    (words, chunk), (asked, whose) = L.tokens([text[i] for i in mine]), L.tokens([reports[one][1]])
    words, asked = L.numbered(words, asked)
    assert L.bm25_scores(words, chunk, np.zeros(len(mine), int), asked, whose, 1)[0].tolist() == scores[mine].tolist()


def test_words_within_a_budget(spark):
    rng = random.Random(8)
    rows = [(q, r, rng.choice([1, 50, 300, 800])) for q in range(60) for r in range(1, rng.randrange(2, 10))]
    df = spark.createDataFrame([(q, f"c{r}", r, w) for q, r, w in rows], "query_id long, chunk_id string, rank int, words int")
    want = dict(R.word_budget(df, 700).select("query_id", "used").distinct().collect())
    q, r, w = (np.array(x) for x in zip(*rows, strict=True))
    assert dict(enumerate(L.words_used(w, r, q, 60, 700).tolist())) == want


def test_fused_scores(spark):
    """Two scores, the second with gaps, against the long form; some reports have more chunks than either side takes."""
    rng = random.Random(11)
    rows = [(q, i, rng.randrange(9) / 4, rng.choice([None, rng.randrange(9) / 8, rng.randrange(10**6) / 1e6])) for q in range(40) for i in range(rng.choice([1, 2, 5, 30]))]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, a double, b double")
    top = lambda c: R.ranked(df.select("query_id", "chunk_id", F.col(c).alias("score")).where("score is not null"), 7)
    want = {(r.query_id, r.chunk_id): (r["rank"], r.score) for r in R.score_fusion(top("a"), top("b"), 7).collect()}
    of, ids, a = (np.array([r[i] for r in rows]) for i in (0, 1, 2))
    dense = pa.array([[r[3] for r in rows if r[0] == q] + [None, 1.0][: q % 3] for q in range(40)], pa.list_(pa.float64()))
    at, score = L.score_fused(a, *L.dealt(dense, of), ids, of, 40, 7)
    place, rank = L.best(score, ids[at], of[at], 7)
    assert {(int(of[at[p]]), int(ids[at[p]])): (int(r), float(score[p])) for p, r in zip(place, rank, strict=True)} == want
    # a list that ends early or isn't there has nothing for the chunks behind it
    held, known = L.dealt(pa.array([[1.0], None, [2.0, None, 3.0]]), np.array([0, 0, 1, 2, 2, 2]))
    assert held[known].tolist() == [1.0, 2.0, 3.0] and known.tolist() == [True, False, False, True, False, True]


def test_windows_at_most(spark):
    texts = [["A. B? C! D", "x.y", " ", None], ["..  !? a. b"], [], None, ["One.  Two.\nThree. Four. Five"]]
    df = spark.createDataFrame([(t, [["h", "k"], ["1", None], ["", ""]], t) for t in texts], "pre_text array<string>, rows array<array<string>>, post_text array<string>")
    got = df.select(F.size(B.window_list(df)).alias("n"), B.most_windows(df).alias("m")).collect()
    assert all(r.n <= r.m <= r.n + 12 for r in got)
    for spoken, n in (("/root/testdata/sf0.001", 7), ("/root/testdata/sf0.001", 2000)):
        shown = lambda r: r.withColumn("pre_text", F.array(F.concat_ws(" ", F.array_join("pre_text", " "), F.lit("One. Two. Three."))))
        r = shown(P.reports(spark, spoken))
        each = r.select((F.col("id") % n).alias("r"), F.size(B.window_list(r)).alias("n")).join(P.most_windows(spark, spoken, n, shown), "r", "left")
        assert each.where("m is null or n > m").count() == 0


def test_products_are_counted_without_reports(spark):
    """The lengths of the lists of products come from orders and lines apart: no join of these, no tables made."""
    got = P.most_windows(spark, "/root/testdata/sf0.001", 7, lambda r: r)._jdf.queryExecution().optimizedPlan().toString()
    assert got.count("Join") == 1 and "round(l_extendedprice" not in got and "collect_list" not in got


@pytest.mark.parametrize("name", ["report_retrieval", "report_retrieval_fused"])
def test_reports_are_ranked_in_batches(spark, name):
    """One pass over the reports' chunks, and no lambda that compares a question's tokens with theirs."""
    got = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert got.count("MapInArrow") == 1 and "regexp_extract_all" not in got and "aggregate(" not in got and "array_intersect" not in got
