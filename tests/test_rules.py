"""Hand-computed cases of the text, number and program rules, and properties of rankings and mixtures."""

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import numeric as N
from tallyweave.functions import text as T
from tallyweave.functions.programs import run_program
from tallyweave.operators import datasets as D
from tallyweave.operators import quotas as Q
from tallyweave.operators import retrieval as R


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("1,234.5 m", 1234.5), ("-3%", -3.0), ("none", None), ("1e5", 1.0), ("", None), (None, None), ("+.5", 0.5)],
)
def test_extract_num(spark, text, want):
    assert one(spark, text, N.extract_num(F.col("x"))) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("const_100", 100.0), ("const_m1", -1.0), ("const_7", 7.0), ("$1,200", 1200.0), ("(45)", -45.0), ("1e3", 1000.0), ("27.3%", 27.3), ("x", None), ("", None), (None, None)],
)
def test_normalize_number(spark, text, want):
    assert one(spark, text, N.normalize_number(F.col("x"))) == want


@pytest.mark.parametrize(
    ("program", "lenient", "strict"),
    [
        ("subtract(1200, 1000), divide(#0, 1000), multiply(#1, const_100)", 20.0, 20.0),
        ("divide(36197, 1189)", 36197 / 1189, 36197 / 1189),
        ("divide(subtract(1200, 1000), 1000)", 1.2, None),
        ("add(1, 2, 3)", 6.0, None),
        ("average(1, 2, 6)", 3.0, None),
        ("divide(1, 0)", None, None),
        ("exp(2, 10)", 1024.0, 1024.0),
        ("exp(0, -1)", None, None),
        ("exp(-8, 0.5)", None, None),
        ("greater(2, 1)", 1.0, 1.0),
        ("less(2, 1)", 0.0, None),
        ("table_sum(revenue, none)", None, None),
        ("divide(#3, 2)", None, None),
        ("add(1, const_0)", 1.0, None),
        ("junk", None, None),
        ("add(1, 2) add(3, 4)", None, None),
        ("add(1, 2", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_programs(spark, program, lenient, strict):
    for dialect, want in (("lenient", lenient), ("strict", strict)):
        got = one(spark, program, run_program(F.col("x"), dialect))
        assert got["ok"] == (want is not None), (dialect, got)
        assert got["result"] == (pytest.approx(want) if want is not None else None)


def test_known_matches(spark):
    match = lambda p, g, t=0.01: spark.range(1).select(N.scaled_match(F.lit(p), F.lit(None).cast("string"), F.lit(g), t)).first()[0]
    assert match(36197 / 1189, "3044%")
    assert not match(-0.2, ".2")
    assert match(0.1092, "10.94%")
    assert not spark.range(1).select(N.numeric_match(F.lit("0.1092"), F.lit("10.94%"), 0.01)).first()[0]


def test_json_and_answers(spark):
    v = T.extract_json(F.col("x"))
    assert one(spark, '```json\n{"answer": null, "n": 0.10}\n```', T.field_as_text(v, "$.answer")) == "None"
    assert one(spark, 'so {"answer": 5}', T.field_as_text(v, "$.answer")) == "5"
    assert one(spark, "no json", T.is_object(v)) is False
    assert one(spark, " 1,234.50 % ", T.norm_answer(F.col("x"))) == "1234.50"
    assert one(spark, "the company2019s share", T.norm_corpus(F.col("x"))) == "the company s share"
    assert one(spark, "What separate items?", T.category(F.col("x"))) == "percent_rate"
    assert one(spark, "a&amp;b &copy;", T.unescape(F.col("x"))) == "a&b ©"


def test_windows_and_tables(spark):
    text = " ".join(map(str, range(300)))
    got = one(spark, text, T.word_windows(F.col("x")))
    assert [w.split()[0] for w in got] == ["0", "120", "240"] and len(got[0].split()) == 160
    assert one(spark, "a b", T.word_windows(F.col("x"))) == ["a b"] and one(spark, None, T.word_windows(F.col("x"))) == []
    table = F.array(F.array(F.lit("h"), F.lit("i")), F.array(F.lit("1")), F.array(F.lit("2"), F.lit("3"), F.lit("4")))
    assert one(spark, "", T.markdown_table(table)) == "| h | i |\n| --- | --- |\n| 1 |  |\n| 2 | 3 |"


def test_fusion_and_budgets(spark):
    lists = spark.createDataFrame([(1, "a", 10, 1), (1, "a", 11, 2), (1, "b", 11, 1)], "query_id long, source string, chunk_id long, rank int")
    got = R.rrf(lists).collect()
    assert [r["chunk_id"] for r in got] == [11, 10] and got[0]["source_ranks"] == {"a": 2, "b": 1}
    assert [tuple(r) for r in R.rrf(lists.orderBy(F.desc("source"))).collect()] == [tuple(r) for r in got]
    items = spark.createDataFrame([(1, 1, 5, 90), (1, 2, 6, 50), (1, 3, 7, 10), (1, 4, 8, 1)], "query_id long, rank int, chunk_id long, words int")
    assert [r["chunk_id"] for r in R.word_budget(items, 100).orderBy("pos").collect()] == [5, 7]
    assert [r["chunk_id"] for r in R.word_budget(items, 10).collect()] == [5]


def test_alias_and_mixture(spark):
    q = spark.createDataFrame([(1, "Tesla market cap")], "query_id long, query string")
    r = spark.createDataFrame([(1, "u1", 1), (1, "u2", 2)], "query_id long, url string, rank int")
    a = spark.createDataFrame([("tesla", "u2"), ("apple", "u9")], "alias string, url string")
    assert [(x["url"], x["curated"]) for x in R.alias_injection(q, r, a).orderBy("rank").collect()] == [("u2", True), ("u1", False)]
    rows = spark.range(100).select("id", (F.col("id") >= 50).alias("correct"), F.when(F.col("id") % 2 == 0, "ratio").alias("category"))
    got = Q.hard_set(rows, 20, 10, 5, 30).collect()
    assert len(got) == 30 and [sum(g["reason"] == k for g in got) for k in ("sft_wrong", "category_focus", "anchor_correct")] == [20, 10, 0]
    assert D.dev_split(rows, least=7).where("split = 'dev'").count() == 10
