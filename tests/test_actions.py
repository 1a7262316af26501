"""Actions, compact pairs, API rows and page sources on nulls, empty texts, odd arguments and empty tables."""

from pyspark.sql import functions as F

from tallyweave.operators import actions as C

SCHEMAS = {"calculator": {"program": "string", "digits": "integer"}, "clock": {}}


def call(name, arguments):
    return '{"action": "tool_call", "tool_call": {"name": "%s"%s}}' % (name, f', "arguments": {arguments}' if arguments else "")


def test_argument_schemas(spark):
    rows = [
        (call("calculator", '{"program": "add(1, 2)", "digits": 3, "more": null}'), 1),
        (call("calculator", '{"program": "add(1, 2)", "digits": "3"}'), 0),
        (call("calculator", '{"program": "add(1, 2)"}'), 0),
        (call("calculator", '{"program": null, "digits": 3}'), 0),
        (call("calculator", '"add(1, 2)"'), 0),
        (call("clock", ""), 1),
        (call("clock", "[1]"), 0),
        (call("api_call", '{"anything": [1]}'), 1),
        (call("unknown", "{}"), 0),
    ]
    df = spark.createDataFrame([(r, r) for r, _ in rows], "raw string, gold string")
    got = C.action_report(df, SCHEMAS).first()
    assert got.pred_tool_turns == len(rows)
    assert got.argument_schema_valid_rate == round(sum(ok for _, ok in rows) / len(rows), 9)
    assert got.tool_name_valid_rate == round(8 / 9, 9)
    assert got.final_exact_rate is None


def test_report_of_odd_rows(spark):
    final = '{"action": "final", "answer": " Forty  Two "}'
    df = spark.createDataFrame([(None, None), ("", final), ("[1]", final), (f"so: {final}", final), ('{"action": "final", "answer": "forty two"}', final)], "raw string, gold string")
    got = C.action_report(df, SCHEMAS).first()
    assert (got.num_samples, got.json_valid_rate, got.no_extra_text_rate, got.final_turns, got.final_exact_rate) == (5, 0.4, 0.2, 4, 0.5)
    assert C.action_report(df.where("false"), SCHEMAS).first().num_samples == 0
    assert C.tool_counts(df).count() == 0


def test_compact_pairs(spark):
    c = spark.createDataFrame([(1, "scaled_correct", "x", "q", ["a", None], 'say "hi"', "c"), (2, "invalid_json", None, None, None, None, "c"), (3, "scaled_wrong", " {} ", "q", [], "1", "c")], "id long, status string, raw string, question string, evidence array<string>, answer string, chosen string")
    said = spark.createDataFrame([(9, 1, "system", "s"), (9, 2, "user", None), (9, 3, "assistant", "yes"), (9, 4, "user", "later"), (8, 1, "user", "alone")], "id long, turn int, role string, text string")
    got = {r.id: r for r in C.compact_pairs(c, C.replay_prompts(said), "Ask", {"wrong": 9, "anchor": 9, "replay": 9}, 1).collect()}
    assert sorted(got) == [1, 2, 3, 9]
    assert got[1].rejected == '{"action": "final", "answer": "say \\"hi\\""}'
    assert got[2].rejected == '{"action":"final","answer":""}' and got[3].rejected == "{}"
    assert (got[9].kind, got[9].prompt, got[9].chosen) == ("replay", "s\n", "yes")


def test_api_rows_take_any_columns(spark):
    df = spark.createDataFrame([(1, " ", "f(1)"), (2, None, None), (3, "what", "")], "id long, prompt string, call string")
    got = {r.id: r.messages[1].content for r in C.apibench_rows(df, "x").collect()}
    assert got == {1: '{"id":1,"prompt":" ","call":"f(1)"}'}
    assert C.apibench_rows(df.drop("call"), "x").count() == 0


def test_sources(spark):
    long = " ".join(map(str, range(200)))
    rows = [(1, 1, "u", "t", long, "s"), (1, 2, "u", None, None, "snip pet"), (1, 3, "u", "t", " \n", "snip"), (1, 4, "u", "t", "", None), (1, 5, "u", "t", "out of reach", "s")]
    df = spark.createDataFrame(rows, "query_id long, rank int, url string, title string, text string, snippet string")
    got = {r.chunk_id: r.text for r in C.source_chunks(df, 4).collect()}
    assert sorted(got) == ["src1-chunk0", "src1-chunk1", "src2-chunk0", "src3-chunk0"]
    assert (got["src2-chunk0"], got["src3-chunk0"]) == ("snip pet", "snip")
    report = {r["rank"]: (r.ok, r.error, r.text_chars) for r in C.fetch_report(df, 4).collect()}
    assert report == {1: (True, None, len(long)), 2: (False, "no stored page", 8), 3: (True, None, 2), 4: (True, None, 0)}


def test_traces_without_rows(spark):
    facts = spark.createDataFrame([("a", "w", 1, 0), ("a", "p", 1, 2), ("b", "w", 1, 4), ("b", "w", 2, 8)], "symbol string, metric string, period int, value long")
    assert C.margin_traces(facts, "p", "w").count() == 0
    pairs = spark.createDataFrame([("b", "a"), ("a", "b"), ("a", "none")], "a string, b string")
    assert [(r.a, r.b, r.answer) for r in C.ratio_traces(facts, pairs, "w").collect()] == [("a", "b", 0.0)]
    assert C.operator_examples(spark.range(1).select(F.col("id"), F.lit(None).cast("string").alias("raw_output"))).count() == 0
