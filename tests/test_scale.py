"""What keeps large tables cheap: each expensive expression stands once in the plan, and a report is worked on within its row."""

from pyspark.sql import functions as F

from tallyweave.operators import quotas as Q
from tallyweave.operators import retrieval as R
from tallyweave.operators import within as I
from tallyweave.plans import registry


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tags_are_made_once(spark):
    rows = spark.range(50).withColumn("tags", F.array_compact(F.array(F.when(F.sha2(F.col("id").cast("string"), 256) > "8", "a"), F.when(F.col("id") % 2 == 0, "b"))))
    got = Q.tagged_mixture(rows, {"a": 5, "b": 4}, 1)
    assert plan(got).count("sha2") == 1
    assert sorted((r.tag, r["count"]) for r in got.groupBy("tag").count().collect()) == [("a", 5), ("b", 4)]


def test_report_queries_shuffle_numbers_alone(spark):
    from tallyweave.plans import reports as P

    data = "/root/testdata/sf0.001"
    for name in ("generation_expanded", "evidence_expand", "generation_topk", "chunk_gold", "generation_gold"):
        got = plan(registry.QUERIES[name](spark, data))
        assert got.count("Join") == 1 and "Window" not in got, name
    assert plan(P.reports(spark, data)).count("Join") == 1


def test_bm25_within_a_report(spark):
    texts = [["a b b", "b c", "c c d", ""], ["x y", "x y"], ["only"]]
    q = spark.createDataFrame([(i, i, "b c x q b") for i in range(3)], "query_id long, sample_id long, text string")
    c = spark.createDataFrame([(i, j, t) for i, ts in enumerate(texts) for j, t in enumerate(ts)], "sample_id long, chunk_id long, text string")
    want = {(r.query_id, r.chunk_id): r.score for r in R.bm25(q, c).collect()}
    tokens = F.transform("t", lambda t: F.filter(F.split(t, " "), lambda w: w != ""))
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t array<string>").select("id", I.bm25_scores(tokens, F.split(F.lit("b c x q b"), " ")).alias("s")).collect()
    assert {(r.id, j): s for r in rows for j, s in enumerate(r.s)} == want


def test_sentences_are_split_once(spark):
    assert plan(registry.QUERIES["chunk_sentences"](spark, "/root/testdata/sf0.001")).count("(?<=[.!?])") == 1


def test_pairs_read_orders_once(spark):
    for name in ("pairs_mixed", "compact_pairs", "controller_eval"):
        assert plan(registry.QUERIES[name](spark, "/root/testdata/sf0.001")).count("o_totalprice") <= 4, name


def test_prompts_are_read_within_their_rows(spark):
    from tallyweave.sources import io as S

    texts = ["Pre-text:\na\nTable:\n| 1 |\nPost-text:\nb", "Table:\n|-\n| 2 |\n\nPre-text:\n\nc"]
    got = S.report_from_prompt(spark.createDataFrame([(1, t) for t in texts], "id long, text string"))
    assert "Window" not in plan(got) and "Window" not in plan(registry.QUERIES["report_from_prompt"](spark, "/root/testdata/sf0.001"))
    want = [("post_text", 5, "b"), ("pre_text", 1, "a"), ("pre_text", 6, "c"), ("table", 2, "| 2 |"), ("table", 3, "| 1 |")]
    assert sorted((r.section, r.pos, r.line) for r in got.collect()) == want


def test_turns_are_chosen_from_paths(spark):
    got = plan(registry.QUERIES["turn_prompt_rows"](spark, "/root/testdata/sf0.001")).lower()
    assert "parse_json" not in got and "parsejson" not in got and "takeordered" not in got


def test_gold_passages_are_found_once(spark):
    got = plan(registry.QUERIES["gold_label_text"](spark, "/root/testdata/sf0.001"))
    assert "xxhash64" not in got and "LeftSemi" in got
