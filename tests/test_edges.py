"""Hostile and odd inputs of the library's functions and jobs."""

from pyspark.sql import functions as F

from tallyweave.functions.programs import run_program
from tallyweave.operators import agents, assembly, datasets, evaluate, retrieval


def test_hostile_programs(spark):
    """Long arguments, many steps and deep brackets give a value or an error, and the session lives on."""
    rows = {
        "add(" + "1" * 4000 + ", 2)": (False, "bad arguments"), "add(" + "x" * 100_000 + ", 2)": (False, "bad arguments"), "(" * 100_000: (False, "bad step"), "add(1,2))": (False, "bad step"),
        ", ".join(["add(1, 1)"] * 5000): (True, 2.0), "divide(" * 50 + "7" + ", 2)" * 50: (True, 3.5), "divide(subtract(1200, 1000), 1000)": (True, 1.2), "max(1, 2, (3, 4))": (True, 2.0), "add(" + "(x)," * 2000 + " 3)": (False, "bad arguments"), "": (False, "empty program"),
    }
    got = spark.createDataFrame([(p,) for p in rows], "p string").select("p", run_program(F.col("p")).alias("r")).collect()
    assert {x.p[:60]: (x.r.ok, x.r.result if x.r.ok else x.r.error) for x in got} == {p[:60]: v for p, v in rows.items()}


def test_containing(spark):
    docs = spark.createDataFrame([(1, "so one two three four five six seven eight ends"), (2, "one two"), (3, None), (4, ""), (1, "again one two")], "doc_id long, text string")
    said = spark.createDataFrame([(1, "ne two three four five six seven eig"), (2, "one two"), (3, "two  three"), (4, None), (5, "x one two three four five six seven eight")], "query_id long, q string")
    assert sorted(map(tuple, retrieval.containing(docs, said).collect())) == [(1, 1), (2, 1), (2, 2)]
    assert retrieval.containing(docs.limit(0), said).count() == 0 and retrieval.containing(docs, said.limit(0)).count() == 0


def test_dense(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 1.0]), (5, [1.0])], "chunk_id long, v array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.5]), (8, None), (9, [0.0, 1.0])], "query_id long, q array<float>")
    for block in (1, 10):
        assert sorted((r.query_id, r.rank, r.chunk_id) for r in retrieval.dense_topk(q, v, 2, block).collect()) == [(7, 1, 1), (7, 2, 2), (9, 1, 4), (9, 2, 1)]
    assert retrieval.dense_topk(q.limit(0), v).count() == 0 and retrieval.dense_topk(q, v.limit(0)).count() == 0


def test_grid_counts_every_query(spark):
    ranked = spark.createDataFrame([(1, 5, 1)], "query_id long, chunk_index long, rank int")
    gold, queries = spark.createDataFrame([(1, 5), (2, 9)], "query_id long, chunk_index long"), spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    row = agents.evidence_grid(ranked, gold, (5,), ((0, 0),), queries).first()
    assert (row.num_queries, row.any_recall, row.avg_chunks) == (3, round(1 / 3, 9), round(1 / 3, 9))


def test_ties(spark):
    rows = spark.createDataFrame([("a", 1, x) for x in "pqrs"], "name string, ordinal long, file string")
    assert len({datasets.last_wins(rows.repartition(n), "name", "ordinal").first().file for n in (1, 2, 4)}) == 1
    assert len({datasets.upsert_manifest(rows.repartition(n), rows.limit(0)).first().file for n in (1, 2, 4)}) == 1


def test_reports(spark):
    schema = "id long, pre_text array<string>, rows array<array<string>>, post_text array<string>, question string, answer string, program string"
    r = spark.createDataFrame([(1, ["a  b", " "], [["h", "x"], ["l", "1", "2"]], None, "q", "3", "add(1, 2)"), (2, None, None, None, "q", None, None)], schema)
    got = sorted((x.sample_id, x.chunk_type, x.chunk_index, x.text) for x in assembly.report_chunks(r).collect())
    assert got == [(1, "pre_text", 0, "a b"), (1, "table_header", 0, "h | x"), (1, "table_row", 1, "metric: l ; x: 1 ; col_2: 2")]
    chats = {x.id: x.messages for x in assembly.chat_from_reports(r.fillna({"answer": ""}), "s").collect()}
    assert len(chats[1]) == 3 and "| h | x |" in chats[1][1].content


def test_expected_tools(spark):
    trace = spark.createDataFrame([("t", 1, "a"), ("t", 2, "b"), ("u", 1, "")], "task string, step int, tool string")
    asked = spark.createDataFrame([("t", ["b", "a"]), ("u", ["a"]), ("v", [])], "task string, tools array<string>")
    assert {r.task: (r.called, r.hit) for r in evaluate.expected_tools(trace, asked).collect()} == {"t": ("a,b", True), "u": ("", False), "v": ("", True)}
