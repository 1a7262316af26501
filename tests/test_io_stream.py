import json

from pyspark.sql import functions as F

from tallyweave.sources import io as S
from tallyweave.streaming.running import running_metrics, watch


def test_jsonl_and_containers(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": 1, "t": "x"}\n\n{"id": 2, "t": null}\n')
    df = S.read_jsonl(spark, str(p), "id long, t string", "f")
    assert [(r.id, r.f) for r in df.orderBy("id").collect()] == [(1, "a.jsonl"), (2, "a.jsonl")]
    c = tmp_path / "c.json"
    c.write_text(json.dumps({"train": [{"a": 1}, {"a": 2}], "dev": [{"a": 3}]}))
    assert sorted((r[0], json.loads(r[1])["a"]) for r in S.flatten_container(spark, str(c)).collect()) == [("dev", 3), ("train", 1), ("train", 2)]
    c.write_text("[5, 6]")
    assert sorted(tuple(r) for r in S.flatten_container(spark, str(c)).collect()) == [("all", "5"), ("all", "6")]


def test_report_from_prompt(spark):
    text = "Ask\nPre-text: here\nfirst line\nTable:\n| a | b |\n| --- | --- |\n| 1 | 2 |\nPost-text:\nlast\n\nQuestion:\nTable: no"
    got = S.report_from_prompt(spark.createDataFrame([(1, text)], "id long, text string")).orderBy("pos").collect()
    assert [(r.section, r.cells or r.line) for r in got] == [("pre_text", "first line"), ("table", ["a", "b"]), ("table", ["1", "2"]), ("post_text", "last")]


def test_metrics_documents(spark, tmp_path):
    one = spark.createDataFrame([(3, 0.5)], "n long, rate double")
    S.write_metrics(one, one, str(tmp_path / "m"))
    got = S.read_metrics(spark, {"r1": str(tmp_path / "m" / "metrics")})
    assert sorted(tuple(r) for r in got.collect()) == [("r1", "n", 3.0), ("r1", "rate", 0.5)]


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [{"run": f"r{i % 2}", "id": i, "gold": "10", "raw_output": json.dumps({"answer": str(10 + i), "program": ""}) if i % 3 else "10"} for i in range(20)]
    (folder / "1.json").write_text("\n".join(map(json.dumps, rows[:11])))
    (folder / "2.json").write_text("\n".join(map(json.dumps, rows[11:])))
    q = watch(spark, str(folder), "running", str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    batch = running_metrics(spark.createDataFrame(rows, "run string, id long, gold string, raw_output string"))
    assert sorted(map(tuple, spark.table("running").collect())) == sorted(map(tuple, batch.collect()))
    assert batch.agg(F.sum("n")).first()[0] == 20
