"""Input views that stand for predictions, reports, chunks and traces, from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QA_SQL = """
SELECT id, a, b, k, concat(CAST(CAST(round(100.0*(a-b)/b) AS BIGINT) AS STRING),'%') AS gold,
 CASE WHEN k=4 THEN concat('The answer is ', CAST(a AS STRING))
      ELSE concat('{"program": "',
        CASE WHEN k=5 THEN ''
             WHEN k=6 THEN concat('table_sum(',CAST(a AS STRING),', none)')
             WHEN k=7 THEN concat('divide(subtract(',CAST(a AS STRING),', ',CAST(b AS STRING),'), ',CAST(b AS STRING),')')
             WHEN k=2 THEN concat('subtract(',CAST(b AS STRING),', ',CAST(a AS STRING),'), divide(#0, ',CAST(b AS STRING),')')
             ELSE concat('subtract(',CAST(a AS STRING),', ',CAST(b AS STRING),'), divide(#0, ',CAST(b AS STRING),')') END,
        '", "answer": "',
        CASE WHEN k=2 THEN CAST(-CAST(round(100.0*(a-b)/b) AS BIGINT) AS STRING)
             WHEN k=3 THEN CAST(10*CAST(round(100.0*(a-b)/b) AS BIGINT) AS STRING)
             WHEN k=1 THEN CAST(CAST(round(1.0*(a-b)/b) AS BIGINT) AS STRING)
             ELSE concat(CAST(CAST(round(100.0*(a-b)/b) AS BIGINT) AS STRING),'%') END, '"}') END AS raw_output
FROM (SELECT o_orderkey AS id, CAST(round(o_totalprice) AS BIGINT) AS a, 1000+o_custkey AS b, o_orderkey % 8 AS k FROM {orders}) t
"""
TOOL_SQL = """
SELECT id, a, b, k, gold, raw_output, CASE WHEN k=4 THEN raw_output ELSE concat('{"action": "tool_call", "tool_call": {"name": "',
  CASE WHEN id % 11 = 0 THEN 'web_search' ELSE 'calculator' END, '", "arguments": {"program": "',
  regexp_extract(raw_output, '"program": "([^"]*)"', 1), '"}}}') END AS raw_tool FROM ({qa}) q
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shares(spark: SparkSession, sf_dir: str, name: str, rows: int) -> int:
    """Partitions of about so many of the table's rows, and as many as the session's shuffles have at least: a task's time and memory stay the same as the table grows. The count is in the files' footers."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, name).count() // rows))


def _orders(spark: SparkSession, sf_dir: str) -> None:
    """Three narrow columns, dealt out evenly: each row becomes texts that cost far more to score than to move."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    rows.repartition(shares(spark, sf_dir, "orders", 100_000)).createOrReplaceTempView("fx_orders")


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions: right with percent sign, right as a ratio, sign flipped, ten times too large, no JSON, empty, unsupported, nested."""
    _orders(spark, sf_dir)
    return spark.sql(QA_SQL.replace("{orders}", "fx_orders"))


def tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    _orders(spark, sf_dir)
    return spark.sql(TOOL_SQL.replace("{qa}", QA_SQL.replace("{orders}", "fx_orders")))


def duck_qa() -> str:
    return f"({QA_SQL.replace('{orders}', 'orders')})"


def duck_tool() -> str:
    return f"({TOOL_SQL.replace('{qa}', QA_SQL.replace('{orders}', 'orders'))})"


def chunks(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Lines of documents, or of those given, as chunks; the first line is the header, the others rows."""
    lines = (table(spark, sf_dir, "documents") if docs is None else docs).select(F.col("doc_id").alias("sample_id"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    return lines.where(F.trim("text") != "").withColumn("chunk_index", F.col("chunk_index").cast("long"))


DUCK_CHUNKS = """(SELECT d.doc_id AS sample_id, CAST(p.pos AS BIGINT) AS chunk_index, p.line AS text
FROM documents d, (SELECT unnest(string_split(d.text, chr(10))) AS line, generate_subscripts(string_split(d.text, chr(10)),1)-1 AS pos) p WHERE trim(p.line) <> '')"""


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("trace_id"), F.row_number().over(w).alias("step"), F.col("event_type").alias("gold_tool"), F.lag("event_type").over(w).alias("pred_tool"))


DUCK_TRACE = """(SELECT user_id AS trace_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_type AS gold_tool,
 lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pred_tool FROM events)"""


def two_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    j = table(spark, sf_dir, "labels").join(d, "doc_id")
    return j.select(F.col("doc_id").alias("id"), F.col("quality").alias("a_ok"), F.when((F.col("toxic") == 0) & (F.col("n_chars") % 3 > 0), 1).otherwise(0).alias("b_ok"))


DUCK_TWO = """(SELECT d.doc_id AS id, l.quality AS a_ok, CASE WHEN l.toxic=0 AND d.n_chars % 3 > 0 THEN 1 ELSE 0 END AS b_ok
FROM labels l JOIN documents d ON l.doc_id=d.doc_id)"""
