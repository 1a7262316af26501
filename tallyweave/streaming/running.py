"""Scores predictions as they land and keeps running metrics per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import numeric as N
from ..operators.evaluate import parsed

SCHEMA = "run string, id long, gold string, raw_output string"


def running_metrics(preds: DataFrame) -> DataFrame:
    """Per run: rows, JSON, numeric matches at 5 %. Stateless parsing, then one aggregation; there is no event time and no watermark."""
    df = parsed(preds)
    return df.groupBy("run").agg(F.count("*").alias("n"), F.count_if("json_ok").alias("json_ok"), F.count_if(N.numeric_match(F.col("answer"), F.col("gold"), 0.05)).alias("num5"))


def watch(spark: SparkSession, folder: str, name: str, checkpoint: str) -> StreamingQuery:
    """Follows a folder of JSON lines; the running table is kept in memory under `name`."""
    stream = spark.readStream.schema(SCHEMA).json(folder)
    return running_metrics(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def upsert_batch(changed: DataFrame, batch: int, store: str) -> None:
    """Writes a batch's changed runs under its own id; a batch that comes again replaces itself, so nothing counts twice."""
    changed.write.mode("overwrite").parquet(f"{store}/batch={batch:010d}")


def catch_up(spark: SparkSession, folder: str, store: str, checkpoint: str, files: int = 1) -> None:
    """Scores all files of the folder that the checkpoint hasn't seen, `files` a batch, and ends. Totals are state; only runs that changed are written (update mode)."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).json(folder)
    query = (
        running_metrics(stream).writeStream.outputMode("update").trigger(availableNow=True)
        .option("checkpointLocation", checkpoint).foreachBatch(lambda changed, batch: upsert_batch(changed, batch, store)).start()
    )
    query.awaitTermination()


def latest(spark: SparkSession, store: str) -> DataFrame:
    """(run, n, json_ok, num5) of the store: each run's row of its last batch."""
    rows = spark.read.schema("run string, n long, json_ok long, num5 long, batch long").option("basePath", store).parquet(store)
    return rows.groupBy("run").agg(F.max_by(F.struct("n", "json_ok", "num5"), "batch").alias("m")).select("run", "m.*")
