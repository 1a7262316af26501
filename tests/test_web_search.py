"""Page search for every benchmark item against all pairs of items and page chunks."""

from pyspark.sql import functions as F

from tallyweave.operators import retrieval as R
from tallyweave.plans import registry

DATA = "/root/testdata/sf0.001"


def test_against_all_pairs(spark):
    p = spark.read.parquet(f"{DATA}/pages.parquet")
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    chunks = R.page_chunks(p).join(p.select("page_id", "url"), "page_id").select(F.concat_ws("-", "page_id", "chunk_index").alias("chunk_id"), F.lit("").alias("title"), "text", "url", F.col("page_id").alias("source_rank"), "chunk_index", F.size(F.split("text", " ")).alias("words"))
    want = R.web_lexical(chunks.crossJoin(F.broadcast(items)), 10).select("query_id", "chunk_id", "score", "rank")
    got = R.web_search(chunks.repartition(3), items, 10, block=7).drop("words")
    assert sorted(got.collect()) == sorted(want.collect())
    asked = {r.query_id for r in items.collect()}
    assert {r.query_id for r in registry.QUERIES["web_retrieval"](spark, DATA).select("query_id").collect()} == asked
