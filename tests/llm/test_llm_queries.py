"""The registered queries on the smallest tables, those with SQL against DuckDB, and the pipeline."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from tallyweave.llm import queries

DATA = "/root/testdata/sf0.001"


def rows(df):
    clean = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) else v
    return sorted((tuple(clean(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet{'/*.parquet' if Path(f'{DATA}/{t}.parquet').is_dir() else ''}'")
    assert rows(queries.QUERIES[name](spark, DATA).toPandas()) == rows(con.sql(queries.ORACLE_SQL[name]).df())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = set()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        want = {r.doc_id for r in docs.select("doc_id").collect()}
    got = corpus_pipeline.run(spark, DATA)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == want
    bench = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert not any(b in r.text for r in docs.collect() for b in bench)
