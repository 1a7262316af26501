"""Disk of the pipeline's stages: tables and shuffled texts that nothing reads any more don't stay."""

import os
from urllib.parse import urlparse

from tallyweave.llm.common import shared_dir
from tallyweave.llm.near_dedup import keep_one_each
from tallyweave.llm.op2_quality import keep_good


def test_tables_are_given_back(spark):
    rows = [(i, " ".join(f"w{(i // 2 * 37 + j) % 997}" for j in range(60 + i % 2))) for i in range(40)]
    at = urlparse(shared_dir(spark)).path
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    assert keep_one_each(spark.createDataFrame(rows, "doc_id long, text string")).count() == 20
    left = {x.rpartition("-")[0] for x in set(os.listdir(at)) - before}
    assert not left & {"features", "twice", "shared", "leaders", "prefixes", "rooted", "mixed", "buckets", "candidates", "packed", "sides", "wanted", "pairs"}


def test_quality_moves_no_text(spark):
    rows = [(i, " ".join(f"w{(i * 37 + j * j) % 997}" for j in range(60)) if i % 3 else "too short", "en", "a") for i in range(30)]
    got = keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert "LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.doc_id for r in got.collect()} == {i for i in range(30) if i % 3}
