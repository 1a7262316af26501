"""Rows of small groups are judged by estimates drawn towards their language's and all rows'."""

import random

from tallyweave.llm import op2_quality


def test_every_row_has_a_distance(spark):
    r = random.Random(5)
    word = lambda symbols: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) + ("%$#&*" * 3 if symbols else "")
    text = lambda symbols: " ".join(word(symbols) for _ in range(120))
    rows = [(i, text(False), "en", "large") for i in range(120)]
    rows += [(200 + i, text(i == 0), "en", f"small{i % 2}") for i in range(20)]
    rows += [(300 + i, text(i == 0), "xx", "small") for i in range(10)]
    rows += [(400, text(True), None, None), (401, text(False), None, None), (500, "too short", "en", "large")]
    got = {x.doc_id: x for x in op2_quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(rows)
    assert all((x.distance is None) == x.base_failed for x in got.values())
    assert {i for i, x in got.items() if not x.kept} == {200, 300, 400, 500}
