"""Quotas over overlapping pools, expressions, number texts, budgets, SQL names, tools, streams, metrics documents, splits and profiles."""

import ast
import json
import math
import random
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import numeric as N
from tallyweave.functions import surface
from tallyweave.functions import text as T
from tallyweave.functions.infix import infix_value
from tallyweave.operators import assembly as B
from tallyweave.operators import evaluate as E
from tallyweave.operators import evidence as V
from tallyweave.operators import quotas as Q
from tallyweave.operators import retrieval as R
from tallyweave.operators.agents import api_arguments
from tallyweave.sources import io as S
from tallyweave.streaming import running


def place(i, seed=7):
    return md5(f"{seed}:{i}".encode()).hexdigest(), i


def brute(rows, pools, total):
    taken = {}
    for name, limit in pools:
        for i in sorted((i for i, p in rows.items() if name in p and i not in taken), key=place)[:limit]:
            taken[i] = name
    names = [n for n, _ in pools]
    rest = sorted((min(names.index(p) for p in ps if p in names), *place(i)) for i, ps in rows.items() if i not in taken and any(p in names for p in ps))
    for _, _, i in rest[: max(total - len(taken), 0)]:
        taken[i] = "top_up"
    return dict(list(taken.items())[:total])


@pytest.mark.parametrize("total", [5, 40, 60, 500])
def test_quotas(spark, total):
    rng = random.Random(total)
    rows = {i: [p for p in ("a", "b", "c", "other") if rng.random() < 0.4] for i in range(200)}
    pools = [("a", 20), ("b", 15), ("c", 10)]
    df = spark.createDataFrame([(i, p) for i, p in rows.items()] * 2, "id long, pools array<string>")
    got = {r.id: r.pool for r in Q.allocated(df, pools, total, 7).collect()}
    assert got == brute(rows, pools, total)
    assert Q.allocated(df.limit(0), pools, total, 7).collect() == []


def test_few_wrong_rows_still_fill_the_hard_set(spark):
    rows = spark.range(3000).select("id", (F.col("id") >= 20).alias("correct"), F.lit("ratio").alias("category"))
    got = Q.hard_set(rows).groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in got} == {"sft_wrong": 20, "category_focus": 650, "anchor_correct": 350, "sft_correct": 1480}


def test_an_id_stands_under_each_of_its_tags(spark):
    preds = spark.createDataFrame([(1, True, True), (2, False, True), (3, None, None)], "id long, correct boolean, hard boolean")
    replay = spark.createDataFrame([("x", "search"), ("y", ""), ("z", None)], "id string, gold_tool string")
    got = {(r.id, r.tag, r.gold_tool) for r in Q.reward_mixture(preds, replay, {"wrong": 5, "anchor": 5, "keyword": 1, "replay": 5}).collect()}
    hard = min("12", key=lambda i: (md5(f"27:{i}".encode()).hexdigest(), i))
    assert got == {("2", "wrong", None), ("3", "wrong", None), ("1", "anchor", None), (hard, "keyword", None), ("x", "replay", "search")}


def python_value(s):
    """The expression by Python's own parser."""
    calls = {"abs": abs, "min": min, "max": max, "round": round, "sum": lambda *x: sum(x)}

    def value(n):
        if isinstance(n, ast.Constant):
            return float(n.value)
        if isinstance(n, ast.UnaryOp):
            return -value(n.operand) if isinstance(n.op, ast.USub) else value(n.operand)
        if isinstance(n, ast.Call):
            return float(calls[n.func.id](*map(value, n.args)))
        x, y = value(n.left), value(n.right)
        if isinstance(n.op, ast.Pow) and abs(y) > 64:
            raise ValueError
        return float({ast.Add: lambda: x + y, ast.Sub: lambda: x - y, ast.Mult: lambda: x * y, ast.Div: lambda: x / y, ast.Mod: lambda: x % y, ast.Pow: lambda: x**y}[type(n.op)]())

    try:
        v = value(ast.parse(s.strip(), mode="eval").body)
        return v if abs(v) < float("inf") else None
    except (ValueError, ZeroDivisionError, OverflowError, TypeError):
        return None


def expression(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice(["2", "3", "7.5", ".5", "4.", "1e2", "12"])
    a, b = expression(rng, depth - 1), expression(rng, depth - 1)
    return rng.choice([f"{a} + {b}", f"{a}-{b}", f"({a})*{b}", f"{a} / ({b})", f"({a}) % ({b})", f"-{a}", f"--{a}", f"+ -{a}", f"2 ** -{rng.choice('123')}", f"-2**2", f"2**3**{rng.choice('01')}", f"({a} - {b})", f"min({a}, {b}, 3)", f"max({a}, abs({b}))", f"sum({a}, {b})", f"{a} - -{b}"])


def test_expressions(spark):
    rng = random.Random(1)
    said = [expression(rng, 4) for _ in range(300)]
    got = [r.v for r in spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select("i", infix_value(F.col("s")).alias("v")).orderBy("i").collect()]
    for s, v in zip(said, got, strict=True):
        want = python_value(s)
        assert (v is None) == (want is None) and (v is None or math.isclose(v, want, rel_tol=1e-9, abs_tol=1e-9)), (s, v, want)


def test_hostile_expressions(spark):
    bad = ["", None, "1 2", "2 * * 3", "1 +", "(1", "1)", "()", "min()", "min(1,)", "1,2(3)", "f(2)", "__import__('os')", "1/0", "9**99", "0**-1", "1e999", "(" * 20_000, "1**" * 5_000 + "1", "1e+-5", "2 // 3", "abs(1, 2)", "min", "2 min(1)", "a" * 10_000]
    good = [("-" * 20_000 + "3", 3.0), ("1+" * 20_000 + "1", 20001.0), ("(" * 150 + "7" + ")" * 150, 7.0), ("1,000 + 1", 1001.0), ("-7 % 3", 2.0), ("round(2.5)", 2.0), ("round(1.2345, 2)", 1.23), (" 2** -1*3", 1.5)]
    rows = [(i, s) for i, s in enumerate([*bad, *(g for g, _ in good)])]
    got = [r.v for r in spark.createDataFrame(rows, "i int, s string").select("i", infix_value(F.col("s")).alias("v")).orderBy("i").collect()]
    assert got[: len(bad)] == [None] * len(bad), [b for b, v in zip(bad, got) if v is not None]
    assert got[len(bad) :] == [g for _, g in good]


def test_arguments_that_break_the_reader_are_kept_raw(spark):
    rows = [("[F(x=" + "1+" * 50_000 + "1)]",), ("[F(x=" + "-" * 20_000 + "1)]",), ("[F(x=1e999)]",), ("[F(x=2)]",)]
    got = [r.a for r in spark.createDataFrame(rows, "s string").select(api_arguments("s").alias("a")).collect()]
    assert [("raw" in json.loads(a)) for a in got] == [True, True, True, False]


def test_number_texts(spark):
    values = [0.0, -0.0, 1.0, 0.5, 1 / 3, 123456.789, 999.5, 1000.0, 1e9, 12345678901.5, 1e-4, 1.5e-5, 1e-310, 2.5e20, -1234567.0, 0.1 + 0.2, 99999999999.25]
    got = [r.t for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", N.format_number(F.col("v")).alias("t")).orderBy("i").collect()]
    want = [str(int(round(v))) if abs(v) >= 1000 and abs(v - round(v)) < 1e-6 else f"{v:.10g}" for v in values]
    assert [w.replace("-0", "0") if w == "-0" else w for w in want] == got
    big = spark.createDataFrame([(1e50,), (float("inf"),), (float("nan"),), (None,)], "v double").select(N.format_number(F.col("v")).alias("t"), B.number_text(F.col("v")).alias("u")).collect()
    assert float(big[0].t) == 1e50 and float(big[0].u) == 1e50 and big[3].t == ""


def test_token_budget(spark):
    rng = random.Random(2)
    rows = [(q, rank, rng.randrange(6), rng.randrange(12), rng.randrange(1, 9)) for q in range(20) for rank in range(15)]
    df = spark.createDataFrame(rows, "query_id long, rank int, unit long, chunk_id long, tokens int")
    want = set()
    for q in range(20):
        units, used, seen = {}, 0, set()
        for _, rank, unit, chunk, n in (r for r in rows if r[0] == q):
            first, items = units.get(unit, (rank, {}))
            items[chunk] = max(n, items.get(chunk, 0))
            units[unit] = (min(first, rank), items)
        for unit, (_, items) in sorted(units.items(), key=lambda u: (u[1][0], u[0])):
            new = {c: n for c, n in items.items() if c not in seen}
            if used + sum(new.values()) <= 25:
                used += sum(new.values())
                seen |= set(new)
                want |= {(q, c, unit) for c in new}
    assert {tuple(r) for r in R.token_budget(df, 25).collect()} == want
    assert {tuple(r) for r in R.token_budget(df.drop("tokens").withColumn("tokens", F.lit(99)), 25, length=F.lit(0)).select("query_id", "chunk_id").collect()} == {(r[0], r[3]) for r in rows}


def test_rank_tokens_and_priors(spark):
    got = spark.createDataFrame([("The Official C++ look-up a b of foo_bar foo_bar",)], "s string").select(T.rank_tokens(F.col("s")).alias("t")).first().t
    assert got == ["c++", "look-up", "foo_bar", "foo_bar"]
    rows = spark.createDataFrame([(1, 1, "official acme acme documentation", "Acme", "https://www.acme.com/x"), (1, 2, "official acme", "x", "https://docs.acme-x.org/official"), (2, 3, "acme", "x", "https://acme.com")], "query_id int, chunk_id int, query string, title string, href string")
    assert {r.chunk_id: r.prior for r in R.source_prior(rows).collect()} == {1: 12.0, 2: 1.0, 3: 0.0}


def test_sql_names_and_tools(spark):
    surface.register(spark)
    surface.register(spark)
    got = spark.sql("""SELECT extract_num('a -1,234.5%') AS n, scaled_match(50D, false, '0.5', 0.01D) AS s, is_object(json_of('```json\n{"a": 1}\n```')) AS j, route_reward('no', 'x.y') AS r, route_reward('{"action": "tool_call", "tool_call": {"name": "x.z"}}', 'x.y') AS q""").first()
    assert (got.n, got.s, got.j, got.r, got.q) == (-1234.5, True, True, -1.0, 0.53)
    surface.register_tools(spark, {"half": ({"x": "number", "why": "string?"}, lambda a: a["x"] / 2), "fail": ({}, lambda a: 1 / 0)})
    calls = [("1", "half", '{"x": 4}'), ("2", "half", '{"x": true}'), ("3", "half", "{}"), ("4", "half", "[1]"), ("5", "half", '{"x": 1, "z": 2}'), ("6", "other", None), ("7", "fail", None), ("8", "half", "{"), ("9", None, "{}")]
    spark.createDataFrame(calls, "id string, tool string, args string").createOrReplaceTempView("test_calls")
    out = {r.id: (r.result, r.error) for r in spark.sql("SELECT * FROM call_tools(TABLE(test_calls))").collect()}
    assert out["1"] == ("2.0", None) and out["2"][1] == "argument x is no number" and out["3"][1] == "missing argument x" and out["4"][1] == "arguments are no object" and out["5"][1] == "unknown argument z"
    assert out["6"][1] == "unknown tool other" and "ZeroDivisionError" in out["7"][1] and "JSONDecodeError" in out["8"][1] and out["9"][1] == "unknown tool None"


def test_a_stream_takes_up_where_it_ended(spark, tmp_path):
    at = {k: str(tmp_path / k) for k in ("in", "store", "checkpoint")}
    (tmp_path / "in").mkdir()
    rows = [{"run": f"r{i % 3}", "id": i, "gold": "10", "raw_output": json.dumps({"answer": str(10 + i % 2), "program": ""})} for i in range(60)]
    for n in range(6):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(map(json.dumps, rows[10 * n : 10 * n + 10])))
        if n in (2, 5):
            running.catch_up(spark, at["in"], at["store"], at["checkpoint"])
    running.catch_up(spark, at["in"], at["store"], at["checkpoint"])  # nothing new
    want = sorted(map(tuple, running.running_metrics(spark.createDataFrame(rows, running.SCHEMA)).collect()))
    assert sorted(map(tuple, running.latest(spark, at["store"]).collect())) == want
    last = max(p.name for p in (tmp_path / "store").iterdir() if p.name.startswith("batch="))
    kept = spark.read.parquet(f"{at['store']}/{last}")
    again = spark.createDataFrame(kept.collect(), kept.schema)
    running.upsert_batch(again, int(last[6:]), at["store"])  # the same batch once more
    assert sorted(map(tuple, running.latest(spark, at["store"]).collect())) == want


def test_missing_metrics(spark, tmp_path):
    one = spark.createDataFrame([(3, 0.5, "x", None)], "n long, rate double, note string, none double")
    S.write_metrics(one, one, str(tmp_path / "m"))
    stages = [("A", str(tmp_path / "m" / "metrics")), ("B", str(tmp_path / "absent"))]
    got = S.stage_summary(spark, stages, ["n", "rate", "none"]).orderBy("place").collect()
    assert [tuple(r) for r in got] == [(0, "A", False, 3.0, 0.5, None), (1, "B", True, None, None, None)]
    assert S.read_metrics(spark, {}).collect() == [] and S.read_metrics(spark, {"B": str(tmp_path / "absent")}).collect() == []


def test_splits_and_profile(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", "a"), (2, "validation", None), (3, "validation", "b" * 50)], "id long, split string, `odd name` string")
    S.write_splits(df, str(tmp_path / "s"))
    dev = S.read_split(spark, str(tmp_path / "s"), "dev")
    assert {r.id for r in dev.collect()} == {2, 3}
    plan = dev._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    got = {r.column: tuple(r)[1:] for r in E.profile(df).collect()}
    assert got == {"id": ("bigint", 3, 0, 3, "1"), "split": ("string", 3, 0, 2, "train"), "odd name": ("string", 3, 1, 2, "a")}
    assert S.write_counted(df, str(tmp_path / "c"), {"rows": F.count("*"), "odd": F.count("odd name")}) == {"rows": 3, "odd": 2}


def test_coalesced_fields(spark):
    df = spark.createDataFrame([(None, "b", ("g",)), ("a", None, (None,))], "prediction string, output string, meta struct<answer string>")
    assert [tuple(r) for r in df.select(T.coalesced(df, T.PREDICTION_KEYS), T.coalesced(df, ("answer", "meta.answer")), T.coalesced(df, ("none", "meta.none"))).collect()] == [("b", "g", None), ("a", None, None)]


def test_prompt_sections(spark):
    text = "x\nFinancial context:\nlost\nPRE-TEXT: lost\n a \n- - -\n\nTable: lost\n| h | k |\n|---|---|\n| 1 | |\nplain\nPost-text:\n|--\n\nQuestion:\nTable:\nq"
    got = [(r.section, r.line, r.cells) for r in S.report_from_prompt(spark.createDataFrame([(1, text), (2, None)], "id long, text string")).orderBy("pos").collect()]
    assert got == [("pre_text", "a", None), ("pre_text", "- - -", None), ("table", "| h | k |", ["h", "k"]), ("table", "| 1 | |", ["1"]), ("table", "plain", ["plain"]), ("post_text", "|--", None)]


def test_typed_grid(spark):
    rng = random.Random(6)
    chunks = [(s, t, i) for s in range(8) for t, n in (("pre_text", 4), ("table_header", 1), ("table_row", 6), ("post_text", 3)) for i in range(1 if t == "table_row" else 0, n + (t == "table_row"))]
    ranked, gold = [], []
    for s in range(8):
        own = [c for c in chunks if c[0] == s] + [(s, "odd", 9), (s, "table_row", 50)]
        ranked += [(s, *c, r) for r, c in enumerate(rng.sample(own, rng.randrange(0, 12)), 1)]
        gold += [(s, *c) for c in rng.sample(own, rng.randrange(0, 4))]
    known = set(chunks)

    def expand(s, t, i, tw, tb):
        if t == "table_row":
            return [(s, "table_header", 0)] + [(s, t, j) for j in range(i - tb, i + tb + 1)]
        if t == "table_header":
            return [(s, "table_row", j) for j in range(1, tb + 2)]
        return [(s, t, j) for j in range(i - tw, i + tw + 1)] if t in ("pre_text", "post_text") else []

    want = {}
    for k in (2, 5):
        for tw, tb in ((0, 0), (1, 2)):
            sizes, hits, every, counters = [], 0, 0, [{}, {}, {}]
            for s in range(9):
                seen = []
                for _, q, t, i, r in sorted((x for x in ranked if x[0] == s), key=lambda x: x[4]):
                    if r <= k:
                        seen += [c for c in [(q, t, i)] + [e for e in expand(q, t, i, tw, tb) if e in known] if c not in seen]
                seen, g = list(dict.fromkeys(seen))[:7], {x[1:] for x in gold if x[0] == s}
                sizes.append(len(seen))
                hits += bool(g & set(seen))
                every += bool(g) and g <= set(seen)
                for at, cs in zip(counters, (g, g - set(seen), seen), strict=True):
                    for c in cs:
                        name = c[1] if c in known else "unknown"
                        at[name] = at.get(name, 0) + 1
            want[k, tw, tb] = (9, round(100 * hits / 9, 2), round(100 * every / 9, 2), sorted(sizes)[int(0.95 * 9) - 1], *counters)
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    grid = V.typed_grid(
        make(ranked, "query_id long, sample_id long, chunk_type string, chunk_index int, rank int"), make(chunks, "sample_id long, chunk_type string, chunk_index int"),
        make(gold, "query_id long, sample_id long, chunk_type string, chunk_index int"), make([(s,) for s in range(9)], "query_id long"), (2, 5), ((0, 0), (1, 2)), 7,
    )
    got = {(r.k, r.text_window, r.table_window): (r.num_queries, r.any_recall, r.all_recall, r.p95_evidence_chunks, r.gold_types or {}, r.missed_types or {}, r.evidence_types or {}) for r in grid.collect()}
    assert got == want
