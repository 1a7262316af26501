"""Tool use: action scoring, recorded calls, templated traces and rows for preference training."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from .datasets import capped
from .evaluate import rate


def canonical_args(args: Column) -> Column:
    """Arguments as JSON text with sorted keys: a join key."""
    return F.to_json(F.try_parse_json(args))


def action_metrics(rows: DataFrame, actions: tuple[str, ...] = ("tool_call", "final")) -> DataFrame:
    """rows (raw, gold_action, gold_tool) -> one row: JSON, no extra text, action and tool rates over all rows, tool rates on gold tool turns too."""
    df = rows.withColumn("_v", T.extract_json(F.col("raw")))
    df = df.withColumns({"j": T.is_object(F.col("_v")), "action": F.coalesce(T.field(F.col("_v"), "$.action"), F.lit("")), "tool": F.coalesce(T.field(F.col("_v"), "$.tool_call.name"), F.lit(""))})
    bare = F.trim("raw").startswith("{") & F.trim("raw").endswith("}")
    turn = F.col("gold_action") == "tool_call"
    right = (F.col("tool") == F.coalesce("gold_tool", F.lit(""))) & F.col("j")
    return df.agg(F.count("*").alias("num_samples"), rate(F.col("j")).alias("json_valid_rate"), rate(bare).alias("no_extra_text_rate"), rate(F.col("action").isin(*actions)).alias("action_valid_rate"), rate(F.col("action") == F.col("gold_action")).alias("action_accuracy"), rate(F.col("tool") != "").alias("tool_valid_rate"), rate(right).alias("tool_accuracy"), rate(right, turn).alias("tool_accuracy_on_gold_tool_turns"))


def observation_cache(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, tool, args, text): a call's observation is the next message; (tool, args) -> observation, the last one seen wins."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    df = messages.withColumns({"observation": F.lead("text").over(w), "args": canonical_args(F.col("args"))}).where("tool is not null and observation is not null")
    return df.groupBy("tool", "args").agg(F.max_by("observation", F.struct("conv_id", "turn")).alias("observation"))


def replay_calls(calls: DataFrame, cache: DataFrame) -> DataFrame:
    """calls (id, tool, args) with the cached observation; unknown tools and arguments get an error."""
    known = cache.select("tool").distinct().withColumn("known", F.lit(True))
    df = calls.withColumn("args", canonical_args(F.col("args"))).join(cache, ["tool", "args"], "left").join(known, "tool", "left")
    return df.withColumn("error", F.when(F.col("known").isNull(), F.concat(F.lit("unknown tool "), "tool")).when(F.col("observation").isNull(), "no recorded observation")).drop("known")


def fact_lookup(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """requests (id, symbol, metric, period) -> value and unit; names match whatever their case; absent facts get an error."""
    f = facts.select(F.upper("symbol").alias("symbol"), F.lower("metric").alias("metric"), F.upper("period").alias("period"), "value", "unit")
    r = requests.select("id", F.upper("symbol").alias("symbol"), F.lower("metric").alias("metric"), F.upper("period").alias("period"))
    return r.join(f, ["symbol", "metric", "period"], "left").withColumn("error", F.when(F.col("value").isNull(), "not found"))


def growth_traces(facts: DataFrame) -> DataFrame:
    """facts (symbol, metric, period, value) -> a question, program and answer for each period that follows another."""
    w = Window.partitionBy("symbol", "metric").orderBy("period")
    df = facts.withColumns({"before": F.lag("value").over(w), "since": F.lag("period").over(w)}).where("before is not null and before <> 0")
    value = lambda c: F.col(c).cast("string")
    question = F.concat(F.lit("How much did "), "metric", F.lit(" of "), "symbol", F.lit(" grow from "), value("since"), F.lit(" to "), value("period"), F.lit("?"))
    program = F.concat(F.lit("subtract("), value("value"), F.lit(", "), value("before"), F.lit("), divide(#0, "), value("before"), F.lit(")"))
    return df.select("symbol", "metric", "period", question.alias("question"), program.alias("program"), F.round((F.col("value") - F.col("before")) / F.col("before"), 6).alias("answer"))


def tool_rows(preds: DataFrame, instruction: str) -> DataFrame:
    """(id, question, program) -> chat rows whose answer is a calculator call."""
    call = F.to_json(F.struct(F.lit("tool_call").alias("action"), F.struct(F.lit("calculator").alias("name"), F.struct("program").alias("arguments")).alias("tool_call")))
    msg = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return preds.select("id", F.array(msg("system", F.lit(instruction)), msg("user", F.col("question")), msg("assistant", call)).alias("messages"))


def mixed_pairs(candidates: DataFrame, caps: dict[str, int], seed: int) -> DataFrame:
    """candidates (id, status, raw, gold_call, gold) -> preference pairs: wrong ones against the gold call, right ones against the gold answer said directly."""
    kind = F.when(F.col("status") == "scaled_correct", "anchor").otherwise("wrong")
    rejected = F.when(F.col("kind") == "anchor", direct_answer(F.col("gold"))).when(F.trim("raw") == "", F.lit('{"action":"final","answer":""}')).otherwise(F.trim("raw"))
    df = candidates.withColumn("kind", kind).withColumn("rejected", rejected)
    return capped(df, caps, "kind", seed).select("id", "kind", F.col("gold_call").alias("chosen"), "rejected")


def direct_answer(answer: Column) -> Column:
    """A final action as its writer spaces it."""
    said = F.to_json(F.array(F.coalesce(answer, F.lit(""))))
    return F.concat(F.lit('{"action": "final", "answer": '), F.substring(said, F.lit(2), F.length(said) - 2), F.lit("}"))


def replay_pairs(turns: DataFrame, cap: int, seed: int) -> DataFrame:
    """turns (id, chosen) of other sources -> up to `cap` pairs in hash order: a tool call against a call of the wrong tool, another answer against an empty one."""
    v = T.extract_json(F.col("chosen"))
    call = T.is_object(v) & (T.field(v, "$.action") == "tool_call") & T.is_object(F.try_variant_get(v, "$.tool_call", "variant"))
    rejected = F.when(F.coalesce(call, F.lit(False)), F.lit('{"action": "tool_call", "tool_call": {"name": "web_search", "arguments": {"query": ""}}}')).otherwise(direct_answer(F.lit("")))
    kept = capped(turns.where("chosen <> ''").withColumn("kind", F.lit("replay")), {"replay": cap}, "kind", seed)
    return kept.select("id", "kind", "chosen", rejected.alias("rejected"))


def repair_rows(runs: DataFrame) -> DataFrame:
    """runs (id, question, program, run): a prompt for each program that is missing or fails."""
    why = F.when(F.trim("program") == "", F.lit("The program is missing.")).otherwise(F.concat(F.lit("The program failed: "), "run.error", F.lit(".")))
    return runs.where(~F.col("run.ok")).select("id", F.concat_ws("\n", F.col("question"), F.concat(F.lit("Program: "), "program"), why, F.lit("Write a valid program.")).alias("prompt"))


def api_name(text: Column) -> Column:
    """Name in `API-Request: [Name(k='v')]`."""
    return F.regexp_extract(text, r"API-Request:\s*\[\s*([A-Za-z_][A-Za-z0-9_.]*)\s*\(", 1)


@F.pandas_udf(StringType())
def api_arguments(text: pd.Series) -> pd.Series:
    """Keyword literals of an API request as JSON; what isn't a literal is kept raw. Literals need Python's own reader."""

    def one(s: str | None) -> str | None:
        try:
            call = ast.parse(s[s.index("[") + 1 : s.rindex("]")].strip(), mode="eval").body
            return json.dumps({k.arg: ast.literal_eval(k.value) for k in call.keywords}, sort_keys=True, allow_nan=False)
        except (ValueError, SyntaxError, AttributeError, TypeError, RecursionError, MemoryError):
            return json.dumps({"raw": s})

    return text.map(one)


def amount(text: Column) -> Column:
    """Dollars in `$1.2 Trillion`, `Billion` or `Million`; no such amount: null."""
    number = F.regexp_extract(text, r"(?i)\$\s*([\d,]+(?:\.\d+)?)\s*(trillion|billion|million)", 1)
    unit = F.lower(F.regexp_extract(text, r"(?i)\$\s*[\d,]+(?:\.\d+)?\s*(trillion|billion|million)", 1))
    size = F.when(unit == "trillion", 1e12).when(unit == "billion", 1e9).when(unit == "million", 1e6)
    return F.translate(number, ",", "").try_cast("double") * size


def compact_usd(x: Column) -> Column:
    """A dollar amount with three decimals in trillions, billions or millions."""
    by = lambda size, name: F.concat(F.lit("$"), F.format_string("%.3f", x / size), F.lit(name))
    return F.when(F.abs(x) >= 1e12, by(1e12, " trillion")).when(F.abs(x) >= 1e9, by(1e9, " billion")).when(F.abs(x) >= 1e6, by(1e6, " million")).otherwise(F.concat(F.lit("$"), F.format_string("%.2f", x)))


def tagged(text: Column, tag: str) -> Column:
    """What follows `<<<tag>>>:` up to the next tag."""
    return F.regexp_extract(text, rf"(?s)<<<{tag}>>>\s*:?\s*(.*?)\s*(?=<<<|\z)", 1)


def coordinates(text: Column) -> Column:
    """First point (x, y) or box of a prediction on the 0-1000 grid: struct<x, y, out_of_range>; a box gives its centre."""
    nums = F.transform(F.slice(F.regexp_extract_all(text, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), 1, 4), lambda n: n.cast("double"))
    x = F.when(F.size(nums) >= 4, (F.get(nums, 0) + F.get(nums, 2)) / 2).otherwise(F.get(nums, 0))
    y = F.when(F.size(nums) >= 4, (F.get(nums, 1) + F.get(nums, 3)) / 2).otherwise(F.get(nums, 1))
    fit = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1000.0))
    return F.when(F.size(nums) >= 2, F.struct(fit(x).alias("x"), fit(y).alias("y"), ((x < 0) | (x > 1000) | (y < 0) | (y > 1000)).alias("out_of_range")))


def evidence_grid(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...], spans: tuple[tuple[int, int], ...], queries: DataFrame | None = None) -> DataFrame:
    """ranked (query_id, chunk_index, rank), gold (query_id, chunk_index): recall and size of top-k evidence with neighbours, for every setting.

    One pass for all settings; queries without gold count as 0, and so do queries (query_id) without ranked rows.
    """
    settings = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("before"), F.lit(b).alias("after")) for k in ks for a, b in spans]))
    rows = ranked.withColumn("s", settings).where(F.col("rank") <= F.col("s.k"))
    near = rows.select("query_id", "s.k", "s.before", "s.after", F.explode(F.sequence(F.col("chunk_index") - F.col("s.before"), F.col("chunk_index") + F.col("s.after"))).alias("chunk_index")).distinct()
    hit = near.join(gold.distinct().withColumn("g", F.lit(1)), ["query_id", "chunk_index"], "left")
    sizes = gold.distinct().groupBy("query_id").agg(F.count("*").alias("n_gold"))
    per = hit.groupBy("k", "before", "after", "query_id").agg(F.count("*").alias("n"), F.count("g").alias("h"))
    if queries is not None:
        every = queries.select("query_id").distinct().withColumn("s", settings).select("s.k", "s.before", "s.after", "query_id")
        per = every.join(per, ["k", "before", "after", "query_id"], "left").fillna(0, ["n", "h"])
    per = per.join(sizes, "query_id", "left")
    return per.groupBy("k", "before", "after").agg(
        F.count("*").alias("num_queries"), F.round(F.avg((F.col("h") > 0).cast("double")), 9).alias("any_recall"), F.round(F.avg(F.coalesce(F.col("h") == F.col("n_gold"), F.lit(False)).cast("double")), 9).alias("all_recall"),
        F.round(F.avg(F.coalesce(F.col("h") / F.col("n_gold"), F.lit(0.0))), 9).alias("coverage"), F.round(F.avg("n"), 9).alias("avg_chunks"),
    )


def comparison(metrics: DataFrame, runs: DataFrame, names: list[str]) -> DataFrame:
    """metrics (run, name, value), runs (run, title): a row a run, percent with two decimals; what is missing shows a dash."""
    wide = metrics.where(F.col("name").isin(*names)).groupBy("run").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])
    pct = lambda n: F.coalesce(F.format_string("%.2f", F.round(F.col(n) * 100, 2)), F.lit("-")).alias(n)
    shown = lambda n: F.when(F.col(n).isNull(), "-").otherwise(pct(n)).alias(n)
    return runs.join(wide, "run", "left").select("run", "title", *[shown(n) for n in names])


def calculator_observation(runs: DataFrame) -> DataFrame:
    """runs (id, run) of programs -> what the calculator tells: result as text, in billions, and the dollar forms; a failed run has its error alone."""
    v, ok = F.col("run.result"), F.col("run.ok")
    when = lambda c: F.when(ok, c)
    return runs.select("id", ok.alias("ok"), when(v).alias("raw_result"), when(v / 1e9).alias("billion"), when(F.abs(v) / 1e9).alias("abs_billion"), when(compact_usd(v)).alias("formatted_usd"), when(compact_usd(F.abs(v))).alias("abs_formatted_usd"), "run.error")


def cagr_traces(facts: DataFrame) -> DataFrame:
    """facts (symbol, metric, period, value) -> yearly growth from the first to the last period of each: question, program, answer; one period or a first value of 0 or less: no row."""
    ends = facts.groupBy("symbol", "metric").agg(F.min_by(F.struct("period", "value"), "period").alias("a"), F.max_by(F.struct("period", "value"), "period").alias("z"))
    ends = ends.select("symbol", "metric", F.col("a.period").alias("since"), F.col("a.value").alias("first"), F.col("z.period").alias("until"), F.col("z.value").alias("last"), (F.col("z.period") - F.col("a.period")).alias("years")).where("years > 0 and first > 0")
    text = lambda c: F.col(c).cast("string")
    question = F.concat(F.lit("What was the yearly growth of "), "metric", F.lit(" of "), "symbol", F.lit(" from "), text("since"), F.lit(" to "), text("until"), F.lit("?"))
    program = F.concat(F.lit("divide("), text("last"), F.lit(", "), text("first"), F.lit("), divide(1, "), text("years"), F.lit("), exp(#0, #1), subtract(#2, 1)"))
    return ends.select("symbol", "metric", question.alias("question"), program.alias("program"), F.round(F.pow(F.col("last") / F.col("first"), 1.0 / F.col("years")) - 1, 6).alias("answer"))
