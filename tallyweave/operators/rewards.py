"""Rewards of completions, as columns over parsed output. Each is a sum of rule terms, clamped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..functions.programs import execute_programs
from .evaluate import scored, tool_parsed

# Factors of a scale error, and words of a percent question.
OFF = (0.001, 0.01, 0.1, 10.0, 100.0, 1000.0, 1000000.0, 1e-6)
PERCENT = ("percent", "percentage", "portion", "rate", "growth", "increase", "decrease", "decline", "change")


def term(when: Column, plus: float, minus: float = 0.0) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), plus).otherwise(minus)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.round(F.least(F.greatest(x, F.lit(low)), F.lit(high)), 6)


def scale_error(p: Column, g: Column) -> Column:
    hit = F.lit(False)
    for f in OFF:
        hit = hit | N.close(p * f, g, 0.05)
    return F.coalesce(hit & (F.abs(g) >= 1e-12), F.lit(False))


def sign_flip(p: Column, g: Column) -> Column:
    return F.coalesce((F.abs(p) >= 1e-12) & (F.abs(g) >= 1e-12) & (F.signum(p) != F.signum(g)), F.lit(False))


def answer_reward(preds: DataFrame) -> DataFrame:
    """preds (id, question, gold, raw_output) -> (id, reward) of answer and program, within [-1, 2.8]."""
    c = F.col
    df = scored(preds).withColumns({"p": N.extract_num(c("answer")), "g": N.extract_num(c("gold")), "v": c("run.result")})
    close1, close5, some, ran = c("num1"), c("num5"), c("has_program"), c("ran")
    executed = F.when(c("exec1"), 1.10).when(c("exec5"), 0.85).when(c("sexec1"), 0.75).when(c("sexec5"), 0.55).when(scale_error(c("v"), c("g")), -0.25).otherwise(0.0)
    agree = F.when(c("same5"), 0.35).when(close5 | c("sexec5"), -0.35).otherwise(0.0)
    both = c("p").isNotNull() & c("g").isNotNull()
    percent = c("gold").contains("%") | c("answer").contains("%") | F.lower(F.coalesce(c("question"), F.lit(""))).rlike("|".join(PERCENT))
    off100 = N.close(c("p") * 100, c("g"), 0.05) | N.close(c("p") / 100, c("g"), 0.05)
    score = (
        term(c("json_ok"), 0.05, -0.25) + term(F.trim("answer") != "", 0.05) + term(some, 0.05) + term(c("exact"), 0.30) + F.when(close1, 1.00).when(close5, 0.60).otherwise(0.0)
        + F.when(some, F.when(ran, executed + agree + 0.20).otherwise(-0.40)).otherwise(0.0)
        + term(both & scale_error(c("p"), c("g")) & ~close5, -0.35) + term(both & sign_flip(c("p"), c("g")), -0.30)
        + F.when(both & percent, F.when(close5, 0.10).when(off100, -0.45).otherwise(0.0)).otherwise(0.0)
        + term(F.char_length("raw_output") > 900, -0.20)
    )
    return df.select("id", clamp(score, -1.0, 2.8).alias("reward"))


def _prefixed(raw: str) -> Column:
    """Text before the first brace."""
    return F.trim(F.col(raw)).contains("{") & ~F.trim(F.col(raw)).startswith("{")


def tool_reward(preds: DataFrame) -> DataFrame:
    """preds (id, gold, raw_tool) -> (id, reward) of a tool call, within [-1, 1.7]."""
    c, df = F.col, tool_parsed(preds)
    df = df.withColumns({"s1": N.scaled_match(c("run.result"), None, c("gold"), 0.01), "s5": N.scaled_match(c("run.result"), None, c("gold"), 0.05), "j": T.is_object(T.extract_json(c("raw_tool")))})
    name = F.when(c("tool_name") == "calculator", 0.05).when(c("j"), -0.10).otherwise(0.0)
    some = F.trim("program") != ""
    score = (
        term(c("j"), 0.05, -0.20) + name + term(some, 0.05, -0.20) + F.when(some, term(c("run.ok"), 0.30, -0.30)).otherwise(0.0) + F.when(c("s1"), 1.00).when(c("s5"), 0.50).otherwise(0.0)
        + term(sign_flip(c("run.result"), N.extract_num(c("gold"))) & ~c("s5"), -0.30) + term(_prefixed("raw_tool"), -0.20) + term(F.char_length("raw_tool") > 700, -0.20)
    )
    return df.select("id", clamp(score, -1.0, 1.7).alias("reward"))


def route_reward(rows: DataFrame) -> DataFrame:
    """rows (id, raw, gold_tool) -> (id, reward) of choosing a tool; a tool of the same class gets part of it; within [-1, 1.5]."""
    c = F.col
    df = rows.withColumn("_v", T.extract_json(c("raw")))
    json, tool = T.is_object(c("_v")), F.coalesce(T.field(c("_v"), "$.tool_call.name"), F.lit(""))
    action = T.field(c("_v"), "$.action") == "tool_call"
    bare = F.trim(c("raw")).startswith("{") & F.trim(c("raw")).endswith("}")
    same = F.split_part(tool, F.lit("."), F.lit(1)) == F.split_part(c("gold_tool"), F.lit("."), F.lit(1))
    hit = F.when(tool == c("gold_tool"), 1.20).when(same & (tool != ""), 0.25).otherwise(-0.15)
    score = term(json, 0.08, -0.45) + term(bare, 0.04, -0.10) + term(action, 0.08, -0.25) + term(tool != "", 0.08, -0.20) + hit + term(F.char_length("raw") > 600, -0.20)
    return df.select("id", clamp(score, -1.0, 1.5).alias("reward"))


def mixed_reward(rows: DataFrame) -> DataFrame:
    """rows (id, task_type, raw_tool, gold, gold_tool) -> (id, reward): program rows within [-1.2, 2], route_replay rows within [-1, 1.3]."""
    c = F.col
    df = execute_programs(tool_parsed(rows).drop("run"), "program", "run", "lenient").withColumn("_v", T.extract_json(c("raw_tool")))
    j, some = T.is_object(c("_v")), F.trim("program") != ""
    action = T.field(c("_v"), "$.action") == "tool_call"
    s1, s5 = N.scaled_match(c("run.result"), None, c("gold"), 0.01), N.scaled_match(c("run.result"), None, c("gold"), 0.05)
    prog = (
        term(j, 0.10, -0.40) + term(action, 0.05, -0.30) + F.when(c("tool_name") == "calculator", 0.10).when(c("tool_name") != "", -0.30).otherwise(0.0) + term(some, 0.05, -0.20)
        + F.when(some, term(c("run.ok"), 0.20, -0.30)).otherwise(0.0) + term(s5, 1.00) + term(s1, 0.50) + term(sign_flip(c("run.result"), N.extract_num(c("gold"))), -0.20) + term(_prefixed("raw_tool"), -0.10) + term(F.char_length("raw_tool") > 900, -0.10)
    )
    same = F.split_part(c("tool_name"), F.lit("."), F.lit(1)) == F.split_part(c("gold_tool"), F.lit("."), F.lit(1))
    route = term(j, 0.10, -0.40) + term(action, 0.10, -0.30) + F.when(c("tool_name") == c("gold_tool"), 1.00).when(same & (c("tool_name") != ""), 0.20).otherwise(-0.20) + term(F.char_length("raw_tool") > 700, -0.10)
    return df.select("id", F.when(c("task_type") == "route_replay", clamp(route, -1.0, 1.3)).otherwise(clamp(prog, -1.2, 2.0)).alias("reward"))


def group_spread(rewards: DataFrame, by: str = "prompt_id") -> DataFrame:
    """Mean and population deviation of each prompt's rewards; a deviation of 0 carries no signal."""
    return rewards.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg("reward"), 6).alias("mean"), F.round(F.stddev_pop("reward"), 6).alias("std")).withColumn("no_signal", F.col("std") == 0)


def advantages(rewards: DataFrame, by: str = "prompt_id") -> DataFrame:
    """Each reward's place in its prompt's group, in deviations (0 without spread)."""
    w = Window.partitionBy(by)
    sd = F.stddev_pop("reward").over(w)
    return rewards.withColumn("advantage", F.when(sd > 0, (F.col("reward") - F.avg("reward").over(w)) / sd).otherwise(0.0))
