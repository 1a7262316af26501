"""Calculator programs in a column, run in the JVM by a fold over their steps.

Patterns are possessive and hold no nested repetition, so a long argument can't exhaust the regex engine's stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import CONSTANTS, normalize_number

# Operations of the two dialects.
LENIENT = ("add", "subtract", "multiply", "divide", "average", "max", "min", "greater", "less", "exp")
STRICT = ("add", "subtract", "multiply", "divide", "exp", "greater")
STEP = r"[A-Za-z_][A-Za-z0-9_]*+\s*+\([^()]*+\)"
# What stands for brackets and commas within a call's brackets.
HIDDEN, SHOWN = "\u0002\u0003\u0004", "(),"


def bound(value: Column, then) -> Column:
    """then(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), then), 0)


def _flat(text: Column) -> Column:
    """The text with brackets and commas inside calls hidden, to any depth; each piece from one bracket to the next is looked at once."""

    def piece(acc: Column, x: Column) -> Column:
        opens, closes = x.startswith("("), x.startswith(")")
        depth = F.when(opens, acc["depth"] + 1).when(closes, acc["depth"] - 1).otherwise(acc["depth"])
        inside = F.when(closes, acc["depth"] > 1).otherwise(depth > 1)
        shown = F.when(inside, F.concat(F.translate(F.substring(x, 1, 1), SHOWN, HIDDEN), F.when(depth > 1, F.translate(F.substring(x, F.lit(2), F.char_length(x)), SHOWN, HIDDEN)).otherwise(F.substring(x, F.lit(2), F.char_length(x))))).otherwise(x)
        return F.struct(F.greatest(depth, F.lit(0)).alias("depth"), F.concat(acc["text"], shown).alias("text"))

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"))
    return F.when(text.rlike(r"\([^()]*+\("), F.aggregate(F.split(text, r"(?=[()])"), start, piece, lambda a: a["text"])).otherwise(text)


def _strict_number(token: Column) -> Column:
    known = F.create_map(*[F.lit(x) for k, v in CONSTANTS.items() if k != "const_0" for x in (k, v)])
    bare = F.translate(token, ",$%", "")
    signed = F.when(bare.startswith("(") & bare.endswith(")"), F.concat(F.lit("-"), F.substring(bare, F.lit(2), F.char_length(bare) - 2))).otherwise(bare)
    plain = F.when(F.trim(signed).rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), F.trim(signed)).try_cast("double")
    return F.coalesce(F.try_element_at(known, token), plain)


def _apply(op: Column, v: Column) -> Column:
    """The operation's value; null where its arguments don't allow it."""
    a, b, two = F.get(v, 0), F.get(v, 1), F.size(v) == 2
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return (
        F.when(op == "add", total)
        .when(op == "multiply", F.aggregate(v, F.lit(1.0), lambda s, x: s * x))
        .when((op == "average") & (F.size(v) > 0), F.try_divide(total, F.size(v)))
        .when(op == "max", F.array_max(v))
        .when(op == "min", F.array_min(v))
        .when(two & (op == "subtract"), a - b)
        .when(two & (op == "divide") & (F.abs(b) >= 1e-12), F.try_divide(a, b))
        .when(two & (op == "greater"), (a > b).cast("double"))
        .when(two & (op == "less"), (a < b).cast("double"))
        .when(two & (op == "exp"), F.pow(a, b))
    )


def run_program(program: Column, dialect: str = "lenient") -> Column:
    """struct<ok, result, values, ops, error> of a program; errors are values, never failures.

    lenient: ten operations, any number of arguments where that makes sense, an operand is the first number in its text. strict: six
    operations of two arguments that parse whole. `#k` is the k-th step's result.
    """
    ops = LENIENT if dialect == "lenient" else STRICT
    shown = lambda t: F.translate(F.btrim(F.trim(t), F.lit("\"'")), HIDDEN, SHOWN)
    parsed = lambda steps: F.transform(
        steps,
        lambda s: F.struct(
            F.regexp_extract(s, r"^([A-Za-z_][A-Za-z0-9_]*+)", 1).alias("op"),
            F.filter(F.transform(F.split(F.regexp_extract(s, r"\(([^()]*+)\)", 1), ","), shown), lambda t: t != "").alias("args"),
        ),
    )
    number = normalize_number if dialect == "lenient" else _strict_number

    def value(values: Column, token: Column) -> Column:
        return F.when(token.rlike(r"^#\d+$"), F.get(values, F.substring(token, 2, 9).try_cast("int"))).otherwise(number(token))

    def step(acc: Column, s: Column) -> Column:
        args = F.transform(s["args"], lambda t: value(acc["values"], t))
        got = bound(args, lambda v: F.when(~F.exists(v, lambda x: x.isNull()) & (F.lit(dialect == "lenient") | (F.size(v) == 2)), _apply(s["op"], v)))
        failed = lambda why: F.struct(acc["values"].alias("values"), acc["ops"].alias("ops"), why.alias("error"))
        went = lambda x: F.when(
            F.abs(x) < float("inf"), F.struct(F.concat(acc["values"], F.array(x)).alias("values"), F.concat(acc["ops"], F.array(s["op"])).alias("ops"), F.lit(None).cast("string").alias("error"))
        ).otherwise(failed(F.lit("bad arguments")))
        return F.when(acc["error"].isNotNull(), acc).when(~s["op"].isin(*ops), failed(F.concat(F.lit("unsupported op "), s["op"]))).otherwise(bound(got, went))

    start = F.struct(F.array().cast("array<double>").alias("values"), F.array().cast("array<string>").alias("ops"), F.lit(None).cast("string").alias("error"))

    def read(text: Column) -> Column:
        shaped = F.regexp_replace(text, STEP, "\u0001").rlike("^[\\s,]*+(?:\u0001\\s*+(?:,[\\s,]*+|$))*+$")
        steps = F.regexp_extract_all(text, F.lit(STEP), F.lit(0))
        return F.struct(steps.alias("steps"), F.when(~shaped, F.lit("bad step")).when(F.size(steps) == 0, F.lit("empty program")).alias("bad"))

    def run(x: Column) -> Column:
        done = F.when(x["bad"].isNull(), F.aggregate(parsed(x["steps"]), start, step)).otherwise(F.struct(start["values"].alias("values"), start["ops"].alias("ops"), x["bad"].alias("error")))
        return bound(done, lambda a: F.struct(a["error"].isNull().alias("ok"), F.when(a["error"].isNull(), F.element_at(a["values"], -1)).alias("result"), a["values"].alias("values"), a["ops"].alias("ops"), a["error"].alias("error")))

    return bound(bound(_flat(F.coalesce(program, F.lit(""))), read), run)


def execute_programs(df: DataFrame, program: str = "program", into: str = "run", dialect: str = "lenient") -> DataFrame:
    """df with the column `into`. Null programs: error 'empty program'. Programs run where their rows are: a run costs less than a shuffle of the row."""
    return df.withColumn(into, run_program(F.col(program), dialect))


def operators_of(program: Column) -> Column:
    """Names followed by a bracket, in order."""
    return F.regexp_extract_all(F.coalesce(program, F.lit("")), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))
