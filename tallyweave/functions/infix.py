"""Arithmetic expressions in a column, evaluated in the JVM: operator precedence by a fold over the tokens with two stacks in arrays.

Anything that isn't an expression of numbers, + - * / % **, signs, brackets and the calls abs, min, max, round and sum gives null: so does a division by
zero, an exponent beyond 64, a value that isn't finite, brackets deeper than DEEPEST, and more than DEEPEST open operators.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .programs import bound

DEEPEST = 200
CALLS = ("abs", "min", "max", "round", "sum")
TOKEN = r"\d+\.?\d*+(?:[eE][+-]?\d++)?+|\.\d++(?:[eE][+-]?\d++)?+|[a-z]++|\*\*|[-+*/%(),]"
#: Binding of an operator; a sign binds between a product and a power.
BINDS = {"+": 1, "-": 1, "*": 2, "/": 2, "%": 2, "sign": 3, "**": 4}
OPS = "array<struct<s:string,p:int,n:int>>"


def _tidy(text: Column) -> Column:
    """Without blanks and with runs of signs before a value made one: `--` is +, `+-` is -. Blanks between two operands leave a mark that is no token.

    A sign behind an operand is an operator and stays by itself: `a - -b % c` isn't `a + b % c`.
    """
    bare = F.regexp_replace(F.regexp_replace(text, r"(?<=[0-9A-Za-z.])\s+(?=[0-9A-Za-z.])|(?<=\*)\s+(?=\*)", "?"), r"\s+", "")
    # runs are cut to at most half by each pass
    once = lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"--", "#"), r"\+\+", "#"), r"\+-|-\+", "-"), "#", "+")
    parted = F.regexp_replace(bare, r"(?<=[0-9.)])([-+])(?=[-+])", "$1|")
    clean = F.aggregate(F.sequence(F.lit(1), F.lit(32)), parted, lambda t, _: F.when(t.rlike(r"[-+][-+]"), once(t)).otherwise(t))
    clean = F.replace(clean, F.lit("|"), F.lit(""))
    # the sign of an exponent is part of its number
    return F.when(bare.rlike(r"[#|]|[eE][-+][-+]"), F.lit("?")).otherwise(clean)


def _apply(s: Column, a: Column, b: Column) -> Column:
    mod = bound(F.try_mod(a, b), lambda m: F.when((m != 0) & ((m < 0) != (b < 0)), m + b).otherwise(m))
    return F.when(s == "+", a + b).when(s == "-", a - b).when(s == "*", a * b).when(s == "/", F.try_divide(a, b)).when(s == "%", mod).when((F.abs(b) <= 64) & ~((a == 0) & (b < 0)), F.pow(a, b))


def _state(vals: Column, ops: Column, want: Column, ok: Column) -> Column:
    """vals: values so far; ops: open operators and brackets; want: a value must follow."""
    return F.struct(vals.alias("vals"), ops.cast(OPS).alias("ops"), want.alias("want"), ok.alias("ok"))


def _op(s: Column | str, p: int | Column, n: int | Column = 0) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(s).alias("s"), lit(p).cast("int").alias("p"), lit(n).cast("int").alias("n"))


def _last(a: Column, back: int = 0) -> Column:
    return F.get(a, F.size(a) - 1 - back)


def _drop(a: Column, n: int = 1) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - n, F.lit(0)))


def _reduced(state: Column, least: Column) -> Column:
    """Applies open operators that bind `least` or tighter, up to a bracket (which binds 0)."""

    def once(a: Column, _: Column) -> Column:
        def with_top(top: Column) -> Column:
            sign = top["p"] == BINDS["sign"]
            y, x = _last(a["vals"]), _last(a["vals"], 1)
            got = F.when(sign, F.when(top["s"] == "-", -y).otherwise(y)).otherwise(_apply(top["s"], x, y))
            vals = F.concat(F.when(sign, _drop(a["vals"])).otherwise(_drop(a["vals"], 2)), F.array(got))
            return F.when(F.coalesce(top["p"] >= F.greatest(least, F.lit(1)), F.lit(False)), _state(vals, _drop(a["ops"]), a["want"], a["ok"])).otherwise(a)

        return bound(_last(a["ops"]), with_top)

    return F.aggregate(F.sequence(F.lit(0), F.size(state["ops"])), state, once)


def _step(a: Column, t: Column) -> Column:
    bad = _state(a["vals"], a["ops"], a["want"], F.lit(False))
    push_op = lambda st, op, want: _state(st["vals"], F.concat(st["ops"], F.array(op)), F.lit(want), st["ok"])
    number = _state(F.concat(a["vals"], F.array(t.try_cast("double"))), a["ops"], F.lit(False), a["ok"])
    top = _last(a["ops"])
    called = F.coalesce(top["s"].isin(*CALLS), F.lit(False))
    # a call's name is turned into its bracket, which counts its arguments
    opened = F.when(called, push_op(_state(a["vals"], _drop(a["ops"]), a["want"], a["ok"]), _op(F.concat(F.lit("("), top["s"]), 0, 1), True)).otherwise(push_op(a, _op("(", 0), True))

    def comma(st: Column) -> Column:
        open_ = _last(st["ops"])
        more = _state(st["vals"], F.concat(_drop(st["ops"]), F.array(_op(open_["s"], 0, open_["n"] + 1))), F.lit(True), st["ok"])
        return F.when(F.coalesce(open_["n"] > 0, F.lit(False)), more).otherwise(bad)

    def close(st: Column) -> Column:
        open_ = _last(st["ops"])

        def with_args(args: Column) -> Column:
            one = F.get(args, 0)
            name, n = F.substring(open_["s"], F.lit(2), F.lit(9)), open_["n"]
            got = F.when(F.exists(args, lambda v: v.isNull()), F.lit(None).cast("double")).when(n == 0, one).when(name == "min", F.array_min(args)).when(name == "max", F.array_max(args)).when(name == "sum", F.aggregate(args, F.lit(0.0), lambda s, x: s + x))
            got = got.when((name == "abs") & (n == 1), F.abs(one)).when((name == "round") & (n == 1), F.bround(one)).when((name == "round") & (n == 2), _round(one, F.get(args, 1)))
            rest = F.slice(st["vals"], F.lit(1), F.greatest(F.size(st["vals"]) - F.size(args), F.lit(0)))
            return _state(F.concat(rest, F.array(got)), _drop(st["ops"]), F.lit(False), st["ok"])

        many = F.greatest(open_["n"], F.lit(1))
        done = bound(F.slice(st["vals"], F.greatest(F.size(st["vals"]) - many + 1, F.lit(1)), many), with_args)
        return F.when(open_.isNull(), bad).otherwise(done)

    power = F.when(t.isin("+", "-"), 1).when(t == "**", BINDS["**"]).otherwise(2)
    # powers are taken from the right, all others from the left
    binary = bound(_reduced(a, F.when(t == "**", BINDS["**"] + 1).otherwise(power)), lambda st: push_op(st, _op(t, power), True))
    after_name = called & (t != "(")
    free = a["want"] & ~called
    step = (
        F.when(~a["ok"] | after_name | (F.size(a["ops"]) > DEEPEST), bad)
        .when(t.rlike(r"^[.\d]"), F.when(free, number).otherwise(bad))
        .when(t.isin(*CALLS), F.when(free, push_op(a, _op(t, 0), True)).otherwise(bad))
        .when(t == "(", F.when(a["want"], opened).otherwise(bad))
        .when(t == ")", F.when(a["want"], bad).otherwise(bound(_reduced(a, F.lit(1)), close)))
        .when(t == ",", F.when(a["want"], bad).otherwise(bound(_reduced(a, F.lit(1)), comma)))
        .when(t.isin("+", "-") & a["want"], push_op(a, _op(t, BINDS["sign"]), True))
        .when(t.isin("+", "-", "*", "/", "%", "**"), F.when(a["want"], bad).otherwise(binary))
        .otherwise(bad)
    )
    return step


def _round(x: Column, digits: Column) -> Column:
    """Half to even at a whole number of digits from 0 to 12; else null."""
    out = F.lit(None).cast("double")
    for d in range(13):
        out = F.when(digits == d, F.bround(x, d)).otherwise(out)
    return out


def infix_value(expression: Column) -> Column:
    """The expression's value as a double, or null. Commas are dropped where there is no bracket."""
    text = F.trim(F.coalesce(expression, F.lit("")))
    text = F.when(text.contains("("), text).otherwise(F.replace(text, F.lit(","), F.lit("")))

    def run(clean: Column) -> Column:
        tokens = F.regexp_extract_all(clean, F.lit(TOKEN), F.lit(0))
        start = _state(F.array().cast("array<double>"), F.array(), F.lit(True), F.array_join(tokens, "") == clean)
        last = bound(F.aggregate(tokens, start, _step), lambda a: _reduced(a, F.lit(1)))
        fine = lambda a: a["ok"] & ~a["want"] & (F.size(a["ops"]) == 0) & (F.size(a["vals"]) == 1)
        value = lambda a: F.when(F.coalesce(fine(a), F.lit(False)), F.get(a["vals"], 0))
        return bound(bound(last, value), lambda v: F.when(F.abs(v) < float("inf"), v))

    return bound(_tidy(text), run)
