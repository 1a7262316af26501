"""Secret scan: base patterns plus sliding-window Shannon entropy, in built-in functions only.

Candidates are maximal runs of 20 or more characters of [A-Za-z0-9+/_=-]. A candidate's character class
(digits, letters, hexadecimal, alphanumeric, base64, words with separators) sets the entropy that counts. The entropy of each window of 20 characters comes
from the counts of the window before, by one character in and one out; f(c) = c log2 c is kept in integers, so that
sums are exact. A candidate is reported whole if one of its windows reaches the threshold, unless
a base span covers it. Of a candidate with a word of the allow-list only the parts between separators without such a word count.

At scale: one pass over the texts, no shuffle. Only texts with a candidate enter the fold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Fixed values of the base patterns.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits a character that a window needs, by the candidate's class.
BITS = {"digits": 3.1, "letters": 4.0, "hex": 3.0, "alnum": 3.6, "base64": 3.8, "words": 3.9}
#: Parts with one of these (lower case) inside are no secrets.
ALLOWED = ("example", "placeholder", "changeme", "dummy", "redacted", "abcdefgh", "01234567", "xxxxxx", "000000")
UNIT = 1_000_000_000
TERMS = [round(c * math.log2(c) * UNIT) if c else 0 for c in range(WINDOW + 1)]


#: Elements of a block of _prefix().
BLOCK = 256


def _prefix(values: Column, op) -> Column:
    """Inclusive running op (sum, greatest) of an array<int> from 0 on, in two levels: a fold that appends copies its array each time, so it never runs over more than a block or one value a block."""
    zero, last = F.lit(0), lambda a: F.get(a, F.size(a) - 1)
    none = F.array().cast("array<int>")
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
    ups = lambda a, x: F.concat(a, F.array(op(last(a), x)))
    bases = lambda blocks: F.aggregate(F.transform(blocks, lambda b: F.aggregate(b, zero, op)), F.array(zero), ups)
    inner = lambda b, base: F.when(b.isNotNull(), F.aggregate(b, F.array(base), ups, lambda a: F.slice(a, F.lit(2), F.size(a) - 1))).otherwise(none)
    whole = lambda v: F.get(F.transform(F.array(cut(v)), lambda blocks: F.flatten(F.zip_with(blocks, bases(blocks), inner))), 0)
    return F.get(F.transform(F.array(values), lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(none)), 0)


def _covered(spans: Column, by: Column) -> Column:
    """Of spans (start, end, ...) those that lie within none of by (start, end), in order: the farthest end of what starts no later is a running maximum."""
    mark = lambda x, kind, end: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), end.alias("reach"))
    both = F.array_sort(F.concat(F.transform(by, lambda x: mark(x, 0, x["end"])), F.transform(spans, lambda x: mark(x, 1, F.lit(0)))))
    reached = lambda b: F.zip_with(b, _prefix(F.transform(b, lambda x: x["reach"]), lambda a, b: F.greatest(a, b)), lambda x, r: F.when((x["kind"] == 1) & (r < x["end"]), F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    return F.array_compact(F.get(F.transform(F.array(both), reached), 0))


def _runs(text: Column, pattern: str, groups: int = 0) -> Column:
    """Matches in order as array<struct<start, end, value>>, in code points; value is the group's text."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(groups))
    length = lambda a: F.transform(a, lambda m: F.char_length(m))
    gaps = F.slice(between, F.lit(1), F.size(found))
    ends = _prefix(F.zip_with(length(found), length(gaps), lambda m, p: m + p), lambda a, b: a + b)
    each = F.arrays_zip(length(found).alias("m"), ends.alias("e"), value.alias("v"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    folded = F.transform(each, lambda x: F.struct((x["e"] - x["m"]).alias("start"), x["e"].alias("end"), x["v"].alias("value")))
    return F.when(text.rlike(pattern), folded).otherwise(none)


def _span(kind: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"))


def _least_sum(idx: Column) -> Column:
    """Least sum of f(count) over the windows of idx: the greatest entropy is log2(WINDOW) - sum / WINDOW."""
    f = F.array(*[F.lit(t).cast("bigint") for t in TERMS])

    def step(a: Column, i: Column) -> Column:
        new, old = F.get(idx, i), F.coalesce(F.get(idx, i - WINDOW), F.lit(-1))
        n_new, n_old = F.get(a["c"], new), F.get(a["c"], old)
        more = F.get(f, n_new + 1) - F.get(f, n_new)
        less = F.when(old >= 0, F.get(f, n_old - 1) - F.get(f, n_old)).otherwise(F.lit(0).cast("bigint"))
        s = F.when(new == old, a["s"]).otherwise(a["s"] + more + less)
        counts = F.transform(a["c"], lambda v, k: v + (k == new).cast("int") - (k == old).cast("int"))
        return F.struct(counts.alias("c"), s.alias("s"), F.when(i >= WINDOW - 1, F.least(a["best"], s)).otherwise(a["best"]).alias("best"))

    zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("c"), F.lit(0).cast("bigint").alias("s"), F.lit(1 << 60).cast("bigint").alias("best"))
    return F.aggregate(F.sequence(F.lit(0), F.size(idx) - 1), zero, step, lambda a: a["best"])


def _limit(value: Column) -> Column:
    """The sum of f that a window may reach at most, by the class of the candidate; null: none of the classes."""
    most = {k: round(WINDOW * (math.log2(WINDOW) - b) * UNIT) for k, b in BITS.items()}
    mixed = value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]")
    return (
        F.when(~value.rlike("[A-Za-z0-9]"), F.lit(None).cast("bigint"))
        .when(value.rlike("^[0-9]+$"), F.lit(most["digits"]))
        .when(value.rlike("^[A-Za-z]+$"), F.lit(most["letters"]))
        .when(value.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit(most["hex"]))
        .when(value.rlike("^[A-Za-z0-9]+$"), F.lit(most["alnum"]))
        .when(mixed, F.lit(most["base64"]))
        .otherwise(F.lit(most["words"]))
    )


def _allowed(value: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.lower(value).contains(w)) if words else F.lit(False)


def with_spans(df: DataFrame, text: str = "text", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """df plus `base` and `spans`: array<struct<start, kind, end>>, in order of start, kind, end. Null text: none. allowed: the allow-list, in lower case."""
    t = F.coalesce(F.col(text), F.lit(""))
    assign = F.filter(_runs(t, ASSIGN, 1), lambda x: F.char_length(x["value"]) >= 12)
    base = F.concat(F.transform(assign, _span(0)), F.transform(_runs(t, ACCESS), _span(1)), F.transform(_runs(t, HEX), _span(2)))
    df = df.withColumn("base", F.array_sort(base)).withColumn("_c", _runs(t, CANDIDATE))
    chars = lambda v: F.transform(F.filter(F.split(v, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    parts = lambda v: F.when(_allowed(v, allowed), F.filter(F.split(v, "[/=_-]"), lambda p: (F.char_length(p) >= WINDOW) & ~_allowed(p, allowed))).otherwise(F.array(v))
    scored = lambda v: F.transform(F.filter(parts(v), lambda p: _limit(p).isNotNull()), lambda p: F.struct(_limit(p).alias("most"), chars(p).alias("idx")))
    df = df.withColumn("_c", F.transform("_c", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), scored(x["value"]).alias("parts"))))
    df = df.withColumn("_c", F.filter("_c", lambda x: F.exists(x["parts"], lambda p: _least_sum(p["idx"]) <= p["most"])))
    free = F.when(F.size("_c") > 0, F.transform(_covered(F.col("_c"), F.col("base")), _span(3))).otherwise(F.transform(F.slice("_c", 1, 0), _span(3)))
    return df.withColumn("spans", F.array_sort(F.concat("base", free))).drop("_c")


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def secrets(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """One row per row of docs: doc_id, counts of the base kinds, digest of the base spans, all spans.

    Null and empty texts have no spans (digest of the empty string). Repeated rows stay repeated; an empty table gives
    no row; further columns are ignored.
    """
    df = with_spans(docs.select("doc_id", "text"), allowed=allowed)
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return df.select("doc_id", n(0), n(1), n(2), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each span of `text` replaced by mark (overlapping spans by one), and n_chars, if there, counted anew.

    Null texts stay null. All columns keep their names, order and rows.
    """
    columns = docs.columns
    plain = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)] + ["text"])
    piece = lambda a, x: F.substring("text", a["end"] + 1, x["start"] - a["end"])
    step = lambda a, x: F.struct(
        F.greatest(a["end"], x["end"]).alias("end"),
        F.when(x["start"] >= a["end"], F.concat(a["out"], F.array(piece(a, x), F.lit(mark)))).otherwise(a["out"]).alias("out"),
    )
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("out"))
    rest = lambda a: F.array_join(F.concat(a["out"], F.array(F.substring("text", a["end"] + 1, F.lit(2**31 - 1)))), "")
    df = with_spans(plain).withColumn("_new", F.when(F.size("spans") > 0, F.aggregate("spans", start, step, rest)).otherwise(F.col("text")))
    new = {"text": F.col("_new"), "n_chars": F.coalesce(F.char_length("_new"), F.lit(0)).cast("long")}
    return df.select([new.get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(columns)])


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
