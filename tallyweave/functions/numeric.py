"""Numbers in text and tolerant matching, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Powers of ten by which a predicted number may be off.
SCALES = (1.0, 100.0, 0.01, 1000.0, 0.001, 1000000.0, 0.000001)
# Named constants of the calculator.
CONSTANTS = {"const_m1": -1.0, "const_0": 0.0, "const_1": 1.0, "const_2": 2.0, "const_3": 3.0, "const_4": 4.0, "const_5": 5.0, "const_10": 10.0, "const_100": 100.0, "const_1000": 1000.0, "const_1000000": 1000000.0}
NUMBER = r"[-+]?\d*\.?\d+"


def _double(text: Column) -> Column:
    return F.when(text != "", text).try_cast("double")


def extract_num(text: Column) -> Column:
    """First number of a text without exponent; commas are dropped. None: null."""
    return _double(F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), NUMBER, 0))


def all_numbers(text: Column) -> Column:
    """All signed numbers of a text in order, percent signs kept, as strings."""
    return F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(NUMBER + "%?"), F.lit(0))


def last_number(text: Column) -> Column:
    """The last number of a text, commas dropped; none: null."""
    found = F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(NUMBER), F.lit(0))
    return F.get(found, F.size(found) - 1).try_cast("double")


def gold_number(text: Column) -> Column:
    """The number `result` of the JSON behind a text's first line (of the whole text, if it has one line); without it the text's last number."""
    payload = F.when(text.contains("\n"), F.regexp_extract(text, r"(?s)^[^\n]*\n(.*)$", 1)).otherwise(text)
    said = F.try_variant_get(F.try_parse_json(payload), "$.result", "string")
    return F.coalesce(F.trim(said).try_cast("double"), last_number(text))


def normalize_number(text: Column) -> Column:
    """A calculator operand: constants, currency, percent, brackets for minus, exponents; finite or null."""
    t = F.btrim(F.trim(text), F.lit("\"'"))
    bare = F.trim(F.translate(t, ",$%", ""))
    signed = F.when(bare.startswith("(") & bare.endswith(")"), F.concat(F.lit("-"), F.substring(bare, F.lit(2), F.char_length(bare) - 2))).otherwise(bare)
    value = _double(F.regexp_extract(signed, NUMBER + r"(?:[eE][-+]?\d+)?", 0))
    known = F.create_map(*[F.lit(x) for kv in CONSTANTS.items() for x in kv])
    named = _double(F.regexp_extract(t, r"^const_([0-9]+(?:\.[0-9]+)?)$", 1))
    out = F.coalesce(F.try_element_at(known, t), named, value)
    return F.when(F.abs(out) < float("inf"), out)


def close(a: Column, b: Column, tol: float) -> Column:
    """|a - b| / max(|b|, 1e-6) is tol or less; a null side: false."""
    return F.coalesce(F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-6)) <= tol, F.lit(False))


def numeric_match(pred: Column, gold: Column, tol: float) -> Column:
    return close(extract_num(pred), extract_num(gold), tol)


def variants(value: Column, text: Column | None = None, scale: bool = True) -> Column:
    """The values that a number may stand for, by size; null: none."""
    every = F.array(*[value * s for s in (SCALES if scale else (1.0,))])
    if text is not None:
        every = F.when(F.coalesce(text.contains("%"), F.lit(False)), F.concat(every, F.array(value / 100.0))).otherwise(every)
    by_size = lambda x: F.struct(F.abs(x).alias("a"), x.alias("v"))
    return F.transform(F.array_sort(F.array_distinct(F.transform(F.filter(every, lambda x: x.isNotNull()), by_size))), lambda s: s["v"])


def _percent(text: Column | None) -> Column:
    return F.lit(False) if text is None else F.coalesce(text.contains("%"), F.lit(False))


def _any_close(p: Column, p_percent: Column, golds: list[tuple[Column, Column | None]], tol: float) -> Column:
    """Whether a value that p may stand for is close to one of golds (number, and when it counts): a fixed OR of comparisons."""
    hit = F.lit(False)
    for g, when in golds:
        one = p_percent & close(p / 100.0, g, tol)
        for s in SCALES:
            one = one | close(p * s, g, tol)
        hit = hit | (one if when is None else when & one)
    return hit


def scaled_match(pred: Column, pred_text: Column | None, gold: Column, tol: float) -> Column:
    """Some variant of the number pred is close to gold as stated or, with a percent sign, to its hundredth."""
    parts = F.struct(pred.alias("p"), _percent(pred_text).alias("s"), extract_num(gold).alias("g"), _percent(gold).alias("t"))
    return F.get(F.transform(F.array(parts), lambda x: _any_close(x["p"], x["s"], [(x["g"], None), (x["g"] / 100.0, x["t"])], tol)), 0)


def nearest_variant(value: Column, gold: Column) -> Column:
    """The variant of value nearest to the number gold; ties by size."""
    err = lambda v: F.abs(v - gold) / F.greatest(F.abs(gold), F.lit(1e-6))
    return F.array_min(F.transform(variants(value), lambda v, i: F.struct(err(v).alias("e"), i.alias("i"), v.alias("v"))))["v"]


def format_number(x: Column, digits: int = 10) -> Column:
    """Whole numbers from 1000 on without point, else `digits` significant digits without end zeros, with an exponent below 1e-4 and from 10^digits on.

    Null gives the empty string; infinite values and NaN their names.
    """
    s = F.format_string(f"%.{digits - 1}e", x)
    mantissa, power = F.regexp_replace(F.regexp_extract(s, "^([^e]*)e", 1), r"\.?0+$", ""), F.regexp_extract(s, r"e([+-]\d+)$", 1)
    size = F.when(power != "", power).try_cast("int")
    plain = F.regexp_replace(s.try_cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    other = F.when(size.isNull(), x.cast("string")).when((size < -4) | (size >= digits), F.concat(mantissa, F.lit("e"), power)).when(F.abs(x) == 0, "0").otherwise(plain)
    return F.when(x.isNull(), "").when((F.abs(x) >= 1000) & (F.abs(x - F.round(x)) < 1e-6), F.coalesce(F.round(x).try_cast("decimal(38,0)").cast("string"), F.format_string("%.0f", x))).otherwise(other)


def printed(value: Column) -> Column:
    """The number that a reader without exponents finds in the value's text: below 1e-4 the text has one, so only its leading digits count."""
    return F.when((F.abs(value) < 1e-4) & (value != 0), extract_num(value.cast("string"))).otherwise(value)


def scaled_to(pred: Column, pred_text: Column | None, gold: Column, tol: float) -> Column:
    """Some variant of pred is close to the number gold itself."""
    parts = F.struct(pred.alias("p"), _percent(pred_text).alias("s"), gold.alias("g"))
    return F.get(F.transform(F.array(parts), lambda x: _any_close(x["p"], x["s"], [(x["g"], None)], tol)), 0)
