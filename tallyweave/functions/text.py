"""JSON, chat, web and report text as Column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

# Stop words of the web tokenizer.
STOP = tuple("a an and are as be by for from in is it of on or that the then to use what with how much many difference between please search find".split())


def extract_json(text: Column) -> Column:
    """From the first to the last brace of a text without code fences, as a VARIANT; no JSON: null."""
    s = F.trim(F.coalesce(text, F.lit("")))
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"^```json\s*", ""), r"^```\s*", ""), r"\s*```$", "")
    body = F.regexp_extract(s, r"(?s)\{.*\}", 0)
    return F.try_parse_json(F.when(body != "", body).otherwise(s))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def field(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def field_as_text(v: Column, path: str) -> Column:
    """A field as text: JSON null reads None, an absent field is empty."""
    there = F.try_variant_get(v, path, "variant")
    return F.when(F.is_variant_null(there), "None").otherwise(F.coalesce(field(v, path), F.lit("")))


def norm_answer(text: Column) -> Column:
    """Lower case, no commas, single spaces, no outer blanks, points, percent or dollar signs."""
    s = F.replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit(","), F.lit(""))
    return F.btrim(F.regexp_replace(s, r"(?U)\s+", " "), F.lit(" .%$"))


def norm_corpus(text: Column) -> Column:
    """Lower case, the broken apostrophe `2019` between letters mended, only letters, digits, point, percent and minus kept."""
    s = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "(?<=[a-z])2019(?=[a-z])", "'")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9.%\-]+", " "), r"\s+", " "))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def first_line(text: Column) -> Column:
    return F.split_part(F.trim(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit(1))


def tool_call(v: Column) -> tuple[Column, Column, Column]:
    """(is a call, tool name, program) of a parsed output; `expression` serves as a program too."""
    called = is_object(v) & is_object(F.try_variant_get(v, "$.tool_call", "variant"))
    name = F.when(called, F.coalesce(field(v, "$.tool_call.name"), F.lit(""))).otherwise("")
    args = F.coalesce(field(v, "$.tool_call.arguments.program"), field(v, "$.tool_call.arguments.expression"), F.lit(""))
    return called, name, F.when(called, args).otherwise("")


def bm25_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z]+|\d+(?:\.\d+)?|[%$]"), F.lit(0))


def signed_tokens(text: Column) -> Column:
    """Words and numbers with their signs and percent signs, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(squeeze(F.coalesce(text, F.lit("")))), F.lit(r"[a-z]+|[-+]?\d+(?:\.\d+)?%?"), F.lit(0))


def web_tokens(text: Column) -> Column:
    """Words and numbers of two or more characters, stop words out, each once."""
    t = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9][a-z0-9_+.$%-]*"), F.lit(0))
    return F.array_distinct(F.filter(t, lambda x: (F.char_length(x) > 1) & ~x.isin(*STOP)))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.trim(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def word_windows(text: Column, size: int = 160, overlap: int = 40, least: int = 25) -> Column:
    """Overlapping windows of words as array<string>; a tail of fewer than `least` words is dropped unless it is all."""


    def cut(words: Column) -> Column:
        starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
        kept = F.filter(starts, lambda s: (F.size(words) - s >= least) | (s == 0))
        return F.transform(kept, lambda s: F.array_join(F.slice(words, s + 1, F.lit(size)), " "))

    # the words are split once, bound by a one-element array
    return F.get(F.transform(F.array(F.filter(F.split(squeeze(text), " "), lambda w: w != "")), cut), 0)


def strip_tags(page: Column) -> Column:
    """Text of a page: script, style and noscript dropped, tags to spaces; entities stay."""
    s = F.regexp_replace(F.coalesce(page, F.lit("")), r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " ")
    return squeeze(F.regexp_replace(s, r"(?s)<[^>]*>", " "))


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    """Character references decoded; the JVM has no function for them."""
    return s.map(html.unescape, na_action="ignore")


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def markdown_table(rows: Column) -> Column:
    """array<array<string>> as a markdown table, rows padded or cut to the header's width."""
    width = F.size(F.get(rows, 0))
    fit = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width)
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = line(F.array_repeat(F.lit("---"), width))
    body = F.transform(rows, lambda r: line(fit(r)))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, F.lit(2), F.greatest(F.size(body) - 1, F.lit(0)))), "\n")).otherwise("")


# Substrings that mark a question's class, in order of the rules.
CLASSES_7 = (
    ("percent_rate", ("percent", "percentage", "rate", "growth", "margin")),
    ("ratio", ("ratio", "portion", "as a percentage")),
    ("average", ("average",)),
    ("sum_total", ("total", "sum", "combined")),
    ("difference", ("change", "increase", "decrease", "higher", "lower", "difference", "decline")),
    ("multiply", ("market capitalization", "product")),
)
CLASSES_6 = (
    ("percent_rate", ("percent", "percentage", "portion", "rate", "margin", "growth", "increase", "decrease", "decline", "change")),
    ("ratio", ("ratio", "relative to", "compared to", "times")),
    ("average", ("average", "mean")),
    ("sum_total", ("total", "sum", "combined")),
    ("difference", ("difference", "decline from", "how much higher", "how much lower")),
)


def category(question: Column, classes: tuple = CLASSES_7) -> Column:
    """Question class by the first rule with a substring in the question, else `other`."""
    q, out = F.lower(F.coalesce(question, F.lit(""))), F
    for name, marks in classes:
        hit = q.rlike("|".join(marks))
        out = out.when(hit, name)
    return out.otherwise("other")


# Substrings that mark a hard question or program.
HARD_KEYWORDS = ("percent", "percentage", "rate", "ratio", "margin", "average", "change", "increase", "decrease", "growth", "cagr", "return", "divided", "per")


def hard_keyword(question: Column, program: Column) -> Column:
    """Whether the question or the program has a hard keyword in it; null counts as empty."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return low(question).rlike("|".join(HARD_KEYWORDS)) | low(program).rlike("|".join(HARD_KEYWORDS))


# Words that the ranking of search results leaves out.
RANK_STOP = ("a", "an", "and", "are", "as", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "then", "to", "use", "what", "with", "look", "up", "summarize", "official")


def rank_tokens(text: Column) -> Column:
    """Words of a search result in order, repeats kept: two characters or more, stop words out."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9][a-z0-9_+-]*"), F.lit(0))
    return F.filter(found, lambda t: (F.char_length(t) > 1) & ~t.isin(*RANK_STOP))


def coalesced(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of the fields `names` (a dot leads into a struct) that df has and that isn't null; none: null."""
    have: list[Column] = []
    for name in names:
        at, kind = name.split("."), df.schema
        for part in at:
            kind = kind[part].dataType if isinstance(kind, StructType) and part in kind.names else None
        if kind is not None:
            have.append(F.col(name).cast("string"))
    return F.coalesce(*have) if have else F.lit(None).cast("string")


# Where predictions keep their text, gold answer and id.
PREDICTION_KEYS = ("prediction", "raw_output", "response", "output", "model_output")
