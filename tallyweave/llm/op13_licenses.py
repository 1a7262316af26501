"""License scan: base phrases, and templates found by an exact set-similarity join, in built-in functions only.

A text's blocks are windows of words, twice the longest template long and half of that apart, so a template's wording always stands within one block,
however its lines are broken. A block meets a template if it holds at least THRESHOLD of the template's distinct words. The words of all templates are put in
an order by the number of blocks that have them, rare ones first. To hold `need` of a template's words a block must have one of its first
size - need + 1 words (prefix filter), at least `need` words of the templates (length filter), and enough words behind the
first shared one on both sides (positional filter); what is left is counted in full. No block that meets a template is missed.

At scale: texts are read once; what is written and joined are the blocks' words that some template has. The templates are a parameter of at most LIMIT
rows, so their words may be broadcast, and a frequent word is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label and wording of the usual notices.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc0", "the author has waived all copyright and related or neighboring rights to this work"),
)
#: Share of a template's distinct words, as a fraction.
THRESHOLD = (9, 10)
LIMIT = 10_000


def words(text: Column) -> Column:
    """Words in order, A-Z lower-cased (null: none)."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(low, GAP), lambda w: w != "")


def plain_words(text: str) -> list[str]:
    """words() of a template."""
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))


def need_of(size: int, threshold: tuple[int, int] = THRESHOLD) -> int:
    return -(-size * threshold[0] // threshold[1])


def stride_of(templates: tuple[tuple[str, str], ...]) -> int:
    return max(len(plain_words(t)) for _, t in templates)


def _starts(phrase: str) -> Column:
    """Starts (words from 0) of a phrase in the array `_w`."""
    first, *rest = phrase.split(" ")
    at = F.filter(F.transform("_w", lambda w, i: F.when(w == first, i)), lambda i: i.isNotNull())
    follows = lambda k, word: lambda i: F.coalesce(F.get("_w", i + k) == word, F.lit(False))
    for k, word in enumerate(rest, 1):
        at = F.filter(at, follows(k, word))
    return at


def scanned(docs: DataFrame, templates: tuple[tuple[str, str], ...], phrases: dict[str, str], threshold: tuple[int, int]) -> DataFrame:
    """A written row per row of docs: row, doc_id, n_words, base (array of start and label), blocks (words that some template has, where enough)."""
    vocabulary = sorted({w for _, t in templates for w in plain_words(t)})
    least = min(need_of(len(set(plain_words(t))), threshold) for _, t in templates)
    stride = stride_of(templates)
    any_phrase = "(?i)" + "|".join("[^0-9a-z]+".join(p.split(" ")) for p in phrases)
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_w", words(F.col("text")))
    none = F.array().cast("array<struct<start:int,label:string>>")
    label = lambda name: lambda i: F.struct(i.alias("start"), F.lit(name).alias("label"))
    base = F.concat(*[F.transform(_starts(p), label(name)) for p, name in phrases.items()])
    held = lambda i: F.array_intersect(F.slice("_w", i + 1, 2 * stride), F.array(*map(F.lit, vocabulary)))
    # the last stride of a text of more than one is within the window before
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - 1 - stride, F.lit(0)), F.lit(stride))
    blocks = F.filter(F.transform(starts, held), lambda b: F.size(b) >= least)
    df = df.select("doc_id", F.size("_w").cast("long").alias("n_words"), F.when(F.col("text").rlike(any_phrase), base).otherwise(none).alias("base"), blocks.alias("blocks"))
    return written(df.withColumn("row", F.monotonically_increasing_id()), "license_blocks")


def matched(blocks: DataFrame, templates: tuple[tuple[str, str], ...], threshold: tuple[int, int]) -> DataFrame:
    """(row, label, score) for each block (row, words) and template that meet: the exact set-similarity join."""
    spark = blocks.sparkSession
    vocabulary = {w for _, t in templates for w in plain_words(t)}
    # as many rows as the templates have words, at most
    seen = {r["w"]: r["n"] for r in blocks.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    rows, least = [], len(order)
    for label, text in templates:
        own = sorted(set(plain_words(text)), key=place.__getitem__)
        need = need_of(len(own), threshold)
        least = min(least, need)
        rows += [(w, p, label, own, need) for p, w in enumerate(own[: len(own) - need + 1])]
    sides = spark.createDataFrame(rows, "w string, p int, label string, own array<string>, need int")
    ordered = blocks.select("row", F.array_intersect(F.array(*map(F.lit, order)), "words").alias("words")).withColumn("size", F.size("words"))
    probes = ordered.select("*", F.posexplode(F.slice("words", F.lit(1), F.greatest(F.col("size") - least + 1, F.lit(0)))).alias("q", "w"))
    possible = (F.col("size") >= F.col("need")) & (F.least(F.size("own") - F.col("p"), F.col("size") - F.col("q")) >= F.col("need"))
    met = probes.join(F.broadcast(sides), "w").where(possible).withColumn("shared", F.size(F.array_intersect("own", "words")))
    return met.where("shared >= need").select("row", "label", (F.col("shared") / F.size("own")).alias("score"))


def licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the greatest share of a template's words in a block, of the templates met; 1 where a base phrase stands, else 0. Null and empty texts have no
    words, no labels (empty strings) and score 0. Null ids keep their rows, repeated rows stay repeated; an empty table gives no row; further
    columns are ignored. templates must have a word each and be LIMIT at most.
    """
    if not 0 < len(templates) <= LIMIT or not all(plain_words(t) for _, t in templates):
        raise ValueError(f"1 to {LIMIT} templates, each with a word")
    rows = scanned(docs, templates, phrases, threshold)
    found = matched(rows.select("row", F.explode("blocks").alias("words")), templates, threshold)
    found = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    start, named = F.transform("base", lambda x: x["start"]), F.transform("base", lambda x: x["label"])
    labels = F.array_distinct(F.concat(named, F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return rows.drop("blocks").join(found, "row", "left").select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(start).cast("long").alias("first_word"), F.array_max(start).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(named)), ",").alias("base_labels"), F.array_join(F.array_sort(labels), ",").alias("labels"), score.alias("score"),
    )


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql() -> str:
    """Every window against every template."""
    stride = stride_of(TEMPLATES)
    rows = ", ".join(f"({_quoted(name)}, [{', '.join(_quoted(w) for w in sorted(set(plain_words(t))))}])" for name, t in TEMPLATES)
    hits = []
    for p, name in PHRASES.items():
        test = " AND ".join(f"coalesce(w[i + {k + 1}] = {_quoted(x)}, false)" for k, x in enumerate(p.split(" ")))
        hits.append(f"[{{'s': i, 'l': {_quoted(name)}}} FOR i IN range(0, len(w)) IF {test}]")
    return rf"""
WITH t(label, own) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS rid, doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAP}') IF x <> ''] AS w FROM documents),
b AS (SELECT *, list_concat({", ".join(hits)}) AS base FROM d),
m AS (SELECT rid, label, len(list_intersect(win, own)) AS shared, len(own) AS size
 FROM (SELECT rid, list_distinct(w[s + 1 : s + {2 * stride}]) AS win FROM (SELECT rid, w, unnest(range(0, greatest(len(w) - 1 - {stride}, 0) + 1, {stride})) AS s FROM d)), t
 WHERE shared * {THRESHOLD[1]} >= size * {THRESHOLD[0]}),
g AS (SELECT rid, list(DISTINCT label) AS more, max(shared / size) AS best FROM m GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(base) AS BIGINT) AS n_base, CAST(list_min([x.s FOR x IN base]) AS BIGINT) AS first_word, CAST(list_max([x.s FOR x IN base]) AS BIGINT) AS last_word,
 array_to_string(list_sort(list_distinct([x.l FOR x IN base])), ',') AS base_labels,
 array_to_string(list_sort(list_distinct(list_concat([x.l FOR x IN base], coalesce(more, [])))), ',') AS labels,
 CASE WHEN len(base) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM b LEFT JOIN g USING (rid)"""


OP13_SQL = _sql()
