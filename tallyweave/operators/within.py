"""Rankings, evidence and scores within a report, as columns of its row: what belongs to one report is never joined or sorted with others.

Chunks are an array of structs, as report_chunks() makes them. Scores and orders are those of the long forms in retrieval, assembly and evidence.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.programs import bound
from . import lists
from .retrieval import lexical_score, with_digits


def together(then, **values: Column) -> Column:
    """then(struct of values), with each value evaluated once."""
    return bound(F.struct(*[v.alias(k) for k, v in values.items()]), then)


def chunk_id(c: Column) -> Column:
    return F.concat_ws(":", c["chunk_type"], c["chunk_index"].cast("string"))


def best(chunks: Column, score, id_of, k: int) -> Column:
    """The k chunks with the greatest score, ties by id, with score and rank from 1."""
    keyed = F.transform(chunks, lambda c: F.struct((-F.round(score(c), 6)).alias("o"), id_of(c).alias("id"), c.alias("c")))
    return F.transform(F.slice(F.sort_array(keyed), 1, k), lambda s, i: s["c"].withField("score", -s["o"]).withField("rank", i + 1))


def lexical_best(chunks: Column, question: Column, k: int) -> Column:
    """lexical_rerank() of a report's own chunks."""
    score = lambda x, c: lexical_score(x["q"], x["numbers"], F.array_distinct(T.bm25_tokens(c["text"])), c["chunk_type"])
    ranked = lambda x: together(lambda y: best(y["c"], lambda c: score(y, c), chunk_id, k), c=x["c"], q=x["q"], numbers=F.size(with_digits(x["q"])))
    return together(ranked, c=chunks, q=F.array_distinct(T.bm25_tokens(question)))


def bm25_scores(tokens: Column, asked: Column, k1: float = 1.5, b: float = 0.75, eps: float = 0.25) -> Column:
    """bm25() of a report's own chunks: a score for each array of tokens; asked: the question's tokens."""

    def run(own, said):
        (chunks, of), (words, whose), rows = lists.flat(own), lists.flat(said), len(own)
        held, chunk = lists.flat(chunks)
        held, words = lists.numbered(held, words)
        return lists.listed(pa.array(lists.bm25_scores(held, chunk, of, words, whose, rows, k1, b, eps)[0]), of, rows)

    return lists.in_column(run, "array<double>")(tokens, asked)


def with_scores(chunks: Column, scores: Column, name: str = "score") -> Column:
    """chunks plus the score that stands at the same place; all scores are made once, which a column of them isn't sure to be."""
    return bound(scores, lambda ss: F.transform(chunks, lambda c, i: c.withField(name, F.get(ss, i))))


def evidence(primary: Column, chunks: Column, mentions, cap: int) -> Column:
    """primary: chunks with rank, in its order; mentions(kind, index) -> array<struct<t, i, reason>> of a primary -> array<struct<chunk_type, chunk_index, text, rank, reason, pos>>.

    First mention wins, `cap` chunks; what chunks lack is left out.
    """
    said = F.flatten(F.transform(primary, lambda p: F.transform(mentions(p["chunk_type"], p["chunk_index"]), lambda m: m.withField("rank", p["rank"]))))

    def found(x: Column) -> Column:
        said_keys = F.transform(x["said"], lambda m: F.concat_ws(":", m["t"], m["i"].cast("string")))
        return together(lambda y: kept(x, y), keys=F.transform(x["chunks"], chunk_id), said=said_keys)

    def kept(x: Column, y: Column) -> Column:
        names = F.slice(F.filter(F.array_distinct(y["said"]), lambda n: F.array_contains(y["keys"], n)), 1, cap)
        at = lambda items, keys, n: F.get(items, F.array_position(keys, n).cast("int") - 1)
        whole = lambda z, i: z["c"].withField("rank", z["m"]["rank"]).withField("reason", z["m"]["reason"]).withField("pos", i + 1)
        return F.transform(names, lambda n, i: together(lambda z: whole(z, i), c=at(x["chunks"], y["keys"], n), m=at(x["said"], y["said"], n)))

    return together(found, said=said, chunks=chunks)


def assembled(found: Column) -> Column:
    """Numbered lines of evidence in order; none: null."""
    line = lambda e: F.concat(F.lit("["), e["pos"].cast("string"), F.lit("] ("), e["chunk_type"], F.lit(") "), e["text"])
    return F.when(F.size(found) > 0, F.array_join(F.transform(found, line), "\n"))


def rows_of(df: DataFrame, items: Column, *keys: Column) -> DataFrame:
    """keys and the fields of each struct of items; outer, as Spark else makes the list once more to look at its size. For the same reason rows are left out by an empty or null list, not by a filter on what they are made of."""
    got = df.select(*keys, F.explode_outer(items).alias("_x"))
    return got.where("_x is not null").select(*got.columns[:-1], "_x.*")
