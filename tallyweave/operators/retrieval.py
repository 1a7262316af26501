"""Chunks, ranking, fusion and packing. Ranked lists are long: (query_id, chunk_id, score, rank)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.programs import bound


def ranked(scores: DataFrame, k: int, by: str = "query_id", order: list[Column] | None = None) -> DataFrame:
    """Top k per query, ties by chunk id. Spark cuts each task's rows before the shuffle."""
    w = Window.partitionBy(by).orderBy(*(order or [F.desc("score"), F.asc("chunk_id")]))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def blocks_of(rows: DataFrame, block: int) -> Iterator[list]:
    """A stated query set in blocks; one block at a time is on the driver."""
    part = []
    for r in rows.toLocalIterator():
        part.append(r)
        if len(part) == block:
            yield part
            part = []
    if part:
        yield part


def containing(documents: DataFrame, passages: DataFrame, words: int = 5) -> DataFrame:
    """documents (doc_id, text), passages (query_id, q) -> (query_id, doc_id) where the passage stands in the text, character by character.

    A passage's inner pieces between spaces are whole in every text that holds it. So texts and passages are joined by the hash of the passage's first `words`
    inner pieces, and only such pairs are compared. Passages with fewer pieces, a few, are looked for in all texts. Null texts and passages match nothing.
    """
    windows = lambda w: F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - words, F.lit(0))), lambda i: i + words <= F.size(w)), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(words)]))
    cut = passages.where("q is not null").select("query_id", "q", F.split("q", " ").alias("_w"))
    anchored = cut.where(F.size("_w") >= words + 2).select("query_id", "q", F.xxhash64(*[F.get("_w", j + 1) for j in range(words)]).alias("_h"))
    # split once: bound by a one-element array, as the lambda looks at the pieces of each place
    seen = documents.select("doc_id", F.explode(F.array_distinct(F.get(F.transform(F.array(F.split("text", " ")), windows), 0))).alias("_h"))
    pairs = seen.join(anchored, "_h").select("doc_id", "query_id", "q").distinct()
    found = documents.select("doc_id", "text").join(pairs, "doc_id").where(F.col("text").contains(F.col("q"))).select("query_id", "doc_id").distinct()
    short = cut.where(F.size("_w") < words + 2).select("query_id", "q")
    return found.union(documents.join(short, F.col("text").contains(F.col("q"))).select("query_id", "doc_id").distinct())


def raw_idf(n: Column, df: Column) -> Column:
    """Inverse frequency of a term that df of n chunks have; negative for terms of more than half of them."""
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def bm25(queries: DataFrame, chunks: DataFrame, k: int = 20, k1: float = 1.5, b: float = 0.75, eps: float = 0.25, tokens=T.bm25_tokens) -> DataFrame:
    """queries (query_id, sample_id, text), chunks (sample_id, chunk_id, text): top k chunks of the query's own sample.

    Statistics are the sample's own; a negative idf is eps times the mean idf of the sample's vocabulary; repeated query
    terms count repeatedly; chunks without a term score 0 and are ranked too. Statistics come from one aggregation, not one index a query.
    """
    tok = chunks.select("sample_id", "chunk_id", tokens(F.col("text")).alias("t"))
    size = tok.select("sample_id", "chunk_id", F.size("t").alias("len"))
    stats = size.groupBy("sample_id").agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
    tf = tok.select("sample_id", "chunk_id", F.explode("t").alias("term")).groupBy("sample_id", "chunk_id", "term").agg(F.count("*").alias("tf"))
    idf = tf.groupBy("sample_id", "term").agg(F.count("*").alias("df")).join(stats, "sample_id").withColumn("raw", raw_idf(F.col("n"), F.col("df")))
    mean = idf.groupBy("sample_id").agg(F.avg("raw").alias("mean"))
    idf = idf.join(mean, "sample_id").select("sample_id", "term", "avgdl", F.when(F.col("raw") < 0, eps * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    q = queries.select("query_id", "sample_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "sample_id", "term").agg(F.count("*").alias("qtf"))
    hit = q.join(idf, ["sample_id", "term"]).join(tf, ["sample_id", "term"]).join(size, ["sample_id", "chunk_id"])
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    score = hit.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))
    every = queries.select("query_id", "sample_id").join(chunks.select("sample_id", "chunk_id"), "sample_id").select("query_id", "chunk_id")
    return ranked(every.join(score, ["query_id", "chunk_id"], "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 6)), k)


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, block: int = 4096) -> DataFrame:
    """queries (query_id, q), vectors (chunk_id, v): top k inner products of every query over all vectors; scores have six decimals.

    Queries are a stated set, taken in blocks of `block` that go to every executor; vectors are read once a block, never shuffled. A task returns
    the best k of a query in each of its batches. Null vectors, and those of another length than the block's first query, are not found.
    """
    schema = f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {dict(vectors.dtypes)['chunk_id']}, score double"
    out = None
    for part in blocks_of(queries.select("query_id", "q").where("q is not null").orderBy("query_id"), block):
        ids, held = [r[0] for r in part], vectors.sparkSession.sparkContext.broadcast(np.array([r[1] for r in part], np.float64))

        def run(batches: Iterator[pa.RecordBatch], ids=ids, held=held) -> Iterator[pa.RecordBatch]:
            asked = held.value
            # scores of one block and 256 vectors are held at a time
            for b in (big.slice(at, 256) for big in batches for at in range(0, big.num_rows, 256)):
                fits = pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(b.column(1)), asked.shape[1]), False)
                b = b.filter(fits)
                if not b.num_rows:
                    continue
                known, score = b.column(0), np.floor(asked @ b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64).T * 1e6 + 0.5) / 1e6
                rows: list[tuple[int, int]] = []
                for i, s in enumerate(score):
                    at = np.arange(len(s)) if len(s) <= k else np.flatnonzero(s >= np.partition(s, -k)[-k])
                    rows += [(i, j) for j in sorted(at.tolist(), key=lambda j: (-s[j], known[j].as_py()))[:k]]
                q, c = np.array(rows).T
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q.tolist()]), known.take(pa.array(c)), pa.array(score[q, c])], ["query_id", "chunk_id", "score"])

        got = vectors.select("chunk_id", "v").mapInArrow(run, schema)
        out = got if out is None else out.union(got)
    return ranked(vectors.sparkSession.createDataFrame([], schema) if out is None else out, k)


def rrf(lists: DataFrame, k: int = 20, c: int = 60) -> DataFrame:
    """lists (query_id, source, chunk_id, rank) -> reciprocal rank fusion, with each source's rank."""
    fused = lists.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (c + F.col("rank"))), 9).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "rank")))).alias("source_ranks"))
    return ranked(fused, k)


def zscore_fusion(a: DataFrame, b: DataFrame, k: int = 20, weight: float = 0.5) -> DataFrame:
    """Weighted sum of z-scores per query (population deviation; below 1e-8: 0); a chunk that one side lacks has 0 there."""

    def z(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("query_id")
        sd = F.stddev_pop("score").over(w)
        return df.select("query_id", "chunk_id", F.when(sd < 1e-8, 0.0).otherwise((F.col("score") - F.avg("score").over(w)) / sd).alias(name))

    both = z(a, "za").join(z(b, "zb"), ["query_id", "chunk_id"], "full")
    return ranked(both.select("query_id", "chunk_id", F.round(weight * F.coalesce("za", F.lit(0.0)) + (1 - weight) * F.coalesce("zb", F.lit(0.0)), 6).alias("score")), k)


def score_fusion(a: DataFrame, b: DataFrame, k: int = 40) -> DataFrame:
    """a, b (query_id, chunk_id, score): sum of both z-scores over the candidates of either side, where one that a side lacks has score 0 there; population deviation, below 1e-8: 0."""
    both = a.select("query_id", "chunk_id", F.col("score").alias("a")).join(b.select("query_id", "chunk_id", F.col("score").alias("b")), ["query_id", "chunk_id"], "full").fillna(0.0, ["a", "b"])
    w = Window.partitionBy("query_id")
    z = lambda c: F.when(F.stddev_pop(c).over(w) < 1e-8, 0.0).otherwise((F.col(c) - F.avg(c).over(w)) / F.stddev_pop(c).over(w))
    return ranked(both.select("query_id", "chunk_id", F.round(z("a") + z("b"), 6).alias("score")), k)


def with_digits(tokens: Column) -> Column:
    return F.filter(tokens, lambda x: x.rlike("[0-9]"))


def lexical_score(q: Column, numbers: Column, t: Column, kind: Column) -> Column:
    """Overlap of distinct tokens of question and chunk + 0.7 number overlap + bonus for table rows and headers; numbers: how many tokens of the question have digits."""
    bonus = F.when(kind == "table_row", 0.08).when(kind == "table_header", 0.03).otherwise(0.0)
    share = lambda n, of: F.coalesce(F.try_divide(n, of), F.lit(0.0))
    some = lambda t: bound(F.array_intersect(q, t), lambda both: share(F.size(both), F.size(q)) + 0.7 * share(F.size(with_digits(both)), numbers) + bonus)
    return bound(t, lambda t: F.when((F.size(q) == 0) | (F.size(t) == 0), 0.0).otherwise(some(t)))


def fused_score(q: Column, t: Column, score: Column) -> Column:
    """Coverage of the question's distinct tokens plus 0.05 of the fused score."""
    return F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1)) + 0.05 * score


def lexical_rerank(candidates: DataFrame, k: int = 10) -> DataFrame:
    """candidates (query_id, chunk_id, query, text, chunk_type): overlap + 0.7 number overlap + bonus for table rows and headers."""
    q, t = F.array_distinct(T.bm25_tokens(F.col("query"))), F.array_distinct(T.bm25_tokens(F.col("text")))
    score = lexical_score(q, F.size(with_digits(q)), t, F.col("chunk_type"))
    return ranked(candidates.select("query_id", "chunk_id", F.round(score, 6).alias("score")), k)


def fused_rerank(candidates: DataFrame, k: int = 10, tokens=T.bm25_tokens) -> DataFrame:
    """candidates (query_id, chunk_id, query, text, score): coverage of the query's tokens plus 0.05 of the fused score."""
    q, t = F.array_distinct(tokens(F.col("query"))), F.array_distinct(tokens(F.col("text")))
    return ranked(candidates.select("query_id", "chunk_id", F.round(fused_score(q, t, F.col("score")), 6).alias("score")), k)


# What asks for a market value, and the hosts that answer it well or badly.
CAP_WORDS = ("market cap", "市值")
CAP_HOSTS, CAP_OTHERS = ("companiesmarketcap.com",), ("tesla.com", "apple.com")


def cap_bonus(query: Column, url: Column, hosts: tuple[str, ...] = CAP_HOSTS, others: tuple[str, ...] = CAP_OTHERS) -> Column:
    """2 for a query about a market value on one of `hosts`, 0.4 less on one of `others` whose address doesn't speak of it; else 0."""
    asked, host = F.lower(F.coalesce(query, F.lit(""))), F.coalesce(T.host(url), F.lit(""))
    some = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: c.contains(w))
    worse = some(host, others) & ~F.lower(F.coalesce(url, F.lit(""))).contains("marketcap")
    return F.when(some(asked, CAP_WORDS), F.when(some(host, hosts), 2.0).otherwise(0.0) - F.when(worse, 0.4).otherwise(0.0)).otherwise(0.0)


def web_lexical(candidates: DataFrame, k: int = 10, bonus: Column | None = None) -> DataFrame:
    """candidates (query_id, chunk_id, query, title, text, url, source_rank, chunk_index): 3 coverage + 0.15 overlap + phrase 2 + 0.2 / source rank + bonus (a Column of candidates, such as cap_bonus())."""
    q = T.web_tokens(F.col("query"))
    body = F.concat_ws(" ", "title", "text")
    overlap = F.size(F.array_intersect(q, T.web_tokens(F.concat_ws(" ", body, T.host(F.col("url"))))))
    phrase = F.when(F.lower(body).contains(F.lower(T.squeeze(F.col("query")))), 2.0).otherwise(0.0)
    score = F.round(3.0 * overlap / F.greatest(F.size(q), F.lit(1)) + 0.15 * overlap + phrase + 0.2 / F.greatest("source_rank", F.lit(1)) + (F.lit(0.0) if bonus is None else bonus), 6)
    return ranked(candidates.withColumn("score", score), k, order=[F.desc("score"), F.asc("source_rank"), F.asc("chunk_index"), F.asc("chunk_id")]).select("query_id", "chunk_id", "score", "rank")


def web_search(chunks: DataFrame, queries: DataFrame, k: int = 10, block: int = 1000) -> DataFrame:
    """chunks (chunk_id, title, text, url, source_rank, chunk_index, words), queries (query_id, query): web_lexical of every query against every chunk.

    Queries are a stated set, taken in blocks of `block` that go to every executor with an index of their tokens; chunks are read once a
    block, each scored for the whole block. A task returns its own top k of a query. Adds rank, score and the chunk's words.
    """
    body = F.concat_ws(" ", "title", "text")
    line = F.col("chunk_id").cast("string").alias("chunk_id")
    ready = chunks.select(line, F.greatest("source_rank", F.lit(1)).cast("long").alias("source"), F.col("source_rank").cast("long").alias("source_rank"), F.col("chunk_index").cast("long").alias("chunk_index"), F.col("words").cast("long").alias("words"), F.lower(body).alias("body"), T.web_tokens(F.concat_ws(" ", body, T.host(F.col("url")))).alias("tokens"))
    asked = queries.select("query_id", F.lower(T.squeeze(F.col("query"))).alias("phrase"), T.web_tokens(F.col("query")).alias("tokens")).orderBy("query_id")
    kind = dict(queries.dtypes)["query_id"]
    schema = f"query_id {kind}, chunk_id string, score double, source_rank long, chunk_index long, words long"
    out, rows, parts = None, [], []
    for r in asked.toLocalIterator():
        rows.append((r.query_id, r.phrase, list(r.tokens or [])))
        if len(rows) == block:
            parts, rows = [*parts, rows], []
    for part in [*parts, rows] if rows else parts:
        held = chunks.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            asks = held.value
            size = np.array([max(1, len(t)) for _, _, t in asks], float)
            at: dict[str, list[int]] = {}
            for i, (_, _, tokens) in enumerate(asks):
                for t in tokens:
                    at.setdefault(t, []).append(i)
            places = {t: np.array(v) for t, v in at.items()}
            best: list[list[tuple]] = [[] for _ in asks]
            worst = np.full(len(asks), -1.0)
            for b in batches:
                for c in b.to_pylist():
                    overlap = np.zeros(len(asks))
                    for t in c["tokens"]:
                        if t in places:
                            overlap[places[t]] += 1
                    said = np.array([2.0 if p is not None and p in c["body"] else 0.0 for _, p, _ in asks])
                    score = np.floor((3.0 * overlap / size + 0.15 * overlap + said + 0.2 / c["source"]) * 1e6 + 0.5) / 1e6
                    for i in np.flatnonzero(score >= worst).tolist():
                        best[i].append((-score[i], c["source_rank"], c["chunk_index"], c["chunk_id"], c["words"]))
                        if len(best[i]) >= 4 * k:
                            best[i] = sorted(best[i])[:k]
                            worst[i] = -best[i][-1][0]
            found = [(asks[i][0], x[3], -x[0], x[1], x[2], x[4]) for i, own in enumerate(best) for x in sorted(own)[:k]]
            if found:
                yield pa.RecordBatch.from_pylist([dict(zip(("query_id", "chunk_id", "score", "source_rank", "chunk_index", "words"), x, strict=True)) for x in found])

        got = ready.mapInArrow(run, schema)
        out = got if out is None else out.union(got)
    out = chunks.sparkSession.createDataFrame([], schema) if out is None else out
    return ranked(out, k, order=[F.desc("score"), F.asc("source_rank"), F.asc("chunk_index"), F.asc("chunk_id")]).select("query_id", "chunk_id", "score", "rank", "words")


def gold_by_text(chunks: DataFrame, gold: DataFrame, least: int = 20) -> DataFrame:
    """chunks (sample_id, chunk_id, text), gold (sample_id, gold): pairs that are equal, or one within the other where that one has `least` characters."""
    c, g = T.norm_corpus(F.col("text")), T.norm_corpus(F.col("gold"))
    j = chunks.withColumn("c", c).join(gold.withColumn("g", g), "sample_id").where((F.col("c") != "") & (F.col("g") != ""))
    inside = lambda x, y: (F.char_length(x) >= least) & y.contains(x)
    return j.where((F.col("c") == F.col("g")) | inside(F.col("c"), F.col("g")) | inside(F.col("g"), F.col("c"))).select("sample_id", "chunk_id", "gold").distinct()


def neighbours(primary: DataFrame, chunks: DataFrame, before: int = 1, after: int = 1, cap: int = 18) -> DataFrame:
    """primary (query_id, sample_id, chunk_index, rank) with the chunks around each; first mention wins; `cap` a query, as the job asks.

    An equi-join on the exploded index, not a range join.
    """
    near = primary.select("query_id", "sample_id", "rank", "chunk_index", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("d"))
    order = F.struct("rank", F.abs("d").alias("far"), "d")
    near = near.withColumn("chunk_index", F.col("chunk_index") + F.col("d")).withColumn("o", order)
    kept = near.join(chunks.select("sample_id", "chunk_index"), ["sample_id", "chunk_index"]).groupBy("query_id", "sample_id", "chunk_index").agg(F.min("o").alias("o"))
    w = Window.partitionBy("query_id").orderBy("o", "sample_id", "chunk_index")
    return kept.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= cap).select("query_id", "sample_id", "chunk_index", "pos", F.when(F.col("o.d") == 0, "primary").otherwise("neighbour").alias("reason"))


def word_budget(candidates: DataFrame, budget: int) -> DataFrame:
    """candidates (query_id, chunk_id, rank, words): in rank order, what fits; the first always; none after the budget is full.

    A fold over the query's short ordered list, since skipped items don't count.
    """
    items = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "words")))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast(f"array<{dict(candidates.dtypes)['chunk_id']}>").alias("kept"))

    def step(a: Column, x: Column) -> Column:
        skip = (a["used"] >= budget) | ((F.size(a["kept"]) > 0) & (a["used"] + x["words"] > budget))
        return F.when(skip, a).otherwise(F.struct((a["used"] + x["words"]).cast("bigint").alias("used"), F.concat(a["kept"], F.array(x["chunk_id"])).alias("kept")))

    out = candidates.groupBy("query_id").agg(F.aggregate(items, start, step).alias("a"))
    return out.select("query_id", F.col("a.used").alias("used"), F.posexplode("a.kept").alias("pos", "chunk_id"))


def token_budget(candidates: DataFrame, budget: int, length: Column | None = None) -> DataFrame:
    """candidates (query_id, rank, unit, chunk_id, tokens): a unit (candidate and neighbours) is taken whole if all its new chunks fit.

    length: what a chunk costs, any Column of candidates (default: tokens). Units go by their least rank, ties by unit; a chunk named twice in a unit counts once,
    with its greatest length. A fold over a query's short list of units, with the chunks taken so far in its state.
    """
    kinds = dict(candidates.dtypes)
    chunks = candidates.withColumn("_n", (F.col("tokens") if length is None else length).cast("long")).groupBy("query_id", "unit", "chunk_id").agg(F.max("_n").alias("n"), F.min("rank").alias("rank"))
    units = chunks.groupBy("query_id", "unit").agg(F.min("rank").alias("rank"), F.array_sort(F.collect_list(F.struct("chunk_id", "n"))).alias("items"))
    pair = f"array<struct<chunk_id:{kinds['chunk_id']},unit:{kinds['unit']}>>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(pair).alias("out"))

    def step(a: Column, x: Column) -> Column:
        new = F.filter(x["items"], lambda i: ~F.exists(a["out"], lambda o: o["chunk_id"] == i["chunk_id"]))

        def take(new: Column) -> Column:
            used = a["used"] + F.aggregate(new, F.lit(0).cast("long"), lambda s, i: s + F.coalesce(i["n"], F.lit(0).cast("long")))
            more = F.transform(new, lambda i: F.struct(i["chunk_id"].alias("chunk_id"), x["unit"].alias("unit")))
            return F.when(used <= budget, F.struct(used.alias("used"), F.concat(a["out"], more).alias("out"))).otherwise(a)

        return F.get(F.transform(F.array(new), take), 0)

    order = F.array_sort(F.collect_list(F.struct("rank", "unit", "items")))
    return units.groupBy("query_id").agg(F.aggregate(order, start, step).alias("a")).select("query_id", F.inline("a.out"))


def alias_injection(queries: DataFrame, results: DataFrame, aliases: DataFrame) -> DataFrame:
    """queries (query_id, query), results (query_id, url, rank), aliases (alias, url): curated pages of an alias in the query go first; ranks anew.

    aliases is a dictionary kept by hand; Spark broadcasts it if it is below its threshold.
    """
    found = queries.join(aliases, F.lower("query").contains(F.lower("alias"))).groupBy("query_id", "url").agg(F.min("alias").alias("alias"))
    first = found.select("query_id", "url", F.lit(0).alias("late"), F.lit(0).cast("long").alias("rank"))
    rest = results.join(found, ["query_id", "url"], "left_anti").select("query_id", "url", F.lit(1).alias("late"), F.col("rank").cast("long"))
    w = Window.partitionBy("query_id").orderBy("late", "rank", "url")
    return first.union(rest).select("query_id", "url", F.row_number().over(w).alias("rank"), (F.col("late") == 0).alias("curated"))


def cleaned_pages(pages: DataFrame) -> DataFrame:
    """page_id, host and text of each page, entities decoded."""
    return pages.select("page_id", T.host(F.col("url")).alias("host"), T.squeeze(T.unescape(T.strip_tags(F.col("html")))).alias("text"))


def page_chunks(pages: DataFrame, size: int = 160, overlap: int = 40) -> DataFrame:
    """(page_id, chunk_index, text): overlapping word windows of cleaned pages."""
    return cleaned_pages(pages).select("page_id", F.posexplode(T.word_windows(F.col("text"), size, overlap)).alias("chunk_index", "text"))


def with_scores(df: DataFrame, scorer, query: str = "query", text: str = "text") -> DataFrame:
    """Pluggable scorer: a function of two pandas Series of strings to floats, run in Arrow batches."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in batches:
            yield scorer(q, t)

    return df.withColumn("score", score(query, text))


def gold_by_table(chunks: DataFrame, gold: DataFrame) -> DataFrame:
    """chunks (sample_id, chunk_id, label, header, text) of table rows, gold (sample_id, gold): rows that share enough with the gold text.

    Enough is 0.6 of the label's tokens and a number; or two numbers and three tokens; or a number and two tokens of label or header.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(T.norm_corpus(F.col(c)), F.lit(r"[a-z]+|\d+(?:\.\d+)?%?"), F.lit(0)))
    digits = lambda a: F.filter(a, lambda x: x.rlike("[0-9]"))
    names = lambda a: F.filter(a, lambda x: ~x.rlike("^[0-9]"))
    j = chunks.withColumns({"l": names(words("label")), "h": names(words("header")), "t": words("text")}).join(gold.withColumn("g", words("gold")), "sample_id")
    both = lambda a, b: F.size(F.array_intersect(a, b))
    nums, label = both(digits(F.col("t")), digits(F.col("g"))), both(F.col("l"), F.col("g"))
    share = F.coalesce(F.try_divide(label, F.size("l")), F.lit(0.0))
    enough = ((share >= 0.6) & (nums >= 1)) | ((nums >= 2) & (both(F.col("t"), F.col("g")) >= 3)) | ((nums >= 1) & (both(F.array_union("l", "h"), F.col("g")) >= 2))
    return j.where(enough).select("sample_id", "chunk_id", "gold").distinct()


def model_rerank(candidates: DataFrame, scores: DataFrame, k: int = 10) -> DataFrame:
    """candidates (query_id, chunk_id), scores (query_id, chunk_id, score) of a model -> top k by that score; candidates without one are left out."""
    return ranked(candidates.select("query_id", "chunk_id").join(scores.select("query_id", "chunk_id", "score"), ["query_id", "chunk_id"]), k)


def web_model_rerank(lexical: DataFrame, scores: DataFrame, k: int = 10) -> DataFrame:
    """lexical (query_id, chunk_id, score), scores of a model -> model score plus 0.05 of the lexical one, where there is none the lexical one; with the ranker's name."""
    j = lexical.join(scores.select("query_id", "chunk_id", F.col("score").alias("model")), ["query_id", "chunk_id"], "left")
    mixed = F.round(F.coalesce(F.col("model") + 0.05 * F.col("score"), F.col("score")), 6)
    return ranked(j.select("query_id", "chunk_id", mixed.alias("score"), F.when(F.col("model").isNull(), "lexical").otherwise("model").alias("reranker")), k)


def snippet_rerank(results: DataFrame, k: int = 10) -> DataFrame:
    """results (query_id, chunk_id, query, title, body, href, rank): 3 title + body + 0.6 address overlap, phrase 4, domain 0.5 for official queries; ties by rank."""
    q, low = T.rank_tokens(F.col("query")), lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    both = lambda c: F.size(F.array_intersect(q, T.rank_tokens(F.col(c))))
    phrase = F.when((F.trim(low("query")) != "") & F.concat_ws(" ", low("title"), low("body"), low("href")).contains(F.trim(low("query"))), 4.0).otherwise(0.0)
    domain = F.when(low("query").contains("official") & low("href").rlike(r"\.com|\.org|docs\."), 0.5).otherwise(0.0)
    score = F.round(3.0 * both("title") + both("body") + 0.6 * both("href") + phrase + domain, 4)
    return ranked(results.withColumn("score", score), k, order=[F.desc("score"), F.asc("rank"), F.asc("chunk_id")]).select("query_id", "chunk_id", "score", "rank")


def source_prior(results: DataFrame) -> DataFrame:
    """results (query_id, chunk_id, query, title, href) plus prior: for official queries 6 for each term (repeats count) that is the host's name, 2 for one within it, 1 for an official title or address."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    host = F.replace(F.coalesce(F.nullif(F.regexp_extract(low("href"), "https?://([^/]+)", 1), F.lit("")), low("href")), F.lit("www."), F.lit(""))
    terms = F.filter(T.rank_tokens(F.col("query")), lambda t: ~t.isin("framework", "documentation"))
    worth = lambda t: F.when((host == F.concat(t, F.lit(".com"))) | (host == F.concat(t, F.lit(".org"))) | host.startswith(F.concat(t, F.lit("."))), 6.0).when(host.contains(t) & ~host.contains("doc"), 2.0).otherwise(0.0)
    total = F.aggregate(F.transform(terms, worth), F.lit(0.0), lambda a, x: a + x) + F.when(low("title").contains("official") | low("href").contains("official"), 1.0).otherwise(0.0)
    return results.select("query_id", "chunk_id", F.when(low("query").contains("official"), total).otherwise(0.0).alias("prior"))
