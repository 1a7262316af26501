"""Evidence of ranked chunks with their context, for many settings at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.programs import bound
from ..sources.interim import written
from . import within
from .assembly import context_of_chunk

KEY = ["sample_id", "chunk_type", "chunk_index"]


def typed_grid(ranked: DataFrame, chunks: DataFrame, gold: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (5, 10, 15, 20), windows: tuple[tuple[int, int], ...] = ((0, 0), (1, 1), (1, 2), (2, 2)), cap: int = 40) -> DataFrame:
    """ranked (query_id, sample_id, chunk_type, chunk_index, rank from 1), chunks and gold (query_id too) by type and index, queries (query_id) -> a row a k and window.

    A table row brings the header and the rows within the table window, a header its first rows, a line the lines within the text window; other types only
    themselves. First mention wins, `cap` chunks a query. Percentages have two decimals; p95 is the element int(0.95 n) of the sorted sizes, the last one where that is 0.
    Counters are MAP<STRING,BIGINT> by type, `unknown` for chunks that the corpus lacks. Queries without ranked rows or gold count as 0.

    The order of first mentions is the same for all k, so each window is expanded and ranked once; sizes become a histogram before the percentile.
    """
    i, kind = F.col("chunk_index").cast("long"), F.col("chunk_type")
    place = lambda t, at, own: F.struct(t.alias("t"), at.cast("long").alias("i"), F.lit(own).alias("own"))
    tw, tb = F.col("w.text"), F.col("w.tab")
    own = F.array(place(kind, i, True))
    span = lambda n: F.transform(F.sequence(-n, n), lambda d: place(kind, i + d, False))
    rows = F.concat(own, F.array(place(F.lit("table_header"), F.lit(0), False)), span(tb))
    head = F.concat(own, F.transform(F.sequence(F.lit(1), tb + 1), lambda j: place(F.lit("table_row"), j, False)))
    every = F.when(kind == "table_row", rows).when(kind == "table_header", head).when(kind.isin("pre_text", "post_text"), F.concat(own, span(tw))).otherwise(own)
    settings = F.explode(F.array(*[F.struct(F.lit(a).alias("text"), F.lit(b).alias("tab")) for a, b in windows]))
    asked = ranked.where(F.col("rank") <= max(ks)).withColumn("w", settings)
    near = asked.select("query_id", "sample_id", "w", "rank", F.posexplode(every).alias("ord", "x")).select("query_id", "sample_id", "w", "rank", "ord", F.col("x.t").alias("chunk_type"), F.col("x.i").alias("chunk_index"), "x.own")
    known = chunks.select("sample_id", "chunk_type", F.col("chunk_index").cast("long").alias("chunk_index")).distinct().withColumn("known", F.lit(True))
    first = near.join(known, KEY, "left").where("own or known").groupBy("query_id", "w", *KEY).agg(F.min(F.struct("rank", "ord")).alias("o"), F.max("known").alias("known"))
    pos = F.row_number().over(Window.partitionBy("query_id", "w").orderBy("o"))
    kept = first.withColumn("pos", pos).where(F.col("pos") <= cap)
    truth = gold.select("query_id", "sample_id", "chunk_type", F.col("chunk_index").cast("long").alias("chunk_index")).distinct()
    truth = truth.join(known, KEY, "left").withColumn("type", F.when(F.col("known"), F.col("chunk_type")).otherwise("unknown")).drop("known")
    hit = kept.join(truth.select("query_id", *KEY, F.lit(1).alias("g")), ["query_id", *KEY], "left")
    cell = hit.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col("o.rank") <= F.col("k"))
    cell = cell.withColumn("type", F.when(F.col("known"), F.col("chunk_type")).otherwise("unknown"))
    # a row a query, setting and type: what both the sizes and the counters are made of
    cell = cell.groupBy("query_id", "k", "w", "type").agg(F.count("*").alias("n"), F.count("g").alias("h"))
    sizes = truth.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    grid = queries.select("query_id").distinct().join(sizes, "query_id", "left").withColumns({"k": F.explode(F.array(*map(F.lit, ks)))}).withColumn("w", settings)
    per = grid.join(cell.groupBy("query_id", "k", "w").agg(F.sum("n").alias("n"), F.sum("h").alias("h")), ["query_id", "k", "w"], "left").fillna(0, ["n", "h", "n_gold"])
    share = F.coalesce(F.try_divide(F.col("h"), F.col("n_gold")), F.lit(0.0))
    by_size = per.groupBy("k", "w", "n").agg(F.count("*").alias("c"), F.sum((F.col("h") > 0).cast("long")).alias("any"), F.sum(((F.col("n_gold") > 0) & (F.col("h") == F.col("n_gold"))).cast("long")).alias("all"), F.sum(share).alias("share"), F.sum("n_gold").alias("golds"))
    golds = truth.groupBy("type").agg(F.count("*").alias("gold"))
    types = cell.groupBy("k", "w", "type").agg(F.sum("n").alias("evidence"), F.sum("h").alias("h"))
    return _summary(by_size, golds, types, spark_settings(queries, ks, settings))


def report_grid(reports: DataFrame, ks: tuple[int, ...] = (5, 10, 15, 20), windows: tuple[tuple[int, int], ...] = ((0, 0), (1, 1), (1, 2), (2, 2)), cap: int = 40) -> DataFrame:
    """typed_grid() where each query is a report's own: reports (best: its ranked chunks, chunks: all of them, with is_gold) -> a row a k and window.

    What counts is a report's shape: the types, indexes and gold flags of its chunks and their ranks. Equal shapes are put together in each task before the shuffle, and settings are
    tried once a shape.
    """
    tally = lambda cs, **sums: F.transform(F.array_sort(F.array_distinct(F.transform(cs, lambda c: c["chunk_type"]))), lambda t: F.struct(t.alias("type"), *[F.size(F.filter(cs, lambda c: (c["chunk_type"] == t) & test(c))).alias(n) for n, test in sums.items()]))
    every, golden = lambda c: F.lit(True), lambda c: c["is_gold"]
    upto = lambda found, k: bound(F.filter(found, lambda c: c["rank"] <= k), lambda cs: tally(cs, n=every, h=golden))

    def cells(tw: int, tb: int) -> Column:
        found = within.evidence(F.filter("best", lambda c: c["rank"] <= max(ks)), F.col("chunks"), lambda t, i: context_of_chunk(t, i, tw, tb), cap)
        return bound(found, lambda f: F.array(*[F.struct(F.lit(k).alias("k"), F.struct(F.lit(tw).alias("text"), F.lit(tb).alias("tab")).alias("w"), upto(f, k).alias("types")) for k in ks]))

    gold = bound(F.filter("chunks", golden), lambda cs: tally(cs, n=every))
    fields = lambda c, *names: F.transform(c, lambda x: F.struct(*[x[n].alias(n) for n in ("chunk_type", "chunk_index", "is_gold", *names)]))
    shapes = reports.select(fields("best", "rank").alias("best"), fields("chunks").alias("chunks")).groupBy("best", "chunks").agg(F.count("*").alias("c"))
    shapes = shapes.select(gold.alias("golds"), F.flatten(F.array(*[cells(*w) for w in windows])).alias("cells"), "c")
    shapes = written(shapes, "shapes")
    total = lambda a, c: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x[c])
    per = shapes.select("c", total(F.col("golds"), "n").alias("n_gold"), F.explode("cells").alias("x")).select("c", "n_gold", "x.k", "x.w", "x.types", total(F.col("x.types"), "n").alias("n"), total(F.col("x.types"), "h").alias("h"))
    share = F.coalesce(F.try_divide(F.col("h"), F.col("n_gold")), F.lit(0.0))
    of = lambda when: F.sum(F.when(when, F.col("c")).otherwise(0))
    by_size = per.groupBy("k", "w", "n").agg(of(F.col("h") > 0).alias("any"), of((F.col("n_gold") > 0) & (F.col("h") == F.col("n_gold"))).alias("all"), F.sum(share * F.col("c")).alias("share"), F.sum(F.col("n_gold") * F.col("c")).alias("golds"), F.sum("c").alias("c"))
    golds = shapes.select("c", F.inline("golds")).groupBy("type").agg(F.sum(F.col("n") * F.col("c")).alias("gold"))
    types = per.select("k", "w", "c", F.inline("types")).groupBy("k", "w", "type").agg(F.sum(F.col("n") * F.col("c")).alias("evidence"), F.sum(F.col("h") * F.col("c")).alias("h"))
    settings = F.explode(F.array(*[F.struct(F.lit(a).alias("text"), F.lit(b).alias("tab")) for a, b in windows]))
    return _summary(by_size, golds, types, spark_settings(reports, ks, settings))


def _summary(by_size: DataFrame, golds: DataFrame, types: DataFrame, settings: DataFrame) -> DataFrame:
    """Rates and counters a setting, from queries by (k, w, n), gold chunks by type and evidence by (k, w, type)."""
    w = Window.partitionBy("k", "w")  # a row for each size up to the cap
    by_size = by_size.withColumns({"upto": F.sum("c").over(w.orderBy("n")), "total": F.sum("c").over(w)})
    at = F.floor(F.col("total") * 0.95)
    percent = lambda c: F.round(100 * F.sum(c) / F.sum("c"), 2)
    rates = by_size.groupBy("k", "w").agg(
        F.sum("c").alias("num_queries"), percent("any").alias("any_recall"), percent("all").alias("all_recall"), percent("share").alias("evidence_coverage"), F.round(F.sum("golds") / F.sum("c"), 2).alias("avg_gold_chunks"),
        F.round(F.sum(F.col("n") * F.col("c")) / F.sum("c"), 2).alias("avg_evidence_chunks"), F.coalesce(F.min(F.when((at > 0) & (F.col("upto") >= at), F.col("n"))), F.max("n")).alias("p95_evidence_chunks"),
    )
    as_map = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(c) > 0, F.struct("type", c)))))
    # types are few, so the settings meet them all
    every = settings.join(F.broadcast(golds)).join(types, ["k", "w", "type"], "full")
    every = every.withColumns({"evidence": F.coalesce("evidence", F.lit(0)), "missed": F.coalesce("gold", F.lit(0)) - F.coalesce("h", F.lit(0)), "gold": F.coalesce("gold", F.lit(0))})
    counters = every.groupBy("k", "w").agg(as_map("gold").alias("gold_types"), as_map("missed").alias("missed_types"), as_map("evidence").alias("evidence_types"))
    return rates.join(counters, ["k", "w"], "left").select("k", F.col("w.text").alias("text_window"), F.col("w.tab").alias("table_window"), *rates.columns[2:], "gold_types", "missed_types", "evidence_types")


def spark_settings(any_table: DataFrame, ks: tuple[int, ...], settings) -> DataFrame:
    """One row a k and window."""
    return any_table.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ks))).alias("k")).withColumn("w", settings)
