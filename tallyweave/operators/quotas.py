"""Quotas over overlapping pools: who gets a row when several pools want it.

A pool of limit n takes its first n rows in hash order that no pool before it has taken. Those before it have taken as many as their limits together at most,
so each pool's first (total + all limits) rows hold all that can matter: one ranking with a bounded result a pool, whatever the input's size. What
follows works on that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.interim import written
from .datasets import shuffled


def _places(rows: DataFrame, seed: int, room: int) -> DataFrame:
    """rows (id, pool) plus place, the rank within the pool by hash; `room` a pool at most. Spark cuts each task's rows before the shuffle."""
    place = F.row_number().over(Window.partitionBy("pool").orderBy(shuffled(seed), "id"))
    return rows.withColumn("place", place).where(F.col("place") <= room)


def allocated(rows: DataFrame, pools: list[tuple[str, int]], total: int, seed: int) -> DataFrame:
    """rows (id, pools array<string>) -> (id, pool, pos): the pools in order each take up to their limit of rows not taken yet; what is then missing from
    `total` is topped up from all pools in the same order, with pool `top_up`.

    pos counts from 1 in the order taken; `total` rows at most. A repeated id counts once, a null id is a row like others; pools of no name in the list, null and
    empty ones, take nothing.
    """
    names, limits = [p for p, _ in pools], [n for _, n in pools]
    each = rows.select("id", F.explode_outer("pools").alias("pool")).where(F.col("pool").isin(names)).distinct()
    known = written(_places(each, seed, total + sum(limits)), "pools")
    turn = F.array_position(F.array(*map(F.lit, names)), F.col("pool")).cast("int")

    def left(taken: DataFrame | None) -> DataFrame:
        if taken is None:
            return known
        return known.join(taken.select(F.col("id").alias("_id")), F.col("id").eqNullSafe(F.col("_id")), "left_anti")

    taken = None
    for name, limit in pools:
        mine = left(taken).where(F.col("pool") == name)
        mine = mine.withColumn("_r", F.row_number().over(Window.partitionBy("pool").orderBy("place"))).where(F.col("_r") <= limit)
        mine = mine.select("id", "pool", turn.alias("turn"), F.col("place").cast("long").alias("place"))
        taken = mine if taken is None else taken.union(mine)
    taken = written(taken, "taken")
    rest = taken.agg(F.greatest(F.lit(total) - F.count("*"), F.lit(0)).alias("rest"))
    # the rest of the budget is one row
    more = left(taken).groupBy("id").agg(F.min(F.struct(turn.alias("turn"), "place")).alias("o")).crossJoin(F.broadcast(rest))
    more = more.withColumn("_r", F.row_number().over(Window.partitionBy("rest").orderBy("o"))).where("_r <= rest")
    every = taken.union(more.select("id", F.lit("top_up"), F.lit(len(pools) + 1), F.col("_r").cast("long")))
    pos = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("turn", "place"))
    return every.withColumn("pos", pos).where(F.col("pos") <= total).select("id", "pool", "pos")


def hard_set(preds: DataFrame, wrong: int = 1500, focus: int = 650, anchor: int = 350, total: int = 2500, seed: int = 7) -> DataFrame:
    """preds (id, correct, category) -> (id, reason, category): wrong ones, then questions of the focus classes, then right ones, topped up to `total`.

    A row taken by its class or as an anchor has that as its reason; the others say whether the prediction was right. One row an id, the one with the greatest hash of several.
    """
    one = preds.groupBy("id").agg(F.max_by(F.struct("correct", "category"), F.xxhash64(*preds.columns)).alias("p")).select("id", F.coalesce("p.correct", F.lit(False)).alias("correct"), "p.category")
    flag = lambda c, name: F.when(c, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    pools = F.concat(flag(~F.col("correct"), "wrong"), flag(F.coalesce(F.col("category").isin("percent_rate", "ratio", "average"), F.lit(False)), "focus"), flag(F.col("correct"), "anchor"))
    got = allocated(one.select("id", pools.alias("pools")), [("wrong", wrong), ("focus", focus), ("anchor", anchor)], total, seed)
    said = F.when(F.col("pool") == "focus", "category_focus").when(F.col("pool") == "anchor", "anchor_correct").when(F.col("correct"), "sft_correct").otherwise("sft_wrong")
    return got.join(one, "id").select("id", said.alias("reason"), "category")


def tagged_mixture(rows: DataFrame, caps: dict[str, int], seed: int) -> DataFrame:
    """rows (id, tags array<string>) -> (id, tag): up to caps[tag] ids of each tag in hash order; an id may stand under several tags, under each once."""
    # outer: else Spark filters on the size of the tags below and writes what they are made of, programs' runs and all, out once more for each mention
    each = rows.select("id", F.explode_outer("tags").alias("pool")).where(F.col("pool").isin(list(caps))).distinct()
    limit = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    return _places(each, seed, max(caps.values())).where(F.col("place") <= F.try_element_at(limit, F.col("pool"))).select("id", F.col("pool").alias("tag"))


def reward_mixture(preds: DataFrame, replay: DataFrame, caps: dict[str, int], seed: int = 27) -> DataFrame:
    """preds (id, correct, hard) and replay (id, gold_tool) -> (id, tag, task_type, gold_tool): wrong, right and hard questions, and tool turns of other sources.

    replay rows without a gold tool are left out. caps: rows of the tags wrong, anchor, keyword and replay.
    """
    tag = lambda c, name: F.when(c, F.lit(name))
    right = F.coalesce("correct", F.lit(False))
    tags = F.array_compact(F.array(tag(~right, "wrong"), tag(right, "anchor"), tag(F.coalesce("hard", F.lit(False)), "keyword")))
    own = tagged_mixture(preds.select(F.col("id").cast("string").alias("id"), tags.alias("tags")), {k: v for k, v in caps.items() if k != "replay"}, seed)
    tool = replay.where("gold_tool <> ''").select(F.col("id").cast("string").alias("id"), "gold_tool")
    old = tagged_mixture(tool.select("id", F.array(F.lit("replay")).alias("tags")), {"replay": caps["replay"]}, seed).join(tool.groupBy("id").agg(F.max("gold_tool").alias("gold_tool")), "id")
    return own.select("id", "tag", F.lit("program").alias("task_type"), F.lit(None).cast("string").alias("gold_tool")).union(old.select("id", "tag", F.lit("route_replay"), "gold_tool"))
