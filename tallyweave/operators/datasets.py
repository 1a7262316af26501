"""Training rows from sources and predictions: caps, pairs, mixtures, splits. Order is md5(seed:id), the same on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N


def shuffled(seed: int, id_col: str = "id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))


def capped(df: DataFrame, caps: dict[str, int], by: str, seed: int, id_col: str = "id") -> DataFrame:
    """At most caps[value] rows of each value of `by`, in hash order; other values are dropped."""
    w = Window.partitionBy(by).orderBy(shuffled(seed, id_col), id_col)
    limit = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    # the greatest cap first: Spark cuts each task's rows by it before the shuffle
    near = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(caps.values()))
    return near.where(F.col("_n") <= F.try_element_at(limit, F.col(by))).drop("_n")


def dev_split(df: DataFrame, seed: int = 42, least: int = 500, share: float = 0.1, id_col: str = "id") -> DataFrame:
    """Adds split: the first max(least, share of all) rows in hash order are dev.

    The place of a row comes from counts per hash prefix and a rank within the prefix, so no task sees all rows.
    """
    h = df.withColumn("_h", shuffled(seed, id_col)).withColumn("_p", F.substring("_h", 1, 3))
    sums = h.groupBy("_p").agg(F.count("*").alias("_c"))  # 4096 rows at most
    before = sums.withColumns({"_before": F.coalesce(F.sum("_c").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_c").over(Window.partitionBy(F.lit(0)))})
    place = F.row_number().over(Window.partitionBy("_p").orderBy("_h", id_col)) + F.col("_before")
    dev = place <= F.greatest(F.lit(least), F.floor(F.col("_all") * share))
    return h.join(before.drop("_c"), "_p").withColumn("split", F.when(dev, "dev").otherwise("train")).drop("_h", "_p", "_before", "_all")


def replay_mix(new: DataFrame, old: DataFrame, cap: int, seed: int, id_col: str = "id") -> DataFrame:
    """All of new, and `cap` rows of old in hash order that new lacks."""
    rest = old.join(new.select(id_col), id_col, "left_anti").orderBy(shuffled(seed, id_col), id_col).limit(cap)
    return new.withColumn("origin", F.lit("new")).unionByName(rest.withColumn("origin", F.lit("replay")), allowMissingColumns=True)


def upsert_manifest(old: DataFrame, new: DataFrame, key: str = "name", order: str = "ordinal") -> DataFrame:
    """One row a name: the one with the highest ordinal, new before old; ties by the greater hash of the row."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc("_new"), F.desc(order), F.desc(F.xxhash64(*both.columns)))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the highest order; ties by the greater hash of the row."""
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc(F.xxhash64(*df.columns)))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def preference_pairs(preds: DataFrame) -> DataFrame:
    """parsed predictions (id, gold, raw_output, correct): chosen is the gold answer, rejected the wrong non-empty output."""
    chosen = F.to_json(F.struct(F.col("gold").alias("answer")))
    return preds.where(~F.col("correct") & (F.trim("raw_output") != "")).select("id", chosen.alias("chosen"), F.col("raw_output").alias("rejected"))


def assistant_turns(conversations: DataFrame) -> DataFrame:
    """A row an assistant turn: its index among them, its text, and the number and roles of the messages before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    df = conversations.withColumns({"prefix": F.row_number().over(w) - 1, "turn_idx": F.count_if(F.col("role") == "assistant").over(w) - 1})
    return df.where("role = 'assistant'").select("conv_id", "turn", "turn_idx", "prefix", "text")


def chat_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, messages) with roles system/human/gpt, in order of turn."""
    role = F.create_map(*[F.lit(x) for x in ("system", "system", "user", "human", "assistant", "gpt")])
    msg = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    got = conversations.groupBy("conv_id").agg(msg.alias("m"))
    return got.select("conv_id", F.transform("m", lambda x: F.struct(F.coalesce(F.try_element_at(role, x["role"]), x["role"]).alias("from"), x["text"].alias("value"))).alias("messages"))


def prompt_prefix(messages: Column) -> Column:
    """Messages before the first assistant (gpt) message."""
    at = F.array_position(F.transform(messages, lambda m: m["from"]), "gpt")
    return F.when(at > 0, F.slice(messages, F.lit(1), at.cast("int") - 1)).otherwise(messages)


def next_tool_rows(traces: DataFrame, pool: DataFrame, distractors: int = 8, seed: int = 42) -> DataFrame:
    """traces (trace_id, step, tool), pool (tool): a row a step with the tools before it and candidates of the path and of the pool.

    pool is the tool registry, a short list.
    """
    path = traces.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "tool"))), lambda x: x["tool"]).alias("path"))
    all_tools = pool.agg(F.array_sort(F.collect_set("tool")).alias("pool"))
    rows = path.crossJoin(F.broadcast(all_tools)).select("trace_id", "path", "pool", F.posexplode("path").alias("pos", "gold_tool"))
    others = F.slice(F.array_sort(F.transform(F.array_except("pool", "path"), lambda t: F.struct(F.md5(F.concat(F.lit(f"{seed}:"), F.col("trace_id").cast("string"), t).cast("binary")).alias("h"), t.alias("t")))), 1, distractors)
    cands = F.array_sort(F.concat(F.array_distinct("path"), F.transform(others, lambda x: x["t"])))
    return rows.select("trace_id", "pos", "gold_tool", F.array_join(F.slice("path", F.lit(1), F.col("pos")), ",").alias("previous"), F.array_join(cands, ",").alias("candidates"))


def repair_merge(base: DataFrame, repairs: DataFrame) -> DataFrame:
    """base (id, program), repairs (id, program, ok): executable repairs replace the program."""
    good = repairs.where("ok").select("id", F.col("program").alias("new"))
    return base.join(good, "id", "left").select("id", F.coalesce("new", "program").alias("program"), F.col("new").isNotNull().alias("repaired"))


def merge_repairs(base: DataFrame, repairs: DataFrame) -> DataFrame:
    """base (id, program, answer), repairs (id, run, program) that were executed -> (id, program, answer, repaired): a repair that ran gives its program, and its value as the answer.

    The value stands at the scale nearest to the old answer, whose percent sign stays. Of several repairs of an id the one with the greatest program counts.
    """
    good = repairs.where((F.trim("program") != "") & F.col("run.ok")).groupBy("id").agg(F.max(F.struct("program", F.col("run.result").alias("value"))).alias("new"))
    value = F.coalesce(N.nearest_variant(F.col("new.value"), N.extract_num(F.col("answer"))), F.col("new.value"))
    said = F.concat(N.format_number(value), F.when(F.col("answer").contains("%"), "%").otherwise(""))
    done = F.col("new").isNotNull()
    return base.join(good, "id", "left").select("id", F.when(done, F.col("new.program")).otherwise(F.col("program")).alias("program"), F.when(done, said).otherwise(F.col("answer")).alias("answer"), done.alias("repaired"))


def staged_mix(rows: DataFrame, replay_train: DataFrame, replay_dev: DataFrame, dev: int, most_train: int, most_dev: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """rows (id, source, ok): the usable ones, of each source the first `dev` in hash order as dev; replays (id) up to their caps -> (id, source, split), and one row of counts with those dropped."""
    w = Window.partitionBy("source").orderBy(shuffled(seed), "id")
    first = rows.where("ok").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= dev).select("id", "source", F.lit("dev").alias("split"))
    own = rows.where("ok").select("id", "source").join(first, ["id", "source"], "left").withColumn("split", F.coalesce("split", F.lit("train")))
    cut = lambda df, n, split: df.orderBy(shuffled(seed), "id").limit(n).select("id", F.lit("replay").alias("source"), F.lit(split).alias("split"))
    out = own.union(cut(replay_train, most_train, "train")).union(cut(replay_dev, most_dev, "dev"))
    return out, rows.agg(F.count_if("ok").alias("kept"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("dropped"))


def usable(rows: DataFrame, source: str) -> DataFrame:
    """rows (source, answer, program) of one source that have an answer and a program; null and empty ones go."""
    return rows.where((F.col("source") == source) & (F.coalesce("answer", F.lit("")) != "") & (F.coalesce("program", F.lit("")) != ""))
