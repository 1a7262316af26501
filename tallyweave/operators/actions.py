"""Actions of an agent: reports with argument schemas, templated traces over facts, compact preference pairs and rows from API benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .agents import tagged
from .datasets import capped
from .evaluate import examples, operators_of, parsed, rate

#: JSON types of arguments and what Spark calls them in a variant.
KINDS = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}
ACTIONS = ("tool_call", "final", "clarify")


def _turns(rows: DataFrame) -> DataFrame:
    """rows (raw, gold) plus the variants p, g and their actions and tools; a tool is empty where there is none."""
    df = rows.withColumns({"p": T.extract_json(F.col("raw")), "g": T.extract_json(F.col("gold"))})
    name = lambda v: F.when(T.is_object(v), F.coalesce(T.field(v, "$.tool_call.name"), F.lit(""))).otherwise("")
    action = lambda v: F.when(T.is_object(v), F.coalesce(T.field(v, "$.action"), F.lit(""))).otherwise("")
    return df.withColumns({"ok": T.is_object(F.col("p")), "pred_action": action(F.col("p")), "gold_action": action(F.col("g")), "pred_tool": name(F.col("p")), "gold_tool": name(F.col("g"))})


def fits_schema(v: Column, tool: Column, schemas: dict[str, dict[str, str]]) -> Column:
    """Whether the call in v has each required argument of its tool, in the type stated; `api_call` takes any object."""
    args = F.try_variant_get(v, "$.tool_call.arguments", "variant")
    shaped = args.isNull() | T.is_object(args)

    def one(argument: str, kind: str) -> Column:
        is_a = F.schema_of_variant(F.try_variant_get(v, f"$.tool_call.arguments.{argument}", "variant"))
        found = F.lit(False)
        for k in KINDS[kind]:
            found = found | is_a.startswith(k)
        return F.coalesce(found, F.lit(False))

    out = F.when(tool == "api_call", shaped)
    for name, wanted in schemas.items():
        every = shaped
        for argument, kind in wanted.items():
            every = every & one(argument, kind)
        out = out.when(tool == name, every)
    return F.coalesce(out, F.lit(False))


def action_report(rows: DataFrame, schemas: dict[str, dict[str, str]]) -> DataFrame:
    """rows (raw, gold: JSON texts) -> one row: rates of valid and right actions, tools and arguments, over all rows and over tool or final turns.

    schemas: tool -> required argument -> JSON type. Null texts have no JSON; no rows give null rates.
    """
    c = F.col
    called, right = c("pred_action") == "tool_call", (c("pred_tool") != "") & (c("pred_tool") == c("gold_tool"))
    answer = lambda v: T.squeeze(F.lower(F.coalesce(T.field(v, "$.answer"), F.lit(""))))
    exact = (c("pred_action") == "final") & (answer(c("p")) == answer(c("g")))
    bare = F.coalesce(F.trim("raw").startswith("{") & F.trim("raw").endswith("}"), F.lit(False))
    df = _turns(rows).withColumns({"bare": bare, "called": called, "right": right, "exact": exact})
    df = df.withColumn("fits", c("called") & fits_schema(c("p"), c("pred_tool"), schemas))
    turn, last = c("gold_action") == "tool_call", c("gold_action") == "final"
    return df.agg(
        F.count("*").alias("num_samples"), rate(c("ok")).alias("json_valid_rate"), rate(c("bare")).alias("no_extra_text_rate"), rate(c("pred_action").isin(*ACTIONS)).alias("action_valid_rate"),
        rate(c("ok") & (c("pred_action") == c("gold_action"))).alias("action_accuracy"), rate(c("called") & c("pred_tool").isin(*schemas, "api_call")).alias("tool_name_valid_rate"), rate(c("right")).alias("tool_name_accuracy"),
        F.count_if(turn).alias("gold_tool_turns"), F.count_if("called").alias("pred_tool_turns"), rate(c("right"), turn).alias("tool_name_accuracy_on_gold_tool_turns"),
        rate(c("fits")).alias("argument_schema_valid_rate"), rate(c("fits"), c("called")).alias("argument_schema_valid_rate_on_pred_tool_turns"), F.count_if(last).alias("final_turns"), rate(c("exact"), last).alias("final_exact_rate"),
    )


def tool_counts(rows: DataFrame) -> DataFrame:
    """rows (raw, gold) -> (side, tool, n): how often each tool is called on either side."""
    sides = F.explode(F.array(F.struct(F.lit("gold").alias("side"), F.col("gold_tool").alias("tool")), F.struct(F.lit("pred").alias("side"), F.col("pred_tool").alias("tool"))))
    return _turns(rows).select(sides.alias("x")).select("x.*").where("tool <> ''").groupBy("side", "tool").agg(F.count("*").alias("n"))


def operator_examples(preds: DataFrame, n: int = 3) -> DataFrame:
    """(op, id, program): the first n programs by id of each operator; a program that has it twice counts twice."""
    ops = parsed(preds).select("id", "program", F.explode(operators_of(F.col("program"))).alias("op"))
    return examples(ops, "op", n).select("op", "id", "program")


def margin_traces(facts: DataFrame, part: str, whole: str) -> DataFrame:
    """facts (symbol, metric, period, value) -> the share of one metric in another, a row a symbol and period that has both; a whole of 0: no row."""
    of = lambda metric, name: facts.where(F.col("metric") == metric).select("symbol", "period", F.col("value").alias(name))
    df = of(part, "p").join(of(whole, "w"), ["symbol", "period"]).where("w <> 0 and p is not null")
    question = F.concat(F.lit(f"What share of {whole} of "), "symbol", F.lit(f" was {part} in "), F.col("period").cast("string"), F.lit("?"))
    program = F.concat(F.lit("divide("), F.col("p").cast("string"), F.lit(", "), F.col("w").cast("string"), F.lit(")"))
    return df.select("symbol", "period", question.alias("question"), program.alias("program"), F.round(F.col("p") / F.col("w"), 6).alias("answer"))


def ratio_traces(facts: DataFrame, pairs: DataFrame, metric: str) -> DataFrame:
    """facts, pairs (a, b) of symbols -> the ratio of their latest values of a metric; unknown symbols and a latest value of 0 below: no row."""
    last = facts.where(F.col("metric") == metric).groupBy("symbol").agg(F.max_by("value", "period").alias("value"))
    side = lambda s, v: last.select(F.col("symbol").alias(s), F.col("value").alias(v))
    df = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where("y <> 0 and x is not null")
    question = F.concat(F.lit(f"What is the ratio of the latest {metric} of "), "a", F.lit(" to that of "), "b", F.lit("?"))
    program = F.concat(F.lit("divide("), F.col("x").cast("string"), F.lit(", "), F.col("y").cast("string"), F.lit(")"))
    return df.select("a", "b", question.alias("question"), program.alias("program"), F.round(F.col("x") / F.col("y"), 6).alias("answer"))


def replay_prompts(messages: DataFrame) -> DataFrame:
    """messages (id, turn, role, text) -> (id, prompt, chosen): what stands before the first assistant message, and that one; without one: no row."""
    said = F.struct("turn", "role", "text")
    first = messages.where("role = 'assistant' and text <> ''").groupBy("id").agg(F.min(said).alias("first"))
    before = messages.join(first, "id").where((F.col("turn") < F.col("first.turn")) & F.col("role").isin("system", "user")).groupBy("id").agg(F.array_sort(F.collect_list(said)).alias("m"))
    prompt = F.coalesce(F.array_join(F.transform("m", lambda x: F.coalesce(x["text"], F.lit(""))), "\n"), F.lit(""))
    return first.join(before, "id", "left").select("id", prompt.alias("prompt"), F.col("first.text").alias("chosen"))


def compact_pairs(candidates: DataFrame, replay: DataFrame, ask: str, caps: dict[str, int], seed: int) -> DataFrame:
    """Preference pairs (id, kind, prompt, chosen, rejected) with short prompts: the question and its gold evidence.

    candidates (id, status, raw, question, evidence array, answer, chosen): right ones are anchors against a direct answer, others against what
    was said. replay (id, prompt, chosen): other tasks against a call of the wrong tool. caps: of kinds wrong, anchor and replay; which rows
    they leave is drawn by seed.
    """
    # The outputs to be rejected.
    empty, wrong_tool = '{"action":"final","answer":""}', '{"action": "tool_call", "tool_call": {"name": "web_search", "arguments": {"query": ""}}}'
    answer = F.concat(F.lit('{"action": "final", "answer": '), F.to_json(F.struct(F.coalesce("answer", F.lit("")).alias("a"))).substr(F.lit(6), F.lit(1 << 30)))
    kind = F.when(F.col("status") == "scaled_correct", "anchor").otherwise("wrong")
    said = F.trim(F.coalesce("raw", F.lit("")))
    prompt = F.concat(F.lit(f"{ask}\n\nQuestion:\n"), F.coalesce("question", F.lit("")), F.lit("\n\nGold supporting evidence:\n"), F.coalesce(F.array_join("evidence", "\n"), F.lit("")))
    own = candidates.select("id", kind.alias("kind"), prompt.alias("prompt"), "chosen", F.when(kind == "anchor", answer).when(said == "", empty).otherwise(said).alias("rejected"))
    other = replay.select("id", F.lit("replay").alias("kind"), "prompt", "chosen", F.lit(wrong_tool).alias("rejected"))
    return capped(own.unionByName(other), caps, "kind", seed)


def apibench_rows(rows: DataFrame, instruction: str) -> DataFrame:
    """(id, messages array, question, query, instruction, prompt, user, api_call, answer, output, function_call, call, tools array; all but id
    optional) -> chat rows (id, messages) whose answer is a call of `api_call`.

    The question is the first user message, else the first of the fields that has text, else the whole row; the call is the first of its
    fields, else the tag in an assistant message, else a tool's. Rows without a call are dropped.
    """
    has = lambda names: [F.when(F.trim(n) != "", F.trim(n)) for n in names.split() if n in rows.columns]
    filled = lambda a: F.get(F.filter(a, lambda x: F.coalesce(x, F.lit("")) != ""), 0)
    of = lambda role: F.transform(F.filter("messages", lambda m: m["role"] == role), lambda m: m["content"])
    query, call = has("question query instruction prompt user"), has("api_call answer output function_call call")
    if "messages" in rows.columns:
        query = [F.trim(filled(of("user"))), *query]
        call = [*call, filled(F.transform(of("assistant"), lambda x: tagged(x, "api_call")))]
    if "tools" in rows.columns:
        call = [*call, F.trim(filled(F.transform("tools", lambda t: T.field(F.try_parse_json(t), "$.api_call"))))]
    whole = F.to_json(F.struct(*[f"`{c}`" for c in rows.columns]))
    df = rows.select("id", F.coalesce(*query, whole).alias("q"), F.coalesce(*call, F.lit("")).alias("call")).where("call <> ''")
    msg = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    said = F.to_json(F.struct(F.lit("tool_call").alias("action"), F.struct(F.lit("api_call").alias("name"), F.struct("call").alias("arguments")).alias("tool_call")))
    return df.select("id", F.array(msg("system", F.lit(instruction)), msg("user", F.col("q")), msg("assistant", said)).alias("messages"))


def _source(pages: DataFrame) -> DataFrame:
    return pages.withColumn("said", F.coalesce(F.when(F.col("text") != "", F.col("text")), F.col("snippet"), F.lit("")))


def source_chunks(pages: DataFrame, limit: int, size: int = 160, overlap: int = 40) -> DataFrame:
    """pages (query_id, rank, url, title, text, snippet) -> chunks `src{rank}-chunk{i}` of the pages up to rank `limit`; a page without text gives its snippet, without either: none."""
    cut = T.word_windows(F.col("said"), size, overlap)
    pieces = F.posexplode(F.when(F.size(cut) > 0, cut).otherwise(F.array("snippet"))).alias("chunk_index", "chunk")
    rows = _source(pages.where(F.col("rank") <= limit)).select("query_id", "rank", "url", "title", pieces).where("trim(chunk) <> ''")
    return rows.select("query_id", F.format_string("src%d-chunk%d", "rank", "chunk_index").alias("chunk_id"), "url", "title", "rank", "chunk_index", F.col("chunk").alias("text"))


def fetch_report(pages: DataFrame, limit: int) -> DataFrame:
    """pages (query_id, rank, url, title, text, snippet) -> (query_id, rank, url, title, ok, error, text_chars): what each page up to rank `limit` gave; a null text is a page that could not be had."""
    ok = F.col("text").isNotNull()
    return _source(pages.where(F.col("rank") <= limit)).select("query_id", "rank", "url", "title", ok.alias("ok"), F.when(~ok, "no stored page").alias("error"), F.char_length("said").cast("long").alias("text_chars"))
