"""Registered queries over an agent's actions, traces over facts, compact pairs and page sources, and DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import actions as C
from ..operators import evaluate as E
from . import fixtures as X
from .registry import _STATUS, FACTS, ORACLE_SQL, _rate, query, table

SCHEMAS = {"calculator": {"program": "string"}, "web_search": {"query": "string"}}


def _actions(spark, d) -> DataFrame:
    """Tool turns, and final ones where k is 5, of which every other is answered."""
    t = X.tool(spark, d)
    gold = F.when(F.col("k") == 5, F.concat(F.lit('{"action": "final", "answer": "'), "gold", F.lit('"}'))).otherwise('{"action": "tool_call", "tool_call": {"name": "calculator"}}')
    raw = F.when(F.col("id") % 16 == 5, F.concat(F.lit('{"action": "final", "answer": " '), "gold", F.lit(' "}'))).otherwise(F.col("raw_tool"))
    return t.select("id", raw.alias("raw"), gold.alias("gold"))


_J, _CALLED, _RIGHT, _FITS = "k <> 4", "k <> 4 AND id % 16 <> 5", "k NOT IN (4,5) AND id % 11 <> 0", "k <> 4 AND id % 16 <> 5 AND id % 11 <> 0"


@query(f"""SELECT count(*) AS num_samples, {_rate(_J)} AS json_valid_rate, {_rate(_J)} AS no_extra_text_rate, {_rate(_J)} AS action_valid_rate, {_rate('k NOT IN (4,5) OR id % 16 = 5')} AS action_accuracy, {_rate(_CALLED)} AS tool_name_valid_rate, {_rate(_RIGHT)} AS tool_name_accuracy,
count(*) FILTER (k <> 5) AS gold_tool_turns, count(*) FILTER ({_CALLED}) AS pred_tool_turns, {_rate(_RIGHT, 'k <> 5')} AS tool_name_accuracy_on_gold_tool_turns, {_rate(_FITS)} AS argument_schema_valid_rate, {_rate(_FITS, _CALLED)} AS argument_schema_valid_rate_on_pred_tool_turns,
count(*) FILTER (k = 5) AS final_turns, {_rate('id % 16 = 5', 'k = 5')} AS final_exact_rate FROM {X.duck_tool()} q""")
def action_report(spark, d) -> DataFrame:
    return C.action_report(_actions(spark, d), SCHEMAS)


@query(f"SELECT 'gold' AS side, 'calculator' AS tool, count(*) AS n FROM {X.duck_tool()} q WHERE k <> 5 HAVING count(*) > 0 UNION ALL SELECT 'pred', CASE WHEN id % 11 = 0 THEN 'web_search' ELSE 'calculator' END AS t, count(*) FROM {X.duck_tool()} q WHERE {_CALLED} GROUP BY t")
def tool_counts(spark, d) -> DataFrame:
    return C.tool_counts(_actions(spark, d))


_PROGRAM = "regexp_extract(raw_output, '\"program\": \"([^\"]*)\"', 1)"


@query(f"SELECT op, id, program FROM (SELECT *, row_number() OVER (PARTITION BY op ORDER BY id) AS r FROM (SELECT id, {_PROGRAM} AS program, unnest(CASE WHEN k IN (0,1,2,3,7) THEN ['subtract','divide'] WHEN k = 6 THEN ['table_sum'] ELSE [] END) AS op FROM {X.duck_qa()} q) t) u WHERE r <= 3")
def op_examples(spark, d) -> DataFrame:
    """Three programs an operator, as the report asks."""
    return C.operator_examples(X.qa(spark, d))


_SUMS = """(SELECT n_name AS symbol, n_nationkey AS nation, year(o_orderdate) AS period, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,2)))) AS BIGINT) AS w, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'F')) AS BIGINT) AS p
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)"""


def _sums(spark, d) -> DataFrame:
    """(symbol, metric, period, value): yearly revenue of nations, and that of finished orders."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    metric = F.explode(F.when(F.col("o_orderstatus") == "F", F.array(F.lit("revenue"), F.lit("finished revenue"))).otherwise(F.array(F.lit("revenue")))).alias("metric")
    rows = o.select(F.col("n_name").alias("symbol"), metric, F.year("o_orderdate").alias("period"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    return rows.groupBy("symbol", "metric", "period").agg(F.round(F.sum("v")).cast("long").alias("value"))


@query(f"SELECT symbol, period, 'What share of revenue of ' || symbol || ' was finished revenue in ' || period || '?' AS question, 'divide(' || p || ', ' || w || ')' AS program, round(p / w, 6) AS answer FROM {_SUMS} s WHERE p IS NOT NULL AND w <> 0")
def margin_traces(spark, d) -> DataFrame:
    return C.margin_traces(_sums(spark, d), "finished revenue", "revenue")


@query(f"""WITH l AS (SELECT symbol, nation, arg_max(w, period) AS v FROM {_SUMS} s GROUP BY 1, 2) SELECT x.symbol AS a, y.symbol AS b, 'What is the ratio of the latest revenue of ' || x.symbol || ' to that of ' || y.symbol || '?' AS question,
'divide(' || x.v || ', ' || y.v || ')' AS program, round(x.v / y.v, 6) AS answer FROM l x JOIN l y ON y.nation = x.nation + 1 WHERE y.v <> 0""")
def ratio_traces(spark, d) -> DataFrame:
    n = table(spark, d, "nation")
    follows = n.select(F.col("n_name").alias("b"), (F.col("n_nationkey") - 1).alias("n_nationkey"))
    return C.ratio_traces(_sums(spark, d), n.select(F.col("n_name").alias("a"), "n_nationkey").join(follows, "n_nationkey").select("a", "b"), "revenue")


CAPS = {"wrong": 900, "anchor": 900, "replay": 1500}
_COMPACT = f"""(WITH f AS (SELECT id, {_STATUS} AS status, raw_output, gold, a, b FROM {FACTS} x), m AS (SELECT conv_id, min((turn, text)) AS first FROM conversations WHERE role = 'assistant' AND text <> '' GROUP BY 1),
c AS (SELECT id, CASE WHEN status = 'scaled_correct' THEN 'anchor' ELSE 'wrong' END AS kind, 'Write one calculator call.' || chr(10) || chr(10) || 'Question:' || chr(10) || 'What is the change of ' || id || '?' || chr(10) || chr(10) || 'Gold supporting evidence:' || chr(10) || 'now ' || a || chr(10) || 'before ' || b AS prompt, 'add(' || a || ', 0)' AS chosen,
 CASE WHEN status = 'scaled_correct' THEN '{{"action": "final", "answer": "' || gold || '"}}' ELSE trim(raw_output) END AS rejected FROM f UNION ALL
 SELECT m.conv_id, 'replay', coalesce((SELECT string_agg(coalesce(text, ''), chr(10) ORDER BY turn, role, text) FROM conversations k WHERE k.conv_id = m.conv_id AND k.turn < first[1] AND role IN ('system', 'user')), ''), first[2], '{{"action": "tool_call", "tool_call": {{"name": "web_search", "arguments": {{"query": ""}}}}}}' FROM m)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5(concat('26:', CAST(id AS VARCHAR))), id) AS r FROM c) t WHERE r <= CASE kind WHEN 'replay' THEN 1500 ELSE 900 END)"""


@query(f"SELECT id, kind, prompt, chosen, rejected FROM {_COMPACT} p")
def compact_pairs(spark, d) -> DataFrame:
    """The mixture's own sizes: 900 wrong ones, 900 anchors, 1,500 of other tasks."""
    q = E.candidate_status(X.tool(spark, d)).select("id", "status", F.col("raw_output").alias("raw"), F.format_string("What is the change of %d?", "id").alias("question"), F.array(F.format_string("now %d", "a"), F.format_string("before %d", "b")).alias("evidence"), F.col("gold").alias("answer"), F.format_string("add(%d, 0)", "a").alias("chosen"))
    said = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), "turn", "role", "text")
    return C.compact_pairs(q, C.replay_prompts(said), "Write one calculator call.", CAPS, 26)


@query("""WITH c AS (SELECT o_orderkey AS id, 'get(' || o_custkey || ')' AS call, CASE WHEN o_orderkey % 3 = 0 THEN 'Find ' ELSE 'Get ' END || o_orderkey AS q FROM orders WHERE o_orderkey % 5 <> 4)
SELECT id, 'system' AS role, 'Call the API.' AS content FROM c UNION ALL SELECT id, 'user', q FROM c UNION ALL SELECT id, 'assistant', '{"action":"tool_call","tool_call":{"name":"api_call","arguments":{"call":"' || call || '"}}}' FROM c""")
def apibench_rows(spark, d) -> DataFrame:
    """By order % 5 the call is in one of two fields, in an assistant's tag, in a tool, or nowhere; by order % 3 the question is a message or a field."""
    kind, call = F.col("o_orderkey") % 5, F.format_string("get(%d)", "o_custkey")
    message = lambda when, role, text: F.when(when, F.struct(F.lit(role).alias("role"), text.alias("content")))
    messages = F.array_compact(F.array(message(F.col("o_orderkey") % 3 == 0, "user", F.format_string(" Find %d", "o_orderkey")), message(kind == 1, "assistant", F.format_string("<<<domain>>>: x\n<<<api_call>>>: get(%d)\n<<<code>>>: y", "o_custkey"))))
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), messages.alias("messages"), F.when(kind == 0, " ").alias("question"), F.format_string("Get %d", "o_orderkey").alias("query"),
        F.when(kind == 0, call).alias("api_call"), F.when(kind == 2, call).otherwise("").alias("output"), F.when(kind == 3, F.array(F.lit("no json"), F.format_string('{"api_call": "get(%d)"}', "o_custkey"))).alias("tools"),
    )
    return C.apibench_rows(rows, "Call the API.").select("id", F.inline("messages"))


def _sources(spark, d) -> DataFrame:
    """Pages as ten results a query; every seventh has no stored page, and its title is the snippet of each."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    text = F.when(F.col("page_id") % 7 > 0, T.strip_tags(F.col("html")))
    return table(spark, d, "pages").select(F.floor(F.col("page_id") / 10).alias("query_id"), (F.col("page_id") % 10 + 1).alias("rank"), "url", title.alias("title"), text.alias("text"), title.alias("snippet"))


_SOURCES = f"""(SELECT query_id, rank, url, title, text, coalesce(nullif(text, ''), title, '') AS said FROM (SELECT p.page_id // 10 AS query_id, p.page_id % 10 + 1 AS rank, p.url, regexp_extract(p.html, '<title>([^<]*)</title>', 1) AS title,
CASE WHEN p.page_id % 7 > 0 THEN s.text END AS text FROM pages p JOIN ({ORACLE_SQL['html_strip']}) s ON s.page_id = p.page_id) x WHERE rank <= 8)"""


@query(f"""SELECT query_id, 'src' || rank || '-chunk' || i AS chunk_id, url, title, rank, i AS chunk_index, array_to_string(list_slice(w, 120*i + 1, 120*i + 160), ' ') AS text FROM (SELECT *, unnest(range(0, (len(w) + 119) // 120)) AS i FROM (SELECT *, [x FOR x IN string_split(trim(regexp_replace(said, '\\s+', ' ', 'g')), ' ') IF x <> ''] AS w FROM {_SOURCES} s) a) b
WHERE i = 0 OR len(w) - 120*i >= 25""")
def source_chunks(spark, d) -> DataFrame:
    """The eight best results of a query: the job's page limit."""
    return C.source_chunks(_sources(spark, d), 8).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(f"SELECT query_id, rank, url, title, text IS NOT NULL AS ok, CASE WHEN text IS NULL THEN 'no stored page' END AS error, length(said) AS text_chars FROM {_SOURCES} s")
def fetch_report(spark, d) -> DataFrame:
    return C.fetch_report(_sources(spark, d), 8)
