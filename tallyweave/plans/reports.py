"""Registered queries over reports, filter ladders, controllers and rerankers, and DuckDB SQL for the same rows. Reports are made from orders and their lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.programs import execute_programs
from ..operators import agents as A
from ..operators import assembly as B
from ..operators import datasets as D
from ..operators import evaluate as E
from ..operators import lists as L
from ..operators import retrieval as R
from ..operators import within as I
from . import fixtures as X
from .registry import _STATUS, _YEARS, EXACT, FACTS, GOLDS, ORACLE_SQL, SCALES, _close, _duck_lists, _facts, _lists, _rate, _scaled, candidate_status, evidence_grid, query, table

QUESTION = "concat(CASE id % 4 WHEN 0 THEN 'What is the percentage change' WHEN 1 THEN 'What is the total' WHEN 2 THEN 'What is the average amount' ELSE 'How much higher is line 2' END, ' of order ', CAST(id AS {string}), '?')"


def _orders(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderstatus", F.round("o_totalprice").cast("long").alias("total"))


def _lines_of(spark, d, n: int, *values) -> DataFrame:
    """Lines dealt by order, which is their id, into n partitions."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), *values).repartition(n, "id")


def _told() -> dict:
    """What a report of an order says around its table."""
    order = F.concat(F.lit("Order "), F.col("id").cast("string"), F.lit(" was placed by customer "), F.col("o_custkey").cast("string"), F.lit("."))
    return {"pre_text": F.array(order, _status()), "post_text": F.array(F.concat(F.lit("The total price is "), F.col("total").cast("string"), F.lit(" dollars.")))}


def _status():
    return F.concat(F.lit("Its status is "), "o_orderstatus", F.lit("."))


def reports(spark, d, beside=None) -> DataFrame:
    """(id, pre_text, rows, post_text, question, answer, program, gold): orders with their lines as a table, in order of line, quantity and price.

    Texts are made once orders and lines have met, so that only numbers are shuffled; partitions grow in number with the lines. beside: a function of the orders (id) that adds columns.
    """
    n = X.shares(spark, d, "lineitem", 400_000)
    x = F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q"), F.round("l_extendedprice").cast("long").alias("p")).alias("x")
    lines = _lines_of(spark, d, n, x).groupBy("id").agg(F.collect_list("x").alias("x"))
    o = _orders(spark, d)
    more = beside(o) if beside else o
    # sort_array compares as array_sort does, without a lambda
    cells = F.transform(F.sort_array("x"), lambda x: F.array(F.concat(F.lit("line "), x["l_linenumber"].cast("string")), x["q"].cast("string"), x["p"].cast("string")))
    total, told = F.col("total").cast("string"), _told()
    return more.repartition(n, "id").join(lines, "id").select(
        "id", told["pre_text"].alias("pre_text"), F.concat(F.array(F.array(F.lit("label"), F.lit("quantity"), F.lit("amount"))), cells).alias("rows"), told["post_text"].alias("post_text"),
        F.expr(QUESTION.format(string="STRING")).alias("question"), total.alias("answer"), F.concat(F.lit("add("), total, F.lit(", 0)")).alias("program"), F.array(_status(), F.lit("2")).alias("gold"),
        *[c for c in more.columns if c not in o.columns],
    )


def most_windows(spark, d, n: int, shown) -> DataFrame:
    """(r, m): m windows or fewer has each report whose id leaves r by n. shown: a function that changes the texts. Counted from orders and lines apart, as a table has a row a line and its header."""
    parts = X.shares(spark, d, "lineitem", 400_000)
    texts = shown(_orders(spark, d).repartition(parts, "id").withColumns(_told()).withColumn("rows", F.array().cast("array<array<string>>")))
    around = texts.select((F.col("id") % n).alias("r"), B.most_windows(texts).alias("m")).groupBy("r").agg(F.max("m").alias("m"))
    rows = _lines_of(spark, d, parts).groupBy("id").agg((F.count("*") + 1).cast("int").alias("rows"))
    most = rows.groupBy((F.col("id") % n).alias("r")).agg(F.max("rows").alias("rows"))
    return around.join(most, "r").select("r", (F.col("m") + F.col("rows")).alias("m"))


_ROWS = "(SELECT o_orderkey AS id, o_custkey AS c, o_orderstatus AS s, CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) AS total, 'line ' || l_linenumber AS label, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q, CAST(CAST(round(l_extendedprice) AS BIGINT) AS VARCHAR) AS p, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, CAST(l_quantity AS INT), CAST(round(l_extendedprice) AS BIGINT)) AS i FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
_REPORTS = f"(SELECT id, any_value(c) AS c, any_value(s) AS s, any_value(total) AS total, string_agg('| ' || label || ' | ' || q || ' | ' || p || ' |', chr(10) ORDER BY i) AS body FROM {_ROWS} l GROUP BY id)"
_CHUNKS = f"""(SELECT id AS sample_id, 'pre_text' AS chunk_type, 0 AS chunk_index, 'Order ' || id || ' was placed by customer ' || c || '.' AS text FROM {_REPORTS} a UNION ALL SELECT id, 'pre_text', 1, 'Its status is ' || s || '.' FROM {_REPORTS} b
 UNION ALL SELECT id, 'table_header', 0, 'label | quantity | amount' FROM {_REPORTS} h UNION ALL SELECT id, 'table_row', i, 'metric: ' || label || ' ; quantity: ' || q || ' ; amount: ' || p FROM {_ROWS} r
 UNION ALL SELECT id, 'post_text', 0, 'The total price is ' || total || ' dollars.' FROM {_REPORTS} p)"""
_Q = QUESTION.format(string="VARCHAR")


@query(f"SELECT sample_id, chunk_type, chunk_index, text FROM {_CHUNKS} c")
def report_chunks(spark, d) -> DataFrame:
    return B.report_chunks(reports(spark, d))


def _marked(spark, d) -> DataFrame:
    """Reports with the list of their chunks, gold ones marked."""
    r = reports(spark, d)
    return r.withColumn("chunks", B.chunk_list(r)).withColumn("chunks", B.marked(F.col("chunks"), F.col("gold"), "chunk_index"))


def _labelled(spark, d) -> DataFrame:
    return I.rows_of(_marked(spark, d), F.col("chunks"), F.col("id").alias("sample_id"))


_GOLD_CHUNKS = f"(SELECT sample_id, chunk_type, chunk_index, text, chunk_index = 2 OR (chunk_type = 'pre_text' AND chunk_index = 1) AS is_gold FROM {_CHUNKS} c)"


@query(f"SELECT sample_id, chunk_type, chunk_index, is_gold FROM {_GOLD_CHUNKS} g")
def chunk_gold(spark, d) -> DataFrame:
    return _labelled(spark, d).select("sample_id", "chunk_type", "chunk_index", "is_gold")


@query(f"SELECT chunk_type, CAST(sum(c) AS BIGINT) AS chunks, count(*) AS samples, CAST(sum(g) AS BIGINT) AS gold_chunks, round(avg(CAST(g > 0 AS INT)), 9) AS gold_share FROM (SELECT chunk_type, sample_id, count(*) AS c, count(*) FILTER (is_gold) AS g FROM {_GOLD_CHUNKS} x GROUP BY 1, 2) y GROUP BY 1")
def corpus_summary(spark, d) -> DataFrame:
    return B.corpus_summary(_labelled(spark, d))


_TOKENS = "list_distinct(regexp_extract_all(lower({0}), '[a-z]+|\\d+(?:\\.\\d+)?|[%$]'))"
_PRIMARY = f"""(SELECT * FROM (SELECT query_id, sample_id, chunk_type, chunk_index, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_type || ':' || chunk_index) AS rank FROM (SELECT sample_id AS query_id, sample_id, chunk_type, chunk_index,
 round(len(list_intersect(q, t))::DOUBLE / len(q) + 0.7 * coalesce(len([x FOR x IN list_intersect(q, t) IF regexp_matches(x, '[0-9]')])::DOUBLE / nullif(len([x FOR x IN q IF regexp_matches(x, '[0-9]')]), 0), 0.0) + CASE chunk_type WHEN 'table_row' THEN 0.08 WHEN 'table_header' THEN 0.03 ELSE 0.0 END, 6) AS score
 FROM (SELECT sample_id, chunk_type, chunk_index, {_TOKENS.format('question')} AS q, {_TOKENS.format('text')} AS t FROM {_CHUNKS} c JOIN (SELECT id, {_Q} AS question FROM {_REPORTS} r) q ON q.id = c.sample_id) z) y) w WHERE rank <= 5)"""


def _primary(spark, d) -> DataFrame:
    """Reports with their chunks, and the five best of them by the lexical score."""
    r = reports(spark, d)
    r = r.withColumn("chunks", B.chunk_list(r))
    return r.withColumn("best", I.lexical_best(F.col("chunks"), F.col("question"), 5))


def _evidence(best: str, cap: int = 18):
    return I.evidence(F.col(best), F.col("chunks"), B.context_of_chunk, cap)


def _prompts(r: DataFrame, evidence) -> DataFrame:
    r = r.withColumn("evidence", evidence)
    return B.prompts(r.withColumns({"context": I.assembled(F.col("evidence")), "n_chunks": F.size("evidence")}), ASK)


def _duck_expanded(primary: str, cap: int = 18) -> str:
    return f"""(WITH p AS (SELECT query_id, sample_id, chunk_type AS t, chunk_index AS i, rank FROM {primary} x0), d AS (SELECT unnest([-1, 0, 1]) AS d), x AS (
 SELECT query_id, sample_id, rank, 0 AS ord, t, i, 'retrieved' AS reason FROM p UNION ALL SELECT query_id, sample_id, rank, 1, 'table_header', 0, 'table_header' FROM p WHERE t = 'table_row'
 UNION ALL SELECT query_id, sample_id, rank, 3 + d, t, i + d, CASE WHEN d = 0 THEN 'retrieved' ELSE 'neighbor_table_row' END FROM p, d WHERE t = 'table_row'
 UNION ALL SELECT query_id, sample_id, rank, j, 'table_row', j, 'header_following_row' FROM p, (SELECT unnest([1, 2]) AS j) j WHERE t = 'table_header'
 UNION ALL SELECT query_id, sample_id, rank, 2 + d, t, i + d, CASE WHEN d = 0 THEN 'retrieved' ELSE 'neighbor_text' END FROM p, d WHERE t IN ('pre_text', 'post_text')),
 f AS (SELECT query_id, sample_id, t, i, min((rank, ord, reason)) AS o FROM x GROUP BY 1, 2, 3, 4)
 SELECT * FROM (SELECT query_id, c.sample_id, chunk_type, chunk_index, text, row_number() OVER (PARTITION BY query_id ORDER BY o) AS pos, o[3] AS reason FROM f JOIN {_CHUNKS} c ON c.sample_id = f.sample_id AND c.chunk_type = t AND c.chunk_index = i) e WHERE pos <= {cap})"""


@query(f"SELECT query_id, chunk_type, chunk_index, pos, reason FROM {_duck_expanded(_PRIMARY)} e")
def evidence_expand(spark, d) -> DataFrame:
    return I.rows_of(_primary(spark, d), _evidence("best"), F.col("id").alias("query_id")).select("query_id", "chunk_type", "chunk_index", "pos", "reason")


ASK = "Write a program and the answer from the evidence."


def _duck_prompts(evidence: str) -> str:
    return f"""SELECT id, '{ASK}' || chr(10) || chr(10) || 'Evidence:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question:' || chr(10) || {_Q} AS prompt, total AS answer, coalesce(n, 0) AS n_chunks
FROM {_REPORTS} r LEFT JOIN (SELECT query_id, string_agg('[' || pos || '] (' || chunk_type || ') ' || text, chr(10) ORDER BY pos) AS context, count(*) AS n FROM {evidence} e GROUP BY query_id) c ON c.query_id = r.id"""


@query(_duck_prompts(f"(SELECT p.query_id, p.rank AS pos, p.chunk_type, c.text FROM {_PRIMARY} p JOIN {_CHUNKS} c USING (sample_id, chunk_type, chunk_index))"))
def generation_topk(spark, d) -> DataFrame:
    return _prompts(_primary(spark, d), F.transform("best", lambda c: c.withField("pos", c["rank"])))


@query(_duck_prompts(_duck_expanded(_PRIMARY)))
def generation_expanded(spark, d) -> DataFrame:
    return _prompts(_primary(spark, d), _evidence("best"))


@query(_duck_prompts(_duck_expanded(f"(SELECT sample_id AS query_id, sample_id, chunk_type, chunk_index, row_number() OVER (PARTITION BY sample_id ORDER BY chunk_type, chunk_index) AS rank FROM {_GOLD_CHUNKS} g WHERE is_gold)", 40)))
def generation_gold(spark, d) -> DataFrame:
    """Evidence from the gold chunks alone, with their neighbours."""
    own = F.array_sort(F.transform(F.filter("chunks", lambda c: c["is_gold"]), lambda c: F.struct(c["chunk_type"], c["chunk_index"])))
    gold = F.transform(own, lambda c, i: F.struct(c["chunk_type"].alias("chunk_type"), c["chunk_index"].alias("chunk_index"), (i + 1).alias("rank")))
    return _prompts(_marked(spark, d).withColumn("primary", gold), _evidence("primary", 40))


_CONTEXT = "'Order ' || id || ' was placed by customer ' || c || '.' || chr(10) || 'Its status is ' || s || '.' || chr(10) || chr(10) || '| label | quantity | amount |' || chr(10) || '| --- | --- | --- |' || chr(10) || body || chr(10) || chr(10) || 'The total price is ' || total || ' dollars.'"
_JSON = """'{"program":"add(' || total || ', 0)","answer":"' || total || '"}'"""


@query(f"SELECT id, 'system' AS role, 'Be exact.' AS content FROM {_REPORTS} r UNION ALL SELECT id, 'user', 'Financial context:' || chr(10) || {_CONTEXT} || chr(10) || chr(10) || 'Question:' || chr(10) || {_Q} FROM {_REPORTS} r UNION ALL SELECT id, 'assistant', {_JSON} FROM {_REPORTS} r")
def report_chat(spark, d) -> DataFrame:
    return B.chat_from_reports(reports(spark, d), "Be exact.").select("id", F.inline("messages"))


_TRACE = [("system", "'Call the calculator.'"), ("user", f"{_CONTEXT} || chr(10) || chr(10) || 'Question:' || chr(10) || {_Q}"), ("assistant", """'{"action":"tool_call","tool_call":{"name":"calculator","arguments":{"program":"add(' || total || ', 0)"}}}'"""), ("user", """'Tool observation from calculator:' || chr(10) || '{"ok":true,"result":"' || total || '"}'"""), ("assistant", """'{"action":"final","answer":"' || total || '"}'""")]


@query(" UNION ALL ".join(f"SELECT id, {i} AS turn, '{role}' AS role, {text} AS content FROM {_REPORTS} r{i}" for i, (role, text) in enumerate(_TRACE)))
def report_traces(spark, d) -> DataFrame:
    r = reports(spark, d)
    chats = B.chat_from_reports(r, "Be exact.").join(r.select("id", "answer", "program"), "id")
    return B.report_traces(chats, "Call the calculator.").select("id", F.posexplode("messages").alias("turn", "m")).select("id", "turn", "m.role", "m.content")


@query(f"SELECT id, {_Q} AS question, total AS answer FROM {_REPORTS} r ORDER BY md5(concat('42:', CAST(id AS VARCHAR))), id LIMIT 1000")
def prompt_sample(spark, d) -> DataFrame:
    """A thousand prompts: the size that the job asks for."""
    return B.sampled_prompts(reports(spark, d).select("id", "question", "answer"), 1000, 42)


_TOK = "regexp_extract_all(lower({0}), '[a-z]+|\\d+(?:\\.\\d+)?|[%$]')"


@query(f"""WITH c AS (SELECT sample_id, chunk_type || ':' || chunk_index AS chunk_id, is_gold, text, {_TOK.format('text')} AS t FROM {_GOLD_CHUNKS} x), st AS (SELECT sample_id, count(*) AS n, avg(len(t)) AS avgdl FROM c GROUP BY 1),
tf AS (SELECT sample_id, chunk_id, term, count(*) AS tf FROM (SELECT sample_id, chunk_id, unnest(t) AS term FROM c) x GROUP BY 1, 2, 3), i0 AS (SELECT sample_id, term, n, avgdl, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf JOIN st USING (sample_id) GROUP BY sample_id, term, n, avgdl),
i AS (SELECT *, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY sample_id) ELSE raw END AS idf FROM i0), q0 AS (SELECT id, {_Q} AS question FROM {_REPORTS} r), q AS (SELECT id, term, count(*) AS qtf FROM (SELECT id, unnest({_TOK.format('question')}) AS term FROM q0) x GROUP BY 1, 2),
s AS (SELECT q.id, tf.chunk_id, sum(qtf * idf * tf.tf * 2.5 / (tf.tf + 1.5 * (1 - 0.75 + 0.75 * len(c.t) / avgdl))) AS s FROM q JOIN i ON q.id = i.sample_id AND q.term = i.term JOIN tf ON tf.sample_id = i.sample_id AND tf.term = i.term JOIN c ON c.sample_id = tf.sample_id AND c.chunk_id = tf.chunk_id GROUP BY 1, 2),
b AS (SELECT * FROM (SELECT c.sample_id, c.chunk_id, c.is_gold, c.text, round(coalesce(s.s, 0.0), 6) AS score, row_number() OVER (PARTITION BY c.sample_id ORDER BY round(coalesce(s.s, 0.0), 6) DESC, c.chunk_id) AS r FROM c LEFT JOIN s ON s.id = c.sample_id AND s.chunk_id = c.chunk_id) y WHERE r <= 40),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY fused DESC, chunk_id) AS rank FROM (SELECT b.sample_id, chunk_id, is_gold, len(string_split(text, ' ')) AS words, round(len(list_intersect(list_distinct({_TOK.format('question')}), list_distinct({_TOK.format('text')})))::DOUBLE / greatest(len(list_distinct({_TOK.format('question')})), 1) + 0.05 * score, 6) AS fused FROM b JOIN q0 ON q0.id = b.sample_id) z) y WHERE rank <= 15),
p AS (SELECT sample_id, min(rank) FILTER (is_gold) AS first, sum(words) FILTER (rank <= 8) AS used FROM f GROUP BY 1), g AS (SELECT sample_id, bool_or(is_gold) AS has, count(*) AS n FROM c GROUP BY 1)
SELECT count(*) AS num_samples, count(*) FILTER (has) AS gold_available, round(avg(n), 9) AS avg_chunks, round(avg(used), 9) AS avg_context_words, {", ".join(f"round(count(*) FILTER (has AND first <= {k}) / count(*) FILTER (has), 9) AS recall_at_{k}" for k in (1, 3, 5, 8, 15))} FROM p JOIN g USING (sample_id)""")  # fmt: skip
def report_retrieval(spark, d) -> DataFrame:
    """From report to recall: chunks, BM25, the fused rerank, eight chunks within 700 words."""

    def found(chunks, question, gold):
        (chunk, of), (own, whose), rows = L.flat(chunks), L.flat(gold), len(question)
        kind, index, text = chunk.flatten()
        text, ids = L.strings(text), L.id_order(pa.compute.binary_join_element_wise(kind, index.cast(pa.string()), ":"))
        (words, chunk), (asked, by) = L.tokens(text), L.tokens(L.strings(question))
        words, asked = L.numbered(words, asked)
        scores, share = L.bm25_scores(words, chunk, of, asked, by, rows)
        first = np.sort(L.best(scores, ids, of, 40)[0])
        places, rank = L.fused_best(share[first], scores[first], ids[first], of[first], 15)
        return L.recalled(text, L.gold_flags(text, L.integers(index), of, L.strings(own), whose), of, first[places], rank, rows)

    r = reports(spark, d)
    return _recall(L.in_batches(r.select(B.chunk_list(r).alias("chunks"), "question", "gold"), found, RECALLED), 9)


RECALLED = "n int, some boolean, first int, used long"


def _recall(per: DataFrame, digits: int) -> DataFrame:
    """reports as lists.recalled() has them -> one row: how often and where gold is found, and the words of eight chunks within 700."""
    return per.agg(F.count("*").alias("num_samples"), F.count_if("some").alias("gold_available"), F.round(F.avg("n"), digits).alias("avg_chunks"), F.round(F.avg("used"), digits).alias("avg_context_words"), *[E.rate(F.coalesce(F.col("first") <= k, F.lit(False)), F.col("some")).alias(f"recall_at_{k}") for k in (1, 3, 5, 8, 15)])


# --- ladders, controllers and pairs -------------------------------------------------------------------------------------


def _laddered(spark, d) -> DataFrame:
    rows = E.parsed(X.qa(spark, d)).withColumn("question", F.expr(QUESTION.format(string="STRING")))
    return B.ladder(rows.withColumn("gold_program", F.format_string("subtract(%d, %d), divide(#0, %d)", "a", "b", "b")))


_DIFF = "CAST(a - b AS DOUBLE)"
_RIGHT = f"(({EXACT}) OR (k <> 4 AND {_close('x', 'g', 0.05)}) OR (k = 4 AND {_close('x', 'g', 0.05)}))"
_LADDER = f"""(SELECT id, a, b, k, g, gold, raw_output, CASE id % 4 WHEN 0 THEN 'percent_rate' WHEN 1 THEN 'sum_total' WHEN 2 THEN 'average' ELSE 'difference' END AS category,
 CASE WHEN NOT {_RIGHT} THEN CASE WHEN k = 4 THEN 'wrong_skip_invalid_json' WHEN {_close('x', 'g', 0.10)} THEN 'wrong_skip_near_miss' WHEN {_close('x * 100', 'g', 0.08)} THEN 'wrong_skip_decimal_percent_equiv' ELSE 'wrong_keep' END
 WHEN id % 4 = 0 AND {_DIFF} <> g AND NOT {_close(_DIFF, 'g', 0.05)} THEN 'synthetic_keep' ELSE 'right_skip' END AS decision FROM {FACTS} f0)"""


@query(f"SELECT category, decision, count(*) AS n FROM {_LADDER} l GROUP BY 1, 2")
def filter_ladder(spark, d) -> DataFrame:
    return _laddered(spark, d).groupBy("category", "decision").agg(F.count("*").alias("n"))


_PAIRS = f"""(SELECT id, category, decision, '{{"program":"subtract(' || a || ', ' || b || '), divide(#0, ' || b || ')","answer":"' || gold || '"}}' AS chosen,
 CASE WHEN decision = 'wrong_keep' THEN raw_output ELSE '{{"program": "subtract(' || a || ', ' || b || ')", "answer": "' || (a - b) || '"}}' END AS rejected FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id) AS r FROM {_LADDER} l WHERE decision LIKE '%keep') k WHERE r <= 180)"""


@query(f"SELECT * FROM {_PAIRS} p")
def balanced_pairs(spark, d) -> DataFrame:
    """A hundred and eighty pairs a category, as the mixture asks."""
    return B.balanced_pairs(_laddered(spark, d))


@query(f"SELECT count(*) AS pairs, count(*) FILTER (category = 'percent_rate' OR contains(chosen, '%')) AS percent_like, count(*) FILTER (contains(chosen, '%')) AS chosen_percent, count(*) FILTER (starts_with(rejected, '{{')) AS rejected_json, count(*) FILTER (NOT starts_with(rejected, '{{')) AS rejected_invalid FROM {_PAIRS} p")
def pair_profile(spark, d) -> DataFrame:
    return B.pair_profile(B.balanced_pairs(_laddered(spark, d)).withColumn("prompt", F.col("category")))


def _turns(extra: str = "") -> str:
    return f"SELECT count(*) AS num_samples, {_rate('k <> 4')} AS tool_json_valid_rate, {_rate('k <> 4 AND id % 11 <> 0')} AS calculator_call_rate, {_rate('k NOT IN (4,5)')} AS program_nonempty_rate, {_rate('w IS NOT NULL')} AS program_executable_rate, {_rate(_scaled('w', 'false', GOLDS, 0.01))} AS scaled_execution_acc_at_1pct, {_rate(_scaled('w', 'false', GOLDS, 0.05))} AS scaled_execution_acc_at_5pct{extra} FROM {FACTS} f0"


@query(_turns())
def candidate_eval(spark, d) -> DataFrame:
    return E.candidate_metrics(X.tool(spark, d))


@query(_turns(f", {_rate('k <> 4')} AS final_action_valid_rate, {_rate('k <> 4 AND ' + _scaled('x', 'pct', GOLDS, 0.01))} AS scaled_final_acc_at_1pct, {_rate('k <> 4 AND ' + _scaled('x', 'pct', GOLDS, 0.05))} AS scaled_final_acc_at_5pct"))
def controller_eval(spark, d) -> DataFrame:
    final = F.when(F.col("k") == 4, "no idea").otherwise(F.concat(F.lit('{"action": "final", "answer": "'), F.col("said"), F.lit('"}')))
    said = F.regexp_extract("raw_output", '"answer": "([^"]*)"', 1)
    return E.controller_metrics(X.tool(spark, d).withColumn("said", said).withColumn("raw_final", final))


@query(f"SELECT id, ok, CASE WHEN ok THEN round(w / 1e9, 15) END AS billion, CASE WHEN ok THEN round(abs(w) / 1e9, 15) END AS abs_billion FROM (SELECT id, w, w IS NOT NULL AS ok FROM {FACTS} f0) t")
def calculator_observation(spark, d) -> DataFrame:
    got = A.calculator_observation(execute_programs(E.parsed(X.qa(spark, d)), "program", "run", "lenient"))
    return got.select("id", "ok", F.round("billion", 15).alias("billion"), F.round("abs_billion", 15).alias("abs_billion"))


@query(f"SELECT unnest(['question_percent','decimal_percent','difference_not_ratio','scale_large','blank']) AS flag, unnest([count(*) FILTER (id % 4 = 0), count(*) FILTER ({_close('x * 100', 'g', 0.08)}), count(*) FILTER (id % 4 = 0 AND k IN (0,1,2,3)), count(*) FILTER (abs(g) > 1e6 AND abs(x / g) < 0.2), 0]) AS n FROM {FACTS} f0 WHERE NOT {_close('x', 'g', 0.05)}")
def failure_flags(spark, d) -> DataFrame:
    from ..functions import numeric as N

    rows = E.parsed(X.qa(spark, d)).withColumn("question", F.expr(QUESTION.format(string="STRING")))
    lost = rows.where(~N.numeric_match(F.col("answer"), F.col("gold"), 0.05))
    return E.failure_flags(lost.select("question", "gold", F.col("answer").alias("pred"), F.col("program").alias("pred_program")))


# --- traces and splits ----------------------------------------------------------------------------------------------------

_FIRST_LAST = "(SELECT min(event_type) AS a, max(event_type) AS z FROM events)"


@query(f"SELECT user_id AS task, string_agg(event_type, ',' ORDER BY ts, event_id) AS called, bool_or(event_type = a) AND bool_or(event_type = z) AS hit FROM events, {_FIRST_LAST} f GROUP BY user_id")
def expected_tools(spark, d) -> DataFrame:
    trace = X.trace(spark, d).select(F.col("trace_id").alias("task"), "step", F.col("gold_tool").alias("tool"))
    wanted = trace.agg(F.array(F.min("tool"), F.max("tool")).alias("tools"))  # one row
    return E.expected_tools(trace, trace.select("task").distinct().crossJoin(wanted))


_PATHS = """(WITH p AS (SELECT user_id AS trace_id, event_type AS tool, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT trace_id, CAST(2 * step - 2 AS INT) AS turn, 'assistant' AS role, '{"action":"tool_call","tool_call":{"name":"' || tool || '"}}' AS content FROM p UNION ALL SELECT trace_id, CAST(2 * step - 1 AS INT), 'user', '{"ok":true,"selected_tool":"' || tool || '","step":' || step || ',"remaining_steps":' || (n - step) || '}' FROM p
UNION ALL SELECT trace_id, CAST(2 * max(n) AS INT), 'assistant', '{"action":"final","answer":"Completed tool plan: ' || string_agg(tool, ' -> ' ORDER BY step) || '"}' FROM p GROUP BY trace_id)"""


def _path_traces(spark, d) -> DataFrame:
    return B.path_traces(X.trace(spark, d).select("trace_id", "step", F.col("gold_tool").alias("tool")))


@query(f"SELECT trace_id, turn, role, content FROM {_PATHS} p")
def path_traces(spark, d) -> DataFrame:
    return _path_traces(spark, d)


@query(f"SELECT trace_id, turn, regexp_extract(content, '\"name\":\"([^\"]*)\"', 1) AS gold_tool, turn AS prompt_turns FROM {_PATHS} p WHERE role = 'assistant' AND contains(content, 'tool_call')")
def turn_prompts(spark, d) -> DataFrame:
    return B.turn_prompts(_path_traces(spark, d))


@query("SELECT doc_id AS id, source, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY md5(concat('42:', CAST(doc_id AS VARCHAR))), doc_id) <= 100 THEN 'dev' ELSE 'train' END AS split FROM documents")
def source_split(spark, d) -> DataFrame:
    return B.source_split(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"), 100, 42)


@query("SELECT count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS paired, count(*) FILTER (l.doc_id IS NULL) AS only_left, count(*) FILTER (d.doc_id IS NULL) AS only_right FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def zip_report(spark, d) -> DataFrame:
    one = lambda name: table(spark, d, name).select(F.col("doc_id").alias("id"))
    return B.zipped(one("documents"), one("labels"))[1]


WANTED = [(5, 1, 1), (10, 1, 2), (30, 0, 0)]


@query(f"SELECT w.place, w.k, w.before, w.after, any_recall, coverage, num_queries IS NULL AS missing FROM (VALUES {', '.join(str((i, *x)) for i, x in enumerate(WANTED))}) w(place, k, before, after) LEFT JOIN ({ORACLE_SQL['evidence_grid']}) g USING (k, before, after)")
def selected_settings(spark, d) -> DataFrame:
    return E.selected_settings(evidence_grid(spark, d), WANTED)


# --- rerankers ------------------------------------------------------------------------------------------------------------


@query(f"SELECT * FROM (SELECT query_id, chunk_id, b.score, row_number() OVER (PARTITION BY query_id ORDER BY b.score DESC, chunk_id) AS rank FROM {_duck_lists(32)} a JOIN {_duck_lists(64)} b USING (query_id, chunk_id)) t WHERE rank <= 10")
def model_rerank(spark, d) -> DataFrame:
    """The list of half the dimensions in the order of the whole vectors' scores."""
    return R.model_rerank(_lists(spark, d, 32), _lists(spark, d, 64))


@query(f"SELECT * FROM (SELECT query_id, chunk_id, score, reranker, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(coalesce(b.score + 0.05 * a.score, a.score), 6) AS score, CASE WHEN b.score IS NULL THEN 'lexical' ELSE 'model' END AS reranker FROM {_duck_lists(32)} a LEFT JOIN {_duck_lists(64)} b USING (query_id, chunk_id)) s) t WHERE rank <= 10")
def web_model_rerank(spark, d) -> DataFrame:
    return R.web_model_rerank(_lists(spark, d, 32), _lists(spark, d, 64))


_SNIPPETS = f"(SELECT page_id // 10 AS query_id, page_id AS chunk_id, 'Official ' || b.text AS query, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, x.text AS body, url AS href, page_id % 10 AS rank FROM pages JOIN ({ORACLE_SQL['html_strip']}) x USING (page_id) JOIN benchmark b ON b.item_id = (page_id // 10) % (SELECT count(*) FROM benchmark))"
# The words that the ranking leaves out.
_STOPPED = ", ".join(f"'{w}'" for w in "a an and are as be by for from in is it of on or that the then to use what with look up summarize official".split())
_ALL = "[t FOR t IN regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9][a-z0-9_+-]*') IF length(t) > 1 AND t NOT IN (" + _STOPPED.replace("{", "{{") + ")]"
_WORDS = f"list_distinct({_ALL})"


def _snippets(spark, d) -> DataFrame:
    """Pages as results, ten a query; queries are the benchmark's items in turn."""
    items = table(spark, d, "benchmark").select("item_id", F.concat(F.lit("Official "), "text").alias("query"))
    n = items.count()
    part = lambda tag: F.regexp_extract("html", f"<{tag}>([^<]*)</{tag}>", 1)
    pages = table(spark, d, "pages").withColumn("query_id", F.floor(F.col("page_id") / 10))
    return pages.join(items, F.col("query_id") % n == F.col("item_id")).select("query_id", F.col("page_id").alias("chunk_id"), "query", part("title").alias("title"), T.strip_tags(F.col("html")).alias("body"), F.col("url").alias("href"), (F.col("page_id") % 10).alias("rank"))


@query(f"""SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r, chunk_id) AS rank FROM (SELECT query_id, chunk_id, rank AS r, round(3.0 * len(list_intersect({_WORDS.format('query')}, {_WORDS.format('title')})) + len(list_intersect({_WORDS.format('query')}, {_WORDS.format('body')})) + 0.6 * len(list_intersect({_WORDS.format('query')}, {_WORDS.format('href')}))
 + CASE WHEN contains(lower(concat_ws(' ', title, body, href)), trim(lower(query))) THEN 4.0 ELSE 0.0 END + CASE WHEN regexp_matches(lower(href), '\\.com|\\.org|docs\\.') THEN 0.5 ELSE 0.0 END, 4)::DOUBLE AS score FROM {_SNIPPETS} s) t""")
def snippet_rerank(spark, d) -> DataFrame:
    """Ten results a query, all kept."""
    return R.snippet_rerank(_snippets(spark, d))


@query(f"""SELECT query_id, chunk_id, (list_sum([CASE WHEN host = t || '.com' OR host = t || '.org' OR starts_with(host, t || '.') THEN 6.0 WHEN contains(host, t) AND NOT contains(host, 'doc') THEN 2.0 ELSE 0.0 END FOR t IN {_ALL.format('query')} IF t NOT IN ('framework', 'documentation')]) + CASE WHEN contains(lower(title), 'official') OR contains(lower(href), 'official') THEN 1.0 ELSE 0.0 END)::DOUBLE AS prior
FROM (SELECT *, replace(regexp_extract(lower(href), 'https?://([^/]+)', 1), 'www.', '') AS host FROM {_SNIPPETS} s) h""")
def source_prior(spark, d) -> DataFrame:
    return R.source_prior(_snippets(spark, d))


# --- fields in text ---------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, 'get(' || o_custkey || ')' AS call, o_orderstatus AS domain FROM orders")
def tagged_fields(spark, d) -> DataFrame:
    said = F.format_string("<<<domain>>>: %s\n<<<api_call>>>: get(%d)\n<<<explanation>>>: none", "o_orderstatus", "o_custkey")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), A.tagged(said, "api_call").alias("call"), A.tagged(said, "domain").alias("domain"))


@query("SELECT o_orderkey AS id, least(x, 1000)::DOUBLE AS x, least(y, 1000)::DOUBLE AS y, x > 1000 OR y > 1000 AS out_of_range FROM (SELECT o_orderkey, (o_custkey % 1200) AS x, (o_orderkey % 1100) AS y FROM orders) t")
def coordinates(spark, d) -> DataFrame:
    said = F.format_string("click (%d, %d) now", F.col("o_custkey") % 1200, F.col("o_orderkey") % 1100)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), A.coordinates(said).alias("c")).select("id", "c.*")


@query("SELECT o_orderkey AS id, '{\"a\":' || o_custkey || ',\"b\":\"' || o_orderstatus || '\"}' AS args FROM orders")
def canonical_args(spark, d) -> DataFrame:
    said = F.format_string('{"b": "%s",  "a": %d}', "o_orderstatus", "o_custkey")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), A.canonical_args(said).alias("args"))


# --- overrides, examples, recorded calls ------------------------------------------------------------------------------------

#: In hundredths, ties broken alike on both sides; the reader of numbers takes no exponent, so of what is below 1e-4 it sees the digits.
_SHOWN = "CAST(floor((CASE WHEN v IS NULL THEN x WHEN u <> 0 AND abs(u) < 1e-4 THEN round(u / power(10.0, floor(log10(abs(u)))), 9) WHEN u = 0 OR (abs(u) >= 1000 AND abs(u - round(u)) < 1e-6) THEN round(u) ELSE round(u * power(10.0, 9 - floor(log10(abs(u))))) / power(10.0, 9 - floor(log10(abs(u)))) END) * 100 + 0.500001) AS BIGINT)"


def _override(spark, d, scale: str) -> DataFrame:
    from ..functions import numeric as N

    return E.answer_override(X.qa(spark, d), scale).select("id", "overridden", F.floor(N.extract_num(F.col("answer")) * 100 + 0.500001).alias("cents"), F.col("answer").endswith("%").alias("percent"))


@query(f"SELECT id, v IS NOT NULL AS overridden, {_SHOWN} AS cents, CASE WHEN v IS NULL THEN pct ELSE false END AS percent FROM (SELECT *, v AS u FROM {FACTS}) y")
def answer_override_plain(spark, d) -> DataFrame:
    return _override(spark, d, "plain")


@query(f"SELECT id, v IS NOT NULL AS overridden, {_SHOWN} AS cents, pct AS percent FROM (SELECT *, CASE WHEN v IS NOT NULL THEN list_sort([{{'e': abs(s*v - x) / greatest(abs(x), 1e-6), 'm': abs(s*v), 'v': s*v}} FOR s IN {SCALES}])[1].v END AS u FROM {FACTS}) y")
def answer_override_like(spark, d) -> DataFrame:
    return _override(spark, d, "answer")


@query(f"SELECT id, status FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY id) AS r FROM (SELECT id, {_STATUS} AS status FROM {FACTS}) s) t WHERE r <= 15")
def status_examples(spark, d) -> DataFrame:
    """Fifteen examples a class, as the report asks."""
    return E.examples(candidate_status(spark, d), "status", 15)


@query(f"SELECT symbol, metric, 'What was the yearly growth of ' || metric || ' of ' || symbol || ' from ' || a || ' to ' || z || '?' AS question, 'divide(' || l || ', ' || f || '), divide(1, ' || (z - a) || '), exp(#0, #1), subtract(#2, 1)' AS program, round(power(l / f, 1.0 / (z - a)) - 1, 6) AS answer FROM (SELECT symbol, metric, min(period) AS a, max(period) AS z, arg_min(value, period) AS f, arg_max(value, period) AS l FROM {_YEARS.replace('sum(o_totalprice)', 'sum(CAST(o_totalprice AS DECIMAL(18,2)))')} y GROUP BY 1, 2) t WHERE z > a AND f > 0")
def cagr_traces(spark, d) -> DataFrame:
    return A.cagr_traces(_facts(spark, d))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) t WHERE r = 1")
def last_wins(spark, d) -> DataFrame:
    return D.last_wins(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


_CALLS = "(SELECT event_id AS id, user_id AS conv_id, event_id AS turn, event_type AS tool, '{\"d\":' || (event_id % 5) || '}' AS args, event_type || '/' || event_id AS text FROM events)"


@query(f"""WITH m AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS seen FROM {_CALLS} c), o AS (SELECT tool, args, arg_max(seen, (conv_id, turn)) AS observation FROM m WHERE seen IS NOT NULL GROUP BY 1, 2), k AS (SELECT DISTINCT tool FROM o),
q AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'none' ELSE tool END AS tool, '{{"d":' || (id % 7) || '}}' AS args FROM {_CALLS} c)
SELECT q.id, o.observation, CASE WHEN k.tool IS NULL THEN 'unknown tool ' || q.tool WHEN o.observation IS NULL THEN 'no recorded observation' END AS error FROM q LEFT JOIN o ON o.tool = q.tool AND o.args = q.args LEFT JOIN k ON k.tool = q.tool""")
def observation_replay(spark, d) -> DataFrame:
    """Calls answered from the observations that recorded traces hold."""
    e = table(spark, d, "events")
    args = lambda n: F.format_string('{"d": %d}', F.col("event_id") % n)
    said = e.select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.col("event_type").alias("tool"), args(5).alias("args"), F.concat_ws("/", "event_type", "event_id").alias("text"))
    calls = e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 11 == 0, "none").otherwise(F.col("event_type")).alias("tool"), args(7).alias("args"))
    return A.replay_calls(calls, A.observation_cache(said)).select("id", "observation", "error")


@query("""WITH q AS (SELECT c_custkey AS query_id, 'facts about ' || n_name AS query FROM customer JOIN nation ON c_nationkey = n_nationkey), r AS (SELECT o_custkey AS query_id, 'order/' || o_orderkey AS url, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders),
f AS (SELECT query_id, 'nation/' || n_nationkey AS url FROM q JOIN nation ON contains(lower(query), lower(n_name))), u AS (SELECT query_id, url, 0 AS late, 0 AS rank FROM f UNION ALL SELECT query_id, url, 1, rank FROM r)
SELECT query_id, url, row_number() OVER (PARTITION BY query_id ORDER BY late, rank, url) AS rank, late = 0 AS curated FROM u""")
def alias_injection(spark, d) -> DataFrame:
    """Pages of a nation go ahead of a customer's orders."""
    from pyspark.sql import Window

    n = table(spark, d, "nation")
    q = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("facts about "), "n_name").alias("query"))
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("url"), rank.alias("rank"))
    return R.alias_injection(q, r, n.select(F.col("n_name").alias("alias"), F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("url")))
