"""All registered queries of the library proper, and DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..functions.infix import infix_value
from ..functions.programs import bound
from ..operators import agents as A
from ..operators import datasets as D
from ..operators import evaluate as E
from ..operators import retrieval as R
from ..operators import rewards as W
from ..sources import io as S
from ..sources.interim import written
from . import fixtures as X

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
table = X.table


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- SQL building blocks for the arithmetic oracles ---------------------------------------------------------------------

SCALES = "[1.0::DOUBLE,100.0,0.01,1000.0,0.001,1000000.0,0.000001]"


def _close(x: str, g: str, t: float) -> str:
    return f"coalesce(abs(({x}) - ({g})) / greatest(abs({g}), 1e-6) <= {t}, false)"


def _scaled(x: str, pct: str, golds: list[str], t: float) -> str:
    one = " OR ".join(_close("v", g, t) for g in golds)
    return f"(CASE WHEN ({x}) IS NULL THEN false ELSE len([v FOR v IN list_concat([s * ({x}) FOR s IN {SCALES}], CASE WHEN {pct} THEN [({x}) / 100.0] ELSE [] END) IF {one}]) > 0 END)"


def _rate(hit: str, of: str = "true") -> str:
    return f"round(count(*) FILTER (({hit}) AND ({of})) / nullif(count(*) FILTER ({of}), 0), 9)"


#: x: number of the answer, pct: it has a percent sign, g: number of gold, v: strict value, w: lenient value.
FACTS = f"""(SELECT *, CASE WHEN v IS NOT NULL AND abs(v) < 1e-4 AND v <> 0 THEN v / power(10, floor(log10(abs(v)))) ELSE v END AS pv FROM (
 SELECT id, a, b, k, gold, raw_output, CAST(round(100.0*(a-b)/b) AS BIGINT)::DOUBLE AS g,
  CASE WHEN k = 1 THEN CAST(round(1.0*(a-b)/b) AS BIGINT) WHEN k = 2 THEN -CAST(round(100.0*(a-b)/b) AS BIGINT) WHEN k = 3 THEN 10*CAST(round(100.0*(a-b)/b) AS BIGINT) WHEN k = 4 THEN a ELSE CAST(round(100.0*(a-b)/b) AS BIGINT) END::DOUBLE AS x,
  k IN (0,5,6,7) AS pct,
  CASE WHEN k IN (0,1,3) THEN (a-b)::DOUBLE / b WHEN k = 2 THEN (b-a)::DOUBLE / b END AS v,
  CASE WHEN k IN (0,1,3) THEN (a-b)::DOUBLE / b WHEN k = 2 THEN (b-a)::DOUBLE / b WHEN k = 7 THEN a::DOUBLE / b END AS w
 FROM {X.duck_qa()} q) f)"""
GOLDS = ["g", "(g / 100.0)"]
EXACT = "CASE WHEN k = 4 THEN false ELSE x = g END"
_S5 = _scaled("x", "pct", GOLDS, 0.05)


@query(
    "SELECT count(*) AS num_samples, "
    + _rate("k <> 4") + " AS json_valid_rate, " + _rate("true") + " AS answer_nonempty_rate, " + _rate("k NOT IN (4,5)") + " AS program_nonempty_rate, " + _rate(EXACT) + " AS answer_exact_match, count(*) AS numeric_total, "
    + ", ".join(_rate(_close("x", "g", t)) + f" AS numeric_accuracy_at_{n}pct" for n, t in ((1, 0.01), (5, 0.05))) + ", "
    + ", ".join(_rate(_scaled("x", "pct", GOLDS, t)) + f" AS scaled_numeric_accuracy_at_{n}pct" for n, t in ((1, 0.01), (5, 0.05)))
    + ", count(*) FILTER (k NOT IN (4,5)) AS program_total, " + _rate("v IS NOT NULL", "k NOT IN (4,5)") + " AS program_executable_rate, "
    + ", ".join(_rate(_close("pv", "g", t), "v IS NOT NULL") + f" AS execution_accuracy_at_{n}pct" for n, t in ((1, 0.01), (5, 0.05))) + ", "
    + ", ".join(_rate(_scaled("v", "false", GOLDS, t), "v IS NOT NULL") + f" AS scaled_execution_accuracy_at_{n}pct" for n, t in ((1, 0.01), (5, 0.05))) + ", "
    + ", ".join(_rate(_scaled("x", "pct", ["pv"], t), "v IS NOT NULL") + f" AS answer_exec_consistency_at_{n}pct" for n, t in ((1, 0.01), (5, 0.05)))
    + f", count(*) FILTER (v IS NOT NULL AND {_S5} AND NOT {_scaled('v', 'false', GOLDS, 0.05)}) AS answer_right_exec_wrong_scaled5, count(*) FILTER (v IS NOT NULL AND {_scaled('v', 'false', GOLDS, 0.05)} AND NOT {_S5}) AS exec_right_answer_wrong_scaled5 FROM {FACTS}"
)
def numeric_qa_exec_eval(spark, d) -> DataFrame:
    return E.answer_exec_metrics(X.qa(spark, d))


@query(f"SELECT count(*) AS num_samples, {_rate('k <> 4')} AS json_valid_rate, {_rate(EXACT)} AS answer_exact_match, count(*) AS numeric_total, {_rate(_close('x', 'g', 0.01))} AS numeric_accuracy_at_1pct, {_rate(_close('x', 'g', 0.05))} AS numeric_accuracy_at_5pct FROM {FACTS}")
def answer_eval(spark, d) -> DataFrame:
    return E.answer_metrics(X.qa(spark, d))


@query(f"SELECT count(*) AS num_samples, {_rate('k <> 4')} AS tool_json_valid_rate, {_rate('k <> 4 AND id % 11 <> 0')} AS tool_name_accuracy, {_rate('k NOT IN (4,5)')} AS program_nonempty_rate, {_rate('w IS NOT NULL')} AS program_executable_rate, {_rate(_scaled('w', 'false', GOLDS, 0.01))} AS scaled_execution_accuracy_at_1pct, {_rate(_scaled('w', 'false', GOLDS, 0.05))} AS scaled_execution_accuracy_at_5pct FROM {FACTS}")
def toolcall_eval(spark, d) -> DataFrame:
    return E.tool_metrics(X.tool(spark, d))


@query(f"SELECT count(*) AS num_samples, {_rate('k NOT IN (4,5)')} AS program_parse_rate, {_rate('w IS NOT NULL')} AS program_executable_rate, {_rate(_scaled('w', 'false', GOLDS, 0.01))} AS scaled_at_1pct, {_rate(_scaled('w', 'false', GOLDS, 0.05))} AS scaled_at_5pct FROM {FACTS}")
def program_oracle_check(spark, d) -> DataFrame:
    return E.program_oracle(X.qa(spark, d))


@query(f"SELECT op, count(*) AS n, op <> 'table_sum' AS supported FROM (SELECT unnest(CASE WHEN k IN (0,1,2,3,7) THEN ['subtract','divide'] WHEN k = 6 THEN ['table_sum'] ELSE [] END) AS op FROM {X.duck_qa()} q) t GROUP BY op")
def op_counts(spark, d) -> DataFrame:
    return E.operator_counts(X.qa(spark, d))


@query(f"SELECT id, v IS NOT NULL AS overridden, round(CASE WHEN v IS NULL THEN x WHEN u <> 0 AND abs(u) < 1e-4 THEN round(u / power(10.0, floor(log10(abs(u)))), 9) WHEN u = 0 OR (abs(u) >= 1000 AND abs(u - round(u)) < 1e-6) THEN round(u) ELSE round(u * power(10.0, 9 - floor(log10(abs(u))))) / power(10.0, 9 - floor(log10(abs(u)))) END, 2) + 0.0 AS value FROM (SELECT *, CASE WHEN v IS NOT NULL THEN list_sort([{{'e': abs(s*v - g) / greatest(abs(g), 1e-6), 'm': abs(s*v), 'v': s*v}} FOR s IN {SCALES}])[1].v END AS u FROM {FACTS}) y")
def answer_override(spark, d) -> DataFrame:
    return E.answer_override(X.qa(spark, d)).select("id", "overridden", (F.round(N.extract_num(F.col("answer")), 2) + 0.0).alias("value"))


@query(f"SELECT id, {_scaled('x', 'pct', GOLDS, 0.01)} AS s1, {_S5} AS s5 FROM {FACTS}")
def scaled_match(spark, d) -> DataFrame:
    df = E.parsed(X.qa(spark, d))
    hit = lambda t: N.scaled_match(N.extract_num(F.col("answer")), F.col("answer"), F.col("gold"), t)
    return df.select("id", hit(0.01).alias("s1"), hit(0.05).alias("s5"))


_STATUS = f"CASE WHEN k = 4 THEN 'invalid_json' WHEN id % 11 = 0 THEN 'wrong_tool' WHEN k = 5 THEN 'empty_program' WHEN w IS NULL THEN 'not_executable' WHEN {_scaled('w', 'false', GOLDS, 0.05)} THEN 'scaled_correct' ELSE 'scaled_wrong' END"


@query(f"SELECT id, {_STATUS} AS status FROM {FACTS}")
def candidate_status(spark, d) -> DataFrame:
    return E.candidate_status(X.tool(spark, d)).select("id", "status")


@query(f"""SELECT id, round(least(greatest((CASE WHEN k <> 4 THEN 0.05 ELSE -0.20 END) + (CASE WHEN k = 4 THEN 0.0 WHEN id % 11 <> 0 THEN 0.05 ELSE -0.10 END) + (CASE WHEN k NOT IN (4,5) THEN 0.05 ELSE -0.20 END)
 + (CASE WHEN k IN (4,5) THEN 0.0 WHEN w IS NOT NULL THEN 0.30 ELSE -0.30 END) + (CASE WHEN {_scaled('w', 'false', GOLDS, 0.01)} THEN 1.0 WHEN {_scaled('w', 'false', GOLDS, 0.05)} THEN 0.5 ELSE 0.0 END)
 + (CASE WHEN abs(w) >= 1e-12 AND abs(g) >= 1e-12 AND sign(w) <> sign(g) AND NOT {_scaled('w', 'false', GOLDS, 0.05)} THEN -0.30 ELSE 0.0 END), -1.0), 1.7), 6) AS reward FROM {FACTS}""")
def reward_tool(spark, d) -> DataFrame:
    return W.tool_reward(X.tool(spark, d))


def _off(p: str, g: str) -> str:
    return "(" + " OR ".join(_close(f"({p}) * {f}", g, 0.05) for f in W.OFF) + f") AND abs({g}) >= 1e-12"


_FLIP = "abs(x) >= 1e-12 AND abs(g) >= 1e-12 AND sign(x) <> sign(g)"


@query(f"""SELECT id, round(least(greatest((CASE WHEN k <> 4 THEN 0.05 ELSE -0.25 END) + 0.05 + (CASE WHEN k NOT IN (4,5) THEN 0.05 ELSE 0.0 END) + (CASE WHEN {EXACT} THEN 0.30 ELSE 0.0 END)
 + (CASE WHEN {_close('x', 'g', 0.01)} THEN 1.0 WHEN {_close('x', 'g', 0.05)} THEN 0.6 ELSE 0.0 END)
 + (CASE WHEN k IN (4,5) THEN 0.0 WHEN v IS NULL THEN -0.40 ELSE 0.20
    + (CASE WHEN {_close('pv', 'g', 0.01)} THEN 1.10 WHEN {_close('pv', 'g', 0.05)} THEN 0.85 WHEN {_scaled('v', 'false', GOLDS, 0.01)} THEN 0.75 WHEN {_scaled('v', 'false', GOLDS, 0.05)} THEN 0.55 WHEN {_off('v', 'g')} THEN -0.25 ELSE 0.0 END)
    + (CASE WHEN {_scaled('x', 'pct', ['pv'], 0.05)} THEN 0.35 WHEN {_close('x', 'g', 0.05)} OR {_scaled('v', 'false', GOLDS, 0.05)} THEN -0.35 ELSE 0.0 END) END)
 + (CASE WHEN ({_off('x', 'g')}) AND NOT {_close('x', 'g', 0.05)} THEN -0.35 ELSE 0.0 END) + (CASE WHEN {_FLIP} THEN -0.30 ELSE 0.0 END)
 + (CASE WHEN {_close('x', 'g', 0.05)} THEN 0.10 WHEN {_close('x * 100', 'g', 0.05)} OR {_close('x / 100', 'g', 0.05)} THEN -0.45 ELSE 0.0 END), -1.0), 2.8), 6) AS reward FROM {FACTS}""")
def reward_answer(spark, d) -> DataFrame:
    return W.answer_reward(X.qa(spark, d).withColumn("question", F.lit("")))


@query(f"""SELECT k AS prompt_id, count(*) AS n, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS std, round(stddev_pop(r), 6) = 0 AS no_signal FROM (SELECT id % 8 AS k, reward AS r FROM ({ORACLE_SQL['reward_tool']}) s) t GROUP BY k""")
def reward_group_stats(spark, d) -> DataFrame:
    return W.group_spread(W.tool_reward(X.tool(spark, d)).withColumn("prompt_id", F.col("id") % 8))


@query(f"""SELECT id, round(CASE WHEN k = 4 THEN -0.45-0.10-0.25-0.20-0.15 ELSE 0.08+0.04+0.08+0.08 + CASE WHEN id % 11 <> 0 THEN 1.20 ELSE -0.15 END END, 6) AS reward
FROM (SELECT id, k, greatest(-1.0, 0) AS z FROM {X.duck_tool()} q) t WHERE k <> 4 UNION ALL SELECT id, -1.0 FROM {X.duck_tool()} q WHERE k = 4""")
def reward_route(spark, d) -> DataFrame:
    df = X.tool(spark, d).select("id", F.col("raw_tool").alias("raw"), F.lit("calculator").alias("gold_tool"))
    return W.route_reward(df)


@query(f"""SELECT id, round(CASE WHEN id % 2 = 0 THEN CASE WHEN k = 4 THEN -0.90 WHEN id % 11 <> 0 THEN 1.20 ELSE 0.0 END WHEN k = 4 THEN -0.90
 ELSE 0.15 + CASE WHEN id % 11 <> 0 THEN 0.10 ELSE -0.30 END + CASE WHEN k = 5 THEN -0.20 ELSE 0.05 END + CASE WHEN k = 5 THEN 0.0 WHEN w IS NOT NULL THEN 0.20 ELSE -0.30 END
 + CASE WHEN {_scaled('w', 'false', GOLDS, 0.05)} THEN 1.0 ELSE 0.0 END + CASE WHEN {_scaled('w', 'false', GOLDS, 0.01)} THEN 0.5 ELSE 0.0 END + CASE WHEN abs(w) >= 1e-12 AND abs(g) >= 1e-12 AND sign(w) <> sign(g) THEN -0.20 ELSE 0.0 END END, 6) AS reward FROM {FACTS}""")
def reward_mixed(spark, d) -> DataFrame:
    df = X.tool(spark, d).withColumns({"task_type": F.when(F.col("id") % 2 == 0, "route_replay").otherwise("program"), "gold_tool": F.lit("calculator")})
    return W.mixed_reward(df)


# --- traces, analyses ---------------------------------------------------------------------------------------------------


@query(f"SELECT count(*) AS traces, round(avg(steps), 9) AS avg_steps, round(sum(r) / sum(steps), 9) AS tool_accuracy, round(avg(r / steps), 9) AS avg_trace_accuracy, max(t) AS max_tools FROM (SELECT trace_id, count(*) AS steps, count(*) FILTER (gold_tool = pred_tool) AS r, count(DISTINCT gold_tool) AS t FROM {X.DUCK_TRACE} x GROUP BY trace_id) p")
def trace_metrics(spark, d) -> DataFrame:
    return E.trace_metrics(X.trace(spark, d))


@query(f"SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM (SELECT CASE WHEN a_ok = 1 AND b_ok = 1 THEN 'both_ok' WHEN a_ok = 1 THEN 'a_ok_b_bad' WHEN b_ok = 1 THEN 'a_bad_b_ok' ELSE 'both_bad' END AS label FROM {X.DUCK_TWO} t) x GROUP BY label")
def transition_matrix(spark, d) -> DataFrame:
    return E.transition_matrix(X.two_models(spark, d))


@query("""WITH c AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, max(n) AS n, min(CASE WHEN r >= greatest(1, floor(0.5*n)) THEN n_chars END) AS p50, min(CASE WHEN r >= greatest(1, floor(0.9*n)) THEN n_chars END) AS p90, min(CASE WHEN r >= greatest(1, floor(0.95*n)) THEN n_chars END) AS p95, min(CASE WHEN r >= greatest(1, floor(0.99*n)) THEN n_chars END) AS p99, max(n_chars) AS max, round(avg(n_chars), 6) AS mean FROM c GROUP BY lang""")
def length_percentiles(spark, d) -> DataFrame:
    return E.nearest_rank(table(spark, d, "documents"), "n_chars", ["lang"], {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})


@query("""WITH c AS (SELECT event_type AS run, value AS latency, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT run, max(n) AS n, min(CASE WHEN r >= round_even((n-1)*0.5, 0) + 1 THEN latency END) AS p50, min(CASE WHEN r >= round_even((n-1)*0.95, 0) + 1 THEN latency END) AS p95, max(latency) AS max, round(avg(latency), 6) AS mean FROM c GROUP BY run""")
def latency_summary(spark, d) -> DataFrame:
    return E.nearest_rank(table(spark, d, "events").select(F.col("event_type").alias("run"), F.col("value").alias("latency")), "latency", ["run"], {"p50": 0.5, "p95": 0.95}, "round")


@query(f"""SELECT label, count(*) AS n FROM (SELECT concat(CASE WHEN coalesce(l.quality = 1, false) THEN 'correct' ELSE 'wrong' END, '_', CASE WHEN coalesce(e.f, false) THEN 'gold_in_evidence' ELSE 'gold_missing' END) AS label
FROM labels l LEFT JOIN (SELECT d.doc_id AS id, true AS f FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE position(b.text IN d.text) > 0)) e ON l.doc_id = e.id) x GROUP BY label""")
def error_attribution(spark, d) -> DataFrame:
    gold = gold_contains(spark, d).select(F.col("doc_id").alias("id"), F.lit(True).alias("gold_found"))
    preds = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("correct"))
    return E.error_attribution(preds, gold)


@query("SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON position(b.text IN d.text) > 0")
def gold_contains(spark, d) -> DataFrame:
    """Passages of the query set within documents."""
    return R.containing(table(spark, d, "documents"), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q")))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def source_histogram(spark, d) -> DataFrame:
    return S.source_histogram(table(spark, d, "documents"), ["lang", "source"])


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100")
def bounded_read(spark, d) -> DataFrame:
    """A top-k report: the hundred longest documents."""
    df = S.known_columns(table(spark, d, "documents"), ["doc_id", "lang", "n_chars", "absent"])
    return df.orderBy(F.desc("n_chars"), "doc_id").limit(100)


# --- chunks and pages ---------------------------------------------------------------------------------------------------


@query(f"SELECT sample_id, chunk_index, text FROM {X.DUCK_CHUNKS} c")
def chunk_lines(spark, d) -> DataFrame:
    return X.chunks(spark, d)


_SQUEEZED = r"trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g'))"


@query(f"""SELECT doc_id, i AS chunk_index, array_to_string(list_slice(w, 120*i + 1, 120*i + 160), ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 119) // 120)) AS i FROM (SELECT doc_id, [x FOR x IN string_split({_SQUEEZED}, ' ') IF x <> ''] AS w FROM documents) a) b
WHERE i = 0 OR len(w) - 120*i >= 25""")
def chunk_windows(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(T.word_windows(F.col("text"))).alias("chunk_index", "text")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(r"""SELECT doc_id, i AS chunk_index, array_to_string(list_slice(s, 2*i + 1, 2*i + 2), ' ') AS text FROM (SELECT doc_id, s, unnest(range(0, (len(s) + 1) // 2)) AS i FROM (SELECT doc_id, [trim(x) FOR x IN string_split(regexp_replace(trim(text), '([.!?])[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g'), chr(1)) IF trim(x) <> ''] AS s FROM documents) a) b""".replace("\\\\", "\\"))
def chunk_sentences(spark, d) -> DataFrame:
    """Windows of two sentences, not overlapping."""
    pairs = lambda s: F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0)), F.lit(2)), lambda i: i < F.size(s)), lambda i: F.array_join(F.slice(s, i + 1, 2), " "))
    # split once a text; outer, as Spark else makes the pairs once more to look at their number
    rows = table(spark, d, "documents").select("doc_id", F.posexplode_outer(bound(T.sentences(F.col("text")), pairs)).alias("chunk_index", "text"))
    return rows.where("chunk_index is not null")


@query(r"""SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS host, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS text FROM pages""")
def html_strip(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.host(F.col("url")).alias("host"), T.strip_tags(F.col("html")).alias("text"))


#: Pages as html_strip gives them, with the references that the given tables use decoded, `&amp;` last.
_CLEAN = f"""(SELECT page_id, host, regexp_replace(replace(replace(replace(text, '&copy;', '\u00a9'), '&middot;', '\u00b7'), '&quot;', '"'), '&amp;?', '&', 'g') AS text FROM ({ORACLE_SQL['html_strip']}) s)"""
_WINDOWS = f"""(SELECT page_id, host, i AS chunk_index, array_to_string(list_slice(w, 120*i + 1, 120*i + 160), ' ') AS text FROM (SELECT page_id, host, w, unnest(range(0, (len(w) + 119) // 120)) AS i FROM (SELECT page_id, host, [x FOR x IN string_split(text, ' ') IF x <> ''] AS w FROM {_CLEAN} a) a) b
WHERE i = 0 OR len(w) - 120*i >= 25)"""


@query(f"SELECT page_id, host, text FROM {_CLEAN} c")
def html_clean(spark, d) -> DataFrame:
    return R.cleaned_pages(table(spark, d, "pages"))


@query(f"SELECT page_id, chunk_index, text FROM {_WINDOWS} w")
def page_chunks(spark, d) -> DataFrame:
    return R.page_chunks(table(spark, d, "pages"))


@query("""SELECT o_orderkey AS id, '| label | quantity | amount |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| line ' || l_linenumber || ' | ' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || ' | ' || CAST(CAST(round(l_extendedprice) AS BIGINT) AS VARCHAR) || ' |', chr(10) ORDER BY l_linenumber, CAST(l_quantity AS INT), CAST(round(l_extendedprice) AS BIGINT)) AS markdown FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def table_markdown(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", F.col("l_quantity").cast("int").alias("q"), F.round("l_extendedprice").cast("long").alias("p"))
    j = table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).join(li, "id")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "q", "p"))), lambda x: F.array(F.concat(F.lit("line "), x["l_linenumber"].cast("string")), x["q"].cast("string"), x["p"].cast("string")))
    head = F.array(F.array(F.lit("label"), F.lit("quantity"), F.lit("amount")))
    return j.groupBy("id").agg(rows.alias("r")).select("id", T.markdown_table(F.concat(head, F.col("r"))).alias("markdown"))


# --- retrieval ------------------------------------------------------------------------------------------------------------


def _lists(spark, d, dims: int, k: int = 20) -> DataFrame:
    """Every hundredth vector, the stated query set, against all vectors."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.slice("embedding", 1, dims).alias("v"))
    return R.dense_topk(e.where(F.col("chunk_id") % 100 == 0).select(F.col("chunk_id").alias("query_id"), F.col("v").alias("q")), e, k)


def _duck_lists(dims: int, k: int = 20) -> str:
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id,
 round(list_inner_product(list_slice(q.embedding, 1, {dims})::DOUBLE[], list_slice(e.embedding, 1, {dims})::DOUBLE[]), 6) AS score FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 100 = 0) s) r WHERE rank <= {k})"""


def _gold(spark, d, chunk: str = "chunk_id") -> DataFrame:
    """What is relevant to a query: vectors of its label among the thousand ids around it."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.floor(F.col("vec_id") / 1000).alias("part"))
    return e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "label", "part").join(e.withColumnRenamed("vec_id", chunk), ["label", "part"]).select("query_id", chunk)


@query(f"SELECT query_id, chunk_id, score, rank FROM {_duck_lists(64, 10)} l")
def dense_topk(spark, d) -> DataFrame:
    return _lists(spark, d, 64, 10)


_TWO = f"(SELECT 'full' AS source, * FROM {_duck_lists(64)} a UNION ALL SELECT 'half' AS source, * FROM {_duck_lists(32)} b)"


@query(f"SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM {_TWO} u GROUP BY query_id, chunk_id) s) t WHERE rank <= 20")
def rrf(spark, d) -> DataFrame:
    both = _lists(spark, d, 64).withColumn("source", F.lit("full")).union(_lists(spark, d, 32).withColumn("source", F.lit("half")))
    return R.rrf(both).drop("source_ranks")


def _duck_z(name: str, dims: int) -> str:
    return f"(SELECT query_id, chunk_id, CASE WHEN stddev_pop(score) OVER w < 1e-8 THEN 0.0 ELSE (score - avg(score) OVER w) / stddev_pop(score) OVER w END AS {name} FROM {_duck_lists(dims)} l WINDOW w AS (PARTITION BY query_id))"


@query(f"SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(0.5*coalesce(za, 0.0) + 0.5*coalesce(zb, 0.0), 6) AS score FROM {_duck_z('za', 64)} a FULL JOIN {_duck_z('zb', 32)} b USING (query_id, chunk_id)) s) t WHERE rank <= 20")
def zscore_fusion(spark, d) -> DataFrame:
    return R.zscore_fusion(_lists(spark, d, 64), _lists(spark, d, 32))


_GOLD = "(SELECT q.vec_id AS query_id, e.vec_id AS chunk_id FROM embeddings q JOIN embeddings e ON q.vec_id // 1000 = e.vec_id // 1000 AND q.label = e.label WHERE q.vec_id % 100 = 0)"


@query(f"""WITH g AS (SELECT * FROM {_GOLD} x), n AS (SELECT query_id, count(*) AS n_gold FROM g GROUP BY 1), h AS (SELECT l.query_id, l.rank FROM {_duck_lists(64)} l JOIN g USING (query_id, chunk_id)), k AS (SELECT unnest([1,3,5,10,20]) AS k),
p AS (SELECT k, n.query_id, n_gold, count(rank) FILTER (rank <= k) AS h, coalesce(sum(CASE WHEN rank <= k THEN 1/log2(rank+1) END), 0.0) AS dcg, min(rank) AS first FROM n CROSS JOIN k LEFT JOIN h ON n.query_id = h.query_id GROUP BY 1,2,3)
SELECT k, count(*) AS num_queries_with_gold, round(avg(CAST(h > 0 AS INT)), 9) AS recall, round(avg(CAST(h = n_gold AS INT)), 9) AS all_recall, round(avg(h / n_gold), 9) AS coverage, round(avg(dcg / list_sum([1/log2(i+1) FOR i IN range(1, least(n_gold, k) + 1)])), 9) AS ndcg, round(avg(coalesce(1.0::DOUBLE/first, 0.0)), 9) AS mrr FROM p GROUP BY k""")
def retrieval_eval(spark, d) -> DataFrame:
    return E.retrieval_metrics(_lists(spark, d, 64), _gold(spark, d))


_TOK = "regexp_extract_all(lower({0}), '[a-z]+|\\d+(?:\\.\\d+)?|[%$]')"


@query(f"""WITH g AS (SELECT b.item_id, d.doc_id, b.text AS q FROM benchmark b JOIN documents d ON position(b.text IN d.text) > 0), c AS (SELECT c.sample_id, c.chunk_index, {_TOK.format('c.text')} AS t FROM {X.DUCK_CHUNKS} c WHERE c.sample_id IN (SELECT doc_id FROM g)),
st AS (SELECT sample_id, count(*) AS n, avg(len(t)) AS avgdl FROM c GROUP BY 1), tf AS (SELECT sample_id, chunk_index, term, count(*) AS tf FROM (SELECT sample_id, chunk_index, unnest(t) AS term FROM c) x GROUP BY 1,2,3),
i0 AS (SELECT sample_id, term, n, avgdl, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf JOIN st USING (sample_id) GROUP BY sample_id, term, n, avgdl), i AS (SELECT *, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY sample_id) ELSE raw END AS idf FROM i0),
q AS (SELECT item_id, doc_id, term, count(*) AS qtf FROM (SELECT item_id, doc_id, unnest({_TOK.format('q')}) AS term FROM g) x GROUP BY 1,2,3),
s AS (SELECT q.item_id, q.doc_id, tf.chunk_index, sum(qtf * idf * tf.tf * 2.5 / (tf.tf + 1.5 * (1 - 0.75 + 0.75 * len(c.t) / avgdl))) AS s FROM q JOIN i ON q.doc_id = i.sample_id AND q.term = i.term JOIN tf ON tf.sample_id = i.sample_id AND tf.term = i.term JOIN c ON c.sample_id = tf.sample_id AND c.chunk_index = tf.chunk_index GROUP BY 1,2,3),
e AS (SELECT g.item_id, g.doc_id, c.chunk_index AS chunk_id, round(coalesce(s.s, 0.0), 6) AS score FROM g JOIN c ON c.sample_id = g.doc_id LEFT JOIN s ON s.item_id = g.item_id AND s.doc_id = g.doc_id AND s.chunk_index = c.chunk_index)
SELECT * FROM (SELECT item_id || ':' || doc_id AS query_id, chunk_id, score, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY score DESC, chunk_id) AS rank FROM e) t WHERE rank <= 20""")
def bm25_local(spark, d) -> DataFrame:
    """Each passage against the lines of each document that holds it."""
    gold = gold_contains(spark, d)
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    q = gold.join(items, "query_id").select(F.concat_ws(":", "query_id", "doc_id").alias("query_id"), F.col("doc_id").alias("sample_id"), "text")
    c = X.chunks(spark, d).select("sample_id", F.col("chunk_index").alias("chunk_id"), "text").join(gold.select(F.col("doc_id").alias("sample_id")).distinct(), "sample_id", "left_semi")
    return R.bm25(q, c)


@query(f"""WITH RECURSIVE l AS (SELECT query_id, rank, chunk_id, 1 + chunk_id % 97 AS words FROM {_duck_lists(64)} x), r AS (SELECT query_id, rank, chunk_id, words AS used, true AS kept FROM l WHERE rank = 1
UNION ALL SELECT l.query_id, l.rank, l.chunk_id, CASE WHEN r.used < 200 AND r.used + l.words <= 200 THEN r.used + l.words ELSE r.used END, r.used < 200 AND r.used + l.words <= 200 FROM r JOIN l ON l.query_id = r.query_id AND l.rank = r.rank + 1)
SELECT query_id, max(used) OVER (PARTITION BY query_id) AS used, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS pos, chunk_id FROM r WHERE kept""")
def word_budget(spark, d) -> DataFrame:
    got = R.word_budget(_lists(spark, d, 64).withColumn("words", 1 + F.col("chunk_id") % 97), 200)
    return got.withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH RECURSIVE l AS MATERIALIZED (SELECT query_id, rank, chunk_id AS unit, unnest([chunk_id - 5, chunk_id, chunk_id + 5]) AS c FROM {_duck_lists(64)} x),
u AS MATERIALIZED (SELECT query_id, unit, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), unit) AS rn, list({{'c': c, 't': 20 + ((c % 50) + 50) % 50}} ORDER BY c) AS items FROM l GROUP BY query_id, unit),
r AS (SELECT query_id, unit, rn, CASE WHEN list_sum([i.t FOR i IN items]) <= 600 THEN list_sum([i.t FOR i IN items]) ELSE 0 END::BIGINT AS used, CASE WHEN list_sum([i.t FOR i IN items]) <= 600 THEN [i.c FOR i IN items] ELSE [] END AS seen, CASE WHEN list_sum([i.t FOR i IN items]) <= 600 THEN [i.c FOR i IN items] ELSE [] END AS took FROM u WHERE rn = 1
 UNION ALL SELECT query_id, unit, rn, CASE WHEN fits THEN used + cost ELSE used END, CASE WHEN fits THEN list_concat(seen, fresh) ELSE seen END, CASE WHEN fits THEN fresh ELSE [] END
 FROM (SELECT *, used + cost <= 600 AS fits FROM (SELECT u.query_id, u.unit, u.rn, r.used, r.seen, [i.c FOR i IN items IF NOT list_contains(r.seen, i.c)] AS fresh, coalesce(list_sum([i.t FOR i IN items IF NOT list_contains(r.seen, i.c)]), 0)::BIGINT AS cost FROM r JOIN u ON u.query_id = r.query_id AND u.rn = r.rn + 1) a) b)
SELECT query_id, unnest(took) AS chunk_id, unit FROM r""")
def token_budget_pack(spark, d) -> DataFrame:
    units = _lists(spark, d, 64).select("query_id", "rank", F.col("chunk_id").alias("unit"), F.explode(F.array(F.col("chunk_id") - 5, F.col("chunk_id"), F.col("chunk_id") + 5)).alias("chunk_id"))
    return R.token_budget(units.withColumn("tokens", F.lit(0)), 600, length=20 + F.pmod("chunk_id", F.lit(50)))


@query(f"""WITH p AS (SELECT query_id, chunk_id AS i, rank FROM {_duck_lists(64, 5)} l), x AS (SELECT p.query_id, p.i + d AS chunk_index, rank, abs(d) AS far, d FROM p CROSS JOIN (SELECT unnest([-1,0,1]) AS d) s), c AS (SELECT vec_id FROM embeddings),
o AS (SELECT query_id, chunk_index, min((rank, far, d)) AS o FROM x JOIN c ON c.vec_id = x.chunk_index GROUP BY 1,2) SELECT * FROM (SELECT query_id, 0 AS sample_id, chunk_index, row_number() OVER (PARTITION BY query_id ORDER BY o, chunk_index) AS pos, CASE WHEN o[3] = 0 THEN 'primary' ELSE 'neighbour' END AS reason FROM o) t WHERE pos <= 18""")
def neighbour_expand(spark, d) -> DataFrame:
    p = _lists(spark, d, 64, 5).select("query_id", F.lit(0).alias("sample_id"), F.col("chunk_id").alias("chunk_index"), "rank")
    return R.neighbours(p, table(spark, d, "embeddings").select(F.lit(0).alias("sample_id"), F.col("vec_id").alias("chunk_index")))


# --- datasets ---------------------------------------------------------------------------------------------------------------


@query("SELECT id, CASE WHEN row_number() OVER (ORDER BY md5(concat('42:', CAST(id AS VARCHAR))), id) <= greatest(500, floor(count(*) OVER () * 0.1)) THEN 'dev' ELSE 'train' END AS split FROM (SELECT o_orderkey AS id FROM orders) t")
def dev_split(spark, d) -> DataFrame:
    return D.dev_split(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")))


@query("SELECT id, 'new' AS origin FROM (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O') a UNION ALL SELECT * FROM (SELECT o_orderkey, 'replay' FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') ORDER BY md5(concat('43:', CAST(o_orderkey AS VARCHAR))), o_orderkey LIMIT 900) b")
def replay_mix(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    return D.replay_mix(o.where("o_orderstatus = 'O'").select("id"), o.select("id"), 900, 43)


@query(f"SELECT id, to_json({{'answer': gold}})::VARCHAR AS chosen, raw_output AS rejected FROM {FACTS} WHERE NOT {_close('x', 'g', 0.05)}")
def pref_pairs(spark, d) -> DataFrame:
    df = E.parsed(X.qa(spark, d)).withColumn("correct", N.numeric_match(F.col("answer"), F.col("gold"), 0.05))
    return D.preference_pairs(df)


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_idx, prefix, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS prefix FROM conversations) t WHERE role = 'assistant'")
def turn_rows(spark, d) -> DataFrame:
    return D.assistant_turns(table(spark, d, "conversations"))


@query("SELECT name, file, ordinal FROM (SELECT source AS name, lang AS file, doc_id AS ordinal, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r FROM documents) t WHERE r = 1")
def manifest_upsert(spark, d) -> DataFrame:
    rows = table(spark, d, "documents").groupBy(F.col("source").alias("name")).agg(F.max_by(F.struct("doc_id", "lang"), "doc_id").alias("m")).select("name", F.col("m.lang").alias("file"), F.col("m.doc_id").alias("ordinal"))
    return D.upsert_manifest(rows.withColumn("ordinal", F.col("ordinal") - 1), rows)


@query(f"SELECT id, CASE WHEN k IN (4,5) THEN 'fixed' ELSE 'kept' END AS program, k IN (4,5) AS repaired FROM {FACTS}")
def repair_merge(spark, d) -> DataFrame:
    base = E.parsed(X.qa(spark, d))
    repairs = base.select("id", F.lit("fixed").alias("program"), (F.trim("program") == "").alias("ok"))
    return D.repair_merge(base.select("id", F.lit("kept").alias("program")), repairs)


@query(f"""WITH t AS MATERIALIZED (SELECT trace_id, step, gold_tool AS tool FROM {X.DUCK_TRACE} t0), a AS (SELECT list(DISTINCT tool) AS pool FROM t), p AS (SELECT trace_id, list(tool ORDER BY step, tool) AS path FROM t GROUP BY 1),
o AS (SELECT trace_id, path, [x.t FOR x IN list_sort([{{'h': md5(concat('42:', trace_id, q)), 't': q}} FOR q IN pool IF NOT list_contains(path, q)])][1:8] AS others FROM p, a)
SELECT trace_id, i AS pos, path[i + 1] AS gold_tool, array_to_string(path[1:i], ',') AS previous, array_to_string(list_sort(list_concat(list_distinct(path), others)), ',') AS candidates FROM (SELECT *, unnest(range(0, len(path))) AS i FROM o) r""")
def next_tool_rows(spark, d) -> DataFrame:
    t = X.trace(spark, d).select("trace_id", "step", F.col("gold_tool").alias("tool"))
    return D.next_tool_rows(t, t.select("tool").distinct())


@query("""SELECT conv_id, len(m) AS n, to_json(m)::VARCHAR AS messages, coalesce(list_position([x['from'] FOR x IN m], 'gpt') - 1, len(m)) AS prefix FROM (SELECT conv_id, list({'from': CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END, 'value': text} ORDER BY turn, role, text) AS m FROM conversations GROUP BY conv_id) c""")
def chat_rows(spark, d) -> DataFrame:
    got = D.chat_rows(table(spark, d, "conversations"))
    return got.select("conv_id", F.size("messages").alias("n"), F.to_json("messages").alias("messages"), F.size(D.prompt_prefix(F.col("messages"))).alias("prefix"))


# --- agents, grids and comparisons ----------------------------------------------------------------------------------------


@query(f"SELECT count(*) AS num_samples, {_rate('k <> 4')} AS json_valid_rate, {_rate('k <> 4')} AS no_extra_text_rate, {_rate('k <> 4')} AS action_valid_rate, {_rate('k <> 4 AND k <> 5')} AS action_accuracy, {_rate('k <> 4')} AS tool_valid_rate, {_rate('k <> 4 AND id % 11 <> 0')} AS tool_accuracy, {_rate('k <> 4 AND id % 11 <> 0', 'k <> 5')} AS tool_accuracy_on_gold_tool_turns FROM {X.duck_tool()} q")
def agent_action_eval(spark, d) -> DataFrame:
    rows = X.tool(spark, d).select(F.col("raw_tool").alias("raw"), F.when(F.col("k") == 5, "final").otherwise("tool_call").alias("gold_action"), F.lit("calculator").alias("gold_tool"))
    return A.action_metrics(rows)


_YEARS = "(SELECT n_name AS symbol, 'revenue' AS metric, year(o_orderdate) AS period, CAST(round(sum(o_totalprice)) AS BIGINT) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)"


def _facts(spark, d) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.groupBy(F.col("n_name").alias("symbol"), F.lit("revenue").alias("metric"), F.year("o_orderdate").alias("period")).agg(F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)"))).cast("long").alias("value"))


@query(f"""SELECT symbol, metric, period, 'How much did ' || metric || ' of ' || symbol || ' grow from ' || since || ' to ' || period || '?' AS question, 'subtract(' || value || ', ' || before || '), divide(#0, ' || before || ')' AS program, round((value - before) / before, 6) AS answer
FROM (SELECT *, lag(value) OVER w AS before, lag(period) OVER w AS since FROM {_YEARS.replace('sum(o_totalprice)', 'sum(CAST(o_totalprice AS DECIMAL(18,2)))')} f WINDOW w AS (PARTITION BY symbol, metric ORDER BY period)) t WHERE before IS NOT NULL AND before <> 0""")
def fact_traces(spark, d) -> DataFrame:
    return A.growth_traces(_facts(spark, d))


@query("SELECT o_orderkey AS id, CASE WHEN n_name IS NULL THEN 'not found' END AS error FROM orders LEFT JOIN nation ON o_custkey % 30 = n_nationkey")
def fact_lookup(spark, d) -> DataFrame:
    facts = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("symbol"), F.lit("Keys").alias("metric"), F.lit("fy").alias("period"), F.col("n_nationkey").cast("double").alias("value"), F.lit("x").alias("unit"))
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("N"), (F.col("o_custkey") % 30).cast("string")).alias("symbol"), F.lit("KEYS").alias("metric"), F.lit("FY").alias("period"))
    return A.fact_lookup(asked, facts).select("id", "error")


_CALL = """'{"action":"tool_call","tool_call":{"name":"calculator","arguments":{"program":"' || regexp_extract(raw_output, '"program": "([^"]*)"', 1) || '"}}}'"""


@query(f"SELECT id, 'system' AS role, 'Use the calculator.' AS content FROM {X.duck_qa()} q UNION ALL SELECT id, 'user', 'What is the change of ' || id || '?' FROM {X.duck_qa()} q UNION ALL SELECT id, 'assistant', {_CALL} FROM {X.duck_qa()} q")
def toolcall_rows(spark, d) -> DataFrame:
    df = E.parsed(X.qa(spark, d)).withColumn("question", F.concat(F.lit("What is the change of "), F.col("id").cast("string"), F.lit("?")))
    return A.tool_rows(df, "Use the calculator.").select("id", F.inline("messages"))


@query(f"SELECT id, CASE WHEN k = 6 THEN 'table_sum(' || a || ', none)' WHEN k = 7 THEN 'nested' ELSE '' END AS what FROM {FACTS} WHERE k >= 4")
def repair_rows(spark, d) -> DataFrame:
    from ..functions.programs import execute_programs

    runs = execute_programs(E.parsed(X.qa(spark, d)), "program", "run", "strict").withColumn("question", F.lit("q"))
    program = F.regexp_extract("prompt", r"Program: (.*)", 1)
    return A.repair_rows(runs).select("id", F.when(program.startswith("divide(subtract"), "nested").otherwise(program).alias("what"))


@query(f"""WITH p AS (SELECT query_id, chunk_id AS i, rank FROM {_duck_lists(64)} l), st AS (SELECT k, b, a FROM (SELECT unnest([5,10,15,20]) AS k) CROSS JOIN (SELECT unnest([{{'b':0,'a':0}},{{'b':1,'a':1}},{{'b':1,'a':2}},{{'b':2,'a':2}}], recursive := true))),
x AS (SELECT DISTINCT k, b, a, query_id, unnest(range(i - b, i + a + 1)) AS c FROM p CROSS JOIN st WHERE rank <= k), g AS (SELECT DISTINCT * FROM {_GOLD} y), n AS (SELECT query_id, count(*) AS n FROM g GROUP BY 1),
q AS (SELECT k, b, a, x.query_id, count(*) AS s, count(g.chunk_id) AS h FROM x LEFT JOIN g ON g.query_id = x.query_id AND g.chunk_id = x.c GROUP BY 1,2,3,4)
SELECT k, b AS before, a AS after, count(*) AS num_queries, round(avg(CAST(h > 0 AS INT)), 9) AS any_recall, round(avg(CAST(coalesce(h = n, false) AS INT)), 9) AS all_recall, round(avg(coalesce(h / n, 0.0)), 9) AS coverage, round(avg(s), 9) AS avg_chunks FROM q LEFT JOIN n USING (query_id) GROUP BY 1,2,3""")
def evidence_grid(spark, d) -> DataFrame:
    lists = _lists(spark, d, 64).select("query_id", F.col("chunk_id").alias("chunk_index"), "rank")
    return A.evidence_grid(lists, _gold(spark, d, "chunk_index"), (5, 10, 15, 20), ((0, 0), (1, 1), (1, 2), (2, 2)), table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id")))


@query(f"SELECT method, k, num_queries_with_gold, recall, all_recall, coverage, ndcg, mrr FROM (SELECT 'full' AS method, * FROM ({ORACLE_SQL['retrieval_eval']}) a UNION ALL SELECT 'half' AS method, * FROM ({ORACLE_SQL['retrieval_eval'].replace(_duck_lists(64), _duck_lists(32))}) b) t")
def method_comparison(spark, d) -> DataFrame:
    gold = _gold(spark, d)
    one = lambda name, dims: E.retrieval_metrics(_lists(spark, d, dims), gold).withColumn("method", F.lit(name))
    return one("full", 64).unionByName(one("half", 32))


@query("SELECT * FROM (VALUES ('quality', 'Labelled good'), ('toxic', 'Labelled toxic'), ('absent', 'Not run')) r(run, title) LEFT JOIN (SELECT 'quality' AS run, printf('%.2f', round(avg(quality) * 100, 2)) AS rate UNION ALL SELECT 'toxic', printf('%.2f', round((SELECT avg(toxic) FROM labels) * 100, 2))) m USING (run)".replace("SELECT * FROM", "SELECT run, title, coalesce(rate, '-') AS rate FROM").replace("round(avg(quality) * 100, 2)", "round((SELECT avg(quality) FROM labels) * 100, 2)"))
def comparison_table(spark, d) -> DataFrame:
    means = table(spark, d, "labels").agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"))
    metrics = means.select(F.stack(F.lit(2), F.lit("quality"), F.col("quality"), F.lit("toxic"), F.col("toxic")).alias("run", "value")).withColumn("name", F.lit("rate"))
    runs = spark.createDataFrame([("quality", "Labelled good"), ("toxic", "Labelled toxic"), ("absent", "Not run")], "run string, title string")
    return A.comparison(metrics, runs, ["rate"])


@query(f"""SELECT * FROM (SELECT item_id || ':' || doc_id AS query_id, chunk_id, score, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT item_id, doc_id, chunk_index AS chunk_id,
 round(CASE WHEN len(q) = 0 OR len(t) = 0 THEN 0.0 ELSE len(list_intersect(q, t))::DOUBLE / len(q) + 0.7 * coalesce(len([x FOR x IN list_intersect(q, t) IF regexp_matches(x, '[0-9]')])::DOUBLE / nullif(len([x FOR x IN q IF regexp_matches(x, '[0-9]')]), 0), 0.0) + CASE WHEN chunk_index = 0 THEN 0.03 ELSE 0.08 END END, 6) AS score
 FROM (SELECT b.item_id, d.doc_id, c.chunk_index, list_distinct({_TOK.format('b.text')}) AS q, list_distinct({_TOK.format('c.text')}) AS t FROM benchmark b JOIN documents d ON position(b.text IN d.text) > 0 JOIN {X.DUCK_CHUNKS} c ON c.sample_id = d.doc_id) z) y) w WHERE rank <= 10""")
def lexical_rerank(spark, d) -> DataFrame:
    gold = gold_contains(spark, d)
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    c = X.chunks(spark, d).withColumnRenamed("sample_id", "doc_id")
    rows = gold.join(items, "query_id").join(c, "doc_id").select(F.concat_ws(":", "query_id", "doc_id").alias("query_id"), F.col("chunk_index").alias("chunk_id"), "query", "text", F.when(F.col("chunk_index") == 0, "table_header").otherwise("table_row").alias("chunk_type"))
    return R.lexical_rerank(rows)


_STOPS = ", ".join(f"'{w}'" for w in T.STOP)
_WEB = "list_distinct([t FOR t IN regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9_+.$%-]*') IF length(t) > 1 AND t NOT IN (" + _STOPS + ")])"


@query(f"""WITH RECURSIVE c AS MATERIALIZED (SELECT page_id || '-' || chunk_index AS chunk_id, page_id, chunk_index, lower(' ' || text) AS body, len(string_split(text, ' ')) AS words, {_WEB.format("concat_ws(' ', ' ' || text, host)")} AS t FROM {_WINDOWS} w),
q AS MATERIALIZED (SELECT item_id AS query_id, lower({_SQUEEZED}) AS phrase, {_WEB.format('text')} AS t FROM benchmark),
s AS (SELECT query_id, chunk_id, page_id, chunk_index, words, floor((3.0::DOUBLE * n / greatest(size, 1) + 0.15::DOUBLE * n + said + 0.2::DOUBLE / greatest(page_id, 1)) * 1e6 + 0.5) / 1e6 AS score FROM (SELECT query_id, chunk_id, page_id, chunk_index, words, len(list_intersect(q.t, c.t)) AS n, len(q.t) AS size, CASE WHEN contains(body, phrase) THEN 2.0 ELSE 0.0 END AS said FROM q, c) x),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id, chunk_index, chunk_id) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id, chunk_index, chunk_id) <= 10),
r AS (SELECT query_id, rank, chunk_id, words AS used, true AS kept FROM l WHERE rank = 1 UNION ALL SELECT l.query_id, l.rank, l.chunk_id, CASE WHEN r.used < 600 AND r.used + l.words <= 600 THEN r.used + l.words ELSE r.used END, r.used < 600 AND r.used + l.words <= 600 FROM r JOIN l ON l.query_id = r.query_id AND l.rank = r.rank + 1)
SELECT query_id, max(used) OVER (PARTITION BY query_id) AS used, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS INT) AS pos, chunk_id FROM r WHERE kept""")
def web_retrieval(spark, d) -> DataFrame:
    """Stored pages to chunks to the best ones per benchmark item, within a word budget."""
    p = table(spark, d, "pages")
    chunks = R.page_chunks(p).join(p.select("page_id", "url"), "page_id").select(F.concat_ws("-", "page_id", "chunk_index").alias("chunk_id"), F.lit("").alias("title"), "text", "url", F.col("page_id").alias("source_rank"), "chunk_index", F.size(F.split("text", " ")).alias("words"))
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return R.word_budget(R.web_search(chunks, queries, 10), 600)


@query("SELECT o_orderkey AS id, round((CAST(round(o_totalprice) AS BIGINT) - o_custkey) / 7.0::DOUBLE + 3 * power(2, 3), 6) AS value FROM orders")
def infix_eval(spark, d) -> DataFrame:
    """Expressions parsed and run in the JVM, where their rows are."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.format_string("(%d - %d) / 7 + 3 * 2 ** 3", F.round("o_totalprice").cast("long"), "o_custkey").alias("e"))
    return o.select("id", F.round(infix_value(F.col("e")), 6).alias("value"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE round(CAST(round(o_totalprice) AS BIGINT) * power(10, 6 + 3 * (o_orderkey % 4)), 0) END AS usd FROM orders")
def amount_parse(spark, d) -> DataFrame:
    unit = F.get(F.array(F.lit("Million"), F.lit("billion"), F.lit("Trillion"), F.lit("apples")), (F.col("o_orderkey") % 4).cast("int"))
    said = F.concat(F.lit("worth $"), F.format_number(F.round("o_totalprice").cast("long"), 0), F.lit(" "), unit, F.lit(" in all"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(A.amount(said), 0).alias("usd"))


@query("SELECT o_orderkey AS id, 'Orders.Get' AS name, '{\"customer\": ' || o_custkey || ', \"status\": \"' || o_orderstatus || '\"}' AS args FROM orders")
def api_rows(spark, d) -> DataFrame:
    said = F.format_string("Thought. API-Request: [Orders.Get(status='%s', customer=%d)]", "o_orderstatus", "o_custkey")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), A.api_name(said).alias("name"), A.api_arguments(said).alias("args"))


@query(f"SELECT DISTINCT d.doc_id AS sample_id, c.chunk_index AS chunk_id, b.item_id FROM benchmark b JOIN documents d ON position(b.text IN d.text) > 0 JOIN {X.DUCK_CHUNKS} c ON c.sample_id = d.doc_id CROSS JOIN LATERAL (SELECT {{0}} AS g, {{1}} AS t) n WHERE n.t <> '' AND n.g <> '' AND (n.t = n.g OR (length(n.t) >= 20 AND position(n.t IN n.g) > 0) OR (length(n.g) >= 20 AND position(n.g IN n.t) > 0))".replace("{0}", "trim(regexp_replace(regexp_replace(regexp_replace(lower(b.text), '([a-z])2019([a-z])', '\\1''\\2', 'g'), '[^a-z0-9.%\\-]+', ' ', 'g'), ' +', ' ', 'g'))").replace("{1}", "trim(regexp_replace(regexp_replace(regexp_replace(lower(c.text), '([a-z])2019([a-z])', '\\1''\\2', 'g'), '[^a-z0-9.%\\-]+', ' ', 'g'), ' +', ' ', 'g'))"))
def gold_label_text(spark, d) -> DataFrame:
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("gold"))
    # found once; only documents with a passage are cut into lines and normalised
    gold = written(gold_contains(spark, d).join(items, "query_id").select(F.col("doc_id").alias("sample_id"), "query_id", "gold"), "gold")
    own = table(spark, d, "documents").join(gold.select(F.col("sample_id").alias("doc_id")), "doc_id", "left_semi")
    c = X.chunks(spark, d, own).select("sample_id", F.col("chunk_index").alias("chunk_id"), "text")
    hit = R.gold_by_text(c, gold.drop("query_id").distinct())
    return hit.join(gold, ["sample_id", "gold"]).select("sample_id", "chunk_id", F.col("query_id").alias("item_id")).distinct()


@query("""SELECT o_orderkey AS sample_id, l_linenumber AS chunk_id FROM (SELECT DISTINCT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber <= 3) t""")
def gold_label_table(spark, d) -> DataFrame:
    """Gold text names lines one to three of each order's table."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("chunk_id")).distinct()
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"))
    rows = li.join(orders, "sample_id").withColumns({"label": F.concat(F.lit("line item "), F.col("chunk_id").cast("string")), "header": F.lit("quantity")})
    rows = rows.withColumn("text", F.concat_ws(" ; ", "label", F.lit("quantity")))
    gold = orders.withColumn("gold", F.explode(F.array(*[F.lit(f"the line item {i} of the order") for i in (1, 2, 3)])))
    return R.gold_by_table(rows, gold).select("sample_id", "chunk_id").distinct()


from . import actions, analyses, mixtures, reports  # noqa: E402, F401  register their queries
