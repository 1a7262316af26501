"""Readers and writers of records, reports, manifests and metrics documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.programs import bound


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, origin: str | None = None) -> DataFrame:
    """One record a line; blank lines are skipped, a corrupt one fails the read. origin: a column for the file's name."""
    df = spark.read.schema(schema).json(path, mode="FAILFAST")
    return df.withColumn(origin, F.col("_metadata.file_name")) if origin else df


def read_union(spark: SparkSession, paths: list[str], schema: StructType | str, origin: str = "source_file") -> DataFrame:
    """Several files as one table, with the file's name: a single scan of all paths."""
    return spark.read.schema(schema).json(paths, mode="FAILFAST").withColumn(origin, F.col("_metadata.file_name"))


def flatten_container(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list, or an object of lists, as rows (split_or_key, item as JSON text)."""
    v = F.parse_json("value")
    raw = spark.read.text(path, wholetext=True).select(v.alias("v"))
    raw.createOrReplaceTempView("container_files")
    return spark.sql(
        """SELECT coalesce(o.key, 'all') AS split_or_key, to_json(i.value) AS item
        FROM (SELECT CASE WHEN schema_of_variant(v) LIKE 'ARRAY%' THEN parse_json(concat('{"all":', to_json(v), '}')) ELSE v END AS v FROM container_files),
        LATERAL variant_explode(v) o, LATERAL variant_explode(o.value) i"""
    )


def known_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that df has, in the order wanted."""
    return df.select([c for c in wanted if c in df.columns])


def bounded_read(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in a stated order; the limit is the caller's."""
    return df.orderBy(*order).limit(n)


def rename_splits(df: DataFrame, column: str = "split") -> DataFrame:
    names = F.create_map(F.lit("validation"), F.lit("dev"))
    return df.withColumn(column, F.coalesce(F.try_element_at(names, F.col(column)), F.col(column)))


def report_from_prompt(prompts: DataFrame) -> DataFrame:
    """(id, text) prompts with section markers -> (id, section, pos, line, cells), pos within the context.

    The context stands between `Financial context:` (or the text's beginning) and an empty line with `Question:`. A line that begins with a marker opens its section, what follows in
    that line is dropped; lines before the first marker and blank ones are dropped, and within a table those that begin with `|` and a dash. Null texts have no lines. Each prompt is read within its row: nothing is shuffled or sorted, and prompts with equal ids don't mix.
    """
    own = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?s)^.*?Financial context:", "")
    context = F.regexp_replace(own, r"(?s)\n\nQuestion:.*$", "")
    lines = F.transform(F.split(context, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    mark = lambda x: F.replace(F.regexp_extract(F.lower(x), r"^(pre-text|table|post-text):", 1), F.lit("-"), F.lit("_"))

    def body(x: Column, m: Column, i: Column) -> Column:
        """The lines of the section that mark m, the i-th, opens: those up to the next mark."""
        upto = F.coalesce(F.get(x["marks"], i + 1)["pos"], F.size(x["lines"]))
        own = F.transform(F.slice(x["lines"], m["pos"] + 2, upto - m["pos"] - 1), lambda line, j: F.struct(m["mark"].alias("section"), (m["pos"] + 1 + j).alias("pos"), line.alias("line")))
        return F.filter(own, lambda r: (r["line"] != "") & ~((r["section"] == "table") & r["line"].rlike(r"^\|\s*-")))

    marks = lambda ls: F.filter(F.transform(ls, lambda x, i: F.struct(mark(x).alias("mark"), i.alias("pos"))), lambda m: m["mark"] != "")
    held = bound(lines, lambda ls: F.struct(ls.alias("lines"), marks(ls).alias("marks")))
    found = bound(held, lambda x: F.flatten(F.transform(x["marks"], lambda m, i: body(x, m, i))))
    # outer, as the list would else be made once more for a filter on its size
    rows = prompts.select("id", F.explode_outer(found).alias("r")).where("r is not null").select("id", "r.*")
    cells = F.when(F.col("section") == "table", F.transform(F.split(F.btrim("line", F.lit("| ")), r"\|"), lambda c: F.trim(c)))
    return rows.select("id", "section", "pos", "line", cells.alias("cells"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_metrics(metrics: DataFrame, bad: DataFrame, path: str) -> None:
    """A run's one-row document, and its bad rows beside it."""
    metrics.coalesce(1).write.json(f"{path}/metrics")
    bad.write.json(f"{path}/bad")


def read_metrics(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Metrics documents of several runs as (run, name, value), one scan of all; fields that aren't numbers, and runs without a file, have no rows."""
    none = spark.createDataFrame([], "run string, name string, value double")
    there = {run: path for run, path in paths.items() if _exists(spark, path)}
    if not there:
        return none
    docs = spark.read.text(sorted(set(there.values())), wholetext=True, pathGlobFilter="*.json").select(F.explode(F.split("value", "\n")).alias("value"), _file().alias("file"))
    docs = docs.select("file", F.try_parse_json("value").alias("v")).where("v is not null")
    # a file belongs to the run whose folder it stands in; runs are a short list
    at = spark.createDataFrame([(run, _absolute(spark, path)) for run, path in there.items()], "run string, at string")
    docs = docs.join(F.broadcast(at), F.col("file").startswith(F.concat("at", F.lit("/"))) | (F.col("file") == F.col("at")))
    fields = docs.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    return fields.select("run", F.col("key").alias("name"), F.try_variant_get("value", "$", "double").alias("value")).where("value is not null and schema_of_variant(v) like 'OBJECT%'")


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _exists(spark: SparkSession, path: str) -> bool:
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(_path(spark, path))


def _absolute(spark: SparkSession, path: str) -> str:
    """The path with its file system, slashes behind the scheme made one."""
    full = _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(_path(spark, path)).toString()
    return re.sub("^([a-z0-9]+):/+", r"\1:/", full).rstrip("/")


def _file() -> Column:
    """Where a row stands, written like _absolute()."""
    return F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^([a-z0-9]+):/+", "$1:/")


def stage_summary(spark: SparkSession, stages: list[tuple[str, str]], names: list[str]) -> DataFrame:
    """stages (title, path of a metrics document) -> (place, title, missing, one column a name): all stages in order; a missing file or field shows as null."""
    found = read_metrics(spark, dict(stages)).groupBy("run").agg(F.lit(True).alias("there"), *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])
    asked = spark.createDataFrame([(i, title) for i, (title, _) in enumerate(stages)], "place int, title string")
    return asked.join(found, F.col("title") == F.col("run"), "left").select("place", "title", F.col("there").isNull().alias("missing"), *names)


def source_histogram(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def write_splits(df: DataFrame, path: str, column: str = "split") -> None:
    """A folder a split, names as in rename_splits()."""
    rename_splits(df, column).write.partitionBy(column).parquet(path)


def read_split(spark: SparkSession, path: str, name: str, column: str = "split") -> DataFrame:
    """The rows of one split: only its folder is scanned."""
    return spark.read.parquet(path).where(F.col(column) == name)


def write_counted(df: DataFrame, path: str, counters: dict[str, Column]) -> dict:
    """Writes df as Parquet and returns counters (aggregates over its rows), taken in the same pass."""
    seen = Observation()
    df.observe(seen, *[c.alias(k) for k, c in counters.items()]).write.parquet(path)
    return seen.get


def read_split_files(spark: SparkSession, paths: dict[str, str], schema: StructType | str) -> DataFrame:
    """JSON lines of several splits as one table with a column split, by the folder or file that a row stands in: one scan."""
    df = spark.read.schema(schema).json(list(paths.values()), mode="FAILFAST")
    at = {name: _absolute(spark, path) for name, path in paths.items()}
    file, split = _file(), F
    for name, path in sorted(at.items(), key=lambda x: -len(x[1])):  # a folder within another comes first
        split = split.when(file.startswith(path + "/") | (file == path), name)
    return df.withColumn("split", split.otherwise(None))
