"""Quality rules: base counts and robust multivariate outliers, in built-in functions only.

Each text gives a vector of transformed statistics. For every (lang, source), for every language and for all rows the
minimum-covariance-determinant estimate is found from three starts by concentration steps: distances to the current centre and scatter, moments of the closest
`share` of the rows, and again; of the starts the one that ends with the least determinant counts, and one reweighted estimate follows. A group's estimate
is drawn towards its language's, with equal weights at PRIOR rows, and that one's likewise towards all rows': so every row has a distance, and no group size is a
threshold. A row is rejected if its squared Mahalanobis distance to its group's estimate exceeds `cutoff`.

At scale: the texts are read once and reduced to a narrow table of integers. A concentration step is one
aggregation to (group, start, distance bin), with partial sums on the map side, so a hot group costs no task more than
another; sums are of integers, so results don't depend on partitioning. Estimates (one row a group) are joined
by Spark's own choice of join: broadcast below its size threshold, else both sides dealt out and hot keys split.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, table, words_of, written

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Transformed statistics, in thousandths; FLOOR is the least standard deviation that counts, in the same unit.
FEATURES = ("word_len", "symbols", "dup_lines", "repeats", "upper")
FLOOR = (40, 150, 150, 60, 150)
SHARE = 0.75
#: Consistency factor of the covariance of the closest three quarters in five dimensions, and the 97.5 % point of chi-square with 5 degrees.
CONSISTENCY, REWEIGHT = 1.41, 12.83
#: Ten robust standard deviations. Whatever the distribution, at most 5 in 100 rows lie so far out (Chebyshev's bound in five dimensions); the chi-square
#: point of 12.83 supposes a normal one and takes 2.4 % of the good rows of skewed statistics (README).
CUTOFF = 100.0
STEPS = 3
#: Rows at which a group's estimate and the wider one have equal weights; weights go by the square, so that a lone outlier in a tiny group doesn't judge itself.
PRIOR = 50
#: Of a start's histogram: cells of CELL thousandths, between these.
CELL, LOWEST, HIGHEST = 50, -100, 400
#: Recurring windows that are looked up one by one; with more of them a text's windows are sorted.
FEW = 64
P = range(len(FEATURES))
CROSS = list(combinations_with_replacement(P, 2))


def _without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def statistics(docs: DataFrame) -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper (long). Null text: zeros."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    df = docs.withColumns({"_words": words_of(F.col("text")), "_lines": lines})
    # hashes of the 3-word windows; texts in which none recurs skip the sort
    df = df.withColumn("_n", F.size("_words")).withColumn(
        "_h",
        F.when(F.col("_n") >= 3, F.transform(F.sequence(F.lit(0), F.col("_n") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))).otherwise(F.array().cast("array<bigint>")),
    )
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array("_h")))
    df = df.withColumn("_d", F.array_distinct(F.filter("_s", lambda x, j: x == F.get("_s", j + 1))))
    few = F.filter(F.sequence(F.lit(0), F.size("_h") - 1), lambda i: F.array_contains("_d", F.get("_h", i)))
    pairs = F.when(F.size("_d") > FEW, F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    df = df.withColumn("_s", pairs)
    again = F.filter("_s", lambda x, j: (F.get("_s", j - 1)["h"] == x["h"]) | (F.get("_s", j + 1)["h"] == x["h"]))
    df = df.withColumn("_p", F.when(F.size("_d") > FEW, F.array_sort(F.transform(again, lambda x: x["i"]))).when(F.size("_d") > 0, few))
    covered = F.aggregate(F.transform("_p", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_p", j + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return df.withColumns(
        {
            "n_words": F.col("_n").cast("long"),
            "word_chars": _without(text, BLANKS).cast("long"),
            "n_symbols": (F.char_length(text) - _without(text, SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "n_upper": (F.char_length(text) - _without(text, UPPER)).cast("long"),
        }
    ).drop("_words", "_lines", "_n", "_h", "_s", "_d", "_p")


def _vector(df: DataFrame) -> DataFrame:
    """Adds x0..x4 (long, thousandths) where base_failed is false, else nulls."""
    n, chars = F.col("n_words"), F.col("word_chars")
    raw = (F.log(chars / n), F.log1p(1000 * F.col("n_symbols") / chars), F.log1p(100 * F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n), F.log1p(1000 * F.col("n_upper") / chars))
    return df.withColumns({f"x{i}": F.when(~F.col("base_failed"), F.round(1000 * r).cast("long")) for i, r in zip(P, raw, strict=True)})


def _distance(df: DataFrame) -> DataFrame:
    """Adds d2 from the centre m*, and the Cholesky factor l*_* of the scatter."""
    for i in P:
        y = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            y = y - F.col(f"l{i}_{j}") * F.col(f"y{j}")
        df = df.withColumn(f"y{i}", y / F.col(f"l{i}_{i}"))
    return df.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in P), F.lit(0.0))).drop(*[f"y{i}" for i in P])


def _scatter(sums: DataFrame, factor: float) -> DataFrame:
    """Adds centre m* and factor times the covariance plus the floors, c*_*, from n, s*, s*_*."""
    # n * cross - s * s in exact decimals, so that no digits cancel
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    cov = {f"c{i}_{j}": (exact("n") * exact(f"s{i}_{j}") - exact(f"s{i}") * exact(f"s{j}")).cast("double") / (F.col("n").cast("double") * F.col("n")) * factor + (FLOOR[i] ** 2 if i == j else 0) for i, j in CROSS}
    return sums.withColumns({**{f"m{i}": F.col(f"s{i}") / F.col("n") for i in P}, **cov})


def _factored(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, centre and the Cholesky factor l*_* of c*_*."""
    for j in P:
        rest = F.col(f"c{j}_{j}")
        for k in range(j):
            rest = rest - F.col(f"l{j}_{k}") * F.col(f"l{j}_{k}")
        df = df.withColumn(f"l{j}_{j}", F.sqrt(rest))
        for i in range(j + 1, len(P)):
            rest = F.col(f"c{j}_{i}")
            for k in range(j):
                rest = rest - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            df = df.withColumn(f"l{i}_{j}", rest / F.col(f"l{j}_{j}"))
    return df.select(*keys, *[f"m{i}" for i in P], *[f"l{i}_{j}" for i in P for j in range(i + 1)])


G = ["lang_k", "source_k"]
X = [f"x{i}" for i in P]
#: The key of all languages or sources; keys of values begin with "=" or are empty.
ALL = "*"
STARTS = 3


def _moments() -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in P], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in CROSS]]


def _again(parts: DataFrame) -> list[Column]:
    return [F.sum(c).alias(c) for c in parts.columns if c == "n" or c[0] == "s" and c[1].isdigit()]


def _levels(rows: DataFrame) -> DataFrame:
    """Each row as one of its group, of its language and of all."""
    keys = F.array(*[F.struct(a.alias("lang_k"), b.alias("source_k")) for a, b in ((F.col("lang_k"), F.col("source_k")), (F.col("lang_k"), F.lit(ALL)), (F.lit(ALL), F.lit(ALL)))])
    return rows.select(F.explode(keys).alias("g"), *X).select("g.*", *X)


def _starts(rows: DataFrame) -> DataFrame:
    """Estimates to start from, by `start`: 0 medians and quartile ranges, 1 all rows, 2 the half of them with an even sum of x*.

    The medians come from counts in cells of bounded number.
    """
    cell = lambda i: F.least(F.greatest(F.floor(F.col(f"x{i}") / CELL), F.lit(LOWEST)), F.lit(HIGHEST))
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), cell(i).alias("b")) for i in P]))
    counts = rows.select(*G, cells.alias("c")).groupBy(*G, "c.f", "c.b").count()
    w = Window.partitionBy(*G, "f")
    ranked = counts.withColumns({"upto": F.sum("count").over(w.orderBy("b")), "all": F.sum("count").over(w)})
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("b") * CELL + CELL // 2))
    quart = ranked.groupBy(*G, "f").agg(at(0.25).alias("lo"), at(0.5).alias("mid"), at(0.75).alias("hi"))
    one = lambda i, c: F.max(F.when(F.col("f") == i, F.col(c)))
    scale = lambda i: F.pow((one(i, "hi") - one(i, "lo")) / 1.349, 2) + FLOOR[i] ** 2
    medians = quart.groupBy(*G).agg(*[one(i, "mid").cast("double").alias(f"m{i}") for i in P], *[(scale(i) if i == j else F.lit(0.0)).alias(f"c{i}_{j}") for i, j in CROSS])
    half = F.pmod(sum((F.col(x) for x in X), F.lit(0)), F.lit(2)) == 0
    sums = rows.withColumn("start", F.explode(F.when(half, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).groupBy(*G, "start").agg(*_moments())
    names = [*G, "start", *[f"m{i}" for i in P], *[f"c{i}_{j}" for i, j in CROSS]]
    return _factored(medians.withColumn("start", F.lit(0)).select(names).unionByName(_scatter(sums, 1.0).select(names)), [*G, "start"])


def _drawn(own: DataFrame, wide: DataFrame, keys: list[str], prior: int) -> DataFrame:
    """Centres and covariances of own (with n), drawn by keys towards those of wide, with weights n^2 and prior^2."""
    values = [f"m{i}" for i in P] + [f"c{i}_{j}" for i, j in CROSS]
    both = own.join(wide.select(*keys, *[F.col(v).alias(f"w_{v}") for v in values]), keys) if keys else own.crossJoin(wide.select(*[F.col(v).alias(f"w_{v}") for v in values]))
    n, w = F.col("n").cast("double") * F.col("n"), float(prior) ** 2
    return both.select(*G, "n", *[((n * F.col(v) + w * F.col(f"w_{v}")) / (n + w)).alias(v) for v in values])


def mcd_estimates(rows: DataFrame, share: float = SHARE, steps: int = STEPS, prior: int = PRIOR) -> DataFrame:
    """rows: lang_k, source_k, x0..x4 -> one row for each group: centre and Cholesky factor of its drawn estimate."""
    rows = written(_levels(rows), "levels")
    key = [*G, "start"]
    tried = rows.withColumn("start", F.explode(F.array(*map(F.lit, range(STARTS)))))
    est = written(_starts(rows), "mcd")
    for _ in range(steps):
        near = _distance(tried.join(est, key)).withColumn("bin", F.floor(16 * F.log2(1 + F.col("d2"))))
        parts = near.groupBy(*key, "bin").agg(*_moments())
        w = Window.partitionBy(*key)
        closest = parts.withColumns({"before": F.coalesce(F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "all": F.sum("n").over(w)}).where(F.col("before") < share * F.col("all"))
        est = written(_factored(_scatter(closest.groupBy(*key).agg(*_again(parts)), CONSISTENCY), key), "mcd")
    det = F.lit(1.0)
    for i in P:
        det = det * F.col(f"l{i}_{i}")
    least = est.groupBy(*G).agg(F.min(F.struct(F.round(det, 6).alias("det"), "start")).alias("least")).select(*G, "least.start")
    best = written(est.join(least, key).drop("start"), "mcd")
    kept = _distance(rows.join(best, G)).where(F.col("d2") <= REWEIGHT)
    plain = written(_scatter(kept.groupBy(*G).agg(*_moments()), 1.0), "mcd")
    every = plain.where((F.col("lang_k") == ALL) & (F.col("source_k") == ALL))
    tongues = _drawn(plain.where((F.col("lang_k") != ALL) & (F.col("source_k") == ALL)), every, [], prior)
    return written(_factored(_drawn(plain.where(F.col("source_k") != ALL), tongues, ["lang_k"], prior), G), "mcd")


def _counted(docs: DataFrame) -> DataFrame:
    counts = statistics(docs)
    counts = counts.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    return _vector(counts.withColumns({"lang_k": key("lang"), "source_k": key("source")}))


def _estimates(counted: DataFrame) -> DataFrame:
    return mcd_estimates(counted.where("not base_failed").select(*G, *X))


def _verdict(counted: DataFrame, est: DataFrame, cutoff: float) -> DataFrame:
    # rows that fail the base rules have no x*, hence no distance
    return _distance(counted.join(est, G, "left")).withColumn("kept", F.coalesce(F.col("d2") <= cutoff, F.lit(False)))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def judged(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """One row per row of docs: doc_id, the counts, base_failed, distance (squared) and kept.

    Null and empty texts have no words and fail the base rules. Null lang or source form groups of their own.
    Rows that fail the base rules have no distance; all others have one, whatever their group's size. Repeated rows are
    judged alike and stay repeated; an empty table gives no row; further columns are ignored.
    """
    base = written(_counted(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality")
    return _verdict(base, _estimates(base), cutoff).select("doc_id", *COUNTS, F.col("d2").alias("distance"), "kept")


def keep_good(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs that the rules keep, all columns as they were.

    Texts are counted once for the estimates and again where they are judged, in place: that costs less than a shuffle of the texts. Null and
    empty texts go, as they fail the base rules; null lang or source form groups of their own; repeated rows are judged
    alike; an empty table gives no row.
    """
    base = written(_counted(docs.select("text", "lang", "source")).select("base_failed", *G, *X), "quality")
    named = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)] + ["text", "lang", "source"])
    stay = _verdict(_counted(named), _estimates(base), cutoff).where("kept")
    return stay.select([F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).drop("distance")
