"""How close a synthetic result is to the real one: metrics, verdicts, normalised error, routing."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import semantics as S
from .ranks import cut, mean_ranks, quantiles_by, quantiles_of

RELATIVE_ERROR, TOTAL_VARIATION, SPEARMAN = 0.25, 0.15, 0.5
GROUP_JACCARD, ITEM_JACCARD, CATEGORY_ACCURACY = 0.5, 0.3, 0.5
ROW_COUNT, ROW_CATEGORY, ROW_MEAN = 0.5, 0.2, 0.5
#: Metrics of which more is better; their error is what is missing to 1.
HIGHER_IS_BETTER = ("jaccard", "mean_jaccard", "spearman", "spearman_rho", "mean_spearman_rho", "categorical_accuracy")


def relative_error(real: str | Column, synth: str | Column) -> Column:
    """|s - r| / |r|; nothing for nothing is right, something for nothing infinitely wrong."""
    r, s = S.col(real).cast("double"), S.col(synth).cast("double")
    return F.when(r == 0, F.when(s == 0, 0.0).otherwise(float("inf"))).otherwise(F.abs(s - r) / F.nullif(F.abs(r), F.lit(0.0)))


def _align(real: DataFrame, synth: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Joined on the keys, null keys alike; values as r.*, s.*"""
    on = None
    for k in keys:
        one = F.col(f"r.`{k}`").eqNullSafe(F.col(f"s.`{k}`"))
        on = one if on is None else on & one
    return real.alias("r").join(synth.alias("s"), on, how)


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the first by the order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def _one_row(df: DataFrame, keys: list[str], pick: Callable) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    x = df.withColumn("__at", F.monotonically_increasing_id()).groupBy(*(F.col(f"`{k}`") for k in keys))
    if not rest:
        return x.agg(pick("__at", "__at").alias("__x")).drop("__x")
    got = x.agg(pick(F.struct(*(F.col(f"`{c}`") for c in rest)), F.col("__at")).alias("__x"))
    return got.select(*(F.col(f"`{k}`") for k in keys), *(F.col(f"__x.`{c}`").alias(c) for c in rest))


def last_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: the last in the order of the table, as a mapping filled row by row has it."""
    return _one_row(df, keys, F.max_by)


def top_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: the first in the order of the table."""
    return _one_row(df, keys, F.min_by)


def _errors(real: DataFrame, synth: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """column, median, mean, n: relative errors over common keys where both sides have a number; columns without any are missing. One shuffle for all columns."""
    on = [relative_error(F.nanvl(F.col(f"r.`{c}`").cast("double"), F.lit(None)), F.nanvl(F.col(f"s.`{c}`").cast("double"), F.lit(None))).alias(c) for c in columns]
    long = _align(real, synth, keys, "inner").select(*on).unpivot([], [f"`{c}`" for c in columns], "column", "value").where("value is not null")
    return quantiles_by(long, ["column"], "value", [0.5], moments=True).select("column", F.element_at("__q", 1).alias("median"), "mean", "n")


def median_errors(real: DataFrame, synth: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """col, value: the median relative error over common keys; infinite if none are."""
    got = _errors(real, synth, keys, columns)
    return _named(real, columns).join(got, "column", "left").select(F.col("column").alias("col"), F.coalesce("median", F.lit(float("inf"))).alias("value"))


def _named(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, columns))).alias("column"))


def total_variation(real: DataFrame, synth: DataFrame, keys: list[str], value: str) -> DataFrame:
    j = _align(real, synth, keys, "full").select(F.coalesce(F.col(f"r.{value}").cast("double"), F.lit(0.0)).alias("x"), F.coalesce(F.col(f"s.{value}").cast("double"), F.lit(0.0)).alias("y"))
    sums = j.agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    share = lambda v, s: F.when(F.col(s) > 0, F.col(v) / F.nullif(F.col(s), F.lit(0.0))).otherwise(F.col(v))
    return j.crossJoin(F.broadcast(sums)).agg((0.5 * F.sum(F.abs(share("x", "sx") - share("y", "sy")))).alias("total_variation"))  # one row of sums


def spearman(real: DataFrame, synth: DataFrame, keys: list[str], value: str, groups: list[str]) -> DataFrame:
    """groups, spearman, n: rank correlation over common keys; ties share their mean rank; 0 for a constant or fewer than two. Without groups ranks are counted by ranges of values, so no task orders all keys."""
    names = [F.col(f"r.`{g}`").alias(g) for g in groups]
    j = _align(real, synth, keys, "inner").select(*names, F.col(f"r.`{value}`").cast("double").alias("x"), F.col(f"s.`{value}`").cast("double").alias("y"))

    def mean_rank(c: str) -> Column:
        return F.rank().over(Window.partitionBy(*groups).orderBy(c)) + (F.count("*").over(Window.partitionBy(*groups, c)) - 1) / 2.0

    if groups:
        k = j.select(*groups, mean_rank("x").alias("x"), mean_rank("y").alias("y"))
    else:
        # distinct pairs with their counts: ties weigh as often as they stand
        pairs = j.groupBy("x", "y").agg(F.count("*").alias("w"))
        for c in ("x", "y"):
            pairs = pairs.join(mean_ranks(j, c).select(F.col("value").alias("__v"), F.col("rank").alias(f"r{c}")), F.col(c).eqNullSafe(F.col("__v"))).drop("__v")
        k = pairs.select(F.col("rx").alias("x"), F.col("ry").alias("y"), "w")
    w = F.lit(1.0) if groups else F.col("w").cast("double")
    n = F.sum(w)
    cov = F.sum(w * F.col("x") * F.col("y")) - F.sum(w * F.col("x")) * F.sum(w * F.col("y")) / F.nullif(n, F.lit(0.0))
    var = lambda c: F.sum(w * F.col(c) * F.col(c)) - F.sum(w * F.col(c)) * F.sum(w * F.col(c)) / F.nullif(n, F.lit(0.0))
    rho = F.coalesce(cov / F.nullif(F.sqrt(F.greatest(var("x") * var("y"), F.lit(0.0))), F.lit(0.0)), F.lit(0.0))
    return k.groupBy(*groups).agg(rho.alias("spearman"), F.coalesce(n, F.lit(0.0)).cast("long").alias("n"))


def support(real: DataFrame, synth: DataFrame, key: str) -> DataFrame:
    """jaccard, missing, extra of the sets of values; 1 for two empty ones."""
    a, b = (x.select(F.col(key).alias("k")).distinct() for x in (real, synth))
    j = a.withColumn("a", F.lit(1)).alias("r").join(b.withColumn("b", F.lit(1)).alias("s"), F.col("r.k").eqNullSafe(F.col("s.k")), "full")
    both = F.sum(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1).otherwise(0))
    return j.agg(F.coalesce(S.ratio(both, F.count("*")), F.lit(1.0)).alias("jaccard"), F.coalesce(F.sum(F.when(F.col("b").isNull(), 1).otherwise(0)), F.lit(0)).cast("long").alias("missing"), F.coalesce(F.sum(F.when(F.col("a").isNull(), 1).otherwise(0)), F.lit(0)).cast("long").alias("extra"))


def category_accuracy(real: DataFrame, synth: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The share of real keys whose value the other side has too."""
    j = _align(real, synth, keys, "left").select((F.col(f"r.{value}").eqNullSafe(F.col(f"s.{value}"))).cast("int").alias("same"))
    return j.agg(F.coalesce(F.avg("same"), F.lit(0.0)).alias("categorical_accuracy"))


def row_level(real: DataFrame, synth: DataFrame, value: str) -> DataFrame:
    a = real.agg(F.count("*").alias("rn"), F.avg(value).alias("rm"))
    b = synth.agg(F.count("*").alias("sn"), F.avg(value).alias("sm"))
    return a.crossJoin(b).select(relative_error("rn", "sn").alias("row_count_error"), relative_error("rm", "sm").alias("mean_error"))  # one row each


def ks_wasserstein(real: DataFrame, synth: DataFrame, value: str) -> DataFrame:
    """Kolmogorov-Smirnov and Wasserstein-1 distances of two columns.

    The running sums go over distinct values. They are laid out in ranges, each
    summed by itself on top of the ranges before, so no task holds all values.
    """
    n = F.count(F.when(F.col("side") == 0, 1)).alias("a"), F.count(F.when(F.col("side") == 1, 1)).alias("b")
    v = real.select(F.col(value).alias("x"), F.lit(0).alias("side")).unionAll(synth.select(F.col(value), F.lit(1))).where("x is not null").groupBy("x").agg(*n)
    v = cut(v, "x", counts=["a", "b"])
    parts = v.groupBy("part").agg(F.sum("a").alias("pa"), F.sum("b").alias("pb"), F.min("x").alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    whole = Window.partitionBy(F.lit(1))
    parts = parts.select("part", F.coalesce(F.sum("pa").over(before), F.lit(0)).alias("ba"), F.coalesce(F.sum("pb").over(before), F.lit(0)).alias("bb"), F.sum("pa").over(whole).alias("na"), F.sum("pb").over(whole).alias("nb"), F.lead("first").over(Window.orderBy("part")).alias("next"))
    run = Window.partitionBy("part").orderBy("x")
    j = v.join(F.broadcast(parts), "part")
    gap = F.abs(S.ratio(F.col("ba") + F.sum("a").over(run), F.col("na")) - S.ratio(F.col("bb") + F.sum("b").over(run), F.col("nb")))
    j = j.select(gap.alias("gap"), (F.coalesce(F.lead("x").over(run), F.col("next")) - F.col("x")).alias("dx"))
    return j.agg(F.max("gap").alias("ks"), F.sum(F.col("gap") * F.col("dx")).alias("wasserstein"))


def frequency_l1(real: DataFrame, synth: DataFrame, key: str) -> DataFrame:
    a, b = (x.groupBy(key).agg(F.count("*").alias("n")) for x in (real, synth))
    return total_variation(a, b, [key], "n").select((2 * F.col("total_variation")).alias("frequency_l1"))


def _correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """All pairs from one aggregate of moments; 0 with a constant."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    n = F.count("*").cast("double")
    mean = {c: F.avg(c) for c in columns}
    std = {c: F.stddev_pop(c) for c in columns}
    return df.select(*(F.col(c).cast("double").alias(c) for c in columns)).dropna().agg(*(F.coalesce((F.covar_pop(a, b)) / F.nullif(std[a] * std[b], F.lit(0.0)), F.lit(0.0)).alias(f"{a}|{b}") for a, b in pairs), n.alias("n"), *(mean[c].alias(f"m_{c}") for c in columns))


def correlation_divergence(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and largest difference of the two correlation matrices, off the diagonal."""
    pairs = [f"{a}|{b}" for i, a in enumerate(columns) for b in columns[i + 1 :]]
    j = _correlations(real, columns).alias("r").crossJoin(_correlations(synth, columns).alias("s"))  # one row each
    gaps = [F.abs(F.col(f"r.`{p}`") - F.col(f"s.`{p}`")) for p in pairs]
    return j.select((S.total(gaps) / len(gaps)).alias("mean_difference"), (F.greatest(*gaps) if len(gaps) > 1 else gaps[0]).alias("max_difference"))


def summary(df: DataFrame, column: str) -> DataFrame:
    x = df.agg(F.avg(column).alias("mean"), F.max(column).alias("max"), F.avg((F.col(column) == 0).cast("int")).alias("zero_rate"))
    x = x.crossJoin(quantiles_of(df, [column], [0.5, 0.9, 0.99]))  # one row each
    return x.select("mean", *(F.element_at("__q", i + 1).alias(n) for i, n in enumerate(("p50", "p90", "p99"))), "max", "zero_rate")


#: The points of the percentile report.
REPORT = (0, 1, 5, 25, 50, 75, 95, 99, 100)


def percentile_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, and a column for each point of REPORT; all columns from one reading."""
    return quantiles_of(df, columns, [p / 100 for p in REPORT]).select("name", *(F.element_at("__q", i + 1).alias(f"p{p}") for i, p in enumerate(REPORT)))


def coverage(devices: DataFrame, key: str, tables: dict[str, DataFrame]) -> DataFrame:
    """name, devices, covered: how many devices each table has rows of. Each table is brought to its distinct keys below the left join."""
    out = None
    for name, t in tables.items():
        j = devices.select(key).join(t.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left")
        one = j.agg(F.count_distinct(key).alias("devices"), F.count_distinct(F.when(F.col("__k").isNotNull(), F.col(key))).alias("covered")).select(F.lit(name).alias("name"), "devices", "covered")
        out = one if out is None else out.unionAll(one)
    return out


def expected_counts(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """name, mean, median: distinct values of each column that a key has; what a Poisson draw for a new key expects."""
    per = df.groupBy(key).agg(*(F.count_distinct(c).alias(c) for c in columns)).select(*columns)
    long = per.unpivot([], columns, "name", "n")
    return quantiles_by(long, ["name"], "n", [0.5], moments=True).select("name", "mean", F.element_at("__q", 1).alias("median"))


# --- splits, normalised error, verdicts -----------------------------------------------------


def ranked_by_hash(df: DataFrame, key: str, seed: str) -> DataFrame:
    """df with __r: the place (from 1) of each row in a seeded random order, and __all: the number of rows.

    Ranges of the hash are counted, then each range is ordered by itself, so no
    task orders all rows. Rows of one key keep next to each other.
    """
    h = df.withColumn("__h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))).withColumn("__g", F.substring("__h", 1, 3))
    counts = h.groupBy("__g").agg(F.count("*").alias("__m"))  # at most 4096 rows
    counts = counts.withColumn("__before", F.sum("__m").over(Window.orderBy("__g")) - F.col("__m")).withColumn("__all", F.sum("__m").over(Window.partitionBy(F.lit(1)))).drop("__m")
    order = Window.partitionBy("__g").orderBy("__h", key)
    return h.join(F.broadcast(counts), "__g").withColumn("__r", F.col("__before") + F.row_number().over(order)).drop("__g", "__h", "__before")


def split_half(devices: DataFrame, key: str, seed: str) -> tuple[DataFrame, DataFrame]:
    """Two halves of the keys by a seeded hash, the first floor(n / 2) of the order. The places are kept once they are known: every table that is split asks for them."""
    placed = ranked_by_hash(devices.select(key), key, seed).persist()
    return placed.where(F.col("__r") <= F.floor(F.col("__all") / 2)).select(key), placed.where(F.col("__r") > F.floor(F.col("__all") / 2)).select(key)


def sample_exact(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """Exactly n rows (all, if fewer), without replacement."""
    return ranked_by_hash(df, key, seed).where(F.col("__r") <= n).drop("__r", "__all")


def mode(df: DataFrame, groups: list[str], column: str) -> DataFrame:
    """The most frequent value of each group, the smallest among equals."""
    n = df.where(F.col(column).isNotNull()).groupBy(*groups, column).agg(F.count("*").alias("__n"))
    return n.groupBy(*groups).agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col(column).alias("v"))).alias("__x")).select(*groups, F.col("__x.v").alias(column))


def mean_comparison(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """name, real_mean, synth_mean, relative_error, within: the narrowest of 10, 25, 50 percent, else null."""
    a = real.agg(*(F.avg(c).alias(c) for c in columns)).unpivot([], columns, "name", "real_mean")
    b = synth.agg(*(F.avg(c).alias(c) for c in columns)).unpivot([], columns, "name", "synth_mean")
    j = a.join(b, "name").withColumn("relative_error", relative_error("real_mean", "synth_mean"))
    within = F.lit(None).cast("int")
    for k in (50, 25, 10):
        within = F.when(F.col("relative_error") <= k / 100, F.lit(k)).otherwise(within)
    return j.withColumn("within", within)


def normalized(records: DataFrame) -> DataFrame:
    """Errors over the error between halves of the real data. records: metric_type, value, baseline, and keys.

    Measures of which more is better count by what is missing to 1. Non-finite values
    and baselines under 1e-8 are left out.
    """
    better = F.col("metric_type").isin(*HIGHER_IS_BETTER)
    err = lambda c: F.when(better, 1 - F.col(c)).otherwise(F.col(c))
    x = records.withColumn("__e", err("value")).withColumn("__b", err("baseline"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return x.where(finite("__e") & finite("__b") & (F.col("__b") >= 1e-8)).withColumn("normalized", F.col("__e") / F.nullif(F.col("__b"), F.lit(0.0))).drop("__e", "__b")


METRIC = "query string, query_type string, column string, metric_type string, value double, passed boolean, detail string"


class Spec(NamedTuple):
    """How two results of a query are compared.

    keys: what rows are aligned by (groups, categories, bins, items); in row-level
    results the categorical columns. values: the measures. groups: the columns within
    which items are ranked. weight: the counted column of a histogram.
    """

    kind: str
    keys: list[str]
    values: list[str]
    groups: list[str] = ()
    weight: str | None = None


#: query type -> the method that synthesises it best.
ROUTES = {"aggregate": "pertable", "histogram": "pertable", "ranking_categorical": "pertable", "distribution": "mst", "ranking_numeric": "mst", "row_level": "mst"}


def judge(metrics: DataFrame, by: list[str] = ()) -> DataFrame:
    """Verdicts of queries, for each of by (methods, say), from their metric rows: the share passed, and whether it is half at least."""
    g = metrics.groupBy("query", "query_type", *by).agg(F.count("*").alias("n_metrics"), F.sum(F.col("passed").cast("int")).cast("long").alias("n_passed"))
    score = F.coalesce(S.ratio("n_passed", "n_metrics"), F.lit(0.0))
    return g.withColumn("score", score).withColumn("passed", score >= 0.5)


def metric_rows(name: str, spec: Spec, real: DataFrame, synth: DataFrame) -> DataFrame:
    """METRIC rows of one query, lazily."""
    spec = Spec(*spec)
    rows = _EVALUATORS[spec.kind](real, synth, spec)
    return rows.select(F.lit(name).alias("query"), F.lit(spec.kind).alias("query_type"), "column", "metric_type", F.col("value").cast("double").alias("value"), F.coalesce(F.col("passed"), F.lit(False)).alias("passed"), "detail")


def evaluate(name: str, kind: str, real: DataFrame, synth: DataFrame, keys: list[str], values: list[str], groups: list[str] = (), weight: str | None = None) -> DataFrame:
    """METRIC rows of one query by its type: a few rows, computed here. A failure, in planning or in running, gives one row that says so."""
    spark = real.sparkSession
    held = [x.persist() for x in (real, synth)]  # each measure reads both
    try:
        got = metric_rows(name, Spec(kind, list(keys), list(values), list(groups), weight), real, synth).collect()  # a row for each measure
    except Exception as e:  # the row carries it
        got = [(name, kind, "", "error", None, None, str(e)[:500])]
    finally:
        for x in held:
            x.unpersist()
    return spark.createDataFrame([tuple(r) for r in got], METRIC)


def evaluate_all(specs: dict[str, Spec | tuple], real: Callable[[str], DataFrame], methods: dict[str, Callable[[str], DataFrame]]) -> DataFrame:
    """Metric rows with method, of every query and method. real and methods give results by query. What can't be read is an error row."""
    spark, rows = SparkSession.active(), []
    for method, synth in methods.items():
        for name, spec in specs.items():
            spec = Spec(*spec)
            try:
                got = [tuple(r) for r in evaluate(name, spec.kind, real(name), synth(name), spec.keys, spec.values, spec.groups, spec.weight).collect()]
            except Exception as e:  # a result that isn't there, on either side
                got = [(name, spec.kind, "", "error", None, None, str(e)[:500])]
            rows += [(*r, method) for r in got]
    return spark.createDataFrame(rows, METRIC + ", method string")


def _both(real: DataFrame, synth: DataFrame, columns: list[str]) -> list[str]:
    """Measures that both results have; a result without any of them can't be compared."""
    both = [c for c in columns if c in real.columns and c in synth.columns]
    if columns and not both:
        raise ValueError(f"neither of {', '.join(columns)} is in both results")
    return both


def _row(df: DataFrame, column: str, metric: str, value: Column, good: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(column).alias("column"), F.lit(metric).alias("metric_type"), value.cast("double").alias("value"), good.alias("passed"), detail.alias("detail"))


def _shared(real: DataFrame, synth: DataFrame, keys: list[str]) -> DataFrame:
    """One row: real, synth, both, either: numbers of distinct keys."""
    sides = [x.select(*(F.col(f"`{k}`") for k in keys)).distinct().withColumn(n, F.lit(1)) for x, n in ((real, "__a"), (synth, "__b"))]
    j = _align(*sides, keys, "full")
    n = lambda c: F.count(F.when(c, 1))
    a, b = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    return j.agg(n(a).alias("real"), n(b).alias("synth"), n(a & b).alias("both"), F.count("*").alias("either"))


def _jaccard() -> Column:
    return F.coalesce(S.ratio("both", "either"), F.lit(1.0))


def _aggregate(real: DataFrame, synth: DataFrame, spec: Spec) -> DataFrame:
    values = _both(real, synth, spec.values)
    shared = _shared(real, synth, spec.keys)
    told = F.format_string("%d/%d real groups matched, %d synth groups total", "both", "real", "synth")
    out = _row(shared, "group_coverage", "jaccard", _jaccard(), _jaccard() >= GROUP_JACCARD, told)
    errors = _errors(top_rows(real, spec.keys), top_rows(synth, spec.keys), spec.keys, values)
    j = _named(real, values).crossJoin(F.broadcast(shared)).join(errors, "column", "left")  # one row beside the measures
    value = F.coalesce("median", F.lit(float("inf")))
    none = F.col("both") == 0
    detail = F.when(none, "no overlapping groups").when(F.col("median").isNull(), "no valid comparisons").otherwise(F.format_string("median RE=%.4f, mean RE=%.4f, n_groups=%d", "median", "mean", "n"))
    return out.unionByName(j.select("column", F.when(none, "relative_error").otherwise("median_relative_error").alias("metric_type"), value.alias("value"), (value <= RELATIVE_ERROR).alias("passed"), detail.alias("detail")))


def _variations(real: DataFrame, synth: DataFrame, key: str, values: list[str]) -> DataFrame:
    """column, value, n: the total variation of each of the values over the categories of both sides. Nulls count as 0."""
    x = [F.coalesce(F.nanvl(F.col(f"{side}.`{v}`").cast("double"), F.lit(None)), F.lit(0.0)).alias(f"{side}{i}") for i, v in enumerate(values) for side in "rs"]
    j = _align(real, synth, [key], "full").select(*x)
    sums = j.agg(*(F.sum(f"{side}{i}").alias(f"s{side}{i}") for i in range(len(values)) for side in "rs"))
    share = lambda c: F.when(F.col(f"s{c}") > 0, F.col(c) / F.nullif(F.col(f"s{c}"), F.lit(0.0))).otherwise(F.col(c))
    tv = [F.coalesce(0.5 * F.sum(F.abs(share(f"r{i}") - share(f"s{i}"))), F.lit(0.0)).alias(v) for i, v in enumerate(values)]
    return j.crossJoin(F.broadcast(sums)).agg(*tv, F.count("*").alias("__n")).unpivot(["__n"], [f"`{v}`" for v in values], "column", "value").withColumnRenamed("__n", "n")  # one row of sums


def _variation_rows(real: DataFrame, synth: DataFrame, key: str, values: list[str], most: float, what: str, named: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    v = _variations(real, synth, key, values)
    return v.select(named(F.col("column")).alias("column"), F.lit("total_variation").alias("metric_type"), "value", (F.col("value") <= most).alias("passed"), F.format_string(f"TV=%.4f, %d {what}", "value", "n").alias("detail"))


def _distribution(real: DataFrame, synth: DataFrame, spec: Spec) -> DataFrame:
    key = spec.keys[0]
    return _variation_rows(last_rows(real, [key]), last_rows(synth, [key]), key, _both(real, synth, spec.values), TOTAL_VARIATION, "categories")


def _histogram(real: DataFrame, synth: DataFrame, spec: Spec) -> DataFrame:
    key, counted = spec.keys[0], spec.weight or spec.values[0]
    real, synth = last_rows(real, [key]), last_rows(synth, [key])
    bins = [x.where(F.col(f"`{key}`").isNotNull()) for x in (real, synth)]
    out = _variation_rows(*bins, key, [counted], TOTAL_VARIATION, "bins", lambda c: F.concat(c, F.lit("_distribution")))
    values = [v for v in _both(real, synth, spec.values) if v != counted]
    if not values:
        return out
    e = _errors(real, synth, [key], values)
    return out.unionByName(e.select("column", F.lit("median_relative_error").alias("metric_type"), F.col("median").alias("value"), (F.col("median") <= RELATIVE_ERROR).alias("passed"), F.format_string("median RE=%.4f, n_bins=%d", "median", "n").alias("detail")))


def _ranking_categorical(real: DataFrame, synth: DataFrame, spec: Spec) -> DataFrame:
    v = spec.values[0]
    real, synth = (last_rows(x, spec.keys).withColumn("__in", F.lit(1)) for x in (real, synth))
    j = _align(real, synth, spec.keys, "left")
    common = F.col("s.__in").isNotNull()
    x = j.agg(F.count("*").alias("all"), F.count(F.when(common, 1)).alias("common"), F.count(F.when(common & (F.col(f"r.`{v}`") == F.col(f"s.`{v}`")), 1)).alias("right"))
    value = F.coalesce(S.ratio("right", "all"), F.lit(0.0))
    detail = F.when(F.col("common") == 0, "no overlapping groups").otherwise(F.format_string("%d/%d keys correct (%d overlapping)", "right", "all", "common"))
    return _row(x, v, "categorical_accuracy", value, value >= CATEGORY_ACCURACY, detail)


def _ranking_numeric(real: DataFrame, synth: DataFrame, spec: Spec) -> DataFrame:
    groups = list(spec.groups)
    items = [k for k in spec.keys if k not in groups]
    keys, values = [*groups, *items], _both(real, synth, spec.values)
    real, synth = top_rows(real, keys), top_rows(synth, keys)
    if not groups:
        shared = _shared(real, synth, items)
        out = _row(shared, "item_overlap", "jaccard", _jaccard(), _jaccard() >= ITEM_JACCARD, F.format_string("%d/%d items matched", "both", "real"))
        for v in values:
            rho = spearman(real, synth, keys, v, []).where("n >= 2")
            out = out.unionByName(_row(rho, f"{v}_rank_corr", "spearman_rho", F.col("spearman"), F.col("spearman") >= SPEARMAN, F.format_string("rho=%.4f, n_items=%d", "spearman", "n")))
        return out
    a, b = (x.select(*keys).withColumn(n, F.lit(1)) for x, n in ((real, "__a"), (synth, "__b")))
    j = _align(a, b, keys, "full").select(*(F.coalesce(f"r.`{g}`", f"s.`{g}`").alias(g) for g in groups), "__a", "__b")
    n = lambda c: F.count(F.when(c, 1))
    per = j.groupBy(*groups).agg(F.count("__a").alias("real"), F.count("__b").alias("synth"), n(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("both"), F.count("*").alias("either"))
    x = per.where("real > 0 and synth > 0").agg(F.avg(_jaccard()).alias("mean"), F.count("*").alias("groups"))
    none, mean = F.col("groups") == 0, F.coalesce("mean", F.lit(0.0))
    detail = F.when(none, "no overlapping groups").otherwise(F.format_string("avg Jaccard=%.4f across %d groups", "mean", "groups"))
    out = x.select(F.when(none, "group_coverage").otherwise("item_overlap").alias("column"), F.when(none, "jaccard").otherwise("mean_jaccard").alias("metric_type"), mean.alias("value"), (~none & (mean >= ITEM_JACCARD)).alias("passed"), detail.alias("detail"))
    rho = spearman(real, synth, keys, values[0], groups).where("n >= 2").agg(F.avg("spearman").alias("rho"), F.count("*").alias("groups")).where("groups > 0")
    return out.unionByName(_row(rho, f"{values[0]}_rank_corr", "mean_spearman_rho", F.col("rho"), F.col("rho") >= SPEARMAN, F.format_string("avg rho=%.4f across %d groups", "rho", "groups")))


def _row_level(real: DataFrame, synth: DataFrame, spec: Spec) -> DataFrame:
    values = _both(real, synth, spec.values)
    one = [x.agg(F.count("*").alias(f"{s}n"), *(F.avg(F.col(f"`{v}`")).alias(f"{s}{i}") for i, v in enumerate(values))) for x, s in ((real, "r"), (synth, "s"))]
    x = one[0].crossJoin(one[1])  # one row each
    error = relative_error("rn", "sn")
    out = _row(x, "row_count", "relative_error", error, error <= ROW_COUNT, F.format_string("real=%d, synth=%d", "rn", "sn"))
    for i, v in enumerate(values):
        error = relative_error(f"r{i}", f"s{i}")
        out = out.unionByName(_row(x, f"{v}_mean", "relative_error", error, error <= ROW_MEAN, F.format_string("real_mean=%.2f, synth_mean=%.2f", f"r{i}", f"s{i}")))
    for k in _both(real, synth, spec.keys):
        a, b = (y.where(F.col(f"`{k}`").isNotNull()).groupBy(F.col(f"`{k}`").alias("k")).agg(F.count("*").alias("n")) for y in (real, synth))
        out = out.unionByName(_variation_rows(a, b, "k", ["n"], ROW_CATEGORY, "values", lambda c, k=k: F.lit(f"{k}_distribution")))
    return out


_EVALUATORS = {"aggregate": _aggregate, "distribution": _distribution, "histogram": _histogram, "ranking_categorical": _ranking_categorical, "ranking_numeric": _ranking_numeric, "row_level": _row_level}


def route(verdicts: DataFrame, routes: dict[str, str] = ROUTES) -> DataFrame:
    """Verdicts (with method) of the method that each query's type is sent to."""
    return verdicts.where(S.total(((F.col("query_type") == k) & (F.col("method") == m)).cast("int") for k, m in routes.items()) > 0)


def normalized_rows(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """Metric rows with method over the metric rows of a baseline: what both measured, finite, where the baseline leaves an error."""
    on = ["query", "column", "metric_type"]
    j = metrics.where("metric_type <> 'error'").join(baseline.where("metric_type <> 'error'").select(*on, F.col("value").alias("baseline")), on)
    return normalized(j).select("method", "query", "query_type", "column", "metric_type", F.col("value").alias("method_value"), F.col("baseline").alias("baseline_value"), "normalized")


def normalized_summary(rows: DataFrame, by: list[str] = ("method",)) -> DataFrame:
    """by, mean, median, std, count of normalised errors."""
    median = quantiles_by(rows, list(by), "normalized", [0.5]).select(*by, F.element_at("__q", 1).alias("median"))
    return rows.groupBy(*by).agg(F.avg("normalized").alias("mean"), F.stddev("normalized").alias("std"), F.count("*").alias("count")).join(median, list(by)).select(*by, "mean", "median", "std", "count")


def method_matrix(verdicts: DataFrame, methods: list[str]) -> DataFrame:
    return verdicts.groupBy("query").pivot("method", methods).agg(F.avg("score"))


def type_averages(verdicts: DataFrame) -> DataFrame:
    """query_type and, where given, method: mean score, share passed, number of queries."""
    by = ["query_type", *(c for c in ("method",) if c in verdicts.columns)]
    return verdicts.groupBy(*by).agg(F.avg("score").alias("mean_score"), F.avg(F.col("passed").cast("int")).alias("pass_rate"), F.count("*").alias("queries"))


def sensitivity(metrics: DataFrame, metric_type: str, thresholds: list[float]) -> DataFrame:
    """threshold, pass_rate of an error metric over thresholds."""
    x = metrics.where(F.col("metric_type") == metric_type)
    return x.agg(*(F.avg((F.col("value") <= t).cast("int")).alias(str(t)) for t in thresholds)).unpivot([], [f"`{t}`" for t in thresholds], "threshold", "pass_rate").withColumn("threshold", F.col("threshold").cast("double"))
