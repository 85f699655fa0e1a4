"""Order over a whole table without a task that holds it: values cut into ranges, ranks, exact quantiles.

The edges of the ranges are some of the values themselves, those of the smallest
hashes. So the range of a value follows from the values alone: nothing has to be
settled before it is used twice, and building a DataFrame runs no job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values, at least; more where the session shuffles in more parts.
RANGES = 64
#: Spark keeps the first rows of each group before it shuffles up to this number.
MOST_RANGES = 999


def _alike(left: str, right: str, columns: list[str]) -> Column:
    on = F.lit(True)
    for c in columns:
        on &= F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return on


def cut(distinct: DataFrame, value: str, groups: list[str] = (), descending: bool = False, counts: list[str] = ("n",)) -> DataFrame:
    """distinct (a row for each value of a group, with counts) with part: a number that rises with the value; null values come last in the order that is meant.

    The edges are taken from the rows with all their counts: so the shuffle that made them is made once for both.
    """
    n = min(max(RANGES, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))), MOST_RANGES)
    counted = F.lit(False)
    for c in counts:
        counted |= F.col(c) > 0
    some = distinct.where(counted).select(*groups, value)
    order = [F.xxhash64(value), F.col(value)]
    if groups:
        some = some.withColumn("__r", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("__r") <= n)
    else:
        some = some.orderBy(*order).limit(n)
    edges = some.groupBy(*groups).agg(F.sort_array(F.collect_list(value)).alias("__edges"))  # n values at most for each group
    j = distinct.alias("d").join(edges.alias("e"), _alike("d", "e", list(groups)), "left") if groups else distinct.alias("d").crossJoin(F.broadcast(edges))
    part = F.when(F.col(f"d.{value}").isNull(), -1 if descending else n + 1).otherwise(F.size(F.filter("__edges", lambda e: e < F.col(f"d.{value}"))))
    return j.select("d.*", part.alias("part"))


def _offsets(counts: DataFrame, groups: list[str], descending: bool, mean: bool = False) -> DataFrame:
    """groups, part, offset, inside, all: the rows before a part, in it, and of the group; with mean, the group's mean value. A group has a row for each part here."""
    mass = [F.sum(F.col("value") * F.col("n")).alias("mass")] if mean else []
    sums = counts.groupBy(*groups, "part").agg(F.sum("n").alias("inside"), *mass)
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    upto = whole.orderBy(F.desc("part") if descending else F.asc("part")).rowsBetween(Window.unboundedPreceding, -1)
    more = [(F.sum("mass").over(whole) / F.sum("inside").over(whole)).alias("mean")] if mean else []
    return sums.select(*groups, "part", F.coalesce(F.sum("inside").over(upto), F.lit(0)).alias("offset"), "inside", F.sum("inside").over(whole).alias("all"), *more)


def _placed(counts: DataFrame, offsets: DataFrame, groups: list[str], descending: bool) -> DataFrame:
    order = F.desc_nulls_last("value") if descending else F.asc_nulls_last("value")
    more = [c for c in ("mean",) if c in offsets.columns]
    j = counts.alias("c").join(offsets.alias("o"), _alike("c", "o", [*groups, "part"])).select("c.*", "offset", "all", *more)
    before = F.sum("n").over(Window.partitionBy(*groups, "part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return j.select(*groups, "value", "n", (F.col("offset") + F.coalesce(before, F.lit(0))).alias("before"), "all", *more)


def running_counts(df: DataFrame, by: str, descending: bool = False, groups: list[str] = ()) -> DataFrame:
    """groups, value, n, before, all: each value of by, its rows, the rows before it in the order, and those of its group."""
    groups = list(groups)
    counts = cut(df.groupBy(*groups, F.col(by).alias("value")).agg(F.count("*").alias("n")), "value", groups, descending)
    return _placed(counts, _offsets(counts, groups, descending), groups, descending)


def ranked_all(df: DataFrame, by: str) -> DataFrame:
    """rank of every row, descending, ties sharing ranks, nulls last."""
    ranks = running_counts(df, by, descending=True).select(F.col("value").alias("__by"), (F.col("before") + 1).cast("long").alias("rank"))
    return df.join(ranks, F.col(by).eqNullSafe(F.col("__by"))).drop("__by")


def mean_ranks(df: DataFrame, by: str, groups: list[str] = ()) -> DataFrame:
    """groups, value, rank: each value's mean rank in its group, ascending, ties sharing it."""
    return running_counts(df, by, groups=groups).select(*groups, "value", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def quantiles_by(df: DataFrame, groups: list[str], value: str, at: list[float], moments: bool = False) -> DataFrame:
    """groups, __q (with moments also n, mean): exact quantiles of each group's values, between two values in proportion; nulls and NaN don't count. Of all groups (columns, say) in the same shuffles; only ranges that hold a wanted place are put in order."""
    groups = list(groups)
    number = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    values = df.select(*groups, number.alias("value")).where("value is not null").groupBy(*groups, "value").agg(F.count("*").alias("n"))
    counts = cut(values, "value", groups)
    offsets = _offsets(counts, groups, False, moments)
    place = {q: F.lit(q) * (F.col("all") - 1) for q in at}
    wanted = F.lit(False)
    for p in place.values():
        for k in (F.floor(p), F.ceil(p)):
            wanted |= (F.col("offset") <= k) & (k < F.col("offset") + F.col("inside"))
    c = _placed(counts, offsets.where(wanted), groups, False)
    out = []
    for p in place.values():
        low, high = F.floor(p), F.ceil(p)
        here = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col("value")))
        part = F.max(p - low)
        out.append(F.when((part == 0) | (here(low) == here(high)), here(low)).otherwise(here(low) * (1 - part) + here(high) * part))
    more = [F.max("all").alias("n"), F.max("mean").alias("mean")] if moments else []
    return c.groupBy(*groups).agg(F.array(*out).alias("__q"), *more)


def quantiles(df: DataFrame, column: str, at: list[float]) -> DataFrame:
    """One row, __q: exact quantiles of one column; without values all are null."""
    return quantiles_by(df.select(F.col(column).alias("__v")), [], "__v", at)


def quantiles_of(df: DataFrame, columns: list[str], at: list[float]) -> DataFrame:
    """name, __q: exact quantiles of columns, all from one reading and the same shuffles; a column without values has nulls."""
    long = df.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in columns)).unpivot([], [f"`{c}`" for c in columns], "name", "value")
    names = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, columns))).alias("name"))
    got = quantiles_by(long, ["name"], "value", at)
    return names.join(got, "name", "left").select("name", F.coalesce("__q", F.array(*(F.lit(None).cast("double") for _ in at))).alias("__q"))
