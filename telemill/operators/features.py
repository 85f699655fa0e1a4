"""Feature vectors from wide rows, and wide rows from feature vectors.

What is fitted (kept values, clip points, means, deviations) is small, plain and can be
saved; applying it and its inverse are expressions of the JVM, a row at a time.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import semantics as S
from .ranks import quantiles_of

TOP, QUANTILE, OTHER = 50, 0.999, "Other"


class Prepared(NamedTuple):
    """categories: column -> values, in the order of their places; the place after them is for all others. numeric: column -> clip point (null: none), mean and deviation of the logs."""

    categories: dict[str, list[str]]
    numeric: dict[str, tuple[float | None, float, float]]

    @property
    def size(self) -> int:
        return sum(len(v) + 1 for v in self.categories.values()) + len(self.numeric)

    def _log(self, column: str) -> Column:
        clip, _, _ = self.numeric[column]
        x = F.coalesce(F.nanvl(F.col(f"`{column}`").cast("double"), F.lit(0.0)), F.lit(0.0))
        return F.log1p(F.greatest(x if clip is None else F.least(x, F.lit(clip)), F.lit(0.0)))

    def transform(self, df: DataFrame, output: str = "features") -> DataFrame:
        """df with an array of size numbers: one place for each value of each category, then the standardised logs. Missing and unknown values are others, missing numbers 0."""
        parts = [_one_hot(_place(c, values), len(values) + 1) for c, values in self.categories.items()]
        if self.numeric:
            parts.append(F.array(*((self._log(c) - mean) / std for c, (_, mean, std) in self.numeric.items())))
        return df.withColumn(output, F.concat(*parts))

    def inverse(self, df: DataFrame, column: str = "features", seed: str | None = None, key: str | None = None) -> DataFrame:
        """df with the columns in place of the vector: the value of the largest place (the first of equals), or, with a seed, one drawn in proportion to exp of the places; numbers back from their logs, none below 0."""
        out, at = [c for c in df.columns if c != column], 0
        shown = []
        for c, values in self.categories.items():
            places = F.slice(column, at + 1, len(values) + 1)
            at += len(values) + 1
            if seed is None:
                place = F.array_position(places, F.array_max(places))
            else:
                top = F.array_max(places)
                upto = F.transform(F.sequence(F.lit(1), F.lit(len(values) + 1)), _running(places, top))
                u = S.uniform(F.concat_ws(":", F.col(f"`{key}`").cast("string"), F.lit(c)), seed) * F.element_at(upto, -1)
                place = F.size(F.filter(upto, _below(u))) + 1
            shown.append(F.element_at(F.array(*map(F.lit, [*values, OTHER])), F.least(place, F.lit(len(values) + 1)).cast("int")).alias(c))
        for k, (c, (_, mean, std)) in enumerate(self.numeric.items()):
            shown.append(F.greatest(F.expm1(F.element_at(column, at + k + 1) * std + mean), F.lit(0.0)).alias(c))
        return df.select(*(F.col(f"`{c}`") for c in out), *shown)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(self._asdict()),)], "fitted string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Prepared:
        told = json.loads(spark.read.text(path).first()[0])
        return cls(told["categories"], {c: tuple(v) for c, v in told["numeric"].items()})


def _place(column: str, values: list[str]) -> Column:
    at = F.array_position(F.array(*map(F.lit, values)).cast("array<string>"), F.col(f"`{column}`").cast("string"))
    return F.when(at > 0, at).otherwise(len(values) + 1)


def _one_hot(place: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: (i == place).cast("double"))


def _running(places: Column, top: Column):
    """The sums of exp over the first places, in parts of the largest."""
    return lambda i: F.aggregate(F.slice(places, F.lit(1), i), F.lit(0.0), lambda a, v: a + F.exp(v - top))


def _below(u: Column):
    return lambda s: s <= u


def fit(df: DataFrame, numeric: list[str], categories: list[str], top: int = TOP, quantile: float = QUANTILE) -> Prepared:
    """Kept values, the most frequent of each category (ties to the smaller), clip points at the quantile, and moments of the clipped logs: three readings for all columns together. To the driver come top values a category and a few numbers a column."""
    kept: dict[str, list[str]] = {c: [] for c in categories}
    if categories:
        long = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in categories)).unpivot([], [f"`{c}`" for c in categories], "column", "value").where("value is not null")
        n = long.groupBy("column", "value").agg(F.count("*").alias("n"))
        best = n.withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("r") <= top)
        for r in best.collect():
            kept[r["column"]].append(r["value"])
    clips: dict[str, float | None] = dict.fromkeys(numeric)
    if numeric:
        for r in quantiles_of(df, numeric, [quantile]).collect():
            clips[r["name"]] = r["__q"][0] if r["__q"][0] is not None and r["__q"][0] > 0 else None
    plain = Prepared({c: sorted(v) for c, v in kept.items()}, {c: (clips[c], 0.0, 1.0) for c in numeric})
    if not numeric:
        return plain
    moments = df.select(*(plain._log(c).alias(f"x{i}") for i, c in enumerate(numeric))).agg(*(f(f"x{i}").alias(f"{n}{i}") for i in range(len(numeric)) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return plain._replace(numeric={c: (clips[c], moments[f"m{i}"] or 0.0, moments[f"s{i}"] or 1.0) for i, c in enumerate(numeric)})
