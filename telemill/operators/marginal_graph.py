"""Synthesis from a tree of two-way marginals.

Columns become codes of small domains. Noisy counts of all pairs of columns, counted in
one pass, say how much each pair shares (mutual information); the maximum spanning tree
of that is kept. Its edges are counted again with the rest of the budget, and records
are drawn down the tree, each column given its parent's code.

Domains are public: values of a category are named, or the most frequent MOST_VALUES - 1
are taken as known; numbers have given bounds. Every cell of a pair's table takes noise,
the empty ones too. A pair's table has MOST_VALUES squared cells at most, so all tables
of a tree go to the tasks as one row.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import privacy
from ..functions import semantics as S

MOST_VALUES, MOST_COLUMNS = 64, 100
OTHER = "Other"


class Domain(NamedTuple):
    """A column's codes: of the values, and one more for all others; or of bins of equal width, and one more for nulls."""

    column: str
    values: tuple[str, ...] = ()
    low: float = 0.0
    high: float = 0.0
    bins: int = 0

    @property
    def size(self) -> int:
        return (self.bins or len(self.values)) + 1

    def code(self) -> Column:
        c = F.col(f"`{self.column}`")
        if self.bins:
            at = F.floor((c.cast("double") - self.low) / (self.high - self.low) * self.bins)
            known = c.isNotNull() & ~F.isnan(c.cast("double"))
            return F.when(known, F.least(F.greatest(at, F.lit(0)), F.lit(self.bins - 1))).otherwise(self.bins).cast("int")
        known = F.array_position(F.array(*map(F.lit, self.values)).cast("array<string>"), c.cast("string")).cast("int")
        return F.when(known > 0, known - 1).otherwise(len(self.values)).cast("int")

    def decode(self, code: Column, u: Column) -> Column:
        """The value of a code; within a bin by u (0..1)."""
        if self.bins:
            width = (self.high - self.low) / self.bins
            return F.when(code < self.bins, F.lit(self.low) + (code + u) * width)
        return F.when(code < len(self.values), F.element_at(F.array(*map(F.lit, self.values)).cast("array<string>"), F.least(code + 1, F.lit(max(len(self.values), 1))))).otherwise(OTHER) if self.values else F.lit(OTHER)


def frequent(df: DataFrame, columns: list[str], most: int = MOST_VALUES - 1) -> list[Domain]:
    """Domains of the most frequent values of each column, ties to the smaller; to the driver go most values a column."""
    out = []
    for c in columns:
        rows = df.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").cast("string").alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(most).collect()
        out.append(Domain(c, tuple(sorted(r["v"] for r in rows))))
    return out


def _checked(domains: list[Domain]) -> None:
    if not 2 <= len(domains) <= MOST_COLUMNS:
        raise ValueError(f"2 to {MOST_COLUMNS} columns, not {len(domains)}")
    for d in domains:
        if d.size > MOST_VALUES or (d.bins and not d.high > d.low):
            raise ValueError(f"{d.column}: at most {MOST_VALUES} codes, over bounds that differ")


def pair_counts(df: DataFrame, domains: list[Domain], pairs: list[tuple[int, int]]) -> DataFrame:
    """i, j, a, b, n: how often each pair of codes stands in the columns i and j; cells that don't occur have 0. One pass for all pairs."""
    codes = df.select(F.array(*(d.code() for d in domains)).alias("c"))
    cell = lambda i, j: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.element_at("c", i + 1).alias("a"), F.element_at("c", j + 1).alias("b"))
    counted = codes.select(F.explode(F.array(*(cell(i, j) for i, j in pairs))).alias("x")).groupBy("x.i", "x.j", "x.a", "x.b").agg(F.count("*").alias("n"))
    sizes = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(domains[i].size).alias("m"), F.lit(domains[j].size).alias("k")) for i, j in pairs))
    grid = df.sparkSession.range(1).select(F.explode(sizes).alias("s")).select("s.*", F.explode(F.sequence(F.lit(0), F.col("s.m") - 1)).alias("a"))
    grid = grid.select("i", "j", "a", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("b"))
    return grid.join(counted, ["i", "j", "a", "b"], "left").select("i", "j", "a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def noisy(counts: DataFrame, sigma: float, seed: str | None) -> DataFrame:
    """The counts with Gaussian noise, none below 0."""
    return counts.withColumn("n", F.greatest(F.col("n") + S.gaussian(F.concat_ws(":", "i", "j", "a", "b"), seed, sigma), F.lit(0.0)))


def mutual_information(counts: DataFrame) -> DataFrame:
    """i, j, mi (nats) of each pair's table; 0 for an empty one."""
    whole, left, right = (counts.groupBy("i", "j", *k).agg(F.sum("n").alias(f"n{len(k)}{k[0] if k else ''}")) for k in ([], ["a"], ["b"]))
    x = counts.join(whole, ["i", "j"]).join(left, ["i", "j", "a"]).join(right, ["i", "j", "b"])
    p = F.col("n") / F.nullif(F.col("n0"), F.lit(0.0))
    term = F.when(F.col("n") > 0, p * F.log(F.col("n") * F.col("n0") / (F.col("n1a") * F.col("n1b")))).otherwise(0.0)
    return x.groupBy("i", "j").agg(F.greatest(F.coalesce(F.sum(term), F.lit(0.0)), F.lit(0.0)).alias("mi"))


def spanning_tree(weights: dict[tuple[int, int], float], columns: int) -> list[tuple[int, int]]:
    """(parent, child) in the order in which a tree of the greatest weight grows from column 0; among equal weights the smaller pair."""
    inside, out = {0}, []
    while len(inside) < columns:
        best = min((-round(w, 9), p, c) for (i, j), w in weights.items() for p, c in ((i, j), (j, i)) if p in inside and c not in inside)
        out.append(best[1:])
        inside.add(best[2])
    return out


class Model(NamedTuple):
    """A tree and the probabilities of each column's codes: of the root one row, of the others one for each code of the parent."""

    domains: list[Domain]
    tree: list[tuple[int, int]]
    tables: dict[int, list[list[float]]]


def fit(df: DataFrame, domains: list[Domain], ledger: privacy.Ledger, rho: float | None = None, seed: str | None = None) -> Model:
    """The tree and its tables for rho of the ledger (all that is left, if not told): half for the choice of edges, half for the tables.

    To the driver come a number for each pair of columns, and the cells of the tree's tables.
    """
    _checked(domains)
    rho = ledger.left if rho is None else rho
    ledger.charge(("edges", rho / 2), ("tables", rho / 2))
    pairs = [(i, j) for i in range(len(domains)) for j in range(i + 1, len(domains))]
    seed = S.fresh_seed() if seed is None else seed
    first = noisy(pair_counts(df, domains, pairs), privacy.zcdp_sigma(len(pairs), rho / 2), seed + "e")
    weights = {(r["i"], r["j"]): r["mi"] for r in mutual_information(first).collect()}
    tree = spanning_tree(weights, len(domains))
    edges = [(min(e), max(e)) for e in tree]
    second = noisy(pair_counts(df, domains, edges), privacy.zcdp_sigma(len(edges), rho / 2), seed + "t")
    cells = {(r["i"], r["j"], r["a"], r["b"]): r["n"] for r in second.collect()}
    n = lambda p, c, a, b: cells[(p, c, a, b) if p < c else (c, p, b, a)]
    tables = {c: [_shares([n(p, c, a, b) for b in range(domains[c].size)]) for a in range(domains[p].size)] for p, c in tree}
    p, c = tree[0]
    tables[0] = [_shares([sum(n(p, c, a, b) for b in range(domains[c].size)) for a in range(domains[p].size)])]
    return Model(list(domains), tree, tables)


def _shares(n: list[float]) -> list[float]:
    """Parts of the sum; even where there is none."""
    whole = math.fsum(n)
    return [x / whole if whole > 0 else 1 / len(n) for x in n]


def draw(spark: SparkSession, model: Model, n: int, seed: str) -> DataFrame:
    """id and the model's columns: n records down the tree. The same seed gives the same records, in any layout."""
    upto = {}
    for c, rows in model.tables.items():
        upto[c] = []
        for r in rows:
            sums, total = [], 0.0
            for x in r[:-1]:
                total += x
                sums.append(total)
            upto[c].append(sums)
    one = spark.createDataFrame([tuple(upto[c] for c in range(len(model.domains)))], ", ".join(f"t{c} array<array<double>>" for c in range(len(model.domains))))
    x = spark.range(n).crossJoin(F.broadcast(one))  # one row of tables
    u = lambda c, what: S.uniform(F.concat_ws(":", F.col("id").cast("string"), F.lit(f"{c}{what}")), seed)
    parents = {c: p for p, c in model.tree}

    def code(c: int) -> Column:
        row = F.element_at(f"t{c}", F.col(f"c{parents[c]}") + 1 if c in parents else F.lit(1))
        place = u(c, "c")
        return F.size(F.filter(row, lambda s: s <= place)).alias(f"c{c}")

    for level in _levels(model.tree):
        # all columns of a level in one step
        x = x.select("*", *map(code, level))
    return x.select("id", *(d.decode(F.col(f"c{c}"), u(c, "v")).alias(d.column) for c, d in enumerate(model.domains)))


def _levels(tree: list[tuple[int, int]]) -> list[list[int]]:
    depth = {0: 0}
    for p, c in tree:
        depth[c] = depth[p] + 1
    return [sorted(c for c, k in depth.items() if k == level) for level in range(max(depth.values()) + 1)]


def table_distance(real: DataFrame, drawn: DataFrame, domains: list[Domain]) -> DataFrame:
    """left, right, total_variation: how far the two-way tables of two sets of rows are from each other, for every pair of columns."""
    pairs = [(i, j) for i in range(len(domains)) for j in range(i + 1, len(domains))]
    share = lambda df: df.withColumn("p", F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy("i", "j")), F.lit(0)))
    a, b = share(pair_counts(real, domains, pairs)), share(pair_counts(drawn, domains, pairs))
    j = a.select("i", "j", "a", "b", F.col("p").alias("x")).join(b.select("i", "j", "a", "b", F.col("p").alias("y")), ["i", "j", "a", "b"])
    names = F.array(*(F.lit(d.column) for d in domains))
    return j.groupBy("i", "j").agg((0.5 * F.sum(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))))).alias("total_variation")).select(F.element_at(names, F.col("i") + 1).alias("left"), F.element_at(names, F.col("j") + 1).alias("right"), "total_variation")

