"""Private synthesis: bucketing, noisy histograms and marginals, nearest-candidate votes, selection, evolution."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..sources.tables import settle
from .nearest import PIVOTS, SAMPLE, SLACK, Index, Metric, choose_pivots
from .ranks import quantiles

#: Rows of a small side that are sent whole to the tasks; more go by a shuffle.
MOST_SENT = 10_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_SENT else df


# --- bucketing and scaling ------------------------------------------------------------------


def top_or_other(df: DataFrame, column: str, k: int, other: str = "Other") -> DataFrame:
    """Keeps the k most frequent values (ties to the smaller), names the rest alike."""
    top = df.groupBy(column).agg(F.count("*").alias("__n")).where(F.col(column).isNotNull()).orderBy(F.desc("__n"), column).limit(k).select(F.col(column).alias("__top"))
    return df.join(_small(top, k), F.col(column) == F.col("__top"), "left").withColumn(column, F.when(F.col("__top").isNotNull(), F.col(column)).otherwise(other)).drop("__top")


def supported_or_other(df: DataFrame, column: str, key: str, least: int | None = None, top: int | None = None, other: str = "Other") -> DataFrame:
    """Keeps values that so many distinct keys have, or that are among the top by that number (ties to the smaller)."""
    n = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count_distinct(key).alias("__n"))
    good = n.where(F.col("__n") >= least) if least is not None else n.orderBy(F.desc("__n"), column).limit(top)
    good = good.select(F.col(column).alias("__good"))
    return df.join(good, F.col(column) == F.col("__good"), "left").withColumn(column, F.when(F.col("__good").isNotNull(), F.col(column)).otherwise(other)).drop("__good")


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """bin, n: equal-width bins between two quantiles; values outside go, the last bin is closed."""
    j = df.select(column).crossJoin(F.broadcast(quantiles(df, column, [low, high])))  # one row of edges
    lo, hi = F.element_at("__q", 1), F.element_at("__q", 2)
    width = F.nullif((hi - lo) / bins, F.lit(0.0))
    at = F.when(width.isNotNull(), F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    return j.where(F.col(column).between(lo, hi)).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def quantile_bins(df: DataFrame, column: str, bins: int) -> DataFrame:
    """column with its bin number: edges at quantiles, equal edges once; a column of one value has one bin."""
    q = quantiles(df, column, [i / bins for i in range(bins + 1)]).select(F.array_distinct("__q").alias("__e"))
    j = df.crossJoin(F.broadcast(q))  # one row of edges
    inner = F.slice("__e", F.lit(2), F.greatest(F.size("__e") - 2, F.lit(0)))
    return j.withColumn(f"{column}_bin", F.when(F.col(column).isNotNull(), F.size(F.filter(inner, lambda e: e < F.col(column))))).drop("__e")


def clipped_log(df: DataFrame, column: str, quantile: float) -> DataFrame:
    """log1p of the values clipped to 0 and a quantile."""
    j = df.crossJoin(F.broadcast(quantiles(df, column, [quantile])))  # one row
    x = F.when(F.col(column).isNotNull(), F.greatest(F.least(F.col(column), F.element_at("__q", 1)), F.lit(0.0)))
    return j.withColumn(column, F.log1p(x)).drop("__q")


def scale_unit(df: DataFrame, column: str) -> DataFrame:
    """log1p brought to 0..1 by its smallest and largest value."""
    j = df.crossJoin(F.broadcast(df.agg(F.min(F.log1p(column)).alias("__lo"), F.max(F.log1p(column)).alias("__hi"))))
    return j.withColumn(column, F.coalesce((F.log1p(column) - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)), F.lit(0.0))).drop("__lo", "__hi")


def unscale_unit(c: str | Column, low: float, high: float) -> Column:
    return F.expm1(S.col(c) * (high - low) + low)


def hurdle(df: DataFrame, columns: list[str]) -> DataFrame:
    """Zero flags and logs beside the columns."""
    return df.withColumns({f"{c}__is_zero": (F.col(c) <= 0).cast("int") for c in columns} | {f"{c}__log": F.log1p(F.greatest(F.col(c), F.lit(0.0))) for c in columns})


def signed_split(df: DataFrame, column: str) -> DataFrame:
    return df.withColumns({f"{column}_pos": F.greatest(F.col(column), F.lit(0.0)), f"{column}_neg": F.greatest(-F.col(column), F.lit(0.0))})


# --- noise ----------------------------------------------------------------------------------


def noisy_count(n: Column, sigma: float, key: str, seed: str | None = None) -> Column:
    return F.greatest(n + S.gaussian(key, seed, sigma), F.lit(0.0))


def noisy_mean(mean: Column, n: Column, value_range: float, sigma: float, key: str, seed: str | None = None) -> Column:
    """Sensitivity range / n, never below 0; unchanged without rows."""
    return F.when(n > 0, F.greatest(mean + S.gaussian(key, seed, sigma) * value_range / n, F.lit(0.0))).otherwise(mean)


def noisy_percentage(p: Column, n: Column, sigma: float, key: str, seed: str | None = None) -> Column:
    return F.when(n > 0, F.least(F.greatest(p + S.gaussian(key, seed, sigma) * 100.0 / n, F.lit(0.0)), F.lit(100.0))).otherwise(p)


# --- nearest candidates ---------------------------------------------------------------------

#: Weights of categories in the distance between devices; all others weigh 1.
CATEGORY_WEIGHTS = {"chassistype": 6.0, "countryname_normalized": 4.0, "os": 2.0}
#: Candidates that are sent whole to every task: beyond that, they are taken in portions.
MOST_CANDIDATES = 200_000
#: Candidates of a portion and distinct vectors of a block that meet in one group of rows.
PORTION, VECTOR_BLOCK = 40_960, 50_000


def _arrays(run: pa.RecordBatch, cats: bool) -> tuple[np.ndarray, np.ndarray | None]:
    x = np.array(run.column("x").to_pylist(), np.float64).reshape(run.num_rows, -1)
    return x, np.array(run.column("k").to_pylist(), str).reshape(run.num_rows, -1) if cats else None


def _meet(candidates: DataFrame, queries: DataFrame, metric: Metric, cats: bool) -> DataFrame:
    """candidates: portion, id, x, k; queries: portion, n, x, k -> x, k, n, dist, candidate_id: the nearest of the portion.

    A portion's queries are cut into blocks, and its candidates go to each of them: a
    task holds PORTION candidates or so, whatever the portion's share of the queries is.
    """
    blocks = queries.groupBy("portion").agg(F.ceil(F.count("*") / VECTOR_BLOCK).alias("blocks"))
    blocks = F.broadcast(blocks)  # a row for each portion
    left = candidates.join(blocks, "portion").select(F.lit(0).alias("side"), "portion", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"), "id", "x", "k")
    right = queries.join(blocks, "portion").select(F.lit(1).alias("side"), "portion", F.pmod(F.xxhash64("x", "k"), F.col("blocks")).cast("int").alias("block"), F.col("n").alias("id"), "x", "k")
    met = left.unionAll(right).repartition("portion", "block").sortWithinPartitions("portion", "block", "side")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, index = None, [], None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                side, portion, block = (part.column(c).to_numpy() for c in ("side", "portion", "block"))
                turns = np.flatnonzero((np.diff(side) != 0) | (np.diff(portion) != 0) | (np.diff(block) != 0)) + 1
                for lo, hi in zip([0, *turns.tolist()], [*turns.tolist(), part.num_rows], strict=True):
                    run = part.slice(lo, hi - lo)
                    if cell != (here := (portion[lo], block[lo])):
                        cell, held, index = here, [], None
                    ids, (x, k) = run.column("id").to_numpy(), _arrays(run, cats)
                    if side[lo] == 0:
                        held.append((ids, x, k))
                        continue
                    if index is None and held:
                        index = Index(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]) if cats else None, metric)
                        held = []
                    if index is not None:
                        found, dist = index.search(x, k)
                        yield pa.RecordBatch.from_arrays([run.column("x"), run.column("k"), pa.array(ids), pa.array(dist), pa.array(found)], names=["x", "k", "n", "dist", "candidate_id"])

    return met.mapInArrow(nearest, _NEAR)


_NEAR = "x array<double>, k array<string>, n long, dist double, candidate_id long"


def _best(near: DataFrame) -> DataFrame:
    best = near.groupBy("x", "k").agg(F.max("n").alias("n"), F.min(F.struct("dist", "candidate_id")).alias("best"))
    return best.select("x", "k", "n", "best.*")


def _in_portions(vectors: DataFrame, candidates: DataFrame, n_candidates: int, weight: np.ndarray | None = None, cat_weight: np.ndarray | None = None) -> DataFrame:
    """vectors: x, k; candidates: candidate_id, x, k (numbers and categories) -> candidate_id, votes.

    Pivots of a bounded sample cut the candidates into groups, and groups of more than PORTION into portions.
    A vector first meets the group of its nearest pivot; what it finds there bounds how far the nearest can be,
    and only groups that reach within that are met as well. Of all that are met the nearest counts (the smaller
    id among equals): the result of all pairs.
    """
    spark, cats, metric = vectors.sparkSession, cat_weight is not None, Metric(weight, cat_weight)
    distinct = vectors.groupBy("x", "k").agg(F.count("*").alias("n"))
    some = candidates.select("x", "k").orderBy(F.xxhash64("candidate_id"), "x", "k").limit(SAMPLE).collect()  # SAMPLE rows at most
    x = np.array([r["x"] for r in some], np.float64).reshape(len(some), -1)
    k = np.array([r["k"] for r in some], str).reshape(len(some), -1) if cats else None
    pivots = choose_pivots(x, k, metric, min(PIVOTS, max(1, -(-n_candidates // PORTION) * 4)))
    px, pk = x[pivots], k[pivots] if cats else None

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                run = batch.slice(at, 2000)
                d = metric.distances(*_arrays(run, cats), px, pk)
                yield pa.RecordBatch.from_arrays([pa.array(d.argmin(1)), pa.array(d.min(1)), *run.columns], names=["group", "far", *run.schema.names])

    grouped = candidates.select(F.col("candidate_id").cast("long").alias("id"), "x", "k").mapInArrow(around, "group long, far double, id long, x array<double>, k array<string>")
    facts = {r["group"]: (r["n"], r["far"]) for r in grouped.groupBy("group").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # a row for each pivot
    parts = np.array([-(-facts[g][0] // PORTION) if g in facts else 0 for g in range(len(px))])
    radius = np.array([facts[g][1] if g in facts else -np.inf for g in range(len(px))])
    before = np.concatenate([[0], np.cumsum(parts)])
    begins, counts = (F.array(*(F.lit(int(v)) for v in a)) for a in (before[:-1], np.maximum(parts, 1)))
    at = F.col("group").cast("int") + 1
    dealt = grouped.select((F.element_at(begins, at) + F.pmod(F.xxhash64("id"), F.element_at(counts, at))).cast("long").alias("portion"), "id", "x", "k")

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The portions to meet: of the nearest group while nothing is found yet, then of all others in reach."""
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                run = batch.slice(at, 500)
                to = metric.distances(*_arrays(run, cats), px, pk)
                to[:, parts == 0] = np.inf
                first = to.argmin(1)
                own = np.arange(len(px))[None, :] == first[:, None]
                if "dist" in run.schema.names:
                    meet = (to - radius[None, :] <= run.column("dist").to_numpy()[:, None] + SLACK) & ~own & (parts > 0)[None, :]
                else:
                    meet = own
                row, group = np.nonzero(meet)
                row = np.repeat(row, parts[group])
                portion = np.concatenate([np.arange(before[g], before[g + 1]) for g in group]) if len(group) else np.zeros(0, np.int64)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(portion.astype(np.int64)), *(run.column(c).take(take) for c in ("n", "x", "k"))], names=["portion", "n", "x", "k"])

    way = "portion long, n long, x array<double>, k array<string>"
    near = settle(_best(_meet(dealt, distinct.mapInArrow(ways, way), metric, cats)))
    far = _meet(dealt, near.mapInArrow(ways, way), metric, cats)
    best = _best(near.select("x", "k", "n", "dist", "candidate_id").unionAll(far))
    return best.groupBy("candidate_id").agg(F.sum("n").alias("votes"))


def _every_candidate(candidates: DataFrame, votes: DataFrame) -> DataFrame:
    return candidates.select(F.col("candidate_id").cast("long").alias("candidate_id")).join(votes, "candidate_id", "left").select("candidate_id", F.coalesce("votes", F.lit(0)).alias("votes"))


def vector_votes(vectors: DataFrame, candidates: DataFrame, column: str) -> DataFrame:
    """candidate_id, votes: how many vectors are nearest to each candidate, every candidate with a bin."""
    spark = vectors.sparkSession
    n = candidates.count()
    if n > MOST_CANDIDATES:
        plain = lambda df, *c: df.select(*c, F.col(column).cast("array<double>").alias("x"), F.array().cast("array<string>").alias("k"))
        return _every_candidate(candidates, _in_portions(plain(vectors), plain(candidates, "candidate_id"), n))
    got = candidates.select("candidate_id", column).orderBy("candidate_id").collect()  # MOST_CANDIDATES at most
    if not got:
        return _every_candidate(candidates, candidates.select(F.lit(0).cast("long").alias("candidate_id"), F.lit(0).cast("long").alias("votes")).limit(0))
    sent = spark.sparkContext.broadcast(Index(np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got], np.float64), None, Metric()))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                found, _ = sent.value.search(np.array(batch.column(0).slice(begin, 500).to_pylist(), np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(found)], names=["candidate_id"])

    votes = vectors.select(column).mapInArrow(vote, "candidate_id long").groupBy("candidate_id").agg(F.count("*").alias("votes"))
    return _every_candidate(candidates, votes)


def device_votes(real: DataFrame, candidates: DataFrame, numeric: list[str], categories: list[str]) -> DataFrame:
    """Votes by the distance between devices: numbers scaled to the real range (clipped to 0..1), categories by mismatch, weights in parts of their sum."""
    spark = real.sparkSession
    bounds = real.agg(*(F.min(c).cast("double").alias(f"lo{i}") for i, c in enumerate(numeric)), *(F.max(c).cast("double").alias(f"hi{i}") for i, c in enumerate(numeric))).first()
    lo = np.array([bounds[f"lo{i}"] or 0.0 for i in range(len(numeric))])
    span = np.maximum(np.array([bounds[f"hi{i}"] or 0.0 for i in range(len(numeric))]) - lo, 1e-10)
    cat_weight = np.array([CATEGORY_WEIGHTS.get(c, 1.0) for c in categories])
    whole = cat_weight.sum() + len(numeric)
    weight = np.full(len(numeric), 1 / whole)
    n = candidates.count()
    if n > MOST_CANDIDATES:
        number = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
        x = F.array(*(F.least(F.greatest((number(c) - float(lo[i])) / float(span[i]), F.lit(0.0)), F.lit(1.0)) for i, c in enumerate(numeric))).cast("array<double>")
        k = F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("Unknown")) for c in categories)).cast("array<string>")
        shaped = lambda df, *c: df.select(*c, x.alias("x"), k.alias("k"))
        return _every_candidate(candidates, _in_portions(shaped(real), shaped(candidates, "candidate_id"), n, weight, cat_weight / whole if categories else None))
    got = candidates.select("candidate_id", *numeric, *categories).orderBy("candidate_id").toPandas()  # MOST_CANDIDATES at most
    if got.empty:
        return _every_candidate(candidates, real.select(F.lit(0).cast("long").alias("candidate_id"), F.lit(0).cast("long").alias("votes")).limit(0))
    scale = lambda pdf: np.clip((pdf[numeric].fillna(0).to_numpy(np.float64) - lo) / span, 0, 1)
    named = lambda pdf: pdf[categories].fillna("Unknown").to_numpy(str) if categories else None
    sent = spark.sparkContext.broadcast(Index(got["candidate_id"].to_numpy(np.int64), scale(got), named(got), Metric(weight, cat_weight / whole if categories else None)))

    def vote(pdfs):
        for pdf in pdfs:
            found, _ = sent.value.search(scale(pdf), named(pdf))
            yield pdf[[]].assign(candidate_id=found)

    votes = real.select(*numeric, *categories).mapInPandas(vote, "candidate_id long").groupBy("candidate_id").agg(F.count("*").alias("votes"))
    return _every_candidate(candidates, votes)


def noisy_votes(votes: DataFrame, sigma: float, seed: str | None = None) -> DataFrame:
    return votes.withColumn("votes", F.greatest(F.col("votes") + S.gaussian("candidate_id", seed, sigma), F.lit(0.0)))


def select_ranked(votes: DataFrame, n: int) -> DataFrame:
    return votes.orderBy(F.desc("votes"), F.desc("candidate_id")).limit(n)


def select_sampled(votes: DataFrame, n: int, seed: str) -> DataFrame:
    """n draws with replacement in proportion to the votes (evenly if there are none): draw, candidate_id.

    Candidates get intervals of the running sum, laid out over groups of candidates so
    that no task sums them all; draws fall into them by an equality on the group
    before the range.
    """
    spark = votes.sparkSession
    v = votes.crossJoin(F.broadcast(votes.agg(F.sum("votes").alias("__all"))))  # one row
    v = v.withColumn("w", F.when(F.col("__all") > 0, F.col("votes")).otherwise(F.lit(1.0))).withColumn("g", F.pmod(F.xxhash64("candidate_id"), F.lit(256)))
    groups = v.groupBy("g").agg(F.sum("w").alias("gw"))
    gw = groups.withColumn("hi", F.sum("gw").over(Window.orderBy("g"))).withColumn("lo", F.col("hi") - F.col("gw")).withColumn("all", F.sum("gw").over(Window.partitionBy(F.lit(1))))  # 256 rows
    draws = spark.range(n).select(F.col("id").alias("draw"), S.uniform("id", seed).alias("u"))
    placed = draws.join(F.broadcast(gw), (F.col("u") * F.col("all") > F.col("lo")) & (F.col("u") * F.col("all") <= F.col("hi"))).withColumn("x", F.col("u") * F.col("all") - F.col("lo"))
    run = Window.partitionBy("g").orderBy("candidate_id")
    inner = v.withColumn("b", F.sum("w").over(run)).withColumn("a", F.col("b") - F.col("w")).select("g", "candidate_id", "a", "b")
    return placed.join(inner, "g").where((F.col("x") > F.col("a")) & (F.col("x") <= F.col("b"))).select("draw", "candidate_id")


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """Distinct numbers for rows, the same ones in any layout of the table: within groups by hash, so that no task orders all rows."""
    groups = 1024
    x = df.withColumn("__g", F.pmod(F.xxhash64(*df.columns), F.lit(groups)))
    at = F.row_number().over(Window.partitionBy("__g").orderBy(*df.columns))
    return x.withColumn(name, (F.col("__g") + groups * at).cast("long")).drop("__g")


def evolve(real: DataFrame, first: DataFrame, vary: Callable[[DataFrame, int], DataFrame], rounds: int, keep: int, sigma: float, numeric: list[str], categories: list[str], seed: str | None, save: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Private evolution: vote, keep the best, vary them, again. vary makes candidates (without ids) from parents; save writes a round where a rerun finds it."""
    pool = first
    for k in range(rounds):
        votes = noisy_votes(device_votes(real, pool, numeric, categories), sigma, None if seed is None else f"{seed}-{k}")
        parents = pool.join(_small(select_ranked(votes, keep).select("candidate_id"), keep), "candidate_id", "left_semi")
        if k == rounds - 1:
            return save(parents, k)
        children = vary(parents, k).drop("candidate_id")
        both = parents.drop("candidate_id").unionByName(children)
        pool = save(_numbered(both, "candidate_id"), k)
    return pool


# --- marginals ------------------------------------------------------------------------------


def marginal(df: DataFrame, column: str, epsilon: float, bins: int = 20, seed: str | None = None) -> DataFrame:
    """lo, hi, p: Laplace-noisy histogram of a numeric column between its first and last percentile."""
    edges = quantiles(df, column, [0.01, 0.99]).select(F.element_at("__q", 1).alias("lo"), ((F.element_at("__q", 2) - F.element_at("__q", 1)) / bins).alias("w"))
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin").crossJoin(F.broadcast(edges))  # bins rows
    n = every.join(histogram(df, column, bins, 0.01, 0.99), "bin", "left")
    noisy = n.withColumn("c", F.greatest(F.coalesce("n", F.lit(0)) + S.laplace("bin", seed, 1 / epsilon), F.lit(0.0)))
    p = S.ratio("c", F.sum("c").over(Window.partitionBy(F.lit(1))))
    return noisy.select((F.col("lo") + F.col("bin") * F.col("w")).alias("lo"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("hi"), F.coalesce(p, F.lit(1.0 / bins)).alias("p"))


def category_marginal(df: DataFrame, columns: list[str], epsilon: float, seed: str | None = None) -> DataFrame:
    """The joint noisy shares of the columns' values."""
    n = df.groupBy(*columns).agg(F.count("*").alias("__n")).withColumn("__k", F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))
    noisy = n.withColumn("__c", F.greatest(F.col("__n") + S.laplace("__k", seed, 1 / epsilon), F.lit(0.0)))
    return noisy.crossJoin(F.broadcast(noisy.agg(F.sum("__c").alias("__all")))).select(*columns, S.ratio("__c", "__all").alias("p"))  # one row


def sample_marginal(dist: DataFrame, n: int, seed: str, numeric: bool) -> DataFrame:
    """n rows drawn from a marginal; numbers are even within their bin. A marginal of few rows is sent whole, a larger one is drawn from by groups."""
    cols = [c for c in dist.columns if c != "p"]
    if dist.count() > MOST_SENT:
        rows = _numbered(dist, "candidate_id")
        j = select_sampled(rows.select("candidate_id", F.col("p").alias("votes")), n, seed).join(rows, "candidate_id").withColumn("__j", S.uniform("draw", seed + "j")).withColumnRenamed("draw", "id")
        return j.select("id", (F.col("lo") + F.col("__j") * (F.col("hi") - F.col("lo"))).alias("value")) if numeric else j.select("id", *cols)
    run = Window.orderBy(*cols)  # a marginal has few rows
    cdf = dist.withColumn("__b", F.sum("p").over(run)).withColumn("__a", F.col("__b") - F.col("p"))
    draws = dist.sparkSession.range(n).select("id", S.uniform("id", seed).alias("__u"), S.uniform("id", seed + "j").alias("__j"))
    j = draws.join(F.broadcast(cdf), (F.col("__u") > F.col("__a")) & (F.col("__u") <= F.col("__b")))
    return j.select("id", (F.col("lo") + F.col("__j") * (F.col("hi") - F.col("lo"))).alias("value")) if numeric else j.select("id", *cols)


def _how_many(key: str, mean: float, seed: str) -> Column:
    """A Poisson number for each key, at least 1."""
    u = S.uniform(key, seed + "n")
    terms, p, cdf = [], float(np.exp(-mean)), 0.0
    for k in range(int(mean + 10 * np.sqrt(mean) + 10)):
        cdf += p
        terms.append(F.when(u > cdf, 1).otherwise(0))
        p *= mean / (k + 1)
    return F.greatest(S.total(terms), F.lit(1))


def fan_out(entities: DataFrame, key: str, items: DataFrame, item: str, weight: str, mean: float, seed: str) -> DataFrame:
    """Items of each entity without replacement: the number is Poisson (at least 1), the choice by weight (exponential race), shares add up to 1.

    A vocabulary of up to MOST_SENT items goes to the entities as one list, from which each takes its own. In a
    larger one an entity draws its own items only (operators/fan.py): the chances are the same.
    """
    if items.limit(MOST_SENT + 1).count() > MOST_SENT:
        from .fan import draw_items

        return draw_items(entities.select(key, _how_many(key, mean, seed).alias("__n")), key, items, item, weight, seed)
    race = lambda x: -F.log(S.uniform(F.concat_ws(":", F.col(key).cast("string"), x["i"].cast("string")), seed)) / F.greatest(x["w"], F.lit(1e-12))
    vocabulary = items.agg(F.collect_list(F.struct(F.col(item).alias("i"), F.col(weight).cast("double").alias("w"))).alias("__items"))
    # keys are few bytes and much work: a number of parts is named, or one task would have them all
    parts = max(int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions")), entities.sparkSession.sparkContext.defaultParallelism)
    spread = entities.select(key).repartition(parts, key).withColumn("__n", _how_many(key, mean, seed))
    j = spread.crossJoin(F.broadcast(vocabulary))  # one row
    first = F.slice(F.sort_array(F.transform("__items", lambda x: F.struct(race(x).alias("e"), x["i"].alias("i")))), F.lit(1), F.col("__n"))
    g = lambda x: -F.log(S.uniform(F.concat_ws(":", F.col(key).cast("string"), x["i"].cast("string")), seed + "s"))
    j = j.select(key, F.transform(first, lambda x: F.struct(x["i"].alias("i"), g(x).alias("g"))).alias("__x"))
    whole = F.aggregate("__x", F.lit(0.0), lambda a, x: a + x["g"])
    j = j.select(key, "__x", whole.alias("__all"))
    return j.select(key, "__all", F.explode("__x").alias("__x")).select(key, F.col("__x.i").alias(item), S.ratio(F.col("__x.g"), F.col("__all")).alias("share"))


def assign_keys(rows: DataFrame, row_key: str, devices: DataFrame, key: str, seed: str) -> DataFrame:
    """rows with a device each, no device twice; rows beyond the number of devices go. Both sides are put in random order and meet by their place."""
    from .evaluate import ranked_by_hash

    left = ranked_by_hash(rows, row_key, seed + "r").drop("__all")
    right = ranked_by_hash(devices.select(key).distinct(), key, seed + "d").drop("__all")
    return left.join(right, "__r").drop("__r")


def assign_by_rate(rows: DataFrame, row_key: str, devices: DataFrame, key: str, rate: float, seed: str) -> DataFrame:
    """rows, all of them, with a device each: of a drawn part of the devices (the rate at which the real table joins, at least one).

    While there are devices enough no device comes twice; with more rows, each draws one of the part,
    with replacement. Both orders are counted by parts of a hash, so no task puts all rows in order.
    """
    from .evaluate import ranked_by_hash

    part = ranked_by_hash(devices.select(key).distinct(), key, seed + "d").withColumn("__k", F.greatest(F.lit(1), F.floor(F.lit(rate) * F.col("__all"))))
    part = part.where(F.col("__r") <= F.col("__k")).select(key, F.col("__r").alias("__place"), "__k")
    size = part.agg(F.max("__k").alias("__k"))
    placed = ranked_by_hash(rows, row_key, seed + "r").crossJoin(F.broadcast(size))  # one row
    drawn = 1 + F.floor(S.uniform(row_key, seed + "u") * F.col("__k"))
    placed = placed.withColumn("__place", F.when(F.col("__all") <= F.col("__k"), F.col("__r")).otherwise(drawn)).drop("__r", "__all", "__k")
    return placed.join(part.drop("__k"), "__place").drop("__place")


def sanitize(df: DataFrame, numeric: list[str], categories: list[str]) -> DataFrame:
    """Records as a generator may return them, put in shape: missing or unreadable numbers 0, none below 0, missing categories "Unknown"."""
    num = {c: F.greatest(S.number_or(F.col(c).cast("string"), 0.0), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in numeric}
    cat = {c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("Unknown")) if c in df.columns else F.lit("Unknown") for c in categories}
    return df.withColumns(num | cat)


def features(df: DataFrame, numeric: list[str], categories: list[str], top: int = 50, quantile: float = 0.999) -> DataFrame:
    """df with a features vector, fitted on itself: rare categories in one place and one-hot, numbers clipped, logged and standardised."""
    from .features import fit

    return fit(df, numeric, categories, top, quantile).transform(df)
