"""Approximate nearest neighbours by a permutation index.

PIVOTS vectors, spread over a bounded sample by farthest-first choice, order
every vector: its PREFIX nearest pivots, nearest first, stand for it. The index
is a table of all vectors with these prefixes, written once. A search reads it in
segments and posts each in inverted files, one for each pivot, with the pivot's
place in the vector's order; a file holds PREFIX / PIVOTS of the rows. A query
walks the files of its own PREFIX pivots and adds up the footrule distance
(pivots that one side lacks count as at place PREFIX). Rows near enough by
footrule are ranked again by the exact distance in double precision. Near enough
is what the nearest SHARE of the sample reach (more where that would be fewer
than CANDIDATES rows of the table), so the rows looked at don't depend on how
the table is cut. A task keeps TOP rows a query; the best TOP of those are the
result. A query that finds fewer than there are is searched again with every row
as a candidate.

Only queries go to the tasks, in blocks of about QUERY_BLOCK, so what is sent is
bounded however many there are; vectors never leave their partition, so one
vector that is very common costs nothing but its rows.

Defined results: vectors that are null, empty, all zero, or hold null or
non-finite components take no part; nor do those of another length than most of
the sample. With no usable vector there are no rows; with fewer candidates than
TOP, all are returned. Rows with the same vec_id are candidates each; as a
query a repeated vec_id counts once (its smallest vector), and of the rows that
equal it in both vec_id and vector one is its own and no candidate. A null
vec_id is a candidate, reported as null, after the others in ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SAMPLE, PIVOTS, PREFIX = 2000, 1024, 64
CANDIDATES, SHARE, TOP, EVERY = 300, 0.09, 10, 100
QUERY_BLOCK, SEGMENT, SEED = 8192, 8192, 41

_FOUND = "query_id long, vec_id long, score double"
_LAST = np.iinfo(np.int64).max


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def choose_pivots(sample: np.ndarray) -> np.ndarray:
    """Farthest-first from the sample's first row, half of the sample at most; ends early when all that is left is a copy."""
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(PIVOTS, max(1, len(sample) // 2)):
        k = int(near.argmax())
        if near[k] <= 0:
            break
        chosen.append(k)
        near = np.minimum(near, ((sample - sample[k]) ** 2).sum(1))
    return sample[chosen]


def orders(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (vectors**2).sum(1)[:, None] - 2 * vectors @ pivots.T + (pivots**2).sum(1)[None, :]
    return np.argsort(d, axis=1, kind="stable")[:, :PREFIX].astype(np.int16)


class Files:
    """The inverted files of some vectors' prefixes."""

    def __init__(self, prefix: np.ndarray, pivots: int):
        self.n, self.k = prefix.shape
        flat = prefix.ravel()
        order = np.argsort(flat, kind="stable")
        self.rows, self.places = (order // max(self.k, 1)).astype(np.int32), (order % max(self.k, 1)).astype(np.int32)
        self.cuts = np.searchsorted(flat[order], np.arange(pivots + 1))

    def saved(self, order: np.ndarray) -> np.ndarray:
        """What each row's footrule distance to a query is below that of sharing no pivot: a shared one at places a, b takes off (k - a) + (k - b) - |a - b|."""
        lo, hi = self.cuts[order], self.cuts[order + 1]
        size = hi - lo
        at = np.arange(int(size.sum())) + np.repeat(lo - (np.cumsum(size) - size), size)
        a, b = np.repeat(np.arange(len(order)), size), self.places[at]
        return np.bincount(self.rows[at], 2 * self.k - a - b - np.abs(a - b), self.n)


def bounds(sample: np.ndarray, pivots: np.ndarray, query_orders: np.ndarray, share: float) -> np.ndarray:
    """For each query the saving that the nearest share of the sample reach."""
    files = Files(orders(sample, pivots), len(pivots))
    want = int(np.ceil(share * len(sample)))
    if want >= len(sample):
        return np.zeros(len(query_orders))
    return np.array([np.partition(files.saved(o), len(sample) - want)[len(sample) - want] for o in query_orders])


class _Best:
    """The nearest TOP + 1 rows of each query so far (its own row may be one of them)."""

    def __init__(self, queries: int):
        self.ids, self.d = np.full((queries, TOP + 1), _LAST), np.full((queries, TOP + 1), np.inf)

    def add(self, q: int, ids: np.ndarray, d: np.ndarray) -> None:
        worst = self.d[q, -1]
        near = d <= worst
        ids, d = np.concatenate([self.ids[q], ids[near]]), np.concatenate([self.d[q], d[near]])
        best = np.lexsort((ids, d))[: TOP + 1]
        self.ids[q], self.d[q] = ids[best], d[best]


def _search(pivots: int, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries, query_orders, least = sent.value
        best = _Best(len(query_ids))

        def segment(ids: np.ndarray, vectors: np.ndarray, prefix: np.ndarray) -> None:
            files = Files(prefix, pivots)
            for q in range(len(query_ids)):
                found = np.flatnonzero(files.saved(query_orders[q]) >= least[q])
                if len(found):
                    best.add(q, ids[found], np.sqrt(((vectors[found] - queries[q]) ** 2).sum(1)))

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= SEGMENT:
                for part in _segments(held, queries.shape[1], query_orders.shape[1]):
                    segment(*part)
                held = []
        for part in _segments(held, queries.shape[1], query_orders.shape[1]):
            segment(*part)
        q, k = np.nonzero(np.isfinite(best.d))
        ids = best.ids[q, k]
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(ids, mask=ids == _LAST), pa.array(best.d[q, k])], names=["query_id", "vec_id", "score"])

    return run


def _segments(held: list[pa.RecordBatch], dim: int, prefix: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """vec_ids, vectors and prefixes of about SEGMENT rows at a time."""
    if not held:
        return
    table = pa.Table.from_batches(held)
    for at in range(0, table.num_rows, SEGMENT):
        part = table.slice(at, SEGMENT).combine_chunks().to_batches()[0]
        ids = part.column(0).fill_null(_LAST).to_numpy()
        flat = [part.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2)]
        yield ids, flat[0].reshape(-1, dim), flat[1].reshape(-1, prefix)


def build_index(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows: vec_id, v, all of the pivots' length -> vec_id, v, prefix, written in the shared folder."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOTS vectors
    dim, k = pivots.shape[1], min(PREFIX, len(pivots))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                vectors = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                prefix = orders(vectors, sent.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(np.arange(0, prefix.size + 1, k, dtype=np.int32), prefix.ravel())], names=["vec_id", "v", "prefix"])

    return common.parted(rows.mapInArrow(post, "vec_id long, v array<double>, prefix array<short>"), "permutations")


def _merged(found: DataFrame) -> DataFrame:
    """The TOP + 1 nearest a query of the tasks' rows, less one row that is the query itself."""
    near = Window.partitionBy("query_id").orderBy("score", F.col("vec_id").asc_nulls_last())
    own = F.coalesce((F.col("vec_id") == F.col("query_id")) & (F.col("score") == 0), F.lit(False))
    best = found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= TOP + 1).withColumn("own", own)
    first = F.min(F.when(F.col("own"), F.col("rank"))).over(Window.partitionBy("query_id"))
    left = best.withColumn("first", first).where(F.col("first").isNull() | (F.col("rank") != F.col("first")))
    return left.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= TOP).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """vectors, queries: vec_id, embedding -> query_id, rank, vec_id, score. Each query is a row of vectors."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # the least hashes of row numbers: never none where there are rows, and each copy of a row by itself
    drawn = rows.withColumn("draw", F.xxhash64(F.monotonically_increasing_id(), F.lit(SEED))).orderBy("draw").limit(SAMPLE).collect()
    if not drawn:
        return empty
    lengths = [len(r["v"]) for r in drawn]
    dim = max(set(lengths), key=lambda x: (lengths.count(x), -x))
    sample = np.array([r["v"] for r in drawn if len(r["v"]) == dim], np.float64)
    pivots = choose_pivots(np.unique(sample, axis=0))
    index = build_index(rows.where(F.size("v") == dim), pivots)
    n = index.count()
    asked = common.settle(usable(queries).where(F.size("v") == dim).where("vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v")))
    share = max(SHARE, CANDIDATES / n)

    def search(asked: DataFrame, share: float) -> DataFrame | None:
        blocks, found = max(1, -(-asked.count() // QUERY_BLOCK)), None
        for b in range(blocks):
            got = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()  # about QUERY_BLOCK queries
            if got:
                got.sort(key=lambda r: r["vec_id"])
                v = np.array([r["v"] for r in got])
                query_orders = orders(v, pivots)
                sent = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in got]), v, query_orders, bounds(sample, pivots, query_orders, share)))
                # one block's best rows, written before the next goes out
                one = _merged(index.mapInArrow(_search(len(pivots), sent), _FOUND))
                one = common.settle(one) if blocks > 1 else one
                found = one if found is None else found.unionAll(one)
        return found

    found = search(asked, share)
    if found is None:
        return empty
    found = common.settle(found)
    short = asked.join(found.groupBy(F.col("query_id").alias("vec_id")).count().where(F.col("count") >= min(TOP, n - 1)), "vec_id", "left_anti")
    again = search(common.settle(short), 1.0) if n > 1 else None
    return found if again is None else found.join(short, found["query_id"] == short["vec_id"], "left_anti").unionAll(again)


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0))
