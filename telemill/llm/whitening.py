"""PCA whitening of vectors by distributed block matrices.

Vectors become whole numbers (SCALE steps to the unit, SHIFT added), so sums and
deviations are exact. Rows get gapless indices from the partition that wrote them
and their place in it; centred on the exact means they form a BlockMatrix of
blocks of rows. Its transpose times itself is the scatter matrix: products of
blocks are made where the blocks meet, spread over as many tasks as there are
blocks by splits of the middle dimension, and added up. The scatter, a square
of the dimension, comes to the driver for its eigenvectors; the block matrix
times the whitening matrix then projects all rows.

The middle splits are an argument of the JVM's multiply that the Python class
does not pass on, so it is called there: without them all blocks of rows would
meet in the one task of the one result block. Blocks have ROWS_PER_BLOCK rows, or
more where there would be over MOST_BLOCKS (the driver lists the blocks, not rows).

Defined results: rows whose vector is null or holds null or non-finite entries
are dropped, and so are those of another length than most of the rows have (the
longest of equally common lengths), the empty vector among them. Entries beyond
2^40 steps count as 2^40. deviation is null where it is beyond a long. Repeated
rows and ids count as often as they stand; a null vec_id stays null. Components
are as many as asked for, or as the dimension; one without variance (up to
rounding) has no whitened values (null) and is left out of identity_error, which
is null if none is left. Without usable rows there are no rows. Other columns
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SCALE, SHIFT, BOUND = 1024, 100_000, 1 << 40
COMPONENTS = 8
ROWS_PER_BLOCK, MOST_BLOCKS = 1024, 16_384
#: Variance of a component below this part of the largest is rounding.
ROUNDING = 1e-12


@dataclass
class Fit:
    """What whitening needs of the fit list: exact sums, and the eigenvectors by falling eigenvalue."""

    n: int
    sums: list[int]
    least: list[int]
    most: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def means(self) -> list[float]:
        return [s / self.n for s in self.sums]

    def rank(self, components: int) -> int:
        """How many of the first components have variance."""
        return int((self.values[:components] > ROUNDING * max(self.values[0], 0)).sum())


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id, x (array<long>), part, place: usable rows, settled, in the order in which they were written."""
    v = F.col("embedding").cast("array<double>")
    step = lambda c: F.least(F.greatest(F.floor(c * SCALE), F.lit(-BOUND)), F.lit(BOUND)) + SHIFT
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))
    number = F.monotonically_increasing_id()
    rows = rows.select("vec_id", F.transform("v", step).alias("x"), F.shiftright(number, 33).cast("int").alias("part"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    held = common.parted(rows, "whole")
    lengths = held.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).where("d > 0").orderBy(F.desc("n"), F.desc("d")).first()
    return held.where(F.size("x") == (lengths["d"] if lengths else -1))


def indexed(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows with index in place of part and place, gapless but for dropped rows; and the end of the indices. A row for each part is added up."""
    ends = rows.groupBy("part").agg((F.max("place") + 1).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = ends.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"), "n")
    end = begins.agg(F.max(F.col("begin") + F.col("n"))).first()[0] or 0
    return rows.join(begins.drop("n"), "part").withColumn("index", F.col("begin") + F.col("place")).drop("part", "place", "begin"), end


def _blocks(rows: DataFrame, end: int, means: list[float]) -> BlockMatrix:
    centred = F.zip_with("x", F.array(*map(F.lit, means)), lambda a, m: a - m)
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(centred).alias("vector")), "vector")
    height = max(ROWS_PER_BLOCK, -(-end // MOST_BLOCKS))
    # both factors of the scatter, the lists of blocks and the projection read the blocks: made once, and again where an executor is lost
    return IndexedRowMatrix(vectors, end, len(means)).toBlockMatrix(height, len(means)).persist(StorageLevel.MEMORY_AND_DISK)


def _scatter(blocks: BlockMatrix) -> np.ndarray:
    split = -(-blocks.numRows() // blocks.rowsPerBlock)
    product = blocks.transpose()._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, split)
    return BlockMatrix(product, blocks.colsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def fit(rows: DataFrame, end: int) -> tuple[Fit, BlockMatrix] | None:
    """Sums and eigenvectors of indexed rows, and their centred block matrix; None without rows. To the driver: a row and a column for each dimension."""
    each = rows.select(F.posexplode("x").alias("k", "c")).groupBy("k").agg(F.count("*").alias("n"), F.sum("c").alias("s"), F.min("c").alias("lo"), F.max("c").alias("hi")).orderBy("k").collect()
    if not each:
        return None
    n, sums = each[0]["n"], [r["s"] for r in each]
    blocks = _blocks(rows, end, [s / n for s in sums])
    v = _scatter(blocks) / n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    down = np.argsort(-values, kind="stable")
    return Fit(n, sums, [r["lo"] for r in each], [r["hi"] for r in each], values[down], vectors[:, down], float(np.trace(v))), blocks


def project(spark: SparkSession, blocks: BlockMatrix, found: Fit, components: int) -> DataFrame:
    """index, w: every row on the components that have variance, over their deviations."""
    k = found.rank(components)
    whitening = found.vectors[:, :k] / np.sqrt(found.values[:k])
    local = Matrices.dense(len(found.sums), k, whitening.ravel(order="F").tolist())
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), local)], 1), len(found.sums), k)
    product = blocks.multiply(right).toIndexedRowMatrix()
    # the rows as they are in the JVM; the class's own way takes each through Python
    rows = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("w"))


def deviation(found: Fit, x: str = "x") -> Column:
    """The sum over dimensions of (n x - S)^2, exact."""
    far = [max(found.n * hi - s, s - found.n * lo) for s, lo, hi in zip(found.sums, found.least, found.most, strict=True)]
    if sum(f * f for f in far) < 1 << 63 and found.n * max(map(abs, (*found.least, *found.most))) < 1 << 63:
        off = F.zip_with(x, F.array(*map(F.lit, found.sums)), lambda a, s: a * F.lit(found.n) - s)
        return F.aggregate(off, F.lit(0).cast("long"), lambda a, y: a + y * y)
    wide = "decimal(38,0)"
    sums = F.array(*(F.lit(str(s)).cast(wide) for s in found.sums))
    off = F.zip_with(x, sums, lambda a, s: (a.cast("decimal(18,0)") * F.lit(found.n).cast("decimal(19,0)")).cast(wide) - s)
    # a difference of 2^32 or more has a square beyond a long
    fits = F.forall(off, lambda y: F.abs(y) < (1 << 32))
    near = F.transform(off, lambda y: F.when(F.abs(y) < (1 << 32), y.cast("decimal(18,0)")).otherwise(F.lit(0).cast("decimal(18,0)")))
    total = F.aggregate(near, F.lit(0).cast(wide), lambda a, y: (a + y * y).cast(wide))
    return F.when(fits & (total < F.lit(str(1 << 63)).cast(wide)), total).cast("long")


def identity_error(projected: DataFrame, k: int) -> float | None:
    """The largest absolute entry of the covariance of w minus the identity."""
    if not k:
        return None
    w = [F.element_at("w", i + 1) for i in range(k)]
    means = projected.agg(*(F.avg(c) for c in w)).first()
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    got = projected.agg(*(F.avg((w[i] - means[i]) * (w[j] - means[j])) for i, j in pairs)).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(got, pairs, strict=True))


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """WHITENED: a row for each usable vector and component."""
    spark = vectors.sparkSession
    rows, end = indexed(whole_numbers(vectors))
    found = fit(rows, end)
    if found is None:
        return spark.createDataFrame([], WHITENED)
    found, blocks = found
    wanted, k = min(components, len(found.sums)), found.rank(components)
    ids = rows.select("index", "vec_id", deviation(found).alias("deviation"))
    if k:
        projected = common.parted(ids.join(project(spark, blocks, found, components), "index"), "whitened")
    else:
        projected = ids.withColumn("w", F.array().cast("array<double>"))
    blocks._java_matrix_wrapper._java_model.blocks().unpersist(False)
    error = identity_error(projected, k)
    share = F.array(*(F.lit(float(v / found.trace) if found.trace > 0 else 0.0) for v in found.values[:wanted]))
    each = projected.withColumn("component", F.explode(F.sequence(F.lit(1), F.lit(wanted))))
    return each.select("vec_id", "component", F.lit(found.n).cast("long").alias("n"), "deviation", F.get("w", F.col("component") - 1).alias("whitened"), F.element_at(share, F.col("component")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the first COMPONENTS whitened components of their own covariance."""
    return whiten(common.table(spark, sf_dir, "embeddings"))
