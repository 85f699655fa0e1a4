"""What the corpus operators share: reading tables, the shared folder, Arrow maps.

Every operator of this subpackage reads only the columns it names, so extra
columns (whatever they are called) pass by or, in pipeline stages, pass through.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Narrow rows that one task takes where there are few.
ROWS_AT_ONCE = 100_000
#: Bytes of an Arrow batch where texts go to Python.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="telemill-shared-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{_own_folder(spark)}/{what}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/telemill/{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Deletes what this application's operators wrote in the shared folder. For the end: results that weren't read yet are gone."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def gathered(df: DataFrame) -> DataFrame:
    """As settle, for narrow rows that may be few: in as many tasks as their number asks for, so that their next shuffle writes few files."""
    df = settle(df)
    return df.coalesce(max(1, -(-df.count() // ROWS_AT_ONCE)))


def parted(df: DataFrame, what: str) -> DataFrame:
    """As settle, in Parquet: columnar and compressed, for rows that carry texts or bytes."""
    path = shared_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run within send batches of some BATCH_BYTES to Python: ten thousand long texts take much memory, twice in the JVM and once in Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """mapInArrow over plain Python columns: fn takes and returns {column: list}."""
    spark_schema = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # slices keep the Python objects of one step to a few thousand rows
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out = fn({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, spark_schema)


def whole_text(col: str = "text"):
    """A null text counts as the empty one."""
    return F.coalesce(F.col(col), F.lit(""))
