"""Reading and writing: Parquet and delimited text by table name, views, checks, results."""

from __future__ import annotations

import json
import re
import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import delimited


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything matches the path, in whatever store Spark reads it from."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def _listed(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []


def tables_in(spark: SparkSession, root: str) -> list[str]:
    """Names of the Parquet tables of a folder, files or folders of that suffix."""
    return [n.removesuffix(".parquet") for n in _listed(spark, root) if n.endswith(".parquet")]


def read_parquet(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The folder of a table, else its single file."""
    for path in (f"{root}/{name}", f"{root}/{name}.parquet"):
        if exists(spark, path):
            return spark.read.parquet(path)
    raise FileNotFoundError(f"no folder or file of table {name} in {root}")


def read_text(spark: SparkSession, root: str, name: str, schema: T.StructType | str | None = None, sep: str | None = None, sampling: float | None = None) -> DataFrame:
    """Delimited text with a header, plain or compressed; the separator is seen from the first lines if not told; rows that don't fit are dropped (delimited.read keeps them apart).

    A gzip file can't be split: it is dealt out after reading, so that what follows is parallel.
    """
    for path in (f"{root}/{name}", f"{root}/{name}*.gz", f"{root}/*/{name}*.gz", f"{root}/{name}*.csv", f"{root}/{name}*.txt"):
        if exists(spark, path):
            sep = sep or delimited.sniff(spark, path).sep
            reader = spark.read.option("header", True).option("sep", sep).option("mode", "DROPMALFORMED")
            if schema is not None:
                reader = reader.schema(schema)
            else:
                reader = reader.option("inferSchema", True)
                if sampling is not None:
                    reader = reader.option("samplingRatio", sampling)
            df = reader.csv(path)
            return df.repartition(spark.sparkContext.defaultParallelism) if any(f.endswith(".gz") for f in df.inputFiles()) else df
    raise FileNotFoundError(f"no text of table {name} in {root}")


NULL_TEXTS = ("", "n/a", "N/A", "NA", "NaN", "nan", "null", "NULL", "None")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A result CSV; the usual spellings of nothing become null in text columns."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return df.select(*(F.when(~F.col(f"`{c}`").isin(*NULL_TEXTS), F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes))


def read_chunks(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.parquet(pattern)


def load_query(text: str) -> dict[str, str]:
    """A query file's JSON: an object, or a list with one; keys sql and, if given, question."""
    got = json.loads(text)
    got = got[0] if isinstance(got, list) else got
    return {"sql": got["sql"], "question": got.get("question", "")}


_REFERENCE = re.compile(r"\breporting\.(\w+)")


def referenced_tables(sql: str) -> list[str]:
    return sorted(set(_REFERENCE.findall(sql)))


def resolve(sql: str, prefix: str = "") -> str:
    """reporting.x as the view of that name; text without such names stays as it is."""
    return _REFERENCE.sub(lambda m: prefix + m[1], sql)


def register_views(tables: dict[str, DataFrame], prefix: str = "") -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)


def validate(df: DataFrame, columns: Iterable[str], key: str = "guid") -> DataFrame:
    """One row: rows, distinct keys, which columns are present and which missing."""
    want = list(columns)
    have = [c for c in want if c in df.columns]
    keys = F.count_distinct(key) if key in df.columns else F.lit(None).cast("long")
    return df.agg(F.count("*").alias("rows"), keys.alias("keys")).select("*", F.array(*map(F.lit, have)).cast("array<string>").alias("present"), F.array(*(F.lit(c) for c in want if c not in have)).cast("array<string>").alias("missing"))


def write_table(df: DataFrame, path: str, key: str = "guid") -> DataFrame:
    """Writes Parquet and returns the check of what was written: rows, keys, columns there and missing, whether names and types are those meant, and the first rows as text."""
    df.write.mode("overwrite").parquet(path)
    got = df.sparkSession.read.parquet(path)
    same = [(f.name, f.dataType.simpleString()) for f in got.schema] == [(f.name, f.dataType.simpleString()) for f in df.schema]
    first = [json.dumps(r.asDict(), default=str) for r in got.limit(3).collect()]
    return validate(got, df.columns, key).withColumns({"same_schema": F.lit(same), "sample": F.array(*map(F.lit, first)).cast("array<string>")})


def write_results(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def route_results(spark: SparkSession, methods: dict[str, str], out_dir: str, kinds: dict[str, str], routes: dict[str, str]) -> DataFrame:
    """query, type, method, error: one folder of results, each query's from the folder of the method that its type is sent to.

    kinds: query -> type; routes: type -> method; methods: method -> folder of results, each a CSV file or a folder of them named after
    its query. What isn't there is told in its row, and nothing is written for it.
    """
    done = []
    for query, kind in sorted(kinds.items()):
        method = routes.get(kind)
        found = None if method not in methods else next((p for p in (f"{methods[method]}/{query}.csv", f"{methods[method]}/{query}") if exists(spark, p)), None)
        if found is None:
            done.append((query, kind, method, "no method for the type" if method is None else "no folder of the method" if method not in methods else "no result"))
            continue
        write_results(spark.read.option("header", True).csv(found), f"{out_dir}/{query}")  # as text: nothing is read into the values
        done.append((query, kind, method, None))
    return spark.createDataFrame(done, "query string, type string, method string, error string")


def save_tables(tables: dict[str, DataFrame], database: str) -> None:
    """Tables that last beyond the session, in the warehouse."""
    for spark in {df.sparkSession for df in tables.values()}:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, df in tables.items():
        df.write.mode("overwrite").format("parquet").saveAsTable(f"`{database}`.`{name}`")


def schema_of(df: DataFrame) -> DataFrame:
    """name, type, nullable: a row for each column, in order."""
    return df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)], "position int, name string, type string, nullable boolean")


def settle(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder that spark.checkpoint.dir names; one of our own only where none is."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="telemill-settled-"))
    return df.checkpoint(eager=True)


def stage(df: DataFrame, path: str) -> DataFrame:
    """The stage's rows: read if an earlier run wrote them whole, else written now."""
    spark = df.sparkSession
    if not exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
