"""Putting synthetic tables right by what their column names say, and by the values that real ones have."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import exists, read_parquet, settle, tables_in
from .ranks import quantiles_of

# Parts of column names that tell how the column behaves, and columns with closed vocabularies.
NONNEGATIVE = ("count", "number", "duration", "bytes", "power", "time", "num", "rank", "total", "nrs")
PERCENT = ("percent", "percentage")
INTEGER = ("count", "number", "num", "rank", "nrs", "instances")
CANONICAL = ("chassistype", "countryname_normalized", "country", "os", "processor_class", "browser", "vendor_name", "app_type", "acdc", "event_name", "persona")
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _hinted(name: str, hints: tuple[str, ...]) -> bool:
    return any(h in name.lower() for h in hints)


def repair_columns(df: DataFrame) -> DataFrame:
    """Numbers: missing ones become the median, hinted ones are clipped and rounded. Texts: trimmed, empty or missing ones "Unknown". guid: hexadecimal digits only."""
    numbers = [c for c, t in df.dtypes if t in _NUMBERS or t.startswith("decimal")]
    if numbers:
        finite = lambda c: F.when(F.abs(F.col(c).cast("double")) != float("inf"), F.col(c).cast("double"))
        each = quantiles_of(df.select(*(finite(c).alias(c) for c in numbers)), numbers, [0.5])  # all columns in the same shuffles
        medians = each.agg(*(F.coalesce(F.max(F.when(F.col("name") == c, F.element_at("__q", 1))), F.lit(0.0)).alias(f"__m{i}") for i, c in enumerate(numbers)))
        out = df.crossJoin(F.broadcast(medians))  # one row
    else:
        out = df
    cols = []
    for c, t in df.dtypes:
        if c in numbers:
            i = numbers.index(c)
            d = F.col(c).cast("double")
            x = F.when(F.isnan(d), None).otherwise(d)
            x = F.coalesce(x, F.col(f"__m{i}"))
            if _hinted(c, NONNEGATIVE):
                x = F.greatest(x, F.lit(0.0))
            if _hinted(c, PERCENT):
                x = F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0))
            if _hinted(c, INTEGER):
                x = F.rint(x).cast("long")
            cols.append(x.alias(c))
        elif t == "string" and c == "guid":
            cols.append(F.regexp_replace(F.lower(c), "[^0-9a-f]", "").alias(c))
        elif t == "string":
            x = F.trim(F.coalesce(F.col(c), F.lit("Unknown")))
            cols.append(F.when(x == "", "Unknown").otherwise(x).alias(c))
        else:
            cols.append(F.col(c))
    return out.select(*cols)


def canonicalize(df: DataFrame, column: str, reference: DataFrame, cutoff: float = 0.8, most: int = 100_000) -> DataFrame:
    """The reference's spelling where a value equals one but for case, else its closest above the cutoff, else as it is.

    Only distinct values that no reference value equals are compared, spread over the
    tasks; the reference goes to them in portions of about `most` values, and of a
    value's closest in all portions the closest counts.
    """
    spark = df.sparkSession
    known = settle(reference.select(F.trim(F.col(column).cast("string")).alias("v")).where("v is not null and v <> ''").groupBy(F.lower("v").alias("k")).agg(F.max("v").alias("v")))
    n = known.count()
    if not n:
        return df
    portions = -(-n // most)
    small = F.broadcast(known) if portions == 1 else known
    distinct = df.select(F.col(column).alias("__v")).where("__v is not null").distinct()
    exact = distinct.join(small, F.lower("__v") == F.col("k"), "left")
    rest, near = exact.where("v is null").select("__v"), None
    for p in range(portions):
        sent = spark.sparkContext.broadcast({r["k"]: r["v"] for r in sorted(known.where(F.pmod(F.xxhash64("k"), F.lit(portions)) == p).collect())})  # about most values
        # in whole batches: a filter on the result of a function of columns would move below distinct, onto every row
        one = rest.mapInPandas(_closest(sent, cutoff), "__v string, __c struct<close:double,k:string,to:string>")
        near = one if near is None else near.unionAll(one)
    best = near.groupBy("__v").agg(F.max("__c").alias("__c")).select("__v", F.col("__c.to").alias("__to"))
    mapped = exact.where("v is not null").select("__v", F.col("v").alias("__to")).unionAll(best)
    return df.join(mapped, F.col(column) == F.col("__v"), "left").withColumn(column, F.coalesce("__to", F.col(column))).drop("__v", "__to")


def _closest(sent, cutoff: float):
    """Values that a key is close enough to, with how close, which, and the spelling."""

    def closest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_length: dict[int, list[str]] = {}
        for k in sent.value:
            by_length.setdefault(len(k), []).append(k)

        def one(v: str):
            # two texts are at most as alike as their lengths: 2 min / (a + b)
            keys = [k for n, of in by_length.items() if 2 * min(n, len(v.lower())) >= cutoff * (n + len(v.lower())) - 1e-9 for k in of]
            near = difflib.get_close_matches(v.lower(), keys, n=1, cutoff=cutoff)
            return {"close": difflib.SequenceMatcher(None, near[0], v.lower()).ratio(), "k": near[0], "to": sent.value[near[0]]} if near else None

        for batch in batches:
            found = [(v, c) for v in batch["__v"] if (c := one(v))]
            yield pd.DataFrame(found, columns=["__v", "__c"])

    return closest


def postprocess(df: DataFrame, real: DataFrame | None = None, cutoff: float = 0.8) -> DataFrame:
    out = repair_columns(df)
    for c in [c for c, t in out.dtypes if c in CANONICAL and t == "string"] if real is not None else ():
        if c in real.columns:
            out = canonicalize(out, c, real, cutoff)
    return out


def postprocess_folder(spark: SparkSession, synth_dir: str, out_dir: str, real_dir: str | None = None, cutoff: float = 0.8) -> DataFrame:
    """name, rows, checked (whether the real folder has the table), error: every table of a folder put right, by the real table's values where there is one, and written under the same name. One table's failure doesn't stop the others."""
    done = []
    for name in tables_in(spark, synth_dir):
        try:
            real = read_parquet(spark, real_dir, name) if real_dir and (exists(spark, f"{real_dir}/{name}") or exists(spark, f"{real_dir}/{name}.parquet")) else None
            postprocess(read_parquet(spark, synth_dir, name), real, cutoff).write.mode("overwrite").parquet(f"{out_dir}/{name}.parquet")
            done.append((name, spark.read.parquet(f"{out_dir}/{name}.parquet").count(), real is not None, None))
        except Exception as e:  # told in the result
            done.append((name, None, None, f"{type(e).__name__}: {str(e)[:300]}"))
    return spark.createDataFrame(done, "name string, rows long, checked boolean, error string")
