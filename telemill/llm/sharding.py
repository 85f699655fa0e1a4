"""Shards by jump consistent hashing: a key and the number of shards decide.

A row's key columns become a 60-bit number (the head of the MD5 of their text),
which jump hashing maps to one of n shards: it draws from a generator that the
key seeds where the key jumps next as shards are appended, and stays at the last
jump below n. Nothing is stored, no ring and no table of shards; going from n to
n + 1 shards moves one row in n + 1, all of them into the new shard.

Slots number the rows of a shard without gaps. Rows (without their texts) are
laid out by ranges of their order; each task counts what it has of each shard,
and a table of these counts, parts times shards, gives where each begins. So no
task holds a shard, and a doc_id that very many rows share is cut across ranges,
since the last column of the ranges is the row's own number.

Defined results: a null text has the size of the empty one (1) and the CRC of
no bytes (0). All rows of one key go to one shard, null being a key like any
other; equal texts under different ids are not brought together, since the id
alone decides (shard_of takes the text's digest as a key where they should be).
Slots go by doc_id (nulls first), then CRC and size; rows equal in all three
differ only in their slots. An empty table has no rows. Extra columns pass
write_shards, whatever they are called, but for one called shard, which is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 8
#: Fixed values of jump hashing: the generator's multiplier, and the width of its draws.
MULTIPLIER, DRAW_BITS = 2862933555777941757, 31


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key: about ln(shards) steps, on all keys that still move at once."""
    state = keys.astype(np.uint64)
    at, upcoming = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    while len(moving):
        at[moving] = upcoming[moving]
        state[moving] = state[moving] * np.uint64(MULTIPLIER) + np.uint64(1)
        draw = (state[moving] >> np.uint64(64 - DRAW_BITS)).astype(np.float64) + 1
        upcoming[moving] = ((at[moving] + 1) * (float(1 << DRAW_BITS) / draw)).astype(np.int64)
        moving = moving[upcoming[moving] < shards]
    return at.astype(np.int32)


def key_of(*columns: str | Column) -> Column:
    """A key that lasts: the same in every version and on every machine. Nulls count as a value of their own."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    text = F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in cols))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key (key_of): a number below shards."""
    if shards < 1:
        raise ValueError("at least one shard")

    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards))

    return of(key)


def slots(rows: DataFrame, order: list[str], shard: str = "shard") -> DataFrame:
    """rows with slot (long): the place of each row in its shard, from 0, by the order (nulls first). rows is small of width and settled here."""
    held = common.parted(rows.withColumn("__own", F.monotonically_increasing_id()), "shards")
    laid = held.repartitionByRange(*(F.asc_nulls_first(c) for c in order), "__own").sortWithinPartitions(*(F.asc_nulls_first(c) for c in order))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            of = batch.column(shard).to_numpy()
            place = np.zeros(len(of), np.int64)
            for s in np.unique(of).tolist():
                mine = np.flatnonzero(of == s)
                place[mine] = seen.get(s, 0) + np.arange(len(mine))
                seen[s] = seen.get(s, 0) + len(mine)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(of), part, np.int32)), pa.array(place)], names=[*batch.schema.names, "__part", "__place"])

    from pyspark.sql.types import IntegerType, LongType, StructType

    schema = StructType([*held.schema.fields]).add("__part", IntegerType(), False).add("__place", LongType(), False)
    placed = common.parted(laid.mapInArrow(number, schema), "slots")
    counts = placed.groupBy("__part", shard).agg((F.max("__place") + 1).alias("__n"))
    # a shard has a row for each part here
    before = Window.partitionBy(shard).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("__part", shard, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__begin"))
    return placed.join(begins, ["__part", shard]).withColumn("slot", F.col("__begin") + F.col("__place")).drop("__part", "__place", "__begin", "__own")


def moved(rows: DataFrame, key: Column, before: int, after: int) -> DataFrame:
    """The rows that another number of shards sends elsewhere, with their shards before and after."""
    both = rows.withColumns({"shard": shard_of(key, before), "grown_shard": shard_of(key, after)})
    return both.where("shard <> grown_shard")


def write_shards(docs: DataFrame, path: str, key: Column, shards: int = SHARDS, files: int = 1) -> None:
    """Writes every row under its shard (folders shard=0, shard=1, ...), so many files a shard; rows of one key are spread over its shard's files."""
    if "shard" in docs.columns:
        raise ValueError("a column is called shard")
    placed = docs.withColumn("shard", shard_of(key, shards)).withColumn("__file", (F.pmod(F.monotonically_increasing_id(), F.lit(files))).cast("int"))
    placed.repartition("shard", "__file").drop("__file").write.partitionBy("shard").mode("errorifexists").parquet(path)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of SHARDS, its slot there, and its shard if there were one more."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = common.table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = docs.withColumn("key", key_of("doc_id"))
    placed = placed.withColumns({"shard": shard_of(F.col("key"), SHARDS), "grown_shard": shard_of(F.col("key"), SHARDS + 1)}).drop("key")
    return slots(placed, ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


OP12_SQL = """
with recursive bits as (
  select range as n, range::ubigint as c, 0 as step from range(256)
  union all
  select n, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, step + 1 from bits where step < 8
), remainders as (select list(c order by n) as r from bits where step = 8),
sized as (
  select doc_id, coalesce(octet_length(encode(text)), 0)::bigint as bytes, lower(hex(encode(coalesce(text, '')))) as h,
    ('0x' || left(md5(case when doc_id is null then '-' else '=' || doc_id end), 15))::ubigint::hugeint as key
  from documents
), crc as (
  select doc_id, bytes, key,
    xor(list_reduce(list_concat([4294967295::ubigint], list_transform(range(bytes), lambda i: ('0x' || substring(h, (2 * i + 1)::int, 2))::ubigint)),
      lambda a, b: xor(a >> 8, r[(xor(a & 255, b) + 1)::int])), 4294967295::ubigint)::bigint as text_crc32
  from sized, remainders
), jumps as (
  select distinct key, key as state, 0::bigint as here, 0::bigint as upcoming from crc
  union all
  select key, next, upcoming, floor((upcoming + 1) * (2147483648.0::double / ((next >> 33) + 1)::double))::bigint
  from (select *, (state * 2862933555777941757 + 1) % 18446744073709551616::hugeint as next from jumps where upcoming < 9)
), placed as (
  select key, max(case when here < 8 then here end)::int as shard, max(here)::int as grown_shard from jumps group by key
)
select doc_id, bytes + 1 as size, text_crc32, 'key' as law, shard,
  row_number() over (partition by shard order by doc_id nulls first, text_crc32, bytes) - 1 as slot, grown_shard
from crc join placed using (key)
"""
