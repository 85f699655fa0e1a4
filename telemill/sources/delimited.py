"""Delimited text whose separator, header and types nobody has told: seen from the first lines, bad lines kept apart."""

from __future__ import annotations

import csv
import datetime as dt
from collections import Counter
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lines that are looked at; characters of a line that are.
SAMPLE, WIDEST = 1000, 100_000
SEPARATORS = (",", "\t", ";", "|")
#: Texts that stand for no value.
NOTHING = ("", "null", "NULL", "NA", "N/A", "n/a", "nan", "NaN", "None")


class Dialect(NamedTuple):
    sep: str
    header: bool
    schema: T.StructType
    first: str


def _fields(lines: list[str], sep: str) -> list[list[str]]:
    return list(csv.reader(lines, delimiter=sep, quotechar='"'))


def separator(lines: list[str]) -> str:
    """The one by which most lines have the same number of fields, of equals the one that gives most fields; a comma where none parts anything."""
    best, chosen = (0.0, 1), ","
    for sep in SEPARATORS:
        size, often = Counter(map(len, _fields(lines, sep))).most_common(1)[0]
        if size > 1 and (often / len(lines), size) > best:
            best, chosen = (often / len(lines), size), sep
    return chosen


def _is(convert, accept=lambda text: True):
    def fits(text: str) -> bool:
        try:
            convert(text)
        except ValueError:
            return False
        return accept(text)

    return fits


_PLAIN = lambda text: text.strip() == text and "_" not in text
#: The narrowest type that fits all values is a column's.
_TYPES = (
    (T.LongType(), _is(int, lambda t: _PLAIN(t) and abs(int(t)) < 1 << 63)),
    (T.DoubleType(), _is(float, _PLAIN)),
    (T.BooleanType(), lambda t: t.lower() in ("true", "false")),
    (T.DateType(), _is(dt.date.fromisoformat, lambda t: len(t) == 10)),
    (T.TimestampType(), _is(dt.datetime.fromisoformat, lambda t: len(t) > 10)),
)


def column_type(values: list[str]) -> T.DataType:
    there = [v for v in values if v not in NOTHING]
    return next((t for t, fits in _TYPES if there and all(map(fits, there))), T.StringType())


def dialect(lines: list[str], header: bool | None = None) -> Dialect:
    """Of the first lines of a file. The first is a header if its names differ, none is empty or a number, and either some column is no text below it or all of it is text."""
    if not lines:
        raise ValueError("no lines")
    sep = separator(lines)
    rows = _fields(lines, sep)
    size = Counter(map(len, rows)).most_common(1)[0][0]
    body = [r for r in rows[1:] if len(r) == size]
    columns = list(zip(*body, strict=True)) if body else [()] * size
    below = [column_type(list(c)) for c in columns]
    if header is None:
        names = rows[0]
        named = len(names) == size == len(set(names)) and all(n.strip() and isinstance(column_type([n]), T.StringType) for n in names)
        header = named and (not body or any(not isinstance(t, T.StringType) for t in below) or not any(n in c for n, c in zip(names, columns, strict=True)))
    if header:
        names, types = [n.strip() for n in rows[0]][:size] + [f"column{k}" for k in range(len(rows[0]), size)], below
    else:
        every = [r for r in rows if len(r) == size]
        names, types = [f"column{k}" for k in range(size)], [column_type(list(c)) for c in zip(*every, strict=True)]
    return Dialect(sep, header, T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)]), lines[0])


def sniff(spark: SparkSession, path: str, header: bool | None = None, sample: int = SAMPLE) -> Dialect:
    """The dialect of the first file of a path; so many lines of it come to the driver."""
    first = min(spark.read.text(path).inputFiles(), default=None)
    if first is None:
        raise FileNotFoundError(path)
    lines = [r[0] for r in spark.read.text(first).select(F.substring("value", 1, WIDEST)).where("trim(value) <> ''").limit(sample).collect()]
    return dialect(lines, header)


def read(spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str | None = None, header: bool | None = None, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """Rows, and the lines that are none: file, line. What is told is not looked for.

    A line is bad if it has another number of fields than the columns, or a value that is none of its
    column's type; types come from the first lines, so a later value that doesn't fit is bad too. Each file
    may begin with the header. Texts for no value are null. Lines are records: a quoted line break is not read.
    """
    seen = sniff(spark, path, header, sample) if schema is None or sep is None or header is None else None
    sep = sep or seen.sep
    schema = schema or seen.schema
    head = seen.header if header is None else header
    bad = "__bad"
    texts = ", ".join([*(f"c{k} string" for k in range(len(schema))), f"{bad} string"])
    options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value").where("trim(value) <> ''")
    if head:
        lines = lines.where(F.col("value") != (seen.first if seen else sep.join(schema.names)))
    if any(f.endswith((".gz", ".zip")) for f in spark.read.text(path).inputFiles()):
        lines = lines.repartition(spark.sparkContext.defaultParallelism)  # such a file can't be split
    x = lines.select("file", "value", F.from_csv("value", texts, options).alias("t"))
    # values are told from their texts: a text for nothing is null in a column of any type
    text = [F.when(~F.trim(F.col(f"t.c{k}")).isin(*NOTHING), F.col(f"t.c{k}")) for k in range(len(schema))]
    typed = [c if isinstance(f.dataType, T.StringType) else F.trim(c).try_cast(f.dataType) for c, f in zip(text, schema.fields, strict=True)]
    unfit = F.col(f"t.{bad}").isNotNull()
    for c, v in zip(text, typed, strict=True):
        unfit |= c.isNotNull() & v.isNull()
    whole = x.select("file", "value", unfit.alias("unfit"), *(v.alias(f.name) for v, f in zip(typed, schema.fields, strict=True)))
    return whole.where(~F.col("unfit")).select(*(F.col(f"`{n}`") for n in schema.names)), whole.where("unfit").select("file", F.col("value").alias("line"))
