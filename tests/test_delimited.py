"""Delimited text without being told how."""

import datetime as dt
import gzip

import pytest
from pyspark.sql import types as T

from telemill.sources import delimited, tables

ROWS = [("g1", "1", "2.5", "2024-01-31", "2024-01-31 10:20:30", "true", "x, y"), ("g2", "-7", "3", "2024-02-29", "2024-02-29 00:00:00", "false", "N/A"), ("g3", "", "1e3", "", "", "", 'say ""hi""')]
NAMES = ["guid", "n", "v", "day", "at", "ok", "text"]


def _lines(sep, header=True):
    quoted = [f'"{r[6]}"' if sep in r[6] or '"' in r[6] else r[6] for r in ROWS]
    return ([sep.join(NAMES)] if header else []) + [sep.join([*r[:6], q]) for r, q in zip(ROWS, quoted, strict=True)]


def _write(path, lines, zipped=False):
    with gzip.open(path, "wt") if zipped else open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    return f"file://{path}"


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_separators_headers_and_types(spark, tmp_path, sep):
    rows, bad = delimited.read(spark, _write(f"{tmp_path}/t.csv", _lines(sep)))
    assert rows.columns == NAMES and [f.dataType for f in rows.schema] == [T.StringType(), T.LongType(), T.DoubleType(), T.DateType(), T.TimestampType(), T.BooleanType(), T.StringType()]
    got = [tuple(r) for r in rows.orderBy("guid").collect()]
    assert got[0] == ("g1", 1, 2.5, dt.date(2024, 1, 31), dt.datetime(2024, 1, 31, 10, 20, 30), True, "x, y") and got[1][6] is None and got[2][1:6] == (None, 1000.0, None, None, None)
    assert bad.count() == 0
    bare, _ = delimited.read(spark, _write(f"{tmp_path}/u.csv", _lines(sep, header=False)))
    assert bare.columns == [f"column{k}" for k in range(7)] and bare.count() == 3
    assert tables.read_text(spark, str(tmp_path), "t").columns == NAMES


def test_bad_lines_are_kept_apart(spark, tmp_path):
    lines = [*_lines(";"), "g4;1;2", "g5;no number;2;2024-01-01;2024-01-01 00:00:00;true;z", "g6;1;2;2024-01-01;2024-01-01 00:00:00;true;z;more", "", "g7;5;2;2024-01-01;2024-01-01 00:00:00;true;fine"]
    path = _write(f"{tmp_path}/t.csv.gz", lines, zipped=True)
    rows, bad = delimited.read(spark, path, sample=4)
    assert {r["guid"] for r in rows.collect()} == {"g1", "g2", "g3", "g7"}
    assert sorted(r["line"][:2] for r in bad.collect()) == ["g4", "g5", "g6"] and all(r["file"].endswith("t.csv.gz") for r in bad.collect())
    assert rows.select("v").count() + bad.select("line").count() == 7


def test_many_files_each_with_its_header(spark, tmp_path):
    for k in range(3):
        _write(f"{tmp_path}/p{k}.csv", ["a|b", *(f"{k}{i}|x{i}" for i in range(50))])
    rows, bad = delimited.read(spark, f"file://{tmp_path}/*.csv")
    assert rows.count() == 150 and bad.count() == 0 and rows.dtypes == [("a", "bigint"), ("b", "string")]


def test_told_and_odd(spark, tmp_path):
    path = _write(f"{tmp_path}/t.txt", ["1,a", "2,b"])
    rows, _ = delimited.read(spark, path, T.StructType([T.StructField("x y", T.LongType()), T.StructField("z", T.StringType())]), ",", False)
    assert sorted(map(tuple, rows.collect())) == [(1, "a"), (2, "b")]
    words = _write(f"{tmp_path}/w.txt", ["name", "one", "two"])
    assert delimited.sniff(spark, words) == delimited.Dialect(",", True, T.StructType([T.StructField("name", T.StringType())]), "name")
    assert not delimited.dialect(["a,b", "a,c", "d,b"]).header and delimited.dialect(["k,v", "a,1", "b,2"]).header and not delimited.dialect(["1,2", "3,4"]).header
    with pytest.raises(ValueError):
        delimited.sniff(spark, _write(f"{tmp_path}/e.txt", []))
    assert delimited.column_type(["1", "x"]) == T.StringType() and delimited.column_type(["9223372036854775808", "1"]) == T.DoubleType() and delimited.column_type([]) == T.StringType()
