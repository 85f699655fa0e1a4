"""Finding F7: the places of devices are worked out once for all tables that are split, and methods are judged together."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from telemill.operators import evaluate as E

DATA = "/root/testdata/sf0.01"


def test_halves_read_the_same_places(spark):
    first, second = E.split_half(spark.range(1001).withColumnRenamed("id", "guid"), "guid", "42")
    assert (first.count(), second.count(), first.join(second, "guid").count()) == (500, 501, 0)
    for half in (first, second):
        assert "InMemoryTableScan" in half._jdf.queryExecution().executedPlan().toString()
    spark.catalog.clearCache()


def test_methods_are_judged_together(spark):
    m = spark.createDataFrame([("q", "aggregate", x, k < n) for x, n in (("mst", 1), ("pertable", 3)) for k in range(4)], "query string, query_type string, method string, passed boolean")
    got = {r["method"]: (r["n_metrics"], r["n_passed"], r["score"], r["passed"]) for r in E.judge(m, ["method"]).collect()}
    assert got == {"mst": (4, 1, 0.25, False), "pertable": (4, 3, 0.75, True)}


def test_judged_queries_by_sql(spark):
    c = duckdb.connect()
    for t in ("customer", "nation", "region", "orders", "events"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    names = ["query", "query_type", "method", "n_metrics", "n_passed", "score", "passed"]
    want = sorted(c.sql(f"select {', '.join(names)} from ({entry.oracle_sql()['judged_queries']})").fetchall())
    got = entry.queries()["judged_queries"](spark, DATA).select(*(F.col(n) for n in names)).collect()
    assert sorted(map(tuple, got)) == want and len(want) == 4
    spark.catalog.clearCache()
