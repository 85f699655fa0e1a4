"""Draws from large vocabularies; folders of tables and of results."""

import random

import pytest
from pyspark.sql import functions as F

from telemill.operators import evaluate as E
from telemill.operators import fan
from telemill.operators import postprocess as R
from telemill.operators import synthesis as Y
from telemill.plans import benchmark
from telemill.sources import tables


def _weights(n):
    rng = random.Random(3)
    return [200.0, 90.0, 40.0] + [rng.choice([0.01, 0.5, 1.0, 2.0]) for _ in range(n - 3)]


def _included(weights, m, times, seed):
    """How often each item is among the first m of the race."""
    rng, n = random.Random(seed), [0] * len(weights)
    for _ in range(times):
        for i in sorted(range(len(weights)), key=lambda i: rng.expovariate(weights[i]))[:m]:
            n[i] += 1
    return [x / times for x in n]


def test_chances_are_those_of_the_race(spark, monkeypatch):
    weights, m, times = _weights(150), 6, 2500
    items = spark.createDataFrame([(f"i{k}", w) for k, w in enumerate(weights)], "item string, weight double").repartition(3)
    entities = spark.range(times).select("id", F.lit(m).alias("__n"))
    monkeypatch.setattr(fan, "HEAVY", 2)
    monkeypatch.setattr(fan, "SPARE", 1)
    got = fan.draw_items(entities, "id", items, "item", "weight", "s").cache()
    per = got.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("item").alias("d"), F.sum("share").alias("s"))
    assert per.count() == times and per.where(f"n <> {m} or d <> {m} or abs(s - 1) > 1e-9").count() == 0
    n = {r["item"]: r["count"] / times for r in got.groupBy("item").count().collect()}
    want = _included(weights, m, times, 1)
    for k, p in enumerate(want):
        assert abs(n.get(f"i{k}", 0) - p) < 5 * (2 * max(p * (1 - p), 0.002) / times) ** 0.5, (k, n.get(f"i{k}", 0), p)
    again = fan.draw_items(entities.repartition(5), "id", items.repartition(2), "item", "weight", "s")
    assert sorted((r["id"], r["item"]) for r in got.collect()) == sorted((r["id"], r["item"]) for r in again.collect())


def test_large_vocabulary_is_not_refused(spark, monkeypatch):
    monkeypatch.setattr(Y, "MOST_SENT", 100)
    items = spark.range(5000).select(F.concat(F.lit("i"), "id").alias("item"), (1 / (1 + F.col("id"))).alias("weight"))
    got = Y.fan_out(spark.range(300).withColumnRenamed("id", "guid"), "guid", items, "item", "weight", 3.0, "s").cache()
    g = got.groupBy("guid").agg(F.count("*").alias("n"), F.count_distinct("item").alias("d")).agg(F.avg("n"), F.max(F.abs(F.col("n") - F.col("d"))), F.count("*")).first()
    assert g[0] == pytest.approx(3.0, abs=0.4) and g[1] == 0 and g[2] == 300
    assert got.where("item = 'i0'").count() > got.where("item = 'i7'").count()


def test_fewer_items_than_wanted(spark):
    items = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("b", 2.0), (None, 5.0)], "item string, weight double")
    got = fan.draw_items(spark.range(5).select("id", F.lit(4).alias("__n")), "id", items, "item", "weight", "s")
    assert {(r["id"], r["n"]) for r in got.groupBy("id").agg(F.count("*").alias("n")).collect()} == {(k, 2) for k in range(5)}


def test_a_folder_of_tables_is_put_right(spark, tmp_path):
    real = spark.createDataFrame([("Notebook", 1.0), ("Desktop", 2.0)], "chassistype string, power double")
    synth = spark.createDataFrame([("notebok", -1.0), ("DESKTOP", None), ("Toaster", 9.0)], "chassistype string, power double")
    real.write.parquet(f"{tmp_path}/real/one.parquet")
    synth.write.parquet(f"{tmp_path}/synth/one.parquet")
    synth.write.parquet(f"{tmp_path}/synth/two.parquet")
    (tmp_path / "synth" / "broken.parquet").mkdir()
    got = {r["name"]: r for r in R.postprocess_folder(spark, f"file://{tmp_path}/synth", f"file://{tmp_path}/out", f"file://{tmp_path}/real").collect()}
    assert (got["one"]["rows"], got["one"]["checked"], got["two"]["checked"]) == (3, True, False) and got["broken"]["error"]
    one = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out/one.parquet").collect()))
    assert one == [("Desktop", 4.0), ("Notebook", 0.0), ("Toaster", 9.0)]
    assert {r["chassistype"] for r in spark.read.parquet(f"{tmp_path}/out/two.parquet").collect()} == {"notebok", "DESKTOP", "Toaster"}


def test_routed_results_are_a_folder(spark, tmp_path):
    kinds = {q: s.kind for q, s in benchmark.SPECS.items()}
    df = lambda v: spark.createDataFrame([("a, b", v), (None, "2")], "k string, v string")
    tables.write_results(df("per"), f"{tmp_path}/pertable/pkg_power_by_country")
    tables.write_results(df("mst"), f"{tmp_path}/mst/pkg_power_by_country")
    df("mst").toPandas().to_csv(tmp_path / "mst" / "display_devices_vendors_percentage.csv", index=False)
    got = {r["query"]: r for r in tables.route_results(spark, {"pertable": f"file://{tmp_path}/pertable", "mst": f"file://{tmp_path}/mst"}, f"file://{tmp_path}/out", kinds, E.ROUTES).collect()}
    assert len(got) == 21 and {q for q, r in got.items() if r["error"] is None} == {"pkg_power_by_country", "display_devices_vendors_percentage"}
    assert got["pkg_power_by_country"]["method"] == "pertable" and got["server_exploration_1"]["error"] == "no result"
    rows = tables.read_results(spark, f"{tmp_path}/out/pkg_power_by_country").collect()
    assert sorted(str(r["v"]) for r in rows) == ["2", "per"] and {r["k"] for r in rows} == {"a, b", None}
    assert sorted(tables._listed(spark, f"file://{tmp_path}/out")) == ["display_devices_vendors_percentage", "pkg_power_by_country"]


def test_folders_of_results_are_compared(spark, tmp_path):
    real = spark.createDataFrame([("Server Class", "A", 10, 5.0, 7.0), ("Server Class", None, 4, 2.0, 1.0)], "processor_class string, os string, number_of_systems long, avg_bytes_received double, avg_bytes_sent double")
    tables.write_results(real, f"{tmp_path}/real/Xeon_network_consumption")
    tables.write_results(real.withColumn("number_of_systems", F.lit(20)), f"{tmp_path}/mst/server_class_network_consumption")
    names = ["server_class_network_consumption", "pkg_power_by_country"]
    got = {(r["query"], r["column"]): r for r in benchmark.evaluate_folders(spark, f"file://{tmp_path}/real", {"mst": f"file://{tmp_path}/mst"}, names).collect()}
    assert got[names[0], "group_coverage"]["passed"] and got[names[0], "avg_bytes_sent"]["value"] == 0 and got[names[0], "number_of_systems"]["value"] == 2.5
    assert got[names[1], ""]["metric_type"] == "error" and "no result" in got[names[1], ""]["detail"] and len(got) == 5
