import datetime
import math

import pytest
from pyspark.sql import functions as F

from telemill.functions import privacy as P
from telemill.functions import semantics as S
from telemill.operators import evaluate as E
from telemill.operators import nearest
from telemill.operators import plan as G
from telemill.operators import postprocess as R
from telemill.operators import ranks
from telemill.operators import synthesis as Y
from telemill.operators import wide as W
from telemill.plans import benchmark
from telemill.sources import reporting, tables
from telemill.streaming.daily import daily_waits


# --- privacy ---


def test_sigma_values():
    assert P.calibrate_sigma(4.0, 1e-5) == pytest.approx(1.08116, abs=1e-4)
    assert P.calibrate_sigma(0.5, 1e-5) == pytest.approx(7.03183, abs=1e-3)


def test_sigma_is_monotone_and_round_trips():
    assert P.calibrate_sigma(1, 1e-5) > P.calibrate_sigma(2, 1e-5)
    assert P.calibrate_sigma(1, 1e-5, rounds=4) > P.calibrate_sigma(1, 1e-5)
    for e in (0.5, 1.0, 4.0):
        assert P.compute_epsilon(P.calibrate_sigma(e, 1e-5, 3), 1e-5, 3) == pytest.approx(e, abs=1e-4)
    assert P.compute_epsilon(0.001, 1e-5) == math.inf
    assert P.gaussian_delta(0.02, 0.1) <= 1 and P.gaussian_delta(50, 900.0) == 0


def test_zcdp():
    rho = P.zcdp_rho(3.5, 1e-5)
    assert rho == pytest.approx(0.2319, abs=1e-3)
    assert P.zcdp_sigma(40, rho / 7) == pytest.approx(24.6, abs=0.1)
    assert P.zcdp_sigma(308, rho / 7) == pytest.approx(68.2, abs=0.1)
    assert P.zcdp_sigma(3, 0) == 1e6


def test_counts():
    got = P.allocate(101, {"a": 25, "b": 22, "c": 1})
    assert sum(got.values()) == 101
    assert sum(P.scale_counts([5, 1, 0], 20)) == 20 and min(P.scale_counts([100, 0, 0], 5)) == 1
    assert P.scale_counts([1, 1, 1], 2) == [1, 1, 1] and P.scale_counts([], 5) == []
    assert P.query_count({"a": 3, "b": 0}, {"a": 2}) == {"a": 9, "b": 1}


# --- semantics ---


def test_snap_ties_go_down(spark):
    want = {3.0: 3, 3.5: 3, 5.0: 4, 7.0: 6, 10.0: 8, 20.0: 20, 40.0: 32, 100.0: 128, 200.0: 256}
    got = spark.createDataFrame([(x,) for x in want], "x double").select("x", S.snap("x").alias("s")).collect()
    assert all(r["s"] in S.RAM_SIZES for r in got)
    assert {r["x"]: r["s"] for r in got if r["x"] in (3.0, 5.0, 7.0, 10.0)} == {3.0: 3, 5.0: 4, 7.0: 6, 10.0: 8}


def test_expressions(spark):
    df = spark.createDataFrame([(2, 10.0, "7"), (0, 5.0, "x"), (3, None, None)], "w int, v double, t string")
    r = df.agg(S.wavg("w", "v").alias("a"), S.ratio(F.sum("v"), F.lit(0)).alias("b")).first()
    assert r["a"] == 10.0 and r["b"] is None
    got = df.select(S.clip("v", 6.0, 9.0).alias("c"), S.number_or("t", 8.0).alias("n"), S.unless_negative(F.col("w") - 1).alias("u")).collect()
    assert [tuple(x) for x in got] == [(9.0, 7.0, 1), (6.0, 8.0, None), (None, 8.0, 2)]
    u = spark.range(2000).select(S.uniform("id", "1").alias("u"), S.gaussian("id", "1", 2.0).alias("g"), S.laplace("id", "1", 1.0).alias("l")).agg(F.avg("u"), F.stddev("g"), F.avg(F.abs("l"))).first()
    assert u[0] == pytest.approx(0.5, abs=0.03) and u[1] == pytest.approx(2.0, abs=0.15) and u[2] == pytest.approx(1.0, abs=0.1)


# --- metrics ---


def _kv(spark, rows, schema="k string, v double"):
    return spark.createDataFrame(rows, schema)


def test_relative_error(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (2.0, 3.0), (-2.0, -1.0)], "r double, s double")
    assert [x[0] for x in rows.select(E.relative_error("r", "s")).collect()] == [0.0, math.inf, 0.5, 0.5]


def test_total_variation(spark):
    tv = lambda a, b: E.total_variation(_kv(spark, a), _kv(spark, b), ["k"], "v").first()[0]
    assert tv([("a", 1.0), ("b", 3.0)], [("a", 10.0), ("b", 30.0)]) == pytest.approx(0)
    assert tv([("a", 1.0)], [("b", 1.0)]) == pytest.approx(1)
    assert tv([(None, 1.0)], [(None, 5.0)]) == pytest.approx(0)


def test_spearman(spark):
    rho = lambda a, b: E.spearman(_kv(spark, list(zip("abcd", a))), _kv(spark, list(zip("abcd", b))), ["k"], "v", []).first()[0]
    assert rho([1.0, 2.0, 3.0, 4.0], [10.0, 20.0, 30.0, 40.0]) == pytest.approx(1)
    assert rho([1.0, 2.0, 3.0, 4.0], [4.0, 3.0, 2.0, 1.0]) == pytest.approx(-1)
    assert rho([1.0, 1.0, 1.0, 1.0], [4.0, 3.0, 2.0, 1.0]) == 0
    assert rho([1.0, 1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 4.0]) == pytest.approx(0.9486833)


def test_support_and_accuracy(spark):
    a, b = _kv(spark, [("a", 1.0), ("b", 2.0)]), _kv(spark, [("b", 2.0), ("c", 3.0), ("d", 3.0)])
    assert tuple(E.support(a, b, "k").first()) == (0.25, 1, 2)
    assert E.support(a.limit(0), b.limit(0), "k").first()[0] == 1.0
    assert E.category_accuracy(a, b, ["k"], "v").first()[0] == 0.5


def test_ks_wasserstein(spark):
    a, b = spark.createDataFrame([(float(x),) for x in range(10)], "v double"), spark.createDataFrame([(float(x) + 5,) for x in range(10)], "v double")
    r = E.ks_wasserstein(a, b, "v").first()
    assert r["ks"] == pytest.approx(0.5) and r["wasserstein"] == pytest.approx(5.0)


def test_evaluate_and_judge(spark):
    a = _kv(spark, [("a", 10.0), ("b", 20.0), ("c", 30.0)])
    m = None
    for kind in ("aggregate", "distribution", "histogram", "ranking_categorical", "ranking_numeric", "row_level"):
        one = E.evaluate(kind, kind, a, a, ["k"], ["v"])
        m = one if m is None else m.unionByName(one)
    m = m.unionByName(E.evaluate("bad", "aggregate", a, a.drop("v"), ["k"], ["v"]))
    v = {r["query"]: r for r in E.judge(m).collect()}
    assert all(v[k]["passed"] for k in v if k != "bad") and not v["bad"]["passed"]
    assert m.where("query = 'bad'").first()["metric_type"] == "error"
    routed = E.route(E.judge(m).withColumn("method", F.lit("mst")))
    assert {r["query"] for r in routed.collect()} == {"distribution", "ranking_numeric", "row_level"}


def test_normalized(spark):
    rows = spark.createDataFrame([("relative_error", 0.2, 0.1), ("jaccard", 0.5, 0.75), ("relative_error", math.inf, 0.1), ("relative_error", 0.1, 0.0)], "metric_type string, value double, baseline double")
    assert [round(r["normalized"], 6) for r in E.normalized(rows).collect()] == [2.0, 2.0]


def test_split_half(spark):
    ids = spark.range(101).withColumnRenamed("id", "guid")
    a, b = E.split_half(ids, "guid", "s")
    assert (a.count(), b.count(), a.intersect(b).count()) == (50, 51, 0)


# --- synthesis ---


def test_self_is_nearest(spark):
    rows = [(i, float(i), float(i * i), "A" if i % 2 else "B") for i in range(30)]
    df = spark.createDataFrame(rows, "candidate_id long, x double, y double, os string")
    votes = Y.device_votes(df.drop("candidate_id"), df, ["x", "y"], ["os"]).collect()
    assert len(votes) == 30 and all(r["votes"] == 1 for r in votes)


def test_blocks_change_nothing(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    data, cands = rng.random((50, 4)), rng.random((70, 4))
    ids = np.arange(len(cands))
    whole = np.round(np.abs(data[:, None, :] - cands[None, :, :]).sum(2), 9).argmin(1)
    monkeypatch.setattr(nearest, "BLOCK", 7)
    assert (nearest.Index(ids, cands, None, nearest.Metric()).search(data)[0] == whole).all()


def test_nearest_without_all_pairs(spark):
    """Clustered and spread data, ties and categories: the nearest of all pairs, with few of them compared where data is clustered."""
    import numpy as np

    rng = np.random.default_rng(4)
    middle = rng.random((40, 6)) * 10
    for clustered in (True, False):
        make = (lambda n: middle[rng.integers(0, 40, n)] + rng.normal(0, 0.05, (n, 6))) if clustered else (lambda n: rng.integers(0, 3, (n, 6)).astype(float))
        x, q = make(3000), make(700)
        k, kq = rng.choice(["a", "b", "c"], (3000, 2)), rng.choice(["a", "b", "unseen"], (700, 2))
        weight, cats = rng.random(6) + 0.1, np.array([0.3, 0.05])
        ids = rng.permutation(3000) * 3
        d = np.round((np.abs(q[:, None, :] - x[None, :, :]) * weight).sum(2) + ((kq[:, None, :] != k[None, :, :]) * cats).sum(2), 9)
        want = [ids[row == row.min()].min() for row in d]
        index = nearest.Index(ids, x, k, nearest.Metric(weight, cats))
        got, dist = index.search(q, kq)
        assert got.tolist() == want and np.abs(dist - d.min(1)).max() < 2e-9
        if clustered:
            assert index.compared < 0.2 * d.size, index.compared / d.size


def test_votes_in_portions(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.integers(0, 4, 3)], "AB"[i % 2] if i % 7 else None, float(i % 13) if i % 5 else None) for i in range(400)]
    rows += [(400 + i, rows[1][1], "A", 3.0) for i in range(30)]
    df = spark.createDataFrame(rows, "candidate_id long, embedding array<float>, os string, mem double")
    real, cands = df.where("candidate_id % 5 <> 0").drop("candidate_id"), df.where("candidate_id % 5 = 0")
    votes = lambda: [sorted(map(tuple, d.collect())) for d in (Y.vector_votes(real, cands, "embedding"), Y.device_votes(real, cands, ["mem"], ["os"]))]
    want = votes()
    for name, n in (("MOST_CANDIDATES", 20), ("PORTION", 9), ("VECTOR_BLOCK", 40)):
        monkeypatch.setattr(Y, name, n)
    assert votes() == want and all(sum(v for _, v in w) == real.count() for w in want)


def test_selection(spark):
    v = spark.createDataFrame([(1, 0.0), (2, 9.0), (3, 9.0), (4, 1.0)], "candidate_id long, votes double")
    assert [r[0] for r in Y.select_ranked(v, 3).collect()] == [3, 2, 4]
    drawn = Y.select_sampled(v, 200, "s").groupBy("candidate_id").count().collect()
    assert sum(r["count"] for r in drawn) == 200 and {r["candidate_id"] for r in drawn} <= {2, 3, 4}
    even = Y.select_sampled(v.withColumn("votes", F.lit(0.0)), 400, "s").groupBy("candidate_id").count().collect()
    assert len(even) == 4


def test_marginals_and_fan_out(spark):
    df = spark.range(2000).select((F.col("id") % 100).cast("double").alias("x"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("c"))
    m = Y.marginal(df, "x", 10.0)
    assert m.count() == 20 and m.agg(F.sum("p")).first()[0] == pytest.approx(1)
    assert Y.sample_marginal(m, 500, "s", True).agg(F.avg("value")).first()[0] == pytest.approx(49.5, abs=5)
    c = Y.category_marginal(df, ["c"], 10.0)
    assert Y.sample_marginal(c, 500, "s", False).where("c = 'a'").count() == pytest.approx(125, abs=40)
    items = spark.createDataFrame([(f"i{k}", float(k + 1)) for k in range(8)], "item string, weight double")
    f = Y.fan_out(spark.range(300).withColumnRenamed("id", "guid"), "guid", items, "item", "weight", 3.0, "s")
    g = f.groupBy("guid").agg(F.count("*").alias("n"), F.count_distinct("item").alias("d"), F.sum("share").alias("s")).agg(F.avg("n"), F.max(F.abs(F.col("n") - F.col("d"))), F.max(F.abs(F.col("s") - 1)), F.count("*")).first()
    assert g[0] == pytest.approx(3.0, abs=0.4) and g[1] == 0 and g[2] < 1e-9 and g[3] == 300


def test_buckets_and_bins(spark):
    df = spark.createDataFrame([("a", 1)] * 3 + [("b", 2)] * 2 + [("c", 3)] * 2 + [(None, 4)], "k string, u int")
    assert {tuple(r) for r in Y.top_or_other(df, "k", 2).groupBy("k").count().collect()} == {("a", 3), ("b", 2), ("Other", 3)}
    q = Y.quantile_bins(spark.range(100).withColumn("x", F.col("id").cast("double")), "x", 4)
    assert [r["count"] for r in q.groupBy("x_bin").count().orderBy("x_bin").collect()] == [25, 25, 25, 25]
    h = Y.histogram(spark.createDataFrame([(5.0,)] * 9, "x double"), "x", 20, 0.01, 0.99).collect()
    assert [tuple(r) for r in h] == [(0, 9)]


def test_plan_and_evolution(spark, tmp_path):
    result = spark.createDataFrame([("Notebook", 120, 30.0), ("Desktop", 60, 55.0)], "chassistype string, n long, mem double")
    p = G.strata("mem", result, ["chassistype"], {"mem": ("percent", 100.0)}, "n", 0.1, "s")
    a = G.allocate(p, 1000)
    assert a.agg(F.sum("n")).first()[0] == pytest.approx(1000 * 22 / 101, abs=3)
    gen = G.SampledGenerator(["mem"], ["chassistype"], "s")
    first = gen.generate(a)
    real = spark.createDataFrame([("Notebook", 31.0)] * 40 + [("Desktop", 54.0)] * 20, "chassistype string, mem double")
    save = lambda df, k: (df.write.mode("overwrite").parquet(f"{tmp_path}/{k}"), spark.read.parquet(f"{tmp_path}/{k}"))[1]
    out = Y.evolve(real, first, lambda ps, k: gen.vary(ps, 2, k), 2, 10, 0.1, ["mem"], ["chassistype"], "e", save)
    assert out.count() == 10


def test_assign_sanitize_features(spark):
    rows = spark.range(30).withColumnRenamed("id", "row")
    devices = spark.range(20).select(F.format_string("g%d", "id").alias("guid"))
    got = Y.assign_keys(rows, "row", devices, "guid", "s").collect()
    assert len(got) == 20 and len({r["guid"] for r in got}) == 20 and len({r["row"] for r in got}) == 20
    raw = spark.createDataFrame([("5", None), ("x", " "), ("-3", "b")], "x string, c string")
    clean = Y.sanitize(raw, ["x", "y"], ["c"]).collect()
    assert [(r["x"], r["y"], r["c"]) for r in clean] == [(5.0, 0.0, "Unknown"), (0.0, 0.0, "Unknown"), (0.0, 0.0, "b")]
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 9.0)], "c string, x double")
    assert all(len(r["features"]) >= 3 for r in Y.features(df, ["x"], ["c"]).collect())


# --- wide and post-processing ---


def test_decompose_inverts_features(spark):
    wide = spark.createDataFrame([("g1", "Notebook", "7", 10.0, 500.0, 0.0, 5.0, 120.0, 3.0, 0.0), ("g2", "Desktop", "x", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "guid string, chassistype string, ram string, net_nrs double, net_received_bytes double, net_sent_bytes double, mem_nrs double, mem_avg_pct_used double, web_chrome_duration double, web_edge_duration double")
    t = W.decompose(wide)
    assert {r["ram"] for r in t["system_sysinfo_unique_normalized"].collect()} == {6.0, 8.0}
    back = {r["guid"]: r for r in W.assemble(wide.select("guid"), W.features({"system_network_consumption": t["system_network_consumption"]})).collect()}
    assert back["g1"]["net_received_bytes"] == pytest.approx(500.0) and back["g2"]["net_nrs"] == 0
    assert t["system_memory_utilization"].first()["avg_percentage_used"] == 100.0
    assert [tuple(r) for r in t["system_web_cat_usage"].collect()] == [("g1", "chrome", 3.0)]
    assert {r["name"]: r["percent_nonzero"] for r in W.sparsity(wide, ["net_nrs", "net_sent_bytes"]).collect()} == {"net_nrs": 50.0, "net_sent_bytes": 0.0}
    assert W.covered(wide, ["net_nrs", "mem_nrs"], 2).count() == 1
    assert {r["grp"]: r["percent"] for r in W.group_sparsity(wide, {"net": ["net_nrs"], "none": ["net_sent_bytes"]}).collect()} == {"net": 50.0, "none": 1.0}


def test_postprocess(spark):
    df = spark.createDataFrame([("{AB-12}", " chromee ", 1.6, 120.0, -3.0), ("zz", "", None, 50.0, 4.0), ("1", "CHROME", 3.0, -1.0, 5.0)], "guid string, browser string, num_x double, used_percent double, delta double")
    real = spark.createDataFrame([("chrome",), ("Firefox",)], "browser string")
    got = R.postprocess(df, real).collect()
    assert [r["guid"] for r in got if r["guid"]] and {r["browser"] for r in got} == {"chrome", "Unknown"}
    assert {r["num_x"] for r in got} == {2, 3} and {r["used_percent"] for r in got} == {100.0, 50.0, 0.0} and {r["delta"] for r in got} == {-3.0, 4.0, 5.0}


# --- sources, reporting, benchmark ---


def test_names_and_query_files():
    assert tables.referenced_tables("select * from reporting.a join reporting.b using (x)") == ["a", "b"]
    assert tables.resolve("select 1") == "select 1" and tables.resolve("from reporting.t", "v_") == "from v_t"
    assert tables.load_query('[{"sql": "select 1", "question": "q"}]') == {"sql": "select 1", "question": "q"} == tables.load_query('{"sql": "select 1", "question": "q"}')


def _raw(spark, root):
    d = datetime.date(2024, 1, 1)
    w = lambda df, n: df.write.parquet(f"{root}/{n}")
    w(spark.createDataFrame([(f"g{i}", "Notebook" if i % 2 else "Desktop", "US", "V", "M", str(8), "Win", 4, f"A {benchmark.SERVER_MARK} CPU" if i == 1 else "Core", "code", "fam", "Gamer") for i in range(6)], "guid string, chassistype string, countryname_normalized string, modelvendor_normalized string, model_normalized string, ram string, os string, `#ofcores` int, cpuname string, cpucode string, cpu_family string, persona string"), "system_sysinfo_unique_normalized")
    w(spark.createDataFrame([(f"g{i}", d, x, 400, 1.0, 9.0, float(i)) for i in range(6) for x in (W.RECEIVED, W.SENT)], "guid string, dt date, input_description string, nr_samples long, min_bytes_sec double, max_bytes_sec double, avg_bytes_sec double"), "os_network_consumption_v2")
    w(spark.createDataFrame([("g1", d, "E", "ac_display_on", "p.exe", 2000), ("g1", d, "E", "ac_display_on", "p.exe", 4000), ("g1", d, "E", "dc_x", "DESKTOP", 1)], "guid string, dt date, event_name string, ac_dc_event_name string, proc_name_current string, duration_ms long"), "userwait_v2")
    w(spark.createDataFrame([("g1", d, "chrome", "education", "x", 30, 1), ("g1", d, "edge", "games", "other", 10, 1), ("g2", d, "chrome", "mail", "x", 60, 2)], "guid string, dt date, browser string, parent_category string, sub_category string, duration_ms long, page_load_count long"), "web_cat_usage_v2")
    w(spark.createDataFrame([("g1", d, 10, 4096.0), ("g2", d, 5, 2048.0)], "guid string, dt date, sample_count long, average double"), "os_memsam_avail_percent")
    names = [n for ns, _ in reporting.METRICS.values() for n in ns[:1]] + [reporting.PACKAGE_POWER]
    w(spark.createDataFrame([("g1", d, "0", n, k + 1, 1.0 * k, 2.0 * k, 3.0 * k) for n in names for k in (1, 2)], "guid string, dt date, instance string, name string, nrs long, min double, mean double, max double"), "hw_metric_stats")
    import gzip
    import os

    texts = {
        "batt_dc_events": "guid,load_ts,power_on_dc_ts,duration_mins,power_on_battery_percent,power_off_battery_percent\ng1,2024-01-02 00:00:00,2024-01-01 10:00:00,30,-1,50\ng1,2024-01-02 00:00:00,2024-01-01 12:00:00,10,80,40\n",
        "system_cpu_metadata": "guid,marketcodename,cpugen\ng1,lake,12\n",
        "system_os_codename_history": "guid,os_name,os_codename,min_ts,max_ts\ng1,Win,22H2,2023-12-01,2024-02-01\ng1,Win,23H2,2024-02-02,2024-05-01\n",
        "system_on_off_suspend_time_day": "guid,dt,on_time,off_time,mods_time,sleep_time\ng1,2024-01-01,10,20,30,40\n",
        "system_display_devices": "guid,dt,display_id,connection_type,vendor_name,resolution_width,resolution_heigth,duration_ac,duration_dc\ng1,2024-01-01,1,HDMI,D,1920,1080,5,6\ng2,2024-01-01,2,DP,D,1920,1080,5,6\n",
        "system_frgnd_apps_types": "guid,dt,app_type,exe_name,totalsecfocal_day,lines_per_day\ng1,2024-01-01,Game,a.exe,10,3\ng2,2024-01-01,Game,b.exe,20,1\ng2,2024-01-01,Game,Desktop,99,1\n",
        "system_mods_power_consumption": "user_id,app_id,total_power_consumption\nu,a,5\nu,b,7\n",
        "system_mods_top_blocker_hist": "guid,dt_utc,blocker_name,blocker_type,activity_level,active_time_ms\ng1,2024-01-05,b,t,l,2000\ng1,2025-01-05,b,t,l,9000\n",
    }
    for n, t in texts.items():
        with gzip.open(os.path.join(root, f"{n}.csv.gz"), "wt") as f:
            f.write(t)


def test_reporting_and_benchmark(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    (tmp_path / "raw").mkdir()
    _raw(spark, raw)
    done = reporting.build_all(spark, raw, out)
    assert set(done.values()) == {"ok"} and len(done) == 19, done
    t = {n: spark.read.parquet(f"{out}/{n}") for n in done}
    b = t["system_batt_dc_events"].first()
    assert (b["duration_mins"], b["num_power_ons"], b["min_power_on_battery_percent"], b["avg_power_on_battery_percent"]) == (40, 2, 80, 80.0)
    m = {r["guid"]: r for r in t["system_memory_utilization"].collect()}
    assert m["g1"]["avg_percentage_used"] == 50.0 and m["g2"]["sysinfo_ram"] == 8192
    w = t["system_userwait"].where("proc_name = 'p.exe'").first()
    assert (w["acdc"], w["number_of_instances"], w["total_duration_ms"]) == ("AC", 2, 6000)
    at_once = reporting.metrics_at_once(spark.read.parquet(f"{raw}/hw_metric_stats"))
    for n in reporting.METRICS:
        assert sorted(map(tuple, at_once[n].collect())) == sorted(map(tuple, t[n].collect()))
    pivot = {r["guid"]: r for r in t["system_web_cat_pivot_duration"].collect()}
    assert pivot["g1"]["education"] == 30 and pivot["g1"]["games_other"] == 10 and len(pivot["g1"]) == 30
    results = {n: q(t).collect() for n, q in benchmark.QUERIES.items()}
    assert len(results) == 24
    assert results["mods_blockers_by_osname_and_codename"][0].asDict() == {"os_name": "Win", "os_codename": "22H2", "num_entries": 1, "number_of_systems": 1, "entries_per_system": 1.0}
    assert results["top_10_applications_by_app_type_ranked_by_focal_time"][0]["exe_name"] == "b.exe" and len(results["top_10_applications_by_app_type_ranked_by_focal_time"]) == 2
    assert results["userwait_top_10_wait_processes"][0].asDict() == {"proc_name": "p.exe", "total_duration_sec_per_instance": 3.0, "rank": 1}
    x = {r["processor_class"]: r["number_of_systems"] for r in results["server_class_network_consumption"]}
    assert x == {"Server Class": 1, "Non-Server Class": 5}
    assert results["display_devices_vendors_percentage"][0]["percentage_of_systems"] == 100.0
    assert results["persona_web_cat_usage_analysis"][0]["mail"] == 60.0
    check = tables.validate(t["system_userwait"], ["guid", "nope"]).first()
    assert check["missing"] == ["nope"] and check["keys"] == 1


def test_stage_and_results(spark, tmp_path):
    df = spark.range(5).withColumn("t", F.lit("n/a"))
    assert tables.stage(df, str(tmp_path / "s")).count() == 5
    assert tables.stage(spark.range(9), str(tmp_path / "s")).count() == 5
    tables.write_results(df, str(tmp_path / "r"))
    assert tables.read_results(spark, str(tmp_path / "r")).where("t is null").count() == 5


def test_stream(spark, tmp_path):
    src = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 5), "g", "ac_on", 2.0), (datetime.datetime(2024, 1, 1, 7), "g", "ac_on", 3.0)], "ts timestamp, guid string, event_name string, duration double")
    src.write.parquet(str(tmp_path / "in"))
    stream = daily_waits(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("waits").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select acdc, number_of_instances, total_duration from waits").collect()] == [("AC", 2, 5.0)]


# --- order, last rows, failures, spellings ---


def test_quantiles_and_ranks_of_many_parts(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = [float(v) for v in rng.integers(0, 40, 300)] + [None, None]
    df = spark.createDataFrame([(v,) for v in x], "v double").repartition(5)
    at = [0, 0.01, 0.333, 0.5, 0.9, 1]
    assert ranks.quantiles(df, "v", at).first()[0] == pytest.approx(np.quantile([v for v in x if v is not None], at).tolist())
    assert ranks.quantiles(df.where("v is null"), "v", [0.5]).first()[0] == [None]
    assert ranks.quantiles(spark.createDataFrame([(math.inf,), (math.inf,)], "v double"), "v", [0.5]).first()[0] == [math.inf]
    got = ranks.ranked_all(df, "v").collect()
    assert len(got) == 302 and all(r["rank"] == (1 + sum(y is not None and y > r["v"] for y in x) if r["v"] is not None else 301) for r in got)


def test_last_row_of_a_category_wins(spark):
    a = spark.createDataFrame([("x", 9.0), ("y", 1.0), ("x", 1.0)], "k string, v double").coalesce(1)
    b = spark.createDataFrame([("x", 1.0), ("y", 1.0)], "k string, v double")
    for kind in ("distribution", "histogram"):
        got = {(r["metric_type"]): r["value"] for r in E.evaluate("q", kind, a, b, ["k"], ["v"]).collect()}
        assert all(v == 0 for v in got.values()), got
    c = spark.createDataFrame([("x", "wrong"), ("x", "right")], "k string, v string").coalesce(1)
    d = spark.createDataFrame([("x", "right")], "k string, v string")
    assert E.evaluate("q", "ranking_categorical", c, d, ["k"], ["v"]).first()["value"] == 1


def test_failures_at_run_time_are_rows(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "no number")], "k string, v string")
    bad = a.select("k", F.col("v").cast("double").alias("v"))
    b = spark.createDataFrame([("x", 1.0)], "k string, v double")

    def gone(name):
        raise FileNotFoundError(name)

    specs = {"q1": ("distribution", ["k"], ["v"], []), "q2": ("aggregate", ["k"], ["v"], [])}
    got = E.evaluate_all(specs, lambda name: b, {"good": lambda name: b, "bad": lambda name: bad, "none": gone}).collect()
    assert {(r["method"], r["query"]) for r in got} == {(m, q) for m in ("good", "bad", "none") for q in specs}
    assert all((r["metric_type"] == "error") == (r["method"] != "good") for r in got)


def test_canonical_spellings_in_portions(spark):
    import difflib

    known = [f"place {i}" for i in range(25)] + ["North Hill", "Nord Hill"]
    values = ["PLACE 3", "plce 17", "nort hill", "elsewhere", None, "place 100"]
    df = spark.createDataFrame([(v,) for v in values], "c string")
    ref = spark.createDataFrame([(v,) for v in known], "c string")
    low = {k.lower(): k for k in known}
    want = []
    for v in values:
        near = difflib.get_close_matches(v.lower(), sorted(low), n=1, cutoff=0.8) if v else []
        want.append(low[near[0]] if near else v)
    for most in (100_000, 4):
        assert sorted(map(str, (r["c"] for r in R.canonicalize(df, "c", ref, most=most).collect()))) == sorted(map(str, want))


def test_support_by_top_and_averages(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1), ("c", 1), ("c", 2), ("c", 3), (None, 9)], "k string, u int")
    count = lambda x: {tuple(r) for r in x.groupBy("k").count().collect()}
    assert count(Y.supported_or_other(df, "k", "u", 2)) == {("a", 2), ("c", 3), ("Other", 3)}
    assert count(Y.supported_or_other(df, "k", "u", top=1)) == {("c", 3), ("Other", 5)}
    v = spark.createDataFrame([("aggregate", "m", 1.0, True), ("aggregate", "m", 0.0, False), ("histogram", "m", 0.5, True)], "query_type string, method string, score double, passed boolean")
    assert {tuple(r) for r in E.type_averages(v).collect()} == {("aggregate", "m", 0.5, 0.5, 2), ("histogram", "m", 0.5, 1.0, 1)}


def test_saved_tables_and_checks(spark, tmp_path):
    df = spark.createDataFrame([("g1", 1), ("g2", 2)], "guid string, n int")
    got = tables.write_table(df, f"{tmp_path}/t").first()
    assert got["rows"] == got["keys"] == 2 and got["same_schema"] and len(got["sample"]) == 2
    assert [tuple(r) for r in tables.schema_of(df).orderBy("position").collect()] == [(0, "guid", "string", True), (1, "n", "int", True)]
    assert len(S.fresh_seed()) == 32 and S.fresh_seed() != S.fresh_seed()
    a, b = (spark.range(50).select(S.uniform("id").alias("u")).agg(F.sum("u")).first()[0] for _ in range(2))
    assert a != b


def test_large_marginals_are_drawn_from_by_groups(spark, monkeypatch):
    monkeypatch.setattr(Y, "MOST_SENT", 5)
    df = spark.range(2000).select((F.col("id") % 100).cast("double").alias("x"))
    got = Y.sample_marginal(Y.marginal(df, "x", 10.0, seed="m"), 400, "s", True)
    assert got.count() == 400 and got.agg(F.avg("value")).first()[0] == pytest.approx(49.5, abs=5)


def test_halves_of_the_devices_are_close(spark):
    from telemill.plans import over_tables

    t = over_tables._Tables(spark, "/root/testdata/sf0.001")
    names = ["popular_browsers_by_count_usage_percentage", "server_class_network_consumption"]
    got = {(r["query"], r["metric_type"], r["column"]): r["value"] for r in benchmark.split_half(t, "7", names).collect()}
    assert {k[0] for k in got} == set(names) and not any(k[1] == "error" for k in got)
    assert got["popular_browsers_by_count_usage_percentage", "total_variation", "percent_instances"] < 0.3


def test_ledger_refuses_to_overspend():
    ledger = P.Ledger(3.5, 1e-5)
    assert P.zcdp_epsilon(ledger.rho, 1e-5) == pytest.approx(3.5)
    ledger.charge(("a", ledger.rho / 2))
    assert 0 < ledger.epsilon_spent() < 3.5
    with pytest.raises(ValueError):
        ledger.charge(("b", ledger.rho / 4), ("c", ledger.rho / 2))
    assert [n for n, _ in ledger.charges] == ["a"]
    ledger.charge(("b", ledger.left))
    assert ledger.left == 0 and ledger.epsilon_spent() == pytest.approx(3.5)
    with pytest.raises(ValueError):
        ledger.charge(("d", 1e-6))
    with pytest.raises(ValueError):
        ledger.charge(("d", -1.0))


def test_whole_counts_add_up(spark):
    import random

    rng = random.Random(5)
    rows = [(g, f"s{k:03}", 7.0 if g == "c" else rng.choice([0.0, 0.4, 3.0, 3.0, 1000.0 * rng.random()])) for g, m in (("a", 40), ("b", 7), ("c", 1), ("few", 30)) for k in range(m)] + [("none", "s", 0.0)]
    targets = {"a": 1000, "b": 11, "c": 5, "few": 12, "none": 9}
    got = G.whole_counts(spark.createDataFrame(rows, "active_group string, stratum string, n_public double"), targets).collect()
    sums = {g: sum(r["n"] for r in got if r["active_group"] == g) for g in targets}
    assert sums == {"a": 1000, "b": 11, "c": 5, "few": 12, "none": 0}
    assert all(r["n"] >= 1 for r in got) and len([r for r in got if r["active_group"] == "a"]) == 40
    for g in "ab":
        here = [r for r in got if r["active_group"] == g]
        whole = sum(r["n_public"] for r in here)
        assert all(abs(r["n"] - 1 - r["n_public"] / whole * (targets[g] - len(here))) < 1 for r in here)


def test_plan_of_results(spark):
    from telemill.plans import generation, over_tables

    results = generation._results(spark, "/root/testdata/sf0.01")
    ledger = P.Ledger(3.5, 1e-5)
    p = G.build_plan(results, 5000, ledger, "x").cache()
    G.build_hints(results, ledger, "x").collect()
    assert ledger.left == pytest.approx(0, abs=1e-12) and ledger.epsilon_spent() == pytest.approx(3.5)
    with pytest.raises(ValueError):
        G.build_plan(results, 5000, ledger, "y")
    per = {r["active_group"]: r["n"] for r in p.groupBy("active_group").agg(F.sum("n").alias("n")).collect()}
    assert per == {"net": 1238, "mem": 1089, "browser_webcat": 990, "onoff": 891, "batt": 743, "hw": 49} and sum(per.values()) == 5000
    whole = p.where("active_group = 'browser_webcat'").select(F.aggregate(F.map_values("numeric_targets"), F.lit(0.0), lambda a, v: a + v).alias("s")).collect()
    assert whole and all(r["s"] == pytest.approx(100) for r in whole)
    ram = p.where("active_group = 'mem'").select((F.element_at("numeric_targets", "mem_sysinfo_ram") / F.element_at("cat_constraints", "ram").cast("double")).alias("x")).collect()
    assert {r["x"] for r in ram} == {1024.0}
    # the noise is that of the accounting: rho of a group is queries / (2 sigma^2)
    rows = G.accounting(results, ledger).collect()
    assert all(r["queries"] / (2 * r["sigma"] ** 2) == pytest.approx(ledger.rho / 7) for r in rows) and len(rows) == 7
    assert {r["sigma"] for r in rows if r["name"] == "hw"} == {r["sigma"] for r in p.where("active_group = 'hw'").collect()}
    assert over_tables.result("pkg_power_by_country", over_tables._Tables(spark, "/root/testdata/sf0.01")).count() == 5


def test_published_specs(spark):
    assert len(benchmark.SPECS) == 21 and set(benchmark.SPECS) == set(benchmark.QUERIES) - set(benchmark.INFEASIBLE)
    from telemill.plans import over_tables

    t = over_tables._Tables(spark, "/root/testdata/sf0.001")
    for name, spec in benchmark.SPECS.items():
        have = benchmark.QUERIES[name](t).columns
        assert {*spec.keys, *spec.values, *spec.groups} <= set(have) and (spec.weight is None or spec.weight in have), name


def test_metric_rows_of_each_type(spark):
    rows = lambda kind, a, b, **k: {(r["column"], r["metric_type"]): (round(r["value"], 6), r["passed"], r["detail"]) for r in E.evaluate("q", kind, a, b, **k).collect()}
    a = spark.createDataFrame([("x", "p", 10.0, 1.0), ("x", "q", 20.0, None), ("y", "p", 0.0, 3.0), ("z", "p", 5.0, 4.0)], "g string, h string, v double, w double").coalesce(1)
    b = spark.createDataFrame([("x", "p", 11.0, 2.0), ("x", "q", 30.0, 2.0), ("y", "p", 1.0, 3.0), ("w", "p", 5.0, 4.0)], "g string, h string, v double, w double").coalesce(1)
    got = rows("aggregate", a, b, keys=["g", "h"], values=["v", "w", "gone"])
    assert got["group_coverage", "jaccard"] == (0.6, True, "3/4 real groups matched, 4 synth groups total")
    assert got["v", "median_relative_error"][:2] == (0.5, False) and got["w", "median_relative_error"] == (0.5, False, "median RE=0.5000, mean RE=0.5000, n_groups=2") and len(got) == 3
    apart = rows("aggregate", a.where("g = 'z'"), b, keys=["g", "h"], values=["v"])
    assert apart["v", "relative_error"] == (math.inf, False, "no overlapping groups")
    bins = rows("histogram", a.where("h = 'p'"), b.where("h = 'p'"), keys=["g"], values=["w"], weight="v")
    # of 15 and 17: 10/15 against 11/17, 0 against 1/17, 5/15 against 0, 0 against 5/17
    assert bins["v_distribution", "total_variation"][0] == round(0.5 * (abs(10 / 15 - 11 / 17) + 1 / 17 + 5 / 15 + 5 / 17), 6) and bins["w", "median_relative_error"][0] == 0.5
    ranked = rows("ranking_numeric", a, b, keys=["g", "h"], values=["v"], groups=["g"])
    assert ranked["item_overlap", "mean_jaccard"] == (1.0, True, "avg Jaccard=1.0000 across 2 groups") and ranked["v_rank_corr", "mean_spearman_rho"] == (1.0, True, "avg rho=1.0000 across 1 groups")
    assert rows("ranking_numeric", a.where("g = 'z'"), b, keys=["g", "h"], values=["v"], groups=["g"]) == {("group_coverage", "jaccard"): (0.0, False, "no overlapping groups")}
    plain = rows("ranking_numeric", a.where("h = 'p'"), b.where("h = 'p'"), keys=["g"], values=["v", "w"])
    assert plain["item_overlap", "jaccard"][0] == 0.5 and plain["v_rank_corr", "spearman_rho"] == (1.0, True, "rho=1.0000, n_items=2") and plain["w_rank_corr", "spearman_rho"][0] == 1.0
    level = rows("row_level", a, b.limit(3), keys=["h"], values=["v"])
    assert level["row_count", "relative_error"] == (0.25, True, "real=4, synth=3") and level["h_distribution", "total_variation"][0] == round(abs(3 / 4 - 2 / 3), 6) and ("v_mean", "relative_error") in level
    assert rows("ranking_categorical", a.where("h = 'q'"), b.where("g = 'w'"), keys=["g"], values=["h"]) == {("h", "categorical_accuracy"): (0.0, False, "no overlapping groups")}


def test_normalized_errors_from_end_to_end(spark):
    from telemill.plans import over_tables

    t = over_tables._Tables(spark, "/root/testdata/sf0.001")
    names = ["pkg_power_by_country", "popular_browsers_by_count_usage_percentage"]
    got = benchmark.normalized_errors(t, {"same": t, "half": benchmark.halves(t, "9")[0]}, "42", names).cache()
    same = [r["normalized"] for r in got.where("method = 'same'").collect()]
    assert same and all(x == 0 for x in same)
    rows = {r["method"]: r for r in E.normalized_summary(got).collect()}
    assert rows["same"]["mean"] == 0 and rows["half"]["mean"] > 0 and rows["half"]["count"] == rows["same"]["count"] == len(same)


def test_quantiles_of_many_columns_in_one_plan(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    data = [(float(rng.integers(0, 30)), float(rng.normal()), None) for _ in range(700)]
    df = spark.createDataFrame(data, "a double, b double, c double").repartition(3)
    got = {r["name"]: r["__q"] for r in ranks.quantiles_of(df, ["a", "b", "c"], [0.0, 0.31, 1.0]).collect()}
    assert got["a"] == pytest.approx(np.quantile([r[0] for r in data], [0, 0.31, 1]).tolist()) and got["b"] == pytest.approx(np.quantile([r[1] for r in data], [0, 0.31, 1]).tolist()) and got["c"] == [None] * 3
    # ranks without groups go by parts: no window over all rows, and nothing is checkpointed while the plan is made
    a, b = (spark.range(500).select("id", (F.rand(s) * 9).cast("int").alias("v")) for s in (1, 2))
    plan = E.spearman(a, b, ["id"], "v", [])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "WindowGroupLimit" not in line]
    assert windows and all("part" in line for line in windows) and "LogicalRDD" not in plan


# --- range joins, key assignment ---


def test_periods_of_all_lengths(spark):
    import datetime as dt
    import random

    from telemill.operators.ranges import join_periods

    rng = random.Random(6)
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)
    # device 0 has half of the events; periods from a day to eighty years, reversed and missing ones
    events = [(0 if k % 2 else rng.randrange(1, 9), None if k % 97 == 0 else day(rng.randrange(-400, 400)), k) for k in range(1200)] + [(None, day(0), -1)]
    periods = []
    for k in range(150):
        a = rng.randrange(-500, 400)
        periods.append((rng.randrange(0, 9), day(a), day(a + rng.choice([0, 1, 29, 30, 600, 5000, 30000])), k))
    periods += [(1, day(5), day(3), -1), (1, None, day(3), -2), (1, day(3), None, -3), (None, day(-9), day(9), -4)]
    e = spark.createDataFrame(events, "g int, d date, e int")
    p = spark.createDataFrame(periods, "h int, lo date, hi date, p int")
    want = sorted((e_, p_) for g, d, e_ in events for h, lo, hi, p_ in periods if g is not None and g == h and None not in (d, lo, hi) and lo <= d <= hi)
    j = join_periods(e, "d", ["g"], p, "lo", "hi", ["h"], 30.0)
    assert sorted((r["e"], r["p"]) for r in j.collect()) == want and j.columns == ["g", "d", "e", "h", "lo", "hi", "p"]
    for unit in ("timestamp", "double"):
        c = lambda x: F.col(x).cast("timestamp") if unit == "timestamp" else F.unix_date(x).cast("double")
        f, q = e.withColumn("d", c("d")), p.withColumn("lo", c("lo")).withColumn("hi", c("hi"))
        assert sorted((r["e"], r["p"]) for r in join_periods(f, "d", ["g"], q, "lo", "hi", ["h"], 86400.0 * 7 if unit == "timestamp" else 7.5).collect()) == want
    assert join_periods(e, "d", ["g"], p.limit(0), "lo", "hi", ["h"], 30.0).count() == 0


def test_one_device_is_many_groups(spark):
    from telemill.operators.ranges import join_periods

    e = spark.range(4000).select(F.lit("hot").alias("g"), (F.col("id") % 1000).cast("double").alias("t"))
    p = spark.range(40).select(F.lit("hot").alias("h"), (F.col("id") * 25).cast("double").alias("lo"), (F.col("id") * 25 + 24).cast("double").alias("hi"))
    j = join_periods(e, "t", ["g"], p, "lo", "hi", ["h"], 10.0)
    assert j.count() == 4000
    plan = j._jdf.queryExecution().optimizedPlan().toString()
    [join] = [line for line in plan.splitlines() if "Join Inner" in line and "__bucket" in line]
    assert "__in" in join and "__on" in join


def test_every_row_gets_a_device(spark):
    devices = spark.range(200).select(F.format_string("g%d", "id").alias("guid"))
    for n, rate in ((30, 0.25), (50, 0.25), (3000, 0.25), (40, 0.0001)):
        rows = spark.range(n).withColumnRenamed("id", "row")
        got = Y.assign_by_rate(rows, "row", devices, "guid", rate, "s").collect()
        k = max(1, int(200 * rate))
        per = {}
        for r in got:
            per[r["guid"]] = per.get(r["guid"], 0) + 1
        assert len(got) == n == len({r["row"] for r in got}) and len(per) <= k
        if n <= k:
            assert max(per.values()) == 1
        elif k > 1:
            assert len(per) == k and max(per.values()) < 2 * n / k
        again = Y.assign_by_rate(rows.repartition(7), "row", devices.repartition(3), "guid", rate, "s").collect()
        assert sorted(map(str, got)) == sorted(map(str, again))


# --- fitted features ---


def test_features_and_back(spark, tmp_path):
    import numpy as np

    from telemill.operators import features

    rng = np.random.default_rng(2)
    rows = [(i, str(rng.choice(["a", "b", "c", "d"], p=[0.5, 0.3, 0.15, 0.05])), float(rng.integers(0, 3)), float(rng.gamma(1, 50))) for i in range(1500)] + [(9000, None, None, float("nan")), (9001, "a", -5.0, 1e9)]
    df = spark.createDataFrame(rows, "id int, c string, x double, y double").withColumn("e", F.lit("only")).cache()
    fitted = features.fit(df, ["x", "y"], ["c", "e"], top=3, quantile=0.99)
    assert fitted.categories == {"c": ["a", "b", "c"], "e": ["only"]} and fitted.size == 4 + 2 + 2
    fitted.save(spark, f"file://{tmp_path}/fitted")
    assert features.Prepared.load(spark, f"file://{tmp_path}/fitted") == fitted
    got = fitted.transform(df)
    v = np.array([r["features"] for r in got.orderBy("id").collect()])
    x = np.array([[0 if r[2] is None else r[2], 0 if r[3] != r[3] else r[3]] for r in sorted(rows)])
    clip = [np.quantile([r[k] for r in rows if r[k] is not None and r[k] == r[k]], 0.99) for k in (2, 3)]
    logs = np.log1p(np.clip(np.minimum(x, clip), 0, None))
    assert np.allclose(v[:, 6:], (logs - logs.mean(0)) / logs.std(0)) and (v[:, :4].sum(1) == 1).all() and (v[:, 4:6] == [1, 0]).all()
    back = {r["id"]: r for r in fitted.inverse(got.select("id", "features")).collect()}
    for i, c, a, b in rows:
        assert back[i]["c"] == (c if c in ("a", "b", "c") else "Other") and back[i]["e"] == "only"
        assert back[i]["x"] == pytest.approx(min(max(a or 0.0, 0.0), clip[0])) and back[i]["y"] == pytest.approx(min(max(b if b == b else 0.0, 0.0), clip[1]))
    # drawn by exp of the places: a place far above the others always, equal places evenly
    z = spark.range(3000).select("id", F.array(*map(F.lit, [0.0, 0.0, -40.0, -40.0, 50.0, 0.0, 0.0, 0.0])).alias("features"))
    drawn = {(r["c"], r["e"]): r["count"] for r in fitted.inverse(z, seed="s", key="id").groupBy("c", "e").count().collect()}
    assert set(drawn) == {("a", "only"), ("b", "only")} and abs(drawn["a", "only"] - 1500) < 120
    empty = features.fit(df.limit(0), ["x"], ["c"])
    assert empty.transform(df).count() == 1502 and empty.size == 2
