"""Evolution that is stopped at each stage ends as one that never was, without another draw of noise."""

import pytest
from pyspark.sql import functions as F

from telemill.operators import evolution
from telemill.operators import plan as G
from telemill.operators import synthesis as Y

TOLD = {"n": 8, "rounds": 3, "epsilon": 4.0, "delta": 1e-5, "data": "fixture"}


class Stop(Exception):
    pass


def _parts(spark):
    real = spark.createDataFrame([("Notebook", 31.0 + i % 5) for i in range(40)] + [("Desktop", 54.0) for _ in range(20)], "chassistype string, mem double")
    plan = spark.createDataFrame([("mem", 12, {"chassistype": "Notebook"}, {"mem": 30.0}), ("mem", 12, {"chassistype": "Desktop"}, {"mem": 50.0})], "active_group string, n long, cat_constraints map<string,string>, numeric_targets map<string,double>")
    gen = G.SampledGenerator(["mem"], ["chassistype"], "s")
    return real, lambda: gen.generate(plan), lambda parents, k: gen.vary(parents, 2, k)


def _end(spark, folder, real, first, vary):
    return sorted(map(str, evolution.run(real, folder, first, vary, ["mem"], ["chassistype"]).collect()))


def test_stopped_runs_end_alike(spark, tmp_path, monkeypatch):
    real, first, vary = _parts(spark)
    fresh = lambda k: f"secret {k}"
    whole = evolution.RunFolder(spark, f"file://{tmp_path}/whole", TOLD, fresh)
    want = _end(spark, whole, real, first, vary)
    assert len(want) == 8
    draws = []
    noisy = Y.noisy_votes
    monkeypatch.setattr(Y, "noisy_votes", lambda votes, sigma, seed: (draws.append(seed), noisy(votes, sigma, seed))[1])
    # a run that is stopped after each record that it writes, and goes on as a new one
    write, records, seeds = evolution.RunFolder._write, [], []

    def write_and_stop(self, record, what):
        write(self, record, what)
        records.append(record)
        raise Stop

    monkeypatch.setattr(evolution.RunFolder, "_write", write_and_stop)
    got = None
    for _ in range(30):
        try:
            folder = evolution.RunFolder(spark, f"file://{tmp_path}/stopped", TOLD, lambda k: (seeds.append(k), fresh(k))[1])
            got = _end(spark, folder, real, first, vary)
            break
        except Stop:
            pass
    assert got == want
    assert records == ["parameters", *(f"{k:04}-{s}" for k in range(3) for s in ("population", "seed", "votes", "selected"))]
    # one seed an iteration, and all noise of an iteration from it
    assert seeds == [0, 1, 2] and set(draws) == {"secret 0", "secret 1", "secret 2"}
    n = len(draws)
    assert _end(spark, folder, real, first, vary) == want and len(draws) == n
    h = [tuple(r)[:3] for r in folder.history().collect()]
    assert h == [(0, "population", 24), (0, "votes", 24), (0, "selected", 8), (1, "population", 24), (1, "votes", 24), (1, "selected", 8), (2, "population", 24), (2, "votes", 24), (2, "selected", 8)]
    assert evolution.spent_epsilon(folder) == pytest.approx(4.0, rel=1e-3)


def test_votes_lost_before_their_record_are_drawn_from_the_same_seed(spark, tmp_path, monkeypatch):
    real, first, vary = _parts(spark)
    folder = evolution.RunFolder(spark, f"file://{tmp_path}/a", TOLD | {"rounds": 1})
    write = evolution.RunFolder._write

    def lose_votes(self, record, what):
        if record.endswith("votes"):
            raise Stop
        write(self, record, what)

    monkeypatch.setattr(evolution.RunFolder, "_write", lose_votes)
    with pytest.raises(Stop):
        _end(spark, folder, real, first, vary)
    lost = spark.read.parquet(f"file://{tmp_path}/a/0000-votes-*")
    before = sorted(map(tuple, lost.collect()))
    monkeypatch.setattr(evolution.RunFolder, "_write", write)
    _end(spark, evolution.RunFolder(spark, f"file://{tmp_path}/a", TOLD | {"rounds": 1}), real, first, vary)
    again = spark.read.parquet(f"file://{tmp_path}/a/{folder._read('0000-votes')['folder']}")
    assert sorted(map(tuple, again.collect())) == before and lost.where("votes <> cast(votes as long)").count() > 0


def test_other_parameters_are_refused(spark, tmp_path):
    evolution.RunFolder(spark, f"file://{tmp_path}/p", TOLD)
    evolution.RunFolder(spark, f"file://{tmp_path}/p", dict(reversed(TOLD.items())))
    with pytest.raises(ValueError, match="epsilon"):
        evolution.RunFolder(spark, f"file://{tmp_path}/p", TOLD | {"epsilon": 5.0})


def test_sampled_selection_and_forgotten_seeds(spark, tmp_path):
    real, first, vary = _parts(spark)
    real = real.withColumn("guid", F.concat(F.lit("g"), F.monotonically_increasing_id()))
    folder = evolution.RunFolder(spark, f"file://{tmp_path}/s", {"n": 30, "rounds": 1, "epsilon": 8.0, "delta": 1e-5, "method": "sampled", "voters": 25, "key": "guid"})
    got = evolution.run(real, folder, first, vary, ["mem"], ["chassistype"]).cache()
    assert got.count() == 30 == got.select("guid").distinct().count()
    folder.forget_seeds()
    assert folder._read("0000-seed") is None and evolution.run(real, folder, first, vary, ["mem"], ["chassistype"]).count() == 30
