"""Small graphs dealt over many partitions: each task joins its edges first."""

import numpy as np

from telemill.llm import common
from telemill.llm import components as C


def _by_hand(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def test_few_edges_take_few_tasks(spark):
    chain = [(i, i + 1) for i in range(-150, 150)]
    edges = common.settle(spark.createDataFrame(chain + chain[:50] + [(5, 5)], "a long, b long").repartition(64))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    context = spark.sparkContext
    try:
        context.setJobGroup("few edges", "few edges")
        got = C.connected_components(edges).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r["node"], r["root"]) for r in got) == [(i, -150) for i in range(-150, 151)]
    told = context.statusTracker()
    stages = {s for j in told.getJobIdsForGroup("few edges") for s in told.getJobInfo(j).stageIds}
    # the edges, written and counted; a round of shuffles over all partitions takes more
    assert sum(told.getStageInfo(s).numTasks for s in stages if told.getStageInfo(s)) < 4 * 64


def test_edges_of_many_tasks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    edges = rng.integers(-400, 400, (600, 2)).tolist() + [[10_000, 10_000 + i] for i in range(1, 300)] + [[20_000 + i, 20_001 + i] for i in range(200)]
    monkeypatch.setattr(C, "EDGES_AT_ONCE", 100)
    got = C.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(16)).collect()
    want = _by_hand([e for e in edges if e[0] != e[1]])
    assert len(got) == len(want) and {r["node"]: r["root"] for r in got} == want


def test_least_reached():
    rng = np.random.default_rng(4)
    for _ in range(20):
        edges = rng.integers(-60, 60, (int(rng.integers(1, 90)), 2))
        nodes, roots = C.least_reached(edges[:, 0], edges[:, 1])
        assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == _by_hand(edges.tolist())
