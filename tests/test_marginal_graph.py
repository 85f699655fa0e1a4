"""Trees of two-way marginals: counts, trees and draws against brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from telemill.functions import privacy as P
from telemill.operators import marginal_graph as M


def _data(spark, n=3000):
    rng = random.Random(4)
    rows = []
    for _ in range(n):
        a = rng.choice("aaabbc")
        b = a.upper() if rng.random() < 0.9 else rng.choice("ABC")
        c = rng.choice("pq")
        x = {"p": 10.0, "q": 60.0}[c] + 20 * rng.random() if rng.random() < 0.95 else None
        rows.append((a, b, c, x, None if rng.random() < 0.02 else rng.choice("yz")))
    return spark.createDataFrame(rows, "a string, b string, c string, x double, d string").cache(), rows


DOMAINS = [M.Domain("a", ("a", "b", "c")), M.Domain("b", ("A", "B", "C")), M.Domain("c", ("p", "q")), M.Domain("x", low=0.0, high=100.0, bins=5), M.Domain("d", ("y", "z"))]


def _codes(row):
    out = []
    for d, v in zip(DOMAINS, row, strict=True):
        if d.bins:
            out.append(d.bins if v is None else min(max(math.floor((v - d.low) / (d.high - d.low) * d.bins), 0), d.bins - 1))
        else:
            out.append(d.values.index(v) if v in d.values else len(d.values))
    return out


def test_counts_information_and_tree(spark):
    df, rows = _data(spark)
    coded = [_codes(r) for r in rows]
    pairs = list(itertools.combinations(range(5), 2))
    got = {(r["i"], r["j"], r["a"], r["b"]): r["n"] for r in M.pair_counts(df, DOMAINS, pairs).collect()}
    assert len(got) == sum(DOMAINS[i].size * DOMAINS[j].size for i, j in pairs)
    assert all(n == sum(c[i] == a and c[j] == b for c in coded) for (i, j, a, b), n in got.items())
    mi = {(r["i"], r["j"]): r["mi"] for r in M.mutual_information(M.pair_counts(df, DOMAINS, pairs)).collect()}
    for i, j in pairs:
        n, want = len(coded), 0.0
        for a, b in itertools.product(range(DOMAINS[i].size), range(DOMAINS[j].size)):
            k = got[i, j, a, b]
            if k:
                want += k / n * math.log(k * n / (sum(c[i] == a for c in coded) * sum(c[j] == b for c in coded)))
        assert mi[i, j] == pytest.approx(want, abs=1e-9)
    tree = M.spanning_tree(mi, 5)
    # of all trees over five columns none has a greater sum
    best = 0.0
    for edges in itertools.combinations(pairs, 4):
        seen, grew = {0}, True
        while grew:
            grew = False
            for i, j in edges:
                if (i in seen) != (j in seen):
                    seen |= {i, j}
                    grew = True
        if len(seen) == 5:
            best = max(best, sum(mi[e] for e in edges))
    assert sum(mi[min(e), max(e)] for e in tree) == pytest.approx(best) and {(0, 1), (2, 3)} <= {(min(e), max(e)) for e in tree}


def test_drawn_records_have_the_tables(spark):
    df, _ = _data(spark)
    ledger = P.Ledger(50.0, 1e-5)
    model = M.fit(df, DOMAINS, ledger, seed="s")
    assert ledger.left == pytest.approx(0, abs=1e-9)
    drawn = M.draw(spark, model, 4000, "d").cache()
    assert drawn.columns == ["id", "a", "b", "c", "x", "d"] and drawn.count() == 4000
    far = {(r["left"], r["right"]): r["total_variation"] for r in M.table_distance(df, drawn, DOMAINS).collect()}
    assert len(far) == 10 and max(far.values()) < 0.06, far
    assert sorted(map(str, drawn.collect())) == sorted(map(str, M.draw(spark, model, 4000, "d").repartition(7).collect()))
    assert drawn.where("x < 0 or x > 100").count() == 0 and drawn.where("x is null").count() > 0 and drawn.where("d = 'Other'").count() > 0


def test_less_budget_more_noise(spark):
    df, _ = _data(spark, 500)
    means = []
    for epsilon in (20.0, 0.05):
        model = M.fit(df, DOMAINS, P.Ledger(epsilon, 1e-5), seed="n")
        means.append(M.table_distance(df, M.draw(spark, model, 3000, "d"), DOMAINS).agg(F.avg("total_variation")).first()[0])
    assert means[0] < 0.1 < means[1]


def test_odd_rows_and_bounds(spark):
    df, _ = _data(spark, 50)
    assert [d.values for d in M.frequent(df, ["a", "d"], 2)] == [("a", "b"), ("y", "z")]
    empty = M.fit(df.limit(0), DOMAINS, P.Ledger(1.0, 1e-5), seed="e")
    assert M.draw(spark, empty, 20, "d").count() == 20
    with pytest.raises(ValueError):
        M.fit(df, DOMAINS[:1], P.Ledger(1.0, 1e-5))
    with pytest.raises(ValueError):
        M.fit(df, [DOMAINS[0], M.Domain("x", low=0.0, high=1.0, bins=64)], P.Ledger(1.0, 1e-5))
    ledger = P.Ledger(1.0, 1e-5)
    with pytest.raises(ValueError):
        M.fit(df, DOMAINS, ledger, rho=2 * ledger.rho)
