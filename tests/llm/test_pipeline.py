"""The pipeline's stages in order, each held against what it must do to its own input."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from telemill.llm import common


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(0)
    vocabulary = [f"{a}{b}{c}" for a in ("th", "er", "ing", "on") for b in ("at", "es", "ou", "ly") for c in ("", "en", "ha")]
    plain = lambda n=150: list(rng.choice(vocabulary, n))
    rows, item = [], plain(30)
    for i in range(240):
        w = plain()
        if i % 10 == 0:
            w = [x + "%%%" for x in w]
        elif i % 10 == 1:
            w[60:60] = item
        elif i % 10 == 2:
            w = rows[-1][1].split() if i % 20 == 2 else w
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.parted(stage(spark, docs, str(tmp_path)), "t")
        seen[name] = docs
    assert [n.split()[0] for n in seen] == ["quality", "SimHash", "benchmark", "mixing", "token-ID"]
    good = {r["doc_id"] for r in seen["quality classifier"].collect()}
    assert good == {i for i in range(240) if i % 10}
    one = {r["doc_id"] for r in seen["SimHash near-dedup"].collect()}
    assert good - one == {i for i in good if i % 20 == 2}
    clean = {r["doc_id"] for r in seen["benchmark decontamination"].collect()}
    assert clean == {i for i in one if i % 10 != 1}
    mixed = seen["mixing sources"]
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars"] and mixed.where(F.length("text") != F.col("n_chars")).count() == 0
    words = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(F.size(F.split("text", "\\s+"))).alias("n")).collect()}
    assert words["s0"] > words["s1"] > words["s2"]
    assert {r["doc_id"] for r in seen["token-ID output"].collect()} == {r["doc_id"] for r in mixed.collect()}
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, seen["token-ID output"].collect()))


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    rng = np.random.default_rng(1)
    vocabulary = [f"{a}{b}{c}" for a in ("th", "er", "ing", "on") for b in ("at", "es", "ou", "ly") for c in ("", "en", "ha")]
    plain = lambda n: " ".join(rng.choice(vocabulary, n)) + "."
    long, twice = plain(40_000), plain(80)
    rows = [(i, plain(120), None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}") for i in range(60)]
    rows += [(60, None, None, None), (61, "", "en", "s0"), (62, " \n\t", "en", None), (63, long, "en", "s1"), (None, plain(90), "en", "s1"), (64, twice, "en", "s2"), (64, twice, "en", "s2"), (65, twice.upper().replace(" ", "  "), "en", "s2")]
    made = [(i, t, lang, source, None, k, f"k{k}", k, k) for k, (i, t, lang, source) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key long, row string, `a.b` long, __n long"
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "w1 w2 w3 w4 w5 w6")], "item_id long, text string")
    docs = spark.createDataFrame(made, schema)
    for name, df in (("odd", docs), ("empty", docs.limit(0))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        (bench if name == "odd" else bench.limit(0)).write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    seen, at = docs, {r[5]: r for r in made}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = common.parted(stage(spark, seen, f"{tmp_path}/odd"), "t")
        assert seen.columns == docs.columns, name
        got = seen.collect()
        # every row that is left has all its other columns as they were
        assert got and all((r["doc_id"], r["lang"], r["source"], r["row"], r["a.b"], r["__n"]) == (at[r["key"]][0], at[r["key"]][2], at[r["key"]][3], f"k{r['key']}", r["key"], r["key"]) for r in got), name
        kept = [r["doc_id"] for r in got]
        if name != "mixing sources":
            assert set(range(60)) | {63, None} <= set(kept) and not {60, 61, 62} & set(kept)
        if name == "SimHash near-dedup":
            assert len([i for i in kept if i in (64, 65)]) == 1
    done = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert sorted(map(str, {r["doc_id"] for r in done})) == sorted(map(str, set(kept))) and all(r["verified"] for r in done)
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
