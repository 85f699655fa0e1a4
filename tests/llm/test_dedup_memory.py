"""Memory of near-dedup's tasks: texts reach Python in small batches, and are hashed and counted in little memory."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from telemill.llm import common, simhash, wordhash


def _texts(n, words, seed=1):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{v}" for v in rng.integers(0, 1 << 40, words).tolist()) for _ in range(n)]


def test_texts_travel_in_small_batches(spark, monkeypatch):
    large, all_of_them = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    frame = type(spark.range(0))
    plain = frame.mapInArrow

    def told(self, fn, *a, **b):
        def run(batches):
            def seen():
                for batch in batches:
                    all_of_them.add(1)
                    large.add(int(batch.nbytes > 2 * (4 << 20)))
                    yield batch

            return fn(seen())

        return plain(self, run, *a, **b)

    monkeypatch.setattr(frame, "mapInArrow", told)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    texts = _texts(600, 2500)
    texts += [t + " end" for t in texts[:20]] + ["", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    kept = simhash.keep_one_each(docs).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == [*range(600), 620]
    assert all_of_them.value > 0 and large.value == 0
    assert spark.conf.get(name, None) == before


def test_setting_comes_back_after_a_failure(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, "123456789")
    try:
        with pytest.raises(ValueError), common.small_batches(spark):
            assert spark.conf.get(name) == str(common.BATCH_BYTES)
            raise ValueError
        assert spark.conf.get(name) == "123456789"
    finally:
        spark.conf.unset(name)


@pytest.mark.parametrize("words", [simhash.WORD_BYTES, None])
def test_a_long_text_is_hashed_in_parts(words):
    fold = {} if words is None else {"fold": words}
    text = _texts(1, 300_000)[0] + " " + "x" * 700_000 + " é " + "the end"
    tracemalloc.start()
    try:
        whole, at = wordhash.hash_words(["", text, "b"], **fold)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 14 * len(text)
    each = [wordhash.hash_words([w], **fold)[0] for w in [*text.split()[:2000], *text.split()[-30:]]]
    assert np.array_equal(np.concatenate(each[:2000]), whole[:2000]) and np.array_equal(np.concatenate(each[2000:]), whole[-31:-1])
    assert at.tolist() == [0, 0, len(text.split()), len(text.split()) + 1]


def test_shared_shingles_are_counted_in_little_memory():
    texts = _texts(60, 8000)
    texts += [texts[0] + f" {i}" for i in range(5)] + [texts[1] + " x"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["key", "text"])
    size = sum(map(len, texts))
    tracemalloc.start()
    try:
        out = list(simhash._counted(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4 * size
    shared = {h: c for b in out for h, c in zip(b.column("h").to_pylist(), b.column("c").to_pylist(), strict=True) if h is not None}
    first = simhash.shingle_sets([texts[0].encode()])[0].tolist()
    assert shared == dict.fromkeys(first, 6)
    assert sum(k is not None for b in out for k in b.column("key").to_pylist()) == len(texts)
