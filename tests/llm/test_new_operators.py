"""Whitening, shards and conversation repair against brute force, on odd rows and on tables cut in many ways."""

import hashlib
import itertools
import re
import zlib
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemill.llm import dialogue, sharding, whitening

# --- conversation repair ---

SPACE = " \t\n\x0b\x0c\r"


def brute_damage(rows):
    """rows: conv_id, turn, role, text -> conversation -> rows in order."""
    out = {}
    for conv, turn, role, text in rows:
        of = lambda x: " " if x is None else str(x)
        role, text, kind = of(role), of(text), zlib.crc32(f"{of(conv)}:{of(turn)}".encode()) % 20
        here = out.setdefault(conv, [])
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        here += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for here in out.values():
        here.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    return out


NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def brute_edits(rows, must_go, cut):
    """cost, audit, repaired rows by recursion over suffixes; the state is the last initial (nothing, s, u, a)."""

    @cache
    def best(i, last, inserted):
        found = []
        if i == len(rows):
            if last in ("", "a"):
                found.append((0, "", ()))
        else:
            role, text = rows[i]
            cost, audit, rest = best(i + 1, last, 0)
            found.append((2 + cost, "D" + audit, rest))
            if not must_go[i]:
                if role[:1] in NEXT[last]:
                    if role[:1]:
                        cost, audit, rest = best(i + 1, role[:1], 0)
                        found.append((cost + 5 * cut[i], "K" + audit, (f"{role}:{text}", *rest)))
                for new in ("user", "assistant"):
                    if new[0] in NEXT[last]:
                        cost, audit, rest = best(i + 1, new[0], 0)
                        found.append((1 + cost + 5 * cut[i], "R" + audit, (f"{new}:{text}", *rest)))
        if inserted < 3:
            for new in ("user", "assistant"):
                if new[0] in NEXT[last]:
                    cost, audit, rest = best(i, new[0], inserted + 1)
                    found.append((5 + cost, "I" + audit, (f"{new}:", *rest)))
        return min(found, default=(10**9, "", ()))

    return best(0, "", 0)


def brute_repair(rows):
    out = {}
    for conv, here in brute_damage(rows).items():
        seen, blank, duplicate, cut = set(), [], [], []
        for _, role, text in here:
            stripped = text.rstrip(SPACE)
            blank.append(not stripped.strip(SPACE))
            duplicate.append(not blank[-1] and (role, text) in seen)
            cut.append(not blank[-1] and not duplicate[-1] and stripped[-1] not in ".!?")
            seen.add((role, text))
        turns = {t for t, _, _ in here if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(here))
        cost, audit, kept = brute_edits(tuple(r[1:] for r in here), [a or b for a, b in zip(blank, duplicate, strict=True)], cut)
        out[conv] = (gaps, sum(blank), sum(duplicate), sum(cut), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_edits_are_the_cheapest_of_all():
    """The recursion above itself, against every sequence of edits of a few rows."""
    grammar = re.compile("(s?(ua)+)?")
    rng = np.random.default_rng(0)
    for _ in range(60):
        rows = [(str(rng.choice(["system", "user", "assistant", "tool"])), "x") for _ in range(rng.integers(0, 4))]
        gone, cut = [bool(rng.integers(4) == 0) for _ in rows], [bool(rng.integers(4) == 0) for _ in rows]
        found = []
        for letters in itertools.product("DKR", repeat=len(rows)):
            if any(g and x != "D" for g, x in zip(gone, letters, strict=True)):
                continue
            for inserts in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
                options = [[r[0][0]] if x == "K" else ["u", "a"] if x == "R" else [""] for r, x in zip(rows, letters, strict=True)]
                for roles in itertools.product(*options):
                    if grammar.fullmatch("".join(i + r for i, r in zip(inserts, (*roles, ""), strict=True))):
                        cost = sum({"D": 2, "K": 0, "R": 1}[x] + 5 * (c and x != "D") for x, c in zip(letters, cut, strict=True)) + 5 * len("".join(inserts))
                        found.append((cost, "".join("I" * len(i) + x for i, x in zip(inserts, (*letters, ""), strict=True))))
        assert brute_edits(tuple(rows), gone, cut)[:2] == min(found)


def conversations(rng, n):
    roles, texts = ["system", "user", "assistant", "tool", "", None, "user", "assistant"], ["Hi.", "Hello there", "So?", "", " \t", None, "é!", "x" * 50 + "."]
    for conv in range(n):
        for turn in range(rng.integers(1, 14)):
            yield (int(conv) if conv else None, None if rng.integers(12) == 0 else int(turn + 3 * (rng.integers(9) == 0)), roles[rng.integers(len(roles))], texts[rng.integers(len(texts))] if rng.integers(3) else f"text {rng.integers(50)}.")


CONVERSATION = "conv_id long, turn long, role string, text string"


def test_repair(spark):
    rng = np.random.default_rng(1)
    rows = list(conversations(rng, 150))
    # two conversations of many rows, one of them with one row very often
    rows += [(900, t, ("user", "assistant")[(t + t // 7) % 2], f"text {t % 40}" + ".?"[t % 2]) for t in range(700)] + [(901, 5, "user", "Again.")] * 300 + [(901, 6, "assistant", "Yes.")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], CONVERSATION + ", n long, conv string").repartition(3)
    want = brute_repair(rows)
    got = {r[0]: tuple(r)[1:] for r in dialogue.repair(dialogue.damaged(df)).select(*dialogue.RESULT).collect()}
    assert got.keys() == want.keys()
    assert {k: got[k] for k in want if got[k] != want[k]} == {}


def test_stretches_give_what_whole_conversations_give(spark, monkeypatch):
    """With stretches of 3 rows nearly all conversations go the long way."""
    monkeypatch.setattr(dialogue, "SEGMENT_ROWS", 3)
    rows = list(conversations(np.random.default_rng(2), 60))
    want = brute_repair(rows)
    ordered = dialogue.in_order(dialogue.damaged(spark.createDataFrame(rows, CONVERSATION)))
    # the functions run in worker processes, which don't see the patch of this one: cut the stretches here
    stretches, cells = [], lambda s: [(e, t, c, a) for e in range(4) for t, (c, a) in s.parse(e).items()]
    by_conv = {}
    for r in ordered.collect():
        by_conv.setdefault((r["gone"], r["conv"]), []).append(r)
    for (gone, conv), here in by_conv.items():
        for k in range(0, len(here), dialogue.SEGMENT_ROWS):
            s = dialogue.Stretch()
            for r in here[k : k + dialogue.SEGMENT_ROWS]:
                s.add(r["role"], r["text"], r["n"], r["blank"], r["first"], r["truncated"], r["turn"] if r["dated"] else None)
            stretches.append((gone, conv, k % 2, k, tuple(s.facts[f] for f in "n blank duplicate truncated illegal turns head tail low high".split()), cells(s), [x[:3] for x in s.rows]))
    schema = f"{dialogue._KEY}, part int, seq long, {dialogue._FACTS}, {dialogue._CELLS}, {dialogue._ROWS}"
    df = spark.createDataFrame([(*s[:2], s[3] // 6, *s[3:]) for s in stretches], schema)
    ways = dialogue.combined(df).cache()
    rest = ways.where("part is null").join(dialogue.hashed(df, ways), ["gone", "conv"])
    got = {None if r["gone"] else r["conv"]: tuple(r[c] for c in dialogue.RESULT[1:]) for r in rest.collect()}
    assert got == want


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], CONVERSATION)
    assert dialogue.repair(dialogue.damaged(empty)).collect() == []
    dropped = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    [row] = dialogue.repair(dialogue.damaged(spark.createDataFrame([(7, dropped, "user", "Hi.")], CONVERSATION))).collect()
    assert tuple(row) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# --- shards ---


def brute_jump(key, shards):
    at, upcoming = 0, 0
    while upcoming < shards:
        at = upcoming
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        upcoming = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_jump_moves_only_into_new_shards():
    keys = np.concatenate([np.arange(200), np.random.default_rng(0).integers(0, 1 << 60, 2000)])
    before = np.zeros(len(keys), int)
    for shards in (1, 2, 3, 8, 9, 10, 1000):
        got = sharding.jump(keys, shards)
        assert got.tolist() == [brute_jump(int(k), shards) for k in keys]
        assert ((got == before) | (got > before)).all()
        before = got
    spread = np.bincount(sharding.jump(np.random.default_rng(1).integers(0, 1 << 60, 80_000), 8))
    assert len(spread) == 8 and abs(spread / 10_000 - 1).max() < 0.05
    moved = (sharding.jump(keys[200:], 8) != sharding.jump(keys[200:], 9)).mean()
    assert 0.08 < moved < 0.145
    assert len(sharding.jump(np.zeros(0, np.int64), 8)) == 0


def test_shards_and_slots(spark, tmp_path):
    rows = [(None, "a"), (None, None), (1, ""), (2, "é"), (2, "é"), (3, "x" * 100_000)] + [(7, "hot")] * 400 + [(i, f"t{i}") for i in range(10, 300)]
    df = spark.createDataFrame([(i, t, "shard", 3) for i, t in rows], "doc_id long, text string, size string, slot int").repartition(5)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op12_sharding(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"key"}
    of = {}
    for r in got:
        key = int(hashlib.md5((b"-" if r["doc_id"] is None else b"=%d" % r["doc_id"])).hexdigest()[:15], 16)
        assert (r["shard"], r["grown_shard"]) == (brute_jump(key, 8), brute_jump(key, 9))
        of.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in of.values())
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"])
    for s in of:
        here = sorted((r for r in got if r["shard"] == s), key=lambda r: r["slot"])
        assert [key(r) for r in here] == sorted(map(key, here))
    again = sharding.op12_sharding(spark, str(tmp_path))
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_shard_files_and_growth(spark, tmp_path):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 50).alias("text"), F.lit(1).alias("key"))
    key = sharding.key_of("doc_id")
    sharding.write_shards(docs, f"{tmp_path}/s", key, 4, files=2)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == 500 and back.where(F.col("shard") != sharding.shard_of(key, 4)).count() == 0
    gone = sharding.moved(docs, key, 4, 6)
    assert 0 < gone.count() < 500 and gone.where("grown_shard < 4").count() == 0
    # equal texts together, where their digest is the key
    by_text = docs.withColumn("shard", sharding.shard_of(sharding.key_of(F.md5("text")), 4))
    assert by_text.groupBy("text").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0
    with pytest.raises(ValueError):
        sharding.write_shards(back, f"{tmp_path}/t", key)
    empty = spark.createDataFrame([], "doc_id long, text string")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert sharding.op12_sharding(spark, str(tmp_path)).collect() == []


# --- whitening ---


def brute_whitening(vectors, k):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), [int(v) for v in x.sum(0)]
    far = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    c = x - np.array(sums) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    down = np.argsort(-e)[:k]
    return far, c @ u[:, down] / np.sqrt(e[down]), e[down] / np.trace(v)


EMBEDDING = "vec_id long, embedding array<float>"


def test_whitening(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS_PER_BLOCK", 37)
    rng = np.random.default_rng(3)
    good = (rng.normal(size=(400, 12)) @ np.diag(np.arange(12, 0, -1)) + rng.normal(size=12)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(good)] + [(7, [float(c) for c in good[7]])] * 50 + [(None, [float(c) for c in good[9]])]
    odd = [(900, None), (901, []), (902, [float("nan")] * 12), (903, [None] + [0.0] * 11), (904, [float("inf")] * 12), (905, [1.0] * 5)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + odd], EMBEDDING + ", n long, index int").repartition(5)
    got = whitening.whiten(df).collect()
    far, white, share = brute_whitening([v for _, v in rows], 8)
    assert len(got) == 8 * len(rows) and {r["n"] for r in got} == {len(rows)} and {r["component"] for r in got} == set(range(1, 9))
    got.sort(key=lambda r: (r["component"], str(r["vec_id"])))
    order = sorted(range(len(rows)), key=lambda i: str(rows[i][0]))
    mine = np.array([r["whitened"] for r in got]).reshape(8, -1).T
    white = white[order]
    assert np.abs(mine * np.sign((mine * white).sum(0)) - white).max() < 1e-9
    assert [r["deviation"] for r in got[: len(rows)]] == [far[i] for i in order]
    assert np.allclose([r["explained"] for r in got[:: len(rows)]], share, rtol=1e-9) and got[0]["identity_error"] < 1e-9


def test_whitening_without_variance(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0, float(i % 2)]) for i in range(20)], EMBEDDING)
    got = sorted(whitening.whiten(same).collect())
    assert len(got) == 60 and [round(r["explained"], 9) for r in got[:3]] == [1.0, 0.0, 0.0]
    assert abs(abs(got[0]["whitened"]) - 1) < 1e-12 and got[1]["whitened"] is None and got[0]["identity_error"] < 1e-12
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, EMBEDDING)).collect()
    assert len(flat) == 6 and {(r["whitened"], r["deviation"], r["identity_error"]) for r in flat} == {(None, 0, None)}
    assert whitening.whiten(spark.createDataFrame([], EMBEDDING)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], EMBEDDING)).collect() == []


def test_deviations_beyond_a_long(spark):
    rows = [(i, [float(2.0**e), 1.0]) for i, e in enumerate((28, 20, 1, 0, 0))] + [(9, [1e30, -1e30])]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, EMBEDDING)).collect()}
    x = [[min(max(int(np.floor(1024 * np.float64(np.float32(c)))), -(1 << 40)), 1 << 40) + 100_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    for (i, _), v in zip(rows, x, strict=True):
        want = sum((len(x) * c - s) ** 2 for c, s in zip(v, sums, strict=True))
        assert got[i] == (want if want < 1 << 63 else None)


# --- licenses: base phrases beside templates of one's own ---


def test_base_places_with_other_templates(spark):
    from telemill.llm import licenses

    df = spark.createDataFrame([(1, "Released under the MIT License."), (2, "foo bar baz qux quux"), (3, "nothing here")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df, templates=(("foo bar baz qux quux", "x"),)).collect()}
    assert [(p["start"], p["label"]) for p in got[1]["places"]] == [(1, "mit")] and got[2]["places"] == [] and [m["label"] for m in got[2]["matches"]] == ["x"] and got[3]["places"] == []
