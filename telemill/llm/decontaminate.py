"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact verification.

An item of n words is compared with every window of n words of a document that
shares one of its five-word shingles (others have similarity 0 and are no
candidates). A window's SimHash weighs its words by how often they stand there.
Fingerprints are cut in BLOCKS blocks; if two differ in RADIUS bits at most, one
block differs in RADIUS // BLOCKS at most, so items are posted under all values
that near to each of their blocks and a window is looked up by its own: that
finds every fingerprint within the radius. Beyond the radius counts decide: a
window of SIMILARITY or more has so many places with shingles of the item
(LEAST_SHARED of them at least) that few others have, and those are candidates
too, so no window is lost to the radius. A candidate is a leak if its weighted
shingle similarity (sum of minima over sum of maxima of the shingles' counts) is
SIMILARITY or more; of the windows of an item in a document the best counts, the
first among equals. Search goes by hashes of words; what it finds is weighed
again on the words themselves.

A document shorter than an item is one window as a whole. An item of fewer words
than a shingle is its own only shingle, so it leaks where it stands whole.

The benchmark is sent to the tasks in portions of ITEMS items, whatever its
size. Defined results: null, empty and wordless texts, in items or documents,
match nothing; repeated rows give repeated results; repeated items are reported
under each of their ids; a null id stays null.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .wordhash import hash_words, mix, shingles

WIDTH, SIMILARITY = 5, 0.8
BLOCKS, RADIUS = 4, 11
#: The share of a window's shingles that are the item's at least: minima over maxima reach SIMILARITY only from there.
LEAST_SHARED = 2 * SIMILARITY / (1 + SIMILARITY)
ITEMS = 5000
#: Texts searched at a time, however large the batches are that Spark sends.
STEP = 500
_SIDE = 64 // BLOCKS


def _near_values() -> np.ndarray:
    """All masks of a block with RADIUS // BLOCKS bits at most."""
    masks = {0}
    for _ in range(RADIUS // BLOCKS):
        masks |= {m | 1 << b for m in masks for b in range(_SIDE)}
    return np.array(sorted(masks), np.uint64)


def simhashes(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of the windows of n words at the given starts."""
    lo, hi = int(starts.min()), int(starts.max()) + n
    bits = np.unpackbits(mix(words[lo:hi]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    ones = sums[starts - lo + n] - sums[starts - lo]
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u8").ravel()


class Benchmark:
    """A portion of the items, ready to search with."""

    def __init__(self, ids: list, hashes: np.ndarray, bounds: np.ndarray):
        self.ids = ids
        self.words = [hashes[bounds[i] : bounds[i + 1]] for i in range(len(ids))]
        self.length = np.array([len(w) for w in self.words], int)
        grams = [shingles(w, WIDTH) for w in self.words]
        self.grams = grams
        self.least = np.array([max(1, int(np.ceil(LEAST_SHARED * len(g) - 1e-9))) if len(g) else np.iinfo(np.int64).max for g in grams], np.int64)
        value = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(ids)), [len(g) for g in grams])
        order = np.lexsort((item, value))
        self.value, self.item = value[order], item[order]
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[self.value & np.uint64((1 << 20) - 1)] = True
        #: width -> shingles of the items of so few words, sorted, and the items
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted(set(self.length[(self.length > 0) & (self.length < WIDTH)].tolist())):
            of = np.flatnonzero(self.length == n)
            whole = np.concatenate([shingles(self.words[i], n) for i in of])
            order = np.argsort(whole, kind="stable")
            self.short[n] = (whole[order], of[order])
        near = _near_values()
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted(set(self.length[self.length >= WIDTH].tolist())):
            of = np.flatnonzero(self.length == n)
            fps = np.concatenate([simhashes(self.words[i], np.zeros(1, int), n) for i in of])
            keys, who = [], []
            for b in range(BLOCKS):
                block = fps >> np.uint64(b * _SIDE) & np.uint64((1 << _SIDE) - 1)
                keys.append(((block[:, None] ^ near[None, :]) | np.uint64(b << _SIDE)).ravel())
                who.append(np.repeat(np.arange(len(of)), len(near)))
            keys, who = np.concatenate(keys), np.concatenate(who)
            order = np.argsort(keys, kind="stable")
            self.tables[n] = (keys[order], who[order], of, fps)

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Places whose shingle some item has."""
        at = np.flatnonzero(self.bitmap[grams & np.uint64((1 << 20) - 1)])
        if not len(at) or not len(self.value):
            return at[:0]
        k = np.minimum(np.searchsorted(self.value, grams[at]), len(self.value) - 1)
        return at[self.value[k] == grams[at]]

    def search(self, words: np.ndarray, grams: np.ndarray, hits: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) of the leaks in one document; hits: places in its shingles."""
        lo, hi = np.searchsorted(self.value, grams[hits], "left"), np.searchsorted(self.value, grams[hits], "right")
        shared = np.zeros(len(self.ids), np.int64)  # places of the document with a shingle of the item
        ranges, times = np.unique(np.stack([lo, hi]), axis=1, return_counts=True)
        for a, b, k in zip(*ranges.tolist(), times.tolist(), strict=True):
            shared[self.item[a:b]] += k
        items = np.flatnonzero(shared)
        best: dict[int, tuple[float, int]] = {}
        for i in items[self.length[items] > len(words)].tolist():
            self._weigh(grams, i, 0, best)
        for n in np.unique(self.length[items][self.length[items] <= len(words)]).tolist():
            # all windows of n words with one of the places; runs of starts, each once
            covered = np.zeros(len(words) - n + 2, np.int64)
            np.add.at(covered, np.clip(hits - (n - WIDTH), 0, len(words) - n + 1), 1)
            np.add.at(covered, np.minimum(hits + 1, len(words) - n + 1), -1)
            starts = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 4 * n) + 1):
                for part in range(0, len(run), 1 << 14):
                    s = run[part : part + (1 << 14)]
                    if len(s):
                        self._verify(words, grams, s, simhashes(words, s, n), n, best)
        for i in np.flatnonzero(shared >= self.least).tolist():
            self._beyond(words, grams, hits, i, best)
        return [(i, s, min(int(self.length[i]), len(words)), x) for i, (x, s) in sorted(best.items())]

    def _verify(self, words, grams, starts, fps, n, best) -> None:
        keys, who, of, own = self.tables[n]
        pairs = set()
        for b in range(BLOCKS):
            k = (fps >> np.uint64(b * _SIDE) & np.uint64((1 << _SIDE) - 1)) | np.uint64(b << _SIDE)
            lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
            for j in np.flatnonzero(hi > lo).tolist():
                pairs.update((j, w) for w in who[lo[j] : hi[j]].tolist())
        if not pairs:
            return
        j, w = np.array(sorted(pairs)).T
        good = np.bitwise_count(fps[j] ^ own[w]) <= RADIUS
        for j, w in zip(j[good].tolist(), w[good].tolist(), strict=True):
            self._weigh(grams, int(of[w]), int(starts[j]), best)

    def _beyond(self, words, grams, hits, i, best) -> None:
        """Windows that share enough shingles with item i, though their fingerprints are beyond the radius."""
        n, m = int(self.length[i]), len(self.grams[i])
        if n > len(words):  # weighed as a whole
            return
        have = np.zeros(len(grams) + 1, np.int64)
        have[hits[np.isin(grams[hits], self.grams[i])] + 1] = 1
        have = np.cumsum(have)
        starts = np.flatnonzero(have[m:] - have[: len(have) - m] >= self.least[i])
        own = simhashes(self.words[i], np.zeros(1, int), n)
        for part in range(0, len(starts), 1 << 14):
            s = starts[part : part + (1 << 14)]
            for start in s[np.bitwise_count(simhashes(words, s, n) ^ own) > RADIUS].tolist():
                self._weigh(grams, i, start, best)

    def _weigh(self, grams, i, s, best) -> None:
        x = similarity(grams[s : s + len(self.grams[i])], self.grams[i])
        if x >= SIMILARITY and (i not in best or (x, -s) > (best[i][0], -best[i][1])):
            best[i] = (x, s)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of minima over sum of maxima of the shingles' counts."""
    if not len(a) and not len(b):
        return 0.0
    values, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(where[: len(a)], minlength=len(values)), np.bincount(where[len(a) :], minlength=len(values))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


_LEAK = "doc_id long, item_id long, first_word long, n_words long, similarity double"


def _portions(benchmark: DataFrame) -> list:
    """The items as broadcasts of about ITEMS items each."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    n = max(1, -(-items.count() // ITEMS))
    numbered = items.withColumn("portion", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    sent = []
    for p in range(n):
        got = sorted(numbered.where(F.col("portion") == p).collect(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"] or ""))
        sent.append(benchmark.sparkSession.sparkContext.broadcast(([r["item_id"] for r in got], [r["text"] for r in got], *hash_words([r["text"] for r in got]))))
    return sent


_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """The words that hash_words hashes."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def _counts(words: list[bytes]) -> Counter:
    return Counter(tuple(words[i : i + WIDTH]) for i in range(max(1, len(words) - WIDTH + 1)))


class _Search:
    """Searches batches of texts for one portion; builds its tables once a task."""

    def __init__(self, sent):
        self.sent, self.built = sent, None

    def _short(self, hashes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text number, item, first word, words) where items of few words first stand whole."""
        out = {}
        for n, (value, item) in self.built.short.items():
            grams = shingles(hashes, n)
            lo, hi = np.searchsorted(value, grams, "left"), np.searchsorted(value, grams, "right")
            at = np.flatnonzero(hi > lo)
            doc = np.searchsorted(bounds, at, "right") - 1
            for k, d in zip(at.tolist(), doc.tolist(), strict=True):
                if k + n <= bounds[d + 1]:
                    for i in item[lo[k] : hi[k]].tolist():
                        out.setdefault((d, i), (d, i, k - int(bounds[d]), n))
        return list(out.values())

    def __call__(self, texts: list[str | None]) -> list[tuple[int, int | None, int, int, float]]:
        """(text number, item_id, first word, words, similarity)"""
        if self.built is None:
            ids, self.texts, hashes, bounds = self.sent.value
            self.built = Benchmark(ids, hashes, bounds)
        b = self.built
        hashes, bounds = hash_words(texts)
        grams = shingles(hashes, WIDTH)
        hits = b.hits(grams)
        doc = np.searchsorted(bounds, hits, "right") - 1
        inside = hits + WIDTH <= bounds[doc + 1]
        hits, doc = hits[inside], doc[inside]
        found = self._short(hashes, bounds)
        for d in np.unique(doc).tolist():
            lo, hi = int(bounds[d]), int(bounds[d + 1])
            found += [(d, i, s, n) for i, s, n, _ in b.search(hashes[lo:hi], grams[lo : hi - WIDTH + 1], hits[doc == d] - lo)]
        out, at, words = [], None, []
        for d, i, s, n in sorted(found):
            if d != at:
                at, words = d, words_of(texts[d])
            x, y = _counts(words[s : s + n]), _counts(words_of(self.texts[i]))
            exact = sum((x & y).values()) / sum((x | y).values())
            if exact >= SIMILARITY:
                out.append((d, b.ids[i], s, n, exact))
        return out


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs: doc_id, text; benchmark: item_id, text -> a row for each document and item that it leaks."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = None
    for sent in _portions(benchmark):
        one = common.map_batches(rows, _leak_rows(_Search(sent)), _LEAK)
        found = one if found is None else found.unionAll(one)
    return found


def _leak_rows(search: _Search):
    def batch(cols: dict[str, list]) -> dict[str, list]:
        got = search(cols["text"])
        return {"doc_id": [cols["doc_id"][g[0]] for g in got]} | {k: [g[j] for g in got] for j, k in enumerate(("item_id", "first_word", "n_words", "similarity"), 1)}

    return batch


def _is_clean(search: _Search):
    def clean(text: pd.Series) -> pd.Series:
        out = np.ones(len(text), bool)
        for at in range(0, len(text), STEP):
            out[[at + g[0] for g in search(list(text[at : at + STEP]))]] = False
        return pd.Series(out)

    return F.pandas_udf(clean, "boolean")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a leak, with all their columns."""
    for sent in _portions(benchmark):
        docs = docs.where(_is_clean(_Search(sent))(F.col("text").cast("string")))
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each leak: the document, the item, where and how similar."""
    found = find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.withColumn("similarity", F.round("similarity", 6))
