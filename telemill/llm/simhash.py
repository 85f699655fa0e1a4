"""Near-duplicates by SimHash with Golay-code fuzzy keys.

Fingerprint: 64 bits, each 1 where over half of a text's 3-word shingles have it
in their XXH64. Documents link at MAX_BITS = 3 or fewer differing bits; a class
is all that links reach.

A fingerprint is cut in three segments of 22, 21 and 21 bits, each padded to a
word of the perfect binary Golay code of length 23. Three differing bits leave
two of the three segments with one error at most each. A word and all words one
error away decode to six codewords at most, so, for each pair of segments, the
index side posts its own two codewords and the probe side posts the up to 6 x 6
combinations near it: whichever two segments agree within an error, the two
sides meet in a key. Every meeting is verified on the whole fingerprints.

Copies share a fingerprint and collapse before any key is made. A large group of
near copies puts many fingerprints under one key; meetings are verified inside
the task in blocks, and only a spanning forest of the verified links leaves it,
so a group of n gives at most n rows from each block instead of its pairs.

near_duplicates links by these bits alone. similar_classes, which keep_one_each
uses, links texts whose exact five-word shingle similarity is SIMILARITY or
more. Shingle fingerprints of such texts differ in some seven bits, too many for
the keys, so its candidates come from two fingerprints of the distinct words,
which edits move less, by the same keys: all within MAX_BITS meet, and those
beyond that have two segments within one error each, up to the last of REACH
bits. Candidates leave their task as one spanning forest for each of REACH, so
that a far candidate never stands in for a near one, and each is verified on the
texts. That finds most links with few comparisons, and misses some: pairs that no
key brings together, and pairs that a forest left out. Those are found exactly
(_completed): two sets that alike share one of the first fifth of their shingles,
in any order that is the same for all. Pairs of two classes that share one are
compared inside the task by sketches, which tell how much two sets differ at
least, so that none alike is lost. First only a forest of each task's nearest
pairs leaves it, and is verified; then all pairs that are still of two classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, wordhash
from .components import connected_components
from .wordhash import hash_words

MAX_BITS = 3
SHINGLE = 3
#: Members of one key looked at together, some pairs at a time; a larger group is dealt out in pairs of such blocks.
BLOCK, PAIRS_AT_ONCE = 8192, 1 << 14
#: Links that a task thins out.
EDGES_AT_ONCE = 1_000_000
#: Pairs that a task holds before it chooses of them.
PAIRS_HELD = 500_000

#: Five-word shingle similarity of near copies; classes of differing bits of their word fingerprints; seeds of these.
SIMILARITY, WIDTH, REACH, WORD_SEEDS = 0.8, 5, (3, 6, 9), (42, 43)

#: Shingles of over HOT texts come last in the order of shingles, the most frequent ones at the end; so many of them at most are sent to the tasks. Any order finds all pairs.
HOT, MOST_HOT = 20, 100_000
#: Keys that are sent to the tasks whole, at most.
MOST_SENT = 300_000
#: Bits of the sketch of a text's shingles; members of one shingle looked at together, pairs at a time; bytes of texts at a time.
LEAST_BITS, MOST_BITS, MEMBERS, MEETINGS_AT_ONCE, AT_ONCE = 64, 1024, 1024, 1 << 16, 1 << 20

#: Bytes of words, A-Z as a-z; zero apart words.
WORD_BYTES = np.arange(1, 257, dtype=np.uint16)
WORD_BYTES[65:91] += 32
WORD_BYTES[[9, 10, 11, 12, 13, 32]] = 0

_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def _words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z), apart by ASCII blanks."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _majority(hashes: list[int]) -> int:
    """The bits that are set in over half of the hashes."""
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(_BITS[2 * ones > n].sum(dtype=np.uint64))


def fingerprint(text: str | None) -> int:
    """Of 3-word shingles with repeats; no words: zero."""
    words = _words(text)
    digest = xxhash.xxh64_intdigest
    if not words:
        return 0
    if len(words) < SHINGLE:
        return _majority([digest(b" ".join(words), 42)])
    return _majority([digest(b"%b %b %b" % w, 42) for w in zip(words, words[1:], words[2:], strict=False)])


def word_fingerprint(text: str | None, seed: int) -> int:
    """Of the distinct words; no words: zero."""
    return _majority([xxhash.xxh64_intdigest(w, seed) for w in set(_words(text))])


def similarity(a: str | None, b: str | None) -> float:
    """Jaccard similarity of the five-word shingles (fewer words: the whole sequence); texts without words are alike."""
    x, y = ({tuple(w[i : i + WIDTH]) for i in range(max(1, len(w) - WIDTH + 1))} for w in (_words(a), _words(b)))
    return len(x & y) / len(x | y)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of the distinct five-word shingles of each text (fewer words: the whole sequence), ascending."""
    words, at = hash_words(texts, WORD_BYTES)
    runs = wordhash.shingles(words, WIDTH)
    sets = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= WIDTH:
            found = np.unique(runs[lo : hi - WIDTH + 1].view("<i8"))
        elif hi > lo:
            found = wordhash.shingles(words[lo:hi], hi - lo).view("<i8")
        else:
            found = np.zeros(1, np.int64)
        sets.append(found)
    return sets


def sketch(h: np.ndarray) -> bytes:
    """For each remainder of the hashes by a power of two, from LEAST_BITS to MOST_BITS, whether an odd number of them has it.

    Two sets differ in as many hashes as their sketches in bits, or more. The
    halves of a sketch, one xor the other, are the sketch of half as many bits.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (len(h) - 1).bit_length()))
    odd = np.bincount(h & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text -> doc_id, fp (the 64 bits as a signed long)."""

    def batch(cols: dict[str, list]) -> dict[str, list]:
        return {"doc_id": cols["doc_id"], "fp": [_signed(fingerprint(t)) for t in cols["text"]]}

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), batch, "doc_id long, fp long")


# --- the Golay code of length 23 ------------------------------------------------------------

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _remainders() -> np.ndarray:
    """Syndromes of all words of 23 bits by the generator polynomial."""
    one = []
    for i in range(23):
        r = 1 << i
        for k in range(22, 10, -1):
            if r >> k & 1:
                r ^= GENERATOR << (k - 11)
        one.append(r)
    table = np.zeros(1, np.int16)
    for i in range(23):
        table = np.concatenate([table, table ^ np.int16(one[i])])
    return table


class Golay:
    """Decoding by syndrome: every word is within three errors of exactly one codeword."""

    def __init__(self):
        self.syndrome = _remainders()
        self.error = np.zeros(1 << 11, np.int64)
        bits = [0, *(1 << i for i in range(23))]
        for a in range(24):
            for b in range(a, 24):
                for c in range(b, 24):
                    e = (bits[a] | bits[b] | bits[c]) if a else (bits[b] | bits[c])
                    s = self.syndrome[e]
                    if not self.error[s] or bin(e).count("1") < bin(int(self.error[s])).count("1"):
                        self.error[s] = e
        self.error[0] = 0

    def decode(self, words: np.ndarray) -> np.ndarray:
        """The codeword's 12 message bits."""
        return (words ^ self.error[self.syndrome[words]]) >> 11

    def near(self, words: np.ndarray) -> np.ndarray:
        """Message bits of all codewords that the words and those one error away decode to, a row each; -1 beyond."""
        around = np.concatenate([words[:, None], words[:, None] ^ (1 << np.arange(23))[None, :]], axis=1)
        found = np.sort(self.decode(around), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = 1 << 20
        found = np.sort(found, axis=1)[:, :6]
        found[found == 1 << 20] = -1
        return found


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


def segments(fp: np.ndarray) -> list[np.ndarray]:
    u = fp.astype(np.int64).view(np.uint64)
    return [(u & np.uint64((1 << 22) - 1)).astype(np.int64), (u >> np.uint64(22) & np.uint64((1 << 21) - 1)).astype(np.int64), (u >> np.uint64(43)).astype(np.int64)]


PAIRS = ((0, 1), (0, 2), (1, 2))


def index_keys(fp: np.ndarray) -> np.ndarray:
    """n x 3 keys: pair number and the two codewords, 26 bits."""
    code = [golay().decode(s) for s in segments(fp)]
    return np.stack([(p << 24) | (code[i] << 12) | code[j] for p, (i, j) in enumerate(PAIRS)], axis=1)


def probe_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys of every combination of near codewords."""
    near = [golay().near(s) for s in segments(fp)]
    rows, keys = [], []
    for p, (i, j) in enumerate(PAIRS):
        both = (p << 24) | (near[i][:, :, None] << 12) | near[j][:, None, :]
        good = (near[i] >= 0)[:, :, None] & (near[j] >= 0)[:, None, :]
        r, a, b = np.nonzero(good)
        rows.append(r)
        keys.append(both[r, a, b])
    return np.concatenate(rows), np.concatenate(keys)


# --- meeting, verifying, linking ------------------------------------------------------------

_ROWS = "key int, block int, side byte, fp long"


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows (side 0) of distinct fingerprints."""
    for batch in batches:
        fp = batch.column(0).to_numpy()
        keys = index_keys(fp).ravel()
        yield _rows(keys, np.zeros(len(keys)), 0, np.repeat(fp, 3))


def _probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Probe rows (side 1)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            fp = batch.column(0).slice(at, 2000).to_numpy()
            rows, keys = probe_keys(fp)
            yield _rows(keys, np.zeros(len(keys)), 1, fp[rows])


def _rows(keys, blocks, side: int, fp) -> pa.RecordBatch:
    n = len(keys)
    return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(np.asarray(blocks, np.int32)), pa.array(np.full(n, side, np.int8)), pa.array(fp)], names=["key", "block", "side", "fp"])


class _Forest:
    """Union-find that says whether a link is news; forgets when large, so that only repeats can slip through."""

    def __init__(self, most: int = 500_000):
        self.up: dict[int, int] = {}
        self.most = most

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (y := up.get(r, r)) != r:
            r = y
        while x != r:
            up[x], x = r, up.get(x, r)
        return r

    def unite(self, a: int, b: int) -> bool:
        if len(self.up) > self.most:
            self.up.clear()
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[a] = b
            self.up.setdefault(b, b)
        return a != b


def _linked(reach: tuple[int, ...]):
    """Rows sorted by key, block, side -> verified links of at most the last of reach bits, one spanning forest for each of reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests = [_Forest() for _ in reach]
        carry = [np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int64)]
        for batch in batches:
            group = (batch.column("key").to_numpy().astype(np.int64) << 32) | batch.column("block").to_numpy().astype(np.int64)
            group, side, fp = (np.concatenate(x) for x in zip(carry, (group, batch.column("side").to_numpy(), batch.column("fp").to_numpy()), strict=True))
            if not len(group):
                continue
            start = np.concatenate([[True], group[1:] != group[:-1]])
            number = np.cumsum(start) - 1
            posts = side == 0
            have = np.bincount(number[posts], minlength=number[-1] + 1)
            first = np.flatnonzero(start)  # posts come first in a group
            probes = np.flatnonzero(~posts & (have[number] > 0))
            a, b = [], []
            ends = np.cumsum(have[number[probes]])
            at = 0
            while at < len(probes):  # some thousand pairs at a time
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
                p = probes[at:stop]
                at = stop
                times = have[number[p]]
                left = np.repeat(p, times)
                right = np.repeat(first[number[p]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                bits = np.bitwise_count((fp[left] ^ fp[right]).view(np.uint64))
                near = np.flatnonzero((bits <= reach[-1]) & (bits > 0))
                x, y, own = fp[left[near]], fp[right[near]], np.searchsorted(reach, bits[near])
                if len(near) > 500:  # in a large group most pairs are connected before long: they go by arrays
                    names, back = np.unique(np.concatenate([x, y]), return_inverse=True)
                    roots = np.array([[f.root(v) for v in names.tolist()] for f in forests])
                    news = np.flatnonzero(roots[own, back[: len(x)]] != roots[own, back[len(x) :]])
                    x, y, own = x[news], y[news], own[news]
                for u, v, k in zip(x.tolist(), y.tolist(), own.tolist(), strict=True):
                    if forests[k].unite(u, v):
                        a.append(u)
                        b.append(v)
                        for wider in forests[k + 1 :]:
                            wider.unite(u, v)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            last = number == number[-1]
            carry = [x[last & posts] for x in (group, side, fp)]

    return run


def links(distinct: DataFrame, reach: tuple[int, ...] = (MAX_BITS,)) -> DataFrame:
    """distinct: fp, each once -> a, b: links that connect exactly what links of MAX_BITS or fewer bits connect (and more, up to the last of reach, as far as keys meet)."""
    posts = distinct.mapInArrow(_posted, _ROWS)
    probes = distinct.mapInArrow(_probing, _ROWS)
    hot = posts.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    hot = common.settle(hot)
    n_hot = hot.count()
    if n_hot:
        # at most 3 n / BLOCK keys; sent whole only while that is small
        side = F.broadcast(hot) if n_hot <= 100_000 else hot
        posts = posts.join(side, "key", "left").select("key", F.coalesce(F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"), F.lit(0)).alias("block"), "side", "fp")
        probes = probes.join(side, "key", "left").select("key", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)).alias("block"), "side", "fp")
    # in the order of fingerprints, so that a group is linked to its smallest member whatever key it meets in
    dealt = posts.unionAll(probes.select("key", "block", "side", "fp")).repartition("key", "block").sortWithinPartitions("key", "block", "side", "fp")
    return dealt.mapInArrow(_linked(reach), "a long, b long")


def _thinned(reach: tuple[int, ...]):
    """Links a, b -> of each partition one spanning forest for each of reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests = [_Forest() for _ in reach]
        for batch in batches:
            x, y = (batch.column(c).to_numpy() for c in ("a", "b"))
            own = np.searchsorted(reach, np.bitwise_count((x ^ y).view(np.uint64)))
            kept: list[tuple[int, int]] = []
            for u, v, k in zip(x.tolist(), y.tolist(), own.tolist(), strict=True):
                if forests[k].unite(u, v):
                    kept.append((u, v))
                    for wider in forests[k + 1 :]:
                        wider.unite(u, v)
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in kept], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def thin(edges: DataFrame, reach: tuple[int, ...]) -> DataFrame:
    """edges: a, b -> fewer of them that connect the same, for each of reach.

    Every task of links has a forest of its own, so a large group has as many
    links a member as tasks that it met in. They go together here, up to
    EDGES_AT_ONCE to a task.
    """
    edges = common.settle(edges)
    return edges.coalesce(max(1, -(-edges.count() // EDGES_AT_ONCE))).mapInArrow(_thinned(reach), "a long, b long")


def _classes(fps: DataFrame) -> DataFrame:
    """fps: doc_id, fp -> fp, root, component_id: each fingerprint once, root naming its class."""
    reps = common.settle(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(reps.select("fp")))
    classed = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    return classed.join(named, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text -> doc_id, fp, component_id, a row for each row of docs.

    component_id is the smallest doc_id that links reach. A null or wordless text
    has fingerprint zero and links like any other. Rows that repeat stay; a null
    doc_id never names a class (null where a class has no other).
    """
    fps = common.settle(fingerprints(docs))
    return fps.join(_classes(fps), "fp").select("doc_id", "fp", "component_id")


_STARTS = "h long, n int, at int, key long, root long"
_MET = "h long, n int, at int, key long, root long, block int, sketch binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Batches of key, text and more -> rows of some MB of texts, and their shingles. Copies are skipped within a task."""
    seen: set[int] = set()
    for batch in batches:
        rows, texts, size = [], [], 0
        keys, columns = batch.column("key").to_pylist(), [c.to_pylist() for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "text"]
        for i, key in enumerate(keys):
            if key in seen:
                continue
            if len(seen) > 1_000_000:
                seen.clear()
            seen.add(key)
            rows.append(tuple(c[i] for c in columns))
            texts.append((batch.column("text")[i].as_py() or "").encode("utf-8", "surrogatepass"))
            size += len(texts[-1])
            if size > AT_ONCE:
                yield rows, shingle_sets(texts)
                rows, texts, size = [], [], 0
        if rows:
            yield rows, shingle_sets(texts)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text -> h, c: shingles that several texts of a task have, and their number; key, sketch: a row for each text."""
    held, many = [], 0

    def told() -> pa.RecordBatch:
        x = np.concatenate(held)
        held.clear()
        x.sort()
        # of c equal ones all but two, so that arrays of all distinct ones aren't made
        h, c = np.unique(x[:-2][x[2:] == x[:-2]], return_counts=True)
        c += 2
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.nulls(len(h), pa.int64()), pa.nulls(len(h), pa.binary())], names=["h", "c", "key", "sketch"])

    for rows, sets in _sets(batches):
        held += sets
        many += sum(map(len, sets))
        if many > 4_000_000:
            yield told()
            many = 0
        n = len(rows)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([sketch(x) for x in sets], pa.binary())], names=["h", "c", "key", "sketch"])
    if held:
        yield told()


def _starts(texts: DataFrame, late: list[int]) -> DataFrame:
    """texts: key, text, root (null: the key) -> the shingles that a set alike must share one of: the first n - ceil(SIMILARITY n) + 1 of each, late ones last, in their order."""
    names = np.array(late, np.int64)
    by_name = np.argsort(names)
    sent = texts.sparkSession.sparkContext.broadcast((names[by_name], by_name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = sent.value
        for rows, sets in _sets(batches):
            cols: list[list[np.ndarray]] = [[], [], []]
            sizes = []
            for h in sets:
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    last = known[at] == h
                    h = np.concatenate([h[~last], h[last][np.argsort(place[at[last]])]])
                n, k = len(h), len(h) - math.ceil(SIMILARITY * len(h) - 1e-9) + 1
                sizes.append(k)
                for c, x in zip(cols, (h[:k], np.full(k, n, np.int32), np.arange(k, dtype=np.int32)), strict=True):
                    c.append(x)
            key, root = (pa.array([r[i] for r in rows], pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), sizes))) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in cols), key, root], names=["h", "n", "at", "key", "root"])

    return texts.select("key", "root", "text").mapInArrow(run, _STARTS)


def _whole_groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Columns of batches sorted by the names, cut so that no group of equal names is split."""
    carry: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        carry.append(batch)
        # a whole batch of the group that is being gathered
        if all(batch.column(c)[0] == batch.column(c)[batch.num_rows - 1] == carry[0].column(c)[0] for c in names):
            continue
        table = pa.Table.from_batches(carry)
        last = np.logical_and.reduce([table.column(c).to_numpy() == table.column(c)[table.num_rows - 1].as_py() for c in names])
        cut = int(np.argmax(last))
        if cut:
            yield table.slice(0, cut)
        carry = table.slice(cut).combine_chunks().to_batches()
    if carry:
        yield pa.Table.from_batches(carry)


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _starts sorted by h -> those whose shingle several classes have; a null root is the key."""
    for rows in _whole_groups(batches, ("h",)):
        h, key = rows.column("h").to_numpy(), rows.column("key").to_numpy()
        root = pc.coalesce(rows.column("root"), rows.column("key")).to_numpy()
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(first, len(h)))
        good = np.repeat(np.minimum.reduceat(root, first) < np.maximum.reduceat(root, first), size)
        if good.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[good]) for x in (h, rows.column("n").to_numpy(), rows.column("at").to_numpy(), key, root)], names=["h", "n", "at", "key", "root"])


def _met(starts: DataFrame) -> DataFrame:
    return common.settle(starts.repartition("h").sortWithinPartitions("h").mapInArrow(_mixed, _STARTS))


def _levels(sketches: list[bytes]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Words of each sketch, and for each such number all sketches of so many words or more, folded to it."""
    words = np.array([len(x) // 8 for x in sketches])
    at: dict[int, np.ndarray] = {}
    for w in sorted(set(words.tolist()), reverse=True):
        m = np.zeros((len(sketches), w), np.uint64)
        own = words == w
        m[own] = np.frombuffer(b"".join(x for x in sketches if len(x) == 8 * w), "<u8").reshape(-1, w)
        for wider, x in at.items():
            own = words == wider
            folded = x[own]
            while folded.shape[1] > w:
                folded = folded[:, : folded.shape[1] // 2] ^ folded[:, folded.shape[1] // 2 :]
            m[own] = folded
        at[w] = m
    return words, at


def _near(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Whole groups of h and block, sorted by size in each -> keys a, b and the part of their shingles that surely differs: pairs of two classes that, by sizes, places and sketches, may be alike."""
    h, block, n, place, key, root = (rows.column(c).to_numpy() for c in ("h", "block", "n", "at", "key", "root"))
    group = np.cumsum(np.concatenate([[False], (h[1:] != h[:-1]) | (block[1:] != block[:-1])]))
    words, level = _levels(rows.column("sketch").to_pylist())
    # rows before a row in its group that are large enough
    least = np.searchsorted(group * (1 << 33) + n, group * (1 << 33) + np.ceil(SIMILARITY * n - 1e-9).astype(np.int64))
    times = np.arange(len(h)) - least
    ends = np.cumsum(times)
    most = (1 - SIMILARITY) / (1 + SIMILARITY)
    at = 0
    while at < len(h):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MEETINGS_AT_ONCE, "right")))
        t = times[at:stop]
        j = np.repeat(np.arange(at, stop), t)
        i = np.repeat(least[at:stop] - (np.cumsum(t) - t), t) + np.arange(t.sum())
        at = stop
        good = (root[i] != root[j]) & (np.minimum(n[i] - place[i], n[j] - place[j]) * (1 + SIMILARITY) >= SIMILARITY * (n[i].astype(np.int64) + n[j]) - 1e-6)
        i, j = i[good], j[good]
        both = n[i].astype(np.int64) + n[j]
        differ = np.zeros(len(i), np.int64)
        width = np.minimum(words[i], words[j])
        for w in np.unique(width).tolist():
            own = width == w
            differ[own] = np.bitwise_count(level[w][i[own]] ^ level[w][j[own]]).sum(axis=1)
        near = np.flatnonzero(differ <= most * both + 1e-6)
        i, j = i[near], j[near]
        yield np.minimum(key[i], key[j]), np.maximum(key[i], key[j]), differ[near] / both[near]


def _pairs_of(whole: bool):
    """Rows of _MET sorted by h, block, n, key -> a, b: all pairs of _near, or of them a forest of the nearest ones of each task."""

    def told(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        held, many = [], 0

        def chosen() -> pa.RecordBatch:
            a, b, differ = (np.concatenate(x) for x in zip(*held, strict=True))
            if whole:
                return told(*np.unique(np.stack([a, b]), axis=1))
            order = np.argsort(differ, kind="stable")
            a, b = a[order], b[order]
            kept, step = [], 4096
            while len(a):
                for u, v in zip(a[:step].tolist(), b[:step].tolist(), strict=True):
                    if forest.unite(u, v):
                        kept.append((u, v))
                a, b = a[step:], b[step:]
                if len(a) > step:  # most pairs are connected before long: they go by arrays
                    names, back = np.unique(np.concatenate([a, b]), return_inverse=True)
                    roots = np.array([forest.root(v) for v in names.tolist()])[back]
                    news = roots[: len(a)] != roots[len(a) :]
                    a, b = a[news], b[news]
            kept = np.array(kept, np.int64).reshape(-1, 2)
            return told(kept[:, 0], kept[:, 1])

        for rows in _whole_groups(batches, ("h", "block")):
            for part in _near(rows):
                held.append(part)
                many += len(part[0])
                if many > PAIRS_HELD:
                    yield chosen()
                    held, many = [], 0
        if held:
            yield chosen()

    return run


def _pairs(met: DataFrame, sketches: DataFrame, whole: bool) -> DataFrame:
    """met: rows of _met; sketches: key, sketch -> a, b: pairs that may be alike, each once. A large group is dealt out in pairs of blocks of its members."""
    hot = common.settle(met.groupBy("h").count().where(F.col("count") > MEMBERS).select("h", F.ceil(F.col("count") / MEMBERS).cast("int").alias("blocks")))
    dealt = met.withColumn("block", F.lit(0))
    if n_hot := hot.count():
        side = F.broadcast(hot) if n_hot <= MOST_HOT else hot
        own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1))
        dealt = met.join(side, "h", "left").withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", other)
        dealt = dealt.select("h", "n", "at", "key", "root", (F.greatest("own", "other") * 65536 + F.least("own", "other")).alias("block"))
    rows = dealt.join(sketches, "key").select("h", "n", "at", "key", "root", "block", "sketch")
    found = rows.repartition("h", "block").sortWithinPartitions("h", "block", "n", "key").mapInArrow(_pairs_of(whole), "a long, b long")
    return common.gathered(found.distinct())


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with the root of their key; null: the key itself."""
    roots = F.broadcast(roots) if roots.count() <= MOST_SENT else roots
    return rows.join(roots, "key", "left")


def _completed(texts: DataFrame, roots: DataFrame) -> DataFrame:
    """roots, with the links of SIMILARITY of texts (key, text) between its classes.

    Twice: by a forest of the nearest pairs of each task, which joins most of a
    large group by few rows, then by all pairs that are still of two classes.
    """
    known = common.parted(texts.select("key", "text").mapInArrow(_counted, "h long, c long, key long, sketch binary"), "shingles")
    often = known.where("h IS NOT NULL").groupBy("h").agg(F.sum("c").alias("c")).where(f"c > {HOT}")
    late = [r["h"] for r in often.orderBy(F.desc("c"), "h").limit(MOST_HOT).select("h").collect()][::-1]
    sketches = known.where("key IS NOT NULL").groupBy("key").agg(F.min("sketch").alias("sketch"))
    met = _met(_starts(_rooted(texts, roots), late))
    for whole in (False, True):
        pairs = _pairs(met, sketches, whole)
        if pairs.isEmpty():
            break
        joined = roots.select(F.col("root").alias("a"), F.col("key").alias("b")).unionAll(_verified(pairs, texts))
        roots = common.settle(connected_components(joined).withColumnRenamed("node", "key"))
        if not whole:
            met = _met(_rooted(met.drop("root"), roots).select("h", "n", "at", "key", "root"))
    return roots


def _verified(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """The edges a, b whose texts have SIMILARITY."""

    def alike(cols: dict[str, list]) -> dict[str, list]:
        good = [i for i, (x, y) in enumerate(zip(cols["s"], cols["t"], strict=True)) if similarity(x, y) >= SIMILARITY]
        return {k: [cols[k][i] for i in good] for k in ("a", "b")}

    # texts that have a candidate; their keys are sent whole only while they are few
    asked = common.gathered(edges.select(F.col("a").alias("key")).unionAll(edges.select("b")).distinct())
    asked = F.broadcast(asked) if asked.count() <= MOST_SENT else asked
    texts = common.parted(texts.join(asked, "key", "left_semi").groupBy("key").agg(F.min("text").alias("text")), "candidates")
    met = edges.join(texts.select(F.col("key").alias("a"), F.col("text").alias("s")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("t")), "b")
    return common.map_batches(met.select("a", "b", "s", "t"), alike, "a long, b long")


def _led(edges: DataFrame, leads: DataFrame) -> DataFrame:
    """edges: a, b; leads: fp, lead -> x, y: the leads of a and b. Few edges are sent to the leads, many go by shuffles."""
    edges = common.gathered(edges)
    if edges.count() <= MOST_SENT:
        asked = edges.select(F.col("a").alias("fp")).unionAll(edges.select("b"))
        leads = F.broadcast(common.gathered(leads.join(F.broadcast(asked), "fp", "left_semi")))
    return edges.join(leads.select(F.col("fp").alias("a"), F.col("lead").alias("x")), "a").join(leads.select(F.col("fp").alias("b"), F.col("lead").alias("y")), "b")


def similar_classes(texts: DataFrame) -> DataFrame:
    """texts: key (a hash of the text), text -> key, root: the smallest key that links of SIMILARITY or more reach; texts without a link are left out."""

    def batch(cols: dict[str, list]) -> dict[str, list]:
        return {"key": cols["key"]} | {f"fp{k}": [_signed(word_fingerprint(t, seed)) for t in cols["text"]] for k, seed in enumerate(WORD_SEEDS)}

    names = [f"fp{k}" for k in range(len(WORD_SEEDS))]
    prints = common.map_batches(texts, batch, "key long, " + ", ".join(f"{n} long" for n in names))
    prints = common.settle(prints.groupBy("key").agg(*(F.min(n).alias(n) for n in names)))
    edges = None
    for k in range(len(WORD_SEEDS)):
        own = prints.select("key", F.col(f"fp{k}").alias("fp"))
        leads = common.settle(own.groupBy("fp").agg(F.min("key").alias("lead")))
        same = own.join(leads, "fp").where("key <> lead").select(F.col("lead").alias("a"), F.col("key").alias("b"))
        far = _led(thin(links(leads.select("fp"), REACH), REACH), leads)
        both = same.unionAll(far.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
        edges = both if edges is None else edges.unionAll(both)
    edges = common.gathered(edges.distinct())

    roots = common.settle(connected_components(_verified(edges, texts)).withColumnRenamed("node", "key"))
    # what no key brought together, and what the forests left out
    return _completed(texts, roots)


def keep_one_each(docs: DataFrame) -> DataFrame:
    """One row of docs, with all its columns, of each class of similar texts: the smallest doc_id (nulls last), then the smallest text hash.

    Rows are told apart by doc_id and the hash of their text, so different texts
    under one doc_id are judged each by its own class, and of equal rows one stays.
    Texts without words are one class.
    """
    # a row of docs travels as one struct, so its columns may have any names
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(common.whole_text().cast("string")).alias("key"))
    slim = common.settle(rows.select("id", "key").groupBy("id", "key").agg(F.count("*").alias("n")))
    with common.small_batches(docs.sparkSession):
        roots = similar_classes(docs.select(F.xxhash64(common.whole_text().cast("string")).alias("key"), common.whole_text().cast("string").alias("text")))
    classed = slim.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    first = classed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("x")).select(F.col("x.id").alias("kept_id"), F.col("x.key").alias("kept_key"))
    kept = rows.join(first, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")), "left_semi")
    if slim.where("n > 1").head(1):
        kept = kept.withColumn("copy", F.row_number().over(Window.partitionBy("id", "key").orderBy(F.lit(0)))).where("copy = 1")
    return kept.select("row.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
