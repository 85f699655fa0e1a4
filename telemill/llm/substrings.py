"""Exact removal of repeated substrings by external induced sorting.

A byte goes if a WIDTH-byte string that covers it also starts in a document with
a smaller doc_id. Suffixes are compared to WIDTH bytes only, so it is enough
that equal WIDTH-byte strings meet in one shard:

1. Whole copies are found by the SHA-256 of the text; only the first of each group
   (smallest doc_id) goes on, the others are known to go as a whole.
2. Every string has a key, the least hash of its GRAM-byte parts; runs of strings
   with one key travel together as one piece of text. Pieces are dealt to shards
   by key, packed and compressed by batch; a piece that recurs in a batch travels
   once with the places where it stands, so a line that a third of all documents
   have costs a few bytes for each.
3. A shard that is larger than SLAB_BYTES is parted by key into files of that
   size on its task's disk, which are taken one after the other. It drops keys
   that one document alone has and strings that stand once (by their hashes), sorts the suffixes of what remains by induction (see
   induced.py) and takes, for each run of suffixes with a common prefix of WIDTH
   bytes, the smallest doc_id. Places in later documents go.
4. Spans are joined to the texts once.

Shards number with the bytes of the table (SHARD_BYTES of text each) up to
MOST_SHARDS, so that what a batch packs for a shard doesn't shrink to nothing;
beyond that they grow, and the files of step 3 keep their memory as it is. Hashes
only say what may be equal: pieces are one, and strings equal, by their bytes.

Defined results: a null text is the empty one; texts under WIDTH bytes lose
nothing; a null doc_id counts as larger than all and removes nothing elsewhere;
rows with the same doc_id don't remove each other's bytes; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .induced import WIDTH, same_slices, slices, sorted_strings
from .wordhash import _BASE, _INVERSE, _power, mix

GRAM = 10
SHARD_BYTES, MOST_SHARDS = 4 << 20, 4096
#: Unpacked bytes of a shard that are taken at a time.
SLAB_BYTES = 96 << 20
#: Bytes of text hashed in one step, and packed in one go.
STEP_BYTES, BATCH_BYTES = 1 << 20, 16 << 20
#: Strings of a shard that are sorted together.
SLAB = 1 << 20
_LAST = (1 << 63) - 1


def string_keys(data: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """For each WIDTH-byte string the least hash of its GRAM-byte parts. sums: prefix sums of byte * base^place."""
    n = len(data)
    if n < WIDTH:
        return np.zeros(0, np.uint64)
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * _power(_INVERSE, n + 1)[: n - GRAM + 1])
    span, width = grams, 1
    want = WIDTH - GRAM + 1
    while 2 * width <= want:
        span = np.minimum(span[:-width], span[width:])
        width *= 2
    if width < want:
        span = np.minimum(span[: len(span) - (want - width)], span[want - width :])
    return span


def _table(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Pieces of some texts: text number, first byte in the text, first byte in all, size, content hash, key."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    n = len(data)
    if n < WIDTH:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=sums[1:])
    key = string_keys(data, sums)
    # a piece ends where the key changes and where a text's strings end
    new = np.ones(len(key) + 1, bool)
    new[1:-1] = key[1:] != key[:-1]
    inner = ends[:-1]
    new[np.minimum(inner, len(key))] = True
    new[np.clip(ends - WIDTH + 1, 0, len(key))] = True
    edge = np.flatnonzero(new)
    first, last = edge[:-1], edge[1:]
    doc = np.searchsorted(ends, first, "right")
    good = first + WIDTH <= ends[doc]
    first, last, doc = first[good], last[good], doc[good]
    size = last - first + WIDTH - 1
    content = mix((sums[first + size] - sums[first]) * _power(_INVERSE, n + 1)[first]) ^ size.astype(np.uint64)
    return doc, first - (ends - lengths)[doc], first, size, content, key[first]


def cut_pieces(texts: list[bytes], docs: np.ndarray, keys: np.ndarray, shards: int) -> list[tuple[int, bytes]]:
    """(shard, packed pieces) of a batch of texts. docs: order numbers; keys: what else tells the rows apart."""
    tables, number, base, at = [], 0, 0, 0
    while at < len(texts):  # two MB at a time: the arrays here are some forty times the text
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) <= STEP_BYTES):
            total += len(texts[end])
            end += 1
        t = _table(texts[at:end])
        tables.append((t[0] + at, t[1], t[2] + base, *t[3:]))
        base += total
        at = end
    doc, place, first, size, content, key = (np.concatenate(c) for c in zip(*tables, strict=True)) if tables else [np.zeros(0, np.int64)] * 6
    if not len(doc):
        return []
    data = np.frombuffer(b"".join(texts), np.uint8)
    lead, same = _distinct(data, first, size, content)
    # pieces in the order of the texts, so that neighbours differ little
    order = np.argsort(lead, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    lead, same = lead[order], back[same]
    spread = mix(key[lead] ^ np.uint64(0x5851F42D4C957F2D))
    shard = (spread % np.uint64(shards)).astype(np.int64)
    by_shard = np.argsort(shard, kind="stable")
    where = np.argsort(shard[same], kind="stable")
    numbers = np.arange(shards + 1)
    cuts, wcuts = np.searchsorted(shard[by_shard], numbers), np.searchsorted(shard[same][where], numbers)
    number = np.empty(len(lead), np.int64)
    pack = zstandard.ZstdCompressor(level=5)
    out = []
    for s in np.unique(shard).tolist():
        u, o = by_shard[cuts[s] : cuts[s + 1]], where[wcuts[s] : wcuts[s + 1]]
        number[u] = np.arange(len(u))
        d = doc[o]
        out.append((s, pack.compress(_packed_pieces(size[lead[u]], spread[u] >> np.uint64(40), number[same[o]], docs[d], keys[d], place[o], slices(data, first[lead[u]], size[lead[u]])))))
    return out


def _distinct(data: np.ndarray, begin: np.ndarray, size: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each group of equal slices, and each slice's group. content: hashes, which tell what to compare."""
    _, lead, same = np.unique(content, return_index=True, return_inverse=True)
    other = np.flatnonzero(lead[same] != np.arange(len(content)))
    first = lead[same[other]]
    like = size[other] == size[first]
    like[like] = same_slices(data, begin[other[like]], begin[first[like]], size[other[like]])
    if not like.all():  # slices of one hash that are not the same bytes get groups of their own
        made: dict[tuple[int, bytes], int] = {}
        leads = lead.tolist()
        for i in other[~like].tolist():
            key = (int(content[i]), data[begin[i] : begin[i] + size[i]].tobytes())
            if key not in made:
                made[key] = len(leads)
                leads.append(i)
            same[i] = made[key]
        lead = np.array(leads, lead.dtype)
    return lead, same


def _packed_pieces(size, key, number, docs, keys, place, data) -> bytes:
    parts = [size, key, _delta(number), _delta(docs), _delta(keys), place]
    return b"".join([np.array([len(size), len(place)], np.int64).tobytes(), *map(_planes, parts), data.tobytes()])


def _unpacked_pieces(raw: bytes) -> list[np.ndarray]:
    """size, key, and of each use piece number, doc, text key, place; then the pieces' bytes."""
    n, m = np.frombuffer(raw, np.int64, 2).tolist()
    at, out = 16, []
    for k, count in enumerate((n, n, m, m, m, m)):
        x = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * count, at).reshape(8, -1).T).view("<i8").ravel()
        at += x.nbytes
        out.append(np.cumsum(x) if k in (2, 3, 4) else x)
    return [*out, np.frombuffer(raw, np.uint8, offset=at)]


def _planes(x: np.ndarray) -> bytes:
    """All first bytes, all second bytes, and so on: the high ones are alike and shrink to nothing."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _delta(x: np.ndarray) -> np.ndarray:
    return np.diff(x.astype(np.int64), prepend=np.int64(0))


class Pieces:
    """The packed pieces of a shard, put together; equal ones are one piece."""

    def __init__(self, blobs: list[bytes]):
        parts: list[list[np.ndarray]] = [[] for _ in range(7)]
        pieces = 0
        for blob in blobs:
            got = _unpacked_pieces(zstandard.ZstdDecompressor().decompress(blob))
            got[2] = got[2] + pieces
            pieces += len(got[0])
            for part, x in zip(parts, got, strict=True):
                part.append(x)
        self.size, self.key, self.piece, self.doc, self.text_key, self.at, self.data = (np.concatenate(p) for p in parts)
        self.begin = np.cumsum(self.size) - self.size
        # equal bytes have equal keys, so pieces of one group have one key
        lead, same = _distinct(self.data, self.begin, self.size, _contents(self.data, self.begin, self.size) ^ (self.key.astype(np.uint64) << np.uint64(32)))
        self.size, self.key, self.begin, self.piece = self.size[lead], self.key[lead], self.begin[lead], same[self.piece]


def by_key(blobs: Iterator[bytes], parts: int) -> Iterator[list[bytes]]:
    """The pieces of a shard, parted by key, by way of one file for each part."""
    pack = zstandard.ZstdCompressor(level=1)
    files = [tempfile.TemporaryFile() for _ in range(parts)]
    sizes: list[list[int]] = [[] for _ in range(parts)]
    for blob in blobs:
        size, key, piece, doc, text_key, place, data = _unpacked_pieces(zstandard.ZstdDecompressor().decompress(blob))
        begin, part = np.cumsum(size) - size, key % parts
        number = np.empty(len(size), np.int64)
        for k in np.unique(part).tolist():
            u = np.flatnonzero(part == k)
            o = np.flatnonzero(part[piece] == k)
            number[u] = np.arange(len(u))
            sub = pack.compress(_packed_pieces(size[u], key[u], number[piece[o]], doc[o], text_key[o], place[o], slices(data, begin[u], size[u])))
            files[k].write(sub)
            sizes[k].append(len(sub))
    for file, lengths in zip(files, sizes, strict=True):
        file.seek(0)
        yield [file.read(n) for n in lengths]
        file.close()


def _contents(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of slices that follow each other, some two MB at a time."""
    out = np.empty(len(begin), np.uint64)
    ends = begin + size
    at = 0
    while at < len(begin):
        stop = max(at + 1, int(np.searchsorted(ends, begin[at] + STEP_BYTES, "right")))
        low = int(begin[at])
        part = data[low : int(ends[stop - 1])]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(part)), out=sums[1:])
        b, e = begin[at:stop] - low, ends[at:stop] - low
        out[at:stop] = mix((sums[e] - sums[b]) * _power(_INVERSE, len(part) + 1)[b]) ^ size[at:stop].astype(np.uint64)
        at = stop
    return out


def shard_spans(p: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, text_key, start, end of runs of strings that an earlier document has."""
    n = len(p.size)
    least = np.full(n, _LAST, np.int64)
    np.minimum.at(least, p.piece, p.doc)
    most = np.full(n, -(1 << 63), np.int64)
    np.maximum.at(most, p.piece, p.doc)
    _, group, members = np.unique(p.key, return_inverse=True, return_counts=True)
    low, high = np.full(len(members), _LAST, np.int64), np.full(len(members), -(1 << 63), np.int64)
    np.minimum.at(low, group, least)
    np.maximum.at(high, group, most)
    shared = (low < high)[group]
    alone = members[group] == 1
    # the only piece of its key: all its strings have been where the piece has been
    use = np.flatnonzero((shared & alone)[p.piece] & (least[p.piece] < p.doc))
    out = [[p.doc[use]], [p.text_key[use]], [p.at[use]], [p.at[use] + p.size[p.piece[use]]]]
    old = np.flatnonzero(shared & ~alone)
    if len(old):
        # keys are apart from each other, so they are taken in slabs of about SLAB strings
        old = old[np.argsort(group[old], kind="stable")]
        weight = np.cumsum(p.size[old] - WIDTH + 1)
        heads = np.flatnonzero(np.diff(group[old], prepend=-1))
        slab = np.unique((weight[heads] - 1) // SLAB, return_index=True)[1]
        bounds = [*heads[slab].tolist(), len(old)]
        by_piece = np.argsort(p.piece, kind="stable")
        ordered = p.piece[by_piece]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            for col, x in zip(out, _slab(p, old[lo:hi], least, by_piece, ordered), strict=True):
                col += x
    return tuple(np.concatenate(c) for c in out)


def _slab(p: Pieces, old: np.ndarray, least: np.ndarray, by_piece: np.ndarray, ordered: np.ndarray) -> list[list[np.ndarray]]:
    """The spans of all uses of some pieces, which hold all strings of their keys."""
    size = p.size[old]
    begin = np.cumsum(size) - size
    strings = size - WIDTH + 1
    first = np.cumsum(strings) - strings
    data = slices(p.data, p.begin[old], size)
    owner = np.repeat(np.arange(len(old)), strings)
    starts = np.arange(len(owner)) + (begin - first)[owner]
    earliest = least[old][owner]
    # strings that stand once need no place in the order: equal hashes tell which may stand twice
    hashes = _contents(data, starts, np.full(len(starts), WIDTH, np.int64))
    _, same, times = np.unique(hashes, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(times[same] > 1)
    del owner, hashes, same
    if len(twice):
        order, new = sorted_strings(data, starts[twice])
        heads = np.flatnonzero(new)
        by_order = twice[order]
        earliest[by_order] = np.repeat(np.minimum.reduceat(earliest[by_order], heads), np.diff(np.append(heads, len(order))))
    del starts, twice
    lo, hi = np.searchsorted(ordered, old, "left"), np.searchsorted(ordered, old, "right")
    renumber = np.repeat(np.arange(len(old)), hi - lo)
    uses = by_piece[np.arange(len(renumber)) + (lo - (np.cumsum(hi - lo) - (hi - lo)))[renumber]]
    weight = np.cumsum(strings[renumber])
    out: list[list[np.ndarray]] = [[], [], [], []]
    step = 0
    while step < len(uses):  # some million strings at a time
        stop = max(step + 1, int(np.searchsorted(weight, (weight[step - 1] if step else 0) + SLAB, "right")))
        for col, x in zip(out, _gone(p, uses[step:stop], renumber[step:stop], strings, first, earliest), strict=True):
            col.append(x)
        step = stop
    return out


def _gone(p: Pieces, use: np.ndarray, u: np.ndarray, strings: np.ndarray, first: np.ndarray, earliest: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of strings of these uses of pieces whose earliest document is an earlier one."""
    count = strings[u]
    of = np.repeat(np.arange(len(use)), count)
    k = np.arange(len(of)) - (np.cumsum(count) - count)[of]
    gone = earliest[first[u][of] + k] < p.doc[use][of]
    begins, ends = gone.copy(), gone.copy()
    begins[1:] &= ~gone[:-1] | (k[1:] == 0)
    ends[:-1] &= ~gone[1:] | (k[1:] == 0)
    a, b = np.flatnonzero(begins), np.flatnonzero(ends)
    w = use[of[a]]
    return p.doc[w], p.text_key[w], p.at[w] + k[a], p.at[w] + k[b] + WIDTH


def _pieces_of(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 4000):
                batch = whole.slice(low, 4000)
                texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
                docs, keys = batch.column("ord").to_numpy(), batch.column("key").to_numpy()
                at = 0
                while at < len(texts):
                    end, total = at, 0
                    while end < len(texts) and (end == at or total + len(texts[end]) <= BATCH_BYTES):
                        total += len(texts[end])
                        end += 1
                    out = cut_pieces(texts[at:end], docs[at:end], keys[at:end], shards)
                    yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], names=["shard", "blob"])
                    at = end

    return run


class _Shard:
    """The blobs of one shard, in memory up to SLAB_BYTES unpacked, else in a file."""

    def __init__(self):
        self.blobs: list[bytes] = []
        self.lengths: list[int] = []
        self.unpacked, self.file = 0, None

    def add(self, blob: bytes) -> None:
        self.unpacked += zstandard.frame_content_size(blob)
        self.blobs.append(blob)
        if self.unpacked > SLAB_BYTES:
            self.file = self.file or tempfile.TemporaryFile()
            for b in self.blobs:
                self.file.write(b)
                self.lengths.append(len(b))
            self.blobs = []

    def slabs(self) -> Iterator[list[bytes]]:
        if self.file is None:
            yield self.blobs
            return
        self.file.seek(0)
        yield from by_key((self.file.read(n) for n in self.lengths), min(256, -(-2 * self.unpacked // SLAB_BYTES)))
        self.file.close()


def _shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard -> spans."""

    def spans(shard: _Shard) -> Iterator[pa.RecordBatch]:
        for blobs in shard.slabs():
            if blobs:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in shard_spans(Pieces(blobs))], names=["ord", "key", "start", "end"])

    held, at = _Shard(), None
    for batch in batches:
        for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if shard != at:
                yield from spans(held)
                held, at = _Shard(), shard
            held.add(blob)
    yield from spans(held)


def repeated_spans(rows: DataFrame, n_bytes: int) -> DataFrame:
    """rows: ord, key, text (no whole copies) -> ord, key, start, end: byte spans that earlier documents have."""
    shards = min(MOST_SHARDS, max(8, -(-n_bytes // SHARD_BYTES)))
    blobs = rows.select("ord", "key", "text").mapInArrow(_pieces_of(shards), "shard long, blob binary")
    return blobs.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_shard_rows, "ord long, key long, start long, end long")


def _packed(cols: dict[str, list]) -> dict[str, list]:
    pack = zstandard.ZstdCompressor(level=5)
    return {k: cols[k] for k in ("doc_id", "ord", "key", "copy")} | {"packed": [pack.compress(t.encode("utf-8", "surrogatepass")) for t in cols["text"]]}


def _remaining(cols: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
    unpack = zstandard.ZstdDecompressor()
    for doc_id, packed, copy, spans in zip(cols["doc_id"], cols["packed"], cols["copy"], cols["spans"], strict=True):
        data = unpack.decompress(packed)
        if copy:
            runs = [[0, len(data)]] if len(data) >= WIDTH else []
        else:
            runs = []
            for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
        kept, at = [], 0
        for a, b in runs:
            kept.append(data[at:a])
            at = b
        kept = b"".join([*kept, data[at:]])
        for k, v in zip(out, (doc_id, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept), strict=True):
            out[k].append(v)
    return out


def remove_repeats(docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """docs: doc_id, text -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes)."""
    text = common.whole_text().cast("string")
    doc = F.col("doc_id").cast("long")
    rows = docs.select(doc.alias("doc_id"), F.coalesce(doc, F.lit(_LAST)).alias("ord"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("same"))
    slim = common.settle(rows.select("ord", "same", F.octet_length("text").cast("long").alias("n")))
    n_bytes = slim.agg(F.sum("n")).first()[0] or 0
    groups = common.settle(slim.groupBy("same").agg(F.min("ord").alias("lead"), F.count("*").alias("m")).where("m > 1").select("same", "lead"))
    # texts that occur more than once; sent whole only while they are few
    known = F.broadcast(groups) if groups.count() <= 300_000 else groups
    marked = rows.join(known, "same", "left").withColumn("copy", F.coalesce(F.col("ord") > F.col("lead"), F.lit(False)))
    # rows are told apart by doc_id; by their text as well only where a doc_id comes again
    again = common.settle(slim.groupBy("ord").count().where("count > 1").select("ord"))
    n_again = again.count()
    if n_again:
        twice = again.withColumn("again", F.lit(True))
        marked = marked.join(F.broadcast(twice) if n_again <= 300_000 else twice, "ord", "left").withColumn("key", F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0)))
    else:
        marked = marked.withColumn("key", F.lit(0).cast("long"))
    spans = repeated_spans(marked.where(~F.col("copy")), n_bytes)
    by_doc = spans.groupBy("ord", "key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    packed = common.map_batches(marked.select("doc_id", "ord", "key", "copy", "text"), _packed, "doc_id long, ord long, key long, copy boolean, packed binary")
    joined = packed.join(by_doc, ["ord", "key"], "left").select("doc_id", "packed", "copy", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return common.map_batches(joined, _remaining, schema + (", kept binary" if with_bytes else ""))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"))
