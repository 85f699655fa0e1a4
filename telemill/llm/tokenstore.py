"""Token ids in a content-addressed store.

Texts become id streams; a rolling hash cuts each stream into chunks; every
distinct chunk is stored once, under the SHA-256 of its bytes; a recipe per
document lists its chunks; a Merkle tree over the recipes proves that what is
read back is what was written. Layout under one folder (all Parquet, zstd):

    store       chunks (hash, ids as little-endian unsigned 32-bit, n), and the recipes as the tasks wrote them
    recipes     doc_id ascending: pos, start, n_tokens, chunks (hash, n, at), root
    manifest    level, node, documents, ids, hash: level 1 over FAN recipes' roots a node, each further level over FAN nodes, up to one root

Reading joins every use of a chunk with what the chunk's own bytes hash to. A
use whose chunk is missing or doesn't hash to its name makes its document
unverified (a missing one leaves its checksum null); recipes or manifest rows
that don't agree with each other, or are gone, raise StoreDamaged.

Defined results: a null text is the empty one; a document without words is the
end id alone; documents with the same doc_id stay apart (ordered by their place
in the input); a null doc_id sorts first; an empty table gives empty files.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

END_ID = 1
#: Chunks end where the rolling hash has MASK_BITS zero bits, after MIN_CHUNK and at MAX_CHUNK ids at the latest.
MASK_BITS, MIN_CHUNK, MAX_CHUNK, WINDOW = 10, 256, 8192, 16
#: Words that a worker remembers with their ids; then it starts anew.
CACHE_WORDS = 900_000
SEEN_CHUNKS = 200_000
#: Children of a node of the Merkle tree; chunks with over one in HOT of all uses (fewer than HOT chunks, then) are joined by broadcast.
FAN, HOT = 1024, 4096

#: Text of these characters alone splits into words by a plain rule (see Encoder).
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-;=-@\\[-`{-~\t-\r ]*")
_WORDS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-;=-@\\[-`{-~]+")


#: How the model spells bytes: printable ones as themselves, the others from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """The tokenizer's ids of whole texts, each distinct word encoded once.

    This vocabulary's tokenizer lower-cases, drops white space, and encodes each
    word by itself: a run of letters, a digit, or a run of other characters. So the
    ids of a text are those of its blank-separated pieces in order, and those of a
    text or piece without apostrophes, markup or rare characters those of its words.
    All encoding is the tokenizer's; each plain word goes straight to its model.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.four = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        self.words: dict[str, bytes] = {}

    def _split(self, text: str) -> list[str]:
        """Words, and blank-separated pieces that no plain rule splits."""
        if _PLAIN.fullmatch(text):
            return _WORDS.findall(text.lower())
        return [w for p in text.split(" ") for w in (_WORDS.findall(p.lower()) if _PLAIN.fullmatch(p) else (p,))]

    def _word(self, word: str) -> bytes:
        """A plain word by the tokenizer's own model: its normalizer and splitter leave such a word as it is."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTES)
        return b"".join([self.four[t.id] for t in self.tokenizer.model.tokenize(word)])

    def _learn(self, new: list[str]) -> None:
        own = self.words
        rest = []
        for w in new:
            if _WORDS.fullmatch(w):
                own[w] = self._word(w)
            else:
                rest.append(w)
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            own[w] = np.array(e.ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for at in range(0, len(texts), 100):
            split = [self._split(t) for t in texts[at : at + 100]]
            new = set().union(*split).difference(self.words)
            if len(self.words) + len(new) > CACHE_WORDS:
                self.words.clear()
                new = set().union(*split)
            self._learn(list(new))
            out += [np.frombuffer(b"".join(map(self.words.__getitem__, ws)), "<u4") for ws in split]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of chunks. The hash of a place covers the WINDOW ids up to it, so equal runs are cut alike wherever they stand."""
    n = len(ids)
    if n <= MIN_CHUNK:
        return [n]
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    rolled, width = mixed, 1
    while width < WINDOW:  # by doubling: sum over j < WINDOW of mixed[i - j] << j
        rolled = rolled.copy()
        rolled[width:] += rolled[:-width].copy() << np.uint64(width)
        width *= 2
    marks = np.flatnonzero((rolled >> np.uint64(64 - MASK_BITS)) == 0) + 1
    ends, last = [], 0
    for m in [*marks.tolist(), n]:
        while m - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if m - last >= MIN_CHUNK or (m == n and m > last):
            ends.append(m)
            last = m
    return ends


_CHUNKS = "array<struct<hash:binary,n:int,at:long>>"
_ROWS = f"kind string, key binary, n long, ids binary, doc_id long, row long, chunks {_CHUNKS}"


def encoded_rows(docs: DataFrame, vocabulary: str) -> DataFrame:
    """A recipe row for each document, and a row for each chunk, whose bytes a task sends once."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text().cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    schema = docs.sparkSession.createDataFrame([], _ROWS).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        seen: set[bytes] = set()
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                doc_ids, texts, numbers = (c.to_pylist() for c in batch.slice(first, 500).columns)
                out: list[tuple] = []
                for doc_id, encoded, row in zip(doc_ids, encode(texts), numbers, strict=True):
                    ids = np.append(encoded, np.uint32(END_ID)).astype("<u4")
                    begin, chunks = 0, []
                    for end in cut_points(ids):
                        data = ids[begin:end].tobytes()
                        key = hashlib.sha256(data).digest()
                        chunks.append({"hash": key, "n": end - begin, "at": begin})
                        if key not in seen:
                            if len(seen) > SEEN_CHUNKS:
                                seen.clear()
                            seen.add(key)
                            out.append(("chunk", key, end - begin, data, None, None, None))
                        begin = end
                    out.append(("recipe", row.to_bytes(8, "big"), len(ids), None, doc_id, row, chunks))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
        # the worker goes on to other tasks, perhaps of other operators: it doesn't keep a large memory for them
        if len(encode.words) > CACHE_WORDS // 2:
            encode.words.clear()

    return rows.mapInArrow(run, schema)


def _root(chunks: str = "chunks") -> Column:
    """A document's root: the hash of its chunks' hashes, sizes and places."""
    return F.sha2(F.array_join(F.transform(chunks, lambda c: F.concat_ws(":", F.hex(c["hash"]), c["n"].cast("string"), c["at"].cast("string"))), ",").cast("binary"), 256)


def _nodes(children: DataFrame) -> DataFrame:
    """children: pos, documents, ids, hash -> one row for FAN of them: node, documents, ids, hash."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"])
    return children.groupBy(F.floor(F.col("pos") / FAN).alias("node")).agg(F.sum("documents").alias("documents"), F.sum("ids").alias("ids"), F.sha2(F.array_join(ordered, "").cast("binary"), 256).alias("hash"))


def _leaves(recipes: DataFrame) -> DataFrame:
    return recipes.select("pos", F.lit(1).cast("long").alias("documents"), F.col("n_tokens").alias("ids"), _root().alias("hash"))


def _children(level: DataFrame) -> DataFrame:
    return level.select(F.col("node").alias("pos"), "documents", "ids", "hash")


_MANIFEST = "level int, node long, documents long, ids long, hash string"


def write_store(docs: DataFrame, folder: str, vocabulary: str | None = None) -> None:
    spark = docs.sparkSession
    rows = encoded_rows(docs, vocabulary or default_vocabulary())
    # a chunk goes by its hash, at most once a task, and stays once; a recipe goes by its row, so a popular chunk weighs on no task
    once = F.row_number().over(Window.partitionBy("key").orderBy("kind"))
    rows.repartition("key").withColumn("copy", once).where("copy = 1").drop("copy").write.option("compression", "zstd").parquet(f"{folder}/store")
    recipes = spark.read.schema(_ROWS).parquet(f"{folder}/store").where("kind = 'recipe'").select("doc_id", "row", F.col("n").alias("n_tokens"), "chunks")
    ordered = recipes.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").withColumn("part", F.spark_partition_id())
    ordered = common.parted(ordered, "recipes-raw")
    sums = ordered.groupBy("part").agg(F.sum("n_tokens").alias("ids"), F.count("*").alias("documents"))
    # one row for each file of recipes: running sums over files, not over documents
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("ids", "documents")))
    run = Window.partitionBy("part").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = ordered.join(F.broadcast(offsets), "part").select(
        (F.col("documents_before") + F.count("*").over(run) - 1).alias("pos"), "doc_id", "row", (F.col("ids_before") + F.sum("n_tokens").over(run) - F.col("n_tokens")).cast("long").alias("start"), "n_tokens", "chunks", _root().alias("root")
    )
    placed.write.option("compression", "zstd").parquet(f"{folder}/recipes")
    level, children, k = None, _leaves(spark.read.parquet(f"{folder}/recipes")), 0
    while level is None or level.count() > 1:
        k += 1
        _nodes(children).select(F.lit(k).alias("level"), "node", "documents", "ids", "hash").write.option("compression", "zstd").mode("append").parquet(f"{folder}/manifest")
        level = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").where(F.col("level") == k)
        children = _children(level)


# --- CRC-32 of a concatenation from the parts' own -----------------------------------------


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC-32 polynomial, bits reflected."""
    p = 0
    for _ in range(32):
        if a & 0x80000000:
            p ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return p


_tables: list[np.ndarray] = []


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """The part of crc32(x + y) that x has in it, from crc32(x) and len(y); crc32(y) is the other part, to be XORed."""
    if not _tables:
        x = 1 << 23  # the polynomial x to the 8th: one byte
        for _ in range(48):  # for each power of two bytes, products with the four bytes of a checksum
            bit = [_times(x, 1 << b) for b in range(32)]
            table = np.zeros((4, 256), np.uint64)
            for byte in range(4):
                for b in range(8):
                    table[byte, 1 << b : 2 << b] = table[byte, : 1 << b] ^ np.uint64(bit[8 * byte + b])
            _tables.append(table)
            x = _times(x, x)
    out, left, k = crc.astype(np.uint64), n_bytes.astype(np.int64), 0
    while left.any():
        at = np.flatnonzero(left & 1)
        if len(at):
            t, c = _tables[k], out[at]
            out[at] = t[0, c & 255] ^ t[1, c >> 8 & 255] ^ t[2, c >> 16 & 255] ^ t[3, c >> 24]
        left, k = left >> 1, k + 1
    return out.astype(np.int64)


class StoreDamaged(ValueError):
    """Recipes and manifest don't agree."""


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_ROWS).parquet(f"{folder}/store").where("kind = 'chunk'").select(F.col("key").alias("hash"), "ids", "n")


def damaged_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """level, node of each place where the tree over the recipes, as they are now, is not the manifest's."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    top = manifest.agg(F.max("level")).first()[0] or 1
    # a tree ends in one root
    bad = manifest.where((F.col("level") == top) & (F.col("node") > 0)).select("level", "node")
    for k in range(1, top + 1):
        own = _nodes(_leaves(spark.read.parquet(f"{folder}/recipes")) if k == 1 else _children(manifest.where(F.col("level") == k - 1)))
        kept = manifest.where(F.col("level") == k).drop("level")
        same = F.coalesce(F.col("o.hash") == F.col("m.hash"), F.lit(False)) & F.coalesce(F.col("o.documents") == F.col("m.documents"), F.lit(False)) & F.coalesce(F.col("o.ids") == F.col("m.ids"), F.lit(False))
        one = own.alias("o").join(kept.alias("m"), F.col("o.node") == F.col("m.node"), "full").where(~same).select(F.lit(k).alias("level"), F.coalesce("o.node", "m.node").alias("node"))
        bad = bad.unionAll(one)
    return bad


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, verified.

    Each stored chunk is read and hashed once, however many documents use it; a
    document's checksum is the XOR of its chunks' own, each moved on by the bytes
    that follow it, so no document is put together in memory.
    """
    damaged = damaged_nodes(spark, folder)
    worst = damaged.orderBy("level", "node").take(3)
    if worst:
        raise StoreDamaged(f"{folder}: recipes and manifest differ at (level, node) {[tuple(r) for r in worst]}")
    sound = F.sha2("ids", 256) == F.lower(F.hex("hash"))
    chunks = common.settle(read_chunks(spark, folder).select("hash", F.crc32("ids").alias("crc"), F.octet_length("ids").cast("long").alias("bytes"), sound.alias("sound")))
    recipes = spark.read.parquet(f"{folder}/recipes")
    total = recipes.agg(F.sum(F.size("chunks"))).first()[0] or 0
    used = recipes.select("pos", "doc_id", "start", "n_tokens", (F.col("root") == _root()).alias("named"), F.explode("chunks").alias("c")).select("pos", "doc_id", "start", "n_tokens", "named", "c.hash", "c.n", "c.at")
    # fewer than HOT chunks, by the threshold
    hot = F.broadcast(common.settle(used.groupBy("hash").count().where(F.col("count") > total / HOT).select("hash")))
    rest = used.join(hot, "hash", "left_anti").join(chunks, "hash", "left")
    popular = used.join(hot, "hash", "left_semi").join(F.broadcast(chunks.join(hot, "hash", "left_semi")), "hash", "left")

    @F.pandas_udf("long")
    def moved(crc: pd.Series, n_bytes: pd.Series) -> pd.Series:
        return pd.Series(crc_shift(crc.to_numpy(np.int64), n_bytes.to_numpy(np.int64)))

    met = rest.unionByName(popular)
    met = met.withColumn("moved", moved(F.coalesce("crc", F.lit(0)), 4 * (F.col("n_tokens") - F.col("at") - F.col("n"))))
    there = F.coalesce(F.col("sound") & (F.col("bytes") == 4 * F.col("n")) & F.col("named"), F.lit(False))
    docs = met.groupBy("pos", "doc_id", "start", "n_tokens").agg(F.bit_xor("moved").alias("crc"), F.bool_and(there).alias("there"), F.bool_and(F.col("crc").isNotNull()).alias("all"), F.sum("bytes").alias("bytes"))
    return docs.select("doc_id", "start", F.coalesce(F.when(F.col("all"), F.floor(F.col("bytes") / 4)), F.col("n_tokens")).cast("long").alias("n_tokens"), F.when(F.col("all"), F.col("crc")).alias("ids_crc32"), (F.col("there") & (F.col("bytes") == 4 * F.col("n_tokens"))).alias("verified"))


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Documents rebuilt from the store: doc_id, start, ids (array of long). A missing chunk is an error."""
    recipes = spark.read.parquet(f"{folder}/recipes")
    used = recipes.select("pos", "doc_id", "start", F.explode("chunks").alias("c")).select("pos", "doc_id", "start", "c.at", "c.hash")
    parts = used.join(read_chunks(spark, folder), "hash", "left").groupBy("pos", "doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"))

    def whole(cols: dict[str, list]) -> dict[str, list]:
        if any(p["ids"] is None for parts in cols["parts"] for p in parts):
            raise StoreDamaged(f"{folder}: a chunk is missing")
        return {"doc_id": cols["doc_id"], "start": cols["start"], "ids": [np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").tolist() for parts in cols["parts"]]}

    return common.map_batches(parts.select("doc_id", "start", "parts"), whole, "doc_id long, start long, ids array<long>")


def store_and_read(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    folder = common.shared_path(docs.sparkSession, "tokens")
    write_store(docs, folder, vocabulary)
    return read_index(docs.sparkSession, folder)


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read(common.table(spark, sf_dir, "documents"))
