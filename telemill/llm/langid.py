"""Language identification: averaged hashed subword embeddings under a linear softmax.

Byte trigrams and 4-grams (with word bounds, ASCII lower-cased) are hashed into
buckets, each with a small embedding; a text is the mean of its grams'
embeddings; a softmax over the learned languages follows. Training is plain
stochastic gradient descent in numpy on a bounded sample: about
SAMPLE_PER_LANGUAGE labelled documents of a language (chosen by a hash of
doc_id and text over the whole table, equal ones once), each with the counts of
all its grams. Since the mean and the linear layer commute, scoring sums one
precomputed logit row per gram over the whole text.

Defined results: a null text, or one without a letter, is `und` with score 0;
a null lang is never learned from; a null doc_id isn't held out and isn't
learned from; with no labelled row at all everything is `und` with score 0;
every other value of lang is learned, however many there are: sample and model
grow with their number (SAMPLE_PER_LANGUAGE documents and 262 kB of weights each).
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE_PER_LANGUAGE = 500
BUCKETS, DIM, EPOCHS, BATCH, RATE, SEED = 1 << 15, 8, 6, 32, 8.0, 17
#: Share of the sample kept from training for temperature and rejection; share of right answers that rejection may cost.
CALIBRATION, REJECT_QUANTILE = 0.2, 0.01
#: Bytes of a text looked at in one step; longer texts take several, which overlap.
STEP = 1 << 22

_FOLD = np.full(256, 32, np.uint8)
for _b in range(256):
    if 65 <= _b <= 90:
        _FOLD[_b] = _b + 32
    elif 97 <= _b <= 122 or _b >= 128:
        _FOLD[_b] = _b


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the whole text's grams and how often each comes."""
    data, total = _padded(text), np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), STEP):
        total += np.bincount(grams(data[at : at + STEP + 3]), minlength=BUCKETS)
    ids = np.flatnonzero(total)
    return ids, total[ids]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def grams(data: np.ndarray) -> np.ndarray:
    """Buckets of all byte trigrams and 4-grams that hold a letter."""
    b = _FOLD[data].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    tri = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    four = (tri[:-1] << np.uint32(8)) | b[3:]
    tri = tri[(tri != 0x202020)]
    four = four[(four != 0x20202020)]
    shift = np.uint32(32 - 15)
    return np.concatenate([(tri * np.uint32(0x9E3779B1)) >> shift, (four * np.uint32(0x85EBCA6B)) >> shift])


def _padded(text: str) -> np.ndarray:
    return np.frombuffer(f" {text} ".encode("utf-8", "surrogatepass"), np.uint8)


class Model:
    def __init__(self, labels: list[str], logits: np.ndarray, bias: np.ndarray, temperature: float, floor: float):
        self.labels, self.logits, self.bias, self.temperature, self.floor = labels, logits, bias, temperature, floor

    def scores(self, text: str) -> np.ndarray:
        ids, counts = gram_counts(text)
        z = (counts @ self.logits[ids] / max(int(counts.sum()), 1) + self.bias) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Label, calibrated probability, and whether rejection would leave the text unlabelled."""
        if not self.labels or not has_letter(text):
            return "und", 0.0, True
        p = self.scores(text)
        k = int(p.argmax())
        return self.labels[k], float(p[k]), bool(p[k] < self.floor)

    def dumps(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, labels=np.array(self.labels, dtype=str), logits=self.logits, bias=self.bias, cal=np.array([self.temperature, self.floor]))
        return f.getvalue()

    @staticmethod
    def loads(data: bytes) -> Model:
        x = np.load(io.BytesIO(data))
        return Model([str(v) for v in x["labels"]], x["logits"], x["bias"], *map(float, x["cal"]))


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """rows: (language, gram buckets, counts). Same rows in the same order give the same model."""
    labels = sorted({lang for lang, _, _ in rows})
    k = len(labels)
    if not k:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(SEED)
    number = {lang: i for i, lang in enumerate(labels)}
    y = np.array([number[lang] for lang, _, _ in rows])
    held = rng.random(len(rows)) < CALIBRATION
    train = np.flatnonzero(~held) if (~held).any() else np.arange(len(rows))
    e, w, b = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.5, (DIM, k)), np.zeros(k)
    weight = len(train) / (k * np.maximum(np.bincount(y[train], minlength=k), 1))

    def forward(at):
        """Means, logits, chances, and the grams of all these rows: bucket, row, share."""
        ids = np.concatenate([rows[i][1] for i in at])
        of = np.repeat(np.arange(len(at)), [len(rows[i][1]) for i in at])
        share = np.concatenate([rows[i][2] / max(rows[i][2].sum(), 1) for i in at])
        h = np.stack([np.bincount(of, weights=share * e[ids, d], minlength=len(at)) for d in range(DIM)], axis=1)
        z = h @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        return h, z, p / p.sum(1, keepdims=True), (ids, of, share)

    steps, done = EPOCHS * -(-len(train) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(train)
        for i in range(0, len(order), BATCH):
            at = order[i : i + BATCH]
            rate = RATE * (1 - done / steps)
            done += 1
            h, _, p, (ids, of, share) = forward(at)
            p[np.arange(len(at)), y[at]] -= 1
            p *= weight[y[at]][:, None] / len(at)
            down = p @ w.T
            w -= 0.1 * rate * (h.T @ p)
            b -= 0.02 * rate * p.sum(0)
            for d in range(DIM):
                e[:, d] -= rate * np.bincount(ids, weights=share * down[of, d], minlength=BUCKETS)
    check = np.flatnonzero(held) if held.any() else train
    z = np.concatenate([forward(check[i : i + BATCH])[1] for i in range(0, len(check), BATCH)])
    best, temperature = np.inf, 1.0
    for t in np.geomspace(0.05, 20, 60):  # temperature by likelihood on the rows kept back
        s = z / t
        s = s - s.max(1, keepdims=True)
        loss = (np.log(np.exp(s).sum(1)) - s[np.arange(len(check)), y[check]]).mean()
        if loss < best - 1e-12:
            best, temperature = loss, float(t)
    s = np.exp((z - z.max(1, keepdims=True)) / temperature)
    top = (s / s.sum(1, keepdims=True)).max(1)[z.argmax(1) == y[check]]
    return Model(labels, e @ w, b, temperature, float(np.quantile(top, REJECT_QUANTILE)) if len(top) else 0.0)


def sample_rows(docs: DataFrame) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """The bounded training sample. docs: doc_id, text, lang; all of it is open to learning."""
    usable = docs.where("doc_id is not null and text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text", F.lit(SEED)).alias("h"))
    # a row a language; documents that repeat count once, so a language's share never leaves it out
    sizes = usable.select("lang", "h").distinct().groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not sizes:
        return []
    large = [x for r in sizes if r["count"] > SAMPLE_PER_LANGUAGE for x in (F.lit(r["lang"]), F.lit(SAMPLE_PER_LANGUAGE / r["count"]))]
    share = F.coalesce(F.try_element_at(F.create_map(*large), F.col("lang")), F.lit(1.0)) if large else F.lit(1.0)
    draw = F.pmod("h", F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = common.settle(usable.where(draw < share).groupBy("h", "lang").agg(F.min("text").alias("text")))

    def counted(cols: dict[str, list]) -> dict[str, list]:
        got = [gram_counts(t) for t in cols["text"]]
        return {"h": cols["h"], "lang": cols["lang"], "ids": [i.tolist() for i, _ in got], "counts": [c.tolist() for _, c in got]}

    # about SAMPLE_PER_LANGUAGE documents of each language, at most BUCKETS counts of each; the limit is a hard bound on what comes to the driver
    rows = common.map_batches(chosen.select("h", "lang", "text"), counted, "h long, lang string, ids array<int>, counts array<int>").limit(2 * SAMPLE_PER_LANGUAGE * len(sizes)).collect()
    return [(r["lang"], np.array(r["ids"], np.int64), np.array(r["counts"], np.int64)) for r in sorted(rows, key=lambda r: (r["h"], r["lang"]))]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs: doc_id, text -> doc_id, lang_pred, score, rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model.dumps())  # BUCKETS x languages doubles
    held: dict[str, Model] = {}

    def batch(cols: dict[str, list]) -> dict[str, list]:
        if "m" not in held:
            held["m"] = Model.loads(sent.value)
        found = [held["m"].predict(t) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "rejected": [f[2] for f in found]}

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), batch, "doc_id long, lang_pred string, score double, rejected boolean")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = identify(docs, fit(sample_rows(docs.where(~out))))
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
