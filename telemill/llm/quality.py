"""Quality by weak labels: heuristic labellers, expectation-maximisation, a hashed linear scorer.

Overlapping heuristics vote good (1), bad (2) or nothing (0) on each whole text.
The votes of all documents are counted by pattern; there are at most 3^L
patterns, however many documents. Expectation-maximisation over those counts
estimates each labeller's accuracy and the share of bad texts (a naive Bayes
mixture with missing votes), which gives every pattern a posterior. Posteriors
of a bounded sample (SAMPLE documents by hash of doc_id and text, equal ones
once, whole texts) train a logistic scorer over hashed words and the binned
statistics that the heuristics look at; it then scores every whole document.

Toxicity is a class of its own, with two sources. A hashed linear scorer learns
it from a bounded sample of the labels table (TOXIC_SAMPLE labelled documents by
hash of doc_id, whole texts): words and beginnings of words that are much
commoner in toxic texts, of whatever language, get weights by logistic
regression on each text's worst PASSAGE words; a text is judged by its worst
passage. A list of insults is a weak labeller, which objects where they are
TOXIC_RATE of a text's words (TOXIC_LEAST at least); the same sample tells how
often it is right (LIST_TRUST where there are no labels). Either of the two may
find a text toxic: their chances of being wrong are multiplied.

Decision: rejected if the quality scorer's probability of a bad text reaches
THRESHOLD, or the toxicity does, which no training text should carry however well
it is written.

Defined results: a null, empty or wordless text has quality 0 and is rejected;
each row is judged by itself, so copies agree; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE = 4000
BUCKETS, EPOCHS, STEPS, BATCH, RATE, DECAY, SEED = 1 << 14, 8, 1500, 32, 0.5, 1e-4, 23
THRESHOLD = 0.5
#: Largest share of good texts that a labeller is allowed to object to.
MOST_FALSE = 0.003
TOXIC_RATE, TOXIC_LEAST, LIST_TRUST = 0.004, 1, 0.9
#: Labelled documents that toxicity is learnt from; words judged together; buckets of words and of their beginnings.
TOXIC_SAMPLE, PASSAGE, TOXIC_BUCKETS, BEGINNING = 20_000, 150, 1 << 20, 5
#: A word counts that so many toxic texts have, so many times the share of others, by chance with this probability at most.
WORD_LEAST, WORD_ODDS, WORD_CHANCE = 3, 8, 2e-3
#: What a toxic text weighs in training, other texts being so many more.
TOXIC_WEIGHT, TOXIC_STEPS = 3.0, 600
#: Common insults; a list to replace for other corpora.
ABUSE = frozenset("idiot idiots moron morons scum clown clowns pathetic stupid trash loser losers garbage disgusting worthless imbecile dumb vermin filth fool fools".split())

#: What words are stripped of at both ends.
_EDGE = ".,;:!?%$&*#'\"()|[]{}<>/\\^~`=+-_@«»„“”‘’‚‹›…–—¿¡·•"
_ODD = re.compile(r"[^\w\s.,;:!?'\"()\-]+")
STATS = ("odd", "upper", "repeat", "table", "distinct", "lines", "bang", "mean", "abuse")


def statistics(text: str | None) -> tuple[np.ndarray, list[str]]:
    """Shares that the heuristics judge, and the words (lower case, bare of punctuation)."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return np.zeros(len(STATS)), []
    odd = sum(len(x) for x in _ODD.findall(text)) / len(text)
    upper = sum(len(w) > 1 for w in [w for w in words if w.isupper()]) / n
    repeat = sum(map(str.__eq__, words, words[1:])) / n
    table = (words.count("|") + words.count("||")) / n
    bare = [w.strip(_EDGE) for w in text.lower().split()]
    # distinct words as a share of what as long a text can be expected to have
    distinct = len(set(bare)) / n * max(1.0, (n / 50) ** 0.5)
    lines = [x for x in text.split("\n") if x]
    copied = 1 - len(set(lines)) / len(lines) if lines else 0.0
    bang = (text.count("!") + text.count("?")) / n
    mean = len(text) / n
    abuse = sum(map(ABUSE.__contains__, bare))
    if abuse < TOXIC_LEAST:
        abuse = 0
    return np.array([odd, upper, repeat, table, distinct, copied, bang, mean, abuse / n]), bare


#: statistic: (good while it is at most, bad from). A pair in falling order reads the other way round.
LIMITS = {"odd": (0.03, 0.08), "upper": (0.15, 0.4), "repeat": (0.05, 0.2), "table": (0.03, 0.15), "distinct": (0.5, 0.25), "lines": (0.2, 0.5), "bang": (0.1, 0.4), "mean": (10.0, 16.0)}
LABELLERS = tuple(LIMITS)


def votes(stats: np.ndarray) -> list[int]:
    out = []
    for name, (good, bad) in LIMITS.items():
        x = stats[STATS.index(name)]
        x, good, bad = (x, good, bad) if good < bad else (-x, -good, -bad)
        out.append(1 if x <= good else 2 if x >= bad else 0)
    return out


def pattern(stats: np.ndarray) -> int:
    return sum(v * 3**i for i, v in enumerate(votes(stats)))


class LabelModel:
    """share of bad texts, and by labeller the chance of each vote given good and bad."""

    def __init__(self, prior: float, chance: np.ndarray):
        self.prior, self.chance = prior, chance

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """v: patterns x labellers of votes -> chance of a bad text. A vote of nothing tells nothing."""
        log = np.log(np.array([1 - self.prior, self.prior]))[None, :].repeat(len(v), 0)
        for i in range(v.shape[1]):
            log += np.where((v[:, i] > 0)[:, None], np.log(self.chance[i][:, v[:, i]]).T, 0.0)
        log -= log.max(1, keepdims=True)
        p = np.exp(log)
        return p[:, 1] / p.sum(1)


def unpack(patterns: np.ndarray) -> np.ndarray:
    return np.stack([patterns // 3**i % 3 for i in range(len(LABELLERS))], axis=1).astype(int)


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> LabelModel:
    """Expectation-maximisation on pattern counts. It begins where any bad vote outweighs a few good ones; smoothing keeps every vote possible."""
    v = unpack(patterns)
    n = max(float(counts.sum()), 1.0)
    bad = np.where((v == 2).any(1), 0.9, 0.05)
    model = LabelModel(0.1, np.ones((v.shape[1], 2, 3)))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - bad), counts * bad], axis=1)
        prior = float(np.clip((weight[:, 1].sum() + 1) / (n + 10), 1e-3, 0.6))
        chance = np.ones((v.shape[1], 2, 3))
        for i in range(v.shape[1]):
            for k in (0, 1):
                got = np.array([weight[v[:, i] == x, k].sum() for x in (1, 2)])
                prior_votes = np.array([9.0, 1.0]) if k == 0 else np.array([5.0, 5.0])
                chance[i, k, 1:] = (got + prior_votes) / (got.sum() + 10)
            # the heuristics are made to be right when they object: no class of good texts may form around an objection
            chance[i, 0, 2] = min(chance[i, 0, 2], MOST_FALSE, chance[i, 1, 2])
            chance[i, 0, 1] = 1 - chance[i, 0, 2]
        model = LabelModel(prior, chance)
        new = model.posterior(v)
        if np.abs(new - bad).max(initial=0) < 1e-6:
            break
        bad = new
    return model


#: Bins of the statistics; the first begins where a labeller no longer calls a text good.
_EDGES = {"odd": (0.03, 0.05, 0.08, 0.15), "upper": (0.15, 0.25, 0.4, 0.7), "repeat": (0.05, 0.1, 0.2, 0.5), "table": (0.03, 0.08, 0.15, 0.3), "distinct": (0.15, 0.25, 0.35, 0.5), "lines": (0.2, 0.35, 0.5, 0.8), "bang": (0.1, 0.2, 0.4, 0.8), "mean": (10.0, 12.0, 14.0, 16.0)}


class Bag:
    """A text's words, and its distinct ones with their hashes and those of their beginnings."""

    def __init__(self, bare: list[str]):
        self.bare = bare
        self.words = sorted(set(bare))
        coded = [w.encode("utf-8", "surrogatepass") for w in self.words]
        n = len(coded)
        self.own = np.fromiter(map(zlib.crc32, coded), np.uint32, n)
        begun = np.fromiter(map(zlib.crc32, [c[:BEGINNING] for c in coded]), np.uint32, n) ^ np.uint32(0x9E3779B9)
        self.longer = np.fromiter(map(len, coded), np.int64, n) > BEGINNING
        mask = np.uint32(TOXIC_BUCKETS - 1)
        #: Of each distinct word its bucket of toxicity, and that of its first BEGINNING bytes if it goes on.
        self.toxic = list(zip((self.own & mask).tolist(), np.where(self.longer, begun & mask, self.own & mask).tolist(), strict=True))


def features(stats: np.ndarray, bag: Bag) -> tuple[np.ndarray, np.ndarray]:
    """Buckets, each once, and weights: distinct words (1 over the root of their number each) and one bucket for each statistic's bin."""
    ids, times = np.unique(bag.own % np.uint32(BUCKETS - 256), return_counts=True)
    own = [BUCKETS - 256 + 8 * k + int(np.searchsorted(e, stats[STATS.index(s)], side="right")) for k, (s, e) in enumerate(_EDGES.items())]
    return np.concatenate([ids.astype(np.int64), own]), np.concatenate([times / max(len(bag.words), 1) ** 0.5, np.ones(len(own))])


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """Logistic regression on soft labels by stochastic gradient descent; the last weight is the bias."""
    w = np.zeros(BUCKETS + 1)
    rng = np.random.default_rng(SEED)
    batches = max(1, -(-len(rows) // BATCH))
    epochs = max(EPOCHS, -(-STEPS // batches))  # small samples are gone through more often
    steps, done = epochs * batches, 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), BATCH):
            rate = RATE * (1 - done / steps)
            done += 1
            part = [rows[j] for j in order[i : i + BATCH]]
            errors = np.array([1 / (1 + np.exp(-np.clip(w[ids] @ x + w[-1], -30, 30))) - y for ids, x, y in part]) / len(part)
            w *= 1 - rate * DECAY
            for (ids, x, _), e in zip(part, errors, strict=True):
                np.add.at(w, ids, -rate * e * x)
            w[-1] -= rate * errors.sum()
    return w


def train(docs: DataFrame) -> np.ndarray:
    """docs: doc_id, text -> the scorer's weights."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def voted(cols: dict[str, list]) -> dict[str, list]:
        got = [statistics(t) for t in cols["text"]]
        return {"pattern": [pattern(s) if bare else -1 for s, bare in got]}

    seen = common.map_batches(rows, voted, "pattern int").groupBy("pattern").count().collect()  # at most 3^8 rows
    seen = sorted((r["pattern"], r["count"]) for r in seen if r["pattern"] >= 0)
    if not seen:
        return np.zeros(BUCKETS + 1)
    patterns, counts = np.array([p for p, _ in seen]), np.array([float(c) for _, c in seen])
    model = fit_labels(patterns, counts)
    bad = dict(zip(patterns.tolist(), model.posterior(unpack(patterns)).tolist(), strict=True))

    def drawn(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"h": [], "ids": [], "x": [], "y": []}
        for h, text in zip(cols["h"], cols["text"], strict=True):
            stats, bare = statistics(text)
            if bare:
                ids, x = features(stats, Bag(bare))
                for k, v in zip(out, (h, ids.tolist(), x.tolist(), bad.get(pattern(stats), 0.0)), strict=True):
                    out[k].append(v)
        return out

    # the least hashes of distinct documents that have words: never none where there are any
    hashed = docs.select(F.xxhash64("doc_id", "text", F.lit(SEED)).alias("h"), F.col("text").cast("string").alias("text")).where(common.whole_text().rlike("\\S"))
    cut = hashed.select("h").distinct().orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    if cut is None:
        return np.zeros(BUCKETS + 1)
    chosen = common.settle(hashed.where(F.col("h") <= cut).groupBy("h").agg(F.min("text").alias("text")))
    # at most SAMPLE rows of at most BUCKETS weights
    got = common.map_batches(chosen, drawn, "h long, ids array<int>, x array<double>, y double").collect()
    got.sort(key=lambda r: r["h"])
    return fit_scorer([(np.array(r["ids"]), np.array(r["x"]), r["y"]) for r in got])


# --- toxicity -------------------------------------------------------------------------------


@dataclass
class Toxicity:
    """Weights by bucket, the bias, and the chance that the list is right when it objects."""

    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -math.inf
    trust: float = LIST_TRUST

    def judge(self, stats: np.ndarray, bag: Bag) -> float:
        worst = worst_passage(bag, self.weights)[0] + self.bias if self.weights else -math.inf
        scorer = 1 / (1 + math.exp(-max(min(worst, 30.0), -30.0))) if worst > -math.inf else 0.0
        return 1 - (1 - scorer) * (1 - (self.trust if stats[-1] >= TOXIC_RATE else 0.0))


def worst_passage(bag: Bag, weights: dict[int, float]) -> tuple[float, list[int]]:
    """The largest sum of weights of the distinct buckets within PASSAGE words, and the buckets."""
    known = {w: [b for b in {x, y} if b in weights] for w, (x, y) in zip(bag.words, bag.toxic, strict=True) if x in weights or y in weights}
    if not known:
        return 0.0, []
    hits = [(i, known[w]) for i, w in enumerate(bag.bare) if w in known]
    inside: dict[int, int] = {}
    top, best, total, first = 0.0, [], 0.0, 0
    for i, buckets in hits:  # weights are not negative, so the best passage ends where it finds a word
        for b in buckets:
            inside[b] = inside.get(b, 0) + 1
            total += weights[b] if inside[b] == 1 else 0.0
        while hits[first][0] <= i - PASSAGE:
            for b in hits[first][1]:
                inside[b] -= 1
                total -= weights[b] if not inside[b] else 0.0
            first += 1
        if total > top + 1e-9:
            top, best = total, [b for b, n in inside.items() if n]
    return top, best


def _by_chance(toxic: int, other: int, share: float) -> float:
    """Chance that of so many texts as many or more are toxic."""
    n = toxic + other
    log = lambda k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log(1 - share)
    return sum(math.exp(log(k)) for k in range(toxic, n + 1))


def fit_toxic(rows: list[tuple[list[int], float]]) -> tuple[dict[int, float], float]:
    """Logistic regression on the buckets of the worst passages; weights are drawn to 1 and never negative."""
    names = sorted({b for ids, _ in rows for b in ids})
    place = {b: i for i, b in enumerate(names)}
    row = np.repeat(np.arange(len(rows)), [len(ids) for ids, _ in rows])
    col = np.array([place[b] for ids, _ in rows for b in ids], int)
    y = np.array([t for _, t in rows], float)
    each = np.where(y > 0, TOXIC_WEIGHT, 1.0)
    w, bias = np.ones(len(names)), -2.0
    for _ in range(TOXIC_STEPS):
        g = each * (1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(rows)) + bias, -30, 30))) - y) / len(rows)
        w = np.maximum(w - 4.0 * np.bincount(col, g[row], len(names)) - 0.004 * (w - 1), 0.0)
        bias -= 2.0 * g.sum()
    return {b: float(x) for b, x in zip(names, w, strict=True) if x > 0}, float(bias)


def train_toxic(docs: DataFrame, labels: DataFrame | None) -> Toxicity:
    """docs: doc_id, text; labels: doc_id, toxic -> the toxicity model; without labels of both kinds only the list."""
    if labels is None:
        return Toxicity()
    told = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    share = min(1.0, TOXIC_SAMPLE / max(told.count(), 1))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20)) < int(share * (1 << 20))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(draw)
    sample = common.parted(rows.join(told.where(draw), "doc_id"), "toxic-sample")

    def seen(cols: dict[str, list]) -> dict[str, list]:
        """By bucket (-1: texts, -2: objections of the list) how many toxic and other texts have it."""
        count: dict[int, list[int]] = {}
        for text, toxic in zip(cols["text"], cols["toxic"], strict=True):
            stats, bare = statistics(text)
            if bare:
                for b in {-1, *((-2,) if stats[-1] >= TOXIC_RATE else ()), *(b for both in Bag(bare).toxic for b in both)}:
                    count.setdefault(b, [0, 0])[0 if toxic else 1] += 1
        return {"bucket": list(count), "toxic": [x[0] for x in count.values()], "other": [x[1] for x in count.values()]}

    counts = common.map_batches(sample, seen, "bucket int, toxic long, other long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counts = common.settle(counts.where((F.col("bucket") < 0) | (F.col("toxic") >= WORD_LEAST)))
    whole = {r["bucket"]: (r["toxic"], r["other"]) for r in counts.where("bucket < 0").collect()}
    toxic, other = whole.get(-1, (0, 0))
    right, wrong = whole.get(-2, (0, 0))
    model = Toxicity(trust=(right + 10 * LIST_TRUST) / (right + wrong + 10))
    if not toxic or not other:
        return model
    # at most TOXIC_BUCKETS rows, in practice a few hundred
    rich = counts.where((F.col("bucket") >= 0) & (F.col("toxic") * (other + 1) >= WORD_ODDS * (F.col("other") + 0.5) * (toxic + 1))).collect()
    chosen = {r["bucket"]: 1.0 for r in rich if _by_chance(r["toxic"], r["other"], toxic / (toxic + other)) <= WORD_CHANCE}
    if not chosen:
        return model
    sent = docs.sparkSession.sparkContext.broadcast(chosen)

    def worst(cols: dict[str, list]) -> dict[str, list]:
        got = [sorted(worst_passage(Bag(statistics(t)[1]), sent.value)[1]) for t in cols["text"]]
        return {"ids": got, "toxic": cols["toxic"]}

    found = common.map_batches(sample, worst, "ids array<int>, toxic int").groupBy("ids", "toxic").count().collect()  # at most TOXIC_SAMPLE rows of a few buckets
    model.weights, model.bias = fit_toxic(sorted((list(r["ids"]), float(r["toxic"])) for r in found for _ in range(r["count"])))
    return model


_JUDGED = "quality double, toxicity double, keep boolean"


def _judge(text: str | None, w: np.ndarray, model: Toxicity) -> tuple[float, float, bool]:
    stats, bare = statistics(text)
    if not bare:
        return 0.0, 0.0, False
    bag = Bag(bare)
    ids, x = features(stats, bag)
    bad = float(1 / (1 + np.exp(-np.clip(w[ids] @ x + w[-1], -30, 30))))
    toxic = model.judge(stats, bag)
    return 1 - bad, toxic, bad < THRESHOLD and toxic < THRESHOLD


def classify(docs: DataFrame, weights: np.ndarray, toxic: Toxicity | None = None) -> DataFrame:
    """docs: doc_id, text -> doc_id, quality, toxicity, keep. Both are chances, of a good and of a toxic text."""
    sent = docs.sparkSession.sparkContext.broadcast((weights, toxic or Toxicity()))  # BUCKETS + 1 doubles, and the words of toxic texts

    def batch(cols: dict[str, list]) -> dict[str, list]:
        got = [_judge(t, *sent.value) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "quality": [g[0] for g in got], "toxicity": [g[1] for g in got], "keep": [g[2] for g in got]}

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), batch, "doc_id long, " + _JUDGED)


def keep_good(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The rows whose text the classifier keeps, with all their columns; no join, so repeated ids do no harm."""
    sent = docs.sparkSession.sparkContext.broadcast((train(docs), train_toxic(docs, labels)))

    @F.pandas_udf("boolean")
    def kept(text: pd.Series) -> pd.Series:
        return text.map(lambda t: _judge(t, *sent.value)[2]).astype(bool)

    return docs.where(kept(F.col("text").cast("string")))


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """The labels table, or None where there is none."""
    try:
        return common.table(spark, sf_dir, "labels")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return classify(docs, train(docs), train_toxic(docs, labels_of(spark, sf_dir)))
