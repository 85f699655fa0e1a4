"""License scans: an exact set-similarity join of text blocks with templates, DataFrame operations only.

Texts are cut in words (ASCII lower-cased). A text block is WINDOW words, one
beginning every WINDOW / 2, so every run of up to WINDOW / 2 words lies whole in
a block. A block meets a template if it holds THRESHOLD of the template's
distinct words. The join:

* tokens are ordered by their frequency over all documents, rarest first;
* length filter: a block with fewer template words than the overlap asked for goes;
* prefix filter: only the first |B| - need + 1 tokens of a block and the first
  |T| - need + 1 of a template can make the pair, so the join is on those;
* positional filter: what still follows the shared token on both sides must
  suffice;
* what is left is verified by the exact overlap.

Only words that some template has are kept of a block, since no others count.
Documents that don't hold enough of any template's words as a whole skip all this.

Besides, the places where a base phrase's words stand one after the other are
counted. Templates may be a table; it is read whole, up to MOST_TEMPLATES of them.
Defined results: a null or empty text has no words and no labels, first
and last word null, score 0; rows that repeat, or have a null doc_id, give rows
of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, THRESHOLD = 48, 0.8
#: Templates that a table may have; up to so many, documents are sifted template by template.
MOST_TEMPLATES, FEW_TEMPLATES = 2000, 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: Phrases that count by themselves, with their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Templates of the method: wording of public licenses, with their labels.
TEMPLATES = (
    *BASE,
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("mozilla public license version 2", "mpl-2"),
)


def _need(n: int) -> int:
    """Words that make up THRESHOLD of n, in whole numbers."""
    return -(-n * round(THRESHOLD * 100) // 100)


def text_words(col: str = "text") -> Column:
    text = common.whole_text(col)
    lower = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def _lits(words) -> Column:
    return F.array(*(F.lit(w) for w in words))


def _places(words: Column, phrase: list[str]) -> Column:
    """Starts of the phrase, counted in words from 0."""
    k = len(phrase)

    def here(i: Column) -> Column:
        same = F.get(words, i) == phrase[0]
        for j in range(1, k):
            same = same & (F.get(words, i + j) == phrase[j])
        return same

    return F.when(F.size(words) >= k, F.filter(F.sequence(F.lit(0), F.size(words) - k), here)).otherwise(F.array().cast("array<int>"))


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))


def scan(docs: DataFrame, templates=TEMPLATES, base=BASE) -> DataFrame:
    """docs: doc_id, text -> doc_id, n_words, places array<struct<start,label>>, matches array<struct<label,score>>.

    templates: pairs of text and label (words in lower case, apart by blanks), or a
    DataFrame with columns text and label, cut in words as documents are; a template
    without words matches nothing.
    """
    spark = docs.sparkSession
    if isinstance(templates, DataFrame):
        got = templates.where("label is not null").select(F.array_join(text_words(), " ").alias("text"), "label").distinct().limit(MOST_TEMPLATES + 1).collect()
        if len(got) > MOST_TEMPLATES:
            raise ValueError(f"more than {MOST_TEMPLATES} templates")
        templates = (*base, *((r["text"], r["label"]) for r in sorted(got)))
    split = [(sorted(set(t.split())), label) for t, label in templates if t.split()]
    vocabulary = sorted({w for ws, _ in split for w in ws})
    least = min(_need(len(ws)) for ws, _ in split)
    enough = F.size("hits") >= least
    if len(split) <= FEW_TEMPLATES:
        enough = F.lit(False)
        for ws, _ in split:
            enough = enough | (F.size(F.array_intersect("hits", _lits(ws))) >= _need(len(ws)))
    for phrase in {frozenset(p.split()) for p, _ in base} - {frozenset(ws) for ws, _ in split}:  # base phrases that no template stands for
        enough = enough | (F.size(F.array_intersect("words", _lits(sorted(phrase)))) == len(phrase))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_words().alias("words"))
    hit = read.select("doc_id", "words", F.array_intersect("words", _lits(vocabulary)).alias("hits"))
    # one pass over the texts; the words stay only of documents that can hold a template
    seen = common.settle(hit.select("doc_id", F.monotonically_increasing_id().alias("row"), F.size("words").cast("long").alias("n_words"), "hits", F.when(enough, F.col("words")).alias("words")))
    frequency = {r["token"]: r["n"] for r in seen.select(F.explode("hits").alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}  # a row for each word of the templates
    order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    ranks = F.create_map(*(x for w in order for x in (F.lit(w), F.lit(rank[w]))))

    able = seen.where("words is not null").select("row", "words")
    half = WINDOW // 2
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(half))
    blocks = able.select("row", F.posexplode(F.transform(starts, lambda i: F.array_intersect(F.slice("words", i + 1, F.lit(WINDOW)), _lits(vocabulary)))).alias("block", "tokens"))
    blocks = blocks.where(F.size("tokens") >= least).select("row", "block", F.array_sort(F.transform("tokens", lambda t: F.element_at(ranks, t))).alias("tokens"))
    prefixes = blocks.select("row", "block", "tokens", F.posexplode(F.slice("tokens", F.lit(1), F.size("tokens") - least + 1)).alias("at", "token"))
    sides = []
    for k, (ws, label) in enumerate(split):
        own = sorted(rank[w] for w in ws)
        need = _need(len(own))
        sides += [(own[j], k, label, own, j, need) for j in range(len(own) - need + 1)]
    side = spark.createDataFrame(sides, "token int, template int, label string, own array<int>, pos int, need int")
    met = prefixes.join(F.broadcast(side), "token")  # the templates: a constant of this module
    met = met.where((F.size("tokens") >= F.col("need")) & (1 + F.least(F.size("tokens") - 1 - F.col("at"), F.size("own") - 1 - F.col("pos")) >= F.col("need")))
    overlap = F.size(F.array_intersect("tokens", "own"))
    met = met.where(overlap >= F.col("need")).select("row", "label", (overlap / F.size("own")).alias("score"))
    matches = met.groupBy("row", "label").agg(F.max("score").alias("score")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("label", "score"))).alias("matches"))

    found = F.array().cast("array<struct<start:int,label:string>>")
    for phrase, label in base:
        found = F.concat(found, _labelled(_places(F.col("words"), phrase.split()), label))
    # a document with a base phrase holds all of that template's words, so its words were kept
    placed = seen.select("row", "doc_id", "n_words", F.when(F.col("words").isNotNull(), F.array_sort(found)).alias("places"))
    return placed.join(matches, "row", "left").select("doc_id", "n_words", F.coalesce("places", F.array().cast("array<struct<start:int,label:string>>")).alias("places"), F.coalesce("matches", F.array().cast("array<struct<label:string,score:double>>")).alias("matches"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    labels = F.array_sort(F.array_distinct(F.concat(F.col("places.label"), F.col("matches.label"))))
    score = F.greatest(F.coalesce(F.array_max(F.col("matches.score")), F.lit(0.0)), F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(F.col("places.start")).cast("long").alias("first_word"), F.array_max(F.col("places.start")).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.round(score, 6).alias("score"),
    )


def _sql() -> str:
    q = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    base = ", ".join(f"({q(p.split())}, '{label}')" for p, label in BASE)
    templates = ", ".join(f"({q(sorted(set(t.split())))}, '{label}', {_need(len(set(t.split())))})" for t, label in TEMPLATES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b(p, label) AS (VALUES {base}), t(ws, label, need) AS (VALUES {templates}),
every_word AS (SELECT r, w, unnest(range(0, len(w))) AS i FROM d),
places AS (SELECT r, i, label FROM every_word, b WHERE list_slice(w, i + 1, i + len(p)) = p),
base AS (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi FROM places GROUP BY r),
blocks AS (SELECT r, list_slice(w, i + 1, i + {WINDOW}) AS blk FROM (SELECT r, w, unnest(range(0, len(w), {WINDOW // 2})) AS i FROM d)),
met AS (SELECT r, label, len(list_intersect(ws, blk)) AS n, len(ws) AS m FROM blocks, t WHERE len(list_intersect(ws, blk)) >= need),
best AS (SELECT r, max(n / m) AS s FROM met GROUP BY r),
bl AS (SELECT r, string_agg(label, ',' ORDER BY label) AS l FROM (SELECT DISTINCT r, label FROM places) GROUP BY r),
al AS (SELECT r, string_agg(label, ',' ORDER BY label) AS l FROM (SELECT r, label FROM places UNION SELECT r, label FROM met) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(bl.l, '') AS base_labels, coalesce(al.l, '') AS labels,
  round(greatest(coalesce(best.s, 0.0), CASE WHEN base.n > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN best USING (r) LEFT JOIN bl USING (r) LEFT JOIN al USING (r)"""


OP7_SQL = _sql()
