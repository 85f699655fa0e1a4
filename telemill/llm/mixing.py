"""Mixing sources to target weights, by blocks, with DataFrame operations only.

Each source's documents (by doc_id) are laid end to end and cut in blocks of
BLOCK words; only indices move, never texts. A source's target words are so many
passes over all its blocks, then part of one more pass, whose last slot takes
only the first words of its block.

Output shards have SHARD_SLOTS slots. For each, source counts are drawn
multinomially: every slot of the shard draws its source by the targets. Running
sums of a source's counts over the shards number its slots, up to the slots that
its target has; what the drawn shards leave (DRAWN of all slots are drawn) fills
the last shards, so the words taken equal the rounded target. A source's slot
number gives pass and place, and place j of a pass takes block perm(j): a
swap-or-not shuffle keyed by source and pass, which is a permutation of any
number of blocks, so no block comes twice in a pass. Slots then join the blocks
by (source, block).

The block shorter than BLOCK that may end a source has the last place in every
pass, outside the permutation.

Defined results: a null or wordless text has size 0 and is never taken; a null
source is one source, last in the order of weights; a source without words has
target 0; repeated rows are documents of their own, in stages as well; a null
doc_id comes first in its source; with no words at all every target is 0; an
empty table gives no rows; other columns, whatever their names, pass through
stages as they are. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Words of a block; slots of an output shard; neighbouring shards of a group of the running sums.
BLOCK, SHARD_SLOTS, GROUP_SHARDS = 128, 4096, 1024
WEIGHTS, MAX_REPEATS, SEED = (5, 2, 1), 3, 31
#: Share of the slots that are drawn; rounds of the permutation; cells of the table that draws look sources up in.
DRAWN, ROUNDS, CELLS = 0.9, 6, 4096
#: Sources sent whole to the tasks; more are joined by shuffles.
FEW_SOURCES = 10_000


def words(col: str = "text") -> Column:
    return F.regexp_count(common.whole_text(col), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """sizes: source, source_size -> with target. One row a source, so the one window over them is small.

    Shares by weight, stopped at MAX_REPEATS times the size, the excess shared again:
    with sources in rising order of cap / weight, those before some place are capped
    and the rest share what is left by weight.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.pmod(F.row_number().over(by_source) - 1, F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), at.cast("int") + 1)
    whole = Window.partitionBy(F.lit(1))
    rising = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    upto = rising.rowsBetween(Window.unboundedPreceding, -1)
    x = sizes.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * MAX_REPEATS).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    x = x.withColumn("all", F.sum("source_size").over(whole).cast("double")).withColumn("all_weight", F.sum("weight").over(whole))
    # what a unit of weight gets if all before this one are capped; the first that stays below its cap sets the level
    x = x.withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))))
    x = x.withColumn("level", F.coalesce(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"], F.lit(float("inf"))))
    return x.select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _large(df: DataFrame) -> DataFrame:
    """Unfolding a few sources into many slots leaves the planner's estimate at a few rows; this side must not be broadcast on it."""
    return df.hint("merge")


def _few(df: DataFrame, sources: int) -> DataFrame:
    return F.broadcast(df) if sources <= FEW_SOURCES else df


def mix_plan(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs: doc_id, text, source -> (documents, sources, slots).

    documents: doc_id, source, size, key, begin (its first word's place in the source)
    sources: source, source_size, target
    slots: shard, source, pass, block, n_words (of the block, from its first word)
    """
    size = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words().alias("size"), F.xxhash64(common.whole_text()).alias("key"))
    # neighbours share a partition, whatever the ids are; a source goes over as many as it fills, so no running sum needs it in one task
    size = common.settle(common.settle(size).repartitionByRange("source", "doc_id", "key").withColumn("part", F.spark_partition_id()))
    sums = size.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("part_begin", F.coalesce(F.sum("part_size").over(before), F.lit(0))).drop("part_size")
    run = Window.partitionBy("source", "part").orderBy("doc_id", "key", "size").rowsBetween(Window.unboundedPreceding, 0)
    inner = size.withColumn("inner", F.sum("size").over(run) - F.col("size"))
    documents = inner.alias("i").join(sums.alias("s"), _same(F.col("i.source"), F.col("s.source")) & (F.col("i.part") == F.col("s.part"))).select("i.doc_id", "i.source", "size", "key", (F.col("part_begin") + F.col("inner")).alias("begin"))
    sources = common.settle(targets(size.groupBy("source").agg(F.sum("size").alias("source_size"))))
    return documents, sources, slots(sources)


def shard_counts(sources: DataFrame, few: int, slots_: int) -> DataFrame:
    """sources: source, n_slots -> shard, source, count: the multinomial draws of the drawn shards. slots_: all slots there are."""
    shards = int(DRAWN * slots_) // SHARD_SLOTS
    upto = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    s = sources.withColumn("high", F.sum("n_slots").over(upto) / float(slots_)).withColumn("low", F.col("high") - F.col("n_slots") / float(slots_))
    cell = lambda c: F.floor(F.least(c, F.lit(1 - 1e-12)) * CELLS).cast("int")
    cells = s.select(F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"), F.struct("low", "source").alias("of")).groupBy("cell").agg(F.array_sort(F.collect_list("of")).alias("of"))
    spark = sources.sparkSession
    drawn = spark.range(shards).withColumnRenamed("id", "shard").repartition("shard").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(SHARD_SLOTS - 1))))
    drawn = drawn.withColumn("u", F.pmod(F.xxhash64("shard", "i", F.lit(SEED)), F.lit(1 << 40)) / float(1 << 40)).withColumn("cell", cell(F.col("u")))
    # of the sources that begin in the cell or before it, the last that begins at u or below
    got = drawn.join(_few(cells, few), "cell").select("shard", F.element_at(F.filter("of", lambda x: (x["low"] <= F.col("u")) | (x["low"] == F.col("of")[0]["low"])), -1)["source"].alias("source"))
    return got.groupBy("shard", "source").agg(F.count("*").alias("count"))


def permuted(place: Column, ring: Column, *key: Column | str) -> Column:
    """place -> one of 0..ring-1, a permutation for each key: in each round a place and its partner K - place change or stay by one bit of both."""

    def turn(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*key, r, F.lit(SEED)), ring) - x, ring)
        return F.when(F.xxhash64(*key, r, F.greatest(x, partner)) % 2 == 0, x).otherwise(partner)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), place.cast("long"), turn)


def slots(sources: DataFrame) -> DataFrame:
    s = sources.where("source_size > 0").withColumn("take", F.round("target").cast("long"))
    s = s.withColumn("full", F.floor(F.col("source_size") / BLOCK)).withColumn("per_pass", F.ceil(F.col("source_size") / BLOCK))
    s = s.withColumn("passes", F.floor(F.col("take") / F.col("source_size"))).withColumn("rest", F.col("take") % F.col("source_size"))
    s = common.settle(s.withColumn("n_slots", F.col("passes") * F.col("per_pass") + F.ceil(F.col("rest") / BLOCK)).where("n_slots > 0"))
    few, total = s.agg(F.count("*"), F.coalesce(F.sum("n_slots"), F.lit(0))).first()
    counts = common.settle(shard_counts(s.select("source", "n_slots"), few, max(total, 1)))
    # running sums over the shards, over groups of shards first
    grouped = counts.withColumn("grp", F.floor(F.col("shard") / GROUP_SHARDS))
    groups = grouped.groupBy("source", "grp").agg(F.sum("count").alias("n"))
    before = Window.partitionBy("source").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("grp_first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    run = Window.partitionBy("source", "grp").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    numbered = grouped.withColumn("inner", F.sum("count").over(run) - F.col("count")).alias("c").join(groups.alias("g"), _same(F.col("c.source"), F.col("g.source")) & (F.col("c.grp") == F.col("g.grp")))
    numbered = numbered.select("c.shard", "c.source", (F.col("grp_first") + F.col("inner")).alias("first"), "count")
    facts = s.select(F.col("source").alias("of"), "n_slots", "per_pass", "full", "passes", "source_size", "rest")
    drawn = numbered.join(_few(facts, few), _same(F.col("source"), F.col("of"))).drop("of")
    drawn = drawn.withColumn("count", F.least(F.col("count"), F.col("n_slots") - F.col("first"))).where("count > 0")
    # what the draws leave of each source, in stretches that fall on the last shards
    had = counts.groupBy("source").agg(F.sum("count").alias("had"))
    left = facts.join(_few(had, few), _same(F.col("of"), F.col("source")), "left").select(F.col("of").alias("source"), F.least(F.coalesce("had", F.lit(0)), F.col("n_slots")).alias("from"), "n_slots", "per_pass", "full", "passes", "source_size", "rest").where(F.col("from") < F.col("n_slots"))
    last = max(1, -(-(total - int(DRAWN * total) // SHARD_SLOTS * SHARD_SLOTS) // SHARD_SLOTS))
    stretch = 64
    left = left.withColumn("first", F.explode(F.sequence("from", F.col("n_slots") - 1, F.lit(stretch).cast("long")))).withColumn("count", F.least(F.lit(stretch), F.col("n_slots") - F.col("first")))
    left = left.withColumn("shard", F.lit(int(DRAWN * total) // SHARD_SLOTS) + F.pmod(F.xxhash64("source", "first", F.lit(SEED)), F.lit(last)))
    p = drawn.unionByName(left.drop("from")).repartition("source", "first").withColumn("slot", F.explode(F.sequence("first", F.col("first") + F.col("count") - 1)))
    p = p.withColumn("pass", F.least(F.floor(F.col("slot") / F.col("per_pass")), F.col("passes"))).withColumn("place", F.col("slot") - F.col("pass") * F.col("per_pass"))
    in_pass = F.when(F.col("pass") < F.col("passes"), F.col("source_size")).otherwise(F.col("rest"))
    block = F.when(F.col("place") < F.col("full"), permuted(F.col("place"), F.greatest(F.col("full"), F.lit(1)), "source", "pass")).otherwise(F.col("full"))
    return p.select("shard", "source", "pass", block.alias("block"), F.least(F.lit(BLOCK), in_pass - F.col("place") * BLOCK).alias("n_words"))


def _met(documents: DataFrame, slots_: DataFrame, what: Column) -> DataFrame:
    """documents' stretches in blocks, joined with the slots that take the blocks (takes: a list of what, at most MAX_REPEATS + 1)."""
    used = _large(slots_.groupBy("source", "block").agg(F.collect_list(what).alias("takes")))
    spread = documents.where("size > 0").select("doc_id", "source", "key", "begin", "size", F.explode(F.sequence(F.floor(F.col("begin") / BLOCK), F.floor((F.col("begin") + F.col("size") - 1) / BLOCK))).alias("block"))
    return spread.alias("d").join(used.alias("u"), _same(F.col("d.source"), F.col("u.source")) & (F.col("d.block") == F.col("u.block"))).select("d.*", "takes")


def taken_words(documents: DataFrame, slots_: DataFrame) -> DataFrame:
    """source, begin, taken, n_shards: the words that the slots take of each document that they reach, and the output shards that get some."""
    j = _met(documents, slots_, F.struct("n_words", "shard"))
    lo = F.greatest(F.col("begin") - F.col("block") * BLOCK, F.lit(0))
    hi = F.least(F.col("begin") + F.col("size") - F.col("block") * BLOCK, F.lit(BLOCK))
    got = F.aggregate("takes", F.lit(0).cast("long"), lambda acc, t: acc + F.greatest(F.least(hi, t["n_words"]) - lo, F.lit(0)))
    shards = F.transform(F.filter("takes", lambda t: t["n_words"] > lo), lambda t: t["shard"])
    return j.groupBy("source", "begin").agg(F.sum(got).alias("taken"), F.size(F.array_distinct(F.flatten(F.collect_list(shards)))).cast("long").alias("n_shards"))


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, source, key, size, source_size, target, taken, n_shards: a row for each row of docs."""
    documents, sources, slots_ = mix_plan(docs)
    taken = _large(taken_words(documents, slots_))
    j = documents.alias("d").join(taken.alias("t"), _same(F.col("d.source"), F.col("t.source")) & (F.col("d.begin") == F.col("t.begin")) & (F.col("d.size") > 0), "left")
    none = F.lit(0).cast("long")
    j = j.select("d.doc_id", "d.source", "d.key", "d.size", F.coalesce("t.taken", none).alias("taken"), F.coalesce("t.n_shards", none).alias("n_shards"))
    return j.alias("j").join(_few(sources, sources.count()).alias("s"), _same(F.col("j.source"), F.col("s.source"))).select("doc_id", "j.source", "key", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), "taken", "n_shards")


def _numbered_copies(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """rows: row, id, of, key, with copy: 1, 2, ... among rows that agree in id, source and text."""
    again = common.settle(documents.groupBy(F.col("doc_id").alias("a_id"), F.col("source").alias("a_of"), F.col("key").alias("a_key")).count().where("count > 1"))
    if not again.head(1):
        return rows.withColumn("copy", F.lit(1))
    is_one = (F.col("key") == F.col("a_key")) & _same(F.col("id"), F.col("a_id")) & _same(F.col("of"), F.col("a_of"))
    copies = rows.join(again, is_one, "left_semi").withColumn("copy", F.row_number().over(Window.partitionBy("id", "of", "key").orderBy(F.lit(0))))
    return rows.join(again, is_one, "left_anti").withColumn("copy", F.lit(1)).unionByName(copies)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs as the mix has them: all columns, text and n_chars (if there) those of the words taken.

    A document taken whole in a pass gives its text, one taken in part the words of
    its slots' blocks, in order; passes follow each other on lines of their own. A
    document of which nothing is taken goes. Rows that repeat are documents of
    their own.
    """
    documents, _, slots_ = mix_plan(docs)
    j = _met(documents, slots_, F.struct("pass", "n_words")).withColumn("take", F.explode("takes"))
    base = F.col("block") * BLOCK
    lo, hi = F.greatest(F.col("begin") - base, F.lit(0)), F.least(F.col("begin") + F.col("size") - base, F.col("take.n_words"))
    pieces = j.where(hi > lo).select("doc_id", "source", "key", "begin", "size", F.col("take.pass").alias("pass"), (base + lo - F.col("begin")).cast("int").alias("at"), (hi - lo).cast("int").alias("n"))
    whole = F.sum("n") == F.col("size")
    passes = pieces.groupBy("doc_id", "source", "key", "begin", "size", "pass").agg(whole.alias("whole"), F.array_sort(F.collect_list(F.struct("at", "n"))).alias("pieces"))
    passes = passes.withColumn("pieces", F.when(F.col("whole"), F.array().cast("array<struct<at:int,n:int>>")).otherwise(F.col("pieces")))
    taken = passes.groupBy("doc_id", "source", "key", "begin").agg(F.array_sort(F.collect_list(F.struct("pass", "whole", "pieces"))).alias("passes"))
    taken = taken.withColumn("t_copy", F.row_number().over(Window.partitionBy("doc_id", "source", "key").orderBy("begin"))).select(F.col("doc_id").alias("t_id"), F.col("source").alias("t_of"), F.col("key").alias("t_key"), "t_copy", "passes")
    # a row of docs travels as one struct, so its columns may have any names
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("of"), F.xxhash64(common.whole_text()).alias("key"))
    rows = _numbered_copies(rows, documents)
    got = rows.join(_large(taken), (F.col("key") == F.col("t_key")) & (F.col("copy") == F.col("t_copy")) & _same(F.col("id"), F.col("t_id")) & _same(F.col("of"), F.col("t_of")))
    text = F.col("row")["text"]
    got = got.withColumn("words", F.when(F.exists("passes", lambda p: ~p["whole"]), F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))))
    new = F.array_join(F.transform("passes", lambda p: F.when(p["whole"], text).otherwise(F.array_join(F.transform(p["pieces"], lambda x: F.array_join(F.slice("words", x["at"] + 1, x["n"]), " ")), " "))), "\n")
    got = got.select("row", new.alias("new"))
    made = {"text": F.col("new"), "n_chars": F.length("new")}
    return got.select(*(made[f.name].cast(f.dataType).alias(f.name) if f.name in made else F.col("row")[f.name].alias(f.name) for f in docs.schema))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "n_shards")
