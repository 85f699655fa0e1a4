"""Weighted draws without replacement from vocabularies of any size.

Each item arrives at an entity after an exponential time, the sooner the greater its
weight; the first ones are the entity's. The heaviest items race one by one. All others
arrive together, as one stream with the sum of their weights as its rate, each arrival
being an item by weight: that is the same race, so an entity draws some more arrivals
than it needs items, and none of the vocabulary is put in order for it. An arrival is
looked up by equality on a bucket: weights are laid end to end and cut into as many
buckets as there are items, so a bucket holds one or two of them.

What arrived by the last drawn arrival is known; an entity that has too few different
items by then draws twice as many arrivals, of which the first are those before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..sources.tables import settle

HEAVY, SPARE, GROUPS = 64, 16, 1024


def _fine(key: Column, seed: str) -> Column:
    """A number in (0, 1) of 52 bits: weights of rare items are finer than what 32 bits tell apart."""
    digest = F.md5(F.concat(key, F.lit(f":{seed}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def _laid_out(light: DataFrame) -> DataFrame:
    """bucket, lo, hi, i, rate: where each item lies between 0 and 1, in each bucket that it touches."""
    x = light.withColumn("g", F.pmod(F.xxhash64("i"), F.lit(GROUPS)))
    sums = x.groupBy("g").agg(F.sum("w").alias("s"), F.count("*").alias("n"))  # GROUPS rows
    before, whole = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    sums = sums.select("g", F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("from"), F.sum("s").over(whole).alias("rate"), F.sum("n").over(whole).alias("all"))
    x = x.join(F.broadcast(sums), "g").withColumn("hi", F.col("from") + F.sum("w").over(Window.partitionBy("g").orderBy("i")))
    x = x.select("i", "rate", "all", ((F.col("hi") - F.col("w")) / F.col("rate")).alias("lo"), (F.col("hi") / F.col("rate")).alias("hi"))
    at = lambda c: F.least(F.greatest(F.floor(F.col(c) * F.col("all")), F.lit(0)), F.col("all") - 1)
    return x.select("i", "lo", "hi", F.explode(F.sequence(at("lo"), at("hi"))).alias("bucket"))


def draw_items(entities: DataFrame, key: str, items: DataFrame, item: str, weight: str, seed: str) -> DataFrame:
    """entities: key, __n -> key, item, share: __n different items of each (all, if there are fewer), by weight; shares add up to 1."""
    words = settle(items.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("i")).agg(F.greatest(F.max(F.col(weight).cast("double")), F.lit(1e-12)).alias("w")))
    heavy = words.orderBy(F.desc("w"), "i").limit(HEAVY).agg(F.collect_list(F.struct("i", "w")).alias("heavy"))  # HEAVY items
    light = words.crossJoin(F.broadcast(heavy)).where(~F.array_contains(F.col("heavy.i"), F.col("i"))).select("i", "w")  # one row
    facts = light.agg(F.sum("w").alias("rate"), F.count("*").alias("lights")).first()  # one row
    lights, rate = facts["lights"], facts["rate"] or 0.0
    table = settle(_laid_out(light))
    name = F.col(key).cast("string")
    mine = lambda what: F.concat_ws(":", name, what.cast("string"))
    own = F.transform("heavy", lambda x: F.struct((-F.log(_fine(mine(x["i"]), seed + "h")) / x["w"]).alias("t"), x["i"].alias("i")))
    todo = settle(entities.crossJoin(F.broadcast(heavy)).select(key, F.least("__n", F.size("heavy") + F.lit(lights)).cast("int").alias("__n"), F.slice(F.array_sort(own), F.lit(1), F.col("__n")).alias("own")))
    out, factor = None, 2
    while True:
        arrivals = F.sequence(F.lit(1), F.col("__n") * factor + SPARE)
        x = todo.select(key, "__n", F.explode(arrivals if lights else F.array().cast("array<int>")).alias("k"))
        x = x.select(key, "__n", (-F.log(_fine(mine(F.col("k")), seed + "t")) / rate if rate else F.lit(None).cast("double")).alias("step"), _fine(mine(F.col("k")), seed + "w").alias("u"), "k")
        x = x.withColumn("t", F.sum("step").over(Window.partitionBy(key).orderBy("k"))).withColumn("bucket", F.least(F.floor(F.col("u") * lights), F.lit(max(lights - 1, 0))))
        met = x.alias("x").join(table.alias("b"), "bucket").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select(key, "i", "t")
        last = x.groupBy(key).agg(F.max("t").alias("last"))
        every = met.unionByName(todo.select(key, F.explode("own").alias("o")).select(key, F.col("o.i").alias("i"), F.col("o.t").alias("t")))
        first = every.groupBy(key, "i").agg(F.min("t").alias("t"))
        ranked = first.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("t", "i"))).join(todo.select(key, "__n"), key).where("r <= __n").join(last, key, "left")
        ranked = settle(ranked)
        # known is what came before the last arrival; with no other items than the heavy ones, all is
        known = ranked.groupBy(key).agg(F.count("*").alias("have"), F.max("t").alias("until"), F.max("__n").alias("n"), F.max("last").alias("last"))
        good = known.where((F.col("have") == F.col("n")) & (F.col("last").isNull() | (F.col("until") <= F.col("last")))).select(key)
        done = ranked.join(good, key, "left_semi").select(key, "i")
        out = done if out is None else out.unionByName(done)
        todo = settle(todo.join(good, key, "left_anti"))
        if todo.isEmpty():
            break
        factor *= 2
    g = out.withColumn("g", -F.log(_fine(mine(F.col("i")), seed + "s")))
    return g.select(key, F.col("i").alias(item), S.ratio(F.col("g"), F.sum("g").over(Window.partitionBy(key))).alias("share"))
