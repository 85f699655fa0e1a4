"""The registered queries over the driver's tables, each with the SQL that must give the same rows.

The tables stand in for telemetry: customer for devices, events for waits and
web use, lineitem for weighted samples, orders for battery sessions, part for
applications. Each query applies the library's operators as they would be
applied to reporting tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..operators import evaluate as E
from ..operators import postprocess as P
from ..operators import synthesis as Y
from ..operators import wide as W
from ..operators.ranges import join_periods

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def ranked(df: DataFrame, by: str, partition: list[str], k: int) -> DataFrame:
    """rank <= k by a measure, descending, ties sharing ranks, within the partition columns."""
    w = (Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))).orderBy(F.desc(by))
    return df.withColumn("rank", F.rank().over(w).cast("long")).where(F.col("rank") <= k)


def top_with_ties(df: DataFrame, by: str, k: int) -> DataFrame:
    """A global rank without one task holding all rows: only what reaches the k-th measure is ranked."""
    bound = df.select(by).orderBy(F.desc(by)).limit(k).agg(F.min(by).alias("__bound"))
    return ranked(df.crossJoin(F.broadcast(bound)).where(F.col(by) >= F.col("__bound")).drop("__bound"), by, [], k)  # the bound is one row


# --- weighted means and joins ---------------------------------------------------------------


@query("""
SELECT c_mktsegment, count(DISTINCT c_custkey)::BIGINT AS n_customers, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS avg_price
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment ORDER BY avg_price DESC""")
def weighted_mean_by_segment(spark, d):
    # a row for each order before the joins: fewer rows to shuffle
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity") * F.col("l_extendedprice")).alias("wx"), F.sum("l_quantity").alias("w"))
    j = lines.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_mktsegment").agg(F.count_distinct("c_custkey").alias("n_customers"), F.round(S.ratio(F.sum("wx"), F.sum("w")), 4).alias("avg_price")).orderBy(F.desc("avg_price"))


@query("""
WITH e AS (SELECT user_id, count(*) AS n, avg(value) AS v FROM events GROUP BY 1), o AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS v FROM orders GROUP BY 1),
l AS (SELECT o_custkey, sum(l_quantity) AS n, sum(l_quantity * l_discount) / sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_mktsegment, count(*)::BIGINT AS n_systems, round(sum(e.n * e.v) / sum(e.n), 4) AS avg_event, round(sum(o.n * o.v) / sum(o.n), 4) AS avg_order, round(sum(l.n * l.v) / sum(l.n), 6) AS avg_discount
FROM customer JOIN e ON c_custkey = e.user_id JOIN o ON c_custkey = o.o_custkey JOIN l ON c_custkey = l.o_custkey GROUP BY 1""")
def multi_metric_join_by_segment(spark, d):
    """Metrics are brought to one row a device before they meet, so no join fans out."""
    orders = table(spark, d, "orders")
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("value").alias("en"), F.avg("value").alias("ev"))
    o = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("on"), F.avg("o_totalprice").alias("ov"))
    lines = table(spark, d, "lineitem").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    li = lines.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("l_quantity").alias("ln"), S.wavg("l_quantity", "l_discount").alias("lv"))
    j = table(spark, d, "customer").join(e, "c_custkey").join(o, "c_custkey").join(li, "c_custkey")
    return j.groupBy("c_mktsegment").agg(F.count("*").alias("n_systems"), F.round(S.wavg("en", "ev"), 4).alias("avg_event"), F.round(S.wavg("on", "ov"), 4).alias("avg_order"), F.round(S.wavg("ln", "lv"), 6).alias("avg_discount"))


@query("""
WITH f AS (SELECT o_custkey AS guid, sum(l_quantity) AS nrs, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity * l_extendedprice * 5 ELSE 0 END) AS received, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity * l_extendedprice * 5 ELSE 0 END) AS sent
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 HAVING sum(l_quantity) > 720)
SELECT guid, round(nrs, 2) AS nrs, round(received, 2) AS received_bytes, round(sent, 2) AS sent_bytes, c_mktsegment AS segment FROM f JOIN customer ON guid = c_custkey WHERE sent > received ORDER BY sent - received DESC""")
def asymmetric_flow_rows(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    flow = F.col("l_quantity") * F.col("l_extendedprice") * 5
    f = j.groupBy(F.col("o_custkey").alias("guid")).agg(F.sum("l_quantity").alias("nrs"), S.sum_if(F.col("l_returnflag") == "R", flow).alias("received"), S.sum_if(F.col("l_returnflag") == "A", flow).alias("sent"))
    f = f.where("nrs > 720 and sent > received").join(table(spark, d, "customer"), F.col("guid") == F.col("c_custkey"))
    return f.orderBy(F.desc(F.col("sent") - F.col("received"))).select("guid", F.round("nrs", 2).alias("nrs"), F.round("received", 2).alias("received_bytes"), F.round("sent", 2).alias("sent_bytes"), F.col("c_mktsegment").alias("segment"))


@query("""
WITH u AS (SELECT user_id, sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) AS a, sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) AS b FROM events GROUP BY 1)
SELECT CASE WHEN n_name LIKE '%IN%' OR n_name ILIKE '%an%' THEN 'Server Class' ELSE 'Non-Server Class' END AS processor_class, c_mktsegment AS os, count(*)::BIGINT AS number_of_systems, round(avg(a), 4) AS avg_received, round(avg(b), 4) AS avg_sent
FROM u JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def class_by_pattern_traffic(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(S.sum_if(F.col("event_type") == "view", "value").alias("a"), S.sum_if(F.col("event_type") == "click", "value").alias("b"))
    j = u.join(table(spark, d, "customer"), F.col("user_id") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    kind = F.when(F.col("n_name").like("%IN%") | F.col("n_name").ilike("%an%"), "Server Class").otherwise("Non-Server Class")
    return j.groupBy(kind.alias("processor_class"), F.col("c_mktsegment").alias("os")).agg(F.count("*").alias("number_of_systems"), F.round(F.avg("a"), 4).alias("avg_received"), F.round(F.avg("b"), 4).alias("avg_sent"))


@query("""
SELECT country, category FROM (SELECT n_name AS country, event_type AS category, rank() OVER (PARTITION BY n_name ORDER BY count(DISTINCT user_id) DESC) AS r
  FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) WHERE r = 1 ORDER BY country, category""")
def top_category_per_nation(spark, d):
    j = table(spark, d, "events").select("user_id", "event_type").distinct().join(table(spark, d, "customer"), F.col("user_id") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    n = j.groupBy(F.col("n_name").alias("country"), F.col("event_type").alias("category")).agg(F.count_distinct("user_id").alias("n"))
    return ranked(n, "n", ["country"], 1).select("country", "category").orderBy("country", "category")


@query("""
SELECT event_type, round(100.0 * count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events), 2) AS percent_systems, round(100.0 * count(*) / (SELECT count(*) FROM events), 2) AS percent_instances,
 round(100.0 * sum(value) / (SELECT sum(value) FROM events), 2) AS percent_duration FROM events GROUP BY 1""")
def category_share_percentages(spark, d):
    e = table(spark, d, "events")
    whole = e.agg(F.count_distinct("user_id").alias("u"), F.count("*").alias("n"), F.sum("value").alias("v"))
    part = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("pu"), F.count("*").alias("pn"), F.sum("value").alias("pv"))
    j = part.crossJoin(F.broadcast(whole))  # one row of totals
    return j.select("event_type", S.percent(F.col("pu"), F.col("u")).alias("percent_systems"), S.percent(F.col("pn"), F.col("n")).alias("percent_instances"), S.percent(F.col("pv"), F.col("v")).alias("percent_duration"))


_TYPES = ("click", "error", "purchase", "signup", "view")


@query(f"""
SELECT c_mktsegment AS persona, count(DISTINCT user_id)::BIGINT AS number_of_systems, count(DISTINCT (user_id, CAST(ts AS DATE)))::BIGINT AS days,
 {", ".join(f"round(100 * sum(CASE WHEN event_type = '{t}' THEN value ELSE 0 END) / nullif(sum(value), 0), 3) AS {t}" for t in _TYPES)}
FROM events JOIN customer ON user_id = c_custkey GROUP BY 1""")
def conditional_pivot_percentages(spark, d):
    """A pivot by conditional sums, one pass, then each group's columns as parts of their sum."""
    day = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("dt")).agg(*(S.sum_if(F.col("event_type") == t, "value").alias(t) for t in _TYPES))
    j = day.join(table(spark, d, "customer"), F.col("user_id") == F.col("c_custkey"))
    g = j.groupBy(F.col("c_mktsegment").alias("persona")).agg(F.count_distinct("user_id").alias("number_of_systems"), F.count("*").alias("days"), *(F.sum(t).alias(t) for t in _TYPES))
    whole = S.total(F.col(t) for t in _TYPES)
    return g.select("persona", "number_of_systems", "days", *(F.round(100 * S.ratio(F.col(t), whole), 3).alias(t) for t in _TYPES))


@query("""
SELECT p_size AS capacity, count(DISTINCT p_partkey)::BIGINT AS n_systems, round(sum(l_quantity * l_discount * 100) / sum(l_quantity), 2) AS avg_percentage_used
FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_discount > 0 GROUP BY p_size ORDER BY p_size""")
def capacity_histogram(spark, d):
    used = table(spark, d, "lineitem").where("l_discount > 0").groupBy("l_partkey").agg(F.sum(F.col("l_quantity") * F.col("l_discount") * 100).alias("wx"), F.sum("l_quantity").alias("w"))
    j = used.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("p_size").alias("capacity")).agg(F.count("*").alias("n_systems"), F.round(S.ratio(F.sum("wx"), F.sum("w")), 2).alias("avg_percentage_used")).orderBy("capacity")


@query("""
SELECT n_name AS country, round(sum(o_totalprice * c_acctbal) / sum(c_acctbal), 4) AS avg_power, count(DISTINCT c_custkey)::BIGINT AS number_of_systems
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1 ORDER BY 2 DESC""")
def weighted_mean_by_country(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("n_name").alias("country")).agg(F.round(S.wavg("c_acctbal", "o_totalprice"), 4).alias("avg_power"), F.count_distinct("c_custkey").alias("number_of_systems")).orderBy(F.desc("avg_power"))


@query("""
WITH b AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS dt, count(*) AS n, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT n_name AS country, count(DISTINCT o_custkey)::BIGINT AS number_of_systems, round(avg(n), 4) AS avg_number_of_dc_powerons, round(avg(v), 2) AS avg_duration
FROM b JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(DISTINCT o_custkey) > 20 ORDER BY 3 DESC""")
def geo_summary_having(spark, d):
    b = table(spark, d, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("dt")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v"))
    j = b.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    g = j.groupBy(F.col("n_name").alias("country")).agg(F.count_distinct("o_custkey").alias("number_of_systems"), F.round(F.avg("n"), 4).alias("avg_number_of_dc_powerons"), F.round(F.avg("v"), 2).alias("avg_duration"))
    return g.where("number_of_systems > 20").orderBy(F.desc("avg_number_of_dc_powerons"))


@query("""
SELECT c_mktsegment, n_name, count(DISTINCT o_custkey)::BIGINT AS number_of_systems, round(avg(o_totalprice), 4) AS avg_duration
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2 HAVING count(DISTINCT o_custkey) > 5""")
def two_key_avg_having(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("c_mktsegment", "n_name").agg(F.count_distinct("o_custkey").alias("number_of_systems"), F.round(F.avg("o_totalprice"), 4).alias("avg_duration")).where("number_of_systems > 5")


@query("""
WITH o AS (SELECT l_orderkey, sum(l_quantity) AS a, sum(l_tax * 100) AS b, sum(l_discount * 100) AS c FROM lineitem GROUP BY 1),
g AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n, avg(a) AS a, avg(b) AS b, avg(c) AS c, avg(a + b + c) AS t FROM o JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT o_orderstatus, o_orderpriority, n::BIGINT AS number_of_systems, round(a, 2) AS avg_on, round(b, 2) AS avg_off, round(c, 2) AS avg_sleep, round(t, 2) AS avg_total, round(100 * a / t, 2) AS pct_on, round(100 * b / t, 2) AS pct_off, round(100 * c / t, 2) AS pct_sleep FROM g WHERE n > 100""")
def time_budget_ratio_of_avgs(spark, d):
    """Shares as ratios of averages, not averages of ratios."""
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("a"), F.sum(F.col("l_tax") * 100).alias("b"), F.sum(F.col("l_discount") * 100).alias("c"))
    j = o.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("t", F.col("a") + F.col("b") + F.col("c"))
    g = j.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("number_of_systems"), *(F.avg(x).alias(x) for x in "abct")).where("number_of_systems > 100")
    named = (("a", "on"), ("b", "off"), ("c", "sleep"), ("t", "total"))
    return g.select("o_orderstatus", "o_orderpriority", "number_of_systems", *(F.round(x, 2).alias(f"avg_{n}") for x, n in named), *(S.percent(F.col(x), F.col("t")).alias(f"pct_{n}") for x, n in named[:3]))


# --- range joins ----------------------------------------------------------------------------

_PERIODS = """p AS (SELECT o_custkey, o_orderpriority, o_orderstatus, CAST(o_orderdate AS DATE) + INTERVAL 9000 DAY AS lo, CAST(o_orderdate AS DATE) + INTERVAL 9400 DAY AS hi FROM orders),
j AS (SELECT e.*, p.o_orderpriority AS os_name, p.o_orderstatus AS os_codename FROM events e JOIN p ON e.user_id = p.o_custkey AND CAST(e.ts AS DATE) BETWEEN p.lo AND p.hi)"""


def _in_periods(spark, d) -> DataFrame:
    """Events in the periods of their device (orders moved on by 9000 days, into the time of the events)."""
    p = table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("os_name"), F.col("o_orderstatus").alias("os_codename"), F.date_add(F.to_date("o_orderdate"), 9000).alias("lo"), F.date_add(F.to_date("o_orderdate"), 9400).alias("hi"))
    e = table(spark, d, "events").withColumn("dt", F.to_date("ts"))
    return join_periods(e, "dt", ["user_id"], p, "lo", "hi", ["o_custkey"], width=30.0)


@query(f"""WITH {_PERIODS} SELECT os_name, os_codename, count(*)::BIGINT AS num_entries, count(DISTINCT user_id)::BIGINT AS number_of_systems, round(count(*) / count(DISTINCT user_id), 4) AS entries_per_system FROM j GROUP BY 1, 2""")
def range_join_counts(spark, d):
    g = _in_periods(spark, d).groupBy("os_name", "os_codename").agg(F.count("*").alias("num_entries"), F.count_distinct("user_id").alias("number_of_systems"))
    return g.withColumn("entries_per_system", F.round(S.ratio("num_entries", "number_of_systems"), 4))


@query(f"""WITH {_PERIODS} SELECT os_name, os_codename, event_type AS blocker_type, count(DISTINCT user_id)::BIGINT AS number_of_clients, round(avg(value) / 1000, 12) AS average_active_time_in_seconds, count(*)::BIGINT AS number_of_occurences FROM j GROUP BY 1, 2, 3""")
def range_join_detail(spark, d):
    return _in_periods(spark, d).groupBy("os_name", "os_codename", F.col("event_type").alias("blocker_type")).agg(F.count_distinct("user_id").alias("number_of_clients"), F.round(F.avg("value") / 1000, 12).alias("average_active_time_in_seconds"), F.count("*").alias("number_of_occurences"))


@query("""
SELECT l_returnflag AS connection_type, p_size::VARCHAR || 'x' || l_linenumber::VARCHAR AS resolution, count(DISTINCT l_suppkey)::BIGINT AS number_of_systems, round(avg(l_tax), 9) AS average_ac, round(avg(l_discount), 9) AS average_dc
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) > 10 ORDER BY 1, 3 DESC""")
def concat_key_durations(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    g = j.groupBy(F.col("l_returnflag").alias("connection_type"), F.concat_ws("x", F.col("p_size").cast("string"), F.col("l_linenumber").cast("string")).alias("resolution"))
    g = g.agg(F.count_distinct("l_suppkey").alias("number_of_systems"), F.round(F.avg("l_tax"), 9).alias("average_ac"), F.round(F.avg("l_discount"), 9).alias("average_dc"))
    return g.where("number_of_systems > 10").orderBy("connection_type", F.desc("number_of_systems"))


@query("""
SELECT o_orderpriority AS vendor_name, count(DISTINCT o_custkey)::BIGINT AS number_of_systems, (SELECT count(DISTINCT o_custkey) FROM orders)::BIGINT AS total_number_of_systems,
 round(100.0 * count(DISTINCT o_custkey) / (SELECT count(DISTINCT o_custkey) FROM orders), 2) AS percentage_of_systems FROM orders GROUP BY 1""")
def percent_of_distinct_total(spark, d):
    o = table(spark, d, "orders")
    whole = o.agg(F.count_distinct("o_custkey").alias("total_number_of_systems"))
    g = o.groupBy(F.col("o_orderpriority").alias("vendor_name")).agg(F.count_distinct("o_custkey").alias("number_of_systems")).crossJoin(F.broadcast(whole))
    return g.withColumn("percentage_of_systems", S.percent(F.col("number_of_systems"), F.col("total_number_of_systems")))


# --- ranked lists ---------------------------------------------------------------------------


@query("""
SELECT l_suppkey AS proc, v AS total_duration_per_instance, rank FROM (SELECT l_suppkey, round(v, 4) AS v, CAST(rank() OVER (ORDER BY v DESC) AS BIGINT) AS rank FROM
 (SELECT l_suppkey, sum(l_extendedprice) / 1000 / sum(l_quantity) AS v FROM lineitem WHERE l_shipdate IS NOT NULL AND l_returnflag IN ('R', 'A') GROUP BY 1)) WHERE rank <= 10""")
def topk_ratio_global(spark, d):
    g = table(spark, d, "lineitem").where(F.col("l_returnflag").isin("R", "A")).groupBy(F.col("l_suppkey").alias("proc")).agg(S.ratio(F.sum("l_extendedprice") / 1000, F.sum("l_quantity")).alias("v"))
    return top_with_ties(g, "v", 10).select("proc", F.round("v", 4).alias("total_duration_per_instance"), "rank")


@query("""
SELECT event_name, acdc, proc, round(v, 2) AS value, rank FROM (SELECT *, CAST(rank() OVER (PARTITION BY event_name, acdc ORDER BY v DESC) AS BIGINT) AS rank FROM
 (SELECT l_linestatus AS event_name, upper(substr(l_returnflag, 1, 2)) AS acdc, l_suppkey AS proc, sum(l_extendedprice) / sum(l_quantity) AS v FROM lineitem WHERE l_linenumber NOT IN (6, 7) GROUP BY 1, 2, 3)) WHERE rank <= 10 ORDER BY acdc, event_name, rank""")
def topk_ratio_multikey(spark, d):
    """Ranks on the unrounded ratio, shows the rounded one."""
    g = table(spark, d, "lineitem").where(~F.col("l_linenumber").isin(6, 7)).groupBy(F.col("l_linestatus").alias("event_name"), S.power_state("l_returnflag").alias("acdc"), F.col("l_suppkey").alias("proc")).agg(S.ratio(F.sum("l_extendedprice"), F.sum("l_quantity")).alias("v"))
    return ranked(g, "v", ["event_name", "acdc"], 10).select("event_name", "acdc", "proc", F.round("v", 2).alias("value"), "rank").orderBy("acdc", "event_name", "rank")


@query("""
WITH t AS (SELECT l_suppkey FROM (SELECT l_suppkey, rank() OVER (ORDER BY sum(l_extendedprice) / sum(l_quantity) DESC) AS r FROM lineitem GROUP BY 1 HAVING count(*) > 50 AND count(DISTINCT l_orderkey) > 20) WHERE r <= 20),
x AS (SELECT l_suppkey AS proc, l_returnflag AS acdc, round(sum(l_extendedprice) / sum(l_quantity), 2) AS v FROM lineitem JOIN t USING (l_suppkey) GROUP BY 1, 2)
SELECT proc, max(CASE WHEN acdc = 'A' THEN v ELSE 0 END) AS ac_duration, max(CASE WHEN acdc = 'N' THEN v ELSE 0 END) AS dc_duration, max(CASE WHEN acdc = 'R' THEN v ELSE 0 END) AS unknown_duration FROM x GROUP BY 1""")
def topk_pivot_compare(spark, d):
    items = table(spark, d, "lineitem")
    g = items.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("o"), S.ratio(F.sum("l_extendedprice"), F.sum("l_quantity")).alias("v")).where("n > 50 and o > 20")
    top = top_with_ties(g, "v", 20).select("l_suppkey")
    x = items.join(top, "l_suppkey", "left_semi").groupBy(F.col("l_suppkey").alias("proc"), F.col("l_returnflag").alias("acdc")).agg(F.round(S.ratio(F.sum("l_extendedprice"), F.sum("l_quantity")), 2).alias("v"))
    names = (("A", "ac"), ("N", "dc"), ("R", "unknown"))
    p = x.groupBy("proc").pivot("acdc", [a for a, _ in names]).agg(F.first("v"))
    return p.select("proc", *(F.coalesce(F.col(a), F.lit(0.0)).alias(f"{n}_duration") for a, n in names))


def _typed_topk(measure: str, name: str) -> str:
    return f"""
SELECT p_type, p_brand, {name}, rank FROM (SELECT p_type, p_brand, m AS {name}, CAST(rank() OVER (PARTITION BY p_type ORDER BY m DESC) AS BIGINT) AS rank FROM
 (SELECT p_type, p_brand, {measure} AS m FROM lineitem JOIN part ON l_partkey = p_partkey WHERE lower(p_brand) NOT IN ('brand#00') GROUP BY 1, 2)) WHERE rank <= 10"""


def _typed(spark, d, measure, name: str) -> DataFrame:
    j = table(spark, d, "lineitem").join(table(spark, d, "part").where(~F.lower("p_brand").isin("brand#00")), F.col("l_partkey") == F.col("p_partkey"))
    return ranked(j.groupBy("p_type", "p_brand").agg(measure.alias(name)), name, ["p_type"], 10)


@query(_typed_topk("round(avg(l_extendedprice), 4)", "avg_price"))
def topk_avg(spark, d):
    return _typed(spark, d, F.round(F.avg("l_extendedprice"), 4), "avg_price")


@query(_typed_topk("count(DISTINCT l_suppkey)::BIGINT", "number_of_systems"))
def topk_distinct(spark, d):
    return _typed(spark, d, F.count_distinct("l_suppkey"), "number_of_systems")


@query(_typed_topk("round(sum(l_quantity), 2)", "total_detections"))
def topk_sum(spark, d):
    return _typed(spark, d, F.round(F.sum("l_quantity"), 2), "total_detections")


@query("SELECT user_id, total, rnk FROM (SELECT user_id, round(sum(value), 4) AS total, CAST(rank() OVER (ORDER BY round(sum(value), 4) DESC) AS BIGINT) AS rnk FROM events GROUP BY 1) WHERE rnk <= 100")
def rank_sum(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total"))
    return top_with_ties(g, "total", 100).withColumnRenamed("rank", "rnk")


@query("SELECT user_id, event_type, total, rnk FROM (SELECT user_id, event_type, round(sum(value), 4) AS total, CAST(rank() OVER (PARTITION BY user_id ORDER BY round(sum(value), 4) DESC) AS BIGINT) AS rnk FROM events GROUP BY 1, 2) WHERE rnk <= 3")
def rank_sum_partitioned(spark, d):
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("total"))
    return ranked(g, "total", ["user_id"], 3).withColumnRenamed("rank", "rnk")


@query("SELECT user_id AS app_id, a AS total_power_consumption, rnk FROM (SELECT user_id, round(avg(value), 6) AS a, CAST(rank() OVER (ORDER BY round(avg(value), 6) DESC) AS BIGINT) AS rnk FROM events GROUP BY 1) WHERE rnk <= 20")
def rank_avg(spark, d):
    g = table(spark, d, "events").groupBy(F.col("user_id").alias("app_id")).agg(F.round(F.avg("value"), 6).alias("total_power_consumption"))
    return top_with_ties(g, "total_power_consumption", 20).withColumnRenamed("rank", "rnk")


# --- daily tables ---------------------------------------------------------------------------


@query("SELECT user_id AS guid, CAST(ts AS DATE)::TIMESTAMP AS dt, event_type, upper(substr(event_type, 1, 2)) AS acdc, count(*)::BIGINT AS number_of_instances, round(sum(value), 4) AS total_duration FROM events GROUP BY 1, 2, 3")
def daily_agg(spark, d):
    g = table(spark, d, "events").groupBy(F.col("user_id").alias("guid"), F.to_date("ts").alias("dt"), "event_type")
    out = g.agg(F.count("*").alias("number_of_instances"), F.round(F.sum("value"), 4).alias("total_duration"))
    return out.select("guid", F.col("dt").cast("timestamp_ntz").alias("dt"), "event_type", S.power_state("event_type").alias("acdc"), "number_of_instances", "total_duration")


@query("SELECT l_suppkey AS guid, l_shipdate AS dt, l_returnflag AS input_desc, round(sum(l_quantity), 2) AS nrs, round(min(l_discount), 4) AS min_v, round(max(l_discount), 4) AS max_v, round(sum(l_quantity * l_discount) / sum(l_quantity), 9) AS avg_v FROM lineitem GROUP BY 1, 2, 3")
def daily_weighted_stats(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("guid"), F.col("l_shipdate").alias("dt"), F.col("l_returnflag").alias("input_desc"))
    return g.agg(F.round(F.sum("l_quantity"), 2).alias("nrs"), F.round(F.min("l_discount"), 4).alias("min_v"), F.round(F.max("l_discount"), 4).alias("max_v"), F.round(S.wavg("l_quantity", "l_discount"), 9).alias("avg_v"))


@query("""SELECT user_id AS guid, count(*)::BIGINT AS num_power_ons, max(CASE WHEN value >= 10 THEN value END) AS max_start, min(CASE WHEN value >= 10 THEN value END) AS min_start, round(avg(CASE WHEN value - 10 >= 0 THEN value END), 2) AS avg_start FROM events GROUP BY 1""")
def daily_minmax_sentinel(spark, d):
    kept = F.when(S.unless_negative(F.col("value") - 10).isNotNull(), F.col("value"))
    return table(spark, d, "events").groupBy(F.col("user_id").alias("guid")).agg(F.count("*").alias("num_power_ons"), F.max(kept).alias("max_start"), F.min(kept).alias("min_start"), F.round(F.avg(kept), 2).alias("avg_start"))


@query("""SELECT l_partkey AS guid, round(sum(l_quantity), 2) AS nrs, max(p_size * 1024)::BIGINT AS sysinfo_ram, round(sum(l_quantity * (100 - 100.0 * l_linenumber * 100 / (p_size * 1024.0))) / sum(l_quantity), 2) AS avg_percentage_used
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 0 GROUP BY 1""")
def memory_percent_used(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part").where("p_size > 0"), F.col("l_partkey") == F.col("p_partkey"))
    used = 100 - 100.0 * F.col("l_linenumber") * 100 / (F.col("p_size") * 1024.0)
    return j.groupBy(F.col("l_partkey").alias("guid")).agg(F.round(F.sum("l_quantity"), 2).alias("nrs"), F.max(F.col("p_size") * 1024).cast("long").alias("sysinfo_ram"), F.round(S.wavg("l_quantity", used), 2).alias("avg_percentage_used"))


@query("""
SELECT 'event' AS source, user_id AS guid, event_type AS kind, value, NULL::BIGINT AS n FROM events UNION ALL SELECT 'order', o_custkey, NULL, o_totalprice, NULL FROM orders UNION ALL SELECT 'line', l_orderkey, l_returnflag, NULL, l_linenumber FROM lineitem""")
def union_padded_sources(spark, d):
    """Sources of different shape in one table; what one lacks is a typed null."""
    e = table(spark, d, "events").select(F.lit("event").alias("source"), F.col("user_id").alias("guid"), F.col("event_type").alias("kind"), "value")
    o = table(spark, d, "orders").select(F.lit("order").alias("source"), F.col("o_custkey").alias("guid"), F.col("o_totalprice").alias("value"))
    li = table(spark, d, "lineitem").select(F.lit("line").alias("source"), F.col("l_orderkey").alias("guid"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").cast("long").alias("n"))
    return e.unionByName(o, allowMissingColumns=True).unionByName(li, allowMissingColumns=True)


# --- wide table -----------------------------------------------------------------------------

_WIDE = """
e AS (SELECT user_id AS guid, count(*)::DOUBLE AS ev_nrs, sum(value) AS ev_total, sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) AS ev_click FROM events GROUP BY 1),
o AS (SELECT o_custkey AS guid, count(*)::DOUBLE AS batt_num, sum(o_totalprice) AS batt_total FROM orders GROUP BY 1),
l AS (SELECT o_custkey AS guid, sum(l_quantity) AS net_nrs, sum(l_quantity * l_discount) / sum(l_quantity) AS net_avg FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
wide AS (SELECT c_custkey AS guid, coalesce(c_mktsegment, 'Unknown') AS segment, coalesce(ev_nrs, 0) AS ev_nrs, coalesce(ev_total, 0) AS ev_total, coalesce(ev_click, 0) AS ev_click, coalesce(batt_num, 0) AS batt_num, coalesce(batt_total, 0) AS batt_total, coalesce(net_nrs, 0) AS net_nrs, coalesce(net_avg, 0) AS net_avg
 FROM customer LEFT JOIN e ON c_custkey = e.guid LEFT JOIN o ON c_custkey = o.guid LEFT JOIN l ON c_custkey = l.guid)"""
_METRICS = ["ev_nrs", "ev_total", "ev_click", "batt_num", "batt_total", "net_nrs", "net_avg"]


def _wide(spark, d) -> DataFrame:
    orders = table(spark, d, "orders")
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("guid")).agg(F.count("*").cast("double").alias("ev_nrs"), F.sum("value").alias("ev_total"), S.sum_if(F.col("event_type") == "click", "value").alias("ev_click"))
    o = orders.groupBy(F.col("o_custkey").alias("guid")).agg(F.count("*").cast("double").alias("batt_num"), F.sum("o_totalprice").alias("batt_total"))
    j = table(spark, d, "lineitem").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    li = j.groupBy(F.col("o_custkey").alias("guid")).agg(F.sum("l_quantity").alias("net_nrs"), S.wavg("l_quantity", "l_discount").alias("net_avg"))
    return W.assemble(table(spark, d, "customer").select(F.col("c_custkey").alias("guid"), F.col("c_mktsegment").alias("segment")), [e, o, li])


@query(f"WITH {_WIDE} SELECT guid, segment, round(ev_nrs, 2) AS ev_nrs, round(ev_total, 2) AS ev_total, round(ev_click, 2) AS ev_click, round(batt_num, 2) AS batt_num, round(batt_total, 2) AS batt_total, round(net_nrs, 2) AS net_nrs, round(net_avg, 12) AS net_avg FROM wide")
def wide_feature_table(spark, d):
    return _wide(spark, d).select("guid", "segment", *(F.round(c, 12 if c == "net_avg" else 2).alias(c) for c in _METRICS))


@query(f"WITH {_WIDE} SELECT guid, name, round(v, 4) AS value FROM (SELECT guid, unnest(['ev_total', 'ev_click', 'batt_total']) AS name, unnest([ev_total, ev_click, batt_total]) AS v FROM wide) WHERE v > 0")
def decompose_unpivot(spark, d):
    return W.unpivot_positive(_wide(spark, d), "guid", ["ev_total", "ev_click", "batt_total"]).withColumn("value", F.round("value", 4))


@query(f"WITH {_WIDE} SELECT guid, ({' + '.join(f'CASE WHEN {c} <> 0 THEN 1 ELSE 0 END' for c in _METRICS)})::BIGINT AS covered FROM wide WHERE ({' + '.join(f'CASE WHEN {c} <> 0 THEN 1 ELSE 0 END' for c in _METRICS)}) >= 5")
def coverage_filter(spark, d):
    return W.covered(_wide(spark, d), _METRICS, 5).select("guid", S.nonzero_count(_METRICS).cast("long").alias("covered"))


@query(f"WITH {_WIDE} SELECT unnest([{', '.join(repr(c) for c in _METRICS)}]) AS name, unnest([{', '.join(f'round(100.0 * sum(CASE WHEN {c} <> 0 THEN 1 ELSE 0 END) / count(*), 4)' for c in _METRICS)}]) AS percent_nonzero FROM wide")
def sparsity_summary(spark, d):
    return W.sparsity(_wide(spark, d), _METRICS).withColumn("percent_nonzero", F.round("percent_nonzero", 4))


@query("""
WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), t AS (SELECT p_brand FROM c ORDER BY n DESC, p_brand LIMIT 10)
SELECT CASE WHEN p_brand IN (SELECT p_brand FROM t) THEN p_brand ELSE 'Other' END AS brand, count(*)::BIGINT AS n FROM part GROUP BY 1""")
def topk_other_bucket(spark, d):
    return Y.top_or_other(table(spark, d, "part"), "p_brand", 10).groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT n_name, count(DISTINCT c_custkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT CASE WHEN n >= 60 THEN n_name ELSE 'Other' END AS country, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN c USING (n_name) GROUP BY 1""")
def min_support_bucket(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return Y.supported_or_other(j, "n_name", "c_custkey", 60).groupBy(F.col("n_name").alias("country")).agg(F.count("*").alias("n"))


@query(f"""SELECT p_partkey, (list_sort(list_transform({list(S.RAM_SIZES)}, lambda a: {{'d': abs(a - p_size), 'v': a}}))[1]).v::DOUBLE AS snapped FROM part""")
def snap_nearest(spark, d):
    return table(spark, d, "part").select("p_partkey", S.snap("p_size").alias("snapped"))


# --- distributions and noise ----------------------------------------------------------------


@query("""
WITH b AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem)
SELECT bin, count(*)::BIGINT AS n FROM (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19)::BIGINT AS bin FROM lineitem, b WHERE l_extendedprice BETWEEN lo AND hi) GROUP BY 1""")
def equal_width_histogram(spark, d):
    return Y.histogram(table(spark, d, "lineitem"), "l_extendedprice", 20, 0.01, 0.99)


@query("""
WITH b AS (SELECT quantile_cont(o_totalprice, 0.999) AS hi FROM orders)
SELECT o_orderkey, round(ln(1 + greatest(least(o_totalprice, hi), 0)), 6) AS x FROM orders, b""")
def quantile_clip_log1p(spark, d):
    return Y.clipped_log(table(spark, d, "orders"), "o_totalprice", 0.999).select("o_orderkey", F.round("o_totalprice", 6).alias("x"))


_HASH = "('0x' || substr(md5({0} || ':{1}'), 1, 8))::BIGINT"


@query(f"""
WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY md5(c_custkey::VARCHAR || ':42'), c_custkey) AS r, count(*) OVER () AS n FROM customer)
SELECT CASE WHEN r <= n // 2 THEN 1 ELSE 2 END::BIGINT AS half, count(*)::BIGINT AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN c ON o_custkey = c_custkey GROUP BY 1""")
def split_half_semi_join(spark, d):
    first, second = E.split_half(table(spark, d, "customer"), "c_custkey", "42")
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    halves = [o.join(h, "c_custkey", "left_semi").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total")).select(F.lit(k).cast("long").alias("half"), "n_orders", "total") for k, h in ((1, first), (2, second))]
    return halves[0].unionByName(halves[1])


@query("""
WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 10 <> 0), c AS (SELECT vec_id AS cand, embedding AS ce FROM embeddings WHERE vec_id % 10 = 0),
dist AS (SELECT vec_id, cand, list_sum(list_transform(list_zip(embedding, ce), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))) AS dd FROM q, c),
nn AS (SELECT vec_id, arg_min(cand, {'d': round(dd, 9), 'c': cand}) AS cand FROM dist GROUP BY 1)
SELECT c.cand AS candidate_id, count(nn.vec_id)::BIGINT AS votes FROM c LEFT JOIN nn ON c.cand = nn.cand GROUP BY 1""")
def nn_l1_votes(spark, d):
    """Every vector votes for its nearest candidate by L1 distance; candidates without votes keep a bin."""
    e = table(spark, d, "embeddings")
    return Y.vector_votes(e.where("vec_id % 10 <> 0"), e.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "candidate_id"), "embedding")


_LAPLACE = "(-2.0 * sign(u - 0.5) * ln(1 - 2 * abs(u - 0.5)))"


@query(f"""
WITH g AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), h AS (SELECT *, (({_HASH.format("event_type", "7")}) + 0.5) / 4294967296.0 AS u FROM g)
SELECT event_type, round(greatest(n + {_LAPLACE}, 0), 6) AS noisy FROM h""")
def noisy_counts_laplace(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return g.select("event_type", F.round(F.greatest(F.col("n") + S.laplace("event_type", "7", 2.0), F.lit(0.0)), 6).alias("noisy"))


@query(f"""
WITH g AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), h AS (SELECT *, (({_HASH.format("user_id::VARCHAR", "9")}) + 0.5) / 4294967296.0 AS u FROM g)
SELECT user_id AS candidate_id, round(greatest(n + {_LAPLACE}, 0), 6) AS votes FROM h ORDER BY 2 DESC, 1 DESC LIMIT 20""")
def noisy_histogram_select(spark, d):
    g = table(spark, d, "events").groupBy(F.col("user_id").alias("candidate_id")).agg(F.count("*").alias("votes"))
    noisy = g.withColumn("votes", F.round(F.greatest(F.col("votes") + S.laplace("candidate_id", "9", 2.0), F.lit(0.0)), 6))
    return Y.select_ranked(noisy, 20)


# --- evaluation -----------------------------------------------------------------------------

_HALVES = "real AS (SELECT * FROM events WHERE user_id % 2 = 0), synth AS (SELECT * FROM events WHERE user_id % 2 = 1)"


def _halves(spark, d) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events")
    return e.where("user_id % 2 = 0"), e.where("user_id % 2 = 1")


@query(f"""
WITH {_HALVES}, r AS (SELECT event_type, avg(value) AS a, count(*)::DOUBLE AS n FROM real GROUP BY 1), s AS (SELECT event_type, avg(value) AS a, count(*)::DOUBLE AS n FROM synth GROUP BY 1)
SELECT 'a' AS col, round(median(abs(s.a - r.a) / abs(r.a)), 6) AS value FROM r JOIN s USING (event_type) UNION ALL SELECT 'n', round(median(abs(s.n - r.n) / abs(r.n)), 6) FROM r JOIN s USING (event_type)""")
def eval_aggregate(spark, d):
    real, synth = (x.groupBy("event_type").agg(F.avg("value").alias("a"), F.count("*").cast("double").alias("n")) for x in _halves(spark, d))
    return E.median_errors(real, synth, ["event_type"], ["a", "n"]).select("col", F.round("value", 6).alias("value"))


@query(f"""
WITH {_HALVES}, r AS (SELECT event_type, sum(value) AS v FROM real GROUP BY 1), s AS (SELECT event_type, sum(value) AS v FROM synth GROUP BY 1)
SELECT round(0.5 * sum(abs(coalesce(r.v, 0) / (SELECT sum(v) FROM r) - coalesce(s.v, 0) / (SELECT sum(v) FROM s))), 6) AS total_variation FROM r FULL JOIN s USING (event_type)""")
def eval_distribution(spark, d):
    real, synth = (x.groupBy("event_type").agg(F.sum("value").alias("v")) for x in _halves(spark, d))
    return E.total_variation(real, synth, ["event_type"], "v").select(F.round("total_variation", 6).alias("total_variation"))


@query(f"""
WITH {_HALVES}, a AS (SELECT extract(hour FROM ts) AS h, count(*) AS v FROM real GROUP BY 1), b AS (SELECT extract(hour FROM ts) AS h, count(*) AS v FROM synth GROUP BY 1),
j AS (SELECT a.v AS x, b.v AS y FROM a JOIN b USING (h)), k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS x, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS y FROM j)
SELECT round(corr(x, y), 6) AS spearman, count(*)::BIGINT AS n FROM k""")
def eval_ranking(spark, d):
    real, synth = (x.groupBy(F.hour("ts").alias("h")).agg(F.count("*").alias("v")) for x in _halves(spark, d))
    return E.spearman(real, synth, ["h"], "v", []).select(F.round("spearman", 6).alias("spearman"), "n")


@query(f"""
WITH {_HALVES} SELECT round(abs((SELECT count(*) FROM synth) - (SELECT count(*) FROM real)) / (SELECT count(*) FROM real), 6) AS row_count_error, round(abs((SELECT avg(value) FROM synth) - (SELECT avg(value) FROM real)) / (SELECT abs(avg(value)) FROM real), 6) AS mean_error""")
def eval_row_level(spark, d):
    real, synth = _halves(spark, d)
    return E.row_level(real, synth, "value").select(F.round("row_count_error", 6).alias("row_count_error"), F.round("mean_error", 6).alias("mean_error"))


@query("""
WITH t AS (SELECT user_id % 3 AS third, event_type, avg(value) AS v FROM events GROUP BY 1, 2)
SELECT a.event_type, round((abs(b.v - a.v) / abs(a.v)) / (abs(c.v - a.v) / abs(a.v)), 4) AS normalized FROM t a JOIN t b USING (event_type) JOIN t c USING (event_type) WHERE a.third = 0 AND b.third = 1 AND c.third = 2 AND abs(c.v - a.v) / abs(a.v) >= 1e-8""")
def normalized_error(spark, d):
    t = table(spark, d, "events").groupBy((F.col("user_id") % 3).alias("third"), "event_type").agg(F.avg("value").alias("v"))
    part = [t.where(F.col("third") == k).select("event_type", F.col("v").alias(f"v{k}")) for k in range(3)]
    j = part[0].join(part[1], "event_type").join(part[2], "event_type")
    records = j.select("event_type", F.lit("relative_error").alias("metric_type"), E.relative_error("v0", "v1").alias("value"), E.relative_error("v0", "v2").alias("baseline"))
    return E.normalized(records).select("event_type", F.round("normalized", 4).alias("normalized"))


@query(f"""
WITH {_HALVES}, a AS (SELECT event_type AS g, extract(hour FROM ts) AS h, sum(value) AS v FROM real GROUP BY 1, 2), b AS (SELECT event_type AS g, extract(hour FROM ts) AS h, sum(value) AS v FROM synth GROUP BY 1, 2),
j AS (SELECT g, a.v AS x, b.v AS y FROM a JOIN b USING (g, h)), k AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) AS x, rank() OVER (PARTITION BY g ORDER BY y) AS y FROM j)
SELECT g, round(corr(x, y), 6) AS spearman, count(*)::BIGINT AS n FROM k GROUP BY 1""")
def spearman_by_group(spark, d):
    real, synth = (x.groupBy(F.col("event_type").alias("g"), F.hour("ts").alias("h")).agg(F.sum("value").alias("v")) for x in _halves(spark, d))
    return E.spearman(real, synth, ["g", "h"], "v", ["g"]).select("g", F.round("spearman", 6).alias("spearman"), "n")


@query(f"""
WITH {_HALVES}, v AS (SELECT value AS x, 1.0 AS a, 0.0 AS b FROM real UNION ALL SELECT value, 0.0, 1.0 FROM synth), g AS (SELECT x, sum(a) AS a, sum(b) AS b FROM v GROUP BY 1),
c AS (SELECT x, sum(a) OVER (ORDER BY x) / (SELECT sum(a) FROM g) AS f, sum(b) OVER (ORDER BY x) / (SELECT sum(b) FROM g) AS h, lead(x) OVER (ORDER BY x) AS nx FROM g)
SELECT round(max(abs(f - h)), 6) AS ks, round(sum(abs(f - h) * (nx - x)), 4) AS wasserstein FROM c""")
def ks_wasserstein(spark, d):
    real, synth = _halves(spark, d)
    return E.ks_wasserstein(real, synth, "value").select(F.round("ks", 6).alias("ks"), F.round("wasserstein", 4).alias("wasserstein"))


@query("""
WITH r AS (SELECT * FROM lineitem WHERE l_orderkey % 2 = 0), s AS (SELECT * FROM lineitem WHERE l_orderkey % 2 = 1),
p AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c FROM r), q AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c FROM s)
SELECT round((abs(p.a - q.a) + abs(p.b - q.b) + abs(p.c - q.c)) / 3, 6) AS mean_difference, round(greatest(abs(p.a - q.a), abs(p.b - q.b), abs(p.c - q.c)), 6) AS max_difference FROM p, q""")
def corr_divergence(spark, d):
    li = table(spark, d, "lineitem")
    out = E.correlation_divergence(li.where("l_orderkey % 2 = 0"), li.where("l_orderkey % 2 = 1"), ["l_quantity", "l_extendedprice", "l_discount"])
    return out.select(F.round("mean_difference", 6).alias("mean_difference"), F.round("max_difference", 6).alias("max_difference"))


@query("""
WITH a AS (SELECT DISTINCT source AS k FROM documents), b AS (SELECT DISTINCT source AS k FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT round((SELECT count(*) FROM a JOIN b USING (k)) / (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)), 6) AS jaccard, (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b))::BIGINT AS missing, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a))::BIGINT AS extra""")
def support_overlap(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("k"))
    toxic = docs.join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi")
    return E.support(docs, toxic, "k").select(F.round("jaccard", 6).alias("jaccard"), "missing", "extra")


@query("""
SELECT p_partkey, CASE WHEN trim(p_type) = '' THEN 'Unknown' ELSE regexp_replace(lower(trim(p_type)), '[^a-z0-9]', '_', 'g') END AS canonical FROM part""")
def text_normalize_canonicalize(spark, d):
    x = F.trim("p_type")
    return table(spark, d, "part").select("p_partkey", F.when(x == "", "Unknown").otherwise(F.regexp_replace(F.lower(x), "[^a-z0-9]", "_")).alias("canonical"))


@query("""
WITH h AS (SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY md5(c_custkey::VARCHAR || ':11'), c_custkey) AS r FROM customer)
SELECT c_custkey, c_mktsegment FROM h WHERE r <= 100""")
def sample_without_replacement(spark, d):
    return E.sample_exact(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", 100, "11")


@query("""
WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM n) WHERE r = 1""")
def mode_per_group(spark, d):
    return E.mode(table(spark, d, "events"), ["user_id"], "event_type")


@query(f"""
WITH {_HALVES}, j AS (SELECT 'value' AS name, (SELECT avg(value) FROM real) AS a, (SELECT avg(value) FROM synth) AS b)
SELECT name, round(a, 6) AS real_mean, round(b, 6) AS synth_mean, round(abs(b - a) / abs(a), 6) AS relative_error, CASE WHEN abs(b - a) / abs(a) <= 0.1 THEN 10 WHEN abs(b - a) / abs(a) <= 0.25 THEN 25 WHEN abs(b - a) / abs(a) <= 0.5 THEN 50 END::INTEGER AS within FROM j""")
def column_mean_comparison(spark, d):
    real, synth = _halves(spark, d)
    return E.mean_comparison(real, synth, ["value"]).select("name", *(F.round(c, 6).alias(c) for c in ("real_mean", "synth_mean", "relative_error")), "within")


@query("""
WITH q AS (SELECT list_distinct([quantile_cont(l_quantity, 0.0), quantile_cont(l_quantity, 0.25), quantile_cont(l_quantity, 0.5), quantile_cont(l_quantity, 0.75), quantile_cont(l_quantity, 1.0)]) AS e FROM lineitem),
x AS (SELECT l_quantity AS v, list_sort(e)[2:len(e) - 1] AS inner_e FROM lineitem, q)
SELECT len(list_filter(inner_e, lambda y: y < v))::INTEGER AS bin, count(*)::BIGINT AS n FROM x GROUP BY 1""")
def quantile_binning(spark, d):
    return Y.quantile_bins(table(spark, d, "lineitem").select("l_quantity"), "l_quantity", 4).groupBy(F.col("l_quantity_bin").alias("bin")).agg(F.count("*").alias("n"))


@query("""
WITH b AS (SELECT quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.9) AS p90, quantile_cont(l_extendedprice, 0.99) AS p99 FROM lineitem)
SELECT round(avg(l_extendedprice), 4) AS mean, round(min(p50), 4) AS p50, round(min(p90), 4) AS p90, round(min(p99), 4) AS p99, round(max(l_extendedprice), 4) AS max, round(avg(CASE WHEN l_extendedprice = 0 THEN 1 ELSE 0 END), 4) AS zero_rate FROM lineitem, b""")
def summary_statistics(spark, d):
    x = E.summary(table(spark, d, "lineitem"), "l_extendedprice")
    return x.select(*(F.round(c, 4).alias(c) for c in x.columns))


# --- lookups, coverage, reports -------------------------------------------------------------

_PLACES = {"BUILDING": "office", "MACHINERY": "plant", "HOUSEHOLD": "home"}


@query(f"SELECT c_custkey, CASE c_mktsegment {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _PLACES.items())} ELSE 'elsewhere' END AS place FROM customer")
def lookup_with_default(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.lookup("c_mktsegment", _PLACES, "elsewhere").alias("place"))


@query("""
SELECT 'events' AS name, count(DISTINCT c_custkey)::BIGINT AS devices, count(DISTINCT CASE WHEN user_id IS NOT NULL THEN c_custkey END)::BIGINT AS covered FROM customer LEFT JOIN events ON c_custkey = user_id
UNION ALL SELECT 'orders', count(DISTINCT c_custkey), count(DISTINCT CASE WHEN o_custkey IS NOT NULL THEN c_custkey END) FROM customer LEFT JOIN orders ON c_custkey = o_custkey""")
def coverage_left_join(spark, d):
    named = {"events": table(spark, d, "events").withColumnRenamed("user_id", "c_custkey"), "orders": table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")}
    return E.coverage(table(spark, d, "customer"), "c_custkey", named)


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, {', '.join(f'round(quantile_cont({c}, {p / 100}), 4) AS p{p}' for p in E.REPORT)} FROM lineitem" for c in ("l_quantity", "l_extendedprice")))
def percentile_report(spark, d):
    return E.percentile_report(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]).select("name", *(F.round(f"p{p}", 4).alias(f"p{p}") for p in E.REPORT))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS kinds FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def list_per_group(spark, d):
    """A list for each group, of distinct values, so that no list grows with the table."""
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("""
WITH n AS (SELECT o_custkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT 'l_partkey' AS name, round(avg(parts), 6) AS mean, median(parts)::DOUBLE AS median FROM n UNION ALL SELECT 'l_suppkey', round(avg(supps), 6), median(supps)::DOUBLE FROM n""")
def expected_counts(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return E.expected_counts(j, "o_custkey", ["l_partkey", "l_suppkey"]).withColumn("mean", F.round("mean", 6))


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN 'no such place' ELSE n_name END AS country FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def canonicalize_spellings(spark, d):
    """Names in lower case, with blanks around, with a letter lost, or of another kind, brought to the vocabulary of a table where one is close."""
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    how = F.col("c_custkey") % 4
    spelt = F.when(how == 0, F.lower("n_name")).when(how == 1, F.col("n_name")).when(how == 2, F.concat(F.substring("n_name", 1, 2), F.substring("n_name", 4, 100))).otherwise("no such place")
    return P.canonicalize(j.select("c_custkey", spelt.alias("country")), "country", table(spark, d, "nation").select(F.col("n_name").alias("country")))


@query(f"""
WITH d AS (SELECT c_custkey, row_number() OVER (ORDER BY md5(c_custkey::VARCHAR || ':42d'), c_custkey) AS r, greatest(1, floor(0.3 * count(*) OVER ())) AS k FROM customer),
o AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR || ':42r'), o_orderkey) AS r, count(*) OVER () AS n, ({_HASH.format("o_orderkey::VARCHAR", "42u")} + 0.5) / 4294967296.0 AS u FROM orders),
p AS (SELECT o_orderkey, CASE WHEN n <= (SELECT max(k) FROM d) THEN r ELSE 1 + floor(u * (SELECT max(k) FROM d)) END AS place FROM o)
SELECT o_orderkey, c_custkey FROM p JOIN d ON d.r = place AND d.r <= d.k""")
def key_assignment(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey")
    return Y.assign_by_rate(rows, "o_orderkey", table(spark, d, "customer"), "c_custkey", 0.3, "42").select("o_orderkey", "c_custkey")
