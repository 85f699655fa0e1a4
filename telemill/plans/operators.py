"""Operators of synthesis, repair and scoring, registered one by one over the driver's tables, noise on fixed seeds, each with its SQL."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..operators import evaluate as E
from ..operators import features as X
from ..operators import postprocess as R
from ..operators import synthesis as Y
from ..operators import wide as W
from ..sources import reporting, tables
from . import benchmark, over_tables, scores
from .catalog import table
from .generation import gaussian_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str):
    def register(fn):
        QUERIES[fn.__name__], ORACLE_SQL[fn.__name__] = fn, sql
        return fn

    return register


def _rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.select(*(F.round(f"`{c}`", digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def _uniform(key: str, seed: str) -> str:
    return f"((('0x' || substr(md5({key} || ':{seed}'), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


def _laplace(key: str, seed: str, scale: float) -> str:
    u = f"({_uniform(key, seed)} - 0.5)"
    return f"(-{scale} * sign({u}) * ln(1 - 2 * abs({u})))"


# --- noise ----------------------------------------------------------------------------------


@_query(f"""
SELECT event_type, round(greatest(n + 3.0 * ({gaussian_sql("event_type", "c")}), 0), 5) AS count, round(greatest(v + 3.0 * ({gaussian_sql("event_type", "m")}) * 500.0 / n, 0), 5) AS mean,
 round(least(greatest(p + 3.0 * ({gaussian_sql("event_type", "p")}) * 100.0 / n, 0), 100), 5) AS percent
FROM (SELECT event_type, count(*) AS n, avg(value) AS v, 100.0 * avg(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS p FROM events GROUP BY 1)""")
def noisy_count_mean_percentage(spark, d):
    high = F.when(F.col("value") > 50, 1).otherwise(0)
    g = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("v"), (100.0 * F.avg(high)).alias("p"))
    n = F.col("n")
    noisy = g.select("event_type", Y.noisy_count(n, 3.0, "event_type", "c").alias("count"), Y.noisy_mean(F.col("v"), n, 500.0, 3.0, "event_type", "m").alias("mean"), Y.noisy_percentage(F.col("p"), n, 3.0, "event_type", "p").alias("percent"))
    return _rounded(noisy, 5)


# --- marginals and scaling ------------------------------------------------------------------


@_query(f"""
WITH e AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders),
h AS (SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19)::BIGINT AS bin, count(*) AS n FROM orders, e WHERE o_totalprice BETWEEN lo AND hi GROUP BY 1),
c AS (SELECT range AS bin, greatest(coalesce(n, 0) + {_laplace("range::VARCHAR", "h", 1.0)}, 0) AS c FROM range(20) LEFT JOIN h ON bin = range)
SELECT round(lo + bin * (hi - lo) / 20, 4) AS lo, round(lo + (bin + 1) * (hi - lo) / 20, 4) AS hi, round(c / sum(c) OVER (), 7) AS p FROM c, e""")
def numeric_marginal(spark, d):
    m = Y.marginal(table(spark, d, "orders").select(F.col("o_totalprice")), "o_totalprice", 1.0, 20, "h")
    return m.select(F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), F.round("p", 7).alias("p"))


@_query(f"""
WITH n AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, greatest(n + {_laplace("l_returnflag || chr(31) || l_linestatus", "j", 2.0)}, 0) AS c FROM n)
SELECT l_returnflag, l_linestatus, round(c / sum(c) OVER (), 9) AS p FROM c""")
def joint_marginal(spark, d):
    return _rounded(Y.category_marginal(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], 0.5, "j"), 9)


@_query("""
WITH b AS (SELECT min(ln(1 + o_totalprice)) AS lo, max(ln(1 + o_totalprice)) AS hi FROM orders)
SELECT o_orderkey, round((ln(1 + o_totalprice) - lo) / (hi - lo), 8) AS scaled FROM orders, b""")
def scaled_to_unit(spark, d):
    return Y.scale_unit(table(spark, d, "orders"), "o_totalprice").select("o_orderkey", F.round("o_totalprice", 8).alias("scaled"))


@_query("""
WITH b AS (SELECT min(ln(1 + o_totalprice)) AS lo, max(ln(1 + o_totalprice)) AS hi FROM orders)
SELECT o_orderkey, round(exp((ln(1 + o_totalprice) - lo) / (hi - lo) * (hi - lo) + lo) - 1, 4) AS back FROM orders, b""")
def scaled_and_back(spark, d):
    o = table(spark, d, "orders")
    lo, hi = o.agg(F.min(F.log1p("o_totalprice")), F.max(F.log1p("o_totalprice"))).first()  # one row
    return Y.scale_unit(o, "o_totalprice").select("o_orderkey", F.round(Y.unscale_unit("o_totalprice", lo, hi), 4).alias("back"))


@_query("SELECT c_custkey, (CASE WHEN c_acctbal <= 0 THEN 1 ELSE 0 END)::INT AS is_zero, round(ln(1 + greatest(c_acctbal, 0)), 8) AS log, greatest(c_acctbal, 0) AS pos, greatest(-c_acctbal, 0) AS neg FROM customer")
def hurdle_and_signed_split(spark, d):
    x = Y.signed_split(Y.hurdle(table(spark, d, "customer"), ["c_acctbal"]), "c_acctbal")
    return x.select("c_custkey", F.col("c_acctbal__is_zero").alias("is_zero"), F.round("c_acctbal__log", 8).alias("log"), F.col("c_acctbal_pos").alias("pos"), F.col("c_acctbal_neg").alias("neg"))


# --- fitted features ------------------------------------------------------------------------

_FITTED = """
top AS (SELECT n AS nation, row_number() OVER (ORDER BY n) AS place FROM (SELECT c_nationkey::VARCHAR AS n, count(*) AS m FROM customer GROUP BY 1 ORDER BY m DESC, n LIMIT 10)),
q AS (SELECT quantile_cont(c_acctbal, 0.95) AS clip FROM customer),
l AS (SELECT c_custkey, c_nationkey, ln(1 + greatest(least(c_acctbal, clip), 0)) AS x FROM customer, q),
m AS (SELECT avg(x) AS mean, stddev_pop(x) AS std FROM l)"""


def _fitted(spark: SparkSession, d: str) -> tuple[DataFrame, X.Prepared]:
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"), "c_acctbal")
    return c, X.fit(c, ["c_acctbal"], ["nation"], 10, 0.95)


@_query(f"""
WITH {_FITTED}
SELECT c_custkey, coalesce(place, 11)::INT AS place, round((x - mean) / std, 7) AS balance FROM l LEFT JOIN top ON nation = c_nationkey::VARCHAR, m""")
def prepared_features(spark, d):
    c, fitted = _fitted(spark, d)
    v = fitted.transform(c)
    return v.select("c_custkey", F.array_position("features", F.lit(1.0)).cast("int").alias("place"), F.round(F.element_at("features", 12), 7).alias("balance"))


@_query(f"""
WITH {_FITTED}
SELECT c_custkey, coalesce(nation, '{X.OTHER}') AS nation, round(greatest(exp(x) - 1, 0), 3) AS c_acctbal FROM l LEFT JOIN top ON nation = c_nationkey::VARCHAR""")
def features_and_back(spark, d):
    c, fitted = _fitted(spark, d)
    back = fitted.inverse(fitted.transform(c).select("c_custkey", "features"))
    return back.select("c_custkey", "nation", F.round("c_acctbal", 3).alias("c_acctbal"))


# --- shapes of the wide table ---------------------------------------------------------------

_EVENT_TYPES = ("view", "click", "purchase", "error")


def _by_type(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("user_id % 7 <> 0 or event_type = 'view'")
    return e.groupBy("user_id").agg(*(S.sum_if(F.col("event_type") == t, F.col("value")).alias(t) for t in _EVENT_TYPES))


_BY_TYPE = f"w AS (SELECT user_id, {', '.join(f'''sum(CASE WHEN event_type = '{t}' THEN value ELSE 0 END) AS "{t}"''' for t in _EVENT_TYPES)} FROM events WHERE user_id % 7 <> 0 OR event_type = 'view' GROUP BY 1)"


@_query(f"""
WITH {_BY_TYPE} SELECT 'buying' AS grp, round(greatest(1.0, 100.0 * avg(CASE WHEN abs(purchase) > 0 THEN 1 ELSE 0 END)), 6) AS percent FROM w
UNION ALL SELECT 'looking', round(greatest(1.0, 100.0 * avg(CASE WHEN abs("view") + abs(click) > 0 THEN 1 ELSE 0 END)), 6) FROM w""")
def group_sparsity(spark, d):
    return _rounded(W.group_sparsity(_by_type(spark, d), {"buying": ["purchase"], "looking": ["view", "click"]}), 6)


@_query(f"""WITH {_BY_TYPE} SELECT ((abs(purchase) + abs(error) > 0)::INT + (abs("view") + abs(click) > 0)::INT)::INT AS active, count(*)::BIGINT AS n FROM w GROUP BY 1""")
def active_groups(spark, d):
    return W.co_occurrence(_by_type(spark, d), {"late": ["purchase", "error"], "early": ["view", "click"]})


@_query(f"""WITH {_BY_TYPE} SELECT user_id FROM w WHERE abs(coalesce(click, 0)) + abs(coalesce(purchase, 0)) > 0""")
def any_nonzero_mask(spark, d):
    return _by_type(spark, d).where(S.any_nonzero(["click", "purchase"])).select("user_id")


@_query("SELECT l_returnflag AS flag, l_linestatus AS status, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2")
def bulk_rename(spark, d):
    li = reporting.rename_columns(table(spark, d, "lineitem"), {"l_returnflag": "flag", "l_linestatus": "status", "not_there": "x"})
    return li.groupBy("flag", "status").agg(F.count("*").alias("n"))


@_query("SELECT o_orderkey, coalesce(TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_totalprice::VARCHAR END AS DOUBLE), -1) AS number FROM orders")
def number_or_default(spark, d):
    text = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.col("o_totalprice").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", S.number_or(text, -1.0).alias("number"))


# --- repair ---------------------------------------------------------------------------------

_RAW = """r AS (SELECT lower(to_hex(event_id)) || 'xyz-' AS guid, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value - 20 END AS power_watts, CASE WHEN event_id % 7 = 0 THEN 140.0 ELSE value - 3 END AS used_percent,
 CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id / 4.0 - 9 END AS num_items, CASE WHEN event_id % 4 = 0 THEN '  ' WHEN event_id % 4 = 1 THEN NULL ELSE ' ' || event_type END AS kind FROM events)"""


def _raw(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, d, "events").select(
        F.concat(F.lower(F.hex(i)), F.lit("xyz-")).alias("guid"),
        F.when(i % 5 != 0, F.col("value") - 20).alias("power_watts"),
        F.when(i % 7 == 0, 140.0).otherwise(F.col("value") - 3).alias("used_percent"),
        F.when(i % 6 != 0, i / 4.0 - 9).alias("num_items"),
        F.when(i % 4 == 0, "  ").when(i % 4 != 1, F.concat(F.lit(" "), F.col("event_type"))).alias("kind"),
    )


@_query(f"""
WITH {_RAW}, m AS (SELECT median(power_watts) AS p, median(used_percent) AS u, median(num_items) AS n FROM r)
SELECT regexp_replace(guid, '[^0-9a-f]', '', 'g') AS guid, round(greatest(coalesce(power_watts, p), 0), 6) AS power_watts, round(least(greatest(coalesce(used_percent, u), 0), 100), 6) AS used_percent,
 round_even(greatest(coalesce(num_items, n), 0), 0)::BIGINT AS num_items, CASE WHEN trim(coalesce(kind, 'Unknown')) = '' THEN 'Unknown' ELSE trim(coalesce(kind, 'Unknown')) END AS kind FROM r, m""")
def repaired_columns(spark, d):
    return _rounded(R.repair_columns(_raw(spark, d)), 6)


@_query(f"""
WITH {_RAW} SELECT guid, greatest(coalesce(power_watts, 0), 0) AS power_watts, 0.0::DOUBLE AS missing, coalesce(nullif(trim(kind), ''), 'Unknown') AS kind FROM r""")
def sanitized_records(spark, d):
    return Y.sanitize(_raw(spark, d), ["power_watts", "missing"], ["kind"]).select("guid", "power_watts", "missing", "kind")


@_query("SELECT count(*)::BIGINT AS rows, count(DISTINCT o_custkey)::BIGINT AS keys, 'o_orderkey,o_custkey' AS present, 'o_missing' AS missing FROM orders")
def table_check(spark, d):
    v = tables.validate(table(spark, d, "orders"), ["o_orderkey", "o_missing", "o_custkey"], "o_custkey")
    return v.select("rows", "keys", F.array_join("present", ",").alias("present"), F.array_join("missing", ",").alias("missing"))


@_query("""
WITH n AS (SELECT p_type, count(DISTINCT p_brand) AS n FROM part GROUP BY 1), t AS (SELECT p_type FROM n ORDER BY n DESC, p_type LIMIT 12)
SELECT CASE WHEN p_type IN (SELECT p_type FROM t) THEN p_type ELSE 'Other' END AS type, count(*)::BIGINT AS n FROM part GROUP BY 1""")
def top_by_support(spark, d):
    return Y.supported_or_other(table(spark, d, "part"), "p_type", "p_brand", top=12).groupBy(F.col("p_type").alias("type")).agg(F.count("*").alias("n"))


# --- scores of scores -----------------------------------------------------------------------

_EVEN, _ODD = "o_orderkey % 2 = 0", "o_orderkey % 2 = 1"


@_query(f"""
WITH a AS (SELECT o_orderpriority AS k, count(*) / (SELECT count(*) FROM orders WHERE {_EVEN}) AS p FROM orders WHERE {_EVEN} GROUP BY 1), b AS (SELECT o_orderpriority AS k, count(*) / (SELECT count(*) FROM orders WHERE {_ODD}) AS p FROM orders WHERE {_ODD} GROUP BY 1)
SELECT round(sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))), 8) AS frequency_l1 FROM a FULL JOIN b USING (k)""")
def frequency_distance(spark, d):
    o = table(spark, d, "orders")
    return _rounded(E.frequency_l1(o.where(_EVEN), o.where(_ODD), "o_orderpriority"), 8)


@_query(f"""
WITH m AS (SELECT o_custkey AS k, max(o_orderstatus) FILTER ({_EVEN}) AS a, max(o_orderstatus) FILTER ({_ODD}) AS b FROM orders GROUP BY 1)
SELECT round(count(CASE WHEN a = b THEN 1 END) / count(a), 8) AS categorical_accuracy FROM m WHERE a IS NOT NULL""")
def category_accuracy(spark, d):
    top = lambda half: table(spark, d, "orders").where(half).groupBy("o_custkey").agg(F.max("o_orderstatus").alias("s"))
    return _rounded(E.category_accuracy(top(_EVEN), top(_ODD), ["o_custkey"], "s"), 8)


_SCORED = {"pkg_power_by_country": "42", "ram_utilization_histogram": "42"}


def _scored(spark: SparkSession, d: str, seeds: tuple[str, ...] = ("42", "7")) -> DataFrame:
    """Metric rows of two queries over two pairs of halves; each pair is a method."""
    t, out = over_tables._Tables(spark, d), []
    for seed in seeds:
        first, second = benchmark.halves(t, seed)
        out += [E.metric_rows(q, benchmark.SPECS[q], *(over_tables.result(q, half).persist() for half in (first, second))).withColumn("method", F.lit("mst" if seed == "42" else "pertable")) for q in _SCORED]
    return reduce(DataFrame.unionByName, out)


def _scored_sql(seeds: tuple[str, ...] = ("42", "7")) -> str:
    parts = []
    for seed in seeds:
        for q in _SCORED:
            spec = benchmark.SPECS[q]
            method = "mst" if seed == "42" else "pertable"
            parts.append(f"SELECT '{q}' AS query, '{spec.kind}' AS query_type, '{method}' AS method, * FROM (WITH {scores._halves_sql(q, seed)} {scores._SCORE_SQL[spec.kind](spec)})")
    return "m AS (" + "\nUNION ALL ".join(parts) + ")"


_JUDGED = f"{_scored_sql()}, v AS (SELECT query, query_type, method, count(*)::BIGINT AS n_metrics, sum(passed::INT)::BIGINT AS n_passed, sum(passed::INT) / count(*) AS score FROM m GROUP BY ALL)"


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return E.judge(_scored(spark, d), ["method"])


@_query(f"WITH {_JUDGED} SELECT query, query_type, method, n_metrics, n_passed, round(score, 6) AS score, score >= 0.5 AS passed FROM v")
def judged_queries(spark, d):
    return _rounded(_judged(spark, d), 6)


@_query(f"WITH {_JUDGED} SELECT query, query_type, method, n_passed FROM v WHERE CASE query_type WHEN 'aggregate' THEN 'pertable' WHEN 'histogram' THEN 'pertable' END = method")
def routed_queries(spark, d):
    return E.route(_judged(spark, d)).select("query", "query_type", "method", "n_passed")


@_query(f"WITH {_JUDGED} SELECT query, round(max(score) FILTER (method = 'mst'), 6) AS mst, round(max(score) FILTER (method = 'pertable'), 6) AS pertable FROM v GROUP BY 1")
def method_matrix(spark, d):
    return _rounded(E.method_matrix(_judged(spark, d), ["mst", "pertable"]), 6)


@_query(f"WITH {_JUDGED} SELECT query_type, method, round(avg(score), 6) AS mean_score, round(avg((score >= 0.5)::INT), 6) AS pass_rate, count(*)::BIGINT AS queries FROM v GROUP BY 1, 2")
def scores_by_type(spark, d):
    return _rounded(E.type_averages(_judged(spark, d)), 6)


@_query(f"WITH {_scored_sql()}, t AS (SELECT unnest([0.01, 0.05, 0.1, 0.25]) AS threshold) SELECT threshold::DOUBLE AS threshold, round(avg((value <= threshold)::INT), 6) AS pass_rate FROM m, t WHERE metric_type = 'median_relative_error' GROUP BY 1")
def threshold_sensitivity(spark, d):
    return _rounded(E.sensitivity(_scored(spark, d), "median_relative_error", [0.01, 0.05, 0.1, 0.25]), 6)


# --- votes and fan-out ----------------------------------------------------------------------

@_query("""
WITH b AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) - min(c_acctbal) AS span FROM customer),
x AS (SELECT c_custkey AS id, least(greatest((c_acctbal - lo) / span, 0), 1) AS v, c_mktsegment AS s, c_nationkey AS n FROM customer, b),
d AS (SELECT r.id AS r, c.id AS c, round(abs(r.v - c.v) / 11 + (r.s <> c.s)::INT * 6.0 / 11 + (r.n <> c.n)::INT * 4.0 / 11, 9) AS d FROM x r, x c WHERE c.id % 20 = 0),
w AS (SELECT c, count(*) AS n FROM (SELECT c, row_number() OVER (PARTITION BY r ORDER BY d, c) AS place FROM d) WHERE place = 1 GROUP BY 1)
SELECT id AS candidate_id, coalesce(w.n, 0)::BIGINT AS votes FROM x LEFT JOIN w ON c = id WHERE id % 20 = 0""")
def device_votes(spark, d):
    x = table(spark, d, "customer").select(F.col("c_custkey").alias("candidate_id"), "c_acctbal", F.col("c_mktsegment").alias("chassistype"), F.col("c_nationkey").cast("string").alias("countryname_normalized"))
    votes = Y.device_votes(x.drop("candidate_id"), x.where("candidate_id % 20 = 0"), ["c_acctbal"], ["chassistype", "countryname_normalized"])
    return votes.select("candidate_id", F.col("votes").cast("long").alias("votes"))


def _poisson_sql(key: str, mean: float, seed: str) -> str:
    """As synthesis._how_many: the number of cumulative chances that the key's uniform exceeds, at least 1."""
    p, cdf, terms = math.exp(-mean), 0.0, []
    for k in range(int(mean + 10 * math.sqrt(mean) + 10)):
        cdf += p
        terms.append(f"(u > {cdf!r})::INT")
        p *= mean / (k + 1)
    return f"(SELECT greatest({' + '.join(terms)}, 1) FROM (SELECT {_uniform(key, seed + 'n')} AS u))"


@_query(f"""
WITH i AS (SELECT p_brand AS item, count(*)::DOUBLE AS w FROM part GROUP BY 1),
e AS (SELECT c_custkey, {_poisson_sql("c_custkey::VARCHAR", 4.0, "f")} AS n FROM customer),
r AS (SELECT c_custkey, n, item, row_number() OVER (PARTITION BY c_custkey ORDER BY -ln({_uniform("c_custkey::VARCHAR || ':' || item", "f")}) / w, item) AS place FROM e, i),
g AS (SELECT c_custkey, item, -ln({_uniform("c_custkey::VARCHAR || ':' || item", "fs")}) AS g FROM r WHERE place <= n)
SELECT c_custkey, item, round(g / sum(g) OVER (PARTITION BY c_custkey), 7) AS share FROM g""")
def weighted_fan_out(spark, d):
    items = table(spark, d, "part").groupBy(F.col("p_brand").alias("item")).agg(F.count("*").cast("double").alias("w"))
    return _rounded(Y.fan_out(table(spark, d, "customer"), "c_custkey", items, "item", "w", 4.0, "f"), 7)
