"""Scores of results against results, registered: the reporting queries over two random halves of the devices.

One half stands for the real tables, the other for synthetic ones. There is a query
for each way of comparing, with the SQL that gives the same metric rows, and one for
the errors of a second pair of halves in parts of the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from . import benchmark, over_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_SEED = "42"
_DIGITS = 5


def _halves_sql(name: str, seed: str, tables: tuple[str, str] = ("real", "synth"), prefix: str = "") -> str:
    """Common table expressions: the result of each half of the devices."""
    order = f"md5(c_custkey::VARCHAR || ':{seed}'), c_custkey"
    placed = f"SELECT c_custkey AS guid, row_number() OVER (ORDER BY {order}) AS r, count(*) OVER () AS n FROM customer"
    return f"""{prefix}placed AS ({placed}), {prefix}one AS (SELECT guid FROM {prefix}placed WHERE r <= n // 2), {prefix}two AS (SELECT guid FROM {prefix}placed WHERE r > n // 2),
{tables[0]} AS ({over_tables.result_sql(name, f"{prefix}one")}),
{tables[1]} AS ({over_tables.result_sql(name, f"{prefix}two")})"""


def _same(keys: list[str]) -> str:
    return " AND ".join(f'r."{k}" IS NOT DISTINCT FROM s."{k}"' for k in keys)


def _listed(keys: list[str], side: str = "") -> str:
    return ", ".join(f'{side}"{k}"' for k in keys)


def _one(column: str, metric: str, value: str, good: str, rest: str) -> str:
    return f"SELECT '{column}' AS \"column\", '{metric}' AS metric_type, round({value}, {_DIGITS})::DOUBLE AS value, {good.format(v=value)} AS passed {rest}"


def _error(column: str) -> str:
    return f'CASE WHEN r."{column}" = 0 THEN CASE WHEN s."{column}" = 0 THEN 0.0 ELSE \'inf\'::DOUBLE END ELSE abs(s."{column}" - r."{column}") / abs(r."{column}") END'


def _jaccard_sql(keys: list[str], column: str, least: float, real: str, synth: str) -> str:
    either = f"(SELECT {_listed(keys)} FROM {real} UNION SELECT {_listed(keys)} FROM {synth})"
    both = f"(SELECT {_listed(keys)} FROM {real} INTERSECT SELECT {_listed(keys)} FROM {synth})"
    return _one(column, "jaccard", f"(SELECT count(*) FROM {both}) / (SELECT count(*) FROM {either})", f"{{v}} >= {least}", "")


def _aggregate_sql(spec: E.Spec, real: str = "real", synth: str = "synth") -> str:
    joined = f"FROM {real} r JOIN {synth} s ON {_same(spec.keys)}"
    rows = [_one(v, "median_relative_error", f"median({_error(v)})", f"{{v}} <= {E.RELATIVE_ERROR}", joined) for v in spec.values]
    return "\nUNION ALL ".join([_jaccard_sql(spec.keys, "group_coverage", E.GROUP_JACCARD, real, synth), *rows])


def _variation_sql(key: str, value: str, column: str, most: float, real: str = "real", synth: str = "synth") -> str:
    part = lambda side, t: f'coalesce({side}."{value}", 0) / (SELECT sum("{value}") FROM {t})'
    return _one(column, "total_variation", f"0.5 * sum(abs({part('r', real)} - {part('s', synth)}))", f"{{v}} <= {most}", f"FROM {real} r FULL JOIN {synth} s ON {_same([key])}")


def _distribution_sql(spec: E.Spec) -> str:
    return "\nUNION ALL ".join(_variation_sql(spec.keys[0], v, v, E.TOTAL_VARIATION) for v in spec.values)


def _histogram_sql(spec: E.Spec) -> str:
    joined = f"FROM real r JOIN synth s ON {_same(spec.keys)}"
    rows = [_one(v, "median_relative_error", f"median({_error(v)})", f"{{v}} <= {E.RELATIVE_ERROR}", joined) for v in spec.values]
    return "\nUNION ALL ".join([_variation_sql(spec.keys[0], spec.weight, f"{spec.weight}_distribution", E.TOTAL_VARIATION), *rows])


def _categorical_sql(spec: E.Spec) -> str:
    v = spec.values[0]
    return _one(v, "categorical_accuracy", f'count(CASE WHEN r."{v}" = s."{v}" THEN 1 END) / count(*)', f"{{v}} >= {E.CATEGORY_ACCURACY}", f"FROM real r LEFT JOIN synth s ON {_same(spec.keys)}")


def _numeric_sql(spec: E.Spec) -> str:
    groups, value = list(spec.groups), spec.values[0]
    by = f"PARTITION BY {_listed(groups)} " if groups else ""
    ranks = lambda c: f"rank() OVER ({by}ORDER BY {c}) + (count(*) OVER (PARTITION BY {_listed([*groups])}{', ' if groups else ''}{c}) - 1) / 2.0"
    named = "".join(f'r."{g}", ' for g in groups)
    rho = f"""SELECT {_listed(groups)}{', ' if groups else ''}coalesce(CASE WHEN isnan(corr(x, y)) THEN 0 ELSE corr(x, y) END, 0) AS rho, count(*) AS n FROM (SELECT {_listed(groups)}{', ' if groups else ''}{ranks('x')} AS x, {ranks('y')} AS y
FROM (SELECT {named}r."{value}"::DOUBLE AS x, s."{value}"::DOUBLE AS y FROM real r JOIN synth s ON {_same(spec.keys)})) {'GROUP BY ' + _listed(groups) if groups else ''}"""
    if not groups:
        return _jaccard_sql(spec.keys, "item_overlap", E.ITEM_JACCARD, "real", "synth") + "\nUNION ALL " + _one(f"{value}_rank_corr", "spearman_rho", "rho", f"{{v}} >= {E.SPEARMAN}", f"FROM ({rho}) WHERE n >= 2")
    sides = f'SELECT {", ".join(f"coalesce(r.{chr(34)}{g}{chr(34)}, s.{chr(34)}{g}{chr(34)}) AS {chr(34)}{g}{chr(34)}" for g in groups)}, r."{spec.keys[-1]}" AS a, s."{spec.keys[-1]}" AS b FROM real r FULL JOIN synth s ON {_same(spec.keys)}'
    per = f"SELECT count(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 END) / count(*) AS j FROM ({sides}) GROUP BY {_listed(groups)} HAVING count(a) > 0 AND count(b) > 0"
    return _one("item_overlap", "mean_jaccard", "avg(j)", f"{{v}} >= {E.ITEM_JACCARD}", f"FROM ({per})") + "\nUNION ALL " + _one(f"{value}_rank_corr", "mean_spearman_rho", "avg(rho)", f"{{v}} >= {E.SPEARMAN}", f"FROM ({rho}) WHERE n >= 2")


def _row_level_sql(spec: E.Spec) -> str:
    error = lambda a: f"abs((SELECT {a} FROM synth) - (SELECT {a} FROM real)) / abs((SELECT {a} FROM real))"
    rows = [_one("row_count", "relative_error", error("count(*)"), f"{{v}} <= {E.ROW_COUNT}", "")]
    rows += [_one(f"{v}_mean", "relative_error", error(f'avg("{v}")'), f"{{v}} <= {E.ROW_MEAN}", "") for v in spec.values]
    for k in spec.keys:
        n = lambda t, k=k: f'(SELECT "{k}", count(*) AS n FROM {t} WHERE "{k}" IS NOT NULL GROUP BY 1)'
        rows.append(_variation_sql(k, "n", f"{k}_distribution", E.ROW_CATEGORY, n("real"), n("synth")))
    return "\nUNION ALL ".join(rows)


_SCORE_SQL = {"aggregate": _aggregate_sql, "distribution": _distribution_sql, "histogram": _histogram_sql, "ranking_categorical": _categorical_sql, "ranking_numeric": _numeric_sql, "row_level": _row_level_sql}


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("column", "metric_type", F.round("value", _DIGITS).alias("value"), "passed")


def _register(query: str, name: str) -> None:
    spec = benchmark.SPECS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        first, second = benchmark.halves(over_tables._Tables(spark, sf_dir), _SEED)
        return _shown(E.metric_rows(name, spec, *(_decided(spec, over_tables.result(name, half)).persist() for half in (first, second))))

    run.__name__ = query
    QUERIES[query] = run
    halves = _halves_sql(name, _SEED, ("real", "synth"))
    if spec.kind == "ranking_categorical":
        halves = _halves_sql(name, _SEED, ("real_all", "synth_all")) + "".join(f', {t} AS (SELECT {_listed(spec.keys)}, min("{spec.values[0]}") AS "{spec.values[0]}" FROM {t}_all GROUP BY ALL)' for t in ("real", "synth"))
    ORACLE_SQL[query] = f"WITH {halves}\n{_SCORE_SQL[spec.kind](spec)}"


def _decided(spec: E.Spec, result: DataFrame) -> DataFrame:
    """Where several values share the first place, the smallest: which row of a result is the last differs between engines."""
    return result.groupBy(*spec.keys).agg(F.min(spec.values[0]).alias(spec.values[0])) if spec.kind == "ranking_categorical" else result


_register("score_aggregate", "pkg_power_by_country")
_register("score_aggregate_of_four_tables", "avg_platform_power_c0_freq_temp_by_chassis")
_register("score_aggregate_of_categories", "persona_web_cat_usage_analysis")
_register("score_distribution", "popular_browsers_by_count_usage_percentage")
_register("score_histogram", "ram_utilization_histogram")
_register("score_ranking_categorical", "most_popular_browser_in_each_country_by_system_count")
_register("score_ranking_numeric", "userwait_top_10_wait_processes")
_register("score_ranking_numeric_by_groups", "top_10_applications_by_app_type_ranked_by_total_detections")
_register("score_row_level", "server_exploration_1")


def normalized_error_of_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second pair of halves, as a method, in parts of what the first pair differs by."""
    name = "pkg_power_by_country"
    tables, spec = over_tables._Tables(spark, sf_dir), benchmark.SPECS[name]
    rows = []
    for seed in (_SEED, "7"):
        first, second = benchmark.halves(tables, seed)
        rows.append(E.metric_rows(name, spec, *(over_tables.result(name, half).persist() for half in (first, second))))
    got = E.normalized_rows(rows[1].withColumn("method", F.lit("halves")), rows[0])
    return got.select("column", "metric_type", F.round("normalized", 3).alias("normalized"))


QUERIES["normalized_error_of_halves"] = normalized_error_of_halves
_P = benchmark.SPECS["pkg_power_by_country"]
ORACLE_SQL["normalized_error_of_halves"] = f"""
WITH {_halves_sql("pkg_power_by_country", _SEED)}, {_halves_sql("pkg_power_by_country", "7", ("real7", "synth7"), "s7")},
{", ".join(f"{n} AS (SELECT \"column\", metric_type, CASE WHEN metric_type = 'jaccard' THEN 1 - value ELSE value END AS e FROM ({_aggregate_sql(_P, r, s).replace(f', {_DIGITS})', ', 15)')}))" for n, r, s in (("base", "real", "synth"), ("method", "real7", "synth7")))}
SELECT "column", metric_type, round(m.e / b.e, 3) AS normalized FROM method m JOIN base b USING ("column", metric_type) WHERE b.e >= 1e-8"""
