"""The generation plan, registered: strata, hints and accounting from the results of the reporting queries, on a fixed seed so that SQL gives the same noise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import privacy
from ..operators import marginal_graph as M
from ..operators import plan as G
from . import over_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TOTAL, EPSILON, DELTA, SEED = 5000, 3.5, 1e-5, "42"
_EACH = privacy.zcdp_rho(EPSILON, DELTA) / (len(G.PLAN) + 1)


def _results(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    tables = over_tables._Tables(spark, sf_dir)
    return lambda name: over_tables.result(name, tables)


def _uniform(key: str, seed: str) -> str:
    return f"(('0x' || substr(md5(({key}) || ':{seed}'), 1, 8))::BIGINT + 0.5) / 4294967296.0"


def gaussian_sql(key: str, seed: str) -> str:
    """Unit noise as semantics.gaussian draws it."""
    return f"sqrt(-2 * ln({_uniform(key, seed + 'a')})) * cos(2 * pi() * ({_uniform(key, seed + 'b')}))"


def generation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stratum and target of the plan."""
    p = G.build_plan(_results(spark, sf_dir), TOTAL, privacy.Ledger(EPSILON, DELTA), SEED)
    return p.select("active_group", "stratum", "n", F.round("n_public", 4).alias("n_public"), F.explode("numeric_targets").alias("field", "value")).withColumn("value", F.round("value", 3))


def _text(column: str) -> str:
    return f'coalesce("{column}"::VARCHAR, \'\')'


def _strata_sql(group: str, spec: G.PlanGroup) -> str:
    key = " || '|' || ".join(f"'{name}=' || {_text(c)}" for name, c in spec.constraints.items())
    needs = "".join(f' AND "{c}" IS NOT NULL AND "{c}"::VARCHAR <> \'{G.NOT_THERE}\'' for c in spec.needs)
    noise = lambda field: gaussian_sql(f"'{group}|' || stratum || '|{field}'", SEED)
    fields = []
    for field, m in spec.measures.items():
        v = f'"{m.source}"::DOUBLE' if isinstance(m.source, str) else f"{m.source}::DOUBLE"
        noisy = f"{v} * 0 + greatest({v} + sigma * ({noise(field)}) * {m.scale} / greatest(n_public, 1), 0)"
        fields.append((field, f"{v} * {m.scale}" if m.kind == "exact" else f"least({noisy}, 100)" if m.kind == "percent" else noisy))
    rows = " UNION ALL ".join(f"SELECT stratum, n_public, '{field}' AS field, {x} AS value FROM c" for field, x in fields)
    value = "value / sum(value) OVER (PARTITION BY stratum) * 100" if spec.whole else "value"
    return f"""(WITH x AS (SELECT *, {key} AS stratum FROM ({over_tables.result_sql(spec.query)}) WHERE true{needs}),
s AS (SELECT *, sqrt((SELECT count(*) FROM x) * {spec.releases} / (2.0 * {_EACH!r})) AS sigma FROM x),
c AS (SELECT *, greatest("{spec.count}" + sigma * ({noise('n')}), 0) AS n_public FROM s)
SELECT '{group}' AS active_group, stratum, n_public, field, {value} AS value FROM ({rows}) WHERE value IS NOT NULL)"""


def _plan_sql() -> str:
    per = privacy.allocate(TOTAL, {g: G.GROUP_SHARES[g] for g in G.PLAN})
    target = "CASE active_group " + " ".join(f"WHEN '{g}' THEN {t}" for g, t in per.items()) + " END"
    return f"""
WITH every AS ({" UNION ALL ".join(f"SELECT * FROM {_strata_sql(g, spec)}" for g, spec in G.PLAN.items())}),
d AS (SELECT DISTINCT active_group, stratum, n_public FROM every),
t AS (SELECT *, {target} AS t, count(*) OVER (PARTITION BY active_group) AS m, sum(n_public) OVER (PARTITION BY active_group) AS whole FROM d),
h AS (SELECT *, round(n_public / whole * greatest(t - m, 0), 9) AS share FROM t WHERE whole > 0),
b AS (SELECT *, floor(share) AS base, greatest(t - m, 0) - sum(floor(share)) OVER (PARTITION BY active_group) AS rest FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY active_group ORDER BY round(share - base, 9) DESC, stratum) AS place, row_number() OVER (PARTITION BY active_group ORDER BY n_public DESC, stratum) AS size FROM b),
n AS (SELECT active_group, stratum, (CASE WHEN t < m THEN CASE WHEN size <= t THEN 1 ELSE 0 END ELSE 1 + base + CASE WHEN place <= rest THEN 1 ELSE 0 END END)::BIGINT AS n FROM r)
SELECT active_group, stratum, n, round(n_public, 4) AS n_public, field, round(value, 3) AS value FROM every JOIN n USING (active_group, stratum) WHERE n > 0"""


def generation_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.build_hints(_results(spark, sf_dir), privacy.Ledger(EPSILON, DELTA), SEED).withColumn("share", F.round("share", 4))


def _hints_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT '{q}' AS hint, \"{name}\"::VARCHAR AS name, \"{count}\"::DOUBLE AS v, {1.0 if of is None else 100.0 / of}::DOUBLE AS unit FROM ({over_tables.result_sql(q)}) WHERE \"{name}\" IS NOT NULL" for q, (name, count, of) in G.HINTS.items())
    noise = gaussian_sql("hint || '|' || name", SEED)
    return f"""
WITH x AS ({rows}), s AS (SELECT *, sqrt((SELECT count(*) FROM x) / (2.0 * {_EACH!r})) AS sigma FROM x),
v AS (SELECT hint, name, unit, greatest(v + sigma * ({noise}) * unit, 0) AS v FROM s),
r AS (SELECT hint, name, CASE WHEN unit = 1 THEN 100.0 * v / sum(v) OVER (PARTITION BY hint) ELSE least(v, 100) END AS share, row_number() OVER (PARTITION BY hint ORDER BY v DESC, name) AS r FROM v)
SELECT hint, name, round(share, 4) AS share FROM r WHERE r <= {G.MOST_HINTS}"""


def plan_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = G.accounting(_results(spark, sf_dir), privacy.Ledger(EPSILON, DELTA))
    return a.select("name", "queries", F.round("sigma", 6).alias("sigma"), F.round("rho", 9).alias("rho"))


def _accounting_sql() -> str:
    needs = lambda spec: "".join(f' AND "{c}" IS NOT NULL AND "{c}"::VARCHAR <> \'{G.NOT_THERE}\'' for c in spec.needs)
    rows = [f"SELECT '{g}' AS name, count(*) * {spec.releases} AS k FROM ({over_tables.result_sql(spec.query)}) WHERE true{needs(spec)}" for g, spec in G.PLAN.items()]
    rows.append("SELECT 'hints', " + " + ".join(f'(SELECT count("{name}") FROM ({over_tables.result_sql(q)}))' for q, (name, _, _) in G.HINTS.items()))
    return f"SELECT name, k::BIGINT AS queries, round(sqrt(k / (2.0 * {_EACH!r})), 6) AS sigma, round({_EACH!r}::DOUBLE, 9) AS rho FROM ({' UNION ALL '.join(rows)})"


QUERIES |= {"generation_plan": generation_plan, "generation_hints": generation_hints, "plan_accounting": plan_accounting}
ORACLE_SQL |= {"generation_plan": _plan_sql(), "generation_hints": _hints_sql(), "plan_accounting": _accounting_sql()}


# --- a tree of two-way marginals ------------------------------------------------------------

_OF = ("chassistype", "countryname_normalized", "os", "marketcodename", "cpugen")
_GRAPH_EPSILON = 2.0


def _devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = over_tables._Tables(spark, sf_dir)
    return t["system_sysinfo_unique_normalized"].join(t["system_cpu_metadata"], "guid").select(*_OF)


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[M.Domain]]:
    df = _devices(spark, sf_dir)
    domains = M.frequent(df, list(_OF), 4)
    pairs = [(i, j) for i in range(len(domains)) for j in range(i + 1, len(domains))]
    counts = M.noisy(M.pair_counts(df, domains, pairs), privacy.zcdp_sigma(len(pairs), privacy.zcdp_rho(_GRAPH_EPSILON, DELTA)), SEED)
    return counts, domains


def pair_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The noisy two-way tables of all pairs of the devices' columns."""
    counts, domains = _graph(spark, sf_dir)
    names = F.array(*(F.lit(d.column) for d in domains))
    label = lambda k, code: F.element_at(F.element_at(F.array(*(F.array(*map(F.lit, (*d.values, M.OTHER))) for d in domains)), F.col(k) + 1), F.col(code) + 1)
    return counts.select(F.element_at(names, F.col("i") + 1).alias("left"), F.element_at(names, F.col("j") + 1).alias("right"), label("i", "a").alias("left_value"), label("j", "b").alias("right_value"), F.round("n", 4).alias("n"))


def marginal_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spanning tree of the greatest mutual information: step, parent, child, mi."""
    counts, domains = _graph(spark, sf_dir)
    weights = {(r["i"], r["j"]): r["mi"] for r in M.mutual_information(counts).collect()}
    tree = M.spanning_tree(weights, len(domains))
    return spark.createDataFrame([(k + 1, domains[p].column, domains[c].column, round(weights[min(p, c), max(p, c)], 5)) for k, (p, c) in enumerate(tree)], "step int, parent string, child string, mi double")


def _tables_sql() -> str:
    """n: i, j, a, b with noisy n; names: values of the codes."""
    sigma = privacy.zcdp_sigma(len(_OF) * (len(_OF) - 1) // 2, privacy.zcdp_rho(_GRAPH_EPSILON, DELTA))
    built = over_tables._BUILD
    cols = list(_OF)
    top = [f"SELECT {k} AS i, v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT {c}::VARCHAR AS v, count(*) AS m FROM d WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY m DESC, v LIMIT 4)" for k, c in enumerate(cols)]
    code = lambda k, c: f"coalesce((SELECT code FROM top WHERE i = {k} AND v = d.{c}::VARCHAR), (SELECT count(*) FROM top WHERE i = {k}))"
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    return f"""d AS (SELECT {", ".join(cols)} FROM ({built["system_sysinfo_unique_normalized"][1]}) s JOIN ({built["system_cpu_metadata"][1]}) m ON s.guid = m.guid),
top AS ({" UNION ALL ".join(top)}),
names AS (SELECT i, v, code FROM top UNION ALL SELECT i, '{M.OTHER}', count(*) FROM top GROUP BY i),
coded AS (SELECT {", ".join(f"{code(k, c)} AS c{k}" for k, c in enumerate(cols))} FROM d),
counted AS ({" UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, c{i} AS a, c{j} AS b, count(*) AS n FROM coded GROUP BY ALL" for i, j in pairs)}),
grid AS (SELECT p.i, p.j, x.code AS a, y.code AS b FROM (VALUES {", ".join(map(str, pairs))}) p(i, j) JOIN names x ON x.i = p.i JOIN names y ON y.i = p.j),
n AS (SELECT i, j, a, b, greatest(coalesce(n, 0) + {sigma!r} * ({gaussian_sql("i || ':' || j || ':' || a || ':' || b", SEED)}), 0) AS n FROM grid LEFT JOIN counted USING (i, j, a, b))"""


_NAMED = f"[{', '.join(repr(c) for c in _OF)}]"
QUERIES |= {"pair_tables": pair_tables, "marginal_tree": marginal_tree}
ORACLE_SQL["pair_tables"] = f"""
WITH {_tables_sql()}
SELECT {_NAMED}[n.i + 1] AS "left", {_NAMED}[n.j + 1] AS "right", x.v AS left_value, y.v AS right_value, round(n, 4) AS n FROM n JOIN names x ON x.i = n.i AND x.code = a JOIN names y ON y.i = n.j AND y.code = b"""
ORACLE_SQL["marginal_tree"] = f"""
WITH RECURSIVE {_tables_sql()},
s AS (SELECT *, sum(n) OVER (PARTITION BY i, j) AS w, sum(n) OVER (PARTITION BY i, j, a) AS l, sum(n) OVER (PARTITION BY i, j, b) AS r FROM n),
mi AS (SELECT i, j, sum(CASE WHEN n > 0 THEN n / w * ln(n * w / (l * r)) ELSE 0 END) AS mi FROM s GROUP BY 1, 2),
sides AS (SELECT i AS p, j AS c, mi FROM mi UNION ALL SELECT j, i, mi FROM mi),
tree AS (SELECT 0 AS step, [0] AS inside, NULL::INT AS p, NULL::INT AS c, NULL::DOUBLE AS mi
 UNION ALL
 SELECT step + 1, list_append(inside, c), p, c, mi FROM (SELECT t.step, t.inside, b.p, b.c, b.mi, row_number() OVER (ORDER BY round(b.mi, 9) DESC, b.p, b.c) AS place FROM tree t JOIN sides b ON list_contains(t.inside, b.p) AND NOT list_contains(t.inside, b.c)) WHERE place = 1)
SELECT step, {_NAMED}[p + 1] AS parent, {_NAMED}[c + 1] AS child, round(mi, 5) AS mi FROM tree WHERE step > 0"""
