"""Generation plans: noisy query results as strata, each with the number of candidates to make and what they should look like.

What turns a stratum into records is outside: a CandidateGenerator. The one here
draws from public marginals, so that everything runs without a network.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple, Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import privacy
from ..functions import semantics as S
from ..sources.reporting import WEB_CATEGORIES

#: Shares of the candidates by active group.
GROUP_SHARES = {"net": 25.0, "mem": 22.0, "browser_webcat": 20.0, "onoff": 18.0, "batt": 15.0, "hw": 1.0}


class Measure(NamedTuple):
    """A number that a stratum's records aim at: a column of the result, or a constant; kind is mean (range of one record's value), percent, or exact (a column that the stratum is named by, times scale; no noise)."""

    source: str | float
    kind: str
    scale: float


class PlanGroup(NamedTuple):
    """A query's result as strata. whole: the measures are shares, brought to 100 after noise. needs: columns that must not be null."""

    query: str
    count: str
    constraints: dict[str, str]
    measures: dict[str, Measure]
    whole: bool = False
    needs: tuple[str, ...] = ()

    @property
    def releases(self) -> int:
        """Noisy numbers for each row: its count, and all measures that take noise."""
        return 1 + sum(m.kind != "exact" for m in self.measures.values())


_SYSTEMS, _DAY = "number_of_systems", 86400.0
_CPU = {"cpucode": "marketcodename", "cpu_family": "cpugen"}
# Results that the plan is made of, record fields, their usual values and ranges.
PLAN: dict[str, PlanGroup] = {
    "batt": PlanGroup("battery_on_duration_cpu_family_gen", _SYSTEMS, _CPU, {"batt_duration_mins": Measure("avg_duration_mins_on_battery", "mean", 1000.0), "batt_num_power_ons": Measure(3.0, "mean", 50.0)}),
    "mem": PlanGroup(
        "ram_utilization_histogram",
        "count(DISTINCT guid)",
        {"ram": "ram_gb"},
        {"mem_avg_pct_used": Measure("avg_percentage_used", "mean", 100.0), "mem_nrs": Measure(5000.0, "mean", 50000.0), "mem_sysinfo_ram": Measure("ram_gb", "exact", 1024.0)},
    ),
    "onoff": PlanGroup(
        "on_off_mods_sleep_summary_by_cpu_marketcodename_gen",
        _SYSTEMS,
        _CPU,
        {f"onoff_{k}_time": Measure(f"avg_{c}_time", "mean", _DAY) for k, c in (("on", "on"), ("off", "off"), ("mods", "modern_sleep"), ("sleep", "sleep"))},
    ),
    "browser_webcat": PlanGroup("persona_web_cat_usage_analysis", _SYSTEMS, {"persona": "persona"}, {f"webcat_{c}": Measure(c, "percent", 100.0) for c in WEB_CATEGORIES}, whole=True, needs=(next(iter(WEB_CATEGORIES)),)),
    "hw": PlanGroup(
        "avg_platform_power_c0_freq_temp_by_chassis",
        _SYSTEMS,
        {"chassistype": "chassistype"},
        {
            "psys_rap_avg": Measure("avg_psys_rap_watts", "mean", 200.0),
            "pkg_c0_avg": Measure("avg_pkg_c0", "mean", 100.0),
            "avg_freq_avg": Measure("avg_freq_mhz", "mean", 5000.0),
            "temp_avg": Measure("avg_temp_centigrade", "mean", 100.0),
            **{f"{c}_nrs": Measure(500.0, "mean", 50000.0) for c in ("psys_rap", "pkg_c0", "avg_freq", "temp", "pkg_power")},
            "pkg_power_avg": Measure(10.0, "mean", 200.0),
        },
    ),
    "net": PlanGroup(
        "server_class_network_consumption",
        _SYSTEMS,
        {"_processor_class": "processor_class", "os": "os"},
        {"net_received_bytes": Measure("avg_bytes_received", "mean", 1e12), "net_sent_bytes": Measure("avg_bytes_sent", "mean", 1e12), "net_nrs": Measure(5000.0, "mean", 50000.0)},
        needs=("os",),
    ),
}
#: Results whose distributions are told beside the strata: query -> name, and the column of counts or of percents; devices that the percents are of.
HINTS = {"battery_power_on_geographic_summary": ("country", _SYSTEMS, None), "pkg_power_by_country": ("countryname_normalized", _SYSTEMS, None), "popular_browsers_by_count_usage_percentage": ("browser", "percent_systems", 1_000_000)}
MOST_HINTS = 15
#: Text that stands for a missing value in results.
NOT_THERE = "n/a"


def strata(group: str, result: DataFrame, keys: list[str], metrics: dict[str, tuple[str, float]], count: str, sigma: float, seed: str) -> DataFrame:
    """active_group, n, cat_constraints, numeric_targets of a query result's rows, with noise.

    metrics: column -> (kind, range); kind is "mean" (sensitivity range / n) or
    "percent" (100 / n). The count's own sensitivity is 1.
    """
    from .synthesis import noisy_count, noisy_mean, noisy_percentage

    key = F.concat_ws("\x1f", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    x = result.withColumn("__k", key)
    n = F.col(count).cast("double")
    targets = []
    for c, (kind, span) in metrics.items():
        v = F.col(c).cast("double")
        noisy = noisy_percentage(v, n, sigma, "__k", seed + c) if kind == "percent" else noisy_mean(v, n, span, sigma, "__k", seed + c)
        targets += [F.lit(c), noisy]
    cats = [y for k in keys for y in (F.lit(k), F.col(k).cast("string"))]
    return x.select(F.lit(group).alias("active_group"), noisy_count(n, sigma, "__k", seed).alias("n"), F.create_map(*cats).alias("cat_constraints"), F.create_map(*targets).alias("numeric_targets"))


def allocate(plan: DataFrame, total: int, shares: dict[str, float] = GROUP_SHARES) -> DataFrame:
    """Counts in whole numbers: the groups' shares of the total, within a group in proportion, at least 1 a stratum."""
    per = privacy.allocate(total, shares)
    sums = plan.groupBy("active_group").agg(F.sum("n").alias("__all"))
    part = F.lit(0)
    for g, k in per.items():
        part = F.when(F.col("active_group") == g, F.lit(k)).otherwise(part)
    scaled = F.greatest(F.lit(1), F.round(F.coalesce(S.ratio("n", "__all"), F.lit(0.0)) * part)).cast("long")
    return plan.join(F.broadcast(sums), "active_group").withColumn("n", scaled).drop("__all")  # one row a group


def noise_for(rows_by_group: dict[str, int], numeric_by_group: dict[str, int], epsilon: float, delta: float) -> dict[str, float]:
    """Noise of each group's queries when the groups share the budget evenly."""
    rho = privacy.zcdp_rho(epsilon, delta) / max(len(rows_by_group), 1)
    return {g: privacy.zcdp_sigma(k, rho) for g, k in privacy.query_count(rows_by_group, numeric_by_group).items()}


def _stratum(spec: PlanGroup) -> Column:
    return F.concat_ws("|", *(F.concat(F.lit(f"{name}="), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for name, c in spec.constraints.items()))


def _told(result: DataFrame, needs: tuple[str, ...]) -> DataFrame:
    for c in needs:
        result = result.where(F.col(f"`{c}`").isNotNull() & (F.col(f"`{c}`").cast("string") != NOT_THERE))
    return result


def _with_sigma(rows: DataFrame, releases: int, rho: float) -> DataFrame:
    """rows with sigma: the noise of each of the numbers that all rows release, if together they are to cost rho."""
    k = rows.agg((F.count("*") * releases).cast("double").alias("__k"))
    return rows.crossJoin(F.broadcast(k)).withColumn("sigma", F.sqrt(F.col("__k") / (2.0 * rho))).drop("__k")  # one row


def _numbers(group: str, spec: PlanGroup, result: DataFrame) -> DataFrame:
    """active_group, stratum, cats, whole, field, kind, scale, v: a row for each number of each stratum, its count (field n) among them."""
    one = lambda field, kind, scale, v: F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), F.lit(float(scale)).alias("scale"), v.cast("double").alias("v"))
    number = [one("n", "count", 1.0, F.col(f"`{spec.count}`"))]
    number += [one(f, m.kind, m.scale, F.col(f"`{m.source}`") if isinstance(m.source, str) else F.lit(float(m.source))) for f, m in spec.measures.items()]
    cats = [y for name, c in spec.constraints.items() for y in (F.lit(name), F.col(f"`{c}`").cast("string"))]
    x = _told(result, spec.needs).select(F.lit(group).alias("active_group"), _stratum(spec).alias("stratum"), F.create_map(*cats).alias("cats"), F.lit(spec.whole).alias("whole"), F.explode(F.array(*number)).alias("x"))
    return x.select("active_group", "stratum", "cats", "whole", "x.*")


def noisy_strata(numbers: DataFrame, rho: float, seed: str | None) -> DataFrame:
    """active_group, stratum, n_public, cat_constraints, numeric_targets, sigma of _numbers. Each group's noisy numbers together cost rho. The noise of means is scaled by the noisy count, so it tells nothing that was not released."""
    k = numbers.groupBy("active_group").agg(F.sqrt(F.count(F.when(F.col("kind") != "exact", 1)) / (2.0 * rho)).alias("sigma"))
    x = numbers.join(F.broadcast(k), "active_group")  # a row a group
    x = x.withColumn("z", S.gaussian(F.concat_ws("|", "active_group", "stratum", "field"), seed, F.col("sigma")))
    of = Window.partitionBy("active_group", "stratum")
    x = x.withColumn("n_public", F.max(F.when(F.col("kind") == "count", F.greatest(F.col("v") + F.col("z"), F.lit(0.0)))).over(of))
    noisy = F.greatest(F.col("v") + F.col("z") * F.col("scale") / F.greatest(F.col("n_public"), F.lit(1.0)), F.lit(0.0))
    value = F.when(F.col("kind") == "exact", F.col("v") * F.col("scale")).when(F.col("v").isNull(), None).when(F.col("kind") == "percent", F.least(noisy, F.lit(100.0))).otherwise(noisy)
    x = x.withColumn("value", F.when(F.col("kind") != "count", value))
    whole = F.sum("value").over(of)
    x = x.withColumn("value", F.when(F.col("whole") & (whole > 0), F.col("value") / F.nullif(whole, F.lit(0.0)) * 100.0).otherwise(F.col("value")))
    pairs = F.collect_list(F.when(F.col("value").isNotNull(), F.struct("field", "value")))
    g = x.groupBy("active_group", "stratum").agg(F.max("n_public").alias("n_public"), F.first("cats").alias("cat_constraints"), F.map_from_entries(pairs).alias("numeric_targets"), F.max("sigma").alias("sigma"))
    return g


def whole_counts(strata: DataFrame, targets: dict[str, int], group: str = "active_group", count: str = "n_public", order: str = "stratum") -> DataFrame:
    """strata with n: whole numbers that add up to each group's target, one for each stratum and the rest in proportion to the counts, by largest remainders.

    With fewer to give than strata, the largest have one each and the others go; so does a group
    without a count. A group has a row for each stratum here.
    """
    target = F.lit(0)
    for g, t in targets.items():
        target = F.when(F.col(group) == g, F.lit(t)).otherwise(target)
    of = Window.partitionBy(group)
    x = strata.select("*", F.greatest(F.col(count), F.lit(0.0)).alias("__c"), target.alias("__t"))
    x = x.select("*", F.sum("__c").over(of).alias("__all"), F.count("*").over(of).alias("__m"))
    extra = F.greatest(F.col("__t") - F.col("__m"), F.lit(0))
    x = x.where("__all > 0").select("*", extra.alias("__extra"), F.round(F.col("__c") / F.col("__all") * extra, 9).alias("__share"))
    base = F.floor("__share")
    largest = F.row_number().over(of.orderBy(F.desc(F.round(F.col("__share") - base, 9)), order))
    size = F.row_number().over(of.orderBy(F.desc("__c"), order))
    n = F.when(F.col("__t") < F.col("__m"), F.when(size <= F.col("__t"), 1).otherwise(0)).otherwise(1 + base + F.when(largest <= F.col("__extra") - F.sum(base).over(of), 1).otherwise(0))
    return x.select(*strata.columns, n.cast("long").alias("n")).where("n > 0")


def build_plan(results: Callable[[str], DataFrame], total: int, ledger: privacy.Ledger, seed: str | None = None, groups: dict[str, PlanGroup] = PLAN, shares: dict[str, float] = GROUP_SHARES) -> DataFrame:
    """active_group, stratum, n, cat_constraints, numeric_targets, sigma, n_public: the strata of all groups, total records in all.

    The ledger is charged before anything is released: an even part of its whole budget for each group
    and one for the hints. A ledger that cannot pay that refuses; drawing again needs another one.
    """
    each = ledger.rho / (len(groups) + 1)
    ledger.charge(*((g, each) for g in groups))
    numbers = reduce(DataFrame.unionByName, (_numbers(g, spec, results(spec.query)) for g, spec in groups.items()))
    return whole_counts(noisy_strata(numbers, each, seed), privacy.allocate(total, {g: shares[g] for g in groups}))


def build_hints(results: Callable[[str], DataFrame], ledger: privacy.Ledger, seed: str | None = None, groups: dict[str, PlanGroup] = PLAN) -> DataFrame:
    """hint, name, share: noisy shares (percent) of countries and browsers, the largest MOST_HINTS of each. All hints share one part of the budget."""
    each = ledger.rho / (len(groups) + 1)
    ledger.charge(("hints", each))
    parts = []
    for query, (name, count, of) in HINTS.items():
        r = results(query).select(F.lit(query).alias("hint"), F.col(f"`{name}`").cast("string").alias("name"), F.col(f"`{count}`").cast("double").alias("v"), F.lit(1.0 if of is None else 100.0 / of).alias("unit"))
        parts.append(r.where("name is not null"))
    x = _with_sigma(reduce(DataFrame.unionByName, parts), 1, each)
    x = x.withColumn("v", F.greatest(F.col("v") + S.gaussian(F.concat_ws("|", "hint", "name"), seed, F.col("sigma")) * F.col("unit"), F.lit(0.0)))
    of = Window.partitionBy("hint")
    share = F.when(F.col("unit") == 1.0, 100.0 * S.ratio("v", F.sum("v").over(of))).otherwise(F.least("v", F.lit(100.0)))
    x = x.withColumn("share", share).withColumn("__r", F.row_number().over(of.orderBy(F.desc("v"), "name")))
    return x.where(F.col("__r") <= MOST_HINTS).select("hint", "name", "share")


def accounting(results: Callable[[str], DataFrame], ledger: privacy.Ledger, groups: dict[str, PlanGroup] = PLAN) -> DataFrame:
    """name, queries, sigma, rho: what the plan releases of each group, and of the hints."""
    each = ledger.rho / (len(groups) + 1)
    rows = [_told(results(spec.query), spec.needs).agg((F.count("*") * spec.releases).alias("queries")).select(F.lit(g).alias("name"), "queries") for g, spec in groups.items()]
    hints = reduce(DataFrame.unionByName, (results(q).where(F.col(f"`{name}`").isNotNull()).agg(F.count("*").alias("queries")) for q, (name, _, _) in HINTS.items()))
    rows.append(hints.agg(F.sum("queries").alias("queries")).select(F.lit("hints").alias("name"), "queries"))
    x = reduce(DataFrame.unionByName, rows)
    return x.select("name", F.col("queries").cast("long").alias("queries"), F.sqrt(F.col("queries") / (2.0 * each)).alias("sigma"), F.lit(each).alias("rho"))


class CandidateGenerator(Protocol):
    def generate(self, plan: DataFrame) -> DataFrame: ...


class SampledGenerator:
    """Candidates of each stratum: its categories, and its targets spread log-normally."""

    def __init__(self, numeric: list[str], categories: list[str], seed: str, spread: float = 0.25):
        self.numeric, self.categories, self.seed, self.spread = numeric, categories, seed, spread

    def generate(self, plan: DataFrame) -> DataFrame:
        x = plan.withColumn("stratum", F.xxhash64("active_group", F.map_values("cat_constraints"), F.map_keys("cat_constraints")))
        x = x.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).withColumn("k", F.concat_ws(":", F.col("stratum").cast("string"), F.col("i").cast("string")))
        num = [(F.coalesce(F.element_at("numeric_targets", c), F.lit(0.0)) * F.exp(S.gaussian("k", self.seed + c, self.spread) - self.spread**2 / 2)).alias(c) for c in self.numeric]
        cat = [F.coalesce(F.element_at("cat_constraints", c), F.lit("Unknown")).alias(c) for c in self.categories]
        return x.select(F.abs(F.xxhash64("k")).alias("candidate_id"), F.format_string("pe_%s", F.substring(F.md5(F.col("k").cast("binary")), 1, 12)).alias("guid"), *cat, *num)

    def vary(self, parents: DataFrame, times: int, round_: int) -> DataFrame:
        """So many children a parent, each near it."""
        x = parents.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("k", F.concat_ws(":", F.col("candidate_id").cast("string"), F.col("i").cast("string"), F.lit(str(round_))))
        num = {c: F.col(c) * F.exp(S.gaussian("k", self.seed + c, self.spread / math.sqrt(1 + round_))) for c in self.numeric}
        return x.withColumns(num).withColumn("candidate_id", F.abs(F.xxhash64("k"))).drop("i", "k")
