"""The 24 analytical queries, registered: reporting tables made of the driver's tables, and the SQL for both.

Customers, orders, line items, parts and events stand in for devices and their
telemetry. Each reporting table is a lazy DataFrame; a query builds only those
that it reads. The queries themselves are those of ``benchmark``; results are
rounded, since sums of doubles differ in their last bits between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..operators.wide import RECEIVED, SENT
from ..sources import reporting
from . import benchmark
from .catalog import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_BUILD: dict[str, tuple[Callable[[Callable[[str], DataFrame]], DataFrame], str]] = {}
CATEGORIES = list(reporting.WEB_CATEGORIES.items())
_METRIC_EVENTS = {"system_psys_rap_watts": "view", "system_pkg_C0": "click", "system_pkg_avg_freq_mhz": "purchase", "system_pkg_temp_centigrade": "error"}


def _made(name: str, sql: str):
    """Registers how a reporting table is made; of(name) gives a table of the driver's."""

    def register(build):
        _BUILD[name] = (build, sql)
        return build

    return register


@_made("system_sysinfo_unique_normalized", f"""
SELECT c_custkey AS guid, c_mktsegment AS chassistype, 'vendor ' || n_regionkey AS modelvendor_normalized, 'model ' || c_nationkey AS model_normalized, (c_custkey % 8 + 1) * 4 AS ram, 'os ' || c_custkey % 3 AS os,
 c_custkey % 16 + 1 AS "#ofcores", CASE WHEN c_acctbal > 5000 THEN '{benchmark.SERVER_MARK} E' ELSE 'Core' END AS cpuname, r_name AS countryname_normalized, c_mktsegment AS persona FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def _sysinfo(of, country="r_name"):
    c = of("customer").join(of("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    if country == "r_name":
        c = c.join(of("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    told = lambda what, x: F.concat(F.lit(what + " "), x.cast("string"))
    return c.select(
        F.col("c_custkey").alias("guid"), F.col("c_mktsegment").alias("chassistype"), told("vendor", F.col("n_regionkey")).alias("modelvendor_normalized"), told("model", F.col("c_nationkey")).alias("model_normalized"), ((F.col("c_custkey") % 8 + 1) * 4).alias("ram"),
        told("os", F.col("c_custkey") % 3).alias("os"), (F.col("c_custkey") % 16 + 1).alias("#ofcores"), F.when(F.col("c_acctbal") > 5000, benchmark.SERVER_MARK + " E").otherwise("Core").alias("cpuname"), F.col(country).alias("countryname_normalized"), F.col("c_mktsegment").alias("persona"),
    )


#: The same with nations for countries, for the queries that are registered by nation.
_BUILD["system_sysinfo_by_nation"] = (lambda of: _sysinfo(of, "n_name"), _BUILD["system_sysinfo_unique_normalized"][1].replace("r_name AS", "n_name AS").replace(" JOIN region ON n_regionkey = r_regionkey", ""))


@_made("system_cpu_metadata", "SELECT c_custkey AS guid, 'code ' || c_nationkey % 5 AS marketcodename, 'gen ' || c_custkey % 2 AS cpugen FROM customer")
def _cpu(of):
    return of("customer").select(F.col("c_custkey").alias("guid"), F.concat(F.lit("code "), (F.col("c_nationkey") % 5).cast("string")).alias("marketcodename"), F.concat(F.lit("gen "), (F.col("c_custkey") % 2).cast("string")).alias("cpugen"))


for _name, _event in _METRIC_EVENTS.items():
    _value = f"avg_{reporting.METRICS[_name][1]}"

    def _metric(of, event=_event, value=_value):
        return of("events").where(F.col("event_type") == event).select(F.col("user_id").alias("guid"), F.to_date("ts").alias("dt"), (F.col("event_id") % 7 + 1).alias("nrs"), F.col("value").alias(value))

    _BUILD[_name] = (_metric, f"SELECT user_id AS guid, CAST(ts AS DATE) AS dt, event_id % 7 + 1 AS nrs, value AS {_value} FROM events WHERE event_type = '{_event}'")


@_made("system_network_consumption", f"SELECT o_custkey AS guid, l_quantity::BIGINT AS nrs, CASE l_returnflag WHEN 'R' THEN '{RECEIVED}' WHEN 'A' THEN '{SENT}' ELSE 'other' END AS input_desc, l_extendedprice AS avg_bytes_sec FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _network(of):
    j = of("lineitem").join(of("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    desc = F.when(F.col("l_returnflag") == "R", RECEIVED).when(F.col("l_returnflag") == "A", SENT).otherwise("other")
    return j.select(F.col("o_custkey").alias("guid"), F.col("l_quantity").cast("long").alias("nrs"), desc.alias("input_desc"), F.col("l_extendedprice").alias("avg_bytes_sec"))


@_made("system_web_cat_usage", "SELECT user_id AS guid, CAST(ts AS DATE) AS dt, event_type AS browser, round(value * 1000)::BIGINT AS duration_ms, event_id % 28 AS category FROM events")
def _web(of):
    return of("events").select(F.col("user_id").alias("guid"), F.to_date("ts").alias("dt"), F.col("event_type").alias("browser"), F.round(F.col("value") * 1000).cast("long").alias("duration_ms"), (F.col("event_id") % 28).alias("category"))


@_made("system_web_cat_pivot_duration", "SELECT user_id AS guid, CAST(ts AS DATE) AS dt, " + ", ".join(f"sum(CASE WHEN event_id % 28 = {k} THEN round(value * 1000) ELSE 0 END) AS {c}" for k, (c, _) in enumerate(CATEGORIES)) + " FROM events GROUP BY 1, 2")
def _pivot(of):
    """By the builder of the reporting tables, from raw usage with parent and sub categories."""
    names = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(s if s is not None else "any").alias("s")) for _, (p, s) in CATEGORIES))
    raw = _web(of).withColumn("of", F.element_at(names, F.col("category").cast("int") + 1))
    return reporting.web_pivot({"web_cat_usage_v2": raw.select("guid", "dt", F.col("of.p").alias("parent_category"), F.col("of.s").alias("sub_category"), "duration_ms")})


@_made("system_memory_utilization", """
WITH m AS (SELECT user_id AS guid, CAST(ts AS DATE) AS dt, sum(event_id % 5 + 1) AS nrs, sum((event_id % 5 + 1) * value) / sum(event_id % 5 + 1) AS free FROM events GROUP BY 1, 2)
SELECT m.guid, dt, nrs, free AS avg_free_ram, r AS sysinfo_ram, r - free AS utilized_ram, round(100 * (r - free) / r) AS avg_percentage_used FROM m JOIN (SELECT c_custkey AS guid, (c_custkey % 8 + 1) * 4 * 1024 AS r FROM customer) c ON m.guid = c.guid""")
def _memory(of):
    raw = of("events").select(F.col("user_id").alias("guid"), F.to_date("ts").alias("dt"), (F.col("event_id") % 5 + 1).alias("sample_count"), F.col("value").alias("average"))
    return reporting.memory({"os_memsam_avail_percent": raw, "system_sysinfo_unique_normalized": _sysinfo(of).withColumn("ram", F.col("ram").cast("string"))})


@_made("system_hw_pkg_power", "SELECT o_custkey AS guid, o_orderkey % 5 + 1 AS nrs, o_totalprice / 1000 AS mean FROM orders")
def _power(of):
    return of("orders").select(F.col("o_custkey").alias("guid"), (F.col("o_orderkey") % 5 + 1).alias("nrs"), (F.col("o_totalprice") / 1000).alias("mean"))


@_made("system_batt_dc_events", "SELECT o_custkey AS guid, CAST(o_orderdate AS DATE) AS dt, count(*) AS num_power_ons, sum(o_totalprice / 1000) AS duration_mins FROM orders GROUP BY 1, 2")
def _battery(of):
    """By the builder of the reporting tables, from raw events with battery levels."""
    raw = of("orders").select(F.col("o_custkey").alias("guid"), F.col("o_orderdate").alias("power_on_dc_ts"), F.col("o_orderdate").alias("load_ts"), (F.col("o_totalprice") / 1000).alias("duration_mins"), F.lit(50).alias("power_on_battery_percent"), F.lit(-1).alias("power_off_battery_percent"))
    return reporting.battery({"batt_dc_events": raw})


@_made("system_on_off_suspend_time_day", "SELECT o_custkey AS guid, l_quantity AS on_time, l_tax * 100 AS off_time, l_discount * 100 AS mods_time, l_linenumber::DOUBLE AS sleep_time FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _times(of):
    j = of("lineitem").join(of("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.col("o_custkey").alias("guid"), F.col("l_quantity").alias("on_time"), (F.col("l_tax") * 100).alias("off_time"), (F.col("l_discount") * 100).alias("mods_time"), F.col("l_linenumber").cast("double").alias("sleep_time"))


@_made("system_mods_top_blocker_hist", "SELECT user_id AS guid, CAST(ts AS DATE) AS dt, 'blocker ' || event_id % 5 AS blocker_name, event_type AS blocker_type, 'level ' || event_id % 2 AS activity_level, value AS active_time_ms FROM events")
def _blockers(of):
    told = lambda what, x: F.concat(F.lit(what + " "), x.cast("string"))
    return of("events").select(F.col("user_id").alias("guid"), F.to_date("ts").alias("dt"), told("blocker", F.col("event_id") % 5).alias("blocker_name"), F.col("event_type").alias("blocker_type"), told("level", F.col("event_id") % 2).alias("activity_level"), F.col("value").alias("active_time_ms"))


@_made("system_os_codename_history", "SELECT o_custkey AS guid, CAST(CAST(o_orderdate AS DATE) + INTERVAL 9000 DAY AS DATE) AS min_ts, CAST(CAST(o_orderdate AS DATE) + INTERVAL 9400 DAY AS DATE) AS max_ts, o_orderpriority AS os_name, o_orderstatus AS os_codename FROM orders")
def _history(of):
    day = F.to_date("o_orderdate")
    return of("orders").select(F.col("o_custkey").alias("guid"), F.date_add(day, 9000).alias("min_ts"), F.date_add(day, 9400).alias("max_ts"), F.col("o_orderpriority").alias("os_name"), F.col("o_orderstatus").alias("os_codename"))


@_made("system_display_devices", "SELECT l_orderkey AS guid, l_returnflag AS connection_type, p_brand AS vendor_name, p_size AS resolution_heigth, l_linenumber AS resolution_width, sqrt(l_extendedprice) AS duration_ac, sqrt(l_quantity) AS duration_dc FROM lineitem JOIN part ON l_partkey = p_partkey")
def _displays(of):
    j = of("lineitem").join(of("part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.select(F.col("l_orderkey").alias("guid"), F.col("l_returnflag").alias("connection_type"), F.col("p_brand").alias("vendor_name"), F.col("p_size").alias("resolution_heigth"), F.col("l_linenumber").alias("resolution_width"), F.sqrt("l_extendedprice").alias("duration_ac"), F.sqrt("l_quantity").alias("duration_dc"))


@_made("system_userwait", f"""
SELECT l_orderkey AS guid, CASE WHEN l_suppkey % 10 = 0 THEN '{benchmark.NO_PROCESSES[1]}' ELSE 'process ' || l_suppkey END AS proc_name, CASE WHEN l_linenumber = 7 THEN '{benchmark.NO_EVENTS[0]}' ELSE l_linestatus END AS event_name,
 CASE l_returnflag WHEN 'A' THEN 'AC' WHEN 'N' THEN 'DC' ELSE 'UN' END AS acdc, round(l_extendedprice * 100)::BIGINT AS total_duration_ms, l_quantity::BIGINT AS number_of_instances FROM lineitem""")
def _userwait(of):
    process = F.when(F.col("l_suppkey") % 10 == 0, benchmark.NO_PROCESSES[1]).otherwise(F.concat(F.lit("process "), F.col("l_suppkey").cast("string")))
    acdc = F.when(F.col("l_returnflag") == "A", "AC").when(F.col("l_returnflag") == "N", "DC").otherwise("UN")
    return of("lineitem").select(F.col("l_orderkey").alias("guid"), process.alias("proc_name"), F.when(F.col("l_linenumber") == 7, benchmark.NO_EVENTS[0]).otherwise(F.col("l_linestatus")).alias("event_name"), acdc.alias("acdc"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("total_duration_ms"), F.col("l_quantity").cast("long").alias("number_of_instances"))


@_made("system_frgnd_apps_types", "SELECT l_suppkey AS guid, CASE WHEN p_size > 1 THEN p_type END AS app_type, CASE WHEN p_size = 2 THEN 'Desktop' ELSE p_brand END AS exe_name, l_extendedprice AS totalsecfocal_day, l_quantity::BIGINT AS lines_per_day FROM lineitem JOIN part ON l_partkey = p_partkey")
def _apps(of):
    j = of("lineitem").join(of("part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.select(F.col("l_suppkey").alias("guid"), F.when(F.col("p_size") > 1, F.col("p_type")).alias("app_type"), F.when(F.col("p_size") == 2, "Desktop").otherwise(F.col("p_brand")).alias("exe_name"), F.col("l_extendedprice").alias("totalsecfocal_day"), F.col("l_quantity").cast("long").alias("lines_per_day"))


@_made("system_mods_power_consumption", "SELECT user_id, event_type AS app_id, round(value * 100)::BIGINT AS total_power_consumption FROM events")
def _consumption(of):
    return of("events").select("user_id", F.col("event_type").alias("app_id"), F.round(F.col("value") * 100).cast("long").alias("total_power_consumption"))


class _Tables(dict):
    """Reporting tables by name, made where they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.of = lambda name: table(spark, sf_dir, name)

    def __missing__(self, name: str) -> DataFrame:
        self[name] = _BUILD[name][0](self.of)
        return self[name]


#: query -> the tables it reads and its SQL over them.
_SQL: dict[str, tuple[list[str], str]] = {}
_DIGITS: dict[str, int] = {}


def result(name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The query's result over reporting tables, doubles rounded as in its SQL."""
    out = benchmark.QUERIES[name](tables)
    return out.select(*(F.round(F.col(f"`{f.name}`"), _DIGITS[name]).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`") for f in out.schema))


def result_sql(name: str, devices: str | None = None, by_nation: bool = False) -> str:
    """The query's SQL with its reporting tables as common table expressions, those of some devices (a table of guid) only if named."""
    tables, sql = _SQL[name]
    made = lambda t: _BUILD["system_sysinfo_by_nation" if by_nation and t == _SYS else t][1]
    kept = lambda t: f"SELECT * FROM ({made(t)}) WHERE guid IN (SELECT guid FROM {devices})" if devices else made(t)
    return f"WITH {', '.join(f'{t} AS ({kept(t)})' for t in tables)}\n{sql}"


def _register(name: str, tables: str, sql: str, digits: int = 4, by_nation: bool = False) -> None:
    """sql: the query over the named reporting tables; by_nation: countries are the 25 nations, not the regions."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = _Tables(spark, sf_dir)
        if by_nation:
            t[_SYS] = t["system_sysinfo_by_nation"]
        return result(name, t)

    run.__name__ = name
    _SQL[name], _DIGITS[name] = (tables.split(), sql), digits
    QUERIES[name] = run
    ORACLE_SQL[name] = result_sql(name, by_nation=by_nation)


def _avg(w: str, x: str) -> str:
    return f"round(sum({w} * {x}) / sum({w}), 4)"


_SYS = "system_sysinfo_unique_normalized"
_parts = [(t, f"avg_{reporting.METRICS[t][1]}", k) for k, t in enumerate(_METRIC_EVENTS)]
_register("avg_platform_power_c0_freq_temp_by_chassis", " ".join([_SYS, *_METRIC_EVENTS]), f"""
SELECT chassistype, count(DISTINCT s.guid)::BIGINT AS number_of_systems, {", ".join(f"round(sum(wx{k}) / sum(w{k}), 4) AS {out}" for (_, _, k), out in zip(_parts, ("avg_psys_rap_watts", "avg_pkg_c0", "avg_freq_mhz", "avg_temp_centigrade"), strict=True))}
FROM {_SYS} s {" ".join(f"JOIN (SELECT guid, sum(nrs * {v}) AS wx{k}, sum(nrs) AS w{k} FROM {t} GROUP BY 1) t{k} ON s.guid = t{k}.guid" for t, v, k in _parts)} GROUP BY 1""")

_FLOW = f"SELECT guid, sum(nrs)::BIGINT AS nrs, sum(CASE WHEN input_desc = '{RECEIVED}' THEN avg_bytes_sec * nrs * 5 ELSE 0 END) AS received_bytes, sum(CASE WHEN input_desc = '{SENT}' THEN avg_bytes_sec * nrs * 5 ELSE 0 END) AS sent_bytes FROM system_network_consumption GROUP BY 1"
_register("server_exploration_1", f"{_SYS} system_network_consumption", f"""
SELECT f.guid, nrs, round(received_bytes, 4) AS received_bytes, round(sent_bytes, 4) AS sent_bytes, chassistype, modelvendor_normalized AS vendor, model_normalized AS model, ram, os, "#ofcores" AS number_of_cores
FROM ({_FLOW}) f JOIN {_SYS} s ON f.guid = s.guid WHERE nrs > 720 AND sent_bytes > received_bytes ORDER BY sent_bytes - received_bytes DESC""")
_register("server_class_network_consumption", f"{_SYS} system_network_consumption", f"""
SELECT CASE WHEN cpuname LIKE '%{benchmark.SERVER_MARK}%' THEN 'Server Class' ELSE 'Non-Server Class' END AS processor_class, os, count(*)::BIGINT AS number_of_systems, round(avg(received_bytes), 4) AS avg_bytes_received, round(avg(sent_bytes), 4) AS avg_bytes_sent
FROM ({_FLOW}) f JOIN {_SYS} s ON f.guid = s.guid GROUP BY 1, 2""")
_register("most_popular_browser_in_each_country_by_system_count", f"{_SYS} system_web_cat_usage", f"""
SELECT country, browser FROM (SELECT countryname_normalized AS country, browser, rank() OVER (PARTITION BY countryname_normalized ORDER BY count(DISTINCT s.guid) DESC) AS r FROM {_SYS} s JOIN system_web_cat_usage w ON s.guid = w.guid GROUP BY 1, 2) WHERE r = 1""", by_nation=True)
_register("popular_browsers_by_count_usage_percentage", "system_web_cat_usage", """
SELECT browser, round(100.0 * count(DISTINCT guid) / (SELECT count(DISTINCT guid) FROM system_web_cat_usage), 2) AS percent_systems, round(100.0 * count(*) / (SELECT count(*) FROM system_web_cat_usage), 2) AS percent_instances,
 round(100.0 * sum(duration_ms) / (SELECT sum(duration_ms) FROM system_web_cat_usage), 2) AS percent_duration FROM system_web_cat_usage GROUP BY 1""")
_all = " + ".join(f"sum({c})" for c, _ in CATEGORIES)
_register("persona_web_cat_usage_analysis", f"{_SYS} system_web_cat_pivot_duration", f"""
SELECT persona, count(DISTINCT p.guid)::BIGINT AS number_of_systems, count(*)::BIGINT AS days, {", ".join(f"round(100 * sum({c}) / nullif({_all}, 0), 3) AS {c}" for c, _ in CATEGORIES)} FROM system_web_cat_pivot_duration p JOIN {_SYS} s ON p.guid = s.guid GROUP BY 1""")
_register("ram_utilization_histogram", "system_memory_utilization", """
SELECT sysinfo_ram / 1024 AS ram_gb, count(DISTINCT guid)::BIGINT AS "count(DISTINCT guid)", round(sum(nrs * avg_percentage_used) / sum(nrs)) AS avg_percentage_used FROM system_memory_utilization WHERE avg_percentage_used > 0 GROUP BY sysinfo_ram""")
_register("pkg_power_by_country", f"{_SYS} system_hw_pkg_power", f"""
SELECT countryname_normalized, count(DISTINCT s.guid)::BIGINT AS number_of_systems, {_avg("nrs", "mean")} AS avg_pkg_power_consumed FROM system_hw_pkg_power p JOIN {_SYS} s ON p.guid = s.guid GROUP BY 1""", by_nation=True)
_register("battery_power_on_geographic_summary", f"{_SYS} system_batt_dc_events", f"""
SELECT countryname_normalized AS country, count(DISTINCT b.guid)::BIGINT AS number_of_systems, round(avg(num_power_ons), 4) AS avg_number_of_dc_powerons, round(avg(duration_mins), 4) AS avg_duration FROM system_batt_dc_events b JOIN {_SYS} s ON b.guid = s.guid GROUP BY 1 HAVING count(DISTINCT b.guid) > 100""")
_register("battery_on_duration_cpu_family_gen", "system_batt_dc_events system_cpu_metadata", """
SELECT marketcodename, cpugen, count(DISTINCT b.guid)::BIGINT AS number_of_systems, round(avg(duration_mins), 4) AS avg_duration_mins_on_battery FROM system_batt_dc_events b JOIN system_cpu_metadata m ON b.guid = m.guid GROUP BY 1, 2 HAVING count(DISTINCT b.guid) > 100""")
_four = ("on", "off", "mods", "sleep")
_register("on_off_mods_sleep_summary_by_cpu_marketcodename_gen", "system_on_off_suspend_time_day system_cpu_metadata", f""", g AS (SELECT marketcodename, cpugen, count(DISTINCT t.guid)::BIGINT AS number_of_systems, {", ".join(f"avg({x}_time) AS a_{x}" for x in _four)}, avg({" + ".join(f"{x}_time" for x in _four)}) AS a_total FROM system_on_off_suspend_time_day t JOIN system_cpu_metadata m ON t.guid = m.guid GROUP BY 1, 2)
SELECT marketcodename, cpugen, number_of_systems, {", ".join(f"round(a_{x}, 2) AS avg_{'modern_sleep' if x == 'mods' else x}_time" for x in (*_four, "total"))}, {", ".join(f"round(100.0 * a_{x} / a_total, 2) AS avg_pcnt_{x}_time" for x in _four)} FROM g WHERE number_of_systems > 100""")
_BLOCKED = "system_mods_top_blocker_hist b JOIN system_os_codename_history h ON b.guid = h.guid AND b.dt BETWEEN h.min_ts AND h.max_ts"
_register("mods_blockers_by_osname_and_codename", "system_mods_top_blocker_hist system_os_codename_history", f"""
SELECT os_name, os_codename, count(*)::BIGINT AS num_entries, count(DISTINCT b.guid)::BIGINT AS number_of_systems, round(count(*) / count(DISTINCT b.guid), 4) AS entries_per_system FROM {_BLOCKED} GROUP BY 1, 2""")
_register("top_mods_blocker_types_durations_by_osname_and_codename", "system_mods_top_blocker_hist system_os_codename_history", f"""
SELECT os_name, os_codename, blocker_name, blocker_type, activity_level, count(DISTINCT b.guid)::BIGINT AS number_of_clients, round(avg(active_time_ms) / 1000, 12) AS average_active_time_in_seconds, count(*)::BIGINT AS number_of_occurences FROM {_BLOCKED} GROUP BY 1, 2, 3, 4, 5""", 12)
_register("display_devices_connection_type_resolution_durations_ac_dc", "system_display_devices", """
SELECT connection_type, resolution_heigth::VARCHAR || 'x' || resolution_width::VARCHAR AS resolution, count(DISTINCT guid)::BIGINT AS number_of_systems, round(avg(duration_ac), 2) AS average_duration_on_ac_in_seconds, round(avg(duration_dc), 2) AS average_duration_on_dc_in_seconds
FROM system_display_devices GROUP BY 1, 2 HAVING count(DISTINCT guid) > 50""")
_register("display_devices_vendors_percentage", "system_display_devices", """
SELECT vendor_name, count(DISTINCT guid)::BIGINT AS number_of_systems, (SELECT count(DISTINCT guid) FROM system_display_devices)::BIGINT AS total_number_of_systems, round(100.0 * count(DISTINCT guid) / (SELECT count(DISTINCT guid) FROM system_display_devices), 2) AS percentage_of_systems FROM system_display_devices GROUP BY 1""")
_told = lambda names: ", ".join(f"'{n}'" for n in names)
_WAITS = f"waits AS (SELECT * FROM system_userwait WHERE proc_name NOT IN ({_told(benchmark.NO_PROCESSES)}) AND event_name NOT IN ({_told(benchmark.NO_EVENTS)}))"
_PER = "sum(total_duration_ms)::DOUBLE / 1000 / sum(number_of_instances)"
_register("userwait_top_10_wait_processes", "system_userwait", f"""
, {_WAITS} SELECT proc_name, round(v, 4) AS total_duration_sec_per_instance, rank FROM (SELECT proc_name, {_PER} AS v, CAST(rank() OVER (ORDER BY {_PER} DESC) AS BIGINT) AS rank FROM waits GROUP BY 1) WHERE rank <= 10""".lstrip())
_register("userwait_top_10_wait_processes_wait_type_ac_dc", "system_userwait", f"""
, {_WAITS} SELECT event_name, acdc, proc_name, round(v, 2) AS total_duration_sec_per_instance, rank FROM (SELECT event_name, acdc, proc_name, {_PER} AS v, CAST(rank() OVER (PARTITION BY event_name, acdc ORDER BY {_PER} DESC) AS BIGINT) AS rank FROM waits GROUP BY 1, 2, 3) WHERE rank <= 10""".lstrip())
_register("userwait_top_20_wait_processes_compare_ac_dc_unknown_durations", "system_userwait", f"""
, {_WAITS}, top AS (SELECT proc_name FROM (SELECT proc_name, rank() OVER (ORDER BY {_PER} DESC) AS r FROM waits GROUP BY 1 HAVING sum(number_of_instances) > 50 AND count(DISTINCT guid) > 20) WHERE r <= 20),
x AS (SELECT proc_name, acdc, round({_PER}, 2) AS v FROM waits WHERE proc_name IN (SELECT proc_name FROM top) GROUP BY 1, 2)
SELECT proc_name, {", ".join(f"max(CASE WHEN acdc = '{a}' THEN v ELSE 0 END) AS {n}_duration" for a, n in (("AC", "ac"), ("DC", "dc"), ("UN", "unknown")))} FROM x GROUP BY 1""".lstrip())


def _app_rank(measure: str, out: str, shown: str) -> str:
    return f"""
SELECT app_type, exe_name, {shown} AS {out}, rank FROM (SELECT app_type, exe_name, {measure} AS v, CAST(rank() OVER (PARTITION BY app_type ORDER BY {measure} DESC) AS BIGINT) AS rank FROM system_frgnd_apps_types WHERE lower(exe_name) NOT IN ({_told(benchmark.NO_APPS)}) AND app_type IS NOT NULL GROUP BY 1, 2) WHERE rank <= 10"""


_register("top_10_applications_by_app_type_ranked_by_focal_time", "system_frgnd_apps_types", _app_rank("avg(totalsecfocal_day)", "average_focal_sec_per_day", "round(v)"))
_register("top_10_applications_by_app_type_ranked_by_system_count", "system_frgnd_apps_types", _app_rank("count(DISTINCT guid)", "number_of_systems", "v::BIGINT"))
_register("top_10_applications_by_app_type_ranked_by_total_detections", "system_frgnd_apps_types", _app_rank("sum(lines_per_day)", "total_number_of_detections", "v::BIGINT"))
_register("ranked_process_classifications", "system_mods_power_consumption", """
SELECT user_id, v::BIGINT AS total_power_consumption, CAST(rank() OVER (ORDER BY v DESC) AS BIGINT) AS rnk FROM (SELECT user_id, sum(total_power_consumption) AS v FROM system_mods_power_consumption GROUP BY 1)""")
_register("top_10_processes_per_user_id_ranked_by_total_power_consumption", "system_mods_power_consumption", """
SELECT user_id, app_id, v::BIGINT AS total_power_consumption, rnk FROM (SELECT user_id, app_id, sum(total_power_consumption) AS v, CAST(rank() OVER (PARTITION BY user_id ORDER BY sum(total_power_consumption) DESC) AS BIGINT) AS rnk FROM system_mods_power_consumption GROUP BY 1, 2) WHERE rnk <= 10""")
_register("top_20_most_power_consuming_processes_by_avg_power_consumed", "system_mods_power_consumption", """
SELECT app_id, round(v, 4) AS total_power_consumption, rnk FROM (SELECT app_id, avg(total_power_consumption) AS v, CAST(rank() OVER (ORDER BY avg(total_power_consumption) DESC) AS BIGINT) AS rnk FROM system_mods_power_consumption GROUP BY 1) WHERE rnk <= 20""")
