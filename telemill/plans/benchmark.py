"""The 24 analytical queries over the reporting tables.

Each takes the reporting tables by name (DataFrames) and returns its result,
lazily. Aggregates go below the joins wherever the join is on the device alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..operators.evaluate import Spec
from ..operators.ranges import join_periods
from ..operators.ranks import ranked_all
from ..operators.wide import RECEIVED, SENT
from ..sources.reporting import WEB_CATEGORIES
from .catalog import ranked, top_with_ties

Tables = dict[str, DataFrame]
QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
#: Their only source is a stub, so their results say nothing.
INFEASIBLE = ("ranked_process_classifications", "top_10_processes_per_user_id_ranked_by_total_power_consumption", "top_20_most_power_consuming_processes_by_avg_power_consumed")

# Pseudo-processes and events that the wait queries leave out.
NO_PROCESSES = ("DUMMY_PROCESS", "DESKTOP", "explorer.exe", "RESTRICTED PROCESS", "UNKNOWN")
NO_EVENTS = ("TOTAL_NON_WAIT_EVENTS", "TOTAL_DISCARDED_WAIT_EVENTS")
NO_APPS = ("restricted process", "desktop")
#: A processor name that holds this is of the server class.
SERVER_MARK = "Xeon"


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _sysinfo(t: Tables) -> DataFrame:
    return t["system_sysinfo_unique_normalized"]


@_query
def avg_platform_power_c0_freq_temp_by_chassis(t):
    j = _sysinfo(t).select("guid", "chassistype")
    parts = (("system_psys_rap_watts", "avg_psys_rap_watts", "avg_psys_rap_watts"), ("system_pkg_C0", "avg_pkg_c0", "avg_pkg_c0"), ("system_pkg_avg_freq_mhz", "avg_avg_freq_mhz", "avg_freq_mhz"), ("system_pkg_temp_centigrade", "avg_temp_centigrade", "avg_temp_centigrade"))
    for i, (name, value, _) in enumerate(parts):
        j = j.join(t[name].groupBy("guid").agg(F.sum(F.col("nrs") * F.col(value)).alias(f"wx{i}"), F.sum("nrs").alias(f"w{i}")), "guid")
    return j.groupBy("chassistype").agg(F.count_distinct("guid").alias("number_of_systems"), *(S.ratio(F.sum(f"wx{i}"), F.sum(f"w{i}")).alias(out) for i, (_, _, out) in enumerate(parts)))


def _traffic(t: Tables) -> DataFrame:
    flow = F.col("avg_bytes_sec") * F.col("nrs").cast("double") * 5
    return t["system_network_consumption"].groupBy("guid").agg(F.sum("nrs").alias("nrs"), S.sum_if(F.col("input_desc") == RECEIVED, flow).alias("received_bytes"), S.sum_if(F.col("input_desc") == SENT, flow).alias("sent_bytes"))


@_query
def server_exploration_1(t):
    j = _traffic(t).where("nrs > 720 and sent_bytes > received_bytes").join(_sysinfo(t), "guid")
    return j.orderBy(F.desc(F.col("sent_bytes") - F.col("received_bytes"))).select("guid", "nrs", "received_bytes", "sent_bytes", "chassistype", F.col("modelvendor_normalized").alias("vendor"), F.col("model_normalized").alias("model"), "ram", "os", F.col("`#ofcores`").alias("number_of_cores"))


@_query
def server_class_network_consumption(t):
    kind = F.when(F.col("cpuname").contains(SERVER_MARK), "Server Class").otherwise("Non-Server Class")
    j = _traffic(t).join(_sysinfo(t), "guid")
    return j.groupBy(kind.alias("processor_class"), "os").agg(F.count("*").alias("number_of_systems"), F.avg("received_bytes").alias("avg_bytes_received"), F.avg("sent_bytes").alias("avg_bytes_sent"))


@_query
def most_popular_browser_in_each_country_by_system_count(t):
    used = t["system_web_cat_usage"].select("guid", "browser").distinct().join(_sysinfo(t), "guid")
    n = used.groupBy(F.col("countryname_normalized").alias("country"), "browser").agg(F.count("*").alias("n"))
    return ranked(n, "n", ["country"], 1).select("country", "browser").orderBy("country")


@_query
def popular_browsers_by_count_usage_percentage(t):
    web = t["system_web_cat_usage"]
    aggs = lambda p: (F.count_distinct("guid").alias(f"{p}u"), F.count("*").alias(f"{p}n"), F.sum(F.col("duration_ms").cast("double")).alias(f"{p}v"))
    j = web.groupBy("browser").agg(*aggs("p")).crossJoin(F.broadcast(web.agg(*aggs("w"))))  # one row of totals
    return j.select("browser", *(S.percent(F.col(f"p{k}"), F.col(f"w{k}")).alias(n) for k, n in (("u", "percent_systems"), ("n", "percent_instances"), ("v", "percent_duration"))))


@_query
def persona_web_cat_usage_analysis(t):
    pivot = t["system_web_cat_pivot_duration"]
    cats = [c for c in pivot.columns if c not in ("guid", "dt")]
    g = pivot.join(_sysinfo(t).select("guid", "persona"), "guid").groupBy("persona").agg(F.count_distinct("guid").alias("number_of_systems"), F.count("*").alias("days"), *(F.sum(c).alias(c) for c in cats))
    whole = S.total(F.col(c) for c in cats)
    return g.select("persona", "number_of_systems", "days", *(F.round(100 * S.ratio(F.col(c), whole), 3).alias(c) for c in cats))


@_query
def ram_utilization_histogram(t):
    m = t["system_memory_utilization"].where("avg_percentage_used > 0")
    g = m.groupBy("sysinfo_ram").agg(F.count_distinct("guid").alias("count(DISTINCT guid)"), F.round(S.wavg("nrs", "avg_percentage_used")).alias("avg_percentage_used"))
    return g.orderBy("sysinfo_ram").select((F.col("sysinfo_ram") / 1024).alias("ram_gb"), "`count(DISTINCT guid)`", "avg_percentage_used")


@_query
def pkg_power_by_country(t):
    p = t["system_hw_pkg_power"].groupBy("guid").agg(F.sum(F.col("nrs") * F.col("mean")).alias("wx"), F.sum("nrs").alias("w"))
    g = p.join(_sysinfo(t), "guid").groupBy("countryname_normalized").agg(F.count("*").alias("number_of_systems"), S.ratio(F.sum("wx"), F.sum("w")).alias("avg_pkg_power_consumed"))
    return g.orderBy(F.desc("avg_pkg_power_consumed"))


@_query
def battery_power_on_geographic_summary(t):
    j = t["system_batt_dc_events"].join(_sysinfo(t), "guid")
    g = j.groupBy(F.col("countryname_normalized").alias("country")).agg(F.count_distinct("guid").alias("number_of_systems"), F.avg("num_power_ons").alias("avg_number_of_dc_powerons"), F.avg("duration_mins").alias("avg_duration"))
    return g.where("number_of_systems > 100").orderBy(F.desc("avg_number_of_dc_powerons"))


@_query
def battery_on_duration_cpu_family_gen(t):
    j = t["system_batt_dc_events"].join(t["system_cpu_metadata"], "guid")
    return j.groupBy("marketcodename", "cpugen").agg(F.count_distinct("guid").alias("number_of_systems"), F.avg("duration_mins").alias("avg_duration_mins_on_battery")).where("number_of_systems > 100")


@_query
def on_off_mods_sleep_summary_by_cpu_marketcodename_gen(t):
    times = ("on", "off", "mods", "sleep")
    j = t["system_on_off_suspend_time_day"].join(t["system_cpu_metadata"], "guid").withColumn("total_time", S.total(F.col(f"{x}_time") for x in times))
    g = j.groupBy("marketcodename", "cpugen").agg(F.count_distinct("guid").alias("number_of_systems"), *(F.avg(f"{x}_time").alias(x) for x in (*times, "total"))).where("number_of_systems > 100")
    shown = [F.round(x, 2).alias(f"avg_{'modern_sleep' if x == 'mods' else x}_time") for x in (*times, "total")]
    return g.select("marketcodename", "cpugen", "number_of_systems", *shown, *(S.percent(F.col(x), F.col("total")).alias(f"avg_pcnt_{x}_time") for x in times))


def _blocked(t: Tables) -> DataFrame:
    """Blocker events under the system's name at the time: by device and stretch of time, so a device with very many events is many groups."""
    b, h = t["system_mods_top_blocker_hist"], t["system_os_codename_history"].withColumnRenamed("guid", "__of")
    return join_periods(b, "dt", ["guid"], h, "min_ts", "max_ts", ["__of"], width=30.0).drop("__of")


@_query
def mods_blockers_by_osname_and_codename(t):
    g = _blocked(t).groupBy("os_name", "os_codename").agg(F.count("*").alias("num_entries"), F.count_distinct("guid").alias("number_of_systems"))
    return g.withColumn("entries_per_system", S.ratio("num_entries", "number_of_systems"))


@_query
def top_mods_blocker_types_durations_by_osname_and_codename(t):
    g = _blocked(t).groupBy("os_name", "os_codename", "blocker_name", "blocker_type", "activity_level")
    return g.agg(F.count_distinct("guid").alias("number_of_clients"), (F.avg("active_time_ms") / 1000).alias("average_active_time_in_seconds"), F.count("*").alias("number_of_occurences"))


@_query
def display_devices_connection_type_resolution_durations_ac_dc(t):
    size = F.concat_ws("x", F.col("resolution_heigth").cast("string"), F.col("resolution_width").cast("string"))
    g = t["system_display_devices"].groupBy("connection_type", size.alias("resolution")).agg(F.count_distinct("guid").alias("number_of_systems"), F.round(F.avg("duration_ac"), 2).alias("average_duration_on_ac_in_seconds"), F.round(F.avg("duration_dc"), 2).alias("average_duration_on_dc_in_seconds"))
    return g.where("number_of_systems > 50").orderBy("connection_type", F.desc("number_of_systems"))


@_query
def display_devices_vendors_percentage(t):
    x = t["system_display_devices"]
    j = x.groupBy("vendor_name").agg(F.count_distinct("guid").alias("number_of_systems")).crossJoin(F.broadcast(x.agg(F.count_distinct("guid").alias("total_number_of_systems"))))  # one row
    return j.withColumn("percentage_of_systems", S.percent(F.col("number_of_systems"), F.col("total_number_of_systems")))


def _waits(t: Tables) -> DataFrame:
    return t["system_userwait"].where(~F.col("proc_name").isin(*NO_PROCESSES) & ~F.col("event_name").isin(*NO_EVENTS))


def _per_instance():
    return S.ratio(F.sum(F.col("total_duration_ms").cast("double")) / 1000, F.sum("number_of_instances"))


@_query
def userwait_top_10_wait_processes(t):
    return top_with_ties(_waits(t).groupBy("proc_name").agg(_per_instance().alias("total_duration_sec_per_instance")), "total_duration_sec_per_instance", 10).orderBy("rank")


@_query
def userwait_top_10_wait_processes_wait_type_ac_dc(t):
    g = _waits(t).groupBy("event_name", "acdc", "proc_name").agg(_per_instance().alias("v"))
    out = ranked(g, "v", ["event_name", "acdc"], 10).orderBy(F.col("acdc").asc_nulls_last(), "event_name", "rank")
    return out.select("event_name", "acdc", "proc_name", F.round("v", 2).alias("total_duration_sec_per_instance"), "rank")


@_query
def userwait_top_20_wait_processes_compare_ac_dc_unknown_durations(t):
    w = _waits(t)
    g = w.groupBy("proc_name").agg(_per_instance().alias("v"), F.sum("number_of_instances").alias("n"), F.count_distinct("guid").alias("g")).where("n > 50 and g > 20")
    top = top_with_ties(g, "v", 20).select("proc_name")
    x = w.join(F.broadcast(top), "proc_name", "left_semi").groupBy("proc_name").pivot("acdc", ["AC", "DC", "UN"]).agg(F.round(_per_instance(), 2))  # some 20 rows
    return x.select("proc_name", *(F.coalesce(F.col(a), F.lit(0.0)).alias(f"{n}_duration") for a, n in (("AC", "ac"), ("DC", "dc"), ("UN", "unknown"))))


def _apps(t: Tables) -> DataFrame:
    return t["system_frgnd_apps_types"].where(~F.lower("exe_name").isin(*NO_APPS) & F.col("app_type").isNotNull())


@_query
def top_10_applications_by_app_type_ranked_by_focal_time(t):
    r = ranked(_apps(t).groupBy("app_type", "exe_name").agg(F.avg("totalsecfocal_day").alias("v")), "v", ["app_type"], 10)
    return r.orderBy("app_type", "rank").select("app_type", "exe_name", F.round("v").alias("average_focal_sec_per_day"), "rank")


@_query
def top_10_applications_by_app_type_ranked_by_system_count(t):
    return ranked(_apps(t).groupBy("app_type", "exe_name").agg(F.count_distinct("guid").alias("number_of_systems")), "number_of_systems", ["app_type"], 10).orderBy("app_type", "rank")


@_query
def top_10_applications_by_app_type_ranked_by_total_detections(t):
    return ranked(_apps(t).groupBy("app_type", "exe_name").agg(F.sum("lines_per_day").alias("total_number_of_detections")), "total_number_of_detections", ["app_type"], 10).orderBy("app_type", "rank")


@_query
def ranked_process_classifications(t):
    """Every user has a rank: as many as have more, plus 1; counted by range partitions, not in one window."""
    g = t["system_mods_power_consumption"].groupBy("user_id").agg(F.sum("total_power_consumption").alias("total_power_consumption"))
    return ranked_all(g, "total_power_consumption").withColumnRenamed("rank", "rnk")


@_query
def top_10_processes_per_user_id_ranked_by_total_power_consumption(t):
    g = t["system_mods_power_consumption"].groupBy("user_id", "app_id").agg(F.sum("total_power_consumption").alias("total_power_consumption"))
    return ranked(g, "total_power_consumption", ["user_id"], 10).withColumnRenamed("rank", "rnk")


@_query
def top_20_most_power_consuming_processes_by_avg_power_consumed(t):
    g = t["system_mods_power_consumption"].groupBy("app_id").agg(F.avg("total_power_consumption").alias("total_power_consumption"))
    return top_with_ties(g, "total_power_consumption", 20).withColumnRenamed("rank", "rnk")


#: Names under which results of earlier runs are filed, where they are not those here.
PUBLISHED = {"server_class_network_consumption": "Xeon_network_consumption"}

_SYSTEMS = "number_of_systems"
# How results are compared, query -> type, keys, values, groups of ranks, counted column.
SPECS: dict[str, Spec] = {
    "avg_platform_power_c0_freq_temp_by_chassis": Spec("aggregate", ["chassistype"], [_SYSTEMS, "avg_psys_rap_watts", "avg_pkg_c0", "avg_freq_mhz", "avg_temp_centigrade"]),
    "battery_on_duration_cpu_family_gen": Spec("aggregate", ["marketcodename", "cpugen"], [_SYSTEMS, "avg_duration_mins_on_battery"]),
    "battery_power_on_geographic_summary": Spec("aggregate", ["country"], [_SYSTEMS, "avg_number_of_dc_powerons", "avg_duration"]),
    "display_devices_connection_type_resolution_durations_ac_dc": Spec("aggregate", ["connection_type", "resolution"], [_SYSTEMS, "average_duration_on_ac_in_seconds", "average_duration_on_dc_in_seconds"]),
    "display_devices_vendors_percentage": Spec("distribution", ["vendor_name"], ["percentage_of_systems"]),
    "mods_blockers_by_osname_and_codename": Spec("aggregate", ["os_name", "os_codename"], ["num_entries", _SYSTEMS, "entries_per_system"]),
    "most_popular_browser_in_each_country_by_system_count": Spec("ranking_categorical", ["country"], ["browser"]),
    "on_off_mods_sleep_summary_by_cpu_marketcodename_gen": Spec(
        "aggregate",
        ["marketcodename", "cpugen"],
        [_SYSTEMS, "avg_on_time", "avg_off_time", "avg_modern_sleep_time", "avg_sleep_time", "avg_total_time", "avg_pcnt_on_time", "avg_pcnt_off_time", "avg_pcnt_mods_time", "avg_pcnt_sleep_time"],
    ),
    "persona_web_cat_usage_analysis": Spec("aggregate", ["persona"], [_SYSTEMS, "days", *WEB_CATEGORIES]),
    "pkg_power_by_country": Spec("aggregate", ["countryname_normalized"], [_SYSTEMS, "avg_pkg_power_consumed"]),
    "popular_browsers_by_count_usage_percentage": Spec("distribution", ["browser"], ["percent_systems", "percent_instances", "percent_duration"]),
    "ram_utilization_histogram": Spec("histogram", ["ram_gb"], ["avg_percentage_used"], [], "count(DISTINCT guid)"),
    "server_exploration_1": Spec("row_level", ["chassistype", "vendor", "os"], ["nrs", "received_bytes", "sent_bytes"]),
    "server_class_network_consumption": Spec("aggregate", ["processor_class", "os"], [_SYSTEMS, "avg_bytes_received", "avg_bytes_sent"]),
    "top_10_applications_by_app_type_ranked_by_focal_time": Spec("ranking_numeric", ["app_type", "exe_name"], ["average_focal_sec_per_day"], ["app_type"]),
    "top_10_applications_by_app_type_ranked_by_system_count": Spec("ranking_numeric", ["app_type", "exe_name"], [_SYSTEMS], ["app_type"]),
    "top_10_applications_by_app_type_ranked_by_total_detections": Spec("ranking_numeric", ["app_type", "exe_name"], ["total_number_of_detections"], ["app_type"]),
    "top_mods_blocker_types_durations_by_osname_and_codename": Spec("aggregate", ["os_name", "os_codename", "blocker_name", "blocker_type", "activity_level"], ["number_of_clients", "average_active_time_in_seconds", "number_of_occurences"]),
    "userwait_top_10_wait_processes": Spec("ranking_numeric", ["proc_name"], ["total_duration_sec_per_instance"]),
    "userwait_top_10_wait_processes_wait_type_ac_dc": Spec("ranking_numeric", ["acdc", "event_name", "proc_name"], ["total_duration_sec_per_instance"], ["acdc", "event_name"]),
    "userwait_top_20_wait_processes_compare_ac_dc_unknown_durations": Spec("ranking_numeric", ["proc_name"], ["ac_duration", "dc_duration", "unknown_duration"]),
}


class Half(dict):
    """The reporting tables of some devices: each table's rows whose device is one of them, made where they are asked for."""

    def __init__(self, tables: Tables, devices: DataFrame, key: str = "guid"):
        super().__init__()
        self.tables, self.devices, self.key = tables, devices, key

    def __missing__(self, name: str) -> DataFrame:
        t = self.tables[name]
        self[name] = t.join(self.devices, self.key, "left_semi") if self.key in t.columns else t
        return self[name]


def halves(tables: Tables, seed: str) -> tuple[Half, Half]:
    """The tables of two random halves of the devices."""
    from ..operators import evaluate as E

    first, second = E.split_half(_sysinfo(tables).select("guid").distinct(), "guid", seed)
    return Half(tables, first), Half(tables, second)


def split_half(tables: Tables, seed: str, names: list[str] | None = None) -> DataFrame:
    """Metric rows of the queries on one random half of the devices against the other: what sampling alone gives, the baseline of normalised errors."""
    from ..operators import evaluate as E

    first, second = halves(tables, seed)
    chosen = {n: SPECS[n] for n in names or SPECS}
    return E.evaluate_all(chosen, lambda n: QUERIES[n](first), {"half": lambda n: QUERIES[n](second)}).drop("method")


def normalized_errors(tables: Tables, methods: dict[str, Tables], seed: str, names: list[str] | None = None) -> DataFrame:
    """method, query, query_type, column, metric_type, method_value, baseline_value, normalized: each method's tables against the real ones, in parts of what two halves of the real ones differ by.

    What either side cannot measure, what is not finite and what halves agree on is left out.
    """
    from ..operators import evaluate as E

    chosen = {n: SPECS[n] for n in names or SPECS}
    got = E.evaluate_all(chosen, lambda n: QUERIES[n](tables), {m: (lambda n, t=t: QUERIES[n](t)) for m, t in methods.items()})
    return E.normalized_rows(got, split_half(tables, seed, names))


def results_in(spark: SparkSession, root: str) -> Callable[[str], DataFrame]:
    """Results by query from a folder of CSV files or folders, under the names here or the published ones."""
    from ..sources.tables import exists, read_results

    def of(name: str) -> DataFrame:
        for n in (name, PUBLISHED.get(name, name)):
            for path in (f"{root}/{n}.csv", f"{root}/{n}"):
                if exists(spark, path):
                    return read_results(spark, path)
        raise FileNotFoundError(f"no result of {name} in {root}")

    return of


def evaluate_folders(spark: SparkSession, real_dir: str, methods: dict[str, str], names: list[str] | None = None) -> DataFrame:
    """Metric rows with method of all published queries: a folder of results for each method against the real one's. What isn't there is an error row."""
    from ..operators import evaluate as E

    return E.evaluate_all({n: SPECS[n] for n in names or SPECS}, results_in(spark, real_dir), {m: results_in(spark, d) for m, d in methods.items()})


def run_all(tables: Tables, out_dir: str, names: list[str] | None = None, infeasible: bool = False) -> dict[str, str]:
    """Writes results as CSV; query -> "ok" or what went wrong."""
    from ..sources.tables import write_results

    done = {}
    for name in names or QUERIES:
        if name in INFEASIBLE and not infeasible:
            continue
        try:
            write_results(QUERIES[name](tables), f"{out_dir}/{name}")
            done[name] = "ok"
        except Exception as e:  # told in the result
            done[name] = f"{type(e).__name__}: {str(e)[:300]}"
    return done
