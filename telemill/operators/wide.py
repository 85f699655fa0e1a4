"""The wide table: a row for each device, put together and taken apart again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import semantics as S


def assemble(devices: DataFrame, features: list[DataFrame], key: str = "guid") -> DataFrame:
    """devices left-joined with per-device features; missing numbers become 0, missing texts "Unknown".

    All sides have one row a key, so no join fans out, and all joins share the key:
    the devices are shuffled once.
    """
    wide = reduce(lambda a, b: a.join(b, key, "left"), features, devices)
    text = [c for c, t in wide.dtypes if t == "string" and c != key]
    return wide.fillna(0, [c for c, t in wide.dtypes if t not in ("string", "date") and c != key]).fillna("Unknown", text)


def unpivot_positive(wide: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A row for each column above 0: key, name, value."""
    return wide.unpivot(key, columns, "name", "value").where("value > 0")


def covered(wide: DataFrame, columns: list[str], least: int) -> DataFrame:
    """Rows with so many columns that are not zero."""
    return wide.where(S.nonzero_count(columns) >= least)


def sparsity(wide: DataFrame, columns: list[str]) -> DataFrame:
    """name, percent_nonzero, from one aggregate over all columns."""
    one = wide.agg(F.count("*").alias("__n"), *(F.sum(F.when(F.coalesce(F.col(c), F.lit(0)) != 0, 1).otherwise(0)).alias(c) for c in columns))
    shares = one.select(*((100.0 * S.ratio(c, "__n")).alias(c) for c in columns))
    return shares.unpivot([], columns, "name", "percent_nonzero")


def group_sparsity(wide: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """group, percent: devices with any value in the group, at least 1."""
    one = wide.agg(F.count("*").alias("__n"), *(F.sum(S.any_nonzero(cs).cast("int")).alias(g) for g, cs in groups.items()))
    return one.select(*(F.greatest(F.lit(1.0), 100.0 * S.ratio(g, "__n")).alias(g) for g in groups)).unpivot([], list(groups), "grp", "percent")


def co_occurrence(wide: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """active, n: devices by the number of their active groups."""
    active = S.total(S.any_nonzero(cs).cast("int") for cs in groups.values())
    return wide.groupBy(active.alias("active")).agg(F.count("*").alias("n"))


# --- the feature aggregates of the reporting tables -----------------------------------------

RECEIVED, SENT = "OS:NETWORK INTERFACE::BYTES RECEIVED/SEC::", "OS:NETWORK INTERFACE::BYTES SENT/SEC::"
HARDWARE = {"psys_rap": ("system_psys_rap_watts", "avg_psys_rap_watts"), "pkg_c0": ("system_pkg_C0", "avg_pkg_c0"), "avg_freq": ("system_pkg_avg_freq_mhz", "avg_avg_freq_mhz"), "temp": ("system_pkg_temp_centigrade", "avg_temp_centigrade"), "pkg_power": ("system_hw_pkg_power", "mean")}
ON_OFF = ("on_time", "off_time", "mods_time", "sleep_time")
BROWSERS = ("chrome", "edge", "firefox")


def features(tables: dict[str, DataFrame]) -> list[DataFrame]:
    """Per-device aggregates of whichever reporting tables there are."""
    out = []
    has = tables.get
    if (t := has("system_network_consumption")) is not None:
        flow = F.col("avg_bytes_sec") * F.col("nrs").cast("double") * 5
        out.append(t.groupBy("guid").agg(F.sum("nrs").cast("double").alias("net_nrs"), S.sum_if(F.col("input_desc") == RECEIVED, flow).alias("net_received_bytes"), S.sum_if(F.col("input_desc") == SENT, flow).alias("net_sent_bytes")))
    if (t := has("system_memory_utilization")) is not None:
        out.append(t.where("avg_percentage_used > 0").groupBy("guid").agg(F.sum("nrs").cast("double").alias("mem_nrs"), S.wavg("nrs", "avg_percentage_used").alias("mem_avg_pct_used"), F.max("sysinfo_ram").cast("double").alias("mem_sysinfo_ram")))
    for name, (table, value) in HARDWARE.items():
        if (t := has(table)) is not None:
            out.append(t.groupBy("guid").agg(F.sum("nrs").cast("double").alias(f"{name}_nrs"), S.wavg("nrs", value).alias(f"{name}_avg")))
    if (t := has("system_batt_dc_events")) is not None:
        out.append(t.groupBy("guid").agg(F.sum("num_power_ons").cast("double").alias("batt_num_power_ons"), F.sum("duration_mins").alias("batt_duration_mins")))
    if (t := has("system_web_cat_usage")) is not None:
        ms = F.col("duration_ms").cast("double")
        out.append(t.groupBy("guid").agg(*(S.sum_if(F.col("browser") == b, ms).alias(f"web_{b}_duration") for b in BROWSERS), F.sum(ms).alias("web_total_duration"), F.count("*").cast("double").alias("web_num_instances")))
    if (t := has("system_web_cat_pivot_duration")) is not None:
        out.append(t.groupBy("guid").agg(*(F.sum(c).alias(f"webcat_{c}") for c in t.columns if c not in ("guid", "dt"))))
    if (t := has("system_on_off_suspend_time_day")) is not None:
        out.append(t.groupBy("guid").agg(*(F.sum(c).cast("double").alias(f"onoff_{c}") for c in ON_OFF)))
    if (t := has("system_display_devices")) is not None:
        out.append(t.groupBy("guid").agg(F.count_distinct("display_id").cast("double").alias("disp_num_displays"), F.sum("duration_ac").cast("double").alias("disp_total_duration_ac"), F.sum("duration_dc").cast("double").alias("disp_total_duration_dc")))
    return out


def decompose(wide: DataFrame) -> dict[str, DataFrame]:
    """Reporting tables from a wide table, each only if its columns are there."""
    w, have, out = wide, set(wide.columns), {}
    ram = S.snap(S.number_or("ram", 8.0)) if "ram" in have else F.lit(8.0)
    known = [c for c in ("chassistype", "countryname_normalized", "modelvendor_normalized", "os", "cpuname", "cpucode", "cpu_family", "persona", "processornumber") if c in have]
    out["system_sysinfo_unique_normalized"] = w.select("guid", *known, ram.alias("ram"))
    if {"cpucode", "cpu_family"} <= have:
        out["system_cpu_metadata"] = w.select("guid", F.col("cpucode").alias("marketcodename"), F.col("cpu_family").alias("cpugen"))
    if {"net_nrs", "net_received_bytes", "net_sent_bytes"} <= have:
        half = F.greatest(F.col("net_nrs") / 2, F.lit(1.0))
        sides = F.array(*(F.struct(F.lit(d).alias("input_desc"), (S.clip(c, 0.0) / (half * 5)).alias("avg_bytes_sec")) for d, c in ((RECEIVED, "net_received_bytes"), (SENT, "net_sent_bytes"))))
        out["system_network_consumption"] = w.where("net_nrs > 0").select("guid", half.alias("nrs"), F.explode(sides).alias("s")).select("guid", "nrs", "s.*")
    if {"mem_nrs", "mem_avg_pct_used"} <= have:
        out["system_memory_utilization"] = w.where("mem_nrs > 0").select("guid", F.col("mem_nrs").alias("nrs"), S.clip("mem_avg_pct_used", 0.0, 100.0).alias("avg_percentage_used"), (ram * 1024).alias("sysinfo_ram"))
    for name, (table, value) in HARDWARE.items():
        if {f"{name}_nrs", f"{name}_avg"} <= have:
            out[table] = w.where(F.col(f"{name}_nrs") > 0).select("guid", F.col(f"{name}_nrs").alias("nrs"), F.col(f"{name}_avg").alias(value))
    if {"batt_num_power_ons", "batt_duration_mins"} <= have:
        out["system_batt_dc_events"] = w.where("batt_num_power_ons > 0").select("guid", F.col("batt_num_power_ons").alias("num_power_ons"), F.col("batt_duration_mins").alias("duration_mins"))
    web = [c for b in BROWSERS if (c := f"web_{b}_duration") in have]
    if web:
        long = unpivot_positive(w, "guid", web)
        out["system_web_cat_usage"] = long.select("guid", F.regexp_extract("name", "^web_(.*)_duration$", 1).alias("browser"), F.col("value").alias("duration_ms"))
    cats = [c for c in w.columns if c.startswith("webcat_")]
    if cats:
        out["system_web_cat_pivot_duration"] = w.where(S.any_nonzero(cats)).select("guid", *(F.col(c).alias(c.removeprefix("webcat_")) for c in cats))
    times = [f"onoff_{c}" for c in ON_OFF]
    if set(times) <= have:
        out["system_on_off_suspend_time_day"] = w.where(S.any_nonzero(times)).select("guid", *(F.col(c).alias(c.removeprefix("onoff_")) for c in times))
    return out
