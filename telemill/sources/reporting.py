"""The reporting tables: daily and per-device tables built from raw telemetry.

Each builder takes the raw DataFrames that it needs by name and returns a
DataFrame; nothing runs until it is written. Where accounts of a table differ,
the one that handles missing values is built: negative battery levels are
missing, weights are doubles, memory needs a positive size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import semantics as S
from . import tables


@dataclass(frozen=True)
class TableSpec:
    name: str
    #: raw table -> "parquet" or "text"
    sources: dict[str, str]
    build: Callable[[dict[str, DataFrame]], DataFrame]


TABLES: dict[str, TableSpec] = {}


def table(name: str, **sources: str):
    def register(build):
        TABLES[name] = TableSpec(name, sources, build)
        return build

    return register


def _copy(name: str, source: str, kind: str) -> None:
    TABLES[name] = TableSpec(name, {source: kind}, lambda raw: raw[source])


_copy("system_sysinfo_unique_normalized", "system_sysinfo_unique_normalized", "parquet")
for _name in ("system_cpu_metadata", "system_os_codename_history", "system_on_off_suspend_time_day", "system_display_devices", "system_frgnd_apps_types", "system_mods_power_consumption"):
    _copy(_name, _name, "text")
_copy("system_web_cat_usage", "web_cat_usage_v2", "parquet")


@table("system_mods_top_blocker_hist", system_mods_top_blocker_hist="text")
def blockers(raw):
    return raw["system_mods_top_blocker_hist"].withColumnRenamed("dt_utc", "dt")


@table("system_batt_dc_events", batt_dc_events="text")
def battery(raw):
    g = raw["batt_dc_events"].groupBy("guid", F.to_date("power_on_dc_ts").alias("dt"))
    levels = []
    for side in ("power_on", "power_off"):
        x = S.unless_negative(f"{side}_battery_percent")
        levels += [F.max(x).alias(f"max_{side}_battery_percent"), F.min(x).alias(f"min_{side}_battery_percent"), F.round(F.avg(x)).alias(f"avg_{side}_battery_percent")]
    return g.agg(F.max("load_ts").alias("load_ts"), F.sum("duration_mins").alias("duration_mins"), F.count("*").alias("num_power_ons"), *levels)


@table("system_network_consumption", os_network_consumption_v2="parquet")
def network(raw):
    g = raw["os_network_consumption_v2"].groupBy("guid", "dt", F.col("input_description").alias("input_desc"))
    return g.agg(F.sum("nr_samples").alias("nrs"), F.min("min_bytes_sec").alias("min_bytes_sec"), F.max("max_bytes_sec").alias("max_bytes_sec"), S.wavg("nr_samples", "avg_bytes_sec").alias("avg_bytes_sec"))


@table("system_userwait", userwait_v2="parquet")
def userwait(raw):
    g = raw["userwait_v2"].groupBy("guid", "dt", "event_name", "ac_dc_event_name", F.col("proc_name_current").alias("proc_name"))
    out = g.agg(F.count("*").alias("number_of_instances"), F.sum("duration_ms").alias("total_duration_ms"))
    return out.select("guid", "dt", "event_name", "ac_dc_event_name", S.power_state("ac_dc_event_name").alias("acdc"), "proc_name", "number_of_instances", "total_duration_ms")


@table("system_memory_utilization", os_memsam_avail_percent="parquet", system_sysinfo_unique_normalized="parquet")
def memory(raw):
    """average is free megabytes; the share used follows from the device's memory."""
    samples = raw["os_memsam_avail_percent"].groupBy("guid", "dt").agg(F.sum("sample_count").alias("nrs"), S.wavg("sample_count", "average").alias("avg_free_ram"))
    ram = raw["system_sysinfo_unique_normalized"].select("guid", (S.number_or("ram", 0.0) * 1024).cast("long").alias("sysinfo_ram")).where("sysinfo_ram > 0")
    j = samples.join(ram, "guid")
    used = F.col("sysinfo_ram") - F.col("avg_free_ram")
    return j.select("guid", "dt", "nrs", "avg_free_ram", "sysinfo_ram", used.alias("utilized_ram"), F.round(100 * S.ratio(used, "sysinfo_ram")).alias("avg_percentage_used"))


#: table -> (metric names, suffix of its columns)
METRICS = {
    "system_psys_rap_watts": (("HW::PACKAGE:RAP:WATTS:", "HW:::PSYS_RAP:WATTS:"), "psys_rap_watts"),
    "system_pkg_C0": (("HW::PACKAGE:C0_RESIDENCY:PERCENT:",), "pkg_c0"),
    "system_pkg_avg_freq_mhz": (("HW::CORE:AVG_FREQ:MHZ:",), "avg_freq_mhz"),
    "system_pkg_temp_centigrade": (("HW::CORE:TEMPERATURE:CENTIGRADE:",), "temp_centigrade"),
}
PACKAGE_POWER = "HW::PACKAGE:IA_POWER:WATTS:"


def _metric(name: str) -> None:
    names, suffix = METRICS[name]

    def build(raw):
        x = raw["hw_metric_stats"].where(F.col("name").isin(*names))
        return x.groupBy("guid", "dt").agg(F.sum("nrs").alias("nrs"), S.wavg("nrs", "min").alias(f"min_{suffix}"), S.wavg("nrs", "mean").alias(f"avg_{suffix}"), S.wavg("nrs", "max").alias(f"max_{suffix}"))

    TABLES[name] = TableSpec(name, {"hw_metric_stats": "parquet"}, build)


for _name in METRICS:
    _metric(_name)


@table("system_hw_pkg_power", hw_metric_stats="parquet")
def package_power(raw):
    x = raw["hw_metric_stats"].where(F.col("name") == PACKAGE_POWER)
    return x.groupBy("guid", "dt", "instance").agg(F.sum("nrs").alias("nrs"), S.wavg("nrs", "mean").alias("mean"), F.max("max").alias("max"))


def metrics_at_once(stats: DataFrame) -> dict[str, DataFrame]:
    """All tables of hw_metric_stats from one scan and one shuffle: sums by metric, then a filter each."""
    kind = F.lit(None).cast("string")
    for name, (names, _) in METRICS.items():
        kind = F.when(F.col("name").isin(*names), name).otherwise(kind)
    x = stats.withColumn("__t", kind).where("__t is not null")
    sums = x.groupBy("guid", "dt", "__t").agg(F.sum("nrs").alias("nrs"), *(S.wavg("nrs", c).alias(c) for c in ("min", "mean", "max")))
    return {name: sums.where(F.col("__t") == name).select("guid", "dt", "nrs", F.col("min").alias(f"min_{s}"), F.col("mean").alias(f"avg_{s}"), F.col("max").alias(f"max_{s}")) for name, (_, s) in METRICS.items()}


# Output column -> (parent category, sub category or None for any). These
# are the categories of the raw web-usage data.
WEB_CATEGORIES = {
    "content_creation_photo_edit_creation": ("content creation", "photo edit/creation"),
    "content_creation_video_audio_edit_creation": ("content creation", "video/audio edit/creation"),
    "content_creation_web_design_development": ("content creation", "web design / development"),
    "education": ("education", None),
    "entertainment_music_audio_streaming": ("entertainment", "music / audio streaming"),
    "entertainment_other": ("entertainment", "other"),
    "entertainment_video_streaming": ("entertainment", "video streaming"),
    "finance": ("finance", None),
    "games_other": ("games", "other"),
    "games_video_games": ("games", "video games"),
    "mail": ("mail", None),
    "news": ("news", None),
    "unclassified": ("other", None),
    "private": ("private", None),
    "productivity_crm": ("productivity", "crm"),
    "productivity_other": ("productivity", "other"),
    "productivity_presentations": ("productivity", "presentations"),
    "productivity_programming": ("productivity", "programming"),
    "productivity_project_management": ("productivity", "project management"),
    "productivity_spreadsheets": ("productivity", "spreadsheets"),
    "productivity_word_processing": ("productivity", "word processing"),
    "recreation_travel": ("recreation", "travel"),
    "reference": ("reference", None),
    "search": ("search", None),
    "shopping": ("shopping", None),
    "social_social_network": ("social", "social network"),
    "social_communication": ("social", "communication"),
    "social_communication_live": ("social", "communication - live"),
}


@table("system_web_cat_pivot_duration", web_cat_usage_v2="parquet")
def web_pivot(raw):
    """28 categories by conditional sums in one pass."""
    ms = F.col("duration_ms").cast("double")
    hit = lambda p, s: (F.col("parent_category") == p) if s is None else (F.col("parent_category") == p) & (F.col("sub_category") == s)
    return raw["web_cat_usage_v2"].groupBy("guid", "dt").agg(*(S.sum_if(hit(p, s), ms).alias(c) for c, (p, s) in WEB_CATEGORIES.items()))


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """A table that was pivoted before: the columns that are there, under their short names."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def build(spark: SparkSession, raw_dir: str, name: str) -> DataFrame:
    spec = TABLES[name]
    readers = {"parquet": tables.read_parquet, "text": tables.read_text}
    return spec.build({s: readers[kind](spark, raw_dir, s) for s, kind in spec.sources.items()})


def build_all(spark: SparkSession, raw_dir: str, out_dir: str, names: list[str] | None = None) -> dict[str, str]:
    """Writes the tables; table -> "ok" or what went wrong. One table's failure doesn't stop the others."""
    done = {}
    for name in names or TABLES:
        try:
            build(spark, raw_dir, name).write.mode("overwrite").parquet(f"{out_dir}/{name}")
            done[name] = "ok"
        except Exception as e:  # told in the result
            done[name] = f"{type(e).__name__}: {str(e)[:300]}"
    return done
