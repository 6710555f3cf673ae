"""Telemetry: canonical projection, snapshot dedup, deltas, quality profile and per-asset summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tribolens.functions import cleaning as c
from tribolens.functions import fixed_values as fv
from tribolens.plans import scans
from tribolens.sources.headers import pick, resolve

COUNTERS = ["operating_hours", "odometer", "idle_hours", "fuel_used"]
POSITION = ["latitude", "longitude"]
SCHEMA = (
    "reading_key string, asset_id string, serial_number string, machine_model string, event_time timestamp_ntz, "
    "modified_time timestamp_ntz, operating_hours double, odometer double, idle_hours double, fuel_used double, "
    "latitude double, longitude double"
)


def schema_issue(columns: list[str]) -> str | None:
    """Why a table cannot be telemetry, or None when it can."""
    needed = {"asset_id": "asset identifier", "event_time": "event timestamp"}
    missing = [label for key, label in needed.items() if resolve(columns, fv.TELEMETRY_HEADERS[key]) is None]
    return f"Telemetry file was ignored because it has no {' and '.join(missing)}." if missing else None


def read_telemetry(raw: DataFrame, row_key: str) -> DataFrame:
    """Canonical readings in one projection; a table without asset or time gives an empty one."""
    if schema_issue(raw.columns):
        return empty_readings(raw.sparkSession)
    names = fv.TELEMETRY_HEADERS

    def col(name: str) -> Column:
        return pick(raw, names[name])[0]

    return raw.select(
        F.col(row_key).alias("reading_key"),
        *[c.identifier(col(name)).alias(name) for name in ["asset_id", "serial_number", "machine_model"]],
        *[c.trimmed_timestamp(*pick(raw, names[name])).alias(name) for name in ["event_time", "modified_time"]],
        *[c.number(col(name)).alias(name) for name in [*COUNTERS, *POSITION]],
    )


def empty_readings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def duplicate_readings(readings: DataFrame) -> DataFrame:
    """How many rows share asset and time with another row."""
    per_key = readings.groupBy("asset_id", "event_time").count()
    return per_key.agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0))
                       .alias("duplicate_asset_timestamp_rows"))


def latest_readings(readings: DataFrame) -> DataFrame:
    """One row per (asset, time): the last modified; undated modification loses. Limited per task before the shuffle."""
    order = Window.partitionBy("asset_id", "event_time").orderBy(
        F.col("modified_time").desc_nulls_last(), F.col("reading_key").desc())
    return readings.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def with_deltas(latest: DataFrame, rows_per_segment: int = scans.ROWS_PER_SEGMENT) -> DataFrame:
    """Gap to the previous reading, counter deltas, resets and guarded ratios."""
    rows = scans.split_series(latest, ["asset_id"], "event_time", "reading_key", depth=1, carried=COUNTERS,
                              rows_per_segment=rows_per_segment)
    series = Window.partitionBy("asset_id", "_seg").orderBy(F.col("event_time").asc_nulls_last(), "reading_key")
    before = rows.select(
        *rows.columns,
        ((c.micros(F.col("event_time")) - c.micros(F.lag("event_time").over(series))) / F.lit(1e6) / F.lit(3600.0))
        .alias("gap_hours"),
        *[(F.col(name) - F.lag(name).over(series)).alias(name + "_delta") for name in COUNTERS],
    ).filter(~F.col("_copy")).drop("_seg", "_copy", "_before")
    hours = F.col("operating_hours_delta")
    return before.withColumns({
        "operating_hours_reset": F.coalesce(hours < 0, F.lit(False)),
        "odometer_reset": F.coalesce(F.col("odometer_delta") < 0, F.lit(False)),
        "distance_per_operating_hour": F.when(hours > 0, F.col("odometer_delta") / hours),
        "utilization_rate": F.when(F.col("gap_hours") > 0, hours / F.col("gap_hours")),
    })


def prepare_telemetry(raw: DataFrame | None, row_key: str, spark: SparkSession | None = None) -> DataFrame:
    readings = empty_readings(spark) if raw is None else read_telemetry(raw, row_key)
    return with_deltas(latest_readings(readings))


def stale_fields(raw: DataFrame) -> DataFrame:
    """Candidate source columns with at most one distinct value, counting NULL as a value.

    Smallest, largest and two counts decide that without a distinct aggregation.
    """
    present = [name for name in fv.STALE_CANDIDATES if name in raw.columns]
    if not present:
        return raw.sparkSession.createDataFrame([], "field string")
    constant = [
        ((F.count(name) == 0) | ((F.min(name) == F.max(name)) & (F.count(name) == F.count("*")))).alias(name)
        for name in present
    ]
    rows = raw.agg(*constant).unpivot([], present, "field", "is_stale")
    return rows.filter("is_stale").select("field")


def quality_profile(raw: DataFrame, readings: DataFrame, issue: str | None = None) -> DataFrame:
    """One row: row counts around dedup, duplicates, assets, time range, stale fields and schema issue."""
    if issue is not None:
        counted = raw.agg(F.count("*").alias("rows_before_deduplication"))
        return counted.select(
            "rows_before_deduplication",
            *[F.lit(0).cast("long").alias(n) for n in
              ["rows_after_deduplication", "duplicate_asset_timestamp_rows", "unique_assets"]],
            *[F.lit(None).cast("timestamp_ntz").alias(n) for n in ["date_start", "date_end"]],
            F.lit("").alias("stale_or_constant_fields"), F.lit(issue).alias("schema_issue"))
    per_key = readings.groupBy("asset_id", "event_time").count()
    counts = per_key.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("rows_before_deduplication"),
        F.count("*").alias("rows_after_deduplication"),
        F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("duplicate_asset_timestamp_rows"),
        F.count_distinct("asset_id").alias("unique_assets"),
        F.min("event_time").alias("date_start"),
        F.max("event_time").alias("date_end"),
    )
    stale = stale_fields(raw).agg(F.array_join(F.sort_array(F.collect_list("field")), "; ").alias("fields"))
    return counts.select("*", stale.scalar().alias("stale_or_constant_fields"),
                         F.lit(None).cast("string").alias("schema_issue"))


def gap_medians(telemetry: DataFrame, rows_per_segment: int = scans.ROWS_PER_SEGMENT) -> DataFrame:
    """Exact median reporting gap per asset from counts per distinct gap, never from one list per asset.

    Counts are ordered in segments of even size, so an asset whose gaps are all alike is spread too.
    """
    counted = (
        telemetry.filter(F.col("gap_hours").isNotNull())
        .groupBy("asset_id", "gap_hours").agg(F.count("*").alias("n"))
        .withColumn("_pos", F.round(F.col("gap_hours") * 3600e6).cast("long"))
    )
    ranked = scans.ranged_totals(counted, ["asset_id"], "_pos", {"upto": ("sum", F.col("n"))}, rows_per_segment=rows_per_segment)
    sizes = ranked.groupBy("asset_id").agg(F.sum("n").alias("total"))
    # The two middle ranks; they coincide for an odd count.
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    first = F.col("upto") - F.col("n")
    middle = [F.when((first < rank) & (F.col("upto") >= rank), F.col("gap_hours")) for rank in (low, high)]
    return scans.join_on(ranked, sizes, ["asset_id"]).groupBy("asset_id").agg(
        ((F.max(middle[0]) + F.max(middle[1])) / 2).alias("median_reporting_gap_hours"))


def asset_summary(telemetry: DataFrame) -> DataFrame:
    """Coverage, last known identity, counter gains, reporting gaps and resets per asset."""
    at = F.struct(F.col("event_time").isNull(), F.col("event_time"), F.col("reading_key"))

    def known(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), at)

    def gain(name: str) -> Column:
        return F.when(F.count(name) >= 2, F.max_by(name, known(name)) - F.min_by(name, known(name)))

    grouped = telemetry.groupBy("asset_id").agg(
        F.max_by("serial_number", known("serial_number")).alias("serial_number"),
        F.max_by("machine_model", known("machine_model")).alias("machine_model"),
        F.count("*").alias("snapshots"),
        F.min("event_time").alias("start"),
        F.max("event_time").alias("end"),
        gain("operating_hours").alias("operating_hours_gain"),
        gain("odometer").alias("odometer_gain"),
        F.max("gap_hours").alias("max_reporting_gap_hours"),
        F.count_if("operating_hours_reset").alias("negative_operating_hour_deltas"),
        F.count_if("odometer_reset").alias("negative_odometer_deltas"),
    )
    return scans.join_on(grouped, gap_medians(telemetry), ["asset_id"])


def asset_insight(telemetry: DataFrame, as_of: Column) -> DataFrame:
    """Monitoring status per asset as of an explicit moment."""
    anomaly = F.col("telemetry_anomaly") if "telemetry_anomaly" in telemetry.columns else F.lit(False)
    grouped = telemetry.filter(F.col("asset_id").isNotNull()).groupBy("asset_id").agg(
        F.count("*").alias("snapshots"),
        F.count_if(anomaly).alias("anomalies"),
        F.count_if("operating_hours_reset").alias("resets"),
        F.max("gap_hours").alias("max_gap_hours"),
        F.max("event_time").alias("latest"),
    )
    worrying = (F.col("anomalies") > 0) | (F.col("resets") > 0) | F.coalesce(F.col("max_gap_hours") > 72, F.lit(False))
    full = F.format_string(
        "%,d telemetry snapshot(s); %d unusual snapshot(s); %d operating-hour reset(s); "
        "maximum reporting gap %.1f hours.",
        "snapshots", "anomalies", "resets", F.bround("max_gap_hours", 1))
    short = F.format_string("%,d telemetry snapshot(s) are available.", "snapshots")
    return grouped.select(
        "asset_id", "snapshots", "anomalies", "resets", "max_gap_hours",
        ((c.micros(as_of) - c.micros(F.col("latest"))) / F.lit(c.MICROS_PER_DAY)).alias("age_days"),
        F.when(worrying, "Monitor").otherwise("Normal").alias("status"),
        F.when(F.col("max_gap_hours").isNotNull(), full).otherwise(short).alias("summary"),
    )


def latest_anomaly_scores(scored: DataFrame) -> DataFrame:
    """Last present anomaly score per asset."""
    at = F.struct(F.col("event_time").isNull(), F.col("event_time"), F.col("reading_key"))
    return scored.filter(F.col("telemetry_anomaly_score").isNotNull() & F.col("asset_id").isNotNull()).groupBy(
        "asset_id").agg(F.max_by("telemetry_anomaly_score", at).alias("telemetry_anomaly_score"))
