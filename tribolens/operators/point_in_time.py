"""Point-in-time features and forward labels.

All joins between samples and events are ordered scans over segments of an asset (work orders by day, telemetry by number of
rows, see `trailing_windows`). No pair of a sample and an event is ever materialised.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tribolens.functions import cleaning as c
from tribolens.functions import fixed_values as fv
from tribolens.operators import trailing_windows
from tribolens.operators.samples import measurement_presence, text_features
from tribolens.operators.trends import add_trends
from tribolens.operators.work_orders import confirmed_corrective, explicit_only
from tribolens.plans import scans

DAY = c.MICROS_PER_DAY
WINDOW_DAYS = list(trailing_windows.SUM_DAYS)


def scoreable(samples: DataFrame) -> DataFrame:
    return samples.filter(F.col("sample_date").isNotNull() & F.col("asset_id").isNotNull())


def day_of(position: Column) -> Column:
    return F.floor(position / F.lit(DAY)).cast("long")


def _sample_points(samples: DataFrame) -> DataFrame:
    return scoreable(samples).select("source_row", "asset_id", c.micros(F.col("sample_date")).alias("at"))


def _readings(telemetry: DataFrame) -> DataFrame:
    """Positions and clipped deltas of the dated readings. A missing delta stays missing when clipped."""
    def clipped(name: str) -> Column:
        return F.when(F.col(name) < 0, F.lit(0.0)).otherwise(F.col(name))

    return telemetry.filter(F.col("event_time").isNotNull() & F.col("asset_id").isNotNull()).select(
        "asset_id", c.micros(F.col("event_time")).alias("at"),
        clipped("operating_hours_delta").alias("hours"), clipped("odometer_delta").alias("distance"),
        F.col("utilization_rate").alias("utilization"))


def trailing(samples: DataFrame, telemetry: DataFrame, rows_per_task: int = scans.ROWS_PER_SEGMENT) -> DataFrame:
    """Latest reading, trailing sums and trailing median per scoreable sample, keyed by `source_row`."""
    return trailing_windows.trailing_windows(_sample_points(samples), _readings(telemetry), rows_per_task)


def telemetry_features(samples: DataFrame, telemetry: DataFrame, rows_per_task: int = scans.ROWS_PER_SEGMENT) -> DataFrame:
    """Availability, age and trailing windows per scoreable sample, keyed by `source_row`."""
    joined = _sample_points(samples).join(trailing(samples, telemetry, rows_per_task), "source_row", "left")
    return joined.select(
        "source_row",
        F.col("latest_reading").isNotNull().cast("double").alias("telemetry_available"),
        *[f"operating_hours_{n}d" for n in WINDOW_DAYS], "distance_30d", "mean_utilization_30d",
        ((F.col("at") - F.col("latest_reading")) / F.lit(DAY)).alias("telemetry_age_days"),
    )


def availability(samples: DataFrame, telemetry: DataFrame, work_orders: DataFrame) -> DataFrame:
    """The two availability features alone: a sample has telemetry from the first reading of its asset on."""
    first = first_readings(telemetry).filter(F.col("asset_id").isNotNull())
    seen = F.coalesce(F.col("_first") <= F.col("sample_date"), F.lit(False)).cast("double")
    dated = scoreable(samples).select("source_row", "asset_id", "sample_date").join(first, "asset_id", "left")
    return with_coverage(dated.withColumn("telemetry_available", seen), work_orders).select(
        "source_row", "telemetry_available", "work_order_history_available")


def first_readings(telemetry: DataFrame) -> DataFrame:
    """Time of the first dated reading of every asset that has any reading."""
    return telemetry.groupBy("asset_id").agg(F.min("event_time").alias("_first"))


def covered_assets(work_orders: DataFrame) -> DataFrame:
    return work_orders.select("asset_id").filter(F.col("asset_id").isNotNull()).distinct()


def with_coverage(samples: DataFrame, work_orders: DataFrame) -> DataFrame:
    """Whether the asset of a sample appears in the work orders at all."""
    marked = covered_assets(work_orders).withColumn("_covered", F.lit(1.0))
    return samples.join(marked, "asset_id", "left").withColumn(
        "work_order_history_available", F.coalesce("_covered", F.lit(0.0))).drop("_covered")


def _scoped_counts(samples: DataFrame, work_orders: DataFrame, ahead_days: int | None) -> DataFrame:
    """Confirmed corrective orders before (or, with `ahead_days`, within the days after) each scoreable sample.

    If any order names a component, a sample that has one only sees orders of that component.
    """
    scoped = work_orders.agg(F.bool_or(F.col("component").isNotNull())).scalar()
    events = confirmed_corrective(work_orders).select(
        "asset_id", c.micros(F.col("opened_date")).alias("at"),
        F.explode(F.array_distinct(F.array(F.lit(""), F.coalesce("component", F.lit(""))))).alias("scope"),
        F.lit(1).cast("long").alias("event"))
    sample_scope = F.when(F.coalesce(scoped, F.lit(False)), F.coalesce("component", F.lit(""))).otherwise(F.lit(""))
    points = scoreable(samples).select(
        "source_row", "asset_id", sample_scope.alias("scope"), c.micros(F.col("sample_date")).alias("at"))
    if ahead_days is not None:
        ends = F.array(F.struct(F.lit(-1).alias("sign"), F.col("at").alias("at")),
                       F.struct(F.lit(1).alias("sign"), (F.col("at") + ahead_days * DAY).alias("at")))
        points = points.select("source_row", "asset_id", "scope", F.explode(ends).alias("_e")).select(
            "source_row", "asset_id", "scope", "_e.sign", "_e.at")
    totals = scans.running_totals(
        points.unionByName(events, allowMissingColumns=True), ["asset_id", "scope"], day_of(F.col("at")), "at",
        {"events": ("sum", F.col("event"))}, inclusive=ahead_days is not None,
    ).filter(F.col("source_row").isNotNull())
    found = F.coalesce("events", F.lit(0))
    if ahead_days is None:
        return totals.select("source_row", found.alias("events"))
    return totals.groupBy("source_row").agg(F.sum(F.col("sign") * found).alias("events"))


def prior_corrective_counts(samples: DataFrame, work_orders: DataFrame) -> DataFrame:
    """Confirmed corrective orders strictly before each sample; NULL for an asset without any order."""
    counts = _scoped_counts(samples, work_orders, None)
    covered = with_coverage(scoreable(samples).select("source_row", "asset_id"), work_orders)
    return covered.join(counts, "source_row", "left").select(
        "source_row", "work_order_history_available",
        F.when(F.col("work_order_history_available") > 0, F.col("events").cast("double"))
        .alias("prior_corrective_wo_count"))


def forward_labels(samples: DataFrame, work_orders: DataFrame, horizon_days: int) -> DataFrame:
    """1 when a confirmed corrective order opens within (sample, sample + horizon], else 0."""
    return _scoped_counts(samples, work_orders, horizon_days).select(
        "source_row", (F.col("events") > 0).cast("int").alias(fv.TARGET))


def sample_features(samples: DataFrame, telemetry: DataFrame | None) -> DataFrame:
    """Past-only features that rest on samples and telemetry alone, per dated sample with an asset."""
    trended = scoreable(add_trends(samples))
    featured = text_features(measurement_presence(trended))
    base = featured.select(
        "source_row", "sample_number", "asset_id", "sample_date", "machine_model", "component", "equipment_hours",
        "fluid_hours", "days_since_previous_sample", "lab_history_samples", "lab_measurement_count",
        "lab_numeric_available",
        F.upper(F.coalesce("interpretation_code", F.lit(""))).alias("lab_interpretation_code"),
        "lab_text_available", "lab_text_length_log",
        *[m + suffix for m in fv.MEASUREMENTS for suffix in ("", "_delta", "_rate_100h", "_mean_3")],
        *fv.TEXT_SIGNALS, "lab_text_signal_count",
    )
    if telemetry is None:
        missing = {name: F.lit(None).cast("double") for name in fv.TELEMETRY_PREDICTORS}
        return base.withColumns({**missing, "telemetry_available": F.lit(0.0)})
    return base.join(telemetry_features(samples, telemetry), "source_row", "left")


def build_scoring(samples: DataFrame, telemetry: DataFrame | None, work_orders: DataFrame | None,
                  features: DataFrame | None = None) -> DataFrame:
    """One row of past-only features per dated sample with an asset; `features` may hold written `sample_features`."""
    rows = sample_features(samples, telemetry) if features is None else features
    names = rows.columns
    at = names.index("lab_text_signal_count") + 1
    if work_orders is None:
        rows = rows.withColumns({"work_order_history_available": F.lit(0.0),
                                 "prior_corrective_wo_count": F.lit(None).cast("double")})
    else:
        rows = rows.join(prior_corrective_counts(samples, work_orders), "source_row", "left")
    return rows.select(*names[:at], "work_order_history_available", "prior_corrective_wo_count", *names[at:])


def observation_ends(work_orders: DataFrame) -> DataFrame:
    """Last stated observation date per asset, NULL where none is stated."""
    return work_orders.filter(F.col("asset_id").isNotNull()).groupBy("asset_id").agg(
        F.max("observation_end_date").alias("stated_end"))


def with_observation_end(samples: DataFrame, work_orders: DataFrame) -> DataFrame:
    """Stated end of the asset, else the largest stated end, else the last opening date."""
    extract_end = work_orders.agg(F.coalesce(F.max("observation_end_date"), F.max("opened_date"))).scalar()
    return samples.join(observation_ends(work_orders), "asset_id", "left").withColumn(
        "observation_end", F.coalesce("stated_end", extract_end)).drop("stated_end")


def fully_observed(samples: DataFrame, horizon_days: int) -> DataFrame:
    """Samples whose whole horizon lies inside the observed period."""
    end = F.col("sample_date") + F.expr(f"INTERVAL '{int(horizon_days)}' DAY")
    return samples.filter(end <= F.col("observation_end"))


def build_training(
    samples: DataFrame, telemetry: DataFrame | None, work_orders: DataFrame | None, horizon_days: int = 30,
    features: DataFrame | None = None,
) -> DataFrame | None:
    """Scoring features plus label, for covered assets and fully observed horizons, from stated outcomes only."""
    if work_orders is None:
        return None
    stated = explicit_only(work_orders)
    scoring = build_scoring(samples, telemetry, stated, features).join(covered_assets(stated), "asset_id", "left_semi")
    observed = fully_observed(with_observation_end(scoring, stated), horizon_days).drop("observation_end")
    return observed.join(forward_labels(samples, stated, horizon_days), "source_row", "left").withColumn(
        "horizon_days", F.lit(int(horizon_days)))


def matched_assets(samples: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Assets present in both sources."""
    present = [df.select("asset_id").filter(F.col("asset_id").isNotNull()) for df in (samples, telemetry)]
    return reduce(lambda a, b: a.intersect(b), present)


def unmatched_count(samples: DataFrame, matched: DataFrame) -> DataFrame:
    return samples.select("asset_id").join(matched, "asset_id", "left_anti").agg(F.count("*").alias("unmatched_rows"))


def matched_count(samples: DataFrame, matched: DataFrame) -> DataFrame:
    return samples.select("asset_id").join(matched, "asset_id", "left_semi").agg(F.count("*").alias("matched_rows"))
