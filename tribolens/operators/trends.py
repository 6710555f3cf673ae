"""Sample trends per (asset, component)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tribolens.functions import cleaning as c
from tribolens.functions import fixed_values as fv
from tribolens.plans import scans

SERIES = ["asset_id", "component"]


def add_trends(samples: DataFrame, rows_per_segment: int = scans.ROWS_PER_SEGMENT) -> DataFrame:
    """Previous sample, deltas, rates per 100 fluid hours, rolling means and the running sample number."""
    rows = scans.split_series(samples, SERIES, "sample_date", "source_row", depth=2,
                              carried=["fluid_hours", *fv.MEASUREMENTS], rows_per_segment=rows_per_segment)
    # One window specification for every column: one exchange and one sort.
    series = Window.partitionBy(*SERIES, "_seg").orderBy(F.col("sample_date").asc_nulls_last(), "source_row")
    so_far = series.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    windowed = rows.select(
        *rows.columns,
        F.lag("sample_date").over(series).alias("previous_sample_date"),
        F.lag("fluid_hours").over(series).alias("previous_fluid_hours"),
        *[F.lag(m, n).over(series).alias(f"_{m}_{n}") for m in fv.MEASUREMENTS for n in (1, 2)],
        (F.count(F.when(~F.col("_copy"), 1)).over(so_far)
         + F.coalesce(F.max("_before").over(so_far), F.lit(0))).alias("lab_history_samples"),
    ).filter(~F.col("_copy"))
    step = F.col("fluid_hours") - F.col("previous_fluid_hours")
    helpers = [f"_{m}_{n}" for m in fv.MEASUREMENTS for n in (1, 2)]
    return windowed.withColumns({
        "days_since_previous_sample": c.elapsed_days(F.col("sample_date"), F.col("previous_sample_date")),
        "fluid_hours_delta": step,
        **{m + "_delta": F.col(m) - F.col(f"_{m}_1") for m in fv.MEASUREMENTS},
        **{m + "_rate_100h": F.when(step > 0, 100 * (F.col(m) - F.col(f"_{m}_1")) / step) for m in fv.MEASUREMENTS},
        **{m + "_mean_3": _mean_of_three(m) for m in fv.MEASUREMENTS},
    }).drop("_seg", "_copy", "_before", *helpers)


def _mean_of_three(m: str) -> Column:
    """Mean of the present ones among a value and the two before it: plain arithmetic instead of a sliding frame."""
    values = [F.col(f"_{m}_2"), F.col(f"_{m}_1"), F.col(m)]
    present = sum((v.isNotNull().cast("int") for v in values[1:]), values[0].isNotNull().cast("int"))
    return c.null_skipping_sum(*values) / F.nullif(present, F.lit(0))


def series_trend(samples: DataFrame, asset_id: str, component: str,
                 rows_per_segment: int = scans.ROWS_PER_SEGMENT) -> DataFrame:
    """Trends of the dated rows of one series; the filter comes first, so only that series is shuffled."""
    chosen = samples.filter((F.col("asset_id") == asset_id) & (F.col("component") == component)
                            & ~F.col("is_invalid_date"))
    return add_trends(chosen, rows_per_segment)


def latest_changes(trend: DataFrame, limit: int = 4) -> DataFrame:
    """Latest against previous present value per measurement, the `limit` largest changes of each series.

    Both rank filters become per-task limits below their exchange.
    """
    values = trend.select(
        *SERIES, "sample_date", "source_row",
        F.explode(F.array(*[
            F.struct(F.lit(m).alias("measurement"), F.col(m).alias("value"), F.col(m + "_rate_100h").alias("rate"))
            for m in fv.MEASUREMENTS])).alias("_m"),
    ).select(*SERIES, "sample_date", "source_row", "_m.*").filter(F.col("value").isNotNull())
    newest = Window.partitionBy(*SERIES, "measurement").orderBy(
        F.col("sample_date").desc_nulls_first(), F.col("source_row").desc())
    ranked = values.withColumn("_n", F.row_number().over(newest)).filter("_n <= 2")
    pairs = ranked.groupBy(*SERIES, "measurement").agg(
        F.max(F.when(F.col("_n") == 1, F.col("value"))).alias("current"),
        F.max(F.when(F.col("_n") == 2, F.col("value"))).alias("previous"),
        F.max(F.when(F.col("_n") == 1, F.col("rate"))).alias("rate_per_100h"),
    )
    change = F.col("current") - F.col("previous")
    labels = c.lookup({m: label for m, (label, _) in fv.MEASUREMENT_LABELS.items()})
    units = c.lookup({m: unit for m, (_, unit) in fv.MEASUREMENT_LABELS.items()})
    table = pairs.select(
        *SERIES, "measurement",
        F.try_element_at(labels, F.col("measurement")).alias("measurement_name"),
        F.try_element_at(units, F.col("measurement")).alias("unit"),
        "current", "previous", change.alias("change"),
        F.when(F.col("previous") != 0, change / F.abs("previous") * 100).alias("change_pct"),
        "rate_per_100h",
        F.coalesce(F.abs(change), F.lit(0.0)).alias("absolute_change"),
    )
    largest = Window.partitionBy(*SERIES).orderBy(F.col("absolute_change").desc(), "measurement")
    return table.withColumn("change_rank", F.row_number().over(largest)).filter(F.col("change_rank") <= limit)
