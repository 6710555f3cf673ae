"""Long laboratory results: latest snapshot, cleaning, unit checks, pivot and fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tribolens.functions import cleaning as c
from tribolens.functions import fixed_values as fv
from tribolens.plans.storage import materialise
from tribolens.sources.headers import pick, quoted, resolve


PLACED = "_placed_sample"
# A sample has a handful of results; those of so many samples are sorted in the memory of one task.
SAMPLES_PER_TASK = 250_000


def place_by_sample(lines: DataFrame) -> DataFrame:
    """Rows that long results are made from, exchanged by canonical sample key ahead of being multiplied; rows without one are left out.

    They are a fraction of the results, which then need no exchange at all.
    """
    sample = resolve(lines.columns, fv.DETAIL_HEADERS["sample"])
    tasks = max(lines.sparkSession.sparkContext.defaultParallelism, -(-lines.count() // SAMPLES_PER_TASK))
    keyed = lines.withColumn(PLACED, c.identifier(quoted(sample))).filter(F.col(PLACED).isNotNull())
    return keyed.repartition(tasks, PLACED)


def read_details(raw: DataFrame, row_key: list[str]) -> DataFrame:
    """Canonical long results. Raises when sample, name or value cannot be found."""
    names = {key: resolve(raw.columns, candidates) for key, candidates in fv.DETAIL_HEADERS.items()}
    if any(names[key] is None for key in ("sample", "name", "value")):
        raise ValueError("long results need a sample key, a result name and a result value column")
    comment = F.lit("") if names["comment"] is None else c.text_or(quoted(names["comment"]))
    units = F.lit("") if names["units"] is None else F.upper(c.strip(quoted(names["units"])))
    modified = c.trimmed_timestamp(*pick(raw, fv.DETAIL_HEADERS["modified"]))
    name = F.upper(c.strip(quoted(names["name"])))
    result_id = name if names["result_id"] is None else c.identifier(quoted(names["result_id"]))
    sample = F.col(PLACED) if PLACED in raw.columns else c.identifier(quoted(names["sample"]))
    return raw.select(
        sample.alias("sample_key"),
        name.alias("result_name"),
        c.number(quoted(names["value"])).alias("value"),
        units.alias("units"),
        modified.alias("modified"),
        result_id.alias("result_id"),
        c.matches(comment, fv.ANALYSIS_PREVENTED_PATTERN).alias("analysis_prevented"),
        F.struct(*row_key).alias("row_key"),
    )


def latest_snapshots(details: DataFrame, placed: bool = False) -> DataFrame:
    """One row per (sample, result id): the last modified, undated snapshots first.

    Rows are exchanged by sample, unsorted: rows of a sample mostly lie together and stay so, which packs them well, and no
    task has to sort its whole input before the exchange. Rows without a sample are divided by result id. `placed` rows, all of
    a sample, stay where they are.
    """
    if placed:
        return _latest(details, "sample_key", "result_id")
    part = F.when(F.col("sample_key").isNull(), F.col("result_id"))
    placed = details.withColumn("_part", part).repartition("sample_key", "_part")
    return _latest(placed, "sample_key", "_part", "result_id").drop("_part")


def _latest(details: DataFrame, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("modified").desc_nulls_last(), F.col("row_key").desc())
    return details.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def without_placeholders(details: DataFrame) -> DataFrame:
    """A zero reported where the analysis was prevented is no measurement."""
    return details.withColumn("value", F.when(~(F.col("analysis_prevented") & (F.col("value") == 0)), F.col("value")))


def with_measurement(details: DataFrame) -> DataFrame:
    """Output column of each known result name, NULL for others."""
    return details.withColumn("measurement", F.try_element_at(c.lookup(fv.RESULT_COLUMNS), F.col("result_name")))


def unit_accepted() -> Column:
    """True when the unit is listed for the measurement, or the measurement has no list."""
    accepted = F.lit(True)
    for measurement, units in fv.ACCEPTED_UNITS.items():
        accepted = F.when(F.col("measurement") == measurement, F.coalesce(F.col("units").isin(units), F.lit(False))
                          ).otherwise(accepted)
    return accepted


def with_checked_units(details: DataFrame) -> DataFrame:
    return details.withColumn("value", F.when(unit_accepted(), F.col("value")))


def with_water_percent(details: DataFrame) -> DataFrame:
    """Water reported in parts per million, expressed in percent."""
    ppm = (F.col("measurement") == "WaterPct") & F.col("units").isin(fv.WATER_PPM_UNITS)
    return details.withColumn("value", F.when(ppm, F.col("value") / 10_000.0).otherwise(F.col("value")))


def one_per_measurement(details: DataFrame) -> DataFrame:
    """One value per (sample, measurement): undated wins, then latest, then plain WATER over TOTAL WATER."""
    priority = F.when(F.col("result_name") == "WATER", 2).otherwise(1)
    order = Window.partitionBy("sample_key", "measurement").orderBy(
        F.col("modified").desc_nulls_first(), priority.desc(), F.col("row_key").desc())
    usable = details.filter("sample_key IS NOT NULL AND measurement IS NOT NULL AND value IS NOT NULL")
    return usable.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def wide_details(picked: DataFrame) -> DataFrame:
    """One row per sample, one column per measurement; expects one value per (sample, measurement)."""
    return picked.groupBy("sample_key").agg(
        *[F.max(F.when(F.col("measurement") == n, F.col("value"))).alias(n) for n in fv.DETAIL_COLUMNS])


def picked_details(details: DataFrame, placed: bool = False) -> DataFrame:
    """All steps from canonical results to one value per (sample, measurement), with one exchange, or none of `placed` rows.

    Results without a sample count for nothing here; the others are exchanged by sample, which serves both rankings and the pivot.
    """
    if not placed:
        details = details.filter("sample_key IS NOT NULL").repartition("sample_key")
    details = _latest(details, "sample_key", "result_id")
    for step in (without_placeholders, with_measurement, with_checked_units, with_water_percent, one_per_measurement):
        details = step(details)
    return details


def clean_details(raw: DataFrame, row_key: list[str]) -> DataFrame:
    return picked_details(read_details(raw, row_key), PLACED in raw.columns)


def enrich_samples(history: DataFrame, details: DataFrame | None, detail_key: list[str]) -> DataFrame:
    """Fill (never overwrite) history measurements from the long results."""
    if details is None:
        return history
    sample = resolve(history.columns, fv.DETAIL_HEADERS["sample"])
    if sample is None:
        raise ValueError("the sample history needs a sample key column")
    wide = wide_details(clean_details(details, detail_key)).select(
        F.col("sample_key").alias("_sample_key"), *[F.col(n).alias("_d_" + n) for n in fv.DETAIL_COLUMNS])
    shadowed = [n for n in fv.DETAIL_COLUMNS if resolve(history.columns, [n]) is None and _other_header(history, n)]
    fills = {}
    if shadowed:
        # Written once: both the flags and the join read it.
        wide = materialise(wide)
        fills = wide.agg(*[F.bool_or(F.col("_d_" + n).isNotNull()).alias(n) for n in shadowed]).first().asDict()
    joined = history.withColumn("_key", c.identifier(quoted(sample))).join(
        wide, F.col("_key") == F.col("_sample_key"), "left")
    filled, added = {}, {}
    for name in fv.DETAIL_COLUMNS:
        present = resolve(history.columns, [name])
        other = _other_header(history, name)
        if present is None and other is not None:
            # A separate column shadows the other header, but only if some result fills it.
            added[name] = F.col("_d_" + name) if fills[name] else c.number(quoted(other))
        elif present is None:
            added[name] = F.col("_d_" + name)
        else:
            filled[present] = F.coalesce(c.number(quoted(present)), F.col("_d_" + name))
    return joined.select(
        *[filled[n].alias(n) if n in filled else quoted(n) for n in history.columns],
        *[column.alias(n) for n, column in added.items()],
    )


def _other_header(history: DataFrame, name: str) -> str | None:
    """Another header of the same measurement in the history, which a column called `name` would shadow."""
    aliases = next(names for names in fv.MEASUREMENT_HEADERS.values() if name in names)
    after = aliases[aliases.index(name) + 1:]
    return resolve(history.columns, after) if after else None
