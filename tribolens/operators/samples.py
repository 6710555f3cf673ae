"""Laboratory samples: canonical projection and per-row features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tribolens.functions import cleaning as c
from tribolens.functions import fixed_values as fv
from tribolens.sources.headers import pick

IDENTIFIERS = ["serial_number", "machine_model", "sample_number", "fluid_changed", "filter_changed", "high_priority",
               "wo_id", "wo_status", "status", "site_name"]
DEFAULTS = {"status": "New", "site_name": "Unknown"}
NUMBERS = ["equipment_hours", "fluid_hours", *fv.MEASUREMENTS]


def prepare_samples(raw: DataFrame, row_key: str, headers: dict[str, list[str]] | None = None) -> DataFrame:
    """Canonical samples. `row_key` names a column with a unique value per row.

    Three plain projections: trimmed cells, parsed date, results. Values used more than once are thus computed once.
    """
    names = {**fv.SAMPLE_HEADERS, **fv.MEASUREMENT_HEADERS, **(headers or {})}

    def col(name: str) -> Column:
        return pick(raw, names[name], DEFAULTS.get(name))[0]

    raw_date, date_type = pick(raw, names["sample_date"])
    is_text = isinstance(date_type, T.StringType)
    trimmed = raw.select(
        F.col(row_key).alias("source_row"),
        *[c.strip(col(name)).alias(name) for name in ["asset_id", "interpretation_code", "component", *IDENTIFIERS]],
        c.text_or(col("interpretation_text")).alias("interpretation_text"),
        raw_date.cast("string").alias("sample_date_raw"),
        c.strip(raw_date).alias("_date"),
        *([] if is_text else [c.timestamp(raw_date, date_type).alias("_parsed")]),
        *[c.number(col(name)).alias(name) for name in NUMBERS],
    )
    if is_text:
        trimmed = trimmed.withColumn("_parsed", F.when(
            ~c.is_time_only(F.col("_date")), c.timestamp(F.col("_date"), date_type)))
    dated = trimmed.withColumn("date_quality_issue", c.date_issue(F.col("_date"), F.col("_parsed")))
    serial = c.known(F.col("serial_number"))
    return dated.select(
        "source_row", F.coalesce(c.known(F.col("asset_id")), serial).alias("asset_id"),
        *[c.known(F.col(name)).alias(name) for name in IDENTIFIERS[:2]],
        c.component_code(F.col("component")).alias("component"),
        F.when(c.date_in_range(F.col("_parsed")), F.col("_parsed")).alias("sample_date"),
        "sample_date_raw", "date_quality_issue", F.col("date_quality_issue").isNotNull().alias("is_invalid_date"),
        F.upper(c.known(F.col("interpretation_code"))).alias("interpretation_code"), "interpretation_text",
        *[c.known(F.col(name)).alias(name) for name in IDENTIFIERS[2:]], *NUMBERS,
    )


def measurement_count() -> Column:
    return reduce(lambda a, b: a + b, [F.col(name).isNotNull().cast("int") for name in fv.MEASUREMENTS])


def has_measurement() -> Column:
    return F.coalesce(*fv.MEASUREMENTS).isNotNull()


def measurement_presence(samples: DataFrame) -> DataFrame:
    """How many of the measurements a sample carries."""
    return samples.withColumns({
        "lab_measurement_count": measurement_count(),
        "lab_numeric_available": has_measurement().cast("double"),
    })


def text_features(samples: DataFrame) -> DataFrame:
    """Length, availability and pattern signals of the laboratory comment."""
    text = c.strip(F.col("interpretation_text"))
    signals = {name: c.matches(text, pattern).cast("double") for name, pattern in fv.TEXT_SIGNALS.items()}
    return samples.withColumns({
        "lab_text_available": (text != "").cast("double"),
        "lab_text_length_log": F.log1p(F.length(text).cast("double")),
        **signals,
    }).withColumn("lab_text_signal_count", reduce(lambda a, b: a + b, [F.col(name) for name in signals]))
