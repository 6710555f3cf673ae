"""Work orders: canonical projection, corrective flag and outcome label source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tribolens.functions import cleaning as c
from tribolens.functions import fixed_values as fv
from tribolens.sources.headers import pick, quoted

DATES = ["opened_date", "closed_date", "observation_end_date"]


def explicit_outcome(value: Column) -> Column:
    """Stated outcome as a number; unclear text is NULL."""
    text = F.upper(c.strip(value))
    stated = (
        F.when(text.isin("TRUE", "T", "Y", "YES"), F.lit(1.0))
        .when(text.isin("FALSE", "F", "N", "NO"), F.lit(0.0))
    )
    return F.coalesce(c.number(value), stated)


def joined_text(df: DataFrame, columns: list[str]) -> Column:
    """The listed text columns that exist, blanks for NULL, joined by one space."""
    present = [F.coalesce(quoted(name).cast("string"), F.lit("")) for name in columns if name in df.columns]
    return F.concat_ws(" ", *present) if present else F.lit("")


def prepare_work_orders(raw: DataFrame, headers: dict[str, list[str]] | None = None) -> DataFrame:
    names = {**fv.WORK_ORDER_HEADERS, **(headers or {})}

    def col(name: str) -> Column:
        return pick(raw, names[name])[0]

    outcome = pick(raw, names["failure_confirmed"])[0]
    base = raw.select(
        c.identifier(col("asset_id")).alias("asset_id"),
        c.component_code(col("component")).alias("component"),
        c.identifier(col("wo_id")).alias("wo_id"),
        *[c.trimmed_timestamp(*pick(raw, names[name])).alias(name) for name in DATES],
        F.upper(F.coalesce(c.identifier(col("wo_type")), F.lit(""))).alias("wo_type"),
        joined_text(raw, fv.WORK_ORDER_TEXT_COLUMNS).alias("wo_text"),
        explicit_outcome(outcome.cast("int") if dict(raw.dtypes).get(_name(raw, names)) == "boolean" else outcome)
        .alias("_outcome"),
    )
    failure_text = c.matches(F.col("wo_text"), fv.FAILURE_TEXT_PATTERN)
    return base.select(
        "asset_id", "component", "wo_id", *DATES, "wo_type", "wo_text",
        (F.col("wo_type").rlike(fv.CORRECTIVE_TYPE_PATTERN) | failure_text).alias("is_corrective"),
        F.when(F.col("_outcome").isNotNull(), "explicit").otherwise("text_inferred").alias("failure_label_source"),
        F.coalesce(F.col("_outcome") != 0, failure_text).alias("confirmed_failure"),
    )


def _name(raw: DataFrame, names: dict[str, list[str]]) -> str | None:
    from tribolens.sources.headers import resolve

    return resolve(raw.columns, names["failure_confirmed"])


def confirmed_corrective(work_orders: DataFrame) -> DataFrame:
    """Orders that count as a confirmed corrective event, dated and tied to an asset."""
    return work_orders.filter(
        F.col("is_corrective") & F.col("confirmed_failure")
        & F.col("opened_date").isNotNull() & F.col("asset_id").isNotNull()
    )


def explicit_only(work_orders: DataFrame) -> DataFrame:
    """Orders whose outcome was stated, not inferred from text."""
    return work_orders.filter(F.col("failure_label_source") == "explicit")
