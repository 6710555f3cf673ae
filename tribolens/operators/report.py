"""Triage report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tribolens.functions import cleaning as c
from tribolens.functions import fixed_values as fv

P1 = [fv.P1_IMMEDIATE, fv.P1_WO_TRACKING]


def report_counts(alerts: DataFrame) -> DataFrame:
    """Header and linkage counts of the report as one row."""
    linked, new = c.has_value(F.col("wo_id")), F.upper("status") == "NEW"
    return alerts.agg(
        F.count("*").alias("samples"),
        F.count_distinct("asset_id").alias("unique_assets"),
        F.count_if(F.upper("interpretation_code") == "AR").alias("lab_ar_samples"),
        F.count_if(F.col("priority_tier").isin(P1)).alias("p1_alerts"),
        F.count_if(F.col("priority_tier") == fv.P2_REPEATED).alias("p2_alerts"),
        F.count_if(F.col("priority_tier") == fv.P3_ACTION).alias("p3_alerts"),
        F.count_if("is_invalid_date").alias("invalid_dates"),
        F.count_if(linked).alias("wo_linked_samples"),
        F.count_if(~linked).alias("samples_without_wo"),
        F.count_if(new & ~linked).alias("new_alerts_without_wo"),
    )


def first_p1_rows(alerts: DataFrame, limit: int = 5) -> DataFrame:
    """First P1 alerts in row order."""
    return alerts.filter(F.col("priority_tier").isin(P1)).orderBy("source_row").limit(limit).select(
        "source_row", "asset_id", "component", "priority_tier", "priority_reason", "lab_status", "evidence_level",
        "recommended_action")


def readiness_lines(gates: DataFrame) -> DataFrame:
    return gates.select("status", "criterion", "detail")
