"""Dataset counters, readiness gates, operating mode and quality issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tribolens.functions import cleaning as c
from tribolens.functions import fixed_values as fv
from tribolens.operators.samples import has_measurement
from tribolens.operators.triage import SERIES


def repeated_unlinked(alerts: DataFrame) -> DataFrame:
    """Rows in (asset, component) groups with at least two new alerts that have no work order."""
    new_unlinked = alerts.filter((F.upper("status") == "NEW") & ~c.has_value(F.col("wo_id")))
    sizes = new_unlinked.groupBy(*SERIES).agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.when(F.col("n") >= 2, F.col("n"))), F.lit(0)).alias("repeated_new_unlinked_rows"))


def dataset_counters(alerts: DataFrame) -> DataFrame:
    """All counters as one row, from one conditional aggregation over the tiered alerts."""
    status = F.upper("status")
    new, closed = status == "NEW", status == "CLOSED"
    linked, urgent = c.has_value(F.col("wo_id")), c.is_high_priority(F.col("high_priority"))
    invalid, tier = F.coalesce("is_invalid_date", F.lit(False)), F.col("priority_tier")
    counted = {
        "lab_ar_samples": F.upper("interpretation_code") == "AR",
        "high_priority_samples": urgent,
        "new_alerts": new,
        "closed_alerts": closed,
        "wo_linked_samples": linked,
        "samples_without_wo": ~linked,
        "new_alerts_without_wo": new & ~linked,
        "invalid_date_samples": invalid,
        "valid_date_samples": ~invalid,
        "high_priority_new_without_wo": urgent & new & ~linked,
        "high_priority_new_with_wo": urgent & new & linked,
        "high_priority_closed": urgent & closed,
        "p1_immediate_records": tier == fv.P1_IMMEDIATE,
        "p1_wo_tracking_records": tier == fv.P1_WO_TRACKING,
        "p2_multiple_unlinked_records": tier == fv.P2_REPEATED,
        "p3_action_records": tier == fv.P3_ACTION,
    }
    row = alerts.agg(F.count_distinct("asset_id").alias("unique_assets"),
                     *[F.count_if(condition).alias(name) for name, condition in counted.items()])
    return row.select("*", repeated_unlinked(alerts).scalar().alias("repeated_new_unlinked_rows"))


def as_rows(counters: DataFrame, names: str = "metric", values: str = "value") -> DataFrame:
    return counters.unpivot([], counters.columns, names, values)


def numeric_series(samples: DataFrame) -> DataFrame:
    """Series with at least three dated samples that carry a measurement."""
    sizes = samples.filter(has_measurement() & ~F.col("is_invalid_date")).groupBy(*SERIES).agg(F.count("*").alias("n"))
    return sizes.agg(F.count_if(F.col("n") >= 3).alias("repeated_numeric_series"))


def text_coverage(samples: DataFrame) -> DataFrame:
    """Samples with a comment and how many different comments there are."""
    text = c.strip(F.col("interpretation_text"))
    per_text = samples.select(text.alias("t")).filter("t <> ''").groupBy("t").agg(F.count("*").alias("n"))
    return per_text.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("text_rows"), F.count("*").alias("text_variants"))


def sample_coverage(samples: DataFrame) -> DataFrame:
    dated = ~F.coalesce("is_invalid_date", F.lit(True))
    return samples.agg(
        F.count_if(has_measurement()).alias("numeric_samples"),
        F.count_if(dated).alias("dated_samples"),
        F.count_distinct(F.when(dated, F.col("sample_date"))).alias("distinct_dates"),
        F.count_distinct(F.upper("interpretation_code")).alias("distinct_codes"),
    )


def outcome_coverage(work_orders: DataFrame) -> DataFrame:
    """Stated outcomes and how many classes they show."""
    stated = F.col("failure_label_source") == "explicit"
    return work_orders.agg(
        F.count_if(stated).alias("explicit_rows"),
        F.count_distinct(F.when(stated, F.col("confirmed_failure"))).alias("explicit_classes"),
    )


def label_coverage(training: DataFrame) -> DataFrame:
    return training.agg(
        F.count("*").alias("labelled_rows"),
        F.count_if(F.col(fv.TARGET) == 1).alias("positives"),
        F.count_if(F.col(fv.TARGET) != 1).alias("negatives"),
        F.count_distinct("asset_id").alias("labelled_assets"),
        F.count_distinct(fv.TARGET).alias("label_classes"),
    )


def match_coverage(samples: DataFrame, matched: DataFrame) -> DataFrame:
    rows = samples.select("asset_id").join(matched, "asset_id", "left_semi").agg(F.count("*").alias("matched_rows"))
    return matched.agg(F.count("*").alias("matched_assets")).select(
        "matched_assets", rows.scalar().alias("matched_rows"))


def coverage(
    samples: DataFrame, matched: DataFrame | None, work_orders: DataFrame | None, training: DataFrame | None
) -> DataFrame:
    """One row with every count the gates look at. Absent sources count zero."""
    parts = [sample_coverage(samples), numeric_series(samples), text_coverage(samples)]
    absent: list[str] = []
    for df, build, names in (
        (work_orders, outcome_coverage, ["explicit_rows", "explicit_classes"]),
        (training, label_coverage, ["labelled_rows", "positives", "negatives", "labelled_assets", "label_classes"]),
        (matched, lambda m: match_coverage(samples, m), ["matched_assets", "matched_rows"]),
    ):
        if df is None:
            absent += names
        else:
            parts.append(build(df))
    # Every part is one row; an equal constant key joins them.
    row = parts[0].withColumn("_one", F.lit(1))
    for part in parts[1:]:
        row = row.join(F.broadcast(part.withColumn("_one", F.lit(1))), "_one")
    return row.drop("_one").select("*", *[F.lit(0).cast("long").alias(name) for name in absent])


def readiness(row: DataFrame) -> DataFrame:
    """Seven gates with status and detail from the coverage row."""
    col = F.col
    trends = (col("numeric_samples") >= 3) & (col("repeated_numeric_series") >= 1)
    texts = (col("text_rows") >= 15) & (col("text_variants") >= 2)
    labelled = ((col("labelled_rows") >= 60) & (col("label_classes") >= 2) & (col("positives") >= 15)
                & (col("negatives") >= 15) & (col("labelled_assets") >= 5))
    both_codes = col("distinct_codes") >= 2
    optional, prediction = "Optional enrichment", "Failure Prediction"
    # Gate, criterion, condition, detail layout, its counts, and what needs it.
    gates = [
        ("lab_predictors", "Enough usable S.O.S predictors exist", trends | texts,
         F.format_string("%d numerical sample(s); %d interpretation-text sample(s) with %d distinct text value(s) — "
                         "need ≥3 numeric or ≥15 text", "numeric_samples", "text_rows", "text_variants"), prediction),
        ("both_lab_classes", "Normal and abnormal S.O.S interpretation codes both exist (optional)", both_codes,
         F.when(both_codes, F.format_string("%d distinct codes found ✓", "distinct_codes")).otherwise(
             F.format_string("%d distinct code(s) — need ≥2 (e.g. A and AR)", "distinct_codes")), optional),
        ("numeric_trends", "Numerical laboratory trend history exists", trends,
         F.format_string("%d numerical sample(s); %d asset/component series have ≥3 dated samples — need ≥3 samples",
                         "numeric_samples", "repeated_numeric_series"), "Condition Monitoring + Failure Prediction"),
        ("explicit_wo_outcomes", "Explicit confirmed work-order outcomes exist",
         (col("explicit_rows") >= 20) & (col("explicit_classes") >= 2),
         F.format_string("%d explicit outcome row(s); %d outcome class(es) — need ≥20 rows and both classes",
                         "explicit_rows", "explicit_classes"), prediction),
        ("matched_assets", "S.O.S and telemetry IDs match across enough assets (optional)",
         (col("matched_assets") >= 2) & (col("matched_rows") >= 10),
         F.format_string("%d matched asset(s), covering %d S.O.S row(s) — need ≥2 assets and ≥10 rows",
                         "matched_assets", "matched_rows"), optional),
        ("labelled_training_rows", "Enough independently labelled training rows exist", labelled,
         F.format_string("%d labelled row(s); %d positive, %d negative, %d asset(s) — need ≥60 rows, ≥15/class and "
                         "≥5 assets", "labelled_rows", "positives", "negatives", "labelled_assets"), prediction),
        ("chronological_dates", "Enough valid calendar dates exist for chronological validation",
         (col("dated_samples") >= 60) & (col("distinct_dates") >= 12),
         F.format_string("%d valid dated sample(s) across %d date(s) — need ≥60 rows and ≥12 dates",
                         "dated_samples", "distinct_dates"), prediction),
    ]
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(gate).alias("gate"), F.lit(criterion).alias("criterion"),
                 F.when(passed, "PASS").otherwise("OPTIONAL" if needed == optional else "BLOCKED").alias("status"),
                 detail.alias("detail"), F.lit(needed).alias("required_for"))
        for gate, criterion, passed, detail, needed in gates])))


def select_mode(gates: DataFrame) -> DataFrame:
    """Operating mode from the gate rows."""
    def passes(names: list[str]) -> Column:
        return F.count_if(F.col("gate").isin(names) & (F.col("status") == "PASS")) >= len(names)

    return gates.agg(
        F.when(passes(fv.PREDICTION_GATES), fv.MODE_PREDICTION).when(passes(["numeric_trends"]), fv.MODE_CONDITION)
        .otherwise(fv.MODE_ALERT).alias("mode"))


def blocked_criteria(gates: DataFrame) -> DataFrame:
    return gates.filter(F.col("status") == "BLOCKED").select("gate", "criterion")


def fallback_mode(gates: list[Row]) -> str:
    """Mode once prediction is ruled out; takes the collected gate rows, at most a handful."""
    trends = any(row["gate"] == "numeric_trends" and row["status"] == "PASS" for row in gates)
    return fv.MODE_CONDITION if trends else fv.MODE_ALERT


def with_gate(gates: DataFrame, gate: str, criterion: str, passed: bool, detail: str) -> DataFrame:
    """Gate table with one more gate that prediction depends on."""
    extra = gates.sparkSession.createDataFrame(
        [(gate, criterion, "PASS" if passed else "BLOCKED", detail, "Failure Prediction")], gates.schema)
    return gates.unionByName(extra)


def quality_issues(samples: DataFrame, alerts: DataFrame, profile: DataFrame, matched: DataFrame | None) -> DataFrame:
    """Material quality issues with count, impact and remedy; one neutral row when there is none."""
    counts = samples.agg(
        F.count_if(F.coalesce("is_invalid_date", F.lit(True))).alias("invalid"),
        F.count_if(F.col("asset_id").isNull()).alias("missing_assets"),
        F.count_if(~has_measurement()).alias("no_numeric"),
        F.count("*").alias("total"),
    )
    if matched is None:
        unmatched = F.col("total")
    else:
        unmatched = F.col("total") - samples.select("asset_id").join(matched, "asset_id", "left_semi").agg(
            F.count("*")).scalar()
    review = alerts.agg(F.count_if(F.col("data_quality_status") == "Review required")).scalar()
    schema = F.coalesce(profile.select("schema_issue").scalar(), F.lit(""))
    row = counts.select(
        "*", unmatched.alias("unmatched"), review.alias("review"), c.strip(schema).alias("schema_issue"),
        profile.select("rows_before_deduplication").scalar().alias("telemetry_rows"),
        profile.select("duplicate_asset_timestamp_rows").scalar().alias("duplicates"))
    # Severity, issue, count column, impact, remedy.
    entries = [
        ("Warning", "Invalid telemetry schema", F.col("telemetry_rows"), F.col("schema_issue"),
         "Provide machine time-series telemetry with an asset identifier and event timestamp; "
         "do not upload enum/reference dictionaries.", F.col("schema_issue") != ""),
        ("Blocker", "Invalid or time-only sample dates", F.col("invalid"),
         F.lit("Date-dependent trends and response-time analysis exclude these rows."),
         "Supply a complete calendar date for DateSampled.", F.col("invalid") > 0),
        ("Blocker", "Missing asset identifiers", F.col("missing_assets"),
         F.lit("S.O.S, telemetry and WO records cannot be joined reliably."),
         "Populate EquipNum or a stable equipment identifier.", F.col("missing_assets") > 0),
        ("Warning", "Samples without structured numerical laboratory measurements", F.col("no_numeric"),
         F.lit("Engineering text triage remains available, but numerical degradation trends are limited."),
         "Include Fe, Cu, Si, Water, FuelDilution, Soot, Viscosity, Oxidation and TBN where available.",
         F.col("no_numeric") > 0),
        ("Information", "S.O.S rows without matched telemetry", F.col("unmatched"),
         F.lit("These records use the other available predictors; telemetry is optional."),
         "If telemetry exists for these machines, align EquipNum and TMSAssetID or provide an approved mapping table.",
         F.col("unmatched") > 0),
        ("Information", "Duplicate telemetry asset/timestamp rows", F.col("duplicates"),
         F.lit("Duplicates were resolved by retaining the most recently modified record."),
         "Review source-system duplicate generation if the count grows.", F.col("duplicates") > 0),
    ]

    def entry(severity: str, issue: str, count: Column, impact: Column, fix: str) -> Column:
        return F.struct(F.lit(severity).alias("severity"), F.lit(issue).alias("issue"),
                        count.cast("long").alias("count"), impact.alias("impact"), F.lit(fix).alias("fix"))

    found = F.array_compact(F.array(*[F.when(holds, entry(*parts)) for *parts, holds in entries]))
    nothing = entry("Information", "No material quality issue detected", F.lit(0),
                    F.lit("The supplied rows passed the configured checks."),
                    "Continue monitoring data coverage and units.")
    return row.select(F.inline(
        F.when((F.size(found) == 0) & (F.col("review") == 0), F.array(nothing)).otherwise(found)))
