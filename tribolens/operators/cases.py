"""Action cards, one operational case per (asset, component), and fleet totals.

Everything per case is an aggregation with map-side combining; no case history is gathered into a list.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tribolens.functions import cleaning as c
from tribolens.functions import fixed_values as fv
from tribolens.operators import point_in_time, triage
from tribolens.operators.samples import has_measurement
from tribolens.operators.triage import SERIES, risk_drivers
from tribolens.plans import scans
from tribolens.plans.storage import materialise


def with_sources(rows: DataFrame, scoring: DataFrame) -> DataFrame:
    """Rows with the two availability flags of their scoring row, false without one."""
    available = scoring.select(
        F.col("source_row").alias("_row"),
        (F.coalesce("telemetry_available", F.lit(0.0)) > 0).alias("_telemetry"),
        (F.coalesce("work_order_history_available", F.lit(0.0)) > 0).alias("_orders"))
    return rows.join(available, F.col("source_row") == F.col("_row"), "left").drop("_row").withColumns({
        "telemetry_available": F.coalesce("_telemetry", F.lit(False)),
        "work_order_history_available": F.coalesce("_orders", F.lit(False)),
    })


def data_sources() -> Column:
    """Names of the sources that a row with availability flags rests on."""
    return F.concat_ws(", ", F.lit("S.O.S."), F.when(F.col("telemetry_available"), "telemetry"),
                       F.when(F.col("work_order_history_available"), "work-order history"))


def action_cards(
    alerts: DataFrame,
    scoring: DataFrame | None,
    probabilities: DataFrame | None = None,
    anomaly_scores: DataFrame | None = None,
    model_features: list[str] | None = None,
    measurements: DataFrame | None = None,
    kept: list[str] | None = None,
) -> DataFrame:
    """One card per alert: evidence, data sources and, if a model is in use, its probability.

    Without `scoring` the alerts carry the two availability flags. `measurements` optionally joins sample measurements for the numeric evidence; the default flow has none.
    """
    rows = alerts if scoring is None else with_sources(alerts, scoring)
    if measurements is not None:
        rows = rows.join(measurements, "source_row", "left")
    if probabilities is None:
        rows = rows.withColumn("failure_probability_pct", F.lit(None).cast("int"))
    else:
        pct = F.bround(F.col("probability") * 100, 0).cast("int")
        rows = rows.join(probabilities.select("source_row", pct.alias("failure_probability_pct")), "source_row", "left")
    if anomaly_scores is None:
        rows = rows.withColumn("telemetry_anomaly_score", F.lit(None).cast("double"))
    else:
        rows = rows.join(anomaly_scores, "asset_id", "left")
    pct, active = F.col("failure_probability_pct"), probabilities is not None
    # Badges, risk texts and source names.
    badge = (
        F.when(pct.isNull(), "🔒 Not Available").when(pct >= 70, "🔴 HIGH MODEL PROBABILITY")
        .when(pct >= 40, "🟡 MEDIUM MODEL PROBABILITY").otherwise("🟢 LOW MODEL PROBABILITY"))
    unavailable = ("Predicted Failure Risk: Not Available for this sample" if active
                   else "Predicted Failure Risk: Not Available — insufficient labelled data")
    risk = F.when(pct.isNull(), unavailable).otherwise(
        F.concat(pct.cast("string"), F.lit("% model-estimated event probability")))
    return rows.select(
        "source_row", "sample_number", "asset_id", "component", "site_name", "machine_model", "sample_date",
        "sample_date_raw", "is_invalid_date", "data_quality_status", "data_quality_issue", "interpretation_code",
        "lab_status", "priority_tier", "priority_reason", "rule_evidence_strength", "evidence_level",
        risk_drivers(rows.columns, model_features if active else None).alias("key_evidence"),
        F.col("recommended_action").alias("action_needed"), "wo_id", "wo_status", "status", "high_priority",
        risk.alias("predicted_risk_status"), "failure_probability_pct", badge.alias("risk_badge"),
        "telemetry_anomaly_score", data_sources().alias("prediction_data_sources"), "telemetry_available",
        "work_order_history_available", F.col("priority_tier").alias("workflow_priority"),
        F.col("priority_reason").alias("priority_evidence"), F.col("priority_tier").alias("operational_priority"),
        *kept or [],
    )


def tier_rank(tier: Column) -> Column:
    ranks = {name: rank for rank, name in enumerate(fv.TIERS)}
    return F.coalesce(F.try_element_at(c.lookup(ranks), tier), F.lit(9))


def selected_findings(cards: DataFrame) -> DataFrame:
    """The card that represents each case: open before closed, best rank, newest, last row.

    The rank filter limits every task to one row per case before the shuffle.
    """
    order = Window.partitionBy(*SERIES).orderBy(
        F.col("priority_tier") == fv.CLOSED, tier_rank(F.col("priority_tier")),
        F.coalesce("sample_date", F.lit("1900-01-01").cast("timestamp_ntz")).desc(), F.col("source_row").desc())
    return cards.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")




def case_history(cards: DataFrame) -> DataFrame:
    """Latest dated row and latest probability of each case, with row counts."""
    scored = F.when(F.col("failure_probability_pct").isNotNull(), newest())
    return cards.groupBy(*SERIES).agg(
        *row_history(),
        F.max_by("failure_probability_pct", scored).cast("double").alias("failure_probability_pct"),
        F.max_by("prediction_data_sources", scored).alias("_scored_sources"))


def newest() -> Column:
    return F.struct(F.coalesce("sample_date", F.lit("1900-01-01").cast("timestamp_ntz")), F.col("source_row"))


def row_history() -> list[Column]:
    """What the history of a case takes from its rows alone, whether alerts or cards."""
    dated = F.struct(F.col("sample_date").isNotNull(), F.col("sample_date"), F.col("source_row"))
    return [
        F.max("sample_date").alias("latest_sample_date"),
        F.max_by("lab_status", dated).alias("latest_lab_status"),
        F.count_if(F.col("priority_tier") != fv.CLOSED).alias("open_sample_count"),
        F.count("*").alias("total_sample_count"),
    ]


def history_of_alerts(
    alerts: DataFrame, telemetry: DataFrame, work_orders: DataFrame, probabilities: DataFrame
) -> DataFrame:
    """`case_history` without cards: only keys and dates meet the probabilities, only the row taken meets its sources."""
    pct = F.bround(F.col("probability") * 100, 0).cast("int").alias("pct")
    given = probabilities.select("source_row", pct).filter("pct IS NOT NULL")
    scored = alerts.select("source_row", *SERIES, "sample_date").join(given, "source_row").groupBy(*SERIES).agg(
        F.max_by(F.struct("pct", "source_row", "sample_date"), newest()).alias("_s"))
    scored = materialise(scored.select(*SERIES, F.col("_s.pct").cast("double").alias("failure_probability_pct"),
                                       "_s.source_row", "_s.sample_date"))
    sources = with_sources(scored, point_in_time.availability(scored, telemetry, work_orders)).select(
        *SERIES, "failure_probability_pct", data_sources().alias("_scored_sources"))
    return scans.join_on(alerts.groupBy(*SERIES).agg(*row_history()), sources, SERIES)


def source_flags(cases: DataFrame, telemetry: DataFrame | None, work_orders: DataFrame | None) -> DataFrame:
    """Whether the asset of each case has telemetry and work orders."""
    for name, source in (("has_telemetry", telemetry), ("has_orders", work_orders)):
        if source is None:
            cases = cases.withColumn(name, F.lit(False))
        else:
            assets = source.select("asset_id").filter(F.col("asset_id").isNotNull()).distinct().withColumn(
                name, F.lit(True))
            cases = cases.join(assets, "asset_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return cases


def series_sizes(samples: DataFrame) -> DataFrame:
    dated = ~F.coalesce("is_invalid_date", F.lit(True))
    return samples.groupBy(*SERIES).agg(
        F.count_if(dated).alias("dated_rows"), F.count_if(dated & has_measurement()).alias("numeric_rows"))


def case_confidence(samples: DataFrame, telemetry: DataFrame | None, work_orders: DataFrame | None) -> DataFrame:
    """Data confidence of each case from history depth and available sources."""
    rows = source_flags(series_sizes(samples), telemetry, work_orders)
    return rows.select(*SERIES, *confidence(), "dated_rows", "numeric_rows", "has_telemetry", "has_orders")


def confidence() -> list[Column]:
    """Data confidence and its reason from the row counts and sources of a case."""
    deep, some = F.col("numeric_rows") >= 3, F.col("dated_rows") >= 2
    points = (F.when(deep, 2).when(some, 1).otherwise(0)
              + F.col("has_telemetry").cast("int") + F.col("has_orders").cast("int"))
    # Reason texts.
    reason = F.concat_ws(
        "; ",
        F.when(deep, F.format_string("%d dated numerical samples", "numeric_rows"))
        .when(some, F.format_string("%d dated samples", "dated_rows")).otherwise("limited dated sample history"),
        F.when(F.col("has_telemetry"), "matched telemetry available").otherwise("no matched telemetry"),
        F.when(F.col("has_orders"), "detailed work-order history available")
        .otherwise("detailed WO outcome unavailable"))
    return [F.when(points >= 4, "High").when(points >= 2, "Medium").otherwise("Low").alias("data_confidence"),
            reason.alias("confidence_reason")]


# Severities with the words that a laboratory status of each holds.
SEVERITY_WORDS = {2: "action required|severe|critical", 1: "warning|monitor", 0: "normal"}


def status_severity(status: Column) -> Column:
    text, severity = F.lower(status), F.lit(None).cast("int")
    for value, words in reversed(SEVERITY_WORDS.items()):
        severity = F.when(text.rlike(words), value).otherwise(severity)
    return severity


def severity_of(status: str) -> int | None:
    """`status_severity` of one text."""
    return next((value for value, words in SEVERITY_WORDS.items() if re.search(words, status.lower())), None)


def status_runs(alerts: DataFrame) -> DataFrame:
    """Latest and prior severity of each case and the length and start of its latest run.

    The last position of every severity tells where the latest run starts after; only rows behind that position
    are counted, so no window over a case is needed.
    """
    at = F.struct("sample_date", "source_row")
    dated = alerts.filter(~F.coalesce("is_invalid_date", F.lit(True))).select(
        *SERIES, "sample_date", "source_row", "recommended_action", "original_interpretation",
        status_severity(F.col("lab_status")).alias("severity"))
    ends = dated.groupBy(*SERIES).agg(
        *[F.max(F.when(F.col("severity") == s, at)).alias(f"_last_{s}") for s in SEVERITIES],
        F.count("*").alias("dated_statuses"), F.count("severity").alias("known_statuses"),
        F.count_if(F.col("severity") == 2).alias("abnormal_statuses"),
        F.max("sample_date").alias("latest_date"),
        F.max_by(F.concat_ws(" ", "recommended_action", "original_interpretation"), at).alias("timing_text"))
    ends = with_latest_severities(ends).select(
        *SERIES, "dated_statuses", "known_statuses", "abnormal_statuses", "latest_date", "timing_text",
        "latest_severity", "_other", "_after")
    runs = (
        scans.join_on(dated.filter(F.col("severity").isNotNull()), ends.select(*SERIES, "_after"), SERIES, "inner")
        .filter(F.col("_after").isNull() | (at > F.col("_after")))
        .groupBy(*SERIES).agg(F.count("*").alias("run_length"), F.min("sample_date").alias("run_start")))
    joined = scans.join_on(ends, runs, SERIES)
    return joined.withColumn("prior_severity", prior_severity()).drop("_other", "_after")


SEVERITIES = range(3)


def with_latest_severities(ends: DataFrame) -> DataFrame:
    """Latest severity, the latest other one and its position, from the last position of each."""
    ranked = F.reverse(F.array_sort(F.array_compact(F.array(*[
        F.when(F.col(f"_last_{s}").isNotNull(), F.struct(F.col(f"_last_{s}").alias("at"), F.lit(s).alias("severity")))
        for s in SEVERITIES]))))
    return ends.withColumn("_ranked", ranked).withColumns({
        "latest_severity": F.get("_ranked", 0)["severity"], "_other": F.get("_ranked", 1)["severity"],
        "_after": F.get("_ranked", 1)["at"]}).drop("_ranked")


def prior_severity() -> Column:
    return F.when(F.col("run_length") >= 2, F.col("latest_severity")).otherwise(F.col("_other"))


def condition_outlook(
    alerts: DataFrame, samples: DataFrame, telemetry: DataFrame | None, work_orders: DataFrame | None
) -> DataFrame:
    """Trajectory, persistence, checkpoint and confidence of the next laboratory condition per case."""
    cases = alerts.select(*SERIES).distinct()
    rows = scans.join_on(cases, status_runs(alerts), SERIES)
    rows = scans.join_on(rows, case_confidence(samples, telemetry, work_orders), SERIES)
    return rows.select(*SERIES, *outlook())


def outlook() -> list[Column]:
    """The outlook of a case from its status runs, numerical samples and sources."""
    latest, prior, run = F.col("latest_severity"), F.col("prior_severity"), F.col("run_length")
    run_days = c.elapsed_days(F.col("latest_date"), F.col("run_start"))
    # First trajectory that holds, with its outlook.
    outcomes = [
        (F.col("dated_statuses").isNull() | latest.isNull(), "Insufficient history",
         "A forward condition outlook cannot be formed yet."),
        ((latest >= 2) & (run >= 2), "Persistent abnormal",
         "Elevated chance that the next laboratory sample remains action-required "
         "unless the identified cause is removed and the repair is confirmed by resampling."),
        (latest > prior, "Worsening",
         "The latest status deteriorated; the next sample has an elevated chance of "
         "remaining abnormal until corrective action is verified."),
        (latest < prior, "Improving", "The latest status improved, but one confirmation sample is still needed."),
        (latest >= 2, "Abnormal — new",
         "A repeat sample is needed to determine whether the abnormal condition persists."),
        (latest == 1, "Monitor", "Continue monitoring; no failure probability is justified from this sequence."),
    ]
    trajectory, expected = F.lit("Stable normal"), F.lit(
        "No deterioration is evident in the available laboratory-status sequence.")
    for holds, name, text in reversed(outcomes):
        trajectory, expected = F.when(holds, name).otherwise(trajectory), F.when(holds, text).otherwise(expected)
    label = F.when(latest >= 2, "action-required").when(latest == 1, "warning").otherwise("normal")
    persistence = F.concat(
        run.cast("string"), F.lit(" consecutive "), label, F.lit(" sample(s)"),
        F.when((run >= 2) & (run_days > 0), F.concat(F.lit(" across "), run_days.cast("string"), F.lit(" days")))
        .otherwise(""))
    hours = F.regexp_extract("timing_text", r"(?id)\b(\d{1,4})\s*(?:operating[- ]?)?hours?\b", 1)
    known = latest.isNotNull()
    numeric = F.coalesce("numeric_rows", F.lit(0))
    basis = F.format_string(
        "%d dated statuses; %d action-required; %d sample(s) with measured numerical results; "
        "telemetry %s; WO outcomes %s", "known_statuses", "abnormal_statuses", numeric,
        F.when(F.col("has_telemetry"), "available").otherwise("not available"),
        F.when(F.col("has_orders"), "available").otherwise("not available"))
    unknown = F.format_string("%d dated sample(s), but no recognised laboratory status sequence", "dated_statuses")
    return [
        trajectory.alias("condition_trajectory"),
        F.when(known, persistence).otherwise("No dated sequence").alias("condition_persistence"),
        expected.alias("next_condition_outlook"),
        F.when(known & (hours != ""), F.concat(F.lit("Resample in "), hours, F.lit(" operating hours")))
        .otherwise("Next scheduled sample").alias("next_checkpoint"),
        F.when(known & (F.col("known_statuses") >= 12) & (numeric >= 6) & F.col("has_orders"), "High")
        .when(known & (F.col("known_statuses") >= 6) & (numeric >= 3), "Medium").otherwise("Low")
        .alias("outlook_confidence"),
        F.when(known, basis).when(F.col("dated_statuses").isNotNull(), unknown)
        .otherwise("No usable dated laboratory sequence").alias("outlook_basis"),
    ]


def condition_index(samples: DataFrame) -> DataFrame:
    """Heuristic condition index 5-100 per case from its latest sample and its run of action-required codes."""
    dated = ~F.coalesce("is_invalid_date", F.lit(True)) & F.col("sample_date").isNotNull()
    at = F.struct(dated.alias("dated"), F.when(dated, F.col("sample_date")).alias("at"), F.col("source_row").alias("row"))
    code = F.upper(F.coalesce("interpretation_code", F.lit("")))
    # Rows carry marks instead of the text.
    marks = [said.alias(name) for name, said in text_marks(F.col("interpretation_text")).items()]
    latest = samples.groupBy(*SERIES).agg(
        F.max_by(F.struct(code.alias("code"), *INDEX_MEASUREMENTS, *marks), at).alias("_latest"),
        F.max(F.when(dated & (code != "AR"), at)).alias("_last_other"),
    )
    runs = (
        scans.join_on(samples.filter(dated & (code == "AR")).select(*SERIES, at.alias("_at")),
                      latest.select(*SERIES, "_last_other"), SERIES, "inner")
        .filter(F.col("_last_other").isNull() | (F.col("_at") > F.col("_last_other")))
        .groupBy(*SERIES).agg(F.count("*").alias("_run")))
    rows = scans.join_on(latest, runs, SERIES).select(
        *SERIES, F.greatest(F.coalesce("_run", F.lit(0)), F.lit(1)).alias("_run"), "_latest.*")
    return rows.select(*SERIES, *index_columns())


INDEX_MEASUREMENTS = ["water_pct", "iron_ppm", "copper_ppm", "aluminium_ppm", "silicon_ppm"]


def text_marks(text: Column) -> dict[str, Column]:
    """What an interpretation says of the fluid."""
    lowered = F.lower(F.coalesce(text, F.lit("")))

    def says(*words: str) -> Column:
        return reduce(lambda a, b: a | b, [lowered.contains(word) for word in words])

    # Words of each mark.
    return {
        "_water": says("water present", "excessive water"), "_coolant": says("coolant", "glycol", "antifreeze"),
        "_fuel": says("fuel dilution", "fuel in oil"), "_fluid": says("viscosity", "oxidation", "degraded"),
    }


def index_columns() -> list[Column]:
    """The index of a case from code, measurements and marks of its latest sample and its run of action-required codes."""
    def over(name: str, limit: float) -> Column:
        return F.coalesce(c.finite_or(F.col(name), None) > limit, F.lit(False))

    def rounded(name: str) -> Column:
        return F.bround(F.col(name), 0)

    is_ar, run = F.col("code") == "AR", F.col("_run")
    watch = reduce(lambda a, b: a | b, [F.col("code").contains(k) for k in ("WARN", "MONITOR", "B", "C")])
    worn, gears = over("iron_ppm", 150), over("iron_ppm", 150) & over("copper_ppm", 15)
    # Condition, points, penalty text, fingerprint.
    effects = [
        (is_ar & (run >= 2), 45, F.format_string("Repeated lab Action Required (%dx consecutive)", run), None),
        (is_ar & (run < 2), 30, F.lit("Lab Action Required (AR)"), None),
        (~is_ar & watch, 15, F.lit("Lab Monitor / Warning status"), None),
        (over("water_pct", 0.02) | F.col("_water"), 25,
         F.lit("Severe water contamination"), "Seal/Plug Moisture Ingress"),
        (F.col("_coolant"), 25, F.lit("Coolant / Glycol contamination"), "Cooler / Internal Leak"),
        (F.col("_fuel"), 20, F.lit("Fuel dilution"), "Fuel Injector Dilution"),
        (gears, 20, F.format_string("Elevated gear & bushing wear (Fe %.0f, Cu %.0f ppm)",
                                    rounded("iron_ppm"), rounded("copper_ppm")), "Gear Mesh & Bushing Breakdown"),
        (worn & ~gears, 15, F.format_string("Elevated Iron (%.0f ppm)", rounded("iron_ppm")), "Mechanical Gear Wear"),
        (over("silicon_ppm", 25) & over("aluminium_ppm", 15), 15,
         F.format_string("Abrasive dirt ingress (Si %.0f, Al %.0f ppm)", rounded("silicon_ppm"),
                         rounded("aluminium_ppm")), "Abrasive Dust Ingress via Breather"),
        (F.col("_fluid"), 10, F.lit("Fluid degradation / thermal stress"), None),
    ]
    points = reduce(lambda a, b: a + b, [F.when(holds, cost).otherwise(0) for holds, cost, _, _ in effects])
    penalties = F.array_compact(F.array(*[F.when(holds, text) for holds, _, text, _ in effects]))
    prints = F.array_compact(F.array(*[F.when(holds, F.lit(mark)) for holds, _, _, mark in effects if mark]))
    index = F.greatest(F.lit(5), F.least(F.lit(100), F.lit(100) - points))
    return [
        index.alias("health_score"),
        F.when(index >= 85, "Optimal").when(index >= 65, "Monitor").otherwise("Degraded").alias("health_status"),
        F.when(F.size(prints) > 0, F.array_join(prints, " + ")).otherwise("Normal Mechanical Baseline")
        .alias("failure_fingerprint"),
        penalties.alias("health_penalties"),
        F.lit("Heuristic condition index; not a probability or remaining-life estimate").alias("health_method"),
    ]


def case_table(
    cards: DataFrame, alerts: DataFrame, samples: DataFrame, telemetry: DataFrame | None,
    work_orders: DataFrame | None, horizon_days: int = 30,
) -> DataFrame:
    """One case per (asset, component) with its finding, history, confidence, outlook and condition index."""
    return _cases(selected_findings(cards), case_history(cards), alerts, samples, telemetry, work_orders, horizon_days)


def case_table_of_alerts(
    alerts: DataFrame, samples: DataFrame, telemetry: DataFrame, work_orders: DataFrame, probabilities: DataFrame,
    horizon_days: int = 30,
) -> DataFrame:
    """The same table from alerts: a card is made for the finding of each case alone, so no card per sample is exchanged or written."""
    finding = materialise(selected_findings(alerts))
    cards = action_cards(finding, point_in_time.availability(finding, telemetry, work_orders))
    history = history_of_alerts(alerts, telemetry, work_orders, probabilities)
    return _cases(cards, history, alerts, samples, telemetry, work_orders, horizon_days)


def _cases(
    finding: DataFrame, history: DataFrame, alerts: DataFrame, samples: DataFrame, telemetry: DataFrame | None,
    work_orders: DataFrame | None, horizon_days: int,
) -> DataFrame:
    rows = scans.join_on(_finding_columns(finding), history, SERIES)
    trust = case_confidence(samples, telemetry, work_orders).select(
        *SERIES, "data_confidence", "confidence_reason")
    for part in (trust, condition_outlook(alerts, samples, telemetry, work_orders), condition_index(samples)):
        rows = scans.join_on(rows, part, SERIES)
    return _shown_cases(rows, horizon_days)


def _finding_columns(cards: DataFrame, *kept: str) -> DataFrame:
    return cards.select(
        *SERIES, "priority_tier", "machine_model", "site_name", F.col("sample_date").alias("finding_sample_date"),
        F.col("lab_status").alias("active_finding_lab_status"), "key_evidence", "wo_id", "action_needed",
        "prediction_data_sources", "data_quality_status", "data_quality_issue", "sample_number", *kept)


# What a case shows of the sample that represents it, as loaded, and what its alert has beside that and no case shows.
FINDING = ["source_row", "sample_number", "sample_date", "machine_model", "site_name", "is_invalid_date", "date_quality_issue",
           "interpretation_code", "interpretation_text", "status", "high_priority", "wo_id"]
NOT_SHOWN = {"serial_number": "string", "sample_date_raw": "string", "wo_status": "string", "fluid_hours": "double"}


def case_rows(samples: DataFrame) -> DataFrame:
    """The columns of samples that cases are made from, with the code in upper case; to be written once for `case_table_of_rows`.

    A `probability` that samples carry, of a model that scored them, is taken along in percent.
    """
    pct = F.bround(F.col("probability") * 100, 0).cast("int") if "probability" in samples.columns else F.lit(None).cast("int")
    code = F.upper(F.coalesce("interpretation_code", F.lit("")))
    return samples.select(
        *SERIES, *[code.alias(n) if n == "interpretation_code" else n for n in FINDING], *INDEX_MEASUREMENTS, triage.undated().alias("_undated"), tier_rank(triage.first_tier()).alias("_rank"),
        has_measurement().alias("_measured"), pct.alias("_pct"))


def case_table_of_rows(
    rows: DataFrame, telemetry: DataFrame, work_orders: DataFrame, horizon_days: int = 30, config: dict | None = None,
) -> DataFrame:
    """The same table from written `case_rows` of samples: one aggregation gives all that a case takes from its rows, one join counts its latest runs.

    Rules and reasons are worked out for two rows of a case alone, the finding and the latest; of telemetry and work
    orders only the assets and their first reading are used. `telemetry` may be readings without deltas.
    """
    ends = materialise(with_latest_severities(_case_ends(rows)))
    cases = scans.join_on(ends, _run_lengths(rows, ends), SERIES)
    first = point_in_time.first_readings(telemetry).filter(F.col("asset_id").isNotNull()).withColumn("_read", F.lit(True))
    cases = cases.join(first, "asset_id", "left").join(
        point_in_time.covered_assets(work_orders).withColumn("_ordered", F.lit(True)), "asset_id", "left")
    cases = cases.withColumns({"has_telemetry": F.coalesce("_read", F.lit(False)), "has_orders": F.coalesce("_ordered", F.lit(False))})
    return _shown_cases(_with_findings(cases, config), horizon_days)


def with_severity(rows: DataFrame) -> DataFrame:
    """Rows with the severity of the laboratory status of their code; listed codes need no search of the status."""
    code = F.col("interpretation_code")
    listed = {name: severity_of(status) for name, status in fv.LAB_STATUS_BY_CODE.items()}
    severity = F.when(code.isin(list(listed)), F.element_at(c.lookup(listed), code)).otherwise(
        status_severity(triage.lab_status(code)))
    return rows.withColumn("_severity", severity)


def _case_ends(rows: DataFrame) -> DataFrame:
    """All that a case takes from its rows in one pass."""
    at, dated = F.struct("sample_date", "source_row"), ~F.col("_undated")
    code, rows = F.col("interpretation_code"), with_severity(rows)
    numbered = ~F.coalesce("is_invalid_date", F.lit(True))
    usable = numbered & F.col("sample_date").isNotNull()
    index_at = F.struct(usable.alias("dated"), F.when(usable, F.col("sample_date")).alias("at"), F.col("source_row").alias("row"))
    closed = fv.TIERS.index(fv.CLOSED)
    # Closed is the last rank, so the rank alone puts open rows first.
    best = F.struct((-F.col("_rank")).alias("rank"), newest().alias("newest"))
    return rows.groupBy(*SERIES).agg(
        F.max_by(F.struct(*FINDING), best).alias("_finding"),
        F.count_if(triage.loaded_new_ar()).alias("_repeats"), F.count_if(triage.unlinked_new_ar()).alias("_unlinked"),
        F.max("sample_date").alias("latest_sample_date"),
        F.max_by(code, F.struct(F.col("sample_date").isNotNull(), F.col("sample_date"), F.col("source_row"))).alias("_status_code"),
        F.count_if(F.col("_rank") != closed).alias("open_sample_count"), F.count("*").alias("total_sample_count"),
        F.max_by(F.struct("_pct", "sample_date"), F.when(F.col("_pct").isNotNull(), newest())).alias("_scored"),
        *[F.max(F.when(dated & (F.col("_severity") == s), at)).alias(f"_last_{s}") for s in SEVERITIES],
        F.count_if(dated).alias("_dated"), F.count_if(dated & F.col("_severity").isNotNull()).alias("known_statuses"),
        F.count_if(dated & (F.col("_severity") == 2)).alias("abnormal_statuses"),
        F.max(F.when(dated, F.col("sample_date"))).alias("latest_date"),
        F.max_by(F.struct("interpretation_code", "interpretation_text"), F.when(dated, at)).alias("_last_dated"),
        F.max_by(F.struct(code.alias("code"), *INDEX_MEASUREMENTS, "interpretation_text"), index_at).alias("_latest"),
        F.max(F.when(usable & (code != "AR"), index_at)).alias("_last_other"),
        F.count_if(numbered).alias("dated_rows"), F.count_if(numbered & F.col("_measured")).alias("numeric_rows"),
    )


def _run_lengths(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Length and start of the latest run of a known severity, and of the run of action-required codes, in one join."""
    at = F.struct("sample_date", "source_row")
    known = ~F.col("_undated") & F.col("_severity").isNotNull()
    usable = ~F.coalesce("is_invalid_date", F.lit(True)) & F.col("sample_date").isNotNull()
    coded = usable & (F.col("interpretation_code") == "AR")
    asked = with_severity(rows).select(*SERIES, "sample_date", "source_row", known.alias("_known"), coded.alias("_coded")).filter("_known OR _coded")
    # A struct of the other position without its leading flag, which is true wherever a position is.
    other = F.struct(F.col("_last_other.at").alias("sample_date"), F.col("_last_other.row").alias("source_row"))
    after = ends.select(*SERIES, "_after", F.when(F.col("_last_other").isNotNull(), other).alias("_behind"))
    in_run = F.col("_known") & (F.col("_after").isNull() | (at > F.col("_after")))
    in_coded_run = F.col("_coded") & (F.col("_behind").isNull() | (at > F.col("_behind")))
    counted = scans.join_on(asked, after, SERIES, "inner").select(
        *SERIES, "sample_date", in_run.alias("_in"), in_coded_run.alias("_in_coded")).filter("_in OR _in_coded")
    return counted.groupBy(*SERIES).agg(
        F.nullif(F.count_if("_in"), F.lit(0)).alias("run_length"),
        F.min(F.when(F.col("_in"), F.col("sample_date"))).alias("run_start"), F.count_if("_in_coded").alias("_run"))


def _with_findings(cases: DataFrame, config: dict | None) -> DataFrame:
    """Cases with their finding, history, confidence, outlook and condition index."""
    missing = {name: F.lit(None).cast(kind) for name, kind in NOT_SHOWN.items()}
    packed = cases.select(*SERIES, F.struct(*[n for n in cases.columns if n not in SERIES]).alias("_case"))
    # Rules for the latest dated row give its timing text, those for the finding its alert.
    timed = triage.with_rule_results(
        packed.select(*SERIES, "_case", "_case._last_dated.*").withColumns(missing), config or triage.load_rules()).select(
        *SERIES, "_case", F.concat_ws(" ", "recommended_action", "original_interpretation").alias("timing_text"))
    finding = timed.select(*SERIES, "_case", "timing_text", "_case._finding.*", "_case._repeats", "_case._unlinked").withColumns(missing)
    alerts = materialise(triage.triage_counted(finding, config, ["_case", "timing_text"]))
    first, covered = F.col("_case._first"), F.col("_case.has_orders")
    cards = action_cards(alerts.withColumns({
        "telemetry_available": F.coalesce(first <= F.col("sample_date"), F.lit(False)),
        "work_order_history_available": covered & F.col("sample_date").isNotNull()}), None, kept=["_case", "timing_text"])
    rows = _finding_columns(cards, "_case", "timing_text").select("*", "_case.*").drop("_case")
    marks = text_marks(F.col("_latest.interpretation_text"))
    rows = rows.withColumns({
        "_run": F.greatest(F.coalesce("_run", F.lit(0)), F.lit(1)), "dated_statuses": F.nullif("_dated", F.lit(0)),
        "prior_severity": prior_severity(), "code": F.col("_latest.code"),
        **{name: F.col("_latest." + name) for name in INDEX_MEASUREMENTS}, **marks,
        "failure_probability_pct": F.col("_scored._pct").cast("double"), "latest_lab_status": triage.lab_status(F.col("_status_code")),
        "telemetry_available": F.coalesce(F.col("_first") <= F.col("_scored.sample_date"), F.lit(False)),
        "work_order_history_available": F.col("has_orders") & F.col("_scored.sample_date").isNotNull()})
    scored = F.when(F.col("_scored").isNotNull(), data_sources()).alias("_scored_sources")
    return rows.select("*", scored, *confidence(), *outlook(), *index_columns())


def _shown_cases(rows: DataFrame, horizon_days: int) -> DataFrame:
    tier, linked = F.col("priority_tier"), c.has_value(F.col("wo_id"))
    probability = F.col("failure_probability_pct")
    prefix = fv.ACTION_PREFIX.strip()
    action = F.when(F.startswith("action_needed", F.lit(prefix)),
                    F.substr(F.col("action_needed"), F.lit(len(prefix) + 1))).otherwise(F.col("action_needed"))
    issues = F.filter("key_evidence", c.has_value)
    return rows.select(
        F.concat(F.coalesce("asset_id", F.lit("<NA>")), F.lit("::"), F.coalesce("component", F.lit("<NA>")))
        .alias("case_id"),
        tier_rank(tier).alias("priority_rank"),
        F.coalesce(F.try_element_at(c.lookup(fv.TIER_LABELS), tier), tier).alias("priority"),
        tier.alias("priority_code"), *SERIES, c.component_label(F.col("component")).alias("component_name"),
        "machine_model", "site_name", "latest_sample_date", "finding_sample_date",
        F.col("latest_lab_status").alias("lab_status"), "latest_lab_status", "active_finding_lab_status",
        F.coalesce(F.get(issues, 0), F.lit("Review laboratory interpretation")).alias("main_issue"),
        "failure_probability_pct",
        F.when(probability.isNotNull(), F.format_string(f"%.0f%% / {int(horizon_days)} days", probability))
        .otherwise("Not available").alias("probability_display"),
        F.coalesce("_scored_sources", "prediction_data_sources").alias("prediction_data_sources"),
        F.when(linked, F.col("wo_id")).otherwise("").alias("wo_id"),
        F.when(linked, "Linked — verify outcome").otherwise("No linked WO").alias("wo_status_display"),
        c.strip(action).alias("required_action"),
        F.coalesce(F.try_element_at(c.lookup(fv.TIER_DUE), tier), F.lit("Closed")).alias("due"),
        "open_sample_count", "total_sample_count", "data_confidence", "confidence_reason", "condition_trajectory",
        "condition_persistence", "next_condition_outlook", "next_checkpoint", "outlook_confidence", "outlook_basis",
        "health_score", "health_status", "failure_fingerprint", "health_penalties", "health_method",
        "data_quality_status", "data_quality_issue", "sample_number", "key_evidence",
    )


def ordered_cases(cases: DataFrame) -> DataFrame:
    """Action-queue order: rank, highest probability, asset."""
    return cases.orderBy("priority_rank", F.col("failure_probability_pct").desc_nulls_last(), "asset_id", "component")


def active(cases: DataFrame) -> DataFrame:
    return cases.filter(F.col("priority_code") != fv.CLOSED)


def fleet_summary(cases: DataFrame, samples: DataFrame, work_orders: DataFrame | None) -> DataFrame:
    """Fleet totals as one row."""
    is_active = F.col("priority_code") != fv.CLOSED
    status = F.lower("lab_status")
    points = F.when(F.col("data_confidence") == "High", 3).when(F.col("data_confidence") == "Medium", 2).otherwise(1)
    index = F.avg(F.when(is_active, F.col("health_score")))
    row = cases.agg(
        F.count("*").alias("machine_components"),
        F.count_if(F.col("priority_code").isin(fv.P1_IMMEDIATE, fv.P1_WO_TRACKING)).alias("immediate_action"),
        F.count_if(is_active & status.rlike("action required|severe")).alias("high"),
        F.count_if(is_active & status.contains("warning")).alias("monitor"),
        F.count_if(is_active & (status == "normal")).alias("normal"),
        F.count_if(is_active & (F.length("wo_id") > 0)).alias("wo_linked_active"),
        F.count_if((F.col("priority_code") == fv.P1_IMMEDIATE) & (F.length("wo_id") == 0)).alias("p1_without_wo"),
        F.coalesce(F.bround(index, 0).cast("int"), F.lit(100)).alias("avg_fleet_health"),
        F.when(F.count("*") == 0, "Not available").when(F.avg(points) >= 2.6, "High")
        .when(F.avg(points) >= 1.6, "Medium").otherwise("Low").alias("analysis_confidence"),
    )
    totals = samples.agg(F.count("*").alias("samples"), F.count_distinct("asset_id").alias("assets"))
    open_orders = F.lit(0).cast("long") if work_orders is None else work_orders.agg(
        F.count_if(F.col("is_corrective") & F.col("closed_date").isNull())).scalar()
    return row.select("*", totals.select("samples").scalar().alias("samples"),
                      totals.select("assets").scalar().alias("assets"), open_orders.alias("open_corrective_wos"))


def tier_counts(cases: DataFrame) -> DataFrame:
    """Active cases per priority."""
    return active(cases).groupBy("priority").agg(F.count("*").alias("cases"))


def top_cases(cases: DataFrame, limit: int = 8) -> DataFrame:
    """First active cases of the action queue."""
    return ordered_cases(active(cases)).limit(limit)


def asset_orders(work_orders: DataFrame, asset_id: str) -> DataFrame:
    return work_orders.filter(F.col("asset_id") == asset_id)
