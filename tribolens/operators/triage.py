"""Rule evaluation, workflow priority, tiers, text categories and risk drivers."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tribolens.functions import cleaning as c
from tribolens.functions import fixed_values as fv
from tribolens.plans import scans

SERIES = ["asset_id", "component"]


def load_rules(path: str | Path | None = None) -> dict:
    """Rule table: severity codes and ordered rules. The default is the built-in one."""
    if path is None:
        return {"severity_codes": fv.SEVERITY_CODES, "rules": fv.RULES}
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as error:
        raise ValueError("YAML rule files need PyYAML; use a JSON rule file instead") from error
    return yaml.safe_load(text)


def _code() -> Column:
    return F.upper(F.coalesce("interpretation_code", F.lit("")))


def _shown(name: str) -> Column:
    """A key inside a message; a missing one is spelled out."""
    return F.coalesce(F.col(name), F.lit("<NA>"))


def base_severity(config: dict) -> Column:
    codes = {str(code).upper(): float(score) for code, score in config["severity_codes"].items()}
    return F.coalesce(F.try_element_at(c.lookup(codes), _code()), F.lit(fv.UNKNOWN_SEVERITY))


def matched_rules(config: dict) -> Column:
    """Structs (id, score, evidence, recommendation) of the rules that match the comment, in rule order."""
    def entry(rule: dict) -> Column:
        anywhere = "|".join(f"(?:{pattern})" for pattern in rule["patterns"])
        return F.when(c.matches(F.col("interpretation_text"), anywhere), F.struct(
            F.lit(str(rule["id"])).alias("id"), F.lit(float(rule["score"])).alias("score"),
            F.lit(rule["evidence"]).alias("evidence"), F.lit(rule["recommendation"]).alias("recommendation")))

    return F.array_compact(F.array(*[entry(rule) for rule in config["rules"]]))


def lab_status(code: Column | None = None) -> Column:
    code = F.col("interpretation_code") if code is None else code
    named = F.try_element_at(c.lookup(fv.LAB_STATUS_BY_CODE), code)
    other = F.when(code != "", F.concat(F.lit("Code "), code))
    return F.coalesce(named, other, F.lit("Unspecified"))


def repeat_counts(rows: DataFrame, conditions: dict[str, Column], written: bool = False) -> DataFrame:
    """Rows of each (asset, component) that meet each condition, pre-aggregated and joined back.

    Conditions count, and tiers ask for counts of, new action-required rows alone. Of `written` rows, which are cheap to read again,
    only these are exchanged for the join; the others get NULL.
    """
    new_ar = (_code() == "AR") & (F.upper(F.coalesce(c.strip(F.col("status")), F.lit("New"))) == "NEW")
    asked = rows.filter(new_ar) if written else rows
    counts = asked.groupBy(*SERIES).agg(*[F.count_if(condition).alias(name) for name, condition in conditions.items()])
    counted = scans.join_on(asked, counts, SERIES)
    return counted.unionByName(rows.filter(~new_ar), allowMissingColumns=True) if written else counted


def loaded_new_ar() -> Column:
    """Action-required samples whose status was loaded as new."""
    return (_code() == "AR") & F.coalesce(F.upper("status") == "NEW", F.lit(False))


def unlinked_new_ar() -> Column:
    """Action-required samples that are new (also by default) and have no work order."""
    new = F.upper(F.coalesce(c.strip(F.col("status")), F.lit("New"))) == "NEW"
    return (_code() == "AR") & new & ~c.has_value(F.col("wo_id"))


def with_rule_results(samples: DataFrame, config: dict) -> DataFrame:
    """Severity, matched rules, evidence strength, texts, confidence and laboratory status."""
    matched = samples.withColumns({"_base": base_severity(config), "_rules": matched_rules(config), "_code": _code()})
    is_ar = F.col("_code") == "AR"
    first_evidence = F.when(is_ar, F.array(F.lit(fv.AR_EVIDENCE))).otherwise(F.array().cast("array<string>"))
    first_advice = F.when(is_ar, F.array(F.lit(fv.AR_RECOMMENDATION))).otherwise(F.array().cast("array<string>"))
    evidence = F.concat(first_evidence, F.col("_rules.evidence"))
    advice = F.concat(first_advice, F.col("_rules.recommendation"))
    top = F.greatest("_base", F.coalesce(F.array_max("_rules.score"), F.lit(0.0)))
    strength = F.greatest(F.lit(0.0), F.least(F.lit(1.0), top))
    prefix = fv.ACTION_PREFIX.strip()

    found = is_ar | (F.size("_rules") > 0)

    def or_default(items: Column, default: str) -> Column:
        return F.when(found, F.array_distinct(items)).otherwise(F.array(F.lit(default)))

    without_prefix = F.transform(or_default(advice, fv.NO_RECOMMENDATION), lambda a: c.strip(
        F.when(F.startswith(a, F.lit(prefix)), F.substr(a, F.lit(len(prefix) + 1))).otherwise(a)))
    history = c.matches(F.col("interpretation_text"), fv.HISTORY_PATTERN)
    return matched.withColumns({
        "rule_evidence_strength": F.bround(strength, 3),
        "evidence_level": F.when(strength >= 0.8, "Strong rule match").when(strength >= 0.5, "Moderate rule match")
        .otherwise("Basic rule match"),
        "triggered_rules": F.when(F.size("_rules") > 0, F.array_join(F.col("_rules.id"), "; ")).otherwise("none"),
        "evidence": F.array_join(or_default(evidence, fv.NO_EVIDENCE), "; "),
        "recommended_action": F.concat(F.lit(fv.ACTION_PREFIX), F.array_join(without_prefix, " ")),
        "confidence": F.when(F.col("fluid_hours").isNull() | history, "Low").when(F.size("_rules") >= 2, "High")
        .otherwise("Medium"),
        "original_interpretation": F.col("interpretation_text"),
        "interpretation_code": F.col("_code"),
    }).withColumn("lab_status", lab_status()).drop("_base", "_rules", "_code")


def with_workflow_priority(rows: DataFrame) -> DataFrame:
    """Base workflow priority and its evidence; expects `status` as loaded and `interpretation_code` upper-case."""
    counted = rows if "_repeats" in rows.columns else repeat_counts(rows, {"_repeats": loaded_new_ar()})
    status = c.capitalised(F.col("status"), "New")
    priority = F.upper(F.coalesce(c.strip(F.col("high_priority")), F.lit("")))
    base = counted.withColumns({
        "status": status, "high_priority": priority, "_linked": c.has_value(F.col("wo_id")), "is_invalid_date": undated(),
    })
    new, closed = F.upper("status") == "NEW", F.upper("status") == "CLOSED"
    urgent, linked = F.col("high_priority").isin(fv.TRUE_TEXTS), F.col("_linked")
    code = F.col("interpretation_code")
    new_ar = (code == "AR") & new
    where = F.when(linked, F.concat(F.lit("with WorkOrderId ("), _shown("wo_id"), F.lit(")"))).otherwise(
        "without WorkOrderId")
    repeated = F.concat(
        F.lit("Repeated New AR sample ("), F.col("_repeats").cast("string"), F.lit(" occurrences) for "),
        _shown("asset_id"), F.lit(" / "), _shown("component"), F.lit(" "), where)

    def with_order(text: str) -> Column:
        return F.concat(F.lit(text + " ("), _shown("wo_id"), F.lit(")"))

    # First outcome that holds, with its priority and evidence text.
    outcomes = [
        (F.col("is_invalid_date"), "Data quality hold",
         F.lit("Missing or time-only sample date (e.g., year 1899 or unparseable date format)")),
        (closed, "Closed", F.lit("SampleStatusNew is Closed")),
        (urgent & new & ~linked, "Immediate review", F.lit("HighPriority=T, Status=New, and no WorkOrderId assigned")),
        (urgent & new & linked, "Immediate review",
         with_order("HighPriority=T, Status=New, with assigned WorkOrderId")),
        (new_ar & (F.col("_repeats") >= 2), "Priority review", repeated),
        (new_ar & linked, "In progress", with_order("New AR sample with assigned WorkOrderId")),
        (new_ar, "Priority review", F.lit("New AR sample without WorkOrderId assigned")),
        (linked, "In progress", with_order("Assigned WorkOrderId")),
        (code.isin("B", "C", "AR", "RED", "YELLOW"), "Priority review",
         F.concat(F.lit("Elevated laboratory code ("), code, F.lit(") without assigned WorkOrderId"))),
    ]
    chosen, reason = F.lit("In progress"), F.concat(F.lit("Status "), F.col("status"))
    for holds, name, text in reversed(outcomes):
        chosen, reason = F.when(holds, F.lit(name)).otherwise(chosen), F.when(holds, text).otherwise(reason)
    return base.withColumns({
        "workflow_priority": chosen, "priority_evidence": reason, "operational_priority": chosen,
        "wo_id": F.when(linked, F.col("wo_id")),
    }).drop("_linked", "_repeats")


ALERT_COLUMNS = [
    "source_row", "sample_number", "asset_id", "serial_number", "machine_model", "component", "sample_date",
    "sample_date_raw", "is_invalid_date", "date_quality_issue", "interpretation_code", "lab_status",
    "workflow_priority", "priority_evidence", "operational_priority", "status", "high_priority", "wo_id", "wo_status",
    "site_name", "rule_evidence_strength", "evidence_level", "confidence", "triggered_rules", "evidence",
    "recommended_action", "original_interpretation",
]


def evaluate_rules(samples: DataFrame, config: dict | None = None) -> DataFrame:
    """One alert row per sample."""
    return with_workflow_priority(with_rule_results(samples, config or load_rules())).select(*ALERT_COLUMNS)


def triage(samples: DataFrame, config: dict | None = None, written: bool = False) -> DataFrame:
    """Rules and tiers in one pass over the samples: both repeat counts come from one aggregation."""
    return triage_counted(repeat_counts(samples, {"_repeats": loaded_new_ar(), "_unlinked": unlinked_new_ar()}, written), config)


def triage_counted(counted: DataFrame, config: dict | None = None, kept: list[str] | None = None) -> DataFrame:
    """Alerts of samples that carry both repeat counts; `kept` columns go along."""
    alerts = with_workflow_priority(with_rule_results(counted, config or load_rules()))
    return priority_tiers(alerts.select(*ALERT_COLUMNS, "_unlinked", *kept or []))


def undated() -> Column:
    """No usable sample date."""
    year = F.year("sample_date")
    return (F.col("is_invalid_date") | F.col("sample_date").isNull()
            | ~F.coalesce(year.between(fv.FIRST_YEAR, fv.LAST_YEAR), F.lit(False)))


def first_tier() -> Column:
    """Tier of a sample as loaded, from its row alone: where a repeat count decides between two tiers, the repeated one.

    No other tier lies between these two, so the order of the rows of a case is that of their alerts.
    """
    status = F.upper(F.coalesce(c.strip(F.col("status")), F.lit("New")))
    urgent = F.coalesce(F.upper(c.strip(F.col("high_priority"))).isin(fv.TRUE_TEXTS), F.lit(False))
    tier = F.lit(fv.IN_PROGRESS)
    for holds, name in reversed(tier_conditions(_code(), status, urgent, c.has_value(F.col("wo_id")), F.lit(True))):
        tier = F.when(holds, name).otherwise(tier)
    return tier


def tier_conditions(code: Column, status: Column, urgent: Column, linked: Column, repeated: Column) -> list[tuple[Column, str]]:
    """The tiers in the order in which they are tried; none holds for a row in progress."""
    new_ar = (code == "AR") & (status == "NEW")
    return [
        (status == "CLOSED", fv.CLOSED), (urgent & ~linked, fv.P1_IMMEDIATE), (urgent & linked, fv.P1_WO_TRACKING),
        (new_ar & repeated & ~linked, fv.P2_REPEATED), (new_ar & linked, fv.IN_PROGRESS), (new_ar & ~linked, fv.P3_ACTION),
        (linked, fv.IN_PROGRESS),
    ]


def data_quality(alerts: DataFrame) -> DataFrame:
    """Date quality of an alert, whatever its tier."""
    invalid = F.coalesce("is_invalid_date", F.lit(False))
    issue = c.strip(F.coalesce("date_quality_issue", F.lit("")))
    return alerts.withColumns({
        "data_quality_status": F.when(invalid, "Review required").otherwise("Valid"),
        "data_quality_issue": F.when(invalid & (issue == ""), fv.DATE_UNSPECIFIED).when(invalid, issue).otherwise(""),
    })


def priority_tiers(alerts: DataFrame) -> DataFrame:
    """Six-tier action priority with its reason; replaces the workflow priority, keeps the operational one."""
    linked = c.has_value(F.col("wo_id"))
    code, status = F.upper("interpretation_code"), F.upper("status")
    counted = alerts if "_unlinked" in alerts.columns else repeat_counts(alerts, {"_unlinked": unlinked_new_ar()})
    urgent = c.is_high_priority(F.col("high_priority"))
    order = _shown("wo_id")
    flag_text = "HighPriority flag is set (HighPriority=T), status is New, "
    # Reason of each tier, in the order of `tier_conditions`.
    reasons = [
        F.lit("The laboratory record status is Closed. This does not by itself confirm that "
              "maintenance or repair was completed."),
        F.lit(flag_text + "and no WorkOrderId is assigned. Requires immediate engineer review."),
        F.concat(F.lit(flag_text + "and WorkOrderId "), order,
                 F.lit(" is linked. Verify its status, inspection result and outcome urgently.")),
        F.concat(F.lit("This extract contains "), F.col("_unlinked").cast("string"), F.lit(" New AR records for asset "),
                 _shown("asset_id"), F.lit(" / compartment "), _shown("component"),
                 F.lit("; this record has no linked WorkOrderId. Verify the dated history and maintenance response.")),
        F.concat(F.lit("New AR sample has linked WorkOrderId "), order,
                 F.lit(". A linked identifier does not confirm inspection, repair, or WO completion.")),
        F.lit("New AR sample has no linked WorkOrderId. Verify whether a WO exists and route "
              "the laboratory recommendation for engineering review."),
        F.concat(F.lit("WorkOrderId "), order, F.lit(" is linked; its maintenance outcome is not available in this file.")),
    ]
    holding = tier_conditions(code, status, urgent, linked, F.col("_unlinked") >= 2)
    outcomes = [(holds, name, reason) for (holds, name), reason in zip(holding, reasons, strict=True)]
    tier = F.lit(fv.IN_PROGRESS)
    reason = F.concat(F.lit("Status is "), c.capitalised(F.col("status"), "New"), F.lit(" with interpretation code "),
                      code, F.lit("."))
    for holds, name, text in reversed(outcomes):
        tier, reason = F.when(holds, F.lit(name)).otherwise(tier), F.when(holds, text).otherwise(reason)
    return data_quality(counted.withColumns({
        "priority_tier": tier, "priority_reason": reason, "workflow_priority": tier, "priority_evidence": reason,
    }).drop("_unlinked"))


def sentences(text: Column) -> Column:
    """Sentences of a text: split after a stop that white space follows."""
    parts = F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), c.strip)
    return F.filter(parts, lambda part: part != "")


def interpretation_categories(alerts: DataFrame) -> DataFrame:
    """One row per matched problem category with the first sentence that shows it; `Other` when none matches."""
    text = F.col("original_interpretation")
    split = alerts.select("sample_number", "asset_id", "component", text.alias("full_interpretation"),
                          sentences(text).alias("_s"), F.lower(text).alias("_lower"))

    def first(name: str, pattern: str) -> Column:
        """First sentence that matches; the patterns run only where the text holds a part of one."""
        shown = F.get(F.filter("_s", lambda sentence: c.matches(sentence, pattern)), 0)
        parts = fv.CATEGORY_PARTS.get(name)
        return shown if parts is None else F.when(reduce(lambda a, b: a | b, [F.contains("_lower", F.lit(p)) for p in parts]), shown)

    def entry(place: int, name: str) -> Column:
        evidence = F.get("_firsts", place)
        return F.when(evidence.isNotNull(), F.struct(F.lit(name).alias("problem_category"), evidence.alias("category_evidence")))

    other = F.struct(F.lit(fv.CATEGORY_OTHER).alias("problem_category"),
                     F.coalesce(F.get("_s", 0), F.left("full_interpretation", F.lit(120))).alias("category_evidence"))
    found = F.array_compact(F.array(*[entry(i, name) for i, (name, _) in enumerate(fv.CATEGORIES)]))
    return (
        split.withColumn("_firsts", F.array(*[first(*category) for category in fv.CATEGORIES]))
        .withColumn("_found", found)
        .select("sample_number", "asset_id", "component", "full_interpretation",
                F.explode(F.when(F.size("_found") > 0, F.col("_found")).otherwise(F.array(other))).alias("_c"))
        .select("sample_number", "asset_id", "component", "_c.*", "full_interpretation")
    )


def risk_drivers(columns: list[str], model_features: list[str] | None = None) -> Column:
    """Up to four reasons: measurement thresholds, evidence parts, then leading model features.

    Measurements that the table does not carry never contribute.
    """
    def value(name: str) -> Column:
        return c.finite_or(F.col(name), 0.0) if name in columns else F.lit(0.0)

    def shown(text: str, name: str, digits: int) -> Column:
        return F.format_string(text, F.bround(value(name), digits))

    iron, viscosity = value("iron_ppm"), value("viscosity_cst")
    # Thresholds and messages.
    numeric = [
        F.when(iron > 80, shown("Iron Wear Metal Spike (%.0f ppm)", "iron_ppm", 0))
        .when(iron > 40, shown("Elevated Iron Concentration (%.0f ppm)", "iron_ppm", 0)),
        F.when(value("copper_ppm") > 40, shown("Copper Bearing Wear (%.0f ppm)", "copper_ppm", 0)),
        F.when(value("silicon_ppm") > 25, shown("Dirt / Silicon Contamination (%.0f ppm)", "silicon_ppm", 0)),
        F.when(value("water_pct") > 0.1, shown("Water Fluid Contamination (%.1f%%)", "water_pct", 1)),
        F.when(value("soot_pct") > 0.5, shown("High Soot Concentration (%.1f%%)", "soot_pct", 1)),
        F.when((viscosity > 0) & ((viscosity < 10) | (viscosity > 18)),
               shown("Viscosity Deviation (%.1f cSt)", "viscosity_cst", 1)),
        F.when(value("fuel_dilution_pct") > 2, shown("Fuel Dilution (%.1f%%)", "fuel_dilution_pct", 1)),
    ]
    parts = F.filter(F.transform(F.split("evidence", ";"), c.strip), lambda part: part != "")
    parts = F.when(F.col("evidence") != fv.NO_EVIDENCE, parts).otherwise(F.array().cast("array<string>"))
    drivers = F.array_distinct(F.concat(F.array_compact(F.array(*numeric)), parts))
    readable = [name.replace("_", " ").title() for name in model_features or []]
    if readable:
        leading = F.array(*[F.when(~F.array_contains(drivers, name), F.lit("Model Driver: " + name)) for name in readable])
        drivers = F.concat(drivers, F.array_compact(leading))
    none = F.array(F.lit("Laboratory AR flag — no numerical measurement data available"))
    return F.slice(F.when(F.size(drivers) > 0, drivers).otherwise(none), 1, 4)
