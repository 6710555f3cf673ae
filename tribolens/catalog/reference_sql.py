"""Reference SQL: the same results written independently for DuckDB, as named common table expressions."""

from __future__ import annotations

from tribolens.catalog import views
from tribolens.functions import fixed_values as fv

M = fv.MEASUREMENTS
CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: str, text: str) -> None:
    CTES[name] = (needs.split(), text)


def query(needs: str, text: str) -> str:
    """`text` with every needed expression, and what those need, in front of it."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for other in CTES[name][0]:
                visit(other)
            order.append(name)

    for name in needs.split():
        visit(name)
    parts = ", ".join(f"{name} AS ({CTES[name][1]})" for name in order)
    return f"WITH {parts} {text}" if parts else text


def q(text: str) -> str:
    """SQL text literal."""
    return "'" + text.replace("'", "''") + "'"


def values(items: list[str]) -> str:
    return ", ".join(q(i) for i in items)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def ident(x: str) -> str:
    return f"CASE WHEN {strip(x)} NOT IN ('', 'nan', 'None', '<NA>') THEN {strip(x)} END"


def component(x: str) -> str:
    code = f"trim(regexp_replace(upper({ident(x)}), '[^A-Z0-9]+', '_', 'g'), '_')"
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fv.COMPONENT_ALIASES.items())
    return f"CASE {code} {cases} ELSE {code} END"


def num(x: str) -> str:
    return f"CASE WHEN NOT isnan(try_cast({x} AS DOUBLE)) THEN try_cast({x} AS DOUBLE) END"


def has(x: str) -> str:
    return f"coalesce({strip(x)} NOT IN ('', 'nan', 'None', '<NA>'), false)"


def us(x: str) -> str:
    return f"epoch_us({x})"


ANY_M = "coalesce(" + ", ".join(M) + ") IS NOT NULL"
COUNT_M = " + ".join(f"({m} IS NOT NULL)::INT" for m in M)

cte("raw_samples", "", views.RAW_SAMPLES)
cte("raw_details", "", views.RAW_DETAILS_DUCKDB)
cte("raw_telemetry", "", views.RAW_TELEMETRY)
cte("raw_pit", "", views.RAW_PIT_SAMPLES)
cte("raw_orders", "", views.RAW_WORK_ORDERS)

TIME_ONLY = r"regexp_full_match(trim(DateSampled), '\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?')"
cte("dated", "raw_samples", f"""
SELECT *, CASE WHEN NOT {TIME_ONLY} AND regexp_matches(DateSampled, '^\\s*\\d{{4}}-')
               THEN try_cast(DateSampled AS TIMESTAMP) END AS parsed FROM raw_samples""")
cte("samples", "dated", f"""
SELECT SampleNum AS source_row, coalesce({ident('equip_num')}, {ident('SerialNum')}) AS asset_id,
  {ident('SerialNum')} AS serial_number, {ident('EqpModel')} AS machine_model, {component('Compartment')} AS component,
  CASE WHEN year(parsed) BETWEEN 1950 AND 2035 THEN parsed END AS sample_date, DateSampled AS sample_date_raw,
  CASE WHEN DateSampled IS NULL OR trim(DateSampled) = '' THEN 'Missing calendar date'
       WHEN {TIME_ONLY} THEN 'Time-only value; calendar date is missing'
       WHEN parsed IS NULL THEN 'Unparseable calendar date'
       WHEN year(parsed) NOT BETWEEN 1950 AND 2035 THEN 'Calendar date is outside the accepted 1950–2035 range' END
    AS date_quality_issue,
  coalesce(year(parsed) NOT BETWEEN 1950 AND 2035, true) AS is_invalid_date,
  {ident('SampleNum')} AS sample_number, upper({ident('OverallInterp')}) AS interpretation_code,
  coalesce(InterpText, '') AS interpretation_text, {num('CMeter')} AS equipment_hours,
  {num('c_meter_fluid')} AS fluid_hours, NULL::VARCHAR AS fluid_changed, NULL::VARCHAR AS filter_changed,
  {ident('HighPriority')} AS high_priority, {ident('WorkOrderId')} AS wo_id, {ident('WOStatus')} AS wo_status,
  {ident('SampleStatusNew')} AS status, {ident('SiteName')} AS site_name,
  Fe AS iron_ppm, Copper AS copper_ppm, Al AS aluminium_ppm, Cr AS chromium_ppm, NULL::DOUBLE AS lead_ppm,
  Si AS silicon_ppm, WaterPct AS water_pct, FuelPct AS fuel_dilution_pct, Soot AS soot_pct,
  Viscosity AS viscosity_cst, NULL::DOUBLE AS oxidation, NULL::DOUBLE AS tbn
FROM dated""")
NO_M = {"iron_ppm": "Fe", "copper_ppm": "Cu"}
cte("pit", "raw_pit", f"""
SELECT SampleNum AS source_row, EquipNum AS asset_id, EqpModel AS machine_model, {component('Compartment')} AS component,
  DateSampled AS sample_date, DateSampled IS NULL AS is_invalid_date, SampleNum AS sample_number,
  OverallInterp AS interpretation_code, InterpText AS interpretation_text, NULL::DOUBLE AS equipment_hours,
  OilHours AS fluid_hours, {', '.join(f"{NO_M.get(m, 'NULL::DOUBLE')} AS {m}" for m in M)} FROM raw_pit""")

# Long results ---------------------------------------------------------------------------------------------------
cte("details", "raw_details", f"""
SELECT detail_key, {ident('SampleNum')} AS sample_key, upper({strip('resultName')}) AS result_name,
  {num('resultFormattedEntry')} AS value, upper({strip('resultUnits')}) AS units, ModifiedOn AS modified,
  {ident('resultNumber')} AS result_id,
  regexp_matches(coalesce(interpText, ''), {q(fv.ANALYSIS_PREVENTED_PATTERN)}, 'i') AS analysis_prevented
FROM raw_details""")
cte("latest_details", "details", """
SELECT * FROM details QUALIFY row_number() OVER (PARTITION BY sample_key, result_id
  ORDER BY modified DESC NULLS LAST, detail_key DESC) = 1""")
cte("no_placeholders", "latest_details", """
SELECT * REPLACE (CASE WHEN NOT (analysis_prevented AND coalesce(value, 1) = 0) THEN value END AS value)
FROM latest_details""")
NAMES = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fv.RESULT_COLUMNS.items())
cte("measured", "no_placeholders", f"SELECT *, CASE result_name {NAMES} END AS measurement FROM no_placeholders")
UNITS = " OR ".join(f"(measurement = {q(k)} AND units IN ({values(v)}))" for k, v in fv.ACCEPTED_UNITS.items())
cte("unit_checked", "measured", f"""
SELECT * REPLACE (CASE WHEN measurement IS NULL OR measurement NOT IN ({values(list(fv.ACCEPTED_UNITS))}) OR {UNITS}
                       THEN value END AS value) FROM measured""")
cte("converted", "unit_checked", """
SELECT * REPLACE (CASE WHEN measurement = 'WaterPct' AND units IN ('PPM', 'MG/KG') THEN value / 10000 ELSE value END
                  AS value) FROM unit_checked""")
cte("picked", "converted", """
SELECT * FROM converted WHERE sample_key IS NOT NULL AND measurement IS NOT NULL AND value IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY sample_key, measurement ORDER BY modified DESC NULLS FIRST,
  CASE result_name WHEN 'WATER' THEN 2 ELSE 1 END DESC, detail_key DESC) = 1""")
cte("wide", "picked", "SELECT sample_key, " + ", ".join(
    f"max(value) FILTER (WHERE measurement = {q(n)}) AS {n}" for n in fv.DETAIL_COLUMNS) + " FROM picked GROUP BY 1")

# Telemetry ------------------------------------------------------------------------------------------------------
cte("readings", "raw_telemetry", f"""
SELECT reading_id AS reading_key, {ident('TMSAssetID')} AS asset_id, NULL::VARCHAR AS serial_number,
  EquipmentHeader_Model AS machine_model, event_date_time AS event_time, SynapseModifiedDateTime AS modified_time,
  CumulativeOperatingHours_Hour AS operating_hours, Distance_Odometer AS odometer,
  CumulativeIdleHours_Hour AS idle_hours, FuelUsed_FuelConsumed AS fuel_used FROM raw_telemetry""")
cte("latest_readings", "readings", """
SELECT * FROM readings QUALIFY row_number() OVER (PARTITION BY asset_id, event_time
  ORDER BY modified_time DESC NULLS LAST, reading_key DESC) = 1""")
cte("lagged", "latest_readings", """
SELECT *, (epoch_us(event_time) - epoch_us(lag(event_time) OVER w)) / 1e6::DOUBLE / 3600::DOUBLE AS gap_hours,
  operating_hours - lag(operating_hours) OVER w AS operating_hours_delta,
  odometer - lag(odometer) OVER w AS odometer_delta, idle_hours - lag(idle_hours) OVER w AS idle_hours_delta,
  fuel_used - lag(fuel_used) OVER w AS fuel_used_delta
FROM latest_readings WINDOW w AS (PARTITION BY asset_id ORDER BY event_time ASC NULLS LAST)""")
cte("telemetry", "lagged", """
SELECT *, coalesce(operating_hours_delta < 0, false) AS operating_hours_reset,
  coalesce(odometer_delta < 0, false) AS odometer_reset,
  CASE WHEN operating_hours_delta > 0 THEN odometer_delta / operating_hours_delta END AS distance_per_operating_hour,
  CASE WHEN gap_hours > 0 THEN operating_hours_delta / gap_hours END AS utilization_rate FROM lagged""")

# Work orders ----------------------------------------------------------------------------------------------------
cte("orders_text", "raw_orders", f"""
SELECT EquipmentId AS asset_id, {component('Component')} AS component, WorkOrderId AS wo_id, OpenedDate AS opened_date,
  ClosedDate AS closed_date, ObservationEndDate AS observation_end_date, upper({strip('WorkOrderType')}) AS wo_type,
  coalesce(Description, '') || ' ' || coalesce(ActionTaken, '') AS wo_text,
  CASE WHEN try_cast(FailureConfirmed AS DOUBLE) IS NOT NULL THEN try_cast(FailureConfirmed AS DOUBLE)
       WHEN upper(trim(FailureConfirmed)) IN ('TRUE', 'T', 'Y', 'YES') THEN 1
       WHEN upper(trim(FailureConfirmed)) IN ('FALSE', 'F', 'N', 'NO') THEN 0 END AS outcome FROM raw_orders""")
cte("work_orders", "orders_text", f"""
SELECT asset_id, component, wo_id, opened_date, closed_date, observation_end_date, wo_type, wo_text,
  regexp_matches(wo_type, {q(fv.CORRECTIVE_TYPE_PATTERN)}) OR regexp_matches(wo_text, {q(fv.FAILURE_TEXT_PATTERN)}, 'i')
    AS is_corrective,
  CASE WHEN outcome IS NULL THEN 'text_inferred' ELSE 'explicit' END AS failure_label_source,
  coalesce(outcome <> 0, regexp_matches(wo_text, {q(fv.FAILURE_TEXT_PATTERN)}, 'i')) AS confirmed_failure
FROM orders_text""")
cte("stated_orders", "work_orders", "SELECT * FROM work_orders WHERE failure_label_source = 'explicit'")


# Trends ---------------------------------------------------------------------------------------------------------
def trends(source: str) -> str:
    columns = ", ".join(
        f"{m} - lag({m}) OVER w AS {m}_delta, avg({m}) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS {m}_mean_3"
        for m in M)
    rates = ", ".join(
        f"CASE WHEN fluid_hours_delta > 0 THEN 100 * {m}_delta / fluid_hours_delta END AS {m}_rate_100h" for m in M)
    return f"""
SELECT *, floor((epoch_us(sample_date) - epoch_us(previous_sample_date)) / 86400000000.0)::BIGINT
  AS days_since_previous_sample, {rates}
FROM (SELECT *, fluid_hours - previous_fluid_hours AS fluid_hours_delta FROM (
  SELECT *, lag(sample_date) OVER w AS previous_sample_date, lag(fluid_hours) OVER w AS previous_fluid_hours,
    row_number() OVER w AS lab_history_samples, {columns} FROM {source}
  WINDOW w AS (PARTITION BY asset_id, component ORDER BY sample_date ASC NULLS LAST, source_row)))"""


cte("trended", "samples", trends("samples"))
cte("pit_trended", "pit", trends("pit"))

# Point in time --------------------------------------------------------------------------------------------------
cte("pit_dated", "pit", "SELECT * FROM pit WHERE sample_date IS NOT NULL AND asset_id IS NOT NULL")
WIN = " AND t.event_time >= s.sample_date - INTERVAL '{n}' DAY"
cte("pit_telemetry", "pit_dated telemetry", f"""
SELECT s.source_row, (count(t.event_time) > 0)::INT::DOUBLE AS telemetry_available,
  {', '.join(f"sum(CASE WHEN t.operating_hours_delta < 0 THEN 0 ELSE t.operating_hours_delta END)"
             f" FILTER (WHERE true{WIN.format(n=n)}) AS operating_hours_{n}d" for n in (7, 30, 90))},
  sum(CASE WHEN t.odometer_delta < 0 THEN 0 ELSE t.odometer_delta END) FILTER (WHERE true{WIN.format(n=30)})
    AS distance_30d,
  median(t.utilization_rate) FILTER (WHERE true{WIN.format(n=30)}) AS mean_utilization_30d,
  (epoch_us(any_value(s.sample_date)) - epoch_us(max(t.event_time))) / 86400000000.0 AS telemetry_age_days
FROM pit_dated s LEFT JOIN telemetry t ON t.asset_id = s.asset_id AND t.event_time <= s.sample_date
GROUP BY s.source_row""")


def prior(orders: str) -> str:
    return f"""
SELECT s.source_row, (s.asset_id IN (SELECT asset_id FROM {orders}))::INT::DOUBLE AS work_order_history_available,
  CASE WHEN s.asset_id IN (SELECT asset_id FROM {orders}) THEN (
    SELECT count(*) FROM {orders} o WHERE o.asset_id = s.asset_id AND o.is_corrective AND o.confirmed_failure
      AND o.opened_date < s.sample_date AND (s.component IS NULL OR o.component = s.component))::DOUBLE END
    AS prior_corrective_wo_count FROM pit_dated s"""


cte("pit_prior", "pit_dated work_orders", prior("work_orders"))
cte("pit_prior_stated", "pit_dated stated_orders", prior("stated_orders"))
TEXT = strip("interpretation_text")
SIGNALS = {n: f"regexp_matches({TEXT}, {q(p)}, 'i')::INT::DOUBLE" for n, p in fv.TEXT_SIGNALS.items()}
FEATURES = f"""
  source_row, sample_number, asset_id, sample_date, machine_model, component, equipment_hours, fluid_hours,
  days_since_previous_sample, lab_history_samples, {COUNT_M} AS lab_measurement_count,
  ({ANY_M})::INT::DOUBLE AS lab_numeric_available, upper(coalesce(interpretation_code, '')) AS lab_interpretation_code,
  ({TEXT} <> '')::INT::DOUBLE AS lab_text_available, ln(1 + length({TEXT})) AS lab_text_length_log,
  {', '.join(f"{m}, {m}_delta, {m}_rate_100h, {m}_mean_3" for m in M)},
  {', '.join(f"{e} AS {n}" for n, e in SIGNALS.items())}, {' + '.join(SIGNALS.values())} AS lab_text_signal_count"""


def scoring(orders: str) -> str:
    return f"""
SELECT f.*, p.work_order_history_available, p.prior_corrective_wo_count, t.telemetry_available, t.operating_hours_7d,
  t.operating_hours_30d, t.operating_hours_90d, t.distance_30d, t.mean_utilization_30d, t.telemetry_age_days
FROM (SELECT {FEATURES} FROM pit_trended WHERE sample_date IS NOT NULL AND asset_id IS NOT NULL) f
JOIN {orders} p USING (source_row) JOIN pit_telemetry t USING (source_row)"""


cte("scoring", "pit_trended pit_prior pit_telemetry", scoring("pit_prior"))
cte("stated_scoring", "pit_trended pit_prior_stated pit_telemetry", scoring("pit_prior_stated"))
HORIZON = 3
cte("ends", "stated_orders", "SELECT asset_id, max(observation_end_date) AS stated_end FROM stated_orders GROUP BY 1")
cte("pit_ends", "pit_dated stated_orders ends", """
SELECT s.*, coalesce(e.stated_end, (SELECT coalesce(max(observation_end_date), max(opened_date)) FROM stated_orders))
  AS observation_end FROM pit_dated s LEFT JOIN ends e USING (asset_id)""")
cte("pit_labels", "pit_dated stated_orders", f"""
SELECT s.source_row, EXISTS (SELECT 1 FROM stated_orders o WHERE o.asset_id = s.asset_id AND o.is_corrective
    AND o.confirmed_failure AND o.opened_date > s.sample_date
    AND o.opened_date <= s.sample_date + INTERVAL '{HORIZON}' DAY
    AND (s.component IS NULL OR o.component = s.component))::INT AS {fv.TARGET} FROM pit_dated s""")
cte("training", "stated_scoring pit_labels pit_ends stated_orders", f"""
SELECT s.*, l.{fv.TARGET}, {HORIZON} AS horizon_days FROM stated_scoring s JOIN pit_labels l USING (source_row)
JOIN pit_ends e USING (source_row)
WHERE s.asset_id IN (SELECT asset_id FROM stated_orders)
  AND s.sample_date + INTERVAL '{HORIZON}' DAY <= e.observation_end""")
# The label rows alone, for everything that needs no features.
cte("labelled", "pit_labels pit_ends stated_orders", f"""
SELECT e.source_row, e.asset_id, e.sample_date, e.machine_model, e.component, l.{fv.TARGET}
FROM pit_ends e JOIN pit_labels l USING (source_row)
WHERE e.asset_id IN (SELECT asset_id FROM stated_orders)
  AND e.sample_date + INTERVAL '{HORIZON}' DAY <= e.observation_end""")
cte("scored", "labelled raw_pit", f"""
SELECT l.{fv.TARGET} AS label, floor(r.OilHours * 37 % 100) / 100::DOUBLE AS probability
FROM labelled l JOIN raw_pit r ON r.SampleNum = l.source_row""")
cte("matched", "samples telemetry", """
SELECT asset_id FROM samples WHERE asset_id IS NOT NULL INTERSECT SELECT asset_id FROM telemetry
WHERE asset_id IS NOT NULL""")

# Triage ---------------------------------------------------------------------------------------------------------
RULE_HIT = {r["id"]: "(" + " OR ".join(f"regexp_matches(interpretation_text, {q(p)}, 'i')" for p in r["patterns"]) + ")"
            for r in fv.RULES}
cte("rule_hits", "samples", f"""
SELECT *, upper(coalesce(interpretation_code, '')) AS code, {', '.join(f"{e} AS hit_{n}" for n, e in RULE_HIT.items())}
FROM samples""")


def listed(key: str) -> str:
    """Texts of the hit rules, in order."""
    return ", ".join(f"CASE WHEN hit_{r['id']} THEN {q(r[key])} END" for r in fv.RULES)


HITS = " + ".join(f"hit_{r['id']}::INT" for r in fv.RULES)
BASE = "CASE code " + " ".join(f"WHEN {q(k)} THEN {v}::DOUBLE" for k, v in fv.SEVERITY_CODES.items()) + " ELSE 0.25::DOUBLE END"
SCORES = ", ".join(f"CASE WHEN hit_{r['id']} THEN {r['score']}::DOUBLE ELSE 0::DOUBLE END" for r in fv.RULES)
STATUS = "upper(status)"
URGENT = "('T', 'TRUE', '1', 'Y', 'YES')"
cte("rule_results", "rule_hits", f"""
SELECT source_row, sample_number, asset_id, serial_number, machine_model, component, sample_date, sample_date_raw,
  is_invalid_date, date_quality_issue, code AS interpretation_code,
  CASE WHEN code = 'AR' THEN 'Laboratory Action Required' WHEN code IN ('A', 'NAR', 'NORMAL') THEN 'Normal'
       WHEN code IN ('B', 'YELLOW', 'WATCH') THEN 'Warning' WHEN code IN ('C', 'RED') THEN 'Severe'
       WHEN code <> '' THEN 'Code ' || code ELSE 'Unspecified' END AS lab_status,
  status AS loaded_status,
  upper(left(coalesce(status, 'New'), 1)) || lower(substr(coalesce(status, 'New'), 2)) AS status,
  upper(coalesce(high_priority, '')) AS high_priority, wo_id, wo_status, site_name,
  {BASE} AS base_severity, greatest({BASE}, {SCORES}) AS strength,
  CASE WHEN {HITS} = 0 THEN 'none' ELSE concat_ws('; ', {', '.join(f"CASE WHEN hit_{r['id']} THEN {q(r['id'])} END" for r in fv.RULES)}) END
    AS triggered_rules,
  CASE WHEN code <> 'AR' AND {HITS} = 0 THEN {q(fv.NO_EVIDENCE)}
       ELSE concat_ws('; ', CASE WHEN code = 'AR' THEN {q(fv.AR_EVIDENCE)} END, {listed('evidence')}) END AS evidence,
  {q(fv.ACTION_PREFIX)} || CASE WHEN code <> 'AR' AND {HITS} = 0 THEN {q(fv.NO_RECOMMENDATION)}
       ELSE concat_ws(' ', CASE WHEN code = 'AR' THEN {q(fv.AR_RECOMMENDATION)} END, {listed('recommendation')}) END
    AS recommended_action,
  CASE WHEN fluid_hours IS NULL OR contains(lower(interpretation_text), 'more sample history needed') THEN 'Low'
       WHEN {HITS} >= 2 THEN 'High' ELSE 'Medium' END AS confidence,
  interpretation_text AS original_interpretation
FROM rule_hits""")
cte("base_alerts", "rule_results", f"""
SELECT * EXCLUDE (strength, base_severity, loaded_status, repeats), round(strength, 3) AS rule_evidence_strength,
  CASE WHEN strength >= 0.8 THEN 'Strong rule match' WHEN strength >= 0.5 THEN 'Moderate rule match'
       ELSE 'Basic rule match' END AS evidence_level,
  CASE WHEN is_invalid_date THEN 'Data quality hold' WHEN {STATUS} = 'CLOSED' THEN 'Closed'
       WHEN high_priority IN {URGENT} AND {STATUS} = 'NEW' THEN 'Immediate review'
       WHEN interpretation_code = 'AR' AND {STATUS} = 'NEW' AND repeats >= 2 THEN 'Priority review'
       WHEN interpretation_code = 'AR' AND {STATUS} = 'NEW' AND wo_id IS NOT NULL THEN 'In progress'
       WHEN interpretation_code = 'AR' AND {STATUS} = 'NEW' THEN 'Priority review'
       WHEN wo_id IS NOT NULL THEN 'In progress'
       WHEN interpretation_code IN ('B', 'C', 'AR', 'RED', 'YELLOW') THEN 'Priority review' ELSE 'In progress' END
    AS operational_priority,
  CASE WHEN is_invalid_date
         THEN 'Missing or time-only sample date (e.g., year 1899 or unparseable date format)'
       WHEN {STATUS} = 'CLOSED' THEN 'SampleStatusNew is Closed'
       WHEN high_priority IN {URGENT} AND {STATUS} = 'NEW' AND wo_id IS NULL
         THEN 'HighPriority=T, Status=New, and no WorkOrderId assigned'
       WHEN high_priority IN {URGENT} AND {STATUS} = 'NEW'
         THEN 'HighPriority=T, Status=New, with assigned WorkOrderId (' || wo_id || ')'
       WHEN interpretation_code = 'AR' AND {STATUS} = 'NEW' AND repeats >= 2
         THEN 'Repeated New AR sample (' || repeats || ' occurrences) for ' || coalesce(asset_id, '<NA>') || ' / '
              || coalesce(component, '<NA>') || ' '
              || CASE WHEN wo_id IS NULL THEN 'without WorkOrderId' ELSE 'with WorkOrderId (' || wo_id || ')' END
       WHEN interpretation_code = 'AR' AND {STATUS} = 'NEW' AND wo_id IS NOT NULL
         THEN 'New AR sample with assigned WorkOrderId (' || wo_id || ')'
       WHEN interpretation_code = 'AR' AND {STATUS} = 'NEW' THEN 'New AR sample without WorkOrderId assigned'
       WHEN wo_id IS NOT NULL THEN 'Assigned WorkOrderId (' || wo_id || ')'
       WHEN interpretation_code IN ('B', 'C', 'AR', 'RED', 'YELLOW')
         THEN 'Elevated laboratory code (' || interpretation_code || ') without assigned WorkOrderId'
       ELSE 'Status ' || status END AS base_evidence
FROM (SELECT *, count(*) FILTER (WHERE interpretation_code = 'AR' AND upper(loaded_status) = 'NEW')
               OVER (PARTITION BY asset_id, component) AS repeats FROM rule_results)""")
cte("alerts", "base_alerts", f"""
SELECT * EXCLUDE (base_evidence, unlinked), priority_tier AS workflow_priority, priority_reason AS priority_evidence
FROM (SELECT *,
  CASE WHEN {STATUS} = 'CLOSED' THEN {q(fv.CLOSED)}
       WHEN high_priority IN {URGENT} AND wo_id IS NULL THEN {q(fv.P1_IMMEDIATE)}
       WHEN high_priority IN {URGENT} THEN {q(fv.P1_WO_TRACKING)}
       WHEN interpretation_code = 'AR' AND {STATUS} = 'NEW' AND unlinked >= 2 AND wo_id IS NULL THEN {q(fv.P2_REPEATED)}
       WHEN interpretation_code = 'AR' AND {STATUS} = 'NEW' AND wo_id IS NULL THEN {q(fv.P3_ACTION)}
       ELSE {q(fv.IN_PROGRESS)} END AS priority_tier,
  CASE WHEN {STATUS} = 'CLOSED' THEN 'The laboratory record status is Closed. This does not by itself confirm that maintenance or repair was completed.'
       WHEN high_priority IN {URGENT} AND wo_id IS NULL
         THEN 'HighPriority flag is set (HighPriority=T), status is New, and no WorkOrderId is assigned. Requires immediate engineer review.'
       WHEN high_priority IN {URGENT}
         THEN 'HighPriority flag is set (HighPriority=T), status is New, and WorkOrderId ' || wo_id || ' is linked. Verify its status, inspection result and outcome urgently.'
       WHEN interpretation_code = 'AR' AND {STATUS} = 'NEW' AND unlinked >= 2 AND wo_id IS NULL
         THEN 'This extract contains ' || unlinked || ' New AR records for asset ' || coalesce(asset_id, '<NA>')
              || ' / compartment ' || coalesce(component, '<NA>')
              || '; this record has no linked WorkOrderId. Verify the dated history and maintenance response.'
       WHEN interpretation_code = 'AR' AND {STATUS} = 'NEW' AND wo_id IS NOT NULL
         THEN 'New AR sample has linked WorkOrderId ' || wo_id || '. A linked identifier does not confirm inspection, repair, or WO completion.'
       WHEN interpretation_code = 'AR' AND {STATUS} = 'NEW'
         THEN 'New AR sample has no linked WorkOrderId. Verify whether a WO exists and route the laboratory recommendation for engineering review.'
       WHEN wo_id IS NOT NULL
         THEN 'WorkOrderId ' || wo_id || ' is linked; its maintenance outcome is not available in this file.'
       ELSE 'Status is ' || status || ' with interpretation code ' || interpretation_code || '.' END AS priority_reason,
  CASE WHEN is_invalid_date THEN 'Review required' ELSE 'Valid' END AS data_quality_status,
  CASE WHEN is_invalid_date THEN date_quality_issue ELSE '' END AS data_quality_issue
FROM (SELECT *, count(*) FILTER (WHERE interpretation_code = 'AR' AND {STATUS} = 'NEW' AND wo_id IS NULL)
               OVER (PARTITION BY asset_id, component) AS unlinked FROM base_alerts))""")
cte("sentences", "alerts", """
SELECT original_interpretation AS t, trim(unnest(l)) AS s, generate_subscripts(l, 1) AS i
FROM (SELECT original_interpretation, regexp_extract_all(original_interpretation, '[^.!?]*[.!?]+') AS l
      FROM (SELECT DISTINCT original_interpretation FROM alerts))""")
CATS = ", ".join(f"({i}, {q(n)}, {q(p)})" for i, (n, p) in enumerate(fv.CATEGORIES))
cte("text_categories", "sentences alerts", f"""
SELECT t, n AS problem_category, arg_min(s, i) AS category_evidence
FROM sentences, (VALUES {CATS}) AS c(o, n, p) WHERE regexp_matches(s, p, 'i') GROUP BY t, n
UNION ALL
SELECT d.t, 'Other', coalesce((SELECT arg_min(s, i) FROM sentences x WHERE x.t = d.t), left(d.t, 120))
FROM (SELECT DISTINCT original_interpretation AS t FROM alerts) d
WHERE NOT EXISTS (SELECT 1 FROM sentences x, (VALUES {CATS}) AS c(o, n, p)
                  WHERE x.t = d.t AND regexp_matches(x.s, c.p, 'i'))""")

# Cards and cases ------------------------------------------------------------------------------------------------
EVIDENCE = "CASE WHEN evidence = " + q(fv.NO_EVIDENCE) + (
    " THEN 'Laboratory AR flag — no numerical measurement data available'"
    " ELSE array_to_string(list_slice(string_split(evidence, '; '), 1, 4), ' | ') END")
SOURCES = "concat_ws(', ', 'S.O.S.', CASE WHEN telemetry_available THEN 'telemetry' END, CASE WHEN work_order_history_available THEN 'work-order history' END)"
cte("cards", "alerts telemetry work_orders samples", f"""
SELECT *, {EVIDENCE} AS key_evidence, {SOURCES} AS prediction_data_sources FROM (
SELECT a.*, a.sample_date IS NOT NULL AND EXISTS (SELECT 1 FROM telemetry t WHERE t.asset_id = a.asset_id
         AND t.event_time <= a.sample_date) AS telemetry_available,
       a.sample_date IS NOT NULL AND a.asset_id IN (SELECT asset_id FROM work_orders) IS TRUE
         AS work_order_history_available FROM alerts a)""")
cte("pct", "raw_samples", """
SELECT SampleNum AS source_row, 
  (ascii(right(SampleNum, 1)) * 7 + length(SampleNum) * 11 + ascii(SampleNum)) % 100 AS pct FROM raw_samples""")
cte("scored_cards", "cards pct", "SELECT c.*, p.pct::INT AS failure_probability_pct FROM cards c JOIN pct p USING (source_row)")
RANK = "CASE priority_tier " + " ".join(f"WHEN {q(t)} THEN {i}" for i, t in enumerate(fv.TIERS)) + " ELSE 9 END"
cte("findings", "scored_cards", f"""
SELECT *, {RANK} AS priority_rank FROM scored_cards QUALIFY row_number() OVER (PARTITION BY asset_id, component
  ORDER BY priority_tier = 'Closed', {RANK}, coalesce(sample_date, TIMESTAMP '1900-01-01') DESC, source_row DESC) = 1""")
cte("last_rows", "scored_cards", """
SELECT asset_id, component, sample_date AS latest_sample_date, lab_status AS latest_lab_status FROM scored_cards
QUALIFY row_number() OVER (PARTITION BY asset_id, component
  ORDER BY sample_date IS NULL, sample_date DESC, source_row DESC) = 1""")
cte("last_scores", "scored_cards", """
SELECT asset_id, component, failure_probability_pct, prediction_data_sources FROM scored_cards
WHERE failure_probability_pct IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY asset_id, component
  ORDER BY coalesce(sample_date, TIMESTAMP '1900-01-01') DESC, source_row DESC) = 1""")
cte("case_counts", "scored_cards", """
SELECT asset_id, component, count(*) FILTER (WHERE priority_tier <> 'Closed') AS open_sample_count,
  count(*) AS total_sample_count FROM scored_cards GROUP BY ALL""")
cte("case_confidence", "samples telemetry work_orders", f"""
SELECT *, CASE WHEN points >= 4 THEN 'High' WHEN points >= 2 THEN 'Medium' ELSE 'Low' END AS data_confidence,
  concat_ws('; ', CASE WHEN numeric_rows >= 3 THEN numeric_rows || ' dated numerical samples'
                       WHEN dated_rows >= 2 THEN dated_rows || ' dated samples' ELSE 'limited dated sample history' END,
    CASE WHEN has_telemetry THEN 'matched telemetry available' ELSE 'no matched telemetry' END,
    CASE WHEN has_orders THEN 'detailed work-order history available' ELSE 'detailed WO outcome unavailable' END)
    AS confidence_reason
FROM (SELECT *, CASE WHEN numeric_rows >= 3 THEN 2 WHEN dated_rows >= 2 THEN 1 ELSE 0 END + has_telemetry::INT
               + has_orders::INT AS points
  FROM (SELECT asset_id, component, count(*) FILTER (WHERE NOT is_invalid_date) AS dated_rows,
          count(*) FILTER (WHERE NOT is_invalid_date AND {ANY_M}) AS numeric_rows,
          coalesce(asset_id IN (SELECT asset_id FROM telemetry WHERE asset_id IS NOT NULL), false) AS has_telemetry,
          coalesce(asset_id IN (SELECT asset_id FROM work_orders), false) AS has_orders
        FROM samples GROUP BY asset_id, component))""")
cte("severities", "alerts", """
SELECT *, count(*) OVER (PARTITION BY asset_id, component) AS dated_statuses FROM (
SELECT asset_id, component, sample_date, source_row, recommended_action || ' ' || original_interpretation AS timing_text,
  CASE lab_status WHEN 'Laboratory Action Required' THEN 2 WHEN 'Severe' THEN 2 WHEN 'Warning' THEN 1
       WHEN 'Normal' THEN 0 END AS severity FROM alerts WHERE NOT is_invalid_date)""")
cte("known_statuses", "severities", """
SELECT *, row_number() OVER (PARTITION BY asset_id, component ORDER BY sample_date DESC, source_row DESC) AS n,
  first_value(severity) OVER (PARTITION BY asset_id, component ORDER BY sample_date DESC, source_row DESC) AS latest
FROM severities WHERE severity IS NOT NULL""")
cte("runs", "known_statuses", """
SELECT asset_id, component, any_value(latest) AS latest, max(severity) FILTER (WHERE n = 2) AS prior,
  count(*) AS known, count(*) FILTER (WHERE severity = 2) AS abnormal,
  coalesce(min(n) FILTER (WHERE severity <> latest) - 1, count(*)) AS run FROM known_statuses GROUP BY ALL""")
cte("run_starts", "runs known_statuses", """
SELECT r.asset_id, r.component, k.sample_date AS run_start FROM runs r JOIN known_statuses k
ON k.asset_id IS NOT DISTINCT FROM r.asset_id AND k.component IS NOT DISTINCT FROM r.component AND k.n = r.run""")
SAME = "{a}.asset_id IS NOT DISTINCT FROM {b}.asset_id AND {a}.component IS NOT DISTINCT FROM {b}.component"
ON = lambda a, b: SAME.format(a=a, b=b)
cte("last_dated", "severities", """
SELECT asset_id, component, sample_date AS latest_date, timing_text, dated_statuses FROM severities
QUALIFY row_number() OVER (PARTITION BY asset_id, component ORDER BY sample_date DESC, source_row DESC) = 1""")
cte("outlook", "alerts last_dated runs run_starts case_confidence", f"""
SELECT asset_id, component,
  CASE WHEN latest IS NULL THEN 'Insufficient history' WHEN latest = 2 AND run >= 2 THEN 'Persistent abnormal'
       WHEN latest > prior THEN 'Worsening' WHEN latest < prior THEN 'Improving' WHEN latest = 2 THEN 'Abnormal — new'
       WHEN latest = 1 THEN 'Monitor' ELSE 'Stable normal' END AS condition_trajectory,
  CASE WHEN latest IS NULL THEN 'No dated sequence' ELSE run || ' consecutive '
       || CASE latest WHEN 2 THEN 'action-required' WHEN 1 THEN 'warning' ELSE 'normal' END || ' sample(s)'
       || CASE WHEN run >= 2 AND run_days > 0 THEN ' across ' || run_days || ' days' ELSE '' END END
    AS condition_persistence,
  CASE WHEN latest IS NOT NULL AND hours <> '' THEN 'Resample in ' || hours || ' operating hours'
       ELSE 'Next scheduled sample' END AS next_checkpoint,
  CASE WHEN known >= 12 AND numeric_rows >= 6 AND has_orders THEN 'High'
       WHEN known >= 6 AND numeric_rows >= 3 THEN 'Medium' ELSE 'Low' END AS outlook_confidence,
  CASE WHEN latest IS NOT NULL THEN known || ' dated statuses; ' || abnormal || ' action-required; ' || numeric_rows
         || ' sample(s) with measured numerical results; telemetry '
         || CASE WHEN has_telemetry THEN 'available' ELSE 'not available' END || '; WO outcomes '
         || CASE WHEN has_orders THEN 'available' ELSE 'not available' END
       WHEN dated_statuses IS NOT NULL
         THEN dated_statuses || ' dated sample(s), but no recognised laboratory status sequence'
       ELSE 'No usable dated laboratory sequence' END AS outlook_basis
FROM (SELECT a.*, r.latest, r.prior, r.known, r.abnormal, r.run, d.dated_statuses, c.numeric_rows, c.has_telemetry,
        c.has_orders, floor((epoch_us(d.latest_date) - epoch_us(s.run_start)) / 86400000000.0)::BIGINT AS run_days,
        regexp_extract(d.timing_text, '(?i)\\b(\\d{{1,4}})\\s*(?:operating[- ]?)?hours?\\b', 1) AS hours
      FROM (SELECT DISTINCT asset_id, component FROM alerts) a
      LEFT JOIN last_dated d ON {ON('a', 'd')} LEFT JOIN runs r ON {ON('a', 'r')}
      LEFT JOIN run_starts s ON {ON('a', 's')} LEFT JOIN case_confidence c ON {ON('a', 'c')})""")
cte("latest_samples", "samples", """
SELECT *, upper(coalesce(interpretation_code, '')) AS code, lower(interpretation_text) AS txt FROM samples
QUALIFY row_number() OVER (PARTITION BY asset_id, component
  ORDER BY sample_date IS NULL, sample_date DESC, source_row DESC) = 1""")
cte("ar_runs", "samples", """
SELECT asset_id, component, coalesce(min(n) FILTER (WHERE coalesce(interpretation_code, '') <> 'AR') - 1, count(*)) AS run
FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, component ORDER BY sample_date DESC, source_row DESC) AS n
      FROM samples WHERE sample_date IS NOT NULL) GROUP BY ALL""")
cte("index_flags", "latest_samples ar_runs", f"""
SELECT l.*, greatest(coalesce(r.run, 0), 1) AS run, l.code = 'AR' AS f_ar,
  coalesce(l.water_pct > 0.02, false) OR contains(txt, 'water present') OR contains(txt, 'excessive water') AS f_water,
  contains(txt, 'coolant') OR contains(txt, 'glycol') OR contains(txt, 'antifreeze') AS f_coolant,
  contains(txt, 'fuel dilution') OR contains(txt, 'fuel in oil') AS f_fuel,
  coalesce(iron_ppm > 150, false) AS f_iron, coalesce(copper_ppm > 15, false) AS f_copper,
  coalesce(silicon_ppm > 25, false) AND coalesce(aluminium_ppm > 15, false) AS f_dirt,
  contains(txt, 'viscosity') OR contains(txt, 'oxidation') OR contains(txt, 'degraded') AS f_fluid,
  l.code <> 'AR' AND (contains(l.code, 'WARN') OR contains(l.code, 'MONITOR') OR contains(l.code, 'B')
                      OR contains(l.code, 'C')) AS f_watch
FROM latest_samples l LEFT JOIN ar_runs r ON {ON('l', 'r')}""")


def whole(x: str) -> str:
    """Half-even integer text of a double."""
    return f"round_even({x}, 0)::BIGINT"


cte("condition_index", "index_flags", f"""
SELECT asset_id, component, health_score::INT AS health_score,
  CASE WHEN health_score >= 85 THEN 'Optimal' WHEN health_score >= 65 THEN 'Monitor' ELSE 'Degraded' END AS health_status,
  CASE WHEN fingerprint = '' THEN 'Normal Mechanical Baseline' ELSE fingerprint END AS failure_fingerprint,
  health_penalties
FROM (SELECT asset_id, component,
  greatest(5, least(100, 100 - CASE WHEN f_ar AND run >= 2 THEN 45 WHEN f_ar THEN 30 WHEN f_watch THEN 15 ELSE 0 END
    - f_water::INT * 25 - f_coolant::INT * 25 - f_fuel::INT * 20
    - CASE WHEN f_iron AND f_copper THEN 20 WHEN f_iron THEN 15 ELSE 0 END - f_dirt::INT * 15 - f_fluid::INT * 10))
    AS health_score,
  concat_ws(' + ', CASE WHEN f_water THEN 'Seal/Plug Moisture Ingress' END,
    CASE WHEN f_coolant THEN 'Cooler / Internal Leak' END, CASE WHEN f_fuel THEN 'Fuel Injector Dilution' END,
    CASE WHEN f_iron AND f_copper THEN 'Gear Mesh & Bushing Breakdown' WHEN f_iron THEN 'Mechanical Gear Wear' END,
    CASE WHEN f_dirt THEN 'Abrasive Dust Ingress via Breather' END) AS fingerprint,
  concat_ws(' | ', CASE WHEN f_ar AND run >= 2 THEN 'Repeated lab Action Required (' || run || 'x consecutive)'
                        WHEN f_ar THEN 'Lab Action Required (AR)' WHEN f_watch THEN 'Lab Monitor / Warning status' END,
    CASE WHEN f_water THEN 'Severe water contamination' END,
    CASE WHEN f_coolant THEN 'Coolant / Glycol contamination' END, CASE WHEN f_fuel THEN 'Fuel dilution' END,
    CASE WHEN f_iron AND f_copper THEN 'Elevated gear & bushing wear (Fe ' || {whole('iron_ppm')} || ', Cu '
           || {whole('copper_ppm')} || ' ppm)'
         WHEN f_iron THEN 'Elevated Iron (' || {whole('iron_ppm')} || ' ppm)' END,
    CASE WHEN f_dirt THEN 'Abrasive dirt ingress (Si ' || {whole('silicon_ppm')} || ', Al ' || {whole('aluminium_ppm')}
           || ' ppm)' END,
    CASE WHEN f_fluid THEN 'Fluid degradation / thermal stress' END) AS health_penalties
FROM index_flags)""")
LABELS = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fv.COMPONENT_LABELS.items())
TIER_TEXT = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fv.TIER_LABELS.items())
DUE = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fv.TIER_DUE.items())
cte("cases", "findings last_rows last_scores case_counts case_confidence outlook condition_index", f"""
SELECT coalesce(f.asset_id, '<NA>') || '::' || coalesce(f.component, '<NA>') AS case_id, f.priority_rank,
  CASE f.priority_tier {TIER_TEXT} END AS priority, f.priority_tier AS priority_code, f.asset_id, f.component,
  CASE coalesce(f.component, 'UNKNOWN') {LABELS} ELSE 'Unknown' END AS component_name, f.machine_model, f.site_name,
  l.latest_sample_date, f.sample_date AS finding_sample_date, l.latest_lab_status AS lab_status,
  f.lab_status AS active_finding_lab_status, string_split(f.key_evidence, ' | ')[1] AS main_issue,
  s.failure_probability_pct::DOUBLE AS failure_probability_pct,
  coalesce(s.failure_probability_pct || '% / 30 days', 'Not available') AS probability_display,
  coalesce(s.prediction_data_sources, f.prediction_data_sources) AS prediction_data_sources,
  coalesce(f.wo_id, '') AS wo_id,
  CASE WHEN f.wo_id IS NULL THEN 'No linked WO' ELSE 'Linked — verify outcome' END AS wo_status_display,
  replace(f.recommended_action, 'Suggested engineering review: ', '') AS required_action,
  CASE f.priority_tier {DUE} ELSE 'Closed' END AS due, n.open_sample_count, n.total_sample_count,
  c.data_confidence, c.confidence_reason, o.condition_trajectory, o.condition_persistence, o.next_checkpoint,
  o.outlook_confidence, o.outlook_basis, i.health_score, i.health_status, i.failure_fingerprint, i.health_penalties,
  f.data_quality_status, f.data_quality_issue, f.sample_number, f.key_evidence
FROM findings f JOIN last_rows l ON {ON('f', 'l')} LEFT JOIN last_scores s ON {ON('f', 's')}
JOIN case_counts n ON {ON('f', 'n')} JOIN case_confidence c ON {ON('f', 'c')} JOIN outlook o ON {ON('f', 'o')}
JOIN condition_index i ON {ON('f', 'i')}""")
