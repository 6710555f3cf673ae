"""Names, labels, patterns, thresholds and messages that results are compared on.

Nothing here is logic. Every list is in the order in which it is matched or displayed.
"""

from __future__ import annotations

# Measurements, in column order.
MEASUREMENTS = [
    "iron_ppm", "copper_ppm", "aluminium_ppm", "chromium_ppm", "lead_ppm", "silicon_ppm",
    "water_pct", "fuel_dilution_pct", "soot_pct", "viscosity_cst", "oxidation", "tbn",
]
MEASUREMENT_LABELS = {
    "iron_ppm": ("Iron", "ppm"),
    "copper_ppm": ("Copper", "ppm"),
    "aluminium_ppm": ("Aluminium", "ppm"),
    "chromium_ppm": ("Chromium", "ppm"),
    "lead_ppm": ("Lead", "ppm"),
    "silicon_ppm": ("Silicon", "ppm"),
    "water_pct": ("Water", "%"),
    "fuel_dilution_pct": ("Fuel dilution", "%"),
    "soot_pct": ("Soot", "%"),
    "viscosity_cst": ("Viscosity", "cSt"),
    "oxidation": ("Oxidation", ""),
    "tbn": ("TBN", ""),
}

# Unicode white space, and cell texts that mean "missing".
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)
BLANK_TEXTS = ["", "nan", "None", "<NA>"]
TRUE_TEXTS = ["TRUE", "T", "YES", "Y", "1"]
FALSE_TEXTS = ["FALSE", "F", "NO", "N", "0", ""]

# Component aliases and display names.
COMPONENT_ALIASES = {
    "ENGINE": "ENG", "ENG": "ENG",
    "HYDRAULIC": "HYD", "HYDRAULICS": "HYD", "HYD": "HYD",
    "TRANSMISSION": "TRANS", "TRANS": "TRANS", "TR": "TRANS",
}
COMPONENT_LABELS = {
    "ENG": "Engine", "ENGINE": "Engine",
    "HYD": "Hydraulic system", "HYDRAULIC": "Hydraulic system",
    "TR": "Transmission", "TRANS": "Transmission", "TRANSMISSION": "Transmission",
    "DIFF_FR": "Front differential", "DIFF_RR": "Rear differential", "DIF": "Differential",
    "FINAL_DRIVE": "Final drive", "FD_LR": "Left-rear final drive", "FD_RR": "Right-rear final drive",
}

# Calendar dates.
TIME_ONLY_PATTERN = r"^\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?$"
FIRST_YEAR, LAST_YEAR = 1950, 2035
DATE_MISSING = "Missing calendar date"
DATE_TIME_ONLY = "Time-only value; calendar date is missing"
DATE_UNPARSEABLE = "Unparseable calendar date"
DATE_OUT_OF_RANGE = "Calendar date is outside the accepted 1950–2035 range"
DATE_UNSPECIFIED = "Sample calendar date is missing or invalid"

# Accepted headers, first match wins.
SAMPLE_HEADERS = {
    "asset_id": ["EquipNum", "EquipmentId", "EquipmentID", "AssetId", "AssetName"],
    "serial_number": ["SerialNum", "SerialNumber", "EquipmentSerialNumber"],
    "machine_model": ["EqpModel", "EquipmentModel", "Model"],
    "component": ["Compartment", "Component", "component"],
    "sample_date": ["DateSampled", "SampleDate", "sample_date"],
    "sample_number": ["SampleNum", "SampleNumber", "sample_id", "Id"],
    "interpretation_code": ["OverallInterp", "Severity", "InterpretationCode"],
    "interpretation_text": ["InterpText", "InterpretationText", "Recommendation"],
    "equipment_hours": ["CMeter", "MeterHours", "EquipmentHours"],
    "fluid_hours": ["CMeterFluid", "OilHours", "FluidHours"],
    "fluid_changed": ["FluidChanged"],
    "filter_changed": ["FilterChanged"],
    "high_priority": ["HighPriority"],
    "status": ["SampleStatusNew", "Status", "SampleStatus", "AlertStatus"],
    "wo_id": ["WorkOrderId", "WO_ID", "ShopJobNo"],
    "wo_status": ["WOStatus", "WorkOrderStatus"],
    "site_name": ["SiteName", "EqpJobsite", "JobsiteDesc", "SiteId"],
}
MEASUREMENT_HEADERS = {
    "iron_ppm": ["Fe", "Iron", "iron_ppm", "Fe_ppm"],
    "copper_ppm": ["Cu", "Copper", "copper_ppm", "Cu_ppm"],
    "aluminium_ppm": ["Al", "Aluminum", "Aluminium", "aluminium_ppm", "Al_ppm"],
    "chromium_ppm": ["Cr", "Chromium", "chromium_ppm", "Cr_ppm"],
    "lead_ppm": ["Pb", "Lead", "lead_ppm", "Pb_ppm"],
    "silicon_ppm": ["Si", "Silicon", "silicon_ppm", "Si_ppm"],
    "water_pct": ["Water", "WaterPct", "water_pct"],
    "fuel_dilution_pct": ["FuelDilution", "FuelPct", "fuel_dilution_pct"],
    "soot_pct": ["Soot", "SootPct", "soot_pct"],
    "viscosity_cst": ["Viscosity", "ViscosityCst", "viscosity_cst"],
    "oxidation": ["Oxidation", "oxidation"],
    "tbn": ["TBN", "tbn"],
}
TELEMETRY_HEADERS = {
    "asset_id": ["TMSAssetID", "EquipmentHeader_EquipmentID", "EquipmentId", "EquipmentID", "EquipNum", "AssetId"],
    "event_time": ["Location_Datetime", "CumulativeOperatingHours_Datetime", "Timestamp", "EventDateTime",
                   "DateTime", "EventTime", "ReadingDate", "event_time"],
    "serial_number": ["TMSSerialNum", "EquipmentHeader_SerialNumber", "SerialNumber"],
    "machine_model": ["EquipmentHeader_Model", "EquipmentModel", "Model"],
    "modified_time": ["SynapseModifiedDateTime", "ModifiedOn"],
    "operating_hours": ["CumulativeOperatingHours_Hour", "OperatingHours", "operating_hours"],
    "odometer": ["Distance_Odometer", "Odometer", "odometer"],
    "idle_hours": ["CumulativeIdleHours_Hour", "IdleHours", "idle_hours"],
    "fuel_used": ["FuelUsed_FuelConsumed", "FuelUsed", "fuel_used"],
    "latitude": ["Location_Latitude", "Latitude"],
    "longitude": ["Location_Longitude", "Longitude"],
}
WORK_ORDER_HEADERS = {
    "asset_id": ["EquipmentId", "EquipNum", "AssetId", "EquipmentID"],
    "component": ["Component", "Compartment", "component"],
    "wo_id": ["WorkOrderId", "WO_ID", "wo_id", "Id"],
    "opened_date": ["OpenedDate", "OpenDate", "WorkOrderDate", "opened_date"],
    "closed_date": ["ClosedDate", "CloseDate", "closed_date"],
    "observation_end_date": ["ObservationEndDate", "DataThroughDate", "ExtractEndDate"],
    "wo_type": ["WorkOrderType", "WOType", "Type"],
    "failure_confirmed": ["FailureConfirmed", "ConfirmedFailure"],
}
WORK_ORDER_TEXT_COLUMNS = ["ProblemDescription", "Description", "ActionTaken", "TechnicianNotes", "FailureCode"]
DETAIL_HEADERS = {
    "sample": ["SampleNum", "SampleNumber", "sample_id", "Id"],
    "name": ["resultName", "ResultName", "resultAliasName"],
    "value": ["resultFormattedEntry", "ResultFormattedEntry", "ResultValue", "Value"],
    "comment": ["interpText", "InterpretationText", "Comment", "Comments"],
    "units": ["resultUnits", "Units", "Unit"],
    "modified": ["SynapseModifiedDateTime", "resultChangedOn", "ModifiedOn"],
    "result_id": ["resultNumber", "ResultNumber", "ResultId"],
}

# Laboratory result names, output columns and accepted units.
RESULT_COLUMNS = {
    "FE": "Fe", "CU": "Cu", "AL": "Al", "CR": "Cr", "PB": "Pb", "SI": "Si",
    "V100": "Viscosity", "OXI": "Oxidation", "ST": "Soot", "IBN": "TBN",
    "FUEL": "FuelDilution", "FUEL DILUTION": "FuelDilution",
    "WATER": "WaterPct", "TOTAL WATER": "WaterPct",
}
DETAIL_COLUMNS = ["Fe", "Cu", "Al", "Cr", "Pb", "Si", "Viscosity", "Oxidation", "Soot", "TBN", "FuelDilution", "WaterPct"]
ACCEPTED_UNITS = {
    "Fe": ["", "PPM", "MG/KG"], "Cu": ["", "PPM", "MG/KG"], "Al": ["", "PPM", "MG/KG"],
    "Cr": ["", "PPM", "MG/KG"], "Pb": ["", "PPM", "MG/KG"], "Si": ["", "PPM", "MG/KG"],
    "Viscosity": ["", "CST", "MM2/S", "MM²/S"],
    "WaterPct": ["", "PPM", "MG/KG", "%", "PCT", "PERCENT"],
    "FuelDilution": ["", "%", "PCT", "PERCENT"],
    "Soot": ["", "%", "PCT", "PERCENT"],
}
WATER_PPM_UNITS = ["PPM", "MG/KG"]
ANALYSIS_PREVENTED_PATTERN = (
    r"prevent(?:s|ed)?\s+(?:most\s+)?analysis"
    r"|unable\s+to\s+(?:complete|perform|analyse|analyze)"
    r"|analysis\s+(?:was\s+)?not\s+(?:completed|performed)"
)

# Work-order wording.
CORRECTIVE_TYPE_PATTERN = "CORRECT|BREAKDOWN|UNSCHEDULED"
FAILURE_TEXT_PATTERN = "fail|broken|damage|wear|replace|overhaul|leak|bearing|gear"

# Telemetry fields checked for being constant, and anomaly features.
STALE_CANDIDATES = ["EngineStatus_Running", "CumulativeIdleHours_Hour", "FuelUsed_FuelConsumed"]
ANOMALY_FEATURES = ["gap_hours", "operating_hours_delta", "odometer_delta",
                    "distance_per_operating_hour", "utilization_rate"]

# Text signals.
TEXT_SIGNALS = {
    "lab_text_wear_signal": r"\bwear\b|\biron\b|\bcopper\b|\bchromium\b|\blead\b|\bmetal",
    "lab_text_contamination_signal": r"\bcontamina|\bdirt\b|\bsilicon\b|\bingress\b|\bdebris\b",
    "lab_text_coolant_signal": r"\bwater\b|\bcoolant\b|\bglycol\b|\bantifreeze\b",
    "lab_text_fuel_signal": r"\bfuel\b|\bdilution\b",
    "lab_text_degradation_signal": r"\bviscosity\b|\boxidation\b|\bacidity\b|\btbn\b|\bsoot\b",
    "lab_text_urgent_signal": r"\bimmediate|\burgent|\bcritical|\bshutdown|\binspect now|\baction required",
    "lab_text_resample_signal": r"\bresample|\bsample again|\bhistory needed|\bmore sample history",
}

# Problem categories.
CATEGORIES = [
    ("Wear Metal – Iron", r"\biron\b|\bFe\b|\bbearing wear\b|\bgear wear\b"),
    ("Wear Metal – Copper", r"\bcopper\b|\bCu\b|\bbronze\b"),
    ("Wear Metal – Aluminium", r"\balumini?um\b|\bAl\b"),
    ("Wear Metal – Lead", r"\blead\b|\bPb\b|\bbabbitt\b"),
    ("Silicon / Dirt Ingress", r"\bsilicon\b|\bSi\b|\bdirt\b|\bingress\b|\bcontamina"),
    ("Water / Coolant", r"\bwater\b|\bcoolant\b|\bglyco\b|\bantifreeze\b"),
    ("Fuel Dilution", r"\bfuel\b|\bdilution\b"),
    ("Fluid Degradation", r"\bviscosity\b|\boxidation\b|\bacidity\b|\bTBN\b|\bsoot\b|\bnigr"),
    ("Resample / History", r"\bresample\b|\bsample in\b|\bmore.*history\b|\bhistory needed\b"),
    ("Normal / Acceptable", r"\bnormal\b|\bacceptable\b|\bsatisfactory\b|\bno action\b"),
]
# Lower-case text of which a match of the category holds at least one part.
CATEGORY_PARTS = {
    "Wear Metal – Iron": ["iron", "fe", "bearing wear", "gear wear"],
    "Wear Metal – Copper": ["copper", "cu", "bronze"],
    "Wear Metal – Aluminium": ["al"],
    "Wear Metal – Lead": ["lead", "pb", "babbitt"],
    "Silicon / Dirt Ingress": ["si", "dirt", "ingress", "contamina"],
    "Water / Coolant": ["water", "coolant", "glyco", "antifreeze"],
    "Fuel Dilution": ["fuel", "dilution"],
    "Fluid Degradation": ["viscosity", "oxidation", "acidity", "tbn", "soot", "nigr"],
    "Resample / History": ["sample", "history"],
    "Normal / Acceptable": ["normal", "acceptable", "satisfactory", "no action"],
}
CATEGORY_OTHER = "Other"

# Severity codes and the default rule table.
SEVERITY_CODES = {"AR": 0.40, "A": 0.20, "NAR": 0.10, "WATCH": 0.55, "NORMAL": 0.10}
UNKNOWN_SEVERITY = 0.25
RULES = [
    {
        "id": "elevated_iron", "score": 0.85,
        "patterns": ["iron.*(highly elevated|elevated|high)"],
        "evidence": "Iron wear indicator is elevated",
        "recommendation": "Have a reliability engineer review the laboratory comment, then inspect magnetic plugs, "
                          "screens and filters for wear debris using the OEM procedure.",
    },
    {
        "id": "dirt_entry", "score": 0.82,
        "patterns": ["dirt entry", "silicon.*alumin"],
        "evidence": "Silicon/aluminium pattern suggests possible dirt entry",
        "recommendation": "Verify the contamination finding and inspect seals, plugs, breathers and other ingress "
                          "paths using the component maintenance procedure.",
    },
    {
        "id": "coolant_or_water", "score": 0.95,
        "patterns": ["coolant.*(entry|leak|contamin)", "glycol", "water.*(high|elevated|contamin)",
                     "excessive water", "water (present|entry)"],
        "evidence": "Possible coolant or water contamination",
        "recommendation": "Confirm the result with the laboratory and inspect the cooling and lubrication systems; "
                          "a qualified engineer should decide whether operating restrictions are required.",
    },
    {
        "id": "fuel_dilution", "score": 0.88,
        "patterns": ["fuel dilution", "fuel.*(high|elevated)"],
        "evidence": "Possible fuel dilution",
        "recommendation": "Confirm the reported dilution, inspect the fuel system and combustion condition, and "
                          "follow the OEM fluid-change criteria.",
    },
    {
        "id": "resample_requested", "score": 0.60,
        "patterns": ["sample in [0-9]+ hours", "resample"],
        "evidence": "Laboratory requested shortened-interval resampling",
        "recommendation": "Schedule the confirmation sample at the laboratory-specified operating-hour interval.",
    },
]
AR_EVIDENCE = "Laboratory interpretation code is AR (Laboratory Action Required)"
AR_RECOMMENDATION = "Confirm sample parameters and review unit history with data owner."
NO_EVIDENCE = "No configured fault signature found in interpretation text"
NO_RECOMMENDATION = "Review original laboratory interpretation and continue scheduled monitoring."
ACTION_PREFIX = "Suggested engineering review: "
HISTORY_PATTERN = "more sample history needed"

# Laboratory status names.
LAB_ACTION_REQUIRED = "Laboratory Action Required"
LAB_STATUS_BY_CODE = {
    "AR": LAB_ACTION_REQUIRED,
    "A": "Normal", "NAR": "Normal", "NORMAL": "Normal",
    "B": "Warning", "YELLOW": "Warning", "WATCH": "Warning",
    "C": "Severe", "RED": "Severe",
}

# Priority tiers, in rank order, with the case-list wording.
P1_IMMEDIATE = "P1 – Immediate Review"
P1_WO_TRACKING = "P1 – WO Tracking"
P2_REPEATED = "P2 – Multiple Unlinked Alerts"
P3_ACTION = "P3 – Action Required"
IN_PROGRESS = "In Progress"
CLOSED = "Closed"
TIERS = [P1_IMMEDIATE, P1_WO_TRACKING, P2_REPEATED, P3_ACTION, IN_PROGRESS, CLOSED]
TIER_LABELS = {
    P1_IMMEDIATE: "P1 — Inspect now",
    P1_WO_TRACKING: "P1 — Verify work order",
    P2_REPEATED: "P2 — Repeated unresolved finding",
    P3_ACTION: "P3 — Engineering review",
    IN_PROGRESS: "In progress",
    CLOSED: "Closed laboratory record",
}
TIER_DUE = {
    P1_IMMEDIATE: "Today", P1_WO_TRACKING: "Today",
    P2_REPEATED: "Within 3 days", P3_ACTION: "Within 3 days",
    IN_PROGRESS: "Track",
}

# Operating modes.
MODE_ALERT = "Alert Management"
MODE_CONDITION = "Condition Monitoring"
MODE_PREDICTION = "Failure Prediction"
PREDICTION_GATES = ["lab_predictors", "explicit_wo_outcomes", "labelled_training_rows", "chronological_dates"]

# Model columns.
TARGET = "corrective_wo_within_horizon"
NOT_PREDICTORS = [TARGET, "source_row", "sample_number", "asset_id", "sample_date", "horizon_days"]
TELEMETRY_PREDICTORS = ["telemetry_available", "operating_hours_7d", "operating_hours_30d", "operating_hours_90d",
                        "distance_30d", "mean_utilization_30d", "telemetry_age_days"]
