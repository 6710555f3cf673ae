"""Machine-data views over the given tables.

The tables hold no machine data, so samples, long results, telemetry and work orders are derived from them row
by row, with missing values, odd spellings, duplicates and bad cells mixed in. The text of each view is plain SQL
that both engines read, so the reference results start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tribolens.operators.enrich import PLACED, place_by_sample
from tribolens.sources.tables import load_table, spread

RAW_SAMPLES = """
SELECT concat_ws('-', cast(l_orderkey AS string), cast(l_linenumber AS string), cast(l_partkey AS string),
                 cast(l_suppkey AS string), cast(cast(l_shipdate AS date) AS string)) AS SampleNum,
       CASE WHEN l_partkey % 97 = 0 THEN ' nan ' ELSE concat(' EQ-', cast(l_suppkey AS string)) END AS equip_num,
       CASE WHEN l_partkey % 194 = 0 THEN NULL ELSE concat('SN-', cast(l_suppkey AS string)) END AS SerialNum,
       concat('M', cast(l_suppkey % 5 AS string)) AS EqpModel,
       CASE WHEN l_partkey % 101 = 0 THEN NULL
            WHEN l_returnflag = 'A' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'Engine' ELSE ' ENG ' END
            WHEN l_returnflag = 'N' THEN ' hydraulics ' ELSE 'diff. rr' END AS Compartment,
       CASE WHEN l_linenumber = 7 THEN '00:00:00' WHEN l_partkey % 211 = 0 THEN 'not recorded'
            WHEN l_partkey % 223 = 0 THEN NULL WHEN l_partkey % 227 = 0 THEN '1899-12-30'
            ELSE cast(cast(l_shipdate AS date) AS string) END AS DateSampled,
       CASE WHEN l_discount < 0.025 THEN 'NAR' WHEN l_discount < 0.045 THEN 'A' WHEN l_discount < 0.055 THEN ' b '
            WHEN l_discount < 0.065 THEN NULL WHEN l_discount < 0.075 THEN 'C' ELSE 'ar' END AS OverallInterp,
       CASE l_linenumber
            WHEN 1 THEN 'Iron highly elevated; gear wear suspected. Inspect bearing and resample within 10 days.'
            WHEN 2 THEN 'Dirt entry suspected. Silicon and aluminium high.'
            WHEN 3 THEN 'Coolant leak likely; water present! Sample in 50 hours.'
            WHEN 4 THEN 'Fuel dilution detected. More sample history needed.'
            WHEN 5 THEN 'No action required. All readings normal.'
            WHEN 6 THEN CASE WHEN l_partkey % 2 = 0 THEN '' ELSE NULL END
            ELSE 'Viscosity and oxidation degraded. Copper wear; TBN low.' END AS InterpText,
       CASE WHEN l_partkey % 53 = 0 THEN 'n/a' ELSE cast(l_quantity * 100 AS string) END AS CMeter,
       CASE WHEN l_partkey % 19 = 0 THEN NULL WHEN l_partkey % 29 = 0 THEN cast('NaN' AS double)
            ELSE l_quantity * 10 END AS c_meter_fluid,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'T' WHEN '2-HIGH' THEN 'f' ELSE NULL END AS HighPriority,
       CASE WHEN l_partkey % 43 = 0 THEN NULL WHEN l_linestatus = 'O' THEN 'new' ELSE 'CLOSED' END AS SampleStatusNew,
       CASE o_orderstatus WHEN 'P' THEN concat('WO-', cast(o_orderkey AS string)) WHEN 'F' THEN ' ' ELSE NULL END
            AS WorkOrderId,
       CASE o_orderstatus WHEN 'P' THEN 'Open' ELSE NULL END AS WOStatus,
       concat('Site ', cast(l_suppkey % 7 AS string)) AS SiteName,
       CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_quantity * 4 END AS Fe,
       CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE floor(l_extendedprice / 20) / 100 END AS Copper,
       CASE WHEN l_linenumber = 6 THEN NULL ELSE l_quantity / 2 END AS Al,
       CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_tax * 100 END AS Cr,
       CASE WHEN l_linenumber = 6 THEN NULL ELSE l_discount * 400 END AS Si,
       CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_linenumber = 6 THEN NULL ELSE l_tax END AS WaterPct,
       CASE WHEN l_partkey % 2 = 0 THEN NULL ELSE l_discount * 30 END AS FuelPct,
       CASE WHEN l_partkey % 2 = 1 THEN NULL ELSE l_tax * 10 END AS Soot,
       CASE WHEN l_partkey % 6 = 0 THEN NULL WHEN l_linenumber = 6 THEN NULL ELSE l_quantity / 4 + 8 END AS Viscosity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

RAW_DETAILS = """
SELECT concat_ws('-', SampleNum, pos, cast(snapshot AS string)) AS detail_key, SampleNum, pos AS result_pos,
       CASE pos WHEN '1' THEN 'Fe' WHEN '2' THEN ' Water ' WHEN '3' THEN 'TOTAL WATER' WHEN '4' THEN 'V100'
                WHEN '5' THEN 'IBN' WHEN '6' THEN 'PQ' ELSE 'pb' END AS resultName,
       CASE pos WHEN '1' THEN q * 4 + 1 + snapshot WHEN '2' THEN t * 10000 + snapshot WHEN '3' THEN t * 20000
                WHEN '4' THEN CASE WHEN ln = 3 THEN 0.0 ELSE q / 4 + 9 END WHEN '5' THEN pr / 10000
                WHEN '6' THEN q ELSE q / 3 END AS resultFormattedEntry,
       CASE pos WHEN '1' THEN CASE WHEN pk % 31 = 0 THEN '%' ELSE 'ppm' END WHEN '2' THEN 'PPM' WHEN '3' THEN 'mg/kg'
                WHEN '4' THEN 'cSt' WHEN '6' THEN 'index' ELSE '' END AS resultUnits,
       CASE WHEN pos = '7' AND pk % 11 = 0 THEN NULL WHEN pos = '6' AND pk % 11 = 0 THEN NULL
            ELSE concat('R', pos) END AS resultNumber,
       CASE WHEN pk % 37 = 0 AND snapshot = 0 THEN NULL
            WHEN pos = '3' AND pk % 2 = 0 THEN sd + INTERVAL '9' DAY
            ELSE sd + INTERVAL '1' DAY END AS ModifiedOn,
       CASE WHEN ln = 3 THEN 'Excess water prevents most analysis.' ELSE NULL END AS interpText
FROM (SELECT SampleNum, q, t, pr, pk, ln, sd, substr(code, 1, 1) AS pos, cast(substr(code, 2, 1) AS int) AS snapshot
      FROM (SELECT concat_ws('-', cast(l_orderkey AS string), cast(l_linenumber AS string),
                             cast(l_partkey AS string), cast(l_suppkey AS string),
                             cast(cast(l_shipdate AS date) AS string)) AS SampleNum,
                   l_quantity AS q, l_tax AS t, l_extendedprice AS pr, l_partkey AS pk, l_linenumber AS ln,
                   l_shipdate AS sd, unnest(array_of_codes) AS code
            FROM lineitem) coded) results
WHERE snapshot = 0 OR pk % 4 = 0
"""

# Two digits: result position and snapshot number.
DETAIL_CODES = "'10', '20', '30', '40', '50', '60', '70', '11', '21'"
RAW_DETAILS_DUCKDB = RAW_DETAILS.replace("array_of_codes", f"[{DETAIL_CODES}]")

# Spark makes the results in two steps, one row per sample and then its results, so that rows can be placed in between.
_coded = RAW_DETAILS[RAW_DETAILS.index("SELECT concat_ws('-', cast"):RAW_DETAILS.index(") coded")]
RAW_RESULT_LINES = _coded.replace(", unnest(array_of_codes) AS code", "")
RAW_DETAILS_SPARK = RAW_DETAILS.replace(_coded, f"SELECT *, explode(array({DETAIL_CODES})) AS code FROM {{lines}}")

RAW_TELEMETRY = """
SELECT event_id AS reading_id,
       CASE WHEN event_id % 61 = 0 THEN NULL ELSE concat('EQ-', cast(user_id AS string)) END AS TMSAssetID,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('M', cast(event_id % 5 AS string)) END AS EquipmentHeader_Model,
       CASE WHEN event_id % 71 = 0 THEN NULL ELSE date_trunc('hour', ts) END AS event_date_time,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE ts END AS SynapseModifiedDateTime,
       CASE WHEN event_id % 23 = 0 THEN NULL ELSE value / 7 END AS CumulativeOperatingHours_Hour,
       cast(regexp_extract(props, '([0-9]+)', 1) AS double) / 3 AS Distance_Odometer,
       cast(5.0 AS double) AS CumulativeIdleHours_Hour,
       value * 2 AS FuelUsed_FuelConsumed
FROM events WHERE event_type NOT IN ('error', 'signup')
"""

RAW_PIT_SAMPLES = """
SELECT concat('P-', cast(event_id AS string)) AS SampleNum, concat('EQ-', cast(user_id AS string)) AS EquipNum,
       concat('M', cast(user_id % 4 AS string)) AS EqpModel,
       CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'Engine' ELSE 'HYD' END AS Compartment,
       CASE WHEN event_id % 41 = 0 THEN NULL ELSE ts END AS DateSampled,
       CASE WHEN event_id % 4 = 0 THEN 'AR' WHEN event_id % 4 = 1 THEN 'NAR' ELSE 'A' END AS OverallInterp,
       CASE WHEN event_id % 4 = 0 THEN 'Elevated iron wear. Resample in 50 hours.' ELSE 'Normal condition.' END
            AS InterpText,
       value AS OilHours, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value * 3 END AS Fe, value / 2 AS Cu
FROM events WHERE event_type = 'signup'
"""

RAW_WORK_ORDERS = """
SELECT concat('W-', cast(event_id AS string)) AS WorkOrderId, concat('EQ-', cast(user_id AS string)) AS EquipmentId,
       CASE event_id % 4 WHEN 0 THEN 'Engine' WHEN 1 THEN 'HYD' WHEN 2 THEN NULL ELSE 'tr' END AS Component,
       CASE WHEN event_id % 67 = 0 THEN NULL ELSE ts END AS OpenedDate,
       CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL '2' DAY ELSE NULL END AS ClosedDate,
       CASE WHEN user_id % 3 = 0 THEN ts + INTERVAL '5' DAY ELSE NULL END AS ObservationEndDate,
       CASE event_id % 3 WHEN 0 THEN 'Corrective' WHEN 1 THEN 'preventive' ELSE ' Unscheduled repair ' END
            AS WorkOrderType,
       CASE event_id % 5 WHEN 0 THEN 'Bearing failure' WHEN 1 THEN 'Routine check' WHEN 2 THEN NULL
            ELSE 'Hose LEAK' END AS Description,
       CASE event_id % 7 WHEN 0 THEN 'part replaced' ELSE NULL END AS ActionTaken,
       CASE event_id % 6 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN 'Yes' WHEN 3 THEN ' n ' WHEN 4 THEN NULL
            ELSE 'maybe' END AS FailureConfirmed
FROM events WHERE event_type = 'error'
"""


def _run(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    named = {name: load_table(spark, f"{sf_dir}/{name}.parquet") for name in tables}
    named[tables[0]] = spread(named[tables[0]])
    for name in tables:
        text = text.replace(f"FROM {name}", "FROM {" + name + "}").replace(f"JOIN {name}", "JOIN {" + name + "}")
    return spark.sql(text, **named)


def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, RAW_SAMPLES, "lineitem", "orders")


def raw_details(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """Long results; `placed` ones lie together by sample and carry its key, and those without a sample are left out."""
    lines = _run(spark, sf_dir, RAW_RESULT_LINES, "lineitem")
    if not placed:
        return spark.sql(RAW_DETAILS_SPARK, lines=lines)
    text = RAW_DETAILS_SPARK.replace("SELECT concat_ws", f"SELECT {PLACED}, concat_ws", 1).replace("(SELECT SampleNum", f"(SELECT {PLACED}, SampleNum")
    return spark.sql(text, lines=place_by_sample(lines))


def raw_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, RAW_TELEMETRY, "events")


def raw_pit_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, RAW_PIT_SAMPLES, "events")


def raw_work_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, RAW_WORK_ORDERS, "events")
