"""Cleaning, sources and sinks, rules, baseline, anomaly and metrics on small inputs."""

import json
import math

import numpy as np
import pytest
from helpers import by, frame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tribolens.functions import cleaning as c
from tribolens.operators import anomaly, baseline, evaluation as ev, point_in_time, telemetry as tele, triage
from tribolens.operators.work_orders import prepare_work_orders
from tribolens.plans.analysis import run
from tribolens.sources.headers import AmbiguousHeader
from tribolens.sources.tables import load_table, write_table


def column(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_identifiers(spark):
    assert column(spark, ["  A1\t", "nan", " ", "None", "<NA>", "NaN", None], c.identifier) == [
        "A1", None, None, None, None, "NaN", None]


def test_components(spark):
    assert column(spark, ["Engine", " hydraulics ", "diff. rr", "TR", "__x__", None], c.component_code) == [
        "ENG", "HYD", "DIFF_RR", "TRANS", "X", None]


def test_numbers(spark):
    assert column(spark, ["1.5", "x", "NaN", "", None, "1e3"], c.number) == [1.5, None, None, None, None, 1000.0]
    assert column(spark, ["1.5", "Infinity", None], lambda v: c.finite_or(v, 0.0)) == [1.5, 0.0, 0.0]


def test_flags(spark):
    assert column(spark, ["Yes", " t ", "0", "", None, "other"], c.flag) == [True, True, False, False, False, True]
    assert column(spark, ["nEW order", None], lambda v: c.capitalised(v, "New")) == ["New order", "New"]
    assert column(spark, ["x", " ", "nan", None], c.has_value) == [True, False, False, False]


def test_dates(spark):
    def read(v):
        return c.trimmed_timestamp(v, T.StringType()).cast("string")

    assert column(spark, ["2025-01-02", "2025-01-02 03:04:05", "1/2/2025", "1/2/2025 3:04", "00:00:00", "2025", "x"], read) == [
        "2025-01-02 00:00:00", "2025-01-02 03:04:05", "2025-01-02 00:00:00", "2025-01-02 03:04:00", None, None, None]
    texts = ["", None, "10:30", "soon", "1899-12-30", "2025-01-01"]
    issues = column(spark, texts, lambda v: c.date_issue(c.strip(v), F.when(
        ~c.is_time_only(c.strip(v)), c.trimmed_timestamp(v, T.StringType()))))
    assert [i and i.split()[0] for i in issues] == ["Missing", "Missing", "Time-only", "Unparseable", "Calendar", None]


def test_elapsed_days_round_down(spark):
    row = spark.sql("SELECT timestamp_ntz'2025-01-01 23:00:00' AS a, timestamp_ntz'2025-01-02 01:00:00' AS b").select(
        c.elapsed_days(F.col("b"), F.col("a")).alias("x"), c.elapsed_days(F.col("a"), F.col("b")).alias("y"),
        c.micros(F.col("a")).alias("m")).first()
    assert (row.x, row.y, row.m) == (0, -1, 1735772400000000)


def test_dot_stops_only_at_line_feeds(spark):
    assert column(spark, ["iron\rhigh", "iron\nhigh", "IRON is High"], lambda v: c.matches(v, "iron.*high")) == [
        True, False, True]


def test_component_label(spark):
    assert column(spark, ["ENG", "fd_lr", "SWING_DRIVE", " ", None], c.component_label) == [
        "Engine", "Left-rear final drive", "Swing Drive", "Unknown", "Unknown"]


def test_tables(spark, tmp_path):
    with pytest.raises(ValueError):
        load_table(spark, str(tmp_path / "x.xlsx"))
    (tmp_path / "twins.csv").write_text("Fe,fe\n1,2\n")
    with pytest.raises(AmbiguousHeader):
        load_table(spark, str(tmp_path / "twins.csv"))
    df = spark.range(5).withColumn("tags", F.array(F.lit("a"), F.lit("b")))
    write_table(df, str(tmp_path / "t.csv"), "csv")
    assert load_table(spark, str(tmp_path / "t.csv")).first().tags == '["a","b"]'
    write_table(df.repartition(3), str(tmp_path / "t.parquet"))
    keyed = load_table(spark, str(tmp_path / "t.parquet"), row_key=True)
    assert keyed.select("source_row").distinct().count() == 5


def test_rule_file(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"severity_codes": {"x": 0.9}, "rules": [
        {"id": "r", "score": 0.3, "patterns": ["a+b"], "evidence": "E", "recommendation": "Suggested engineering review: R"}]}))
    rows = spark.createDataFrame([(1, "AAB", "X", 1.0), (2, "none", "Y", None)],
                                 "source_row int, interpretation_text string, interpretation_code string, fluid_hours double")
    got = by(triage.with_rule_results(rows, triage.load_rules(path)), "source_row")
    assert got[1].rule_evidence_strength == 0.9 and got[1].triggered_rules == "r" and got[1].evidence == "E"
    assert got[1].recommended_action == "Suggested engineering review: R"
    assert got[2].rule_evidence_strength == 0.25 and got[2].confidence == "Low"


def test_work_order_outcomes(spark):
    rows = by(prepare_work_orders(frame(
        spark, WO_ID=["1", "2", "3", "4"], EquipNum="E", WorkOrderDate="2025-01-01",
        Type=["Breakdown", "inspect", "inspect", "inspect"], Description=["", "gearbox", None, "ok"],
        ConfirmedFailure=["yes", None, "0", "maybe"])), "wo_id")
    assert [rows[k].failure_label_source for k in "1234"] == ["explicit", "text_inferred", "explicit", "text_inferred"]
    assert [rows[k].confirmed_failure for k in "1234"] == [True, True, False, False]
    assert [rows[k].is_corrective for k in "1234"] == [True, True, False, False]


def test_beta_quantiles():
    # Beta(1, 1) is uniform; Beta(2, 1) has distribution x^2; Beta(1, 3) has 1 - (1 - x)^3.
    a, b = np.array([1.0, 2.0, 1.0]), np.array([1.0, 1.0, 3.0])
    got = baseline.beta_quantile(a, b, 0.05)
    assert np.allclose(got, [0.05, math.sqrt(0.05), 1 - 0.95 ** (1 / 3)], atol=1e-9)


def test_metrics_against_brute_force(spark):
    rng = np.random.default_rng(4)
    p = np.round(rng.random(400), 2)
    y = (rng.random(400) < p).astype(int)
    scored = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "label int, probability double")
    m = ev.binary_metrics(scored, 0.4).first()
    pairs = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    assert abs(m.roc_auc - np.mean(pairs)) < 1e-9
    ap, before = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        called = p >= t
        recall = y[called].sum() / y.sum()
        ap, before = ap + (recall - before) * y[called].mean(), recall
    assert abs(m.average_precision - ap) < 1e-9
    assert m.true_positive == int(((p >= 0.4) & (y == 1)).sum())
    best = max((2 * ((p >= t) & (y == 1)).sum() / ((p >= t).sum() + y.sum()), ((p >= t) & (y == 1)).sum() / y.sum(),
                -abs(t - 0.5), t) for t in [i * 0.01 + 0.1 for i in range(81)])
    assert abs(ev.choose_threshold(scored).first().threshold - best[-1]) < 1e-12


def test_no_skill_fails_the_gate(spark):
    scored = spark.createDataFrame([(i % 2, 0.5) for i in range(20)], "label int, probability double")
    row = ev.utility_gate(scored, ev.binary_metrics(scored, 0.5), F.lit(0.5)).first()
    assert row.average_precision_lift == 0 and row.brier_skill_score == 0 and not row.passes_utility_gate


def test_anomaly_scores(spark):
    n = 400
    raw = frame(spark, AssetId="E", Timestamp=[f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00" for i in range(n)],
                OperatingHours=[float(i) + (500.0 if i == 200 else 0.0) for i in range(n)],
                Odometer=[float(i * 3) for i in range(n)])
    scored = anomaly.score_telemetry(tele.prepare_telemetry(raw, "source_row")).collect()
    scores = [r.telemetry_anomaly_score for r in scored]
    assert min(scores) == 0 and max(scores) == 1
    assert sum(r.telemetry_anomaly for r in scored) <= 0.06 * n
    top = sorted(scored, key=lambda r: -r.telemetry_anomaly_score)[:4]
    assert any(abs(r.operating_hours_delta or 0) > 400 for r in top)
    few = tele.prepare_telemetry(raw.limit(10), "source_row")
    assert {r.telemetry_anomaly for r in anomaly.score_telemetry(few).collect()} == {False}


def test_batch_job(spark, tmp_path):
    (tmp_path / "samples.csv").write_text(
        "SampleNum,EquipNum,Compartment,OverallInterp,InterpText,DateSampled,HighPriority\n"
        "S1,EQ-1,ENGINE,AR,Iron high,2025-01-01,T\nS2,EQ-1,ENGINE,NAR,ok,00:00:00,\n")
    (tmp_path / "details.csv").write_text("id,SampleNum,resultName,Value,Units\nd1,S1,Fe,12,PPM\n")
    (tmp_path / "telemetry.csv").write_text("id,AssetId,Timestamp,OperatingHours\nt1,EQ-1,2024-12-30,5\nt2,EQ-1,2024-12-31,9\n")
    out = str(tmp_path / "out")
    result = run(spark, f"{tmp_path}/samples.csv", out, telemetry_path=f"{tmp_path}/telemetry.csv",
                 details_path=f"{tmp_path}/details.csv", sample_key="SampleNum", telemetry_key="id", detail_key=["id"])
    assert result.mode == "Alert Management"
    assert by(spark.read.parquet(f"{out}/scoring"), "sample_number")["S1"].iron_ppm == 12
    assert spark.read.parquet(f"{out}/cases").count() == 1
    summary = spark.read.json(f"{out}/summary").first()
    assert summary.sample_rows == 2 and summary.matched_assets == 1 and summary.dataset_metrics.p1_immediate_records == 1


def test_numbers_are_plain_decimals(spark):
    cells = ["12", " 1.5 ", "-.5", "1e3", "+7.", "inf", "12D", "1.5f", "0x1p3", "1d", "NaN", "", "1 2", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(cells)], "i int, x string")
    got = [r[0] for r in rows.orderBy("i").select(c.number(F.col("x"))).collect()]
    assert got == [12.0, 1.5, -0.5, 1000.0, 7.0, float("inf")] + [None] * 8
    assert rows.select(c.number(F.col("i")).alias("n")).agg(F.sum("n")).first()[0] == 91


def test_date_layouts(spark):
    """Month first where day and month could be exchanged."""
    wanted = {
        "1/2/2025 3:04 PM": "2025-01-02 15:04:00", "1/2/2025 3:04:05 PM": "2025-01-02 15:04:05",
        "2025-01-02 03:04 PM": "2025-01-02 15:04:00", "2025/01/02": "2025-01-02 00:00:00", "02-Jan-2025": "2025-01-02 00:00:00",
        "02-JAN-2025 4:05": "2025-01-02 04:05:00", "1/2/25": "2025-01-02 00:00:00", "20250102": "2025-01-02 00:00:00",
        "1/2/2025 03:04:05.123": "2025-01-02 03:04:05.123", "2025/1/2 3:04 am": "2025-01-02 03:04:00",
        "2025-01-02T03:04:05": "2025-01-02 03:04:05", "1/2/2025 13:04": "2025-01-02 13:04:00", "13/1/2025": None, "00:00:00": None,
        "soon": None, "99999999": None,
    }
    rows = spark.createDataFrame(list(wanted.items()), "x string, want string")
    parsed = c.timestamp(F.col("x"), T.StringType()).cast("string")
    assert {r[0]: r[1] for r in rows.select("x", parsed).collect()} == wanted


def test_trees_get_their_share_at_every_size(spark):
    for count in (300, 5_000, 200_000):
        readings = spark.range(count).select(F.col("id").cast("string").alias("reading_key"))
        sizes = [r[1] for r in anomaly._tree_samples(readings, count).groupBy("tree").count().collect()]
        assert len(sizes) == anomaly.TREES and abs(sum(sizes) / len(sizes) - anomaly.SUBSAMPLE) < 12


def test_csv_without_a_key_column(spark, tmp_path):
    spark.createDataFrame([("a", "1"), ("a", "1"), ("b", None)], "x string, y string").coalesce(1).write.option(
        "header", True).csv(str(tmp_path / "t.csv"))
    keyed = load_table(spark, str(tmp_path / "t.csv"), row_key=True)
    rows = keyed.collect()
    assert len({r["source_row"] for r in rows}) == 3 and {r["source_row"] for r in keyed.collect()} == {
        r["source_row"] for r in rows}
    assert sorted((r["x"], r["y"] or "") for r in rows) == [("a", "1"), ("a", "1"), ("b", "")]
