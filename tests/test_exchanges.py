"""What the queries exchange, write and repeat: forms that keep the traffic in proportion to the rows."""

import re

from pyspark.sql import functions as F

from tribolens.catalog.entries import given_probabilities, orders, samples, telemetry
from tribolens.functions import fixed_values as fv
from tribolens.operators import cases, enrich, point_in_time as pit, triage
from tribolens.plans import scans
from tribolens.plans.storage import materialise
from tribolens.sources.tables import load_table, write_table

SMALL = "/root/testdata/sf0.001"


def test_long_results_are_exchanged_once(spark):
    """Two rankings and the pivot share one unsorted exchange; results without a sample are divided by result id."""
    keys = ["S1", "S1", "S1", "S2", None, None, None]
    raw = spark.createDataFrame(
        [(i, k, n, v, r) for i, (k, n, v, r) in enumerate(zip(
            keys, ["Fe", "Fe", "WATER", "V100", "Fe", "Fe", "Cu"], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0], "112311 "))],
        "id long, SampleNum string, resultName string, resultFormattedEntry double, resultNumber string")
    wide = enrich.wide_details(enrich.clean_details(raw, ["id"]))
    latest = enrich.latest_snapshots(enrich.read_details(raw, ["id"]))
    for df in (wide, latest):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan
    assert {r.sample_key: (r.Fe, r.WaterPct, r.Viscosity) for r in wide.collect()} == {"S1": (2.0, 3.0, None), "S2": (None, None, 4.0)}
    assert sorted(r.row_key.id for r in latest.collect()) == [1, 2, 3, 5, 6]


def test_category_patterns_run_once_and_lose_nothing(spark):
    """Each pattern stands once in the plan, and the cheap test ahead of it lets every match through, whatever its case."""
    texts = ["IRON high.  fE seen", "bronze", "Aluminum and ALUMINIUM", "Pb. Babbitt", "SI; contaminated", "glyco! antifreeze",
             "dilution", "nigrosine, tBn", "RESAMPLE. sample IN. more of the History", "No action", "Fer silver alert", "", None]
    alerts = spark.createDataFrame([(str(i), "A", "ENG", t) for i, t in enumerate(texts)],
                                   "sample_number string, asset_id string, component string, original_interpretation string")
    found = triage.interpretation_categories(alerts)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE(") == len(fv.CATEGORIES)
    sentences = [[s.strip() for s in re.split(r"(?<=[.!?])\s+", t or "") if s.strip()] for t in texts]
    want = set()
    for i, parts in enumerate(sentences):
        for name, pattern in fv.CATEGORIES:
            shown = next((s for s in parts if re.search(pattern, s, re.I | re.A)), None)
            want |= {(str(i), name, shown)} if shown else set()
    got = {(r.sample_number, r.problem_category, r.category_evidence) for r in found.collect()}
    assert {g for g in got if g[1] != fv.CATEGORY_OTHER} == want and {w[1] for w in want} == {name for name, _ in fv.CATEGORIES}


def test_text_sink_is_packed_and_read_back(spark, tmp_path):
    """A CSV sink repeats long texts in full, so its files are compressed; a scan gives the same cells."""
    rows = spark.range(5000).select("id", F.lit('a long text, "quoted", ' * 20).alias("text")).coalesce(2)
    write_table(rows, f"{tmp_path}/out.csv", "csv")
    assert sum(p.stat().st_size for p in (tmp_path / "out.csv").glob("part-*")) < 500_000
    back = load_table(spark, f"{tmp_path}/out.csv")
    assert back.columns == ["id", "text"] and back.distinct().count() == 5000 and back.select("text").distinct().count() == 1


def test_only_new_action_required_rows_are_exchanged_for_repeat_counts(spark):
    rows = materialise(samples(spark, SMALL)).select("source_row", "asset_id", "component", "interpretation_code", "status", "wo_id")
    counted = triage.repeat_counts(rows, {"_repeats": triage.loaded_new_ar(), "_unlinked": triage.unlinked_new_ar()},
                                   written=True)
    assert "Union" in counted._jdf.queryExecution().optimizedPlan().toString()
    plain = scans.join_on(rows, rows.groupBy("asset_id", "component").agg(
        F.count_if(triage.loaded_new_ar()).alias("_repeats"), F.count_if(triage.unlinked_new_ar()).alias("_unlinked")),
        ["asset_id", "component"])
    asked = (F.coalesce("interpretation_code", F.lit("")) == "AR") & (F.upper(F.coalesce("status", F.lit("New"))) == "NEW")
    assert 0 < rows.filter(asked).count() < counted.count() == rows.count()
    assert counted.filter("_repeats IS NULL").count() == rows.filter(~asked).count()
    shown = ["source_row", "_repeats", "_unlinked"]
    assert sorted(counted.filter(asked).select(*shown).collect()) == sorted(plain.filter(asked).select(*shown).collect())


def test_cases_of_alerts_are_those_of_all_cards(spark):
    """Cases made from alerts, with cards for the findings alone, equal the cases of a card per sample."""
    rows, tel, work = (materialise(f(spark, SMALL)) for f in (samples, telemetry, orders))
    tiers = materialise(triage.triage(rows, written=True))
    given = given_probabilities(rows).withColumn("probability", F.when(F.col("probability") < 0.6, F.col("probability")))
    made = materialise(cases.action_cards(tiers, pit.availability(rows, tel, work), given))
    want = cases.case_table(made, tiers, rows, tel, work)
    got = cases.case_table_of_alerts(tiers, rows, tel, work, given)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_forest_keeps_the_node_of_each_row(spark):
    from pyspark.ml.linalg import Vectors

    from tribolens.functions import fixed_values as fv
    from tribolens.operators import model

    rows = spark.createDataFrame(
        [(Vectors.dense(float(i % 7), float(i % 11)), int(i % 7 > 3), 1.0) for i in range(300)], ["features", fv.TARGET, "weight"])
    forest = model.candidates(300.0)["random_forest"].setNumTrees(3)
    assert forest.getCacheNodeIds()
    kept, walked = (forest.copy().setCacheNodeIds(keep).fit(rows).toDebugString.split("\n", 1)[1] for keep in (True, False))
    assert kept == walked


def test_fit_and_scoring_share_written_features(spark):
    from tribolens.catalog import entries

    sf = "/root/testdata/sf0.001"
    rows, tel, work, features = entries._written(spark, sf)
    assert entries._written(spark, sf)[3] is features
    shared, own = (entries.pit.build_scoring(rows, tel, work, f) for f in (features, None))
    assert shared.columns == own.columns
    assert sorted(map(str, shared.collect())) == sorted(map(str, own.collect()))


def test_a_summary_makes_no_card(spark):
    """Scoring rows and cards are written when asked for; a summary without a model needs neither."""
    from tribolens.catalog import views
    from tribolens.plans import analysis

    result = analysis.analyze(views.raw_samples(spark, SMALL), None, None, 3, sample_key="SampleNum")
    row = analysis.run_summary(result).first()
    assert row["prediction_rows"] == 0 and row["sample_rows"] == result.alerts.count()
    assert not {"cards", "scoring"} & set(vars(result))
    assert result.cards.count() == row["sample_rows"]


def test_case_history_joins_the_raw_tables_once(spark):
    from tribolens.catalog.entries import QUERIES

    assert "l_orderkey" not in QUERIES["case_history"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_condition_index_joins_the_raw_tables_once(spark):
    from tribolens.catalog.entries import QUERIES

    assert "l_orderkey" not in QUERIES["condition_index"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_long_results_are_placed_ahead_of_being_made(spark):
    """The rows that results are made from are exchanged by sample, not the results; both ways give the same results."""
    from tribolens.catalog import views
    from tribolens.catalog.entries import QUERIES

    for name in ("details_wide", "details_one_per_measurement"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate explode") < plan.index("Exchange hashpartitioning"), plan
    placed, plain = (enrich.clean_details(views.raw_details(spark, SMALL, place), ["detail_key"]) for place in (True, False))
    assert placed.columns == plain.columns and sorted(map(str, placed.collect())) == sorted(map(str, plain.collect()))


def test_unit_check_exchanges_no_made_result_that_has_a_sample(spark):
    """Results without a sample are made apart and exchanged; the query still gives every result."""
    from tribolens.catalog.entries import QUERIES, details

    found = QUERIES["details_unit_check"](spark, SMALL)
    plan = found._jdf.queryExecution().executedPlan().toString()
    placed = plan[:plan.rindex("Generate explode")]
    assert "Union" in plan and "Exchange hashpartitioning(_placed_sample" in plan and placed.count("Exchange hashpartitioning") == 2, plan
    assert found.count() == enrich.latest_snapshots(details(spark, SMALL)).count()


def test_trimming_skips_only_texts_that_need_none(spark):
    from tribolens.functions import cleaning as c

    texts = ["", " ", "a", " a", "a ", " x ", "~", "!", "\x7f", "é", " é ", "a b", "\ta\n", "x　", "　x", "ab\x1f", "0", "\x85q", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        c.strip(F.col("t")).alias("got"), F.trim("t", F.lit(fv.WHITE_SPACE)).alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_cases_of_rows_are_those_of_all_cards(spark):
    """One aggregation over samples gives the cases of a card per sample, also for odd statuses, codes, dates and missing keys."""
    from tribolens.catalog.entries import given_probability, readings

    rows, tel, work = (materialise(f(spark, SMALL)) for f in (samples, readings, orders))
    last = F.ascii(F.right("source_row", F.lit(1))) + F.length("source_row") * 3 + F.pmod(F.xxhash64("source_row"), F.lit(50))
    rows = materialise(rows.withColumns({
        "status": F.when(last % 11 == 0, " nEw ").when(last % 13 == 0, "closed").when(last % 17 == 0, None).otherwise(F.col("status")),
        "high_priority": F.when(last % 7 == 0, " t ").otherwise(F.col("high_priority")),
        "wo_id": F.when(last % 5 == 0, "None").otherwise(F.col("wo_id")),
        "interpretation_code": F.when(last % 19 == 0, "monitor").when(last % 23 == 0, "ar").otherwise(F.col("interpretation_code")),
        "asset_id": F.when(last % 29 == 0, None).otherwise(F.col("asset_id")),
        "sample_date": F.when(last % 9 == 0, F.lit("1994-01-01").cast("timestamp_ntz")).otherwise(F.col("sample_date")),
        "probability": F.when(given_probability() < 0.6, given_probability()),
    }))
    tiers = materialise(triage.triage(rows, written=True))
    given = rows.select("source_row", "probability")
    all_tel = materialise(telemetry(spark, SMALL))
    made = materialise(cases.action_cards(tiers, pit.availability(rows, all_tel, work), given))
    want = cases.case_table(made, tiers, rows, all_tel, work)
    got = cases.case_table_of_rows(materialise(cases.case_rows(rows)), tel, work)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    tier = {r.source_row: r[1] for r in rows.select("source_row", triage.first_tier()).collect()}
    twins = {fv.P2_REPEATED, fv.P3_ACTION}
    for r in tiers.select("source_row", "priority_tier").collect():
        assert tier[r.source_row] == (fv.P2_REPEATED if r.priority_tier in twins else r.priority_tier)


def test_case_queries_make_no_alert_per_sample(spark):
    """Rules run over written cases, and the tables are joined once, before the rows are written."""
    from tribolens.catalog.entries import QUERIES

    for name in ("case_table", "fleet_summary", "top_active_cases", "active_cases_by_priority"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan and "RLIKE((?id)" not in plan and "event_type" not in plan, plan
    severities = spark.createDataFrame([(x,) for x in [*fv.LAB_STATUS_BY_CODE, "", "X", "MONITOR", "CRITICAL"]], "interpretation_code string")
    for r in cases.with_severity(severities).withColumn("want", cases.status_severity(triage.lab_status())).collect():
        assert r["_severity"] == r.want
