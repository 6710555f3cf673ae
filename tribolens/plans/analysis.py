"""The whole analysis: from raw tables to alerts, features, model, cards, cases and sinks."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tribolens.functions import fixed_values as fv
from tribolens.operators import anomaly, cases, gates, model, point_in_time, report, telemetry as tele, triage
from tribolens.operators.enrich import enrich_samples
from tribolens.operators.samples import prepare_samples
from tribolens.operators.work_orders import prepare_work_orders
from tribolens.plans.storage import materialise
from tribolens.sources.tables import load_table, write_json_row, write_table

log = logging.getLogger(__name__)


@dataclass
class Analysis:
    """Lazy result tables and the few decisions taken while building them.

    The two widest tables, scoring rows and cards, are written when they are first asked for.
    """

    mode: str
    predictive: bool
    samples: DataFrame
    alerts: DataFrame
    categories: DataFrame
    counters: DataFrame
    telemetry: DataFrame | None
    telemetry_quality: DataFrame | None
    work_orders: DataFrame | None
    matched_assets: DataFrame | None
    training: DataFrame | None
    readiness: DataFrame
    write_scoring: Callable[[], DataFrame]
    make_cards: Callable[[DataFrame], DataFrame]
    model: model.TrainedModel | None = None
    leaderboard: DataFrame | None = None
    model_error: str | None = None
    horizon_days: int = 30

    @cached_property
    def scoring(self) -> DataFrame:
        return self.write_scoring()

    @cached_property
    def cards(self) -> DataFrame:
        return materialise(self.make_cards(self.scoring))

    def case_table(self) -> DataFrame:
        return cases.case_table(self.cards, self.alerts, self.samples, self.telemetry, self.work_orders,
                                self.horizon_days)

    def fleet_summary(self) -> DataFrame:
        return cases.fleet_summary(self.case_table(), self.samples, self.work_orders)

    def quality_issues(self) -> DataFrame:
        return gates.quality_issues(self.samples, self.alerts, self.telemetry_quality, self.matched_assets)


def _no_profile(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(
        F.lit(0).cast("long").alias("rows_before_deduplication"), F.lit(0).cast("long").alias("rows_after_deduplication"),
        F.lit(0).cast("long").alias("duplicate_asset_timestamp_rows"), F.lit(0).cast("long").alias("unique_assets"),
        F.lit(None).cast("timestamp_ntz").alias("date_start"), F.lit(None).cast("timestamp_ntz").alias("date_end"),
        F.lit("").alias("stale_or_constant_fields"), F.lit(None).cast("string").alias("schema_issue"))


def analyze(
    samples_raw: DataFrame,
    telemetry_raw: DataFrame | None = None,
    work_orders_raw: DataFrame | None = None,
    horizon_days: int = 30,
    sample_key: str = "source_row",
    telemetry_key: str = "source_row",
    rules: dict | None = None,
) -> Analysis:
    """Build all result tables. Only gate rows and, when the gates pass, model fits are computed here."""
    spark = samples_raw.sparkSession
    samples = materialise(prepare_samples(samples_raw, sample_key))
    telemetry, quality = None, _no_profile(spark)
    if telemetry_raw is not None:
        issue = tele.schema_issue(telemetry_raw.columns)
        quality = tele.quality_profile(
            telemetry_raw, None if issue else tele.read_telemetry(telemetry_raw, telemetry_key), issue)
        if issue is None:
            telemetry = materialise(tele.prepare_telemetry(telemetry_raw, telemetry_key))
    work_orders = None if work_orders_raw is None else materialise(prepare_work_orders(work_orders_raw))
    alerts = materialise(triage.triage(samples, rules, written=True))
    matched = None if telemetry is None else point_in_time.matched_assets(samples, telemetry)

    @cache
    def write_scoring() -> DataFrame:
        return materialise(point_in_time.build_scoring(samples, telemetry, work_orders))

    training = point_in_time.build_training(samples, telemetry, work_orders, horizon_days)
    if training is not None:
        training = materialise(training)
    ready = gates.readiness(gates.coverage(samples, matched, work_orders, training))
    ready = spark.createDataFrame(ready.collect(), ready.schema)
    mode = gates.select_mode(ready).first()["mode"]

    predictive, trained, board, error = mode == fv.MODE_PREDICTION, None, None, None
    probabilities = scores = top = None
    if predictive:
        try:
            trained, board = model.train_failure_model(training)
        except model.NotTrainable as problem:
            error = str(problem)
            ready = gates.with_gate(ready, "chronological_model_fit",
                                    "Chronological model training completes successfully", False, error)
        else:
            passed = bool(trained.metrics["passes_utility_gate"])
            ready = gates.with_gate(
                ready, "heldout_model_utility", "Selected model beats a no-feature baseline on newer data", passed,
                f"Average-precision lift {trained.metrics['average_precision_lift']:.3f}; "
                f"Brier skill {trained.metrics['brier_skill_score']:.3f}")
            if passed:
                probabilities = trained.predict(write_scoring())
                top = list(trained.importances())[:3]
                if telemetry is not None:
                    telemetry = anomaly.score_telemetry(telemetry)
                    scores = tele.latest_anomaly_scores(telemetry)
            else:
                trained = None
                error = "on the test block the model is not better than the event rate alone"
        if error:
            log.warning("prediction is off: %s", error)
            predictive, mode = False, gates.fallback_mode(ready.collect())
    return Analysis(
        mode=mode, predictive=predictive, samples=samples, alerts=alerts,
        categories=triage.interpretation_categories(alerts), counters=gates.dataset_counters(alerts),
        telemetry=telemetry, telemetry_quality=quality, work_orders=work_orders, matched_assets=matched,
        training=training, readiness=ready, write_scoring=write_scoring,
        make_cards=lambda scoring: cases.action_cards(alerts, scoring, probabilities, scores, top), model=trained, leaderboard=board,
        model_error=error, horizon_days=horizon_days)


def mode_summary(result: Analysis) -> DataFrame:
    """Mode, horizon and the criteria that still block prediction."""
    blocked = gates.blocked_criteria(result.readiness).agg(F.collect_list("criterion")).scalar()
    return result.readiness.sparkSession.range(1).select(
        F.lit(result.mode).alias("mode"), F.lit(f"{result.mode} active").alias("title"),
        F.lit(result.horizon_days).alias("horizon_days"),
        F.lit(result.predictive and result.mode == fv.MODE_PREDICTION).alias("prediction_enabled"),
        blocked.alias("blocking_reasons"))


def run_summary(result: Analysis) -> DataFrame:
    """One row for the JSON summary sink."""
    samples = result.samples.agg(F.count("*").alias("sample_rows"), F.count_distinct("asset_id").alias("sample_assets"))
    matched = F.lit(0).cast("long") if result.matched_assets is None else result.matched_assets.agg(F.count("*")).scalar()
    # Without a model no card has a probability, so none is made for the count.
    predicted = F.lit(0).cast("long") if result.model is None else result.cards.agg(F.count("failure_probability_pct")).scalar()
    quality = result.telemetry_quality.select(F.struct("*")).scalar()
    counters = result.counters.select(F.struct("*")).scalar()
    return samples.select(
        F.lit(result.mode).alias("operating_mode"), "*", matched.alias("matched_assets"),
        predicted.alias("prediction_rows"),
        F.lit(result.model.name if result.model else None).cast("string").alias("trained_model"),
        quality.alias("telemetry_quality"), counters.alias("dataset_metrics"))


def run(
    spark: SparkSession,
    samples_path: str,
    output: str,
    telemetry_path: str | None = None,
    work_orders_path: str | None = None,
    details_path: str | None = None,
    horizon_days: int = 30,
    sample_key: str | None = None,
    telemetry_key: str | None = None,
    detail_key: list[str] | None = None,
    fmt: str = "parquet",
) -> Analysis:
    """Batch job: read, analyse, write every output table below `output`.

    Without a key column Parquet rows are keyed by file and position; CSV tables must name one.
    """
    def load(path: str | None, key: str | None) -> DataFrame | None:
        return None if path is None else load_table(spark, path, row_key=key is None)

    history = load(samples_path, sample_key)
    if details_path is not None:
        history = enrich_samples(history, load(details_path, detail_key and detail_key[0]), detail_key or ["source_row"])
    orders = None if work_orders_path is None else load_table(spark, work_orders_path)
    result = analyze(history, load(telemetry_path, telemetry_key), orders, horizon_days,
                     sample_key or "source_row", telemetry_key or "source_row")
    tables = {
        "alerts": result.alerts,
        "telemetry_summary": None if result.telemetry is None else tele.asset_summary(result.telemetry),
        "telemetry": result.telemetry, "readiness": result.readiness, "scoring": result.scoring,
        "cards": result.cards, "training": result.training, "cases": cases.ordered_cases(result.case_table()),
        "quality_issues": result.quality_issues(), "report_counts": report.report_counts(result.alerts),
        "report_p1": report.first_p1_rows(result.alerts), "report_readiness": report.readiness_lines(result.readiness),
    }
    for name, table in tables.items():
        if table is not None:
            write_table(table, f"{output}/{name}", fmt)
    if result.model is not None:
        result.model.save(f"{output}/failure_model")
    write_json_row(run_summary(result), f"{output}/summary")
    return result
