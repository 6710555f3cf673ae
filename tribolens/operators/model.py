"""Failure model on Spark ML: preprocessing, two candidates, selection, calibration, test and scoring."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import (
    Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tribolens.functions import fixed_values as fv
from tribolens.operators import evaluation as ev
from tribolens.operators.gates import label_coverage
from tribolens.plans.storage import materialise

SEED = 42
# Candidate settings. Node ids are kept per row and tree, so that a level of a forest does not walk every tree from its root again.
LOGISTIC = {"maxIter": 2000, "tol": 1e-6}
FOREST = {"numTrees": 160, "maxDepth": 12, "minInstancesPerNode": 4, "featureSubsetStrategy": "sqrt",
          "cacheNodeIds": True}


class NotTrainable(ValueError):
    """The labelled rows do not allow a leak-free model."""


@dataclass
class TrainedModel:
    name: str
    pipeline: PipelineModel
    calibrator: LogisticRegressionModel
    features: list[str]
    metrics: dict[str, Any] = field(default_factory=dict)
    # Written tables and candidates of the fit; not saved.
    trace: dict[str, Any] = field(default_factory=dict, repr=False)

    def predict(self, frame: DataFrame) -> DataFrame:
        """Calibrated probability per row, keyed by `source_row`."""
        return calibrated(self, frame, ["source_row"])

    def importances(self) -> dict[str, float]:
        return feature_importances(self)

    def save(self, path: str) -> None:
        """Pipeline, calibrator and metrics under one folder."""
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        self.calibrator.write().overwrite().save(f"{path}/calibrator")
        row = SparkSession.getActiveSession().createDataFrame([(self.name, self.features)], "name string, features array<string>")
        row.select("*", *[F.lit(v).alias(k) for k, v in self.metrics.items()]).write.mode("overwrite").json(
            f"{path}/metrics")


def load_model(spark: SparkSession, path: str) -> TrainedModel:
    """A model as `TrainedModel.save` wrote it."""
    row = spark.read.json(f"{path}/metrics").first().asDict()
    name, features = row.pop("name"), row.pop("features")
    return TrainedModel(name, PipelineModel.load(f"{path}/pipeline"), LogisticRegressionModel.load(f"{path}/calibrator"),
                        list(features), row)


def _quoted(name: str) -> str:
    return f"`{name}`"


def preprocessing(train: DataFrame, features: list[str]) -> list:
    """Median-imputed, indicated and standardised numbers; mode-imputed one-hot texts."""
    texts = ev.text_columns(train, features)
    numbers = [n for n in features if n not in texts]
    facts = train.agg(
        *[F.count_if(F.col(n).isNull()).alias("m_" + n) for n in numbers],
        *[F.mode(n, True).alias("t_" + n) for n in texts]).first().asDict()
    missing = [n for n in numbers if facts["m_" + n] > 0]
    made = [f"CAST({_quoted(n)} AS DOUBLE) AS `num__{n}`" for n in numbers]
    made += [f"CAST({_quoted(n)} IS NULL AS DOUBLE) AS `missingindicator_{n}`" for n in missing]
    made += ["coalesce({0}, '{1}') AS `txt__{2}`".format(_quoted(n), str(facts["t_" + n]).replace("'", "''"), n)
             for n in texts]
    stages: list = [SQLTransformer(statement=f"SELECT *, {', '.join(made)} FROM __THIS__")]
    parts = []
    if numbers:
        raw, filled = [f"num__{n}" for n in numbers], [f"imp__{n}" for n in numbers]
        stages += [
            Imputer(strategy="median", inputCols=raw, outputCols=filled, relativeError=0.0001),
            VectorAssembler(inputCols=filled + [f"missingindicator_{n}" for n in missing], outputCol="_numbers"),
            StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True),
        ]
        parts.append("_scaled")
    if texts:
        stages += [
            StringIndexer(inputCols=[f"txt__{n}" for n in texts], outputCols=[f"idx__{n}" for n in texts],
                          handleInvalid="keep"),
            OneHotEncoder(inputCols=[f"idx__{n}" for n in texts], outputCols=[f"hot__{n}" for n in texts],
                          dropLast=False),
        ]
        parts += [f"hot__{n}" for n in texts]
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features")]


def weighted(train: DataFrame) -> DataFrame:
    """Equal-asset weight times class balance."""
    sizes = {r[fv.TARGET]: r["count"] for r in train.groupBy(fv.TARGET).count().collect()}
    rows = sum(sizes.values())
    balance = reduce(lambda acc, kv: F.when(F.col(fv.TARGET) == kv[0], rows / (len(sizes) * kv[1])).otherwise(acc),
                     sizes.items(), F.lit(1.0))
    return ev.asset_weights(train).withColumn("weight", F.col("sample_weight") * balance)


def candidates(total_weight: float) -> dict:
    """Both candidate estimators; the ridge strength matches a unit penalty on the weighted sum of losses."""
    shared = {"featuresCol": "features", "labelCol": fv.TARGET, "weightCol": "weight"}
    return {
        "logistic_regression": LogisticRegression(
            regParam=1.0 / total_weight, elasticNetParam=0.0, standardization=False, **LOGISTIC, **shared),
        "random_forest": RandomForestClassifier(seed=SEED, **FOREST, **shared),
    }


def model_score(name: str) -> Column:
    """What the calibrator sees: the margin of the linear model, the vote share of the forest."""
    column = "rawPrediction" if name == "logistic_regression" else "probability"
    return F.get(vector_to_array(F.col(column)), 1)


def scored(pipeline: PipelineModel, name: str, frame: DataFrame) -> DataFrame:
    return pipeline.transform(frame).withColumns({
        "score": model_score(name), "base_probability": F.get(vector_to_array("probability"), 1),
    }).select(*frame.columns, "score", "base_probability")


def fit_sigmoid(calibration: DataFrame) -> LogisticRegressionModel:
    """Sigmoid calibration with smoothed targets; expects `score` and the label.

    A target t is expressed by two rows: label 1 with weight t and label 0 with weight 1 - t.
    """
    sizes = {r[fv.TARGET]: r["count"] for r in calibration.groupBy(fv.TARGET).count().collect()}
    positives, negatives = sizes.get(1, 0), sizes.get(0, 0)
    target = F.when(F.col(fv.TARGET) == 1, (positives + 1) / (positives + 2)).otherwise(1 / (negatives + 2))
    rows = calibration.select(
        array_to_vector(F.array("score")).alias("features"),
        F.explode(F.array(F.struct(F.lit(1.0).alias("label"), target.alias("weight")),
                          F.struct(F.lit(0.0).alias("label"), (1 - target).alias("weight")))).alias("_t"),
    ).select("features", "_t.*")
    return LogisticRegression(regParam=0.0, weightCol="weight", maxIter=200).fit(rows)


def calibrated(model: TrainedModel, frame: DataFrame, keep: list[str]) -> DataFrame:
    rows = scored(model.pipeline, model.name, frame).withColumn("features", array_to_vector(F.array("score")))
    out = model.calibrator.transform(rows.select(*keep, "features"))
    return out.select(*keep, F.get(vector_to_array("probability"), 1).alias("probability"))


def as_scored(rows: DataFrame, probability: str) -> DataFrame:
    return rows.select(F.col(fv.TARGET).alias("label"), F.col(probability).alias("probability"))


def train_failure_model(training: DataFrame) -> tuple[TrainedModel, DataFrame]:
    """Fit, select on the middle block, calibrate, choose a threshold and test once on the newest block."""
    rows = materialise(training.filter(F.col("sample_date").isNotNull()))
    facts = label_coverage(rows).select(
        "*", rows.agg(F.count_distinct("sample_date")).scalar().alias("distinct_dates"),
        rows.agg(F.max("horizon_days")).scalar().alias("horizon")).first().asDict()
    problem = ev.training_problem(facts)
    if problem:
        raise NotTrainable(problem)
    horizon = int(facts["horizon"])
    split = ev.choose_split(rows, horizon).first()
    if split is None:
        raise NotTrainable(
            "no cut in time leaves eight rows and both outcomes to each of training, calibration and test")
    starts = [F.lit(split[k]).cast("timestamp_ntz") for k in ("calibration_start", "test_start")]
    blocks = ev.split_blocks(rows, horizon, *starts)
    train, calibration, test = (blocks.filter(F.col("block") == b).drop("block")
                                for b in ("train", "calibration", "test"))
    features = [r["feature"] for r in ev.usable_features(train).collect()]
    features = [n for n in ev.candidate_features(rows) if n in features]
    if not features:
        raise NotTrainable("no predictor varies")
    ready = materialise(weighted(train))
    total_weight = ready.agg(F.sum("weight")).first()[0]
    steps = Pipeline(stages=preprocessing(train, features)).fit(ready)
    prepared = materialise(steps.transform(ready).select("features", fv.TARGET, "weight"))

    fitted, board = {}, []
    for name, estimator in candidates(total_weight).items():
        fitted[name] = PipelineModel([*steps.stages, estimator.fit(prepared)])
        validated = materialise(as_scored(scored(fitted[name], name, calibration), "base_probability"))
        metrics = ev.binary_metrics(validated)
        board.append(metrics.select(
            F.lit(name).alias("model"), F.lit("validation").alias("evaluation_period"), "*",
            F.lit(train.count()).alias("train_rows"), F.col("test_rows").alias("calibration_rows")).first())
    leaderboard = rows.sparkSession.createDataFrame(board).orderBy(F.col("average_precision").desc(), "brier_score")
    winner = min(board, key=lambda r: (-r["average_precision"], r["brier_score"]))
    name = winner["model"]
    to_calibrate = materialise(scored(fitted[name], name, calibration).select("score", fv.TARGET))
    calibrator = fit_sigmoid(to_calibrate)
    model = TrainedModel(name, fitted[name], calibrator, features, trace={
        "weighted": ready, "prepared": prepared, "candidates": fitted, "total_weight": total_weight, "calibration": to_calibrate})
    validation = materialise(as_scored(calibrated(model, calibration, [fv.TARGET]), "probability"))
    threshold = float(ev.choose_threshold(validation).first()["threshold"])
    held_out = materialise(as_scored(calibrated(model, test, [fv.TARGET]), "probability"))
    prevalence = ev.development_prevalence(blocks).scalar()
    tested = ev.utility_gate(held_out, ev.binary_metrics(held_out, threshold), prevalence).first().asDict()
    model.metrics = {
        **tested, "model": name, "selection_average_precision": winner["average_precision"],
        "selection_brier_score": winner["brier_score"], "train_rows": winner["train_rows"],
        "calibration_rows": winner["calibration_rows"],
        "calibration_start": split["calibration_start"].isoformat(), "test_start": split["test_start"].isoformat(),
        "embargo_days": horizon, "asset_balanced_training": True,
    }
    return model, leaderboard


def _slot_names(model: TrainedModel) -> list[str]:
    """Name of every slot of the assembled vector."""
    names: list[str] = []
    for stage in model.pipeline.stages:
        kind = type(stage).__name__
        if kind == "VectorAssembler" and stage.getOutputCol() == "_numbers":
            names += [n.removeprefix("imp__") for n in stage.getInputCols()]
        elif kind == "StringIndexerModel":
            for column, labels in zip(stage.getInputCols(), stage.labelsArray):
                base = column.removeprefix("txt__")
                names += [f"{base}_{label}" for label in labels] + [f"{base}_unknown"]
    return names


def feature_importances(model: TrainedModel) -> dict[str, float]:
    """Share of each input in the model, largest first."""
    last = model.pipeline.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    sums: dict[str, float] = {}
    for name, value in zip(_slot_names(model), values.toArray()):
        sums[name] = sums.get(name, 0.0) + abs(float(value))
    whole = sum(sums.values())
    shares = {k: round(v / whole, 4) if whole > 0 else v for k, v in sums.items()}
    return dict(sorted(shares.items(), key=lambda kv: -kv[1]))


def validation_summary(model: TrainedModel) -> dict[str, Any]:
    """Held-out figures of a deployed model."""
    m = model.metrics
    keys = ["test_rows", "true_negative", "false_positive", "false_negative", "true_positive", "decision_threshold",
            "roc_auc", "average_precision", "baseline_average_precision", "average_precision_lift", "brier_score",
            "baseline_brier_score", "brier_skill_score", "passes_utility_gate"]
    return {"model_name": model.name.replace("_", " ").title(), **{k: m[k] for k in keys},
            "precision": m["precision_at_threshold"], "recall": m["recall_at_threshold"], "f1": m["f1_at_threshold"]}
