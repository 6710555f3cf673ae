"""Model-selection arithmetic: splits, feature eligibility, weights, metrics, thresholds and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tribolens.functions import cleaning as c
from tribolens.functions import fixed_values as fv
from tribolens.plans import scans
from tribolens.plans.storage import materialise

MIN_BLOCK_ROWS = 8


def date_counts(training: DataFrame) -> DataFrame:
    """Rows, positives and negatives per distinct sample time."""
    label = F.col(fv.TARGET)
    return training.filter(F.col("sample_date").isNotNull()).groupBy("sample_date").agg(
        F.count("*").alias("n"), F.sum(label).cast("long").alias("pos"), F.sum(1 - label).cast("long").alias("neg"),
    ).withColumn("at", c.micros(F.col("sample_date")))


def _with_lookup(rows: DataFrame, level: str, wanted: Column, name: str, rows_per_segment: int) -> DataFrame:
    """Add the first position at which the non-decreasing column `level` reaches `wanted`.

    Levels and wanted levels are merged in one order, each distinct value once; the places found join back on the value.
    """
    step, asked = F.lit(1).cast("long"), F.lit(True)
    levels = rows.select(F.col(level).alias("_level"), step.alias("_step")).unionByName(
        rows.select(wanted.cast("long").alias("_level"), asked.alias("_asked")), allowMissingColumns=True)
    levels = levels.groupBy("_level").agg(F.sum("_step").alias("_step"), F.max("_asked").alias("_asked"))
    found = scans.ranged_totals(levels, [], "_level", {name: ("sum", F.col("_step"))}, inclusive=False,
                                rows_per_segment=rows_per_segment)
    places = found.filter("_asked").select("_level", F.coalesce(name, F.lit(0)).alias(name))
    return materialise(rows.withColumn("_wanted", wanted.cast("long")).join(
        places, F.col("_wanted") == F.col("_level")).drop("_wanted", "_level"))


def choose_split(training: DataFrame, horizon_days: int, rows_per_segment: int = scans.ROWS_PER_SEGMENT) -> DataFrame:
    """Middle valid (calibration start, test start) of a chronological split with a horizon embargo.

    The train block only grows with the calibration start i, the test block only shrinks with the test start j,
    and for a fixed i the calibration block only grows with j. So the valid j of one i are an interval, found by
    three position lookups, and no pair of dates is formed. Returns one row, or none without a valid split.
    Each step is written once, because the next one reads it several times.
    """
    horizon = int(max(horizon_days, 0)) * c.MICROS_PER_DAY
    dates = materialise(date_counts(training))
    upto = scans.ranged_totals(dates, [], "at", {
        "n_upto": ("sum", F.col("n")), "pos_upto": ("sum", F.col("pos")), "neg_upto": ("sum", F.col("neg")),
        "rank": ("sum", F.lit(1).cast("long"))}, rows_per_segment=rows_per_segment)
    total = dates.agg(F.count("*").alias("dates"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k)
                                                     for k in ("n", "pos", "neg")]).first().asDict()

    ended = dates.select((F.col("at") + horizon).alias("at"), *[F.col(k).alias("_" + k) for k in ("n", "pos", "neg")])
    rows = scans.ranged_totals(
        upto.unionByName(ended, allowMissingColumns=True), [], "at",
        {k + "_ended": ("sum", F.col("_" + k)) for k in ("n", "pos", "neg")}, inclusive=False,
        rows_per_segment=rows_per_segment,
    ).filter(F.col("rank").isNotNull()).select(
        "sample_date", (F.col("rank") - 1).alias("position"),
        *[(F.col(k + "_upto") - F.col(k)).alias(k + "_before") for k in ("n", "pos", "neg")],
        *[F.coalesce(k + "_ended", F.lit(0)).alias(k + "_ended") for k in ("n", "pos", "neg")])
    rows = materialise(rows)
    need = {"n": MIN_BLOCK_ROWS, "pos": 1, "neg": 1}
    for k, least in need.items():
        rows = _with_lookup(rows, k + "_ended", F.col(k + "_before") + least, k + "_first", rows_per_segment)

    position = F.col("position")
    train_from, train_to = max(1, int(total["dates"] * 0.50)), max(2, int(total["dates"] * 0.72))
    test_from, test_to = max(2, int(total["dates"] * 0.72)), max(3, int(total["dates"] * 0.90))
    test_valid = ((total["n"] - F.col("n_before") >= MIN_BLOCK_ROWS) & (total["pos"] - F.col("pos_before") > 0)
                  & (total["neg"] - F.col("neg_before") > 0))
    last_test = rows.filter(test_valid & (position < test_to)).agg(F.max("position")).first()[0]
    train_valid = (F.col("n_ended") >= MIN_BLOCK_ROWS) & (F.col("pos_ended") >= 1) & (F.col("neg_ended") >= 1)
    first = F.greatest("n_first", "pos_first", "neg_first", F.lit(test_from), position + 1)
    options = rows.filter(train_valid & (position >= train_from) & (position < train_to)).select(
        "position", "sample_date", first.alias("first"), (F.lit(last_test) - first + 1).alias("options")
    ).filter(F.col("options") > 0)
    counted = scans.ranged_totals(options, [], "position", {"options_upto": ("sum", F.col("options"))},
                                  rows_per_segment=rows_per_segment)
    target = F.lit((options.agg(F.sum("options")).first()[0] or 0) // 2)
    chosen = counted.filter((F.col("options_upto") > target) & (F.col("options_upto") - F.col("options") <= target))
    chosen = chosen.select(
        F.col("sample_date").alias("calibration_start"),
        (F.col("first") + target - (F.col("options_upto") - F.col("options"))).alias("test_position"))
    return chosen.join(rows.select(position.alias("test_position"), F.col("sample_date").alias("test_start")),
                       "test_position").select("calibration_start", "test_start")


def split_blocks(training: DataFrame, horizon_days: int, calibration_start: Column, test_start: Column) -> DataFrame:
    """Add `block`: train, calibration or test; rows inside an embargo get NULL."""
    end = F.col("sample_date") + F.expr(f"INTERVAL '{int(max(horizon_days, 0))}' DAY")
    at = F.col("sample_date")
    return training.withColumn(
        "block", F.when(at >= test_start, "test").when((at >= calibration_start) & (end < test_start), "calibration")
        .when(end < calibration_start, "train"))


def candidate_features(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.name not in fv.NOT_PREDICTORS and f.name != "block"]


def feature_eligibility(train: DataFrame) -> DataFrame:
    """Per candidate: present somewhere and not constant (NULL counts as a value); one pass, no distinct."""
    names = candidate_features(train)
    varies = [
        ((F.count(n) > 0) & ((F.min(n) != F.max(n)) | (F.count(n) < F.count("*")))).alias(n) for n in names]
    row = train.agg(*[F.coalesce(v, F.lit(False)).alias(n) for v, n in zip(varies, names)])
    return row.unpivot([], names, "feature", "eligible")


def telemetry_coverage(train: DataFrame) -> DataFrame:
    """Whether telemetry covers enough train rows and assets to be used."""
    seen = F.coalesce(F.col("telemetry_available") > 0, F.lit(False))
    row = train.agg(F.count("*").alias("train_rows"), F.count_if(seen).alias("telemetry_rows"),
                    F.count_distinct(F.when(seen, F.col("asset_id"))).alias("telemetry_assets"))
    least = F.greatest(F.lit(20), F.ceil(F.col("train_rows") * 0.05))
    return row.withColumn("use_telemetry", (F.col("telemetry_rows") >= least) & (F.col("telemetry_assets") >= 3))


def usable_features(train: DataFrame) -> DataFrame:
    """Eligible features, without the telemetry ones when their coverage is too thin."""
    if "telemetry_available" not in train.columns:
        return feature_eligibility(train).filter("eligible").select("feature")
    use = telemetry_coverage(train).select("use_telemetry").scalar()
    keep = F.coalesce(use, F.lit(False)) | ~F.col("feature").isin(fv.TELEMETRY_PREDICTORS)
    return feature_eligibility(train).filter(F.col("eligible") & keep).select("feature")


def asset_weights(frame: DataFrame) -> DataFrame:
    """Equal total weight per asset, mean 1: rows / (assets * rows of the asset)."""
    key = F.coalesce("asset_id", F.lit("__missing_asset__"))
    keyed = frame.withColumn("_asset", key)
    sizes = keyed.groupBy("_asset").agg(F.count("*").alias("_rows"))
    whole = sizes.agg(F.sum("_rows").alias("rows"), F.count("*").alias("assets"))
    mean = whole.select(F.col("assets") / F.col("rows")).scalar()
    return keyed.join(sizes, "_asset").withColumn("sample_weight", F.lit(1.0) / F.col("_rows") / mean).drop(
        "_asset", "_rows")


def _per_score(scored: DataFrame) -> DataFrame:
    """Counts per distinct probability; expects `label` and `probability`."""
    label = F.col("label")
    return scored.groupBy("probability").agg(
        F.count("*").alias("n"), F.sum(label).cast("long").alias("pos"), F.sum(1 - label).cast("long").alias("neg"))


def binary_metrics(scored: DataFrame, threshold: float | Column = 0.5,
                   rows_per_segment: int = scans.ROWS_PER_SEGMENT) -> DataFrame:
    """Average precision, threshold metrics, Brier score, confusion cells and rank AUC as one row."""
    limit = F.lit(threshold) if isinstance(threshold, float) else threshold
    scores = materialise(_per_score(scored))
    ranked = scans.ranged_totals(scores, [], "probability", {"n_upto": ("sum", F.col("n")), "pos_upto": ("sum", F.col("pos"))},
                                 rows_per_segment=rows_per_segment)
    size = scores.agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    rows, positives = size.select("n").scalar(), size.select("pos").scalar()
    p, n, pos, neg = (F.col(k) for k in ("probability", "n", "pos", "neg"))
    called = p >= limit
    above_n, above_pos = rows - F.col("n_upto") + n, positives - F.col("pos_upto") + pos
    below_neg = (F.col("n_upto") - F.col("pos_upto")) - neg
    summed = ranked.withColumn("_precision", above_pos / above_n).agg(
        F.sum(n).alias("test_rows"), F.sum(pos).alias("_pos"), F.sum(neg).alias("_neg"),
        F.sum(pos * F.col("_precision")).alias("_ap"),
        F.sum(pos * (below_neg + neg / 2)).alias("_pairs"),
        F.sum(pos * (1 - p) * (1 - p) + neg * p * p).alias("_brier"),
        F.coalesce(F.sum(F.when(called, pos)), F.lit(0)).alias("true_positive"),
        F.coalesce(F.sum(F.when(called, neg)), F.lit(0)).alias("false_positive"),
    )
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("_pos") - F.col("true_positive")

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(0.0)

    return summed.select(
        "test_rows", (F.col("_pos") / F.col("test_rows")).alias("test_positive_rate"),
        ratio(F.col("_ap"), F.col("_pos")).alias("average_precision"),
        limit.cast("double").alias("decision_threshold"),
        ratio(tp, tp + fp).alias("precision_at_threshold"),
        ratio(tp, tp + fn).alias("recall_at_threshold"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1_at_threshold"),
        (F.col("_brier") / F.col("test_rows")).alias("brier_score"),
        (F.col("_neg") - fp).alias("true_negative"), fp.alias("false_positive"),
        fn.alias("false_negative"), tp.alias("true_positive"),
        F.when((F.col("_pos") > 0) & (F.col("_neg") > 0), F.col("_pairs") / (F.col("_pos") * F.col("_neg")))
        .alias("roc_auc"),
    )


def threshold_table(scored: DataFrame) -> DataFrame:
    """Recall and F1 at the 81 thresholds 0.10 … 0.90.

    Each row is counted once, at the highest threshold it reaches; sums from the top give every threshold.
    """
    p = F.col("probability")

    def at(step: Column) -> Column:
        return step * F.lit(0.01) + F.lit(0.10)

    guess = F.greatest(F.lit(-1), F.least(F.lit(80), F.floor((p - 0.10) / 0.01).cast("int")))
    step = (F.when((guess < 80) & (p >= at(guess + 1)), guess + 1).when((guess >= 0) & (p < at(guess)), guess - 1)
            .otherwise(guess))
    reached = scored.groupBy(step.alias("step")).agg(
        F.count("*").alias("n"), F.sum("label").cast("long").alias("pos"))
    steps = scored.sparkSession.range(-1, 81).select(F.col("id").cast("int").alias("step"))
    filled = steps.join(F.broadcast(reached), "step", "left").select(
        "step", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("pos", F.lit(0)).alias("pos"))
    # 82 rows: from here on a single ordered frame is enough.
    down = Window.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    tp, called, positives = F.sum("pos").over(down), F.sum("n").over(down), F.sum("pos").over(whole)
    sums = filled.select("step", tp.alias("tp"), called.alias("called"), positives.alias("positives")).filter("step >= 0")
    return sums.select(
        at(F.col("step")).alias("threshold"),
        F.when(F.col("positives") > 0, F.col("tp") / F.col("positives")).otherwise(0.0).alias("recall"),
        F.when(F.col("called") + F.col("positives") > 0, 2 * F.col("tp") / (F.col("called") + F.col("positives")))
        .otherwise(0.0).alias("f1"),
    )


def choose_threshold(scored: DataFrame) -> DataFrame:
    """Threshold with the best F1, then recall, then nearest to one half, then the higher one."""
    return threshold_table(scored).orderBy(
        F.col("f1").desc(), F.col("recall").desc(), F.abs(F.col("threshold") - 0.5), F.col("threshold").desc(),
    ).limit(1)


def development_prevalence(blocks: DataFrame) -> DataFrame:
    """Mean label over train and calibration."""
    return blocks.filter(F.col("block").isin("train", "calibration")).agg(
        F.avg(fv.TARGET).alias("development_prevalence"))


def utility_gate(scored: DataFrame, metrics: DataFrame, prevalence: Column) -> DataFrame:
    """Compare the held-out metrics with a constant-prevalence baseline."""
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), prevalence))
    label = F.col("label").cast("double")
    held = scored.agg(F.avg(label).alias("baseline_average_precision"),
                      F.avg((label - base) * (label - base)).alias("baseline_brier_score"))
    row = metrics.select(
        "*", base.alias("baseline_probability"), *[held.select(n).scalar().alias(n) for n in held.columns])
    lift = F.col("average_precision") - F.col("baseline_average_precision")
    skill = F.when(F.col("baseline_brier_score") > 0,
                   1 - F.col("brier_score") / F.col("baseline_brier_score")).otherwise(0.0)
    return row.withColumns({"average_precision_lift": lift, "brier_skill_score": skill}).withColumn(
        "passes_utility_gate",
        (F.col("average_precision_lift") >= 0.02) & (F.col("brier_skill_score") > 0)
        & (F.col("recall_at_threshold") > 0))


def training_problem(row: dict) -> str | None:
    """Why a label coverage row does not allow training, or None when it does."""
    if row["labelled_rows"] < 60:
        return "fewer than 60 labelled samples: too few for blocks in time order"
    if row["label_classes"] < 2:
        return "only one kind of outcome among the labels"
    if row["positives"] < 15 or row["negatives"] < 15 or row["labelled_assets"] < 5:
        return "fewer than 15 outcomes of a kind, or labels of fewer than five assets"
    if row["distinct_dates"] < 12:
        return "fewer than 12 sample dates"
    return None


def text_columns(df: DataFrame, names: list[str]) -> list[str]:
    return [n for n in names if isinstance(df.schema[n].dataType, T.StringType)]
