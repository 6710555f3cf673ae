"""Unsupervised telemetry anomaly score: an isolation forest (Liu, Ting and Zhou, 2008) trained on Spark.

Each tree sees at most 256 readings, so all training data together is a sample of fixed size that may be
broadcast. Trees are grown in parallel tasks, and every reading is scored in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tribolens.functions import cleaning as c
from tribolens.functions import fixed_values as fv
from tribolens.plans import selection
from tribolens.plans.storage import materialise

# Forest settings.
TREES, SUBSAMPLE, CONTAMINATION, SEED, MIN_ROWS = 250, 256, 0.05, 42, 20
NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, depth double"


def average_path(n: np.ndarray) -> np.ndarray:
    """Expected path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3)
    long = 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def grow_tree(points: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Nodes (index, feature or -1, cut, left, right, path length at a leaf)."""
    limit = int(np.ceil(np.log2(max(len(points), 2))))
    nodes: list[tuple] = []
    open_nodes = [(0, points, 0)]
    size = 1
    while open_nodes:
        index, rows, depth = open_nodes.pop()
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (None, None)
        choices = np.flatnonzero(high > low) if len(rows) > 1 else []
        if depth >= limit or len(choices) == 0:
            nodes.append((index, -1, 0.0, -1, -1, depth + float(average_path(len(rows)))))
            continue
        feature = int(rng.choice(choices))
        cut = float(rng.uniform(low[feature], high[feature]))
        below = rows[:, feature] <= cut
        nodes.append((index, feature, cut, size, size + 1, 0.0))
        open_nodes += [(size, rows[below], depth + 1), (size + 1, rows[~below], depth + 1)]
        size += 2
    return nodes


def _features(telemetry: DataFrame, medians: dict[str, float], missing: list[str]) -> list:
    """Median-filled features followed by missing indicators."""
    values = [c.finite_or(F.col(n), medians[n]).alias("x_" + n) for n in fv.ANOMALY_FEATURES]
    marks = [c.finite_or(F.col(n), None).isNull().cast("double").alias("m_" + n) for n in missing]
    return values + marks


def _tree_samples(readings: DataFrame, count: int) -> DataFrame:
    """Readings with the trees they grow, about SUBSAMPLE for each tree, by one rule for any number of readings.

    A reading joins TREES * SUBSAMPLE / count trees on average, at most all: the whole part of that many, and one more where
    a hash of its key falls below the fraction. They are consecutive trees from one that another hash picks.
    """
    share = min(float(TREES), TREES * SUBSAMPLE / count)
    unit = F.pmod(F.xxhash64("reading_key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.floor(F.lit(share) + unit).cast("int")
    first = F.pmod(F.xxhash64("reading_key", F.lit(SEED)), F.lit(TREES))
    trees = F.transform(F.sequence(F.lit(0), times - 1), lambda i: ((first + i) % TREES).cast("int"))
    return readings.filter(times > 0).withColumns({"tree": F.explode(trees), "_h": F.xxhash64("reading_key")})


def score_telemetry(telemetry: DataFrame) -> DataFrame:
    """Add `telemetry_anomaly_score` in [0, 1] and `telemetry_anomaly` (above the exact 95 % quantile)."""
    known = {n: c.finite_or(F.col(n), None) for n in fv.ANOMALY_FEATURES}
    telemetry = materialise(telemetry)
    facts = telemetry.agg(
        F.count("*").alias("rows"), *[F.count(v).alias("n_" + n) for n, v in known.items()]).first().asDict()
    if facts["rows"] < MIN_ROWS or sum(facts["n_" + n] for n in known) == 0:
        return telemetry.withColumns({"telemetry_anomaly_score": F.lit(None).cast("double"),
                                      "telemetry_anomaly": F.lit(False)})
    missing = [n for n in known if facts["n_" + n] < facts["rows"]]
    found = selection.quantiles(telemetry.select(*[v.alias(n) for n, v in known.items()]), dict.fromkeys(known, 0.5))
    medians = {n: 0.0 if found[n] is None else found[n] for n in known}
    inputs = _features(telemetry, medians, missing)
    spark = telemetry.sparkSession

    take = min(SUBSAMPLE, facts["rows"])
    names = [f"_x{i}" for i in range(len(inputs))]

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        rows = rows.sort_values(["_h", "reading_key"])[names].to_numpy(float)
        nodes = grow_tree(rows, np.random.default_rng([SEED, tree]))
        return pd.DataFrame([(tree, *node) for node in nodes],
                            columns=["tree", "node", "feature", "cut", "left", "right", "depth"])

    samples = _tree_samples(telemetry.select("reading_key", *(x.alias(n) for x, n in zip(inputs, names))), facts["rows"])
    grown = samples.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas().sort_values(["tree", "node"])
    forest = [
        tuple(group[k].to_numpy() for k in ("feature", "cut", "left", "right", "depth"))
        for _, group in grown.groupby("tree", sort=True)]
    trees = spark.sparkContext.broadcast(forest)
    scale = float(average_path(take))

    @F.pandas_udf("double")
    def isolation(*columns: pd.Series) -> pd.Series:
        points = np.column_stack([column.to_numpy(float) for column in columns])
        every = np.arange(len(points))
        total = np.zeros(len(points))
        for feature, cut, left, right, depth in trees.value:
            at = np.zeros(len(points), dtype=np.int64)
            while True:
                split = feature[at] >= 0
                if not split.any():
                    break
                goes_left = points[every, np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(split, np.where(goes_left, left[at], right[at]), at)
            total += depth[at]
        return pd.Series(np.exp2(-total / len(trees.value) / scale))

    raw = materialise(telemetry.select("*", isolation(*inputs).alias("_raw")))
    bounds = raw.agg(F.min("_raw").alias("low"), F.max("_raw").alias("high")).first()
    edge = selection.quantiles(raw.select("_raw"), {"_raw": 1 - CONTAMINATION})["_raw"]
    span = bounds["high"] - bounds["low"]
    return raw.select(
        *telemetry.columns,
        ((F.col("_raw") - bounds["low"]) / span if span > 0 else F.lit(0.0)).alias("telemetry_anomaly_score"),
        (F.col("_raw") > edge).alias("telemetry_anomaly"))
