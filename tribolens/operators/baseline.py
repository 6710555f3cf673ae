"""Empirical-Bayes event rate per (machine model, component)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tribolens.functions import fixed_values as fv
from tribolens.plans import scans

GROUP = ["machine_model", "component"]
PRIOR_STRENGTH = 12.0


def _incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (Lentz's method)."""
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    lgamma = np.vectorize(math.lgamma)
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-13):
            break
    value = front * h
    return np.where(swap, 1 - value, value)


def beta_quantile(a: np.ndarray, b: np.ndarray, q: float) -> np.ndarray:
    """Quantile of the beta distribution by bisection."""
    low, high = np.zeros_like(a), np.ones_like(a)
    for _ in range(60):
        middle = (low + high) / 2
        below = _incomplete_beta(a, b, middle) < q
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


def _quantile_udf(q: float):
    @F.pandas_udf("double")
    def quantile(alpha: pd.Series, beta: pd.Series) -> pd.Series:
        return pd.Series(beta_quantile(alpha.to_numpy(float), beta.to_numpy(float), q))

    return quantile


def _with_interval(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "posterior_mean": F.col("alpha") / (F.col("alpha") + F.col("beta")),
        "credible_low_90": _quantile_udf(0.05)("alpha", "beta"),
        "credible_high_90": _quantile_udf(0.95)("alpha", "beta"),
    })


def fleet_posterior(training: DataFrame, prior_strength: float = PRIOR_STRENGTH) -> DataFrame:
    """One row: prior and posterior parameters of the whole fleet."""
    rate = F.col("events") / F.col("rows")
    return training.agg(F.sum(fv.TARGET).alias("events"), F.count("*").alias("rows")).select(
        "events", "rows",
        F.greatest(F.lit(0.5), rate * prior_strength).alias("alpha0"),
        F.greatest(F.lit(0.5), (1 - rate) * prior_strength).alias("beta0"),
    ).select("alpha0", "beta0", (F.col("alpha0") + F.col("events")).alias("alpha"),
             (F.col("beta0") + F.col("rows") - F.col("events")).alias("beta"))


def fit_rates(training: DataFrame, prior_strength: float = PRIOR_STRENGTH, interval: bool = True) -> DataFrame:
    """Posterior mean and 90 % interval per group."""
    fleet = fleet_posterior(training, prior_strength)
    alpha0, beta0 = fleet.select("alpha0").scalar(), fleet.select("beta0").scalar()
    grouped = training.groupBy(*GROUP).agg(F.sum(fv.TARGET).alias("events"), F.count("*").alias("rows"))
    posterior = grouped.select(
        *GROUP, "events", "rows", (alpha0 + F.col("events")).alias("alpha"),
        (beta0 + F.col("rows") - F.col("events")).alias("beta"))
    if not interval:
        return posterior.withColumn("posterior_mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))
    return _with_interval(posterior)


def apply_rates(frame: DataFrame, training: DataFrame, prior_strength: float = PRIOR_STRENGTH,
                interval: bool = True) -> DataFrame:
    """Rate of each row's group, the fleet's where the group is unknown."""
    values = ["posterior_mean", "credible_low_90", "credible_high_90"] if interval else ["posterior_mean"]
    rates = fit_rates(training, prior_strength, interval).select(*GROUP, *values)
    fleet = fleet_posterior(training, prior_strength)
    fleet = _with_interval(fleet) if interval else fleet.withColumn(
        "posterior_mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))
    joined = scans.join_on(frame, rates, GROUP)
    return joined.withColumns({v: F.coalesce(v, fleet.select(v).scalar()) for v in values})
