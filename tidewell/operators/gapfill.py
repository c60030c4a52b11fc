"""Polynomial gap filling from the samples around each gap.

Only sums of powers leave the JVM: each gap's normal equations are aggregated by
Spark and solved in batches with numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cuts, ranges


def context(tod: DataFrame, gaps: DataFrame, buffer: int) -> DataFrame:
    """Good samples within `buffer` of each gap: det, s, e, samp, y, x (place from the gap's start)."""
    near = gaps.select("det", "s", "e", F.explode(F.sequence(F.col("s") - buffer, F.col("e") + buffer - 1)).alias("samp"))
    bad = ranges.flagged_samples(gaps, ["det"])
    good = near.join(bad, ["det", "samp"], "left_anti").join(tod.select("det", "samp", "y"), ["det", "samp"])
    return good.withColumn("x", (F.col("samp") - F.col("s")).cast("double"))


def fit(tod: DataFrame, gaps: DataFrame, buffer: int, order: int) -> DataFrame:
    """Coefficients of every gap (det, s, e, coef): degree at most `order`, one term more for every ten samples."""
    at = context(tod, gaps, buffer).withColumn("u", F.col("x") / F.lit(float(buffer)))
    powers = [F.sum(F.pow("u", F.lit(k))).alias(f"m{k}") for k in range(2 * order + 1)]
    right = [F.sum(F.col("y") * F.pow("u", F.lit(k))).alias(f"b{k}") for k in range(order + 1)]
    sums = at.groupBy("det", "s", "e").agg(F.count("*").alias("cnt"), *powers, *right)

    def solve(batches):
        for g in batches:
            m = g[[f"m{k}" for k in range(2 * order + 1)]].to_numpy(float)
            b = g[[f"b{k}" for k in range(order + 1)]].to_numpy(float)
            terms = np.minimum(g["cnt"].to_numpy() // 10 + 1, order + 1)
            coef = np.zeros((len(g), order + 1))
            for t in np.unique(terms).tolist():
                at = np.flatnonzero(terms == t)
                left = m[at][:, np.arange(t)[:, None] + np.arange(t)[None, :]]
                coef[at, :t] = np.stack([np.linalg.lstsq(a, r, rcond=None)[0] for a, r in zip(left, b[at, :t])]) / float(buffer) ** np.arange(t)
            yield pd.DataFrame({"det": g["det"], "s": g["s"], "e": g["e"], "coef": list(coef)})

    return sums.mapInPandas(solve, "det long, s int, e int, coef array<double>")


def fill(tod: DataFrame, gaps: DataFrame, buffer: int, order: int) -> DataFrame:
    """Model values under the gaps (det, s, samp, v); a gap without good neighbours gets 0."""
    model = fit(tod, gaps.select("det", F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e")), buffer, order).drop("e")
    at = cuts.spread(gaps).join(model, ["det", "s"], "left").withColumn("x", F.col("i").cast("double"))
    value = F.aggregate(F.reverse("coef"), F.lit(0.0), lambda acc, c: acc * F.col("x") + c)
    return at.select("det", "s", "samp", F.coalesce(value, F.lit(0.0)).alias("v"))


def fill_linear(tod: DataFrame, gaps: DataFrame, buffer: int) -> DataFrame:
    """Order 1 with built-in regression alone; fewer than ten good samples give their mean."""
    line = context(tod, gaps, buffer).groupBy("det", "s").agg(F.count("*").alias("cnt"), F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("b"), F.avg("y").alias("mean"))
    at = cuts.spread(gaps).join(line, ["det", "s"], "left")
    value = F.when(F.col("cnt") < 10, F.col("mean")).otherwise(F.col("a") * F.col("i") + F.col("b"))
    return at.select("det", "s", "samp", F.coalesce(value, F.lit(0.0)).alias("v"))


def replaced(tod: DataFrame, model: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The data with the model under the gaps, and the originals that it replaced."""
    return cuts.insert_full(tod, model), tod.join(model.select("det", "samp"), ["det", "samp"])
