"""Calibration of scores, and thresholds with a risk bound."""

from __future__ import annotations

from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Edges of ten equal bins as exact doubles: 3 * 0.1 is not 0.3.
EDGES = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]


def calibration_error(rows: DataFrame, score: str, correct: str) -> DataFrame:
    """One row (ece, n): mean distance of accuracy and score over bins [low, high), weighted by their rows.

    A score of exactly 1 or below 0 is in no bin but counts in n, as do nulls' rows not at all.
    """
    used = rows.where(F.col(score).isNotNull() & F.col(correct).isNotNull())
    bin_ = F.lit(None).cast("int")
    for i in range(10):
        bin_ = F.when((F.col(score) >= EDGES[i]) & (F.col(score) < EDGES[i + 1]), i).otherwise(bin_)
    per = used.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("acc"), F.avg(score).alias("conf"))
    gap = F.sum(F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("acc") - F.col("conf"))).otherwise(0.0))
    return per.agg(F.try_divide(gap, F.sum("n")).alias("ece"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def conformal_tau(rows: DataFrame, score: str, error: str, key: str, alpha: float = 0.1, delta: float = 0.05, on_infeasible: float = 0.0) -> DataFrame:
    """One row (tau, n): the smallest score such that the errors at or above it, with Hoeffding's margin, stay within alpha.

    Candidates are the prefixes in descending score (ties by key). If none qualifies tau is ``on_infeasible``. Equal
    scores are counted first, so the running sums go over distinct scores, not rows; within a score the prefix with the
    lowest bound decides, which needs the order of its rows only if it has both errors and hits.
    """
    used = rows.where(F.col(score).isNotNull()).select(F.col(score).alias("s"), F.col(error).cast("int").alias("e"), F.col(key).alias("k"))
    # Running sums by buckets of the score first, then within a bucket: no task holds all rows.
    used = used.withColumn("b", F.floor(F.col("s") * 1024))
    per = used.groupBy("b").agg(F.count("*").alias("bn"), F.sum("e").alias("be"))
    above = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket of the score
    per = per.withColumn("n0", F.coalesce(F.sum("bn").over(above), F.lit(0))).withColumn("e0", F.coalesce(F.sum("be").over(above), F.lit(0)))
    within = Window.partitionBy("b").orderBy(F.desc("s"), "k")
    run = used.join(per, "b").withColumn("n", F.col("n0") + F.row_number().over(within)).withColumn("errors", F.col("e0") + F.sum("e").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    bound = F.col("errors") / F.col("n") + F.sqrt(F.lit(log(1 / delta)) / (2 * F.col("n")))
    return run.agg(F.coalesce(F.min(F.when(F.round(bound, 9) <= alpha, F.col("s"))), F.lit(on_infeasible)).alias("tau"), F.count("*").alias("n"))


def fit_isotonic(rows: DataFrame, score: str, target: str):
    """Spark ML's isotonic regression of target on score; scores beyond the fitted ones are clipped."""
    from pyspark.ml.regression import IsotonicRegression

    used = rows.where(F.col(score).isNotNull() & F.col(target).isNotNull()).select(F.col(score).cast("double").alias("raw"), F.col(target).cast("double").alias("label"))
    return IsotonicRegression(featuresCol="raw", labelCol="label").fit(used)


def calibrate(rows: DataFrame, model, score: str, out: str = "calibrated") -> DataFrame:
    """Adds the calibrated score, by interpolation between the model's boundaries; null stays null.

    The boundaries, two numbers each, go along as arrays: the plan is the same however many there are.
    """
    xs, ys = (np.array([float(v) for v in values]) for values in (model.boundaries, model.predictions))
    shared = rows.sparkSession.sparkContext.broadcast((xs, ys))

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(np.interp(x, *shared.value), index=x.index).where(x.notna())

    return rows.withColumn(out, run(F.col(score).cast("double")))
