"""Samples that are the same in every run: rows in hash order of their key."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import draw


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, or all, without replacement."""
    return rows.withColumn("_draw", draw(seed, F.col(key))).orderBy("_draw", key).limit(n).drop("_draw")


def without(rows: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    return rows.join(taken.select(key), key, "left_anti")


def strata(rows: DataFrame, key: str, wanted: list[tuple[str, Column | None, Column | None, int]], seed: int = 42) -> DataFrame:
    """Rows with ``stratum``, each from the first stratum that takes it.

    A stratum is (name, condition, order, size): it takes the rows left over that meet the condition, first by order, or,
    without one, in hash order.
    """
    rest, parts = rows, []
    for name, condition, order, n in wanted:
        pool = rest if condition is None else rest.where(condition)
        part = sample(pool, key, n, seed) if order is None else pool.orderBy(order, key).limit(n)
        parts.append(part.withColumn("stratum", F.lit(name)))
        rest = without(rest, part, key)
    return reduce(DataFrame.unionByName, parts)


def shuffled(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """The rows in hash order of their key."""
    return rows.orderBy(draw(seed, F.col(key)), key)


def golden_set(rows: DataFrame, key: str, wanted: list[tuple[str, Column | None, Column | None, int]], total: int = 200, double: int = 50, seed: int = 42) -> DataFrame:
    """The rows of :func:`strata`, filled up to ``total`` from what is left, with ``double_annotate`` on ``double`` of them and
    ``place``, their order when shuffled. All of it is bounded by ``total``."""
    first = strata(rows, key, wanted, seed)
    taken = first.agg(F.count("*").alias("taken"))
    pool = sample(without(rows, first, key), key, total, seed).withColumn("nth", F.row_number().over(Window.orderBy(draw(seed, F.col(key)), key)))
    rest = pool.join(F.broadcast(taken)).where(F.col("nth") <= total - F.col("taken")).drop("nth", "taken").withColumn("stratum", F.lit("rest"))
    every = first.unionByName(rest)
    twice = Window.orderBy(draw(seed + 1, F.col(key)), key)
    return every.withColumn("double_annotate", F.row_number().over(twice) <= double).withColumn("place", F.row_number().over(Window.orderBy(draw(seed + 2, F.col(key)), key)))


def weighted_mean(value: Column, times: Column) -> Column:
    return F.try_divide(F.sum(value * times), F.sum(times))


def weighted_median(value: Column, times: Column) -> Column:
    return F.percentile(value, F.lit(0.5), times)


def resample(values: DataFrame, key: str, value: str, resamples: int, statistic: Callable[[Column, Column], Column] = weighted_mean, seed: int = 42) -> DataFrame:
    """(r, stat) of ``resamples`` draws with replacement, as many rows each as there are.

    ``statistic`` makes an aggregate of a value and of how many times it was drawn, so that any statistic that Spark can
    aggregate by frequency can be resampled.

    Each row is drawn a Poisson(1) number of times in every resample, decided by a hash of row and resample: no row has to
    be found by its number, so the rows stay where they are and only sums move.
    """
    u = (draw(seed, F.col("r"), F.col(key)) + 0.5) / F.lit(2.0**32)
    times, upto, p = F.lit(0), 0.0, 0.36787944117144233
    for k in range(12):
        upto += p
        times = times + F.when(u >= upto, 1).otherwise(0)
        p /= k + 1
    each = values.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("v"), F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("r"))
    return each.withColumn("times", times).groupBy("r").agg(statistic(F.col("v"), F.col("times")).alias("stat"))


def resample_means(values: DataFrame, key: str, value: str, resamples: int, seed: int = 42) -> DataFrame:
    """(r, mean) of :func:`resample`."""
    return resample(values, key, value, resamples, seed=seed).withColumnRenamed("stat", "mean")


def interval(means: DataFrame, confidence: float = 0.95, stat: str = "mean") -> DataFrame:
    """One row (lower, upper) of the middle share of the resampled statistic."""
    tail = (1 - confidence) / 2
    return means.agg(F.percentile(stat, F.lit(tail)).alias("lower"), F.percentile(stat, F.lit(1 - tail)).alias("upper"))
