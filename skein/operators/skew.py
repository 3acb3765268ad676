"""Exact per-key quantiles and counts where a few keys hold most rows.

Distributed exact selection: values are counted in a histogram per key with partial aggregation, so a hot key sends at
most ``BINS`` counts per task and never its values. The histogram tells, for each asked rank, the bin that holds it;
only rows of such bins are counted again, in bins 256 times as fine, until a bin is one value wide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.session import cut, drop

BITS = 8
#: Bins of fewer rows than this are no burden for a task, so they are joined by shuffle; fuller ones are broadcast.
FULL_BIN = 100_000


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """(key, n) with map-side partial counts: a hot key is one row per task in the shuffle."""
    return df.groupBy(key).agg(F.count("*").alias("n"))


def key_quantiles(df: DataFrame, key: str, value: str, probs: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """(key, n, n_values, quantiles array<bigint>) per key; ``value`` is a whole number (cast dates to microseconds).

    ``n`` counts all rows of the key, ``n_values`` those with a value. Quantile p is the value of rank
    ``max(1, ceil(p * n_values))`` in ascending order, exactly; null where a key has no value. Ties and repeated rows
    count as often as they come; rows with a null key form a group of their own; no rows give no rows. Without ``probs``
    the first histogram, which has all counts, is the last one, and ``quantiles`` is empty.
    """
    rows = df.select(F.col(key).alias("k"), F.col(value).cast("bigint").alias("v"))
    span = rows.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")).first()
    low, high = (span["low"], span["high"]) if span["low"] is not None else (0, 0)
    levels = max(1, -(-max(1, (high - low).bit_length()) // BITS))
    rows = rows.withColumn("v", F.col("v") - F.lit(low))
    shift = BITS * (levels - 1)
    hist = cut(rows.groupBy("k", F.shiftright("v", shift).alias("bin")).agg(F.count("*").alias("n")))
    totals = hist.groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("bin").isNotNull(), F.col("n")).otherwise(0)).alias("n_values"))
    if not probs:
        return totals.select(F.col("k").alias(key), "n", "n_values", F.array().cast("array<bigint>").alias("quantiles"))
    ranks = F.posexplode(F.array(*(F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n_values"))).cast("bigint") for p in probs)))
    wanted = totals.where("n_values > 0").select("k", ranks.alias("i", "rank"))
    # prefix: the bin's index at this level, from the value's leading bits.
    targets = cut(_locate(hist.where("bin is not null"), wanted))
    for level in range(levels - 2, -1, -1):
        hot = targets.where(F.col("inside") >= FULL_BIN).select("k", "bin").distinct()
        cold = targets.where(F.col("inside") < FULL_BIN).select("k", "bin").distinct()
        keyed = rows.where("v is not null").withColumn("bin", F.shiftright("v", shift))
        shift = BITS * level
        # There are at most rows / FULL_BIN full bins per probability.
        few = span["n"] // FULL_BIN * len(probs) <= 100_000
        on = (keyed["k"].eqNullSafe(hot["k"])) & (keyed["bin"] == hot["bin"])
        of_hot = keyed.join(F.broadcast(hot) if few else hot, on, "left_semi")
        of_cold = keyed.join(cold, (keyed["k"].eqNullSafe(cold["k"])) & (keyed["bin"] == cold["bin"]), "left_semi")
        fine = [x.groupBy("k", "bin", F.shiftright("v", shift).alias("finer")).agg(F.count("*").alias("n")) for x in (of_hot, of_cold)]
        after = cut(_refine(fine[0].unionByName(fine[1]), targets))
        drop(targets)
        targets = after
    found = targets.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "bin"))), lambda x: x["bin"] + F.lit(low)).alias("quantiles"))
    return totals.join(found.withColumnRenamed("k", "k2"), F.col("k").eqNullSafe(F.col("k2")), "left").select(F.col("k").alias(key), "n", "n_values", "quantiles")


def _locate(hist: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k, i, bin, rank, inside): the bin that holds each wanted rank, the rank within it, and its rows."""
    upto = F.sum("n").over(Window.partitionBy("k").orderBy("bin"))
    bins = hist.withColumn("upto", upto).select(F.col("k").alias("bk"), "bin", F.col("n").alias("inside"), "upto")
    hit = wanted.join(bins, F.col("k").eqNullSafe(F.col("bk")) & (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("inside")))
    return hit.select("k", "i", "bin", (F.col("rank") - (F.col("upto") - F.col("inside"))).alias("rank"), "inside")


def _refine(fine: DataFrame, targets: DataFrame) -> DataFrame:
    upto = F.sum("n").over(Window.partitionBy("k", "bin").orderBy("finer"))
    bins = fine.withColumn("upto", upto).select(F.col("k").alias("bk"), F.col("bin").alias("bb"), "finer", F.col("n").alias("inside2"), "upto")
    hit = targets.join(
        bins,
        F.col("k").eqNullSafe(F.col("bk")) & (F.col("bin") == F.col("bb")) & (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("inside2")),
    )
    return hit.select("k", "i", F.col("finer").alias("bin"), (F.col("rank") - (F.col("upto") - F.col("inside2"))).alias("rank"), F.col("inside2").alias("inside"))


def heavy_keys(quantiles: DataFrame, share: float) -> DataFrame:
    """The keys of :func:`key_quantiles` that hold at least ``share`` of all rows."""
    total = quantiles.agg(F.sum("n").alias("total"))
    return quantiles.join(F.broadcast(total), F.col("n") >= F.lit(share) * F.col("total")).drop("total")
