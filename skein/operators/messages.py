"""Cleaning, counting and splitting of message rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.ids import author_key, clean_id


def cast_messages(raw: DataFrame) -> DataFrame:
    """All-string rows with inbound as boolean (True, False, else null) and created_at as time (null if malformed)."""
    inbound = F.when(F.col("inbound") == "True", True).when(F.col("inbound") == "False", False)
    # The weekday's name says nothing new, and Spark's parser takes none.
    at = F.try_to_timestamp(F.substring("created_at", 5, 40), F.lit("MMM dd HH:mm:ss Z yyyy"))
    return raw.withColumns({"inbound": inbound, "created_at": at})


def brand_report(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(handle, outbound_count, mention_count, in_known_list) of all who write outbound or are mentioned inbound.

    Handles count in one spelling (:func:`skein.functions.ids.author_key`). Rows with a null ``inbound`` count for neither.
    ``known`` has the column ``handle``.
    """
    out = rows.where("inbound = false and author_id is not null").groupBy(author_key(F.col("author_id")).alias("handle")).agg(F.count("*").alias("outbound_count"))
    named = rows.where("inbound").select(F.explode(T.mentions(F.col("text"))).alias("handle")).groupBy("handle").agg(F.count("*").alias("mention_count"))
    both = out.join(named, "handle", "full_outer").na.fill(0, ["outbound_count", "mention_count"])
    listed = known.select(author_key(F.col("handle")).alias("handle"), F.lit(True).alias("in_known_list")).distinct()
    return both.join(listed, "handle", "left").na.fill(False, ["in_known_list"])


def replied_to(rows: DataFrame, handle: str) -> DataFrame:
    """Inbound messages that a handle, however spelled, replied to; links count after cleaning."""
    answers = rows.where(author_key(F.col("author_id")) == handle.lower()).select(clean_id(F.col("in_response_to_tweet_id")).alias("tweet_id"))
    return rows.where("inbound").join(answers, "tweet_id", "left_semi")


def split_counts(rows: DataFrame, when: str, cutoff: str) -> DataFrame:
    """One row (train, test): rows before a time, and from it on; a null time is in neither."""
    at = F.lit(cutoff).cast("timestamp")
    return rows.agg(F.count_if(F.col(when) < at).alias("train"), F.count_if(F.col(when) >= at).alias("test"))


def gates(checks: dict[str, tuple[Column, float | None, float | None]], rows: DataFrame) -> DataFrame:
    """(gate, value, passed) per check name -> (aggregate, least, most): data-quality checks that report and never stop."""
    values = rows.agg(*(agg.cast("double").alias(name) for name, (agg, _, _) in checks.items()))
    long = values.select(F.explode(F.create_map(*(x for name in checks for x in (F.lit(name), F.col(name))))).alias("gate", "value"))
    ok = F.lit(True)
    for name, (_, least, most) in checks.items():
        fits = (F.col("value") >= least if least is not None else F.lit(True)) & (F.col("value") <= most if most is not None else F.lit(True))
        ok = F.when(F.col("gate") == name, fits).otherwise(ok)
    return long.withColumn("passed", F.coalesce(ok, F.lit(False)))


def similarity(a: str, b: str) -> float:
    """1 - insertions and deletions from one to the other, by both lengths: twice the longest common subsequence."""
    if not a and not b:
        return 1.0
    # Bit-parallel longest common subsequence: a bit of ``row`` is 0 where the subsequence grows.
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def greedy_copies(texts: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(text) of near-copies among (text): within a block, in order of the text, each is dropped that is like one kept before.

    Which copy is dropped depends on those kept before it, so the distinct texts of one block go to one task
    (:func:`skein.functions.text.block_key`); for whole corpora the near-duplicate groups of ``skein.llm`` have no such limit.
    """

    def drop(block: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(block["text"])
        # How often each of 64 classes of characters occurs: no common subsequence is longer than what two texts share of it.
        counts = np.stack([np.bincount(np.frombuffer(t.encode("utf-32-le"), np.uint32) % 64, minlength=64) for t in rows]).astype(np.int32)
        lengths, kept, out = np.array([len(t) for t in rows]), np.zeros(len(rows), bool), []
        for i, t in enumerate(rows):
            near = np.flatnonzero(kept[:i])
            most = np.minimum(counts[near], counts[i]).sum(axis=1)
            if any(similarity(rows[k], t) >= threshold for k in near[2 * most >= threshold * (lengths[near] + len(t))]):
                out.append(t)
            else:
                kept[i] = True
        return pd.DataFrame({"text": pd.Series(out, dtype=object)})

    keyed = texts.where("text is not null").distinct().withColumn("block", T.block_key(F.col("text")))
    several = keyed.groupBy("block").count().where("count > 1").select("block")
    return keyed.join(several, "block", "left_semi").groupBy("block").applyInPandas(drop, "text string")


def hygiene(rows: DataFrame, handle: str) -> DataFrame:
    """A handle's replies with a column ``dropped``: dm_redirect, link_or_blank, near_copy, or null for those kept."""
    own = rows.where(author_key(F.col("author_id")) == handle.lower()).withColumn("norm", F.coalesce(T.strip_leading_mentions(F.col("text")), F.lit("")))
    first = F.when(T.is_dm_redirect(F.col("text")), "dm_redirect").when(T.is_link_or_blank(F.col("text")), "link_or_blank")
    own = own.withColumn("dropped", first)
    copies = greedy_copies(own.where("dropped is null").select(F.col("norm").alias("text"))).select(F.col("text").alias("norm"), F.lit(True).alias("copy"))
    return own.join(copies, "norm", "left").withColumn("dropped", F.when(F.col("dropped").isNull() & F.col("copy"), "near_copy").otherwise(F.col("dropped"))).drop("copy", "norm")


def batches(items: Iterator, size: int) -> Iterator[list]:
    """Lists of up to ``size`` consecutive items."""
    kept: list = []
    for x in items:
        kept.append(x)
        if len(kept) == size:
            yield kept
            kept = []
    if kept:
        yield kept
