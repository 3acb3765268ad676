"""Support threads of one brand, from reply links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.ids import as_key, author_key, clean_id, clean_ids
from skein.operators.graph import connected_components


def thread_ids(rows: DataFrame) -> DataFrame:
    """(id, thread_id) bigint of every message that links to another or is linked to, by components of reply links."""
    key = as_key(F.col("tweet_id"))
    up = rows.select(key.alias("a"), as_key(clean_id(F.col("in_response_to_tweet_id"))).alias("b"))
    down = rows.select(key.alias("a"), F.explode(F.transform(clean_ids(F.col("response_tweet_id")), as_key)).alias("b"))
    comp = connected_components(up.unionByName(down).where("a is not null and b is not null"), "a", "b")
    return comp.select(F.col("node").alias("id"), F.col("component").alias("thread_id"))


def build_threads(rows: DataFrame, handle: str) -> DataFrame:
    """One row per thread in which the handle takes part, a customer writes, and the handle replies more than to redirect.

    (thread_id, tweet_count, customer_turn_count, brand_turn_count, channel_switch, first_customer_message,
    first_customer_created_at, turns). Turns are in order of time, null first, then id. Null texts stay null.
    Each copy of a repeated row counts once. ``turns`` nests a whole thread in one row.
    """
    once = rows.groupBy(as_key(F.col("tweet_id")).alias("id")).agg(*(F.min(c).alias(c) for c in ("author_id", "inbound", "created_at", "text")))
    named = once.join(thread_ids(rows), "id", "left").withColumn("thread_id", F.coalesce("thread_id", "id"))
    brand = F.coalesce(author_key(F.col("author_id")) == handle.lower(), F.lit(False))
    customer = F.coalesce("inbound", F.lit(False))
    moved = T.is_dm_redirect(F.col("text"))
    ours = named.where(brand).select("thread_id").distinct()
    order = F.struct("created_at", "id")
    threads = named.join(ours, "thread_id", "left_semi").groupBy("thread_id").agg(
        F.count("*").alias("tweet_count"),
        F.count_if(customer).alias("customer_turn_count"),
        F.count_if(brand & ~moved).alias("brand_turn_count"),
        F.bool_or(brand & moved).alias("channel_switch"),
        F.min_by(F.when(customer, F.struct("text", "created_at")), F.when(customer, order)).alias("first"),
        F.sort_array(F.collect_list(F.struct("created_at", "id", "author_id", "inbound", "text"))).alias("turns"),
    )
    kept = threads.where("customer_turn_count > 0 and brand_turn_count > 0")
    return kept.select("thread_id", "tweet_count", "customer_turn_count", "brand_turn_count", "channel_switch", F.col("first.text").alias("first_customer_message"), F.col("first.created_at").alias("first_customer_created_at"), "turns")
