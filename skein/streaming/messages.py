"""Message streams: counts by window, and references still waiting for their message."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.ids import author_key, clean_id


def read_messages(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream of message rows."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def author_counts(stream: DataFrame, window: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """(window, author, n, inbound): messages per window and author; rows later than the watermark, or without a time, are left out."""
    timed = stream.where("created_at is not null").withWatermark("created_at", late)
    return timed.groupBy(F.window("created_at", window, slide or window), author_key(F.col("author_id")).alias("author")).agg(
        F.count("*").alias("n"), F.count_if(F.coalesce("inbound", F.lit(False))).alias("inbound")
    )


def first_copies(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """The first copy of each tweet_id within the watermark; state for older ids is dropped."""
    return stream.where("created_at is not null").withWatermark("created_at", late).dropDuplicatesWithinWatermark(["tweet_id"])


def replies(stream: DataFrame, late: str = "2 days", wait: str = "1 day") -> DataFrame:
    """(tweet_id, parent_id, created_at, parent_at) of messages and the messages they answer, joined as both arrive.

    A pair is found if the answer is at most ``wait`` after what it answers.
    """
    timed = stream.where("created_at is not null")
    asked = timed.select(F.col("tweet_id").alias("parent_id"), F.col("created_at").alias("parent_at")).withWatermark("parent_at", late)
    said = timed.select("tweet_id", clean_id(F.col("in_response_to_tweet_id")).alias("ref"), "created_at").where("ref is not null").withWatermark("created_at", late)
    near = (F.col("created_at") >= F.col("parent_at")) & (F.col("created_at") <= F.col("parent_at") + F.expr(f"interval {wait}"))
    return said.join(asked, (F.col("ref") == F.col("parent_id")) & near).select("tweet_id", "parent_id", "created_at", "parent_at")
