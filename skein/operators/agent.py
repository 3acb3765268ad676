"""Answers to messages: retrieve, route, then draft by an injected caller from the evidence found."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import citations, fill
from skein.operators.services import complete

#: A message that is handed to a person gets this in place of a reply.
ESCALATED = "[ESCALATED]"
PROMPT = "Customer message: {message}\n\nEvidence:\n{evidence}\n\nAnswer from the evidence only and end with CITATIONS: [ids]."


def evidence(ranking: DataFrame, texts: DataFrame, most: int = 3, length: int = 300) -> DataFrame:
    """(query_id, found, evidence): how many documents a ranking (query_id, doc_id, rank) has for a query, and its first as numbered lines."""
    first = ranking.join(texts, "doc_id", "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", F.substring("text", 1, length).alias("text")))).alias("d"))
    line = lambda d: F.concat(F.lit("["), d["rank"].cast("string"), F.lit("] "), d["doc_id"].cast("string"), F.lit(": "), F.coalesce(d["text"], F.lit("")))
    return first.select("query_id", F.size("d").alias("found"), F.array_join(F.transform(F.slice("d", 1, most), line), "\n").alias("evidence"))


def respond(rows: DataFrame, key: str, message: str, route: Column, call: Callable[[str], str], longest: int = 500) -> DataFrame:
    """(key, action, reason_code, layer, reply, citations) of rows that carry ``evidence``, by a route (action, reason_code, layer).

    Rows that are escalated get :data:`ESCALATED` and no citations and nothing is asked for them. The others are drafted by the
    injected caller; its reply is split from the ids that it cites.
    """
    routed = rows.select(F.col(key).cast("string").alias("key"), route.alias("r"), fill(PROMPT, message=F.substring(F.col(message), 1, longest), evidence=F.col("evidence")).alias("prompt"))
    drafts = complete(routed.where("r.action <> 'escalate'").select("key", "prompt").distinct(), [("draft", call)]).select("key", "response")
    both = routed.join(drafts, "key", "left")
    drafted = F.trim(F.regexp_replace("response", r"(?is)CITATIONS:\s*\[[^\]]*\].*$", ""))
    none = F.array().cast("array<string>")
    return both.select(
        F.col("key").alias(key),
        "r.*",
        F.when(F.col("r.action") == "escalate", F.lit(ESCALATED)).otherwise(drafted).alias("reply"),
        F.when(F.col("r.action") == "escalate", none).otherwise(F.coalesce(citations(F.col("response")), none)).alias("citations"),
    )
