"""Mixing sources to target shares of the tokens, by Sainte-Laguë apportionment."""

from __future__ import annotations

import heapq
import random
from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokenizer files of the public_tokenizers folder.
TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER_FILE = "byte_bpe_50k.json"
#: Most shards of a source, and about how many blocks each has below that.
SHARDS, SHARD_BLOCKS = 4_096, 64


def source_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def count_pieces(c: Column) -> Column:
    """Pieces between white space (no-break space included); 0 for null."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"[\s\p{Z}]+"), lambda x: x != "")).cast("bigint")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def count_tokens(c: Column, path: str = f"{TOKENIZER_DIR}/{TOKENIZER_FILE}") -> Column:
    """Tokens of a public tokenizer; 0 for null."""

    @F.pandas_udf(T.LongType())
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = _tokenizer(path)
        for batch in texts:
            yield pd.Series([len(e.ids) for e in tokenizer.encode_batch(batch.fillna("").tolist(), add_special_tokens=False)], dtype="int64")

    return run(c)


def supply(docs: DataFrame, targets: DataFrame, source: str = "source", tokens: str = "tokens") -> DataFrame:
    """(source, target_share, max_repeats, n_docs, tokens, total_tokens, reachable) of every target source.

    Sources are compared trimmed and lower-cased; documents without one count nowhere. ``total_tokens`` is that of all
    documents with a source, and ``reachable`` says whether the source's tokens times ``max_repeats`` reach its share of
    it. A target without documents has 0 tokens. Of repeated targets the largest share and cap count.
    """
    each = docs.where(F.col(source).isNotNull()).groupBy(source_key(F.col(source)).alias("source")).agg(F.count("*").alias("n_docs"), F.sum(tokens).alias("tokens"))
    total = each.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"))
    wanted = targets.where("source is not null").groupBy(source_key(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    out = wanted.join(each, "source", "left").join(F.broadcast(total)).na.fill(0, ["n_docs", "tokens"])
    return out.withColumn("reachable", F.col("tokens") * F.col("max_repeats") >= F.col("target_share") * F.col("total_tokens"))


def apportion(shares: np.ndarray, caps: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients share / (2 * given + 1), none beyond its cap; ties go to the first.

    A common divisor gives all seats whose quotients are surely among the highest at once; only the last ones, no more than
    there are parties, are given one by one. Fewer than ``seats`` are given only if all caps are reached.
    """
    shares, caps = np.asarray(shares, float), np.where(np.asarray(shares, float) > 0, np.asarray(caps, np.int64), 0)
    if not len(caps) or seats >= caps.sum():
        return caps

    def at(x: float) -> np.ndarray:
        return np.minimum(caps, np.floor(shares * x + 0.5).astype(np.int64))

    low, high = 0.0, 1.0
    while at(high).sum() <= seats:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if at(middle).sum() <= seats else (low, middle)
    given = at(low * (1 - 1e-9))
    heap = [(-shares[i] / (2 * given[i] + 1), i) for i in range(len(shares)) if given[i] < caps[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(given.sum())):
        _, i = heapq.heappop(heap)
        given[i] += 1
        if given[i] < caps[i]:
            heapq.heappush(heap, (-shares[i] / (2 * given[i] + 1), i))
    return given


def sainte_lague(shares: dict[str, float], caps: dict[str, int], seats: int) -> dict[str, int]:
    """:func:`apportion` by name; ties go to the name first in the alphabet."""
    names = sorted(shares)
    return dict(zip(names, apportion([shares[n] for n in names], [caps[n] for n in names], seats).tolist(), strict=True))


def quotas(docs: DataFrame, targets: DataFrame, block: int, source: str = "source", tokens: str = "tokens", blocks: int | None = None) -> list[dict]:
    """One entry per target source: what :func:`supply` says, with ``cap``, the blocks it can give, and ``quota``, those it gives.

    By default the mix has as many blocks as the source that runs out first allows. A source without a single block, such as
    one without documents, can hold no share; it has quota 0 and does not limit the others.
    """
    have = [r.asDict() for r in supply(docs, targets, source, tokens).collect()]  # one row per target source
    for r in have:
        r["cap"] = int(r["tokens"]) * int(r["max_repeats"] or 0) // block
    shares, caps = {r["source"]: float(r["target_share"] or 0) for r in have}, {r["source"]: r["cap"] for r in have}
    if blocks is None:
        blocks = int(min((caps[s] / share for s, share in shares.items() if share > 0 and caps[s] > 0), default=0))
    given = sainte_lague(shares, caps, blocks)
    return [r | {"quota": given[r["source"]]} for r in have]


def mix(docs: DataFrame, targets: DataFrame, block: int, seed: int = 0, key: str = "doc_id", source: str = "source", tokens: str = "tokens", blocks: int | None = None) -> DataFrame:
    """(doc_id, source, tokens, repeats): how often each document is used; every document of a used source at most ``max_repeats`` times.

    The mix has ``blocks`` blocks of ``block`` tokens (:func:`quotas`), apportioned to the sources and again, by the same
    rule, to the shards of each source: up to ``SHARDS`` parts of its documents by a seeded hash, so that a large source
    is spread over many tasks. A shard's documents, in hash order, are cut into blocks of equal tokens, as near as whole
    documents allow. Its quota takes every block as often as it is a multiple of their number, and the rest from a
    seeded permutation of them.

    Documents without a source, or of a source without a target, are not used. Null texts have 0 tokens and are used
    with their block. Extra columns are ignored; a repeated key is a document each time.
    """
    ready = docs.where(F.col(source).isNotNull()).select(F.col(key).alias("doc_id"), source_key(F.col(source)).alias("source"), F.coalesce(tokens, F.lit(0)).alias("tokens"))
    have = {r["source"]: r for r in quotas(ready, targets, block, blocks=blocks) if r["quota"] > 0}
    spark = docs.sparkSession
    split = [(s, max(1, min(SHARDS, r["tokens"] // (block * SHARD_BLOCKS)))) for s, r in have.items()]
    parts = spark.createDataFrame(split, "source string, shards bigint")  # one row per target source
    ready = ready.join(F.broadcast(parts), "source").withColumn("order", F.xxhash64(F.lit(seed), "source", "doc_id"))
    ready = ready.withColumn("shard", F.pmod(F.shiftright("order", 16), F.col("shards")))
    totals: dict[str, list] = {s: [] for s in have}
    for r in ready.groupBy("source", "shard").agg(F.sum("tokens").alias("n")).where("n > 0").collect():  # at most SHARDS rows per target source
        totals[r["source"]].append((r["shard"], r["n"]))
    plan = []
    for name, own in totals.items():
        own.sort()
        n = np.array([t for _, t in own], np.int64)
        pieces = np.maximum(1, np.round(n / block).astype(np.int64))
        quota = apportion(n, pieces * have[name]["max_repeats"], have[name]["quota"])
        for (shard, size), k, q in zip(own, pieces.tolist(), quota.tolist(), strict=True):
            r = random.Random(f"{seed}/{name}/{shard}")
            step = next(x for x in iter(lambda k=k, r=r: r.randrange(1, k + 1), 0) if gcd(x, k) == 1)
            plan.append((name, shard, size, k, q // k, q % k, step, r.randrange(k)))
    plan = spark.createDataFrame(plan, "source string, shard bigint, size bigint, pieces bigint, whole bigint, rest bigint, step bigint, start bigint")
    ready = ready.join(F.broadcast(plan), ["source", "shard"])
    before = F.sum("tokens").over(Window.partitionBy("source", "shard").orderBy("order", "doc_id")) - F.col("tokens")
    piece = F.least(F.floor(before * F.col("pieces") / F.col("size")), F.col("pieces") - 1)
    picked = F.pmod(piece * F.col("step") + F.col("start"), F.col("pieces")) < F.col("rest")
    used = ready.withColumn("repeats", F.col("whole") + picked.cast("bigint"))
    return used.where("repeats > 0").select("doc_id", "source", "tokens", "repeats")


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, n_docs, max_used) of a mix; a source that gave nothing has share 0."""
    each = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("n_docs"), F.max("repeats").alias("max_used"))
    total = each.agg(F.sum("tokens").alias("all_tokens"))
    wanted = targets.where("source is not null").select(source_key(F.col("source")).alias("source"), "target_share")
    out = wanted.join(each, "source", "left").join(F.broadcast(total)).na.fill(0, ["tokens", "n_docs", "max_used", "all_tokens"])
    return out.select("source", "target_share", F.coalesce(F.try_divide("tokens", "all_tokens"), F.lit(0.0)).alias("actual_share"), "tokens", "n_docs", "max_used")
