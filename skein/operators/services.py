"""Calls of outside services as tables: cached answers, budgets, and what a reply says."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import cache_key, citations, fill, json_array, lenient_json
from skein.operators.sampling import sample


def keyed(prompts: DataFrame, provider: str, model: str) -> DataFrame:
    return prompts.withColumn("key", cache_key(F.lit(provider), F.lit(model), F.col("prompt")))


def lookup(prompts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of keyed prompts against a cache (key, response)."""
    return prompts.join(cache.select("key", "response"), "key"), prompts.join(cache, "key", "left_anti")


def within_budget(calls: DataFrame, when: str, provider: str, order: str, limit: int) -> DataFrame:
    """Adds ``allowed``: whether a call is among the first ``limit`` of its provider and UTC day. ``order`` is unique.

    Only the first calls of a day are ranked together: each task drops what cannot be among them before the shuffle.
    """
    day = F.date_format(when, "yyyy-MM-dd")
    place = F.row_number().over(Window.partitionBy(day, provider).orderBy(when, order))
    first = calls.withColumn("_place", place).where(F.col("_place") <= limit).select(order, F.lit(True).alias("allowed"))
    return calls.join(first, order, "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def ledger(calls: DataFrame, when: str, provider: str) -> DataFrame:
    """(day_key, calls): calls per day and provider, the key written day/provider."""
    return calls.groupBy(F.concat_ws("/", F.date_format(when, "yyyy-MM-dd"), F.col(provider)).alias("day_key")).agg(F.count("*").alias("calls"))


def ledger_of_day(counts: DataFrame, day: str) -> DataFrame:
    """(provider, calls) of one day of a ledger: its keys taken apart again."""
    parts = F.split("day_key", "/", 2)
    return counts.where(parts[0] == day).select(parts[1].alias("provider"), "calls")


def cache_stats(cache: DataFrame, provider: str = "provider") -> DataFrame:
    """(provider, n, total): cached answers per provider, ``unknown`` where it is null, and in all."""
    per = cache.groupBy(F.coalesce(F.col(provider), F.lit("unknown")).alias("provider")).agg(F.count("*").alias("n"))
    return per.join(F.broadcast(per.agg(F.sum("n").alias("total"))))


class Busy(Exception):
    """The provider asks to be called later: it is called again after a wait."""


class BudgetSpent(Exception):
    """The provider's calls of the day are used up: the next one is called."""


class Unavailable(Exception):
    """The provider cannot be used here: the next one is called."""


def _is_busy(e: Exception) -> bool:
    return isinstance(e, Busy) or "429" in str(e) or "rate limit" in str(e).lower()


def complete(prompts: DataFrame, providers: list[tuple[str, Callable[[str], str]]], attempts: int = 5, wait: Callable[[float], None] = time.sleep, errors: bool = False) -> DataFrame:
    """(key, response, provider[, errors]): each prompt to the first provider that answers; null if none does.

    A provider that is busy (:class:`Busy`, or an error that says so) is called up to ``attempts`` times, after waits of 1, 2,
    4 ... seconds; after any other error the next one is called. ``errors`` lists what each provider that failed said
    last, written provider: class: message. The callables and the wait are injected: the library itself calls nothing.
    """

    def ask(prompt: str) -> tuple[str | None, str | None, list[str]]:
        said: list[str] = []
        for name, call in providers:
            for i in range(attempts):
                try:
                    return call(prompt), name, said
                except Exception as e:  # noqa: BLE001
                    last = f"{name}: {type(e).__name__}: {e}"
                    if not _is_busy(e) or i + 1 == attempts:
                        break
                    wait(2.0**i)
            said.append(last)
        return None, None, said

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [ask(p) for p in f["prompt"]]
            out = {"key": f["key"], "response": [g[0] for g in got], "provider": [g[1] for g in got]}
            yield pd.DataFrame(out | ({"errors": [g[2] for g in got]} if errors else {}))

    return prompts.select("key", "prompt").mapInPandas(run, "key string, response string, provider string" + (", errors array<string>" if errors else ""))


def answered(prompts: DataFrame, cache: DataFrame, providers: list[tuple[str, Callable[[str], str]]], **options) -> DataFrame:
    """(key, response, provider, cached) of keyed prompts: from the cache (key, response, provider) if it has them, else by a call.

    Equal prompts are asked once. With a cache that has everything nothing is called.
    """
    wanted = prompts.groupBy("key").agg(F.min("prompt").alias("prompt"))
    kept = cache.groupBy("key").agg(F.min_by("response", F.struct("provider", "response")).alias("response"), F.min("provider").alias("provider"))
    hits = wanted.join(kept, "key").select("key", "response", "provider", F.lit(True).alias("cached"))
    asked = complete(wanted.join(kept, "key", "left_anti"), providers, **options).select("key", "response", "provider")
    return hits.unionByName(asked.withColumn("cached", F.lit(False)))


def second_labels(rows: DataFrame, key: str, text: str, names: list[str], call: Callable[[str], str], n: int = 300, size: int = 20, seed: int = 42) -> DataFrame:
    """(key, label) of a second labeller for a sample of ``n`` rows, asked in batches of ``size``; null where its reply lacks one.

    The reply to a batch is a JSON array of labels in the batch's order, perhaps fenced; a label not among ``names`` is null.
    """
    some = sample(rows.select(F.col(key).alias("id"), F.col(text).alias("t")), "id", n, seed)
    placed = some.withColumn("place", F.row_number().over(Window.orderBy("id")) - 1)  # a bounded sample
    batch = placed.groupBy(F.floor(F.col("place") / size).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("place", "id", "t"))).alias("rows"))
    lines = F.array_join(F.transform("rows", lambda r: F.concat((r["place"] % size).cast("string"), F.lit(". "), F.coalesce(r["t"], F.lit("")))), "\n")
    prompt = fill("Label each message with one of: {names}. Return a JSON array of labels.\n{lines}", names=F.lit(", ".join(names)), lines=lines)
    asked = batch.select(F.col("batch").cast("string").alias("key"), prompt.alias("prompt"), F.col("rows.id").alias("ids"))
    got = asked.select("key", "ids").join(complete(asked, [("labeller", call)]).select("key", "response"), "key")
    labels = F.from_json(json_array(F.col("response")), "array<string>")
    each = got.select(F.posexplode("ids").alias("i", key), labels.alias("labels"))
    label = F.try_element_at("labels", F.col("i") + 1)
    return each.select(key, F.when(label.isin(names), label).alias("label"))


def merge_clusters(exemplars: DataFrame, cluster: str, text: str, call: Callable[[str], str]) -> DataFrame:
    """(name, cluster): clusters joined into named intents by an injected caller, from their exemplars (a bounded number).

    The reply is a JSON array of {name, source_clusters}. Clusters that the reply lacks are ``out_of_scope``; of several names
    the first counts.
    """
    per = exemplars.groupBy(F.col(cluster).alias("cluster")).agg(F.array_join(F.array_sort(F.collect_list(text)), " | ").alias("t"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("cluster", "t"))), lambda r: F.concat(F.lit("cluster "), r["cluster"].cast("string"), F.lit(": "), r["t"]))
    prompt = per.agg(F.lit("merge").alias("key"), F.array_join(lines, "\n").alias("prompt"))
    found = complete(prompt, [("merger", call)]).select(F.explode(F.from_json(json_array(F.col("response")), "array<struct<name:string,source_clusters:array<bigint>>>")).alias("r"))
    named = found.select("r.name", F.explode("r.source_clusters").alias("cluster")).groupBy("cluster").agg(F.min("name").alias("name"))
    return per.select(F.col("cluster").cast("bigint").alias("cluster")).join(named, "cluster", "left").select(F.coalesce("name", F.lit("out_of_scope")).alias("name"), "cluster")


def parse_replies(rows: DataFrame, reply: str = "response") -> DataFrame:
    """Adds score (3 if none is found), winner (tie if none) and citations of a judge's or an agent's reply."""
    return rows.withColumns({
        "score": lenient_json(F.col(reply), "score", r'"score"\s*:\s*(\d)', F.lit("3")).try_cast("int"),
        "winner": lenient_json(F.col(reply), "winner", r'"winner"\s*:\s*"([AB]|tie)"', F.lit("tie")),
        "citations": citations(F.col(reply)),
    })


def swap_verdicts(rows: DataFrame) -> DataFrame:
    """Adds verdict, same_letter and same_side to (order1, order2), the winners A, B or tie in both orders.

    In the second order the sides are swapped: ``verdict`` is the side that won both, else tie. ``same_letter`` compares
    the raw letters, as is sometimes reported; ``same_side`` compares what they stand for.
    """
    side = lambda c, a, b: F.when(F.col(c) == "A", a).when(F.col(c) == "B", b).otherwise("tie")
    one, two = side("order1", "agent_win", "baseline_win"), side("order2", "baseline_win", "agent_win")
    return rows.withColumns({"verdict": F.when(one == two, one).otherwise("tie"), "same_letter": F.col("order1") == F.col("order2"), "same_side": one == two})


def consistent(runs: DataFrame, item: str, reply: str) -> DataFrame:
    """One row (rate, n): items whose replies are all the same."""
    per = runs.groupBy(item).agg((F.count_distinct(reply) == 1).alias("same"))
    return per.agg(F.avg(F.col("same").cast("double")).alias("rate"), F.count("*").alias("n"))
