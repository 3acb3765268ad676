"""Lexical and dense retrieval, rank fusion, reranking and rank metrics, for many queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import draw, tokens
from skein.functions.vectors import unit

K1, B, EPSILON = 1.5, 0.75, 0.25


def bm25(docs: DataFrame, doc_key: str, doc_text: str, queries: DataFrame, key: str, text: str) -> DataFrame:
    """(query_id, doc_id, score) of the documents that share a term with a query; all others score 0.

    A negative idf is replaced by a quarter of the mean idf over all terms of the documents. A query's repeated words count
    as often as they come; null texts have no words. Only words that are asked for become postings, so a word that is in
    every document moves only if a query has it; the document counts of all terms are summed where the documents lie.
    """
    words = docs.select(F.col(doc_key).alias("doc_id"), tokens(F.col(doc_text)).alias("w"))
    n_docs = words.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl"))
    df = words.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(n_docs)).withColumn("raw", F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean = idf.agg(F.avg("raw").alias("mean_idf"))
    asked = queries.select(F.col(key).alias("query_id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    terms = asked.select("term").distinct()
    idf = idf.join(terms, "term", "left_semi").join(F.broadcast(mean)).select("term", "avgdl", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    each = words.select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term")).join(terms, "term", "left_semi")
    postings = each.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    hits = asked.join(idf, "term").join(postings, "term")
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def hashed_terms(rows: DataFrame, text: str, out: str = "vector", dim: int = 16) -> DataFrame:
    """Adds a stand-in for a text encoder: counts of a text's words, hashed to ``dim`` places, as a unit vector; zeros for null."""
    rows = rows.withColumn("_places", F.transform(tokens(F.col(text)), lambda w: draw(0, w) % dim))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter("_places", lambda p: p == i)).cast("double"))
    return rows.withColumn("_counts", counts).withColumn(out, unit(F.col("_counts"))).drop("_places", "_counts")


def embed(rows: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray], out: str = "embedding") -> DataFrame:
    """Adds the unit vector of each text by an injected encoder, which takes a batch of texts and gives a matrix; nulls are ''."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        m = np.asarray(encoder(texts.fillna("").tolist()), np.float32)
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
        return pd.Series(list(m), index=texts.index)

    return rows.withColumn(out, run(F.col(text)))


def every_pair(queries: DataFrame, docs: DataFrame, score: Callable[[Column, Column], Column]) -> DataFrame:
    """(query_id, doc_id, score) of each query (query_id, vector) with each of few documents (doc_id, vector), such as intents.

    The documents go along as one array; for a corpus use :func:`dense_top`.
    """
    listed = docs.agg(F.collect_list(F.struct("doc_id", "vector")).alias("docs"))  # a taxonomy, bounded by its own size
    each = queries.join(F.broadcast(listed)).select("query_id", F.explode(F.transform("docs", lambda d: F.struct(d["doc_id"].alias("doc_id"), score(F.col("vector"), d["vector"]).alias("score")))).alias("d"))
    return each.select("query_id", "d.*")


def with_zeros(scores: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Scores (query_id, doc_id, score) with a 0 for each of few documents (doc_id) that a query (query_id) does not score."""
    listed = docs.agg(F.collect_list("doc_id").alias("docs"))  # as in every_pair
    each = queries.select("query_id").distinct().join(F.broadcast(listed)).select("query_id", F.explode("docs").alias("doc_id"))
    return each.join(scores, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def dense_top(queries: DataFrame, docs: DataFrame, most: int = 20, block: int = 2_000) -> DataFrame:
    """(query_id, doc_id, score, rank) of the ``most`` documents nearest to each query by cosine, both (id bigint, vector).

    The queries are the set that is asked; blocks of them are broadcast and multiplied with all documents where those
    lie. A task keeps only its best of each query. Null vectors are left out; a null or zero vector is near to nothing.
    """
    spark, parts, rows = docs.sparkSession, [], []
    ready = docs.where("doc_id is not null and vector is not null").select("doc_id", F.col("vector").cast("array<double>").alias("vector"))

    def scan(shared):
        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best_s, best_d = np.full((len(ids), most), -np.inf), np.full((len(ids), most), np.iinfo(np.int64).max)
            for batch in batches:
                if not batch.num_rows:
                    continue
                d = batch.column(0).to_numpy(zero_copy_only=False)
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                s = np.concatenate([best_s, np.round(q @ v.T, 9)], axis=1)
                d = np.concatenate([best_d, np.broadcast_to(d, (len(ids), len(d)))], axis=1)
                order = np.lexsort((d, -s), axis=1)[:, :most]
                best_s, best_d = np.take_along_axis(s, order, 1), np.take_along_axis(d, order, 1)
            full = np.isfinite(best_s)
            who = np.repeat(ids, full.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(best_d[full]), pa.array(best_s[full])], ["query_id", "doc_id", "score"])

        return over

    def flush() -> None:
        q = np.array([v for _, v in rows], float)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        shared = spark.sparkContext.broadcast((np.array([i for i, _ in rows], np.int64), q))
        parts.append(ready.mapInArrow(scan(shared), "query_id bigint, doc_id bigint, score double"))
        rows.clear()

    for r in queries.where("query_id is not null and vector is not null").toLocalIterator():
        rows.append((r["query_id"], r["vector"]))
        if len(rows) == block:
            flush()
    if rows:
        flush()
    if not parts:
        return spark.createDataFrame([], "query_id bigint, doc_id bigint, score double, rank int")
    return ranked(reduce(DataFrame.unionByName, parts), most)


def normalised(scores: DataFrame) -> DataFrame:
    """Scores divided by the query's largest, if that is positive."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    return scores.withColumn("score", F.when(top > 0, F.col("score") / top).otherwise(F.col("score")))


def ranked(scores: DataFrame, most: int | None = None) -> DataFrame:
    """Adds ``rank`` from 0, by score, then doc_id; with ``most`` only the first ones stay."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    out = scores.withColumn("rank", F.row_number().over(order) - 1)
    return out if most is None else out.where(F.col("rank") < most)


def fuse(lists: list[tuple[DataFrame, float]], k: int = 60) -> DataFrame:
    """(query_id, doc_id, score): weighted reciprocal rank fusion of ranked lists; what a list lacks adds nothing."""
    parts = None
    for rows, weight in lists:
        one = rows.select("query_id", "doc_id", (F.lit(weight) / (F.lit(k) + F.col("rank") + 1)).alias("part"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))


def rerank(candidates: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], most: int = 5) -> DataFrame:
    """The first ``most`` of (query_id, doc_id, query, text) by an injected scorer that takes whole batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[["query_id", "doc_id"]].assign(score=scorer(f["query"], f["text"]).astype(float))

    kinds = {c: t for c, t in candidates.dtypes if c in ("query_id", "doc_id")}
    return ranked(candidates.mapInPandas(run, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double"), most)


def word_overlap(queries: pd.Series, texts: pd.Series) -> pd.Series:
    """A stand-in for a cross-encoder: the share of a query's words that the text has."""
    pairs = ((set(str(q).lower().split()), set(str(t).lower().split())) for q, t in zip(queries, texts, strict=True))
    return pd.Series([len(a & b) / max(1, len(a)) for a, b in pairs], index=queries.index)


def rank_metrics(ranking: DataFrame, relevant: DataFrame, at: int = 5) -> DataFrame:
    """One row (mrr, recall, ndcg, n) for one relevant document per query of (query_id, doc_id); a miss counts 0."""
    found = relevant.join(ranking.select("query_id", "doc_id", (F.col("rank") + 1).alias("r")), ["query_id", "doc_id"], "left")
    hit = F.col("r") <= at
    return found.agg(
        F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))).alias("mrr"),
        F.avg(F.coalesce(hit.cast("double"), F.lit(0.0))).alias("recall"),
        F.avg(F.when(hit, 1 / F.log2(F.col("r") + 1)).otherwise(0.0)).alias("ndcg"),
        F.count("*").alias("n"),
    )
