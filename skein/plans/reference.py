"""One query per operator of the blueprint, over the message tables, the corpus and the vectors."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.ids import author_key, clean_id
from skein.functions.vectors import dot, unit
from skein.operators import agent, calibration, evaluation, labels, messages, retrieval, routing, sampling, services, threads
from skein.plans.reference_sql import SQL
from skein.session import scratch, table
from skein.sources import files

__all__ = ["QUERIES", "SQL"]

QUERIES = {}
CUTOFF = "2017-11-15"
BRAND = "novafonhelp"


def query(f):
    QUERIES[f.__name__] = f
    return f


# Sources and sinks


@query
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "csv")
    files.write_messages_csv(table(spark, sf, "twcs").where(T.strip(F.col("text")) != ""), path)
    return files.read_messages_csv(spark, path).select("tweet_id", "inbound", F.unix_micros("created_at").alias("micros"), "text")


@query
def json_lines_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    rows, path = table(spark, sf, "labelled"), scratch(spark, "json")
    files.write_json_lines(rows, path)
    return files.read_json_lines(spark, path, rows.schema, "first_customer_message")


@query
def brand_json_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "brand_config").agg(F.count("*").alias("brands"), F.sum("outbound_count").alias("outbound"))
    return files.one_row_json(rows)


@query
def run_log(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "log")
    for name in ("twcs", "documents"):
        files.append_log(table(spark, sf, name).agg(F.lit(name).alias("stage"), F.count("*").alias("n_rows")), path)
    return spark.read.parquet(path)


@query
def intent_report(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "labelled").groupBy(F.col("knn_label").alias("intent")).agg(F.count("*").alias("n"))
    return files.markdown_table(counts, ["intent", "n"], [F.col("intent")])


@query
def golden_csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    rows, path = table(spark, sf, "golden_set"), scratch(spark, "golden")
    files.write_csv(rows, path)
    back = files.read_csv(spark, path, rows.schema)
    return back.withColumn("asked_at", F.unix_micros(T.iso_time(F.col("first_customer_created_at")))).drop("first_customer_created_at")


@query
def calibration_record(spark: SparkSession, sf: str) -> DataFrame:
    rows, alpha, delta, path = _calibration_rows(spark, sf), 0.4, 0.05, scratch(spark, "calibration")
    tau = calibration.conformal_tau(rows, "score", "error", "thread_id", alpha=alpha, delta=delta).select("tau")
    one = calibration.calibration_error(rows, "score", "correct").join(F.broadcast(tau)).select("tau", F.round("ece", 6).alias("ece"), F.lit(alpha).alias("alpha"), F.lit(delta).alias("delta"), "n")
    files.write_json_lines(one, path)
    return files.read_json_lines(spark, path, one.schema)


@query
def full_report(spark: SparkSession, sf: str) -> DataFrame:
    strata = table(spark, sf, "golden_set").groupBy(F.lower(F.trim("difficulty")).alias("difficulty")).agg(F.count("*").alias("n"))
    return files.report("Report", [("Intents", intent_report(spark, sf)), ("Difficulty", files.markdown_table(strata, ["difficulty", "n"], [F.col("difficulty")]))])


@query
def label_choices(spark: SparkSession, sf: str) -> DataFrame:
    return files.choices_xml(table(spark, sf, "taxonomy"))


# Projections, casts, predicates, text


@query
def message_predicates(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf, "twcs").select(
        "tweet_id",
        author_key(F.col("author_id")).alias("author"),
        T.is_dm_redirect(c).alias("dm_redirect"),
        T.is_link_or_blank(c).alias("link_or_blank"),
        T.word_count(c).alias("words"),
        F.size(T.mentions(c)).alias("n_mentions"),
        F.coalesce(c.rlike(T.OTHER_SCRIPT), F.lit(False)).alias("other_script"),
        F.substring(T.strip_leading_mentions(c), 1, 120).alias("head"),
        clean_id(F.col("in_response_to_tweet_id")).alias("parent"),
    )


@query
def mention_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "twcs").select(F.explode(T.mentions(F.col("text"))).alias("handle"))
    return rows.groupBy("handle").agg(F.count("*").alias("n"))


@query
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query
def rounded_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labelled").select("thread_id", T.round_to(F.col("calibrated_conf"), 4).alias("conf"), F.coalesce(T.round_to(F.col("knn_conf"), 4), F.lit(1.0)).alias("raw"))


@query
def quality_gates(spark: SparkSession, sf: str) -> DataFrame:
    checks = {
        "rows": (F.count("*"), 1000, None),
        "text_share": (F.avg(F.col("text").isNotNull().cast("double")), 0.9, 1.0),
        "inbound_share": (F.avg(F.col("inbound").cast("double")), 0.02, 0.35),
    }
    return messages.gates(checks, table(spark, sf, "twcs")).withColumn("value", F.round("value", 6))


@query
def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "taxonomy").select("name", F.col("description").alias("prompt"))
    return services.keyed(rows, "local", "stub").select("name", "key")


@query
def parsed_replies(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("description")
    reply = F.when(n % 3 == 0, F.concat(F.lit('```json\n{"score": '), (n % 5 + 1).cast("string"), F.lit(', "winner": "A"}\n```')))
    reply = reply.when(n % 3 == 1, F.concat(F.lit('oops "score": 4 "winner": "B" CITATIONS: [\'t1\', "'), F.col("name"), F.lit('"]'))).otherwise("no json at all")
    rows = services.parse_replies(table(spark, sf, "taxonomy").withColumn("response", reply))
    return rows.select("name", "score", "winner", F.array_join("citations", ",").alias("cited"))


# Joins, counts, sets


@query
def brand_report(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "brand_config").where("in_known_list").select("handle")
    return messages.brand_report(table(spark, sf, "twcs"), known)


@query
def top_brands(spark: SparkSession, sf: str) -> DataFrame:
    return brand_report(spark, sf).orderBy(F.desc("outbound_count"), "handle").limit(10)


@query
def time_split(spark: SparkSession, sf: str) -> DataFrame:
    return messages.split_counts(messages.replied_to(table(spark, sf, "twcs"), BRAND), "created_at", CUTOFF)


@query
def handles_by_use(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "twcs")
    authors = rows.where("author_id is not null").select(author_key(F.col("author_id")).alias("handle")).distinct()
    listed = table(spark, sf, "brand_config").select("handle")
    named = rows.select(F.explode(T.mentions(F.col("text"))).alias("handle")).distinct()
    every = authors.union(listed).union(named).distinct()
    return every.join(authors.exceptAll(listed.distinct()).select("handle", F.lit(True).alias("unlisted")), "handle", "left").na.fill(False)


@query
def uncalibrated_threads(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labelled")
    return rows.select("thread_id").distinct().join(table(spark, sf, "golden_set").select("thread_id"), "thread_id", "left_anti")


@query
def reply_hygiene(spark: SparkSession, sf: str) -> DataFrame:
    rows = messages.hygiene(table(spark, sf, "twcs"), BRAND)
    return rows.groupBy("dropped").agg(F.count("*").alias("n"))


@query
def hygiene_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where("text is not null").select("text").distinct()
    keyed = rows.select(T.block_key(F.col("text")).alias("b")).groupBy("b").agg(F.count("*").alias("n")).where("n > 1")
    return keyed.select("b.prefix", "b.tens", "n")


@query
def brand_threads(spark: SparkSession, sf: str) -> DataFrame:
    rows = threads.build_threads(table(spark, sf, "twcs"), BRAND)
    return rows.select(F.col("thread_id").cast("string").alias("thread_id"), "tweet_count", "customer_turn_count", "brand_turn_count", "channel_switch", "first_customer_message", F.unix_micros("first_customer_created_at").alias("asked_at"), F.transform("turns", lambda t: t["id"])[0].alias("first_id"))


@query
def thread_averages(spark: SparkSession, sf: str) -> DataFrame:
    rows = threads.build_threads(table(spark, sf, "twcs"), BRAND)
    return rows.agg(F.count("*").alias("threads"), F.round(F.avg("tweet_count"), 6).alias("mean_tweets"), F.count_if("channel_switch").alias("switched"))


# Labels, clusters, vectors


@query
def label_centroids(spark: SparkSession, sf: str) -> DataFrame:
    got = labels.centroids(table(spark, sf, "embeddings"))
    return got.select("label", F.posexplode("centroid").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


@query
def nearest_centroid(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    got = labels.nearest(rows, labels.centroids(rows))
    return got.select("vec_id", F.col("label").alias("nearest"), F.round("conf", 6).alias("conf"), F.round("margin", 6).alias("margin"))


@query
def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.round(dot(e, e), 6).alias("squared"), F.round(dot(unit(e), unit(e)), 6).alias("unit_squared"))


@query
def kmeans_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return labels.kmeans(table(spark, sf, "embeddings"), 10, starts=10).groupBy("cluster", "label").agg(F.count("*").alias("n"))


@query
def cluster_exemplars(spark: SparkSession, sf: str) -> DataFrame:
    return labels.exemplars(table(spark, sf, "embeddings"), "label", "vec_id", 10).select("label", "vec_id", "place")


@query
def taxonomy_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select((F.col("vec_id") % 30).cast("int").alias("cluster"))
    mapped = labels.map_clusters(rows, table(spark, sf, "taxonomy"))
    return labels.coverage(mapped).withColumn("coverage", F.round("coverage", 6))


# Calibration


def _calibration_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "golden_set").where("model_confidence is not null and correct_intent is not null and predicted_intent is not null")
    hit = (F.col("predicted_intent") == F.col("correct_intent")).cast("int")
    return rows.select("thread_id", F.col("model_confidence").alias("score"), hit.alias("correct"), (1 - hit).alias("error"))


@query
def expected_calibration_error(spark: SparkSession, sf: str) -> DataFrame:
    return calibration.calibration_error(_calibration_rows(spark, sf), "score", "correct").withColumn("ece", F.round("ece", 6))


@query
def conformal_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return calibration.conformal_tau(_calibration_rows(spark, sf), "score", "error", "thread_id", alpha=0.4)


@query
def isotonic_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = _calibration_rows(spark, sf)
    model = calibration.fit_isotonic(rows, "score", "correct")
    return calibration.calibrate(rows.select("score").distinct(), model, "score").select("score", F.round("calibrated", 6).alias("calibrated"))


# Retrieval


def _intent_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "taxonomy").select("name", F.concat_ws(" ", "description", "exemplars").alias("body"))
    asked = table(spark, sf, "labelled").groupBy("thread_id").agg(F.min("first_customer_message").alias("message"))
    return retrieval.bm25(docs, "name", "body", asked, "thread_id", "message")


@query
def bm25_intents(spark: SparkSession, sf: str) -> DataFrame:
    return _intent_scores(spark, sf).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query
def bm25_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    scores = retrieval.bm25(docs, "doc_id", "text", table(spark, sf, "taxonomy"), "name", "description")
    return retrieval.ranked(retrieval.normalised(scores), 20).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, doc_id, score): lexical and dense ranks of every intent, fused; the dense vectors are a stand-in's."""
    asked = table(spark, sf, "labelled").groupBy(F.col("thread_id").alias("query_id")).agg(F.min("first_customer_message").alias("m"))
    intents = table(spark, sf, "taxonomy").select(F.col("name").alias("doc_id"), F.concat_ws(" ", "description", "exemplars").alias("m"))
    lexical = retrieval.with_zeros(_intent_scores(spark, sf), asked, intents)
    asked, intents = (retrieval.hashed_terms(x, "m").select(k, "vector") for x, k in ((asked, "query_id"), (intents, "doc_id")))
    dense = retrieval.every_pair(asked, intents, dot)
    return retrieval.fuse([(retrieval.ranked(lexical), 0.4), (retrieval.ranked(dense), 0.6)])


@query
def fused_intents(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.ranked(_hybrid(spark, sf), 5).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query
def fused_metrics(spark: SparkSession, sf: str) -> DataFrame:
    got = retrieval.rank_metrics(retrieval.ranked(_hybrid(spark, sf)), _wanted_intents(spark, sf))
    return got.select(*(F.round(c, 6).alias(c) for c in ("mrr", "recall", "ndcg")), "n")


@query
def reranked_intents(spark: SparkSession, sf: str) -> DataFrame:
    first = retrieval.ranked(_hybrid(spark, sf), 20)
    asked = table(spark, sf, "labelled").groupBy(F.col("thread_id").alias("query_id")).agg(F.min("first_customer_message").alias("query"))
    intents = table(spark, sf, "taxonomy").select(F.col("name").alias("doc_id"), F.col("description").alias("text"))
    rows = first.select("query_id", "doc_id").join(asked.where("query is not null"), "query_id").join(F.broadcast(intents), "doc_id")
    return retrieval.rerank(rows, retrieval.word_overlap).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query
def dense_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = retrieval.dense_top(asked, rows.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), 20)
    return got.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _wanted_intents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labelled").where("knn_label is not null").groupBy(F.col("thread_id").alias("query_id")).agg(F.min("knn_label").alias("doc_id"))


@query
def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    got = retrieval.rank_metrics(retrieval.ranked(_intent_scores(spark, sf)), _wanted_intents(spark, sf))
    return got.select(*(F.round(c, 6).alias(c) for c in ("mrr", "recall", "ndcg")), "n")


@query
def reranked_documents(spark: SparkSession, sf: str) -> DataFrame:
    first = bm25_documents(spark, sf).select("query_id", "doc_id")
    rows = first.join(F.broadcast(table(spark, sf, "taxonomy").select(F.col("name").alias("query_id"), F.col("description").alias("query"))), "query_id")
    rows = rows.join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return retrieval.rerank(rows, retrieval.word_overlap)


# Routing


@query
def rail_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "twcs").withColumn("code", F.coalesce(routing.rail(F.col("text")), F.lit("none")))
    return routing.reason_counts(rows, "code")


@query
def routes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labelled")
    r = routing.route(F.col("first_customer_message"), F.col("calibrated_conf"), F.col("tweet_count"), margin=F.coalesce("knn_margin", F.lit(1.0)))
    return rows.select(r.alias("r")).groupBy("r.action", "r.reason_code", "r.layer").agg(F.count("*").alias("n"))


# Sampling


@query
def lowest_confidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labelled").groupBy("thread_id").agg(F.min(F.coalesce("calibrated_conf", F.lit(1.0))).alias("conf"))
    return rows.orderBy("conf", "thread_id").limit(60)


@query
def golden_strata(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labelled").groupBy("thread_id").agg(F.min(F.coalesce("calibrated_conf", F.lit(1.0))).alias("conf"), F.max("tweet_count").alias("tweets"), F.min("first_customer_message").alias("message"))
    wanted = [("low_confidence", None, F.col("conf"), 60), ("long", F.col("tweets") >= 4, None, 40), ("short", F.length("message") < 20, None, 20), ("rest", None, None, 80)]
    return sampling.strata(rows, "thread_id", wanted).select("thread_id", "stratum")


@query
def golden_set_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labelled").groupBy("thread_id").agg(F.min(F.coalesce("calibrated_conf", F.lit(1.0))).alias("conf"), F.max("tweet_count").alias("tweets"), F.min("first_customer_message").alias("message"))
    wanted = [("low_confidence", None, F.col("conf"), 60), ("long", F.col("tweets") >= 4, None, 40), ("short", F.length("message") < 20, None, 20)]
    return sampling.golden_set(rows, "thread_id", wanted).select("thread_id", "stratum", "double_annotate", "place")


@query
def numbered_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = sampling.sample(table(spark, sf, "golden_set").select("thread_id").distinct(), "thread_id", 100)
    place = F.row_number().over(Window.orderBy("thread_id"))  # a bounded sample
    return rows.select("thread_id", F.floor((place - 1) / 20).cast("int").alias("batch"))


# Evaluation


def _golden(spark: SparkSession, sf: str) -> DataFrame:
    policy = F.coalesce(routing.rail(F.col("first_customer_message")).isNotNull(), F.lit(False)) | (F.coalesce("model_confidence", F.lit(0.5)) < 0.45)
    return table(spark, sf, "golden_set").withColumn("escalated", policy)


@query
def intent_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.accuracy(_golden(spark, sf), "correct_intent", "predicted_intent").withColumn("accuracy", F.round("accuracy", 6))


@query
def intent_f1(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.per_label(_golden(spark, sf), "correct_intent", "predicted_intent").withColumn("f1", F.round("f1", 6))


@query
def macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.per_label(_golden(spark, sf), "correct_intent", "predicted_intent").agg(F.round(F.avg("f1"), 6).alias("macro_f1"))


@query
def escalation_scores(spark: SparkSession, sf: str) -> DataFrame:
    got = evaluation.binary_scores(_golden(spark, sf), "should_escalate", "escalated")
    return got.select(*(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "over_rate")), "n")


@query
def accuracy_interval(spark: SparkSession, sf: str) -> DataFrame:
    rows = _golden(spark, sf).groupBy("thread_id").agg(F.max((F.col("correct_intent") == F.col("predicted_intent")).cast("double")).alias("hit"))
    return sampling.interval(sampling.resample_means(rows, "thread_id", "hit", 2_000)).select(F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


@query
def intent_kappa(spark: SparkSession, sf: str) -> DataFrame:
    rows = _golden(spark, sf)
    plain = evaluation.kappa(rows, "correct_intent", "predicted_intent", weighted=False).withColumn("kind", F.lit("none"))
    return plain.unionByName(evaluation.kappa(rows, "correct_intent", "predicted_intent").withColumn("kind", F.lit("quadratic"))).withColumn("kappa", F.round("kappa", 6))


def _ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Three raters' marks from 1 to 5 of each thread, derived from its confidences."""
    rows = table(spark, sf, "labelled").groupBy("thread_id").agg(F.min("calibrated_conf").alias("a"), F.min("knn_margin").alias("b"), F.min("tweet_count").alias("c"))
    marks = [F.least(F.lit(5), F.floor(F.col("a") * 5) + 1), F.least(F.lit(5), F.floor(F.col("b") * 5) + 1), F.least(F.lit(5), F.col("c"))]
    each = F.array(*(F.struct(F.lit(n).alias("rater"), m.cast("int").alias("score")) for n, m in zip("abc", marks, strict=True)))
    return rows.select(F.col("thread_id").alias("item"), F.explode(each).alias("r")).select("item", "r.*").where("score is not null")


@query
def rater_kappas(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.rater_pairs(_ratings(spark, sf), "item", "rater", "score").withColumn("kappa", F.round("kappa", 6))


@query
def jury_median(spark: SparkSession, sf: str) -> DataFrame:
    return _ratings(spark, sf).groupBy("item").agg(F.percentile("score", F.lit(0.5)).alias("median"), evaluation.rounded_vote(F.col("score")).alias("vote"))


@query
def judge_as_annotator(spark: SparkSession, sf: str) -> DataFrame:
    rows = _ratings(spark, sf)
    got = evaluation.alternative_annotator(rows.where("rater <> 'c'"), rows.where("rater = 'c'").select("item", "score"))
    rounded = [F.round(c, 6).alias(c) for c in ("judge_agreement", "human_agreement", "judge_kappa", "human_kappa")]
    return got.select(*rounded, "verdict", "n_items", "n_raters")


@query
def mean_rater_kappa(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.mean_rater_kappa(_ratings(spark, sf), "item", "rater", "score").withColumn("kappa", F.round("kappa", 6))


@query
def win_rate(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.win_rate(_ratings(spark, sf), "item", "rater", "score", "a", "b").withColumn("win_rate", F.round("win_rate", 6))


@query
def evaluation_record(spark: SparkSession, sf: str) -> DataFrame:
    rows = _golden(spark, sf).where("correct_intent is not null").select("thread_id", "first_customer_message", "correct_intent", "predicted_intent", "should_escalate", "escalated")
    agent = rows.select("*", F.lit("agent").alias("system"), F.col("predicted_intent").alias("pred"), F.col("escalated").alias("flagged"))
    every = agent.unionByName(evaluation.baselines(rows, "thread_id", "correct_intent", routing.rail(F.col("first_customer_message")).isNotNull()))
    got = evaluation.record(every, "system", "thread_id", "correct_intent", "pred", "should_escalate", "flagged")
    return got.select("system", "n", *(F.round(c, 6).alias(c) for c in got.columns if c not in ("system", "n")))


@query
def median_interval(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labelled").groupBy("thread_id").agg(F.max("tweet_count").alias("tweets"))
    got = sampling.resample(rows, "thread_id", "tweets", 200, sampling.weighted_median)
    return sampling.interval(got, stat="stat")


@query
def swapped_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda salt: F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("tie")), (T.draw(salt, F.col("thread_id")) % 3 + 1).cast("int"))
    rows = table(spark, sf, "labelled").select("thread_id").distinct().select(pick(1).alias("order1"), pick(2).alias("order2"))
    return services.swap_verdicts(rows).groupBy("verdict", "same_letter", "same_side").agg(F.count("*").alias("n"))


@query
def score_correlations(spark: SparkSession, sf: str) -> DataFrame:
    got = evaluation.correlations(table(spark, sf, "labelled"), "calibrated_conf", "knn_margin")
    return got.select(F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"), "n")


@query
def correlation_p_values(spark: SparkSession, sf: str) -> DataFrame:
    got = evaluation.correlations(table(spark, sf, "labelled"), "calibrated_conf", "knn_margin")

    def run(frames):
        for f in frames:
            yield pd.DataFrame({c: [evaluation.correlation_p(r, n) for r, n in zip(f[c], f["n"], strict=True)] for c in ("pearson", "spearman")})

    return got.mapInPandas(run, "pearson double, spearman double")


@query
def majority_baseline(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "golden_set").where("correct_intent is not null")
    counts = rows.groupBy("correct_intent").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "correct_intent").limit(1).select(F.col("correct_intent").alias("majority"))
    return rows.join(F.broadcast(top)).groupBy("majority").agg(F.round(evaluation.share(F.col("correct_intent") == F.col("majority")), 6).alias("accuracy"))


@query
def consistent_labels(spark: SparkSession, sf: str) -> DataFrame:
    got = services.consistent(table(spark, sf, "labelled").where("knn_label is not null"), "thread_id", "knn_label")
    return got.withColumn("rate", F.round("rate", 6))


# Services


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "ts", F.col("event_type").alias("provider"))


@query
def call_budget(spark: SparkSession, sf: str) -> DataFrame:
    rows = services.within_budget(_calls(spark, sf), "ts", "provider", "event_id", 50)
    return rows.groupBy("provider", "allowed").agg(F.count("*").alias("n"))


@query
def call_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return services.ledger(_calls(spark, sf), "ts", "provider")


@query
def cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    prompts = services.keyed(table(spark, sf, "labelled").select(F.col("first_customer_message").alias("prompt")).where("prompt is not null").distinct(), "local", "stub")
    cache = services.keyed(table(spark, sf, "golden_set").select(F.col("first_customer_message").alias("prompt")).where("prompt is not null").distinct(), "local", "stub").select("key", F.lit("ok").alias("response"))
    hits, misses = services.lookup(prompts, cache)
    return hits.agg(F.lit("hit").alias("kind"), F.count("*").alias("n")).unionByName(misses.agg(F.lit("miss").alias("kind"), F.count("*").alias("n")))


@query
def stub_answers(spark: SparkSession, sf: str) -> DataFrame:
    prompts = services.keyed(table(spark, sf, "taxonomy").select(F.col("description").alias("prompt")), "local", "stub")
    return services.complete(prompts, [("stub", lambda p: p.upper())])


@query
def provider_chain(spark: SparkSession, sf: str) -> DataFrame:
    def spent(_: str) -> str:
        raise services.BudgetSpent("50 calls")

    def late(p: str) -> str:
        if len(p) % 2:
            raise services.Busy("429")
        return f"late {len(p)}"

    prompts = services.keyed(table(spark, sf, "taxonomy").select(F.col("description").alias("prompt")), "local", "stub")
    got = services.complete(prompts, [("spent", spent), ("late", late), ("last", lambda p: f"last {len(p)}")], wait=lambda s: None, errors=True)
    return got.select("key", "response", "provider", F.array_join("errors", "; ").alias("errors"))


@query
def cached_answers(spark: SparkSession, sf: str) -> DataFrame:
    prompts = services.keyed(table(spark, sf, "labelled").select(F.col("first_customer_message").alias("prompt")).where("prompt is not null"), "local", "stub")
    cache = services.keyed(table(spark, sf, "golden_set").select(F.col("first_customer_message").alias("prompt")).where("prompt is not null").distinct(), "local", "stub")
    got = services.answered(prompts, cache.select("key", F.lit("kept").alias("response"), F.lit("stub").alias("provider")), [("stub", lambda p: "new")])
    return got.groupBy("response", "provider", "cached").agg(F.count("*").alias("n"))


@query
def cache_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return services.cache_stats(_calls(spark, sf))


@query
def ledger_of_first_day(spark: SparkSession, sf: str) -> DataFrame:
    day = _calls(spark, sf).agg(F.date_format(F.min("ts"), "yyyy-MM-dd")).first()[0]
    return services.ledger_of_day(call_ledger(spark, sf), day)


@query
def second_labeller(spark: SparkSession, sf: str) -> DataFrame:
    names = [r[0] for r in table(spark, sf, "taxonomy").select("name").orderBy("name").collect()]  # a taxonomy

    def call(prompt: str) -> str:
        return "```json\n" + json.dumps([names[i % len(names)] for i in range(20)]) + "\n```"

    rows = table(spark, sf, "labelled").groupBy("thread_id").agg(F.min("first_customer_message").alias("m"), F.min("knn_label").alias("first"))
    got = services.second_labels(rows, "thread_id", "m", names, call).join(rows.select("thread_id", "first"), "thread_id")
    return evaluation.accuracy(got, "first", "label").withColumn("accuracy", F.round("accuracy", 6))


@query
def merged_clusters(spark: SparkSession, sf: str) -> DataFrame:
    def call(prompt: str) -> str:
        found = sorted({int(line.split(":")[0].split()[1]) for line in prompt.splitlines() if line.startswith("cluster ")})
        return "Here you are: " + json.dumps([{"name": f"intent_{m}", "source_clusters": [c for c in found if c % 4 == m]} for m in range(3)])

    rows = table(spark, sf, "embeddings").select((F.col("vec_id") % 30).alias("cluster"), F.col("vec_id").cast("string").alias("text"))
    return services.merge_clusters(labels.exemplars(rows, "cluster", "text", 3), "cluster", "text", call)


@query
def agent_answers(spark: SparkSession, sf: str) -> DataFrame:
    def draft(prompt: str) -> str:
        ids = re.findall(r"^\[\d+\] (\S+):", prompt, re.M)
        return f"Thank you. CITATIONS: [{', '.join(ids)}]"

    asked = table(spark, sf, "labelled").groupBy(F.col("thread_id").alias("query_id")).agg(F.min("first_customer_message").alias("m"), F.min("calibrated_conf").alias("conf"), F.min("knn_margin").alias("margin"))
    found = agent.evidence(retrieval.ranked(_intent_scores(spark, sf), 5), table(spark, sf, "taxonomy").select(F.col("name").alias("doc_id"), F.col("description").alias("text")))
    rows = asked.where("m is not null").join(found, "query_id", "left").na.fill({"found": 0, "evidence": ""})
    r = routing.route(F.col("m"), F.col("conf"), F.col("found"), margin=F.coalesce("margin", F.lit(1.0)))
    got = agent.respond(rows, "query_id", "m", r, draft)
    return got.select("query_id", "action", "reason_code", "reply", F.array_join("citations", ",").alias("cited"))
