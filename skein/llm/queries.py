"""Queries of the text problems, named pN_..., with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.ids import as_key
from skein.llm import conversations, language, leakage, mixing, neardup, pii, spans
from skein.llm.sql import SQL
from skein.session import cut, table

__all__ = ["QUERIES", "SQL"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = conversations.rebuild(table(spark, sf_dir, "twcs"))
    return got.select(F.col("conv").cast("string").alias("conv_id"), "turn_no", F.col("id").cast("string").alias("tweet_id"), "role")


def p1_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = conversations.rebuild(table(spark, sf_dir, "twcs"), infer=True)
    return got.select(*(F.col(c).cast("string").alias(n) for c, n in (("conv", "conv_id"), ("id", "tweet_id"), ("parent", "parent_id"))), "turn_no", "role", "score")


def p1_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of inferred conversations: turns are numbered without a gap, and a parent that is a turn is one of the same conversation."""
    got = cut(p1_threads(spark, sf_dir))
    numbered = got.groupBy("conv_id").agg((F.max("turn_no") == F.count_distinct("turn_no")).alias("ok")).agg(F.bool_and("ok").alias("numbered"))
    other = got.select(F.col("tweet_id").alias("parent_id"), F.col("conv_id").alias("of_parent"))
    joined = got.join(other, "parent_id").agg(F.coalesce(F.bool_and(F.col("conv_id") == F.col("of_parent")), F.lit(True)).alias("joined"))
    return numbered.join(F.broadcast(joined))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tweets = table(spark, sf_dir, "twcs")
    got = pii.items(tweets, names=pii.learn_names(tweets)).where(F.col("kind").isin(*pii.KINDS))
    return got.select(F.col("key").alias("tweet_id"), "kind", "value").distinct()


SECRET = "a secret of the deployment"


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    tweets = table(spark, sf_dir, "twcs")
    return tweets.select("tweet_id", pii.redacted(F.col("text"), SECRET, pii.learn_names(tweets)).alias("text"))


def p3_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of the pseudonyms of a corpus: equal items share one and no others do, each leads back, and each is in its text."""
    tweets = table(spark, sf_dir, "twcs")
    names = pii.learn_names(tweets)
    holders = F.size(F.regexp_extract_all("text", F.lit(r"\[(?:EMAIL|PHONE|ID_NUMBER|ADDRESS|NAME|BIRTH_DATE) "), F.lit(0)))
    placed = tweets.select(pii.redacted(F.col("text"), SECRET, names).alias("text")).agg(F.sum(holders).alias("placed"))
    found = cut(pii.items(tweets.withColumn("tweet_id", F.coalesce("tweet_id", F.lit(""))), names=names))
    counts = found.agg(F.count("*").alias("n")).join(F.broadcast(placed))
    return pii.audit(found, SECRET).join(F.broadcast(counts)).select("linked", "inverted", (F.col("n") == F.col("placed")).alias("placed"))


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tweets = table(spark, sf_dir, "twcs").select(as_key(F.col("tweet_id")).alias("id"), "text")
    return neardup.near_duplicates(tweets, "id", "text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neardup.expand(*_near(spark, sf_dir))
    return pairs.select(F.col("a").cast("string").alias("tweet_id_a"), F.col("b").cast("string").alias("tweet_id_b"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = neardup.groups(*_near(spark, sf_dir))
    return got.select(*(F.col(c).cast("string").alias(n) for c, n in (("id", "tweet_id"), ("rep", "class_id"), ("group", "group_id"))), "links")


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    tweets = table(spark, sf_dir, "twcs").select(F.lit("twcs").alias("src_table"), F.col("tweet_id").alias("record_id"), "text")
    golden = table(spark, sf_dir, "golden_set").select(F.lit("golden_set").alias("src_table"), F.col("thread_id").alias("record_id"), F.col("first_customer_message").alias("text"))
    return tweets.unionByName(golden)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spoken(spark, sf_dir)
    model = language.train(docs, table(spark, sf_dir, "lang_labels"))
    return language.segments(language.identify(docs, model, only_mixed_or_foreign=True)).select("src_table", "record_id", "seg_no", "lang")


def p5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spoken(spark, sf_dir)
    return language.segments(language.identify(docs, language.train(docs, table(spark, sf_dir, "lang_labels"))))


def p5_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of the segments: those of messages that are not wholly English are the same in both queries; a confidence is a share."""
    docs = _spoken(spark, sf_dir)
    model = language.train(docs, table(spark, sf_dir, "lang_labels"))
    some, every = (cut(language.segments(language.identify(docs, model, only_mixed_or_foreign=x))) for x in (True, False))
    key = ["src_table", "record_id"]
    foreign = every.where("lang <> 'en'").select(*key).distinct()
    marked = some.withColumn("side", F.lit(1)).unionByName(every.join(foreign, key, "left_semi").withColumn("side", F.lit(-1)))
    odd = marked.groupBy(*key, "seg_no", "lang").agg(F.sum("side").alias("n")).where("n <> 0").agg((F.count("*") == 0).alias("agree"))
    bounded = every.agg(F.coalesce(F.bool_and(F.col("confidence").between(1 / len(language.LANGUAGES) - 1e-9, 1 + 1e-9)), F.lit(True)).alias("bounded"))
    return odd.join(F.broadcast(bounded))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), ("paraphrase",)).select("doc_id", "item_id", "common")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", mixing.count_pieces(F.col("text")).alias("tokens"))
    return mixing.supply(docs, table(spark, sf_dir, "mix_targets")).where("not reachable").select("source")


def p9_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", mixing.count_pieces(F.col("text")).alias("tokens"))
    return mixing.supply(docs, table(spark, sf_dir, "mix_targets"))


def _mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.count_tokens(F.col("text")).alias("tokens"))
    return mixing.mix(cut(docs), table(spark, sf_dir, "mix_targets"), block=2048)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)


def p9_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", mixing.count_pieces(F.col("text")).alias("tokens"))
    rows = [(r["source"], r["cap"], r["quota"]) for r in mixing.quotas(docs, table(spark, sf_dir, "mix_targets"), block=256)]
    return spark.createDataFrame(rows, "source string, cap bigint, quota bigint")


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of every mix: no document is used too often, and each source has its share within a block and a half of its quota's."""
    targets = table(spark, sf_dir, "mix_targets")
    wanted = targets.select(mixing.source_key(F.col("source")).alias("source"), "max_repeats", F.col("target_share").alias("t"))
    rows = mixing.mix_report(_mix(spark, sf_dir), targets).drop("target_share").join(wanted, "source")
    total = rows.agg(F.sum("tokens").alias("all_tokens"))
    off = F.abs(F.col("actual_share") - F.col("t")) * F.col("all_tokens")
    return rows.join(F.broadcast(total)).select("source", (F.col("max_used") <= F.col("max_repeats")).alias("capped"), (off <= 1.5 * 2048).alias("near"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf_dir, "documents"))


def p10_portion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spans.shared_portion(docs, spans.shared_spans(docs))


QUERIES = {name: f for name, f in list(globals().items()) if name[:1] == "p" and name[1:2].isdigit()}
