import pandas as pd
import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.sieve import Sieve
from skein.operators import calibration, evaluation, labels, messages, retrieval, routing, sampling, services, threads


def one(df):
    return df.collect()[0]


@pytest.mark.parametrize(
    ("text", "rail"),
    [
        ("I want a refund", "billing_legal"),
        ("I have an issue", "billing_legal"),
        ("I want to end my life", "safety"),
        ("someone logged in as me", "account_takeover"),
        ("he is underage", "minor"),
        ("my ssn is out", "pii_sensitive"),
        ("I will switch to them", "competitor_abuse"),
        ("killing me", None),
        (None, None),
    ],
)
def test_rails(spark, text, rail):
    assert one(spark.createDataFrame([(text,)], "t string").select(routing.rail(F.col("t")).alias("r")))["r"] == rail


def test_redirects_have_fewer_than_25_words(spark):
    texts = [("please dm " + "x " * 22,), ("please dm " + "x " * 23,)]
    assert [r[0] for r in spark.createDataFrame(texts, "t string").select(T.is_dm_redirect(F.col("t"))).collect()] == [True, False]


def test_unicode_words_and_mentions(spark):
    row = one(spark.createDataFrame([("@café_1 a b",)], "t string").select(T.mentions(F.col("t")).alias("m"), T.tokens(F.col("t")).alias("w")))
    assert row["m"] == ["café_1"] and row["w"] == ["@café_1", "a", "b"]


def test_casts_of_raw_messages(spark):
    raw = spark.createDataFrame([("True", "Tue Oct 31 22:10:47 +0000 2017"), ("maybe", "junk"), ("", None)], "inbound string, created_at string")
    got = [(r["inbound"], r["us"]) for r in messages.cast_messages(raw).withColumn("us", F.unix_micros("created_at")).collect()]
    assert got == [(True, 1509487847000000), (None, None), (None, None)]


def test_similarity_is_twice_the_common_subsequence():
    assert messages.similarity("abcd", "abxd") == 0.75
    assert messages.similarity("", "") == 1.0 and messages.similarity("a", "") == 0.0


def test_greedy_copies_keep_the_first(spark):
    a = "the very same long reply text number one"
    rows = spark.createDataFrame([(a,), (a + "x",), ("other",), (None,)], "text string")
    assert [r["text"] for r in messages.greedy_copies(rows).collect()] == [a + "x"]


def test_threads_need_a_customer_and_a_reply(spark):
    schema = "tweet_id string, author_id string, inbound boolean, created_at timestamp, text string, response_tweet_id string, in_response_to_tweet_id string"
    rows = [
        ("1", "7", True, None, "help", "2,", None),
        ("2", "Brand", False, None, "sure thing", None, "1.0"),
        ("3", "8", True, None, "hello", None, None),
        ("4", "Brand", False, None, "please dm us", None, "3"),
        ("5", "Brand", False, None, "news", None, "99"),
    ]
    got = threads.build_threads(spark.createDataFrame(rows, schema), "brand").collect()
    assert [(r["thread_id"], r["tweet_count"], r["first_customer_message"]) for r in got] == [(1, 2, "help")]


def test_calibration_error_leaves_one_out_and_counts_it(spark):
    rows = spark.createDataFrame([(1.0, 1), (0.30000000000000004, 1), (0.3, 0), (-0.1, 0)], "s double, c int")
    got = one(calibration.calibration_error(rows, "s", "c"))
    assert got["n"] == 4 and got["ece"] == pytest.approx((0.7 + 0.3) / 4)


def test_tau_is_the_smallest_that_qualifies(spark):
    rows = spark.createDataFrame([(i, i / 1000, 0 if i > 200 else 1) for i in range(1000)], "id int, s double, e int")
    got = one(calibration.conformal_tau(rows, "s", "e", "id"))
    assert got["n"] == 1000 and 0.1 < got["tau"] <= 0.201
    assert one(calibration.conformal_tau(rows.limit(3), "s", "e", "id", on_infeasible=2.0))["tau"] == 2.0


def test_isotonic_pools_and_clips(spark):
    rows = spark.createDataFrame([(0.1, 0.0), (0.2, 1.0), (0.3, 0.0), (0.4, 1.0)], "s double, y double")
    model = calibration.fit_isotonic(rows, "s", "y")
    got = calibration.calibrate(spark.createDataFrame([(0.0,), (0.25,), (0.9,), (None,)], "s double"), model, "s").collect()
    assert [r["calibrated"] for r in got] == [0.0, 0.5, 1.0, None]


def test_rank_metrics_by_hand(spark):
    ranking = spark.createDataFrame([("q", "a", 0), ("q", "b", 1), ("p", "b", 0)], "query_id string, doc_id string, rank int")
    got = one(retrieval.rank_metrics(ranking, spark.createDataFrame([("q", "b"), ("p", "x")], "query_id string, doc_id string")))
    assert got["mrr"] == 0.25 and got["recall"] == 0.5 and got["ndcg"] == pytest.approx(0.5 / 1.5849625007)


def test_fusion_does_not_depend_on_order(spark):
    a, b = (spark.createDataFrame([("q", d, i) for i, d in enumerate(x)], "query_id string, doc_id string, rank int") for x in ("xy", "yz"))
    one_way, other = ({r["doc_id"]: round(r["score"], 12) for r in retrieval.fuse(x).collect()} for x in ([(a, 0.4), (b, 0.6)], [(b, 0.6), (a, 0.4)]))
    assert one_way == other and one_way["y"] == pytest.approx(0.4 / 62 + 0.6 / 61)


def test_kappa(spark):
    rows = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (1, 2)], "a int, b int")
    assert one(evaluation.kappa(rows, "a", "a"))["kappa"] == 1.0
    assert one(evaluation.kappa(rows, "a", "b", weighted=False))["kappa"] == pytest.approx((0.75 - 5 / 16) / (1 - 5 / 16))


def test_correlation_p_by_table():
    assert evaluation.correlation_p(0.632, 10) == pytest.approx(0.05, abs=5e-4)
    assert evaluation.correlation_p(0.0, 30) == pytest.approx(1.0)


def test_binary_scores_divide_by_nothing(spark):
    got = one(evaluation.binary_scores(spark.createDataFrame([(False, False)], "g boolean, p boolean"), "g", "p"))
    assert (got["accuracy"], got["precision"], got["recall"], got["f1"], got["over_rate"]) == (1.0, 0.0, 0.0, 0.0, 0.0)


def test_strata_do_not_overlap(spark):
    rows = spark.range(300).withColumnRenamed("id", "k")
    got = sampling.strata(rows, "k", [("low", None, F.col("k"), 60), ("even", F.col("k") % 2 == 0, None, 40), ("rest", None, None, 50)])
    assert got.count() == 150 == got.select("k").distinct().count()


def test_interval_holds_the_mean(spark):
    rows = spark.range(400).select("id", (F.col("id") % 5 == 0).cast("double").alias("v"))
    got = one(sampling.interval(sampling.resample_means(rows, "id", "v", 200)))
    assert got["lower"] < 0.2 < got["upper"] and 0.05 < got["upper"] - got["lower"] < 0.11


def test_replies_parse_leniently(spark):
    rows = spark.createDataFrame([('```json\n{"score": 5, "winner": "B"}\n```',), ('x "score": 2 y',), ("CITATIONS: ['a', \"b\"]",)], "response string")
    got = services.parse_replies(rows).collect()
    assert [(r["score"], r["winner"]) for r in got] == [(5, "B"), (2, "tie"), (3, "tie")] and got[2]["citations"] == ["a", "b"]


def test_next_provider_answers_where_one_fails(spark):
    def broken(_):
        raise RuntimeError("429")

    rows = spark.createDataFrame([("k", "hi")], "key string, prompt string")
    assert tuple(one(services.complete(rows, [("a", broken), ("b", str.upper)]))) == ("k", "HI", "b")
    assert tuple(one(services.complete(rows, [("a", broken)]))) == ("k", None, None)


def test_position_bias_is_no_agreement(spark):
    got = one(services.swap_verdicts(spark.createDataFrame([("A", "A")], "order1 string, order2 string")))
    assert (got["verdict"], got["same_letter"], got["same_side"]) == ("tie", True, False)


def test_rerank_by_injected_scorer(spark):
    rows = spark.createDataFrame([("q", 1, "a b", "a"), ("q", 2, "a b", "a b")], "query_id string, doc_id int, query string, text string")
    assert [r["doc_id"] for r in retrieval.rerank(rows, retrieval.word_overlap, 1).collect()] == [2]
    assert retrieval.word_overlap(pd.Series([""]), pd.Series(["x"])).tolist() == [0.0]


def test_sieve_passes_all_of_its_keys(spark):
    keys = spark.range(0, 1000, 7).withColumnRenamed("id", "k")
    rows = spark.range(1000).withColumnRenamed("id", "k")
    assert rows.where(Sieve(keys, "k").passes("k")).join(keys, "k").count() == keys.count()


def test_nearest_prefers_the_larger_label_on_ties(spark):
    cents = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "label int, centroid array<double>")
    got = one(labels.nearest(spark.createDataFrame([(9, [1.0, 0.0])], "vec_id int, embedding array<double>"), cents))
    assert got["label"] == 2 and got["margin"] == 0.0


def test_copies_of_very_long_texts_are_dropped(spark):
    from skein.operators.messages import greedy_copies

    long = "a" * 40_000
    texts = spark.createDataFrame([(f"{long} one",), (f"{long} two",)], "text string")
    assert [r["text"] for r in greedy_copies(texts).collect()] == [f"{long} two"]


def test_handles_and_links_count_in_their_clean_forms(spark):
    schema = "tweet_id string, author_id string, inbound boolean, created_at timestamp, text string, in_response_to_tweet_id string"
    rows = spark.createDataFrame([
        ("1000000001", "55", True, None, "@Shop hi", None), ("1000000002", "@Shop", False, None, "hello", "1000000001.0"),
        ("1000000003", "66", True, None, "hey", "nan"), ("1000000004", " SHOP ", False, None, "yes", " 1000000003 "), ("1000000005", None, None, None, None, None),
    ], schema)
    assert {r["tweet_id"] for r in messages.replied_to(rows, "shop").collect()} == {"1000000001", "1000000003"}
    got = messages.brand_report(rows, spark.createDataFrame([("Shop",)], "handle string")).collect()
    assert [tuple(r) for r in got] == [("shop", 2, 1, True)]


def test_calibration_takes_any_number_of_boundaries(spark):
    class Fitted:
        boundaries, predictions = [i / 5000 for i in range(5001)], [i / 10000 for i in range(5001)]

    rows = spark.createDataFrame([(-1.0,), (0.5,), (2.0,), (None,)], "s double")
    assert [None if r[0] is None else round(r[0], 6) for r in calibration.calibrate(rows, Fitted, "s").select("calibrated").collect()] == [0.0, 0.25, 0.5, None]


def test_registry_without_the_text_problems(monkeypatch):
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "skein.llm", None)
    assert "p2_found" in entry.queries() and "p1_found" not in entry.queries()


def test_replies_with_arrays_and_templates(spark):
    rows = spark.createDataFrame([("```json\n[1, [2]]\n```", "a"), ("Here: [\"x\"] done", None), ("none", "b")], "r string, v string")
    got = [tuple(r) for r in rows.select(T.json_array(F.col("r")), T.fill("{{{v}}} of {v}!", v=F.col("v"))).collect()]
    assert got == [("[1, [2]]", "{a} of a!"), ('["x"]', "{} of !"), ("none", "{b} of b!")]
    times = spark.createDataFrame([("2017-10-31T22:10:47+00:00",), ("2017-10-31 22:10:47",), ("NaT",), ("",), (None,)], "t string")
    assert [r[0] for r in times.select(F.unix_micros(T.iso_time(F.col("t")))).collect()] == [1509487847000000] * 2 + [None] * 3


def test_busy_providers_are_called_again_after_growing_waits(spark, tmp_path):
    log = tmp_path / "waits"

    def wait(seconds):
        with open(log, "a") as f:
            f.write(f"{seconds} ")

    def busy(_):
        raise services.Busy("later")

    def broken(_):
        raise ValueError("no key")

    rows = spark.createDataFrame([("k", "hi")], "key string, prompt string")
    got = one(services.complete(rows, [("a", busy), ("b", broken), ("c", str.upper)], attempts=4, wait=wait, errors=True))
    assert (got["response"], got["provider"], got["errors"]) == ("HI", "c", ["a: Busy: later", "b: ValueError: no key"])
    assert log.read_text().split() == ["1.0", "2.0", "4.0"]


def test_documents_without_a_shared_word_are_ranked_last(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", "z"), ("c", None)], "doc_id string, body string")
    asked = spark.createDataFrame([("q", "z z"), ("r", None)], "query_id string, m string")
    scores = retrieval.with_zeros(retrieval.bm25(docs, "doc_id", "body", asked, "query_id", "m"), asked, docs)
    got = {(r["query_id"], r["doc_id"]): r["rank"] for r in retrieval.ranked(scores).collect()}
    assert got == {("q", "b"): 0, ("q", "a"): 1, ("q", "c"): 2, ("r", "a"): 0, ("r", "b"): 1, ("r", "c"): 2}


def test_dense_neighbours_in_blocks(spark):
    import numpy as np

    r = np.random.default_rng(0).standard_normal((60, 4))
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r)] + [(60, None), (61, [0.0] * 4)], "doc_id bigint, vector array<double>")
    asked = docs.select(F.col("doc_id").alias("query_id"), "vector").where("query_id < 7")
    u = r / np.linalg.norm(r, axis=1, keepdims=True)
    want = {(q, int(d), k) for q in range(7) for k, d in enumerate(np.argsort(-(u[q] @ u.T))[:5])}
    for block in (2, 100):
        assert {(x["query_id"], x["doc_id"], x["rank"]) for x in retrieval.dense_top(asked, docs, 5, block).collect()} == want
    assert retrieval.dense_top(asked.limit(0), docs).count() == 0


def test_texts_are_embedded_by_an_injected_encoder(spark):
    import numpy as np

    rows = spark.createDataFrame([("ab",), ("",), (None,)], "t string")
    got = [r["embedding"] for r in retrieval.embed(rows, "t", lambda ts: np.array([[3.0 * len(t), 4.0 * len(t)] for t in ts])).collect()]
    assert [[round(x, 6) for x in v] for v in got] == [[0.6, 0.8], [0, 0], [0, 0]]


def test_any_statistic_can_be_resampled(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(101)], "id int, v double")
    got = one(sampling.interval(sampling.resample(rows, "id", "v", 100, sampling.weighted_median), stat="stat"))
    assert 30 < got["lower"] < 50 < got["upper"] < 70


def test_fewer_than_two_raters_agree(spark):
    rows = spark.createDataFrame([(1, "a", 3)], "item int, rater string, score int")
    assert tuple(one(evaluation.mean_rater_kappa(rows, "item", "rater", "score"))) == (1.0, 0)


def test_choices_are_escaped(spark):
    from skein.sources import files

    rows = spark.createDataFrame([('a<b & "c"',)], "name string")
    assert one(files.choices_xml(rows))["xml"] == '<Choice value="a&lt;b &amp; &quot;c&quot;"/>'
