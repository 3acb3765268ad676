import random
from math import ceil

from pyspark.sql import functions as F

from skein.functions.ids import clean_ids
from skein.operators import orphans, skew


def test_quantiles_of_hot_cold_and_empty_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "FULL_BIN", 50)
    r = random.Random(1)
    rows = [("hot", r.randrange(-(10**12), 10**12)) for _ in range(900)] + [(f"k{i % 9}", r.randrange(5)) for i in range(200)] + [("none", None), (None, 4), (None, None)]
    got = {x["key"]: x for x in skew.key_quantiles(spark.createDataFrame(rows, "key string, v bigint"), "key", "v", (0.1, 0.5, 1.0)).collect()}
    for key in {k for k, _ in rows}:
        own = sorted(v for k, v in rows if k == key and v is not None)
        assert got[key]["n"] == sum(k == key for k, _ in rows)
        assert got[key]["quantiles"] == ([own[max(1, ceil(p * len(own))) - 1] for p in (0.1, 0.5, 1.0)] if own else None)


def test_quantiles_of_nothing(spark):
    assert skew.key_quantiles(spark.createDataFrame([], "key string, v bigint"), "key", "v").count() == 0


def test_heavy_keys_count_all_rows(spark):
    rows = [("a", None)] * 50 + [("b", 1)] * 49 + [("c", 2)]
    got = skew.heavy_keys(skew.key_quantiles(spark.createDataFrame(rows, "k string, v bigint"), "k", "v"), 0.49)
    assert {r["k"] for r in got.collect()} == {"a", "b"}


def test_link_forms(spark):
    forms = [("1000000001.0",), (" 1000000002 ,1000000003,",), ("nan",), ("",), (None,), (" 1000000004",), ("1000000005,1000000005",)]
    got = [r[0] for r in spark.createDataFrame(forms, "x string").select(clean_ids(F.col("x"))).collect()]
    assert got == [["1000000001"], ["1000000002", "1000000003"], [], [], [], ["1000000004"], ["1000000005"]]


def table(spark, rows):
    return spark.createDataFrame(rows, "id string, up string, down string, at timestamp")


def test_orphans_are_direct_then_inherited(spark):
    from datetime import datetime

    at = datetime(2017, 11, 3)
    rows = table(spark, [("1", "99", None, at), ("2", "1", None, at), ("3", "2", "98", None), ("3", "2", "98", at), ("4", None, "1", at), ("5", "6", None, at), ("6", "5", None, at)])
    refs = orphans.references(rows, "t", {"up": "up", "down": "down"}, "id", "at")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "ref_id string")
    got = orphans.cascade(refs, rows.select(F.col("id").alias("ref_id")), ids("99", "98"), ids("98", "97"))
    out = {(r["id"], r["field"], r["ref_id"], r["status"], r["level"]) for r in got.collect()}
    assert out == {("1", "up", "99", "late", 0), ("3", "down", "98", "late", 0), ("2", "up", "1", "late", 1), ("3", "up", "2", "late", 2)}
    report = {(r["field"], r["period"], r["direct"], r["inherited"]) for r in orphans.orphan_report(got).collect()}
    assert report == {("up", "2017-11", 1, 2), ("down", "2017-11", 1, 0)}


def test_no_references(spark):
    refs = orphans.references(table(spark, []), "t", {"up": "up"}, "id", "at")
    none = spark.createDataFrame([], "ref_id string")
    assert orphans.cascade(refs, none, none, none).count() == 0


def test_heavy_authors_come_from_refined_histograms(spark, tmp_path, monkeypatch):
    from skein.plans import core_problems

    lengths = {"brand": [7 * i for i in range(150)], "other": [1000] * 40, "rare": [3]}
    rows = [((" @Brand", "BRAND ", "brand")[i % 3] if who == "brand" else who, "x" * n) for who, each in lengths.items() for i, n in enumerate(each)] + [(None, "y" * 9)] * 5
    spark.createDataFrame(rows, "author_id string, text string").write.parquet(str(tmp_path / "twcs.parquet"))
    done, key_quantiles, rounds, refine = [], skew.key_quantiles, [], skew._refine
    monkeypatch.setattr(skew, "key_quantiles", lambda *x: done.append(key_quantiles(*x)) or done[-1])
    monkeypatch.setattr(skew, "_refine", lambda *x: rounds.append(1) or refine(*x))
    got = core_problems.p6_found(spark, str(tmp_path))
    assert {r["author"] for r in got.collect()} == {"brand", "other"}
    assert len(done) == 1 and rounds == [1]  # lengths up to 1,043 take two levels
    wanted = {k: [sorted(v)[max(1, ceil(p * len(v))) - 1] for p in core_problems.PROBS] for k, v in lengths.items()}
    assert {r["author"]: r["quantiles"] for r in done[0].where("author is not null").collect()} == wanted


def test_direct_orphans_of_the_query_come_from_the_cascade(spark, tmp_path, monkeypatch):
    from datetime import datetime

    from skein.plans import core_problems

    columns = "tweet_id string, in_response_to_tweet_id string, response_tweet_id string, created_at timestamp"
    at = datetime(2017, 11, 3)
    chain = [("1", "99", None, at)] + [(str(i), f"{i - 1}.0", None, at) for i in range(2, 6)] + [("6", None, "97, 5", at), ("7", "8", None, None), ("8", "7", None, None)]
    for name, rows in (("twcs", chain), ("twcs_late", [("99", "98", None, at)]), ("deleted_tweets", [("97", None, None, at)])):
        spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / f"{name}.parquet"))
    done, cascade = [], orphans.cascade
    monkeypatch.setattr(orphans, "cascade", lambda *x: done.append(cascade(*x)) or done[-1])
    got = {tuple(r) for r in core_problems.p7_found(spark, str(tmp_path)).collect()}
    up, down = "in_response_to_tweet_id", "response_tweet_id"
    assert got == {("twcs", "1", up, "99", "late"), ("twcs", "6", down, "97", "deleted"), ("twcs_late", "99", up, "98", "missing")}
    inherited = {(r["id"], r["level"]) for r in done[0].where("level > 0").collect()}
    assert inherited == {("1", 1), *((str(i), i - 1) for i in range(2, 6))}
