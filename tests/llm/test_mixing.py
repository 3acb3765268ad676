from pyspark.sql import functions as F

from skein.llm import mixing


def tables(spark, sizes, targets):
    docs = [(i, s, n) for i, (s, n) in enumerate((s, n) for s, ns in sizes.items() for n in ns)]
    return spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_apportionment_by_hand():
    assert mixing.sainte_lague({"a": 0.53, "b": 0.24, "c": 0.23}, dict.fromkeys("abc", 99), 7) == {"a": 3, "b": 2, "c": 2}
    assert mixing.sainte_lague({"a": 0.9, "b": 0.1}, {"a": 1, "b": 2}, 9) == {"a": 1, "b": 2}
    assert mixing.sainte_lague({}, {}, 5) == {}


def test_shares_caps_and_repeats(spark):
    docs, targets = tables(spark, {" Big": [40] * 500, "small": [30] * 40, "none": [5], None: [7]}, [("big", 0.7, 1), ("small", 0.3, 4)])
    mixed = mixing.mix(docs, targets, block=100)
    report = {r["source"]: r for r in mixing.mix_report(mixed, targets).collect()}
    assert abs(report["big"]["actual_share"] - 0.7) < 0.02 and report["small"]["max_used"] <= 4 and report["big"]["max_used"] == 1
    assert mixed.where("source not in ('big', 'small')").count() == 0
    again = mixing.mix(docs.repartition(7), targets, block=100)
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, again.collect()))
    assert sorted(map(tuple, mixing.mix(docs, targets, block=100, seed=1).collect())) != sorted(map(tuple, mixed.collect()))


def test_supply_and_empty_tables(spark):
    docs, targets = tables(spark, {"a": [10, None], "b": [90]}, [("A ", 0.5, 2), ("b", 0.5, 1), ("gone", 0.0, 1)])
    got = {r["source"]: (r["tokens"], r["total_tokens"], r["reachable"]) for r in mixing.supply(docs, targets).collect()}
    assert got == {"a": (10, 100, False), "b": (90, 100, True), "gone": (0, 100, True)}
    assert mixing.mix(docs.limit(0), targets, block=10).count() == 0
    assert {r["actual_share"] for r in mixing.mix_report(mixing.mix(docs.limit(0), targets, block=10), targets).collect()} == {0.0}


def test_token_counts(spark):
    df = spark.createDataFrame([("a b c\n d",), ("",), (None,), ("<|endoftext|>",)], "t string")
    assert [r[0] for r in df.select(mixing.count_pieces(F.col("t"))).collect()] == [4, 0, 0, 1]
    got = [r[0] for r in df.select(mixing.count_tokens(F.col("t"))).collect()]
    assert got[1:3] == [0, 0] and got[3] > 1


def test_apportionment_is_that_of_one_seat_at_a_time():
    import random

    for seed in range(200):
        r = random.Random(seed)
        n = r.randrange(1, 9)
        shares, caps = [r.choice([0, 1, 2, 3, r.random()]) for _ in range(n)], [r.choice([0, 5, 400]) for _ in range(n)]
        given, seats = [0] * n, r.randrange(600)
        for _ in range(seats):
            open_ = [i for i in range(n) if given[i] < caps[i] and shares[i] > 0]
            if not open_:
                break
            given[max(open_, key=lambda i: (shares[i] / (2 * given[i] + 1), -i))] += 1
        assert mixing.apportion(shares, caps, seats).tolist() == given


def test_apportionment_of_many_seats_takes_no_longer():
    got = mixing.apportion([0.5, 0.3, 0.2], [10**12] * 3, 10**11)
    assert got.sum() == 10**11 and abs(got[0] - 5 * 10**10) <= 1


def test_shards_share_a_source_evenly(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 4)
    docs, targets = tables(spark, {"a": [20] * 3000, "b": [30] * 400}, [("a", 0.5, 1), ("b", 0.5, 3)])
    got = mixing.mix(docs, targets, block=500)
    sums = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("n")).collect()}
    assert abs(sums["a"] / sums["b"] - 1) < 0.03 and abs(sums["b"] - 36_000) <= 1500
    assert got.where("source = 'a' and repeats > 1 or repeats > 3").count() == 0
