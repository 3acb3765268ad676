import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import spans


def brute(rows, n):
    texts = {}
    for d, t in rows:
        if d is not None and t is not None:
            texts[d] = min(t, texts.get(d, t))
    owners = {}
    for d, t in texts.items():
        for i in range(len(t) - n + 1):
            owners.setdefault(t[i : i + n], set()).add(d)
    out = set()
    for d, t in texts.items():
        low = high = None
        for i in range(len(t) - n + 1):
            if len(owners[t[i : i + n]]) > 1:
                if high is not None and i <= high:
                    high = i + n
                else:
                    if high is not None:
                        out.add((d, low, high))
                    low, high = i, i + n
        if high is not None:
            out.add((d, low, high))
    return out


@pytest.mark.parametrize("n", [120, 40, 7])
@pytest.mark.parametrize("seed", [1, 2])
def test_spans_are_those_of_brute_force(spark, n, seed):
    r = random.Random(seed)
    letters = "ab é😀"
    piece = lambda k: "".join(r.choice(letters) for _ in range(k))
    shared = [piece(n + r.randrange(2 * n)) for _ in range(4)] + ["x" * (n + 5)]
    rows = []
    for d in range(24):
        t = "".join(r.choice([piece(r.randrange(3 * n)), r.choice(shared), r.choice(shared)[: n - 1]]) for _ in range(3))
        rows.append((d, t))
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, None), (None, rows[1][1]), (103, ""), (104, "y" * 3 * n), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("edge", F.lit(1))
    got = {(x["doc_id"], x["span_start"], x["span_end"]) for x in spans.shared_spans(df, n).collect()}
    assert got == brute(rows, n) != set()


def test_every_passage_holds_a_token():
    r = np.random.default_rng(0)
    for n in (120, 40, 7):
        k, w = spans.sizes(n)
        assert w <= k and k + w <= n + 1
        text = "".join(map(chr, r.integers(97, 100, 600)))
        at, _ = spans.tokens(text, k, w)
        assert all(((at >= i) & (at + k <= i + n)).any() for i in range(len(text) - n))


def test_portion_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a" * 60 + "b" * 60), (2, "a" * 60 + "b" * 60 + "c"), (3, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["shared_chars"], round(r["portion"], 3)) for r in spans.shared_portion(df, spans.shared_spans(df)).collect()}
    assert got == {1: (120, 1.0), 2: (120, 0.992), 3: (0, 0.0)}
    assert spans.shared_spans(df.limit(0)).count() == 0


def test_second_hash_tells_order_and_place():
    import numpy as np

    codes = np.array([ord(c) for c in "abcabcbacab" * 3])
    h = spans.window_sums(codes, 4)
    texts = ["".join(map(chr, codes[i : i + 4])) for i in range(len(codes) - 3)]
    assert all((h[i] == h[j]) == (texts[i] == texts[j]) for i in range(len(texts)) for j in range(len(texts)))


def test_equal_first_hashes_of_different_texts_are_no_span(spark, monkeypatch):
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    same = text(60)
    rows = [(1, text(40) + same + text(30)), (2, text(25) + same), (3, text(90))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {tuple(x) for x in spans.shared_spans(df, 30).collect()}
    assert {d for d, _, _ in want} == {1, 2}
    # A first hash of four values: all runs collide, the second hash tells them apart.
    real = spans.window_hashes
    monkeypatch.setattr(spans, "window_hashes", lambda codes, size: real(codes, size) % np.uint64(4) if size == 30 else real(codes, size))
    assert {tuple(x) for x in spans.shared_spans(df, 30).collect()} == want


def test_cores_of_equal_runs_are_equal_and_lie_in_them():
    import pyarrow as pa

    r = random.Random(3)
    for n, letters in ((120, "abcd "), (40, "ab"), (7, "ab"), (2, "ab"), (1, "ab")):
        piece = lambda k, own=letters: "".join(r.choice(own) for _ in range(k))
        same = piece(3 * n)
        texts = [piece(5) + same + piece(9), piece(17) + same, "x" * 2 * n + same]
        regions = [[{"low": -9, "high": 11}, {"low": 11, "high": 1000}, {"low": 3, "high": 5}]] * len(texts)
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(regions)], ["doc", "text", "regions"])
        core_of, places = {}, {d: [] for d in range(len(texts))}
        for out in spans._cores(n)(iter([batch])):
            for row in out.to_pylist():
                for s in range(row["low"], row["high"]):
                    places[row["doc"]].append(s)
                    assert core_of.setdefault(texts[row["doc"]][s : s + n], row["core"]) == row["core"]
        assert all(places[d] == list(range(len(t) - n + 1)) for d, t in enumerate(texts))


def test_runs_that_only_share_a_token_are_not_written(spark, monkeypatch):
    """what is written and shuffled follows what records share, not every place where a shorter piece recurs."""
    r = random.Random(11)
    text = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    short, long = text(100), text(150)
    rows = [(d, text(200) + short + text(200)) for d in range(300)] + [(300 + d, text(90) + long + text(80)) for d in range(2)]
    written, real = [], spans.cut

    def counted(df):
        back = real(df)
        if {"gram", "at"} <= set(back.columns):
            written.append(back.count())
        return back

    monkeypatch.setattr(spans, "cut", counted)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {tuple(x) for x in spans.shared_spans(df).collect()}
    assert got == brute(rows, 120) != set()
    # 62 shared runs, and at most a core's width beside each end; all places of the token were 300 x 60 more.
    assert 62 <= sum(written) <= 62 + 4 * 15
