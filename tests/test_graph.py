import random

import pytest
from pyspark.sql import functions as F

from skein.operators import graph


def brute(parents):
    known = set(parents)
    up = {k: v if v in known else None for k, v in parents.items()}
    out = {}
    for n in up:
        path, x = [], n
        while x is not None and x not in path:
            path.append(x)
            x = up[x]
        if x is None:
            out[n] = (path[-1], len(path) - 1)
        else:
            out[n] = (min(path[path.index(x) :]), -1)
    return out


def rows(spark, parents):
    return spark.createDataFrame(list(parents.items()), "id bigint, parent bigint")


def found(df):
    return {r["id"]: (r["root"], r["depth"]) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("co_locate", [50_000, 5])
def test_hierarchy_is_that_of_brute_force(spark, seed, co_locate):
    r = random.Random(seed)
    n = 120
    parents = {i: r.choice([None, r.randrange(n), max(0, i - 1), n + 5]) for i in range(n)}
    parents[7] = 7
    assert found(graph.hierarchy(rows(spark, parents), co_locate=co_locate)) == brute(parents)


@pytest.mark.parametrize("co_locate", [50_000, 5])
def test_long_chain_star_and_ring(spark, co_locate):
    parents = {i: i + 1 for i in range(60)} | {60: None} | {i: 100 for i in range(101, 160)} | {100: None} | {200 + i: 200 + (i + 1) % 9 for i in range(9)} | {300: 203}
    got = graph.hierarchy(rows(spark, parents), paths=True, co_locate=co_locate)
    assert found(got) == brute(parents)
    by = {r["id"]: r for r in got.collect()}
    assert by[0]["path"] == list(range(60, -1, -1))
    assert by[100]["n_descendants"] == 59
    assert by[300]["path"] == [203, 300]
    assert {i for i, r in by.items() if r["on_cycle"]} == set(range(200, 209))


def test_descendants_are_all_below(spark):
    parents = {1: None, 2: 1, 3: 2, 4: 2}
    got = graph.descendants(graph.hierarchy(rows(spark, parents), paths=True))
    assert {tuple(r) for r in got.collect()} == {(1, 2, 1), (1, 3, 2), (1, 4, 2), (2, 3, 1), (2, 4, 1)}


def test_empty_null_and_repeated_rows(spark):
    assert graph.hierarchy(spark.createDataFrame([], "id bigint, parent bigint")).count() == 0
    df = spark.createDataFrame([(1, None, "x"), (2, 1, "y"), (2, 1, "z"), (None, 1, "w")], "id bigint, parent bigint, path string")
    assert found(graph.hierarchy(df)) == {1: (1, 0), 2: (1, 1)}


@pytest.mark.parametrize("finish", [100_000, 0])
@pytest.mark.parametrize("seed", range(3))
def test_components_are_those_of_union_find(spark, monkeypatch, seed, finish):
    monkeypatch.setattr(graph, "FINISH", finish)
    r = random.Random(seed)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 260)] + [(None, 3), (5, 5)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = graph.connected_components(spark.createDataFrame(edges, "src bigint, dst bigint"))
    assert {r["node"]: r["component"] for r in got.collect()} == {x: find(x) for x in list(up) if find(x) != x}
    assert got.groupBy("node").count().where(F.col("count") > 1).count() == 0


def test_no_edges(spark):
    assert graph.connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


@pytest.mark.parametrize("co_locate", [50_000, 3])
def test_descendants_are_counted_at_every_size(spark, co_locate):
    r = random.Random(5)
    parents = {i: None if i == 0 else r.randrange(max(0, i - 4), i) for i in range(150)} | {200 + i: 200 + (i + 1) % 5 for i in range(5)} | {300: 203, 301: 300, 302: 300}
    ring, want = set(range(200, 205)), dict.fromkeys(parents, 0)
    for n in parents:
        x = n
        while x not in ring and (x := parents[x]) is not None:
            want[x] += 1
    got = graph.hierarchy(rows(spark, parents), co_locate=co_locate)
    assert {r["id"]: r["n_descendants"] for r in got.collect()} == want
