from datetime import datetime

import pytest

from skein.llm import conversations

SCHEMA = "tweet_id string, author_id string, inbound boolean, created_at timestamp, text string, response_tweet_id string, in_response_to_tweet_id string, conv string"


def at(h, m=0):
    return datetime(2017, 11, 1, h, m)


def rebuild(spark, rows, **options):
    got = conversations.rebuild(spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA), **options)
    return {(r["conv"], r["turn_no"], r["id"], r["role"]) for r in got.collect()}, {r["id"]: r["parent"] for r in got.collect()}


def test_turns_are_ordered_and_broken_ones_dropped(spark):
    rows = [
        ("10", "7", True, at(1), "help", "11.0,", None),
        ("11", "Brand", False, at(2), "sure", None, None),
        ("12", "7", None, None, "early", None, "11"),
        ("13", "Brand", False, at(3), " ​ ", None, "10"),  # nothing visible
        ("20", "8", True, at(1), "hello", None, None),
        ("21", "Brand", False, at(2), "hi", "99", "20"),  # leads nowhere
        ("30", "8", True, at(1), "a", None, "31"),
        ("31", "Brand", False, at(2), "b", None, "30"),  # a circle
        ("40", "9", True, at(5), "late question", None, "41"),
        ("41", "Brand", False, at(4), "first", None, None),  # no answer after
        ("50", "9", True, at(5), "alone", None, None),
    ]
    turns, _ = rebuild(spark, rows)
    assert turns == {(10, 1, 12, "customer"), (10, 2, 10, "customer"), (10, 3, 11, "brand")}


def test_copies_unite_their_links(spark):
    rows = [("1", "7", True, at(1), "q", None, None), ("1", " 7", True, at(1), "q", "2", None), ("2", "B", False, at(2), "a", None, None)]
    turns, parent = rebuild(spark, rows)
    assert turns == {(1, 1, 1, "customer"), (1, 2, 2, "brand")} and parent == {1: None, 2: 1}


def test_likeliest_parent_is_chosen(spark):
    rows = [
        ("1", "7", True, at(1), "@B the battery is dead", "3", None),
        ("2", "8", True, at(2, 50), "@B where is my parcel", "3", None),
        ("3", "B", False, at(3), "@8 your parcel is on its way", None, None),
    ]
    _, parent = rebuild(spark, rows)
    assert parent[3] == 2


def test_channels_link_messages_without_references(spark):
    rows = [("1", "7", True, at(1), "@Brand help", None, None), ("2", "Brand", False, at(2), "@7 with what", None, None)]
    assert rebuild(spark, rows)[0] == set()
    assert rebuild(spark, rows, infer=True)[0] == {(1, 1, 1, "customer"), (1, 2, 2, "brand")}


@pytest.mark.parametrize("at_once", [1000, 2])
def test_any_earlier_message_of_a_channel_may_be_the_parent(spark, monkeypatch, at_once):
    monkeypatch.setattr(conversations, "AT_ONCE", at_once)
    rows = [
        ("1", "7", True, at(1), "@Brand the espresso machine leaks water", None, None),
        *((str(i), "7", True, at(1, i), f"@Brand note number{i}", None, None) for i in range(2, 9)),
        ("9", "Brand", False, at(1, 20), "@7 sorry that your espresso machine leaks water", None, None),
        ("10", "Brand", False, at(1, 21), "@7 thanks for number4", None, None),
    ]
    parent = rebuild(spark, rows, infer=True)[1]
    assert parent[9] == 1 and parent[10] == 4


def test_large_conversations_are_numbered_alike(spark, monkeypatch):
    monkeypatch.setattr(conversations, "ID_BITS", 3)
    rows = [(str(i), "7" if i % 2 else "B", bool(i % 2), at(i % 20) if i % 5 else None, "t", None, str(max(1, i - 1)) if i > 1 else None) for i in range(1, 40)]
    assert rebuild(spark, rows, co_locate=5)[0] == rebuild(spark, rows)[0] != set()


def test_no_messages(spark):
    assert rebuild(spark, []) == (set(), {})


def test_interleaved_topics_are_told_apart(spark):
    import random

    r = random.Random(2)
    rows, truth, n = [], {}, 100
    for customer in range(40):
        topics = [" ".join(f"w{r.randrange(3000)}x" for _ in range(5)) for _ in range(3)]
        turns = [(t, side) for t in range(3) for side in range(2)]
        order = sorted(turns, key=lambda x: (x[1] * 2 + r.random() * 3 if x[1] else r.random() * 2))  # answers after most questions
        order = [x for x in order if x[1] == 0] + [x for x in order if x[1] == 1]
        asked = {}
        for k, (topic, side) in enumerate(order):
            n += 1
            words = topics[topic].split()
            r.shuffle(words)
            text = f"@{'Shop' if side == 0 else customer} " + " ".join(words[:4]) + f" filler{n}"
            rows.append((str(n), str(customer) if side == 0 else "Shop", side == 0, at(1 + k // 2, 10 * (k % 2) + customer % 10), text, None, None))
            if side:
                truth[n] = asked[topic]
            else:
                asked[topic] = n
    parent = rebuild(spark, rows, infer=True)[1]
    assert sum(parent.get(c) == p for c, p in truth.items()) >= 0.95 * len(truth)


def test_every_mention_is_a_channel(spark):
    rows = [("1", "7", True, at(1), "@Other hello there", None, None), ("2", "Shop", False, at(2), "@9 and @7 hello", None, None), ("3", "7", True, at(3), "@Shop fine", None, None)]
    got = conversations.channel_parents(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), spark.createDataFrame([(2,), (3,)], "id bigint"))
    assert {(r["child"], r["parent"]) for r in got.collect()} == {(3, 2)}


def test_turns_are_the_same_without_parents(spark):
    rows = [("1", "7", True, at(1), "q", None, None), ("2", "B", False, at(2), "a", None, "1"), ("3", "B", False, at(3), "a", None, "1")]
    whole = rebuild(spark, rows)[0]
    got = conversations.rebuild(spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA), parents=False)
    assert {tuple(r) for r in got.collect()} == whole


def test_query_scores_its_candidates_and_joins_their_trees(spark, tmp_path, monkeypatch):
    from skein.llm import queries

    rows = [
        ("1", "7", True, at(1), "@B the battery is dead", "3", None),
        ("2", "8", True, at(2, 50), "@B where is my parcel", "3", None),
        ("3", "B", False, at(3), "@8 your parcel is on its way", None, None),
    ]
    spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA).write.parquet(str(tmp_path / "twcs.parquet"))
    trees, likeliest = [], conversations.likeliest
    monkeypatch.setattr(conversations, "likeliest", lambda *x: trees.append(likeliest(*x)) or trees[-1])
    got = queries.p1_found(spark, str(tmp_path))
    assert [(r["child"], r["parent"], r["score"] > 4) for t in trees for r in t.collect()] == [(3, 2, True)]
    assert {tuple(r) for r in got.collect()} == {("1", 1, "1", "customer"), ("1", 2, "2", "customer"), ("1", 3, "3", "brand")}


def test_trees_with_a_link_between_them_are_one(spark):
    import random

    from skein.operators.graph import connected_components

    r = random.Random(3)
    whole = [(r.randrange(400), r.randrange(400)) for _ in range(250)]
    tree = {by: (by, to) for by, to in whole if by != to}.values()
    links = spark.createDataFrame(whole, "by bigint, to bigint")
    got = conversations._trees_joined(spark.createDataFrame(list(tree), "child bigint, parent bigint"), links)
    assert {tuple(x) for x in got.collect()} == {tuple(x) for x in connected_components(links, "by", "to").collect()}
