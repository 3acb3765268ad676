import random
import re

from skein.llm import leakage


def words(t):
    return re.findall(r"[^\W_]+", t.lower())


def brute(docs, items):
    runs = {}
    for i, b in items:
        if i is not None and b is not None:
            w = words(b)
            for k in range(len(w) - 15):
                runs.setdefault(tuple(w[k : k + 16]), set()).add(i)
    return {(d, i) for d, t in docs if d is not None and t is not None for k in range(len(words(t)) - 15) for i in runs.get(tuple(words(t)[k : k + 16]), ())}


def found(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, body string")
    return {(r["doc_id"], r["item_id"]) for r in leakage.leaks(d, i, **options).collect()}


def corpus(seed=1):
    r = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.randrange(20, 90))) for i in range(40)]
    docs = []
    for d in range(120):
        w = words(items[r.randrange(40)][1])
        a, n = r.randrange(len(w)), r.randrange(10, 40)
        docs.append((d, f"{text(r.randrange(80))} {' , '.join(w[a : a + n]).upper()}. {text(r.randrange(60))}"))
    return docs, items


def test_verbatim_runs_are_those_of_brute_force(spark):
    docs, items = corpus()
    rest = [(900, None), (None, items[0][1]), (901, ""), (0, docs[0][1])]
    assert found(spark, docs + rest, items + [(50, None), (None, "x"), (51, "short item"), items[0]]) == brute(docs, items) != set()


def test_item_blocks_give_the_same(spark, monkeypatch):
    docs, items = corpus(2)
    whole = found(spark, docs, items)
    monkeypatch.setattr(leakage, "ITEM_BLOCK", 15)
    assert found(spark, docs, items) == whole


def test_nothing_to_find(spark):
    docs, items = corpus()
    assert found(spark, [], items) == set() and found(spark, docs, []) == set() and found(spark, docs, [(1, "")]) == set()


def test_paraphrases_share_order_and_answers(spark):
    docs, items = corpus(3)
    body = "on friday the 24 engineers moved 731 crates from the northern depot to the harbour before the storm closed road 88 for nine days and nobody was hurt"
    near = body.replace("engineers", "workers").replace("northern", "north").replace("nobody was hurt", "no one got injured")
    other = near.replace("24", "25").replace("731", "600").replace("88", "12")
    got = found(spark, [*docs, (500, near), (501, other), (502, " ".join(reversed(body.split())))], [*items, (77, body)], kinds=("paraphrase",))
    assert (500, 77) in got and not {(501, 77), (502, 77)} & got


def test_short_paraphrases_in_long_documents_are_found_at_every_offset(spark):
    # 26 words of an item of 60, three of them changed, among 70 to 100 words that no item has.
    r = random.Random(5)
    items = [(i, " ".join(f"item{i}w{k}" if k % 6 else f"{i}{k}77" for k in range(60))) for i in range(4)]
    docs = []
    for offset in range(70, 101):
        part = items[offset % 4][1].split()[13:39]
        for k in (4, 12, 19):
            part[k] = "changed"
        other = [f"other{r.randrange(900)}" for _ in range(offset + 50)]
        docs.append((offset, " ".join(other[:offset] + part + other[offset:])))
    assert found(spark, docs, items, kinds=("paraphrase",)) == {(d, d % 4) for d, _ in docs}


def test_common_subsequence():
    import numpy as np

    assert leakage.common_subsequence(np.array([1, 2, 3, 4]), np.array([2, 9, 4, 1])) == 2
    assert leakage.common_subsequence(np.array([], int), np.array([1])) == 0


def test_no_run_is_lost_by_the_bound_on_cosines(spark, monkeypatch):
    docs, items = corpus(4)
    items += [(200 + i, b) for i, b in items[:5]]  # runs that several items have
    monkeypatch.setattr(leakage, "NEAR", 0.8)
    assert found(spark, docs, items) == brute(docs, items)
