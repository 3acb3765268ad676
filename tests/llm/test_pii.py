import random

import pytest

from skein.llm import pii


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("write to a.b-c+d@mail.example.org now", [("email", "abcdmailexampleorg")]),
        ("Reach me on salma24 at webpost dot invalid any time", [("email", "salma24atwebpostdotinvalid")]),
        ("my login is x_y[at]post[dot]box[dot]example.", [("email", "xyatpostdotboxdotexample")]),
        ("Let us know at 10:28 if it dot works", []),
        ("Call me on +44 (0)7700 900163 please", [("phone", "4407700900163")]),
        ("my number is (203) 555-0114.", [("phone", "2035550114")]),
        ("text 3095550147 after six", [("phone", "3095550147")]),
        ("serial 3095550147, build 26.27.7914, order 00-2172831-22", []),
        ("NI number QQ 27 20 33 A.", [("id_number", "qq272033a")]),
        ("Passport no XX4682287. tax id: 936 11 6317", [("id_number", "xx4682287"), ("id_number", "936116317")]),
        ("ticket 936116317 is open", []),
        ("We live at 5 Wexcombe Mill Ave.", [("address", "5wexcombemillave")]),
        ("moved to 88 tannery close last month", [("address", "88tannteryclose".replace("tannt", "tann"))]),
        ("needs 386 tries Close to giving up", []),
        ("Deliver it to Avenida Ravana 325, or 45 rue de Gryois.", [("address", "avenidaravana325"), ("address", "45ruedegryois")]),
        ("ich wohne in der Ashgroveallee 429.", [("address", "ashgroveallee429")]),
        ("Ask for Jürgen Ravoulis-Dorninger at the desk", [("name", "jürgenravoulisdorninger")]),
        ("booked for Fennquist, Freya and one child", [("name", "fennquistfreya")]),
        ("it was Ilse T. Moor who came", [("name", "ilsetmoor")]),
        ("ask for three days of it", []),
        ("born on 03/02/1990", [("birth_date", "03021990")]),
        ("", []),
        ("x" * 20_000, []),
    ],
)
def test_items(text, wanted):
    assert [(k, pii.value(text[a:b])) for a, b, k in pii.find(text)] == wanted


def test_pseudonyms_keep_their_format_and_can_be_undone():
    r = random.Random(3)
    key, seen = b"k", set()
    for n in (1, 2, 3, 7, 11):
        for _ in range(60):
            item = "".join(r.choice("0123456789") for _ in range(n)) + "-" + "".join(r.choice("abcXYZ") for _ in range(n))
            got = pii.pseudonym(item, key)
            assert [c.isdigit() for c in got] == [c.isdigit() for c in item] and [c.isupper() for c in got] == [c.isupper() for c in item]
            assert pii.pseudonym(got, key, undo=True) == item
            seen.add((item, got))
    assert len({a for a, _ in seen}) == len({b for _, b in seen})
    assert pii.pseudonym("+44 7700", key).replace(" ", "") == pii.pseudonym("+447700", key)


def test_all_three_digit_numbers_are_permuted():
    assert len({pii.pseudonym(f"{i:03d}", b"k") for i in range(1000)}) == 1000


def test_dates_stay_dates():
    for item in ("03/02/1990", "1999-12-31", "29.02.2000"):
        got = pii.date_pseudonym(item, b"k")
        assert len(got) == len(item) and pii.date_pseudonym(got, b"k", undo=True) == item


def test_redaction_leaves_the_rest(spark):
    df = spark.createDataFrame([("call me on 07700 900 734, thanks",), (None,), ("nothing here",)], "text string")
    got = [r[0] for r in df.select(pii.redacted(df["text"], "s")).collect()]
    assert got[0].startswith("call me on [PHONE ") and got[0].endswith("], thanks") and "07700" not in got[0]
    assert got[1:] == [None, "nothing here"]


def test_rows_with_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "a@b.example", "x"), ("1", None, "y"), ("1", "a@b.example", "z")], "tweet_id string, text string, kind string")
    assert [(r["key"], r["value"]) for r in pii.items(df).collect()] == [("1", "abexample")]
    assert pii.items(df.limit(0)).count() == 0


def test_names_are_learned_from_what_follows_cues(spark):
    texts = [f"My name is {a} {b}." for a in ("Zorvik", "Ulmetta", "Kasparro") for b in ("Tallane", "Brennick", "Ostrowe")]
    texts += ["Registered to Dunmore Road and to Dunmore Street and to Dunmore Lane"] * 3 + [None, "", "my name is lower case"] + ["Mein Name ist Nurein Einziger"] * 5
    held = ["yesterday Zorvik Vandermolen called", "I saw Kasparro Quillfeather there", "the Dunmore Tower", "Ulmetta went home", "booked for Nurein Anders"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    names = pii.learn_names(docs)
    assert names == {"zorvik", "ulmetta", "kasparro"}
    got = pii.items(spark.createDataFrame(list(enumerate(held)), "tweet_id bigint, text string"), names=names)
    assert {(r["key"], r["value"]) for r in got.where("kind = 'name'").collect()} == {("0", "zorvikvandermolen"), ("1", "kasparroquillfeather")}
    assert pii.learn_names(docs.limit(0)) == frozenset()


def test_pseudonyms_of_a_corpus_are_linked_and_lead_back(spark):
    rows = [(str(i), f"call me on +49 30 23125 {i % 7:03d}, mail a{i % 5}@b.example, born on {1 + i % 28:02d}.03.1990, my name is Élise Dupont") for i in range(60)]
    found = pii.items(spark.createDataFrame(rows, "tweet_id string, text string"))
    assert {r["kind"] for r in found.select("kind").distinct().collect()} == {"phone", "email", "birth_date", "name"}
    assert tuple(pii.audit(found, "k").collect()[0]) == (True, True)
    assert tuple(pii.audit(found.limit(0), "k").collect()[0]) == (True, True)
