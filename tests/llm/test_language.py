import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import language

LINES = {
    "en": ["the battery of my phone does not charge any more", "please send us a message with your order", "when will the parcel arrive at my house", "thank you for your quick answer to this"],
    "de": ["der Akku von meinem Gerät lädt nicht mehr", "bitte schreibt mir wann das Paket kommt", "ich habe noch keine Antwort bekommen und warte", "das geht leider immer noch nicht richtig"],
    "fr": ["la batterie de mon téléphone ne charge plus", "je n'ai pas encore reçu de réponse", "pourquoi la livraison est en retard chez vous", "merci beaucoup pour votre réponse rapide"],
}


@pytest.fixture(scope="module")
def data(spark):
    rows = [("t", f"{lang}{i}", f"{a}. {b}.", lang) for lang, lines in LINES.items() for i, (a, b) in enumerate((x, y) for x in lines for y in lines)]
    wrong = [("t", f"w{i}", LINES["en"][i % 4], "DE") for i in range(3)]
    docs = spark.createDataFrame([r[:3] for r in rows + wrong], "src_table string, record_id string, text string")
    labels = spark.createDataFrame([(s, i, lang) for s, i, _, lang in rows + wrong] + [("t", "none", None), ("t", "en0", "und")], "src_table string, record_id string, lang string")
    return docs, labels


def found(spark, model, texts, **options):
    df = spark.createDataFrame([("t", str(i), t, "x") for i, t in enumerate(texts)], "src_table string, record_id string, text string, lang string")
    got = language.segments(language.identify(df, model, **options)).collect()
    return [[r["lang"] for r in sorted(got, key=lambda r: r["seg_no"]) if r["record_id"] == str(i)] for i in range(len(texts))]


def test_mixed_wrong_and_empty_texts(spark, data):
    model = language.train(*data)
    mixed = "@shop Der Akku lädt leider nicht mehr richtig. 👍 The battery of the phone does not charge! https://a.example"
    texts = [mixed, LINES["en"][0], LINES["fr"][1], None, "", "👍 12345", "Merci pour la réponse rapide de la batterie " * 2000]
    assert found(spark, model, texts) == [["de", "en"], ["en"], ["fr"], [], [], [], ["fr"]]
    assert found(spark, model, texts, only_mixed_or_foreign=True) == [["de", "en"], [], ["fr"], [], [], [], ["fr"]]


def test_held_out_accuracy(spark, data):
    docs, labels = data
    part = F.pmod(F.xxhash64("record_id"), F.lit(3)) == 0
    model = language.train(docs.where(~part), labels.where(~part))
    rows = docs.where(part).where("record_id not like 'w%'").collect()
    got = found(spark, model, [r["text"] for r in rows])
    assert np.mean([g == [r["record_id"][:2]] for g, r in zip(got, rows, strict=True)]) >= 0.9


def test_labels_in_many_spellings(spark):
    rows = spark.createDataFrame([("en-US",), ("GER",), (" pt-BR",), ("und",), (None,)], "x string")
    assert [r[0] for r in rows.select(language.clean_label(F.col("x"))).collect()] == ["en", "de", "pt", None, None]


def test_no_labels(spark, data):
    docs, labels = data
    model = language.train(docs, labels.limit(0))
    assert found(spark, model, ["der Akku lädt nicht"]) == [[]]


def _made_up(seed, n, wrong):
    """n messages of templates with slots per language, most of them English, and a label each; a share of the labels is wrong."""
    rng = np.random.default_rng(seed)
    shapes = {
        "en": ["{} drains overnight since the last update of the {}", "please tell us whether the {} works on your {}", "thanks for flagging that the {} sends empty messages to the {}", "no luck with {} and {}", "who do I talk to about {} of the {}"],
        "de": ["{} wurde nicht geliefert obwohl {} bezahlt ist", "könnt ihr bitte prüfen ob {} bei {} noch läuft", "ich warte seit Tagen auf eine Antwort wegen {} und {}"],
        "es": ["por qué {} no funciona desde ayer con {}", "necesito que miren {} porque mi {} se reinicia solo", "todavía no me han contestado sobre {} y {}"],
    }
    slot = lambda: "".join(rng.choice(list("abcdefgilmnorstuvz"), 7))
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "de", "es"], p=[0.8, 0.1, 0.1])
        text = rng.choice(shapes[lang]).format(slot(), slot())
        rows.append((text, str(rng.choice([x for x in shapes if x != lang]) if rng.random() < wrong else lang), lang))
    return rows


@pytest.mark.parametrize("seed", range(5))
def test_wrong_labels_make_no_centroids(seed):
    rows = _made_up(seed, 1_500, 0.15)  # more than half of the messages labelled de or es are English
    held = _made_up(100 + seed, 1_000, 0)
    df = np.bincount(language.vectors([t for t, *_ in rows])[1], minlength=language.DIM)
    model = language.fit([(t, given, 1.0) for t, given, _ in rows], df, len(rows))
    cos = model.cosines([t for t, *_ in held])
    named = np.array(model.langs)[np.argmax(cos, axis=1)]
    true = np.array([t for *_, t in held])
    taken = model.accepts(cos)
    assert (named == true)[taken].mean() >= 0.99 and taken.mean() >= 0.9


def test_both_forms_agree(spark, data):
    docs, labels = data
    model = language.train(docs, labels)
    texts = docs.unionByName(spark.createDataFrame([("t", "m", "Der Akku lädt nicht mehr. Please send us a message with your order."), ("t", "o", "ok")], docs.schema))
    every = {(r["record_id"], r["seg_no"], r["lang"]) for r in language.segments(language.identify(texts, model)).collect()}
    english = {i for i, *_ in every} - {i for i, _, lang in every if lang != "en"}
    some = {(r["record_id"], r["seg_no"], r["lang"]) for r in language.segments(language.identify(texts, model, only_mixed_or_foreign=True)).collect()}
    assert some == {x for x in every if x[0] not in english}
