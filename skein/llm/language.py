"""The language of messages and of their segments, by nearest centroids of TF-IDF n-gram vectors.

A sentence is a vector of character trigrams (within words, with their edges), weighted by TF-IDF and normalised. Each
language has several centroids, clustered from sentences of labelled messages, whose labels are cleaned by a model of
their noise; a sentence takes the language of the centroid nearest by cosine. A sentence that is near to none, or about as
near to another language, is rejected and belongs to the sentence beside it; both bounds are fitted on held-out sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.codepoints import CharClass, encode, mix
from skein.llm.pii import ADDRESS, NAME, signals

LANGUAGES = ("de", "en", "es", "fr", "pt", "ru")
#: Buckets that trigrams are hashed to.
DIM = 1 << 15
#: Labelled messages the centroids are fitted on, per language: a bounded sample, taken in hash order of the ids.
SAMPLE = 3_000
CENTROIDS, ROUNDS = 8, 10
#: A centroid's components are damped by this power, so that trigrams of many sentences do not drown those of some.
DAMPED = 0.75
#: The share of distinct sentences held out to fit the bounds of rejection, and the share of those that belong to their language
#: and would still be rejected. Fewer than FEW of them say nothing of such a share: then the bounds are those of :class:`Model`.
HELD_OUT, REJECTED, FEW = 0.2, 0.004, 200
#: A sentence whose labels agree this often, and that much likelier with one true language than with any other, needs no other proof.
TIMES, LIKELIER = 3, 20.0
#: A cluster with a smaller share of its language's sentences than this part of an even share is dropped.
LEAST_CLUSTER = 0.1
#: A sentence of fewer letters is rejected, unless the whole message has no other; one that gives a number or an address to write
#: to needs as many more.
LEAST_LETTERS = 12
#: A message of so many letters in which all sentences are rejected needs only this part of the least cosine as a whole, as there is
#: no sentence beside it to belong to.
ALONE = 0.5
#: Sentences whose cosines are taken at once: their rows stay in the processor's cache.
AT_ONCE = 128
_GIVES = re.compile(r"\S@\S|\d(?:[ .()-]{0,2}\d){6,}|\d{2} \d{2} \d{2}|[a-z]{2}\d{6,}", re.I)

# Names of the languages in labels, by their first letters.
_NAMES = {"en": "en", "eng": "en", "de": "de", "ger": "de", "deu": "de", "fr": "fr", "fra": "fr", "fre": "fr", "es": "es", "spa": "es", "pt": "pt", "por": "pt", "ru": "ru", "rus": "ru"}

_LETTER = CharClass(str.isalpha)
#: What belongs to the sentence beside it has one of these marks: web and e-mail addresses, mentions, hashtags, signatures,
#: numbers and codes.
_MARK = CharClass(lambda c: c.isdigit() or c in "@#^&/")
_SPACE = CharClass(lambda c: c.isspace() or c == "\0")
ASIDE = re.compile(r"(?<!\S)[^\s\d@#^&/]*[\d@#^&/]\S*")
_END = re.compile(r"(?<=[.!?…])[\"'»”)]*\s+|\s+/\s+|\n+")


def clean_label(c: Column) -> Column:
    """A label as one of the languages, whatever its case and region; null for ``und`` and others."""
    low = F.lower(F.split(F.trim(c), r"[-_]")[0])
    out = F.lit(None).cast("string")
    for name, lang in _NAMES.items():
        out = F.when(low == name, F.lit(lang)).otherwise(out)
    return out


def sentences(text: str) -> list[str]:
    """The text's sentences: they end with a stop and white space, or with a line."""
    return [s for s in _END.split(text) if s.strip()]


def mask(sentence: str) -> str:
    """A sentence without the names and addresses in it."""
    told = signals(sentence)
    if "name" in told:
        for start, end in sorted(((*m.span("name"),) for m in NAME.finditer(sentence)), reverse=True):
            sentence = sentence[:start] + sentence[end:]
    return ADDRESS.sub(" ", sentence) if "place" in told else sentence


def n_letters(sentence: str) -> int:
    """The letters that speak for a sentence's language."""
    n = sum(map(str.isalpha, ASIDE.sub(" ", sentence)))
    return n - LEAST_LETTERS if _GIVES.search(sentence) else n


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, trigram, count): the trigrams of each text, hashed, sorted by text."""
    codes, starts = encode([f" {t} " for t in map(str.lower, texts)])
    letter = _LETTER(codes)
    piece = np.cumsum(_SPACE(codes))
    aside = np.zeros(int(piece[-1]) + 1 if len(piece) else 0, bool)
    aside[piece[_MARK(codes)]] = True
    letter &= ~aside[piece]
    c = np.where(letter, codes, 0).astype(np.uint64)
    # A trigram's middle is a letter; what is no letter is an edge.
    h = mix(c[:-2] * np.uint64(0x9E3779B1) + c[1:-1] * np.uint64(0x85EBCA77C2B2AE63) + c[2:] * np.uint64(0xC2B2AE3D27D4EB4F))
    at = np.flatnonzero(letter[1:-1])
    doc = np.searchsorted(starts, at + 1, side="right") - 1
    both = np.sort(doc * DIM + (h[at] % np.uint64(DIM)).astype(np.int64))
    if not len(both):
        return both, both, both
    new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    return both[new] // DIM, both[new] % DIM, np.diff(np.append(new, len(both)))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the number of texts: over all of them."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            rows = batch.column(0).to_pylist()
            seen += np.bincount(vectors(rows)[1], minlength=DIM)
            n += len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.flatnonzero(seen), DIM)), pa.array(np.append(seen[seen > 0], n))], ["bucket", "n"])

    out = np.zeros(DIM + 1, np.int64)
    for r in texts.mapInArrow(over, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most DIM + 1 rows
        out[r["bucket"]] = r["n"]
    return out[:DIM], int(out[DIM])


class Model:
    """Centroids (one column each), their languages, the weights of trigrams, and the bounds of rejection.

    A sentence whose best cosine is below ``least``, or of which another language has more than ``rival`` times as much, is rejected.
    """

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, langs: list[str], least: float = 0.05, rival: float = 0.8) -> None:
        order = sorted(range(len(langs)), key=lambda i: langs[i])
        self.langs = sorted(set(langs))
        self.first = np.array([next(k for k, i in enumerate(order) if langs[i] == lang) for lang in self.langs])
        self.idf, self.weights = idf, np.ascontiguousarray((idf[:, None] * centroids[:, order]).astype(np.float32))
        self.least, self.rival = least, rival

    def cosines(self, texts: list[str]) -> np.ndarray:
        """The cosine of each text with the nearest centroid of each language; 0 for texts without letters."""
        doc, gram, n = vectors(texts)
        out = np.zeros((len(texts), len(self.langs)), np.float32)
        if not len(doc):
            return out
        # The rows of the trigrams that occur, close together.
        seen = np.zeros(DIM, bool)
        seen[gram] = True
        rows, at = self.weights[seen], (np.cumsum(seen) - 1)[gram]
        starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        norm = np.sqrt(np.add.reduceat((n * self.idf[gram]) ** 2, starts))
        times, ends = n.astype(np.float32), np.append(starts, len(doc))
        for a in range(0, len(starts), AT_ONCE):
            low, high = ends[a], ends[min(a + AT_ONCE, len(starts))]
            own = rows[at[low:high]]
            more = np.flatnonzero(n[low:high] > 1)
            own[more] *= times[low:high][more, None]
            dots = np.add.reduceat(own, starts[a : a + AT_ONCE] - low)
            out[doc[starts[a : a + AT_ONCE]]] = np.maximum.reduceat(dots, self.first, axis=1)
        out[doc[starts]] /= np.maximum(norm, 1e-9)[:, None]
        return out

    def accepts(self, cos: np.ndarray, part: float = 1.0) -> np.ndarray:
        """Which sentences, by their cosines with each language, are not rejected for their distance; with ``part`` of the least."""
        best = cos.max(axis=1)
        second = np.partition(cos, -2, axis=1)[:, -2] if cos.shape[1] > 1 else np.zeros(len(cos), cos.dtype)
        return (best >= part * self.least) & (second <= self.rival * best)


def _sums(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by ``doc``, which is sorted."""
    out = np.zeros((n, *values.shape[1:]), values.dtype)
    if len(doc):
        starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        out[doc[starts]] = np.add.reduceat(values, starts)
    return out


class _Vectors:
    """Normalised TF-IDF vectors of some texts, each with a weight."""

    def __init__(self, texts: list[str], weight: np.ndarray, idf: np.ndarray) -> None:
        self.n, self.weight = len(texts), weight
        self.doc, self.gram, n = vectors(texts)
        val = n * idf[self.gram]
        self.val = (val / np.sqrt(np.maximum(_sums(self.doc, val**2, len(texts)), 1e-9))[self.doc]).astype(np.float32)

    def mean(self, members: np.ndarray) -> np.ndarray:
        c = np.bincount(self.gram, weights=np.where(members[self.doc], self.val * self.weight[self.doc], 0), minlength=DIM)
        return (c / max(float(np.linalg.norm(c)), 1e-9)).astype(np.float32)

    def near(self, centres: list[np.ndarray]) -> np.ndarray:
        """The cosine of each text with each centre; some texts at a time, so that little memory is needed."""
        c, out = np.stack(centres, axis=1), np.zeros((self.n, len(centres)), np.float32)
        ends = np.searchsorted(self.doc, np.arange(0, self.n + 2_000, 2_000))
        for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            some = out[2_000 * i : 2_000 * (i + 1)]
            some[:] = _sums(self.doc[a:b] - 2_000 * i, self.val[a:b, None] * c[self.gram[a:b]], len(some))
        return out

    def pick(self, at: np.ndarray) -> _Vectors:
        """Those of some of the texts, whose places are in order."""
        out = object.__new__(_Vectors)
        own = np.zeros(self.n, bool)
        own[at] = True
        keep = own[self.doc]
        out.n, out.weight, out.gram, out.val = len(at), self.weight[at], self.gram[keep], self.val[keep]
        out.doc = (np.cumsum(own) - 1)[self.doc[keep]]
        return out


def _distinct(labelled: list[tuple[str, str, float]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(sentences, votes, times) of labelled (text, lang, weight): the distinct sentences by their letters, what weight of labels
    each has per language, and in how many texts it is."""
    votes: dict[str, np.ndarray] = {}
    times: dict[str, int] = {}
    for text, lang, weight in labelled:
        for part in {" ".join(re.findall(r"[^\W\d_]+", ASIDE.sub(" ", mask(s)).lower())) for s in sentences(text)} - {""}:
            votes.setdefault(part, np.zeros(len(LANGUAGES)))[LANGUAGES.index(lang)] += weight
            times[part] = times.get(part, 0) + 1
    texts = sorted(votes)
    return texts, np.array([votes[t] for t in texts]).reshape(-1, len(LANGUAGES)), np.array([times[t] for t in texts], float)


def _noise(votes: np.ndarray, placed: np.ndarray) -> np.ndarray:
    """How often each label is given to texts of each true language (true x given, none is 0), by the votes on placed texts."""
    out = np.stack([votes[placed == i].sum(axis=0) for i in range(len(LANGUAGES))])
    out = out / np.maximum(out.sum(axis=1, keepdims=True), 1e-9) + 0.01
    return out / out.sum(axis=1, keepdims=True)


def _likelihoods(votes: np.ndarray, noise: np.ndarray, present: list[int]) -> np.ndarray:
    """The log-likelihood of votes (a row each) if the true language is each of those present."""
    return votes @ np.log(noise[present]).T


def _cluster(own: _Vectors, k: int, rounds: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Spherical k-means. Starts are ordinary members, drawn by their distance from those before, which counts no more than that
    of most members: an outlier is no likelier a start than others. Small clusters are dropped."""
    centres = [own.mean(np.ones(own.n, bool))]
    far = 1 - own.near(centres)[:, 0]
    while len(centres) < min(k, own.n):
        odds = own.weight * np.minimum(far, np.quantile(far, 0.75)).clip(1e-6)
        start = own.mean(np.arange(own.n) == rng.choice(own.n, p=odds / odds.sum()))
        far = np.minimum(far, 1 - own.near([start])[:, 0])
        centres.append(start)
    for r in range(rounds):
        at = np.argmax(own.near(centres), axis=1)
        size = np.bincount(at, weights=own.weight, minlength=len(centres))
        least = LEAST_CLUSTER * own.weight.sum() / k if r > 1 else 0
        centres = [own.mean(at == i) for i in range(len(centres)) if size[i] > least]
    return centres


def fit(labelled: list[tuple[str, str, float]], df: np.ndarray, n_texts: int, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 0) -> Model:
    """A model from (text, lang, weight), the weight being how many labelled messages the row stands for.

    Labels are often wrong, and mixed texts have only one. The distinct sentences are placed by the mean vectors of the
    languages; how often each label is given to sentences of each language is the noise of the labels. A sentence of
    several labels takes the language that makes them likeliest; one of a single label is kept only if it is placed there.
    What is kept is clustered within each language. A cluster whose labels are likelier those of another language is
    dropped. A share of the sentences takes no part in this: the bounds of rejection are quantiles of its cosines.
    """
    texts, votes, times = _distinct(labelled)
    idf = np.log((1 + n_texts) / (1 + df)) + 1
    if not texts:
        return Model(idf, np.zeros((DIM, 1), np.float32), ["en"])  # everything is rejected
    rng = np.random.default_rng(seed)
    every, label = _Vectors(texts, times, idf), np.argmax(votes, axis=1)
    held = rng.random(len(texts)) < HELD_OUT
    held &= np.bincount(label[~held], minlength=len(LANGUAGES))[label] > 0
    present = np.flatnonzero(np.bincount(label[~held], minlength=len(LANGUAGES)))
    counts, kept = votes / votes.sum(axis=1, keepdims=True) * times[:, None], ~held
    for _ in range(4):
        means = [every.mean((label == i) & (kept if (kept & (label == i)).any() else ~held)) for i in present]
        placed = present[np.argmax(every.near(means), axis=1)]
        noise = _noise(votes, placed)
        like = _likelihoods(counts, noise, present)
        top = np.sort(like, axis=1)
        sure = (times >= TIMES) & ((top[:, -1] - top[:, -2] > np.log(LIKELIER)) if len(present) > 1 else True)
        label = np.where(sure, present[np.argmax(like, axis=1)], label)
        kept = ~held & (sure | (placed == label))
    centres, names = [], []
    for i in present.tolist():
        own = np.flatnonzero((label == i) & kept)
        found = _cluster(every.pick(own), centroids, rounds, rng) if len(own) else []
        centres += found
        names += [i] * len(found)
    while True:
        near = every.near(centres)
        at = np.argmax(near, axis=1)[~held]
        given = np.stack([np.bincount(at, weights=votes[~held, i], minlength=len(names)) for i in range(len(LANGUAGES))], axis=1)
        good = (present[np.argmax(_likelihoods(given, noise, present), axis=1)] == np.array(names)) | (given.sum(axis=1) == 0)
        if good.all() or not good.any():
            break
        centres, names = [c for c, g in zip(centres, good, strict=True) if g], [x for x, g in zip(names, good, strict=True) if g]
    damped = [c**DAMPED / max(float(np.linalg.norm(c**DAMPED)), 1e-9) for c in centres]
    model = Model(idf, np.stack(damped, axis=1), [LANGUAGES[i] for i in names])
    # Held-out sentences that are placed as they are labelled, long enough to speak for themselves.
    asked = np.flatnonzero(held & (placed == label))
    asked = asked[[sum(map(str.isalpha, texts[i])) >= LEAST_LETTERS for i in asked.tolist()]]
    cos = np.sort(model.cosines([texts[i] for i in asked.tolist()]), axis=1)
    if len(cos) >= FEW and cos.shape[1] > 1:
        model.least = float(np.quantile(cos[:, -1], REJECTED / 2))
        model.rival = float(np.quantile(cos[:, -2] / np.maximum(cos[:, -1], 1e-9), 1 - REJECTED / 2))
    return model


def segment(cos: np.ndarray, accepted: np.ndarray, langs: list[str]) -> list[tuple[str, float, int, int]]:
    """(lang, confidence, first, last) runs of a message's sentences, from their cosines with each language.

    Rejected sentences belong to the run before them, those at the start to the run after. The confidence is the share of
    the best language in the summed squared cosines of the run's own sentences. No accepted sentence: no run.
    """
    runs: list[list] = []
    for i, row in enumerate(cos):
        if not accepted[i]:
            if runs:
                runs[-1][2] = i
            continue
        lang = langs[int(np.argmax(row))]
        if runs and runs[-1][0] == lang:
            runs[-1][2] = i
            runs[-1][3] = runs[-1][3] + row**2
        else:
            runs.append([lang, i if runs else 0, i, row**2])
    return [(lang, float(v[langs.index(lang)] / v.sum()), a, b) for lang, a, b, v in runs]


def classify(texts: list[str], m: Model) -> tuple[list[tuple[int, list[tuple[str, float, int, int]]]], np.ndarray, np.ndarray, np.ndarray]:
    """(apart, english, confidence, sentences): the texts taken apart, by place and with their segments; which of the others are
    English, with what confidence, and how many sentences each text has.

    Texts no sentence of which is nearer to another language than to English are English, or nothing if all their
    sentences are rejected. The others are taken apart without the names and addresses in them, which may be in another
    language than the sentence around them. Where all sentences are rejected the whole text may still speak for itself.
    """
    parts = [sentences(t) for t in texts]
    n = np.array([len(p) for p in parts], np.int64)
    cos = m.cosines([s for p in parts for s in p])
    own = np.repeat(np.arange(len(texts)), n)
    english = m.langs.index("en") if "en" in m.langs else -1
    other = (np.argmax(cos, axis=1) != english) & (cos.max(axis=1) >= ALONE * m.least)
    foreign = np.bincount(own[other], minlength=len(texts)) > 0
    speaks = m.accepts(cos) & ~foreign[own] & (english >= 0)
    power = np.stack([np.bincount(own[speaks], weights=cos[speaks, i].astype(float) ** 2, minlength=len(texts)) for i in range(len(m.langs))], axis=1)
    total = power.sum(axis=1)
    at = np.flatnonzero(foreign).tolist()
    plain = [[mask(p) for p in parts[i]] for i in at]
    cos = m.cosines([s for p in plain for s in p])
    good = m.accepts(cos) & np.array([n_letters(s) >= LEAST_LETTERS for p in plain for s in p], bool)
    apart, done = [], 0
    for i, p in zip(at, plain, strict=True):
        rows = slice(done, done + len(p))
        done += len(p)
        got = segment(cos[rows], good[rows], m.langs)
        if not got:
            row = m.cosines([" ".join(p)]) if len(p) > 1 else cos[rows]
            part = ALONE if sum(map(n_letters, p)) >= LEAST_LETTERS else 1.0
            got = [(lang, c, 0, len(p) - 1) for lang, c, _, _ in segment(row, m.accepts(row, part), m.langs)]
        apart.append((i, got))
    return apart, (total > 0), power[:, english] / np.maximum(total, 1e-12), n


_OUT = "src_table string, record_id string, segs array<struct<lang:string,confidence:double,first:int,last:int>>"


def identify(docs: DataFrame, model: Model, only_mixed_or_foreign: bool = False) -> DataFrame:
    """(src_table, record_id, segs): the segments of every text of (src_table, record_id, text), in order.

    Null texts are left out; a text without a classified sentence has an empty list. With ``only_mixed_or_foreign`` texts
    that are wholly English, or without a language, are left out. Repeated records come each time; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("first", pa.int32()), ("last", pa.int32())]))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart, english, sure, n = classify(batch.column(2).to_pylist(), shared.value)
            if only_mixed_or_foreign:
                out = {i: got for i, got in apart if not {lang for lang, *_ in got} <= {"en"}}
            else:
                out = {i: [("en", sure[i], 0, n[i] - 1)] if english[i] else [] for i in range(batch.num_rows)} | dict(apart)
            segs = [[dict(zip(("lang", "confidence", "first", "last"), s, strict=True)) for s in got] for got in out.values()]
            at = pa.array(list(out), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(segs, kind)], ["src_table", "record_id", "segs"])

    rows = docs.select(F.col("src_table").cast("string"), F.col("record_id").cast("string"), F.col("text").cast("string")).where("text is not null")
    return rows.mapInArrow(over, _OUT)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the labels (src_table, record_id, lang) of the texts (src_table, record_id, text).

    Trigram counts cover all texts; the centroids are fitted on at most ``sample`` labelled messages per language, the
    first in hash order of the id, so that they depend on nothing else.
    """
    from pyspark.sql import Window

    df, n = document_frequencies(docs.where("text is not null").select("text"))
    known = labels.select("src_table", "record_id", clean_label(F.col("lang")).alias("lang")).where("lang is not null and record_id is not null")
    order = F.xxhash64("src_table", "record_id")
    of_lang = known.groupBy("lang").agg(F.count("*").alias("of_lang"))
    few = known.withColumn("part", F.pmod(order, F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(order, "record_id")))
    few = few.where(f"rank <= {-(-sample // 64)}").join(F.broadcast(of_lang), "lang").select("src_table", "record_id", "lang", "of_lang")
    got = docs.join(F.broadcast(few), ["src_table", "record_id"]).where("text is not null")  # few is bounded by the sample
    got = got.groupBy("src_table", "record_id", "lang", "of_lang").agg(F.min("text").alias("text")).select("text", "lang", "of_lang").collect()
    taken = {lang: sum(r["lang"] == lang for r in got) for lang in LANGUAGES}
    return fit(sorted((r["text"], r["lang"], r["of_lang"] / taken[r["lang"]]) for r in got), df, n)


def segments(found: DataFrame) -> DataFrame:
    """(src_table, record_id, seg_no, lang, confidence): one row per segment; of a repeated record the smallest list counts."""
    once = found.groupBy("src_table", "record_id").agg(F.min("segs").alias("segs"))
    return once.select("src_table", "record_id", F.posexplode("segs").alias("pos", "s")).select("src_table", "record_id", (F.col("pos") + 1).alias("seg_no"), "s.lang", "s.confidence")
