"""Evaluation texts that leaked into a corpus, found by latent semantic retrieval.

Items are cut into overlapping passages; their TF-IDF matrix, weighted by word counts over the whole corpus, is reduced
by a distributed randomised SVD. Passages of documents are folded into the same space and compared by cosine; whatever
comes near an item's passage is checked word by word: for a verbatim run, or, for paraphrases, by the longest common
subsequence and by the item's answers (its numbers and codes). A cosine of whole windows says little of a short stretch in
one, so candidates for paraphrases are counted instead: the words and answers that a window shares with an item.

The items are the query set: they are small and broadcast, in blocks of ``ITEM_BLOCK``. Documents are only ever scanned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.codepoints import CharClass, encode, mix, window_hashes, words
from skein.session import cut

#: Words of a passage and the step to the next: any run of MIN_RUN words lies within one passage.
MIN_RUN, PASSAGE, STEP = 16, 48, 32
RANK, POWER_ROUNDS = 64, 2
#: A document's passage is a candidate for a verbatim run of the items within this cosine; where that leaves a shared run
#: unexplained it is one for all items. Of the verbatim runs of the test tables (16 of a passage's 48 words) none comes below 0.35.
NEAR = 0.25
#: Passages compared at once: their cosines stay in the processor's cache.
BLOCK = 96
#: Items compared at once; each block is a scan of the documents.
ITEM_BLOCK = 20_000
LEAST_COMMON, LEAST_ANSWERS = 0.6, 0.5
#: Fewest words of a paraphrase, and windows such that any stretch of so many words lies within one. TABLE items are counted at once.
STRETCH, WINDOW, TABLE = 24, 32, 1_000
HOP = WINDOW - STRETCH
#: Answers that are enough in PASSAGE words of which 0.6 are the item's, and of a stretch by its own numbers.
PASSAGE_ANSWERS = 3

_WORD = CharClass(str.isalnum)
_DIGIT = CharClass(str.isdigit)


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, numeric) of all words, lower-cased, in order; numeric if the word has a digit."""
    codes, starts = encode([t.lower() for t in texts])
    h, start, end = words(codes, _WORD(codes))
    digits = np.concatenate([[0], np.cumsum(_DIGIT(codes))])
    return h, np.searchsorted(starts, start, side="right") - 1, digits[end] > digits[start]


def _passages(n: int, size: int, step: int) -> list[tuple[int, int]]:
    """Where the passages of n words start and stop; the last reaches the end."""
    last = max(0, -(-(n - size) // step))
    return [(step * j, min(n, step * j + size)) for j in range(last + 1)]


class Items:
    """A block of items: their words, passages and runs."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.ids = np.array([i for i, _ in rows], np.int64)
        h, doc, numeric = _words([t for _, t in rows])
        self.vocabulary = np.unique(h)
        at = np.searchsorted(self.vocabulary, h)
        ends = np.searchsorted(doc, np.arange(len(rows)), side="right")
        self.words = np.split(at, ends[:-1]) if len(rows) else []
        self.answers = [np.unique(w[f]) for w, f in zip(self.words, np.split(numeric, ends[:-1]) if len(rows) else [], strict=True)]
        #: How many answers a document's window must repeat of each item: half of those expected in so many words.
        self.needed = np.array([max(1, -(-LEAST_ANSWERS * min(len(own), WINDOW // 8) // 1)) for own in self.answers])
        self.passages = [(i, w[a:b]) for i, w in enumerate(self.words) if len(w) for a, b in _passages(len(w), PASSAGE, STEP)]
        runs = [(window_hashes(h[e - len(w) : e], MIN_RUN), i) for i, (w, e) in enumerate(zip(self.words, ends, strict=True))]
        keys = [mix(g ^ mix(np.uint64(i) + np.zeros(1, np.uint64))) for g, i in runs if len(g)]
        self.runs = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        #: Every item's runs, how many items have each, and their first 22 bits: most stretches of a document that are no run
        #: are told by these.
        own = [np.unique(g) for g, _ in runs]
        self.grams, self.holders = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.starts = np.zeros(1 << 22, bool)
        self.starts[self.grams >> np.uint64(42)] = True

    def tables(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By TABLE items: (first item, row of each word, has, answers, bodies); has and answers are words x items, the last row and word -1 no item's."""
        for a in range(0, len(self.ids), TABLE):
            words = self.words[a : a + TABLE]
            own = np.unique(np.concatenate(words))
            row = np.full(len(self.vocabulary) + 1, len(own))
            row[own] = np.arange(len(own))
            has, answers = (np.zeros((len(own) + 1, len(words)), np.uint8) for _ in range(2))
            bodies = np.full((len(words), max(map(len, words))), -2)
            for i, w in enumerate(words):
                has[row[w], i], answers[row[self.answers[a + i]], i], bodies[i, : len(w)] = 1, 1, w
            yield a, row, has, answers, bodies

    def held(self, grams: np.ndarray) -> np.ndarray:
        """How many items have each of these runs of words."""
        out = np.zeros(len(grams), np.int64)
        some = np.flatnonzero(self.starts[grams >> np.uint64(42)])
        at = _lookup(self.grams, grams[some])
        out[some[at >= 0]] = self.holders[at[at >= 0]]
        return out

    def is_run(self, keys: np.ndarray) -> np.ndarray:
        return _lookup(self.runs, keys) >= 0


def _lookup(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def document_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each word of the vocabulary occurs, and the number of documents: over all of them."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(len(shared.value), np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            h, doc, _ = _words(texts)
            at = _lookup(shared.value, h)
            both = np.unique(doc[at >= 0] * len(seen) + at[at >= 0]) if len(seen) else at[:0]
            seen += np.bincount(both % max(1, len(seen)), minlength=len(seen))
            n += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.flatnonzero(seen), -1)), pa.array(np.append(seen[seen > 0], n))], ["word", "n"])

    out, total = np.zeros(len(vocabulary), np.int64), 0
    counted = docs.mapInArrow(over, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # at most one row per word of the items
        if r["word"] < 0:
            total = r["n"]
        else:
            out[r["word"]] = r["n"]
    return out, total


def randomised_svd(passages: DataFrame, idf: np.ndarray, rank: int, rounds: int = POWER_ROUNDS, seed: int = 0) -> np.ndarray:
    """The leading right singular vectors (words x rank) of the TF-IDF matrix of ``passages`` (terms array<int>), a row a passage.

    Each round multiplies a random basis by the matrix and its transpose: a task does so for its passages and returns one
    words x rank block; blocks are summed and the basis made orthonormal. The matrix is never in one place.
    """
    spark = passages.sparkSession
    basis = np.random.default_rng(seed).standard_normal((len(idf), min(rank, max(1, len(idf))))).astype(np.float32)
    weights = spark.sparkContext.broadcast(idf)
    for _ in range(rounds + 1):
        shared = spark.sparkContext.broadcast(basis)

        def over(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            b, w = shared.value, weights.value
            out = np.zeros_like(b)
            for batch in batches:
                for terms in batch.column(0).to_pylist():
                    x, n = np.unique(np.array(terms, np.int64), return_counts=True)
                    row = (n * w[x]).astype(np.float32)
                    row /= max(float(np.linalg.norm(row)), 1e-9)
                    out[x] += row[:, None] * (row @ b[x])[None, :]
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["block"])

        blocks = passages.mapInArrow(over, "block binary").toLocalIterator()
        total = reduce(np.add, (np.frombuffer(r["block"], np.float32).reshape(basis.shape) for r in blocks))
        basis = np.linalg.qr(total.astype(np.float64))[0].astype(np.float32)
    return basis


def _fold(terms: list[np.ndarray], space: np.ndarray) -> np.ndarray:
    """Passages in the latent space, as unit vectors; ``space`` holds the weighted vector of each word."""
    n = np.array([len(t) for t in terms])
    out = np.zeros((len(terms), space.shape[1]), np.float32)
    if n.sum():
        full = np.flatnonzero(n)
        out[full] = np.add.reduceat(space[np.concatenate(terms)], (np.cumsum(n) - n)[full])
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common subsequence of two word sequences."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        hit = row[:-1] + (b == x)
        row = np.concatenate([[0], np.maximum.accumulate(np.maximum(hit, row[1:]))])
    return int(row[-1])


def longest_stretch(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int] | None:
    """(start, end, common) of the longest stretch of a, of STRETCH words or more, of which b has LEAST_COMMON in order."""
    rows = np.zeros((max(0, len(a) - STRETCH + 1), len(b) + 1), np.int16)
    best = None
    for k, equal in enumerate(a[:, None] == b):
        own = rows[: k + 1]  # a row for each start so far
        hit = own[:, :-1] + equal
        np.maximum(hit, own[:, 1:], out=hit)
        np.maximum.accumulate(hit, axis=1, out=own[:, 1:])
        if k + 1 >= STRETCH:
            n = k + 1 - np.arange(k + 2 - STRETCH)
            fits = np.flatnonzero(own[: len(n), -1] >= LEAST_COMMON * n - 1e-9)
            if len(fits) and (best is None or n[fits[0]] > best[1] - best[0]):
                best = (int(fits[0]), k + 1, int(own[fits[0], -1]))
    return best


def _reach(a: np.ndarray, b: np.ndarray, common: int) -> int:
    """The length of the shortest prefix of b that has ``common`` words of a in order."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row = np.concatenate([[0], np.maximum.accumulate(np.maximum(row[:-1] + (b == x), row[1:]))])
    return int(np.searchsorted(row, common))


def _answers(stretch: np.ndarray, numbers: int, body: np.ndarray, answers: np.ndarray, common: int) -> bool:
    """Whether a stretch repeats an answer, and half of those of the part of the item that it follows or half of its own ``numbers`` are the item's."""
    there = len(np.intersect1d(stretch, answers))
    if there >= PASSAGE_ANSWERS and there >= LEAST_ANSWERS * numbers:
        return True
    ends = sorted((_reach(stretch, body, common), len(body) - _reach(stretch[::-1], body[::-1], common)))
    asked = np.intersect1d(body[slice(*ends)], answers)
    return np.isin(asked, stretch).sum() >= max(1, LEAST_ANSWERS * len(asked))


def _whole(part: np.ndarray, body: np.ndarray, answers: np.ndarray) -> int:
    """The common words of a passage or a short document that repeats an item in LEAST_COMMON of all its words, with enough answers; else 0."""
    if len(np.intersect1d(part, answers)) < max(1, -(-LEAST_ANSWERS * min(len(answers), 2 * PASSAGE_ANSWERS) // 1)) or np.isin(part, body).sum() < LEAST_COMMON * len(part):
        return 0
    common = common_subsequence(part, body)
    return common if common >= LEAST_COMMON * len(part) else 0


def _common(windows: np.ndarray, bodies: np.ndarray) -> np.ndarray:
    """The length of the longest common subsequence of each row of the one and of the other."""
    row = np.zeros((len(windows), bodies.shape[1] + 1), np.int8)
    for k in range(windows.shape[1]):
        hit = row[:, :-1] + (bodies == windows[:, k, None])
        np.maximum(hit, row[:, 1:], out=hit)
        np.maximum.accumulate(hit, axis=1, out=row[:, 1:])
    return row[:, -1]


def _dense(hits: np.ndarray) -> np.ndarray:
    """Whether some stretch of STRETCH or more columns has LEAST_COMMON of them set, by row."""
    total = np.zeros((len(hits), hits.shape[1] + 1), np.float32)
    np.cumsum(hits - np.float32(LEAST_COMMON), axis=1, out=total[:, 1:])
    low = np.minimum.accumulate(total, axis=1)
    return (total[:, STRETCH:] - low[:, : total.shape[1] - STRETCH] >= -1e-3).any(axis=1)


def _paraphrased(items: Items, at: np.ndarray, numeric: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, item, common) of windows with a stretch that repeats an item; ``common`` words of the longest one.

    The counts that rule pairs out are upper bounds, so none is lost: the words, the answers, the words of a stretch,
    and the common subsequence that a window has with an item.
    """
    least = int(np.ceil(LEAST_COMMON * STRETCH - 1e-9))
    start_of, end_of = (np.repeat(x, ends - begins) for x in (begins, ends))  # of the document of each word
    long = ends - begins >= STRETCH
    # The last passage of a document, or all of a short one, counts as a whole.
    short = [(a + _passages(b - a, PASSAGE, STEP)[-1][0], b) for a, b in zip(begins.tolist(), ends.tolist(), strict=True) if b > a]
    begins, ends = begins[long], ends[long]
    n = -(-(ends - begins) // HOP)
    start = np.repeat(begins, n) + HOP * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    end = np.minimum(start + WINDOW, np.repeat(ends, n))
    padded = np.concatenate([at, np.full(WINDOW, -1)])
    for first, row, has, answers, bodies in items.tables():
        needed = items.needed[first : first + len(bodies)]
        for a, b in short:
            rows = row[at[a:b]]
            hopes = (has[rows].sum(axis=0, dtype=np.int64) >= LEAST_COMMON * (b - a)) & answers[rows].any(axis=0)
            for item in (first + np.flatnonzero(hopes)).tolist():
                if common := _whole(at[a:b], items.words[item], items.answers[item]):
                    yield a, b, item, common
        for a in range(0, len(start), 4_000):
            s, e = start[a : a + 4_000], end[a : a + 4_000]
            spots = s[:, None] + np.arange(WINDOW)
            words = np.where(spots < e[:, None], padded[spots], -1)
            w, i = [], []
            for b in range(0, len(s), 50):
                rows = row[words[b : b + 50]]
                x, y = np.nonzero(has[rows].sum(axis=1, dtype=np.uint8) >= least)
                enough = np.zeros(len(x), np.int64)
                for k in range(WINDOW):
                    enough += answers[rows[x, k], y]
                w.append(x[enough >= needed[y]] + b)
                i.append(y[enough >= needed[y]])
            w, i = np.concatenate(w), np.concatenate(i)
            for part in np.array_split(np.arange(len(w)), len(w) // 5_000 + 1):
                x, y = w[part], i[part]
                ok = _dense(has[row[words[x]], y[:, None]])
                x, y = x[ok], y[ok]
                ok = _common(words[x], bodies[y]) >= least
                for k, item in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                    own, item = at[s[k] : e[k]], first + item
                    body, wanted = items.words[item], items.answers[item]
                    if np.isin(wanted, own).sum() < items.needed[item] or not (got := longest_stretch(own, body)):
                        continue
                    low, high = s[k] + got[0], s[k] + got[1]
                    if _answers(at[low:high], int(numeric[low:high].sum()), body, wanted, got[2]):
                        yield int(s[k]), int(e[k]), item, got[2]
                        continue
                    for low in (max(start_of[s[k]], s[k] + WINDOW - PASSAGE), s[k]):
                        high = min(low + PASSAGE, end_of[s[k]])
                        if common := _whole(at[low:high], body, wanted):
                            yield int(low), int(high), item, common


def _scan(items: Items, space: np.ndarray, targets: np.ndarray, verbatim: bool):
    owner = np.array([i for i, _ in items.passages], np.int64)

    def near(terms: list[np.ndarray], least: float, checked: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(passage, item, cosine) of candidates, each item once per passage; some passages at a time.

        ``checked`` says of each passage whether the check that follows can succeed at all.
        """
        for a in range(0, len(terms), BLOCK):
            cos = _fold(terms[a : a + BLOCK], space) @ targets.T
            p, q = np.divmod(np.flatnonzero(cos >= least), len(owner))
            if checked is not None:
                p, q = p[checked[p + a]], q[checked[p + a]]
            key = (p + a) * len(items.ids) + owner[q]
            order = np.lexsort((-cos[p, q], key))
            first = order[np.concatenate([[True], np.diff(key[order]) != 0])] if len(order) else order
            yield p[first] + a, owner[q[first]], cos[p[first], q[first]]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            h, doc, numeric = _words(batch.column(1).to_pylist())
            at = _lookup(items.vocabulary, h)
            rows = {"doc_id": [], "item_id": [], "kind": [], "cosine": [], "common": []}

            def put(d, i, kind, cos, common, rows=rows, ids=ids) -> None:
                for name, x in (("doc_id", ids[d]), ("item_id", items.ids[i]), ("kind", np.full(len(d), kind)), ("cosine", cos.astype(float)), ("common", common)):
                    rows[name].append(x)

            if verbatim:
                # A verbatim run has only words of items: stretches of fewer such words hold none.
                known = np.concatenate([[0], (at >= 0).view(np.int8), [0]])
                cuts = np.flatnonzero(np.diff(known))
                start, end = cuts[0::2], cuts[1::2]
                breaks = np.flatnonzero(np.diff(doc)) + 1
                if len(breaks):  # a stretch ends with its document
                    inner = breaks[(at[breaks] >= 0) & (at[breaks - 1] >= 0)]
                    start, end = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))
                long = end - start >= MIN_RUN
                spots = [(s + a, s + b) for s, e in zip(start[long].tolist(), end[long].tolist(), strict=True) for a, b in _passages(e - s, PASSAGE, STEP)]
                grams = window_hashes(h, MIN_RUN)
                lows, highs = (np.array([x[k] for x in spots], np.int64) for k in range(2))
                held = np.concatenate([[0], np.cumsum(items.held(grams))])
                wanted = held[highs - MIN_RUN + 1] - held[lows]
                explained = np.zeros(len(spots), np.int64)
                rest = np.arange(len(spots))
                # Where the runs of the candidates within the bound are not all runs that the passage shares with items, the cosine
                # has missed an item: such passages are compared again without a bound, so that no run is lost.
                for least in (NEAR, -2.0):
                    for q, i, cos in near([at[spots[p][0] : spots[p][1]] for p in rest.tolist()], least, wanted[rest] > 0):
                        p = rest[q]
                        n = highs[p] - lows[p] - MIN_RUN + 1
                        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        key = mix(grams[np.repeat(lows[p], n) + offset] ^ np.repeat(mix(i.astype(np.uint64)), n))
                        found = np.add.reduceat(items.is_run(key).astype(np.int64), np.cumsum(n) - n) if len(n) else n
                        hit = found > 0
                        np.add.at(explained, p[hit], found[hit])
                        put(doc[lows[p[hit]]], i[hit], "verbatim", cos[hit], (found[hit] + MIN_RUN - 1).astype(np.int64))
                    rest = np.flatnonzero(explained < wanted)
                    if not len(rest):
                        break
            else:
                ends = np.searchsorted(doc, np.arange(batch.num_rows), side="right")
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                for a, b, item, common in _paraphrased(items, at, numeric, begins, ends.astype(np.int64)):
                    known = at[a:b][at[a:b] >= 0]
                    cos = (_fold([known], space) @ targets[owner == item].T).max(axis=1)
                    put(doc[[a]], np.array([item]), "paraphrase", cos, np.array([common]))
            if rows["doc_id"]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in rows.values()], list(rows))

    return over


_FOUND = "doc_id bigint, item_id bigint, kind string, cosine double, common bigint"


def leaks(docs: DataFrame, items: DataFrame, kinds: tuple[str, ...] = ("verbatim",), key: str = "doc_id", text: str = "text", item: str = "item_id", body: str = "body") -> DataFrame:
    """(doc_id, item_id, kind, cosine, common) of every document and item that share a passage.

    ``verbatim``: at least 16 consecutive words of the item are consecutive in the document (``common`` words, in the
    passage where most are). ``paraphrase``: of a stretch of at least 24 words of the document the item has 0.6 in the
    same order (``common`` words, in the window of 32 where most are), and it repeats half of the answers of the part of
    the item that it follows, or half of its own numbers and codes are the item's answers. Words are runs of letters and digits,
    lower-cased. Null texts and keys leak nothing; items shorter than a run cannot be found verbatim; repeated items or
    documents come once per key. No items or no documents give no rows; extra columns are ignored.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    wanted = items.select(F.col(item).cast("bigint").alias("i"), F.col(body).alias("b")).where("i is not null and b is not null").distinct()
    spark, found, block = docs.sparkSession, [], []

    def run(block: list[tuple[int, str]], more: bool) -> None:
        own = Items(sorted(block))
        if not own.passages:
            return
        df, n = document_counts(rows.select("text"), own.vocabulary)
        idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
        passages = spark.createDataFrame([(t.tolist(),) for _, t in own.passages], "terms array<int>")
        basis = randomised_svd(passages, idf, RANK)
        space = idf[:, None] * basis
        targets = _fold([t for _, t in own.passages], space)
        shared = spark.sparkContext.broadcast((own, space, targets))

        def scan(kind: str):
            def over(batches):
                yield from _scan(*shared.value, kind == "verbatim")(batches)

            return over

        parts = [rows.mapInArrow(scan(kind), _FOUND) for kind in kinds]
        if more:  # so that no more than one block of items is in memory at once
            parts = [cut(part) for part in parts]
            shared.destroy()
        found.extend(parts)

    for r in wanted.toLocalIterator():
        if len(block) == ITEM_BLOCK:
            run(block, True)
            block = []
        block.append((r["i"], r["b"]))
    if block:
        run(block, False)
    if not found:
        return spark.createDataFrame([], _FOUND)
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id", "kind").agg(F.max("cosine").alias("cosine"), F.max("common").alias("common"))
