"""Long exact spans shared between records, by compaction of a de Bruijn graph over minimizers.

Characters are too many for graph nodes, so the graph's tokens are the winnowed k-mers (minimizers) of a text: of every
``w`` neighbouring k-mers the one with the least hash. The sizes are chosen so that every passage of ``min_len``
characters holds a whole token: a token that occurs in one record only can be left out, and nothing is lost. Two
consecutive tokens of a record overlap; with their distance they make an edge, so equal edges are equal texts. The edges
between repeated tokens are compacted into nonbranching paths, and around the places where a record runs along a path the
source coordinates are verified, coarse to fine: what neighbouring runs of ``min_len`` characters there have in common is
compared with all other records' first, then, where that occurs elsewhere, each run, by hash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.codepoints import encode, mix, sliding_argmin, sliding_max, sliding_min, window_hashes
from skein.functions.sieve import Sieve
from skein.operators.graph import connected_components
from skein.session import cut, drop

#: Characters handled at once, so that the arrays stay in the processor's caches.
CHUNK = 150_000


def sizes(min_len: int) -> tuple[int, int]:
    """(k, w): w <= k, so that neighbouring tokens overlap, and k + w <= min_len + 1, so that a passage holds one."""
    w = max(1, (min_len + 1) // 2)
    return min_len + 1 - w, w


def tokens(text: str, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of a text's minimizers."""
    codes, _ = encode([text])
    return _tokens(codes[:-1], k, w)


def _tokens(codes: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    h = window_hashes(codes, k)
    if len(h) < w:
        return np.zeros(0, np.int64), h[:0]
    least = sliding_min(h, w)
    # A k-mer is a minimizer if it is the least of one of its windows: the largest of their minima is its own hash.
    top = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero(sliding_max(top, w) == h)
    return at, h[at]


def _chunks(ids: list, texts: list[str]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    a, n = 0, 0
    for b, text in enumerate(texts):
        n += len(text)
        if n >= CHUNK or b == len(texts) - 1:
            yield (ids[a : b + 1], *encode(texts[a : b + 1]))
            a, n = b + 1, 0


def _mark(k: int, w: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, codes, starts in _chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, h = _tokens(codes, k, w)
                doc = np.searchsorted(starts, at, side="right") - 1
                # A k-mer with the 0 behind a text is none of that text.
                inside = at + k < starts[doc + 1]
                at, h, doc = at[inside], h[inside], doc[inside]
                columns = [np.asarray(ids, dtype=np.int64)[doc], h.view(np.int64), (at - starts[doc]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "token", "at"])

    return over


def _regions(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc, place, codes, starts) of the texts' regions, many at once: the runs of ``size`` characters that start there."""
    docs, lows, pieces, n = [], [], [], 0
    for batch in batches:
        for doc, text, regions in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for low, high in merged(((r["low"], r["high"]) for r in regions), len(text) - size + 1):
                docs.append(doc)
                lows.append(low)
                pieces.append(text[low : high + size - 1])
                n += len(pieces[-1])
            if n >= CHUNK:
                yield np.array(docs, np.int64), np.array(lows, np.int64), *encode(pieces)
                docs, lows, pieces, n = [], [], [], 0
    if pieces:
        yield np.array(docs, np.int64), np.array(lows, np.int64), *encode(pieces)


def merged(regions: Iterable[tuple[int, int]], end: int) -> list[list[int]]:
    """Regions (low, high) within 0 and ``end``, in order; those that touch or overlap are one."""
    out: list[list[int]] = []
    for low, high in sorted((max(low, 0), min(high, end)) for low, high in regions):
        if low < high and out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        elif low < high:
            out.append([low, high])
    return out


def _inside(starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, piece) of every run of ``size`` code points that lies in one piece, without the 0 behind it."""
    n = np.maximum(np.diff(starts) - size, 0)
    piece = np.repeat(np.arange(len(n)), n)
    return np.arange(len(piece)) + (starts[:-1] - (np.cumsum(n) - n))[piece], piece


def _cores(size: int):
    """(doc, core, low, high): a hash of what the runs of ``size`` characters that start from ``low`` to ``high`` have in common.

    A run's least k-mer, the first of equal ones, depends on the run alone. Its distance from the start, in steps of a
    quarter of ``w``, says which ``size - step + 1`` characters are the core: they lie in the run, and equal runs have
    equal cores.
    """
    k, w = sizes(size)
    step = -(-w // 4)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, lows, codes, starts in _regions(batches, size):
            at, piece = _inside(starts, size)
            least = sliding_argmin(window_hashes(codes, k), w)[at]
            core = least - (least - at) // step * step
            first = np.flatnonzero(np.diff(core, prepend=-1))
            low = (lows[piece] + at - starts[piece])[first]
            high = low + np.diff(first, append=len(core))
            h = window_hashes(codes, size - step + 1)[core[first]]
            columns = [docs[piece[first]], h.view(np.int64), low.astype(np.int32), high.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "core", "low", "high"])

    return over


def _grams(size: int):
    """Two hashes of every run of ``size`` characters that starts in one of a text's regions."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, lows, codes, starts in _regions(batches, size):
            at, piece = _inside(starts, size)
            h, more = window_hashes(codes, size)[at], window_sums(codes, size)[at]
            columns = [docs[piece], h.view(np.int64), more, (lows[piece] + at - starts[piece]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "gram", "more", "at"])

    return over


def window_sums(codes: np.ndarray, size: int) -> np.ndarray:
    """A second hash, of 32 bits, of every run of ``size`` code points: independent of the first, by sums that only need two
    running totals. What is summed are mixed codes times their place, so the order counts."""
    spread = mix(codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x2545F4914F6CDD1D))
    place = np.arange(1, len(codes) + 1, dtype=np.uint64)
    plain, weighted = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (spread, spread * place))
    n = len(codes) - size + 1
    first = np.arange(n, dtype=np.uint64)
    own, by_place = plain[size : size + n] - plain[:n], weighted[size : size + n] - weighted[:n]
    return (mix(by_place - first * own + own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _paths(occurrences: DataFrame, k: int) -> DataFrame:
    """(doc, path, low, high): where records run along a nonbranching path of edges between repeated tokens.

    ``low`` is the first token's place and ``high`` the last one's. Where a token has one edge out and the token it leads
    to has one edge in, the two belong to one path; paths are the components of these links.
    """
    order = Window.partitionBy("doc").orderBy("at")
    after = F.lead(F.struct("token", "at")).over(order)
    steps = occurrences.withColumn("after", after).where(F.col("after.at") - F.col("at") <= k)
    edges = cut(steps.select("token", F.col("after.token").alias("to"), (F.col("after.at") - F.col("at")).alias("gap")).distinct())
    one_out = edges.groupBy("token").count().where("count = 1").select("token")
    one_in = edges.groupBy("to").count().where("count = 1").select("to")
    chain = edges.join(one_out, "token", "left_semi").join(one_in, "to", "left_semi")
    path = connected_components(chain, "token", "to").withColumnsRenamed({"node": "token", "component": "path"})
    named = occurrences.join(path, "token", "left").withColumn("path", F.coalesce("path", "token"))
    breaks = (F.lag("path").over(order) != F.col("path")) | (F.col("at") - F.lag("at").over(order) > k)
    runs = named.withColumn("run", F.sum(F.coalesce(breaks, F.lit(True)).cast("int")).over(order))
    return runs.groupBy("doc", "run").agg(F.first("path").alias("path"), F.min("at").alias("low"), F.max("at").alias("high")).drop("run")


def shared_spans(docs: DataFrame, min_len: int = 120, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, span_start, span_end): the longest stretches whose characters all lie in passages of at least ``min_len``
    characters that also occur in a record of another key.

    Places count code points from 0, the end is exclusive; stretches that touch or overlap are one. Case, spaces and
    marks count as they are. Null texts, null keys and texts shorter than ``min_len`` have no spans; of a repeated key
    the smallest text counts; passages repeated within a record alone are not shared. Copies of a whole text are found by
    digest and need no comparison, however many there are. Extra columns are ignored; an empty table has no spans.
    """
    k, w = sizes(min_len)
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).where(f"doc is not null and length(text) >= {min_len}")
    marks = cut(rows.mapInArrow(_mark(k, w), "doc bigint, token bigint, at int"))
    repeated = cut(marks.groupBy("token").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("token"))
    occurrences = cut(marks.where(Sieve(repeated, "token").passes("token")).join(repeated, "token", "left_semi"))
    drop(marks)
    drop(repeated)
    # A passage that holds a token starts at most min_len before the token's end, and not behind its start.
    reach = F.struct((F.col("low") + k - min_len).alias("low"), (F.col("high") + 1).alias("high"))
    regions = cut(_paths(occurrences, k).groupBy("doc").agg(F.collect_set(reach).alias("regions")))
    once = cut(rows.where(Sieve(regions, "doc").passes("doc")).join(regions, "doc").groupBy("doc").agg(F.min("text").alias("text"), F.first("regions").alias("regions")))
    drop(occurrences)
    drop(regions)
    digest = once.select("doc", F.sha2("text", 256).alias("digest"), F.length("text").alias("n"))
    several = digest.groupBy("digest").agg(F.min("doc").alias("first"), F.count("*").alias("n_copies")).where("n_copies > 1")
    copies = cut(digest.join(several, "digest").select("doc", "first", "n"))
    others = copies.where("doc <> first").select("doc")
    one = [F.min("doc").alias("a"), F.max("doc").alias("b")]
    # Most records that share a token share no whole passage. Neighbouring passages are told apart from those by their
    # cores first, a row for many of them, so that only what another record is likely to hold is compared run by run.
    cores = cut(once.select("doc", "text", "regions").mapInArrow(_cores(min_len), "doc bigint, core bigint, low int, high int").join(others, "doc", "left_anti"))
    common = cut(cores.groupBy("core").agg(*one).where("a < b").select("core"))
    alike = cores.where(Sieve(common, "core").passes("core")).join(common, "core", "left_semi")
    places = cut(alike.groupBy("doc").agg(F.collect_set(F.struct("low", "high")).alias("regions")))
    drop(cores)
    drop(common)
    # Equal hashes of min_len characters, 96 bits of two kinds; those of other records decide, so a record's own repeats do
    # not count.
    kept = once.where(Sieve(places, "doc").passes("doc")).select("doc", "text").join(places, "doc").select("doc", "text", "regions")
    grams = cut(kept.mapInArrow(_grams(min_len), "doc bigint, gram bigint, more int, at int"))
    drop(once)
    drop(places)
    shared = cut(grams.groupBy("gram").agg(*one, (F.min("more") < F.max("more")).alias("mixed")).where("a < b").select("gram", "mixed"))
    hits = grams.where(Sieve(shared, "gram").passes("gram")).join(shared.select("gram"), "gram", "left_semi")
    mixed = shared.where("mixed")
    if not mixed.isEmpty():
        # Runs whose first hashes are equal but not the second ones are different texts: each must be shared by itself.
        unshared = grams.join(mixed, "gram", "left_semi").groupBy("gram", "more").agg(*one).where("a = b").select("gram", "more")
        hits = hits.join(unshared, ["gram", "more"], "left_anti")
    starts = hits.join(copies.select("doc"), "doc", "left_anti").select("doc", "at")
    order = Window.partitionBy("doc").orderBy("at")
    fresh = F.coalesce(F.col("at") > F.lag("at").over(order) + min_len, F.lit(True)).cast("int")
    spans = starts.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(order)).groupBy("doc", "span")
    spans = spans.agg(F.min("at").alias("span_start"), (F.max("at") + min_len).alias("span_end")).drop("span")
    whole = copies.select("doc", F.lit(0).alias("span_start"), F.col("n").alias("span_end"))
    return spans.unionByName(whole).withColumnRenamed("doc", "doc_id")


def shared_portion(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_spans, shared_chars, portion) of every record; 0 where nothing is shared or the text is null."""
    sums = spans.groupBy(F.col("doc_id").alias("k")).agg(F.count("*").alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    each = docs.groupBy(F.col(key).cast("bigint").alias("doc_id")).agg(F.coalesce(F.length(F.min(text)), F.lit(0)).alias("n_chars"))
    out = each.join(sums, F.col("doc_id") == F.col("k"), "left").na.fill(0, ["n_spans", "shared_chars"]).drop("k")
    return out.withColumn("portion", F.coalesce(F.try_divide("shared_chars", "n_chars"), F.lit(0.0)))
