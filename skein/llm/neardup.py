"""Groups of near-duplicate records by a Gray-ordered hierarchical index over bit fingerprints, without losing a link.

A record is its set of words. Its fingerprint has ``WIDTH`` bits; each word flips one. Sets that share at least
``threshold`` of their words together differ in a bounded number of words, so their fingerprints differ in at most as
many bits: the search for such fingerprints is exact.

The index has three levels. Records are first filed under *masked patterns*: words that two similar records must share,
the rarest words of each (prefix filtering). Where a word is too common for one node, the node is split by a second and
a third such word (long records by a second one only), which similar records must share as well. A node that is still too large for a task is split by masked
bit patterns: of one band of bits more than may differ, similar fingerprints have at least one in common. Within a node the fingerprints are sorted by Gray rank, so
that neighbours differ in few bits; runs of them form groups whose common bits (mask and pattern) are factored out. Two
groups are compared first by these: where the differences of the shared bits alone, together with those already counted,
exceed the bound, the whole pair of groups is pruned. Pairs that remain are compared bit by bit, and what passes is
compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.codepoints import CharClass, encode, mix, words
from skein.functions.sieve import Sieve
from skein.session import cut

#: Buckets of the word-count sketch: 4 MB however large the corpus; it covers all records.
SKETCH = 1 << 22
#: A word counted more often than this is filed together with a second word (and that with a third).
COMMON = 2_000
#: Sets of so many words are filed under two common words at most: their triples would be too many.
LONG = 64
#: A node of more records than this is split by bands of the fingerprints' bits.
HOT = 20_000
GROUP = 64
#: Members of a large class that are paired at once.
PART = 1_000

_LETTER = CharClass(str.isalnum)
WIDTH = 64


def plain(c: Column) -> Column:
    """Lower-cased text without web addresses and @mentions."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\b(?:https?://|www\.)\S+", " ")
    return F.lower(F.regexp_replace(bare, r"@[\p{L}\p{N}_]+", " "))


def _distinct_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): each text's distinct words, and where each text's stop."""
    codes, starts = encode(texts)
    h, at, _ = words(codes, _LETTER(codes))
    doc = np.searchsorted(starts, at, side="right") - 1
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(texts)), side="right")


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) % SKETCH


def _count(least: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SKETCH, np.int32)
        for batch in batches:
            h, ends = _distinct_words(batch.column(0).to_pylist())
            n = np.diff(ends, prepend=0)
            seen += np.bincount(_bucket(h)[np.repeat(n >= least, n)], minlength=SKETCH).astype(np.int32)
        at = np.flatnonzero(seen)
        for part in np.array_split(at, max(1, len(at) // 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(seen[part].astype(np.int64))], ["bucket", "n"])

    return over


def sketch(counts: DataFrame) -> np.ndarray:
    """One byte per bucket: 0 for words that occur in one record, then growing with the count; 4 MB on the driver."""
    level = F.when(F.col("n") <= 1, 0).otherwise(F.least(F.lit(255), F.ceil(8 * F.log2("n"))))
    rows = counts.groupBy("bucket").agg(F.sum("n").alias("n")).select("bucket", level.cast("int").alias("level"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, level = batch.column(0).to_numpy().astype(np.int32), batch.column(1).to_numpy().astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()], pa.binary()), pa.array([level.tobytes()], pa.binary())], ["at", "level"])

    out = np.zeros(SKETCH, np.uint8)
    for r in rows.where("level > 0").mapInArrow(pack, "at binary, level binary").toLocalIterator():
        out[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["level"], np.uint8)
    return out


def _fingerprints(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each record's fingerprint; a word flips one of the bits."""
    starts = np.concatenate([[0], ends[:-1]])
    if not len(h):
        return np.zeros(len(ends), np.uint64)
    flips = np.uint64(1) << (h % np.uint64(WIDTH))
    return np.where(ends > starts, np.bitwise_xor.reduceat(flips, np.minimum(starts, len(h) - 1)), np.uint64(0))


_CARDS = "id bigint, size int, fp bigint, digest bigint, keys array<bigint>"


def _cards(rarity, least: int, threshold: float):
    """One card per record: its fingerprint, a digest of its word set, and the keys it is filed under."""
    common = ceil(8 * np.log2(COMMON))

    def keys(own: np.ndarray, level: np.ndarray) -> list[int]:
        # Two sets that share at least need words have, in any fixed order, their first j shared words among the
        # first len - need + j of each: one common word decides, or the first two, or the first three. The larger set of a
        # pair says whether three are taken, so sets that may be the smaller one of a long one are filed both ways.
        deep, flat = len(own) < LONG, len(own) >= threshold * LONG - 1e-9
        order = np.lexsort((own, level))
        spare = len(own) - ceil(threshold * len(own) - 1e-9)
        own, level = own[order[: spare + 3]], level[order[: spare + 3]]
        out = []
        for i in range(min(spare + 1, len(own))):
            if level[i] == 0:
                continue
            if level[i] < common:
                out.append(own[i])
                continue
            for j in range(i + 1, min(spare + 2, len(own))):
                two = own[i] * np.uint64(3) + own[j]
                if level[j] < common:
                    out.append(two)
                    continue
                if flat:
                    out.append(two)
                if deep:
                    out.extend(two * np.uint64(5) + own[m] for m in range(j + 1, min(spare + 3, len(own))))
        return out

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(rarity.value, np.uint8)
        np.seterr(over="ignore")
        for batch in batches:
            h, ends = _distinct_words(batch.column(1).to_pylist())
            starts = np.concatenate([[0], ends[:-1]])
            level, fps = levels[_bucket(h)], _fingerprints(h, ends)
            keep = np.flatnonzero(ends - starts >= least)
            spread = mix(h * np.uint64(7))
            sums = np.add.reduceat(spread, np.minimum(starts, max(0, len(h) - 1))) if len(h) else np.zeros(len(ends), np.uint64)
            filed = [[int(x) for x in np.array(keys(h[starts[i] : ends[i]], level[starts[i] : ends[i]]), np.uint64).view(np.int64)] for i in keep.tolist()]
            ids = batch.column(0).to_numpy(zero_copy_only=False)[keep]
            columns = [pa.array(ids, pa.int64()), pa.array((ends - starts)[keep].astype(np.int32)), pa.array(fps[keep].view(np.int64)), pa.array(sums[keep].view(np.int64)), pa.array(filed, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "size", "fp", "digest", "keys"])

    return over


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of a bit pattern in Gray order: the binary number whose Gray code it is."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp ^ (fp >> np.uint64(s))
    return fp


def _bound(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Most words by which sets of sizes a and b may differ: |A| + |B| - 2 * overlap, overlap >= t / (1 + t) * (|A| + |B|)."""
    total = a + b
    return total - 2 * np.ceil(threshold / (1 + threshold) * total - 1e-9).astype(np.int64)


def _most(total: np.ndarray, threshold: float) -> np.ndarray:
    """No less than _bound of any two sizes that make up to ``total``; _bound itself falls where the parity of the sum changes."""
    return np.floor(total * (1 - threshold) / (1 + threshold) + 1e-6).astype(np.int64)


def _bands(threshold: float):
    """For mapInArrow over cards (key, id, size, fp) of large nodes: each under the masked bit patterns that it shares with every
    similar card.

    Sizes fall into classes, each up to 1 / threshold times as large as the one before, so that similar sets are in the same class or in
    neighbouring ones: a pair meets in the larger class of the two. A class has one band of bits more than its sets may
    differ in; where that is more than there are bits the class is one node.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            key, ids, size, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            bits = fp.view(np.uint64)
            own = np.floor(np.log(np.maximum(size, 1)) / -np.log(threshold) + 1e-9).astype(np.int64)
            for step in (0, 1):
                # No set of the class is larger than this, so no two differ in more words than ``most``.
                most = _most(2 * np.floor(threshold ** -(own + step + 1.0) + 1e-9), threshold)
                blind = most >= WIDTH
                bands = np.where(blind, 1, most + 1)
                for b in range(int(bands.max(initial=0))):
                    at = np.flatnonzero(bands > b)
                    low, high = b * WIDTH // bands[at], (b + 1) * WIDTH // bands[at]
                    masked = (bits[at] >> low.astype(np.uint64)) & ((np.uint64(1) << np.minimum(high - low, 63).astype(np.uint64)) - np.uint64(1) | np.where(high - low == WIDTH, ~np.uint64(0), np.uint64(0)))
                    masked[blind[at]] = 0
                    node = mix(key[at].view(np.uint64) * np.uint64(7) + mix(masked * np.uint64(131) + (b + WIDTH * (own[at] + step)).astype(np.uint64)))
                    yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(ids[at]), pa.array(size[at]), pa.array(fp[at])], ["key", "id", "size", "fp"])

    return over


def _differ(fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[i] ^ fp[j]).astype(np.int64)


def _search(ids: np.ndarray, size: np.ndarray, fp: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one large node, sorted by Gray rank: groups are pruned by their shared bits, then members compared."""
    n = len(ids)
    edges = np.arange(0, n, GROUP)
    pattern = np.bitwise_and.reduceat(fp, edges)
    mask = pattern | np.bitwise_and.reduceat(~fp, edges)
    low, high = np.minimum.reduceat(size, edges), np.maximum.reduceat(size, edges)
    out_i, out_j = [], []
    for g in range(len(edges)):
        rest = np.arange(g, len(edges))
        shared = np.bitwise_count((pattern[rest] ^ pattern[g]) & mask[rest] & mask[g]).astype(np.int64)
        near = (shared <= _most(high[rest] + high[g], threshold)) & (low[rest] * threshold <= high[g]) & (low[g] * threshold <= high[rest])
        mine = np.arange(edges[g], min(n, edges[g] + GROUP))
        members = np.concatenate([np.arange(edges[x], min(n, edges[x] + GROUP)) for x in rest[near].tolist()] or [mine[:0]])
        i, j = np.repeat(mine, len(members)), np.tile(members, len(mine))
        ahead = i < j
        i, j = i[ahead], j[ahead]
        hit = _differ(fp, i, j) <= _bound(size[i], size[j], threshold)
        out_i.append(i[hit])
        out_j.append(j[hit])
    return np.concatenate(out_i), np.concatenate(out_j)


def _pairs(threshold: float, flush: int = 200_000):
    """For mapInArrow over cards sorted by key: candidate pairs of each node."""

    def run(key, ids, size, fp) -> pa.RecordBatch:
        order = np.lexsort((gray_rank(fp), key))
        key, ids, size, fp = key[order], ids[order], size[order].astype(np.int64), fp[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.append(starts, len(key)))
        found_i, found_j = [], []
        for s, m in zip(starts[n > GROUP].tolist(), n[n > GROUP].tolist(), strict=True):
            i, j = _search(ids[s : s + m], size[s : s + m], fp[s : s + m], threshold)
            found_i.append(s + i)
            found_j.append(s + j)
        # Nodes of one group: each member with those behind it, one step further each time.
        place = np.arange(len(key)) - np.repeat(starts, n)
        behind = np.where(np.repeat(n, n) > GROUP, 0, np.repeat(n, n) - 1 - place)
        at, step = np.flatnonzero(behind), 1
        while len(at):
            j = at + step
            hit = _differ(fp, at, j) <= _bound(size[at], size[j], threshold)
            found_i.append(at[hit])
            found_j.append(j[hit])
            step += 1
            at = at[behind[at] >= step]
        i, j = np.concatenate(found_i or [at]), np.concatenate(found_j or [at])
        a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        both = np.unique(np.stack([a, b]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows = [], 0
        for batch in batches:
            key, ids, size, fp = (batch.column(i).to_numpy() for i in range(4))
            kept.append((key, ids, size, fp.view(np.uint64)))
            rows += len(key)
            if rows < flush:
                continue
            whole = [np.concatenate(x) for x in zip(*kept, strict=True)]
            end = int(np.searchsorted(whole[0], whole[0][-1]))
            if end:
                yield run(*(x[:end] for x in whole))
            kept, rows = [tuple(x[end:] for x in whole)], len(whole[0]) - end
        if rows:
            yield run(*(np.concatenate(x) for x in zip(*kept, strict=True)))

    return over


def near_duplicates(docs: DataFrame, key: str, text: str, threshold: float = 0.8, least: int = 12) -> tuple[DataFrame, DataFrame]:
    """(classes, pairs): classes (id, rep) of records with the same word set, pairs (a, b) of similar representatives.

    ``key`` must be a bigint column. Words are maximal runs of letters and digits in the lower-cased text, without web
    addresses and @mentions. Records with fewer than ``least`` distinct words, null texts and null keys are left out. A
    key given more than once counts once, with its smallest word set by digest. Two records are similar if they share at
    least ``threshold`` of the distinct words of both together; each pair comes once, with a < b. Records with the same
    words are one class, named by its smallest id and compared once, however many they are. An empty table gives
    no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), plain(F.col(text)).alias("text"))
    counts = rows.select("text").mapInArrow(_count(least), "bucket int, n bigint")
    rarity = spark.sparkContext.broadcast(sketch(counts).tobytes())
    cards = rows.mapInArrow(_cards(rarity, least, threshold), _CARDS)
    card = F.struct("digest", "size", "fp", "keys")
    cards = cut(cards.groupBy("id").agg(F.min(card).alias("c")).select("id", "c.*"))
    same = ("digest", "fp", "size")
    classes = cards.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    several = cut(classes.where("n > 1"))
    member = cut(cards.join(several.drop("n"), list(same)).select("id", "rep"))
    alone = member.where("id <> rep").select("id")
    filed = cards.join(alone, "id", "left_anti").select(F.explode("keys").alias("key"), "id", "size", "fp")
    hot = cut(filed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key"))
    if not hot.isEmpty():
        parts = filed.join(hot, "key", "left_semi").select("key", "id", "size", "fp").mapInArrow(_bands(threshold), "key bigint, id bigint, size int, fp bigint")
        filed = filed.join(hot, "key", "left_anti").unionByName(parts)
    nodes = filed.repartition("key").sortWithinPartitions("key")
    candidates = cut(nodes.mapInArrow(_pairs(threshold), "a bigint, b bigint").distinct())
    sides = cut(candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = rows.where(Sieve(sides, "id").passes("id")).join(sides, "id", "left_semi").select("id", F.array_distinct(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))).alias("set"))
    sets = cut(sets.groupBy("id").agg(F.min("set").alias("set")))
    both = candidates.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    overlap = F.size(F.array_intersect("sa", "sb"))
    pairs = both.where(overlap >= F.lit(threshold) * (F.size("sa") + F.size("sb") - overlap)).select("a", "b")
    every = cards.select("id").join(member, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    return every, pairs


def expand(classes: DataFrame, pairs: DataFrame, most: int | None = None) -> DataFrame:
    """(a, b) of records rather than classes: similar ones, and those of the same class. All of them, unless ``most`` is given.

    A class of more than ``most`` members is not expanded into all pairs: its members are linked to its representative,
    and only that to other classes, so that groups stay whole while copies stay linear. Large classes are paired in
    parts of about ``PART`` members, so that no task has all pairs of one.
    """
    sizes = classes.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1")
    copied = classes.join(sizes, "rep")
    few = F.lit(True) if most is None else F.col("n") <= most
    parts = sizes.where(few & (F.col("n") > PART)).select("rep", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    open_ = copied.where(few)
    part = F.expr(f"pmod(hash(id), cast(ceil(n / {PART}) as int))")
    open_ = open_.select("rep", "id", part.alias("part"))

    def spread(rows: DataFrame, end: str) -> DataFrame:
        out = rows.join(parts.withColumnRenamed("rep", end), end, "left")
        return out.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))

    left = spread(open_.select("rep", F.col("id").alias("a")), "rep")
    within = left.join(open_.withColumnRenamed("id", "b"), ["rep", "part"]).where("a < b").select("a", "b")
    out = within
    if most is not None:
        star = copied.where((F.col("n") > most) & (F.col("rep") < F.col("id"))).select(F.col("rep").alias("a"), F.col("id").alias("b"))
        out = out.unionByName(star)
    sides = pairs
    for end in ("a", "b"):
        members = open_.select(F.col("rep").alias(end), F.col("id").alias("m"), "part")
        sides = spread(sides, end).join(members, [end, "part"], "left").where("m is not null or parts is null")
        sides = sides.withColumn(end, F.coalesce("m", end)).drop("m", "part", "parts")
    return sides.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(out)


def groups(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, rep, group, links): each record's class, group of linked classes (its smallest id) and links of its class."""
    from skein.operators.graph import connected_components

    comp = connected_components(pairs, "a", "b").withColumnsRenamed({"node": "rep", "component": "group"})
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    out = classes.join(links, "rep", "left").join(comp, "rep", "left")
    return out.select("id", "rep", F.coalesce("group", "rep").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
