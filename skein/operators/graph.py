"""Connected components and hierarchies over parent-child rows.

Neither collects a graph anywhere: components come from rounds of contraction over the edge table, and only
components of at most ``co_locate`` nodes are brought together in one task; larger ones are resolved by pointer
doubling in joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.session import cut, drop


#: Edges that one task joins up at once instead of further rounds: a few megabytes, whatever the size of the table.
FINISH = 100_000


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, to): each node but the smallest of its component to that one, by union-find over a bounded number of edges."""
    up: dict = {}

    def find(x):
        top = x
        while up.setdefault(top, top) != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    if up:
        ends = [(x, find(x)) for x in list(up)]
        node, to = zip(*((x, t) for x, t in ends if x != t), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(node, kind), pa.array(to, kind)], ["node", "to"])


def _contract(edges: DataFrame, order) -> tuple[DataFrame, DataFrame]:
    """One round: (node, to) pointers to the neighbour first in ``order``, and the edges between what they point to."""
    ahead = order("a") > order("b")
    both = edges.select(F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("node"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("near"))
    point = both.groupBy("node").agg(F.min_by("near", order("near")).alias("to"))
    for _ in range(2):
        step = point.select(F.col("node").alias("to"), F.col("to").alias("next"))
        point = point.join(step, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    point, ends = cut(point), edges
    for end in ("a", "b"):
        ends = ends.join(point.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return point, cut(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())


def _compose(point: DataFrame, onward: DataFrame) -> DataFrame:
    """Pointers of a round carried on by those of what is left after it."""
    ahead = onward.select(F.col("node").alias("to"), F.col("to").alias("next"))
    carried = point.join(ahead, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    return carried.unionByName(onward.join(point.select("node"), "node", "left_anti"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of each node of an undirected edge table but the smallest of its component, which names it.

    Each round points every node to a neighbour, shortens these pointers twice, and contracts the edges along them. The
    first round goes by id, as replies mostly point to older and smaller ids; later ones go by a hash that changes
    with the round, so that a long chain loses a constant share of its nodes whatever its ids. When at most ``FINISH``
    edges are left one task joins them up. The pointers of all rounds are composed at the end, from the last and smallest
    to the first. Null ends and loops are ignored; repeated
    edges count once; no edges give no rows.
    """
    pairs = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"))
    left = cut(pairs.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("a") != F.col("b"))).distinct())
    first, after = _contract(left, F.col)
    drop(left)
    left, rounds = after, []
    kind = first.schema["node"].dataType.simpleString()
    while n := left.count():
        if n <= FINISH:
            rounds.append(cut(left.coalesce(1).mapInArrow(_join_up, f"node {kind}, to {kind}")))
            break
        point, after = _contract(left, lambda c, r=len(rounds): F.struct(F.xxhash64(F.lit(r), F.col(c)), F.col(c)))
        drop(left)
        left = after
        rounds.append(point)
    drop(left)
    if not rounds:
        return first.withColumnRenamed("to", "component")
    rest = rounds[-1]
    for point in reversed(rounds[:-1]):
        rest = _compose(point, rest)
    # What the first round left holds the smallest node of every component that is not yet whole.
    ends = rest.select(F.col("to").alias("node"), "to").distinct().join(rest.select("node"), "node", "left_anti")
    rest = cut(rest.unionByName(ends))
    least = rest.groupBy("to").agg(F.min("node").alias("least"))
    rest = rest.join(least, "to").select("node", F.col("least").alias("to")).where("node <> to")
    return _compose(first, rest).withColumnRenamed("to", "component")


WHITE, GREY, BLACK = 0, 1, 2


def walk(ids: np.ndarray, parents: np.ndarray, paths: bool) -> dict[str, list]:
    """Depth-first traversal with node colours of a forest with cycles, without recursion.

    ``parents`` holds positions, or -1. Roots are entered first; whatever stays white lies on a cycle or below one.
    There the search climbs from node to parent, greying nodes: a step onto a grey node is the back edge that closes
    a cycle. Cycle members turn black with depth -1, then the search descends from them.
    """
    n = len(ids)
    order = np.argsort(parents, kind="stable")
    first = np.searchsorted(parents[order], np.arange(n + 1))
    kids, first, up, name = order.tolist(), first.tolist(), parents.tolist(), ids.tolist()
    colour, depth, root, below = [WHITE] * n, [-1] * n, [0] * n, [0] * n
    cycle, path = [False] * n, [None] * n

    def descend(top: int) -> None:
        stack = [(top, first[top])]
        colour[top] = GREY
        while stack:
            node, k = stack.pop()
            if k < first[node + 1]:
                stack.append((node, k + 1))
                kid = kids[k]
                if colour[kid] == WHITE:
                    colour[kid] = GREY
                    root[kid] = root[node]
                    depth[kid] = depth[node] + 1 if depth[node] >= 0 else -1
                    if paths:
                        path[kid] = path[node] + [name[kid]]
                    stack.append((kid, first[kid]))
            else:
                colour[node] = BLACK
                if stack and node != top:
                    below[stack[-1][0]] += below[node] + 1

    for node in np.flatnonzero(parents < 0).tolist():
        root[node], depth[node], path[node] = name[node], 0, [name[node]]
        descend(node)
    for start in range(n):
        if colour[start] != WHITE:
            continue
        node, trail = start, []
        while colour[node] == WHITE:
            colour[node] = GREY
            trail.append(node)
            node = up[node]
        ring = trail[trail.index(node) :]
        smallest = min(name[x] for x in ring)
        for x in trail:
            colour[x] = WHITE
        for x in ring:
            colour[x], root[x], cycle[x], path[x] = BLACK, smallest, True, [name[x]]
        for x in ring:
            descend(x)
    return {"root": root, "depth": depth, "on_cycle": cycle, "n_descendants": below, "path": path}


_KEYS = (("id", "bigint"), ("root", "bigint"), ("depth", "int"), ("on_cycle", "boolean"), ("n_descendants", "bigint"))


def _walker(paths: bool, flush: int = 100_000):
    """For mapInArrow over rows sorted by component: walks whole components, some ``flush`` rows at a time."""

    def run(ids: np.ndarray, parents: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")
        at = np.searchsorted(ids, parents, sorter=order).clip(max=max(0, len(ids) - 1))
        got = walk(ids, np.where(parents >= 0, order[at], -1), paths)
        columns = [pa.array(ids, pa.int64()), pa.array(got["root"], pa.int64()), pa.array(got["depth"], pa.int32())]
        columns += [pa.array(got["on_cycle"], pa.bool_()), pa.array(got["n_descendants"], pa.int64())]
        names = [k for k, _ in _KEYS]
        if paths:
            columns, names = [*columns, pa.array(got["path"], pa.list_(pa.int64()))], [*names, "path"]
        return pa.RecordBatch.from_arrays(columns, names)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            kept.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "parent", "component")))
            rows += batch.num_rows
            if rows < flush:
                continue
            ids, parents, comp = (np.concatenate(x) for x in zip(*kept, strict=True))
            end = int(np.searchsorted(comp, comp[-1])) if len(comp) else 0
            if end:
                yield run(ids[:end], parents[:end])
            kept, rows = [(ids[end:], parents[end:], comp[end:])], len(ids) - end
        if rows:
            yield run(*(np.concatenate(x) for x in list(zip(*kept, strict=True))[:2]))

    return over


def co_located_walk(nodes: DataFrame, paths: bool = False) -> DataFrame:
    """(id, root, depth, on_cycle, n_descendants[, path]) of rows (id, parent, component), a component to one task.

    ``parent`` is null or an id of the same component. Components must be of bounded size.
    """
    schema = ", ".join(f"{k} {t}" for k, t in _KEYS) + (", path array<bigint>" if paths else "")
    ready = nodes.select("id", F.coalesce("parent", F.lit(-1)).alias("parent"), "component")
    return ready.repartition("component").sortWithinPartitions("component").mapInArrow(_walker(paths), schema)


def count_below(forest: DataFrame) -> DataFrame:
    """(id, n) of a forest (id, parent), whatever its depth: how many nodes each has below it, by log2(depth) joins.

    With the counts of what is nearer than 2^k below each node, those of what is nearer than 2^(k+1) follow: a node takes
    over the counts of the nodes exactly 2^k below it.
    """
    state = cut(forest.select("id", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("n")))
    while not state.where("up is not null").isEmpty():
        given = state.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("n").alias("more"))
        onward = state.select(F.col("id").alias("up"), F.col("up").alias("up2"))
        after = cut(state.join(given, "id", "left").join(onward, "up", "left").select("id", F.col("up2").alias("up"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
        drop(state)
        state = after
    return state.select("id", (F.col("n") - 1).alias("n"))


def doubled_walk(nodes: DataFrame, paths: bool = False) -> DataFrame:
    """The result of :func:`co_located_walk`, by pointer doubling: log2(depth) joins, whatever the size of a tree.

    A row holds how far it has climbed (``dist``), where it stands (``at``) and the smallest id on the way. Who stands
    on a root is done. After more steps than there are nodes the others stand on a cycle.
    """
    parent = cut(nodes.select("id", "parent"))
    limit = max(1, parent.count())
    first = [
        "id",
        F.coalesce("parent", "id").alias("at"),
        F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("dist"),
        F.col("id").alias("low"),
        F.col("parent").isNull().alias("done"),
    ]
    state = parent.select(*first, *([F.array("id").alias("trail")] if paths else []))
    state, steps = cut(state), 1
    while steps <= limit and not state.where("not done").isEmpty():
        onward = state.select(*(F.col(c).alias(f"{c}2") for c in state.columns))
        todo = state.where("not done").join(onward, F.col("at") == F.col("id2")).select(
            "id",
            F.col("at2").alias("at"),
            (F.col("dist") + F.col("dist2")).alias("dist"),
            F.least("low", "low2").alias("low"),
            F.col("done2").alias("done"),
            *([F.array_distinct(F.concat("trail", "trail2")).alias("trail")] if paths else []),
        )
        after = cut(state.where("done").unionByName(todo))
        drop(state)
        state, steps = after, steps * 2
    ring = state.where("not done").select(F.col("id").alias("at"), F.col("low").alias("ring"))
    on_ring = state.where("not done").select(F.col("at").alias("id")).distinct()
    # Everyone on a cycle is where someone on the cycle stands after that many steps.
    out = state.join(ring, "at", "left").join(on_ring.withColumn("on_cycle", F.lit(True)), "id", "left")
    out = out.select(
        "id",
        F.when(F.col("done"), F.col("at")).otherwise(F.col("ring")).alias("root"),
        F.when(F.col("done"), F.col("dist")).otherwise(-1).cast("int").alias("depth"),
        F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"),
        *(["trail"] if paths else []),
    )
    if not paths:
        # The members of a cycle are the roots of what hangs below them.
        out = cut(out)
        cyclic = out.where("on_cycle").select("id", F.lit(True).alias("ringed"))
        forest = parent.join(cyclic, "id", "left").select("id", F.when(F.col("ringed").isNull(), F.col("parent")).alias("parent"))
        return out.join(count_below(forest).withColumnRenamed("n", "n_descendants"), "id").select("id", "root", "depth", "on_cycle", "n_descendants")
    rings = out.where("on_cycle").select("id", F.lit(True).alias("ringed"))
    steps_up = out.select("id", "root", "depth", "on_cycle", F.posexplode("trail").alias("pos", "anc")).join(rings.withColumnRenamed("id", "anc"), "anc", "left")
    # In a tree the trail ends at the root; below a cycle the path starts at the first cycle member met.
    met = F.min(F.when(F.col("ringed"), F.col("pos"))).over(Window.partitionBy("id"))
    steps_up = steps_up.withColumn("met", met).where("met is null or pos <= met")
    upward = F.transform(F.array_sort(F.collect_list(F.struct("pos", "anc"))), lambda x: x["anc"])
    whole = cut(
        steps_up.groupBy("id").agg(*(F.first(c).alias(c) for c in ("root", "depth", "on_cycle")), F.reverse(upward).alias("path"))
    )
    below = whole.select("id", F.explode("path").alias("anc")).where("id <> anc").groupBy(F.col("anc").alias("id")).agg(F.count("*").alias("n_descendants"))
    return whole.join(below, "id", "left").select("id", "root", "depth", "on_cycle", F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"), "path")


def hierarchy(rows: DataFrame, paths: bool = False, co_locate: int = 50_000) -> DataFrame:
    """(id, root, depth, on_cycle, n_descendants[, path]) of parent-child rows (id bigint, parent bigint).

    - A parent that is no id of the table counts as none. Rows with a null id are left out; of an id given more than
      once the smallest parent counts. An empty table gives no rows; other columns are ignored.
    - ``n_descendants`` of a member of a cycle counts only what hangs below it off the cycle.
    - A root has depth 0 and is its own root. Nodes on a cycle, and below one, have depth -1 and as root the smallest
      id of that cycle. ``path`` leads from the root (or the cycle's member) down to the node.
    - Components of up to ``co_locate`` nodes are walked depth first in one task each; larger ones by pointer doubling.
      A single node needs neither.
    """
    rows = cut(rows.where("id is not null").groupBy("id").agg(F.min("parent").alias("parent")))
    known = rows.select(F.col("id").alias("parent"))
    linked = cut(rows.where("parent is not null").join(known, "parent", "left_semi").select("id", "parent"))
    comp = cut(connected_components(linked, "id", "parent").withColumnsRenamed({"node": "id"}))
    # A node without edges, or with none but a loop, is a component of its own.
    full = rows.select("id").join(linked, "id", "left").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    large = comp.groupBy("component").count().where(F.col("count") >= co_locate).select("component")
    if large.isEmpty():
        return co_located_walk(full, paths)
    full = cut(full)
    small, big = full.join(large, "component", "left_anti"), full.join(large, "component", "left_semi")
    return co_located_walk(small, paths).unionByName(doubled_walk(big, paths))


def descendants(walked: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of every node below another, from a hierarchy with paths."""
    steps = walked.select(F.col("id").alias("descendant"), F.size("path").alias("len"), F.posexplode("path").alias("pos", "ancestor"))
    return steps.where("ancestor <> descendant").select("ancestor", "descendant", (F.col("len") - F.col("pos") - 1).alias("distance"))
