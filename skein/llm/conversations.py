"""Ordered conversations from message rows.

Candidate reply links of a message are its explicit references, in either direction, or, for messages without any, all
messages before it in its channel (the pair of author and mentioned author). Where there are several, each is
scored by explicit reference, time, mentions and shared words, and the likeliest becomes the message's parent; these
links form trees. Explicit references never split a conversation: trees joined by one are one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.ids import as_key, author_key, clean_id, clean_ids
from skein.operators.graph import co_located_walk, connected_components, doubled_walk
from skein.session import cut

#: Nothing but white space of any kind and characters without width.
BLANK = r"^[\s\p{Z}\x{1c}-\x{1f}\x{85}\x{200b}-\x{200d}\x{2060}\x{feff}]*$"
#: What a candidate link gains for an explicit reference, a mention of the other author, nearness in time, shared words.
WEIGHTS = {"explicit": 4.0, "mention": 1.0, "time": 1.0, "lexical": 1.0}
HALF_LIFE_S = 6 * 3600.0
#: Messages without a time of a large conversation are numbered by ranges of 2 to the power of this many ids.
ID_BITS = 20
#: Messages of a channel that look for their parents at once.
AT_ONCE = 1_000


def messages(rows: DataFrame) -> DataFrame:
    """(id, author, inbound, created_at, blank, owns, named): one row per tweet_id, whatever its copies.

    Of values that differ between copies the smallest that is not null counts; links are united. Rows whose tweet_id is
    null or no number are left out. ``blank`` says that no copy has a visible text.
    """
    ready = rows.select(
        as_key(clean_id(F.col("tweet_id"))).alias("id"),
        author_key(F.col("author_id")).alias("author"),
        "inbound",
        "created_at",
        (F.col("text").isNull() | F.col("text").rlike(BLANK)).alias("blank"),
        as_key(clean_id(F.col("in_response_to_tweet_id"))).alias("own"),
        F.transform(clean_ids(F.col("response_tweet_id")), as_key).alias("refs"),
    ).where("id is not null")
    least = [F.min(c).alias(c) for c in ("author", "inbound", "created_at", "blank")]
    return ready.groupBy("id").agg(*least, F.collect_set("own").alias("owns"), F.array_distinct(F.flatten(F.collect_set("refs"))).alias("named"))


def links(msgs: DataFrame) -> DataFrame:
    """(child, parent, by): every explicit reference; ``by`` is the message that holds it, ``own`` whether that is the child."""
    up = msgs.select(F.col("id").alias("by"), F.explode("owns").alias("to"), F.lit(True).alias("own"))
    down = msgs.select(F.col("id").alias("by"), F.explode("named").alias("to"), F.lit(False).alias("own"))
    return up.unionByName(down)


def _known(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, author, created_at, to, words) of the messages of ``ids`` (id), for scores. Of copies the smallest values count.

    ``to`` are the authors mentioned and ``words`` the words, by hashes of 32 bits: texts need not move.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    words = F.array_distinct(F.transform(F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}]{3,})"), F.lit(1)), lambda w: F.hash(w)))
    to = F.array_distinct(F.regexp_extract_all(low, F.lit(r"@([\p{L}\p{N}_]+)"), F.lit(1)))
    side = rows.select(as_key(clean_id(F.col("tweet_id"))).alias("id"), author_key(F.col("author_id")).alias("author"), "created_at", to.alias("to"), words.alias("words"))
    return side.join(ids, "id", "left_semi").groupBy("id").agg(*(F.min(c).alias(c) for c in ("author", "created_at", "to", "words")))


def _total(explicit: Column) -> Column:
    """The score of a pair of messages, their columns prefixed c_ (child) and p_ (parent)."""
    mention = F.array_contains("c_to", F.col("p_author")) | F.array_contains("p_to", F.col("c_author"))
    gap = (F.unix_micros("c_created_at") - F.unix_micros("p_created_at")) / 1e6
    near = F.when(gap >= 0, F.power(F.lit(2.0), -gap / HALF_LIFE_S))
    common = F.try_divide(F.size(F.array_intersect("c_words", "p_words")), F.least(F.size("c_words"), F.size("p_words")))
    parts = {"explicit": explicit.cast("double"), "mention": mention.cast("double"), "time": near, "lexical": common}
    return F.round(sum((F.lit(WEIGHTS[k]) * F.coalesce(v, F.lit(0.0)) for k, v in parts.items()), F.lit(0.0)), 9)


def score(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """(child, parent, explicit, score) of candidates (child, parent, explicit), from the messages' rows.

    Time is halved every six hours and 0 if the parent is later or either time is null; shared words (of three letters
    or more) count as a share of the shorter text's. Null texts share nothing. Of copies the smallest values count.
    """
    side = cut(_known(rows, candidates.select(F.explode(F.array("child", "parent")).alias("id")).distinct()))
    c, p = (side.select(*(F.col(x).alias(f"{a}_{x}") for x in side.columns)) for a in "cp")
    both = candidates.join(c, F.col("child") == F.col("c_id")).join(p, F.col("parent") == F.col("p_id"))
    return both.select("child", "parent", "explicit", _total(F.col("explicit")).alias("score"))


def channel_parents(rows: DataFrame, without: DataFrame) -> DataFrame:
    """(child, parent, score) for the messages of ``without`` (id): the likeliest of all those before each in its channels.

    A channel is an author and an author it mentions, in either order; a message that mentions several is in as many.
    Messages without a mention, or without a time, have no channel. Ties and lone candidates as in ``likeliest``. Pairs are scored where they are made and only
    the best of a child is kept, so a channel takes time in proportion to the square of its length, but no room.
    """
    named = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"@([\p{L}\p{N}_]+)"), F.lit(1)), F.lower))
    said = rows.where("text is not null and created_at is not null").select(as_key(clean_id(F.col("tweet_id"))).alias("id"), author_key(F.col("author_id")).alias("author"), F.explode(named).alias("to"), "created_at")
    said = said.where("id is not null").groupBy("id", "to").agg(*(F.min(x).alias(x) for x in ("author", "created_at")))
    said = said.select("id", F.least("author", "to").alias("a"), F.greatest("author", "to").alias("b"), F.col("created_at").alias("at"))
    open_ = said.join(without, "id", "left_semi")
    # A long channel's children are dealt to parts, each with all its messages.
    parts = open_.groupBy("a", "b").agg(F.ceil(F.count("*") / AT_ONCE).cast("int").alias("parts"))
    said = said.distinct().join(parts, ["a", "b"]).join(without.withColumn("open", F.lit(True)), "id", "left")
    said = cut(said)
    said = said.join(_known(rows, said.select("id")), "id")
    child, parent = ([F.col(x).alias(f"{side}_{x}") for x in ("at", "id", "author", "created_at", "to", "words")] for side in "cp")
    c = said.where("open").select("a", "b", F.expr("pmod(hash(id), parts)").alias("part"), *child)
    p = said.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *parent)
    both = c.join(p, ["a", "b", "part"]).where("struct(p_at, p_id) < struct(c_at, c_id)")
    best = F.max(F.struct(_total(F.lit(False)).alias("score"), (-F.col("p_id")).alias("last"))).alias("best")
    got = both.groupBy(F.col("c_id").alias("child")).agg(best, (F.min("p_id") < F.max("p_id")).alias("several"))
    return got.select("child", (-F.col("best.last")).alias("parent"), F.when(F.col("several"), F.col("best.score")).alias("score"))


def likeliest(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """(child, parent, score): the best candidate of each child, ties to the smaller parent. A lone candidate is not scored."""
    several = candidates.withColumn("n", F.count("*").over(Window.partitionBy("child")))
    several = cut(several)
    lone = several.where("n = 1").select("child", "parent", F.lit(None).cast("double").alias("score"))
    scored = score(several.where("n > 1").drop("n"), rows)
    best = scored.groupBy("child").agg(F.max(F.struct("score", (-F.col("parent")).alias("last"))).alias("b"))
    return lone.unionByName(best.select("child", (-F.col("b.last")).alias("parent"), F.col("b.score").alias("score")))


def _trees_joined(tree: DataFrame, whole: DataFrame) -> DataFrame:
    """(node, component) as of ``connected_components``: the trees of the links (child, parent), those with an explicit link (by, to) between them as one."""
    trees = cut(connected_components(tree, "child", "parent"))
    ends = whole.select("by", "to").distinct()
    for end in ("by", "to"):
        ends = ends.join(trees.select(F.col("node").alias(end), F.col("component").alias("top")), end, "left").withColumn(end, F.coalesce("top", end)).drop("top")
    between = cut(ends.where("by <> to").distinct())
    onward = cut(connected_components(between, "by", "to"))
    ahead = onward.select(F.col("node").alias("component"), F.col("component").alias("next"))
    carried = trees.join(ahead, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return carried.unionByName(onward.join(trees.select("node"), "node", "left_anti"))


def _numbered(turns: DataFrame, large: DataFrame) -> DataFrame:
    """Adds turn_no within ``conv``. Conversations of ``large`` (conv) are numbered by the hour, hours by running counts; those
    without a time, which are ordered by id, by ranges of ids."""
    order = [F.col("created_at").asc_nulls_first(), F.col("id")]
    small = turns
    if large.isEmpty():
        return small.withColumn("turn_no", F.row_number().over(Window.partitionBy("conv").orderBy(*order)))
    small = turns.join(large, "conv", "left_anti").withColumn("turn_no", F.row_number().over(Window.partitionBy("conv").orderBy(*order)))
    big = turns.join(large, "conv", "left_semi").withColumn("hour", F.coalesce(F.date_trunc("hour", "created_at"), F.lit("0001-01-01").cast("timestamp")))
    big = big.withColumn("part", F.when(F.col("created_at").isNull(), F.shiftright("id", ID_BITS)).otherwise(F.lit(0)))
    hours = big.groupBy("conv", "hour", "part").agg(F.count("*").alias("n"))
    hours = hours.select("conv", "hour", "part", (F.sum("n").over(Window.partitionBy("conv").orderBy("hour", "part")) - F.col("n")).alias("before"))
    big = big.join(hours, ["conv", "hour", "part"])
    within = F.row_number().over(Window.partitionBy("conv", "hour", "part").orderBy(*order))
    return small.unionByName(big.withColumn("turn_no", (within + F.col("before")).cast("int")).drop("hour", "part", "before"))


def rebuild(rows: DataFrame, infer: bool = False, co_locate: int = 50_000, parents: bool = True) -> DataFrame:
    """(conv, turn_no, id, role[, parent, score]): the turns of every conversation that is whole.

    ``rows`` has the columns of the message table; others are ignored. A conversation is a set of messages connected by
    links and named by its smallest id. With ``infer`` messages that neither refer nor are referred to get a parent from
    their channel; without, only explicit references link. Turns are messages with visible text, ordered by time (null
    first), then id. A null ``inbound`` means a customer if the author is a number, a brand otherwise. ``parent`` is the likeliest
    parent, null for the first of a tree. As every explicit reference connects, whichever is the likeliest, the turns of
    explicit conversations need no scores: with ``parents=False`` none are made (not with ``infer``, where they decide).

    Left out are conversations that refer to an id without a row, that hold a circle of replies, or in which no brand
    turn follows a customer's. An empty table has no conversations.
    """
    msgs = cut(messages(rows))
    ids = msgs.select(F.col("id").alias("to"), F.lit(True).alias("there"))
    refs = cut(links(msgs).join(ids, "to", "left"))
    whole = refs.where("there")
    child, parent = F.when(F.col("own"), F.col("by")).otherwise(F.col("to")), F.when(F.col("own"), F.col("to")).otherwise(F.col("by"))
    tree = None
    if parents or infer:
        candidates = whole.select(child.alias("child"), parent.alias("parent"), F.lit(True).alias("explicit")).where("child <> parent").distinct()
        tree = likeliest(candidates, rows)
        if infer:
            alone = msgs.select("id").join(refs.select(F.explode(F.array("by", "to")).alias("id")), "id", "left_anti")
            tree = tree.unionByName(channel_parents(rows, alone))
        tree = cut(tree)
        comp = _trees_joined(tree, whole)
    else:
        comp = connected_components(whole, "by", "to")
    comp = cut(comp.withColumnsRenamed({"node": "id", "component": "conv"}))

    # The parent that decides on circles: the message's own reference, else the smallest message that names it.
    own = msgs.where("size(owns) > 0").select("id", F.array_min("owns").alias("up"))
    namer = refs.where("there and not own").groupBy(F.col("to").alias("id")).agg(F.min("by").alias("up"))
    namer = namer.join(own, "id", "left_anti")
    up = own.join(ids.select(F.col("to").alias("up")), "up", "left_semi").unionByName(namer)
    everyone = msgs.drop("owns", "named").join(comp, "id", "left").withColumn("conv", F.coalesce("conv", "id"))
    everyone = cut(everyone.join(up, "id", "left"))
    sizes = comp.groupBy("conv").count().where(F.col("count") >= co_locate).select("conv")
    large = cut(sizes)
    linked = everyone.where("up is not null or id = conv").select("id", F.col("up").alias("parent"), F.col("conv").alias("component"))
    heads = everyone.join(up.select(F.col("up").alias("id")).distinct(), "id", "left_semi").where("up is null and id <> conv")
    linked = linked.unionByName(heads.select("id", F.col("up").alias("parent"), F.col("conv").alias("component")))
    if large.isEmpty():
        walked = co_located_walk(linked)
    else:
        mark = large.withColumnRenamed("conv", "component")
        walked = co_located_walk(linked.join(mark, "component", "left_anti")).unionByName(doubled_walk(linked.join(mark, "component", "left_semi")))
    circles = walked.where("on_cycle").select("id")
    broken = refs.where("there is null").select(F.col("by").alias("id")).unionByName(circles).distinct()
    dropped = everyone.join(broken, "id", "left_semi").select("conv").distinct()

    is_customer = F.coalesce("inbound", F.col("author").rlike(r"^\d+$"), F.lit(False))
    turns = everyone.where("not blank").select("conv", "id", "created_at", F.when(is_customer, "customer").otherwise("brand").alias("role"))
    at = F.struct("created_at", "id")
    ends = turns.groupBy("conv").agg(F.min(F.when(F.col("role") == "customer", at)).alias("asked"), F.max(F.when(F.col("role") == "brand", at)).alias("answered"))
    kept = ends.where("answered > asked").select("conv").join(dropped, "conv", "left_anti")
    out = _numbered(turns.join(kept, "conv", "left_semi"), large)
    if tree is None:
        return out.select("conv", "turn_no", "id", "role")
    return out.join(tree.withColumnRenamed("child", "id"), "id", "left").select("conv", "turn_no", "id", "role", "parent", "score")
