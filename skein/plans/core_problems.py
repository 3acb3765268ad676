"""Queries p2, p6 and p7 over the message tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.ids import as_key, author_key, clean_id, clean_ids
from skein.operators import graph, orphans, skew
from skein.session import table


def reply_parents(twcs: DataFrame) -> DataFrame:
    """(id, parent) bigint of every tweet: its own reference, else the smallest tweet that names it as a response."""
    own = twcs.groupBy(as_key(F.col("tweet_id")).alias("id")).agg(F.min(as_key(clean_id(F.col("in_response_to_tweet_id")))).alias("own"))
    named = twcs.select(as_key(F.col("tweet_id")).alias("namer"), F.explode(clean_ids(F.col("response_tweet_id"))).alias("ref"))
    named = named.groupBy(as_key(F.col("ref")).alias("id")).agg(F.min("namer").alias("namer"))
    return own.join(named, "id", "left").select("id", F.coalesce("own", "namer").alias("parent"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = graph.hierarchy(reply_parents(table(spark, sf_dir, "twcs")))
    return got.select(F.col("id").cast("string").alias("tweet_id"), F.col("root").cast("string").alias("root_id"), "depth")


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = graph.hierarchy(reply_parents(table(spark, sf_dir, "twcs")), paths=True)
    return got.select(
        F.col("id").cast("string").alias("tweet_id"), F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"), "depth", F.col("root").cast("string").alias("root_id"), "n_descendants", "on_cycle"
    )


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = graph.descendants(graph.hierarchy(reply_parents(table(spark, sf_dir, "twcs")), paths=True))
    return got.select(F.col("ancestor").cast("string").alias("ancestor_id"), F.col("descendant").cast("string").alias("descendant_id"), "distance")


def p2_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = graph.hierarchy(reply_parents(table(spark, sf_dir, "twcs"))).where("on_cycle")
    return got.select(F.col("root").cast("string").alias("cycle_id"), F.col("id").cast("string").alias("tweet_id"))


PROBS = (0.5, 0.9, 0.99)


def _author_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "twcs").select(author_key(F.col("author_id")).alias("author"), F.length("text").alias("chars"))
    return skew.key_quantiles(rows, "author", "chars", PROBS)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.heavy_keys(_author_lengths(spark, sf_dir), 0.01).where("author is not null").select("author")


def p6_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _author_lengths(spark, sf_dir)
    return got.select("author", "n", "n_values", *(F.try_element_at("quantiles", F.lit(i + 1)).alias(f"p{round(100 * p)}") for i, p in enumerate(PROBS)))


def p6_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "twcs").select(author_key(F.col("author_id")).alias("author"), F.unix_micros("created_at").alias("at"))
    return skew.key_quantiles(rows, "author", "at", (0.5,)).select("author", "n", F.try_element_at("quantiles", F.lit(1)).alias("median_micros"))


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    twcs, late, deleted = (table(spark, sf_dir, t) for t in ("twcs", "twcs_late", "deleted_tweets"))
    fields = {"in_response_to_tweet_id": "up", "response_tweet_id": "down"}
    refs = orphans.references(twcs, "twcs", fields, "tweet_id", "created_at").unionByName(orphans.references(late, "twcs_late", fields, "tweet_id", "created_at"))
    ref = F.col("tweet_id").alias("ref_id")
    return refs, twcs.select(ref), late.select(ref), deleted.select(ref)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = orphans.cascade(*_references(spark, sf_dir)).where("level = 0")  # inherited orphans are counted in p7_report
    return got.select("src_table", F.col("id").alias("tweet_id"), "field", "ref_id", "status")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(orphans.cascade(*_references(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (p2_found, p2_paths, p2_descendants, p2_cycles, p6_found, p6_lengths, p6_times, p7_found, p7_report)}

_CLEAN = r"nullif(regexp_extract({0}, '^[\s\x{{a0}}]*(\d+)(?:\.0*)?[\s\x{{a0}}]*$', 1), '')"
_EACH = "select tweet_id, unnest(string_split(coalesce({0}, ''), ',')) part from {1}"
_PARENTS = f"""own as (select tweet_id, min({_CLEAN.format('in_response_to_tweet_id')}) p from twcs group by 1),
named as (select {_CLEAN.format('part')} ref, min(tweet_id) p from ({_EACH.format('response_tweet_id', 'twcs')}) group by 1),
links as (select own.tweet_id id, coalesce(own.p, named.p) parent from own left join named on named.ref = own.tweet_id),
parents as (select id, case when parent in (select tweet_id from twcs) then parent end parent from links)"""
_TREE = f"""with recursive {_PARENTS},
down as (select id, id root, 0 depth, id path from parents where parent is null
  union all select p.id, d.root, d.depth + 1, d.path || '/' || p.id from down d join parents p on p.parent = d.id),
climb as (select id start, id spot, 0 n from parents where id not in (select id from down)
  union all select c.start, p.parent, c.n + 1 from climb c join parents p on p.id = c.spot where c.n < 200),
rings as (select start, bool_or(spot = start and n > 0) own from climb group by 1),
far as (select start, min(spot) root from climb where n >= 100 group by 1),
ringed as (select far.start id, far.root, rings.own on_cycle from far join rings using (start))"""
_PATHS = f"""{_TREE},
hang as (select id, root, id path from ringed where on_cycle
  union all select p.id, h.root, h.path || '/' || p.id from hang h join parents p on p.parent = h.id where p.id not in (select id from ringed where on_cycle)),
paths as (select id, root, cast(depth as integer) depth, path, false on_cycle from down union all select h.id, h.root, -1, path, on_cycle from hang h join ringed using (id)),
above as (select id, list_reverse(string_split(path, '/')) up from paths),
pairs as (select id descendant, unnest(up[2:]) ancestor, unnest(range(1, len(up))) distance from above),
below as (select ancestor id, count(*) n from pairs group by 1)"""
_AUTHOR = "lower(regexp_replace(trim(author_id), '^@+', ''))"


def _quantile(p: float, value: str) -> str:
    return f"list_sort(list({value}) filter (where {value} is not null))[greatest(1, cast(ceil({p} * count({value})) as bigint))]"


_REFS = " union ".join(
    f"select '{t}' src_table, tweet_id, '{c}' field, {_CLEAN.format('part')} ref_id from ({_EACH.format(c, t)})" for t in ("twcs", "twcs_late") for c in ("in_response_to_tweet_id", "response_tweet_id")
)
_DATED = " union all ".join(
    f"select '{t}' src_table, tweet_id, '{c}' field, {_CLEAN.format('part')} ref_id, strftime(created_at, '%Y-%m') period from (select tweet_id, created_at, unnest(string_split(coalesce({c}, ''), ',')) part from {t})"
    for t in ("twcs", "twcs_late") for c in ("in_response_to_tweet_id", "response_tweet_id")
)
_STATUS = """case when r.ref_id in (select tweet_id from twcs_late) then 'late'
  when r.ref_id in (select tweet_id from deleted_tweets) then 'deleted' else 'missing' end"""

SQL = {
    "p2_found": f"{_TREE} select id tweet_id, root root_id, cast(depth as integer) depth from down union all select id, root, -1 from ringed",
    "p2_cycles": f"{_TREE} select root cycle_id, id tweet_id from ringed where on_cycle",
    "p2_paths": f"""{_PATHS} select id tweet_id, path, depth, root root_id, coalesce(n, 0) n_descendants, on_cycle from paths left join below using (id)""",
    "p2_descendants": f"{_PATHS} select ancestor ancestor_id, descendant descendant_id, cast(distance as integer) distance from pairs",
    "p6_found": f"select {_AUTHOR} author from twcs where author_id is not null group by 1 having count(*) >= 0.01 * (select count(*) from twcs)",
    "p6_lengths": f"select {_AUTHOR} author, count(*) n, count(text) n_values, " + ", ".join(f"cast({_quantile(p, 'length(text)')} as bigint) p{round(100 * p)}" for p in PROBS) + " from twcs group by 1",
    "p6_times": f"select {_AUTHOR} author, count(*) n, {_quantile(0.5, 'epoch_us(created_at)')} median_micros from twcs group by 1",
    "p7_report": f"""with recursive dated as ({_DATED}), refs as (select src_table, tweet_id, field, ref_id, min(period) period from dated where ref_id is not null group by all),
  direct as (select r.*, {_STATUS} status from refs r where r.ref_id not in (select tweet_id from twcs)),
  up as (select * from refs where field = 'in_response_to_tweet_id'),
  reach as (select distinct tweet_id id, 0 far, status from direct where field = 'in_response_to_tweet_id'
    union select u.tweet_id, far + 1, status from reach join up u on u.ref_id = reach.id where far < 200),
  near as (select id, min(far) far from reach group by 1), cause as (select id, min(status) status from reach join near using (id, far) group by 1),
  every as (select src_table, field, period, status, true own from direct
    union all select src_table, field, period, cause.status, false from up join cause on cause.id = up.ref_id)
  select src_table, field, period, status, count(*) filter (where own) direct, count(*) filter (where not own) inherited from every group by 1, 2, 3, 4""",
    "p7_found": f"with refs as ({_REFS}) select r.*, {_STATUS} status from refs r where r.ref_id is not null and r.ref_id not in (select tweet_id from twcs)",
}
