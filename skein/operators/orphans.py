"""References to records that do not exist, direct and inherited."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.ids import clean_ids
from skein.session import cut, drop


def references(df: DataFrame, name: str, fields: dict[str, str], key: str, when: str) -> DataFrame:
    """(src_table, id, field, ref_id, points, period): one row per reference of a table.

    ``fields`` says of each column whether it names the row's parent (``up``) or its children (``down``). Ids count
    after cleaning; null, empty and ``nan`` are no references. ``period`` is the month of ``when``, null if that is.
    """
    def of(field: str, way: str):
        return F.transform(clean_ids(F.col(field)), lambda ref: F.struct(F.lit(field).alias("field"), ref.alias("ref_id"), F.lit(way).alias("points")))

    each = [of(field, way) for field, way in fields.items()]
    rows = df.select(F.lit(name).alias("src_table"), F.col(key).alias("id"), F.date_format(when, "yyyy-MM").alias("period"), F.explode(F.concat(*each)).alias("r"))
    return rows.select("src_table", "id", "period", "r.*")


def direct(refs: DataFrame, known: DataFrame, late: DataFrame, deleted: DataFrame) -> DataFrame:
    """(src_table, id, field, ref_id, points, status, period, level 0): the distinct references to ids that ``known`` lacks.

    ``late`` if the id arrived later, else ``deleted`` if it has a tombstone, else ``missing``. Repeated references count
    once, with their earliest period; null keys match nothing.
    """
    refs = refs.groupBy("src_table", "id", "field", "ref_id", "points").agg(F.min("period").alias("period"))
    dangling = refs.join(known, "ref_id", "left_anti")
    dangling = dangling.join(late.select("ref_id", F.lit("late").alias("l")).distinct(), "ref_id", "left")
    dangling = dangling.join(deleted.select("ref_id", F.lit("deleted").alias("d")).distinct(), "ref_id", "left")
    return dangling.select("src_table", "id", "field", "ref_id", "points", F.coalesce("l", "d", F.lit("missing")).alias("status"), "period", F.lit(0).alias("level"))


def cascade(refs: DataFrame, known: DataFrame, late: DataFrame, deleted: DataFrame) -> DataFrame:
    """(src_table, id, field, ref_id, status, period, level): every orphan reference, direct at level 0, then inherited.

    ``refs`` comes from :func:`references`; ``known``, ``late`` and ``deleted`` each have the column ``ref_id``.
    Level 0 are the references of :func:`direct`. A record whose upward reference is orphaned is itself an orphan, and so are those
    that refer up to it: each round semi-joins the references with the records found in the one before, until no new
    ones come (circles end, as a record is an orphan once). Inherited rows have the status of their first cause in
    alphabetical order.
    """
    level = cut(direct(refs, known, late, deleted))
    upward = cut(refs.where("points = 'up'").groupBy("src_table", "id", "field", "ref_id", "points").agg(F.min("period").alias("period")))
    found = [level]
    orphans = cut(level.where("points = 'up'").groupBy(F.col("id").alias("ref_id")).agg(F.min("status").alias("status")))
    seen = orphans
    while not orphans.isEmpty():
        level = cut(upward.join(orphans, "ref_id").select("src_table", "id", "field", "ref_id", "points", "status", "period", F.lit(len(found)).alias("level")))
        if level.isEmpty():
            drop(level)
            break
        found.append(level)
        new = level.groupBy(F.col("id").alias("ref_id")).agg(F.min("status").alias("status"))
        orphans = cut(new.join(seen, "ref_id", "left_anti"))
        seen = seen.unionByName(orphans)
    drop(upward)
    return reduce(DataFrame.unionByName, found).drop("points")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """(src_table, field, period, status, direct, inherited) counts of the references of :func:`cascade`."""
    return orphans.groupBy("src_table", "field", "period", "status").agg(
        F.count_if(F.col("level") == 0).alias("direct"), F.count_if(F.col("level") > 0).alias("inherited")
    )
