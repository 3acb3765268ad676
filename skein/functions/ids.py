"""Cleaning of record ids and of lists of ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number, perhaps written as a float, between any white space.
_ID = r"^[\s ]*(\d+)(?:\.0*)?[\s ]*$"


def clean_id(c: Column) -> Column:
    """The digits of an id written as ``7``, `` 7 `` or ``7.0``; null for ``nan``, blanks and anything else."""
    return F.nullif(F.regexp_extract(c, _ID, 1), F.lit(""))


def clean_ids(c: Column) -> Column:
    """Array of the clean ids in a comma list; empty for null."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), clean_id)
    return F.array_distinct(F.filter(parts, lambda x: x.isNotNull()))


def as_key(c: Column) -> Column:
    """An id as a long; -1, which no row has, where it is too long for one."""
    return F.when(c.isNotNull(), F.coalesce(c.try_cast("bigint"), F.lit(-1).cast("bigint")))


def author_key(c: Column) -> Column:
    """An author in one spelling: trimmed, lower case, without leading @."""
    return F.lower(F.regexp_replace(F.trim(c), r"^@+", ""))
