"""Operators that keep or drop reads by what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basewright.functions import exprs as X

#: Id lists of so many rows at most are broadcast; longer ones are joined by shuffles.
BROADCAST_IDS = 2_000_000


def _small(ids: DataFrame) -> DataFrame:
    one = ids.toDF("_name").dropDuplicates()
    return F.broadcast(one) if one.count() <= BROADCAST_IDS else one


def search(reads: DataFrame, pattern: str, ignore_case: bool = False, invert: bool = False) -> DataFrame:
    """Reads whose bases match a regular expression anywhere, or don't."""
    found = F.col("seq").rlike(("(?i)" if ignore_case else "") + pattern)
    return reads.where(~found if invert else found)


def grep(reads: DataFrame, ids: DataFrame, full: bool = False) -> DataFrame:
    """Reads whose first id token (or whole id) is in a list."""
    key = F.col("id") if full else X.first_token(F.col("id"))
    return reads.join(_small(ids), key == F.col("_name"), "left_semi")


def remove(reads: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads whose whole id isn't in a list, and those whose id is."""
    small = _small(ids)
    same = F.col("id") == F.col("_name")
    return reads.join(small, same, "left_anti"), reads.join(small, same, "left_semi")


def select_pairs(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The reads of each file whose whole id is in the other."""
    return first.join(second.select("id"), "id", "left_semi").select(first.columns), second.join(first.select("id"), "id", "left_semi").select(second.columns)
