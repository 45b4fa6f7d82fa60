"""Set operations on keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def newer_wins(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``new`` and the rows of ``old`` whose key it lacks."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def in_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.intersect, tables)


def pick_ids(first: DataFrame, second: DataFrame, excluded: DataFrame) -> DataFrame:
    return first.intersect(second).subtract(excluded)
