"""Columns that are worked out once a row, however often they are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns that are worked out once a row: conditions on plain ones are moved below them and work them out again."""
    made = df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_made"))
    return made.select(*df.columns, *[F.col(f"_made.{n}").alias(n) for n in columns])
