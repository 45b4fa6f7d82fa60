"""Linguistic coordination: how much more a user uses a class of words when answering someone who used it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_USES = 3


def marker_flags(pairs: DataFrame, markers: dict[str, Column], answered: dict[str, Column]) -> DataFrame:
    """(user_text, marker, s: the reply has it, t: the answered comment has it), one row for each pair and marker."""
    rows = F.array(*[F.struct(F.lit(m).alias("marker"), c.cast("int").alias("s"), answered[m].cast("int").alias("t")) for m, c in markers.items()])
    return pairs.select("user_text", F.explode(rows).alias("x")).select("user_text", "x.*")


def coordination(flags: DataFrame, least: int = LEAST_USES) -> DataFrame:
    """(user_text, marker, coordination): sum(s and t) / sum(t) - sum(s) / n; null below ``least`` uses or without any t."""
    g = flags.groupBy("user_text", "marker").agg(
        F.sum(F.col("s") * F.col("t")).alias("both"), F.sum("t").alias("t"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("n")
    )
    value = F.when((F.col("s") >= least) & (F.col("t") > 0), F.col("both") / F.col("t") - F.col("s") / F.col("n"))
    return g.select("user_text", "marker", value.alias("coordination"))


def aggregated(per_marker: DataFrame) -> DataFrame:
    """(user_text, all_present, filled, present): mean over markers if all are known; mean with unknown ones
    taken from the marker's mean over users (zeros left out); mean of the known ones."""
    mean = F.avg(F.when(F.col("coordination") != 0, F.col("coordination"))).over(Window.partitionBy("marker"))
    x = per_marker.withColumn("_f", F.coalesce("coordination", mean))
    known, n = F.count("coordination"), F.count(F.lit(1))
    return x.groupBy("user_text").agg(
        F.when(known == n, F.avg("coordination")).alias("all_present"), F.when(known > 0, F.avg("_f")).alias("filled"), F.avg("coordination").alias("present")
    )
