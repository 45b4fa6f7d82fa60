"""Revert detection by repeated content hashes.

A content hash that occurs more than once on a page spans from its first to its last time; revisions
within such a span were reverted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def repeated_hashes(revisions: DataFrame) -> DataFrame:
    """(page_id, sha1, n, first_ts, last_ts) of hashes that a page has more than once; null hashes never repeat."""
    groups = revisions.where("sha1 IS NOT NULL").groupBy("page_id", "sha1")
    return groups.agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).where("n > 1")


def with_reverted(revisions: DataFrame) -> DataFrame:
    """``revisions`` with ``reverted``: within [first, last) of a repeated hash of the page, or at the one
    time of a hash whose repeats all have one time.

    No range join: as the page is read in time order, the latest end of all spans begun so far tells
    whether one still runs, so a page costs one sort whatever its number of spans.
    """
    same = Window.partitionBy("page_id", "sha1")
    spans = revisions.withColumn("_n", F.when(F.col("sha1").isNotNull(), F.count(F.lit(1)).over(same)).otherwise(0))
    spans = spans.withColumn("_first", F.when(F.col("_n") > 1, F.min("ts").over(same))).withColumn("_last", F.when(F.col("_n") > 1, F.max("ts").over(same)))
    page = Window.partitionBy("page_id").orderBy("ts")
    so_far = page.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    now = page.rangeBetween(Window.currentRow, Window.currentRow)
    running = F.coalesce(F.max("_last").over(so_far) > F.col("ts"), F.lit(False))
    at_once = F.max(F.col("_n").cast("boolean") & (F.col("_n") > 1) & (F.col("_first") == F.col("_last"))).over(now)
    return spans.withColumn("reverted", running | F.coalesce(at_once, F.lit(False))).drop("_n", "_first", "_last")


def reverted_rows(revisions: DataFrame) -> DataFrame:
    return with_reverted(revisions).where("reverted").drop("reverted").dropDuplicates(["rev_id"])


def unreverted(revisions: DataFrame, reverted: DataFrame) -> DataFrame:
    """Revisions whose id is not in ``reverted``."""
    return revisions.join(reverted.select("rev_id"), "rev_id", "left_anti")


def daily_reverts(revisions: DataFrame, toxic: float = 0.75) -> DataFrame:
    """Per day: revisions, toxic ones, toxic and reverted ones, and the toxic share."""
    is_toxic = F.col("attack") >= toxic
    days = with_reverted(revisions).groupBy(F.to_date("ts").alias("day"))
    return days.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(is_toxic, 1)).alias("toxic"),
        F.count(F.when(is_toxic & F.col("reverted"), 1)).alias("toxic_reverted"),
        F.round(F.count(F.when(is_toxic, 1)) / F.count(F.lit(1)), 6).alias("toxic_share"),
    )
