"""A user's past at the start of a conversation: counts, recent comments, mean scores, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlens.functions.time import nearest_second


def counts_before(starts: DataFrame, edits: DataFrame) -> DataFrame:
    """(user, start, n_before, n_week): edits strictly before a start, and those of the seven days before it, by the nearest seconds.

    ``starts``: (user, start); ``edits``: (user, ts). Edits and starts of a user are merged in time order
    and counted by one window, so that a user with a long past costs a sort, not a product.
    """
    marks = starts.select("user", F.col("start").alias("ts"), F.lit(0).alias("e")).distinct()
    both = marks.unionByName(edits.select("user", "ts", F.lit(1).alias("e")))
    seconds = nearest_second(F.col("ts"))
    order = Window.partitionBy("user").orderBy(seconds)
    before = order.rangeBetween(Window.unboundedPreceding, -1)
    week = order.rangeBetween(-7 * 86400 + 1, -1)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    counted = both.withColumn("n_before", zero(F.sum("e").over(before))).withColumn("n_week", zero(F.sum("e").over(week)))
    return counted.where("e = 0").select("user", F.col("ts").alias("start"), "n_before", "n_week")


def latest_before(starts: DataFrame, edits: DataFrame, most: int = 100, days: int = 7) -> DataFrame:
    """The ``most`` latest edits of each (user, start) that lie more than ``days`` before it."""
    # number a user's edits by time, count those before each bound, and join by number: no product of starts and edits
    mine = Window.partitionBy("user").orderBy("ts", "edit_id")
    numbered = edits.withColumn("_n", F.row_number().over(mine))
    bounds = starts.select("user", "start").distinct().withColumn("ts", F.col("start") - F.make_dt_interval(F.lit(days)))
    both = bounds.withColumn("e", F.lit(0)).unionByName(edits.select("user", "ts", F.lit(1).alias("e")), allowMissingColumns=True)
    before = Window.partitionBy("user").orderBy("ts", "e").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a bound comes before edits of its time
    counted = both.withColumn("_c", F.sum("e").over(before)).where("e = 0").select("user", "start", "_c")
    upto = F.col("_c").cast("int")
    wanted = counted.where("_c > 0").select("user", "start", "_c", F.explode(F.sequence(F.greatest(upto - most + 1, F.lit(1)), upto)).alias("_n"))
    return wanted.join(numbered, ["user", "_n"]).withColumn("place", (F.col("_c") - F.col("_n") + 1).cast("long")).drop("_c", "_n")


def past_toxicity(actions: DataFrame, starts: DataFrame) -> DataFrame:
    """(conversation_id, user, history_toxicity): mean score before a start, 0 without a past."""
    marks = starts.select("user", F.col("start").alias("ts")).distinct().withColumn("e", F.lit(0))
    both = marks.unionByName(actions.select("user", "ts", F.lit(1).alias("e"), "toxicity"), allowMissingColumns=True)
    before = Window.partitionBy("user").orderBy("ts", "e").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a start comes before actions of its time
    past = both.withColumn("_mean", F.avg("toxicity").over(before)).where("e = 0").select(F.col("user").alias("_user"), F.col("ts").alias("_start"), "_mean")
    joined = starts.join(past, F.col("user").eqNullSafe(F.col("_user")) & (F.col("start") == F.col("_start")), "left")
    return joined.groupBy("conversation_id", "user").agg(F.coalesce(F.max("_mean"), F.lit(0.0)).alias("history_toxicity"))


def monthly_edits(edits: DataFrame) -> DataFrame:
    return edits.groupBy("user", "page_id", F.year("ts").alias("year"), F.month("ts").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def subject_pages(edits: DataFrame, subjects: DataFrame) -> DataFrame:
    """``edits`` with ``subject_id``: the subject page of their talk page, -1 where none is known. ``subjects``: (page_id, subject_id)."""
    known = subjects.select("page_id", "subject_id").dropDuplicates(["page_id"])
    return edits.join(known, "page_id", "left").withColumn("subject_id", F.coalesce("subject_id", F.lit(-1)))


def account_age_months(registered: F.Column, now: F.Column) -> F.Column:
    """Months of 30 days between two epoch seconds, 0 at least."""
    return F.greatest((now - registered) / (30 * 86400), F.lit(0.0))


# User groups of each status level.
LEVELS = {
    4: ["founder", "sysop"],
    3: ["accountcreator", "bureaucrat", "checkuser"],
    2: [
        "abusefilter", "abusefilter-helper", "autoreviewer", "extendedmover", "filemover", "import", "oversight", "patroller", "reviewer", "rollbacker",
        "templateeditor", "epadmin", "epcampus", "epcoordinator", "epinstructor", "eponline",
    ],
    1: ["massmessage-sender", "ipblock-exempt", "extendedconfirmed", "autoconfirmed", "researcher", "user"],
}


def status(groups: F.Column) -> F.Column:
    """-1 for a bot, 4 down to 1 by the highest of a user's groups."""
    level = F.when(F.array_contains(groups, "bot"), -1)
    for n, names in LEVELS.items():
        level = level.when(F.arrays_overlap(groups, F.array(*map(F.lit, names))), n)
    return level.otherwise(1)


def user_facts(users: DataFrame, starts: DataFrame) -> DataFrame:
    """(conversation_id, user, registered, level, anonymous, blocked before the start); -1 pages and unknown users stay."""
    joined = starts.join(users.withColumnRenamed("name", "user"), "user", "left")
    return joined.select(
        "conversation_id", "user", F.unix_timestamp("registration").alias("registered"), status(F.coalesce("groups", F.array().cast("array<string>"))).alias("level"),
        F.col("user").rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$").alias("anonymous"), F.coalesce(F.col("blockedtimestamp") < F.col("start"), F.lit(False)).alias("blocked"),
    )
