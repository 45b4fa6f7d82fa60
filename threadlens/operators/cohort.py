"""Cohort matching: conversations that end in an attack, paired with calm ones of the same page and length.

Running windows over a conversation replace self-joins, so that each step costs one sort on its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.functions.time import nearest_second

ATTACK, CALM, CALM_AFTER = 0.6, 0.6, 0.4


def dedupe_scores(scores: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One score of each key: the first in ``order``."""
    return scores.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def split_by_type(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Actions that carry text of their own, and those that take or bring back another's."""
    own = F.col("type").isin("ADDITION", "CREATION", "MODIFICATION")
    return actions.where(own), actions.where(F.col("type").isin("DELETION", "RESTORATION"))


def with_own_score(actions: DataFrame, scores: DataFrame, model: str) -> DataFrame:
    return actions.join(scores.where(F.col("model") == model).select(F.col("record_id").alias("id"), "score"), "id")


def with_parent_score(actions: DataFrame, scores: DataFrame, model: str) -> DataFrame:
    return actions.join(scores.where(F.col("model") == model).select(F.col("record_id").alias("parent_id"), "score"), "parent_id")


def fully_scored(scored: DataFrame, every: DataFrame) -> DataFrame:
    """Conversations of which each action has a score: their ids and number of actions."""
    n = scored.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n_scored"))
    m = every.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(m, "conversation_id").where("n_scored = n").select("conversation_id", "n")


def bad_conversations(scored: DataFrame, attack: float = ATTACK) -> DataFrame:
    """Actions up to and with the first attack, of conversations that have one; ``attack_time`` added."""
    conv = Window.partitionBy("conversation_id")
    timed = scored.withColumn("attack_time", F.min(F.when(F.col("toxicity") > attack, F.col("ts"))).over(conv))
    return timed.where("ts <= attack_time")


def good_conversations(scored: DataFrame, calm: float = CALM) -> DataFrame:
    """All actions of conversations whose greatest score is below the bound."""
    return scored.withColumn("_most", F.max("toxicity").over(Window.partitionBy("conversation_id"))).where(F.col("_most") < calm).drop("_most")


def conversation_stats(actions: DataFrame) -> DataFrame:
    """(conversation_id, start, end, page_id, users, length) of conversations that last and have several users."""
    stats = actions.groupBy("conversation_id").agg(
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
        F.min("page_id").alias("page_id"),
        F.countDistinct("user_text").alias("users"),
        F.countDistinct("id").alias("length"),
    )
    return stats.where("end_time > start_time AND users > 1")


def before_attack(bad: DataFrame) -> DataFrame:
    """What a bad conversation was like before its attack: greatest score, users and actions."""
    earlier = F.col("ts") < F.col("attack_time")
    return bad.groupBy("conversation_id").agg(
        F.max(F.when(earlier, F.col("toxicity"))).alias("before_max"),
        F.countDistinct(F.when(earlier, F.col("user_text"))).alias("users_before"),
        F.countDistinct(F.when(earlier, F.col("id"))).alias("length_before"),
    )


def prefixes(good: DataFrame) -> DataFrame:
    """Each time of a good conversation as a possible end: stats up to it, before it, and the greatest score from it on.

    One row for each (conversation, time): (conversation_id, end_time, start_time, page_id, users,
    length, before_max, users_before, length_before, after_max).
    """
    def is_new(column: str) -> Column:
        first = F.row_number().over(Window.partitionBy("conversation_id", column).orderBy("ts", "id")) == 1
        return (first & F.col(column).isNotNull()).cast("int")

    marked = good.withColumn("new_user", is_new("user_text")).withColumn("new_id", is_new("id"))
    by_time = marked.groupBy("conversation_id", "ts").agg(
        F.min("page_id").alias("page_id"), F.sum("new_user").alias("new_users"), F.sum("new_id").alias("new_ids"), F.max("toxicity").alias("most")
    )
    conv = Window.partitionBy("conversation_id").orderBy("ts")  # one row a time by now
    upto = conv.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = conv.rowsBetween(Window.unboundedPreceding, -1)
    after = conv.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    count = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    return by_time.select(
        "conversation_id", F.col("ts").alias("end_time"),
        F.min("ts").over(upto).alias("start_time"), F.min("page_id").over(upto).alias("page_id"),
        count("new_users", upto).alias("users"), count("new_ids", upto).alias("length"),
        F.max("most").over(earlier).alias("before_max"),
        count("new_users", earlier).alias("users_before"), count("new_ids", earlier).alias("length_before"),
        F.max("most").over(after).alias("after_max"),
    )


def candidate_matches(bad: DataFrame, good: DataFrame, gap: float = 0.2) -> DataFrame:
    """Bad and good ends of one page and length whose greatest earlier scores differ by less than ``gap``
    and that have equally many users. ``bad`` has before-attack columns joined to its stats."""
    b = bad.select("page_id", "length", F.col("conversation_id").alias("bad_id"), F.col("start_time").alias("bs"), F.col("end_time").alias("be"), F.col("before_max").alias("bm"), F.col("users").alias("bu"))
    g = good.select("page_id", "length", F.col("conversation_id").alias("good_id"), F.col("start_time").alias("gs"), F.col("end_time").alias("ge"), F.col("before_max").alias("gm"), F.col("users").alias("gu"))
    seconds = lambda x, y: F.abs(nearest_second(F.col(x)) - nearest_second(F.col(y)))
    joined = b.join(g, ["page_id", "length"]).where((F.abs(F.col("bm") - F.col("gm")) < gap) & (F.col("bu") == F.col("gu")))
    return joined.select("bad_id", "good_id", "page_id", "length", F.col("ge").alias("good_end"), seconds("bs", "gs").alias("start_delta"), seconds("be", "ge").alias("end_delta"))


def best_matches(matches: DataFrame) -> DataFrame:
    """The closest bad conversation of each good one, then the closest good one of each bad one among those."""

    def first(df: DataFrame, key: str, tie: list[str | Column]) -> DataFrame:
        order = Window.partitionBy(key).orderBy("start_delta", "end_delta", *tie)
        return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")

    return first(first(matches, "good_id", ["bad_id", "good_end"]), "bad_id", ["good_id", "good_end"])
