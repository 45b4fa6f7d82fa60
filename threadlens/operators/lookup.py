"""Parameterised lookups: each a filter that reaches the scan, with a total order before any limit."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEARCHED = ("conversation_id", "user_text", "page_id", "page_title", "type", "id", "content")
_ID, _NAME = re.compile(r"^[\d.]+$"), re.compile(r"^[^'\"]*$")


def conversation(actions: DataFrame, conversation_id: object, most: int = 100) -> DataFrame:
    return actions.where(F.col("conversation_id") == conversation_id).orderBy("ts", "id").limit(most)


def by_revision(actions: DataFrame, rev_id: int, most: int = 100) -> DataFrame:
    return actions.where(F.col("rev_id") == rev_id).orderBy("id").limit(most)


def by_page(actions: DataFrame, column: str, value: object, most: int = 100) -> DataFrame:
    if column not in ("page_id", "page_title"):
        raise ValueError(f"pages are looked up by page_id or page_title, not {column}")
    return actions.where(F.col(column) == value).orderBy("ts", "id").limit(most)


def search(actions: DataFrame, column: str, operator: str, value: str, most: int = 100) -> DataFrame:
    """Rows whose column equals or is LIKE a value; columns and operators are listed, quotes refused."""
    if column not in SEARCHED or operator not in ("=", "LIKE") or not _NAME.match(value):
        raise ValueError(f"can't search {column} {operator} {value!r}")
    c = F.col(column).cast("string")
    return actions.where(c == value if operator == "=" else c.like(value)).orderBy("id").limit(most)


def by_toxicity(
    actions: DataFrame, low: float, high: float, descending: bool = True, alive: bool = False, most: int = 20, **equal: object
) -> DataFrame:
    """The ``most`` extreme actions of an open score range that are no deletions; ``equal`` adds column = value."""
    found = actions.where((F.col("toxicity") > low) & (F.col("toxicity") < high) & (F.col("type") != "DELETION"))
    if alive:
        found = found.where("is_alive")
    for column, value in equal.items():
        if column == "id" and not _ID.match(str(value)):
            raise ValueError(f"no action id: {value!r}")
        found = found.where(F.col(column) == value)
    return found.orderBy(F.desc("toxicity") if descending else F.asc("toxicity"), "id").limit(most)


def latest_reply(actions: DataFrame) -> DataFrame:
    """The latest reply to each comment: (reply_to, id, ts)."""
    replies = actions.where("reply_to IS NOT NULL").groupBy("reply_to")
    return replies.agg(F.max(F.struct("ts", "id")).alias("x")).select("reply_to", "x.id", "x.ts")


def context_upto(actions: DataFrame, comment_id: str) -> DataFrame:
    """The conversation of a comment up to and with its time."""
    one = actions.where(F.col("id") == comment_id).select("conversation_id", F.col("ts").alias("until"))
    return actions.join(one, "conversation_id").where("ts <= until").drop("until")


def of_length(actions: DataFrame, column: str, above: int, below: int) -> DataFrame:
    """Replies whose text is longer than ``above`` and shorter than ``below``; a target written as the text ``null`` is none."""
    return actions.where((F.length(column) > above) & (F.length(column) < below) & (F.col("reply_to") != "null"))


def of_pages(revisions: DataFrame, pages: DataFrame) -> DataFrame:
    """Revisions of the pages named in the table ``pages`` (chunk, page_id)."""
    return revisions.join(pages.select("page_id").distinct(), "page_id", "left_semi")


def enriched(changes: DataFrame, comments: DataFrame) -> DataFrame:
    """Changes, whose ids may be negative, with text and time of their revision; those without either go."""
    known = comments.where("comment IS NOT NULL AND timestamp IS NOT NULL").select(F.col("rev_id").alias("_rev"), "comment", "timestamp")
    return changes.join(known, F.abs("rev_id") == F.col("_rev")).drop("_rev")
