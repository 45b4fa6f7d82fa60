"""Threads: turns, replies, depth, order, participants, and liveness of comments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.functions.text import agrees, bigrams, disagrees
from threadlens.functions.time import nearest_second
from threadlens.operators.tree import positions


def drop_last_time(actions: DataFrame) -> DataFrame:
    """Without the actions at a conversation's last time."""
    last = F.max("ts").over(Window.partitionBy("conversation_id"))
    return actions.withColumn("_last", last).where("ts < _last").drop("_last")


def turns(messages: DataFrame) -> DataFrame:
    """Consecutive messages of one user merged: (conversation_id, turn_no, user_text, n_messages, start, end, words, gap).

    ``gap`` is seconds from the end of the turn before, null for the first.
    """
    conv = Window.partitionBy("conversation_id").orderBy("ts", "id")
    changed = F.when(F.col("user_text").eqNullSafe(F.lag("user_text").over(conv)) & F.lag("id").over(conv).isNotNull(), 0).otherwise(1)
    numbered = messages.withColumn("_new", changed).withColumn("turn_no", F.sum("_new").over(conv.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    merged = numbered.groupBy("conversation_id", "turn_no").agg(
        F.min("user_text").alias("user_text"),
        F.count(F.lit(1)).alias("n_messages"),
        F.min("ts").alias("start"),
        F.max("ts").alias("end"),
        F.sum(F.size(F.split(F.trim("content"), r"\s+"))).cast("long").alias("words"),
    )
    before = F.lag("end").over(Window.partitionBy("conversation_id").orderBy("turn_no"))
    return merged.withColumn("gap", nearest_second(F.col("start")) - nearest_second(before))


def turn_pairs(messages: DataFrame, words: Callable[[Column], Column], stopwords: tuple[str, ...]) -> DataFrame:
    """Each turn but a conversation's first against the turn before it: (conversation_id, turn_no, agree, disagree,
    n_repeated_content, n_repeated_stop, gap).

    Repeated words are counted as often as the turn uses them. ``words`` cuts a text into words. Where
    ``messages`` has part-of-speech tags (pos, an array), n_repeated_pos_bigram counts equal tag pairs as well.
    """
    tagged = "pos" in messages.columns
    conv = Window.partitionBy("conversation_id").orderBy("ts", "id")
    new = F.when(F.col("user_text").eqNullSafe(F.lag("user_text").over(conv)) & F.lag("id").over(conv).isNotNull(), 0).otherwise(1)
    numbered = messages.withColumn("_new", new).withColumn("turn_no", F.sum("_new").over(conv.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    said = F.array_sort(F.collect_list(F.struct("ts", "id", "content", *(["pos"] if tagged else []))))
    turn = numbered.groupBy("conversation_id", "turn_no").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), said.alias("said"))
    turn = turn.withColumn("words", F.flatten(F.transform("said", lambda x: words(x["content"]))))
    order = Window.partitionBy("conversation_id").orderBy("turn_no")
    turn = turn.withColumns({"_was": F.lag("words").over(order), "_ended": F.lag("end").over(order)})
    if tagged:
        turn = turn.withColumn("pairs", F.flatten(F.transform("said", lambda x: bigrams(x["pos"]))))
        turn = turn.withColumn("_pairs", F.lag("pairs").over(order))
    stop = F.array(*map(F.lit, stopwords))
    count = lambda now, keep: F.size(F.filter(now, keep)).cast("long")
    return turn.where("_was IS NOT NULL").select(
        "conversation_id", "turn_no", F.exists("said", lambda x: agrees(x["content"])).alias("agree"), F.exists("said", lambda x: disagrees(x["content"])).alias("disagree"),
        count("words", lambda w: F.array_contains("_was", w) & ~F.array_contains(stop, w)).alias("n_repeated_content"),
        count("words", lambda w: F.array_contains("_was", w) & F.array_contains(stop, w)).alias("n_repeated_stop"),
        *([count("pairs", lambda w: F.array_contains("_pairs", w)).alias("n_repeated_pos_bigram")] if tagged else []),
        (nearest_second(F.col("start")) - nearest_second(F.col("_ended"))).alias("gap"),
    )


def last_comments(actions: DataFrame, n: int = 1, by_user: bool = True) -> DataFrame:
    """The ``n`` latest comments of each user of a conversation, or of the conversation."""
    keys = ["conversation_id", "user_text"] if by_user else ["conversation_id"]
    order = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("id"))
    return actions.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def responses(actions: DataFrame) -> DataFrame:
    """(id, conversation_id, n_responses): how many comments answer each, 0 where none does."""
    n = actions.where("reply_to IS NOT NULL").groupBy(F.col("reply_to").alias("_to")).agg(F.count(F.lit(1)).alias("n"))
    return actions.join(n, F.col("id") == F.col("_to"), "left").select("id", "conversation_id", F.coalesce("n", F.lit(0)).alias("n_responses"))


def question_pairs(actions: DataFrame, asks: Column) -> DataFrame:
    """(conversation_id, n_questions, n_answered, pair_00 .. pair_11): questions, those with an answer, and replies by whether
    reply (first digit) and parent (second) are questions."""
    marked = actions.withColumn("_asks", asks.cast("int"))
    answers = reply_pairs(marked, ["_asks"])
    kinds = answers.groupBy("conversation_id").agg(*[F.count(F.when((F.col("_asks") == a) & (F.col("to__asks") == b), 1)).alias(f"pair_{a}{b}") for a in (0, 1) for b in (0, 1)])
    answered = responses(actions).select(F.col("id").alias("_id"), "n_responses")
    totals = marked.join(answered, F.col("id") == F.col("_id")).groupBy("conversation_id").agg(
        F.sum("_asks").cast("long").alias("n_questions"), F.count(F.when((F.col("_asks") == 1) & (F.col("n_responses") > 0), 1)).alias("n_answered")
    )
    return totals.join(kinds, "conversation_id", "left").fillna(0)


def attacker_spoke_before(actions: DataFrame) -> DataFrame:
    """(conversation_id, user_text, spoke_before): the user of a conversation's last action, and whether they took part before its last time."""
    last = actions.groupBy("conversation_id").agg(F.max(F.struct("ts", "id", "user_text")).alias("x")).select("conversation_id", "x.user_text", F.col("x.ts").alias("_end"))
    own = F.col("user_text").eqNullSafe(F.col("_user")) & (F.col("ts") < F.col("_end"))
    joined = actions.join(last.withColumnRenamed("user_text", "_user"), "conversation_id")
    return joined.groupBy("conversation_id", F.col("_user").alias("user_text")).agg(F.max(own).alias("spoke_before"))


def own_previous(actions: DataFrame, columns: list[str]) -> DataFrame:
    """``actions`` with ``prev_<column>`` of the same user's latest strictly earlier action in the conversation."""
    mine = Window.partitionBy("conversation_id", "user_text").orderBy("ts")
    # one row a time, so that the row before is the latest strictly earlier time; of its actions the least id counts
    by_time = actions.groupBy("conversation_id", "user_text", "ts").agg(F.min_by(F.struct(*columns), "id").alias("_x"))
    previous = by_time.withColumn("_prev", F.lag("_x").over(mine)).select("conversation_id", "user_text", "ts", "_prev")
    joined = actions.join(previous, ["conversation_id", "user_text", "ts"], "left")
    return joined.select(*actions.columns, *[F.col(f"_prev.{c}").alias(f"prev_{c}") for c in columns])


def reply_pairs(actions: DataFrame, columns: list[str]) -> DataFrame:
    """Each reply with ``to_<column>`` of the comment it answers."""
    parent = actions.select(F.col("id").alias("_parent"), *[F.col(c).alias(f"to_{c}") for c in columns])
    return actions.join(parent, F.col("reply_to") == F.col("_parent")).drop("_parent")


def user_pairs(actions: DataFrame) -> DataFrame:
    """Distinct directed (user, answered user) pairs of each conversation, self-replies left out."""
    pairs = reply_pairs(actions, ["user_text"]).where("user_text <> to_user_text")
    return pairs.select("conversation_id", F.col("user_text").alias("a"), F.col("to_user_text").alias("b")).distinct()


def network(actions: DataFrame) -> DataFrame:
    """(conversation_id, users, pairs, density = pairs / users^2, reciprocity = share of pairs answered back)."""
    pairs = user_pairs(actions)
    both = pairs.groupBy("conversation_id", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    per = both.groupBy("conversation_id").agg(F.sum("n").cast("long").alias("pairs"), F.sum(F.when(F.col("n") == 2, 2).otherwise(0)).cast("long").alias("mutual"))
    users = actions.groupBy("conversation_id").agg(F.countDistinct("user_text").alias("users"))
    joined = users.join(per, "conversation_id", "left").fillna(0, ["pairs", "mutual"])
    return joined.select(
        "conversation_id", "users", "pairs",
        F.round(F.col("pairs") / (F.col("users") * F.col("users")), 6).alias("density"),
        F.round(F.when(F.col("pairs") > 0, F.col("mutual") / F.col("pairs")).otherwise(0.0), 6).alias("reciprocity"),
    )


def depths(actions: DataFrame) -> DataFrame:
    """(id, conversation_id, root, depth) by following replies from the roots.

    A reply to an unknown comment is a root, as is the first comment of a circle of replies.
    """
    return positions(actions).drop("dfs_index", "is_final")


def deepest(actions: DataFrame) -> DataFrame:
    """The deepest comment of each conversation; the latest of those as deep: (conversation_id, id, depth)."""
    d = depths(actions).join(actions.select("id", "ts"), "id")
    return d.groupBy("conversation_id").agg(F.max(F.struct("depth", "ts", "id")).alias("x")).select("conversation_id", "x.id", "x.depth")


def participants(actions: DataFrame) -> DataFrame:
    """Per (conversation, user): utterances, their share, words, replies received, seconds taken to answer."""
    base = actions.groupBy("conversation_id", "user_text").agg(
        F.count(F.lit(1)).alias("utterances"), F.sum(F.size(F.split(F.trim("content"), r"\s+"))).cast("long").alias("words")
    )
    total = F.sum("utterances").over(Window.partitionBy("conversation_id"))
    base = base.withColumn("share", F.round(F.col("utterances") / total, 6))
    pairs = reply_pairs(actions, ["user_text", "ts"])
    received = pairs.groupBy("conversation_id", F.col("to_user_text").alias("user_text")).agg(F.countDistinct("reply_to").alias("replied"))
    seconds = nearest_second(F.col("ts")) - nearest_second(F.col("to_ts"))
    gaps = pairs.groupBy("conversation_id", "user_text").agg(F.sum(seconds).alias("reply_seconds"), F.max(seconds).alias("longest_gap"))
    keys = ["conversation_id", "user_text"]
    return base.join(received, keys, "left").join(gaps, keys, "left").fillna(0, ["replied"])


def last_participant_profile(users: DataFrame, aspect: str) -> DataFrame:
    """How the last participant of a conversation stands among the others on an aspect: Anonymous, New Comer, Bot, No Gap, Max, Min or Middle.

    ``users`` has conversation_id, user_text, is_last, is_new and the aspect; where it has them, anonymous and bot.
    """
    conv = Window.partitionBy("conversation_id")
    ranged = users.withColumn("_lo", F.min(aspect).over(conv)).withColumn("_hi", F.max(aspect).over(conv)).where("is_last")
    is_a = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in users.columns else F.lit(False)
    kind = (
        F.when(is_a("anonymous") | F.col("user_text").isNull(), "Anonymous").when(F.col("is_new"), "New Comer").when(is_a("bot"), "Bot").when(F.col("_lo") == F.col("_hi"), "No Gap").when(F.col(aspect) == F.col("_hi"), "Max")
        .when(F.col(aspect) == F.col("_lo"), "Min").otherwise("Middle")
    )
    return ranged.select("conversation_id", "user_text", kind.alias("profile"))


def question_profile(actions: DataFrame, attackers: DataFrame) -> DataFrame:
    """Who asks in a conversation: None, Attacker, Non-Attacker or Both. ``attackers``: (conversation_id, user_text)."""
    marks = attackers.select("conversation_id", "user_text", F.lit(True).alias("_a")).distinct()
    joined = actions.join(marks, ["conversation_id", "user_text"], "left")
    asks = F.col("content").contains("?")
    by = joined.groupBy("conversation_id").agg(F.max(asks & F.col("_a").isNotNull()).alias("a"), F.max(asks & F.col("_a").isNull()).alias("b"))
    return by.select("conversation_id", F.when(F.col("a") & F.col("b"), "Both").when(F.col("a"), "Attacker").when(F.col("b"), "Non-Attacker").otherwise("None").alias("asked_by"))


def word_adoption(actions: DataFrame, words: F.Column) -> DataFrame:
    """Words that a user brought into a conversation and another user took up later:
    (conversation_id, user_text, introduced, adopted)."""
    spread = actions.select("conversation_id", "user_text", "ts", "id", F.explode(F.array_distinct(words)).alias("word"))
    first = spread.groupBy("conversation_id", "word").agg(F.min(F.struct("ts", "id", "user_text")).alias("x"), F.countDistinct("user_text").alias("n_users"))
    return first.groupBy("conversation_id", F.col("x.user_text").alias("user_text")).agg(
        F.count(F.lit(1)).alias("introduced"), F.count(F.when(F.col("n_users") > 1, 1)).alias("adopted")
    )


def live_tree(actions: DataFrame) -> DataFrame:
    """Which comments of an action log stand at its end, and under which parent.

    ``actions``: id, type, conversation_id, ts, parent_id, reply_to. A deletion, or a change of any kind
    but restoration, makes its parent absent; the later of restorations and removals counts. Returns
    (id, conversation_id, latest: the version that stands for it, null if deleted; present).
    """
    removal = F.col("type").isin("DELETION", "MODIFICATION")
    events = actions.where("parent_id IS NOT NULL AND (type IN ('DELETION', 'MODIFICATION', 'RESTORATION'))")
    last = events.groupBy("parent_id").agg(F.max(F.struct("ts", "id", removal.alias("removed"), "type")).alias("e"))
    own = actions.where("type NOT IN ('DELETION', 'RESTORATION')").select("id", "conversation_id")
    joined = own.join(last, F.col("id") == F.col("parent_id"), "left")
    present = ~F.coalesce(F.col("e.removed"), F.lit(False))
    latest = F.when(present, F.col("id")).when(F.col("e.type") == "MODIFICATION", F.col("e.id"))
    return joined.select("id", "conversation_id", latest.alias("latest"), present.alias("present"))


def dfs_order(actions: DataFrame) -> DataFrame:
    """(id, conversation_id, depth, dfs_index, is_final): comments in depth-first order of the reply tree.

    Children stand in comment order: by time, then the numeric parts of the id.
    """
    return positions(actions).drop("root")
