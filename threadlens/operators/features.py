"""Features of conversations, as aggregates over per-comment columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlens.functions import text as t
from threadlens.functions.once import once
from threadlens.functions.time import nearest_second
from threadlens.operators.conversations import drop_last_time, own_previous, reply_pairs

#: A short default; callers with a fuller list pass it.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "this", "to", "was", "were", "will", "with")


def per_comment(actions: DataFrame, lexicons: dict[str, list[str]] | None = None, stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """``actions`` with token lists, cues and counts of each lexicon."""
    c = F.col("content")
    words = t.tokens(c)
    stop = F.array(*map(F.lit, stopwords))
    out = actions.withColumns({"tokens": words, "stop_tokens": F.array_intersect(words, stop), "content_tokens": F.array_except(words, stop), "length": F.size(words), **t.cues(c)})
    out = out.withColumns({"agrees": t.agrees(c), "disagrees": t.disagrees(c)})
    return out.withColumns({f"lexicon_{k}": t.lexicon_count(c, v) for k, v in (lexicons or {}).items()})


def conversation_features(
    actions: DataFrame, lexicons: dict[str, list[str]] | None = None, compat: bool = False, stopwords: tuple[str, ...] = STOPWORDS
) -> DataFrame:
    """One row a conversation, over its comments before the last time.

    Lengths, greatest score, score entropy, any-comment cues, repetition against the own previous
    comment, adoption against the answered one, score rises. ``compat`` gives min_len as the last
    comment's length, as published figures have it.
    """
    rows = per_comment(drop_last_time(actions), lexicons, stopwords)
    conv = Window.partitionBy("conversation_id")
    p = F.col("toxicity") / F.nullif(F.sum("toxicity").over(conv), F.lit(0.0))
    n = F.count(F.lit(1)).over(conv)
    rows = rows.withColumn("_h", F.when((p > 0) & (n > 1), p * F.log(p) / F.log(n.cast("double"))).otherwise(0.0))
    any_of = [F.max(F.col(c)).alias(c) for c in ("has_thank", "has_greeting", "has_marks", "do_start", "you_start", "all_caps", "is_question", "agrees", "disagrees")]
    lex = [F.max(F.col(f"lexicon_{k}") > 0).alias(f"lexicon_{k}") for k in lexicons or {}]
    base = rows.groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("no_comments"),
        F.max("length").alias("max_len"),
        (F.max_by("length", F.struct("ts", "id")) if compat else F.min("length")).alias("min_len"),
        F.avg("length").alias("avg_len"),
        F.max("toxicity").alias("max_toxicity"),
        F.least(1 + F.sum("_h"), F.lit(1.0)).alias("toxicity_entropy"),
        *any_of,
        *lex,
    )
    mine = own_previous(rows, ["content_tokens", "stop_tokens", "toxicity"])
    gap = F.col("toxicity") - F.col("prev_toxicity")
    overlap = lambda a, b: F.coalesce(F.arrays_overlap(a, b), F.lit(False))
    repeats = mine.groupBy("conversation_id").agg(
        F.max(overlap("content_tokens", "prev_content_tokens")).alias("content_repeat"),
        F.max(overlap("stop_tokens", "prev_stop_tokens")).alias("stop_repeat"),
        F.max(F.coalesce(gap > 0.05, F.lit(False))).alias("toxicity_raise"),
        F.max(gap).alias("max_toxicity_gap"),
        F.avg(gap).alias("mean_toxicity_gap"),
    )
    answers = reply_pairs(rows, ["content_tokens", "stop_tokens", "is_question", "ts"])
    seconds = nearest_second(F.col("ts")) - nearest_second(F.col("to_ts"))
    replies = answers.groupBy("conversation_id").agg(
        F.max(overlap("content_tokens", "to_content_tokens")).alias("content_adoption"),
        F.max(overlap("stop_tokens", "to_stop_tokens")).alias("stop_adoption"),
        F.max(F.col("is_question") & F.col("to_is_question")).alias("question_to_question"),
        F.max(F.col("is_question") & ~F.col("to_is_question")).alias("question_to_non_question"),
        F.max(~F.col("is_question") & F.col("to_is_question")).alias("non_question_to_question"),
        F.max(seconds).alias("max_time_gap"),
    )
    return base.join(repeats, "conversation_id", "left").join(replies, "conversation_id", "left")


def ngram_document_frequency(actions: DataFrame, words: F.Column, above: int) -> DataFrame:
    """(ngram, df) of uni- and bigrams that more than ``above`` conversations have."""
    # words, cut once, are brought together by conversation; its n-grams are made distinct in one row, so that only counts are shuffled by n-gram
    rows = once(actions.select("conversation_id", words.alias("words")).groupBy("conversation_id").agg(F.collect_list("words").alias("lists")), grams=F.array_distinct(F.flatten(F.transform("lists", lambda w: F.concat(w, t.bigrams(w))))))
    return rows.select(F.explode("grams").alias("ngram")).groupBy("ngram").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > above)


def max_normalised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each column over its greatest value; columns whose greatest value is 0 stay."""
    most = rows.agg(*[F.max(c).alias(f"_{c}") for c in columns])
    scaled = {c: F.when(F.col(f"_{c}") != 0, F.col(c) / F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    return rows.join(F.broadcast(most)).withColumns(scaled).drop(*[f"_{c}" for c in columns])  # one row


def user_entropy(values: DataFrame, value: str, start: float = 0.001) -> DataFrame:
    """(conversation_id, entropy): 1 + sum p ln p / ln n over users, each starting from a small value."""
    conv = Window.partitionBy("conversation_id")
    x = values.groupBy("conversation_id", "user_text").agg((F.sum(value) + start).alias("x"))
    p, n = F.col("x") / F.sum("x").over(conv), F.count(F.lit(1)).over(conv)
    term = x.withColumn("_t", F.when(n > 1, p * F.log(p) / F.log(n.cast("double"))).otherwise(F.lit(None)))
    return term.groupBy("conversation_id").agg((1 + F.sum("_t")).alias("entropy"))


def policy_intervention(actions: DataFrame) -> DataFrame:
    """(conversation_id, has_policy_intervention): whether any link of a conversation's comments is to a policy on vandalism or harassment."""
    marks = t.feature_text(F.col("content"))
    links = F.concat(marks["external_link"], marks["wiki_link"])
    named = F.exists(links, lambda x: F.lower(x).rlike("vandal|harass"))
    return actions.groupBy("conversation_id").agg(F.max(F.coalesce(named, F.lit(False))).alias("has_policy_intervention"))


#: Sentiments over the first count as positive, under the second as negative.
POSITIVE, NEGATIVE = 0.5, -0.5


def polarity(actions: DataFrame, score: str = "sentiment", politeness: str | None = None, asks: F.Column | None = None) -> DataFrame:
    """``actions`` with is_positive and is_negative by a sentiment score, and is_polite: a request with a politeness of a half or more."""
    out = actions.withColumns({"is_positive": F.coalesce(F.col(score) > POSITIVE, F.lit(False)), "is_negative": F.coalesce(F.col(score) < NEGATIVE, F.lit(False))})
    return out if politeness is None else out.withColumn("is_polite", F.coalesce(asks & (F.col(politeness) >= 0.5), F.lit(False)))


def any_of(actions: DataFrame, columns: list[str]) -> DataFrame:
    """(conversation_id, has_<x>): whether any comment is ``is_<x>``."""
    return actions.groupBy("conversation_id").agg(*[F.max(c).alias(c.replace("is_", "has_", 1)) for c in columns])


def polarity_changes(actions: DataFrame, score: str = "sentiment") -> DataFrame:
    """How comments differ in polarity from the same user's comment before, and replies from what they answer, by conversation."""
    rows = polarity(actions, score)
    mine = own_previous(rows, ["is_positive", "is_negative", score]).where("prev_is_negative IS NOT NULL")
    now, was = lambda c: F.col(f"is_{c}"), lambda c: F.col(f"prev_is_{c}")
    own = mine.groupBy("conversation_id").agg(
        F.max(now("negative") & ~was("negative")).alias("negative_increase"), F.max(~now("negative") & was("negative")).alias("negative_decrease"),
        F.max(now("positive") & ~was("positive")).alias("positive_increase"), F.max(~now("positive") & was("positive")).alias("positive_decrease"),
        F.max(now("negative") & was("negative")).alias("consecutive_negative"), F.max(F.col(score) - F.col(f"prev_{score}")).alias("max_polarity_gap"),
    )
    answers = reply_pairs(rows, ["is_positive", "is_negative"])
    replies = answers.groupBy("conversation_id").agg(
        F.max("is_negative").alias("has_negative_reply"), F.avg(F.col("is_negative").cast("double")).alias("negative_reply_share"),
        F.max(F.col("is_negative") & F.col("to_is_positive")).alias("negative_to_positive"), F.max(F.col("is_positive") & F.col("to_is_negative")).alias("positive_to_negative"),
    )
    return own.join(replies, "conversation_id", "full")


def noun_features(actions: DataFrame, tokens: str = "tokens", tags: str = "pos") -> DataFrame:
    """(conversation_id, nouns_over_tokens, most_nouns, least_nouns): distinct nouns by supplied part-of-speech tags (NN and its kin),
    over all tokens, and their number by user at most and at least."""
    pairs = F.filter(F.arrays_zip(F.col(tokens).alias("w"), F.col(tags).alias("t")), lambda x: x["t"].startswith("NN"))
    rows = actions.select("conversation_id", "user_text", F.size(tokens).alias("n"), F.transform(pairs, lambda x: x["w"]).alias("nouns"))
    by_user = rows.groupBy("conversation_id", "user_text").agg(F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("nouns"))).alias("nouns"))
    return by_user.groupBy("conversation_id").agg(
        (F.size(F.array_distinct(F.flatten(F.collect_list("nouns")))) / F.nullif(F.sum("n"), F.lit(0))).alias("nouns_over_tokens"),
        F.max(F.size("nouns")).alias("most_nouns"), F.min(F.size("nouns")).alias("least_nouns"),
    )


def question_types(questions: DataFrame, kind: str, kinds: int = 8) -> DataFrame:
    """(conversation_id, question_type0 ..): whether any question is of each kind; the kind is that of the nearest cluster, given from outside."""
    return questions.groupBy("conversation_id").agg(*[F.max(F.coalesce(F.col(kind) == k, F.lit(False))).alias(f"question_type{k}") for k in range(kinds)])


def nearest_kind(distances: F.Column) -> F.Column:
    """The place of the least of an array of distances, from 0; the first of equal ones."""
    return F.array_position(distances, F.array_min(distances)) - 1


def aspect_features(users: DataFrame, aspects: list[str], start: float = 0.001) -> DataFrame:
    """Per conversation: greatest, least, gap and entropy of each aspect over users that are no bots, and has_anon, has_bot, has_blocked.

    ``users``: conversation_id, user, anonymous, bot, blocked and the aspects (null counts as 0).
    """
    conv = Window.partitionBy("conversation_id", "bot")
    x = lambda a: F.coalesce(F.col(a).cast("double"), F.lit(0.0))
    p = lambda a: (x(a) + start) / F.sum(x(a) + start).over(conv)
    n = F.count(F.lit(1)).over(conv)
    term = lambda a: F.when(n > 1, p(a) * F.log(p(a)) / F.log(n.cast("double")))
    rows = users.withColumn("bot", F.coalesce("bot", F.lit(False))).withColumns({f"_{a}": term(a) for a in aspects})
    human = lambda c: F.when(~F.col("bot"), c)
    parts = []
    for a in aspects:
        parts += [F.max(human(x(a))).alias(f"max_{a}"), F.min(human(x(a))).alias(f"min_{a}"), (F.max(human(x(a))) - F.min(human(x(a)))).alias(f"gap_{a}"), (1 + F.sum(human(F.col(f"_{a}")))).alias(f"entropy_{a}")]
    has = [F.max(F.coalesce(F.col(c), F.lit(False))).alias(f"has_{short}") for c, short in (("anonymous", "anon"), ("bot", "bot"), ("blocked", "blocked"))]
    return rows.groupBy("conversation_id").agg(*parts, *has)
