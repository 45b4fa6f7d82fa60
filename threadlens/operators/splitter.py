"""Sentence splitting learnt from unmarked text (Kiss and Strunk's statistics): which words are abbreviations, which words
begin sentences, and which follow numbers. All counts are over whole tables and stay tables; nothing goes through the driver."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.once import once

# The thresholds of the published method.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
NUMBER = "##"
_SPACE = "[ \\t\\n\\r\\f]+"
_CLOSING = "[\"'”’»)\\]]+$"


#: What a token may end with that ends a sentence; most tokens are told by it without a look at their core.
_MAY_END = "[.!?][\"'”’»)\\]]*$"


def _words(text: str) -> Column:
    """Tokens between white space; a null text has none."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), _SPACE), lambda x: x != "")


def _core(token: Column) -> Column:
    stripped = F.regexp_replace(F.regexp_replace(token, r"^[^\p{L}\p{N}]+", ""), _CLOSING, "")
    return F.when(token.rlike(r"^\p{L}+$"), token).otherwise(stripped)


def _word(core: Column) -> Column:
    number = F.when(core.rlike(r"^[\p{N}.,]*\p{N}[\p{N}.,]*$"), F.lit(NUMBER))
    return F.when(core.rlike(r"^\p{L}+$"), F.lower(core)).otherwise(number.otherwise(F.lower(F.regexp_replace(core, r"[.!?…,;:]+$", ""))))


def _read(tokens: DataFrame) -> DataFrame:
    """``tokens`` with (word, ends) of each ``token``. It costs several patterns, so give each different token once."""
    core = tokens.withColumn("core", _core(F.col("token")))
    ends = F.when(F.col("core").rlike(r"[!?]$"), "stop").when(F.col("core").rlike(r"(^|[^.])\.$"), "period")
    return once(core, word=_word(F.col("core")), ends=ends).drop("core")


def _read_next(pairs: DataFrame) -> DataFrame:
    """``pairs`` with (word, ends, next, next_upper) of each (``token``, ``after``), those alone whose token ends with a stop."""
    after = _read(pairs).where(F.col("ends").isNotNull()).withColumn("_after", _core(F.col("after")))
    return once(after, next=_word(F.col("_after")), next_upper=F.coalesce(F.col("_after").rlike(r"^\p{Lu}"), F.lit(False))).drop("_after")


def _ended(texts: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """(columns kept, token, after, pos): each token that may end a sentence, the token after it, and its place."""
    rows = texts.select(*keep, F.explode(F.array(_words(text))).alias("w")).where(F.size("w") > 1)  # exploded, so that it is cut once
    n = F.size("w") - 1
    # zipped with itself moved by one: a lambda that looked at the whole array would work it out again for each word
    zipped = F.arrays_zip(F.slice("w", F.lit(1), n).alias("token"), F.slice("w", F.lit(2), n).alias("after"), F.sequence(F.lit(0), n - 1).alias("pos"))
    names = [c for c in rows.columns if c != "w"]
    return rows.select(*names, F.explode(F.filter(zipped, lambda x: x["token"].rlike(_MAY_END))).alias("x")).select(*names, "x.token", "x.after", "x.pos")


def _log(count: Column, chance: Column) -> Column:
    """count * ln(chance), 0 for no count."""
    return F.when(count > 0, count * F.ln(chance)).otherwise(0.0)


def likelihood(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Dunning's ratio that b follows a more or less often than it occurs: a and b times, ab together, among n."""
    a, b, ab, n = (x.cast("double") for x in (a, b, ab, n))
    p, p1, p2 = b / n, ab / a, (b - ab) / F.greatest(n - a, F.lit(1.0))
    rest = n - a - b + ab
    same = _log(ab, p) + _log(a - ab, 1 - p) + _log(b - ab, p) + _log(rest, 1 - p)
    other = _log(ab, p1) + _log(a - ab, 1 - p1) + _log(b - ab, p2) + _log(rest, 1 - p2)
    return -2 * (same - other)


class Splitter:
    """What a table of texts says about its sentences.

    ``scores`` (word, n_period, n_plain, score) has every word of letters that a period follows somewhere;
    ``abbreviations``, ``starters`` and ``followers`` (of numbers) have the words over the thresholds.
    Null and empty texts say nothing. Different tokens, and pairs of a stop and what comes after it, are counted first,
    in the tasks before rows move; patterns look at each of them once. With a ``folder`` that driver and executors
    share, each table is written there when it is first asked for, so that no text is counted again for the next
    one, and the planner knows their sizes; without one they are plans.
    """

    def __init__(self, texts: DataFrame, text: str = "text", folder: str | None = None):
        self.texts, self.text, self.folder = texts, text, folder

    def _kept(self, name: str, df: DataFrame) -> DataFrame:
        if self.folder is None:
            return df
        df.write.parquet(f"{self.folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    @cached_property
    def words(self) -> DataFrame:
        """(word, n_period, n): how often each word occurs, and with a period."""
        tokens = _read(self.texts.select(F.explode(_words(self.text)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")))
        period = F.sum(F.when(F.col("ends") == "period", F.col("n")).otherwise(F.lit(0)))
        return self._kept("words", tokens.groupBy("word").agg(period.alias("n_period"), F.sum("n").alias("n")))

    @cached_property
    def _every(self) -> DataFrame:
        return self._kept("every", self.words.agg(F.sum("n").alias("total"), F.sum("n_period").alias("periods")))

    @cached_property
    def scores(self) -> DataFrame:
        kind = self.words.where(F.col("word").rlike(r"^(\p{L}+\.)*\p{L}+$") & (F.col("n_period") > 0)).crossJoin(F.broadcast(self._every))  # one row
        plain = F.col("n") - F.col("n_period")
        p = F.col("periods") / F.col("total")
        ratio = -2 * (_log(F.col("n_period").cast("double"), p) + _log(plain.cast("double"), 1 - p) - _log(F.col("n_period").cast("double"), F.lit(0.99)) - _log(plain.cast("double"), F.lit(0.01)))
        letters = F.length(F.replace("word", F.lit("."), F.lit("")))
        inner = F.length("word") - letters + 1
        score = ratio * F.exp(-letters) * inner * F.pow(letters.cast("double"), -plain.cast("double"))
        return kind.select("word", "n_period", plain.alias("n_plain"), score.alias("score"))

    @cached_property
    def abbreviations(self) -> DataFrame:
        return self._kept("abbreviations", self.scores.where(F.col("score") >= ABBREVIATION).select("word"))

    @cached_property
    def _after(self) -> DataFrame:
        """(word, next, ab, short): how often a word with a period has another after it."""
        pairs = _ended(self.texts, self.text, []).groupBy("token", "after").agg(F.count(F.lit(1)).alias("n"))
        ended = _read_next(pairs).where(F.col("ends") == "period").groupBy("word", "next").agg(F.sum("n").alias("ab"))
        return self._kept("after", ended.join(self.abbreviations.select("word", F.lit(True).alias("short")), "word", "left"))

    @cached_property
    def starters(self) -> DataFrame:
        breaks = self._after.where(F.col("short").isNull() & (F.col("word") != NUMBER) & (F.length("word") > 1))
        return self._kept("starters", self._follow(breaks, STARTER))

    @cached_property
    def followers(self) -> DataFrame:
        return self._kept("followers", self._follow(self._after.where(F.col("word") == NUMBER), COLLOCATION))

    def _follow(self, pairs: DataFrame, least: float) -> DataFrame:
        """(word, score) of words that follow a break, or a number, more often than they occur."""
        after = pairs.groupBy("next").agg(F.sum("ab").alias("ab"))
        counts = self.words.select(F.col("word").alias("next"), F.col("n").alias("b"))
        one = after.agg(F.sum("ab").alias("a")).crossJoin(self._every)  # one row
        both = after.join(counts, "next").crossJoin(F.broadcast(one))
        score = likelihood(F.col("a"), F.col("b"), F.col("ab"), F.col("total"))
        often = F.col("ab") * F.col("total") > F.col("b") * F.col("a")
        return both.where(often & F.col("next").rlike(r"^\p{L}")).select(F.col("next").alias("word"), score.alias("score")).where(F.col("score") >= least)

    def split(self, texts: DataFrame, id_col: str, text: str = "text") -> DataFrame:
        """(id_col, sentences) of each row: white space is one space; a null or empty text has no sentence.

        A word that ends with ``!`` or ``?`` ends a sentence, as does one with a period, but for an
        abbreviation or a single letter, unless a capital that begins a usual first word follows, and a number
        that a small letter or a usual follower of numbers follows. Rows that are alike are split alike.
        """
        key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h")).alias("key")
        ends = _ended(texts, text, [key])
        kinds = _read_next(ends)
        mark = lambda df, name, column: df.select(F.col("word").alias(column), F.lit(True).alias(name))
        known = kinds.join(mark(self.abbreviations, "short", "word"), "word", "left").join(mark(self.starters, "starts", "next"), "next", "left").join(mark(self.followers, "follows", "next"), "next", "left")
        is_short = F.col("short").isNotNull() | ((F.length("word") == 1) & F.col("word").rlike(r"\p{L}"))
        cut = (
            F.when(F.col("ends") == "stop", True).when(F.col("word") == NUMBER, F.col("next_upper") & F.col("follows").isNull())
            .when(is_short, F.col("next_upper") & F.col("starts").isNotNull()).otherwise(True)
        )
        cuts = known.where(cut).groupBy("key").agg(F.sort_array(F.collect_set("pos")).alias("cuts"))
        rows = texts.select(F.col(id_col), key, _words(text).alias("words")).join(cuts, "key", "left")
        edges = F.concat(F.array(F.lit(-1)), F.coalesce("cuts", F.array().cast("array<int>")), F.array(F.size("words") - 1))
        spans = F.transform(F.sequence(F.lit(1), F.size("edges") - 1), lambda i: F.array_join(F.slice("words", F.get("edges", i - 1) + 2, F.get("edges", i) - F.get("edges", i - 1)), " "))
        return rows.withColumn("edges", edges).select(id_col, F.when(F.size("words") > 0, spans).otherwise(F.array().cast("array<string>")).alias("sentences"))


