"""Scorers and flags: a protocol for outside models, and plain defaults that need none."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from threadlens.functions.once import once
from threadlens.functions.text import tokens


class Scorer(Protocol):
    """Anything that turns a batch of texts into a table of scores, one column for each model."""

    models: tuple[str, ...]

    def score_batch(self, texts: pd.Series) -> pd.DataFrame: ...


class WordScorer:
    """Share of a text's words that a word list has, at most 1: deterministic, for tests and dry runs."""

    def __init__(self, lists: dict[str, set[str]], gain: float = 5.0):
        self.lists, self.gain, self.models = lists, gain, tuple(lists)

    def score_batch(self, texts: pd.Series) -> pd.DataFrame:
        words = texts.fillna("").str.lower().str.findall(r"[a-z']+")
        share = lambda w, has: min(1.0, self.gain * sum(x in has for x in w) / len(w)) if w else 0.0
        return pd.DataFrame({m: [share(w, has) for w in words] for m, has in self.lists.items()}, index=texts.index)


def score(df: DataFrame, text: str, scorer: Scorer) -> DataFrame:
    """``df`` with a column for each model. Empty texts get 0 without being sent to the scorer."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", {m} double" for m in scorer.models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            full = batch[text].fillna("") != ""
            out = batch.copy()
            for m in scorer.models:
                out[m] = 0.0
            if full.any():
                out.loc[full, list(scorer.models)] = scorer.score_batch(batch.loc[full, text])[list(scorer.models)].to_numpy()
            yield out

    return df.mapInPandas(run, schema)


def is_toxic(value: Column, least: float = 0.5) -> Column:
    return F.coalesce(value >= least, F.lit(False))


def first_finding(findings: Column) -> Column:
    """Type of the first finding that is likely or very likely, else null."""
    likely = F.filter(findings, lambda f: f["likelihood"].isin("LIKELY", "VERY_LIKELY"))
    return F.get(likely, 0)["infoType"]["name"]


# Shapes of personal data that a comment is flagged for.
FLAGGED = {
    "EMAIL_ADDRESS": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z]+",
    "IP_ADDRESS": r"\b[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}\b",
    "PHONE_NUMBER": r"\+[0-9]+ \([0-9]+\) [0-9-]+",
    "US_SOCIAL_SECURITY_NUMBER": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "DATE_OF_BIRTH": r"(born|birth|DOB)[ :a-z]{0,12}[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{4}",
    "IBAN_CODE": r"\b[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){3,7}\b",
    "MAC_ADDRESS": r"\b([0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b",
}


def personal_data(text: Column) -> Column:
    """The first kind of personal data whose shape a text holds, else null."""
    kind = None
    for name, pattern in FLAGGED.items():
        kind = F.when(text.rlike(pattern), name) if kind is None else kind.when(text.rlike(pattern), name)
    return kind


def flagged(df: DataFrame, text: str, toxicity: Column) -> DataFrame:
    """Rows that are toxic or hold personal data, with both findings."""
    marked = df.withColumns({"pii": personal_data(F.col(text)), "toxic": is_toxic(toxicity)})
    return marked.where("toxic OR pii IS NOT NULL")


def categories(df: DataFrame, text: str, lists: dict[str, list[str]], least_tokens: int = 20, top: int = 3) -> DataFrame:
    """``df`` with ``categories``: up to ``top`` (category, confidence) of a text, by the share of its words that each keyword list has.

    A stand-in for an outside classifier of page texts. Texts of fewer than ``least_tokens`` words are sent
    twice over, as the outside one asks for; shares do not change by it.
    """
    cut = once(df, _t=tokens(F.col(text)))
    words = F.when(F.size("_t") < least_tokens, F.concat("_t", "_t")).otherwise(F.col("_t"))
    listed = {w for has in lists.values() for w in has}
    held = once(cut, _n=F.size(words), _w=F.filter(words, lambda w: w.isin(*listed))).drop("_t")  # the lists go over the few words that any of them has
    share = lambda has: F.size(F.filter("_w", lambda w: w.isin(*has))) / F.greatest(F.col("_n"), F.lit(1))
    found = F.array(*[F.struct(F.lit(c).alias("category"), F.round(share(has), 6).alias("confidence")) for c, has in lists.items()])
    return once(held, categories=top_categories(F.filter(found, lambda x: x["confidence"] > 0), top)).drop("_n", "_w")


def top_categories(found: Column, top: int = 3) -> Column:
    """The ``top`` of (category, confidence) by confidence, then name."""
    ranked = F.array_sort(F.transform(found, lambda x: F.struct((-x["confidence"]).alias("c"), x["category"].alias("category"), x["confidence"].alias("confidence"))))
    return F.transform(F.slice(ranked, 1, top), lambda x: F.struct(x["category"].alias("category"), x["confidence"].alias("confidence")))


class RateLimited:
    """A scorer that waits, so that no partition sends more than ``per_second`` batches, and tries a batch again after an error."""

    def __init__(self, scorer: Scorer, per_second: float, tries: int = 3, wait: Callable[[float], None] = time.sleep):
        self.scorer, self.models, self.per_second, self.tries, self.wait = scorer, scorer.models, per_second, tries, wait
        self.last = None

    def score_batch(self, texts: pd.Series) -> pd.DataFrame:
        for attempt in range(self.tries):
            if self.last is not None:
                self.wait(max(0.0, self.last + 1 / self.per_second - time.monotonic()))
            self.last = time.monotonic()
            try:
                return self.scorer.score_batch(texts)
            except Exception:
                if attempt == self.tries - 1:
                    raise
                self.wait(2.0**attempt / self.per_second)
        raise AssertionError("no try was made")


def looked_up(df: DataFrame, key: str, fetch: Callable[[list], dict], columns: str, size: int = 50) -> DataFrame:
    """``df`` with ``columns`` (a schema) that ``fetch`` gives for each distinct key, ``size`` keys a call, null where it gives none.

    Each distinct key is asked for once; a failing call raises and its task is tried again by Spark.
    """
    fields = StructType.fromDDL(columns).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), size):
                keys = batch[key].iloc[a : a + size].tolist()
                got = fetch(keys)
                yield pd.DataFrame([{key: k, **{f: got.get(k, {}).get(f) for f in fields}} for k in keys], columns=[key, *fields])

    kind = df.schema[key].dataType.simpleString()
    answers = df.select(key).where(F.col(key).isNotNull()).distinct().mapInPandas(run, f"`{key}` {kind}, {columns}")
    return df.join(answers, key, "left")


def refetched(df: DataFrame, text: str, key: str, fetch: Callable[[list], dict]) -> DataFrame:
    """``df`` with empty texts asked for again by key; those that ``fetch`` has no text for stay empty."""
    empty = df.where(F.coalesce(F.col(text), F.lit("")) == "")
    found = looked_up(empty.select(key).distinct(), key, lambda keys: {k: {"_again": v} for k, v in fetch(keys).items()}, "_again string")
    return df.join(found, key, "left").withColumn(text, F.when(F.coalesce(F.col(text), F.lit("")) == "", F.coalesce("_again", F.col(text))).otherwise(F.col(text))).drop("_again")
