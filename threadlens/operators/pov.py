"""Sentence-level edits between consecutive revisions of a page."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlens.functions.text import fuzzy_match, sentences

_WORD = re.compile("[a-z0-9']+")
#: Pairs in one Arrow batch.
PAIRS = 5000


def with_former(revisions: DataFrame, page: str, order: list[str], column: str) -> DataFrame:
    """``revisions`` with ``former``: the page's text before, null for its first revision."""
    return revisions.withColumn("former", F.lag(column).over(Window.partitionBy(page).orderBy(*order)))


def similar_size(pairs: DataFrame, column: str, most: int = 100) -> DataFrame:
    return pairs.where(F.col("former").isNotNull() & (F.abs(F.length("former") - F.length(column)) < most))


def mentions(pairs: DataFrame, word: str = "POV", every: bool = False, column: str = "comment") -> DataFrame:
    """Edits whose comment has the word as written; null comments have none."""
    return pairs if every else pairs.where(F.coalesce(F.col(column).contains(word), F.lit(False)))


def sentence_changes(pairs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, inserts, deletes, kept) as arrays of distinct sentences."""
    now, was = sentences(F.col(column)), sentences(F.col("former"))
    return pairs.select(
        key, F.array_except(now, was).alias("inserts"), F.array_except(was, now).alias("deletes"), F.array_intersect(was, now).alias("kept")
    )


def fuzzy_pairs(olds: list[str], news: list[str], least: float = 0.6, tokens_least: int = 3) -> Iterator[tuple[int, int]]:
    """Places of the pairs that ``fuzzy_match`` finds, without comparing all of them.

    Sentences that share ``least`` of both sets have one of their rarest tokens in common, so that each is held
    only against those that have one of the few tokens that it may miss and one more.
    """
    words = lambda s: _WORD.findall(s.lower())
    cut = [words(s) for s in olds]
    ours, theirs = {i: set(w) for i, w in enumerate(cut) if len(w) >= tokens_least}, [set(words(s)) for s in news]
    often = Counter(chain.from_iterable(chain(ours.values(), theirs)))

    def rare(found: set[str]) -> list[str]:
        need = next((n for n in range(len(found) + 1) if n / max(len(found), 1) >= least), 0)
        return sorted(found, key=lambda w: (often[w], w))[: len(found) - need + 1]

    having = defaultdict(list)
    for j, found in enumerate(theirs):
        for w in rare(found):
            having[w].append(j)
    for i, found in ours.items():
        for j in set(chain.from_iterable(having.get(w, ()) for w in rare(found))):
            other = theirs[j]
            if min(len(found), len(other)) / max(len(found), len(other)) >= least and len(found & other) / max(len(found), len(other)) >= least and olds[i] != news[j]:
                yield i, j


def revised_sentences(changes: DataFrame, key: str) -> DataFrame:
    """(key, old, new): deleted and inserted sentences of one edit that match fuzzily."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, olds, news, kind = [], [], [], batch.schema.field(0).type
            for k, deletes, inserts in zip(batch[0], batch[1], batch[2], strict=True):
                deletes, inserts = deletes.as_py() or [], inserts.as_py() or []
                for i, j in fuzzy_pairs(deletes, inserts):
                    keys.append(k)
                    olds.append(deletes[i])
                    news.append(inserts[j])
                    if len(keys) == PAIRS:
                        yield pa.record_batch([pa.array(keys, kind), pa.array(olds, pa.string()), pa.array(news, pa.string())], [key, "old", "new"])
                        keys, olds, news = [], [], []
            yield pa.record_batch([pa.array(keys, kind), pa.array(olds, pa.string()), pa.array(news, pa.string())], [key, "old", "new"])

    return changes.where((F.size("deletes") > 0) & (F.size("inserts") > 0)).select(key, "deletes", "inserts").mapInArrow(run, f"`{key}` {changes.schema[key].dataType.simpleString()}, old string, new string")


def context(sentence_rows: DataFrame, key: str, place: str, changed: str, reach: int = 3, compat: bool = False) -> DataFrame:
    """Unchanged sentences within ``reach`` of a changed one. ``compat`` leaves out the text's last sentence."""
    around = Window.partitionBy(key).orderBy(place).rowsBetween(-reach, reach)
    rows = sentence_rows.withColumn("_near", F.max(F.col(changed).cast("int")).over(around)).where(F.col("_near") == 1).where(~F.col(changed))
    if compat:
        last = sentence_rows.groupBy(key).agg(F.max(place).alias("_last"))
        rows = rows.join(last, key).where(F.col(place) < F.col("_last")).drop("_last")
    return rows.drop("_near")


def sentence_origin(revisions: DataFrame, page: str, order: str, column: str) -> DataFrame:
    """(page, sentence, first revision of each unbroken presence, last): who a sentence is due to.

    A sentence that goes and comes back starts anew. One sort by sentence finds the first and last revisions of each
    presence; they are paired in its order, so that no table of all sentences is built in memory beside it.
    """
    numbered = revisions.withColumn("_n", F.row_number().over(Window.partitionBy(page).orderBy(order)))
    present = numbered.select(page, order, "_n", F.explode(F.array_distinct(sentences(F.col(column)))).alias("sentence"))
    rows, n = Window.partitionBy(page, "sentence").orderBy("_n"), F.col("_n")
    begins, ends = F.coalesce(F.lag("_n").over(rows) < n - 1, F.lit(True)), F.coalesce(F.lead("_n").over(rows) > n + 1, F.lit(True))
    edges = present.withColumn("_begins", begins).withColumn("_ends", ends).where("_begins OR _ends")
    last = F.when(F.col("_ends"), F.col(order)).otherwise(F.lead(order).over(rows))
    return edges.withColumn("last_rev", last).where("_begins").select(page, "sentence", F.col(order).alias("first_rev"), "last_rev")


def fuzzy_revisions(rejected: DataFrame, improved: DataFrame, key: str = "rev_id", column: str = "sentence") -> DataFrame:
    """(key, old, new, n): rejected and improved sentences of one revision that match, each pair of texts once; n pairs of rows have it.

    Copies are counted before the join, which costs the pairs of different sentences only.
    """
    once = lambda df, name: df.groupBy(key, F.col(column).alias(name)).agg(F.count(F.lit(1)).alias(f"_{name}"))
    both = once(rejected, "old").join(once(improved, "new"), key).where(fuzzy_match(F.col("old"), F.col("new")))
    return both.select(key, "old", "new", (F.col("_old") * F.col("_new")).alias("n"))


def author_overlap(first: DataFrame, second: DataFrame, author: str, least: int = 20) -> DataFrame:
    """One row (first, second, both): authors with ``least`` revisions or more in each table, and in both."""
    often = lambda df: df.groupBy(author).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(author)
    a, b = often(first).withColumn("a", F.lit(1)), often(second).withColumn("b", F.lit(1))
    return a.join(b, author, "full").agg(F.count("a").alias("first"), F.count("b").alias("second"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("both"))
