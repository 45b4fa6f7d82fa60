"""Annotator labels: majorities, weighted opinions, agreement, and thresholds of a score against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.functions.stats import running_sums


def majority(labels: DataFrame, unit: str, label: str, strict: bool = False) -> DataFrame:
    """(unit, n, mean, positive): the mean of 0/1 labels is a half or more (``strict``: more). Negative labels (not sure) are left out."""
    known = labels.where(F.col(label) >= 0).groupBy(unit).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("mean"))
    return known.withColumn("positive", F.col("mean") > 0.5 if strict else F.col("mean") >= 0.5)


def label_counts(labels: DataFrame, unit: str, columns: dict[str, Column]) -> DataFrame:
    """One row a unit with the count of each condition (0 where none holds)."""
    return labels.groupBy(unit).agg(*[F.count(F.when(c, 1)).alias(name) for name, c in columns.items()])


def weighted_opinion(counts: DataFrame, weights: dict[str, int]) -> Column:
    """sum(weight * count) / sum(count) of count columns; null where all are 0."""
    total = sum((F.col(c) for c in weights), F.lit(0))
    return sum((F.lit(w) * F.col(c) for c, w in weights.items()), F.lit(0)) / F.when(total != 0, total)


def pairwise_agreement(labels: DataFrame, unit: str, label: str) -> DataFrame:
    """(unit, agreement): sum n_c^2 / (sum n_c)^2 over the label's values."""
    n = labels.groupBy(unit, label).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(unit).agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("agreement"))


def coincidences(labels: DataFrame, unit: str, label: str) -> DataFrame:
    """(c, k, o): coincidence matrix of all ordered label pairs within a unit, each unit weighing 1 / (labels - 1).

    From counts of labels in a unit, so a unit with many labels makes a row for each pair of values only.
    """
    n = labels.where(F.col(label).isNotNull()).groupBy(unit, label).agg(F.count(F.lit(1)).alias("n"))
    m = F.sum("n").over(Window.partitionBy(unit))
    n = n.withColumn("m", m).where("m > 1")
    a, b = n.select(unit, F.col(label).alias("c"), F.col("n").alias("nc"), "m"), n.select(unit, F.col(label).alias("k"), F.col("n").alias("nk"))
    pairs = a.join(b, unit).withColumn("w", F.when(F.col("c") == F.col("k"), F.col("nc") * (F.col("nc") - 1)).otherwise(F.col("nc") * F.col("nk")) / (F.col("m") - 1))
    return pairs.groupBy("c", "k").agg(F.sum("w").alias("o"))


def krippendorff_alpha(labels: DataFrame, unit: str, label: str, interval: bool = False) -> DataFrame:
    """One row (alpha): 1 - observed / expected disagreement, nominal or squared differences."""
    o = coincidences(labels, unit, label)
    apart = (F.col("c") - F.col("k")) * (F.col("c") - F.col("k")) if interval else F.when(F.col("c") == F.col("k"), 0).otherwise(1)
    margin = o.groupBy("c").agg(F.sum("o").alias("n"))
    n, c = F.col("n"), F.col("c")
    # the sum over all pairs of label values, from single sums
    pairs = 2 * (F.sum(n) * F.sum(n * c * c) - F.sum(n * c) * F.sum(n * c)) if interval else F.sum(n) * F.sum(n) - F.sum(n * n)
    expected = margin.agg(pairs.alias("e"))
    seen = o.agg(F.sum(F.col("o") * apart).alias("d"), F.sum("o").alias("total"))
    return seen.join(expected).select((1 - (F.col("total") - 1) * F.col("d") / F.when(F.col("e") != 0, F.col("e"))).alias("alpha"))


def at_thresholds(scored: DataFrame, score: str, truth: Column, thresholds: list[float]) -> DataFrame:
    """(threshold, predicted, hits, precision, recall) in one pass over the rows."""
    sums = [F.count(F.when(truth, 1)).alias("positives")]
    for i, t in enumerate(thresholds):
        over = F.col(score) >= t
        sums += [F.count(F.when(over, 1)).alias(f"p{i}"), F.count(F.when(over & truth, 1)).alias(f"h{i}")]
    one = scored.agg(*sums)
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"p{i}").alias("predicted"), F.col(f"h{i}").alias("hits")) for i, t in enumerate(thresholds)]))
    out = one.select("positives", rows.alias("r")).select("positives", "r.*")
    share = lambda a, b: F.round(F.col(a) / F.when(F.col(b) != 0, F.col(b)), 6)
    return out.select("threshold", "predicted", "hits", share("hits", "predicted").alias("precision"), share("hits", "positives").alias("recall"))


def break_even(scored: DataFrame, score: str, truth: Column) -> DataFrame:
    """One row (threshold, precision, recall): where precision and recall are closest, from running counts over distinct scores."""
    per = scored.groupBy(F.col(score).alias("threshold")).agg(F.count(F.when(truth, 1)).alias("hits"), F.count(F.lit(1)).alias("n"))
    run = running_sums(per, "threshold", ["hits", "n"], descending=True).select("threshold", F.col("hits_to").alias("hits"), F.col("n_to").alias("n"))
    run = run.join(F.broadcast(per.agg(F.sum("hits").alias("all"))))  # one row
    rates = run.select("threshold", (F.col("hits") / F.col("n")).alias("precision"), (F.col("hits") / F.when(F.col("all") > 0, F.col("all"))).alias("recall"))
    return rates.orderBy(F.abs(F.col("precision") - F.col("recall")), F.desc("threshold")).limit(1)


def reliability_matrix(labels: DataFrame, unit: str, coder: str, label: str, coders: list[str]) -> DataFrame:
    """One row a unit with a column for each coder: the label they gave, null where they gave none."""
    return labels.groupBy(unit).agg(*[F.min(F.when(F.col(coder) == c, F.col(label))).alias(c) for c in coders])


def label_members(units: DataFrame, conversations: DataFrame, unit: str, members: str) -> DataFrame:
    """(unit, conversation_id): the conversations that hold an action of a unit. ``units`` lists action ids in the array
    column ``members``; ``conversations`` has (conversation_id, id)."""
    named = units.select(unit, F.explode(members).alias("id")).distinct()
    return named.join(conversations.select("id", "conversation_id"), "id").select(unit, "conversation_id").distinct()


def with_matched(rows: DataFrame, matched: str, key: str) -> DataFrame:
    """Rows whose matched counterpart is present as well."""
    there = rows.select(F.col(key).alias("_there")).distinct()
    return rows.join(there, F.col(matched) == F.col("_there"), "left_semi")


def pair_accuracy(labels: DataFrame, truth: DataFrame, unit: str, label: str, page: str) -> DataFrame:
    """(page, accuracy): the share of a page's units whose crowd label, a mean above a half, is the true one.

    ``labels``: (unit, label of 0 or 1); ``truth``: (unit, page, bad: 0 or 1).
    """
    said = majority(labels, unit, label, strict=True).select(unit, F.col("positive").cast("int").alias("said"))
    right = truth.join(said, unit).withColumn("right", (F.col("said") == F.col("bad")).cast("double"))
    return right.groupBy(page).agg(F.avg("right").alias("accuracy"))


def cross_counts(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """One row (a, b, both, only_a) of counts."""
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return rows.agg(count(a, "a"), count(b, "b"), count(a & b, "both"), count(a & ~b, "only_a"))


def subsample(labels: DataFrame, unit: str, key: str, n: int = 5, seed: str = "0") -> DataFrame:
    """``n`` labels of each unit that has more, all of the others; drawn by a digest."""
    order = Window.partitionBy(unit).orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed))), key)
    return labels.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")
