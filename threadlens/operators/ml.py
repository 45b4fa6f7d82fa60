"""Classifiers over conversation features and text."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import CountVectorizer, MaxAbsScaler, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.functions import text as t


def _bare(model: PipelineModel) -> PipelineModel:
    """The model without its training summary: that holds the training table, which tasks neither need nor can always be sent."""
    last = model.stages[-1]._java_obj
    last.setSummary(SparkSession.getActiveSession()._jvm.scala.Option.empty())
    return model


def fold_of(pair: str, folds: int) -> Column:
    """The fold of a pair, by a digest: every row of a pair is in one."""
    return F.conv(F.substring(F.md5(F.col(pair).cast("string")), 1, 8), 16, 10).cast("long") % folds


def fold_counts(rows: DataFrame, label: str, pair: str, folds: int = 5) -> DataFrame:
    """(fold, n, positives, trained, baseline): each fold's rows, whether the rest has both classes to train on, and how often
    the rest's more frequent class (of equal ones, the positive) is right in the fold."""
    per = rows.groupBy(fold_of(pair, folds).alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("positives"))
    every = per.agg(F.sum("n").alias("all_n"), F.sum("positives").alias("all_positives"))  # one row
    rest, up = F.col("all_n") - F.col("n"), F.col("all_positives") - F.col("positives")
    right = F.when(2 * up >= rest, F.col("positives")).otherwise(F.col("n") - F.col("positives"))
    return per.crossJoin(F.broadcast(every)).select("fold", "n", "positives", ((up > 0) & (up < rest)).alias("trained"), (right / F.col("n")).alias("baseline"))


class LeftOut(NamedTuple):
    """Accuracy with its standard error over the rows tested, and the rows of folds that had a single class to train on."""

    accuracy: float
    error: float
    tested: int
    skipped: int


def leave_pairs_out(rows: DataFrame, features: list[str], label: str, pair: str, folds: int = 5, c: float = 0.02, iterations: int = 100) -> LeftOut:
    """Accuracy of a linear SVM over folds of whole pairs, chosen by a digest of the pair. The rows of a fold whose rest
    has a single class can't be tested; ``skipped`` says how many they are, and they are no part of the accuracy."""
    data = VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep").transform(rows.fillna(0, features)).withColumn("_fold", fold_of(pair, folds)).persist()
    right, n, skipped = 0, 0, 0
    for r in sorted(fold_counts(rows, label, pair, folds).collect(), key=lambda r: r.fold):
        if not r.trained:
            skipped += r.n
            continue
        svm = _bare(Pipeline(stages=[MaxAbsScaler(inputCol="raw", outputCol="features"), LinearSVC(labelCol=label, regParam=c, maxIter=iterations)]).fit(data.where(F.col("_fold") != r.fold)))
        said = svm.transform(data.where(F.col("_fold") == r.fold))
        right, n = right + said.where(F.col("prediction") == F.col(label)).count(), n + r.n
    data.unpersist()
    p = right / n if n else math.nan
    return LeftOut(p, math.sqrt(p * (1 - p) / n) if n else math.nan, n, skipped)


def text_classifier(train: DataFrame, text: str, label: str, vocabulary: int = 20_000, least_df: int = 2) -> PipelineModel:
    """Bag of words into a logistic regression; the vocabulary is bounded."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"[a-z0-9']+", gaps=False),
        CountVectorizer(inputCol="_tokens", outputCol="features", vocabSize=vocabulary, minDF=least_df, binary=True),
        LogisticRegression(labelCol=label, maxIter=30, regParam=0.01),
    ]
    return _bare(Pipeline(stages=stages).fit(train))


def quality(model: PipelineModel, rows: DataFrame, label: str) -> dict[str, float]:
    """Accuracy, area under the curve, and the accuracy of always saying the more frequent class."""
    said = model.transform(rows)
    hit = said.agg(F.avg((F.col("prediction") == F.col(label)).cast("double")), F.avg(F.col(label).cast("double"))).first()
    return {"accuracy": hit[0], "auc": BinaryClassificationEvaluator(labelCol=label).evaluate(said), "baseline": max(hit[1], 1 - hit[1])}


def top_coefficients(names: list[str], coefficients: list[float], n: int = 10) -> tuple[list[tuple[str, float]], list[tuple[str, float]]]:
    """The ``n`` greatest and the ``n`` least weights."""
    ranked = sorted(zip(names, coefficients, strict=True), key=lambda x: (-x[1], x[0]))
    return ranked[:n], ranked[::-1][:n]


def grid_search(rows: DataFrame, features: list[str], label: str, group: str, grid: list[float], folds: int = 5) -> tuple[float, dict[float, float]]:
    """(best, accuracy by value): the regularisation of a logistic regression with the best accuracy over folds of whole groups, chosen by a hash."""
    fold = F.pmod(F.xxhash64(group), F.lit(folds))
    data = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(rows.fillna(0, features)).withColumn("_fold", fold).persist()
    right, n = dict.fromkeys(grid, 0), 0
    for k in range(folds):
        train, test = data.where(F.col("_fold") != k), data.where(F.col("_fold") == k)
        if test.isEmpty() or train.select(label).distinct().count() < 2:
            continue
        n += test.count()
        for c in grid:
            model = _bare(Pipeline(stages=[LogisticRegression(labelCol=label, regParam=c, maxIter=30)]).fit(train))
            right[c] += model.transform(test).where(F.col("prediction") == F.col(label)).count()
    data.unpersist()
    accuracy = {c: right[c] / n if n else math.nan for c in grid}
    return max(grid, key=lambda c: (accuracy[c], -grid.index(c))), accuracy


def politeness_scorer(requests: DataFrame, text: str, score: str, vocabulary: int = 20_000) -> PipelineModel:
    """A model of polite requests from scored ones (polite: a score above 0): words, word pairs and politeness strategies into a logistic
    regression. ``politeness_scores`` applies it."""
    stages = [
        CountVectorizer(inputCol="_grams", outputCol="_words", vocabSize=vocabulary, minDF=2, binary=True),
        VectorAssembler(inputCols=["_words", "_strategies"], outputCol="features"),
        LogisticRegression(labelCol="_polite", maxIter=30, regParam=0.02),
    ]
    return _bare(Pipeline(stages=stages).fit(_politeness_columns(requests, text).withColumn("_polite", (F.col(score) > 0).cast("double"))))


def _politeness_columns(rows: DataFrame, text: str) -> DataFrame:
    words = t.tokens(F.col(text))
    strategies = F.array(*[c.cast("double") for c in t.politeness(F.col(text)).values()])
    return rows.withColumns({"_grams": F.array_union(words, t.bigrams(words)), "_strategies": array_to_vector(strategies)})


def politeness_scores(model: PipelineModel, rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``politeness``: the chance that a text is polite."""
    said = model.transform(_politeness_columns(rows, text))
    return said.select(*rows.columns, vector_to_array("probability")[1].alias("politeness"))
