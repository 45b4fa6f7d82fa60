"""Reproducible samples: strata by score zone, ordered by a keyed digest instead of a random number."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.functions.stats import t_interval


def draw_key(key: str, seed: str) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def random_sample(rows: DataFrame, key: str, n: int, seed: str = "s") -> DataFrame:
    """``n`` rows, those with the least digests."""
    return rows.orderBy(draw_key(key, seed), key).limit(n)


def zone(score: str, zones: int) -> Column:
    """Which of ``zones`` half-open zones [i/zones, (i+1)/zones) a score lies in; a score of 1 is in none."""
    return F.when((F.col(score) >= 0) & (F.col(score) < 1), F.floor(F.col(score) * zones).cast("long"))


def stratified_sample(rows: DataFrame, key: str, score: str, zones: int, per_zone: int, random: int = 0, seed: str = "s") -> DataFrame:
    """``per_zone`` rows of each zone with the column ``zone``, and ``random`` more of all rows with zone -1."""
    in_zone = Window.partitionBy("zone").orderBy(draw_key(key, seed), key)
    strata = rows.withColumn("zone", zone(score, zones)).where("zone IS NOT NULL")
    strata = strata.withColumn("_n", F.row_number().over(in_zone)).where(F.col("_n") <= per_zone).drop("_n")
    if random:
        strata = strata.unionByName(random_sample(rows, key, random, seed + "r").withColumn("zone", F.lit(-1).cast("long")))
    return strata


def poisson_steps() -> list[float]:
    """The cumulative chances of 0, 1, 2, ... at a mean of 1, until the rest is below what a double holds."""
    steps, p, total = [], math.exp(-1), 0.0
    for k in range(1, 20):
        total += p
        steps.append(total)
        p /= k
    return steps


def bootstrap_means(rows: DataFrame, key: str, value: str, repetitions: int, seed: str = "b") -> DataFrame:
    """(rep, mean) of ``repetitions`` resamples in which each row has a Poisson(1) count, drawn by a digest.

    Poisson counts resample with replacement without a pass over row numbers.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), "rep", F.lit(seed))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    count = sum((F.when(u >= c, 1).otherwise(0) for c in poisson_steps()), F.lit(0))
    spread = rows.where(F.col(value).isNotNull()).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repetitions)))).withColumn("_k", count)
    return spread.groupBy("rep").agg((F.sum(F.col("_k") * F.col(value)) / F.sum("_k")).alias("mean"))


def bootstrap_interval(means: DataFrame, share: float = 0.95) -> tuple[float, float, float]:
    """(mean, low, high) of resampled means, by Student's distribution."""
    r = means.agg(F.count("mean"), F.avg("mean"), F.stddev_samp("mean")).first()
    return (r[1], *t_interval(r[0], r[1], r[2] or 0.0, share))


def approximate_randomisation(pairs: DataFrame, key: str, a: str, b: str, repetitions: int = 1000, seed: str = "r") -> DataFrame:
    """One-sided p-value for mean(a) > mean(b) of paired rows: each repetition swaps a pair at the flip of a digest bit."""
    diff = F.col(a) - F.col(b)
    bit = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), "rep", F.lit(seed))), 1, 1), 16, 10).cast("int") % 2
    reps = pairs.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repetitions)))).groupBy("rep").agg(F.sum(F.when(bit == 1, -diff).otherwise(diff)).alias("d"))
    observed = pairs.agg(F.sum(diff).alias("seen"))
    return reps.join(F.broadcast(observed)).agg(((F.count(F.when(F.col("d") >= F.col("seen"), 1)) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))  # one row


def split(rows: DataFrame, key: str, share: float = 0.8, seed: int = 48173) -> Column:
    """Whether a row is in the training part: by a hash of its key, so reruns and appends agree."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)
