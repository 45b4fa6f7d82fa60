"""Statistics whose sums come from Spark and whose last step is plain arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entropy_share(p: Column, n: Column) -> Column:
    """One term of 1 + sum(p ln p) / ln n."""
    return F.when((p > 0) & (n > 1), p * F.log(p) / F.log(n)).otherwise(0.0)


def mean_with_error(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, mean, sem, half_width) with 1.96 standard errors as half width."""
    sem = F.stddev_samp(value) / F.sqrt(F.count(value))
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), sem.alias("sem"), (sem * 1.96).alias("half_width"))


def f_statistic(rows: DataFrame, group: str, value: str) -> float:
    """One-way analysis of variance; the groups' sums are all that is collected."""
    g = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    t = g.agg(F.sum("n"), F.sum("s"), F.sum("q"), F.sum(F.col("s") * F.col("s") / F.col("n")), F.count(F.lit(1))).first()
    n, s, q, between, k = (float(x or 0) for x in t)
    inner, outer = q - between, between - s * s / n
    return (outer / (k - 1)) / (inner / (n - k)) if k > 1 and n > k and inner > 0 else math.nan


def normal_tail(z: float) -> float:
    """Two-sided tail probability."""
    return math.erfc(abs(z) / math.sqrt(2))


def running_sums(rows: DataFrame, order: str, values: list[str], descending: bool = False, pieces: int = 200) -> DataFrame:
    """``rows``, one for each value of the numeric column ``order``, with ``<value>_to`` for each of ``values``: its sum up to and with the row.

    Quantiles cut the order into pieces; a row's sum is that of the pieces before, of which there are ``pieces`` at
    most, and a running sum within its piece, so that no task holds all rows.
    """
    quantiles = [i / pieces for i in range(1, pieces)]
    cuts = rows.agg(F.percentile_approx(order, quantiles, 10 * pieces)).first()[0] or []
    sign = -1 if descending else 1
    piece = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<double>"), lambda c: c < F.col(order))) * sign
    cut = rows.withColumn("_piece", piece)
    so_far = F.col(order) * sign
    whole = cut.groupBy("_piece").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # over the pieces
    whole = whole.select("_piece", *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}") for v in values])
    inner = Window.partitionBy("_piece").orderBy(so_far).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = cut.withColumns({f"{v}_to": F.sum(v).over(inner) for v in values}).join(F.broadcast(whole), "_piece")  # a row a piece
    return run.withColumns({f"{v}_to": F.col(f"{v}_to") + F.col(f"_{v}") for v in values}).drop("_piece", *[f"_{v}" for v in values])


def t_interval(n: int, mean: float, deviation: float, share: float = 0.95) -> tuple[float, float]:
    """Confidence interval of a mean by Student's distribution."""
    if n < 2:
        return math.nan, math.nan
    half = t_quantile((1 + share) / 2, n - 1) * deviation / math.sqrt(n)
    return mean - half, mean + half


def t_quantile(p: float, df: int) -> float:
    """The quantile of Student's distribution, by bisection of its integral (Simpson's rule)."""
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    density = lambda x: scale * (1 + x * x / df) ** (-(df + 1) / 2)

    def below(x: float, steps: int = 2000) -> float:
        h = x / steps
        return 0.5 + h / 3 * (density(0) + density(x) + sum((4 if i % 2 else 2) * density(i * h) for i in range(1, steps)))

    if p < 0.5:
        return -t_quantile(1 - p, df)
    lo, hi = 0.0, 1.0
    while below(hi) < p and hi < 1e6:
        lo, hi = hi, 2 * hi
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return (lo + hi) / 2


def binomial_p(k: int, n: int, p: float = 0.5) -> float:
    """Two-sided exact binomial test: the chance of an outcome no likelier than ``k`` of ``n``."""
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    seen = log(k)
    return min(1.0, sum(math.exp(log(i)) for i in range(n + 1) if log(i) <= seen + 1e-7))


def signed_rank_z(pairs: DataFrame, a: str, b: str) -> float:
    """Wilcoxon's signed-rank z of paired values: differences of 0 are left out, equal ones ranked by their mean."""
    d = pairs.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0")
    per = d.groupBy(F.abs("d").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("d") > 0, 1)).alias("up"))
    ranked = running_sums(per, "size", ["n"]).withColumn("rank", F.col("n_to") - (F.col("n") - 1) / 2)
    t = ranked.agg(F.sum(F.col("up") * F.col("rank")), F.sum("n"), F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n"))).first()
    up, n, ties = (float(x or 0) for x in t)
    variance = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return (up - n * (n + 1) / 4) / math.sqrt(variance) if variance > 0 else math.nan


def rescaled(x: Column, low: float, high: float, to_low: float = 0.0, to_high: float = 1.0) -> Column:
    """A linear map of [low, high] to [to_low, to_high]."""
    return to_low + (x - low) * ((to_high - to_low) / (high - low))


def rank_sum_z(rows: DataFrame, group: str, value: str) -> float:
    """Mann-Whitney z of the groups true and false, ties ranked by their mean."""
    per_value = rows.groupBy(value).agg(F.count(F.when(F.col(group), 1)).alias("a"), F.count(F.lit(1)).alias("n"))
    ranked = running_sums(per_value, value, ["n"]).withColumn("rank", F.col("n_to") - (F.col("n") - 1) / 2)
    t = ranked.agg(F.sum(F.col("a") * F.col("rank")), F.sum("a"), F.sum("n")).first()
    ranks, a, n = (float(x or 0) for x in t)
    b = n - a
    return (ranks - a * (a + 1) / 2 - a * b / 2) / math.sqrt(a * b * (n + 1) / 12) if a and b else math.nan
