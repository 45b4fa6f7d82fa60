"""Month, day and category trends of scored actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_range(column: str, year: int, month: int) -> Column:
    """From the first of the month to before the first of the next."""
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1)).cast("timestamp_ntz")
    after = F.add_months(F.make_date(F.lit(year), F.lit(month), F.lit(1)), 1).cast("timestamp_ntz")
    return (F.col(column) >= first) & (F.col(column) < after)


def month_toxic(revisions: DataFrame, year: int, month: int, toxic: float = 0.75) -> DataFrame:
    return revisions.where(month_range("ts", year, month) & (F.col("attack") >= toxic))


def month_nontoxic_count(revisions: DataFrame, year: int, month: int, toxic: float = 0.75) -> DataFrame:
    return revisions.where(month_range("ts", year, month) & (F.col("attack") < toxic)).agg(F.count(F.lit(1)).alias("n"))


def calendar(revisions: DataFrame, toxic: float = 0.75) -> DataFrame:
    """(year, month, total, toxic)."""
    return revisions.groupBy(F.year("ts").cast("long").alias("year"), F.month("ts").cast("long").alias("month")).agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("attack") >= toxic, 1)).alias("toxic")
    )


def calendar_of_reverted(revisions: DataFrame, reverted: DataFrame, toxic: float = 0.75) -> DataFrame:
    """(year, month, reverted) of toxic revisions: months without a revert count 0."""
    marks = reverted.select(F.col("rev_id").alias("reverted_id")).distinct()
    toxic_rows = revisions.where(F.col("attack") >= toxic)
    joined = marks.join(toxic_rows, F.col("reverted_id") == F.col("rev_id"), "right")
    return joined.groupBy(F.year("ts").cast("long").alias("year"), F.month("ts").cast("long").alias("month")).agg(F.count("reverted_id").alias("reverted"))


def daily_distinct(actions: DataFrame, least: float) -> DataFrame:
    """Distinct scored actions of each day that are not deletions (an action of unknown type goes too)."""
    kept = actions.where((F.col("type") != "DELETION") & (F.col("toxicity") >= least))
    return kept.groupBy(F.to_date("ts").alias("day")).agg(F.countDistinct("id").alias("n"))


def monthly_share(actions: DataFrame, least: float) -> DataFrame:
    """(month, toxic, total, share): months without a toxic action are left out."""
    month = F.trunc("ts", "month").alias("month")
    both = actions.where("type != 'DELETION'").groupBy(month).agg(
        F.countDistinct(F.when(F.col("toxicity") >= least, F.col("id"))).alias("toxic"), F.countDistinct("id").alias("total")
    )
    return both.where("toxic > 0").withColumn("share", F.round(F.col("toxic") / F.col("total"), 6))


def share_growth(shares: DataFrame) -> DataFrame:
    """Each month's growth over the month before it, of shares rounded to three digits; one row a month."""
    order = Window.orderBy("month")
    rounded = shares.select("month", F.round("share", 3).alias("share"))
    before = F.lag("share").over(order)
    return rounded.withColumn("growth", F.round((F.col("share") - before) / F.when(before != 0, before), 3))


def category_trend(rows: DataFrame, skip_top: bool = True) -> DataFrame:
    """Most frequent categories (or sub-categories, where given) of talk pages; by default the second to the fifth.

    ``rows`` has page_title and category1..3, sub_category1..3.
    """
    pairs = F.explode(F.array(*[F.coalesce(F.col(f"sub_category{i}"), F.col(f"category{i}")) for i in (1, 2, 3)])).alias("category")
    counts = rows.where(F.col("page_title").startswith("Talk:")).select(pairs).where("category IS NOT NULL").groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "category").limit(5)
    place = F.row_number().over(Window.orderBy(F.desc("n"), "category"))  # over the five that are left
    return top.withColumn("place", place).where(F.col("place") > (1 if skip_top else 0)).select("category", "n", F.col("place").cast("long").alias("place"))


def model_counts(rows: DataFrame, models: list[str], above: float = 0.8, top: int = 6) -> DataFrame:
    """How many actions that are not deletions each model scores above the bound; the most frequent models."""
    counts = rows.where("type IS NULL OR type != 'DELETION'").select(*[F.count(F.when(F.col(m) > above, 1)).alias(m) for m in models])
    return counts.unpivot([], models, "model", "n").orderBy(F.desc("n"), "model").limit(top)


def page_type_counts(rows: DataFrame) -> DataFrame:
    """Talk and user pages, toxic and already deleted."""
    kind = F.when(F.col("page_title").startswith("Talk:"), "talk").when(F.col("page_title").startswith("User"), "user").otherwise("other")
    gone = F.coalesce(F.col("type") == "DELETION", F.lit(False))
    return rows.groupBy(kind.alias("kind")).agg(F.count(F.when(~gone, 1)).alias("toxic"), F.count(F.when(gone, 1)).alias("detoxed"))


def deletion_lag(created: Column, removed: Column) -> Column:
    """How long a comment stood, from two epoch seconds."""
    s = removed - created
    return F.when(s <= 86400, "day").when(s <= 7 * 86400, "week").when(s <= 30 * 86400, "month").when(s <= 365 * 86400, "year").otherwise("more")


def deletion_lags(deleted: DataFrame) -> DataFrame:
    """Count of deletions by how long the comment stood; ``deleted`` has created and removed times."""
    lag = deletion_lag(F.unix_timestamp("created"), F.unix_timestamp("removed"))
    return deleted.groupBy(lag.alias("lag")).agg(F.count(F.lit(1)).alias("n"))


#: Scores, categories and descriptions of a month's rows, in order.
SLICE_SCORES = ["toxicity", "flirtation", "threat", "identity_attack", "insult", "sexually_explicit", "profanity", "severe_toxicity"]
SLICE = [
    *SLICE_SCORES, "category1", "sub_category1", "category2", "sub_category2", "category3", "sub_category3",
    "page_id", "page_title", "id", "rev_id", "user_text", "timestamp", "content", "cleaned_content", "type",
]


def month_slice(actions: DataFrame, start: Column, end: Column, above: float = 0.8) -> DataFrame:
    """The columns of ``SLICE``, for toxic actions from ``start`` to ``end``, both included."""
    return actions.where(F.col("timestamp").between(start, end) & (F.col("toxicity") > above)).select(*SLICE)


def client_rows(revisions: DataFrame, reverted: DataFrame) -> DataFrame:
    """(row): [1, attack, 1 if reverted else 0] of each revision, as clients draw them."""
    marks = reverted.select(F.col("rev_id").alias("_r")).distinct()
    joined = revisions.join(marks, F.col("rev_id") == F.col("_r"), "left")
    return joined.select("rev_id", F.array(F.lit(1.0), F.col("attack").cast("double"), F.col("_r").isNotNull().cast("double")).alias("row"))


def category_facet(rows: DataFrame, value: str, alive: bool = True) -> DataFrame:
    """Rows one of whose six categories and sub-categories is ``value``; ``alive`` leaves deletions out."""
    found = rows.where(F.lit(value).isin(*[F.col(f"{s}category{i}") for i in (1, 2, 3) for s in ("", "sub_")]))
    return found.where("type IS NULL OR type <> 'DELETION'") if alive else found
