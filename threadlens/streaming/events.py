"""Live events: filtered streams, micro-batches that append and flag, and windowed counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from threadlens.operators.reverts import with_reverted
from threadlens.sources.ledger import Ledger
from threadlens.sources.readers import events_from_json
from threadlens.sources.sinks import new_rows, valid_rows


def wanted_edits(lines: DataFrame, wiki: str, namespaces: list[int]) -> DataFrame:
    """Events of one wiki's namespaces that edit an existing page and that no bot made; works on batches and streams."""
    e = events_from_json(lines)
    return e.where((~F.coalesce("bot", F.lit(False))) & (F.col("wiki") == wiki) & F.col("namespace").isin(namespaces) & F.col("revision.old").isNotNull())


def windowed_counts(events: DataFrame, time: str, width: str, late: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """Counts of tumbling windows; rows later than ``late`` are dropped by the watermark."""
    w = F.window(time, width)
    counts = events.withWatermark(time, late).groupBy(w, *(by or [])).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *(by or []), "n")


def sliding_counts(events: DataFrame, time: str, width: str, slide: str, late: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """Counts of windows of one width that begin every ``slide``; an event is in each that holds it."""
    w = F.window(time, width, slide)
    counts = events.withWatermark(time, late).groupBy(w, *(by or [])).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *(by or []), "n")


def session_counts(events: DataFrame, time: str, gap: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    """Sessions of each ``by``: events with less than ``gap`` to the one before are in one, from its first event to ``gap`` after its last."""
    w = F.session_window(time, gap)
    counts = events.withWatermark(time, late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


#: Groups that ``split_late`` deals rows to.
LATE_GROUPS = 1024


class _Late(StatefulProcessor):
    """Tags each row by whether it is older than the watermark when it comes; keeps nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            yield pd.DataFrame({"tag": ["late" if due < mark else "row" for due in part["due"]], "row": part["row"]})

    def close(self) -> None:
        pass


def split_late(events: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """(tag, columns of ``events``): a stream's rows, those that come after the watermark has passed them with the tag
    ``late``, the others with ``row``.

    Spark's own windows drop late rows without a trace, a batch later than the watermark moves. Written with
    ``partitionBy("tag")`` and counted from the part ``row``, every row is either counted or among the late
    ones. Needs ``pages.state_on_disk``; rows without a time are dropped. ``key`` deals the rows out, to
    ``LATE_GROUPS`` groups at most, since a call for each key would cost more than its few rows.
    """
    marked = events.where(F.col(time).isNotNull()).withWatermark(time, late)
    sent = marked.select(F.pmod(F.xxhash64(key), F.lit(LATE_GROUPS)).cast("string").alias("key"), F.unix_millis(F.col(time)).alias("due"), F.to_json(F.struct(*events.columns)).alias("row"))
    out = sent.groupBy("key").transformWithStateInPandas(_Late(), "tag string, row string", "append", "EventTime")
    return out.select("tag", F.from_json("row", events.schema).alias("row")).select("tag", "row.*")


def once_each(events: DataFrame, key: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Re-delivered events are dropped within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


class LiveRevisions:
    """Revisions that micro-batches add to a ledger, with the flags of their pages.

    A step appends the valid rows whose key the ledger lacks and flags the pages that it touched anew, in one
    commit; the flags of other pages stay. Rows lie in buckets of pages, and a step reads those buckets
    that its pages are in. A batch that is given again, before or after its commit, changes nothing more.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, required: list[str], key: list[str], buckets: int = 64):
        self.ledger, self.schema, self.required, self.key = Ledger(spark, path, buckets), schema, required, key

    def step(self, batch: DataFrame, number: int) -> None:
        """A ``foreachBatch`` step; ``batch`` has the columns of the schema, page_id, sha1 and ts among them."""
        if self.ledger.has(number):
            return
        rows = valid_rows(batch.select(*StructType.fromDDL(self.schema).names), [*self.required, "page_id"]).persist()
        try:
            touched = [r[0] for r in rows.select(self.ledger.bucket("page_id")).distinct().collect()]  # ``buckets`` at most
            pages = rows.select("page_id").distinct()
            held = self.ledger.read("rows", self.schema, touched).join(pages, "page_id", "left_semi").select(*rows.columns)
            fresh = new_rows(rows, held, self.key).select(*rows.columns)
            flags = with_reverted(held.unionByName(fresh)).where("reverted").drop("reverted")
            version = F.lit(number).cast("long").alias("version")
            self.ledger.write(number, {"rows": (fresh, "page_id"), "flags": (flags.select("*", version), "page_id"), "pages": (pages.select("page_id", version), "page_id")})
        finally:
            rows.unpersist()

    def revisions(self) -> DataFrame:
        return self.ledger.read("rows", self.schema)

    def reverted(self) -> DataFrame:
        """The reverted rows, as the last batch that touched each page flagged them."""
        last = self.ledger.read("pages", "page_id string, version long").groupBy("page_id").agg(F.max("version").alias("version"))
        return self.ledger.read("flags", f"{self.schema}, version long").join(last, ["page_id", "version"], "left_semi").drop("version")


def run_available(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process what is there in micro-batches, then stop."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
