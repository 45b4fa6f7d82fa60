"""Rows of a stream in time order within each key, and pages rebuilt from them, in restartable state.

Keys are dealt to groups by a hash. Rows of a group wait in a list state until the watermark has passed them; an
event-time timer at the earliest waiting row takes those that are due, sorted. State lives in the RocksDB store, part
by part, and is checkpointed with the query, so that a restart goes on where it stopped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby, islice
from operator import itemgetter
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups that keys are dealt to: calls and state of its own for each of many keys would cost more than its few rows.
GROUPS = 1024
#: A block of rows that wait: when the first is due, in milliseconds, how many they are, and (due, key, place, row) of each as JSON.
_WAITING = "due long, n int, rows string"
#: Rows of one block: the state takes a pickle and a call's share for each element, which rows alone would not be worth.
BLOCK = 1000
#: The order of rows by key, then by time and place.
_IN_KEY = itemgetter(1, 0, 2, 3)
#: Rows of one frame that goes out.
FRAME = 10_000


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started in this block keep their state in RocksDB, which ``in_time_order`` and ``reconstruct_stream`` need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class InTimeOrder(StatefulProcessor):
    """Hands the rows of a group's keys on in the order of (time, place) within each key, once the watermark has passed them.

    A row that is older than the watermark when it comes is late and goes out at once with the tag ``late``.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        firsts, late = [], []
        for part in rows:
            new = []
            for due, name, place, row in zip(part["due"].tolist(), part["key"], part["place"].tolist(), part["row"], strict=True):
                (late if due <= mark else new).append((int(due), name, int(place), row))
            if new:
                self.waiting.appendList(self._blocks(sorted(new)))
                firsts.append(min(new)[0])
        if firsts:
            self._wake(min(firsts), 0)
        yield from self._framed("late", sorted(late, key=_IN_KEY))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        due, rest, kept = [], [], []
        for first, n, text in self.waiting.get():
            if first > mark and n >= BLOCK // 2:
                kept.append((first, n, text))
                continue
            for row in map(tuple, json.loads(text)):
                (due if row[0] <= mark else rest).append(row)
        if due:
            kept += self._blocks(sorted(rest))
            self.waiting.put(kept) if kept else self.waiting.clear()
        if kept or rest:
            self._wake(min(row[0] for row in (*kept, *rest)), mark)
        yield from self.take(sorted(due, key=_IN_KEY))

    @staticmethod
    def _blocks(rows: list[tuple]) -> list[tuple]:
        cut = (rows[at : at + BLOCK] for at in range(0, len(rows), BLOCK))
        return [(part[0][0], len(part), json.dumps(part)) for part in cut]

    def _wake(self, when: int, mark: int) -> None:
        """See that a timer after the mark goes off no later than then."""
        if not any(mark < t <= when for t in self.handle.listTimers()):
            self.handle.registerTimer(when)

    def take(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        """What becomes of the (due, key, place, row) that are due, in order within each key."""
        yield from self._framed("row", rows)

    def _framed(self, tag: str, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        for at in range(0, len(rows), FRAME):
            yield self.out([{"tag": tag, "row": row} for _, _, _, row in rows[at : at + FRAME]])

    def out(self, rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["tag", "row"])

    def close(self) -> None:
        pass


def _sent(rows: DataFrame, key: str, time_column: str, order: str, late: str) -> DataFrame:
    """(group, key, due, place, row) under a watermark (pandas would rename names that begin with a low line); the time goes as a number, so that late rows reach the processor."""
    marked = rows.withWatermark(time_column, late)
    name = F.col(key).cast("string")
    return marked.select(F.pmod(F.xxhash64(name), F.lit(GROUPS)).alias("group"), name.alias("key"), F.unix_millis(F.col(time_column)).alias("due"), F.col(order).cast("long").alias("place"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("row"))


def in_time_order(rows: DataFrame, key: str, time_column: str, order: str, late: str) -> DataFrame:
    """(tag, columns of ``rows``): the stream's rows, tag ``row``, by (time, ``order``) within each ``key`` over all batches.

    A row goes out when the watermark, ``late`` behind the newest time of the stream, has passed it; one that is
    older than the watermark already goes out at once with the tag ``late``. Rows without a key or a time
    are dropped. The waiting rows of one of ``GROUPS`` groups of keys are what one task holds; rows handed on keep nothing.
    """
    sent = _sent(rows.where(F.col(key).isNotNull() & F.col(time_column).isNotNull()), key, time_column, order, late)
    out = sent.groupBy("group").transformWithStateInPandas(InTimeOrder(), "tag string, row string", "append", "EventTime")
    return out.select("tag", F.from_json("row", rows.schema).alias("row")).select("tag", "row.*")


LINEAGE = ("conversations", "ancestors", "authors")
ACTION_COLUMNS = ("id", "type", "content", "rev_id", "parent_id", "replyTo_id", "conversation_id", "indentation")
PAGE_ROWS = "tag string, page_id string, id string, type string, content string, rev_id bigint, parent_id string, replyTo_id string, conversation_id string, indentation int"


#: Comments whose lineage one part of a page's state holds.
LINEAGES = 64


class Pages(InTimeOrder):
    """Folds the revisions of a group's pages, in time order, into actions.

    A page is kept in parts: first its head with the places of its comments and the deleted texts, then the lineages
    of its comments, dealt to parts by a hash. A batch writes the parts that it changed. A revision that
    breaks the page gives an ``error`` row and stops the page for good, as a batch run does from a logged error on.
    """

    def __init__(self, fold=None):
        self.fold = fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.parts = handle.getMapState("parts", "page string, part int", "value string")

    def _load(self, page_id: str):
        from threadlens.operators.reconstruct import Page, page_of

        head = self.parts.getValue((page_id, 0))
        if head is None:
            return [], Page(page_id), None
        row = json.loads(head[0])
        parts = [head[0], *(self.parts.getValue((page_id, n + 1))[0] for n in range(row["parts"]))]
        for field in LINEAGE:
            row[field] = {}
        for part in parts[1:]:
            for field, known in json.loads(part).items():
                row[field] |= known
        return parts, page_of(row), row["stopped"]

    def _store(self, before: list[str], page, stopped: int | None) -> None:
        from threadlens.operators.reconstruct import state_row

        row = state_row(page)
        lineage = {field: row.pop(field) for field in LINEAGE}
        parts = 1 << (max(map(len, lineage.values())) // LINEAGES).bit_length()
        dealt: list[dict[str, dict]] = [{field: {} for field in LINEAGE} for _ in range(parts)]
        for field, known in lineage.items():
            for comment, x in known.items():
                dealt[crc32(comment.encode()) % parts][field][comment] = x
        now = [json.dumps(row | {"parts": parts, "stopped": stopped}), *map(json.dumps, dealt)]
        for n, value in enumerate(now):
            if n >= len(before) or before[n] != value:
                self.parts.updateValue((page.page_id, n), (value,))
        for n in range(len(now), len(before)):
            self.parts.removeKey((page.page_id, n))

    def take(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        made = (row for page_id, mine in groupby(rows, itemgetter(1)) for row in self._folded(page_id, [row for _, _, _, row in mine]))
        while out := list(islice(made, FRAME)):
            yield self._frame(out)

    def _folded(self, page_id: str, rows: list[str]) -> list[dict]:
        from threadlens.operators.reconstruct import PageFold

        before, page, stopped = self._load(page_id)
        if stopped is not None:
            return []
        fold, out = (self.fold or PageFold)(page), []
        for row in rows:
            for tag, made in fold.take(json.loads(row)):
                if tag == "error":
                    stopped = made["rev_id"]
                out.append({"tag": tag, "page_id": page_id, "rev_id": made["rev_id"]} | ({n: made[n] for n in ACTION_COLUMNS} if tag == "action" else {}))
        self._store(before, page, stopped)
        return out

    def out(self, rows: list[dict]) -> pd.DataFrame:
        late = [json.loads(r["row"]) for r in rows]
        return self._frame([{"tag": r["tag"], "page_id": x["page_id"], "rev_id": x["rev_id"], "content": x["text"]} for r, x in zip(rows, late, strict=True)])

    @staticmethod
    def _frame(rows: list[dict]) -> pd.DataFrame:
        names = [c.split(" ")[0] for c in PAGE_ROWS.split(", ")]
        return pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names).astype({"indentation": "Int32", "rev_id": "Int64"})


def reconstruct_stream(revisions: DataFrame, late: str = "1 hour", fold=None) -> DataFrame:
    """(tag, page_id, ...) of a stream of revisions that come in any order: actions (tag ``action``), the revisions
    at which pages stopped (``error``), and revisions that came after the watermark had passed them (``late``,
    with their text as ``content``).

    ``revisions`` has rev_id, timestamp (a text in ISO form), text (clean), user_id, user_text, page_id, page_title. Actions
    go out once the watermark, ``late`` behind the newest timestamp, has passed their revision, and are
    those of a batch run over the revisions that were not late. Split the output by its tag, or write
    it with ``partitionBy("tag")``, so that the three change together. ``fold`` is another ``PageFold``.
    """
    timed = revisions.withColumn("_time", F.to_timestamp("timestamp", "yyyy-MM-dd'T'HH:mm:ssX"))
    sent = _sent(timed.where("page_id IS NOT NULL AND _time IS NOT NULL"), "page_id", "_time", "rev_id", late)
    return sent.groupBy("group").transformWithStateInPandas(Pages(fold), PAGE_ROWS, "append", "EventTime")
