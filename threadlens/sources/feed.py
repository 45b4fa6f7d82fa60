"""A live source: a service that is asked for the events of time windows, as a stream with offsets."""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: What ``fetch`` gives for the seconds [start, end): lines of the feed, one event each.
Fetch = Callable[[int, int], Iterable[str]]
HOUR = 3600
FEED = "line string, window_start timestamp, window_end timestamp"
EVENT = "wiki string, bot boolean, namespace int, title string, user string, comment string, revision struct<old:bigint,new:bigint>"


class Busy(Exception):
    """What a fetcher raises when the service asks it to come back later."""

    def __init__(self, wait: float = 0.0):
        super().__init__(f"try again in {wait} s")
        self.wait = wait


def patiently(fetch: Fetch, start: int, end: int, tries: int, wait: float) -> list[str]:
    """The lines of a window, whole: after ``Busy`` the window is asked for again, twice as late each time."""
    for attempt in range(tries):
        try:
            return list(fetch(start, end))
        except Busy as busy:
            if attempt + 1 == tries:
                raise
            time.sleep(max(busy.wait, wait * 2**attempt * (0.5 + random.random())))
    return []


class _Window(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__((start, end))
        self.start, self.end = start, end


class _Windows(DataSourceStreamReader):
    """The offset is the second up to which windows are asked for; each window is a partition of its own."""

    def __init__(self, source: type[Feed]):
        self.source = source

    def initialOffset(self) -> dict:
        return {"until": self.source.since}

    def latestOffset(self) -> dict:
        s = self.source
        whole = int(s.clock()) // s.width * s.width - s.behind
        return {"until": max(s.since, whole)}

    def partitions(self, start: dict, end: dict) -> list[_Window]:
        width = self.source.width
        edges = [*range(start["until"], end["until"], width), end["until"]]
        return [_Window(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]

    def read(self, partition: _Window) -> Iterator[tuple]:
        from datetime import UTC, datetime

        s, at = self.source, lambda x: datetime.fromtimestamp(x, UTC).replace(tzinfo=None)
        for line in patiently(s.fetch, partition.start, partition.end, s.tries, s.wait):
            yield line, at(partition.start), at(partition.end)

    def commit(self, end: dict) -> None:
        """Nothing to tell the service: it is asked by time."""


class Feed(DataSource):
    """Attributes of a registered feed; ``read_feed`` makes one for each source."""

    since, width, behind, tries, wait = 0, HOUR, HOUR, 5, 1.0
    fetch: Fetch = staticmethod(lambda start, end: [])
    clock: Callable[[], float] = staticmethod(time.time)

    def schema(self) -> str:
        return FEED

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Windows(type(self))


def read_feed(spark: SparkSession, fetch: Fetch, since: int, width: int = HOUR, behind: int = HOUR, clock: Callable[[], float] = time.time, tries: int = 5, wait: float = 1.0) -> DataFrame:
    """A stream of (line, window_start, window_end) of a service that ``fetch`` asks for the seconds [start, end).

    Windows are ``width`` seconds long and begin at whole multiples of it after ``since`` (also one); the newest ends ``behind``
    the full width before now, so at the defaults an hour is asked for once it is over for an hour. The
    checkpoint holds the second that has been reached: a query that is started again goes on there, in
    windows of any width, and after a crash asks again for the windows of its last unfinished batch, so
    that nothing is lost and, with a sink that commits, nothing comes twice. ``fetch`` raises ``Busy`` to be
    asked again later, ``tries`` times at most, and runs in the tasks: a window is one task, and its lines
    are what it holds.
    """
    name = f"feed_{uuid.uuid4().hex}"
    settings = {"since": since, "width": width, "behind": behind, "tries": tries, "wait": wait, "fetch": staticmethod(fetch), "clock": staticmethod(clock), "name": classmethod(lambda cls: name)}
    spark.dataSource.register(type("OneFeed", (Feed,), settings))
    return spark.readStream.format(name).load()


def parsed_events(lines: DataFrame, column: str = "line", schema: str = EVENT) -> DataFrame:
    """The lines' events (struct ``event``) and ``malformed``: the line itself where it is no event, else null. Empty lines are dropped."""
    whole = lines.where(F.col(column).isNotNull() & (F.trim(F.col(column)) != ""))
    event = F.from_json(column, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    read = whole.withColumn("event", event)
    bad = F.col("event").isNull() | F.col("event._corrupt").isNotNull()
    return read.select("*", F.when(bad, F.col(column)).alias("malformed")).withColumn("event", F.when(~bad, F.col("event").dropFields("_corrupt")))
