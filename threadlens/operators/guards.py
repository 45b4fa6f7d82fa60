"""Calls under guard: a deadline and a memory limit for each value, and one rate for all tasks of a job."""

from __future__ import annotations

import multiprocessing
import resource
import time
from collections import deque
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

OK, TIME, MEMORY, ERROR, DIED = "ok", "time", "memory", "error", "died"
#: For how many intervals of the whole rate a task holds batches, so that tasks agree once in so many intervals at most.
AHEAD = 10
#: Seconds that a pause is longer by: a call goes out a little after its task has noted it, one later than the next.
LAG = 0.005


def _serve(call: Callable, connection, megabytes: int) -> None:
    """A child's loop: values in, (outcome, value or reason) out, until the pipe is closed."""
    if megabytes:
        with open("/proc/self/statm") as f:
            now = int(f.read().split()[0]) * resource.getpagesize()
        resource.setrlimit(resource.RLIMIT_AS, (now + (megabytes << 20),) * 2)
    while True:
        try:
            value = connection.recv()
        except EOFError:
            return
        try:
            answer = (OK, call(value))
        except MemoryError:
            answer = (MEMORY, f"over {megabytes} MB")
        except Exception as failed:  # noqa: BLE001  the reason goes to the error table
            answer = (ERROR, f"{type(failed).__name__}: {failed}"[:500])
        connection.send(answer)


class Guard:
    """Runs calls in a child process that is killed and replaced when a call overruns its time or dies."""

    def __init__(self, call: Callable, seconds: float, megabytes: int = 0):
        self.call, self.seconds, self.megabytes, self.child = call, seconds, megabytes, None

    def _start(self) -> None:
        context = multiprocessing.get_context("fork")
        self.pipe, other = context.Pipe()
        self.child = context.Process(target=_serve, args=(self.call, other, self.megabytes), daemon=False)
        self.child.start()
        other.close()

    def stop(self) -> None:
        if self.child is not None:
            self.pipe.close()
            self.child.kill()
            self.child.join()
            self.child = None

    def __call__(self, value) -> tuple[str, object]:
        if self.child is None:
            self._start()
        try:
            self.pipe.send(value)
            if not self.pipe.poll(self.seconds):
                self.stop()
                return TIME, f"over {self.seconds} s"
            return self.pipe.recv()
        except (EOFError, OSError):
            self.stop()
            return DIED, "the worker died"


def guarded(rows: DataFrame, column: str, call: Callable, kind: str, seconds: float = 2.0, megabytes: int = 1024, name: str = "value") -> DataFrame:
    """``rows`` with ``name`` (what ``call`` made of ``column``, of type ``kind``), ``outcome`` and ``reason``.

    Each value has ``seconds`` and ``megabytes`` (beyond what the child has at its start) of its own; one that
    overruns them costs no more than that, keeps its row, gets a null result and says why: the outcome is
    ``ok``, ``time``, ``memory``, ``error`` or ``died``. Null values are not called and are ``ok``. A task has
    one child at a time, replaced after a kill; ``cleaned`` puts the raw value where there is no result.
    """
    schema = StructType(list(rows.schema.fields)).add(name, kind).add("outcome", "string").add("reason", "string")
    at, arrow = rows.columns.index(column), to_arrow_type(schema[name].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guard = Guard(call, seconds, megabytes)
        try:
            for batch in batches:
                answers = [guard(v) if v is not None else (OK, None) for v in batch.column(at).to_pylist()]
                made = [pa.array([x if o == OK else None for o, x in answers], arrow), pa.array([o for o, _ in answers]), pa.array([None if o == OK else x for o, x in answers], pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, name, "outcome", "reason"])
        finally:
            guard.stop()

    return rows.mapInArrow(run, schema)


def cleaned(done: DataFrame, column: str, name: str = "value") -> tuple[DataFrame, DataFrame]:
    """The rows of ``guarded`` with the raw value where there is no result, and the table of errors (all columns, outcome, reason)."""
    kept = done.withColumn(name, F.when(F.col("outcome") == OK, F.col(name)).otherwise(F.col(column)))
    return kept.drop("outcome", "reason"), done.where(F.col("outcome") != OK).drop(name)


def allotted(wants: list[int], budget: int, turn: int) -> list[int]:
    """Shares of a budget among tasks that want some, as even as they can be; ``turn`` says who gets an odd one first."""
    shares, left = [0] * len(wants), min(budget, sum(wants))
    while left:
        open_ = [i for i in range(len(wants)) if shares[i] < wants[i]]
        each, odd = divmod(left, len(open_))
        first = turn % len(open_)
        for place, i in enumerate(open_[first:] + open_[:first]):
            give = min(wants[i] - shares[i], each or int(place < odd))
            shares[i] += give
            left -= give
    return shares


def due(begun: deque[float], share: int, before: int, agreed: float, pause: float) -> float:
    """When a task may call next: ``share`` calls a pause, and ``before`` (its last share) until a pause after ``agreed``.

    Until then calls that others made by their last shares may be less than a pause old.
    """

    def after(n: int) -> float:
        return begun[-n] + pause if len(begun) >= n else 0.0

    return max(after(share), min(agreed + pause, after(before)) if before else agreed + pause)


def at_rate(rows: DataFrame, call: Callable[[list[dict]], list[dict]], schema: str, per_second: float, tasks: int = 4, size: int = 50, interval: float = 1.0) -> DataFrame:
    """What ``call`` makes of batches of ``size`` rows, with at most ``per_second`` calls a second in the whole job.

    The tasks run in barrier mode: they tell each other how many calls they hold, up to ten intervals' budgets, and
    share out an interval's budget, the same rule in every task, until those calls are made. In any interval a task
    begins no more calls than its share, so the rate holds whatever their number, and a task that has no rows leaves
    its share to the others. All ``tasks`` must find a slot at once; a lost one makes Spark run the stage again. A
    task holds ten intervals' batches.
    """
    budget = max(1, int(per_second * interval))
    pause = max(interval, budget / per_second) + LAG
    kinds = StructType.fromDDL(schema)
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        me, turn, share = context.partitionId(), 0, budget
        rows_in = (row for batch in batches for row in batch.to_pylist())
        parts = iter(lambda: list(islice(rows_in, size)), [])
        held: list[list[dict]] = []
        begun: deque[float] = deque(maxlen=budget)
        while True:
            held += islice(parts, AHEAD * budget - len(held))
            wants = [int(w) for w in context.allGather(str(len(held)))]  # takes a second or more, however short the interval
            if not any(wants):
                return
            agreed, intervals = time.monotonic(), -(-sum(wants) // budget)
            before, share = share, allotted([-(-w // intervals) for w in wants], budget, turn)[me]
            for part in held[: share * intervals]:
                time.sleep(max(0.0, due(begun, share, before, agreed, pause) - time.monotonic()))
                begun.append(time.monotonic())
                yield pa.RecordBatch.from_pylist(call(part), schema=arrow)
            held, turn = held[share * intervals :], turn + 1

    return rows.repartition(tasks).mapInArrow(run, kinds, barrier=True)
