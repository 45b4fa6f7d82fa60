"""Paged lookups at a service: bounded requests in flight, continuation tokens as a work list, back-off, and restarts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.sources.feed import Busy, patiently
from threadlens.sources.shared import located

#: ``fetch(key, token)`` gives a page's rows and the token of the next page, None after the last; the first token is None.
Fetch = Callable[[str, str | None], tuple[list[dict], str | None]]
_FOUND = "key string, page long, row string, token string, error string"


def _one(fetch: Fetch, key: str, token: str | None, page: int, pages: int, tries: int, pause: float) -> list[tuple]:
    """Up to ``pages`` pages of a key: a row for each found, then one with the token of what is left, or the error."""
    out: list[tuple] = []
    for n in range(page, page + pages):
        try:
            rows, token = patiently(lambda _a, _b, token=token: [fetch(key, token)], 0, 0, tries, pause)[0]
        except Exception as failed:  # noqa: BLE001  a key that fails costs its own rows only, and its error is kept
            out.append((key, n, None, token, f"{type(failed).__name__}: {failed}"))
            return out
        out += [(key, n, json.dumps(row), None, None) for row in rows]
        if token is None:
            return out
    return [*out, (key, page + pages, None, token, None)]


def _round(fetch: Fetch, in_flight: int, pages: int, tries: int, pause: float):
    """A task's work: ``in_flight`` requests at a time, and no more keys read than are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in _FOUND.split(", ")]
        schema = pa.schema(list(zip(names, [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()], strict=True)))

        def done(futures: set[Future]) -> pa.RecordBatch:
            rows = [r for f in futures for r in f.result()]
            return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

        with ThreadPoolExecutor(in_flight) as pool:
            waiting: set[Future] = set()
            for batch in batches:
                for key, page, token in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if len(waiting) >= in_flight:
                        over, waiting = wait(waiting, return_when=FIRST_COMPLETED)
                        yield done(over)
                    waiting.add(pool.submit(_one, fetch, key, token, page, pages, tries, pause))
            if waiting:
                yield done(waiting)

    return run


class PagedLookup:
    """All pages that a service has for the distinct keys of a table, fetched in rounds that are written to ``folder``.

    Each round asks for up to ``pages`` pages of each key that isn't at its end, with ``in_flight`` requests of the
    whole job at a time, and writes what it found with the tokens of what is left: the next round's work. A
    run that died is taken up from the last round that was written, so every row comes once. ``fetch``
    runs in the tasks and raises ``Busy`` to be asked again, up to ``tries`` times, after twice the pause
    each time; a key whose request fails otherwise keeps its pages so far and has a row in ``errors``.
    Null keys are not asked for. The folder lies in storage that all executors share.
    """

    def __init__(self, keys: DataFrame, key: str, fetch: Fetch, schema: str, folder: str, in_flight: int = 50, pages: int = 10, tries: int = 5, pause: float = 1.0):
        self.spark: SparkSession = keys.sparkSession
        self.schema, self.folder = schema, folder.rstrip("/")
        tasks = max(1, min(in_flight, self.spark.sparkContext.defaultParallelism))
        work = keys.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.lit(0).cast("long").alias("page"), F.lit(None).cast("string").alias("token")).distinct()
        self.rounds = 0
        while True:
            path = f"{self.folder}/round-{self.rounds:05d}"
            if not self._written(path):
                found = work.repartition(tasks, "key").mapInArrow(_round(fetch, in_flight // tasks, pages, tries, pause), _FOUND)
                found.write.mode("overwrite").parquet(path)
            self.rounds += 1
            work = self.spark.read.schema(_FOUND).parquet(path).where("token IS NOT NULL AND error IS NULL").select("key", "page", "token")
            if work.isEmpty():
                break

    def _written(self, path: str) -> bool:
        store, at = located(f"{path}/_SUCCESS")
        return store.get_file_info(at).is_file

    def _found(self) -> DataFrame:
        return self.spark.read.schema(_FOUND).parquet(*[f"{self.folder}/round-{n:05d}" for n in range(self.rounds)])

    def rows(self) -> DataFrame:
        """(key, page, columns of ``schema``) of every row that the service gave."""
        return self._found().where("row IS NOT NULL").select("key", "page", F.from_json("row", self.schema).alias("row")).select("key", "page", "row.*")

    def errors(self) -> DataFrame:
        """(key, page, token, error): where a key's pages broke off."""
        return self._found().where("error IS NOT NULL").select("key", "page", "token", "error")


__all__ = ["Busy", "Fetch", "PagedLookup"]
