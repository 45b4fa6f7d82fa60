"""A sink with commit: rows of several datasets are staged in the tasks and published together by one manifest a batch.

A file that no manifest names does not exist for readers, so a batch appears whole or not at all, and a
batch that is written again after a crash, before or after its commit, gives one result.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from threadlens.sources.shared import files_under, located, publish

#: Columns that say which dataset, and which of its buckets, a row is for.
DATASET, BUCKET = "dataset", "bucket"


@dataclass
class Staged(WriterCommitMessage):
    """Files that a task has written: (dataset, bucket, name, rows)."""

    files: list[tuple[str, int, str, int]]


def _manifest(path: str, batch: int) -> str:
    return f"{path}/_manifests/{batch:012d}.json"


class _Staging:
    """Writes rows to one file for each dataset and bucket, and publishes what tasks have written."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, at = located(self.path)
        open_files: dict = {}
        rows: dict[tuple[str, int], int] = defaultdict(int)
        names: dict[tuple[str, int], str] = {}
        try:
            for batch in iterator:
                keys = zip(batch.column(batch.schema.get_field_index(DATASET)).to_pylist(), batch.column(batch.schema.get_field_index(BUCKET)).to_pylist(), strict=True)
                for dataset, bucket in sorted(set(keys)):
                    mask = pc.and_(pc.equal(batch.column(batch.schema.get_field_index(DATASET)), dataset), pc.equal(batch.column(batch.schema.get_field_index(BUCKET)), bucket))
                    part = batch.filter(mask).drop_columns([DATASET, BUCKET])
                    key = (dataset, bucket)
                    if key not in open_files:
                        names[key] = f"{dataset}/{bucket}-{uuid.uuid4().hex}.parquet"
                        store.create_dir(f"{at}/{dataset}", recursive=True)
                        open_files[key] = pq.ParquetWriter(f"{at}/{names[key]}", part.schema, filesystem=store, compression="zstd")
                    open_files[key].write_batch(part)
                    rows[key] += part.num_rows
        finally:
            for f in open_files.values():
                f.close()
        return Staged([(d, b, names[d, b], n) for (d, b), n in sorted(rows.items())])

    def publish(self, messages: list[Staged | None], batch: int) -> None:
        files = [{"dataset": d, "bucket": b, "name": n, "rows": r} for m in messages if m for d, b, n, r in m.files]
        if not publish(_manifest(self.path, batch), json.dumps({"batch": batch, "files": files}).encode()):
            self.discard(messages)  # the batch has been published before

    def discard(self, messages: list[Staged | None]) -> None:
        store, at = located(self.path)
        for m in messages:
            for _, _, name, _ in m.files if m else []:
                store.delete_file(f"{at}/{name}")


class _BatchWriter(DataSourceArrowWriter):
    def __init__(self, path: str, batch: int):
        self.staging, self.batch = _Staging(path), batch

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return self.staging.write(iterator)

    def commit(self, messages: list) -> None:
        self.staging.publish(messages, self.batch)

    def abort(self, messages: list) -> None:
        self.staging.discard(messages)


class _StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.staging = _Staging(path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return self.staging.write(iterator)

    def commit(self, messages: list, batchId: int) -> None:
        self.staging.publish(messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:
        self.staging.discard(messages)


class LedgerSource(DataSource):
    """The format ``ledger``: option ``path`` names the folder, option ``batch`` the number of a batch write."""

    @classmethod
    def name(cls) -> str:
        return "ledger"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _BatchWriter(self.options["path"], int(self.options["batch"]))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(self.options["path"])


class Ledger:
    """The datasets of a folder, as the batches published so far make them.

    ``path`` lies in storage that all executors share. Batches are numbered; a number that is published
    already is passed over. Rows may be put into ``buckets`` by a key, so that a reader of few keys reads few files.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        spark.dataSource.register(LedgerSource)

    def has(self, batch: int) -> bool:
        store, at = located(_manifest(self.path, batch))
        return store.get_file_info(at).is_file

    def bucket(self, key: str) -> F.Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def write(self, batch: int, datasets: dict[str, tuple[DataFrame, str | None]]) -> None:
        """Publish a batch: rows for each dataset, each with the column whose buckets they go to, if any. The
        rows of all datasets are written by one job; a column that a dataset lacks is null there."""
        if self.has(batch):
            return
        tagged = None
        for name, (rows, key) in datasets.items():
            one = rows.select(F.lit(name).alias(DATASET), (self.bucket(key) if key else F.lit(0)).alias(BUCKET), *rows.columns)
            tagged = one if tagged is None else tagged.unionByName(one, allowMissingColumns=True)
        # a bucket's rows of a batch come together, so that files are as many as buckets, but for buckets that are split
        dealt = tagged.repartition(F.col(DATASET), F.col(BUCKET))
        dealt.write.format("ledger").option("path", self.path).option("batch", batch).mode("append").save()

    def stream(self, rows: DataFrame, dataset: str, checkpoint: str, key: str | None = None, **trigger):
        """Start a query that appends a stream's rows to a dataset, each micro-batch published as a batch of its number."""
        tagged = rows.select(F.lit(dataset).alias(DATASET), (self.bucket(key) if key else F.lit(0)).alias(BUCKET), *rows.columns)
        writer = tagged.writeStream.format("ledger").option("path", self.path).option("checkpointLocation", checkpoint).outputMode("append")
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def files(self) -> DataFrame:
        """(batch, dataset, bucket, name, rows) of the files that manifests name."""
        there = [p for p, _ in files_under(f"{self.path}/_manifests")]
        schema = "batch long, files array<struct<dataset:string,bucket:int,name:string,rows:long>>"
        if not there:
            return self.spark.createDataFrame([], "batch long, dataset string, bucket int, name string, rows long")
        return self.spark.read.schema(schema).json(f"{self.path}/_manifests/[0-9]*.json").select("batch", F.explode("files").alias("f")).select("batch", "f.*")

    def read(self, dataset: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        """A dataset's rows; with ``buckets``, of those buckets only. The driver sees the names of the files read."""
        files = self.files().where(F.col("dataset") == dataset)
        files = files if buckets is None else files.where(F.col("bucket").isin(buckets))
        names = [f"{self.path}/{r[0]}" for r in files.select("name").collect()]
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    def vacuum(self) -> int:
        """Delete the files that no manifest names, left by runs that died; not while a batch is written. Returns how many."""
        named = {r[0] for r in self.files().select("name").collect()}
        store, at = located(self.path)
        gone = [p[len(self.path) + 1 :] for p, _ in files_under(self.path) if p[len(self.path) + 1 :] not in named]
        for name in gone:
            store.delete_file(f"{at}/{name}")
        return len(gone)
