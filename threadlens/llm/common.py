"""Shared folder, materialised tables and whole-text readers used by the corpus operators."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``, as a Java and RE2 character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

#: Hold while tables are saved: the shuffle files of a writing job go as soon as it ends, and Arrow batches are small.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
_lock = threading.Lock()
_saving: dict = {"now": 0, "before": {}}
#: Folders of the tables saved within each of this thread's open scratch scopes.
_scopes = threading.local()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may go without it; then a temporary folder is set for the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="threadlens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """``_SETTINGS``, from the first of several concurrent saves to the end of the last."""
    with _lock:
        if _saving["now"] == 0:
            _saving["before"] = {k: spark.conf.get(k, None) for k in _SETTINGS}
            for k, v in _SETTINGS.items():
                spark.conf.set(k, v)
        _saving["now"] += 1
    try:
        yield
    finally:
        with _lock:
            _saving["now"] -= 1
            if _saving["now"] == 0:
                for k, v in _saving["before"].items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables saved in this block are deleted at its end, but for those that outlive it."""
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a saved table."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def save_at(df: DataFrame, path: str) -> None:
    """Write ``df`` under a folder of ``fresh_path``."""
    with _settings(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)


def save(df: DataFrame, label: str, outlive: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Within ``scratch`` blocks the table goes with the innermost, or with the one around the ``outlive`` innermost, if any.

    Cuts lineage, computes shared parts once, survives lost executors, and gives the planner real
    sizes: both sides of a later join are then plain scans, whose skew adaptive execution splits.
    The shuffle files of the writing job are dropped as soon as it ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    stack = _scopes.__dict__.get("stack", [])
    if len(stack) > outlive:
        stack[-1 - outlive].append(path)
    save_at(df, path)
    return spark.read.schema(df.schema).parquet(path)


def boxed(docs: DataFrame, **keys: Column) -> DataFrame:
    """Whole rows in one column ``row`` beside ``keys``, so that no column of ``docs`` clashes with an operator's."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *[k.alias(name) for name, k in keys.items()])


def unboxed(df: DataFrame, columns: list[str], **replaced: Column) -> list[Column]:
    """The columns of the rows that ``boxed`` packed, some of them replaced."""
    return [(replaced[c] if c in replaced else df["row"].getField(c)).alias(c) for c in columns]
