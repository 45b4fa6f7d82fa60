"""Exact dedup against a persistent digest index: a table bucketed and sorted by digest.

New rows are grouped by digest, the groups are held against the index by a sort-merge anti-join,
and only digests that the index lacks are appended to it, with the name of their batch: a batch that is added
again after a crash gets the decisions it would have got at first. The index side of each join is read
bucket by bucket and is never shuffled. An index that has grown by many appends is compacted into one
sorted file a bucket, and into more buckets if its rows ask for them.
"""

from __future__ import annotations

import hashlib
import math
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.common import SPACE_CLASS, fresh_path, remove, save

#: Digests that a bucket is meant to hold (some 40 MB), and the fewest and most buckets of an index.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 1_000_000, 64, 65_536


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256))


def buckets_for(rows: int) -> int:
    """A power of two, so that each bucket of ``rows`` digests holds about ``BUCKET_ROWS``."""
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << math.ceil(math.log2(max(1, rows / BUCKET_ROWS)))))


class DigestIndex:
    """Digests of every text kept so far, with the id of the row that was kept.

    ``path`` names the folder of the index in storage that all executors share; an index that is
    there already is opened again, with the buckets and the type of id that it was made with. A new index
    is made at the first ``add``: ``buckets`` says how many it gets, or else the rows of that call do.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.buckets, self.table = spark, path.rstrip("/"), buckets, None
        try:
            known = spark.read.parquet(f"{self.path}/versions").orderBy(F.desc("version")).first()
        except AnalysisException:
            known = None  # not made yet
        if known is not None:
            self._open(known.version, known.buckets, known.id_type)

    def _open(self, version: int, buckets: int, id_type: str) -> None:
        self.version, self.buckets, self.id_type = version, buckets, id_type
        folder = f"{self.path}/v{version}"
        self.table = f"digest_index_{hashlib.sha1(folder.encode()).hexdigest()[:16]}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id {id_type}, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{folder}'"
        )

    def _note(self, version: int, buckets: int, id_type: str) -> None:
        row = self.spark.range(1).select(F.lit(version).alias("version"), F.lit(buckets).alias("buckets"), F.lit(id_type).alias("id_type"))
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/versions")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def _append(self, digests: DataFrame) -> None:
        digests.repartition(self.buckets, "digest").write.insertInto(self.table)

    def compact(self) -> None:
        """Write the index anew: one sorted file a bucket, as many buckets as its rows ask for. The version
        is noted last, so that an index whose compaction fails stays as it was; what a failed one left goes first."""
        rows, old = self.rows(), self.table
        buckets, id_type, version = max(self.buckets, buckets_for(rows.count())), self.id_type, self.version + 1
        remove(self.spark, f"{self.path}/v{version}")
        self._open(version, buckets, id_type)
        self._append(rows)
        self._note(version, buckets, id_type)
        self.spark.sql(f"DROP TABLE IF EXISTS {old}")

    def close(self) -> None:
        """Take the index out of the session's catalog; its files stay."""
        if self.table:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Decide every row of ``docs`` and append the new texts to the index.

        Returns one row per input row: id_col, keep_id, group_size, kept, digest. Of equal texts the
        smallest id stays, unless the index already holds the text: then its row stays and every new
        one goes. Ids may be of any type that sorts and must be of the index's; a null id stays only where
        no row of its text has one. ``group_size`` counts the rows of this call. Null counts as the empty
        text; a text's length does not matter beyond its digest; repeated rows with the same id are all
        kept or all dropped; an empty table gives an empty result; other columns are ignored. A hot text is
        counted in each task before rows move, and its rows are given their decision by a join whose skew
        adaptive execution splits.

        ``batch`` names the call. Texts that the index has from a call of the same name count as new again,
        so a call that died anywhere, even in the midst of its append, can be made again and loses nothing.
        Without a name each call is a batch of its own: then what an earlier call added, this one drops.
        """
        batch = batch or uuid.uuid4().hex
        slim = save(docs.select(F.col(id_col).alias("id"), digest(F.col(text_col).cast("string")).alias("digest")), "digests")
        id_type = slim.schema["id"].dataType.simpleString()
        if self.table is None:
            buckets = self.buckets or buckets_for(slim.count())
            self._open(0, buckets, id_type)
            self._note(0, buckets, id_type)
        elif id_type != self.id_type:
            raise ValueError(f"ids of this index are of type {self.id_type}, not {id_type}")
        groups = save(slim.groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")), "digest-groups")
        fresh = save(groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti"), "new-digests")
        known = groups.join(fresh.select("digest"), "digest", "left_anti")
        decided = fresh.select("digest", F.col("first_id").alias("keep_id"), F.col("n").alias("group_size"), F.lit(False).alias("old"))
        if not known.isEmpty():  # only then is there an id to look up
            index = self.rows().select("digest", "keep_id", (F.col("batch") != batch).alias("old")).hint("merge")
            found = known.select("digest", F.col("n").alias("group_size")).join(index, "digest").select("digest", "keep_id", "group_size", "old")
            decided = decided.unionByName(save(found, "known-digests"))
        self._append(fresh.select("digest", F.col("first_id").alias("keep_id"), F.lit(batch).alias("batch")))
        # a row of another call is none of this call's, whatever its id
        kept = ~F.col("old") & F.col("keep_id").eqNullSafe(F.col("id"))
        return slim.join(decided, "digest").select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "digest")


def exact_dedup(docs: DataFrame, path: str | None = None, batch: str | None = None) -> DataFrame:
    """``docs`` held against the index at ``path``, or against a new one in the shared folder."""
    index = DigestIndex(docs.sparkSession, path or fresh_path(docs.sparkSession, "index"))
    decided = index.add(docs, batch=batch)
    index.close()  # what is decided stands in tables of its own
    return decided
