"""Sharding by sampled splitters.

Size-weighted key samples give quantile boundaries, records are range-partitioned by them, overfull
ranges are subdivided, and exact running sizes over the ranges cut the shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from threadlens.llm.common import boxed, save, scratch, unboxed

LEAST_ID = -(1 << 63)
#: Rows that a range is meant to hold, and the most ranges: what the driver holds of a table grows no further.
RANGE_ROWS, MOST_RANGES = 2_000_000, 20_000
#: Rows of a shard that one task writes.
FILE_ROWS = 1_000_000
#: How often overfull ranges are subdivided at most.
SUBDIVISIONS = 3
KEY = ("h", "key_id", "salt")


def _keys(columns: list[np.ndarray]) -> np.ndarray:
    """Tuples of signed 64-bit numbers as strings of bytes that sort as the tuples do."""
    both = np.empty((len(columns[0]), len(columns)), dtype=">u8")
    for i, c in enumerate(columns):
        both[:, i] = np.asarray(c, dtype=np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return both.view(f"S{8 * len(columns)}").ravel()


def _quantiles(keys: np.ndarray, weights: np.ndarray, pieces: int) -> np.ndarray:
    """Boundaries (first keys of the later pieces) that cut a weighted sample into ``pieces`` of equal weight."""
    if not len(keys):
        return keys
    order = np.argsort(keys, kind="stable")
    running = np.cumsum(weights[order])
    at = np.searchsorted(running, running[-1] * np.arange(1, pieces) / pieces) + 1
    return keys[order][at[at < len(keys)]]


def _in_ranges(slim: DataFrame, edges: np.ndarray) -> DataFrame:
    """``slim`` with the number of the range of each record."""
    shared = slim.sparkSession.sparkContext.broadcast(edges)  # MOST_RANGES times the subdivisions at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = _keys([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in KEY])
            r = np.searchsorted(shared.value, key, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r)], [*b.schema.names, "range"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema) + ", range int"
    return slim.mapInArrow(run, schema)


def _drawn(rows: DataFrame, step: float, seed: int) -> DataFrame:
    """A sample in which a row of size s has the chance s / step."""
    u = F.pmod(F.xxhash64(*KEY, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return rows.where(u < F.col("size") / F.lit(step))


def _sample(rows: DataFrame, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, weights and ranges of drawn rows."""
    t = rows.toArrow()
    return _keys([t[c].to_numpy() for c in KEY]), np.maximum(t["size"].to_numpy().astype(np.float64), step), t["range"].to_numpy()


def _id_key(column: Column, kind) -> Column:
    number = column.cast("long") if isinstance(kind, IntegralType) else F.when(column.isNotNull(), F.xxhash64(column.cast("string")))
    return F.coalesce(number, F.lit(LEAST_ID))


def shard_by_bytes(
    docs: DataFrame,
    shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranges_per_shard: int = 20,
    samples_per_range: int = 50,
    overfull: float = 1.5,
    seed: int = 7,
) -> DataFrame:
    """Assign every row to one of ``shards`` shards whose sizes are near equal.

    Returns id_col, size (UTF-8 bytes of the text plus 8), text_crc32, text_hash, shard, slot (gapless
    from 0 in each shard). Keys are (hash of the text, id, number of the row), so equal texts are neighbours;
    a shard ends where its size is reached, inside a group of equal texts as anywhere else, so a hot text
    is spread over as many shards as its bytes ask for. Ranges hold ``RANGE_ROWS`` rows and are
    ``ranges_per_shard`` a shard at least and ``MOST_RANGES`` at most; the driver sees
    ``samples_per_range`` keys of each.

    Ids may be of any type that has a string form. A null text has size 8 and the checksum of the empty
    text; a very long text is one record, so its shard may be larger by it; null ids sort first; repeated
    rows each get a slot, in any order among themselves; an empty table gives an empty result; other
    columns are ignored.
    """
    with scratch(docs.sparkSession):
        return _shard_by_bytes(docs, shards, id_col, text_col, ranges_per_shard, samples_per_range, overfull, seed)


def _shard_by_bytes(docs: DataFrame, shards: int, id_col: str, text_col: str, ranges_per_shard: int, samples_per_range: int, overfull: float, seed: int) -> DataFrame:
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = save(
        docs.select(
            F.col(id_col).alias("id"),
            _id_key(F.col(id_col), docs.schema[id_col].dataType).alias("key_id"),
            F.xxhash64(text).alias("h"),
            (F.octet_length(text).cast("long") + 8).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("crc"),
            F.xxhash64(F.monotonically_increasing_id()).alias("salt"),  # only repeated rows meet it
        ),
        "sizes",
    )
    sums = slim.agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).first()
    total = sums["size"] or 0
    ranges = max(shards * ranges_per_shard, min(MOST_RANGES, math.ceil(sums["rows"] / RANGE_ROWS)))
    step = max(total / (ranges * samples_per_range), 1e-9)
    keys, weights, _ = _sample(_drawn(slim, step, seed).select(*KEY, "size", F.lit(0).alias("range")), step)
    edges = np.unique(_quantiles(keys, weights, ranges))
    fair = total / ranges
    for attempt in range(SUBDIVISIONS + 1):
        ranged = save(_in_ranges(slim, edges), "ranged")
        full = {r["range"]: (r["size"], r["n"]) for r in ranged.groupBy("range").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()}
        over = {r: math.ceil(size / fair) for r, (size, n) in full.items() if size > overfull * fair and n > 1}
        if not over or attempt == SUBDIVISIONS:
            break
        fine = fair / samples_per_range
        keys, weights, of = _sample(_drawn(ranged.where(F.col("range").isin(list(over))), fine, seed + attempt + 1).select(*KEY, "size", "range"), fine)
        more = [_quantiles(keys[of == r], weights[of == r], pieces) for r, pieces in over.items()]
        finer = np.unique(np.concatenate([edges, *more]))
        if len(finer) == len(edges):
            break
        edges = finer

    offsets, size_before, rows_before = [], 0, 0
    for r in sorted(full):
        offsets.append((r, size_before, rows_before))
        size_before, rows_before = size_before + full[r][0], rows_before + full[r][1]
    before = spark.createDataFrame(offsets or [(0, 0, 0)], "range int, size_before long, rows_before long")
    in_range = Window.partitionBy("range").orderBy(*KEY)
    running = in_range.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.select("*", F.sum("size").over(running).alias("to_here"), F.row_number().over(in_range).alias("rn")).join(
        F.broadcast(before), "range"
    )  # as many rows as ranges
    middle = 2 * (F.col("size_before") + F.col("to_here")) - F.col("size")
    placed = save(
        placed.select(
            "id", "h", "size", "crc",
            F.least(F.floor(middle * shards / F.lit(max(2 * total, 1))), F.lit(shards - 1)).cast("int").alias("shard"),
            (F.col("rows_before") + F.col("rn") - 1).alias("place"),
        ),
        "placed",
        outlive=1,
    )
    starts = {r.shard: r.start for r in placed.groupBy("shard").agg(F.min("place").alias("start")).collect()}
    start = F.element_at(F.array(*[F.lit(starts.get(s, 0)).cast("long") for s in range(shards)]), F.col("shard") + 1)
    return placed.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("h").alias("text_hash"), "shard", (F.col("place") - start).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", **options) -> None:
    """Write ``docs`` as Parquet, one folder ``shard=N`` for each shard that has rows, rows in slot order.

    Rows are numbered first and meet their shard by number, so null and repeated ids, null texts and
    repeated rows are written once each. The column ``shard`` is added (a column of ``docs`` of that name is
    refused); an empty table writes no folder.
    """
    if "shard" in {c.lower() for c in docs.columns}:
        raise ValueError("shard is a column of the result")
    rows = save(boxed(docs, number=F.monotonically_increasing_id()), "numbered")
    slim = rows.select("number", F.col("row").getField(text_col).alias("text"))
    placed = shard_by_bytes(slim, shards, id_col="number", text_col="text", **options).select(F.col("number").alias("_number"), "shard", "slot")
    joined = rows.join(placed, F.col("number") == F.col("_number"))
    dealt = joined.repartition("shard", F.floor(F.col("slot") / FILE_ROWS)).sortWithinPartitions("shard", "slot")
    dealt.select(*unboxed(dealt, docs.columns), "shard").write.partitionBy("shard").parquet(path)
