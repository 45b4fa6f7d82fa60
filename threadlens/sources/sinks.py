"""Writers: year shards, typed and validated inserts, idempotent appends, quoted CSV, and run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def write_by_year(revisions: DataFrame, path: str) -> None:
    revisions.write.partitionBy("year").mode("append").json(path)


def write_json_batches(df: DataFrame, path: str, rows: int = 100_000) -> None:
    df.write.option("maxRecordsPerFile", rows).json(path)


def write_quoted_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, quoteAll=True, escape='"')


def typed(df: DataFrame, columns: dict[str, str], falsy_to_null: bool = False) -> DataFrame:
    """``df`` under a column configuration: STRING, BYTES (base64 of UTF-8), FLOAT, INT, BOOL, TIMESTAMP or
    ARRAY(one of these). A column that ``df`` lacks becomes null; another kind is an error.
    ``falsy_to_null`` also nulls 0, false and the empty string, as some stores' loaders do."""
    simple = {"STRING": "string", "FLOAT": "double", "INT": "bigint", "BOOL": "boolean", "TIMESTAMP": "timestamp"}

    def one(name: str, kind: str) -> Column:
        array = kind.startswith("ARRAY(")
        inner = kind[6:-1] if array else kind
        if inner not in simple and inner != "BYTES":
            raise ValueError(f"no such column kind: {kind}")
        if name not in df.columns:
            return F.lit(None).cast(f"array<{simple.get(inner, 'string')}>" if array else simple.get(inner, "string")).alias(name)
        c = F.col(name)
        if inner == "BYTES":
            value = F.transform(c, lambda x: F.base64(F.encode(x, "UTF-8"))) if array else F.base64(F.encode(c, "UTF-8"))
        else:
            value = c.cast(f"array<{simple[inner]}>" if array else simple[inner])
        if falsy_to_null and not array:
            empty = {"STRING": value == "", "FLOAT": value == 0, "INT": value == 0, "BOOL": ~value}.get(inner)
            value = value if empty is None else F.when(~empty, value)
        return value.alias(name)

    return df.select(*[one(n, k) for n, k in columns.items()])


def valid_rows(df: DataFrame, required: list[str]) -> DataFrame:
    """Rows in which no required field is null or empty."""
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    return df.where(ok)


def new_rows(df: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """One row of each key that ``existing`` lacks: an insert that ignores what is there already."""
    order = Window.partitionBy(*key).orderBy(F.xxhash64(*df.columns))
    once = df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return once.join(existing.select(*key), key, "left_anti")


def published(actions: DataFrame) -> DataFrame:
    """The sixteen columns in order, authors flattened to ``uid:name`` (nulls: ANONYMOUS)."""
    from pyspark.sql.types import StructType

    from threadlens.schemas import ACTION

    label = lambda a: F.concat_ws(":", F.coalesce(a["user_id"], F.lit("ANONYMOUS")), F.coalesce(a["user_text"], F.lit("ANONYMOUS")))
    have = {f.name for f in actions.schema}
    columns = []
    for f in StructType.fromDDL(ACTION):
        if f.name == "authors" and f.name in have:
            columns.append(F.transform("authors", label).alias("authors"))
        else:
            columns.append((F.col(f.name) if f.name in have else F.lit(None)).cast("array<string>" if f.name == "authors" else f.dataType).alias(f.name))
    return actions.select(*columns)


def safe_names(df: DataFrame) -> DataFrame:
    """Colons in column names become underscores."""
    return df.toDF(*[c.replace(":", "_") for c in df.columns])


def without_prefix(df: DataFrame, n: int = 2) -> DataFrame:
    return df.toDF(*[c[n:] for c in df.columns])


def observed(df: DataFrame, name: str, time_column: str) -> tuple[DataFrame, Observation]:
    """``df`` with a log row of its run, filled in once it has been written: rows added, first and last time."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows_added"), F.min(time_column).alias("start_time"), F.max(time_column).alias("end_time")), seen


def gold_json(df: DataFrame, answer: str, order: str) -> DataFrame:
    """Annotation rows as JSON documents: sequential id_N by ``order``, the other columns, and the gold answer in the two
    fields ``answer`` and ``gold``. A column ``id`` gives way to the sequential one."""
    n = F.row_number().over(Window.orderBy(order))  # gold questions are a hand-made list
    rest = [c for c in df.columns if c not in ("id", "answer", "gold")]
    numbered = df.select(F.concat(F.lit("id_"), n).alias("id"), F.col(answer).alias("answer"), F.col(answer).alias("gold"), *rest)
    return numbered.select(F.to_json(F.struct("*")).alias("value"))


def write_by_key(df: DataFrame, path: str, key: str, shards: int | None = None) -> None:
    """One folder for each value of a key, its rows together; with ``shards``, so many folders at most.

    A folder for each of many keys with few rows costs more than the rows. With ``shards`` keys are dealt to folders
    ``key_shard=N`` by a hash, and a key's rows lie side by side in one file, where ``key_rows`` finds them.
    """
    if shards is None:
        df.repartition(key).write.partitionBy(key).mode("append").json(path)
        return
    dealt = df.withColumn("key_shard", F.pmod(F.xxhash64(key), F.lit(shards)))
    dealt.repartition("key_shard").sortWithinPartitions("key_shard", key).write.partitionBy("key_shard").mode("append").json(path)


def key_rows(spark: SparkSession, path: str, schema: str, key: str, value: Column, shards: int) -> DataFrame:
    """The rows of one key that ``write_by_key`` dealt to ``shards``, from its folder alone; ``value`` has the type of the key."""
    rows = spark.read.schema(f"{schema}, key_shard bigint").json(path)
    return rows.where((F.col("key_shard") == F.pmod(F.xxhash64(value), F.lit(shards))) & F.col(key).eqNullSafe(value)).drop("key_shard")


def chunk_number(key: list[Column], size: int) -> Column:
    """The number of the chunk of ``size`` rows, in the order of ``key`` within a partition column that callers put first."""
    return F.floor((F.row_number().over(Window.partitionBy(key[0]).orderBy(*key[1:])) - 1) / size).cast("long")
