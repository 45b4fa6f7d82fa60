"""Readers: JSON lines, XML history dumps, CSV and TSV archives, lexicons and word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.schemas import REVISION, TALK_NAMESPACES


def read_json_lines(spark: SparkSession, path: str | list[str], schema: str, corrupt: str | None = None) -> DataFrame:
    """JSON lines under a declared schema; with ``corrupt``, unparsable lines land in a column of that name."""
    reader = spark.read
    if corrupt:
        schema = f"{schema}, `{corrupt}` string"
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt)
    return reader.schema(schema).json(path)


def read_revisions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_json_lines(spark, path, REVISION)


_DUMP_PAGE = (
    "title string, ns int, id string, revision array<struct<id:string,timestamp:string,"
    "contributor:struct<username:string,ip:string,id:string>,comment:string,text:string,sha1:string,model:string,format:string>>"
)


def read_dump(spark: SparkSession, path: str | list[str], namespaces: list[int] | None = None) -> DataFrame:
    """Revisions of a page-history dump (XML, also compressed), one row each, talk namespaces only.

    Pages of other namespaces go before their revisions are unfolded. The user is the name or else the
    address. ISO year and week of the timestamp are added; they name the shards that write_by_year makes.
    """
    pages = spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false").schema(_DUMP_PAGE).load(path)
    talk = pages.where(F.col("ns").isin(TALK_NAMESPACES if namespaces is None else namespaces))
    r = talk.select("title", "ns", F.col("id").alias("page_id"), F.explode("revision").alias("r"))
    ts = F.to_timestamp("r.timestamp", "yyyy-MM-dd'T'HH:mm:ssX")
    return r.select(
        "r.comment", "r.sha1", F.col("r.contributor.id").alias("user_id"), F.coalesce("r.contributor.username", "r.contributor.ip").alias("user_text"),
        F.col("r.contributor.ip").alias("user_ip"), "r.timestamp", "r.text", "r.format", "r.model", "page_id", F.col("title").alias("page_title"),
        F.col("ns").cast("string").alias("page_namespace"), F.col("r.id").cast("long").alias("rev_id"), *iso_week(ts),
    )


def iso_week(ts: F.Column) -> list[F.Column]:
    return [F.extract(F.lit("YEAROFWEEK"), ts).cast("int").alias("year"), F.weekofyear(ts).alias("week")]


def read_quoted_csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """CSV with a header and every field quoted; quotes are doubled and fields may hold line feeds."""
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True)


def read_tsv_of_users(spark: SparkSession, path: str | list[str], schema: str, users: DataFrame) -> DataFrame:
    """A tab-separated archive cut to the users in the one-column table ``users``."""
    rows = spark.read.schema(schema).csv(path, sep="\t", header=True)
    return rows.join(users.toDF("_user"), F.col("user") == F.col("_user"), "left_semi")


def read_categories(spark: SparkSession, path: str, codes: list[int]) -> DataFrame:
    """(word, codes) of a dictionary file with lines ``word<TAB>code<TAB>code``: a trailing ``*`` of the
    word goes, and only the wanted codes stay; words without one are dropped."""
    lines = spark.read.text(path).where(F.col("value").contains("\t"))
    parts = F.split("value", "\t")
    entries = lines.select(F.regexp_replace(parts[0], r"\*$", "").alias("word"), F.explode(F.slice(parts, F.lit(2), F.size(parts))).alias("code"))
    wanted = entries.select("word", F.expr("try_cast(code AS int)").alias("code")).where(F.col("code").isin(codes))
    return wanted.groupBy("word").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def read_word_lists(spark: SparkSession, files: dict[str, tuple[str, str]]) -> DataFrame:
    """(category, words) from files of one word a line: ``files`` gives each category's path and encoding."""
    out = None
    for category, (path, encoding) in files.items():
        words = spark.read.option("encoding", encoding).csv(path, schema="word string", sep="\x00", quote="")
        one = words.select(F.lit(category).alias("category"), F.trim("word").alias("word")).where("word <> ''")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("category").agg(F.array_sort(F.collect_set("word")).alias("words"))


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, modified, bytes) of the files under a glob, without reading them."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def list_dumps(files: DataFrame, pattern: str = r"pages-meta-history.*\.bz2$") -> DataFrame:
    """The page-history dumps among files, as ``list_files`` or a status file lists them (path, bytes), in the order of their names."""
    return files.where(F.col("path").rlike(pattern)).orderBy("path")


def read_dump_status(spark: SparkSession, path: str, job: str = "metahistorybz2dump") -> DataFrame:
    """(path, bytes) of the files that a dump's JSON status names for a job."""
    schema = "jobs map<string,struct<files:map<string,struct<size:bigint,url:string>>>>"
    status = spark.read.schema(schema).json(path, multiLine=True)
    files = status.select(F.explode(F.col("jobs")[job]["files"]).alias("name", "f"))
    return files.select(F.coalesce("f.url", "name").alias("path"), F.col("f.size").alias("bytes"))


def scores_of_pages(scores: DataFrame, mapping: DataFrame) -> DataFrame:
    """Sharded score rows with the (conversation, user) that their id stands for."""
    return scores.join(mapping, "id")


def events_from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Recent-change events of a text column; lines that don't parse are dropped."""
    schema = "wiki string, bot boolean, namespace int, title string, user string, comment string, revision struct<old:bigint,new:bigint>"
    return lines.select(F.from_json(column, schema).alias("e")).where("e IS NOT NULL AND e.wiki IS NOT NULL").select("e.*")
