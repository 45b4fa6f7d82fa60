"""From raw documents to token ids in five stages, each over all that the one before it kept.

Every stage but the last returns the columns of its input, whatever further columns there are and whatever
their names, and an empty table for an empty one. Repeated rows are rows like others but to near-dedup,
which keeps one of them. Whole texts are read, very long ones as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm import bpe, langid, line_dedup, mixing, probminhash
from threadlens.llm.common import documents, save, scratch, unboxed

#: Texts whose n-grams are further than this from every language's profile (1: as the profile) are no language.
LEAST_SCORE = 0.2

ORACLE_SQL = None  # MinHash classes and BPE merges have no SQL form; tests/llm holds run() against brute force


def _n_chars(text: Column) -> Column:
    return F.length(text).cast("long")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that are in no known language: null, empty, without a letter, or far from every profile.

    Ties between languages do not matter here; where no row is labelled there is no language and every row goes.
    """
    return langid.in_known_language(docs, langid.fit(docs.where(~langid.held_out())), LEAST_SCORE)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut lines that repeat an earlier one; a document whose every line goes, goes.

    Null and empty texts stay as they are; of equal lines the one of the least (doc_id, line number) stays, null ids first.
    """
    with scratch(spark):
        cut = line_dedup.LineDecisions(docs).cut()
    left = cut.where(~(F.col("changed") & (F.coalesce("kept", F.lit("")) == "")))
    text = F.when(F.col("changed"), F.col("kept")).otherwise(F.col("row").getField("text"))
    return left.select(*unboxed(left, docs.columns, text=text, n_chars=_n_chars(text)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each class of near-duplicates, by doc_id, a null one last.

    Null and wordless texts are classes of their own and stay.
    """
    with scratch(spark):
        return probminhash.NearDuplicates(docs).kept_rows()


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and cut documents so that the sources' words meet their target weights.

    Texts without a word, null ones among them, add nothing to a mix and go; a null source is a source.
    """
    mixed = mixing.Mix(docs, whole=True).texts()
    return mixed.select(*[_n_chars(F.col("text")).alias(c) if c == "n_chars" else mixed[f"`{c}`"] for c in docs.columns])


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with their digest and that of the decoded text; null counts as the empty text."""
    coded = bpe.encode_decode(docs, keep=("lang", "source"))
    sha = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    return coded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"),
        sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe", bpe_encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
