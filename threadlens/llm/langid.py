"""Language identification by rank-order n-gram profiles.

A language's profile ranks its most frequent n-grams of one to three letters; a document goes to the
language whose ranks are least out of place against its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlens.llm.common import save
from threadlens.llm.textarrays import pieces

UNKNOWN = "und"
#: n-grams of a profile.
PROFILE = 400
#: n-grams of a document that are compared.
COMPARED = 300
#: Labelled documents that a language's profile is made from, about; which ones, a hash decides.
FIT_ROWS = 2000
_BITS = 21
_SPACE = 0x20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def ngram_codes(text: str) -> np.ndarray:
    """Codes of all 1- to 3-grams of a text's words, each word bounded by a space; no code spans two words."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each word
    s = np.full(int(keep.sum()) + 2, _SPACE, dtype=np.int64)
    s[1:-1] = np.where(letter, points, _SPACE)[keep]
    two = s[:-1] << _BITS | s[1:]
    three = two[:-1] << _BITS | s[2:]
    return np.concatenate([s[s != _SPACE], two[(s[:-1] != _SPACE) | (s[1:] != _SPACE)], three[s[1:-1] != _SPACE]])


def top_ngrams(text: str, k: int) -> np.ndarray:
    """The ``k`` most frequent n-gram codes in rank order; ties by code."""
    codes, counts = np.unique(ngram_codes(text), return_counts=True)
    return codes[np.argsort(-counts, kind="stable")[:k]]


class Profiles:
    """Ranks of each language's n-grams, as one table over all codes."""

    def __init__(self, ranked: dict[str, list[int]], size: int = PROFILE):
        self.languages, self.size = sorted(ranked), size
        self.codes = np.array(sorted({c for v in ranked.values() for c in v}), dtype=np.int64)
        self.ranks = np.full((len(self.codes) + 1, len(self.languages)), -1, dtype=np.int64)
        for n, language in enumerate(self.languages):
            for rank, code in enumerate(ranked[language][:size]):
                self.ranks[np.searchsorted(self.codes, code), n] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score is 1 at no distance and 0 at the greatest possible one. A text
        without a letter, or a model without a language, gives (und, 0); ties go to the first by name."""
        top = top_ngrams(text or "", COMPARED)
        if not len(top) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, top)
        at[at == len(self.codes)] = 0
        found = self.codes[at] == top
        ranks = np.where(found[:, None], self.ranks[at], -1)
        apart = np.where(ranks >= 0, np.minimum(np.abs(ranks - np.arange(len(top))[:, None]), self.size), self.size).sum(axis=0)
        best = int(np.argmin(apart))
        return self.languages[best], float(1 - apart[best] / (len(top) * self.size))


def chosen_rows(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS) -> DataFrame:
    """(lang, text): about ``rows`` labelled documents of each language (all, where it has fewer), chosen by a
    hash of the id, or of the text where the id is null."""
    labelled = labelled.where(F.col(lang_col).isNotNull())
    n = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}  # a row for each language
    share = F.create_map(*[F.lit(x) for k, v in (n or {"": 1}).items() for x in (k, min(1.0, rows / v))])
    text = F.col(text_col).cast("string")
    u = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), text), F.lit(11)), F.lit(1 << 40)) / float(1 << 40)
    return labelled.where(u < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), text.alias("text"))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS, size: int = PROFILE) -> Profiles:
    """Profiles from about ``rows`` labelled documents of each language (``FIT_ROWS`` is the bound of the sample).

    Rows without label or text teach nothing; n-grams as frequent as each other rank by code; repeated rows
    count each; an empty table gives a model without languages; other columns are ignored.
    """
    chosen = chosen_rows(labelled, id_col, text_col, lang_col, rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, 1):
                langs, texts = np.array(b.column(0).to_pylist(), dtype=object), b.column(1).to_pylist()
                for lang in sorted(set(langs)):
                    parts = [ngram_codes(texts[i]) for i in np.flatnonzero(langs == lang) if texts[i]]
                    codes, counts = np.unique(np.concatenate([*parts, np.zeros(0, np.int64)]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts.astype(np.int64))], ["lang", "code", "n"])

    counted = save(chosen.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "ngrams")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top = counted.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "rank", "code").collect()  # ``size`` rows a language
    ranked: dict[str, list[int]] = {}
    for r in sorted(top):
        ranked.setdefault(r.lang, []).append(r.code)
    return Profiles(ranked, size)


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, lang_pred and score, from the text alone.

    Null, empty or letterless texts give ``und`` and score 0; languages equally far go to the first by
    name; repeated rows get equal answers; whole texts are read, a slice of rows at a time; an empty table
    gives an empty result; other columns are ignored. The model is broadcast: a few hundred n-grams for
    each language.
    """
    model = docs.sparkSession.sparkContext.broadcast(profiles)
    sent = docs.select(F.col(id_col), F.col(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, 1):
                said = [model.value.predict(t) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())], [id_col, "lang_pred", "score"])

    return sent.mapInArrow(run, f"`{id_col}` {sent.schema[0].dataType.simpleString()}, lang_pred string, score double")


def in_known_language(docs: DataFrame, profiles: Profiles, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, whose text is in a language of the model with a score of ``least`` or more.

    Null, empty and letterless texts go, as do texts far from every profile; nothing is added to a row,
    so that no column can clash; repeated rows fare alike; an empty table gives an empty result.
    """
    model, at = docs.sparkSession.sparkContext.broadcast(profiles), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, at):
                said = (model.value.predict(t) for t in b.column(at).to_pylist())
                yield b.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in said], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 5 == 0
