"""I-Match fingerprints with randomised lexicon subsets.

Terms within a band of inverse document frequency form the lexicon. A document's distinct lexicon
terms, sorted, are intersected with many random subsets of the lexicon, and each intersection is
hashed. Subsets come in levels: level l holds about one term in 2**l, so that documents of any length
have levels at which an intersection is a term or two, and a partial edit leaves some hashes alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import save
from threadlens.llm.textarrays import SLICE_BYTES, U, Words, alnum_table, mix64, pieces, slices

#: Terms of the lexicon occur in at least and at most these shares of all documents (idf from 2.3 to 6.9).
#: A corpus with d distinct terms a document on average has d / LEAST_SHARE such terms at most, whatever its size.
LEAST_SHARE, MOST_SHARE = 0.001, 0.1
SUBSETS = 16
LEVELS = 20
SHOWN = 3
#: Characters for each range that neighbours are looked for in, and the most ranges, which is what the driver holds a number of.
RANGE_CHARS, MOST_RANGES = 8_000_000, 20_000


def _distinct_terms(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) pairs, each once."""
    text = words.text_of_word()
    order = np.lexsort((text, hashes))
    t, h = text[order], hashes[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return t[new], h[new]


def lower_words(texts: list[str | None]) -> Words:
    """The words of texts in lower case, as Python lowers them: terms are counted and looked up alike."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return Words(np.frombuffer(b"".join(raw), dtype=np.uint8), off, alnum_table())


def document_frequencies(texts: DataFrame) -> DataFrame:
    """(term, df) over all rows of a one-column table of texts. Terms are 64-bit hashes of words in lower case;
    each task sums its own before rows move."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        terms, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return terms, np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(terms)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            terms, n = merged(parts)
            for i in range(0, len(terms), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(terms[i : i + 100_000].view(np.int64)), pa.array(n[i : i + 100_000])], ["term", "n"])

        for batch in batches:
            for piece in pieces(batch, 0):
                words = lower_words(piece.column(0).to_pylist())
                _, h = _distinct_terms(words, words.hashes())
                terms, n = np.unique(h, return_counts=True)
                parts.append((terms, n))
                held += len(terms)
                if held > 1_500_000:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
                    if held > 1_000_000:
                        yield from out()
                        parts, held = [], 0
        if parts:
            yield from out()

    return texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


class Lexicon:
    """Lexicon terms with, for each of the random subset families, a term's level and scrambled value."""

    def __init__(self, terms: np.ndarray, seed: int = 1):
        self.terms = np.sort(terms.astype(np.int64).view(U))
        bits = max(16, math.ceil(math.log2(16 * len(self.terms) + 1)))
        self.mask = U((1 << bits) - 1)
        self.maybe = np.zeros(1 << bits, dtype=bool)
        self.maybe[self.terms & self.mask] = True
        self.level = np.zeros((SUBSETS, len(self.terms)), dtype=np.int64)
        self.value = np.zeros((SUBSETS, len(self.terms)), dtype=U)
        for j in range(SUBSETS):
            x = mix64(self.terms + U((seed * 1000003 + j * 7919) % (1 << 63)))
            low = x & (~x + U(1))  # lowest set bit
            self.level[j] = np.minimum(np.log2(np.maximum(low, U(1)).astype(np.float64)).astype(np.int64), LEVELS - 1)
            self.value[j] = mix64(x) | U(1)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are terms, and their numbers."""
        at = np.flatnonzero(self.maybe[hashes & self.mask])
        if not len(self.terms) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = np.searchsorted(self.terms, hashes[at])
        n[n == len(self.terms)] = 0
        ok = self.terms[n] == hashes[at]
        return at[ok], n[ok]


class Fingerprints:
    """Fingerprints of consecutive texts: hashes[text, subset, level], 0 for an empty intersection."""

    def __init__(self, texts: list[str], lexicon: Lexicon):
        words = lower_words(texts)
        hashes, text = words.hashes(), words.text_of_word()
        at, number = lexicon.find(hashes)
        pairs = np.unique(text[at] * np.int64(max(len(lexicon.terms), 1)) + number)  # sorted distinct terms of each text
        text_of, number = np.divmod(pairs, max(len(lexicon.terms), 1))
        self.n = np.bincount(text_of, minlength=len(texts))
        own = np.zeros((len(texts), SUBSETS, LEVELS), dtype=U)
        for j in range(SUBSETS):
            np.add.at(own[:, j, :], (text_of, lexicon.level[j][number]), lexicon.value[j][number])
        # subset l of a family has the terms of level l and above
        self.hashes = mix64(np.cumsum(own[:, :, ::-1], axis=2, dtype=U)[:, :, ::-1])
        self.hashes[np.cumsum(own[:, :, ::-1] != 0, axis=2)[:, :, ::-1] == 0] = 0
        self.low = np.clip(np.floor(np.log2(np.maximum(self.n, 1))).astype(np.int64) - 1, 0, LEVELS - SHOWN)
        self.bare = {}
        for i in np.flatnonzero(self.n == 0):  # no term within the band: all its distinct words count
            self.bare[int(i)] = int(mix64(np.array([np.add.reduce(np.unique(hashes[words.first[i] : words.first[i + 1]]), dtype=U)], dtype=U))[0])

        #: 16 bits of each hash, 0 for an empty intersection only
        self.short = np.where(self.hashes == 0, 0, np.maximum(self.hashes >> U(48), U(1))).astype(np.uint16)

    def shown(self, i: int) -> str:
        """The fingerprint: the first level shown, then the hashes of ``SHOWN`` levels of each subset family."""
        if i in self.bare:
            return f"w:{self.bare[i]:016x}"
        low = int(self.low[i])
        return f"{low}:" + self.short[i, :, low : low + SHOWN].astype(">u2").tobytes().hex()

    def likeness(self, a: int, b: int) -> float:
        """``likeness`` of the two fingerprints."""
        if a in self.bare or b in self.bare:
            return float(self.bare.get(a, -1) == self.bare.get(b, -2))
        low, high = max(self.low[a], self.low[b]), min(self.low[a], self.low[b]) + SHOWN
        return _alike(self.short[a, :, low:high], self.short[b, :, low:high])


def _alike(x: np.ndarray, y: np.ndarray) -> float:
    either = int(((x | y) != 0).sum())
    return float((x[x != 0] == y[x != 0]).sum() / either) if either else 0.0


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints as shown, 0 to 1: of the subsets at levels that both show and that hold a
    term of either text, the share with equal hashes; of texts without a lexicon term, whether they are equal."""
    (first, x), (second, y) = a.split(":"), b.split(":")
    if "w" in (first, second):
        return float(a == b)
    low, high = max(int(first), int(second)), min(int(first), int(second)) + SHOWN
    cells = [np.frombuffer(bytes.fromhex(z), dtype=">u2").reshape(-1, SHOWN) for z in (x, y)]
    return _alike(*(c[:, low - int(at) : max(high, low) - int(at)] for c, at in zip(cells, (first, second), strict=True)))


def edited(text: str, after: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many (or all) of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _compare(texts: list[str], nexts: list[str] | None, lexicon: Lexicon) -> list[tuple]:
    """Results for each text: ``nexts`` gives the document after each, or else it is the next in ``texts``, whose last one gets none."""
    chain = nexts is None
    pairs = list(zip(texts, texts[1:] if chain else nexts, strict=False))
    changed = [edited(a, b) for a, b in pairs]
    n = len(pairs)
    prints = Fingerprints([*(texts if chain else [*texts, *nexts]), *changed], lexicon)
    first_changed = len(texts) if chain else 2 * n
    return [
        (len(pairs[i][0]), changed[i], prints.shown(i), prints.shown(first_changed + i), prints.likeness(i, first_changed + i), prints.likeness(i, i + 1 if chain else n + i))
        for i in range(n)
    ]


def _parts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    return slices(np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64) + 200)]), SLICE_BYTES // 4)


def fit_lexicon(docs: DataFrame, text_col: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> Lexicon:
    """The lexicon over all rows of ``docs``."""
    n = docs.count()
    df = document_frequencies(docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    band = save(df.where((F.col("df") >= max(2, least * n)) & (F.col("df") <= max(2, most * n))).select("term"), "lexicon")
    terms = band.toPandas()["term"].to_numpy()
    return Lexicon(terms)


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lexicon: Lexicon | None = None) -> DataFrame:
    """One row per input row, with its fingerprint, that of its edited text, and their likenesses.

    Returns id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; the
    likenesses are those of the fingerprints returned. Documents follow each other by id, null ids first, rows that share an id by a hash of their
    texts; the first follows the last. Null counts as the empty text; equal texts have equal fingerprints; a text
    without a lexicon term gets a hash of all its distinct words; repeated rows stand next to each other; a
    very long text is fingerprinted whole with the text after it; an empty table gives an empty result; other
    columns are ignored, whatever their names.

    Rows are range-partitioned by id and text hash once and compared while they stream past in order, a slice at a time. The first and
    last row of each range are kept aside and meet their neighbours by a join on the range's number.
    """
    spark = docs.sparkSession
    lexicon = lexicon or fit_lexicon(docs, text_col)
    shared = spark.sparkContext.broadcast(lexicon)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, max(1, math.ceil(chars / RANGE_CHARS)))
    names = ["range", "part", "id", "text", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def record(range_no: int, part: str, ids: list, texts: list, results: list[tuple], kind) -> pa.RecordBatch:
        import hashlib

        r = [(a, hashlib.sha256(b.encode("utf-8", "surrogatepass")).hexdigest(), *c) for a, b, *c in results] or [(None,) * 6] * len(ids)
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        columns = [pa.array([range_no] * len(ids), pa.int32()), pa.array([part] * len(ids), pa.string()), pa.array(ids, kind), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array([x[k] for x in r], t) for k, t in enumerate(types))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        range_no, carried = TaskContext.get().partitionId(), None
        kind = None
        for batch in (p for whole in batches for p in pieces(whole, 1)):
            kind = batch.column(0).type
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if carried is None:
                yield record(range_no, "first", ids[:1], texts[:1], [], kind)
            else:
                ids.insert(0, carried[0])
                texts.insert(0, carried[1])
            for a, b in _parts([len(t) for t in texts[:-1]]):
                results = _compare(texts[a : b + 1], None, shared.value)
                yield record(range_no, "row", ids[a:b], [None] * (b - a), results, kind)
            carried = ids[-1], texts[-1]
        if carried is not None:
            yield record(range_no, "last", [carried[0]], [carried[1]], [], kind)

    def join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                i, text, after = (batch.column(c)[k].as_py() for c in range(3))
                yield record(0, "row", [i], [None], _compare([text], [after], shared.value), batch.column(0).type)

    schema = f"range int, part string, id {id_type}, text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    seen = save(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(run, schema), "fingerprints")
    first, last = seen.where("part = 'first'"), seen.where("part = 'last'")
    numbers = sorted(r[0] for r in first.select("range").collect())  # one for each range
    after = spark.createDataFrame(list(zip(numbers, numbers[1:] + numbers[:1], strict=True)), "range int, after int")
    ends = (
        last.select("range", "id", "text")
        .join(after, "range")
        .join(first.select(F.col("range").alias("after"), F.col("text").alias("after_text")), "after")
        .select("id", "text", "after_text")
        .mapInArrow(join_ends, schema)
    )
    return seen.where("part = 'row'").unionByName(ends).select(F.col("id").alias(id_col), *names[4:])
