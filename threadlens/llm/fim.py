"""Fill-in-the-middle: texts cut in three at pseudorandom places and put in another order.

A text becomes an array of code points (UTF-32); units begin where the classes of neighbouring code points
differ; two ranks among the units' ends, drawn from a hash of the id, say where prefix and middle end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.textarrays import pieces

#: A text that holds one of these stays plain, so that every output can be taken apart again.
TAGS = ("<P>", "<S>", "<M>")
_TAG = r"<[PSM]>"
UNITS = ("char", "word", "line")
PLAIN, PSM, SPM = "plain", "psm", "spm"


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """0 for white space, 1 for letters and digits, 2 for anything else, by code point."""
    kind = lambda c: 0 if c.isspace() else 1 if c.isalnum() else 2
    return np.fromiter((kind(chr(c)) for c in range(0x110000)), dtype=np.uint8, count=0x110000)


def classes(points: np.ndarray, unit: str) -> np.ndarray:
    """A class for each code point: ``char`` gives each its own, ``word`` its kind, ``line`` the number of its line."""
    if unit == "char":
        return np.arange(len(points), dtype=np.int64)
    if unit == "word":
        return _kinds()[points]
    ended = np.cumsum(points == 0x0A)
    return np.concatenate([[0], ended[:-1]]) if len(points) else ended


def unit_ends(points: np.ndarray, unit: str) -> np.ndarray:
    """Ends of 0, 1, 2, ... units; the last is the text's length."""
    of = classes(points, unit)
    inner = np.flatnonzero(of[1:] != of[:-1]) + 1
    return np.concatenate([[0], inner, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def _cut(text: str, h: tuple[int, int, int, int], unit: str, fim_percent: int, spm_percent: int) -> tuple:
    """(units, form, code points of prefix and of middle, output) of one text."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    ends = unit_ends(points, unit)
    n = len(ends) - 1
    if not text or h[2] % 100 >= fim_percent or any(t in text for t in TAGS):
        return n, PLAIN, None, None, text
    ranks = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (int(x) for x in ends[ranks])
    prefix, middle, suffix = (p.tobytes().decode("utf-32-le") for p in (points[:a], points[a:b], points[b:]))
    if h[3] % 100 < spm_percent:
        return n, SPM, a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, PSM, a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", fim_percent: int = 90, spm_percent: int = 20, seed: int = 1) -> DataFrame:
    """One row per input row: id_col, n (units), form, prefix_chars, middle_chars, output.

    The four draws are the first 8-digit groups of the hex SHA-256 of ``seed:id``, so a row's cut depends
    on its id and text alone, whatever the partitions, and reruns agree. ``unit`` is one of ``UNITS``.

    A null text counts as empty; an empty text, and one that holds a tag, stays plain. A null id draws as
    the empty string; rows of one id draw alike, so repeated rows get equal answers. Very long texts are
    cut whole, a slice of rows at a time (a text takes four bytes a code point meanwhile). Ties cannot
    arise: where both ranks are the same the middle is empty. An empty table gives an empty result; other
    columns are ignored.
    """
    if unit not in UNITS:
        raise ValueError(f"unit: one of {', '.join(UNITS)}")
    hashed = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), "UTF-8"), 256)
    draws = [F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    sent = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.array(*draws).alias("draws"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            for b in pieces(batch, 1):
                rows = [_cut(t, h, unit, fim_percent, spm_percent) for t, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
                made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([b.column(0), *made], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = sent.schema["id"].dataType.simpleString()
    cut = sent.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return cut.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No piece holds a tag, and no tag can begin in a piece and end
    in a tag (no tag's end is another's beginning), so the tags cut the output into exactly its pieces."""
    part = F.split(output, _TAG, -1)
    psm = F.concat(part[1], part[3], part[2])
    spm = F.concat(part[2], part[3], part[1])
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)
