"""Word and window hashes of whole Arrow text columns, computed with numpy over the raw UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_GOLDEN = U(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D | 1
#: Bytes of text handled at once; a longer text is still handled whole.
SLICE_BYTES = 1 << 21


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the splitmix64 finaliser)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=U) * _GOLDEN)


_powers = np.ones(1, dtype=U)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1024)
        _powers = np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, _BASE, U)]))
    return _powers


def space_table() -> np.ndarray:
    """True for bytes that belong to words under the rule ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def alnum_table() -> np.ndarray:
    """True for ASCII letters and digits and for every byte of a non-ASCII character."""
    table = np.zeros(256, dtype=bool)
    table[0x80:] = True
    for lo, hi in ((48, 58), (65, 91), (97, 123)):
        table[lo:hi] = True
    return table


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, one row at least."""
    row, n = 0, len(off) - 1
    while row < n:
        end = int(np.searchsorted(off, off[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def pieces(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES // 2) -> Iterator[pa.RecordBatch]:
    """A batch in row ranges of about ``limit`` bytes of one text column, so that what is made of them stays small."""
    _, off = text_buffers(batch.column(column))
    for a, b in slices(off, limit):
        yield batch.slice(a, b - a)


class Words:
    """The words of consecutive texts: byte spans, 64-bit hashes, and the words of each text."""

    def __init__(self, data: np.ndarray, off: np.ndarray, table: np.ndarray):
        inside = table[data]
        before = np.empty_like(inside)
        if len(inside):
            before[0] = False
            before[1:] = inside[:-1]
            first = off[:-1][off[:-1] < len(data)]
            before[first] = False
        self.start = np.flatnonzero(inside & ~before)
        #: words of text i are first[i] .. first[i + 1]
        self.first = np.searchsorted(self.start, off).astype(np.int64)
        self.data, self.inside, self.off = data, inside, off

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A polynomial over scrambled bytes, scrambled once more."""
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, U)
        begin = self.start[0]
        spans = np.diff(np.append(self.start, n))
        place = np.arange(begin, n) - np.repeat(self.start, spans)
        values = _byte_values()[self.data[begin:]] * _power_table(int(spans.max()) + 1)[place]
        values[~self.inside[begin:]] = 0
        return mix64(np.add.reduceat(values, self.start - begin))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive entries, by doubling; entry i covers i .. i + k - 1."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U)
    base = int(_BASE)
    out, out_len = None, 0
    level, width = hashes, 1
    rest = k
    while rest:
        if rest & 1:
            if out is None:
                out, out_len = level, width
            else:
                size = n - out_len - width + 1
                out = out[:size] * U(pow(base, width, 1 << 64)) + level[out_len : out_len + size]
                out_len += width
        rest >>= 1
        if rest:
            size = n - 2 * width + 1
            level = level[:size] * U(pow(base, width, 1 << 64)) + level[width : width + size]
            width *= 2
    return mix64(out[: n - k + 1] + U(k))


def window_starts(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """Which of the ``total - k + 1`` rolling windows lie within one text."""
    ok = np.zeros(max(total - k + 1, 0), dtype=bool)
    counts = np.diff(first)
    n = np.maximum(counts - k + 1, 0)
    keep = n > 0
    if keep.any():
        starts, n = first[:-1][keep], n[keep]
        marks = np.zeros(len(ok) + 1, dtype=np.int32)
        np.add.at(marks, starts, 1)
        np.add.at(marks, starts + n, -1)
        ok = np.cumsum(marks[:-1]) > 0
    return ok
