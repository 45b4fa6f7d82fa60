"""Substring dedup by fixed-block anchors.

Every text is cut into non-overlapping blocks of words, which are the reference index; every rolling
window of a block's length probes it. A block that some other place also holds is an anchor. Hits are
extended to both sides: all windows of the wanted length that an anchor can grow into are held against
each other, by 128 bits of hash, and the union of those that occur twice is the set of maximal exact repeats.

A window of 35 words holds a whole 18-word block of its own text, wherever it starts, so each
repeated window has an anchor and none is lost. Hashes travel packed, dealt to parts by their first
bits: many in a row rather than a row each, and those that occur twice among the hashes that a task
holds together are decided there and sent on once, so a passage that every text has is counted in parts. Of a
large corpus there are more parts than a slice of text has hashes for; then hashes are dealt in two steps.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import save, scratch
from threadlens.llm.textarrays import U, Words, mix64, rolling, slices, space_table, text_buffers, window_starts

WINDOW = 35
#: Longest block such that each window holds one that starts at a multiple of it.
BLOCK = (WINDOW + 1) // 2
#: Characters of text for each part that hashes are dealt to, and bytes of text that a slice holds.
PART_CHARS, SLICE = 8_000_000, 1 << 21
#: Bits of the parts of the first step, and bytes of hashes that the second step holds together.
FIRST_BITS, HELD = 12, 1 << 25
#: Bytes sent of an anchor's hash besides its part: anchors are only candidates. Windows are sent whole, with 64 bits more.
ANCHOR_BYTES, WINDOW_BYTES = 5, 8
_OTHER = U(0xA0761D6478BD642F)


class Sent(NamedTuple):
    """Hashes with what asks about them: ``low`` has 64 further bits or is None; ``asks`` says which entries ask,
    the others only count; ``row`` and ``place`` name the asker's text and the place in it."""

    h: np.ndarray
    low: np.ndarray | None
    asks: np.ndarray
    row: np.ndarray
    place: np.ndarray


NAMES = ["part", "decided", "others", "others_low", "hashes", "hashes_low", "rows", "places"]
SENT = "part int, decided boolean, others binary, others_low binary, hashes binary, hashes_low binary, rows array<long>, places array<int>"


def _packed(h: np.ndarray, width: int) -> np.ndarray:
    """The first ``width`` bytes of each hash."""
    return np.ascontiguousarray((h >> U(64 - 8 * width)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def _unpacked(raw: bytes | pa.Buffer, width: int) -> np.ndarray:
    """Hashes whose first ``width`` bytes were packed; the rest is 0."""
    out = np.zeros((len(raw) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, width)
    return out.view("<u8").ravel() << U(64 - 8 * width)


def _joined(column: pa.ChunkedArray | pa.Array) -> bytes:
    return b"".join(x.as_buffer() for x in column if x.is_valid)


def _cells(at: np.ndarray, values: np.ndarray, width: int) -> pa.Array:
    """Binary cells of consecutive packed values, cut at ``at``."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _send(sent: Sent, bits: int, width: int, above: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows for the parts that the hashes fall into by their next ``bits`` bits (``above``: the bits before them): hashes
    that ask with their places, others that only count, and one row of places that are decided already, their
    hashes occurring twice here."""
    if not len(sent.h):
        return
    order = np.argsort(sent.h, kind="stable")
    h, low = sent.h[order], None if sent.low is None else sent.low[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = h[1:] != h[:-1]
    if low is not None:
        unlike = ~first[1:] & (low[1:] != low[:-1])
        if unlike.any():  # 64 bits agree and the others don't: order by both
            order = np.lexsort((sent.low, sent.h))
            h, low = sent.h[order], sent.low[order]
            first[1:] = (h[1:] != h[:-1]) | (low[1:] != low[:-1])
    asks, row, place = sent.asks[order], sent.row[order], sent.place[order]
    single = first.copy()
    single[:-1] &= first[1:]
    own = (h >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), dtype=np.int64)
    rest = h << U(bits)
    index, others, decided = single & asks, first & ~(single & asks), ~single & asks
    counts = [np.bincount(own[m], minlength=1 << bits) for m in (index, others)]
    hit = np.flatnonzero(counts[0] + counts[1])
    at_index, at_others = (np.concatenate([[0], np.cumsum(c[hit])]) for c in counts)
    n = len(hit)
    lows = [pa.array([None] * n, pa.binary())] * 2 if low is None else [_cells(at_others, _packed(low[others], 8), 8), _cells(at_index, _packed(low[index], 8), 8)]
    offsets = pa.array(at_index, pa.int32())
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(hit + (above << bits), pa.int32()), pa.array(np.zeros(n, dtype=bool)),
            _cells(at_others, _packed(rest[others], width), width), lows[0], _cells(at_index, _packed(rest[index], width), width), lows[1],
            pa.ListArray.from_arrays(offsets, pa.array(row[index], pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(place[index], pa.int32())),
        ],
        NAMES,
    )
    if decided.any():
        there, none = pa.array([0, int(decided.sum())], pa.int32()), pa.array([b""], pa.binary())
        anywhere = int(mix64(h[decided][:1])[0] & U((1 << bits) - 1)) + (above << bits)  # any part may pass them on
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([anywhere], pa.int32()), pa.array([True]), none, none, none, none,
                pa.ListArray.from_arrays(there, pa.array(row[decided], pa.int64())), pa.ListArray.from_arrays(there, pa.array(place[decided], pa.int32())),
            ],
            NAMES,
        )


def _received(batch: pa.RecordBatch | pa.Table, width: int, wide: bool) -> Sent:
    """What rows that are not decided hold: those that ask first."""
    asked, others = (_unpacked(_joined(batch.column(c)), width) for c in ("hashes", "others"))
    low = np.concatenate([_unpacked(_joined(batch.column(c)), 8) for c in ("hashes_low", "others_low")]) if wide else None
    flat = lambda c: pa.concat_arrays([x.flatten() for x in batch.column(c).chunks] or [pa.array([], pa.int64())]).to_numpy(zero_copy_only=False)
    zeros = np.zeros(len(others), dtype=np.int64)
    return Sent(np.concatenate([asked, others]), low, np.arange(len(asked) + len(others)) < len(asked), np.concatenate([flat("rows"), zeros]), np.concatenate([flat("places"), zeros]))


def _deal(bits: int, width: int, out_width: int, wide: bool) -> Callable:
    """The second step: parts of the first step are cut into 2**bits, a bounded number of hashes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = defaultdict(list), 0

        def flush() -> Iterator[pa.RecordBatch]:
            for part, rows in held.items():
                yield from _send(_received(pa.Table.from_batches(rows), width, wide), bits, out_width, part)
            held.clear()

        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                part = row.column(0)[0].as_py()
                if row.column(1)[0].as_py():
                    yield pa.RecordBatch.from_arrays([pa.array([part << bits], pa.int32()), *row.columns[1:]], NAMES)
                else:
                    held[part].append(row)
                    size += row.nbytes
                    if size > HELD:
                        yield from flush()
                        size = 0
        yield from flush()

    return run


def _answered(width: int, wide: bool) -> Callable[[pa.Table], pa.Table]:
    """For one part: the places whose hash another place or slice has too."""

    def run(table: pa.Table) -> pa.Table:
        decided = table.column("decided").combine_chunks()
        got = _received(table.filter(pa.compute.invert(decided)), width, wide)
        order = np.argsort(got.h, kind="stable") if got.low is None else np.lexsort((got.low, got.h))
        same = got.h[order][1:] == got.h[order][:-1]
        if got.low is not None:
            same &= got.low[order][1:] == got.low[order][:-1]
        twice = np.zeros(len(order) + 1, dtype=bool)
        twice[1:-1] = same
        live = np.empty(len(order), dtype=bool)
        live[order] = twice[:-1] | twice[1:]
        live &= got.asks
        done = table.filter(decided)
        flat = lambda c, kind: pa.concat_arrays([pa.array([], kind), *(x.flatten() for x in done.column(c).chunks)])
        rows = pa.concat_arrays([pa.array(got.row[live], pa.int64()), flat("rows", pa.int64())])
        places = pa.concat_arrays([pa.array(got.place[live], pa.int32()), flat("places", pa.int32())])
        return pa.table([rows, places], names=["row", "place"])

    return run


def _exchange(rows: DataFrame, send: Callable, bits: int, width: int, wide: bool, label: str, first_bits: int = FIRST_BITS) -> DataFrame:
    """(row, places): places of each text that were confirmed, ascending. ``send(bits, width)`` makes the rows of the first step."""
    first, then = min(bits, first_bits), max(0, bits - first_bits)
    first_width = width if wide else min(8, width + math.ceil(then / 8))
    sent = rows.mapInArrow(send(first, first_width), SENT)
    if then:
        sent = sent.repartition(1 << first, "part").mapInArrow(_deal(then, first_width, width, wide), SENT)
    with scratch(rows.sparkSession):
        answered = save(sent.groupBy("part").applyInArrow(_answered(width, wide), "row long, place int"), label)
        return save(answered.groupBy("row").agg(F.array_sort(F.collect_list("place")).alias("places")), f"{label}-by-text", outlive=1)


def _words(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    data, off = text_buffers(batch.column(1))
    for a, b in slices(off, SLICE):
        words = Words(data[off[a] : off[b]], off[a : b + 1] - off[a], space_table())
        yield a, b, words, words.hashes()


def _blocks(block: int, window: int) -> Callable:
    """Sends each rolling window of a block's length; those at multiples of it, the index, ask."""

    def send(bits: int, width: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                numbers = batch.column(0).to_numpy(zero_copy_only=False)
                for a, _, words, h in _words(batch):
                    probes = rolling(h, block)
                    ok = window_starts(words.first, block, len(h))
                    text = words.text_of_word()[: len(probes)]
                    ok &= (words.counts() >= window)[text]
                    place = np.arange(len(probes)) - words.first[text]
                    yield from _send(Sent(probes[ok], None, (place % block == 0)[ok], numbers[a + text[ok]], (place // block)[ok]), bits, width)

        return run

    return send


def _windows(block: int, window: int) -> Callable:
    """Sends the windows that an anchor of their text grows into. The third column lists a text's anchors by block number."""

    def send(bits: int, width: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                numbers = batch.column(0).to_numpy(zero_copy_only=False)
                for a, b, words, h in _words(batch):
                    hashes, low = rolling(h, window), rolling(mix64(h ^ _OTHER), window)
                    ok = window_starts(words.first, window, len(h))
                    text = words.text_of_word()[: len(hashes)]
                    anchors = batch.column(2).slice(a, b - a)
                    owner = np.repeat(np.arange(b - a), anchors.value_lengths().to_numpy(zero_copy_only=False))
                    start = words.first[owner] + anchors.flatten().to_numpy(zero_copy_only=False).astype(np.int64) * block
                    marks = np.zeros(len(h) + 1, dtype=np.int32)
                    np.add.at(marks, np.maximum(start - (window - block), words.first[owner]), 1)
                    np.add.at(marks, start + 1, -1)
                    ok &= (np.cumsum(marks[:-1]) > 0)[: len(hashes)]
                    place = (np.arange(len(hashes)) - words.first[text])[ok]
                    yield from _send(Sent(hashes[ok], low[ok], np.ones(len(place), dtype=bool), numbers[a + text[ok]], place), bits, width)

        return run

    return send


def kept_words(text: str, places: list[int] | np.ndarray, window: int = WINDOW) -> tuple[int, int, str]:
    """(words, removed words, the kept words joined by one space) of a text whose windows at ``places`` go."""
    words = text.encode("utf-8").split()  # ASCII white space, as in the word rule
    if not len(places):
        return len(words), 0, b" ".join(words).decode("utf-8")
    marks = np.zeros(len(words) + window + 1, dtype=np.int32)
    np.add.at(marks, np.asarray(places), 1)
    np.add.at(marks, np.asarray(places) + window, -1)
    stays = np.cumsum(marks)[: len(words)] == 0
    kept = [words[i] for i in np.flatnonzero(stays)]
    return len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8")


def _cut(window: int, id_name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, begin, rows = 0, 0, []
            for i in range(len(batch)):
                text, places = batch.column(1)[i].as_py() or "", batch.column(2)[i].values
                rows.append(kept_words(text, places.to_numpy() if places is not None else [], window))
                size += len(text)
                if size > SLICE or i == len(batch) - 1:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(begin, len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())],
                        [id_name, "n_words", "n_removed", "kept"],
                    )
                    size, begin, rows = 0, i + 1, []

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, part_chars: int = PART_CHARS, first_bits: int = FIRST_BITS) -> DataFrame:
    """One row per input row: id_col, n_words, n_removed, kept (the words that stay, joined by one space).

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes if it lies in a window of ``window`` words of
    its text whose word sequence starts anywhere else too, in the same text or another; windows are
    judged on the input. Rows are numbered and written first, so ids may be null, shared or of any type.
    Null and empty texts have no words; texts shorter than a window keep all; a very long text is hashed
    as one slice; repeated rows repeat each other and lose their windows; an empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    block = (window + 1) // 2
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = save(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text.alias("text")), "numbered")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(3, math.ceil(math.log2(max(1, chars / part_chars))))
    texts = rows.select("row", "text")
    anchors = _exchange(texts, _blocks(block, window), bits, ANCHOR_BYTES, False, "anchors", first_bits)
    # merge joins at every size: places grow with the texts, so a plan that broadcasts them would not last
    hit = texts.join(anchors.hint("merge"), "row").select("row", "text", "places")
    repeats = _exchange(hit, _windows(block, window), bits, WINDOW_BYTES, True, "windows", first_bits)
    cut = rows.join(repeats.hint("merge"), "row", "left").select("id", "text", "places")
    return cut.mapInArrow(_cut(window, id_col), f"`{id_col}` {id_type}, n_words long, n_removed long, kept string")
