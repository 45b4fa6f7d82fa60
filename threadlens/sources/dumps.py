"""A reader of page-history dumps that splits files, streams revisions, and holds one revision at a time.

A bz2 file is cut at the 48-bit marks with which its blocks begin, wherever they stand among the bits; each
block is decompressed as a stream of its own. A task skips to the first ``<page>`` of its blocks and reads on
past their end until its last page is over.
"""

from __future__ import annotations

import bz2
import uuid
from collections.abc import Iterator
from itertools import chain
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from threadlens.schemas import TALK_NAMESPACES
from threadlens.sources.readers import iso_week
from threadlens.sources.shared import files_under, located

# Fixed values of the bz2 format: the marks of a block and of the end of a stream.
BLOCK_MARK, END_MARK = 0x314159265359, 0x177245385090
#: Compressed bytes that a task owns, bytes read at once, and bytes of text put into one Arrow batch.
SPLIT_BYTES, CHUNK, BATCH_BYTES = 32 << 20, 1 << 20, 4 << 20
#: Bytes that opening a file counts for where small files are put into one task.
OPEN_BYTES = 1 << 20
PAGE, PAGE_END, REVISION, REVISION_END = b"<page>", b"</page>", b"<revision>", b"</revision>"
ROW = "comment string, sha1 string, user_id string, user_text string, user_ip string, timestamp string, text string, format string, model string, page_id string, page_title string, page_namespace string, rev_id bigint"


def _marks(data: bytes, mark: int) -> list[int]:
    """Bit offsets at which a 48-bit mark begins."""
    raw, wanted, found = np.frombuffer(data, dtype=np.uint8).astype(np.uint16), mark.to_bytes(6, "big"), []
    after = np.append(raw[1:], 0)
    for shift in range(8):
        turned = ((raw << shift) | (after >> (8 - shift))).astype(np.uint8).tobytes() if shift else data
        at = turned.find(wanted)
        while at >= 0:
            if 8 * at + shift + 48 <= 8 * len(data):
                found.append(8 * at + shift)
            at = turned.find(wanted, at + 1)
    return sorted(found)


def _block(data: bytes, begin: int, end: int) -> bytes:
    """What the block between two bit offsets holds: its bits between the head and the end of a stream of one block."""
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8)[begin // 8 : -(-end // 8)])[begin % 8 : begin % 8 + end - begin]
    check = bits[48:80]  # of a stream of one block, the check sum is the block's
    tail = np.unpackbits(np.frombuffer(END_MARK.to_bytes(6, "big"), dtype=np.uint8))
    return bz2.decompress(b"BZh9" + np.packbits(np.concatenate([bits, tail, check])).tobytes())


def bz2_texts(path: str, start: int, end: int) -> Iterator[tuple[bytes, bool]]:
    """(text, own) of each block from the first that begins at byte ``start`` on; those that begin before ``end`` are own.

    Holds the block that is being gathered and ``CHUNK`` more bytes. A mark that stands within a block by
    chance is passed over, since the block up to it fails its check sum.
    """
    store, at = located(path)
    with store.open_input_file(at) as file:
        size, held, base = file.size(), b"", start
        begin: int | None = None  # where in ``held``, in bits, the block begins
        seen = 0  # bits of ``held`` in which marks have been looked for
        while True:
            more = file.read_at(min(CHUNK, size - base - len(held)), base + len(held)) if base + len(held) < size else b""
            held += more
            skip = max(0, seen // 8 - 8)
            found = [(8 * skip + m, kind) for kind in (BLOCK_MARK, END_MARK) for m in _marks(held[skip:], kind)]
            for mark, kind in sorted(m for m in found if m[0] >= seen):
                if begin is not None:
                    try:
                        text = _block(held, begin, mark)
                    except (OSError, ValueError):
                        continue
                    yield text, 8 * base + begin < 8 * end
                begin = mark if kind == BLOCK_MARK else None
            seen = max(seen, 8 * len(held) - 47)
            if not more:
                if begin is not None:
                    raise EOFError(f"{path} ends within a block")
                return
            gone = max(0, len(held) - 8) if begin is None else begin // 8
            held, base, seen = held[gone:], base + gone, max(0, seen - 8 * gone)
            begin = None if begin is None else begin - 8 * gone


def plain_texts(path: str, start: int, end: int) -> Iterator[tuple[bytes, bool]]:
    """(text, own) of a file that isn't compressed, from byte ``start`` on; the bytes before ``end`` are own."""
    store, at = located(path)
    with store.open_input_file(at) as file:
        place, size = start, file.size()
        while place < size:
            stop = end if place < end else size
            data = file.read_at(min(CHUNK, stop - place), place)
            yield data, place < end
            place += len(data)


class _Text:
    """What has been read and not yet used of a run of texts, and where the own part of it ends."""

    def __init__(self, texts: Iterator[tuple[bytes, bool]]):
        self.texts, self.held, self.base, self.own_end = texts, bytearray(), 0, None

    def more(self) -> bool:
        for text, own in self.texts:
            if not own and self.own_end is None:
                self.own_end = self.base + len(self.held)
            self.held += text
            return True
        return False

    def drop(self, n: int) -> None:
        del self.held[:n]
        self.base += n

    def find(self, mark: bytes, keep: bool) -> int:
        """Where ``mark`` stands, reading on as far as it takes; -1 if nowhere. Without ``keep`` what stands before it is dropped."""
        at = 0
        while True:
            found = self.held.find(mark, at)
            if found >= 0:
                return found
            at = max(0, len(self.held) - len(mark) + 1)
            if not keep:
                self.drop(at)
                at = 0
                if mark == PAGE and self.own_end is not None and self.base >= self.own_end:
                    return -1
            if not self.more():
                return -1


def _revision(fragment: bytes, title: str | None, page_id: str | None, ns: str) -> tuple:
    r = ElementTree.fromstring(fragment)
    who = r.find("contributor")
    name, ip, user = (who.findtext(t) or None for t in ("username", "ip", "id")) if who is not None else (None, None, None)
    of = lambda t: r.findtext(t) or None
    return of("comment"), of("sha1"), user, name or ip, ip, of("timestamp"), of("text"), of("format"), of("model"), page_id, title, ns, int(r.findtext("id"))


def dump_rows(texts: Iterator[tuple[bytes, bool]], namespaces: frozenset[int]) -> Iterator[tuple]:
    """The revisions, as rows, of the pages of some namespaces that begin in the own part of ``texts``.

    Marks can't stand within values, where the sign they begin with is escaped. Holds one revision, and of
    pages of other namespaces nothing.
    """
    run = _Text(texts)
    while True:
        at = run.find(PAGE, keep=False)
        if at < 0 or run.own_end is not None and run.base + at >= run.own_end:
            return
        run.drop(at + len(PAGE))
        # the head of the page ends with its first revision, or with the page
        while (first := min((x for x in (run.held.find(REVISION), run.held.find(PAGE_END)) if x >= 0), default=-1)) < 0:
            if not run.more():
                return
        head = ElementTree.fromstring(b"<h>" + bytes(run.held[:first]) + b"</h>")
        title, page_id, ns = head.findtext("title"), head.findtext("id"), head.findtext("ns")
        run.drop(first)
        wanted = ns is not None and int(ns) in namespaces
        while wanted:
            while len(run.held) < len(REVISION) and run.more():
                pass
            if not run.held.startswith(REVISION):
                break
            end = run.find(REVISION_END, keep=True)
            if end < 0:
                return
            yield _revision(bytes(run.held[: end + len(REVISION_END)]), title, page_id, ns)
            run.drop(end + len(REVISION_END))
            while not (begun := len(run.held) - len(run.held.lstrip())) < len(run.held):  # white space between revisions
                if not run.more():
                    return
            run.drop(begun)
        over = run.find(PAGE_END, keep=False)
        if over < 0:
            return
        run.drop(over + len(PAGE_END))


class _Part(InputPartition):
    """What one task reads: (path, start, end) of each piece."""

    def __init__(self, pieces: list[tuple[str, int, int]]):
        super().__init__(pieces)
        self.pieces = pieces


def packed(pieces: list[tuple[str, int, int]], size: int) -> list[list[tuple[str, int, int]]]:
    """Pieces in their order, as many together as make ``size`` bytes, where each counts ``OPEN_BYTES`` more for being opened."""
    out: list[list[tuple[str, int, int]]] = []
    room = 0
    for piece in pieces:
        cost = piece[2] - piece[1] + OPEN_BYTES
        if not out or cost > room:
            out.append([])
            room = size
        out[-1].append(piece)
        room -= cost
    return out


class _DumpReader(DataSourceReader):
    def __init__(self, source: type[Dump]):
        self.source = source

    def partitions(self) -> list[_Part]:
        step = self.source.split
        pieces = [(p, a, min(a + step, size)) for path in self.source.paths for p, size in files_under(path) for a in range(0, size, step)]
        return [_Part(x) for x in packed(pieces, step)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in ROW.split(", ")]
        schema = pa.schema([(n, pa.int64() if n == "rev_id" else pa.string()) for n in names])
        rows, held = [], 0
        every = (dump_rows((bz2_texts if path.endswith(".bz2") else plain_texts)(path, start, end), self.source.namespaces) for path, start, end in partition.pieces)
        for row in chain.from_iterable(every):
            rows.append(row)
            held += sum(len(x) for x in row if isinstance(x, str))
            if held >= BATCH_BYTES or len(rows) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Dump(DataSource):
    """Attributes of a registered dump; ``stream_dump`` makes one for each read."""

    paths: list[str] = []
    namespaces: frozenset[int] = frozenset()
    split = SPLIT_BYTES

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> DataSourceReader:
        return _DumpReader(type(self))


def stream_dump(spark: SparkSession, path: str | list[str], namespaces: list[int] | None = None, split: int = SPLIT_BYTES) -> DataFrame:
    """The rows of ``readers.read_dump``, from files (``.bz2`` or plain XML) that are split and read as streams.

    A task owns ``split`` bytes and the pages that begin in them; it holds one revision and a block, however
    long a page is. Files must be in storage that Arrow's file systems know; ``read_dump`` reads from
    any that Spark knows, a page at a time. Empty values are null; a file without pages gives no rows.
    """
    paths = [path] if isinstance(path, str) else list(path)
    name = f"dump_{uuid.uuid4().hex}"
    wanted = frozenset(TALK_NAMESPACES if namespaces is None else namespaces)
    spark.dataSource.register(type("OneDump", (Dump,), {"paths": paths, "namespaces": wanted, "split": split, "name": classmethod(lambda cls: name)}))
    return spark.read.format(name).load().select("*", *iso_week(F.to_timestamp("timestamp", "yyyy-MM-dd'T'HH:mm:ssX")))
