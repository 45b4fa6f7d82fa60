"""Byte-pair encoding and decoding over the merge table of a public tokenizer file.

A word's symbols form a doubly linked list; a heap of (merge rank, place) gives the next merge, and
entries whose symbols have meanwhile changed are skipped. Each distinct word is merged once by a worker
process and then looked up, as long as the words it remembers stay within a bound of memory.
"""

from __future__ import annotations

import heapq
import json
import os.path
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.textarrays import pieces

#: Bytes of words and their ids that a worker remembers at most; beyond, the memory is emptied and filled anew.
REMEMBERED_BYTES = 72_000_000
#: Bytes of text encoded, and ids put into one Arrow batch, at most, but for one longer text.
SLICE, BATCH_IDS = 1 << 20, 200_000

ID_BITS, PLACE_BITS = 20, 32
ID_MASK, PLACE_MASK = (1 << ID_BITS) - 1, (1 << PLACE_BITS) - 1


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class _Memory(dict):
    """Ids of the words met so far; a word that is missing is merged first."""

    def __init__(self, merge):
        super().__init__()
        self.merge, self.bytes = merge, 0

    def __missing__(self, word: str) -> list[int]:
        ids = self.merge(word)
        if len(word) < 64:
            if self.bytes >= REMEMBERED_BYTES:
                self.clear()
                self.bytes = 0
            self.bytes += 210 + 2 * len(word) + 8 * len(ids)  # about what the entry, the string and the list take
            self[word] = ids
        return ids


#: The parts of a tokenizer file, but for its words and merges, that this coder stands for.
FORM = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "decoder": None,
}
SPLIT = {"type": "Split", "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def _cut_pattern(file: dict) -> str:
    """How a file cuts normalised text into words; files of another form than ``FORM`` are refused."""
    steps = (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    same = lambda want, got: all(got.get(k) == v for k, v in want.items())
    plain = all(not t.get(k) for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not (len(steps) == 2 and same(FORM, file) and same(SPLIT, steps[0]) and same(BYTES, steps[1]) and same(MODEL, file["model"]) and file["model"].get("end_of_word_suffix") and plain):
        raise ValueError("this coder is for word-end BPE files: NFC, white space and lower case, words cut by a pattern, bytes, no decoder")
    return steps[0]["pattern"]["Regex"]


class Bpe:
    """The vocabulary, merges, word pattern and special tokens of a word-end BPE tokenizer file."""

    def __init__(self, spec: str):
        file = json.loads(spec)
        self.cut = regex.compile(_cut_pattern(file))
        suffix = file["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = file["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.strings = {i: s for s, i in [*vocab.items(), *self.special.items()]}
        #: one number object for each id, which all words share
        self.numbers = list(range(max(self.strings) + 1))
        self.merges = {}
        for rank, (a, b) in enumerate(file["model"]["merges"]):
            self.merges[vocab[a] << ID_BITS | vocab[b]] = rank << ID_BITS | vocab[a + b]
        symbols = byte_symbols()
        self.inner = [self.numbers[vocab[s]] for s in symbols]
        self.final = [self.numbers[vocab[s + suffix]] for s in symbols]
        self.stop = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: what every special token begins with
        self.mark = os.path.commonprefix(list(self.special)) if self.special else ""
        self.memory = _Memory(self.merge)

    def merge(self, word: str) -> list[int]:
        """The ids of one word.

        A heap entry is one number: merge rank, id that the merge makes, place of its left symbol.
        """
        raw = word.encode("utf-8", "surrogatepass")
        inner, numbers, find = self.inner, self.numbers, self.merges.get
        ids = [inner[b] for b in raw]
        ids[-1] = self.final[raw[-1]]
        n = len(ids)
        heap = []
        for i in range(n - 1):
            m = find(ids[i] << ID_BITS | ids[i + 1])
            if m is not None:
                heap.append(m << PLACE_BITS | i)
        if not heap:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i, m = entry & PLACE_MASK, entry >> PLACE_BITS
            j = after[i]
            if j >= n or ids[i] < 0 or find(ids[i] << ID_BITS | ids[j]) != m:
                continue  # stale: one of its symbols has been merged meanwhile
            joined = numbers[m & ID_MASK]
            ids[i], ids[j] = joined, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = find(joined << ID_BITS | ids[k])
                if m is not None:
                    heapq.heappush(heap, m << PLACE_BITS | i)
            h = before[i]
            if h >= 0:
                m = find(ids[h] << ID_BITS | joined)
                if m is not None:
                    heapq.heappush(heap, m << PLACE_BITS | h)
        return [i for i in ids if i >= 0]

    def words(self, text: str) -> list[str]:
        """A piece without special tokens: NFC, lower case character by character, cut into words."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.cut.findall(text.lower())

    def encode(self, text: str) -> list[int]:
        find = self.memory.__getitem__
        if self.stop is None or self.mark not in text:
            return list(chain.from_iterable(map(find, self.words(text))))
        out = []
        for n, piece in enumerate(self.stop.split(text)):
            if n % 2:
                out.append(self.special[piece])
            else:
                out.extend(chain.from_iterable(map(find, self.words(piece))))
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings in turn, with the one space between them that a file without decoder asks for."""
        return " ".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=1)
def _loaded(spec: str) -> Bpe:
    """The coder of one file, kept by a worker process from task to task."""
    return Bpe(spec)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_decode(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id_col, the ``keep`` columns, ``ids array<int>`` and ``decoded string``.

    Whole texts are encoded; null counts as the empty text and gives no ids and an empty decoded text. A
    very long text is one row by itself and its words are coded one by one. Repeated rows are each
    answered, an empty table gives an empty result, other columns are ignored; ``keep`` columns named
    ``ids`` or ``decoded`` are refused. The tokenizer file is read by the driver and broadcast (its size
    does not depend on the data); rows never move.
    """
    spark: SparkSession = docs.sparkSession
    if {c.lower() for c in (id_col, *keep)} & {"ids", "decoded"}:
        raise ValueError("ids and decoded are columns of the result")
    with open(tokenizer_path or default_path(), encoding="utf-8") as f:
        text = f.read()
    _cut_pattern(json.loads(text))
    spec = spark.sparkContext.broadcast(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(spec.value)
        for whole in batches:
            for batch in pieces(whole, whole.num_columns - 1, SLICE):
                texts = batch.column(batch.num_columns - 1)
                ids, decoded, size, begin = [], [], 0, 0
                for row, text in enumerate(texts):
                    one = bpe.encode(text.as_py() or "")
                    ids.append(one)
                    decoded.append(bpe.decode(one))
                    size += len(one)
                    if size > BATCH_IDS or row == len(texts) - 1:
                        yield pa.RecordBatch.from_arrays(
                            [*(c.slice(begin, len(ids)) for c in batch.columns[:-1]), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names
                        )
                        ids, decoded, size, begin = [], [], 0, row + 1

    kept = docs.select(id_col, *keep)
    names = [*kept.columns, "ids", "decoded"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", ids array<int>, decoded string"
    return docs.select(id_col, *keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)
