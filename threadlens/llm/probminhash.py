"""Near-dedup by ProbMinHash signatures, banding, and verification.

A document is its set of five-word shingles, each of weight 1. Each shingle has a Poisson
process whose rate is its weight; every arrival falls to a random component of the signature, which
keeps the shingle of its earliest arrival. A process ends as soon as its next arrival is later than
everything the signature holds, so most shingles arrive once or twice. Two signatures agree in a
component with the probability Jaccard similarity, which at equal weights is the Jaccard similarity
of the sets, however often a text repeats a shingle. Bands of components propose pairs,
and the exact Jaccard similarity of the shingle sets decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import boxed, save, scratch, unboxed
from threadlens.llm.components import components
from threadlens.llm.textarrays import U, Words, alnum_table, mix64, rolling, slices, text_buffers, window_starts

SHINGLE, SIMILAR = 5, 0.8
#: Components (a power of two), and how many make a band: pairs at 0.8 share a band but once in 20,000.
COMPONENTS, BAND = 128, 5
#: Hubs of a bucket that its texts are held against in each round after the first.
HUBS = 6
#: Rounds go on while one pair in so many is a link; the exact join is cheaper for the rest.
FEW = 100
#: Share of agreeing components from which a pair is verified: pairs at 0.8 fail it less than once in 10^11.
LIKELY = 0.5
#: Bands of sizes for each doubling of them.
BANDS_OF_SIZES = 16
_GOLDEN = U(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of each distinct shingle by text, and a 64-bit digest of each text's words.

    Words are runs of letters and digits. A text of fewer than ``k`` words has one shingle, all its
    words; a text without words has none.
    """
    words = Words(data, off, alnum_table())
    h, n = words.hashes(), words.counts()
    windows = rolling(h, k)
    ok = window_starts(words.first, k, len(h))
    text_of = words.text_of_word()
    text, value = text_of[: len(windows)][ok], windows[ok]
    # all words of each text, in order
    digest = np.zeros(len(n), dtype=U)
    if len(h):
        place = np.arange(len(h)) - np.repeat(words.first[:-1], n)
        spread = mix64(h + place.astype(U) * _GOLDEN)
        some = n > 0
        digest[some] = mix64(np.add.reduceat(spread, words.first[:-1][some]) + n[some].astype(U))
    few = np.flatnonzero((n > 0) & (n < k))
    text, value = np.concatenate([text, few]), np.concatenate([value, digest[few]])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return text[at], value[at], np.diff(np.append(at, len(text))), digest


def signatures(texts: int, text: np.ndarray, value: np.ndarray, weight: np.ndarray, m: int = COMPONENTS) -> np.ndarray:
    """ProbMinHash signatures of ``texts`` texts: the winning shingle of each component, 0 where there is no shingle."""
    best = np.full(texts * m, np.inf)
    winner = np.zeros(texts * m, dtype=U)
    time, active, r = np.zeros(len(text)), np.arange(len(text)), 0
    while len(active):
        r += 1
        x = mix64(value[active] + U(r * int(_GOLDEN) % (1 << 64)))
        time[active] -= np.log(((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[active]
        cell = text[active] * m + (mix64(x) & U(m - 1)).astype(np.int64)
        t = time[active]
        np.minimum.at(best, cell, t)
        won = best[cell] == t
        winner[cell[won]] = value[active][won]
        last = best.reshape(texts, m).max(axis=1)
        active = active[t < last[text[active]]]
    return winner.reshape(texts, m)


def band_keys(signature: np.ndarray, width: int = BAND) -> np.ndarray:
    """One key for each band of each signature."""
    bands = signature.shape[1] // width
    keys = np.zeros((len(signature), bands), dtype=U)
    for j in range(width):
        keys = mix64(keys * U(0x5851F42D4C957F2D) + signature[:, j : bands * width : width] + U(j))
    return mix64(keys + (np.arange(bands, dtype=U) + U(1)) * _GOLDEN)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(number, id, rk, digest, has_words, bands, short) from (number, id, rk, text)."""
    for batch in batches:
        data, off = text_buffers(batch.column(3))
        for a, b in slices(off, 1 << 20):
            for c in range(a, b, 4096):
                d = min(c + 4096, b)
                text, value, _, digest = shingles(data[off[c] : off[d]], off[c : d + 1] - off[c])
                signature = signatures(d - c, text, value, np.ones(len(text)))
                keys = band_keys(signature)
                has = np.bincount(text, minlength=d - c) > 0
                rows = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel().view(np.int64)), keys.shape[1]).cast(pa.list_(pa.int64()))
                short = pa.FixedSizeBinaryArray.from_buffers(pa.binary(COMPONENTS), d - c, [None, pa.py_buffer(np.ascontiguousarray(mix64(signature).astype(np.uint8)))])
                yield pa.RecordBatch.from_arrays(
                    [*(x.slice(c, d - c) for x in batch.columns[:3]), pa.array(digest.view(np.int64)), pa.array(has), rows, short.cast(pa.binary())],
                    ["number", "id", "rk", "digest", "has_words", "bands", "short"],
                )


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, shingles) from (id, text), of texts whose words have the digest ``id``."""
    for batch in batches:
        data, off = text_buffers(batch.column(1))
        nodes = batch.column(0).to_numpy(zero_copy_only=False).view(U)
        for a, b in slices(off, 1 << 20):
            text, value, _, digest = shingles(data[off[a] : off[b]], off[a : b + 1] - off[a])
            ends = np.searchsorted(text, np.arange(b - a + 1))
            raw = value.view(np.uint8).tobytes()  # each text's shingles ascend
            sets = [raw[8 * ends[i] : 8 * ends[i + 1]] for i in range(b - a)]
            made = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], ["id", "shingles"])
            yield made.filter(pa.array(digest == nodes[a:b]))


def _by_size(batch: pa.RecordBatch, *columns: int, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """A batch in row ranges whose cells of some binary columns hold about ``limit`` bytes, so that long texts are few at a time."""
    size = sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False) for c in columns)
    for a, b in slices(np.concatenate([[0], np.cumsum(size)]).astype(np.int64), limit):
        yield batch.slice(a, b - a)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, s): a row for each of a text's n shingles."""
    for batch in batches:
        for part in _by_size(batch, 1):
            sets = [np.frombuffer(v.as_buffer(), dtype=np.int64) for v in part.column(1)]
            n = np.array([len(x) for x in sets], dtype=np.int32)
            of = np.repeat(np.arange(len(sets)), n)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array(n[of]), pa.array(np.concatenate(sets))], ["id", "n", "s"])


def _likely(least: float):
    """Keeps pairs whose one-byte signatures agree in at least the share ``least`` of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_size(batch, 2, 3):
                x, y = (np.frombuffer(b"".join(v.as_buffer() for v in part.column(c)), dtype=np.uint8).reshape(-1, COMPONENTS) for c in (2, 3))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= least))

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        jaccard = np.zeros(len(batch))
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            a, b = np.frombuffer(x.as_buffer(), dtype=U), np.frombuffer(y.as_buffer(), dtype=U)
            if len(a) > len(b):
                a, b = b, a
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            both = int((b[at] == a).sum()) if len(b) else 0
            jaccard[i] = both / (len(a) + len(b) - both)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(jaccard)], ["a", "b", "jaccard"])


def by_sizes(met: DataFrame, similar: float) -> tuple[DataFrame, DataFrame, list[str]]:
    """The rows of ``met`` (s, id, class, n, place, main) as the shorter and as the longer text of a pair, and the columns to join them on.

    A row comes once for each band of sizes that its partner can have, and not at all where it can have none.
    Of two rows of a key at most one is of its largest class (``main``): the shorter one, the longer one, or neither.
    """
    share = F.lit(similar / (1 + similar))
    # a partner of more shingles than this could not share enough
    met = met.withColumn("reach", (F.col("n") - F.col("place") + 1 + F.lit(1e-6)) / share - F.col("n"))
    band = lambda n: F.floor(F.log2(F.greatest(n, F.lit(1.0))) * F.lit(BANDS_OF_SIZES)).cast("int")
    kinds = lambda main, other: F.explode(F.when(F.col("main"), F.array(F.lit(main))).otherwise(F.array(F.lit(other), F.lit(2))))
    longest = F.least(F.col("n") / F.lit(similar) + 1e-6, F.col("reach"))
    short = met.where(F.col("reach") >= F.col("n")).withColumn("long_band", F.explode(F.sequence(band(F.col("n")), band(longest))))
    least, most = F.col("n") * F.lit(similar) - 1e-6, F.least(F.col("n"), F.col("reach"))
    long = met.where(most >= least).withColumn("short_band", F.explode(F.sequence(band(least), band(most))))
    short = short.withColumn("kind", kinds(0, 1)).withColumn("short_band", band(F.col("n")))
    return short, long.withColumn("kind", kinds(1, 0)).withColumn("long_band", band(F.col("n"))), ["s", "kind", "short_band", "long_band"]


class NearDuplicates:
    """Classes of near-duplicate documents: connected by links of Jaccard similarity ``similar`` or more
    over distinct shingles of five words (lower case, runs of letters and digits).

    Equal word sequences are one text, named by a 64-bit digest of them, and take part once. In every band bucket each
    text is held against the bucket's most central text, the one with most company over all its
    buckets; the texts that stay apart are then held against the next most central ones, round after
    round, while a round finds more than a few links. The texts of buckets that still hold several classes then get
    an exact join over their rarest shingles, so no link within a bucket is given up.

    Ids may be null, shared or of any type that sorts: texts are compared, not ids. A null or wordless text
    is a class of its own; repeated rows are in one class, of which one row stays; texts as central as each
    other take turns by a hash; a very long text is one set of shingles, held by one task at a time; an
    empty table gives an empty result; other columns are ignored, whatever their names.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR):
        self.docs, self.id_col, self.text_col, self.similar = docs, id_col, text_col, similar
        self.id_type = docs.schema[id_col].dataType.simpleString()
        #: number, id, rk, digest and has_words of each row; of each distinct word sequence its first row and its copies; (id, class) of those with a link
        self.rows, self.texts, self.classes = None, None, None
        with scratch(docs.sparkSession):
            self._compare()

    def _compare(self) -> None:
        text = self._text(F.col(self.text_col))
        rows = self.docs.select(F.monotonically_increasing_id().alias("number"), F.col(self.id_col).alias("id"), self._row_key(F.col(self.id_col), text).alias("rk"), text.alias("text"))
        with scratch(self.docs.sparkSession):
            sketched = rows.mapInArrow(_sketch, f"number long, id {self.id_type}, rk long, digest long, has_words boolean, bands array<long>, short binary")
            sketches = save(sketched, "sketches")
            self.rows = save(sketches.drop("bands", "short"), "rows", outlive=2)
            # of equal word sequences, the row with the least id (null last), then the least hash and number
            first = F.struct(F.col("id").isNull().alias("none"), "id", "rk", "number")
            self.texts = save(self.rows.where("has_words").groupBy("digest").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("copies")), "texts", outlive=2)
            firsts = self.texts.select(F.col("first.number").alias("number"))
            distinct = sketches.join(firsts, "number", "left_semi").select(F.col("digest").alias("id"), "bands", "short")
            distinct = save(distinct, "distinct-texts", outlive=1)
        # from here on, ``id`` is the digest of a distinct text
        bands = distinct.select("id", F.explode("bands").alias("key"))
        crowded = save(bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "crowded")
        met = save(bands.join(crowded, "key"), "crowded-bands")
        company = save(met.groupBy("id").agg(F.sum("n").alias("company")), "candidates")
        self.bands = met.select("id", "key").join(company, "id")
        self.short = save(distinct.select("id", "short").join(company, "id", "left_semi"), "signatures")
        wanted = self.texts.select(F.col("digest").alias("node"), F.col("first.rk").alias("_rk")).join(company.select(F.col("id").alias("node")), "node", "left_semi")
        # a merge join at every size: candidates grow with the rows, so a plan that broadcasts them would not last
        named = rows.select("rk", "text").join(save(wanted, "candidate-rows").hint("merge"), F.col("rk") == F.col("_rk"))
        self.sets = save(named.select("node", "text").mapInArrow(_shingle_sets, "id long, shingles binary").dropDuplicates(["id"]), "shingle-sets")
        self.classes = save(self._classes(), "classes", outlive=1)
        del self.bands, self.short, self.sets

    @staticmethod
    def _row_key(id_column: Column, text: Column) -> Column:
        return F.xxhash64(id_column, text)

    @staticmethod
    def _text(column: Column) -> Column:
        return F.lower(F.coalesce(column.cast("string"), F.lit("")))

    def _sides(self, pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
        x = table.select(F.col("id").alias("a"), F.col(column).alias("x"))
        y = table.select(F.col("id").alias("b"), F.col(column).alias("y"))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")

    def _links(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose shingle sets are similar. Signatures rule out most of the others first."""
        likely = save(self._sides(pairs, self.short, "short").mapInArrow(_likely(LIKELY), "a long, b long"), "likely")
        verified = self._sides(likely, self.sets, "shingles").mapInArrow(_verify, "a long, b long, jaccard double")
        return save(verified.where(F.col("jaccard") >= self.similar), "links")

    def _rare_keys(self, texts: DataFrame) -> DataFrame:
        """(id, class, n, s, df, place): the rarest shingles of each of ``texts`` (id, class), so many that two texts
        with ``similar`` or more in common share one, with their places in the text's order of rarity.

        Rarity is counted among these texts. A shingle of one text takes its place but makes no key.
        """
        spread = self.sets.join(texts.select("id"), "id", "left_semi").mapInArrow(_spread, "id long, n int, s long")
        spread = save(spread, "open-shingles")
        df = save(spread.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "open-df")
        shared = save(spread.join(df, "s").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("x")), "open-keys")
        alone = F.col("n") - F.size("x")  # these come first
        size = F.col("n") - F.ceil(F.col("n") * F.lit(self.similar) - F.lit(1e-9)) + 1 - alone
        first = shared.select("id", "n", alone.alias("alone"), F.posexplode(F.slice("x", F.lit(1), F.greatest(size, F.lit(0)).cast("int"))).alias("i", "x"))
        return first.select("id", "n", F.col("x.s").alias("s"), (F.col("alone") + F.col("i") + 1).alias("place")).join(texts, "id")

    def _rest(self, open_rows: DataFrame) -> DataFrame:
        """The links between classes among the texts of ``open_rows`` (id, key, class), by a prefix join.

        At the first key that two texts share, no more than what follows it in both can be shared. So a key's
        place bounds the sizes of its text's partners from above, and ``similar`` bounds them from below. Both
        bounds are in the join's key, as bands of sizes: the shorter text's and the longer one's. As the shorter
        of two, a text needs its first ninth only (at 0.8), so pages of one template that are too far
        apart to be links meet nowhere, however many they are. A key's largest class is held against the others
        only, never against itself.
        """
        keys = save(self._rare_keys(save(open_rows.select("id", "class").distinct(), "open-texts")), "rare-keys")
        sizes = save(keys.groupBy("s", "class").agg(F.count(F.lit(1)).alias("c")), "key-classes")
        largest = sizes.groupBy("s").agg(F.max(F.struct("c", "class"))["class"].alias("largest"), F.count(F.lit(1)).alias("classes"))
        largest = save(largest.where("classes > 1").select("s", "largest"), "mixed-keys")
        met = save(keys.join(largest, "s").select("s", "id", "class", "n", "place", (F.col("class") == F.col("largest")).alias("main")), "mixed-rows")
        short, long, on = by_sizes(met, self.similar)
        named = lambda side, prefix: side.select(*on, *[F.col(c).alias(f"{prefix}_{c}") for c in ("id", "class", "n", "reach")])
        ordered = F.struct("x_n", "x_id") < F.struct("y_n", "y_id")
        able = (F.col("x_n") <= F.col("y_reach")) & (F.col("y_n") <= F.col("x_reach")) & (F.col("x_n") >= F.col("y_n") * F.lit(self.similar) - 1e-6)
        pairs = named(short, "x").join(named(long, "y"), on).where((F.col("x_class") != F.col("y_class")) & ordered & able)
        pairs = save(pairs.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct(), "rest-pairs")
        return self._links(pairs)

    def _classes(self) -> DataFrame:
        """(id, class) of the distinct texts that have a link."""
        open_rows = self.bands.withColumn("class", F.col("id"))
        links = classes = None
        self.rounds = 0
        while True:
            self.rounds += 1
            # a bucket's hubs: the most central text, later several of much company, alike in all buckets of a cluster
            orders = [F.struct(F.floor(F.log2("company")) if j else F.col("company"), F.xxhash64("id", F.lit(self.rounds * HUBS + j)), "id") for j in range(1 if self.rounds == 1 else HUBS)]
            hubs = save(open_rows.groupBy("key").agg(F.array_distinct(F.array(*[F.max(o)["id"] for o in orders])).alias("ids")), "hubs")
            met = open_rows.join(hubs, "key")
            # the hubs of all of a text's buckets, each once: as many as bands times hubs at most
            hubs_of = met.groupBy("id", "class").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
            pairs = hubs_of.select("id", "class", F.explode("ids").alias("hub")).where("id <> hub")
            if classes is not None:
                pairs = pairs.join(classes.select(F.col("node").alias("hub"), "component"), "hub", "left").where("class <> coalesce(component, hub)")
            pairs = save(pairs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct(), "pairs")
            found = self._links(pairs)
            if found.isEmpty():
                break
            links = found if links is None else links.unionByName(found)
            classes = components(links.select("a", "b"))
            rest = met.where(~F.array_contains("ids", F.col("id"))).select("id", "key", "company")
            labelled = rest.join(classes.withColumnRenamed("node", "id"), "id", "left").select("id", "key", "company", F.coalesce("component", "id").alias("class"))
            labelled = save(labelled, "labelled")
            mixed = save(labelled.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("key"), "mixed")
            open_rows = save(labelled.join(mixed, "key", "left_semi"), "open-rows")
            if open_rows.isEmpty() or found.count() * FEW < pairs.count():
                break
        if not open_rows.isEmpty():
            found = self._rest(open_rows)
            if not found.isEmpty():
                links = found if links is None else links.unionByName(found)
                classes = components(links.select("a", "b"))
        self.links = None if links is None else save(links, "class-links", outlive=1)
        if classes is None:
            return self.texts.select(F.col("digest").alias("id"), F.col("digest").alias("class")).limit(0)
        return classes.select(F.col("node").alias("id"), F.col("component").alias("class"))

    def decisions(self) -> DataFrame:
        """One row per input row: id, rk (hash of id and lower-case text), class_id (the smallest id of its class),
        class_size and kept: is it the class's first row, by id (null last), hash and number."""
        with scratch(self.docs.sparkSession):
            named = self.texts.join(self.classes, self.texts["digest"] == self.classes["id"], "left").select("digest", F.coalesce("class", "digest").alias("class"), "first", "copies")
            named = save(named, "named")
            sizes = save(named.groupBy("class").agg(F.sum("copies").alias("size"), F.min("first").alias("first")).where("size > 1"), "class-sizes")
            sized = named.select("digest", "class").join(sizes, "class").select("digest", F.col("first.id").alias("least"), F.col("first.number").alias("stays"), "size")
            sized = save(sized, "sized", outlive=1)
        grouped = F.col("has_words") & F.col("size").isNotNull()
        return self.rows.join(sized, "digest", "left").select(
            "id", "rk",
            F.when(grouped, F.col("least")).otherwise(F.col("id")).alias("class_id"),
            F.when(grouped, F.col("size")).otherwise(1).cast("long").alias("class_size"),
            (~grouped | (F.col("stays") == F.col("number"))).alias("kept"),
        )

    def result(self) -> DataFrame:
        """One row per input row: id_col, class_id, class_size and kept."""
        return self.decisions().select(F.col("id").alias(self.id_col), "class_id", "class_size", "kept")

    def pairs(self) -> DataFrame:
        """(a, b, jaccard): ids of the first rows of two texts, for links that hold the classes together; with ``result``,
        which names every row's class, they say why a row is in it."""
        first = self.texts.select("digest", F.col("first.id").alias("first_id"))
        links = self.links if self.links is not None else first.select(F.col("digest").alias("a"), F.col("digest").alias("b"), F.lit(1.0).alias("jaccard")).limit(0)
        x, y = first.select(F.col("digest").alias("a"), F.col("first_id").alias("x")), first.select(F.col("digest").alias("b"), F.col("first_id").alias("y"))
        return links.join(x, "a").join(y, "b").select(F.col("x").alias("a"), F.col("y").alias("b"), "jaccard")

    def kept_rows(self) -> DataFrame:
        """The rows of ``docs``, whole, one of each class. Of repeated rows (same id and text) of a class, one stays."""
        per_row = self.decisions().groupBy("rk").agg(F.max("kept").alias("kept"), F.max("class_size").alias("class_size"), F.count(F.lit(1)).alias("n"))
        cut = save(per_row.where("NOT kept OR (n > 1 AND class_size > 1)").select(F.col("rk").alias("_rk"), "kept"), "near-copies", outlive=1)
        rows = boxed(self.docs, rk=self._row_key(F.col(self.id_col), self._text(F.col(self.text_col))))
        same = F.col("rk") == F.col("_rk")
        alone = rows.join(cut, same, "left_anti")
        repeated = cut.where("kept")
        if not repeated.isEmpty():  # none, where ids are unique
            alone = alone.unionByName(rows.join(repeated, same, "left_semi").dropDuplicates(["rk"]))
        return alone.select(*unboxed(alone, self.docs.columns))
