"""Near-duplicate line removal by a deletion-neighbourhood join, with DataFrame operations only.

A line is its words. The edit bound is one word inserted, deleted or replaced, which is a likeness of 0.8
or more from five words on; of shorter lines it would be more than a fifth, so they must be equal. Each line emits the
hashed keys of itself and of itself without each one of its words; lines that share a key are
candidates, an exact comparison of their words verifies the edit, and the earliest line stays.

Two lines within the bound agree on a first or a last half, so only lines that share a hashed half
with another distinct line need to emit their neighbourhood; the others cannot have a partner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.llm.common import boxed, save, scratch, unboxed

#: Least likeness of lines, as the share of words that an edit leaves; both must have the words for it.
SIMILAR = 0.8
#: Lines of at least so many words may differ from an earlier one in one word: 1 / (1 - SIMILAR).
EDIT_WORDS = 5


#: White space of the word rule but for the space and the line feed, which cuts lines.
OTHER_SPACE = "\t\x0b\x0c\r"


def _words(line: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a line without line feeds: cut at single spaces, which needs no pattern."""
    other = F.lit(False)
    for c in OTHER_SPACE:
        other = other | line.contains(c)
    spaced = F.when(other, F.translate(line, OTHER_SPACE, " " * len(OTHER_SPACE))).otherwise(line)
    return F.array_remove(F.split(spaced, " "), "")


def _half_keys(words: Column, n: Column) -> Column:
    """Hashes of the first and the last floor((n-1)/2) and floor(n/2) words, with kind and length."""

    def key(kind: int, size: Column) -> Column:
        part = F.slice(words, F.lit(1), size) if kind == 0 else F.slice(words, n - size + 1, size)
        return F.xxhash64(F.lit(kind), size, part)

    short, long = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.array_distinct(F.array(key(0, short), key(0, long), key(1, short), key(1, long)))


def _without(words: Column, place: Column) -> Column:
    """The words but for the one at ``place`` (from 1); all of them at place 0."""
    return F.when(place == 0, words).otherwise(F.concat(F.slice(words, F.lit(1), place - 1), F.slice(words, place + 1, F.size(words))))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


class LineDecisions:
    """Which lines of ``docs`` go. ``lines``: one row per line (id, th, line_no, n, exact, near).

    Lines are cut at line feeds and ordered by (id, line number). A line goes as ``exact`` if one of equal
    words is earlier, and a line of EDIT_WORDS words or more goes as ``near`` if one within one edited word,
    of as many words at least, is earlier, whether or not that one stays. Null texts have no lines; lines without a word
    stay; a very long text is cut into lines by one task, which hold its words one line at a time; null ids
    come first, and of rows that share an id the least text hash; repeated rows (same id and text) have equal lines at equal places, none of
    which is earlier than the other, so they fare alike; an empty table gives no rows; other columns
    are ignored, whatever their names. Hot lines are counted in each task before rows move and meet their decision in a join
    whose skew adaptive execution splits; nothing pairs up the lines of a group, each is held against
    the group's earliest.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.docs, self.id_col, self.text_col = docs, id_col, text_col
        raw = _lines(docs, id_col, text_col).select("id", "th", "line_no", _words(F.col("line")).alias("words"))
        n = F.size("words")
        halves = F.when(n >= EDIT_WORDS, _half_keys(F.col("words"), n))
        self.slim = save(
            raw.select("id", "th", "line_no", n.alias("n"), F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), "words").alias("h2"), halves.alias("halves")), "lines"
        )
        first = F.struct("id", "line_no", "th", "n", "halves")
        distinct = self.slim.where("n > 0").groupBy("h1", "h2").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"))
        self.distinct = save(distinct.select("h1", "h2", "copies", "first.*"), "distinct-lines")
        with scratch(docs.sparkSession):
            near = save(self._near(), "near-lines", outlive=1)
        flagged = (
            self.distinct.select("h1", "h2", "copies", F.col("id").alias("first_id"), F.col("th").alias("first_th"), F.col("line_no").alias("first_no"))
            .join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left")
            .where("copies > 1 OR near")
        )
        flagged = save(flagged, "flagged-lines")
        here, there = self.slim.drop("halves"), flagged.drop("copies")
        is_first = F.col("first_id").eqNullSafe(F.col("id")) & (F.col("first_th") == F.col("th")) & (F.col("first_no") == F.col("line_no"))
        self.lines = (
            here.join(there, ["h1", "h2"], "left")
            .withColumn("exact", (F.col("n") > 0) & F.col("first_no").isNotNull() & ~is_first)
            .select("id", "th", "line_no", "n", "exact", (F.coalesce("near", F.lit(False)) & ~F.col("exact")).alias("near"))
        )

    def _near(self) -> DataFrame:
        """(h1, h2) of the distinct lines that an earlier line comes within one edited word of."""
        long_lines = self.distinct.where(F.col("n") >= EDIT_WORDS)
        keys = save(long_lines.select("h1", F.explode("halves").alias("half")), "halves")
        shared = save(keys.groupBy("half").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("half"), "shared-halves")
        suspects = save(keys.join(shared, "half", "left_semi").select("h1").distinct(), "suspects")
        suspects = save(long_lines.drop("halves", "copies").join(suspects, "h1", "left_semi"), "suspect-lines")
        # a text's suspect lines are named in one row, so that texts move once and no other line does
        named = suspects.groupBy("id", "th").agg(F.collect_list(F.struct("line_no", "h1", "h2")).alias("wanted")).withColumnsRenamed({"id": "_id", "th": "_th"})
        text = F.col(self.text_col).cast("string")
        texts = self.docs.select(F.col(self.id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
        texts = texts.join(named, texts["id"].eqNullSafe(named["_id"]) & (texts["th"] == named["_th"]))
        pick = lambda lines: F.transform("wanted", lambda w: F.struct(w["h1"].alias("h1"), w["h2"].alias("h2"), w["line_no"].alias("line_no"), F.get(lines, w["line_no"]).alias("line")))
        found = texts.select("id", F.explode(F.transform(F.array(F.split("text", "\n")), pick)[0]).alias("x"))
        found = found.select("x.h1", "x.h2", "id", "x.line_no", _words(F.col("x.line")).alias("words"))
        found = save(found.dropDuplicates(["h1", "h2"]), "suspect-words")

        at = lambda place: F.xxhash64("word", place)
        spread = found.select("h1", "h2", "id", "line_no", F.posexplode("words").alias("i", "word"))
        spread = spread.select("h1", "h2", "id", "line_no", F.col("i") + 1, at(F.col("i")).alias("stay"), at(F.col("i") - 1).alias("moved")).toDF(
            "h1", "h2", "id", "line_no", "place", "stay", "moved"
        )
        line = Window.partitionBy("h1", "h2").orderBy("place")
        upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy("h1", "h2")
        # a key is the sum, bit by bit, of 64-bit hashes of words with their places: the words before the
        # deleted one keep their places, those after it move up by one
        bits = lambda c, over: F.bit_xor(c).over(over)
        variants = spread.select(
            "h1", "h2", "id", "line_no", "place",
            bits("stay", upto).bitwiseXOR(F.col("stay")).bitwiseXOR(bits("moved", whole)).bitwiseXOR(bits("moved", upto)).alias("key"),
            bits("stay", whole).alias("full"),
        )
        variants = save(variants, "variants")
        me = F.struct("id", "line_no", "h1", "h2")
        dels = variants.select("key", "place", me.alias("me"))
        full = variants.where("place = 1").select(F.col("full").alias("key"), me.alias("whole"))
        # a word replaced: equal keys with the same place deleted
        first = save(dels.groupBy("key", "place").agg(F.min("me").alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "hubs")
        replaced = dels.join(first, ["key", "place"]).where("hub < me").select("me", "place", F.col("hub").alias("you"), F.col("place").alias("your_place"))
        # a word inserted or deleted: a line's own key equals another's key with a deletion
        crossed = save(dels.join(full, "key"), "crossed")
        longer_later = crossed.where("whole < me").select("me", "place", F.col("whole").alias("you"), F.lit(0).alias("your_place"))
        shorter_later = (
            crossed.where("me < whole")
            .groupBy("whole").agg(F.min(F.struct("me", "place")).alias("x"))
            .select(F.col("whole").alias("me"), F.lit(0).alias("place"), F.col("x.me").alias("you"), F.col("x.place").alias("your_place"))
        )
        pairs = save(replaced.unionByName(longer_later).unionByName(shorter_later), "line-pairs")
        mine = found.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("words").alias("a"))
        yours = found.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("words").alias("b"))
        verified = (
            pairs.join(mine, (pairs["me.h1"] == mine["a1"]) & (pairs["me.h2"] == mine["a2"]))
            .join(yours, (F.col("you.h1") == yours["b1"]) & (F.col("you.h2") == yours["b2"]))
            .where(_without(F.col("a"), F.col("place")) == _without(F.col("b"), F.col("your_place")))
        )
        return verified.select(F.col("a1").alias("h1"), F.col("a2").alias("h2")).distinct()

    def per_document(self) -> DataFrame:
        """(id, th, n_lines, n_exact, n_near, gone: numbers of the lines that go) of documents with lines."""
        numbers = lambda c: F.collect_set(F.when(c, F.col("line_no")))
        sets = self.lines.groupBy("id", "th").agg((F.max("line_no") + 1).cast("long").alias("n_lines"), numbers(F.col("exact")).alias("e"), numbers(F.col("near")).alias("m"))
        return sets.select("id", "th", "n_lines", F.size("e").cast("long").alias("n_exact"), F.size("m").cast("long").alias("n_near"), F.concat("e", "m").alias("gone"))

    def texts(self) -> DataFrame:
        """``docs`` with each text cut to the lines that stay, joined by line feeds, and the columns
        _n_lines, _n_exact and _n_near, which take the place of any of these names. A text whose every line
        goes becomes empty; null stays null."""
        cut, counts = self.cut(), ("n_lines", "n_exact", "n_near")
        text = F.when(F.col("changed"), F.col("kept")).otherwise(F.col("row").getField(self.text_col))
        rows = unboxed(cut, [c for c in self.docs.columns if c.lower() not in {f"_{n}" for n in counts}], **{self.text_col: text})
        return cut.select(*rows, *[F.col(c).alias(f"_{c}") for c in counts])

    def cut(self) -> DataFrame:
        """(row, kept, changed, n_lines, n_exact, n_near): whole rows with what is left of their texts."""
        decided = save(self.per_document(), "line-decisions", outlive=1).withColumnsRenamed({"id": "_id", "th": "_th"})
        docs = boxed(self.docs, id=F.col(self.id_col), th=F.xxhash64(F.col(self.text_col).cast("string")))
        joined = docs.join(decided, docs["id"].eqNullSafe(decided["_id"]) & (docs["th"] == decided["_th"]), "left")
        # places that stay, by one pass over a set of those that go; a text is split once
        stays = F.array_except(F.sequence(F.lit(0), (F.col("n_lines") - 1).cast("int")), F.col("gone"))
        pick = lambda lines: F.array_join(F.transform(stays, lambda i: F.get(lines, i)), "\n")
        lines = F.split(F.col("row").getField(self.text_col).cast("string"), "\n")
        kept = F.when(F.size("gone") > 0, F.transform(F.array(lines), pick)[0])
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
        return joined.select("row", kept.alias("kept"), F.coalesce(F.size("gone") > 0, F.lit(False)).alias("changed"), zero("n_lines"), zero("n_exact"), zero("n_near"))
