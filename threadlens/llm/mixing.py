"""Mixing sources to target weights, with DataFrame operations only.

The words of each source are packed into blocks of fixed length. Output shards of fixed length (but the last)
draw their counts of each source multinomially, given each source's total, so that totals meet their
targets: one pseudorandom arrangement of all slots, cut into shards, is that draw. The slots that a source
gets go through that source's pseudorandom permutation of block numbers, and blocks are joined to slots by number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.llm.common import SPACE_CLASS, WORD_CLASS, boxed, save, scratch, unboxed

#: Words of a block, and blocks of an output shard; the last shard may have fewer.
BLOCK, SHARD_BLOCKS = 128, 4096
WEIGHTS = (3, 1, 2)
#: Share of all words that the mix takes, and how often at most a source is repeated.
TOTAL_SHARE, MOST_REPEATS = 1.5, 2.0
ROUNDS = 12
#: Slots made by one task's row, and such rows made by another's.
CHUNK = 4096
#: Rows of a bucket of a source, and buckets of a group, within which running sums are taken.
BUCKET_ROWS, GROUP_BUCKETS = 2000, 1024


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"{WORD_CLASS}+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE, repeats: float = MOST_REPEATS) -> DataFrame:
    """(sid, source, source_size, target) from (source, size): one row for each source.

    Sources by code point, null last, take the weights in turn and share ``share`` of all words. A
    target stops at ``repeats`` times its source's size and the excess is shared anew by weight: that
    is the level at which weights times one factor, capped, add up to the whole; the capped sources
    are those with the least cap for their weight, so running sums over that order give it.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    one = Window.orderBy(F.col("source").asc_nulls_last())  # over sources, not rows
    per_source = per_source.withColumn("sid", F.row_number().over(one))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") - 1) % len(weights) + 1)
    per_source = per_source.withColumn("w", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / (
        F.sum("w").over(every) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0))
    )
    ranked = per_source.withColumn("level", level).withColumn("place", F.row_number().over(order))
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("place", "level"))
    return ranked.withColumn("factor", F.min(fits).over(every)["level"]).select(
        "sid", "source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("factor") * F.col("w")), F.col("cap")).alias("target")
    )


def permuted(x: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """Where a keyed swap-or-not shuffle of 0 .. n - 1 sends ``x``; a bijection for every n."""

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - at, n)
        return F.when(F.pmod(F.xxhash64(key, r, F.greatest(at, other)), F.lit(2)) == 0, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), step)


def _spread(rows: DataFrame, n: str, step: int, name: str) -> DataFrame:
    """``rows`` once for each of 0, step, 2 step, ... below column ``n``, in two stages so that no row's array grows with n."""
    wide = step * CHUNK
    upto = lambda start, end, by: F.sequence(start, end, F.lit(by).cast("long"))
    coarse = rows.select("*", F.explode(upto(F.lit(0).cast("long"), F.col(n) - 1, wide)).alias("_from"))
    return coarse.select("*", F.explode(upto(F.col("_from"), F.least(F.col("_from") + wide, F.col(n)) - 1, step)).alias(name)).drop("_from")


class Mix:
    """The mix of one table: its sources, packed blocks, output shards and slots.

    Sizes are counts of words ``[^\\x20\\x09-\\x0D]+``; a null text has none and is in no block. A null source
    is a source of its own, the last one. A very long text lies in many blocks, each a row. Documents are
    packed in the order of a hash of id and text, repeated rows one after the other in any order; an empty
    table mixes to nothing; other columns are ignored, whatever their names. Offsets within a source are
    running sums over hashed buckets, groups of buckets, and groups, so that no task holds a hot source.
    ``whole`` writes the rows, numbered, so that ``texts`` and ``blocks`` can be asked for.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = 5, whole: bool = False):
        self.columns, self.id_col, self.text_col, self.block, self.seed = docs.columns, id_col, text_col, block, seed
        self.spark, self.whole = docs.sparkSession, whole
        self.rows = boxed(docs, number=F.monotonically_increasing_id())
        if whole:
            self.rows = save(self.rows, "numbered")
        with scratch(self.spark):
            self._pack(id_col, text_col, source_col, shard_blocks)

    def _pack(self, id_col: str, text_col: str, source_col: str, shard_blocks: int) -> None:
        block = self.block
        field = lambda c: F.col("row").getField(c)
        text = field(text_col).cast("string")
        sized = save(self.rows.select("number", field(id_col).alias("id"), field(source_col).alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("th")), "words")
        rows = sized.count()
        self.sources = save(targets(sized), "sources", outlive=1)
        size, target = F.col("source_size"), F.col("target")
        turns = F.when(size > 0, F.floor(target / size)).otherwise(0).cast("long")
        rest = F.round(target).cast("long") - turns * size
        #: whole turns through each source, then ``rest`` words of one more
        plan = self.sources.select("*", F.ceil(size / F.lit(block)).cast("long").alias("blocks"), turns.alias("turns"), F.greatest(rest, F.lit(0)).alias("rest"))
        buckets = max(64, math.ceil(rows / BUCKET_ROWS))
        known = sized.join(self.sources.select("sid", F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        known = known.withColumn("bucket", F.pmod(F.xxhash64("id", "th"), F.lit(buckets)))
        in_bucket = Window.partitionBy("sid", "bucket").orderBy("id", "th", "size", "number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        known = save(known.withColumn("to_here", F.sum("size").over(in_bucket)).drop("th", "source"), "packed", outlive=1)

        def so_far(c: str, by: list[str], order: str) -> Column:
            return F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

        sums = known.groupBy("sid", "bucket").agg(F.sum("size").alias("held")).withColumn("group", F.floor(F.col("bucket") / GROUP_BUCKETS))
        sums = save(sums, "bucket-sums")
        groups = sums.groupBy("sid", "group").agg(F.sum("held").alias("held")).select("sid", "group", so_far("held", ["sid"], "group").alias("base"))
        within = sums.select("sid", "bucket", "group", so_far("held", ["sid", "group"], "bucket").alias("inner"))
        offsets = save(within.join(groups, ["sid", "group"]).select("sid", "bucket", (F.col("base") + F.col("inner")).alias("offset")), "offsets", outlive=1)
        #: number, id, sid, size, source_size, target, start: each document's first word in its source's stream
        self.packed = known.join(offsets, ["sid", "bucket"]).withColumn("start", F.col("offset") + F.col("to_here") - F.col("size"))
        turns = plan.where("blocks > 0").withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns"))))
        last = F.col("turn") == F.col("turns")
        count = F.when(last, F.ceil(F.col("rest") / F.lit(block))).otherwise(F.col("blocks")).cast("long")
        #: which slots there are: n in each turn through a source, numbered from ``base`` among all
        before = Window.orderBy("sid", "turn").rowsBetween(Window.unboundedPreceding, -1)  # over sources and turns, not rows
        self.turns = turns.withColumn("n", count).where("n > 0").select("sid", "turn", "n", "blocks", "rest", last.alias("last"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        self.total, self.shard_blocks = self.turns.agg(F.sum("n")).first()[0] or 0, shard_blocks
        self.shards, self._parts = max(1, math.ceil(self.total / shard_blocks)), max(2 * self.spark.sparkContext.defaultParallelism, math.ceil(self.total / 100_000))

    def slots(self) -> DataFrame:
        """(shard, position, sid, turn, slot, block, upto): each slot with its place in the output shards, and its block.

        The places of all slots are a pseudorandom arrangement, and every ``shard_blocks`` places are a shard.
        So a shard's counts of the sources are drawn without replacement from the totals that the targets
        ask for: a multinomial draw given those totals. A slot's number in its turn goes through the turn's
        permutation of the source's blocks; ``upto`` words of the block are taken.
        """
        size = F.lit(self.block).cast("long")
        chunks = _spread(self.turns, "n", CHUNK, "c").repartition(self._parts, F.xxhash64("sid", "turn", "c"))
        slots = chunks.withColumn("slot", F.explode(F.sequence(F.col("c"), F.least(F.col("c") + CHUNK, F.col("n")) - 1)))
        upto = F.when(F.col("last"), F.least(size, F.col("rest") - F.col("slot") * self.block)).otherwise(size)
        placed = slots.select(
            "sid", "turn", "slot",
            permuted(F.col("base") + F.col("slot"), F.lit(max(1, self.total)).cast("long"), F.xxhash64(F.lit(self.seed + 1))).alias("place"),
            permuted(F.col("slot"), F.col("blocks"), F.xxhash64(F.lit(self.seed), "sid", "turn")).alias("block"),
            upto.alias("upto"),
        )
        per = F.lit(self.shard_blocks).cast("long")
        return placed.select(F.floor(F.col("place") / per).cast("int").alias("shard"), (F.col("place") % per).alias("position"), "sid", "turn", "slot", "block", "upto")

    def shard_counts(self) -> DataFrame:
        """(shard, source, slots): how many blocks each output shard drew from each source."""
        counts = self.slots().groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("slots"))
        return counts.join(self.sources.select("sid", "source"), "sid").select("shard", "source", "slots")

    def _spans(self) -> DataFrame:
        """Each document's part [lo, hi) of each block it lies in, in words of its source's stream."""
        b = F.lit(self.block).cast("long")
        first, end = F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b) + 1
        spread = _spread(self.packed.where("size > 0").withColumns({"first": first, "n": end - first}), "n", 1, "k").withColumn("block", F.col("first") + F.col("k"))
        lo, hi = F.greatest("start", F.col("block") * b), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
        return spread.select("number", "sid", "start", "size", "block", lo.alias("lo"), hi.alias("hi"))

    def pieces(self) -> DataFrame:
        """Each document's part of each block it lies in, with how often and how far the block is taken, and
        the first places (shard and position in one number) of a block taken whole and of one taken in part."""
        full = F.col("upto") == self.block
        place = F.shiftleft(F.col("shard").cast("long"), 32) + F.col("position")
        drawn = self.slots().groupBy("sid", "block").agg(
            F.count(F.when(full, 1)).alias("whole"), F.sum(F.when(full, 0).otherwise(F.col("upto"))).alias("part"),
            F.min(F.when(full, place)).alias("whole_at"), F.min(F.when(~full, place)).alias("part_at"),
        )
        joined = self._spans().join(drawn.hint("merge"), ["sid", "block"])  # the planner takes generated slots for a few rows
        part_hi = F.least("hi", F.greatest("lo", F.col("block") * self.block + F.col("part")))
        return joined.withColumn("part_hi", part_hi).drop("part")

    def taken(self) -> DataFrame:
        """One row per input row: id, size, source_size, target (of its source), taken, and the output shard and
        position of the first block that has words of it (null, if none is taken)."""
        words = F.col("whole") * (F.col("hi") - F.col("lo")) + F.col("part_hi") - F.col("lo")
        at = F.least("whole_at", F.when(F.col("part_hi") > F.col("lo"), F.col("part_at")))
        sums = self.pieces().groupBy("sid", "start", "size").agg(F.sum(words).alias("taken"), F.min(at).alias("at"))  # a start is one document's, if it has words
        known = self.packed.join(sums.hint("merge"), ["sid", "start", "size"], "left")
        at = F.when(F.col("size") > 0, F.col("at"))  # an empty document may start where another does
        return known.select(
            F.col("id").alias(self.id_col), "size", "source_size", "target",
            F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"),
            F.shiftright(at, 32).cast("int").alias("shard"), at.bitwiseAND(F.lit((1 << 32) - 1)).alias("position"),
        )

    def _with_rows(self, parts: DataFrame) -> DataFrame:
        if not self.whole:
            raise ValueError("texts and blocks need a mix made with whole=True")
        return self.rows.withColumnRenamed("number", "_number").join(parts.hint("merge"), F.col("_number") == F.col("number"))

    def _cut(self, pieces: str) -> Column:
        """The words of a row's text at ``pieces`` (at, n), in turn, with one space between them; a text is split once."""
        words = F.filter(F.split(F.col("row").getField(self.text_col).cast("string"), f"{SPACE_CLASS}+"), lambda w: w != "")
        pick = lambda w: F.array_join(F.flatten(F.transform(pieces, lambda p: F.slice(w, (p["at"] + 1).cast("int"), p["n"].cast("int")))), " ")
        return F.transform(F.array(words), pick)[0]

    def texts(self) -> DataFrame:
        """The mix as rows of the input table, all columns: one row for each document and turn in which
        the mix takes words of it, its text cut to them (as it was, where all are taken). Each of several
        repeated rows has the words taken of it, so that the words add up to ``taken``."""
        form = "struct<at:bigint,n:bigint>"
        whole = F.struct(F.col("lo") - F.col("start"), F.col("hi") - F.col("lo")).cast(form)
        part = F.struct(F.col("lo") - F.col("start"), F.col("part_hi") - F.col("lo")).cast(form)
        copies = self.pieces().select("number", "size", F.posexplode(F.concat(F.array_repeat(whole, F.col("whole").cast("int")), F.array(part))).alias("turn", "piece"))
        per_row = copies.where("piece.n > 0").groupBy("number", "size", "turn").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
        joined = self._with_rows(save(per_row, "taken-pieces"))
        all_taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["n"]) == F.col("size")
        text = F.when(all_taken, F.col("row").getField(self.text_col)).otherwise(self._cut("pieces"))
        return joined.select(*unboxed(joined, self.columns, **{self.text_col: text}))

    def blocks(self) -> DataFrame:
        """The mix as packed blocks: (shard, position, source, block, n_words, text), one row for each slot. A
        block is the words of as many documents as it takes to fill it, joined by one space; the last one
        of a source may be shorter."""
        span = F.array(F.struct((F.col("lo") - F.col("start")).alias("at"), (F.col("hi") - F.col("lo")).alias("n")))
        parts = save(self._spans().select("number", "sid", "block", "lo", span.alias("pieces")), "block-parts")
        held = self._with_rows(parts).select("sid", "block", "lo", self._cut("pieces").alias("words"))
        packed = held.groupBy("sid", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lo", "words"))), lambda x: x["words"]), " ").alias("text"))
        joined = self.slots().join(save(packed, "blocks"), ["sid", "block"]).join(self.sources.select("sid", "source"), "sid")
        words = F.slice(F.split("text", " "), F.lit(1), F.col("upto").cast("int"))
        return joined.select("shard", "position", "source", "block", F.size(words).cast("long").alias("n_words"), F.array_join(words, " ").alias("text"))
