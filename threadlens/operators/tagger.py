"""A hidden Markov tagger: counts of a tagged table, and the likeliest tags of each sequence by Viterbi's fold."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags are a fixed set of a language, so their table of pairs is small; more than this many are refused.
MOST_TAGS = 200


class Tagger:
    """Log chances of tags and of words.

    ``tags`` names the tags; ``first`` and ``pairs`` hold the log chances of a sequence's first tag and of a tag after
    another; ``words`` (word, chances) has, for each known word, its log chance under each tag, and stays
    a table; ``unknown`` holds what any other word has.
    """

    def __init__(self, tags: list[str], first: list[float], pairs: list[list[float]], words: DataFrame, unknown: list[float]):
        if len(tags) > MOST_TAGS:
            raise ValueError(f"{len(tags)} tags; {MOST_TAGS} at most")
        self.tags, self.first, self.pairs, self.words, self.unknown = tags, first, pairs, words, unknown

    @classmethod
    def fit(cls, tagged: DataFrame, words: str = "words", tags: str = "tags", more: float = 0.5) -> Tagger:
        """Counts of sequences (two arrays of one length), each count greater by ``more``. Rows with a null are passed over."""
        whole = tagged.where(F.col(words).isNotNull() & F.col(tags).isNotNull())
        both = whole.select(F.posexplode(F.arrays_zip(F.col(words).alias("word"), F.col(tags).alias("tag"))).alias("at", "x"), F.col(tags).alias("all"))
        seen = both.select("at", F.col("x.word").alias("word"), F.col("x.tag").alias("tag"), F.get("all", F.col("at") - 1).alias("former"))
        steps = seen.groupBy("former", "tag").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("at") == 0, 1)).alias("begins")).collect()  # tags squared
        names = sorted({r.tag for r in steps})
        at = {t: i for i, t in enumerate(names)}
        k = len(names)
        count, begins, total = [[more] * k for _ in names], [more] * k, [0] * k
        for r in steps:
            total[at[r.tag]] += r.n
            begins[at[r.tag]] += r.begins
            if r.former is not None:
                count[at[r.former]][at[r.tag]] += r.n
        logs = lambda row: [math.log(x / sum(row)) for x in row]
        emitted = seen.groupBy("word").pivot("tag", names).agg(F.count(F.lit(1))) if names else seen.select("word")
        vocabulary = seen.agg(F.count_distinct("word")).first()[0]
        below = [math.log(total[i] + more * (vocabulary + 1)) for i in range(k)]
        chances = [F.ln(F.coalesce(F.col(f"`{t}`"), F.lit(0)) + F.lit(more)) - F.lit(below[i]) for i, t in enumerate(names)]
        table = emitted.select("word", F.array(*chances).alias("chances"))
        return cls(names, logs(begins) if k else [], [logs(row) for row in count], table, [math.log(more) - b for b in below])

    def _best(self, chances: Column) -> Column:
        """Places of the likeliest tags, given each word's log chances; of equal ways the one over earlier tags."""
        numbers = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
        places = F.array(*[F.lit(i) for i in range(len(self.tags))])
        into = F.array(*[numbers([row[j] for row in self.pairs]) for j in range(len(self.tags))])  # into[j][i]: from i to j
        start = F.struct(F.zip_with(numbers(self.first), F.get(chances, F.lit(0)), lambda a, b: a + b).alias("score"), F.array().cast("array<array<int>>").alias("back"))

        def step(held: Column, own: Column) -> Column:
            ways = F.transform(places, lambda j: F.array_max(F.zip_with(F.zip_with(held["score"], F.get(into, j), lambda s, t: s + t), places, lambda v, i: F.struct(v.alias("v"), (-i).alias("i")))))
            score = F.zip_with(ways, own, lambda w, e: w["v"] + e)
            return F.struct(score.alias("score"), F.concat(held["back"], F.array(F.transform(ways, lambda w: -w["i"]))).alias("back"))

        def trace(held: Column) -> Column:
            last = -F.array_max(F.zip_with(held["score"], places, lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))))["i"]
            return F.reverse(F.aggregate(F.reverse(held["back"]), F.array(last), lambda path, back: F.concat(path, F.array(F.get(back, F.element_at(path, -1))))))

        return F.when(F.size(chances) > 0, F.aggregate(F.slice(chances, F.lit(2), F.greatest(F.size(chances) - 1, F.lit(0))), start, step, trace))

    def tag(self, rows: DataFrame, words: str = "words", name: str = "tags") -> DataFrame:
        """``rows`` with the array ``name``: the likeliest tags of the array ``words``; null for a null or empty one.

        Words meet their chances by a join, so the vocabulary may be of any size; then a sequence is one
        fold. A null word counts as unknown. Rows that are alike are tagged alike.
        """
        distinct = rows.select(F.col(words).alias("_seq")).where(F.size("_seq") > 0).distinct()
        keyed = distinct.withColumn("_key", F.sha2(F.to_json(F.struct("_seq"), {"ignoreNullFields": "false"}), 256))
        each = keyed.select("_key", F.posexplode("_seq").alias("at", "word")).join(self.words, "word", "left")
        unknown = F.array(*[F.lit(float(x)) for x in self.unknown])
        gathered = each.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("chances", unknown).alias("c")))).alias("x"))
        # the fold's input must be a column: an expression in its place would be worked out again for each use
        best = self._best(F.col("_chances"))
        tagged = gathered.select("_key", F.transform("x", lambda x: x["c"]).alias("_chances")).withColumn("_best", best)
        names = F.array(*[F.lit(t) for t in self.tags])
        made = keyed.join(tagged, "_key").select("_seq", F.transform("_best", lambda i: F.get(names, i)).alias(name))
        return rows.join(made, rows[words].eqNullSafe(made["_seq"]), "left").drop("_seq")
