"""The trained splitter and the tagger against plain versions."""

from __future__ import annotations

import itertools
import math
import random

import pytest

from threadlens.operators.splitter import Splitter
from threadlens.operators.tagger import MOST_TAGS, Tagger


def test_abbreviations_and_ordinals_are_not_cut(spark):
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 8))) for _ in range(150)]
    names = ["Smith", "Jones", "Brown", "Miller", "Davis"]

    def sentence() -> str:
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(4, 10))]
        words[0] = rnd.choice(["The", "Then", "We", words[0].capitalize()])
        kind = rnd.random()
        if kind < 0.3:
            words.insert(rnd.randint(1, len(words) - 1), f"{rnd.choice(['Dr.', 'Mr.'])} {rnd.choice(names)}")
        elif kind < 0.45:
            words.insert(rnd.randint(1, len(words) - 1), f"{rnd.randint(1, 30)}. of May")
        elif kind < 0.55:
            words.insert(rnd.randint(1, len(words) - 1), "e.g. " + rnd.choice(vocabulary))
        elif kind < 0.6:
            words.insert(rnd.randint(1, len(words) - 1), f"J. {rnd.choice(names)}")
        return " ".join(words) + rnd.choice(["."] * 8 + ["!", "?", '."'])

    truth = [[sentence() for _ in range(rnd.randint(1, 12))] for _ in range(300)]
    rows = [(i, "  ".join(s) + "\n") for i, s in enumerate(truth)] + [(1000, None), (1001, ""), (1002, " \n"), (1003, "no end"), (0, "  ".join(truth[0]) + "\n")]
    df = spark.createDataFrame(rows, "id long, text string")
    model = Splitter(df)
    short = {r.word for r in model.abbreviations.collect()}
    assert {"dr", "mr", "e.g"} <= short and not short & set(vocabulary)
    got = model.split(df, "id").collect()
    assert len(got) == len(rows)
    out = {r.id: r.sentences for r in got}
    assert out[1000] == out[1001] == out[1002] == [] and out[1003] == ["no end"]
    assert sum(out[i] == s for i, s in enumerate(truth)) >= 295
    assert Splitter(df.limit(0)).split(df.limit(0), "id").count() == 0


def likeliest(tagger: Tagger, words: dict, sequence: list) -> list[str]:
    own = [words.get(w, tagger.unknown) for w in sequence]
    k = range(len(tagger.tags))
    score = lambda p: tagger.first[p[0]] + sum(own[i][t] for i, t in enumerate(p)) + sum(tagger.pairs[a][b] for a, b in itertools.pairwise(p))
    return [tagger.tags[t] for t in max(itertools.product(k, repeat=len(sequence)), key=score)]


def test_likeliest_tags_by_enumeration(spark):
    rnd = random.Random(2)
    tagged = [([rnd.choice("abcdef") for _ in range(n)], [rnd.choice(["N", "V", "D"]) for _ in range(n)]) for n in (rnd.randint(1, 8) for _ in range(60))]
    tagger = Tagger.fit(spark.createDataFrame([*tagged, (None, None), (["a"], None)], "words array<string>, tags array<string>"))
    words = {r.word: r.chances for r in tagger.words.collect()}
    n = {t: sum(x.count(t) for _, x in tagged) for t in tagger.tags}
    seen = sum(w == "a" and t == "N" for ws, ts in tagged for w, t in zip(ws, ts, strict=True))
    assert words["a"][tagger.tags.index("N")] == pytest.approx(math.log((seen + 0.5) / (n["N"] + 0.5 * 7)))
    for row in [tagger.first, *tagger.pairs]:
        assert sum(map(math.exp, row)) == pytest.approx(1)
    sequences = [[rnd.choice([*"abcdef", "zz", None]) for _ in range(rnd.randint(1, 6))] for _ in range(40)]
    rows = [(i, s) for i, s in enumerate([*sequences, sequences[0], [], None])]
    got = {r.id: r.tags for r in tagger.tag(spark.createDataFrame(rows, "id long, words array<string>")).collect()}
    assert got == {i: likeliest(tagger, words, s) if s else None for i, s in rows}
    with pytest.raises(ValueError):
        Tagger([str(i) for i in range(MOST_TAGS + 1)], [], [], tagger.words, [])
