"""Each operator against brute force, on texts that hold every awkward case."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import pytest

from threadlens.llm import anchors, bpe, components, digest_index, imatch, langid, line_dedup, mixing, pii, probminhash, sharding

CLASHES = dict.fromkeys(
    "id h size th digest n key range place places class start turn part ids spans edited shard score lang_pred decoded row number kept changed first least node "
    "n_lines n_exact n_near _n_lines _id _th _th2 _gone gone line_no words bands short copies sid block position slot salt crc key_id number_ keep_id old".split(),
    1,
)


def corpus(seed: int = 1, n: int = 80) -> list[tuple]:
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeéßñ") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    words = lambda k: [rnd.choice(vocabulary) for _ in range(k)]
    passage, line = " ".join(words(60)), " ".join(words(14))
    texts: list[str | None] = [None, "", " ", "\n", "x", "a b c", "1 2 3", passage, passage, "w " * 300, line, "é" * 3000]
    for i in range(n):
        text = words(rnd.randint(1, 120))
        if i % 6 == 0:
            text[rnd.randint(0, len(text)) : 0] = passage.split()
        if i % 5 == 0:
            text.insert(rnd.randint(0, len(text)), "\n" + line + "\n")
        if i % 7 == 0:
            changed = line.split()
            changed[rnd.randrange(14)] = "zzz"
            text.append("\n" + " ".join(changed))
        texts.append(" ".join(text))
    base = words(200)
    for _ in range(12):  # near copies
        other = list(base)
        for _ in range(3):
            other[rnd.randrange(200)] = rnd.choice(vocabulary)
        texts.append(" ".join(other))
    texts += [texts[20]] * 15
    sources = ["s1", "s0", None, "é", "s1", "s1"]
    return [(i, t, "en" if i % 2 else None, sources[i % len(sources)], None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    return df.withColumns({k: F.lit(v) for k, v in CLASHES.items()})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_shards(docs, empty):
    out = rows(sharding.shard_by_bytes(docs, shards=6))
    texts = {i: t for i, t, *_ in corpus()}
    assert out.keys() == texts.keys()
    for i, r in out.items():
        raw = (texts[i] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in out.values():
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    most = max(len((t or "").encode()) for t in texts.values()) + 8
    assert max(abs(s - sum(sizes.values()) / 6) for s in sizes.values()) <= most
    assert sharding.shard_by_bytes(empty).count() == 0


def test_written_shards(docs, empty, spark, tmp_path):
    rows_in = docs.drop("shard").unionByName(docs.drop("shard").where("doc_id % 4 = 0").withColumn("doc_id", docs["doc_id"] * 0 + 3))
    sharding.write_shards(rows_in, str(tmp_path / "shards"), shards=5)
    out = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(str, out.drop("shard").collect())) == sorted(map(str, rows_in.collect()))
    sizes = collections.Counter()
    for r in out.collect():
        sizes[r.shard] += len((r.text or "").encode()) + 8
    assert len(sizes) == 5 and max(sizes.values()) - min(sizes.values()) < 2 * max(len((t or "").encode()) for _, t, *_ in corpus())
    sharding.write_shards(empty.drop("shard"), str(tmp_path / "none"), shards=5)
    with pytest.raises(ValueError):
        sharding.write_shards(docs, str(tmp_path / "clash"))


def test_shards_cut_a_group_of_any_size(spark):
    """No rule depends on how large a group of equal texts is: sizes come near the mean whatever the groups."""
    for group in (2, 40, 400):
        df = spark.createDataFrame([(i, f"text {i // group:06d}") for i in range(2000)], "doc_id long, text string")
        n = collections.Counter(r.shard for r in sharding.shard_by_bytes(df, shards=7).collect())
        assert len(n) == 7 and max(n.values()) - min(n.values()) <= 1


def test_shards_of_repeated_rows(spark):
    df = spark.createDataFrame([(None, "same")] * 600 + [(None, None)] * 100, "doc_id string, text string")
    n = collections.Counter(r.shard for r in sharding.shard_by_bytes(df, shards=4).collect())
    assert set(n) == set(range(4)) and max(n.values()) - min(n.values()) < 70


def test_shards_of_one_text(spark):
    df = spark.createDataFrame([(i, "same text") for i in range(500)], "doc_id long, text string")
    n = collections.Counter(r.shard for r in sharding.shard_by_bytes(df, shards=5).collect())
    assert set(n) == set(range(5)) and max(n.values()) - min(n.values()) <= 1


def fill(sizes: dict, share=1.5, repeats=2.0) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, fixed = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in fixed]
        rest = budget - sum(repeats * sizes[s] for s in fixed)
        out = {s: repeats * sizes[s] if s in fixed else rest * weights[s] / sum(weights[f] for f in free) for s in names}
        over = {s for s in free if out[s] > repeats * sizes[s] + 1e-9}
        if not over:
            return out
        fixed |= over


def test_mix(docs, empty):
    data = corpus()
    size = {i: len(WORDS.findall(t or "")) for i, t, *_ in data}
    source = {i: s for i, _, _, s, _ in data}
    sizes = collections.Counter()
    for i, s in source.items():
        sizes[s] += size[i]
    want = fill(dict(sizes))
    mix = mixing.Mix(docs, block=16, shard_blocks=8, whole=True)
    out = rows(mix.taken())
    assert out.keys() == size.keys()
    taken = collections.Counter()
    for i, r in out.items():
        assert r["size"] == size[i] and r.source_size == sizes[source[i]] and r.taken <= 2 * size[i]
        assert r.target == pytest.approx(want[source[i]])
        taken[source[i]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 16 for s in sizes)
    again = rows(mixing.Mix(docs.repartition(2), block=16, shard_blocks=8).taken())
    assert {i: tuple(r) for i, r in again.items()} == {i: tuple(r) for i, r in out.items()}
    words = collections.Counter()
    for r in mix.texts().collect():
        words[r.doc_id] += len(WORDS.findall(r.text))
    assert dict(words) == {i: r.taken for i, r in out.items() if r.taken}
    none = mixing.Mix(empty, whole=True)
    assert none.taken().count() == 0 and none.texts().count() == 0 and none.blocks().count() == 0
    with pytest.raises(ValueError):
        mixing.Mix(docs).texts()


def test_mix_shards(docs):
    """Output shards: slots without gaps, counts that are those drawn, blocks that hold the words taken."""
    mix = mixing.Mix(docs, block=16, shard_blocks=40, whole=True)
    slots = mix.slots().collect()
    by_shard, by_source = collections.defaultdict(list), collections.Counter()
    for r in slots:
        by_shard[r.shard].append(r.position)
        by_source[r.sid, r.turn] += 1
    assert all(sorted(p) == list(range(len(p))) for p in by_shard.values()) and set(by_shard) <= set(range(mix.shards)) and mix.shards > 3
    plan = {(r.sid, r.turn): r.n for r in mix.turns.collect()}
    assert dict(by_source) == plan
    assert all(len({r.block for r in slots if (r.sid, r.turn) == k}) == n for k, n in plan.items())  # a permutation takes no block twice
    counts = {(r.shard, r.source): r.slots for r in mix.shard_counts().collect()}
    assert sum(counts.values()) == len(slots)
    # shards of fixed length, but the last
    lengths = collections.Counter(r.shard for r in slots)
    assert [lengths[k] for k in range(mix.shards)] == [40] * (mix.shards - 1) + [len(slots) - 40 * (mix.shards - 1)]
    text = {i: WORDS.findall(t or "") for i, t, *_ in corpus()}
    source = {i: s for i, _, _, s, _ in corpus()}
    held, taken = collections.Counter(), collections.Counter()
    blocks = mix.blocks().collect()
    assert sorted((r.shard, r.position) for r in blocks) == sorted((r.shard, r.position) for r in slots)
    for r in blocks:
        words = r.text.split(" ")
        assert len(words) == r.n_words <= 16
        held.update((r.source, w) for w in words)
    first = {}
    for r in mix.texts().collect():
        taken.update((r.source, w) for w in WORDS.findall(r.text))
    assert held == taken
    for r in blocks:
        for s, w in {(r.source, w) for w in r.text.split(" ")}:
            first.setdefault((s, w), []).append((r.shard, r.position))
    for i, r in rows(mix.taken()).items():
        assert (r.shard is None) == (r.taken == 0)
        if r.taken:
            assert any((r.shard, r.position) in first[source[i], w] for w in text[i])


def test_shard_counts_follow_the_law(spark):
    """Counts of sources over many shards: the mean and spread of a multinomial draw given the totals."""
    df = spark.createDataFrame([(i, "w " * 640, f"s{i % 3}") for i in range(900)], "doc_id long, text string, source string")
    for seed in (5, 6):
        mix = mixing.Mix(df, block=16, shard_blocks=256, seed=seed)
        counts = {(r.shard, r.source): r.slots for r in mix.shard_counts().collect()}
        total = collections.Counter()
        for (_, s), n in counts.items():
            total[s] += n
        n, full = sum(total.values()), mix.shards - 1
        assert n == mix.total and full > 100
        for s, k in total.items():
            p = k / n
            spread = 256 * p * (1 - p) * (n - 256) / (n - 1)
            got = [counts.get((shard, s), 0) for shard in range(full)]
            assert abs(sum(got) / full - 256 * p) < 5 * math.sqrt(spread / full)
            assert 0.6 < sum((x - 256 * p) ** 2 for x in got) / full / spread < 1.6


def test_permutation(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3)).alias("x"))
        assert sorted(r.x for r in df.collect()) == list(range(n))


def shingle_set(text: str | None) -> frozenset:
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes(sets: dict) -> dict:
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in sets}


def test_near_duplicates(docs, empty):
    sets = {i: shingle_set(t) for i, t, *_ in corpus()}
    want = classes(sets)
    out = rows(probminhash.NearDuplicates(docs).result())
    assert {i: r.class_id for i, r in out.items()} == want
    n = collections.Counter(want.values())
    assert all(r.class_size == n[want[i]] and r.kept == (want[i] == i) for i, r in out.items())
    assert probminhash.NearDuplicates(empty).result().count() == 0


def test_near_duplicates_with_repeated_tails(spark):
    """Pairs of set Jaccard over 0.8, one text of which ends in a passage over and over."""
    rnd = random.Random(9)
    words = lambda k: ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(k)]
    texts = []
    for k in range(20):
        head, tail = words(130), words(25)
        texts += [" ".join(head + tail), " ".join(head[: len(head) - 2] + words(2) + tail * (10 + k))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = classes({i: shingle_set(t) for i, t in enumerate(texts)})
    assert sum(want[2 * k + 1] == 2 * k for k in range(20)) == 20
    assert {i: r.class_id for i, r in rows(probminhash.NearDuplicates(df).result()).items()} == want


def test_near_duplicates_in_crowded_buckets(spark):
    """The last two texts are alike, but in all their buckets other texts have more company."""
    rnd = random.Random(4)
    words = lambda k: ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(k)]
    template, texts = words(400), []
    for _ in range(4):
        family = template + words(60)
        texts += [family + words(10) for _ in range(30)]
    texts = [" ".join(t) for t in [*texts, template + words(40), template + words(40)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = classes({i: shingle_set(t) for i, t in enumerate(texts)})
    assert want[121] == 120
    assert {i: r.class_id for i, r in rows(probminhash.NearDuplicates(df).result()).items()} == want


@pytest.mark.parametrize("own", [(80, 80), (30, 70)])
def test_pages_of_one_template(spark, monkeypatch, own):
    """Pages that share a template but are too far apart meet in pairs that grow no faster than they do; the classes stay right."""
    joined, met_rows, plain = {}, {}, probminhash.by_sizes
    rnd = random.Random(4)
    words = lambda k: ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(k)]
    template = words(400)
    for n in (40, 160):

        def counted(met, similar, n=n):
            short, long, on = plain(met, similar)
            joined[n], met_rows[n] = short.join(long, on).count(), met.count()
            return short, long, on

        monkeypatch.setattr(probminhash, "by_sizes", counted)
        texts = [" ".join(template + words(rnd.randint(*own))) for _ in range(n)]
        near = probminhash.NearDuplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        want = classes({i: shingle_set(t) for i, t in enumerate(texts)})
        assert {i: r.class_id for i, r in rows(near.result()).items()} == want
        linked = [tuple(r) for r in near.pairs().collect()]
        assert {i for a, b, _ in linked for i in (a, b)} == {i for i, c in want.items() if collections.Counter(want.values())[c] > 1}
        assert all(want[a] == want[b] and j >= 0.8 for a, b, j in linked)
    if own != (30, 70):  # no links at all
        assert met_rows[160] >= 3 * met_rows[40] > 0 and joined[160] <= 8 * met_rows[160]


def test_prefix_join_by_brute_force(spark):
    """The exact join alone, over all texts as one class each: every link, none other."""
    rnd = random.Random(12)
    pool = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(60)]
    texts = []
    for _ in range(25):
        base = [rnd.choice(pool) for _ in range(rnd.randint(3, 150))]
        for _ in range(6):
            other = list(base)
            for _ in range(rnd.randint(0, 2)):
                other[rnd.randrange(len(other))] = rnd.choice(pool)
            texts.append(" ".join(other[rnd.randint(0, 3) :] + [rnd.choice(pool) for _ in range(rnd.randint(0, 4))]))
    texts = list(dict.fromkeys(texts))
    near = probminhash.NearDuplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    digest = {r.digest: r.first.id for r in near.texts.collect()}
    named = spark.createDataFrame(list(enumerate(texts)), "id long, text string").join(near.texts.selectExpr("digest AS node", "first.id AS id"), "id")
    near.sets = named.select("node", "text").mapInArrow(probminhash._shingle_sets, "id long, shingles binary")
    near._links = lambda pairs: pairs
    found = near._rest(near.texts.selectExpr("digest AS id", "1L AS key", "digest AS class"))
    pairs = {tuple(sorted((digest[r.a], digest[r.b]))) for r in found.collect()}
    sets = [shingle_set(t) for t in texts]
    want = {(i, j) for i, j in itertools.combinations(digest.values(), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert {tuple(sorted(p)) for p in want} <= pairs and len(want) > 30


def test_near_duplicates_with_other_repeats(spark):
    """Copies that repeat a passage more or less often have nearly equal shingle sets."""
    rnd = random.Random(6)
    words = lambda k: ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(k)]
    texts = []
    for _ in range(25):
        passage, rest = words(90), words(210)
        texts += [" ".join(passage + rest), " ".join(passage * 20 + rest)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {i: r.class_id for i, r in rows(probminhash.NearDuplicates(df).result()).items()} == {i: i - i % 2 for i in range(50)}


def test_signatures_estimate_probability_jaccard():
    import numpy as np

    rnd = np.random.default_rng(1)
    value = rnd.integers(1, 2**63, 300, dtype=np.uint64)
    weight = rnd.uniform(0.5, 3, 300)
    a, b = np.arange(0, 220), np.arange(80, 300)
    text = np.concatenate([np.zeros(220, int), np.ones(220, int)])
    s = probminhash.signatures(2, text, value[np.concatenate([a, b])], weight[np.concatenate([a, b])], m=4096)
    both = range(80, 220)
    want = sum(1 / (sum(max(weight[y] / weight[x] if y < 220 else 0, weight[y] / weight[x] if y >= 80 else 0) for y in range(300))) for x in both)
    assert abs((s[0] == s[1]).mean() - want) < 0.04


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    out = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def removed(texts: dict) -> dict:
    split = {i: WORDS.findall(t or "") for i, t in texts.items()}
    seen = collections.Counter(tuple(w[k : k + 35]) for w in split.values() for k in range(len(w) - 34))
    out = {}
    for i, w in split.items():
        gone = set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize(("seed", "how"), [(1, {}), (2, {}), (3, {"part_chars": 200, "first_bits": 2})])
def test_repeats(spark, seed, how):
    data = corpus(seed)
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = rows(anchors.remove_repeats(df, **how))
    want = removed({i: t for i, t, *_ in data})
    assert {i: (r.n_words, r.n_removed, r.kept) for i, r in out.items()} == want
    assert any(n for _, n, _ in want.values())
    assert anchors.remove_repeats(df.limit(0)).count() == 0


def test_bpe_agrees_with_the_library(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.default_path())
    out = rows(bpe.encode_decode(docs, keep=("source",)))
    assert len(out) == len(corpus())
    for i, t, _, s, _ in corpus():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert (list(out[i].ids), out[i].decoded, out[i].source) == (ids, tokenizer.decode(ids, skip_special_tokens=False), s)
    assert bpe.encode_decode(empty).count() == 0


def test_bpe_words():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.default_path())
    with open(bpe.default_path(), encoding="utf-8") as f:
        mine = bpe.Bpe(f.read())
    hard = ["ΑΣ ΣΑΣ", "It's DON'T <|endoftext|>Foo<|startoftext|> x<|x", "İstanbul ǅ", "a" * 5000, "é́ ẛ̣", "x\x1cy\x85z", "!!'ll''re", "12 3.4", "日本語 テスト"]
    rnd = random.Random(5)
    hard += ["".join(rnd.choice("abcdeéèßΣs'<|>tI 1\n") for _ in range(60)) for _ in range(300)]
    for text in hard:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == ids, text
        assert mine.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_fingerprints(docs, empty):
    data = corpus()
    out = rows(imatch.fingerprint_neighbours(docs))
    texts = [t or "" for _, t, *_ in data]
    for k, t in enumerate(texts):
        half = len(t) // 2
        changed = t[: len(t) - half] + texts[(k + 1) % len(texts)][:half]
        assert out[k].n_chars == len(t) and out[k].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= out[k].near_edited <= 1 and 0 <= out[k].near_next <= 1
        if changed == t:
            assert out[k].near_edited == 1 and out[k].fingerprint == out[k].edited_fingerprint
    by_text = collections.defaultdict(set)
    for k, t in enumerate(texts):
        by_text[t].add(out[k].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert len({v for s in by_text.values() for v in s}) > 0.8 * len(by_text)
    assert sum(r.near_edited for r in out.values()) > 2 * sum(r.near_next for r in out.values() if r.doc_id < 90)
    assert imatch.fingerprint_neighbours(empty).count() == 0
    assert rows(imatch.fingerprint_neighbours(docs.where("doc_id = 20")))[20].near_next == 1


def mixed(x: int) -> int:
    from threadlens.llm.textarrays import mix64
    import numpy as np

    return int(mix64(np.array([x], dtype=np.uint64))[0])


def test_fingerprints_by_sets(spark):
    """Likenesses from the sets themselves: terms of the band, random subsets, and which intersections are equal."""
    import numpy as np

    from threadlens.llm.textarrays import Words, alnum_table

    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice("abcdeé0") for _ in range(rnd.randint(2, 6))) for _ in range(400)]
    texts = [" ".join(rnd.choice(vocabulary[:rnd.randint(1, 400)]) for _ in range(rnd.choice([0, 1, 3, 30, 200]))) for _ in range(120)]
    texts += [texts[7], texts[7] + " " + vocabulary[3], None, "zz9 zz8", "zz9 zz8", "", "É é", "word" * 9000, "\ua7c0b \ua7c0c", "\ua7c1b \ua7c1c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    lexicon = imatch.fit_lexicon(df)
    split = lambda t: set(re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower()))

    def term(word):
        raw = np.frombuffer(word.encode(), dtype=np.uint8)
        return int(Words(raw, np.array([0, len(raw)]), alnum_table()).hashes()[0])

    n, df_of = len(texts), collections.Counter(w for t in texts for w in split(t or ""))
    band = {w: term(w) for w, c in df_of.items() if max(2, 0.001 * n) <= c <= max(2, 0.1 * n)}
    assert sorted(band.values()) == lexicon.terms.tolist() and len(band) > 50
    level = {w: [int(lexicon.level[j][int(np.searchsorted(lexicon.terms, np.uint64(t)))]) for j in range(imatch.SUBSETS)] for w, t in band.items()}
    for w, t in list(band.items())[:30]:  # a term is in level l or above with the chance 2 ** -l: trailing zeros of a scrambled hash
        x = mixed((t + 1 * 1000003) % 2**64)
        assert level[w][0] == min((x & -x).bit_length() - 1, imatch.LEVELS - 1)

    def like(a: str, b: str) -> float:
        sets = [{w for w in split(t) if w in band} for t in (a, b)]
        if not all(sets):
            return float(not any(sets) and split(a) == split(b))
        lows = [min(max(math.floor(math.log2(len(s))) - 1, 0), imatch.LEVELS - imatch.SHOWN) for s in sets]
        same = either = 0
        for j in range(imatch.SUBSETS):
            for at in range(max(lows), min(lows) + imatch.SHOWN):
                x, y = ({w for w in s if level[w][j] >= at} for s in sets)
                either += bool(x or y)
                same += bool(x and x == y)
        return same / either if either else 0.0

    out = rows(imatch.fingerprint_neighbours(df, lexicon=lexicon))
    plain = [t or "" for t in texts]
    for k, t in enumerate(plain):
        after = plain[(k + 1) % n]
        changed = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert out[k].near_edited == pytest.approx(like(t, changed)) and out[k].near_next == pytest.approx(like(t, after)), k
        assert imatch.likeness(out[k].fingerprint, out[k].edited_fingerprint) == out[k].near_edited
        assert imatch.likeness(out[k].fingerprint, out[(k + 1) % n].fingerprint) == out[k].near_next
    whole = rows(imatch.fingerprint_neighbours(df))
    assert {k: tuple(r) for k, r in whole.items()} == {k: tuple(r) for k, r in out.items()}


def within_one_word(a: list[str], b: list[str]) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def test_lines(docs, empty):
    lines = [(i, n, WORDS.findall(x)) for i, t, *_ in corpus() if t is not None for n, x in enumerate(t.split("\n"))]
    want = {}
    for k, (i, n, w) in enumerate(lines):
        exact = len(w) > 0 and any(w == v for _, _, v in lines[:k])
        near = not exact and len(w) >= 5 and any(v != w and len(v) >= 5 and within_one_word(w, v) for _, _, v in lines[:k])
        # a near line's later equals go as exact; an equal of an earlier near one goes too
        want[i, n] = (exact, near)
    decided = line_dedup.LineDecisions(docs)
    out = {(r.id, r.line_no): (r.exact, r.near) for r in decided.lines.collect()}
    assert out == want
    assert any(near for _, near in want.values()) and any(exact for exact, _ in want.values())
    cut = rows(decided.texts())
    for i, t, *_ in corpus():
        kept = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if not any(want[i, n]))
        assert cut[i].text == kept
    assert line_dedup.LineDecisions(empty).texts().count() == 0


def test_line_edits(spark):
    base = [f"w{k}" for k in range(14)]
    variants = {1: base, 2: base[:5] + base[6:], 3: base[:5] + ["new"] + base[5:], 4: base[:5] + ["other"] + base[6:], 5: base[:5] + ["a", "b"] + base[7:], 6: base[:9], 7: base[:8], 8: base[:5], 9: ["x"] + base[1:5], 10: base[:4], 11: ["x"] + base[1:4], 12: base[:4], 13: ["日本語"], 14: ["日本語"], 15: []}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in variants.items()], "doc_id long, text string")
    gone = {r.id for r in line_dedup.LineDecisions(df).lines.where("exact OR near").collect()}
    assert gone == {2, 3, 4, 7, 9, 12, 14}  # 5 has two words changed; an edit of four words is too much


def test_line_keys_of_many_lines(spark):
    """Lines of the same words in other places, and lines whose parts are equal, have keys of their own."""
    rnd = random.Random(3)
    base = [f"w{k}" for k in range(8)]
    texts = {"\n".join(" ".join(rnd.sample(base, rnd.randint(5, 8))) for _ in range(30)) for _ in range(20)}
    data = list(enumerate(sorted(texts)))
    lines = [(i, n, x.split(" ")) for i, t in data for n, x in enumerate(t.split("\n"))]
    want = set()
    for k, (i, n, w) in enumerate(lines):
        if any(within_one_word(w, v) for _, _, v in lines[:k]):
            want.add((i, n))
    out = line_dedup.LineDecisions(spark.createDataFrame(data, "doc_id long, text string")).lines.where("exact OR near")
    assert {(r.id, r.line_no) for r in out.collect()} == want and 0 < len(want) < len(lines)


def test_digests(docs, empty, spark, tmp_path):
    data = corpus()
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t, *_ in data}
    first, n = {}, collections.Counter(norm.values())
    for i in sorted(norm):
        first.setdefault(norm[i], i)
    index = digest_index.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    out = rows(index.add(docs))
    assert {i: (r.keep_id, r.group_size, r.kept) for i, r in out.items()} == {i: (first[t], n[t], first[t] == i) for i, t in norm.items()}
    assert all(r.digest == hashlib.sha256(norm[i].encode()).digest() for i, r in out.items())
    assert index.rows().count() == len(first)
    again = digest_index.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    late = spark.createDataFrame([(1000, "x"), (1001, "brand new"), (1002, "brand  new")], "doc_id long, text string")
    out = {i: (r.keep_id, r.kept) for i, r in rows(again.add(late)).items()}
    assert out == {1000: (first["x"], False), 1001: (1001, True), 1002: (1001, False)}
    assert again.rows().count() == len(first) + 1
    assert again.add(empty).count() == 0
    before = sorted(map(tuple, again.rows().collect()))
    again.compact()
    assert (again.version, again.buckets) == (1, 64) and sorted(map(tuple, again.rows().collect())) == before
    reopened = digest_index.DigestIndex(spark, str(tmp_path / "index"))
    assert (reopened.version, reopened.buckets) == (1, 64)
    assert {i: (r.keep_id, r.kept) for i, r in rows(reopened.add(late)).items()} == {1000: (first["x"], False), 1001: (1001, False), 1002: (1001, False)}
    with pytest.raises(ValueError):
        reopened.add(late.withColumn("doc_id", late["doc_id"].cast("string")))
    reopened.close()
    assert reopened.table not in {t.name for t in spark.catalog.listTables()}
    assert [digest_index.buckets_for(n) for n in (0, 1, 64_000_000, 64_000_001, 10**15)] == [64, 64, 64, 128, 65_536]


def test_batches_can_be_added_again(docs, spark, tmp_path, monkeypatch):
    """A batch that died before, in the midst of, or after its append gives, added again, what it would have given."""
    index_of = lambda name: digest_index.DigestIndex(spark, str(tmp_path / name), buckets=4)
    early = spark.createDataFrame([(5000, "x"), (5001, "only early")], "doc_id long, text string")
    late = spark.createDataFrame([(1000, "x"), (1001, "brand new"), (1002, "brand  new"), (1003, None), (1001, "brand new"), (1004, "more")], "doc_id long, text string")
    plain = index_of("plain")
    plain.add(early, batch="a")
    want = sorted(map(str, plain.add(late, batch="b").collect()))
    state = sorted(map(str, plain.rows().collect()))
    append = digest_index.DigestIndex._append
    for name, share in (("before", None), ("midst", "hex(digest) < '8'"), ("after", "true")):
        index = index_of(name)
        index.add(early, batch="a")

        def dies(self, digests, share=share):
            if share:
                append(self, digests.where(share))
            raise OSError("the driver is lost")

        monkeypatch.setattr(digest_index.DigestIndex, "_append", dies)
        with pytest.raises(OSError):
            index.add(late, batch="b")
        monkeypatch.setattr(digest_index.DigestIndex, "_append", append)
        for _ in range(2):
            again = index_of(name)
            assert sorted(map(str, again.add(late, batch="b").collect())) == want
            assert sorted(map(str, again.rows().collect())) == state
        assert not any(r.kept for r in again.add(late, batch="c").collect())
    # a compaction that died leaves nothing behind that the next one would take for rows
    monkeypatch.setattr(digest_index.DigestIndex, "_note", lambda self, *_: dies(self, again.rows(), None))
    with pytest.raises(OSError):
        again.compact()
    monkeypatch.undo()
    again = index_of("after")
    again.compact()
    assert sorted(map(str, again.rows().collect())) == state


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, by the contract's patterns alone."""
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    out = [(m.start(), 0, m.end()) for m in email.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in card.finditer(t):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in phone.finditer(t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_personal_data(spark, empty):
    rnd = random.Random(4)
    parts = ["a.b@c-d.ef", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "999.1.1.1", "+1 (017) 555-5036", "é", " ", ".", "@", "5", "-", "+", "x"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(3000)] + ["", None, "9" * 20000, "a" * 20000 + "@b.c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = rows(pii.find_pii(df))
    for i, t in enumerate(texts):
        base = [(s.start, pii.KINDS.index(s.kind), s.end) for s in out[i].spans if s.kind in pii.BASE_KINDS]
        assert base == base_spans(t or ""), t
    assert pii.find_pii(empty).count() == 0


@pytest.mark.parametrize("number", ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO9386011117947"])
@pytest.mark.parametrize("after", [" BIC COBADEFFXXX", " I am", " 12 A", "", ".", " GB82 WEST 1234 5698 7654 32"])
def test_iban_before_other_words(number, after):
    found = [(a, b) for k, a, b, _ in pii.spans(f"IBAN {number}{after}") if k == "iban"]
    assert (5, 5 + len(number)) in found and len(found) == 1 + ("WEST" in after)


def test_national_numbers_and_secrets():
    found = lambda t: [(k, t[a:b]) for k, a, b, _ in pii.spans(t) if k not in pii.BASE_KINDS]
    assert found("NIR 1 84 12 76 451 089 46, DNI 12345678Z, NIE X1234567L") == [("national_id", "1 84 12 76 451 089 46"), ("national_id", "12345678Z"), ("national_id", "X1234567L")]
    assert not found("1 84 12 76 451 089 47 12345678A X1234567T order 12345678Z")
    assert found("her SSN is 219-09-9999") == [("ssn", "219-09-9999")] and not found("219-09-9999") and not found("SSN 000-12-3456 666-12-3456 912-12-3456 123-00-1234")
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert found(f'é token = "{key}" and') == [("secret", key)] and found(f"API_KEY:{key}") == [("secret", key)]
    assert not found(f"commit {key}") and not found("password = aaaaaaaaaaaaaaaa1") and not found("token = wholly-unlikely-words")
    aws, pem = "AKIA" + "ABCDEFGH" + "23456789", "-----BEGIN RSA PRIVATE KEY-----"
    assert found(f"use {aws}. {pem}") == [("secret", aws), ("secret", pem)] and not found(f"for example {aws}")
    assert pii.random_looking(key) and not pii.random_looking("a1" * 20)


def test_iban_and_context():
    good, bad = "GB82 WEST 1234 5698 7654 32", "GB83 WEST 1234 5698 7654 32"
    assert [(k, t) for k, a, b, _ in pii.spans(f"é {good}.") for t in [f"é {good}."[a:b]] if k == "iban"] == [("iban", good)]
    assert not [k for k, *_ in pii.spans(bad) if k == "iban"]
    assert not [k for k, *_ in pii.spans(f"token {good}") if k == "iban"]
    near, far = pii.score("call +1 (017) 555-5036", "phone", 5, 22), pii.score("xxxx +1 (017) 555-5036", "phone", 5, 22)
    assert near > far


def test_languages(spark, empty):
    rnd = random.Random(2)
    syllables = {"de": "schen ung ein ich der zu ge", "en": "the ing tion er and ou st", "fr": "eau eux ment que ou é tre"}
    data = []
    for i in range(240):
        lang = sorted(syllables)[i % 3]
        data.append((i, " ".join("".join(rnd.choice(syllables[lang].split()) for _ in range(2)) for _ in range(30)), None if i % 4 == 0 else lang))
    data += [(900, None, "en"), (901, "123 !!", "de"), (902, "", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    out = rows(langid.predict(df, langid.fit(df.where(~langid.held_out()))))
    assert all(out[i].lang_pred == sorted(syllables)[i % 3] and 0 <= out[i].score <= 1 for i in range(240))
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (900, 901, 902))
    assert langid.fit(empty).languages == [] and langid.predict(empty, langid.Profiles({})).count() == 0
    held = {r.doc_id: r.h for r in df.select("doc_id", langid.held_out().alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in held.items())


def test_languages_by_brute_force(spark):
    """Profiles, distances and scores from plain counts, equal distances included."""
    rnd = random.Random(12)
    letters = {"aa": "abcdeé", "bb": "defghß", "cc": "abcdeé"}  # two languages alike
    data = []
    for i in range(90):
        lang = sorted(letters)[i % 3]
        text = " ".join("".join(rnd.choice(letters[lang]) for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(0, 25)))
        data.append((i, rnd.choice([text, text.upper(), text + " 12, x-y\n"]), None if i % 7 == 0 else lang))
    data += [(i + 100, t, "dd" if g == "bb" else None) for i, t, g in data[:60]] + [(300, None, "aa"), (301, "", "ee")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")

    def counts(text):
        out = collections.Counter()
        for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
            padded = f" {word} "
            out.update(word)
            out.update(padded[k : k + 2] for k in range(len(padded) - 1))
            out.update(padded[k : k + 3] for k in range(len(padded) - 2))
        return out

    code = lambda gram: sum(ord(c) << 21 * (len(gram) - 1 - k) for k, c in enumerate(gram))
    ranked = lambda c, k: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], code(x[0])))[:k]]
    total = collections.defaultdict(collections.Counter)
    for _, t, g in data:
        if g:
            total[g].update(counts(t))
    profiles = {g: ranked(c, 30) for g, c in total.items() if c}
    model = langid.fit(df, size=30)
    assert model.languages == sorted(profiles) == ["aa", "bb", "cc", "dd"]
    out = rows(langid.predict(df, model))
    tied = 0
    for i, t, _ in data:
        top = ranked(counts(t), langid.COMPARED)
        if not top:
            assert (out[i].lang_pred, out[i].score) == ("und", 0.0)
            continue
        apart = {g: sum(min(abs(p.index(x) - k), 30) if x in p else 30 for k, x in enumerate(top)) for g, p in profiles.items()}
        best = min(sorted(apart), key=apart.get)
        tied += list(apart.values()).count(apart[best]) > 1
        assert out[i].lang_pred == best and out[i].score == pytest.approx(1 - apart[best] / (30 * len(top)))
    same = langid.Profiles({"z": model_codes(profiles["aa"], code), "b": model_codes(profiles["aa"], code)})
    assert same.predict("abc")[0] == "b"


def model_codes(grams, code):
    return [code(g) for g in grams]


def test_fit_sample_is_bounded(spark):
    df = spark.createDataFrame([(i, "abc", "xx") for i in range(4000)] + [(i, "de", "yy") for i in range(50)], "doc_id long, text string, lang string")
    n = collections.Counter(r.lang for r in langid.chosen_rows(df, rows=500).collect())
    assert 400 < n["xx"] < 600 and n["yy"] == 50


def test_language_ngrams():
    codes = langid.ngram_codes("Ab, c")
    one = [c for c in codes if c < 1 << 21]
    assert sorted(one) == sorted(map(ord, "abc"))
    assert len(codes) == 3 + 5 + 3  # " a" "ab" "b " " c" "c "; " ab" "ab " " c "
    assert math.isclose(langid.Profiles({"x": list(langid.top_ngrams("ab c", 400))}).predict("AB C")[1], 1.0)


def test_repeated_rows(docs):
    """Repeated rows are answered alike by every operator that answers by row."""
    twice = docs.unionByName(docs.where("doc_id % 3 = 0"))
    n = twice.count()
    answers = {
        "shards": sharding.shard_by_bytes(twice, shards=4).drop("slot", "shard"),
        "mix": mixing.Mix(twice, block=16).taken().drop("taken", "shard", "position"),
        "near": probminhash.NearDuplicates(twice).result().drop("kept"),
        "repeats": anchors.remove_repeats(twice),
        "bpe": bpe.encode_decode(twice),
        "lines": line_dedup.LineDecisions(twice).texts().select("doc_id", "text", "_n_lines", "_n_exact", "_n_near"),
        "digests": digest_index.exact_dedup(twice),
        "pii": pii.find_pii(twice),
        "languages": langid.predict(twice, langid.fit(twice)),
    }
    for name, df in answers.items():
        got = df.collect()
        assert len(got) == n, name
        by_id = collections.defaultdict(set)
        for r in got:
            by_id[r.doc_id].add(str(r))
        assert all(len(v) == 1 for v in by_id.values()), name
    assert imatch.fingerprint_neighbours(twice).count() == n
    alone = {r.doc_id: (r.text, r._n_exact, r._n_near) for r in line_dedup.LineDecisions(docs).texts().collect()}
    assert {r.doc_id: (r.text, r._n_exact, r._n_near) for r in answers["lines"].collect()} == alone
    sets = {i: shingle_set(t) for i, t, *_ in corpus()}
    groups = len({c for i, c in classes(sets).items() if sets[i]}) + sum(2 - (i % 3 > 0) for i, x in sets.items() if not x)
    assert answers["near"].count() == n and probminhash.NearDuplicates(twice).result().where("kept").count() == groups
    mix = mixing.Mix(twice, block=16, whole=True)
    taken, words = collections.Counter(), collections.Counter()
    for r in mix.taken().collect():
        taken[r.doc_id] += r.taken
    for r in mix.texts().collect():
        words[r.doc_id] += len(WORDS.findall(r.text))
    assert +taken == +words


def awkward() -> list[tuple]:
    """Rows whose ids are null or shared, with texts equal and not."""
    texts = [t for _, t, *_ in corpus(5, 40)]
    return [(None if k % 3 == 0 else k % 10, t, ["s", None][k % 2]) for k, t in enumerate(texts)] + [(None, texts[20], "s"), (None, texts[20], "s"), (1, texts[21], "s"), (2, texts[21], "s")]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_null_and_shared_ids(spark, kind):
    data = [(i if i is None or kind == "long" else f"id {i}", t, s) for i, t, s in awkward()]
    df = spark.createDataFrame(data, f"doc_id {kind}, text string, source string").repartition(3)
    n = len(data)
    texts = {k: t for k, (_, t, _) in enumerate(data)}
    many = lambda df, *c: collections.Counter(tuple(r[x] for x in c) for r in df.collect())
    # substring dedup: each row by its own text
    want = collections.Counter((data[k][0], *v) for k, v in removed(texts).items())
    assert many(anchors.remove_repeats(df), "doc_id", "n_words", "n_removed", "kept") == want
    # near-dedup: classes of texts, one row of each stays
    class_of = classes({k: shingle_set(t) for k, t in texts.items()})
    size = collections.Counter(class_of.values())
    least = {c: min((data[k][0] for k in texts if class_of[k] == c and data[k][0] is not None), default=None) for c in size}
    near = probminhash.NearDuplicates(df)
    assert many(near.result(), "doc_id", "class_id", "class_size") == collections.Counter((data[k][0], least[c] if size[c] > 1 else data[k][0], size[c]) for k, c in class_of.items())
    stays = near.kept_rows().collect()
    assert near.result().where("kept").count() == len(stays) == len(size)
    assert {tuple(sorted(shingle_set(r.text))) for r in stays} == {tuple(sorted(shingle_set(t))) for k, t in texts.items() if class_of[k] == k}
    # exact dedup
    norm = {k: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for k, t in texts.items()}
    keep = {t: min((data[k][0] for k in texts if norm[k] == t and data[k][0] is not None), default=None) for t in norm.values()}
    group = collections.Counter(norm.values())
    assert many(digest_index.exact_dedup(df), "doc_id", "keep_id", "group_size") == collections.Counter((data[k][0], keep[t], group[t]) for k, t in norm.items())
    # line dedup: rows by id (null first), then text hash; lines within a row in order
    order = {(r.id, r.text): r.th for r in df.selectExpr("doc_id AS id", "text", "xxhash64(text) AS th").collect()}
    ranked = sorted({(i, t) for i, t, _ in data if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0, order[x]) if kind == "long" else (x[0] is not None, x[0] or "", order[x]))
    lines = sorted(((ranked.index((i, t)), i, t, j, tuple(WORDS.findall(x))) for i, t in ranked for j, x in enumerate(t.split("\n"))), key=lambda x: (x[1] is not None, x[1] or (0 if kind == "long" else ""), x[3], x[0]))
    exact, seen = collections.Counter(), set()
    for _, i, t, j, w in lines:
        exact[i, t] += bool(w) and w in seen
        seen.add(w)
    got = collections.Counter()
    decided = line_dedup.LineDecisions(df)
    for r in decided.per_document().collect():
        got[r.id, r.n_exact] += 1
    assert got == collections.Counter((i, exact[i, t]) for i, t in ranked)
    assert decided.texts().count() == n
    # the others answer every row
    placed = sharding.shard_by_bytes(df, shards=4).collect()
    slots = collections.defaultdict(list)
    for r in placed:
        slots[r.shard].append(r.slot)
    assert len(placed) == n and all(sorted(x) == list(range(len(x))) for x in slots.values())
    mix = mixing.Mix(df, block=16, whole=True)
    assert sum(r.taken for r in mix.taken().collect()) == sum(len(WORDS.findall(r.text)) for r in mix.texts().collect()) and mix.taken().count() == n
    assert many(bpe.encode_decode(df), "doc_id") == many(pii.find_pii(df), "doc_id") == many(langid.predict(df, langid.Profiles({})), "doc_id") == many(df, "doc_id")
    by_text = collections.defaultdict(set)
    prints = imatch.fingerprint_neighbours(df).collect()
    assert collections.Counter(r.doc_id for r in prints) == collections.Counter(i for i, *_ in data)
    for r in prints:
        by_text[r.fingerprint].add(r.n_chars)
    assert all(len(v) == 1 for f, v in by_text.items() if not f.startswith("w:"))


def test_very_long_texts(spark):
    """A text of some megabytes beside its near copy and short ones, in every operator."""
    from tokenizers import Tokenizer

    rnd = random.Random(13)
    vocabulary = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(2, 8))) for _ in range(3000)]
    words = [rnd.choice(vocabulary) for _ in range(300_000)]
    long = "\n".join(" ".join(words[k : k + 20]) for k in range(0, len(words), 20))
    near = long.replace(words[500], "other", 3) + "\nmail a.b@c.de +1 (017) 555-5036"
    texts = [long, near, "a short text", None, "x" * 2_500_000, " ".join(words[100:160])]
    df = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    assert [r.class_id for r in probminhash.NearDuplicates(df).result().orderBy("doc_id").collect()] == [0, 0, 2, 3, 4, 5]
    want = removed(dict(enumerate(texts)))
    assert {i: (r.n_words, r.n_removed, r.kept) for i, r in rows(anchors.remove_repeats(df)).items()} == want
    tokenizer = Tokenizer.from_file(bpe.default_path())
    coded = rows(bpe.encode_decode(df))
    assert all(list(coded[i].ids) == tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts))
    lines = rows(line_dedup.LineDecisions(df).texts())
    seen, kept = set(), {}
    for i, t in enumerate(texts):
        kept[i] = [] if t is None else [x for x in t.split("\n") if x not in seen]
        seen.update(kept[i])
    assert all(lines[i].text == "\n".join(kept[i]) for i in (0, 2, 4)) and lines[1]._n_exact + lines[1]._n_near >= len(words) // 20 - 3
    assert [(k, near[a:b]) for k, a, b, _ in rows(pii.find_pii(df))[1].spans] == [("email", "a.b@c.de"), ("phone", "+1 (017) 555-5036")]
    mix = mixing.Mix(df, whole=True)
    assert {r.doc_id: r["size"] for r in mix.taken().collect()} == {i: len(WORDS.findall(t or "")) for i, t in enumerate(texts)}
    assert sum(len(WORDS.findall(r.text)) for r in mix.texts().collect()) == sum(r.taken for r in mix.taken().collect())
    assert {i: r.n_chars for i, r in rows(imatch.fingerprint_neighbours(df)).items()} == {i: len(t or "") for i, t in enumerate(texts)}
    assert all(r.group_size == 1 for r in digest_index.exact_dedup(df).collect())
    assert sharding.shard_by_bytes(df, shards=3).count() == 6 and langid.predict(df, langid.fit(df)).count() == 6


def test_tokenizer_files_of_other_forms_are_refused(docs):
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    with pytest.raises(ValueError):
        bpe.encode_decode(docs, keep=("ids",))
