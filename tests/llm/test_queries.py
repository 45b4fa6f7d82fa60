"""The registered queries: columns, the pipeline's stages, and an unknown shared folder."""

from __future__ import annotations

import collections
import hashlib
import zlib

import pytest

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op1": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op2": ["doc_id", "size", "source_size", "target", "taken", "shard", "position"],
    "op4": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op5": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op6": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op8": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op9": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op10": ["doc_id", "held_out", "lang_pred", "score"],
    "op11": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
}


def registered():
    import __spark_entry__

    return __spark_entry__.queries()


@pytest.mark.parametrize("op", sorted(COLUMNS))
def test_columns(spark, op):
    name = next(n for n in registered() if n.startswith(f"{op}_"))
    df = registered()[name](spark, SF)
    assert set(COLUMNS[op]) <= set(df.columns)
    assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_every_operator_is_registered():
    names = registered()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_pipeline(spark):
    """Each stage against a plain version of it, on the stage before."""
    import corpus_pipeline as p
    from test_rows import WORDS, classes, fill, shingle_set, within_one_word
    from tokenizers import Tokenizer

    from threadlens.llm import bpe
    from threadlens.llm.common import save

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, got = docs.columns, {}
    for name, stage in p.STAGES:
        before = docs
        docs = save(stage(spark, before, SF), "test-stage")
        got[name] = (before.collect(), docs.collect())
        if name != "bpe":
            assert docs.columns == columns
    before, after = got["language_id"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")}
    before, after = got["line_dedup"]
    lines = [(r.doc_id, n, WORDS.findall(x)) for r in sorted(before, key=lambda r: r.doc_id) if r.text is not None for n, x in enumerate(r.text.split("\n"))]
    gone, by_size, seen = set(), collections.defaultdict(list), set()
    for i, n, w in lines:
        if (w and tuple(w) in seen) or (len(w) >= 5 and any(within_one_word(w, v) for k in (-1, 0, 1) for v in by_size[len(w) + k])):
            gone.add((i, n))
        if len(w) >= 5:
            by_size[len(w)].append(w)
        seen.add(tuple(w))
    cut = {r.doc_id: None if r.text is None else "\n".join(x for n, x in enumerate(r.text.split("\n")) if (r.doc_id, n) not in gone) for r in before}
    assert {r.doc_id: r.text for r in after} == {i: t for i, t in cut.items() if t != "" or not any(i == j for j, _ in gone)}
    before, after = got["near_dedup"]
    want = classes({r.doc_id: shingle_set(r.text) for r in before})
    assert {r.doc_id for r in after} == {i for i, c in want.items() if i == c}
    before, after = got["mix_sources"]
    sizes, taken = collections.Counter(), collections.Counter()
    for r in before:
        sizes[r.source] += len(WORDS.findall(r.text or ""))
    for r in after:
        taken[r.source] += len(WORDS.findall(r.text))
        assert r.n_chars == len(r.text)
    target = fill(dict(sizes))
    assert all(abs(taken[s] - target[s]) <= 128 for s in sizes)
    before, after = got["bpe"]
    tokenizer = Tokenizer.from_file(bpe.default_path())
    ids = [tokenizer.encode(r.text or "", add_special_tokens=False).ids for r in before]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    plain = sorted((r.doc_id, len(i), sha(" ".join(map(str, i))), sha(tokenizer.decode(i, skip_special_tokens=False))) for r, i in zip(before, ids, strict=True))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after) == plain
    assert sorted(map(tuple, p.run(spark, SF).collect())) == sorted(map(tuple, after))


def test_language_stage_rejects_unknown_scripts(spark):
    """Texts without an n-gram of any profile score 0 and go; a score between 0 and the bound is enough to go."""
    import corpus_pipeline as p

    docs = spark.createDataFrame(
        [(i, f"some plain english words {i} of the kind that are written", "en", "s", 10) for i in range(40)]
        + [(100, "нечто совсем другое", None, "s", 19), (101, "完全に違う文字", None, "s", 7), (102, "нечто совсем другое e нечто", None, "s", 27), (103, "12 !", "en", "s", 4), (104, None, "en", "s", 0)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    from threadlens.llm import langid

    scores = {r.doc_id: r.score for r in langid.predict(docs, langid.fit(docs.where(~langid.held_out()))).collect()}
    assert scores[100] == scores[101] == 0 < scores[102] < p.LEAST_SCORE < min(scores[i] for i in range(40))
    assert {r.doc_id for r in p.language_id(spark, docs, SF).collect()} == set(range(40))


def test_stages_on_awkward_tables(spark):
    """Nulls in every column, repeated rows, clashing names and empty tables in all stages."""
    import corpus_pipeline as p
    from test_rows import CLASHES, WORDS, corpus
    from pyspark.sql import functions as F

    data = corpus(7, 50) + [(None, "a line of words that is here\nand another of them", None, None, None), (None, None, None, None, None)]
    data += [data[20], data[20], (5, data[30][1], "en", "s1", 3)]
    plain = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs = plain.withColumns({k: F.lit(v) for k, v in CLASHES.items()})
    n, left = docs.count(), {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        if name == "bpe":
            assert out.count() == docs.count()
            continue
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        left[name] = out.collect()
        assert all(r.score == 1 and r.lang_pred == 1 and r._gone == 1 and r._th2 == 1 and r.ids == 1 and r.row == 1 for r in left[name]), name
    assert {r.text for r in left["language_id"]} <= {t for _, t, *_ in data if t and any(c.isalpha() for c in t)}
    assert len(left["line_dedup"]) < n and all(r.n_chars == (None if r.text is None else len(r.text)) for r in left["line_dedup"])
    texts = [r.text for r in left["near_dedup"]]
    assert texts.count(data[20][1]) == 1 and texts.count(None) == sum(t is None for _, t, *_ in data)
    assert all(r.text and WORDS.findall(r.text) and r.n_chars == len(r.text) for r in left["mix_sources"])
    assert any(r.source is None for r in left["mix_sources"])


def table(spark, folder=SF):
    return {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_shard_query(spark):
    docs, sizes, slots = table(spark), collections.Counter(), collections.defaultdict(list)
    for r in registered()["op1_shard"](spark, SF).collect():
        raw = (docs[r.doc_id].text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == len(docs) and set(slots) <= set(range(24))
    most = max(len((d.text or "").encode()) for d in docs.values()) + 8
    assert max(abs(sizes[s] - sum(sizes.values()) / 24) for s in range(24)) <= most


def test_mix_query(spark):
    from test_rows import WORDS, fill

    docs, sizes, taken = table(spark), collections.Counter(), collections.Counter()
    for d in docs.values():
        sizes[d.source] += len(WORDS.findall(d.text or ""))
    want = fill(dict(sizes))
    for r in registered()["op2_mix"](spark, SF).collect():
        d = docs[r.doc_id]
        assert r["size"] == len(WORDS.findall(d.text or "")) and r.source_size == sizes[d.source] and r.target == pytest.approx(want[d.source]) and 0 <= r.taken <= 2 * r["size"]
        taken[d.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 128 for s in sizes)


def test_bpe_query(spark):
    from tokenizers import Tokenizer

    from threadlens.llm import bpe

    tokenizer, docs = Tokenizer.from_file(bpe.default_path()), table(spark)
    for r in registered()["op5_bpe"](spark, SF).collect():
        ids = tokenizer.encode(docs[r.doc_id].text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))


def test_fingerprint_query(spark):
    from threadlens.llm import imatch

    docs = table(spark)
    order, out = sorted(docs), {r.doc_id: r for r in registered()["op6_imatch"](spark, SF).collect()}
    by_text = collections.defaultdict(set)
    for k, i in enumerate(order):
        after = order[(k + 1) % len(order)]
        text, following = docs[i].text or "", docs[after].text or ""
        half = len(text) // 2
        assert (out[i].n_chars, out[i].edited_sha256) == (len(text), sha(text[: len(text) - half] + following[:half]))
        assert out[i].near_next == imatch.likeness(out[i].fingerprint, out[after].fingerprint) and out[i].near_edited == imatch.likeness(out[i].fingerprint, out[i].edited_fingerprint)
        by_text[text].add(out[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_personal_data_query(spark):
    from test_rows import base_spans

    from threadlens.llm import pii

    docs, names = table(spark, "/root/testdata/sf0.01"), pii.BASE_KINDS
    some = 0
    for r in registered()["op9_pii"](spark, "/root/testdata/sf0.01").collect():
        found = [(names[k], a, b) for a, k, b in base_spans(docs[r.doc_id].text or "")]
        count = collections.Counter(k for k, *_ in found)
        assert [r[f"n_{k}"] for k in names] == [count[k] for k in names]
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in found))
        assert {f"{k}:{a}:{b}" for k, a, b in found} <= set(r.spans.split(","))
        some += len(found)
    assert some > 30


def test_language_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = table(spark, folder)
    right = n = 0
    for r in registered()["op10_langid"](spark, folder).collect():
        d = docs[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in d.text or ""))
        if r.held_out and d.lang is not None and len(d.text or "") > 100:
            n, right = n + 1, right + (r.lang_pred == d.lang)
    assert n > 50 and right / n > 0.95
