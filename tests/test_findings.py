"""Queries against their SQL on small tables that show what larger ones were found to break."""

from __future__ import annotations

import datetime as dt
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from threadlens.operators import pov
from threadlens.operators.splitter import Splitter
from threadlens.plans import feature_queries, history_queries, source_queries, text_queries
from threadlens.plans.registry import ORACLES, QUERIES
from threadlens.sources import sinks

assert feature_queries and history_queries and source_queries and text_queries
EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def both(spark, folder, name: str, **tables: tuple[list[tuple], str]) -> tuple[list, list]:
    """The rows of a query and of its SQL over given tables, sorted."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    said = con.execute(ORACLES[name])
    names = [d[0] for d in said.description]
    return sorted(tuple(r[c] for c in names) for r in df.collect()), sorted(said.fetchall())


def at(day: int, seconds: float) -> dt.datetime:
    return dt.datetime(2024, 1, day, 10) + dt.timedelta(seconds=seconds)


def test_seconds_are_rounded(spark, tmp_path):
    times = [at(1, 0.7), at(11, 0.2), at(11, 0.6), at(11, 1.5), at(4, 0.7), at(4, 1.5)]
    rows = [(n, ts, 1, "view", 1.0, "{}") for n, ts in enumerate(times)]
    mine, said = both(spark, tmp_path, "history_counts_asof", events=(rows, EVENT))
    assert mine == said and said[0][2] == 4


@pytest.mark.parametrize("name", ["cohort_dedupe", "matched_bad_content", "matched_good_content"])
def test_matches_by_rounded_seconds(spark, tmp_path, name):
    # by whole seconds cut off user 21 begins nearest to user 1; rounded, both are a second off and the ends decide
    spans = {1: (0.0, 120.0, 400.0), 11: (1.4, 120.0, 1.0), 21: (0.6, 126.0, 1.0)}
    rows = [
        (10 * user + n, at(1, seconds), user, kind, value, '{"k": 1}')
        for user, (begin, end, last) in spans.items()
        for n, (seconds, kind, value) in enumerate([(begin, "view", 1.0), (60.0, "click", 1.0), (end, "view", last)])
    ]
    mine, said = both(spark, tmp_path, name, events=(rows, EVENT))
    assert mine == said and said


def test_copies_of_sentences_are_not_paired(spark, tmp_path):
    # 20,000 rows of one revision have two sentences; their 100 million pairs of rows were each compared
    docs = spark.range(20_000).selectExpr("id * 31 AS doc_id", "'' AS text", "'en' AS lang", "concat('src', (id div 2) % 2) AS source", "0L AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    began = time.monotonic()
    mine = QUERIES["fuzzy_revisions"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in mine] == [(0, 50_000_000)] and time.monotonic() - began < 30


def test_fuzzy_pairs_are_those_of_all_pairs():
    rnd = random.Random(5)
    said = lambda: " ".join(rnd.choice("a b c d e f g h i j".split()) for _ in range(rnd.randint(0, 9)))
    olds, news = [said() for _ in range(150)], [said() for _ in range(150)]
    sets = lambda s: set(s.split())
    share = lambda a, b: len(sets(a) & sets(b)) / max(len(sets(a)), len(sets(b)), 1)
    wanted = [(i, j) for i, a in enumerate(olds) for j, b in enumerate(news) if a != b and len(a.split()) >= 3 and share(a, b) >= 0.6]
    assert sorted(pov.fuzzy_pairs(olds, news)) == wanted and wanted


def test_an_edit_of_many_sentences(spark):
    olds = [f"old{i} told{i} bold{i} the end" for i in range(4000)]
    news = [f"old{i} told{i} bold{i} an end" if i == 7 else f"new{i} few{i} dew{i} the end" for i in range(4000)]
    changes = spark.createDataFrame([(1, olds, news), (2, [], ["a b c"]), (3, None, None)], "k long, deletes array<string>, inserts array<string>")
    began = time.monotonic()
    assert [tuple(r) for r in pov.revised_sentences(changes, "k").collect()] == [(1, olds[7], news[7])]
    assert time.monotonic() - began < 30


def test_patterns_look_at_a_token_once(spark):
    # conditions on words were moved below them, and worked them out again for every token of all texts
    texts = spark.createDataFrame([("Dr. Who met 3. May etc.",)], "text string")
    plan = Splitter(texts).scores._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\p{N}.,]*\p{N}") <= 2  # one for each of the two tables that count words


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_categories_cut_a_text_once(spark, tmp_path):
    texts = ["the and of in", "The LE le und of", "x", "", None, "der " * 30 + "in"]
    docs = ([(n, x, "en", "s", len(x or "")) for n, x in enumerate(texts)], DOCUMENT)
    ours, theirs = both(spark, tmp_path, "top_categories", documents=docs)
    assert ours == theirs
    assert planned(QUERIES["top_categories"](spark, str(tmp_path))).count("split(") == 1


def test_sentiment_cuts_a_text_once(spark, tmp_path):
    texts = ["not the of", "no no of le", "not not in der", "of", "", None, "est " * 40 + "not"]
    docs = ([(n, x, "en", "s", len(x or "")) for n, x in enumerate(texts)], DOCUMENT)
    ours, theirs = both(spark, tmp_path, "sentiment_words", documents=docs)
    assert ours == theirs
    assert planned(QUERIES["sentiment_words"](spark, str(tmp_path))).count("split(") == 1


def test_trained_splitter_counts_texts_once(spark, tmp_path):
    texts = ["He met Dr. Smith. Then he left! It was No. 5. 3. next", "Dr. Jones came. The end.", "", None, "Dr. Who? Yes."] * 3
    docs = ([(n, x, "en", "s", len(x or "")) for n, x in enumerate(texts)], DOCUMENT)
    ours, theirs = both(spark, tmp_path, "trained_sentences", documents=docs)
    assert ours == theirs
    plan = QUERIES["trained_sentences"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [doc_id") == 2  # once for the places of the cuts, once for the texts themselves


def test_ngrams_cut_a_text_once(spark, tmp_path):
    docs = ([(n, x, "en", "s", 1) for n, x in enumerate(["a b a b c"] * 41 + ["a", "", None, "b a"])], DOCUMENT)
    ours, theirs = both(spark, tmp_path, "ngram_df", documents=docs)
    assert ours == theirs and len(ours) == 6
    assert planned(QUERIES["ngram_df"](spark, str(tmp_path))).count("split(") == 1


def test_late_rows_are_dealt_to_groups(spark, tmp_path):
    from threadlens.streaming.events import LATE_GROUPS, split_late

    spark.createDataFrame([], "u long, ts timestamp").write.parquet(f"{tmp_path}/in")
    split = split_late(spark.readStream.schema("u long, ts timestamp").parquet(f"{tmp_path}/in"), "u", "ts")
    assert "pmod(xxhash64(u#" in split._jdf.queryExecution().analyzed().toString() and LATE_GROUPS == 1024
    rows = [(n * 10, at(30 if n % 3 == 0 else 1 + n % 12, n), None if n % 7 == 0 else n, "view", 1.0, "{}") for n in range(40)]
    ours, theirs = both(spark, tmp_path, "late_and_counted", events=(rows, EVENT))
    assert ours == theirs


def test_small_dump_files_share_tasks(spark, tmp_path):
    from threadlens.sources.dumps import packed, stream_dump

    assert packed([("a", 0, 10), ("b", 0, 1 << 20), ("c", 0, 1 << 21)], 1 << 22) == [[("a", 0, 10), ("b", 0, 1 << 20)], [("c", 0, 1 << 21)]]
    for n in range(40):
        (tmp_path / f"{n:02d}.xml").write_text(f"<mediawiki><page><title>T</title><ns>1</ns><id>{n}</id><revision><id>{n}</id><text>x</text></revision></page></mediawiki>")
    rows = stream_dump(spark, str(tmp_path), [1])
    assert rows.rdd.getNumPartitions() == 2 and sorted(r.rev_id for r in rows.collect()) == list(range(40))


def test_many_keys_share_folders(spark, tmp_path, monkeypatch):
    # a folder and a file for each of 1,500 users; the listing and the commit grew with them
    rows = [(n, at(1, n), n % 1500, "view", 1.0, "{}") for n in range(3000)]
    monkeypatch.setattr(source_queries, "_folder", lambda _: str(tmp_path / "out"))
    mine, said = both(spark, tmp_path, "key_shards", events=(rows, EVENT))
    assert mine == said and len(said) == 1500
    assert len(list((tmp_path / "out").glob("*/*.json"))) <= source_queries.KEY_SHARDS


def test_rows_of_one_key_among_shards(spark, tmp_path):
    rows = [(None if n % 50 == 0 else n % 40, n) for n in range(200)]
    sinks.write_by_key(spark.createDataFrame(rows, "k bigint, n bigint"), str(tmp_path / "out"), "k", 4)
    for k in (7, None, 99):
        held = sinks.key_rows(spark, str(tmp_path / "out"), "k bigint, n bigint", "k", F.lit(k).cast("long"), 4)
        assert sorted(map(tuple, held.collect())) == [r for r in rows if r[0] == k] and len(held.inputFiles()) <= 4


def test_pages_of_many_users(spark, tmp_path, monkeypatch):
    # the service was a folder and a file for each user, read whole for each page; an event without an id broke its user off
    users = [*range(1200), *[-5] * 50, *[10**18] * 7, *[3] * 30]
    rows = [(n, at(1, n), user, "view", 1.0, "{}") for n, user in enumerate(users)] + [(None, at(1, 0), 5000, "view", 1.0, "{}")]
    monkeypatch.setattr(source_queries, "_folder", lambda _: str(tmp_path / "out"))
    mine, said = both(spark, tmp_path, "paged_lookup", events=(rows, EVENT))
    assert mine == said and len(said) == len(rows)
    assert len(list((tmp_path / "out" / "service").glob("*/*.txt"))) <= source_queries.KEY_SHARDS


def test_presences_of_sentences_are_paired_in_order(spark):
    # the first and last revisions were aggregated in tables of all sentences of a task, beside the sort
    texts = ["A. B.", "A. A.", "", "A. B.", "B.", "C. A.", None, "A."]
    rows = [(p, 10 * n, text) for p in (1, 2) for n, text in enumerate(texts)]
    got = pov.sentence_origin(spark.createDataFrame(rows, "page long, rev long, text string"), "page", "rev", "text")
    one = [("A.", 0, 10), ("A.", 30, 30), ("A.", 50, 50), ("A.", 70, 70), ("B.", 0, 0), ("B.", 30, 40), ("C.", 50, 50)]
    assert sorted(map(tuple, got.select("page", "sentence", "first_rev", "last_rev").collect())) == [(p, *x) for p in (1, 2) for x in one]
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
