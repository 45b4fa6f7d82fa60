"""Readers, writers, scorers, samples, statistics, and models."""

from __future__ import annotations

import bz2
import json
import math

import pytest
from pyspark.sql import functions as F

from threadlens.functions import stats
from threadlens.operators import features, history, ml, sampling, scoring, trends
from threadlens.sources import readers, sinks

DUMP = """<mediawiki><page><title>Talk:A</title><ns>1</ns><id>7</id>
<revision><id>1</id><timestamp>2005-01-01T10:00:00Z</timestamp><contributor><username>Ann</username><id>5</id></contributor><comment>c</comment><text>one</text><sha1>s1</sha1><model>wikitext</model><format>text/x-wiki</format></revision>
<revision><id>2</id><timestamp>2005-01-03T10:00:00Z</timestamp><contributor><ip>1.2.3.4</ip></contributor><text>two</text><sha1>s2</sha1></revision></page>
<page><title>A</title><ns>0</ns><id>8</id><revision><id>3</id><timestamp>2005-01-03T10:00:00Z</timestamp><contributor><ip>1.2.3.4</ip></contributor><text>no</text></revision></page></mediawiki>"""


def test_dump(spark, tmp_path):
    path = tmp_path / "dump.xml.bz2"
    path.write_bytes(bz2.compress(DUMP.encode()))
    rows = {r.rev_id: r for r in readers.read_dump(spark, str(path)).collect()}
    assert set(rows) == {1, 2}
    assert (rows[1].user_text, rows[1].user_id, rows[1].comment, rows[1].year, rows[1].week) == ("Ann", "5", "c", 2004, 53)
    assert (rows[2].user_text, rows[2].user_id, rows[2].comment, rows[2].year) == ("1.2.3.4", None, None, 2005)
    sinks.write_by_year(readers.read_dump(spark, str(path)), str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"year=2004", "year=2005"}
    assert readers.read_revisions(spark, str(tmp_path / "out" / "year=2005")).first().text == "two"


def test_json_lines_with_errors(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}\nbroken\n')
    rows = readers.read_json_lines(spark, str(tmp_path / "x.json"), "a int", "bad").collect()
    assert sorted((r.a, r.bad) for r in rows if r.a) == [(1, None)] and [r.bad for r in rows if r.bad] == ["broken"]


def test_lexicons(spark, tmp_path):
    (tmp_path / "d.dic").write_text("%\n1\tarticle\nthe\t1\t9\nrun*\t3\nno\t8\n")
    assert {r.word: list(r.codes) for r in readers.read_categories(spark, str(tmp_path / "d.dic"), [1, 3]).collect()} == {"the": [1], "run": [3]}
    (tmp_path / "a.txt").write_bytes("café\nbad\n".encode("iso-8859-1"))
    (tmp_path / "b.txt").write_text("été\n", encoding="utf-8")
    lists = readers.read_word_lists(spark, {"a": (str(tmp_path / "a.txt"), "ISO-8859-1"), "b": (str(tmp_path / "b.txt"), "UTF-8")})
    assert {r.category: list(r.words) for r in lists.collect()} == {"a": ["bad", "café"], "b": ["été"]}
    assert readers.list_files(spark, str(tmp_path / "*.txt")).count() == 2


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"\nthere'), (2, None)], "id int, t string")
    sinks.write_quoted_csv(df, str(tmp_path / "c"))
    back = {r.id: r.t for r in readers.read_quoted_csv(spark, str(tmp_path / "c"), "id int, t string").collect()}
    assert back[1] == 'say "hi"\nthere'
    (tmp_path / "u.tsv").write_text("user\tn\na\t1\nb\t2\n")
    assert readers.read_tsv_of_users(spark, str(tmp_path / "u.tsv"), "user string, n int", spark.createDataFrame([("b",)], "x string")).first().n == 2


def test_typed_rows(spark):
    df = spark.createDataFrame([("p", "é", 0, True, ["a"], "2001-01-01 00:00:00")], "page_id string, raw string, n int, ok boolean, l array<string>, ts string")
    columns = {"page_id": "STRING", "raw": "BYTES", "n": "INT", "ok": "BOOL", "l": "ARRAY(STRING)", "ts": "TIMESTAMP", "none": "FLOAT"}
    r = sinks.typed(df, columns).first()
    assert (r.raw, r.n, r.ok, list(r.l), r.none) == ("w6k=", 0, True, ["a"], None)
    assert sinks.typed(df, columns, falsy_to_null=True).first().n is None
    with pytest.raises(ValueError):
        sinks.typed(df, {"n": "DECIMAL"})


def test_inserts(spark, tmp_path):
    old = spark.createDataFrame([(1, "a")], "id int, t string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "d"), (3, ""), (4, None)], "id int, t string")
    assert sorted(r.id for r in sinks.new_rows(new, old, ["id"]).collect()) == [2, 3, 4]
    assert sorted(r.id for r in sinks.valid_rows(new, ["id", "t"]).collect()) == [1, 2, 2]
    df, seen = sinks.observed(new.withColumn("ts", F.lit("x")), "run", "ts")
    df.count()
    assert seen.get["rows_added"] == 5
    gold = [r.value for r in sinks.gold_json(new.where("t <> ''"), "t", "t").collect()]
    assert [json.loads(v, object_pairs_hook=list) for v in gold] == [[("id", f"id_{n}"), ("answer", t), ("gold", t), ("t", t)] for n, t in ((1, "b"), (2, "c"), (3, "d"))]
    sinks.write_by_key(new, str(tmp_path / "keyed"), "id")
    assert {p.name for p in (tmp_path / "keyed").iterdir() if p.is_dir()} == {"id=1", "id=2", "id=3", "id=4"}
    assert sinks.safe_names(old.toDF("a:b", "c")).columns == ["a_b", "c"] and sinks.without_prefix(old.toDF("x_a", "x_b")).columns == ["a", "b"]


def test_published_actions(spark):
    df = spark.createDataFrame([("1.0.0", [("5", "Ann"), (None, None)])], "id string, authors array<struct<user_id:string,user_text:string>>")
    out = sinks.published(df)
    assert len(out.columns) == 16 and list(out.first().authors) == ["5:Ann", "ANONYMOUS:ANONYMOUS"] and out.first().page_id is None


def test_scorer_and_flags(spark):
    df = spark.createDataFrame([(1, "bad bad day"), (2, ""), (3, None), (4, "mail a@b.cd")], "id int, text string")
    scored = scoring.score(df, "text", scoring.WordScorer({"toxicity": {"bad"}}))
    assert {r.id: r.toxicity for r in scored.collect()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}
    assert {(r.id, r.toxic, r.pii) for r in scoring.flagged(scored, "text", F.col("toxicity")).collect()} == {(1, True, None), (4, False, "EMAIL_ADDRESS")}
    finding = "array<struct<likelihood:string,infoType:struct<name:string>>>"
    f = spark.createDataFrame([([("POSSIBLE", ("A",)), ("LIKELY", ("B",))],), ([],), (None,)], f"f {finding}")
    assert [r[0] for r in f.select(scoring.first_finding(F.col("f"))).collect()] == ["B", None, None]


def test_samples_and_statistics(spark):
    rows = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("v"), (F.col("id") % 2 == 0).alias("g"))
    means = [r["mean"] for r in sampling.bootstrap_means(rows, "id", "v", 20).collect()]
    assert len(means) == 20 and abs(sum(means) / 20 - 3) < 0.2 and len(set(means)) > 10
    pairs = rows.select("id", (F.col("v") + 1).alias("a"), F.col("v").alias("b"))
    assert sampling.approximate_randomisation(pairs, "id", "a", "b", 200).first().p < 0.05
    assert 280 < rows.where(sampling.split(rows, "id")).count() < 360
    assert stats.f_statistic(rows.withColumn("k", F.col("id") % 4), "k", "v") < 5
    assert abs(stats.rank_sum_z(rows, "g", "v")) < 1 and stats.normal_tail(1.96) == pytest.approx(0.05, abs=1e-3)
    m = stats.mean_with_error(rows, ["g"], "v").first()
    assert m.half_width == pytest.approx(1.96 * m.sem) and not math.isnan(m["mean"])
    lag = spark.createDataFrame([("2001-01-01", "2001-01-01 05:00:00"), ("2001-01-01", "2003-01-01")], "created string, removed string")
    lag = lag.select(*[F.col(c).cast("timestamp") for c in lag.columns])
    assert {r.lag: r.n for r in trends.deletion_lags(lag).collect()} == {"day": 1, "more": 1}


def test_models(spark):
    rows = spark.range(120).select(F.col("id"), (F.col("id") % 2).cast("int").alias("label"), F.floor(F.col("id") / 2).alias("pair"), (F.col("id") % 2 + F.rand(3) * 0.2).alias("x"), F.rand(5).alias("noise"))
    accuracy, error, tested, skipped = ml.leave_pairs_out(rows, ["x", "noise"], "label", "pair", folds=2)
    assert tested + skipped == rows.count()
    assert accuracy > 0.9 and error < 0.1
    texts = rows.select("label", F.when(F.col("label") == 1, "awful words here").otherwise("nice words here").alias("t"))
    q = ml.quality(ml.text_classifier(texts, "t", "label"), texts, "label")
    assert q["accuracy"] == 1.0 and q["auc"] == 1.0 and q["baseline"] == 0.5
    assert ml.top_coefficients(["a", "b", "c"], [0.1, -2.0, 3.0], 1) == ([("c", 3.0)], [("b", -2.0)])


def test_history(spark):
    ts = lambda d: F.to_timestamp_ntz(F.lit(d))
    users = spark.createDataFrame([("Ann", ["sysop", "reviewer"], "2001-01-01 00:00:00", None), ("Tool", ["bot"], None, "2000-01-01 00:00:00")], "name string, groups array<string>, registration string, blockedtimestamp string")
    starts = spark.createDataFrame([("c", "Ann"), ("c", "1.2.3.4"), ("c", "Tool")], "conversation_id string, user string").withColumn("start", F.lit("2002-01-01 00:00:00"))
    out = {r.user: (r.level, r.anonymous, r.blocked) for r in history.user_facts(users, starts).collect()}
    assert out == {"Ann": (4, False, False), "1.2.3.4": (1, True, False), "Tool": (-1, False, True)}
    actions = spark.createDataFrame([("Ann", 0.5), ("Ann", 0.9)], "user string, toxicity double").withColumn("ts", F.when(F.col("toxicity") < 0.6, ts("2001-01-01")).otherwise(ts("2003-01-01")))
    past = history.past_toxicity(actions, starts.withColumn("start", ts("2002-01-01")))
    assert {r.user: r.history_toxicity for r in past.collect()} == {"Ann": 0.5, "1.2.3.4": 0.0, "Tool": 0.0}
    assert history.monthly_edits(actions.withColumn("page_id", F.lit(1))).count() == 2
    n = features.max_normalised(actions.select("toxicity", F.lit(0.0).alias("z")), ["toxicity", "z"])
    assert sorted(round(r.toxicity, 3) for r in n.collect()) == [0.556, 1.0]


def test_tests_of_significance(spark):
    assert stats.t_quantile(0.975, 19) == pytest.approx(2.0930, abs=1e-3) and stats.t_quantile(0.025, 4) == pytest.approx(-2.7764, abs=1e-3)
    assert stats.t_interval(20, 3.0, 1.0) == pytest.approx((3 - 2.093 / math.sqrt(20), 3 + 2.093 / math.sqrt(20)), abs=1e-3)
    assert stats.binomial_p(8, 10) == pytest.approx(0.109375) and stats.binomial_p(5, 10) == pytest.approx(1.0)
    pairs = spark.createDataFrame([(float(a), float(b)) for a, b in zip([125, 115, 130, 140, 140, 115, 140, 125, 140, 135], [110, 122, 125, 120, 140, 124, 123, 137, 135, 145])], "a double, b double")
    assert stats.signed_rank_z(pairs, "a", "b") == pytest.approx(4.5 / math.sqrt(71.125))  # ranks 27 against 18, one tie of two
    mean, low, high = sampling.bootstrap_interval(spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "mean double"))
    assert mean == 2 and low == pytest.approx(2 - 4.3027 / math.sqrt(3), abs=1e-3) and high > 4
    runs = stats.running_sums(spark.createDataFrame([(float(v), 1) for v in range(500)], "v double, n long"), "v", ["n"], descending=True, pieces=7)
    assert {r.v: r.n_to for r in runs.collect()} == {float(v): 500 - v for v in range(500)}


def test_models_chosen_and_politeness(spark):
    rows = spark.range(120).select((F.col("id") % 2).cast("int").alias("label"), F.floor(F.col("id") / 2).alias("pair"), (F.col("id") % 2 + F.rand(3) * 0.2).alias("x"))
    best, accuracy = ml.grid_search(rows, ["x"], "label", "pair", [0.01, 100.0], folds=2)
    assert best == 0.01 and accuracy[0.01] > 0.9
    texts = spark.createDataFrame([("Could you please help me? Thanks!", 0.9), ("Why did you do that. You must stop.", -0.8)] * 20, "t string, s double")
    scores = ml.politeness_scores(ml.politeness_scorer(texts, "t", "s"), texts.distinct(), "t")
    assert {r.t[0]: r.politeness > 0.5 for r in scores.collect()} == {"C": True, "W": False}


def test_lookups_in_batches(spark):
    df = spark.createDataFrame([(i % 60, None if i % 4 else "there") for i in range(120)] + [(None, "")], "id long, text string").repartition(1)

    def fetch(keys):
        assert len(keys) <= 50
        return {k: {"name": f"n{k}", "age": k} for k in keys if k % 2 == 0}

    out = scoring.looked_up(df, "id", fetch, "name string, age long").collect()
    assert len(out) == 121 and all((r.name, r.age) == ((f"n{r.id}", r.id) if r.id is not None and r.id % 2 == 0 else (None, None)) for r in out)
    again = scoring.refetched(df, "text", "id", lambda keys: {k: "found" for k in keys if k < 30}).collect()
    assert all(r.text == ("there" if r.text == "there" else "found" if r.id is not None and r.id < 30 else r.text) for r in again) and any(r.text == "found" for r in again)


def test_scorers_wait_and_try_again():
    import pandas as pd

    waits, calls = [], []

    class Flaky(scoring.WordScorer):
        def score_batch(self, texts):
            calls.append(len(texts))
            if len(calls) == 1:
                raise OSError("too many requests")
            return super().score_batch(texts)

    limited = scoring.RateLimited(Flaky({"x": {"a"}}), 10, wait=waits.append)
    assert limited.score_batch(pd.Series(["a b"])).x.tolist() == [1.0] and len(calls) == 2 and len(waits) == 2 and limited.models == ("x",)


def test_dump_listings(spark, tmp_path):
    status = {"jobs": {"metahistorybz2dump": {"files": {"w-pages-meta-history1.xml.bz2": {"size": 5, "url": "/d/w-pages-meta-history1.xml.bz2"}, "md5.txt": {"size": 1, "url": "/d/md5.txt"}}}, "other": {"files": {}}}}
    (tmp_path / "status.json").write_text(json.dumps(status))
    assert [tuple(r) for r in readers.list_dumps(readers.read_dump_status(spark, str(tmp_path / "status.json"))).collect()] == [("/d/w-pages-meta-history1.xml.bz2", 5)]


def test_templates_of_any_depth(spark):
    from threadlens.functions import text as t

    df = spark.createDataFrame([("a {{x|{{y|{{z|{{w}}}}}}}} b",), ("no template",), ("{{open",), ("}} {{q}}",), (None,)], "x string")
    assert [r[0] for r in df.select(t.strip_wiki(F.col("x"))).collect()] == ["a  b", "no template", "{{open", "}} ", None]
    long = df.select(*t.guarded(F.col("x"), t.clean_comment, 12)).collect()
    assert [r[1] for r in long] == [True, False, False, False, False] and long[0][0].startswith("a {{")


def dump_of(rnd, pages):
    """(XML, rows that are to be read): pages of three namespaces, revisions up to some kilobytes."""
    from xml.sax.saxutils import escape

    out, want, number = [], [], 0
    for p in range(pages):
        ns, revisions = rnd.choice([1, 3, 0]), []
        for k in range(rnd.randint(0, 12)):
            number += 1
            text = "".join(rnd.choice("abc <&>\"é\n") for _ in range(rnd.randint(1, 9000))) + "."
            who = f"<username>u&amp;{k}</username><id>{k}</id>" if k % 2 else "<ip>1.2.3.4</ip>"
            note = f"<comment>{escape(text[:9])}.</comment>" if k % 3 else ""
            revisions.append(f"    <revision>\n      <id>{number}</id>\n<timestamp>2005-03-01T10:00:00Z</timestamp><contributor>{who}</contributor>{note}<text xml:space=\"preserve\">{escape(text)}</text>\n    </revision>\n")
            if ns != 0:
                want.append((number, str(p), f"Talk:{p} & x", f"u&{k}" if k % 2 else "1.2.3.4", str(k) if k % 2 else None, text))
        out.append(f"  <page>\n    <title>Talk:{p} &amp; x</title>\n    <ns>{ns}</ns>\n    <id>{p}</id>\n" + "".join(revisions) + "  </page>\n")
    return ("<mediawiki>\n <siteinfo><base>x</base></siteinfo>\n" + "".join(out) + "</mediawiki>\n").encode(), want


def test_dumps_are_split_and_streamed(spark, tmp_path):
    """Whatever the splits, every revision once, and the rows of the reader that takes a page at a time."""
    import bz2
    import random

    from threadlens.sources import dumps

    xml, want = dump_of(random.Random(3), 30)
    files = {"a.xml.bz2": bz2.compress(xml, 1), "b.xml": xml, "two.xml.bz2": bz2.compress(xml[: len(xml) // 2], 1) + bz2.compress(xml[len(xml) // 2 :], 9)}
    columns = ["rev_id", "page_id", "page_title", "user_text", "user_id", "text"]
    for name, content in files.items():
        path = tmp_path / name
        path.write_bytes(content)
        for split in (len(content), 50_001):
            got = dumps.stream_dump(spark, str(path), [1, 3], split)
            assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want)
        texts = dumps.bz2_texts if name.endswith("bz2") else dumps.plain_texts
        one = [r for a in range(0, len(content), 9973) for r in dumps.dump_rows(texts(str(path), a, min(a + 9973, len(content))), frozenset((1, 3)))]
        assert sorted(r[12] for r in one) == sorted(r[0] for r in want)
    plain = readers.read_dump(spark, str(tmp_path / "a.xml.bz2"), [1, 3])
    streamed = dumps.stream_dump(spark, str(tmp_path / "a.xml.bz2"), [1, 3], 100_000)
    assert sorted(streamed.columns) == sorted(plain.columns)
    assert sorted(map(str, streamed.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    (tmp_path / "none.xml").write_text("<mediawiki></mediawiki>")
    assert dumps.stream_dump(spark, str(tmp_path / "none.xml")).count() == 0


def test_twenty_thousand_revisions_of_one_page_in_fifty_megabytes(tmp_path):
    """A page of 10,000 revisions of 10 kB and 10,000 of 50 kB, read in a process that may grow by 50 MB."""
    import subprocess
    import sys

    code = """
import resource, sys, bz2
from threadlens.sources import dumps
def texts():
    yield b"<mediawiki><page><title>Talk:x</title><ns>1</ns><id>7</id>", True
    for i in range(20000):
        yield f"<revision><id>{i}</id><timestamp>2005-03-01T10:00:00Z</timestamp><contributor><ip>1</ip></contributor><text>{'x' * (10000 if i < 10000 else 50000)}</text></revision>".encode(), True
    yield b"</page></mediawiki>", True
first = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(1 for r in dumps.dump_rows(texts(), frozenset((1,))))
print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - first)
path = sys.argv[1]
with bz2.open(path, "wb", 1) as f:
    for text, _ in texts():
        f.write(text)
first = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(1 for r in dumps.dump_rows(dumps.bz2_texts(path, 0, 1 << 40), frozenset((1,))))
print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - first)
"""
    out = subprocess.run([sys.executable, "-c", code, str(tmp_path / "big.xml.bz2")], capture_output=True, text=True, timeout=600)
    counts = [tuple(map(int, line.split())) for line in out.stdout.splitlines() if line.strip()]
    assert [n for n, _ in counts] == [20_000, 20_000], out.stderr
    assert all(grown <= 50_000 for _, grown in counts)
