"""Reverts, trends, cohorts, lookups, samples and sets over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.operators import cohort, history, lookup, reverts, sampling, sets, trends
from threadlens.operators.reconstruct import size_classes
from threadlens.plans.registry import query
from threadlens.sources.views import COMMENTS, REVISIONS, SCORED, comments, revisions, scored, table

SPANS = f"""{REVISIONS}, spans AS (
    SELECT page_id, sha1, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM revisions WHERE sha1 IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1),
flagged AS (
    SELECT r.*, EXISTS (SELECT 1 FROM spans s WHERE s.page_id = r.page_id
        AND ((s.first_ts <= r.ts AND r.ts < s.last_ts) OR (s.first_ts = s.last_ts AND r.ts = s.first_ts))) AS reverted FROM revisions r)"""


@query(f"""WITH {SPANS} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS total, count(*) FILTER (attack >= 0.75) AS toxic,
    count(*) FILTER (attack >= 0.75 AND reverted) AS toxic_reverted, round(count(*) FILTER (attack >= 0.75) / count(*), 6) AS toxic_share
    FROM flagged GROUP BY 1""")
def flagship_revert_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reverts.daily_reverts(revisions(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query(f"WITH {SPANS} SELECT page_id, sha1, n, first_ts, last_ts FROM spans")
def revert_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reverts.repeated_hashes(revisions(spark, sf_dir))


@query(f"WITH {SPANS} SELECT page_id, sha1, n FROM spans ORDER BY n DESC, page_id, sha1")
def repeated_sha1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reverts.repeated_hashes(revisions(spark, sf_dir)).select("page_id", "sha1", "n").orderBy(F.desc("n"), "page_id", "sha1")


@query(f"WITH {SPANS} SELECT rev_id, page_id, ts, sha1, attack, author, user_id FROM flagged WHERE reverted")
def reverted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reverts.reverted_rows(revisions(spark, sf_dir))


@query(f"WITH {SPANS} SELECT rev_id, page_id, sha1 FROM flagged WHERE NOT reverted")
def unreverted_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = revisions(spark, sf_dir)
    return reverts.unreverted(rows, reverts.reverted_rows(rows)).select("rev_id", "page_id", "sha1")


IN_JANUARY = "ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'"


@query(f"WITH {REVISIONS} SELECT rev_id, page_id, ts, attack FROM revisions WHERE {IN_JANUARY} AND attack >= 0.75")
def month_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.month_toxic(revisions(spark, sf_dir), 2024, 1).select("rev_id", "page_id", "ts", "attack")


@query(f"WITH {REVISIONS} SELECT count(*) AS n FROM revisions WHERE {IN_JANUARY} AND attack < 0.75")
def month_nontoxic_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.month_nontoxic_count(revisions(spark, sf_dir), 2024, 1)


@query(f"WITH {SPANS} SELECT DISTINCT rev_id, page_id, author FROM flagged WHERE reverted AND {IN_JANUARY} AND attack >= 0.75")
def reverted_in_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = revisions(spark, sf_dir)
    marks = reverts.reverted_rows(rows).select("rev_id")
    return trends.month_toxic(rows, 2024, 1).join(marks, "rev_id").select("rev_id", "page_id", "author").distinct()


@query(f"""WITH {SPANS} SELECT r.rev_id, r.attack, f.reverted AS reverted FROM revisions r LEFT JOIN flagged f ON f.rev_id = r.rev_id
    WHERE r.attack >= 0.75 AND r.ts >= TIMESTAMP '2024-01-01' AND r.ts < TIMESTAMP '2024-02-01'""")
def month_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = revisions(spark, sf_dir)
    marks = reverts.reverted_rows(rows).select("rev_id", F.lit(True).alias("_r"))
    joined = trends.month_toxic(rows, 2024, 1).join(marks, "rev_id", "left")
    return joined.select("rev_id", "attack", F.coalesce("_r", F.lit(False)).alias("reverted"))


ORDER_REVISIONS = """WITH r AS (SELECT o_orderkey AS rev_id, o_orderdate AS ts, least(o_totalprice / 400000, 1) AS attack, o_orderpriority AS author FROM orders)"""


def _order_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS rev_id", "o_orderdate AS ts", "least(o_totalprice / 400000, 1) AS attack", "o_orderpriority AS author", "o_orderstatus AS status")


@query(f"{ORDER_REVISIONS} SELECT year(ts) AS year, month(ts) AS month, count(*) AS total, count(*) FILTER (attack >= 0.75) AS toxic FROM r GROUP BY 1, 2")
def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.calendar(_order_revisions(spark, sf_dir))


@query("""WITH r AS (SELECT o_orderkey AS rev_id, o_orderdate AS ts, least(o_totalprice / 400000, 1) AS attack, o_orderstatus AS status FROM orders),
    m AS (SELECT DISTINCT rev_id AS reverted_id FROM r WHERE status = 'F')
    SELECT year(ts) AS year, month(ts) AS month, count(reverted_id) AS reverted FROM m RIGHT JOIN r ON reverted_id = rev_id WHERE attack >= 0.75 GROUP BY 1, 2""")
def calendar_reverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_revisions(spark, sf_dir)
    return trends.calendar_of_reverted(rows, rows.where("status = 'F'"))


@query("""WITH r AS (SELECT o_orderkey AS rev_id, o_orderdate AS ts, least(o_totalprice / 400000, 1) AS attack, o_orderstatus AS status FROM orders)
    SELECT year(ts) AS year, month(ts) AS month, count(*) AS total, count(*) FILTER (attack >= 0.75) AS toxic,
           count(*) FILTER (attack >= 0.75 AND status = 'F') AS reverted FROM r GROUP BY 1, 2""")
def calendar_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_revisions(spark, sf_dir)
    marks = trends.calendar_of_reverted(rows, rows.where("status = 'F'"))
    return trends.calendar(rows).join(marks, ["year", "month"], "left").fillna(0, ["reverted"])


@query(f"WITH {SCORED} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(DISTINCT id) AS n FROM scored WHERE type <> 'DELETION' AND toxicity >= 0.8 GROUP BY 1")
def daily_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.daily_distinct(scored(spark, sf_dir), 0.8).withColumn("day", F.col("day").cast("string"))


@query(f"""WITH {SCORED}, d AS (SELECT CAST(ts AS DATE) AS day, count(DISTINCT id) AS n FROM scored WHERE type <> 'DELETION' AND toxicity >= 0.8 GROUP BY 1)
    SELECT CAST(day AS VARCHAR) AS day, CAST(sum(n) OVER (PARTITION BY day) AS BIGINT) AS n FROM d""")
def daily_window_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    days = trends.daily_distinct(scored(spark, sf_dir), 0.8)
    return days.select(F.col("day").cast("string").alias("day"), F.sum("n").over(Window.partitionBy("day")).alias("n"))


SHARES = """s AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(DISTINCT o_orderkey) FILTER (o_totalprice / 500000 >= 0.6) AS toxic,
    count(DISTINCT o_orderkey) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)"""


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_orderdate AS ts", "o_totalprice / 500000 AS toxicity", "CASE WHEN o_orderstatus = 'P' THEN 'DELETION' ELSE 'ADDITION' END AS type"
    )
    return trends.monthly_share(rows, 0.6)


@query(f"WITH {SHARES} SELECT CAST(month AS VARCHAR) AS month, toxic, total, round(toxic / total, 6) AS share FROM s WHERE toxic > 0")
def monthly_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shares(spark, sf_dir).withColumn("month", F.col("month").cast("string"))


@query(f"""WITH {SHARES}, r AS (SELECT month, round(round(toxic / total, 6), 3) AS share FROM s WHERE toxic > 0)
    SELECT CAST(month AS VARCHAR) AS month, share, round((share - lag(share) OVER (ORDER BY month)) / nullif(lag(share) OVER (ORDER BY month), 0), 3) AS growth FROM r""")
def share_mom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.share_growth(_shares(spark, sf_dir)).withColumn("month", F.col("month").cast("string"))


# --- scores and cohorts ---

SCORES = """raw AS (SELECT doc_id AS record_id, 'toxic' AS model, CAST(toxic AS DOUBLE) AS score FROM labels UNION ALL
    SELECT doc_id, 'quality', CAST(quality AS DOUBLE) FROM labels UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS DOUBLE) / 2 FROM labels WHERE doc_id % 3 = 0),
scores AS (SELECT record_id, model, score FROM (SELECT *, row_number() OVER (PARTITION BY record_id, model ORDER BY score DESC) AS n FROM raw) WHERE n = 1)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    one = lambda c: labels.selectExpr("doc_id AS record_id", f"'{c}' AS model", f"CAST({c} AS DOUBLE) AS score")
    again = labels.where("doc_id % 3 = 0").selectExpr("doc_id AS record_id", "'toxic' AS model", "CAST(toxic AS DOUBLE) / 2 AS score")
    return cohort.dedupe_scores(one("toxic").unionByName(one("quality")).unionByName(again), ["record_id", "model"], [F.desc("score")])


@query(f"WITH {SCORES} SELECT record_id, model, score FROM scores")
def dedupe_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)


@query(f"WITH {SCORED} SELECT id, type, type IN ('ADDITION', 'CREATION', 'MODIFICATION') AS own_text FROM scored")
def split_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, others = cohort.split_by_type(scored(spark, sf_dir))
    return own.select("id", "type", F.lit(True).alias("own_text")).unionByName(others.select("id", "type", F.lit(False).alias("own_text")))


@query(f"WITH {SCORES} SELECT doc_id AS id, source, score FROM documents JOIN scores ON record_id = doc_id WHERE model = 'toxic'")
def score_join_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return cohort.with_own_score(docs, _scores(spark, sf_dir), "toxic").select("id", "source", "score")


@query(f"WITH {SCORES} SELECT doc_id AS id, doc_id - 1 AS parent_id, score FROM documents JOIN scores ON record_id = doc_id - 1 WHERE model = 'toxic'")
def score_join_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") - 1).alias("parent_id"))
    return cohort.with_parent_score(docs, _scores(spark, sf_dir), "toxic").select("id", "parent_id", "score")


@query("SELECT r_name, n_name FROM region, nation")
def cross_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select("r_name").crossJoin(table(spark, sf_dir, "nation").select("n_name"))


@query(f"""WITH {COMMENTS}, n AS (SELECT conversation_id, count(*) AS n_scored FROM comments WHERE length(content) > 20 GROUP BY 1),
    m AS (SELECT conversation_id, count(*) AS n FROM comments GROUP BY 1) SELECT conversation_id, n FROM n JOIN m USING (conversation_id) WHERE n_scored = n""")
def fully_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = comments(spark, sf_dir)
    return cohort.fully_scored(rows.where(F.length("content") > 20), rows)


BAD = f"""{SCORED}, bad AS (SELECT s.*, a.attack_time FROM scored s JOIN (SELECT conversation_id, min(ts) AS attack_time FROM scored WHERE toxicity > 0.6 GROUP BY 1) a
    USING (conversation_id) WHERE ts <= attack_time)"""
GOOD = "good AS (SELECT * FROM scored WHERE conversation_id IN (SELECT conversation_id FROM scored GROUP BY 1 HAVING max(toxicity) < 0.6))"
STATS = """SELECT conversation_id, min(ts) AS start_time, max(ts) AS end_time, min(page_id) AS page_id, count(DISTINCT user_text) AS users,
    count(DISTINCT id) AS length FROM {} GROUP BY 1 HAVING max(ts) > min(ts) AND count(DISTINCT user_text) > 1"""


@query(f"WITH {BAD} SELECT id, conversation_id, ts, toxicity, attack_time FROM bad")
def bad_convs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.bad_conversations(scored(spark, sf_dir)).select("id", "conversation_id", "ts", "toxicity", "attack_time")


@query(f"WITH {SCORED}, {GOOD} SELECT id, conversation_id, ts, toxicity FROM good")
def good_convs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.good_conversations(scored(spark, sf_dir)).select("id", "conversation_id", "ts", "toxicity")


BEFORE = """b AS (SELECT conversation_id, max(toxicity) FILTER (ts < attack_time) AS before_max, count(DISTINCT user_text) FILTER (ts < attack_time) AS users_before,
    count(DISTINCT id) FILTER (ts < attack_time) AS length_before FROM bad GROUP BY 1)"""


def _bad_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = cohort.bad_conversations(scored(spark, sf_dir))
    return cohort.conversation_stats(bad).join(cohort.before_attack(bad), "conversation_id")


@query(f"WITH {BAD}, s AS ({STATS.format('bad')}), {BEFORE} SELECT * FROM s JOIN b USING (conversation_id)")
def bad_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bad_stats(spark, sf_dir)


PREFIX = f"""{GOOD}, ends AS (SELECT DISTINCT conversation_id, ts AS end_time FROM good),
prefixes AS (SELECT e.conversation_id, e.end_time, min(g.ts) FILTER (g.ts <= e.end_time) AS start_time, min(g.page_id) FILTER (g.ts <= e.end_time) AS page_id,
    count(DISTINCT g.user_text) FILTER (g.ts <= e.end_time) AS users, count(DISTINCT g.id) FILTER (g.ts <= e.end_time) AS length,
    max(g.toxicity) FILTER (g.ts < e.end_time) AS before_max, count(DISTINCT g.user_text) FILTER (g.ts < e.end_time) AS users_before,
    count(DISTINCT g.id) FILTER (g.ts < e.end_time) AS length_before, max(g.toxicity) FILTER (g.ts >= e.end_time) AS after_max
    FROM ends e JOIN good g USING (conversation_id) GROUP BY 1, 2)"""


@query(f"WITH {SCORED}, {PREFIX} SELECT conversation_id, end_time, start_time, page_id, users, length, before_max, users_before, length_before FROM prefixes")
def good_prefix_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.prefixes(cohort.good_conversations(scored(spark, sf_dir))).drop("after_max")


@query(f"WITH {SCORED}, {PREFIX} SELECT conversation_id, end_time, after_max FROM prefixes WHERE after_max < 0.4 AND end_time > start_time")
def prefix_after_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cohort.prefixes(cohort.good_conversations(scored(spark, sf_dir)))
    return rows.where(F.col("after_max") < cohort.CALM_AFTER).where("end_time > start_time").select("conversation_id", "end_time", "after_max")


MATCHES = f"""{BAD}, s AS ({STATS.format('bad')}), {BEFORE}, bs AS (SELECT * FROM s JOIN b USING (conversation_id) WHERE users_before = users), {PREFIX},
gs AS (SELECT * FROM prefixes WHERE end_time > start_time AND after_max < 0.4 AND users > 1),
matches AS (SELECT bs.conversation_id AS bad_id, gs.conversation_id AS good_id, bs.page_id, bs.length, gs.end_time AS good_end,
    CAST(abs(epoch(bs.start_time)::BIGINT - epoch(gs.start_time)::BIGINT) AS BIGINT) AS start_delta, CAST(abs(epoch(bs.end_time)::BIGINT - epoch(gs.end_time)::BIGINT) AS BIGINT) AS end_delta
    FROM bs JOIN gs ON bs.page_id = gs.page_id AND bs.length = gs.length WHERE abs(bs.before_max - gs.before_max) < 0.2 AND bs.users = gs.users)"""


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = _bad_stats(spark, sf_dir).where("users_before = users")
    good = cohort.prefixes(cohort.good_conversations(scored(spark, sf_dir))).where(F.col("after_max") < cohort.CALM_AFTER).where("end_time > start_time AND users > 1")
    return cohort.candidate_matches(bad, good)


@query(f"WITH {MATCHES} SELECT bad_id, good_id, page_id, length, good_end FROM matches")
def cohort_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).drop("start_delta", "end_delta")


@query(f"""WITH {MATCHES}, one AS (SELECT *, row_number() OVER (PARTITION BY good_id ORDER BY start_delta, end_delta, bad_id, good_end) AS n FROM matches),
    two AS (SELECT *, row_number() OVER (PARTITION BY bad_id ORDER BY start_delta, end_delta, good_id, good_end) AS m FROM one WHERE n = 1)
    SELECT bad_id, good_id, page_id, length, good_end FROM two WHERE m = 1""")
def cohort_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.best_matches(_matches(spark, sf_dir)).drop("start_delta", "end_delta")


@query(f"""WITH {MATCHES}, one AS (SELECT *, row_number() OVER (PARTITION BY good_id ORDER BY start_delta, end_delta, bad_id, good_end) AS n FROM matches),
    two AS (SELECT *, row_number() OVER (PARTITION BY bad_id ORDER BY start_delta, end_delta, good_id, good_end) AS m FROM one WHERE n = 1)
    SELECT t.bad_id, g.id, g.ts FROM two t JOIN good g ON g.conversation_id = t.good_id WHERE m = 1 AND g.ts <= t.good_end""")
def matched_good_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = cohort.best_matches(_matches(spark, sf_dir)).select("bad_id", F.col("good_id").alias("conversation_id"), "good_end")
    return cohort.good_conversations(scored(spark, sf_dir)).join(best, "conversation_id").where("ts <= good_end").select("bad_id", "id", "ts")


@query(f"""WITH {MATCHES}, one AS (SELECT *, row_number() OVER (PARTITION BY good_id ORDER BY start_delta, end_delta, bad_id, good_end) AS n FROM matches),
    two AS (SELECT *, row_number() OVER (PARTITION BY bad_id ORDER BY start_delta, end_delta, good_id, good_end) AS m FROM one WHERE n = 1)
    SELECT t.good_id, b.id, b.ts, b.attack_time AS end_time FROM two t JOIN bad b ON b.conversation_id = t.bad_id WHERE m = 1""")
def matched_bad_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = cohort.best_matches(_matches(spark, sf_dir)).select("good_id", F.col("bad_id").alias("conversation_id"))
    return cohort.bad_conversations(scored(spark, sf_dir)).join(best, "conversation_id").select("good_id", "id", "ts", F.col("attack_time").alias("end_time"))


# --- lookups ---


@query(f"WITH {COMMENTS} SELECT id, ts, user_text FROM comments WHERE conversation_id = 7 ORDER BY ts, id LIMIT 100")
def lookup_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.conversation(comments(spark, sf_dir), 7).select("id", "ts", "user_text")


@query(f"WITH {COMMENTS} SELECT id, page_id FROM comments WHERE page_id = 3 ORDER BY ts, id LIMIT 100")
def lookup_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.by_page(comments(spark, sf_dir), "page_id", 3).select("id", "page_id")


@query(f"WITH {REVISIONS} SELECT rev_id, page_id FROM revisions WHERE rev_id = 42")
def lookup_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.by_revision(revisions(spark, sf_dir).withColumn("id", F.col("rev_id")), 42).select("rev_id", "page_id")


@query(f"WITH {COMMENTS} SELECT id, user_text FROM comments WHERE user_text LIKE 'u%' ORDER BY id LIMIT 100")
def search_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.search(comments(spark, sf_dir), "user_text", "LIKE", "u%").select("id", "user_text")


@query(f"WITH {SCORED} SELECT id, toxicity FROM scored WHERE toxicity > 0.1 AND toxicity < 0.9 AND type <> 'DELETION' ORDER BY toxicity, id LIMIT 20")
def top20_score_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.by_toxicity(scored(spark, sf_dir), 0.1, 0.9, descending=False).select("id", "toxicity")


@query(f"WITH {SCORED} SELECT id, toxicity FROM scored WHERE toxicity > 0.1 AND toxicity < 0.9 AND type <> 'DELETION' ORDER BY toxicity DESC, id LIMIT 20")
def top20_score_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.by_toxicity(scored(spark, sf_dir), 0.1, 0.9).select("id", "toxicity")


@query(f"WITH {COMMENTS} SELECT reply_to, arg_max(id, (ts, id)) AS id, max(ts) AS ts FROM comments WHERE reply_to IS NOT NULL GROUP BY 1")
def latest_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.latest_reply(comments(spark, sf_dir))


@query(f"WITH {COMMENTS} SELECT r.id, r.ts FROM comments l JOIN comments r USING (conversation_id) WHERE l.id = '5.3.3' AND r.ts <= l.ts")
def context_upto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.context_upto(comments(spark, sf_dir), "5.3.3").select("id", "ts")


# --- samples, sets, shards ---

DRAW = "md5(id || ':s')"


@query(f"""WITH {SCORED}, z AS (SELECT id, toxicity, CAST(floor(toxicity * 5) AS BIGINT) AS zone FROM scored WHERE toxicity >= 0 AND toxicity < 1)
    SELECT id, zone FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY {DRAW}, id) AS n FROM z) WHERE n <= 30""")
def zone_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_sample(scored(spark, sf_dir), "id", "toxicity", 5, 30).select("id", "zone")


@query(f"WITH {SCORED} SELECT id, toxicity FROM scored ORDER BY {DRAW}, id LIMIT 50")
def random_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.random_sample(scored(spark, sf_dir), "id", 50).select("id", "toxicity")


@query(f"""WITH {SCORED}, z AS (SELECT id, CAST(floor(toxicity * 4) AS BIGINT) AS zone FROM scored WHERE toxicity >= 0 AND toxicity < 1)
    SELECT id, zone FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY {DRAW}, id) AS n FROM z) WHERE n <= 20
    UNION ALL (SELECT id, -1 AS zone FROM scored ORDER BY md5(id || ':sr'), id LIMIT 20)""")
def zone_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_sample(scored(spark, sf_dir), "id", "toxicity", 4, 20, random=20).select("id", "zone")


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT c_custkey FROM customer WHERE c_nationkey < 5")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.where("c_acctbal > 5000").select(F.col("c_custkey").alias("id")).unionByName(c.where("c_nationkey < 5").select(F.col("c_custkey").alias("id")))


@query("""SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'
    INTERSECT SELECT user_id FROM events WHERE event_type = 'error'""")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return sets.in_all([e.where(F.col("event_type") == t).select("user_id") for t in ("click", "purchase", "error")])


@query("""SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    key = F.col("o_custkey").alias("id")
    return sets.pick_ids(c.where("c_acctbal > 0").select(F.col("c_custkey").alias("id")), o.select(key), o.where("o_orderstatus = 'P'").select(key))


@query("""SELECT c_custkey AS id, 'new' AS version FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'old' FROM customer WHERE c_custkey % 3 <> 0""")
def replace_newer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return sets.newer_wins(c.withColumn("version", F.lit("old")), c.where("id % 3 = 0").withColumn("version", F.lit("new")), ["id"])


@query("""SELECT CAST(isoyear(o_orderdate) AS BIGINT) AS iso_year, CAST(weekofyear(o_orderdate) AS BIGINT) AS week, count(*) AS n FROM orders GROUP BY 1, 2""")
def iso_year_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadlens.sources.readers import iso_week

    year, week = iso_week(F.col("o_orderdate"))
    rows = table(spark, sf_dir, "orders").select(year, week)
    return rows.groupBy(F.col("year").cast("long").alias("iso_year"), F.col("week").cast("long").alias("week")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT page_id, count(*) AS n, CAST(coalesce(sum(octet_length(encode(text))), 0) AS BIGINT) AS bytes,
    CASE WHEN count(*) < 100 THEN 'short' WHEN count(*) <= 100000 THEN 'long' ELSE 'gigantic' END AS size_class, coalesce(sum(octet_length(encode(text))), 0) > 100000 AS big
    FROM (SELECT source AS page_id, text FROM documents) GROUP BY 1""")
def size_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return size_classes(table(spark, sf_dir, "documents").select(F.col("source").alias("page_id"), "text"), big_bytes=100_000)


@query("""WITH b AS (SELECT source, sum(n_chars) > 100000 AS big FROM documents GROUP BY 1) SELECT doc_id, CAST(big AS INT) AS big FROM documents JOIN b USING (source)""")
def big_page_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    big = docs.groupBy("source").agg((F.sum("n_chars") > 100_000).cast("int").alias("big"))
    return docs.join(big, "source").select("doc_id", "big")


# --- history of users ---

STARTS = "starts AS (SELECT user_id AS user, min(ts) + INTERVAL 10 DAY AS start FROM events GROUP BY 1)"


def _starts_edits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), "ts", F.col("event_id").alias("edit_id"))
    return e.groupBy("user").agg((F.min("ts") + F.expr("INTERVAL 10 DAY")).alias("start")), e


@query(f"""WITH {STARTS} SELECT s.user, s.start, count(e.event_id) FILTER (epoch(e.ts)::BIGINT < epoch(s.start)::BIGINT) AS n_before,
    count(e.event_id) FILTER (epoch(e.ts)::BIGINT < epoch(s.start)::BIGINT AND epoch(e.ts)::BIGINT > epoch(s.start)::BIGINT - 604800) AS n_week
    FROM starts s LEFT JOIN events e ON e.user_id = s.user GROUP BY 1, 2""")
def history_counts_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.counts_before(*_starts_edits(spark, sf_dir))


@query(f"""WITH {STARTS} SELECT s.user, e.event_id AS edit_id FROM starts s JOIN events e ON e.user_id = s.user WHERE e.ts < s.start AND e.ts > s.start - INTERVAL 7 DAY""")
def prev_week_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts, edits = _starts_edits(spark, sf_dir)
    return edits.join(starts, "user").where("ts < start AND ts > start - INTERVAL 7 DAY").select("user", "edit_id")


@query(f"""WITH {STARTS} SELECT "user", edit_id, place FROM (SELECT s.user AS "user", e.event_id AS edit_id,
    row_number() OVER (PARTITION BY s.user ORDER BY e.ts DESC, e.event_id DESC) AS place FROM starts s JOIN events e ON e.user_id = s.user
    WHERE e.ts < s.start - INTERVAL 7 DAY) WHERE place <= 100""")
def top100_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest_before(*_starts_edits(spark, sf_dir)).select("user", "edit_id", "place")
