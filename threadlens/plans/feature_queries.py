"""Features of conversations and users, slices, lookups, crowd labels, and the smaller functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.functions import stats, time
from threadlens.functions import text as t
from threadlens.operators import agreement, conversations, features, history, lookup, pov, sampling, scoring, trends
from threadlens.plans.registry import ORACLES, query
from threadlens.plans.text_queries import DOCS, PAIRS, SENTENCES, STOP, TOKENS, _docs, _pairs, sql_q
from threadlens.sources import readers, sinks
from threadlens.sources.views import COMMENTS, REVISIONS, comments, revisions, table

SCORES = "least(((turn * 37 + conversation_id * 11) % 41) / 20 - 1, 1)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comments(spark, sf_dir).withColumns({"sentiment": F.expr(SCORES), "toxicity": (F.col("turn") * 37 % 100) / 100})


# --- messages, turns and replies ---

_agrees = f"((starts_with(lower(content), 'sure ') OR starts_with(lower(content), 'true ')) AND NOT contains(content, '?')) OR regexp_matches(lower(content), '{sql_q(t.whole(t.AGREE))}')"


@query(f"""WITH {COMMENTS}, m AS (SELECT *, {TOKENS.format('content')} AS w, coalesce(user_text IS DISTINCT FROM lag(user_text) OVER o OR lag(id) OVER o IS NULL, true) AS fresh FROM comments WINDOW o AS (PARTITION BY conversation_id ORDER BY ts, id)),
    n AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY ts, id) - 1 AS turn_no FROM m),
    g AS (SELECT conversation_id, turn_no, min(ts) AS ts, max(ts) AS ended, flatten(list(w ORDER BY ts, id)) AS w, bool_or({_agrees}) AS agree, bool_or(regexp_matches(lower(content), '{sql_q(t.whole(t.DISAGREE))}')) AS disagree FROM n GROUP BY 1, 2),
    x AS (SELECT *, lag(w) OVER o AS was, lag(ended) OVER o AS former FROM g WINDOW o AS (PARTITION BY conversation_id ORDER BY turn_no))
    SELECT conversation_id, CAST(turn_no AS BIGINT) AS turn_no, agree, disagree,
    CAST(len(list_filter(w, lambda v: list_contains(was, v) AND NOT list_contains({STOP}, v))) AS BIGINT) AS n_repeated_content,
    CAST(len(list_filter(w, lambda v: list_contains(was, v) AND list_contains({STOP}, v))) AS BIGINT) AS n_repeated_stop,
    CAST(epoch(ts)::BIGINT - epoch(former)::BIGINT AS BIGINT) AS gap FROM x WHERE was IS NOT NULL""")
def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.turn_pairs(comments(spark, sf_dir), t.tokens, features.STOPWORDS).withColumn("turn_no", F.col("turn_no").cast("long"))


@query(f"WITH {COMMENTS} SELECT conversation_id, user_text, arg_max(id, turn) AS id FROM comments GROUP BY 1, 2")
def last_comment_of_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.last_comments(comments(spark, sf_dir)).select("conversation_id", "user_text", "id")


@query(f"WITH {COMMENTS} SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) AS n FROM comments) WHERE n <= 3")
def last_three_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.last_comments(comments(spark, sf_dir), 3, by_user=False).select("id")


@query(f"WITH {COMMENTS} SELECT c.id, c.conversation_id, (SELECT count(*) FROM comments r WHERE r.reply_to = c.id) AS n_responses FROM comments c")
def response_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.responses(comments(spark, sf_dir))


@query(f"""WITH {COMMENTS}, q AS (SELECT *, CAST(contains(content, '?') AS INT) AS q FROM comments),
    p AS (SELECT r.conversation_id, r.q AS a, p.q AS b FROM q r JOIN q p ON r.reply_to = p.id),
    k AS (SELECT conversation_id, count(*) FILTER (a = 0 AND b = 0) AS pair_00, count(*) FILTER (a = 0 AND b = 1) AS pair_01, count(*) FILTER (a = 1 AND b = 0) AS pair_10, count(*) FILTER (a = 1 AND b = 1) AS pair_11 FROM p GROUP BY 1),
    n AS (SELECT conversation_id, CAST(sum(q) AS BIGINT) AS n_questions, count(*) FILTER (q = 1 AND id IN (SELECT reply_to FROM comments WHERE reply_to IS NOT NULL)) AS n_answered FROM q GROUP BY 1)
    SELECT conversation_id, n_questions, n_answered, coalesce(pair_00, 0) AS pair_00, coalesce(pair_01, 0) AS pair_01, coalesce(pair_10, 0) AS pair_10, coalesce(pair_11, 0) AS pair_11 FROM n LEFT JOIN k USING (conversation_id)""")
def question_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.question_pairs(comments(spark, sf_dir), F.col("content").contains("?"))


@query(f"""WITH {COMMENTS}, l AS (SELECT conversation_id, max(turn) AS last FROM comments GROUP BY 1)
    SELECT c.conversation_id, any_value(c.user_text) FILTER (turn = last) AS user_text, coalesce(bool_or(turn < last AND c.user_text = u.user_text), false) AS spoke_before
    FROM comments c JOIN l USING (conversation_id) JOIN (SELECT conversation_id, arg_max(user_text, turn) AS user_text FROM comments GROUP BY 1) u USING (conversation_id) GROUP BY 1""")
def attacker_spoke_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.attacker_spoke_before(comments(spark, sf_dir))


@query(f"""WITH {COMMENTS}, s AS (SELECT *, {SCORES} AS s FROM comments),
    m AS (SELECT x.*, arg_max(y.s, y.turn) AS was FROM s x JOIN s y ON x.conversation_id = y.conversation_id AND x.user_text = y.user_text AND y.turn < x.turn GROUP BY ALL),
    o AS (SELECT conversation_id, bool_or(s < -0.5 AND NOT was < -0.5) AS negative_increase, bool_or(NOT s < -0.5 AND was < -0.5) AS negative_decrease, bool_or(s > 0.5 AND NOT was > 0.5) AS positive_increase,
        bool_or(NOT s > 0.5 AND was > 0.5) AS positive_decrease, bool_or(s < -0.5 AND was < -0.5) AS consecutive_negative, max(s - was) AS gap FROM m GROUP BY 1),
    r AS (SELECT a.conversation_id, bool_or(a.s < -0.5) AS has_negative_reply, avg(CAST(a.s < -0.5 AS INT)) AS share, bool_or(a.s < -0.5 AND b.s > 0.5) AS negative_to_positive,
        bool_or(a.s > 0.5 AND b.s < -0.5) AS positive_to_negative FROM s a JOIN s b ON a.reply_to = b.id GROUP BY 1)
    SELECT conversation_id, negative_increase, negative_decrease, positive_increase, positive_decrease, consecutive_negative, round(gap, 6) AS max_polarity_gap, has_negative_reply,
        round(share, 6) AS negative_reply_share, negative_to_positive, positive_to_negative FROM o FULL JOIN r USING (conversation_id)""")
def polarity_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = features.polarity_changes(_scored(spark, sf_dir))
    return changes.withColumns({c: F.round(c, 6) for c in ("max_polarity_gap", "negative_reply_share")})


@query(f"""WITH {COMMENTS} SELECT conversation_id, bool_or({SCORES} > 0.5) AS has_positive, bool_or({SCORES} < -0.5) AS has_negative, bool_or(contains(content, '?') AND turn % 2 = 0) AS has_polite FROM comments GROUP BY 1""")
def polarity_of_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).withColumn("politeness", (1 - F.col("turn") % 2).cast("double"))
    return features.any_of(features.polarity(rows, politeness="politeness", asks=F.col("content").contains("?")), ["is_positive", "is_negative", "is_polite"])


_overlap = lambda a, b, w: f"list_has_any(list_filter({a}, lambda v: {w} list_contains({STOP}, v)), list_filter({b}, lambda v: {w} list_contains({STOP}, v)))"


@query(f"""WITH {COMMENTS}, l AS (SELECT *, max(turn) OVER (PARTITION BY conversation_id) AS last FROM comments),
    c AS (SELECT conversation_id, turn, id, reply_to, user_text, ts, {TOKENS.format('content')} AS w, contains(content, '?') AS q, (turn * 37 % 100) / 100 AS x FROM l WHERE turn < last),
    m AS (SELECT a.conversation_id, a.turn, a.x, a.w, arg_max(b.w, b.turn) AS was, arg_max(b.x, b.turn) AS px FROM c a LEFT JOIN c b ON a.conversation_id = b.conversation_id AND a.user_text = b.user_text AND b.turn < a.turn GROUP BY ALL),
    o AS (SELECT conversation_id, bool_or(coalesce({_overlap('w', 'was', 'NOT')}, false)) AS content_repeat, bool_or(coalesce({_overlap('w', 'was', '')}, false)) AS stop_repeat,
        bool_or(coalesce(x - px > 0.05, false)) AS toxicity_raise, max(x - px) AS most, avg(x - px) AS mean FROM m GROUP BY 1),
    r AS (SELECT a.conversation_id, bool_or({_overlap('a.w', 'b.w', 'NOT')}) AS content_adoption, bool_or({_overlap('a.w', 'b.w', '')}) AS stop_adoption, bool_or(a.q AND b.q) AS question_to_question,
        bool_or(a.q AND NOT b.q) AS question_to_non_question, bool_or(NOT a.q AND b.q) AS non_question_to_question, CAST(max(epoch(a.ts)::BIGINT - epoch(b.ts)::BIGINT) AS BIGINT) AS max_time_gap FROM c a JOIN c b ON a.reply_to = b.id GROUP BY 1)
    SELECT conversation_id, content_repeat, stop_repeat, toxicity_raise, round(most, 6) AS max_toxicity_gap, round(mean, 6) AS mean_toxicity_gap, content_adoption, stop_adoption, question_to_question,
        question_to_non_question, non_question_to_question, max_time_gap FROM o LEFT JOIN r USING (conversation_id)""")
def repetition_and_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features.conversation_features(_scored(spark, sf_dir))
    r = lambda c: F.round(c, 6).alias(c)
    flags = ["content_adoption", "stop_adoption", "question_to_question", "question_to_non_question", "non_question_to_question", "max_time_gap"]
    return f.select("conversation_id", "content_repeat", "stop_repeat", "toxicity_raise", r("max_toxicity_gap"), r("mean_toxicity_gap"), *flags)


_low = "lower(content)"
_has = lambda words: f"list_has_any({TOKENS.format('content')}, [" + ", ".join(f"'{w}'" for w in words) + "])"
_starts = lambda p: f"len(list_filter({SENTENCES.format('content')}, lambda x: regexp_matches(lower(x), '{sql_q(p)}'))) > 0"
_marker = lambda words: f"len(list_filter(regexp_split_to_array({_low}, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x IN (" + ", ".join(f"'{w}'" for w in words) + "))) > 0"
LISTS = {"article": ["the", "a"], "conjunction": ["and", "or"]}


@query(rf"""WITH {COMMENTS}, l AS (SELECT *, max(turn) OVER (PARTITION BY conversation_id) AS last FROM comments), c AS (SELECT *, (turn * 37 % 100) / 100 AS x FROM l WHERE turn < last),
    p AS (SELECT *, x / nullif(sum(x) OVER (PARTITION BY conversation_id), 0) AS p, count(*) OVER (PARTITION BY conversation_id) AS n FROM c)
    SELECT conversation_id, round(least(1 + sum(CASE WHEN p > 0 AND n > 1 THEN p * ln(p) / ln(n) ELSE 0 END), 1), 6) AS toxicity_entropy, bool_or({_has(t.THANKS)}) AS has_thank, bool_or({_has(t.GREETINGS)}) AS has_greeting,
        bool_or(regexp_matches(content, '[?!][?!]')) AS has_marks, bool_or({_starts("^(do|don't) ")}) AS do_start, bool_or({_starts('^you ')}) AS you_start,
        bool_or(len(list_filter(regexp_split_to_array(content, '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_matches(x, '^[A-Z][A-Z]+$'))) > 0) AS all_caps,
        bool_or({_agrees}) AS agrees, bool_or(regexp_matches({_low}, '{sql_q(t.whole(t.DISAGREE))}')) AS disagrees, {', '.join(f'bool_or({_marker(w)}) AS lexicon_{k}' for k, w in LISTS.items())} FROM p GROUP BY 1""")
def cues_of_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features.conversation_features(_scored(spark, sf_dir), LISTS)
    flags = ["has_thank", "has_greeting", "has_marks", "do_start", "you_start", "all_caps", "agrees", "disagrees", *(f"lexicon_{k}" for k in LISTS)]
    return f.select("conversation_id", F.round("toxicity_entropy", 6).alias("toxicity_entropy"), *flags)


@query(f"""WITH {DOCS} SELECT doc_id, CAST(place AS BIGINT) AS place, md5(sentence) AS sentence FROM (SELECT doc_id, unnest({SENTENCES.format("replace(text, ', ', '? ')")}) AS sentence,
    unnest(range(len({SENTENCES.format("replace(text, ', ', '? ')")}))) AS place FROM d) WHERE ends_with(sentence, '?')""")
def question_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commas stand for question marks, of which the texts have none."""
    asked = t.questions(F.replace(F.col("text"), F.lit(", "), F.lit("? ")))
    return _docs(spark, sf_dir).select("doc_id", F.inline(asked)).withColumn("sentence", F.md5("sentence"))


@query("SELECT doc_id % 50 AS conversation_id, " + ", ".join(f"bool_or(doc_id % 9 = {k}) AS question_type{k}" for k in range(8)) + " FROM documents GROUP BY 1")
def question_type_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.abs(k - F.col("doc_id") % 9))
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("conversation_id"), features.nearest_kind(d).alias("kind"))
    return features.question_types(rows, "kind")


TAGS = "CASE WHEN length(x) % 3 = 0 THEN 'NN' WHEN length(x) % 3 = 1 THEN 'NNS' ELSE 'VB' END"


@query(f"""WITH {COMMENTS}, w AS (SELECT conversation_id, user_text, unnest({TOKENS.format('content')}) AS x FROM comments), n AS (SELECT *, {TAGS} AS tag FROM w),
    u AS (SELECT conversation_id, user_text, count(DISTINCT x) FILTER (starts_with(tag, 'NN')) AS nouns FROM (SELECT conversation_id, user_text, NULL AS x, '' AS tag FROM comments UNION ALL SELECT * FROM n) GROUP BY 1, 2)
    SELECT c.conversation_id, round((SELECT count(DISTINCT x) FILTER (starts_with(tag, 'NN')) / nullif(count(*), 0) FROM n WHERE n.conversation_id = c.conversation_id), 6) AS nouns_over_tokens,
    CAST(max(u.nouns) AS BIGINT) AS most_nouns, CAST(min(u.nouns) AS BIGINT) AS least_nouns FROM (SELECT DISTINCT conversation_id FROM comments) c JOIN u USING (conversation_id) GROUP BY 1""")
def noun_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = t.tokens(F.col("content"))
    rows = comments(spark, sf_dir).withColumn("tokens", words)
    tag = lambda x: F.when(F.length(x) % 3 == 0, "NN").when(F.length(x) % 3 == 1, "NNS").otherwise("VB")
    found = features.noun_features(rows.withColumn("pos", F.transform("tokens", tag)))
    return found.select("conversation_id", F.round("nouns_over_tokens", 6).alias("nouns_over_tokens"), F.col("most_nouns").cast("long").alias("most_nouns"), F.col("least_nouns").cast("long").alias("least_nouns"))


USERS = """u AS (SELECT DISTINCT doc_id % 40 AS conversation_id, source AS "user", source = 'web' AS anonymous, length(source) % 5 = 0 AS bot, length(source) % 2 = 0 AS blocked, CAST(length(source) + (doc_id % 40) AS DOUBLE) AS age FROM documents)"""


@query(f"""WITH {USERS}, p AS (SELECT *, (coalesce(age, 0) + 0.001) / sum(coalesce(age, 0) + 0.001) OVER w AS p, count(*) OVER w AS n FROM u WINDOW w AS (PARTITION BY conversation_id, coalesce(bot, false)))
    SELECT conversation_id, max(coalesce(age, 0)) FILTER (NOT coalesce(bot, false)) AS max_age, min(coalesce(age, 0)) FILTER (NOT coalesce(bot, false)) AS min_age,
    max(coalesce(age, 0)) FILTER (NOT coalesce(bot, false)) - min(coalesce(age, 0)) FILTER (NOT coalesce(bot, false)) AS gap_age,
    round(1 + sum(CASE WHEN n > 1 THEN p * ln(p) / ln(n) END) FILTER (NOT coalesce(bot, false)), 6) AS entropy_age,
    bool_or(coalesce(anonymous, false)) AS has_anon, bool_or(coalesce(bot, false)) AS has_bot, bool_or(coalesce(blocked, false)) AS has_blocked FROM p GROUP BY 1""")
def user_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "documents").selectExpr(
        "doc_id % 40 AS conversation_id", "source AS user", "source = 'web' AS anonymous", "length(source) % 5 = 0 AS bot", "length(source) % 2 = 0 AS blocked", "CAST(length(source) + (doc_id % 40) AS DOUBLE) AS age"
    ).distinct()
    return features.aspect_features(users, ["age"]).withColumn("entropy_age", F.round("entropy_age", 6))


@query(f"""WITH {COMMENTS}, u AS (SELECT conversation_id, user_text, count(*) AS n, max(turn) AS last, min(turn) AS first FROM comments GROUP BY 1, 2),
    r AS (SELECT *, min(n) OVER w AS lo, max(n) OVER w AS hi, max(last) OVER w AS fin FROM u WINDOW w AS (PARTITION BY conversation_id))
    SELECT conversation_id, user_text, CASE WHEN user_text = 'system' THEN 'Anonymous' WHEN first = last THEN 'New Comer' WHEN conversation_id % 9 = 0 THEN 'Bot' WHEN lo = hi THEN 'No Gap' WHEN n = hi THEN 'Max' WHEN n = lo THEN 'Min' ELSE 'Middle' END AS profile
    FROM r WHERE last = fin""")
def last_participant(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    u = comments(spark, sf_dir).groupBy("conversation_id", "user_text").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last"), F.min("turn").alias("first"))
    u = u.withColumn("is_last", F.col("last") == F.max("last").over(Window.partitionBy("conversation_id"))).withColumns(
        {"is_new": F.col("first") == F.col("last"), "anonymous": F.col("user_text") == "system", "bot": F.col("conversation_id") % 9 == 0}
    )
    return conversations.last_participant_profile(u, "n")


LINKS = "content || ' [WIKI_LINK: WP:' || CASE WHEN conversation_id % 4 = 0 AND turn = 2 THEN 'Vandalism' ELSE 'Style' END || '] [EXTERNAL_LINK: http://x.org]'"


@query(f"WITH {COMMENTS} SELECT conversation_id, bool_or(conversation_id % 4 = 0 AND turn = 2) AS has_policy_intervention FROM comments GROUP BY 1")
def policy_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.policy_intervention(comments(spark, sf_dir).withColumn("content", F.expr(LINKS)))


MARKED = "'=: ' || role || ' [REPLYTO: ' || role || '] see [WIKI_LINK: P' || turn || '] and [EXTERNAL_LINK: http://x.org/' || turn || '] [OUTDENT: 3][MENTION: Ann] end ='"


@query(r"""WITH l AS (SELECT conv_id, turn, role, array_to_string(list_filter(list_transform(string_split(':*' || role || ' [REPLYTO: ' || role || '] ' || text || chr(10) || chr(10) || ' [WIKI_LINK: P' || turn || '] and [EXTERNAL_LINK: http://x.org/' || turn || '] [OUTDENT: 3][MENTION: Ann] end', chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS x FROM conversations),
    p AS (SELECT *, regexp_replace(x, '^[:*]+', '') AS y FROM l)
    SELECT conv_id, turn, role AS replyto, 'P' || turn AS wiki_link, 'http://x.org/' || turn AS external_link, 'Ann' AS mention, md5(regexp_replace(replace(replace(replace(replace(replace(y, '[REPLYTO: ' || role || ']', 'replyto'), '[WIKI_LINK: P' || turn || ']', 'wiki_link'),
    '[EXTERNAL_LINK: http://x.org/' || turn || ']', 'external_link'), '[OUTDENT: 3]', ''), '[MENTION: Ann]', 'mention'), ' +', ' ', 'g')) AS "text" FROM p""")
def feature_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of the table, whole, among the marks that features are cut from."""
    raw = F.expr("concat(':*', role, ' [REPLYTO: ', role, '] ', text, '\\n\\n [WIKI_LINK: P', turn, '] and [EXTERNAL_LINK: http://x.org/', turn, '] [OUTDENT: 3][MENTION: Ann] end')")
    found = t.feature_text(raw)
    text = F.md5(F.regexp_replace(found["text"], " +", " ")).alias("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text, *[F.array_join(found[c], "|").alias(c) for c in ("replyto", "wiki_link", "external_link", "mention")])


# --- sentences and text ---


@query(rf"""WITH {DOCS} SELECT doc_id, CAST(len(s) AS BIGINT) AS n, md5(array_to_string(s, '|')) AS cut FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]+)[ \t\n]+([\p{{Lu}}0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)),
    lambda x: trim(regexp_replace(x, '[ \t\n]+', ' ', 'g'))), lambda x: x <> '') AS s FROM d)""")
def running_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t.running_sentences(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|")).alias("cut"))


@query(r"""WITH l AS (SELECT conv_id, turn, string_split(CASE turn % 3 WHEN 0 THEN '== h ==' || chr(10) || text || chr(10) || 'end' WHEN 1 THEN '=== t ==' || chr(10) || text || chr(10) || 'end' ELSE text || chr(10) || '= x' || chr(10) || 'end' END, chr(10)) AS l FROM conversations)
    SELECT conv_id, turn, array_to_string(list_filter(l, lambda x: length(regexp_extract(x, '^(=+)', 1)) = 0 OR length(regexp_extract(x, '^(=+)', 1)) <> length(regexp_extract(x, '(=+)$', 1))), chr(10)) AS plain FROM l""")
def without_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE turn % 3 WHEN 0 THEN concat('== h ==\\n', text, '\\nend') WHEN 1 THEN concat('=== t ==\\n', text, '\\nend') ELSE concat(text, '\\n= x\\nend') END")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.without_headings(raw).alias("plain"))


@query("SELECT conv_id, turn, replace(role || ' ' || text || '  x', chr(10), ' ') AS plain FROM conversations")
def plain_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("concat(role, 'NEWLINE_TOKEN', replace(text, '\\n', 'NEWLINE_TOKEN'), 'NEWTAB_TOKENNEWLINE_TOKENx')")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.plain_tokens(raw).alias("plain"))


@query(f"WITH {DOCS} SELECT doc_id, length(text) > 300 AS raw, md5(CASE WHEN length(text) > 300 THEN text ELSE regexp_replace(regexp_replace(text, '--', '', 'g'), ' :', ' ', 'g') END) AS clean FROM d")
def guarded_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean, raw = t.guarded(F.col("text"), t.clean_action, 300)
    return _docs(spark, sf_dir).select("doc_id", raw.alias("raw"), F.md5(clean).alias("clean"))


@query("SELECT doc_id, sha1(coalesce(text, '')) AS sha1 FROM documents")
def sha1_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha1("text").alias("sha1"))


TITLES = "CASE doc_id % 4 WHEN 0 THEN 'Talk:A' || doc_id || '/Archive 1/x' WHEN 1 THEN 'User talk:B:' || doc_id WHEN 2 THEN 'C' || doc_id || '/sub' ELSE 'Talk:' END"


@query(f"""SELECT doc_id, regexp_replace({TITLES}, '^[^:]*:', '') AS page, CASE WHEN contains({TITLES}, '/Archive') THEN string_split({TITLES}, '/')[1] ELSE {TITLES} END AS root,
    CASE doc_id % 5 WHEN 1 THEN 'talk' WHEN 3 THEN 'user_talk' END AS namespace, CASE WHEN doc_id % 3 = 0 THEN 'arts|music|' || lang WHEN doc_id % 3 = 1 THEN 'arts|-|-' ELSE '-|-|-' END AS levels,
    CASE WHEN doc_id % 2 = 0 THEN 'T' || doc_id || ', Music of ' || lang END AS subject, substr(coalesce(text, ''), 3, 5) AS span FROM documents""")
def title_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.expr(TITLES.replace("'Talk:A' || doc_id || '/Archive 1/x'", "concat('Talk:A', doc_id, '/Archive 1/x')").replace("'User talk:B:' || doc_id", "concat('User talk:B:', doc_id)").replace("'C' || doc_id || '/sub'", "concat('C', doc_id, '/sub')"))
    path = F.expr("CASE WHEN doc_id % 3 = 0 THEN concat('/arts/music/', lang) WHEN doc_id % 3 = 1 THEN '/arts' ELSE '' END")
    subjects = F.array(F.lit("Category:Wikipedia pages"), F.expr("CASE WHEN doc_id % 2 = 0 THEN concat('Category:Music of ', lang) ELSE 'Category:1900 births' END"))
    rows = table(spark, sf_dir, "documents")
    return rows.select(
        "doc_id", t.title_without_namespace(title).alias("page"), t.archive_root(title).alias("root"), t.namespace_name(F.col("doc_id") % 5).alias("namespace"),
        F.array_join(t.category_levels(path), "|", "-").alias("levels"), t.category_text(F.concat(F.lit("T"), "doc_id"), subjects).alias("subject"),
        t.span_text(F.coalesce("text", F.lit("")), F.lit(2), F.lit(7)).alias("span"),
    )


# --- edits ---


@query(f"""WITH {PAIRS}, x AS (SELECT doc_id, list_distinct(list_filter(now, lambda x: NOT list_contains(was, x))) AS i, list_distinct(list_filter(was, lambda x: NOT list_contains(now, x))) AS d FROM c),
    q AS (SELECT doc_id, old, unnest(i) AS new FROM (SELECT doc_id, unnest(d) AS old, i FROM x)), w AS (SELECT *, {TOKENS.format('old')} AS a, {TOKENS.format('new')} AS b FROM q)
    SELECT doc_id, md5(old) AS old, md5(new) AS new FROM w WHERE old <> new AND len(a) >= 3 AND len(list_intersect(list_distinct(a), list_distinct(b))) / greatest(len(list_distinct(a)), 1) >= 0.6
        AND len(list_intersect(list_distinct(a), list_distinct(b))) / greatest(len(list_distinct(b)), 1) >= 0.6""")
def revised_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pov.revised_sentences(pov.sentence_changes(_pairs(spark, sf_dir), "doc_id", "text"), "doc_id")
    return found.select("doc_id", F.md5("old").alias("old"), F.md5("new").alias("new"))


@query("""WITH r AS (SELECT doc_id % 31 AS rev_id, doc_id, 'the ' || source || ' has some words here' AS sentence FROM documents)
    SELECT a.rev_id, count(*) AS n FROM r a JOIN r b ON a.rev_id = b.rev_id AND a.doc_id % 2 = 0 AND b.doc_id % 2 = 1 AND a.sentence <> b.sentence GROUP BY 1""")
def fuzzy_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id % 31 AS rev_id", "doc_id", "concat('the ', source, ' has some words here') AS sentence")
    return pov.fuzzy_revisions(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1")).groupBy("rev_id").agg(F.sum("n").alias("n"))


@query(f"WITH {PAIRS} SELECT doc_id FROM p WHERE former IS NOT NULL AND abs(length(former) - length(text)) < 100 AND contains(text, 'er')")
def similar_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pov.mentions(pov.similar_size(_pairs(spark, sf_dir), "text"), "er", column="text").select("doc_id")


# --- slices, lookups and labels ---

SLICED = """s AS (SELECT e.event_id AS id, e.event_id % 1000 / 1000 AS toxicity, e.event_id % 7 / 7 AS flirtation, e.event_id % 11 / 11 AS threat, e.event_id % 13 / 13 AS identity_attack, e.event_id % 17 / 17 AS insult,
    e.event_id % 19 / 19 AS sexually_explicit, e.event_id % 23 / 23 AS profanity, e.event_id % 29 / 29 AS severe_toxicity, event_type AS category1, NULL AS sub_category1, NULL AS category2, event_type || '/x' AS sub_category2,
    NULL AS category3, NULL AS sub_category3, user_id AS page_id, 'Talk:' || user_id AS page_title, event_id AS rev_id, 'u' || user_id AS user_text, ts AS "timestamp", props AS content, props AS cleaned_content,
    CASE WHEN event_type = 'error' THEN 'DELETION' ELSE 'ADDITION' END AS type FROM events e)"""
SLICED_SPARK = SLICED[len("s AS (SELECT ") : SLICED.rindex(" FROM events e)")].replace("e.event_id", "event_id").replace("event_type || '/x'", "concat(event_type, '/x')").replace("'Talk:' || user_id", "concat('Talk:', user_id)").replace("'u' || user_id", "concat('u', user_id)").replace("NULL AS", "CAST(NULL AS STRING) AS").replace('"timestamp"', "timestamp")


def _sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("_sliced_events")
    return spark.sql(f"SELECT {SLICED_SPARK} FROM _sliced_events")


@query(f"""WITH {SLICED} SELECT {', '.join('"timestamp"' if c == 'timestamp' else c for c in trends.SLICE)} FROM s WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND toxicity > 0.8""")
def month_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda d: F.to_timestamp_ntz(F.lit(d))
    return trends.month_slice(_sliced(spark, sf_dir), at("2024-01-05 00:00:00"), at("2024-01-20 00:00:00"))


@query(f"WITH {SLICED} SELECT id FROM s WHERE (category1 = 'view/x' OR sub_category2 = 'view/x') AND type <> 'DELETION'")
def category_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.category_facet(_sliced(spark, sf_dir), "view/x").select("id")


@query(f"WITH {REVISIONS} SELECT rev_id, attack, CAST(rev_id % 6 = 0 AS DOUBLE) AS reverted FROM revisions")
def client_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = revisions(spark, sf_dir)
    out = trends.client_rows(rows, rows.where("rev_id % 6 = 0"))
    return out.select("rev_id", F.col("row")[1].alias("attack"), F.col("row")[2].alias("reverted"))


@query(f"WITH {COMMENTS} SELECT id FROM comments WHERE length(content) > 60 AND length(content) < 200 AND reply_to <> 'null'")
def length_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.of_length(comments(spark, sf_dir), "content", 60, 200).select("id")


@query("SELECT doc_id FROM documents WHERE source IN (SELECT DISTINCT source FROM documents WHERE doc_id % 31 = 0)")
def selected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("page_id"))
    return lookup.of_pages(docs, docs.where("doc_id % 31 = 0")).select("doc_id")


@query("SELECT -e.event_id AS rev_id, d.text AS comment FROM events e JOIN documents d ON d.doc_id = e.event_id WHERE d.text IS NOT NULL AND d.doc_id % 5 <> 0")
def enriched_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "events").select((-F.col("event_id")).alias("rev_id"))
    known = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rev_id"), F.col("text").alias("comment"), F.when(F.col("doc_id") % 5 != 0, "t").alias("timestamp"))
    return lookup.enriched(changes, known).drop("timestamp")


@query("""WITH s AS (SELECT DISTINCT user_id AS page_id, user_id * 10 AS subject_id FROM events WHERE user_id % 3 <> 0) SELECT event_id, coalesce(subject_id, -1) AS subject_id FROM events LEFT JOIN s ON page_id = user_id""")
def subject_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    subjects = e.where("user_id % 3 <> 0").selectExpr("user_id AS page_id", "user_id * 10 AS subject_id")
    return history.subject_pages(e.selectExpr("event_id", "user_id AS page_id"), subjects).select("event_id", "subject_id")


@query("""WITH s AS (SELECT source, count(*) AS n, avg(n_chars) AS mean, CAST(sum(n_chars) AS BIGINT) AS total FROM documents GROUP BY 1) SELECT source, n, round(mean, 6) AS mean, total FROM s""")
def size_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.sum("n_chars").alias("total"))


@query("SELECT doc_id % 60 AS unit, " + ", ".join(f"min(toxic) FILTER (doc_id % 4 = {k}) AS c{k}" for k in range(4)) + " FROM labels GROUP BY 1")
def reliability_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").selectExpr("doc_id % 60 AS unit", "concat('c', doc_id % 4) AS coder", "toxic AS label")
    return agreement.reliability_matrix(rows, "unit", "coder", "label", [f"c{k}" for k in range(4)])


@query(f"""WITH {COMMENTS}, u AS (SELECT conv_id % 20 AS unit, conv_id || '.0.0' AS id FROM conversations WHERE turn = 0 UNION SELECT conv_id % 20, (conv_id + 1) || '.1.1' FROM conversations WHERE turn = 0)
    SELECT DISTINCT unit, conversation_id FROM u JOIN comments USING (id)""")
def label_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "conversations").where("turn = 0").selectExpr("conv_id % 20 AS unit", "array(concat(conv_id, '.0.0'), concat(conv_id + 1, '.1.1')) AS ids")
    return agreement.label_members(units, comments(spark, sf_dir), "unit", "ids")


@query("SELECT doc_id FROM documents a WHERE a.doc_id + 1 IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) AND a.doc_id % 3 <> 0")
def with_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").selectExpr("doc_id", "doc_id + 1 AS matched_id")
    return agreement.with_matched(rows, "matched_id", "doc_id").select("doc_id")


@query("""WITH s AS (SELECT doc_id % 80 AS unit, avg(toxic) > 0.5 AS said FROM labels GROUP BY 1), u AS (SELECT DISTINCT doc_id % 80 AS unit FROM labels)
    SELECT CAST(unit % 9 AS BIGINT) AS page, round(avg(CAST(CAST(said AS INT) = unit % 2 AS DOUBLE)), 6) AS accuracy FROM u JOIN s USING (unit) GROUP BY 1""")
def crowd_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id % 80 AS unit", "toxic AS label")
    truth = labels.select("unit").distinct().selectExpr("unit", "CAST(unit % 9 AS BIGINT) AS page", "CAST(unit % 2 AS INT) AS bad")
    return agreement.pair_accuracy(labels, truth, "unit", "label", "page").withColumn("accuracy", F.round("accuracy", 6))


@query("""SELECT round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(value)), 6) AS sem, round(1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS half_width, event_type FROM events GROUP BY 4""")
def mean_with_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mean_with_error(table(spark, sf_dir, "events"), ["event_type"], "value").select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "sem", "half_width")])


@query("SELECT value, n, CAST(sum(n) OVER (ORDER BY value) AS BIGINT) AS n_to FROM (SELECT round(value) AS value, count(*) AS n FROM events GROUP BY 1)")
def running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "events").groupBy(F.round("value").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return stats.running_sums(per, "value", ["n"])


@query("SELECT event_id, round(10 + (value - 0) * (20 - 10) / (500 - 0), 6) AS scaled, round(value / max(value) OVER (), 6) AS share FROM events")
def rescaled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "value", F.col("value").alias("share"))
    return features.max_normalised(e, ["share"]).select("event_id", F.round(stats.rescaled(F.col("value"), 0, 500, 10, 20), 6).alias("scaled"), F.round("share", 6).alias("share"))


@query("SELECT event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 7 AS BIGINT) AS chunk FROM events")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", sinks.chunk_number([F.col("user_id"), F.col("event_id")], 7).alias("chunk"))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n, arg_min(event_type, event_id) AS first FROM events GROUP BY 1")
def action_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of a page by id, as one map; its size and the value at the least id."""
    maps = table(spark, sf_dir, "events").groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_id", "event_type"))).alias("m"))
    return maps.select("user_id", F.size("m").cast("long").alias("n"), F.col("m")[F.array_min(F.map_keys("m"))].alias("first"))


@query("SELECT user_id, md5(string_agg(event_id, ',' ORDER BY event_id)) AS ordered FROM events GROUP BY 1")
def ordered_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of a page in the order of the first part of their ids as a number."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct(F.split(F.concat_ws(".", "event_id", F.lit("0")), r"\.")[0].cast("long").alias("n")))), lambda x: x["n"].cast("string"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.md5(F.array_join(ids, ",")).alias("ordered"))


KINDS = {"first": ["the", "der", "le", "el"], "second": ["and", "und", "et", "y"], "third": ["of", "von", "de"], "fourth": ["in", "en", "to"]}
_share = lambda words: f"round(len(list_filter(w, lambda x: x IN ({', '.join(repr(v) for v in words)}))) / greatest(len(w), 1), 6)"


@query(f"""WITH {DOCS}, w AS (SELECT doc_id, {TOKENS.format('text')} AS w FROM d), k AS (SELECT doc_id, unnest([{', '.join(f"{{'name': '{k}', 'conf': {_share(v)}}}" for k, v in KINDS.items())}]) AS pair FROM w),
    r AS (SELECT doc_id, pair.name AS category, pair.conf AS confidence, row_number() OVER (PARTITION BY doc_id ORDER BY pair.conf DESC, pair.name) AS place FROM k WHERE pair.conf > 0) SELECT doc_id, category, confidence FROM r WHERE place <= 3""")
def top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.categories(_docs(spark, sf_dir), "text", KINDS).select("doc_id", F.inline("categories"))


# --- users and times ---


@query("""WITH s AS (SELECT user_id, min(ts) + INTERVAL 10 DAY AS start FROM events GROUP BY 1) SELECT s.user_id || '' AS conversation_id, s.user_id AS "user", round(coalesce(avg(value), 0), 6) AS history_toxicity
    FROM s LEFT JOIN events e ON e.user_id = s.user_id AND e.ts < s.start GROUP BY 1, 2""")
def past_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    starts = e.groupBy("user_id").agg((F.min("ts") + F.expr("INTERVAL 10 DAY")).alias("start")).selectExpr("CAST(user_id AS STRING) AS conversation_id", "user_id AS user", "start")
    return history.past_toxicity(e.selectExpr("user_id AS user", "ts", "value AS toxicity"), starts).withColumn("history_toxicity", F.round("history_toxicity", 6))


@query("""SELECT user_id AS "user", event_type AS page_id, CAST(year(ts) AS BIGINT) AS year, CAST(month(ts) AS BIGINT) AS month, count(*) AS n FROM events GROUP BY 1, 2, 3, 4""")
def monthly_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = history.monthly_edits(table(spark, sf_dir, "events").selectExpr("user_id AS user", "event_type AS page_id", "ts"))
    return n.withColumns({c: F.col(c).cast("long") for c in ("year", "month")})


@query("""SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds, round(greatest((CAST(epoch(date_trunc('second', ts)) AS BIGINT) - 1704844800) / (30 * 86400), 0), 6) AS age,
    CASE WHEN epoch(date_trunc('second', ts)) - 1704067200 <= 86400 THEN 'day' WHEN epoch(date_trunc('second', ts)) - 1704067200 <= 7 * 86400 THEN 'week' WHEN epoch(date_trunc('second', ts)) - 1704067200 <= 30 * 86400 THEN 'month' ELSE 'year' END AS lag FROM events""")
def ages_and_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("t", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss 'UTC'"))
    s = time.epoch_seconds(F.col("t"))
    lag = trends.deletion_lag(F.lit(1704067200), s)
    return e.select("event_id", s.alias("seconds"), F.round(history.account_age_months(F.lit(1704844800), s), 6).alias("age"), lag.alias("lag"))


@query("""SELECT DISTINCT 'c' || user_id % 5 AS conversation_id, 'u' || user_id AS "user", CASE WHEN user_id % 7 = 0 THEN -1 WHEN user_id % 7 = 1 THEN 4 WHEN user_id % 7 = 2 THEN 3 WHEN user_id % 7 = 3 THEN 2 ELSE 1 END AS level,
    user_id % 4 = 0 AS blocked FROM events""")
def user_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    users = u.selectExpr(
        "concat('u', user_id) AS name", "CASE user_id % 7 WHEN 0 THEN array('sysop', 'bot') WHEN 1 THEN array('reviewer', 'sysop') WHEN 2 THEN array('checkuser') WHEN 3 THEN array('rollbacker') WHEN 4 THEN array('user') ELSE array() END AS groups",
        "'2001-01-01 00:00:00' AS registration", "CASE user_id % 4 WHEN 0 THEN '2001-01-01' WHEN 1 THEN '2003-01-01' END AS blockedtimestamp",
    )
    starts = u.selectExpr("concat('c', user_id % 5) AS conversation_id", "concat('u', user_id) AS user", "'2002-01-01' AS start")
    return history.user_facts(users, starts).select("conversation_id", "user", "level", "blocked")


# --- sinks, sources and streams ---


@query("""SELECT CAST(event_id AS VARCHAR) AS id, event_type AS type, 'ANONYMOUS:' || user_id AS author FROM events""")
def published_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("CAST(event_id AS STRING) AS id", "event_type AS type", "array(struct(CAST(NULL AS STRING) AS user_id, CAST(user_id AS STRING) AS user_text)) AS authors")
    return sinks.published(e).select("id", "type", F.col("authors")[0].alias("author"))


@query("""SELECT base64(encode(event_type)) AS raw, CASE WHEN event_id % 10 <> 0 THEN CAST(event_id % 10 AS BIGINT) END AS n, count(*) AS rows FROM events WHERE event_type <> 'view' GROUP BY 1, 2""")
def typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("CASE WHEN event_type <> 'view' THEN event_type ELSE '' END AS raw", "event_id % 10 AS n")
    rows = sinks.typed(sinks.valid_rows(e, ["raw"]), {"raw": "BYTES", "n": "INT"}, falsy_to_null=True)
    return rows.groupBy("raw", "n").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT event_type, count(*) AS n FROM (SELECT DISTINCT event_type, user_id FROM events WHERE user_id % 2 = 1) GROUP BY 1")
def inserted_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "user_id")
    return sinks.new_rows(e, e.where("user_id % 2 = 0"), ["event_type", "user_id"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS "start", event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def streaming_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, counted by hour; the counts are read from the stream's own table."""
    from threadlens.streaming.events import windowed_counts

    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    folder, name = spark.conf.get("spark.checkpoint.dir", None), f"hourly_{uuid.uuid4().hex}"
    writer = windowed_counts(stream, "ts", "1 hour", by=["event_type"]).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True)
    writer = writer.option("checkpointLocation", f"{folder.rstrip('/')}/{name}") if folder else writer
    writer.start().awaitTermination()
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND event_id % 3 <> 0 AND event_id % 2 = 1")
def wanted_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a change feed: those of one wiki's namespace, by people, to pages that were there."""
    from threadlens.streaming.events import wanted_edits as wanted

    line = F.to_json(F.struct(F.col("event_type").alias("wiki"), (F.col("event_id") % 3 == 0).alias("bot"), (F.col("event_id") % 2).cast("int").alias("namespace"), F.col("event_id").cast("string").alias("title"), F.struct(F.lit(1).cast("long").alias("old")).alias("revision")))
    return wanted(table(spark, sf_dir, "events").select(line.alias("value")), "click", [1]).select(F.col("title").cast("long").alias("event_id"))


@query("""WITH z AS (SELECT event_id AS id, value / 500 AS score FROM events), s AS (SELECT id, CAST(floor(score * 4) AS BIGINT) AS zone, row_number() OVER (PARTITION BY floor(score * 4) ORDER BY md5(id || ':s'), id) AS n FROM z WHERE score >= 0 AND score < 1),
    r AS (SELECT id, CAST(-1 AS BIGINT) AS zone FROM z ORDER BY md5(id || ':sr'), id LIMIT 15) SELECT id, zone FROM s WHERE n <= 10 UNION ALL SELECT id, zone FROM r""")
def stratified_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("value") / 500).alias("score"))
    return sampling.stratified_sample(rows, "id", "score", 4, 10, random=15).select("id", "zone")


@query("SELECT event_id, user_id AS conversation FROM events WHERE user_id % 2 = 0")
def scores_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    scores, mapping = e.select("event_id", F.col("user_id").alias("id")), e.where("user_id % 2 = 0").select(F.col("user_id").alias("id"), F.col("user_id").alias("conversation")).distinct()
    return readers.scores_of_pages(scores, mapping).select("event_id", "conversation")


# --- resamples and models ---

_CUMULATIVE = "[" + ", ".join(f"{c!r}" for c in sampling.poisson_steps()) + "]"
_U = "(('0x' || substr(md5({} || ':' || rep || ':{}'), 1, {}))::BIGINT)"


@query(f"""WITH r AS (SELECT event_id, value, unnest(range(1, 11)) AS rep FROM events), k AS (SELECT rep, value, len(list_filter({_CUMULATIVE}, lambda c: {_U.format('event_id', 'b', 8)} / 4294967296.0 >= c)) AS k FROM r)
    SELECT CAST(rep AS BIGINT) AS rep, round(sum(k * value) / sum(k), 6) AS mean FROM k GROUP BY 1""")
def bootstrap_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.bootstrap_means(table(spark, sf_dir, "events"), "event_id", "value", 10).select(F.col("rep").cast("long").alias("rep"), F.round("mean", 6).alias("mean"))


@query(f"""WITH p AS (SELECT event_id, value - 250 AS d FROM events), r AS (SELECT event_id, d, unnest(range(1, 101)) AS rep FROM p),
    s AS (SELECT rep, sum(CASE WHEN {_U.format('event_id', 'r', 1)} % 2 = 1 THEN -d ELSE d END) AS d FROM r GROUP BY 1) SELECT round((count(*) FILTER (d >= (SELECT sum(d) FROM p)) + 1) / (count(*) + 1), 6) AS p FROM s""")
def randomisation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "events").select("event_id", "value", F.lit(250.0).alias("other"))
    return sampling.approximate_randomisation(pairs, "event_id", "value", "other", 100).withColumn("p", F.round("p", 6))


def _separable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "CAST(doc_id % 2 AS INT) AS label", "doc_id DIV 2 AS pair", "doc_id % 2 + (doc_id % 10) / 100 AS x",
        "concat('some words of ', source, CASE WHEN doc_id % 2 = 1 THEN ' awful' ELSE ' nice' END) AS said",
    )


@query("SELECT CAST(1.0 AS DOUBLE) AS accuracy, CAST(0.0 AS DOUBLE) AS error")
def pairs_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear SVM on two classes that one feature tells apart, pairs kept together."""
    from threadlens.operators import ml

    return spark.createDataFrame([ml.leave_pairs_out(_separable(spark, sf_dir), ["x"], "label", "pair", folds=2, iterations=10)[:2]], "accuracy double, error double")


@query("SELECT CAST(1.0 AS DOUBLE) AS accuracy, CAST(1.0 AS DOUBLE) AS auc, CAST(greatest(avg(doc_id % 2), 1 - avg(doc_id % 2)) AS DOUBLE) AS baseline FROM documents")
def text_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bag-of-words model on texts that one word tells apart."""
    from threadlens.operators import ml

    rows = _separable(spark, sf_dir)
    q = ml.quality(ml.text_classifier(rows, "said", "label"), rows, "label")
    return spark.createDataFrame([(q["accuracy"], q["auc"], q["baseline"])], "accuracy double, auc double, baseline double")


@query("SELECT CAST(0.01 AS DOUBLE) AS best, CAST(1.0 AS DOUBLE) AS accuracy")
def regularisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two regularisations, of which one is far too strong for any but the more frequent class."""
    from threadlens.operators import ml

    best, accuracy = ml.grid_search(_separable(spark, sf_dir), ["x"], "label", "pair", [0.01, 1e6], folds=2)
    return spark.createDataFrame([(best, accuracy[best])], "best double, accuracy double")


_LABELLED = "SELECT d.doc_id, d.source, coalesce(d.text, '') AS text, l.toxic FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic IS NOT NULL"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with features of their texts."""
    labels = table(spark, sf_dir, "labels").where("toxic IS NOT NULL").select("doc_id", "toxic")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")).join(labels, "doc_id")
    words = F.size(F.split("text", " "))
    return docs.withColumns({"length": F.length("text").cast("double"), "words": words.cast("double"), "questions": (F.length("text") - F.length(F.replace("text", F.lit("?"), F.lit("")))).cast("double")})


_FOLDS = f"""l AS ({_LABELLED}), f AS (SELECT *, CAST('0x' || substr(md5(source), 1, 8) AS BIGINT) % 5 AS fold FROM l),
    p AS (SELECT fold, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS positives FROM f GROUP BY 1), e AS (SELECT sum(n) AS all_n, sum(positives) AS up FROM p),
    r AS (SELECT fold, n, positives, up - positives > 0 AND up - positives < all_n - n AS trained, round(CASE WHEN 2 * (up - positives) >= all_n - n THEN positives ELSE n - positives END / n, 6) AS baseline FROM p, e)"""


@query(f"WITH {_FOLDS} SELECT * FROM r")
def label_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of labelled documents, a source in one: their rows, classes, and the accuracy of the more frequent class."""
    from threadlens.operators import ml

    return ml.fold_counts(_labelled(spark, sf_dir), "toxic", "source").withColumn("baseline", F.round("baseline", 6))


@query(f"WITH {_FOLDS} SELECT CAST(coalesce(sum(n) FILTER (trained), 0) AS BIGINT) AS tested, CAST(coalesce(sum(n) FILTER (NOT trained), 0) AS BIGINT) AS skipped, true AS sound FROM r")
def toxic_sources_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear SVM over features of the texts, sources left out in turn: rows tested and skipped, and whether its accuracy is a share."""
    from threadlens.operators import ml

    left = ml.leave_pairs_out(_labelled(spark, sf_dir), ["length", "words", "questions"], "toxic", "source", iterations=10)
    return spark.createDataFrame([(left.tested, left.skipped, 0.0 <= left.accuracy <= 1.0)], "tested bigint, skipped bigint, sound boolean")


_RANKS = "avg(rank) OVER (PARTITION BY {0}) FROM (SELECT *, row_number() OVER (ORDER BY {0}) AS rank FROM {1})"


@query(f"""WITH g AS (SELECT event_type, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM events GROUP BY 1),
    f AS (SELECT sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b, count(*) AS k FROM g),
    d AS (SELECT value - 250 AS d, abs(value - 250) AS size FROM events WHERE value <> 250),
    w AS (SELECT d, size, {_RANKS.format('size', 'd').replace('avg(rank) OVER (PARTITION BY size)', 'avg(rank) OVER (PARTITION BY size) AS r')}),
    ties AS (SELECT sum(c * c * c - c) AS t FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM d GROUP BY size)),
    u AS (SELECT event_type, {_RANKS.format('value', 'events').replace('avg(rank) OVER (PARTITION BY value)', 'avg(rank) OVER (PARTITION BY value) AS r')}),
    m AS (SELECT CAST(count(*) FILTER (event_type = 'click') AS DOUBLE) AS a, CAST(count(*) AS DOUBLE) AS n, sum(r) FILTER (event_type = 'click') AS ranks FROM u),
    b AS (SELECT CAST(count(*) FILTER (user_id % 2 = 0) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM events),
    o AS (SELECT lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5) AS l, lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + n * ln(0.5) AS seen FROM (SELECT k, n, unnest(range(CAST(n AS BIGINT) + 1)) AS i FROM b))
    SELECT 'f' AS test, round(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 5) AS value FROM f
    UNION ALL SELECT 'signed rank', round((sum(r) FILTER (d > 0) - count(*) * (count(*) + 1) / 4) / sqrt(CAST(count(*) AS DOUBLE) * (count(*) + 1) * (2 * count(*) + 1) / 24 - any_value(t) / 48), 5) FROM w, ties
    UNION ALL SELECT 'rank sum', round((ranks - a * (a + 1) / 2 - a * (n - a) / 2) / sqrt(a * (n - a) * (n + 1) / 12), 5) FROM m
    UNION ALL SELECT 'binomial', round(least(1, sum(exp(l)) FILTER (l <= seen + 1e-7)), 5) FROM o""")
def significance_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis of variance, Wilcoxon's, Mann and Whitney's and the binomial test, over all events."""
    e = table(spark, sf_dir, "events").select("event_type", "user_id", "value", F.lit(250.0).alias("other"), (F.col("event_type") == "click").alias("click"))
    n = e.agg(F.count(F.when(F.col("user_id") % 2 == 0, 1)), F.count(F.lit(1))).first()
    found = [
        ("f", stats.f_statistic(e, "event_type", "value")), ("signed rank", stats.signed_rank_z(e, "value", "other")),
        ("rank sum", stats.rank_sum_z(e, "click", "value")), ("binomial", stats.binomial_p(n[0], n[1])),
    ]
    return spark.createDataFrame([(name, round(x, 5)) for name, x in found], "test string, value double")


@query(ORACLES["bootstrap_means"].replace("SELECT CAST(rep AS BIGINT) AS rep, round(sum(k * value) / sum(k), 6) AS mean FROM k GROUP BY 1", "m AS (SELECT sum(k * value) / sum(k) AS mean FROM k GROUP BY rep) SELECT round(avg(mean), 5) AS mean, round(avg(mean) - 2.2621571627409915 * stddev_samp(mean) / sqrt(10), 5) AS low, round(avg(mean) + 2.2621571627409915 * stddev_samp(mean) / sqrt(10), 5) AS high FROM m").replace("AS k FROM r)", "AS k FROM r),", 1))
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and confidence interval of the values of all events, from ten resamples."""
    mean, low, high = sampling.bootstrap_interval(sampling.bootstrap_means(table(spark, sf_dir, "events"), "event_id", "value", 10))
    return spark.createDataFrame([tuple(round(x, 5) for x in (mean, low, high))], "mean double, low double, high double")
