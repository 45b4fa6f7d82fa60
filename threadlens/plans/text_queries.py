"""Text functions, threads, edits, annotator agreement and coordination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlens.functions import text as t
from threadlens.functions.time import nearest_second
from threadlens.operators import agreement, conversations, coordination, features, pov, reconstruct, scoring, snapshot, tree, trends
from threadlens.plans.registry import query
from threadlens.sources.views import COMMENTS, comments, table

MARKERS = {"article": ["the", "a"], "preposition": ["of", "on", "with"], "conjunction": ["and", "or"]}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
sql_q = lambda s: s.replace("'", "''")
TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9'']+'), lambda x: x <> '')"
SENTENCES = "list_filter(list_transform(string_split(regexp_replace({}, '([!?.\\n]+)', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(replace(x, chr(10), ' '))), lambda x: x <> '')"

# --- cleaning ---


@query(rf"""SELECT page_id, md5(coalesce(array_to_string(list_transform(list_filter(list_transform(string_split(regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g'), chr(10)),
    lambda x: trim(x)), lambda x: x <> ''), lambda x: x || chr(10)), ''), '')) AS clean FROM pages""")
def clean_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(t.clean_html(F.col("html"))).alias("clean"))


@query("SELECT page_id, md5(regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g')) AS plain FROM pages")
def html_tag_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(t.strip_tags(F.coalesce("html", F.lit("")))).alias("plain"))


WIKI = "'== Topic ' || conv_id || ' ==' || chr(10) || ':' || '[[User:U' || turn || '|talk]] ''''bold'''' {{tpl|x}} ' || text || ' -- 12:3' || (turn % 10) || ', 7 March 2015 (UTC)' || ' :x'"
WIKI_SPARK = "concat('== Topic ', conv_id, ' ==', chr(10), ':', '[[User:U', turn, '|talk]] ''''bold'''' {{tpl|x}} ', text, ' -- 12:3', turn % 10, ', 7 March 2015 (UTC)', ' :x')"


def _wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{WIKI_SPARK} AS raw")


def _re(pattern: str, of: str, by: str = "") -> str:
    return f"regexp_replace({of}, '{sql_q(pattern)}', '{by}', 'g')"


_strip = lambda x: _re("==+", _re("'''?", _re(r"\[[a-z]+://[^\]]*\]", _re(r"\[[a-z]+://[^ \]]* ([^\]]*)\]", _re(r"\[\[([^\[\]]*)\]\]", _re(r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", _re(r"\{\{[^{}]*\}\}", _re(r"\{\{[^{}]*\}\}", x)), r"\1"), r"\1"), r"\1"))))


def _all(rules: list[tuple[str, str]], of: str) -> str:
    for pattern, by in rules:
        of = _re(pattern, of, by)
    return of


_comment = lambda x: _all(t.AFTER_STRIP, _re("<[^>]*>", _strip(_all(t.BEFORE_STRIP, _re(t.DATE, x)))))


@query(f"SELECT conv_id, turn, {_comment(WIKI)} AS clean FROM conversations")
def clean_wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wiki(spark, sf_dir).select("conv_id", "turn", t.clean_comment(F.col("raw")).alias("clean"))


@query(f"SELECT conv_id, turn, {_re(t.DATE, WIKI)} AS clean FROM conversations")
def remove_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wiki(spark, sf_dir).select("conv_id", "turn", t.remove_dates(F.col("raw")).alias("clean"))


@query(f"SELECT conv_id, turn, {_re(' :', _re('--', WIKI), ' ')} AS clean FROM conversations")
def clean_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wiki(spark, sf_dir).select("conv_id", "turn", t.clean_action(F.col("raw")).alias("clean"))


@query(r"""WITH l AS (SELECT conv_id, turn, trim(CASE WHEN turn % 3 = 0 THEN '== ' || role || ' ==' WHEN turn % 3 = 1 THEN '=== ' || role || ' ==' ELSE role END) AS line FROM conversations)
    SELECT conv_id, turn, length(regexp_extract(line, '^(=+)', 1)) > 0 AND length(regexp_extract(line, '^(=+)', 1)) = length(regexp_extract(line, '(=+)$', 1)) AS heading,
           CAST(length(regexp_extract(line, '^(=+)', 1)) AS BIGINT) AS depth FROM l""")
def heading_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("CASE WHEN turn % 3 = 0 THEN concat('== ', role, ' ==') WHEN turn % 3 = 1 THEN concat('=== ', role, ' ==') ELSE role END")
    rows = table(spark, sf_dir, "conversations").withColumn("line", line)
    return rows.select("conv_id", "turn", t.is_heading(F.col("line")).alias("heading"), F.length(F.regexp_extract(F.trim("line"), "^(=+)", 1)).cast("long").alias("depth"))


@query(r"""WITH l AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN '== t ==' ELSE chr(10) || repeat(':', CAST(turn AS INT)) || text END AS raw FROM conversations),
    f AS (SELECT conv_id, turn, coalesce(list_filter(string_split(raw, chr(10)), lambda x: trim(x) <> '')[1], '') AS line FROM l)
    SELECT conv_id, turn, CAST(CASE WHEN length(regexp_extract(trim(line), '^(=+)', 1)) > 0 AND length(regexp_extract(trim(line), '^(=+)', 1)) = length(regexp_extract(trim(line), '(=+)$', 1))
        THEN -1 ELSE length(regexp_extract(line, '^([:*]*)', 1)) END AS BIGINT) AS indentation FROM f""")
def indentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE WHEN turn = 0 THEN '== t ==' ELSE concat(chr(10), repeat(':', CAST(turn AS INT)), text) END")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.indentation(raw).cast("long").alias("indentation"))


DIFF = "'<tr><td class=\"diff-context\">old</td><td class=\"diff-addedline\"><div>' || text || ' == h ==</div></td></tr><td class=\"diff-addedline\">' || role || '</td>'"
DIFF_SPARK = DIFF.replace("' || text || '", "', text, '").replace("' || role || '", "', role, '")


@query(f"""SELECT conv_id, turn, substr({_re(t.DATE, "trim(" + _re('==+', _re('<[^>]*>', "array_to_string(regexp_extract_all(" + DIFF + ", '<td class=\"diff-addedline\">(.*?)</td>', 1), chr(10))")) + ")")}, 1, 2800) AS added
    FROM conversations""")
def diff_added_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.diff_added_text(F.expr(f"concat({DIFF_SPARK})")).alias("added"))


FLAG_SQL = "CASE " + " ".join(f"WHEN regexp_matches(text, '{sql_q(p)}') THEN '{n}'" for n, p in scoring.FLAGGED.items()) + " END"


@query(f"""WITH {DOCS} SELECT doc_id, {FLAG_SQL} AS pii, coalesce(toxic >= 0.5, false) AS toxic FROM d LEFT JOIN labels USING (doc_id)
    WHERE {FLAG_SQL} IS NOT NULL OR coalesce(toxic >= 0.5, false)""")
def pii_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("score"))
    return scoring.flagged(_docs(spark, sf_dir).join(labels, "doc_id", "left"), "text", F.col("score")).select("doc_id", "pii", "toxic")


@query(f"SELECT conv_id, turn, ((starts_with(lower(text), 'sure ') OR starts_with(lower(text), 'true ')) AND NOT contains(text, '?')) OR regexp_matches(lower(text), '{sql_q(t.whole(t.AGREE))}') AS agrees, regexp_matches(lower(text), '{sql_q(t.whole(t.DISAGREE))}') AS disagrees FROM conversations")
def agreement_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.agrees(F.col("text")).alias("agrees"), t.disagrees(F.col("text")).alias("disagrees"))


_has = lambda words: f"list_has_any({TOKENS.format('text')}, [" + ", ".join(f"'{w}'" for w in words) + "])"
_starts = lambda p: f"len(list_filter({SENTENCES.format('text')}, lambda x: regexp_matches(lower(x), '{sql_q(p)}'))) > 0"


@query(rf"""SELECT conv_id, turn, {_has(t.THANKS)} AS has_thank, {_has(t.GREETINGS)} AS has_greeting, regexp_matches(text, '[?!][?!]') AS has_marks,
    {_starts("^(do|don't) ")} AS do_start, {_starts('^you ')} AS you_start, len(list_filter(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_matches(x, '^[A-Z][A-Z]+$'))) > 0 AS all_caps, contains(text, '?') AS is_question FROM conversations""")
def lexical_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *[c.alias(n) for n, c in t.cues(F.col("text")).items()])


_among = lambda words, of: f"list_filter(regexp_split_to_array(lower({of}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x IN (" + ", ".join(f"'{w}'" for w in words) + "))"
_count = lambda words, of: f"CAST(len({_among(words, of)}) AS BIGINT)"


@query(f"WITH {DOCS} SELECT doc_id, " + ", ".join(f"{_count(w, 'text')} AS {n}" for n, w in MARKERS.items()) + " FROM d")
def lexicon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", *[t.lexicon_count(F.col("text"), w).alias(n) for n, w in MARKERS.items()])


@query(f"WITH {DOCS} SELECT doc_id, CAST(len({SENTENCES.format('text')}) AS BIGINT) AS n, md5(array_to_string({SENTENCES.format('text')}, '|')) AS cut FROM d")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t.sentences(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|")).alias("cut"))


# --- edits: consecutive documents as revisions of one page ---

PAIRS = f"""{DOCS}, p AS (SELECT doc_id, text, lag(text) OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) AS former FROM d),
c AS (SELECT doc_id, {SENTENCES.format('text')} AS now, {SENTENCES.format('former')} AS was FROM p WHERE former IS NOT NULL)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumn("page", F.floor(F.col("doc_id") / 8))
    return pov.with_former(docs, "page", ["doc_id"], "text").where("former IS NOT NULL")


@query(f"""WITH {PAIRS}, e AS (SELECT doc_id, list_distinct(list_filter(now, lambda x: NOT list_contains(was, x))) AS i,
    list_distinct(list_filter(was, lambda x: NOT list_contains(now, x))) AS d, list_distinct(list_filter(was, lambda x: list_contains(now, x))) AS k FROM c)
    SELECT doc_id, CAST(len(i) AS BIGINT) AS n_inserts, CAST(len(d) AS BIGINT) AS n_deletes, CAST(len(k) AS BIGINT) AS n_kept,
    md5(array_to_string(list_sort(i), '|')) AS inserts FROM e""")
def sentence_diff_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = pov.sentence_changes(_pairs(spark, sf_dir), "doc_id", "text")
    n = lambda x: F.size(x).cast("long").alias(f"n_{x}")
    return c.select("doc_id", n("inserts"), n("deletes"), n("kept"), F.md5(F.array_join(F.array_sort("inserts"), "|")).alias("inserts"))


@query(f"""WITH {COMMENTS}, a AS (SELECT conversation_id, turn, content, list_distinct({TOKENS.format('content')}) AS t, {TOKENS.format('content')} AS w FROM comments)
    SELECT x.conversation_id, x.turn AS old_turn, y.turn AS new_turn FROM a x JOIN a y ON x.conversation_id = y.conversation_id AND x.turn < y.turn
    WHERE x.turn = y.turn - 1 AND x.content <> y.content AND len(x.w) >= 3 AND len(list_intersect(x.t, y.t)) / greatest(len(x.t), 1) >= 0.1 AND len(list_intersect(x.t, y.t)) / greatest(len(y.t), 1) >= 0.1""")
def fuzzy_sentence_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments that are much like the one before them; ``revised_sentences`` holds sentences to the reference bound."""
    c = comments(spark, sf_dir).select("conversation_id", "turn", "content")
    pairs = pov.with_former(c, "conversation_id", ["turn"], "content").where("former IS NOT NULL")
    return pairs.where(t.fuzzy_match(F.col("former"), F.col("content"), least=0.1)).select("conversation_id", (F.col("turn") - 1).alias("old_turn"), F.col("turn").alias("new_turn"))


@query("""WITH c AS (SELECT doc_id, doc_id // 50 AS page, doc_id % 7 = 0 AS changed FROM documents),
    w AS (SELECT *, max(CAST(changed AS INT)) OVER (PARTITION BY page ORDER BY doc_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM c) SELECT page, doc_id FROM w WHERE near = 1 AND NOT changed""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 50).alias("page"), "doc_id", (F.col("doc_id") % 7 == 0).alias("changed"))
    return pov.context(rows, "page", "doc_id", "changed").select("page", "doc_id")


@query(f"""WITH {DOCS}, n AS (SELECT doc_id // 8 AS page, doc_id, row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) AS n, text FROM d),
    s AS (SELECT page, doc_id, n, unnest(list_distinct({SENTENCES.format('text')})) AS sentence FROM n),
    r AS (SELECT *, n - row_number() OVER (PARTITION BY page, sentence ORDER BY n) AS run FROM s)
    SELECT page, md5(sentence) AS sentence, min(doc_id) AS first_rev, max(doc_id) AS last_rev FROM r GROUP BY page, sentence, run HAVING count(*) > 1""")
def sentence_blame(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumn("page", F.floor(F.col("doc_id") / 8))
    origin = pov.sentence_origin(docs, "page", "doc_id", "text").where("last_rev > first_rev")
    return origin.select("page", F.md5("sentence").alias("sentence"), "first_rev", "last_rev")


# --- n-grams and words ---


@query(f"""WITH {DOCS}, w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9'']+'), lambda x: x <> '') AS t FROM d),
    g AS (SELECT doc_id, unnest(t) AS ngram FROM w UNION SELECT doc_id, unnest(list_transform(list_zip(t[:-2], t[2:]), lambda x: x[1] || ' ' || x[2])) FROM w WHERE len(t) > 1)
    SELECT ngram, count(DISTINCT doc_id) AS df FROM g GROUP BY 1 HAVING count(DISTINCT doc_id) > 40""")
def ngram_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumnRenamed("doc_id", "conversation_id")
    return features.ngram_document_frequency(docs, t.tokens(F.col("text")), 40)


STOP = "[" + ", ".join(f"'{w}'" for w in features.STOPWORDS) + "]"


@query(f"WITH {DOCS} SELECT doc_id, CAST(len(list_intersect(list_distinct({TOKENS.format('text')}), {STOP})) AS BIGINT) AS n_stop FROM d")
def stopword_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.size(F.array_intersect(t.tokens(F.col("text")), F.array(*map(F.lit, features.STOPWORDS)))).cast("long").alias("n_stop"))


@query(f"""WITH {COMMENTS}, w AS (SELECT conversation_id, user_text, ts, id, unnest(list_distinct({TOKENS.format('content')})) AS word FROM comments),
    f AS (SELECT conversation_id, word, arg_min(user_text, (ts, id, user_text)) AS user_text, count(DISTINCT user_text) AS n FROM w GROUP BY 1, 2)
    SELECT conversation_id, user_text, count(*) AS introduced, count(*) FILTER (n > 1) AS adopted FROM f GROUP BY 1, 2""")
def word_adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.word_adoption(comments(spark, sf_dir), t.tokens(F.col("content")))


# --- threads ---


@query(rf"""WITH {COMMENTS}, m AS (SELECT *, CASE WHEN lag(user_text) OVER w IS NOT DISTINCT FROM user_text AND lag(id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS new FROM comments WINDOW w AS (PARTITION BY conversation_id ORDER BY ts, id)),
    n AS (SELECT *, sum(new) OVER (PARTITION BY conversation_id ORDER BY ts, id) - 1 AS turn_no FROM m),
    t AS (SELECT conversation_id, turn_no, min(user_text) AS user_text, count(*) AS n_messages, min(ts) AS start, max(ts) AS "end",
          CAST(sum(len(regexp_split_to_array(trim(content), '\s+'))) AS BIGINT) AS words FROM n GROUP BY 1, 2)
    SELECT conversation_id, CAST(turn_no AS BIGINT) AS turn_no, user_text, n_messages, words,
           coalesce(CAST(epoch(start)::BIGINT - epoch(lag("end") OVER (PARTITION BY conversation_id ORDER BY turn_no))::BIGINT AS BIGINT), -1) AS gap FROM t""")
def turns_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.turns(comments(spark, sf_dir)).drop("start", "end").fillna(-1, ["gap"])


@query(f"""WITH {COMMENTS} SELECT c.id, coalesce(CAST(epoch(c.ts)::BIGINT - epoch(max(p.ts))::BIGINT AS BIGINT), -1) AS gap FROM comments c LEFT JOIN comments p
    ON p.conversation_id = c.conversation_id AND p.user_text = c.user_text AND p.ts < c.ts GROUP BY c.id, c.ts""")
def last_self_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.own_previous(comments(spark, sf_dir), ["ts"])
    return rows.select("id", F.coalesce(nearest_second(F.col("ts")) - nearest_second(F.col("prev_ts")), F.lit(-1)).alias("gap"))


@query(f"WITH {COMMENTS} SELECT r.id, r.user_text, p.user_text AS to_user_text FROM comments r JOIN comments p ON r.reply_to = p.id")
def reply_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.reply_pairs(comments(spark, sf_dir), ["user_text"]).select("id", "user_text", "to_user_text")


@query(f"""WITH {COMMENTS}, p AS (SELECT DISTINCT r.conversation_id, r.user_text AS a, p.user_text AS b FROM comments r JOIN comments p ON r.reply_to = p.id WHERE r.user_text <> p.user_text),
    m AS (SELECT p.*, EXISTS (SELECT 1 FROM p q WHERE q.conversation_id = p.conversation_id AND q.a = p.b AND q.b = p.a) AS mutual FROM p),
    g AS (SELECT conversation_id, count(*) AS pairs, count(*) FILTER (mutual) AS mutual FROM m GROUP BY 1),
    u AS (SELECT conversation_id, count(DISTINCT user_text) AS users FROM comments GROUP BY 1)
    SELECT conversation_id, users, coalesce(pairs, 0) AS pairs, round(coalesce(pairs, 0) / (users * users), 6) AS density,
           round(CASE WHEN pairs > 0 THEN mutual / pairs ELSE 0.0 END, 6) AS reciprocity FROM u LEFT JOIN g USING (conversation_id)""")
def reciprocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.network(comments(spark, sf_dir))


@query(f"WITH {COMMENTS} SELECT id, conversation_id, conversation_id || '.0.0' AS root, CAST(turn AS BIGINT) AS depth FROM comments")
def reply_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.depths(comments(spark, sf_dir)).withColumn("depth", F.col("depth").cast("long"))


@query(f"WITH {COMMENTS} SELECT conversation_id, arg_max(id, turn) AS id, CAST(max(turn) AS BIGINT) AS depth FROM comments GROUP BY 1")
def deepest_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.deepest(comments(spark, sf_dir)).withColumn("depth", F.col("depth").cast("long"))


TREE = "SELECT conv_id || '.' || turn || '.' || turn AS id, conv_id AS conversation_id, turn, CASE WHEN turn > 0 THEN conv_id || '.' || ((turn - 1) // 2) || '.' || ((turn - 1) // 2) END AS reply_to FROM conversations"


@query(f"""WITH RECURSIVE e AS ({TREE}), w AS (SELECT id, conversation_id, [turn] AS path, 0 AS depth FROM e WHERE reply_to IS NULL
    UNION ALL SELECT e.id, e.conversation_id, list_append(w.path, e.turn), w.depth + 1 FROM e JOIN w ON e.reply_to = w.id)
    SELECT id, conversation_id, CAST(depth AS BIGINT) AS depth, row_number() OVER (PARTITION BY conversation_id ORDER BY path) - 1 AS dfs_index,
    row_number() OVER (PARTITION BY conversation_id ORDER BY path) = count(*) OVER (PARTITION BY conversation_id) AS is_final FROM w""")
def dfs_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = comments(spark, sf_dir).withColumn("reply_to", F.expr("CASE WHEN turn > 0 THEN concat(conversation_id, '.', (turn - 1) DIV 2, '.', (turn - 1) DIV 2) END"))
    return conversations.dfs_order(rows).withColumn("depth", F.col("depth").cast("long"))


@query(rf"""WITH {COMMENTS}, b AS (SELECT conversation_id, user_text, count(*) AS utterances, CAST(sum(len(regexp_split_to_array(trim(content), '\s+'))) AS BIGINT) AS words FROM comments GROUP BY 1, 2),
    s AS (SELECT *, round(utterances / sum(utterances) OVER (PARTITION BY conversation_id), 6) AS share FROM b),
    p AS (SELECT r.conversation_id, r.user_text, p.user_text AS to_user, r.reply_to, CAST(epoch(r.ts)::BIGINT - epoch(p.ts)::BIGINT AS BIGINT) AS s FROM comments r JOIN comments p ON r.reply_to = p.id),
    x AS (SELECT conversation_id, to_user AS user_text, count(DISTINCT reply_to) AS replied FROM p GROUP BY 1, 2),
    g AS (SELECT conversation_id, user_text, CAST(sum(s) AS BIGINT) AS reply_seconds, max(s) AS longest_gap FROM p GROUP BY 1, 2)
    SELECT conversation_id, user_text, utterances, words, share, coalesce(replied, 0) AS replied, coalesce(reply_seconds, -1) AS reply_seconds, coalesce(longest_gap, -1) AS longest_gap
    FROM s LEFT JOIN x USING (conversation_id, user_text) LEFT JOIN g USING (conversation_id, user_text)""")
def participant_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.participants(comments(spark, sf_dir)).fillna(-1, ["reply_seconds", "longest_gap"])


@query(f"""WITH {COMMENTS}, a AS (SELECT conversation_id, max(CASE WHEN user_text = 'user' AND contains(content, '?') THEN 1 ELSE 0 END) AS a,
    max(CASE WHEN user_text <> 'user' AND contains(content, '?') THEN 1 ELSE 0 END) AS b FROM comments GROUP BY 1)
    SELECT conversation_id, CASE WHEN a = 1 AND b = 1 THEN 'Both' WHEN a = 1 THEN 'Attacker' WHEN b = 1 THEN 'Non-Attacker' ELSE 'None' END AS asked_by FROM a""")
def question_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = comments(spark, sf_dir)
    return conversations.question_profile(rows, rows.where("user_text = 'user'"))


@query(f"""WITH {COMMENTS} SELECT count(*) AS n FROM (SELECT conversation_id FROM comments WHERE type IN ('ADDITION', 'CREATION') GROUP BY 1 HAVING count(DISTINCT user_text) > 1)""")
def multi_participant(spark: SparkSession, sf_dir: str) -> DataFrame:
    several = comments(spark, sf_dir).where("type IN ('ADDITION', 'CREATION')").groupBy("conversation_id").agg(F.countDistinct("user_text").alias("n")).where("n > 1")
    return several.agg(F.count(F.lit(1)).alias("n"))


ACTIONS = "CASE WHEN turn % 5 = 3 THEN 'DELETION' WHEN turn % 5 = 4 THEN 'RESTORATION' WHEN turn % 5 = 2 THEN 'MODIFICATION' WHEN turn = 0 THEN 'CREATION' ELSE 'ADDITION' END"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = "CASE WHEN turn % 5 >= 2 THEN concat(conversation_id, '.', turn - (turn % 5) + 1, '.', turn - (turn % 5) + 1) END"
    return comments(spark, sf_dir).withColumns({"type": F.expr(ACTIONS), "parent_id": F.expr(parent)})


@query(f"""WITH {COMMENTS}, a AS (SELECT id, conversation_id, ts, turn, {ACTIONS} AS type,
        CASE WHEN turn % 5 >= 2 THEN conversation_id || '.' || (turn - (turn % 5) + 1) || '.' || (turn - (turn % 5) + 1) END AS parent_id FROM comments),
    e AS (SELECT parent_id, arg_max(type, (ts, id)) AS type, arg_max(id, (ts, id)) AS eid FROM a WHERE type IN ('DELETION', 'MODIFICATION', 'RESTORATION') GROUP BY 1)
    SELECT a.id, a.conversation_id, coalesce(e.type = 'RESTORATION', true) AS present,
        CASE WHEN coalesce(e.type = 'RESTORATION', true) THEN a.id WHEN e.type = 'MODIFICATION' THEN e.eid END AS latest
    FROM a LEFT JOIN e ON a.id = e.parent_id WHERE a.type NOT IN ('DELETION', 'RESTORATION')""")
def live_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.live_tree(_log(spark, sf_dir))


@query(f"""WITH {COMMENTS}, a AS (SELECT id, conversation_id, turn, {ACTIONS} AS type, count(*) OVER (PARTITION BY conversation_id) AS n FROM comments),
    c AS (SELECT *, CASE turn WHEN 1 THEN n <= 2 OR n >= 5 WHEN 6 THEN n <= 7 ELSE true END AS present,
        CASE WHEN turn = 1 AND n = 3 THEN 2 WHEN turn = 1 AND n = 4 THEN NULL WHEN turn = 6 AND n = 8 THEN 7 ELSE turn END AS version,
        CASE turn WHEN 1 THEN 0 WHEN 2 THEN CASE WHEN n >= 5 THEN 1 ELSE 0 END WHEN 5 THEN 2 WHEN 6 THEN 5 WHEN 7 THEN 5 END AS up,
        CASE turn WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN CASE WHEN n >= 5 THEN 2 ELSE 1 END WHEN 5 THEN 3 ELSE 4 END AS depth FROM a WHERE type NOT IN ('DELETION', 'RESTORATION')),
    p AS (SELECT *, CASE WHEN present THEN row_number() OVER (PARTITION BY conversation_id, present ORDER BY turn) - 1 END AS place, count(*) FILTER (present) OVER (PARTITION BY conversation_id) AS m FROM c)
    SELECT id, conversation_id, present, conversation_id || '.' || version || '.' || version AS latest, CASE WHEN present THEN conversation_id || '.' || up || '.' || up END AS parent,
        turn = 0 AS is_root, CASE WHEN present THEN CAST(depth AS BIGINT) END AS depth, place AS dfs_index, coalesce(place = m - 1, false) AS is_final,
        turn = max(turn) OVER (PARTITION BY conversation_id) AS is_latest FROM p""")
def comment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.comment_tree(_log(spark, sf_dir)).withColumn("depth", F.col("depth").cast("long"))


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(ltrim(regexp_replace(coalesce({}, ''), '[\t\n\r]', ' ', 'g')), '^[:*]+', '', 'g'), '\[(REPLYTO|MENTION|OUTDENT): [^\]]*\]', '', 'g'), '\[(EXTERNAL_LINK|WIKI_LINK): ', '', 'g')"


@query(f"""WITH {COMMENTS}, a AS (SELECT *, count(*) OVER (PARTITION BY conversation_id) AS n, turn % 5 AS k, turn - turn % 5 AS b FROM comments),
    c AS (SELECT a.*, m.content AS new_content, m.user_text AS new_user FROM a LEFT JOIN comments m ON a.k = 1 AND m.conversation_id = a.conversation_id AND m.turn = a.b + 2 WHERE a.k < 2)
    SELECT CAST(conversation_id AS VARCHAR) AS conversation_id, id, {_CLEAN.format("coalesce(new_content, content)")} AS content, coalesce(new_user, user_text) AS user_text, reply_to,
        CASE WHEN k = 0 OR n <= b + 2 THEN 'added' WHEN n = b + 3 THEN 'changed' WHEN n = b + 4 THEN 'removed' ELSE 'restored' END AS status,
        array_to_string(list_transform(range(turn, CASE WHEN k = 0 THEN turn + 1 ELSE least(n, b + 5) END), lambda t: conversation_id || '.' || t || '.' || t), ',') AS versions,
        CAST(CASE turn WHEN 0 THEN -1 WHEN 1 THEN 0 WHEN 5 THEN 1 ELSE 2 END AS BIGINT) AS relative_replyTo FROM c""")
def snapshot_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = snapshot.snapshots(_log(spark, sf_dir)).drop("ts")
    return out.withColumns({"versions": F.array_join("versions", ","), "relative_replyTo": F.col("relative_replyTo").cast("long")})


@query(rf"""WITH {COMMENTS}, l AS (SELECT *, max(ts) OVER (PARTITION BY conversation_id) AS last FROM comments),
    r AS (SELECT conversation_id, ts, id, len({TOKENS.format('content')}) AS n, contains(content, '?') AS q, (turn * 37 % 100) / 100 AS toxicity FROM l WHERE ts < last)
    SELECT conversation_id, count(*) AS no_comments, CAST(max(n) AS BIGINT) AS max_len, CAST(min(n) AS BIGINT) AS min_len, round(avg(n), 6) AS avg_len, round(max(toxicity), 6) AS max_toxicity, max(q) AS is_question FROM r GROUP BY 1""")
def conversation_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = comments(spark, sf_dir).withColumn("toxicity", (F.col("turn") * 37 % 100) / 100)
    f = features.conversation_features(rows)
    r = lambda c: F.round(c, 6).alias(c)
    return f.select("conversation_id", "no_comments", F.col("max_len").cast("long").alias("max_len"), F.col("min_len").cast("long").alias("min_len"), r("avg_len"), r("max_toxicity"), "is_question")


# --- agreement ---

LABELS = "l AS (SELECT doc_id % 97 AS unit, doc_id, CASE WHEN doc_id % 11 = 0 THEN -1 ELSE toxic END AS label, quality FROM labels)"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").selectExpr("doc_id % 97 AS unit", "doc_id", "CASE WHEN doc_id % 11 = 0 THEN -1 ELSE toxic END AS label", "quality")


@query(f"WITH {LABELS} SELECT unit, count(*) AS n, round(avg(label), 6) AS mean, avg(label) >= 0.5 AS positive FROM l WHERE label >= 0 GROUP BY 1")
def label_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.majority(_labels(spark, sf_dir), "unit", "label").withColumn("mean", F.round("mean", 6))


@query(f"""WITH {LABELS}, c AS (SELECT unit, count(*) FILTER (label = -1) AS unsure, count(*) FILTER (label = 0) AS no, count(*) FILTER (label = 1) AS yes FROM l GROUP BY 1)
    SELECT unit, unsure, no, yes, round((2 * yes - no) / nullif(yes + no, 0), 6) AS opinion FROM c""")
def weighted_likert(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = F.col("label")
    c = agreement.label_counts(_labels(spark, sf_dir), "unit", {"unsure": l == -1, "no": l == 0, "yes": l == 1})
    return c.withColumn("opinion", F.round(agreement.weighted_opinion(c, {"yes": 2, "no": -1}), 6))


@query(f"WITH {LABELS}, n AS (SELECT unit, label, count(*) AS n FROM l GROUP BY 1, 2) SELECT unit, round(sum(n * n) / (sum(n) * sum(n)), 6) AS agreement FROM n GROUP BY 1")
def pair_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.pairwise_agreement(_labels(spark, sf_dir), "unit", "label").withColumn("agreement", F.round("agreement", 6))


@query(f"""WITH {LABELS}, r AS (SELECT *, count(*) OVER (PARTITION BY unit) AS m FROM l),
    o AS (SELECT a.label AS c, b.label AS k, sum(1.0 / (a.m - 1)) AS o FROM r a JOIN r b ON a.unit = b.unit AND a.doc_id <> b.doc_id WHERE a.m > 1 GROUP BY 1, 2),
    n AS (SELECT c, sum(o) AS n FROM o GROUP BY 1), e AS (SELECT sum(a.n * b.n) FILTER (a.c <> b.c) AS e FROM n a, n b)
    SELECT round(1 - (sum(o) - 1) * sum(o) FILTER (c <> k) / any_value(e), 6) AS alpha FROM o, e""")
def kripp_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.krippendorff_alpha(_labels(spark, sf_dir), "unit", "label").select(F.round("alpha", 6).alias("alpha"))


THRESHOLDS = [0.2, 0.4, 0.6, 0.8]


@query(f"""WITH s AS (SELECT (d.n_chars % 1000) / 1000 AS score, toxic = 1 AS truth FROM labels JOIN documents d USING (doc_id)), t AS (SELECT unnest({THRESHOLDS}) AS threshold)
    SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (score >= threshold) AS predicted, count(*) FILTER (score >= threshold AND truth) AS hits,
    round(count(*) FILTER (score >= threshold AND truth) / nullif(count(*) FILTER (score >= threshold), 0), 6) AS precision,
    round(count(*) FILTER (score >= threshold AND truth) / nullif(count(*) FILTER (truth), 0), 6) AS recall FROM s, t GROUP BY 1""")
def pr_at_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "(n_chars % 1000) / 1000 AS score")
    return agreement.at_thresholds(table(spark, sf_dir, "labels").join(docs, "doc_id"), "score", F.col("toxic") == 1, THRESHOLDS)


# --- coordination ---

_flag = lambda words, of: f"CAST(len({_among(words, of)}) > 0 AS INT)"
FLAGS = f"""{COMMENTS}, pairs AS (SELECT r.conversation_id % 25 || r.user_text AS user_text, r.content, p.content AS answered FROM comments r JOIN comments p ON r.reply_to = p.id),
flags AS (""" + " UNION ALL ".join(f"SELECT user_text, '{m}' AS marker, {_flag(w, 'content')} AS s, {_flag(w, 'answered')} AS t FROM pairs" for m, w in MARKERS.items()) + """),
coord AS (SELECT user_text, marker, CASE WHEN sum(s) >= 3 AND sum(t) > 0 THEN sum(s * t) / sum(t) - sum(s) / count(*) END AS coordination FROM flags GROUP BY 1, 2)"""


def _coordination(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = conversations.reply_pairs(comments(spark, sf_dir), ["content"]).withColumn("user_text", F.concat(F.col("conversation_id") % 25, "user_text"))
    has = lambda c: {m: F.lower(c).rlike(r"\b(" + "|".join(w) + r")\b") for m, w in MARKERS.items()}
    return coordination.coordination(coordination.marker_flags(pairs, has("content"), has("to_content")))


@query(f"WITH {FLAGS} SELECT user_text, marker, round(coordination, 6) AS coordination FROM coord")
def coordination_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coordination(spark, sf_dir).withColumn("coordination", F.round("coordination", 6))


@query(f"""WITH {FLAGS}, f AS (SELECT *, coalesce(coordination, avg(nullif(coordination, 0)) OVER (PARTITION BY marker)) AS filled FROM coord)
    SELECT user_text, round(CASE WHEN count(coordination) = count(*) THEN avg(coordination) END, 6) AS all_present,
    round(CASE WHEN count(coordination) > 0 THEN avg(filled) END, 6) AS filled, round(avg(coordination), 6) AS present FROM f GROUP BY 1""")
def coordination_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return coordination.aggregated(_coordination(spark, sf_dir)).select("user_text", r("all_present"), r("filled"), r("present"))


@query(f"""WITH {COMMENTS}, x AS (SELECT conversation_id, user_text, sum(length(content)) + 0.001 AS x FROM comments GROUP BY 1, 2),
    p AS (SELECT conversation_id, x / sum(x) OVER (PARTITION BY conversation_id) AS p, count(*) OVER (PARTITION BY conversation_id) AS n FROM x)
    SELECT conversation_id, round(1 + sum(CASE WHEN n > 1 THEN p * ln(p) / ln(n) END), 6) AS entropy FROM p GROUP BY 1""")
def entropy_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = comments(spark, sf_dir).select("conversation_id", "user_text", F.length("content").alias("x"))
    return features.user_entropy(values, "x").withColumn("entropy", F.round("entropy", 6))


# --- categories ---


def _categorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "concat(CASE WHEN doc_id % 3 = 0 THEN 'Talk:' WHEN doc_id % 3 = 1 THEN 'User talk:' ELSE 'File:' END, doc_id) AS page_title",
        "CASE WHEN doc_id % 10 = 0 THEN 'DELETION' ELSE 'ADDITION' END AS type", "source AS category1", "lang AS category2", "CAST(NULL AS STRING) AS category3",
        "CASE WHEN doc_id % 2 = 0 THEN concat(lang, '/', source) END AS sub_category1", "CAST(NULL AS STRING) AS sub_category2", "CAST(NULL AS STRING) AS sub_category3",
        "(doc_id * 13 % 100) / 100 AS m_threat", "(doc_id * 29 % 100) / 100 AS m_insult", "(doc_id * 7 % 83) / 83 AS m_obscene",
    )


CATEGORISED = """c AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'Talk:' WHEN doc_id % 3 = 1 THEN 'User talk:' ELSE 'File:' END || doc_id AS page_title,
    CASE WHEN doc_id % 10 = 0 THEN 'DELETION' ELSE 'ADDITION' END AS type, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang || '/' || source END, source) AS a, lang AS b,
    (doc_id * 13 % 100) / 100 AS m_threat, (doc_id * 29 % 100) / 100 AS m_insult, (doc_id * 7 % 83) / 83 AS m_obscene FROM documents)"""


@query(f"""WITH {CATEGORISED}, n AS (SELECT category, count(*) AS n FROM (SELECT page_title, unnest([a, b]) AS category FROM c) WHERE starts_with(page_title, 'Talk:') AND category IS NOT NULL GROUP BY 1),
    r AS (SELECT category, n, row_number() OVER (ORDER BY n DESC, category) AS place FROM n) SELECT category, n, place FROM r WHERE place BETWEEN 2 AND 5""")
def category_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.category_trend(_categorised(spark, sf_dir))


@query(f"""WITH {CATEGORISED} SELECT model, n FROM (SELECT 'm_threat' AS model, count(*) FILTER (m_threat > 0.8) AS n FROM c WHERE type <> 'DELETION' UNION ALL
    SELECT 'm_insult', count(*) FILTER (m_insult > 0.8) FROM c WHERE type <> 'DELETION' UNION ALL SELECT 'm_obscene', count(*) FILTER (m_obscene > 0.8) FROM c WHERE type <> 'DELETION')""")
def model_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.model_counts(_categorised(spark, sf_dir), ["m_threat", "m_insult", "m_obscene"])


@query(f"""WITH {CATEGORISED} SELECT CASE WHEN starts_with(page_title, 'Talk:') THEN 'talk' WHEN starts_with(page_title, 'User') THEN 'user' ELSE 'other' END AS kind,
    count(*) FILTER (type <> 'DELETION') AS toxic, count(*) FILTER (type = 'DELETION') AS detoxed FROM c GROUP BY 1""")
def page_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.page_type_counts(_categorised(spark, sf_dir))


# --- reconstruction and scoring ---


@query(r"""WITH RECURSIVE l AS (SELECT conv_id, turn, trim(regexp_replace(repeat(':', CAST(turn AS INT)) || replace(text, chr(10), ' '), '<[^>]*>', '', 'g')) AS line FROM conversations),
    h AS (SELECT *, length(regexp_extract(line, '^(=+)', 1)) > 0 AND length(regexp_extract(line, '^(=+)', 1)) = length(regexp_extract(line, '(=+)$', 1)) AND length(regexp_extract(line, '^(=+)', 1)) < length(line) AS heading,
        coalesce(sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM l WHERE line <> ''),
    o AS (SELECT conv_id, turn, heading, CASE WHEN heading THEN -1 ELSE length(regexp_extract(line, '^([:*]*)', 1)) END AS indent, (conv_id * 1000 + turn) || '.' || CAST(place AS BIGINT) || '.' || CAST(place AS BIGINT) AS id FROM h),
    r AS (SELECT c.*, (SELECT arg_max(p.turn, p.turn) FROM o p WHERE p.conv_id = c.conv_id AND p.turn < c.turn AND p.indent < c.indent) AS up FROM o c),
    w AS (SELECT conv_id, turn, id AS conversation_id FROM r WHERE up IS NULL UNION ALL SELECT r.conv_id, r.turn, w.conversation_id FROM r JOIN w ON w.conv_id = r.conv_id AND w.turn = r.up)
    SELECT r.id, CASE WHEN r.heading THEN 'CREATION' ELSE 'ADDITION' END AS type, CAST(r.conv_id AS VARCHAR) AS page_id, CAST(NULL AS VARCHAR) AS parent_id, p.id AS "replyTo_id", w.conversation_id,
        CAST(r.indent AS BIGINT) AS indentation, r.conv_id * 1000 + r.turn AS rev_id FROM r LEFT JOIN o p ON p.conv_id = r.conv_id AND p.turn = r.up JOIN w ON w.conv_id = r.conv_id AND w.turn = r.turn""")
def reconstruct_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = reconstruct.only("action", transcript_revisions(spark, sf_dir))
    return actions.select("id", "type", "page_id", "parent_id", "replyTo_id", "conversation_id", F.col("indentation").cast("long").alias("indentation"), "rev_id")


def transcript_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's growing transcript as the revisions of one page."""
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = F.concat(F.expr("repeat(':', CAST(turn AS INT))"), F.regexp_replace("text", "\n", " "))
    pages = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.array_join(F.collect_list(line).over(so_far), "\n"), F.lit("\n")).alias("text"), "role")
    return pages.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("rev_id"), F.format_string("2001-01-01T00:%02d:00Z", "turn").alias("timestamp"), "text",
        F.lit(None).cast("string").alias("user_id"), F.col("role").alias("user_text"), F.col("conv_id").cast("string").alias("page_id"), F.lit("Talk").alias("page_title"),
    )


@query(rf"""SELECT conv_id, turn, round(CASE WHEN len(regexp_extract_all(lower(text), '[a-z'']+')) = 0 THEN 0.0
    ELSE least(1.0, 5.0 * len(list_filter(regexp_extract_all(lower(text), '[a-z'']+'), lambda x: x IN ('the', 'and'))) / len(regexp_extract_all(lower(text), '[a-z'']+'))) END, 6) AS toxicity FROM conversations""")
def word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return scoring.score(rows, "text", scoring.WordScorer({"toxicity": {"the", "and"}})).select("conv_id", "turn", F.round("toxicity", 6).alias("toxicity"))


# --- further functions ---

_any = lambda p, of="lower(text)": f"len(list_filter({SENTENCES.format(of)}, lambda x: regexp_matches(x, '{sql_q(p)}'))) > 0"
POSITIVE, NEGATIVE = ["of", "to", "and", "est", "le"], ["the", "in", "der", "de"]


@query(f"SELECT conv_id, turn, {', '.join(f'{_any(p)} AS {n}' for n, p in t.POLITE.items())} FROM conversations")
def politeness_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *[c.alias(n) for n, c in t.politeness(F.col("text")).items()])


@query(f"SELECT conv_id, turn, contains(text, '?') OR {_any('^(' + '|'.join(t.POLAR) + ') ')} AS is_request FROM conversations")
def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.is_request(F.col("text")).alias("is_request"))


@query(f"""WITH {DOCS}, u AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS w, unnest(range(len({TOKENS.format('text')}))) AS i FROM d),
    w AS (SELECT doc_id, w, CASE WHEN lag(w) OVER (PARTITION BY doc_id ORDER BY i) IN ('not', 'no') THEN -1 ELSE 1 END AS side FROM u), s AS (SELECT doc_id, sum(side * CASE WHEN w IN ({', '.join(f"'{x}'" for x in POSITIVE)}) THEN 1
    WHEN w IN ({', '.join(f"'{x}'" for x in NEGATIVE)}) THEN -1 ELSE 0 END) AS t FROM w GROUP BY 1) SELECT doc_id, round(coalesce(t, 0) / sqrt(coalesce(t, 0) * coalesce(t, 0) + 15), 6) AS sentiment FROM d LEFT JOIN s USING (doc_id)""")
def sentiment_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.round(t.sentiment(F.col("text"), POSITIVE, NEGATIVE), 6).alias("sentiment"))


@query("SELECT event_id, json_keys(props)[1] AS first_key FROM events")
def json_first_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", t.first_key(F.col("props")).alias("first_key"))


@query("""SELECT event_id, CAST(epoch(strptime(strftime(ts, '%Y%m%d%H%M%S'), '%Y%m%d%H%M%S')) AS BIGINT) AS seconds,
    CAST(epoch(date_trunc('second', ts)) AS BIGINT) - 7200 AS shifted, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) - 7200 AS hour_start FROM events""")
def time_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadlens.functions import time

    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        "event_id", F.unix_timestamp(time.from_compact(F.date_format(ts, "yyyyMMddHHmmss"))).alias("seconds"),
        time.with_offset(F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("+02"))).alias("shifted"), F.unix_timestamp(time.hour_before(ts)[0]).alias("hour_start"),
    )


@query("""WITH s AS (SELECT (d.n_chars % 1000) / 1000 AS score, toxic = 1 AS truth FROM labels JOIN documents d USING (doc_id)),
    p AS (SELECT score, count(*) FILTER (truth) AS h, count(*) AS n FROM s GROUP BY 1),
    r AS (SELECT score, sum(h) OVER (ORDER BY score DESC) AS h, sum(n) OVER (ORDER BY score DESC) AS n, sum(h) OVER () AS a FROM p)
    SELECT score AS threshold, round(h / n, 6) AS precision, round(h / nullif(a, 0), 6) AS recall FROM r ORDER BY abs(h / n - h / nullif(a, 0)), score DESC LIMIT 1""")
def precision_recall_break_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "(n_chars % 1000) / 1000 AS score")
    best = agreement.break_even(table(spark, sf_dir, "labels").join(docs, "doc_id"), "score", F.col("toxic") == 1)
    return best.select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("SELECT count(*) FILTER (toxic = 1) AS a, count(*) FILTER (quality = 1) AS b, count(*) FILTER (toxic = 1 AND quality = 1) AS both, count(*) FILTER (toxic = 1 AND quality <> 1) AS only_a FROM labels".replace("AS both", 'AS "both"'))
def boolean_cross_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.cross_counts(table(spark, sf_dir, "labels"), F.col("toxic") == 1, F.col("quality") == 1)


@query("""SELECT unit, doc_id FROM (SELECT doc_id % 37 AS unit, doc_id, row_number() OVER (PARTITION BY doc_id % 37 ORDER BY md5(doc_id || ':0'), doc_id) AS n FROM labels) WHERE n <= 5""")
def label_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id % 37 AS unit", "doc_id")
    return agreement.subsample(labels, "unit", "doc_id")


@query("""WITH a AS (SELECT user_id FROM events WHERE event_type = 'click' GROUP BY 1 HAVING count(*) >= 20), b AS (SELECT user_id FROM events WHERE event_type = 'view' GROUP BY 1 HAVING count(*) >= 20)
    SELECT (SELECT count(*) FROM a) AS first, (SELECT count(*) FROM b) AS second, (SELECT count(*) FROM a JOIN b USING (user_id)) AS "both" """)
def frequent_author_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return pov.author_overlap(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "user_id")


# --- trained models of text ---

_ENDS = r"""t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f]+'), lambda x: x <> '') AS w FROM documents),
    c AS (SELECT doc_id, unnest(list_transform(w, lambda x: regexp_replace(regexp_replace(x, '^[^\p{L}\p{N}]+', ''), '["''”’»)\]]+$', ''))) AS core, unnest(range(len(w))) AS pos FROM t),
    k AS (SELECT *, CASE WHEN regexp_matches(core, '^[\p{N}.,]*\p{N}[\p{N}.,]*$') THEN '##' ELSE lower(regexp_replace(core, '[.!?…,;:]+$', '')) END AS word,
        CASE WHEN regexp_matches(core, '[!?]$') THEN 'stop' WHEN regexp_matches(core, '(^|[^.])\.$') THEN 'period' END AS ends FROM c),
    n AS (SELECT *, lead(word) OVER o AS next, coalesce(regexp_matches(lead(core) OVER o, '^\p{Lu}'), false) AS upper FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
    words AS (SELECT word, count(*) FILTER (ends = 'period') AS n_period, count(*) AS n FROM k GROUP BY 1),
    e AS (SELECT CAST(sum(n) AS DOUBLE) AS total, CAST(sum(n_period) AS DOUBLE) AS periods FROM words),
    f AS (SELECT word, n_period, n - n_period AS n_plain, length(replace(word, '.', '')) AS letters, periods / total AS p FROM words, e WHERE regexp_matches(word, '^(\p{L}+\.)*\p{L}+$') AND n_period > 0),
    scores AS (SELECT word, n_period, n_plain, -2 * (n_period * ln(p) + CASE WHEN n_plain > 0 THEN n_plain * ln(1 - p) ELSE 0 END - n_period * ln(0.99) - n_plain * ln(0.01)) * exp(-letters) * (length(word) - letters + 1) * pow(letters, -n_plain) AS score FROM f),
    short AS (SELECT word FROM scores WHERE score >= 0.3)"""


def _following(a: str, least: float) -> str:
    """SQL of the words (ab times after any of a) that follow more often than they occur."""
    part = lambda x, p: f"CASE WHEN {x} > 0 THEN {x} * ln({p}) ELSE 0 END"
    same = " + ".join([part("ab", "b / total"), part("(a - ab)", "(1 - b / total)"), part("(b - ab)", "b / total"), part("(total - a - b + ab)", "(1 - b / total)")])
    other = " + ".join([part("ab", "ab / a"), part("(a - ab)", "(1 - ab / a)"), part("(b - ab)", "(b - ab) / greatest(total - a, 1)"), part("(total - a - b + ab)", "(1 - (b - ab) / greatest(total - a, 1))")])
    return f"""SELECT word FROM (SELECT x.next AS word, CAST(ab AS DOUBLE) AS ab, CAST(n AS DOUBLE) AS b, CAST((SELECT sum(ab) FROM {a}) AS DOUBLE) AS a, total FROM {a} x JOIN words w ON w.word = x.next, e)
        WHERE ab * total > b * a AND regexp_matches(word, '^\\p{{L}}') AND -2 * (({same}) - ({other})) >= {least}"""


_STARTS = rf"""{_ENDS},
    breaks AS (SELECT next, count(*) AS ab FROM n WHERE ends = 'period' AND next IS NOT NULL AND word <> '##' AND length(word) > 1 AND word NOT IN (SELECT word FROM short) GROUP BY 1),
    numbers AS (SELECT next, count(*) AS ab FROM n WHERE ends = 'period' AND next IS NOT NULL AND word = '##' GROUP BY 1),
    starters AS ({_following('breaks', 30.0)}), followers AS ({_following('numbers', 7.88)})"""


@query(f"WITH {_ENDS} SELECT word, n_period, n_plain, round(score, 4) AS score FROM scores")
def abbreviation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each word of all texts behaves like an abbreviation."""
    from threadlens.operators.splitter import Splitter

    return Splitter(table(spark, sf_dir, "documents").select("text")).scores.withColumn("score", F.round("score", 4))


@query(f"""WITH {_STARTS}, cuts AS (SELECT doc_id, count(*) AS n FROM n WHERE ends IS NOT NULL AND next IS NOT NULL AND CASE WHEN ends = 'stop' THEN true WHEN word = '##' THEN upper AND next NOT IN (SELECT word FROM followers)
        WHEN word IN (SELECT word FROM short) OR (length(word) = 1 AND regexp_matches(word, '\\p{{L}}')) THEN upper AND next IN (SELECT word FROM starters) ELSE true END GROUP BY 1)
    SELECT doc_id, CASE WHEN len(w) > 0 THEN coalesce(n, 0) + 1 ELSE 0 END AS n FROM t LEFT JOIN cuts USING (doc_id)""")
def trained_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of sentences of every text, by a splitter trained on all of them."""
    from threadlens.operators.splitter import Splitter
    from threadlens.plans.source_queries import _folder

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return Splitter(docs, folder=_folder(spark)).split(docs, "doc_id").select("doc_id", F.size("sentences").cast("long").alias("n"))


def _way(j: int, i: int, pairs: list[list[float]]) -> str:
    return f"s{i} + ({pairs[i][j]!r}e0)"


_CALM = {"first": [-0.5, -0.9], "pairs": [[-0.2, -1.7], [-1.1, -0.4]], "seen": {"view": [-0.6, -1.9], "click": [-1.2, -1.4], "purchase": [-2.5, -0.7]}, "other": [-3.0, -2.2]}


def _own(j: int) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{w}' THEN ({c[j]!r}e0)" for w, c in _CALM["seen"].items()) + f" ELSE ({_CALM['other'][j]!r}e0) END"


@query(f"""WITH RECURSIVE o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    v AS (SELECT user_id, place, n, {_CALM['first'][0]}e0 + {_own(0)} AS s0, {_CALM['first'][1]}e0 + {_own(1)} AS s1, '0' AS p0, '1' AS p1 FROM o WHERE place = 1
        UNION ALL SELECT o.user_id, o.place, o.n, greatest({_way(0, 0, _CALM['pairs'])}, {_way(0, 1, _CALM['pairs'])}) + {_own(0)}, greatest({_way(1, 0, _CALM['pairs'])}, {_way(1, 1, _CALM['pairs'])}) + {_own(1)},
            CASE WHEN {_way(0, 0, _CALM['pairs'])} >= {_way(0, 1, _CALM['pairs'])} THEN p0 ELSE p1 END || '0', CASE WHEN {_way(1, 0, _CALM['pairs'])} >= {_way(1, 1, _CALM['pairs'])} THEN p0 ELSE p1 END || '1' FROM v JOIN o ON o.user_id = v.user_id AND o.place = v.place + 1)
    SELECT user_id, CASE WHEN s0 >= s1 THEN p0 ELSE p1 END AS path FROM v WHERE place = n""")
def likeliest_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest hidden states of each user's whole sequence of events, under a given model."""
    from threadlens.operators.tagger import Tagger

    words = spark.createDataFrame(list(_CALM["seen"].items()), "word string, chances array<double>")
    tagger = Tagger(["0", "1"], _CALM["first"], _CALM["pairs"], words, _CALM["other"])
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("words"))
    return tagger.tag(rows).select("user_id", F.array_join("tags", "").alias("path"))
