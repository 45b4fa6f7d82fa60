"""The registered corpus queries: each applies its operator to the whole of its table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm import anchors, bpe, digest_index, extraction, fim, imatch, kmeans, langid, line_dedup, mixing, pii, probminhash, sharding
from threadlens.llm.common import documents, scratch


def _sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def _joined(items: Column, form: Callable[[Column], Column], by: str) -> Column:
    return F.array_join(F.transform(items, form), by)


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(documents(spark, sf_dir), shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(documents(spark, sf_dir)).taken()


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.NearDuplicates(documents(spark, sf_dir)).result()


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = anchors.remove_repeats(documents(spark, sf_dir))
    return cut.select("doc_id", "n_words", "n_removed", _sha256(F.col("kept")).alias("kept_sha256"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(documents(spark, sf_dir))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        _sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        _sha256(F.col("decoded")).alias("decoded_sha256"),
    )


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_neighbours(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        cut = line_dedup.LineDecisions(documents(spark, sf_dir)).cut()
    text = F.when(F.col("changed"), F.col("kept")).otherwise(F.coalesce(F.col("row.text"), F.lit("")))
    return cut.select("row.doc_id", "n_lines", "n_exact", "n_near", _sha256(text).alias("kept_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = digest_index.exact_dedup(documents(spark, sf_dir))
    return decided.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir))
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, pii.BASE_KINDS), _sha256(_joined(base, text, ",")).alias("base_sha256"), _joined(F.col("spans"), text, ",").alias("spans")
    )


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = langid.fit(docs.where(~langid.held_out()))
    said = langid.predict(docs, profiles)
    return said.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.transform(documents(spark, sf_dir))
    text = fim.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", _sha256(F.col("output")).alias("output_sha256"), _sha256(text).alias("restored_sha256"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kmeans.Clustering(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    return found.assigned().select("*", found.by_cluster(digests, "string").alias("centroid_sha256"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extraction.extract(pages, extraction.fit(pages))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shard": op1_shard,
    "op2_mix": op2_mix,
    "op3_near_dedup": op3_near_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_bpe": op5_bpe,
    "op6_imatch": op6_imatch,
    "op7_line_dedup": op7_line_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_pii": op9_pii,
    "op10_langid": op10_langid,
    "op11_fim": op11_fim,
    "op12_centroids": op12_centroids,
    "op13_main_text": op13_main_text,
}

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _rounds_of_k_means(rounds: int = 10) -> str:
    """Plain rounds over whole tables: centroids c0, c1, ... and the assignments a0, a1, ... to them."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
            d{i} AS MATERIALIZED (SELECT x.r, c.c, sum((x.x - c.x) * (x.x - c.x)) AS d FROM x JOIN c{i} c USING (i) GROUP BY 1, 2),
            a{i} AS MATERIALIZED (SELECT r, d AS distance, c FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if i < rounds:
            steps.append(f"""
            c{i + 1} AS MATERIALIZED (SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, old) AS x
                FROM (SELECT c.c, c.i, any_value(c.x) AS old, sum(x.x) AS s, nullif(count(x.x), 0) AS n FROM c{i} c LEFT JOIN a{i} a ON a.c = c.c LEFT JOIN x ON x.r = a.r AND x.i = c.i GROUP BY 1, 2))""")
    return f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
                WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
            x AS MATERIALIZED (SELECT r, unnest(range(1, 65)) AS i, CAST(floor(1024 * CAST(unnest(embedding) AS DOUBLE)) AS HUGEINT) AS x FROM v),
            c0 AS MATERIALIZED (SELECT c, i, x FROM x JOIN (SELECT r, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), embedding) - 1 AS c FROM v QUALIFY c < 8) USING (r)),
            {",".join(steps)},
            sha AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY 1)
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
            CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM a{rounds} JOIN v USING (r) JOIN sha USING (c)
    """


ORACLES: dict[str, str] = {
    "op3_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents),
        t AS (SELECT doc_id, array_to_string(w, ' ') AS t, w FROM w WHERE len(w) > 0),
        rep AS (SELECT t, min(doc_id) AS rep, count(*) AS copies, any_value(w) AS w FROM t GROUP BY 1),
        s AS (SELECT rep, unnest(list_distinct(CASE WHEN len(w) < 5 THEN [t] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM rep),
        n AS (SELECT rep, count(*) AS n FROM s GROUP BY 1),
        common AS (SELECT s FROM s GROUP BY 1 HAVING count(*) > 1),
        c AS (SELECT s, rep FROM s JOIN common USING (s)),
        p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS shared FROM c a JOIN c b ON a.s = b.s AND a.rep < b.rep GROUP BY 1, 2),
        links AS (SELECT a, b FROM p JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE shared / (x.n + y.n - shared) >= 0.8),
        e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT rep AS node, rep AS seen FROM rep WHERE rep IN (SELECT a FROM e) UNION SELECT r.node, e.b FROM reach r JOIN e ON e.a = r.seen),
        class AS (SELECT node, min(seen) AS class_id FROM reach GROUP BY 1),
        named AS (SELECT t, copies, coalesce(class_id, rep) AS class_id FROM rep LEFT JOIN class ON node = rep),
        size AS (SELECT class_id, CAST(sum(copies) AS BIGINT) AS class_size FROM named GROUP BY 1)
        SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(class_size, 1) AS class_size, coalesce(class_id, d.doc_id) = d.doc_id AS kept
        FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN named USING (t) LEFT JOIN size USING (class_id)
    """,
    "op4_substring_dedup": rf"""
        WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        s AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM w WHERE len(w) >= 35)),
        d AS (SELECT k FROM s GROUP BY 1 HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM s JOIN d USING (k)),
        each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM each e ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY 1)
        SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
    """,
    "op7_line_dedup": rf"""
        WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents WHERE text IS NOT NULL),
        l AS (SELECT doc_id, no, line, {_WORDS.format("line")} AS w FROM raw),
        k AS (SELECT *, array_to_string(w, ' ') AS key, len(w) AS n FROM l),
        f AS (SELECT key, min((doc_id, no)) AS first, any_value(w) AS w, any_value(n) AS n FROM k WHERE n > 0 GROUP BY 1),
        v AS (SELECT first, i, array_to_string(w[:i - 1] || w[i + 1:], ' ') AS v FROM (SELECT first, w, unnest(range(1, n + 1)) AS i FROM f WHERE n >= 5)),
        hub AS (SELECT v, i, min(first) AS hub FROM v GROUP BY 1, 2),
        cross_ AS (SELECT f.first AS whole, v.first AS longer FROM v JOIN f ON f.key = v.v WHERE f.n >= 5),
        near AS (SELECT first FROM v JOIN hub USING (v, i) WHERE hub < first UNION SELECT longer FROM cross_ WHERE whole < longer UNION SELECT whole FROM cross_ WHERE longer < whole),
        decided AS (SELECT k.*, coalesce(k.n > 0 AND f.first <> (k.doc_id, k.no), false) AS exact, near.first IS NOT NULL AS is_near
            FROM k LEFT JOIN f ON f.key = k.key AND k.n > 0 LEFT JOIN near ON near.first = f.first),
        per AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (exact) AS n_exact, count(*) FILTER (is_near AND NOT exact) AS n_near,
            string_agg(line, chr(10) ORDER BY no) FILTER (NOT exact AND NOT is_near) AS kept FROM decided GROUP BY 1)
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near, sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents d LEFT JOIN per USING (doc_id)
    """,
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
    """,
    "op11_fim": """
        WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        r AS (SELECT *, list_transform(range(4), lambda i: CAST('0x' || substring(h, 8 * i + 1, 8) AS BIGINT)) AS r FROM h),
        c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
            CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
        p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n - b) AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
            sha256(t) AS restored_sha256 FROM p
    """,
    "op12_centroids": _rounds_of_k_means(),
}
