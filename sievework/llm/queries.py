"""Registered queries of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from sievework.llm import alignment, decontaminate, grades, jaccard, licenses, packing, pii, runs, sharding, token_store, topk, toxicity, warc
from sievework.llm.common import documents
from sievework.plans.registry import query
from sievework.session import raw_table

VOCABULARY = "word_bpe_49k.json"


@query("op1_ordinal_grades")
def op1(spark, sf_dir):
    """Grades from labels: 0 low quality, 1 good but toxic, 2 good and clean."""
    docs, labels = documents(spark, sf_dir), raw_table(spark, sf_dir, "labels")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    model = grades.fit_grades(docs, labels.select("doc_id", grade.alias("grade")), 3)
    return grades.score_grades(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True)).alias("held_out"),
        "expected_grade",
        F.col("tails")[0].alias("p_grade_1"),
        F.col("tails")[1].alias("p_grade_2"),
        (F.col("tails")[0] >= 0.5).cast("int").alias("keep"),
    )


OP2_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, n FROM dw JOIN win USING (n, g)),
wordhit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN wordhit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query("op2_decontamination", OP2_SQL)
def op2(spark, sf_dir):
    return decontaminate.decontamination_digest(documents(spark, sf_dir), raw_table(spark, sf_dir, "benchmark"))


@query("op3_uniform_shards")
def op3(spark, sf_dir):
    """Size, checksum and place of every document after the shuffle; law: rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return sharding.shuffle_into_shards(documents(spark, sf_dir), 16).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS g, least(len(w), 5) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""


@query("op4_jaccard_classes", OP4_SQL)
def op4(spark, sf_dir):
    return jaccard.jaccard_classes(documents(spark, sf_dir))


@query("op5_token_files")
def op5(spark, sf_dir):
    return token_store.token_digests(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


@query("op6_license_scan", licenses.oracle())
def op6(spark, sf_dir):
    return licenses.scan_licenses(documents(spark, sf_dir)).select("doc_id", "n_known", "licenses")


@query("op7_toxicity")
def op7(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = toxicity.fit_toxicity(docs, raw_table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op8_pii")
def op8(spark, sf_dir):
    return pii.pii_digest(documents(spark, sf_dir))


@query("op9_best_fit_packing")
def op9(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


@query("op10_exact_topk", OP10_SQL)
def op10(spark, sf_dir):
    rows = topk.integer_vectors(raw_table(spark, sf_dir, "embeddings"))
    return topk.exact_topk(rows.where(F.col("vec_id") % 20 == 0), rows)


OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS head FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN head IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN head IS DISTINCT FROM page_id THEN head END AS refers_to
FROM f
"""


@query("op11_warc_chains", OP11_SQL)
def op11(spark, sf_dir):
    return warc.warc_digest(raw_table(spark, sf_dir, "pages"))


# crc32 from its own table; equal words of a text p words apart, whose stretches
# of neighbours are the runs.
OP12_SQL = r"""
WITH RECURSIVE bits(b, c, k) AS (SELECT b, b::BIGINT, 0 FROM range(256) t(b) UNION ALL SELECT b, xor(c >> 1, (c & 1) * 3988292384), k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
h AS (SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
             lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h,
             list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents, tab),
g AS (SELECT doc_id, w, len(w) AS n, h, (h // 10) AS g FROM h),
a AS (SELECT doc_id, w, n, g, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM g),
d AS (SELECT doc_id, n, list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) AS w FROM a),
tok AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS w FROM d),
eq AS (SELECT x.doc_id, x.i, y.i - x.i AS p FROM tok x JOIN tok y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i WHERE 4 * (y.i - x.i) <= x.n),
isl AS (SELECT doc_id, p, min(i) AS s, count(*) + p AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS k FROM eq) GROUP BY doc_id, p, k),
run AS MATERIALIZED (SELECT doc_id, s, l, min(p) AS p FROM isl WHERE l >= greatest(6, 4 * p) GROUP BY doc_id, s, l),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l::DOUBLE / p DESC, s, p) = 1),
lines AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || p || chr(10), '' ORDER BY s, p) AS t FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + p, s + l)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM tok ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, p::BIGINT AS period, (1000 * l // p)::BIGINT AS exponent_milli,
       sha256(coalesce(lines.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op12_periodic_runs", OP12_SQL)
def op12(spark, sf_dir):
    return runs.run_digest(runs.with_planted_runs(documents(spark, sf_dir)))


@query("op13_token_alignment")
def op13(spark, sf_dir):
    return alignment.alignment_digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
