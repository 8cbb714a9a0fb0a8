"""Queries over text corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions.columns import h32, h32_sql as H, words
from sievework.operators import contracts as K, text as T, tokenizer as B
from sievework.plans.registry import query
from sievework.plans.source_queries import DIGEST_SQL
from sievework.session import table

SQ = lambda c: f"trim(regexp_replace(lower({c}),'\\s+',' ','g'))"
WORDS = lambda c: f"list_filter(string_split({SQ(c)},' '), lambda x: x<>'')"


def docs(spark, sf):
    return table(spark, sf, "documents")


@query("T1_normalize_text", f"SELECT doc_id, md5({SQ('text')}) AS normalized, (length(text)-length(regexp_replace(text,'^\\s+','')))::INT AS offset_base FROM documents")
def t1(spark, sf):
    return T.normalize_text(docs(spark, sf), "text").select("doc_id", F.md5("normalized").alias("normalized"), "offset_base")


_LUHN = """(list_sum(list_transform(list_reverse(regexp_extract_all(m,'\\d')), lambda x, i: CASE WHEN i%2=0 THEN CASE WHEN x::INT*2>9 THEN x::INT*2-9 ELSE x::INT*2 END ELSE x::INT END))%10=0)"""


@query(
    "T2_redact_pii",
    f"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text,'{T.PII_PATTERNS['EMAIL']}')) AS e, len(regexp_extract_all(text,'{T.PII_PATTERNS['SECRET']}')) AS s,
 len(list_filter(regexp_extract_all(text,'{T.PII_PATTERNS['CARD']}'), lambda m: {_LUHN})) AS c, len(list_filter(regexp_extract_all(text,'{T.PII_PATTERNS['IPV4']}'), lambda m: m<>'13.149.130.89')) AS i, len(regexp_extract_all(text,'{T.PII_PATTERNS['PHONE']}')) AS p FROM documents)
 SELECT doc_id, 'EMAIL' AS type, e::INT AS n FROM c WHERE e>0 UNION ALL SELECT doc_id,'SECRET',s::INT FROM c WHERE s>0 UNION ALL SELECT doc_id,'CARD',c::INT FROM c WHERE c>0 UNION ALL SELECT doc_id,'IPV4',i::INT FROM c WHERE i>0 UNION ALL SELECT doc_id,'PHONE',p::INT FROM c WHERE p>0""",
)
def t2(spark, sf):
    out = T.redact_pii(docs(spark, sf).select("doc_id", "text"), "doc_id", "text", allow=["13.149.130.89"])
    return out.select("doc_id", F.inline("audit"))


CHUNKS = """pr AS (SELECT doc_id, text, string_split(text,chr(10)) AS ps FROM documents), pz AS (SELECT doc_id, ps, i AS paragraph, string_split(ps[i+1],' ') AS w FROM pr, (SELECT unnest(generate_series(0,(SELECT max(len(string_split(text,chr(10))))-1 FROM documents))) AS i) WHERE i<len(ps) AND trim(ps[i+1])<>''),
 cw AS (SELECT *, greatest(1,ceil((len(w)-8)/32.0))::INT AS n FROM pz), cz AS (SELECT *, unnest(generate_series(0,n-1)) AS k FROM cw),
 chunks AS (SELECT doc_id, paragraph::INT AS paragraph, (coalesce(list_sum(list_transform(ps[1:paragraph], lambda x: length(x)+1)),0) + CASE WHEN k>0 THEN length(array_to_string(w[1:k*32],' '))+1 ELSE 0 END)::INT AS start,
  array_to_string(w[k*32+1:k*32+40],' ') AS body, len(w[k*32+1:k*32+40])::INT AS tokens FROM cz)"""


def chunked(spark, sf):
    return T.chunk(docs(spark, sf), "doc_id", "text", "v1", 40, 8)


@query("T3_chunk", f"WITH {CHUNKS} SELECT doc_id, paragraph, md5(doc_id||'|v1|'||start||'|40/8') AS chunk_id, start, length(body)::INT AS length, tokens, md5(body) AS body FROM chunks")
def t3(spark, sf):
    return chunked(spark, sf).select("doc_id", "paragraph", "chunk_id", "start", "length", "tokens", F.md5("text").alias("body"))


@query("T4_dedup_exact", f"WITH h AS (SELECT doc_id, md5({SQ('text')}) AS h FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS canonical FROM h")
def t4(spark, sf):
    return T.dedup_exact(docs(spark, sf), "doc_id", "text")[1]


@query(
    "T5_dedup_near",
    f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS('text')} AS w FROM documents), s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4],' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1,greatest(1,len(w)-4))) AS i FROM w WHERE len(w)>0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) GROUP BY ALL),
 l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id=a JOIN n y ON y.doc_id=b WHERE a<>b AND c/(x.n+y.n-c)::DOUBLE >= 0.8
  UNION SELECT a.doc_id, b.doc_id FROM w a JOIN w b ON len(a.w)=0 AND len(b.w)=0),
 r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other=l.a)
 SELECT doc_id, min(other) AS canonical FROM r GROUP BY 1""",
)
def t5(spark, sf):
    return T.dedup_near(docs(spark, sf), "doc_id", "text")


@query(
    "T6_merge_duplicate_acl",
    f"""WITH d AS (SELECT doc_id, md5({SQ('text')}) AS grp, CASE WHEN doc_id%23<>0 THEN list_distinct(['all','g'||{H('source')}%4,'g'||{H("doc_id::VARCHAR||'acl'")}%4]) END AS acl FROM documents),
 z AS (SELECT grp, count(DISTINCT doc_id) AS copies FROM d GROUP BY 1), g AS (SELECT grp, p, count(*) AS n FROM (SELECT DISTINCT grp, doc_id, unnest(acl) AS p FROM d) GROUP BY 1,2)
 SELECT z.grp, copies, coalesce(string_agg(p, ',' ORDER BY p),'') AS allowed FROM z LEFT JOIN g ON g.grp=z.grp AND g.n=z.copies GROUP BY 1,2""",
)
def t6(spark, sf):
    tag = lambda *c: F.concat(F.lit("g"), (h32(*c) % 4).cast("string"))
    acl = F.when(F.col("doc_id") % 23 != 0, F.array_distinct(F.array(F.lit("all"), tag("source"), tag("doc_id", F.lit("acl")))))
    d = docs(spark, sf).select("doc_id", F.md5(T.squeeze(F.col("text"))).alias("grp"), acl.alias("acl"))
    return T.merge_duplicate_acl(d, "grp", "doc_id", "acl").withColumn("allowed", F.array_join("allowed", ","))


@query(
    "T7_contamination",
    f"""WITH h AS (SELECT item_id AS item, {SQ('text')} AS ht, {WORDS('text')} AS w FROM benchmark), hn AS (SELECT *, least(8,len(w)) AS n FROM h WHERE len(w)>0),
 hg AS (SELECT DISTINCT item, g FROM (SELECT item, unnest(list_transform(generate_series(1,len(w)-n+1), lambda i: n||'|'||array_to_string(w[i:i+n-1],' '))) AS g FROM hn)),
 dw AS (SELECT doc_id, {SQ('text')} AS tt, {WORDS('text')} AS w FROM documents), sz AS (SELECT DISTINCT n FROM hn),
 dg AS (SELECT DISTINCT unnest(list_transform(generate_series(1,len(w)-n+1), lambda i: n||'|'||array_to_string(w[i:i+n-1],' '))) AS g FROM dw, sz WHERE len(w)>=n),
 sh AS (SELECT item, round(count(dg.g)/count(*)::DOUBLE,6) AS ngram_share FROM hg LEFT JOIN dg USING (g) GROUP BY 1),
 ct AS (SELECT item, count(*) AS containing, count(*) FILTER (tt=ht) AS exact_copies FROM hn JOIN dw ON contains(' '||tt||' ',' '||ht||' ') GROUP BY 1)
 SELECT hn.item, coalesce(exact_copies,0) AS exact_copies, coalesce(containing,0) AS containing, ngram_share FROM hn LEFT JOIN ct USING (item) LEFT JOIN sh USING (item)""",
)
def t7(spark, sf):
    return T.contamination(docs(spark, sf), "doc_id", "text", table(spark, sf, "benchmark"), "item_id", "text", 8)[0]


def bpe_steps(where: str, merges: int) -> str:
    """CTEs p0, p1, ..: the merges of a vocabulary, each symbol between chr(1) and
    chr(2) so that replacing one pair never touches the next."""
    a, z = "chr(1)", "chr(2)"
    out = [f"v0 AS MATERIALIZED (SELECT regexp_replace(word,'(.)',{a}||'\\1'||{z},'gs') AS s, count(*) AS n FROM (SELECT unnest({WORDS('text')}) AS word FROM documents WHERE {where}) GROUP BY 1)"]
    for k in range(merges):
        sym = f"string_split(substr(s,2,length(s)-2),{z}||{a})"
        out.append(
            f"p{k} AS MATERIALIZED (SELECT z[1] AS l, z[2] AS r, sum(n)::BIGINT AS c FROM (SELECT n, unnest(list_zip(y[:len(y)-1],y[2:])) AS z FROM (SELECT n, {sym} AS y FROM v{k}) WHERE len(y)>1) GROUP BY 1,2 ORDER BY c DESC, 1, 2 LIMIT 1)"
        )
        out.append(f"v{k + 1} AS MATERIALIZED (SELECT {bpe_merge('s', f'p{k}')} AS s, n FROM v{k}, p{k})")
    return ", ".join(out)


def bpe_merge(s: str, p: str) -> str:
    return f"replace({s}, chr(1)||{p}.l||chr(2)||chr(1)||{p}.r||chr(2), chr(1)||{p}.l||{p}.r||chr(2))"


BPE16 = bpe_steps("doc_id%10<>0", 16)


@query("T8_train_bpe", f"WITH {BPE16} " + " UNION ALL ".join(f"SELECT {k}::INT AS step, l AS \"left\", r AS \"right\", c AS n FROM p{k}" for k in range(16)))
def t8(spark, sf):
    merges = B.train_bpe(docs(spark, sf).where("doc_id % 10 <> 0"), "text", 16)
    rows = [(i, a, b, c) for i, (a, b, c) in enumerate(merges)]
    return spark.createDataFrame(rows, "step int, left string, right string, n bigint")


@query(
    "T8_first_merge",
    f"""WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest({WORDS('text')}) AS word FROM documents) GROUP BY 1), p AS (SELECT n, unnest(list_transform(generate_series(1,length(word)-1), lambda i: word[i:i+1])) AS z FROM w WHERE length(word)>1)
 SELECT z[1] AS "left", z[2] AS "right", sum(n)::BIGINT AS n FROM p GROUP BY 1,2 ORDER BY n DESC, 1, 2 LIMIT 1""",
)
def t8b(spark, sf):
    return spark.createDataFrame(B.train_bpe(docs(spark, sf), "text", 1), "left string, right string, n bigint")


@query(
    "T9_encode_fertility",
    f"WITH {BPE16}, e0 AS (SELECT lang, word, regexp_replace(word,'(.)',chr(1)||'\\1'||chr(2),'gs') AS s, n FROM (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest({WORDS('text')}) AS word FROM documents WHERE doc_id%10=0) GROUP BY 1,2)), "
    + ", ".join(f"e{k + 1} AS (SELECT lang, word, {bpe_merge('s', f'p{k}')} AS s, n FROM e{k}, p{k})" for k in range(16))
    + """, f AS (SELECT lang, word, n, string_split(substr(s,2,length(s)-2),chr(2)||chr(1)) AS y FROM e16)
 SELECT lang, sum(n)::BIGINT AS words, round(sum(n*len(y))/sum(n)::DOUBLE,6) AS pieces_per_word, round(sum(n*length(word))/sum(n)::DOUBLE,6) AS chars_per_word,
 round(sum(n*len(list_filter(y, lambda x: length(x)=1)))/sum(n*len(y))::DOUBLE,6) AS single_char_share, count(*) FILTER (array_to_string(y,'')<>word) AS broken_words FROM f GROUP BY 1""",
)
def t9(spark, sf):
    d = docs(spark, sf)
    merges = [(a, b) for a, b, _ in B.train_bpe(d.where("doc_id % 10 <> 0"), "text", 16)]
    return B.fertility(d.where("doc_id % 10 = 0"), "text", "lang", merges)


@query(
    "T9_words_and_chars",
    f"""SELECT lang, count(*) AS words, round(sum(length(w))/count(*)::DOUBLE,6) AS chars_per_word, 0::BIGINT AS broken_words FROM (SELECT lang, unnest({WORDS('text')}) AS w FROM documents) GROUP BY 1""",
)
def t9b(spark, sf):
    d = docs(spark, sf)
    merges = [(a, b) for a, b, _ in B.train_bpe(d, "text", 4)]
    return B.fertility(d, "text", "lang", merges).select("lang", "words", "chars_per_word", "broken_words")


SHARD = H("'shard|'||doc_id") + "%4"


@query(
    "T10_pack_sequences",
    f"""WITH d AS (SELECT doc_id, len({WORDS('text')}) AS n, ({SHARD})::INT AS shard FROM documents), r AS (SELECT *, (sum(n) OVER (PARTITION BY shard ORDER BY doc_id))::BIGINT-n AS a, (sum(n) OVER (PARTITION BY shard))::BIGINT AS t FROM d WHERE n>0),
 s AS (SELECT *, unnest(generate_series(a//256,(a+n-1)//256)) AS seq FROM r)
 SELECT shard, seq, doc_id, greatest(0,seq*256-a)::BIGINT AS doc_from, least(n,(seq+1)*256-a)::BIGINT AS doc_to FROM s WHERE seq < t//256""",
)
def t10(spark, sf):
    return T.pack_sequences(docs(spark, sf), "doc_id", F.size(words(T.squeeze(F.col("text")))), 256, 4, keep_remainder=False)


@query(
    "T11_shard_manifest",
    f"""WITH d AS (SELECT ({SHARD})::INT AS shard, len({WORDS('text')}) AS n, md5(concat_ws(chr(31), doc_id::VARCHAR, text, lang)) AS d FROM documents)
 SELECT shard, sum(n)::BIGINT AS tokens, {DIGEST_SQL.removeprefix('SELECT ')} FROM d GROUP BY 1""",
)
def t11(spark, sf):
    return T.shard_manifest(docs(spark, sf), "doc_id", F.size(words(T.squeeze(F.col("text")))), 4, ["doc_id", "text", "lang"])


CONV = """c AS (SELECT conv_id, CASE WHEN conv_id%11=3 THEN turn*2 ELSE turn END AS turn, CASE WHEN conv_id%7=2 AND turn=1 THEN 'user' WHEN conv_id%13=5 AND turn=0 THEN 'assistant' ELSE role END AS role, CASE WHEN conv_id%17=4 AND turn=0 THEN ' ' ELSE text END AS text, CASE WHEN conv_id%19<>6 THEN 'src' END AS source FROM conversations)"""


def conv(spark, sf):
    c, i = table(spark, sf, "conversations"), F.col("conv_id")
    return c.select(
        "conv_id", F.when(i % 11 == 3, F.col("turn") * 2).otherwise(F.col("turn")).alias("turn"),
        F.when((i % 7 == 2) & (F.col("turn") == 1), "user").when((i % 13 == 5) & (F.col("turn") == 0), "assistant").otherwise(F.col("role")).alias("role"),
        F.when((i % 17 == 4) & (F.col("turn") == 0), " ").otherwise(F.col("text")).alias("text"), F.when(i % 19 != 6, "src").alias("source"),
    )


@query(
    "T12_validate_conversations",
    f"""WITH {CONV}, l AS (SELECT *, lag(turn) OVER w AS pt, lag(role) OVER w AS pr FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 g AS (SELECT conv_id, count(*) AS turns, bool_or(coalesce(role IS NULL OR trim(role)='',false)) AS a, bool_or(source IS NULL) AS b, bool_or(coalesce(pt IS NULL AND role NOT IN ('user','system'),false)) AS c, bool_or(coalesce(pt IS NOT NULL AND (role=pr OR role='system'),false)) AS d,
  bool_or(coalesce(text IS NULL OR trim(text)='',false)) AS e, bool_or(CASE WHEN pt IS NULL THEN turn<>0 ELSE turn<>pt+1 END) AS f FROM l GROUP BY 1)
 SELECT conv_id, turns, array_to_string(list_filter([CASE WHEN a THEN 'missing_role' END, CASE WHEN b THEN 'missing_provenance' END, CASE WHEN c THEN 'bad_first_role' END, CASE WHEN d THEN 'no_alternation' END, CASE WHEN e THEN 'empty_turn' END, CASE WHEN f THEN 'turn_gap' END], lambda x: x IS NOT NULL),',') AS reasons FROM g""",
)
def t12(spark, sf):
    return T.validate_conversations(conv(spark, sf)).withColumn("reasons", F.array_join("reasons", ","))


@query(
    "T13_render_dialogues",
    f"""SELECT conv_id, md5(string_agg(CASE role WHEN 'user' THEN '<u>'||text||'</u>' WHEN 'assistant' THEN '<a>'||text||'</a>' ELSE '<s>'||text END, chr(10) ORDER BY turn)) AS rendered,
 (sum(len(list_filter(regexp_split_to_array(text,'\\s+'), lambda x: x<>''))) FILTER (role<>'assistant'))::BIGINT AS prompt_tokens, coalesce(sum(len(list_filter(regexp_split_to_array(text,'\\s+'), lambda x: x<>''))) FILTER (role='assistant'),0)::BIGINT AS answer_tokens FROM conversations GROUP BY 1""",
)
def t13(spark, sf):
    out = T.render_dialogues(table(spark, sf, "conversations"), [("user", "<u>{text}</u>"), ("assistant", "<a>{text}</a>"), ("system", "<s>{text}")])
    return out.withColumn("rendered", F.md5("rendered"))


def answers(spark, sf):
    c = table(spark, sf, "conversations")
    u = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), (h32("text") % 40).alias("prompt"))
    a = c.where("role = 'assistant'").join(u, ["conv_id", "turn"])
    return a.select(
        "prompt", (F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "text", (F.length("text") % 50).cast("bigint").alias("score"),
        F.when(F.col("conv_id") % 3 == 0, "model").otherwise("human").alias("source"),
    )


PREF = f"""ans AS (SELECT {H('u.text')}%40 AS prompt, a.conv_id*1000+a.turn AS answer_id, a.text, (length(a.text)%50)::BIGINT AS score, CASE WHEN a.conv_id%3=0 THEN 'model' ELSE 'human' END AS source FROM conversations a JOIN conversations u ON u.conv_id=a.conv_id AND u.turn+1=a.turn AND u.role='user' WHERE a.role='assistant'),
 rk AS (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY score DESC, answer_id DESC) AS hi, row_number() OVER (PARTITION BY prompt ORDER BY score, answer_id DESC) AS lo, count(*) OVER (PARTITION BY prompt) AS n FROM ans),
 pairs AS (SELECT c.prompt, c.n AS answers, c.answer_id AS chosen_id, r.answer_id AS rejected_id, c.score AS chosen_score, r.score AS rejected_score, c.text AS chosen, r.text AS rejected, c.source FROM rk c JOIN rk r ON r.prompt=c.prompt AND r.lo=1 WHERE c.hi=1 AND c.text<>r.text AND c.score>r.score)"""


@query("T14_preference_pairs", f"WITH {PREF} SELECT prompt, answers, chosen_id, rejected_id, chosen_score, rejected_score, source FROM pairs")
def t14(spark, sf):
    return T.preference_pairs(answers(spark, sf)).drop("chosen", "rejected")


@query(
    "T15_preference_audit",
    f"""WITH {PREF} SELECT source, count(*) AS n, round(avg((chosen_id%3=0)::INT::DOUBLE),6) AS first_position_rate, round(avg((length(chosen)>length(rejected))::INT::DOUBLE),6) AS longer_chosen_rate, round(corr(length(chosen),length(rejected)),6) AS length_corr,
 round(avg((rejected_id%5<>0)::INT::DOUBLE),6) AS swap_consistency FROM pairs GROUP BY 1""",
)
def t15(spark, sf):
    p = T.preference_pairs(answers(spark, sf)).withColumn("chosen_first", F.col("chosen_id") % 3 == 0).withColumn("swap_agrees", F.col("rejected_id") % 5 != 0)
    return T.preference_audit(p).drop("style_gap")


@query(
    "T16_verify_answers",
    f"""WITH b AS (SELECT conv_id, turn, role, text, (conv_id*10+turn)%4 AS m FROM conversations), v AS (SELECT role, length(text) AS l, CASE m WHEN 0 THEN '  '||lower(text)||'.' WHEN 1 THEN (turn+0.001::DOUBLE)::VARCHAR WHEN 2 THEN (turn+5)::VARCHAR ELSE text||' x' END AS a, CASE m WHEN 1 THEN turn::VARCHAR WHEN 2 THEN turn::VARCHAR ELSE text END AS t, m FROM b),
 f AS (SELECT role, l, CASE WHEN m=1 THEN true WHEN m=2 THEN false ELSE {SQ("regexp_replace(a,'[.,;:!?]+$','')")}={SQ("regexp_replace(t,'[.,;:!?]+$','')")} END AS ok FROM v)
 SELECT role, count(*) AS n, round(avg(ok::INT::DOUBLE),6) AS accept_rate, round(corr(ok::INT::DOUBLE,l::DOUBLE),6) AS reward_length_corr, coalesce(abs(round(corr(ok::INT::DOUBLE,l::DOUBLE),6))>0.3,false) AS suspect FROM f GROUP BY 1""",
)
def t16(spark, sf):
    c = table(spark, sf, "conversations")
    m = (F.col("conv_id") * 10 + F.col("turn")) % 4
    t = F.col("turn")
    c = c.withColumn("a", F.when(m == 0, F.concat(F.lit("  "), F.lower("text"), F.lit("."))).when(m == 1, (t + 0.001).cast("string")).when(m == 2, (t + 5).cast("string")).otherwise(F.concat("text", F.lit(" x"))))
    c = c.withColumn("t", F.when(m.isin(1, 2), t.cast("string")).otherwise(F.col("text")))
    v = T.verify_answers(c, "a", "t", 0.01).withColumn("reward", F.col("accepted").cast("int"))
    return T.verifier_report(v, "role", "reward", F.length("text"), 0.3)


GEN_SCHEMA = {"type": "object", "required": ["id", "lang"], "properties": {"id": {"type": "integer"}, "lang": {"type": "string", "enum": ["en", "fr", "de"]}}}


@query(
    "T17_filter_generated",
    f"""WITH r AS (SELECT doc_id, md5({SQ('text')}) AS h, doc_id%13=0 OR lang NOT IN ('en','fr','de') AS bad FROM documents WHERE doc_id%5<>0), ref AS (SELECT DISTINCT md5({SQ('text')}) AS h FROM documents WHERE doc_id%5=0),
 w AS (SELECT doc_id, doc_id%5=0 AS ref, {WORDS('text')} AS w FROM documents), sh AS (SELECT DISTINCT doc_id, ref, array_to_string(w[i:i+4],' ') AS g FROM (SELECT doc_id, ref, w, unnest(generate_series(1,greatest(1,len(w)-4))) AS i FROM w WHERE len(w)>0)),
 sn AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1), ov AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g=b.g AND NOT a.ref AND b.ref GROUP BY 1,2),
 nc AS (SELECT DISTINCT a FROM ov JOIN sn x ON x.doc_id=a JOIN sn y ON y.doc_id=b WHERE c/(x.n+y.n-c)::DOUBLE >= 0.8),
 c AS (SELECT *, h IN (SELECT h FROM ref) OR doc_id IN (SELECT a FROM nc) AS cp FROM r), f AS (SELECT h, min(doc_id) AS m FROM c WHERE NOT bad AND NOT cp GROUP BY 1)
 SELECT doc_id, CASE WHEN bad THEN 'malformed' WHEN cp THEN 'copied' WHEN doc_id<>m THEN 'duplicate' ELSE 'kept' END AS verdict, 'p1' AS prompt_version FROM c LEFT JOIN f USING (h)""",
)
def t17(spark, sf):
    d = docs(spark, sf)
    g = d.where("doc_id % 5 <> 0").withColumn("prompt_version", F.lit("p1"))
    raw = F.when(F.col("doc_id") % 13 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("doc_id").alias("id"), "lang")))
    g = g.withColumn("raw", raw)
    bad = K.record_violations(g, "doc_id", "raw", GEN_SCHEMA)
    return T.filter_generated(g, "doc_id", "raw", "text", d.where("doc_id % 5 = 0"), "text", bad).select("doc_id", "verdict", "prompt_version")


@query(
    "T18_corpus_metrics",
    f"""WITH {CHUNKS}, cc AS (SELECT doc_id, count(*) AS c FROM chunks WHERE doc_id%9<>0 GROUP BY 1), d AS (SELECT doc_id, source, min(doc_id) OVER (PARTITION BY md5({SQ('text')})) AS k, len(list_filter(regexp_split_to_array(text,'\\s+'), lambda x: x<>'')) AS n FROM documents)
 SELECT source, count(*) AS documents, count(*) FILTER (n=0) AS failures, round(count(c)/count(*)::DOUBLE,6) AS chunked, round(coalesce(sum(c),0)/count(*)::DOUBLE,6) AS chunks_per_doc, round(count(*) FILTER (doc_id<>k)/count(*)::DOUBLE,6) AS duplicate_rate,
 min(n)::INT AS min_tokens, round(avg(n),6) AS mean_tokens, max(n)::INT AS max_tokens FROM d LEFT JOIN cc USING (doc_id) GROUP BY 1""",
)
def t18(spark, sf):
    return T.corpus_metrics(docs(spark, sf), chunked(spark, sf).where("doc_id % 9 <> 0"), "doc_id", "text")


