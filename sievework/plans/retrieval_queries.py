"""Queries over retrieval and knowledge (R1-R30) and copy search (X11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions.columns import h32, h32_sql as H
from sievework.functions.ivf import build_ivf, ivf_topk
from sievework.operators import knowledge as G, retrieval as R, text as T
from sievework.plans import derive as D
from sievework.plans.model_queries import U
from sievework.plans.registry import query
from sievework.plans.text_queries import SQ, WORDS
from sievework.plans.version_queries import LINEAGE, lineage_edges
from sievework.session import cut, dealt, scratch_path, table

DIM = 32


def items(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text")


def questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def embed(df, key):
    """Vectors of all texts; the only texts without one are those without words."""
    return R.hash_embed(df, key, "text", DIM, 2**31 - 1).where("status = 'ok'").select(key, "vector")


def lexical(spark, sf, k=10):
    return R.bm25_topk(questions(spark, sf), items(spark, sf), k)


def dense(spark, sf, k=10):
    return R.dense_topk(embed(questions(spark, sf), "query_id"), embed(items(spark, sf), "item_id"), k)


def fused(spark, sf):
    return R.fuse_rrf([lexical(spark, sf), dense(spark, sf)], 60, 10)


def qrels(spark, sf):
    per, found = T.contamination(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "benchmark"), "item_id", "text", 8)
    return found.select(F.col("item").alias("query_id"), F.col("doc").alias("item_id"))


def _emb(name, src, key):
    return f"""{name}_t AS (SELECT {key}, {H('t')} AS h FROM (SELECT {key}, unnest({WORDS('text')}) AS t FROM {src})), {name}_b AS (SELECT {key}, h%{DIM} AS b, sum(CASE WHEN (h//{DIM})%2=0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v FROM {name}_t GROUP BY 1,2),
 {name}_n AS (SELECT {key}, sqrt(sum(v*v)) AS n FROM {name}_b GROUP BY 1), {name} AS (SELECT {key}, b, CASE WHEN n>0 THEN v/n ELSE v END AS v FROM {name}_b JOIN {name}_n USING ({key}))"""


@query("R1_hash_embed", f"WITH {_emb('e', 'documents', 'doc_id')}, f AS (SELECT doc_id, b, v FROM e WHERE v<>0) SELECT doc_id, b::INT AS pos, round(v,6) AS value FROM f")
def r1(spark, sf):
    e = R.hash_embed(table(spark, sf, "documents"), "doc_id", "text", DIM, 100000)
    return e.select("doc_id", F.posexplode("vector").alias("pos", "value")).where("value <> 0").withColumn("value", F.round("value", 6))


_COS = "list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[])"


def vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return q, e.where("vec_id % 25 <> 0").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))


DENSE_SQL = f"""ex AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, round({_COS},6) AS score FROM embeddings q JOIN embeddings i ON q.vec_id%25=0 AND i.vec_id%25<>0),
 exact AS (SELECT query_id, item_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id))::INT AS rank FROM ex QUALIFY rank<=10)"""


@query(
    "R2_dense_topk",
    f"""SELECT q.vec_id AS query_id, i.vec_id AS item_id, round({_COS},6) AS score, (row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS},6) DESC, i.vec_id))::INT AS rank, 'vec/'||i.vec_id AS citation
 FROM embeddings q JOIN embeddings i ON q.vec_id%25=0 AND i.vec_id%25<>0 AND i.label<>3 QUALIFY rank<=10""",
)
def r2(spark, sf):
    q, _ = vectors(spark, sf)
    e = table(spark, sf, "embeddings").where("vec_id % 25 <> 0")
    index = e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), "label", F.concat(F.lit("vec/"), F.col("vec_id").cast("string")).alias("source"))
    return R.dense_topk(q, index, 10, where=F.col("label") != 3, citation="source")


@query("R3_ann_topk", f"WITH {DENSE_SQL} SELECT * FROM exact")
def r3(spark, sf):
    """The inverted file's bounds make its result the exact one."""
    q, i = vectors(spark, sf)
    return ivf_topk(q, build_ivf(i, scratch_path(spark, "ivf")), 10)


LEX = f"""lq AS (SELECT DISTINCT item_id AS query_id, unnest({WORDS('text')}) AS term FROM benchmark), ld AS (SELECT doc_id AS item_id, {WORDS('text')} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS av FROM ld),
 tf AS (SELECT item_id, any_value(dl) AS dl, term, count(*) AS tf FROM (SELECT item_id, len(w) AS dl, unnest(w) AS term FROM ld) WHERE term IN (SELECT term FROM lq) GROUP BY item_id, term), dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 ls AS (SELECT query_id, item_id, round(sum(ln(1+(n-df+0.5)/(df+0.5))*tf*2.2::DOUBLE/(tf+1.2::DOUBLE*(0.25::DOUBLE+0.75::DOUBLE*dl/av))),6) AS score FROM lq JOIN tf USING (term) JOIN dfq USING (term), st GROUP BY 1,2),
 lexi AS (SELECT query_id, item_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id))::INT AS rank FROM ls WHERE score>0 QUALIFY rank<=10)"""
DEN = f"""{_emb('de', 'documents', 'doc_id')}, {_emb('qe', 'benchmark', 'item_id')}, dot AS (SELECT q.item_id AS query_id, d.doc_id AS item_id, sum(q.v*d.v) AS s FROM qe q JOIN de d USING (b) GROUP BY 1,2),
 ds AS (SELECT b.item_id AS query_id, d.doc_id AS item_id, round(coalesce(s,0.0),6) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN dot ON dot.query_id=b.item_id AND dot.item_id=d.doc_id),
 deni AS (SELECT query_id, item_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id))::INT AS rank FROM ds QUALIFY rank<=10)"""
RRF = f"""{LEX}, {DEN}, fs AS (SELECT query_id, item_id, round(sum(1.0::DOUBLE/(60+rank)),9) AS score FROM (SELECT query_id,item_id,rank FROM lexi UNION ALL SELECT query_id,item_id,rank FROM deni) GROUP BY 1,2),
 fused AS (SELECT query_id, item_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id))::INT AS rank FROM fs QUALIFY rank<=10)"""
QREL = f"""qrel AS (SELECT b.item_id AS query_id, d.doc_id AS item_id FROM (SELECT item_id, ' '||{SQ('text')}||' ' AS t FROM benchmark) b JOIN (SELECT doc_id, ' '||{SQ('text')}||' ' AS t FROM documents) d ON contains(d.t,b.t))"""


@query("R4_bm25_topk", f"WITH {LEX} SELECT * FROM lexi")
def r4(spark, sf):
    return lexical(spark, sf)


@query("R5_fuse_rrf", f"WITH {RRF} SELECT * FROM fused")
def r5(spark, sf):
    return fused(spark, sf)


SCALED = f"""{LEX}, {DEN}, z AS (SELECT 0 AS l, query_id, item_id, score FROM lexi UNION ALL SELECT 1, query_id, item_id, score FROM deni), sp AS (SELECT l, query_id, min(score) AS a, max(score) AS b FROM z GROUP BY 1,2),
 sc AS (SELECT query_id, item_id, coalesce(max(CASE WHEN l=0 THEN CASE WHEN b>a THEN (score-a)/(b-a) ELSE 1.0 END END),0.0) AS s0, coalesce(max(CASE WHEN l=1 THEN CASE WHEN b>a THEN (score-a)/(b-a) ELSE 1.0 END END),0.0) AS s1 FROM z JOIN sp USING (l,query_id) GROUP BY 1,2)"""


@query("R6_fuse_weighted", f"WITH {SCALED} SELECT query_id, item_id, round(0.0::DOUBLE+s0*0.7::DOUBLE+s1*0.3::DOUBLE,9) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY round(0.0::DOUBLE+s0*0.7::DOUBLE+s1*0.3::DOUBLE,9) DESC, item_id))::INT AS rank FROM sc QUALIFY rank<=5")
def r6(spark, sf):
    return R.fuse_weighted([lexical(spark, sf), dense(spark, sf)], [0.7, 0.3], 5)


@query(
    "R6_tune_weights",
    f"""WITH {SCALED}, {QREL}, g AS (SELECT * FROM (VALUES (0,1.0::DOUBLE,0.0::DOUBLE),(1,0.5,0.5),(2,0.0,1.0)) t(setting,w0,w1)), t AS (SELECT setting, query_id, item_id, row_number() OVER (PARTITION BY setting, query_id ORDER BY round(0.0::DOUBLE+s0*w0+s1*w1,9) DESC, item_id) AS r FROM sc, g QUALIFY r<=1),
 h AS (SELECT setting, query_id, count(*) AS h FROM t WHERE (query_id,item_id) IN (SELECT (query_id,item_id) FROM qrel) GROUP BY 1,2), n AS (SELECT query_id, count(*) AS r FROM qrel GROUP BY 1),
 m AS (SELECT g.setting, round(avg(coalesce(h,0)/r::DOUBLE) FILTER (n.query_id%2=0),6) AS tr, round(avg(coalesce(h,0)/r::DOUBLE) FILTER (n.query_id%2<>0),6) AS te FROM n CROSS JOIN g LEFT JOIN h ON h.query_id=n.query_id AND h.setting=g.setting GROUP BY 1),
 b AS (SELECT setting FROM m ORDER BY tr DESC, setting LIMIT 1)
 SELECT m.setting, tr AS train_recall, m.setting=b.setting AS chosen, CASE WHEN m.setting=b.setting THEN te END AS test_recall FROM m, b""",
)
def r6b(spark, sf):
    return R.tune_weights([cut(lexical(spark, sf)), cut(dense(spark, sf))], [(1.0, 0.0), (0.5, 0.5), (0.0, 1.0)], qrels(spark, sf), F.col("query_id") % 2 == 0, 1)


@query("R7_acl_filter", D.with_(D.ACL) + " SELECT doc_id, source FROM acl WHERE grp IN ('g0','g2') AND doc_id%2=1 OR grp='g1' AND doc_id%2=0")
def r7(spark, sf):
    rows = D.acl(spark, sf).withColumn("project", F.col("doc_id") % 2)
    e = table(spark, sf, "events")
    c = e.select(F.explode(F.array(F.struct(F.lit(1).cast("bigint").alias("project"), F.lit("g0").alias("grp")), F.struct(F.lit(1).cast("bigint").alias("project"), F.lit("g2").alias("grp")), F.struct(F.lit(0).cast("bigint").alias("project"), F.lit("g1").alias("grp")))).alias("c"))
    claims = c.select("c.project", "c.grp").distinct()
    return R.Guarded(rows, "project", "grp").visible(claims).select("doc_id", "source")


RERANK = f"""{RRF}, qw AS (SELECT item_id AS query_id, list_distinct({WORDS('text')}) AS q FROM benchmark), dw AS (SELECT doc_id AS item_id, {WORDS('text')} AS d FROM documents WHERE doc_id%6<>0),
 ft AS (SELECT query_id, item_id, round(len(list_intersect(q,list_distinct(d)))/greatest(len(q),1)::DOUBLE,6) AS overlap, round(least(len(q),len(d))/greatest(len(q),len(d))::DOUBLE,6) AS closeness FROM fused JOIN qw USING (query_id) JOIN dw USING (item_id) WHERE len(d)>0),
 rr AS (SELECT query_id, item_id, rank, round(0.0::DOUBLE+overlap*0.8::DOUBLE+closeness*0.2::DOUBLE,9) AS rerank_score FROM fused LEFT JOIN ft USING (query_id,item_id) WHERE rank<=8)"""


@query("R8_rerank", f"WITH {RERANK} SELECT *, rerank_score IS NULL AS fallback, (row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, rank, item_id))::INT AS final_rank FROM rr")
def r8(spark, sf):
    f = cut(fused(spark, sf))
    feats = R.overlap_features(f.select("query_id", "item_id"), questions(spark, sf), items(spark, sf).where("item_id % 6 <> 0"))
    return R.rerank(f, feats, {"overlap": 0.8, "closeness": 0.2}, 8)


@query(
    "R9_late_interaction",
    f"""WITH {LEX}, c AS (SELECT query_id, item_id FROM lexi WHERE rank<=5), q AS (SELECT item_id AS query_id, i, w[i] AS t FROM (SELECT item_id, w, unnest(generate_series(1,len(w))) AS i FROM (SELECT item_id, {WORDS('text')} AS w FROM benchmark))),
 d AS (SELECT DISTINCT item_id, unnest(w) AS t FROM ld SEMI JOIN c USING (item_id)), u AS (SELECT t, list_transform(generate_series(0,15), lambda i: ('0x'||substr(md5(t),(2*i+1)::INT,2))::INT-127.5::DOUBLE) AS v FROM (SELECT t FROM q UNION SELECT t FROM d)),
 x AS MATERIALIZED (SELECT t, list_transform(v, lambda y: y/sqrt(list_inner_product(v,v))) AS v FROM u),
 best AS (SELECT c.query_id, c.item_id, q.i, max(list_inner_product(a.v,b.v)) AS s FROM c JOIN q USING (query_id) JOIN d USING (item_id) JOIN x a ON a.t=q.t JOIN x b ON b.t=d.t GROUP BY 1,2,3),
 z AS (SELECT query_id, item_id, round(sum(s),6) AS score FROM best GROUP BY 1,2), n AS (SELECT item_id, count(*)::INT AS item_vectors FROM d GROUP BY 1)
 SELECT query_id, item_id, score, item_vectors, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id))::INT AS rank FROM z JOIN n USING (item_id)""",
)
def r9(spark, sf):
    return R.late_interaction(lexical(spark, sf, 5).select("query_id", "item_id"), questions(spark, sf), items(spark, sf))


@query(
    "R10_build_context",
    f"""WITH {LEX}, n AS (SELECT doc_id AS item_id, len({WORDS('text')}) AS tokens FROM documents), s AS (SELECT query_id, item_id, rank, tokens, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS c FROM lexi JOIN n USING (item_id))
 SELECT query_id, string_agg(item_id::VARCHAR, ',' ORDER BY rank) AS citations, sum(tokens)::BIGINT AS tokens FROM s WHERE c<=1500 GROUP BY 1""",
)
def r10(spark, sf):
    n = items(spark, sf).select("item_id", F.size(R.tokens(F.col("text"))).alias("tokens"))
    c = R.build_context(lexical(spark, sf), n, 1500)
    return c.select("query_id", F.array_join(F.transform("citations", lambda x: x.cast("string")), ",").alias("citations"), "tokens")


@query(
    "R11_check_citations",
    """WITH a AS (SELECT doc_id AS answer_id, doc_id%50 AS query_id, CASE WHEN doc_id%12=0 THEN -doc_id-1 ELSE doc_id END AS item_id, 5 AS start, CASE WHEN doc_id%7=0 THEN 'zz~zz' ELSE text[6:25] END AS quote FROM documents),
 c AS (SELECT doc_id%50 AS query_id, doc_id AS item_id FROM documents WHERE doc_id%9<>0)
 SELECT answer_id, a.item_id, CASE WHEN d.doc_id IS NULL THEN 'forged' WHEN c.item_id IS NULL THEN 'not_in_context' WHEN d.text[6:5+length(quote)]<>quote THEN 'offset_mismatch' ELSE 'valid' END AS verdict FROM a LEFT JOIN documents d ON d.doc_id=a.item_id LEFT JOIN c ON c.item_id=a.item_id AND c.query_id=a.query_id""",
)
def r11(spark, sf):
    i = F.col("doc_id")
    d = table(spark, sf, "documents")
    cite = F.struct(F.when(i % 12 == 0, -i - 1).otherwise(i).alias("item_id"), F.lit(5).alias("start"), F.when(i % 7 == 0, "zz~zz").otherwise(F.substring("text", 6, 20)).alias("quote"))
    a = d.select(i.alias("answer_id"), (i % 50).alias("query_id"), F.array(cite).alias("cites"))
    c = d.where("doc_id % 9 <> 0").select((i % 50).alias("query_id"), i.alias("item_id"))
    return R.check_citations(a, c, d.select(i.alias("item_id"), "text"))


@query(
    "R12_abstain",
    f"""WITH {LEX}, ok AS (SELECT * FROM lexi WHERE query_id%8<>0), g AS (SELECT query_id, max(score) AS top, max(score) FILTER (rank=2) AS second, count(*) FILTER (score>=40) AS items FROM ok GROUP BY 1),
 r AS (SELECT b.item_id AS query_id, CASE WHEN top IS NULL THEN 'no_evidence' WHEN top<60 THEN 'low_score' WHEN items<3 THEN 'few_items' WHEN top-coalesce(second,0)<1 THEN 'ambiguous' END AS why FROM benchmark b LEFT JOIN g ON g.query_id=b.item_id)
 SELECT query_id, CASE WHEN why IS NULL THEN 'answer' ELSE 'abstain' END AS decision, coalesce(why,'supported') AS reason FROM r""",
)
def r12(spark, sf):
    return R.abstain(lexical(spark, sf).where("query_id % 8 <> 0"), questions(spark, sf), 60.0, 1.0, 3, 40.0)


IRM = """rel AS (SELECT DISTINCT query_id, item_id FROM qrel WHERE NOT (item_id%10=3)), ht AS (SELECT query_id, count(*) AS h, min(rank) AS f, sum(1/log2(rank+1)) AS dcg FROM lexi WHERE rank<=10 AND (query_id,item_id) IN (SELECT (query_id,item_id) FROM rel) GROUP BY 1), nr AS (SELECT query_id, count(*) AS r FROM rel GROUP BY 1),
 irm AS (SELECT query_id, r, round(coalesce(h/r::DOUBLE,0),6) AS recall, round(coalesce(h/10.0::DOUBLE,0),6) AS precision, round(coalesce(1.0::DOUBLE/f,0),6) AS mrr, round(coalesce(dcg,0)/list_sum(list_transform(generate_series(1,least(r,10)), lambda i: 1/log2(i+1))),6) AS ndcg FROM nr LEFT JOIN ht USING (query_id))"""


@query("R13_ir_metrics", f"WITH {LEX}, {QREL}, {IRM} SELECT * FROM irm")
def r13(spark, sf):
    q = qrels(spark, sf)
    return R.ir_metrics(lexical(spark, sf), q, 10, denied=q.where("item_id % 10 = 3"))


@query(
    "R14_answer_metrics",
    """WITH j AS (SELECT CASE WHEN user_id%2=0 THEN 'human' ELSE 'judge' END AS s, value>5 AS a, value>12 AS c, event_type<>'view' AS ci, json_extract_string(props,'$.k')::BIGINT>20 AS su, value>4 AS ab FROM events)
 SELECT s AS label_source, count(*) AS n, round(avg((c AND ci)::INT::DOUBLE) FILTER (a),6) AS cited_accuracy, round(avg((NOT su)::INT::DOUBLE) FILTER (a),6) AS unsupported_rate, round(count(*) FILTER (NOT a AND NOT ab)/count(*) FILTER (NOT a)::DOUBLE,6) AS abstention_precision,
 round(count(*) FILTER (NOT a AND NOT ab)/count(*) FILTER (NOT ab)::DOUBLE,6) AS abstention_recall FROM j GROUP BY 1""",
)
def r14(spark, sf):
    e = table(spark, sf, "events")
    return R.answer_metrics(
        e.select(
            F.when(F.col("user_id") % 2 == 0, "human").otherwise("judge").alias("label_source"), (F.col("value") > 5).alias("answered"), (F.col("value") > 12).alias("correct"), (F.col("event_type") != "view").alias("cited"),
            (F.get_json_object("props", "$.k").cast("bigint") > 20).alias("supported"), (F.col("value") > 4).alias("answerable"),
        )
    )


@query(
    "R15_ablation",
    """WITH r AS (SELECT (['dense','hybrid','lexical'])[event_id%3+1] AS route, event_type AS cls, CASE WHEN user_id%2=0 THEN 'train' ELSE 'test' END AS part, json_extract_string(props,'$.k')::DOUBLE/100 AS metric, value AS lat FROM events),
 g AS (SELECT route, CASE WHEN grouping(cls)=1 THEN '(all)' ELSE cls END AS cls, CASE WHEN grouping(part)=1 THEN '(all)' ELSE part END AS part, count(*) AS n, avg(metric) AS metric, avg(lat) AS latency_ms, sum(lat*2) AS cost FROM r GROUP BY GROUPING SETS ((route,cls,part),(route,cls),(route,part),(route)))
 SELECT g.route, g.cls, g.part, g.n, round(g.metric,6) AS metric, round(g.latency_ms,6) AS latency_ms, round(g.cost,6) AS cost, round(g.metric-b.metric,6) AS delta FROM g JOIN g b ON b.route='lexical' AND b.cls=g.cls AND b.part=g.part""",
)
def r15(spark, sf):
    e = table(spark, sf, "events")
    r = e.select(
        F.element_at(F.array(F.lit("dense"), F.lit("hybrid"), F.lit("lexical")), (F.col("event_id") % 3 + 1).cast("int")).alias("route"), F.col("event_type").alias("cls"), F.when(F.col("user_id") % 2 == 0, "train").otherwise("test").alias("part"),
        F.col("event_id").alias("query_id"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("metric"), F.col("value").alias("latency_ms"), (F.col("value") * 2).alias("cost"),
    )
    return R.ablation(r, "lexical", 50, "ab").drop("low", "high")


@query("R16_build_index", "SELECT count(*) AS chunks, count(*) FILTER (doc_id%40=1) AS missing, count(*) FILTER (doc_id%40=2) AS repeated, count(*) FILTER (doc_id%40=3) AS bad_vectors, 1::BIGINT AS strays, 'incomplete' AS gate_status FROM documents")
def r16(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    v = R.hash_embed(d, "chunk_id", "text", 8, 100000).select("chunk_id", "vector")
    v = v.where("chunk_id % 40 <> 1").withColumn("vector", F.when(F.col("chunk_id") % 40 != 3, F.col("vector")))
    v = v.unionByName(v.where("chunk_id % 40 = 2")).unionByName(v.where("chunk_id = 0").withColumn("chunk_id", F.lit(-1).cast("bigint")))
    return G.build_index(d, v, "v1", 8)[1]


ATT = f"""ev AS (SELECT user_id AS alias, event_id+1 AS seq, event_type='view' AS passing, {H("event_id::VARCHAR||'al'")}%4<>0 AS good FROM events), lv AS (SELECT *, max(CASE WHEN passing AND good THEN seq END) OVER (PARTITION BY alias ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l1 FROM ev),
 at AS (SELECT alias, seq, passing, CASE WHEN passing AND NOT good THEN 0 ELSE coalesce(l1,0) END AS expected FROM lv)"""


@query(
    "R17_alias_history",
    f"""WITH RECURSIVE {ATT.replace(' at AS (', ' att AS (')}, won AS (SELECT alias, expected, min(seq) AS seq FROM att WHERE passing AND seq>expected GROUP BY 1,2), ch AS (SELECT alias, seq AS version, expected AS previous, 1::BIGINT AS activation FROM won WHERE expected=0 UNION ALL SELECT w.alias, w.seq, w.expected, c.activation+1 FROM ch c JOIN won w ON w.alias=c.alias AND w.expected=c.version)
 SELECT alias, activation, version, previous FROM ch""",
)
def r17(spark, sf):
    from sievework.functions.scan import running

    e = table(spark, sf, "events")
    ok, good = F.col("event_type") == "view", h32("event_id", F.lit("al")) % 4 != 0
    ev = e.select(F.col("user_id").alias("alias"), (F.col("event_id") + 1).alias("seq"), ok.alias("passing"), good.alias("good"))
    ev = running(ev, ["alias"], ["seq"], F.floor(F.col("seq") / 65536), inclusive=False, l1=("max", F.when(F.col("passing") & F.col("good"), F.col("seq"))))
    at = ev.select("alias", "seq", "passing", F.when(F.col("passing") & ~F.col("good"), 0).otherwise(F.coalesce("l1", F.lit(0))).cast("bigint").alias("expected"))
    return G.alias_history(at, 0)


@query(
    "R18_incremental_index",
    D.with_(D.VERSIONS)
    + """, ch AS (SELECT coalesce(a.doc_id,b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'delete' ELSE 'put' END AS kind FROM v1 a FULL JOIN v2 b ON a.doc_id=b.doc_id WHERE a.text IS DISTINCT FROM b.text)
 SELECT doc_id, md5(text) AS body FROM v2 WHERE doc_id IN (SELECT doc_id FROM ch) UNION ALL SELECT doc_id, md5(text) FROM v1 WHERE doc_id NOT IN (SELECT doc_id FROM ch)""",
)
def r18(spark, sf):
    from sievework.sources.tables import source_changes

    a, b = D.doc_versions(spark, sf)
    ix = lambda d: d.select("doc_id", F.md5("text").alias("body"))
    ch = source_changes(ix(a), ix(b), "doc_id", "body").where("status <> 'unchanged'")
    ch = ch.select("doc_id", F.when(F.col("status") == "deleted", "delete").otherwise("put").alias("kind"), F.col("doc_id").alias("sequence"))
    return G.incremental_index(ix(a), ch, ix(b))[0]


@query(
    "R18_stored_index",
    D.with_(D.VERSIONS)
    + """, ch AS (SELECT coalesce(a.doc_id,b.doc_id) AS doc_id FROM v1 a FULL JOIN v2 b ON a.doc_id=b.doc_id WHERE a.text IS DISTINCT FROM b.text)
 SELECT doc_id, md5(text) AS body FROM v2 WHERE doc_id IN (SELECT doc_id FROM ch) UNION ALL SELECT doc_id, md5(text) FROM v1 WHERE doc_id NOT IN (SELECT doc_id FROM ch)""",
)
def r18b(spark, sf):
    """The first version, then the changes as one delta, the delta once more."""
    from sievework.sources.tables import source_changes

    a, b = D.doc_versions(spark, sf)
    ix = lambda d: d.select("doc_id", F.md5("text").alias("body"))
    table_ = G.index_table(scratch_path(spark, "index"), "body string")
    G.update_index(table_, a.select("doc_id", F.lit("put").alias("kind"), F.lit(0).cast("bigint").alias("sequence")), ix(a), 0)
    ch = source_changes(ix(a), ix(b), "doc_id", "body").where("status <> 'unchanged'")
    ch = ch.select("doc_id", F.when(F.col("status") == "deleted", "delete").otherwise("put").alias("kind"), (F.col("doc_id") + 1).alias("sequence"))
    for _ in range(2):
        G.update_index(table_, ch, ix(b), 1)
    return G.read_index(spark, table_)


@query(
    "R19_apply_tombstones",
    """WITH t AS (SELECT doc_id, min(d) AS d FROM (SELECT doc_id, DATE '2024-01-01'+(doc_id%30)::INT AS d FROM documents WHERE doc_id%8=0 UNION ALL SELECT doc_id, DATE '2024-02-01' FROM documents WHERE doc_id%12=0) GROUP BY 1)
 SELECT doc_id, strftime(d+30,'%Y-%m-%d') AS purge_after, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM t)) AS readable FROM t""",
)
def r19(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    old = d.where("doc_id % 8 = 0").select("doc_id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("deleted_at"))
    new = d.where("doc_id % 12 = 0").select("doc_id", F.lit("2024-02-01").cast("date").alias("deleted_at"))
    left, t = G.apply_tombstones(d, old, new.unionByName(new), 30)
    return t.select("doc_id", F.date_format("purge_after", "yyyy-MM-dd").alias("purge_after")).withColumn("readable", left.agg(F.count(F.lit(1))).scalar())


@query(
    "R20_pending_reembed",
    """SELECT vec_id, (row_number() OVER (ORDER BY vec_id)-1)//64 AS batch, round(len(embedding)*0.5::DOUBLE+label,6) AS cost FROM embeddings WHERE vec_id%3<>0""",
)
def r20(spark, sf):
    e = table(spark, sf, "embeddings")
    done = e.where("vec_id % 3 = 0").select("vec_id", F.lit("r2").alias("revision")).unionByName(e.where("vec_id % 5 = 0").select("vec_id", F.lit("r1").alias("revision")))
    return G.pending_reembed(e, done, "vec_id", "r2", 64, F.floor(F.col("vec_id") / 256), F.round(F.size("embedding") * 0.5 + F.col("label"), 6))


CACHE = f"""en AS (SELECT event_id AS entry_id, user_id%5 AS tenant, event_type||' '||(user_id%7) AS request, CASE WHEN {H("event_id::VARCHAR||'cv'")}%6=0 THEN 1 ELSE 2 END AS iv, CASE WHEN event_id%31=0 THEN 9 ELSE user_id%5 END AS owner, event_id%200 AS doc_id FROM events),
 au AS (SELECT entry_id, tenant, md5(tenant||'|'||lower(request)||'|1|1|'||iv||'|3') AS cache_key, CASE WHEN owner<>tenant THEN 'cross_tenant' WHEN doc_id%50=7 THEN 'deleted_reference' WHEN iv<>2 THEN 'stale' ELSE 'fresh' END AS status FROM en)"""


@query("R21_cache_audit", f"WITH {CACHE}, f AS (SELECT cache_key, min(entry_id) AS f FROM au GROUP BY 1) SELECT status, count(*) AS n, count(*) FILTER (entry_id<>f AND status='fresh') AS hits, count(*) FILTER (NOT (entry_id<>f AND status='fresh')) AS misses FROM au JOIN f USING (cache_key) GROUP BY 1")
def r21(spark, sf):
    e = table(spark, sf, "events")
    one = F.lit(1)
    en = e.select(
        F.col("event_id").alias("entry_id"), (F.col("user_id") % 5).alias("tenant"), F.concat_ws(" ", F.upper("event_type"), (F.col("user_id") % 7).cast("string")).alias("request"), one.alias("model_v"), one.alias("prompt_v"),
        F.when(h32("event_id", F.lit("cv")) % 6 == 0, 1).otherwise(2).alias("index_v"), F.lit(3).alias("acl_v"), F.when(F.col("event_id") % 31 == 0, 9).otherwise(F.col("user_id") % 5).alias("owner_tenant"), (F.col("event_id") % 200).alias("doc_id"),
    )
    cur = en.select("tenant", one.alias("model_v"), one.alias("prompt_v"), F.lit(2).alias("index_v"), F.lit(3).alias("acl_v")).distinct()
    gone = table(spark, sf, "documents").where("doc_id % 50 = 7").select("doc_id")
    return G.cache_hits(G.cache_audit(en, cur, gone))


@query(
    "R22_feedback_lineage",
    """WITH f AS (SELECT event_id, event_id-1-event_id%5 AS trace_id, user_id%3 AS caller, value AS rating FROM events WHERE event_type='click'), t AS (SELECT event_id AS trace_id, user_id%3 AS owner, 'ix'||user_id%4 AS iv FROM events WHERE event_id%9<>0)
 SELECT event_id AS feedback_id, trace_id, rating, iv AS index_v FROM f JOIN t USING (trace_id) WHERE owner=caller""",
)
def r22(spark, sf):
    e = table(spark, sf, "events")
    i = F.col("event_id")
    fb = e.where("event_type = 'click'").select(i.alias("feedback_id"), (i - 1 - i % 5).alias("trace_id"), (F.col("user_id") % 3).alias("caller"), F.col("value").alias("rating"), F.lit("open").alias("reviewer_state"))
    tr = e.where("event_id % 9 <> 0").select(i.alias("trace_id"), (F.col("user_id") % 3).alias("owner"), F.concat(F.lit("ix"), (F.col("user_id") % 4).cast("string")).alias("index_v"), F.lit("p1").alias("prompt_v"), F.lit("m1").alias("model_v"))
    return G.feedback_lineage(fb, tr)[0].select("feedback_id", "trace_id", "rating", "index_v")


def _nv(i):
    a = f"'w|v{i}|'||doc_id||"
    return f"sqrt(-2.0::DOUBLE*ln({U(a + chr(39) + '|u1' + chr(39))}))*cos(6.283185307179586::DOUBLE*{U(a + chr(39) + '|u2' + chr(39))})"


@query(
    "R23_generate_workload",
    f"""WITH v AS (SELECT doc_id, [{_nv(0)},{_nv(1)},{_nv(2)}] AS v FROM documents) SELECT doc_id, 'g'||({H("'w|g|'||doc_id")}%4) AS grp, round(v[1]/sqrt(list_sum(list_transform(v, lambda x: x*x))),6) AS v0, 'w'||({H("'w|t|'||doc_id||'|1'")}%1000) AS first_query, array_to_string(list_transform(generate_series(1,6), lambda i: 'w'||({H("'w|t|'||doc_id||'|'||i")}%1000)),' ') AS text FROM v""",
)
def r23(spark, sf):
    w = G.generate_workload(table(spark, sf, "documents"), "doc_id", "w", 3, 4, 6, 2)
    return w.select("doc_id", "grp", F.round(F.col("vector")[0], 6).alias("v0"), F.col("queries")[0].alias("first_query"), "text")


def mentions(spark, sf):
    """E-mail addresses of documents, each also seen with one letter lost."""
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([a-z]+\.\d+@mail\d\.example\.com)"), F.lit(1)))).alias("mail"))
    name, host = F.regexp_extract("mail", r"^([a-z]+)\.", 1), F.regexp_extract("mail", r"@(.*)$", 1)
    v = d.select("doc_id", "mail", F.inline(F.array(F.struct(F.lit(0).alias("v"), name.alias("name"), F.col("mail").alias("strong_id")), F.struct(F.lit(1).alias("v"), name.alias("name"), F.lit(None).cast("string").alias("strong_id")))), host.alias("block"))
    v = v.withColumn("name", F.when(F.col("v") == 1, F.concat(F.substring("name", 1, 3), F.expr("substring(name, 5)"))).otherwise(F.col("name")))
    return v.select(F.concat_ws("/", "doc_id", "mail", "v").alias("mention_id"), "name", "block", "strong_id", F.col("mail").alias("true_entity"))


@query(
    "R24_resolve_entities",
    r"""WITH RECURSIVE e AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text,'([a-z]+\.\d+@mail\d\.example\.com)'))) AS mail FROM documents),
 p AS (SELECT *, regexp_extract(mail,'^([a-z]+)\.',1) AS name, regexp_extract(mail,'@(.*)$',1) AS block FROM e),
 m AS (SELECT doc_id||'/'||mail||'/0' AS mention_id, name, block, mail AS strong_id FROM p UNION ALL SELECT doc_id||'/'||mail||'/1', substr(name,1,3)||substr(name,5), block, NULL FROM p),
 r AS (SELECT min(mention_id) AS id, name, block, strong_id FROM m GROUP BY ALL),
 l AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.id<>b.id AND (a.strong_id=b.strong_id OR (a.block=b.block AND (a.strong_id=b.strong_id OR a.strong_id IS NULL OR b.strong_id IS NULL)
  AND levenshtein(a.name,b.name)/greatest(len(a.name),len(b.name),1)::DOUBLE <= 0.25))),
 c(id, other) AS (SELECT id, id FROM r UNION SELECT c.id, l.b FROM c JOIN l ON c.other=l.a), k AS (SELECT id, min(other) AS comp FROM c GROUP BY 1),
 t AS (SELECT mention_id, m.strong_id, comp FROM m JOIN r ON m.name=r.name AND m.block=r.block AND m.strong_id IS NOT DISTINCT FROM r.strong_id JOIN k USING (id)),
 n AS (SELECT comp, count(DISTINCT strong_id) AS ids FROM t GROUP BY 1)
 SELECT mention_id, CASE WHEN ids>1 AND strong_id IS NOT NULL THEN 's:'||strong_id WHEN ids>1 THEN 'w:'||comp ELSE 'c:'||comp END AS entity,
  CASE WHEN strong_id IS NOT NULL THEN 'strong_id' WHEN ids>1 THEN 'ambiguous_name' ELSE 'name' END AS evidence,
  CASE WHEN strong_id IS NOT NULL THEN 1.0 WHEN ids>1 THEN 0.3 ELSE 0.8 END::DOUBLE AS confidence FROM t JOIN n USING (comp)""",
)
def r24(spark, sf):
    return G.resolve_entities(mentions(spark, sf), 0.25)


@query(
    "R25_resolution_metrics",
    f"""WITH p AS (SELECT doc_id, md5({SQ('text')}) AS e, source||'-'||lang AS t FROM documents), c AS (SELECT e, t, count(*) AS n FROM p GROUP BY 1,2), tp AS (SELECT sum(n*(n-1)/2.0::DOUBLE) AS tp FROM c), pe AS (SELECT sum(n*(n-1)/2.0::DOUBLE) AS pp, count(*) FILTER (k>1) AS me FROM (SELECT sum(n) AS n, count(*) AS k FROM c GROUP BY e)), te AS (SELECT sum(n*(n-1)/2.0::DOUBLE) AS tt, count(*) FILTER (k>1) AS se FROM (SELECT sum(n) AS n, count(*) AS k FROM c GROUP BY t))
 SELECT round(tp/pp,6) AS precision, round(tp/tt,6) AS recall, me AS merge_errors, se AS split_errors FROM tp, pe, te""",
)
def r25(spark, sf):
    d = table(spark, sf, "documents")
    return G.resolution_metrics(d.select("doc_id", F.md5(T.squeeze(F.col("text"))).alias("entity")), d.select("doc_id", F.concat_ws("-", "source", "lang").alias("true_entity")), "doc_id")


@query(
    "R26_k_hop",
    f"""WITH RECURSIVE {LINEAGE}, ok AS (SELECT DISTINCT src, dst FROM edges WHERE {H('src')}%5<>0), h1 AS (SELECT 'n'||n_nationkey AS seed, dst AS node, min('n'||n_nationkey||'>'||dst) AS path FROM nation JOIN ok ON src='n'||n_nationkey WHERE n_nationkey<6 GROUP BY 1,2),
 h2 AS (SELECT seed, dst AS node, min(path||'>'||dst) AS path FROM h1 JOIN ok ON src=node WHERE (seed,dst) NOT IN (SELECT (seed,node) FROM h1) AND dst<>seed GROUP BY 1,2)
 SELECT seed, node, 1 AS depth, path FROM h1 UNION ALL SELECT seed, node, 2, path FROM h2""",
)
def r26(spark, sf):
    e = lineage_edges(spark, sf).withColumn("grp", h32("src") % 5)
    seeds = table(spark, sf, "nation").where("n_nationkey < 6").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("seed"))
    return G.k_hop(e, seeds, 2, e.where("grp = 0").select("grp").distinct())


@query(
    "R27_graph_diff",
    """WITH a AS (SELECT l_suppkey AS s, l_partkey AS d, count(*) AS w FROM lineitem WHERE l_orderkey%10<>0 GROUP BY 1,2), b AS (SELECT l_suppkey AS s, l_partkey AS d, count(*) AS w FROM lineitem WHERE l_orderkey%11<>0 GROUP BY 1,2)
 SELECT CASE WHEN a.s IS NULL THEN 'added' WHEN b.s IS NULL THEN 'removed' WHEN a.w<>b.w THEN 'changed' ELSE 'same' END AS change, count(*) AS n FROM a FULL JOIN b ON a.s=b.s AND a.d=b.d GROUP BY 1""",
)
def r27(spark, sf):
    # Dealt once by the edges' ends, to tasks of a size that does not grow.
    li = dealt(table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey"), ["l_suppkey", "l_partkey"])
    g = lambda m: li.where(f"l_orderkey % {m} <> 0").groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("d")).agg(F.count(F.lit(1)).alias("w"))
    return G.graph_diff(g(10), g(11), ["s", "d"])


@query(
    "R28_facts_as_of",
    D.with_(D.FACTS)
    + """ SELECT subject, predicate, value, fact_id FROM facts WHERE observed<=DATE '1998-02-01' AND valid_from<=DATE '1998-01-20' AND valid_to>DATE '1998-01-20' QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY observed DESC, fact_id DESC)=1""",
)
def r28(spark, sf):
    return G.facts_as_of(D.facts(spark, sf), F.lit("1998-01-20").cast("date"), F.lit("1998-02-01").cast("date")).drop("observed")


@query(
    "R29_fact_conflicts",
    D.with_(D.FACTS)
    + """ SELECT a.subject, a.fact_id, a.value, strftime(min(greatest(a.valid_from,b.valid_from)),'%Y-%m-%d') AS conflict_from FROM facts a JOIN facts b ON a.subject=b.subject AND a.predicate=b.predicate AND a.value<>b.value AND a.valid_from<b.valid_to AND b.valid_from<a.valid_to GROUP BY 1,2,3""",
)
def r29(spark, sf):
    return G.fact_conflicts(D.facts(spark, sf)).select("subject", "fact_id", "value", F.date_format("conflict_from", "yyyy-MM-dd").alias("conflict_from"))


@query("R30_structured_query", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice),2) AS total FROM orders WHERE o_orderpriority IN ('1-URGENT','2-HIGH') AND o_totalprice>=1000 GROUP BY 1 ORDER BY 1 LIMIT 10")
def r30(spark, sf):
    tabs = {"orders": (table(spark, sf, "orders"), ["o_orderstatus", "o_totalprice", "o_orderpriority"])}
    spec = {
        "table": "orders", "where": [("o_orderpriority", "in", ["1-URGENT", "2-HIGH"]), ("o_totalprice", ">=", 1000)], "group": ["o_orderstatus"],
        "measures": {"n": ("count", None), "total": ("sum", "o_totalprice")}, "order": ["o_orderstatus"], "limit": 10,
    }
    return G.structured_query(tabs, spec, 100).withColumn("total", F.round("total", 2))


@query(
    "X11_nearest_copies",
    """WITH s AS (SELECT vec_id, CASE WHEN vec_id%6=0 THEN embedding ELSE list_transform(embedding, lambda x, i: x*(1+(vec_id+i)%5)) END AS v FROM embeddings WHERE vec_id%3=0), t AS (SELECT vec_id, embedding AS v FROM embeddings WHERE vec_id%3<>1), h AS (SELECT vec_id, embedding AS v FROM embeddings WHERE vec_id%3=1),
 a AS (SELECT s.vec_id, round(1-max(round(list_cosine_similarity(s.v::DOUBLE[],t.v::DOUBLE[]),6)),6) AS d FROM s, t GROUP BY 1), b AS (SELECT s.vec_id, round(1-max(round(list_cosine_similarity(s.v::DOUBLE[],h.v::DOUBLE[]),6)),6) AS d FROM s, h GROUP BY 1)
 SELECT vec_id, a.d AS train_distance, b.d AS held_distance, a.d<=0.000001 AS exact_copy, a.d<b.d AS nearer_train FROM a JOIN b USING (vec_id)""",
)
def x11(spark, sf):
    from sievework.operators.privacy import nearest_copies

    e = table(spark, sf, "embeddings")
    warp = F.transform("embedding", lambda x, i: x * (1 + (F.col("vec_id") + i + 1) % 5).cast("float"))
    syn = e.where("vec_id % 3 = 0").select("vec_id", F.when(F.col("vec_id") % 6 == 0, F.col("embedding")).otherwise(warp).alias("vector"))
    real = lambda cond: e.where(cond).select("vec_id", F.col("embedding").alias("vector"))
    return nearest_copies(syn, real("vec_id % 3 <> 1"), real("vec_id % 3 = 1"), "vec_id", "vector")[0]


