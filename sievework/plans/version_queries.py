"""Queries over digests, versions, lineage and catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sievework.operators import quality as Q, versions as V
from sievework.plans import derive as D
from sievework.plans.registry import query
from sievework.plans.source_queries import DIGEST_SQL, digest_rows_sql
from sievework.session import scratch_path, table

V1_TABLES = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_shipdate"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "events": ["event_id", "user_id", "event_type", "value", "props"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
}


@query(
    "V1_dataset_checksum",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, * FROM ({DIGEST_SQL} FROM ({digest_rows_sql(t, c)}))" for t, c in V1_TABLES.items()),
)
def v1(spark, sf):
    parts = [V.dataset_checksum(table(spark, sf, t), c).withColumn("table_name", F.lit(t)) for t, c in V1_TABLES.items()]
    return reduce(DataFrame.unionByName, parts).select("table_name", "rows", "sum_a", "sum_b", "xor_c")


@query(
    "V2_curate",
    """SELECT cust, order_id, status, priority FROM (SELECT o_custkey AS cust, o_orderkey::INT AS order_id, coalesce(list_position(['F','O','P'], o_orderstatus),0)::INT-1 AS status, trim(o_orderpriority) AS priority,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn=1""",
)
def v2(spark, sf):
    o = table(spark, sf, "orders").drop("o_totalprice")
    out = V.curate(
        o, ["o_custkey"], ["o_orderdate", "o_orderkey"],
        {"o_custkey": "cust", "o_orderkey": "order_id", "o_orderstatus": "status", "o_orderpriority": "priority"},
        {"o_orderkey": "int"}, ["o_orderpriority"], {"o_orderstatus": ["F", "O", "P"]},
    )
    return out.select("cust", "order_id", "status", "priority")


@query(
    "V3_commit_version",
    D.with_(D.VERSIONS)
    + """ SELECT 'documents' AS name, 1::BIGINT AS version, count(*) AS rows, 'a' AS committed_at FROM v1 UNION ALL SELECT 'documents', 2, count(*), 'c' FROM v2""",
)
def v3(spark, sf):
    a, b = D.doc_versions(spark, sf)
    ledger = scratch_path(spark, "ledger")
    gate = lambda d: Q.quality_gate(Q.quality_report(d, {"not_null": ["doc_id", "text"], "unique": ["doc_id"]}))
    broken = a.unionByName(a.where("doc_id % 3 = 0"))
    for frame, at in ((a, "a"), (a, "b"), (b, "c"), (broken, "d")):
        V.commit_version(frame, "documents", scratch_path(spark, "documents"), ledger, gate, at)
    return V.read_ledger(spark, ledger).select("name", "version", "rows", "committed_at")


@query(
    "V4_read_as_of",
    """SELECT 'ds-'||user_id AS name, max(event_id) AS version, 'v/'||max(event_id) AS path FROM events WHERE event_type='purchase' AND ts <= TIMESTAMP '2024-01-15' GROUP BY 1""",
)
def v4(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'purchase'")
    ledger = e.select(
        F.concat(F.lit("ds-"), F.col("user_id").cast("string")).alias("name"), F.col("event_id").cast("string").alias("version"),
        F.concat(F.lit("v/"), F.col("event_id").cast("string")).alias("path"), F.col("ts").alias("committed_at"),
    )
    return V.resolve_as_of(ledger, F.lit("2024-01-15").cast("timestamp_ntz"))


@query(
    "V5_diff_versions",
    D.with_(D.VERSIONS)
    + """, j AS (SELECT a.doc_id AS ka, b.doc_id AS kb, a.text IS DISTINCT FROM b.text AS ct FROM v1 a FULL JOIN v2 b ON a.doc_id=b.doc_id),
 t AS (SELECT 'rows_'||CASE WHEN ka IS NULL THEN 'added' WHEN kb IS NULL THEN 'removed' WHEN ct THEN 'changed' ELSE 'same' END AS item FROM j UNION ALL SELECT 'column_text' FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND ct)
 SELECT item, count(*) AS n FROM t GROUP BY 1""",
)
def v5(spark, sf):
    a, b = D.doc_versions(spark, sf)
    return V.diff_versions(a, b, ["doc_id"])


@query(
    "V6_restore_check",
    f"""WITH r AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey%97=0 THEN 0.5 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey%100<>3),
 cmp AS (SELECT c.c_custkey AS k, r.c_custkey AS rk, c.c_acctbal IS DISTINCT FROM r.c_acctbal AS ch FROM customer c LEFT JOIN r USING (c_custkey))
 SELECT count(*) FILTER (rk IS NULL) AS missing, 0::BIGINT AS extra, count(*) FILTER (rk IS NOT NULL AND ch) AS changed, count(*) AS backup_rows, count(rk) AS restored_rows, false AS identical,
 (SELECT max(c_custkey) - max(c_custkey) FILTER (c_custkey%100=3) FROM customer)*86400::DOUBLE AS rpo_seconds FROM cmp""",
)
def v6(spark, sf):
    c = table(spark, sf, "customer").withColumn("at", F.timestamp_seconds(F.col("c_custkey") * 86400))
    r = c.where("c_custkey % 100 <> 3").withColumn("c_acctbal", F.when(F.col("c_custkey") % 97 == 0, 0.5).otherwise(F.col("c_acctbal")))
    return V.restore_check(c, r, ["c_custkey"], "at").drop("backup_digest", "restored_digest")


@query(
    "V7_build_manifests",
    """WITH a AS (SELECT l_orderkey AS run_id, CASE WHEN l_linenumber=1 THEN 'input' ELSE 'output' END AS role, 'p/'||l_partkey||'/'||l_linenumber||'/'||l_suppkey AS uri, md5(l_partkey::VARCHAR) AS checksum FROM lineitem),
 g AS (SELECT run_id, string_agg(uri||'#'||checksum, ',' ORDER BY uri, checksum) FILTER (role='input') AS i, string_agg(uri||'#'||checksum, ',' ORDER BY uri, checksum) FILTER (role='output') AS o FROM a GROUP BY 1)
 SELECT o_orderkey AS run_id, 0::INT AS part, 1::INT AS parts, o_orderpriority AS name, CASE WHEN o_totalprice>=100000 THEN 'allow' ELSE 'deny' END AS decision, coalesce(i,'') AS inputs, coalesce(o,'') AS outputs,
  'customer='||o_custkey||',status='||o_orderstatus AS params, o_totalprice AS total FROM orders LEFT JOIN g ON o_orderkey=run_id""",
)
def v7(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    runs = o.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderdate").alias("started_at"),
        F.when(F.col("o_totalprice") >= 100000, "allow").otherwise("deny").alias("decision"),
    )
    arts = li.select(
        F.col("l_orderkey").alias("run_id"), F.when(F.col("l_linenumber") == 1, "input").otherwise("output").alias("role"),
        F.concat_ws("/", F.lit("p"), "l_partkey", "l_linenumber", "l_suppkey").alias("uri"), F.md5(F.col("l_partkey").cast("string")).alias("checksum"),
    )
    pars = o.select(F.col("o_orderkey").alias("run_id"), F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("string").alias("value")) for n, c in (("customer", "o_custkey"), ("status", "o_orderstatus"))])))
    mets = o.select(F.col("o_orderkey").alias("run_id"), F.lit("total").alias("metric"), F.col("o_totalprice").alias("value"))
    shown = lambda c, a, b, mark: F.array_join(F.transform(c, lambda x: F.concat(x[a], F.lit(mark), x[b])), ",").alias(c)
    return V.build_manifests(runs, arts, pars, mets).select(
        "run_id", "part", "parts", "name", "decision", shown("inputs", "uri", "checksum", "#"), shown("outputs", "uri", "checksum", "#"), shown("params", "name", "value", "="), F.col("metrics")[0]["value"].alias("total")
    )


@query(
    "V8_lineage_pairs",
    """WITH e AS (SELECT user_id||'/'||strftime(ts,'%Y-%m-%d') AS run_id, CASE event_type WHEN 'view' THEN 'START' WHEN 'purchase' THEN 'COMPLETE' WHEN 'error' THEN 'FAIL' ELSE 'OTHER' END AS kind, ts FROM events)
 SELECT run_id, count(*) FILTER (kind='START') AS starts, count(*) FILTER (kind='COMPLETE') AS completes, count(*) FILTER (kind='FAIL') AS fails,
 count(*) FILTER (kind='START')>0 AND count(*) FILTER (kind IN ('COMPLETE','FAIL'))=0 AS open, count(*) FILTER (kind IN ('COMPLETE','FAIL'))>1 AS double_terminal, count(*) FILTER (kind='START')=0 AS no_start,
 round((epoch_us(max(ts) FILTER (kind IN ('COMPLETE','FAIL'))))/1e6 - (epoch_us(min(ts) FILTER (kind='START')))/1e6, 3) AS duration_s FROM e GROUP BY 1""",
)
def v8(spark, sf):
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "view", "START").when(F.col("event_type") == "purchase", "COMPLETE").when(F.col("event_type") == "error", "FAIL").otherwise("OTHER")
    return V.lineage_pairs(
        e.select(F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("run_id"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("at"))
    )


LINEAGE = """edges AS (SELECT 'r'||n_regionkey AS src, 'n'||n_nationkey AS dst FROM nation UNION SELECT 'n'||s_nationkey, 's'||s_suppkey FROM supplier UNION SELECT 's'||l_suppkey, 'p'||l_partkey FROM lineitem
 UNION SELECT 'p'||p_partkey, 'r0' FROM part WHERE p_partkey%500=0)"""


def lineage_edges(spark, sf):
    node = lambda tag, c: F.concat(F.lit(tag), F.col(c).cast("string"))
    n, s, li, p = (table(spark, sf, t) for t in ("nation", "supplier", "lineitem", "part"))
    return (
        n.select(node("r", "n_regionkey").alias("src"), node("n", "n_nationkey").alias("dst"))
        .union(s.select(node("n", "s_nationkey"), node("s", "s_suppkey")))
        .union(li.select(node("s", "l_suppkey"), node("p", "l_partkey")))
        .union(p.where("p_partkey % 500 = 0").select(node("p", "p_partkey"), F.lit("r0")))
    )


@query(
    "V9_lineage_trace",
    f"""WITH RECURSIVE {LINEAGE}, t AS (SELECT 'n'||n_nationkey AS start, 'n'||n_nationkey AS node, 0 AS depth FROM nation WHERE n_regionkey=1
 UNION SELECT start, dst, depth+1 FROM t JOIN edges ON node=src WHERE depth<4) SELECT start, node, min(depth)::INT AS depth FROM t GROUP BY 1,2 HAVING min(depth)>0""",
)
def v9(spark, sf):
    starts = table(spark, sf, "nation").where("n_regionkey = 1").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("start"))
    return V.lineage_trace(lineage_edges(spark, sf), starts, "downstream", 4)


@query(
    "V10_orphan_outputs",
    """WITH a AS (SELECT 'l'||l_orderkey||'-'||l_linenumber||'-'||l_partkey AS asset, 'output' AS role, l_orderkey AS run_id FROM lineitem UNION ALL SELECT 'l'||o_orderkey||'-1-'||(o_custkey%500), 'input', o_orderkey FROM orders)
 SELECT asset, 'no_run' AS problem FROM a WHERE role='output' AND run_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey%50<>0)
 UNION ALL SELECT DISTINCT asset, 'no_producer' FROM a WHERE role='input' AND asset NOT IN (SELECT asset FROM a WHERE role='output') AND asset NOT IN (SELECT 'l'||o_orderkey||'-1-'||(o_custkey%500) FROM orders WHERE o_orderstatus='F')""",
)
def v10(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    name = lambda *c: F.concat(F.lit("l"), F.concat_ws("-", *[x.cast("string") for x in c])).alias("asset")
    given = name(F.col("o_orderkey"), F.lit(1), F.col("o_custkey") % 500)
    arts = li.select(name(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")), F.lit("output").alias("role"), F.col("l_orderkey").alias("run_id"))
    arts = arts.union(o.select(given, F.lit("input"), F.col("o_orderkey")))
    runs = o.where("o_orderkey % 50 <> 0").select(F.col("o_orderkey").alias("run_id"))
    return V.orphan_outputs(arts, runs, o.where("o_orderstatus = 'F'").select(given))


@query(
    "V11_dependency_audit",
    """WITH RECURSIVE nodes AS (SELECT CASE WHEN o_orderkey%701=5 THEN 'N'||(o_orderkey-1) WHEN o_orderkey%809=3 THEN 'bad '||o_orderkey ELSE 'N'||o_orderkey END AS id, o_custkey%50 AS grp, o_orderkey//50+1 AS number,
  CASE WHEN o_orderkey%10=0 THEN 'choose:'||(o_orderkey//25) END AS route, o_orderkey AS k FROM orders),
 edges AS (SELECT 'N'||o_orderkey AS id, CASE WHEN o_orderkey%997=1 THEN 'N-'||o_orderkey ELSE 'N'||(o_orderkey//10) END AS needs FROM orders UNION ALL SELECT 'N'||(o_orderkey//10), 'N'||o_orderkey FROM orders WHERE o_orderkey%1000=117
  UNION ALL SELECT 'N'||o_orderkey, 'choose:'||(o_orderkey*10//25) FROM orders WHERE o_orderkey%1000=214),
 rc AS (SELECT route, count(*) AS n FROM nodes WHERE route IS NOT NULL GROUP BY 1),
 ee AS (SELECT DISTINCT id, needs FROM (SELECT id, needs FROM edges WHERE needs IN (SELECT id FROM nodes) UNION ALL SELECT e.id, n.id FROM edges e JOIN nodes n ON n.route=e.needs) WHERE id<>needs),
 cl AS (SELECT id AS a, needs AS b FROM ee UNION SELECT a, needs FROM cl JOIN ee ON b=id),
 cyc AS (SELECT a FROM cl WHERE a=b)
 SELECT 'duplicate_id' AS rule, id AS subject FROM nodes GROUP BY id HAVING count(*)>1
 UNION ALL SELECT 'malformed_id', id FROM nodes WHERE NOT regexp_matches(id,'^N[0-9]+$')
 UNION ALL SELECT 'self_dependency', id FROM edges WHERE id=needs
 UNION ALL SELECT 'unknown_dependency', id FROM edges WHERE needs NOT IN (SELECT id FROM nodes UNION SELECT route FROM rc)
 UNION ALL SELECT 'small_route_group', route FROM rc WHERE n<2
 UNION ALL SELECT 'numbering_gap', g.grp||'/'||g.i FROM (SELECT grp, unnest(generate_series(1, max(number))) AS i FROM nodes GROUP BY grp) g WHERE (g.grp, g.i) NOT IN (SELECT (grp, number) FROM nodes)
 UNION ALL SELECT DISTINCT 'cycle', a FROM cyc""",
)
def v11(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    text = lambda tag, c: F.concat(F.lit(tag), c.cast("string"))
    tenth = F.floor(k / 10).cast("bigint")
    nodes = o.select(
        F.when(k % 701 == 5, text("N", k - 1)).when(k % 809 == 3, text("bad ", k)).otherwise(text("N", k)).alias("id"),
        (F.col("o_custkey") % 50).alias("grp"), (F.floor(k / 50) + 1).alias("number"),
        F.when(k % 10 == 0, text("choose:", F.floor(k / 25).cast("bigint"))).alias("route"),
    )
    edges = o.select(text("N", k).alias("id"), F.when(k % 997 == 1, text("N-", k)).otherwise(text("N", tenth)).alias("needs")).union(
        o.where("o_orderkey % 1000 = 117").select(text("N", tenth), text("N", k))
    ).union(o.where("o_orderkey % 1000 = 214").select(text("N", k), text("choose:", F.floor(k * 10 / 25).cast("bigint"))))
    return V.dependency_audit(nodes, edges, "^N[0-9]+$")


@query(
    "V12_catalog_search",
    """SELECT p_partkey AS asset_id, p_name AS name, q.s AS quality_status, strftime(l.at,'%Y-%m-%d') AS last_lineage FROM part
 LEFT JOIN (SELECT l_partkey AS k, arg_max(l_linestatus, strftime(l_shipdate,'%Y-%m-%d')||lpad(l_orderkey::VARCHAR,12,'0')||l_linenumber) AS s FROM lineitem GROUP BY 1) q ON q.k=p_partkey
 LEFT JOIN (SELECT l_partkey AS k, max(o_orderdate) AS at FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1) l ON l.k=p_partkey WHERE contains(p_name,'ring') AND p_brand='Brand#2'""",
)
def v12(spark, sf):
    p, li, o = table(spark, sf, "part"), table(spark, sf, "lineitem"), table(spark, sf, "orders")
    assets = p.select(F.col("p_partkey").alias("asset_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("owner"))
    check = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.col("l_linenumber").cast("string"))
    quality = li.select(F.col("l_partkey").alias("asset_id"), F.col("l_linestatus").alias("status"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("at"), check.alias("check_id"))
    lineage = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("asset_id"), F.col("o_orderdate").alias("at"))
    return V.catalog_search(assets, quality, lineage, "RING", "Brand#2").select("asset_id", "name", "quality_status", F.date_format("last_lineage", "yyyy-MM-dd").alias("last_lineage"))


@query(
    "V13_retention_plan",
    """WITH a AS (SELECT o_orderkey AS asset_id, o_orderstatus AS class, o_orderdate::DATE AS created, o_orderkey%17=0 AS hold, o_orderkey%19=0 AS req FROM orders),
 d AS (SELECT *, created + CASE class WHEN 'F' THEN 365 WHEN 'O' THEN 900 END AS due FROM a)
 SELECT asset_id, CASE WHEN hold THEN 'held' WHEN req OR due IS NULL THEN 'keep' WHEN due <= DATE '1999-01-01' THEN 'eligible' ELSE 'keep' END AS verdict FROM d""",
)
def v13(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("asset_id"), F.col("o_orderstatus").alias("class"), F.col("o_orderdate").alias("created"),
        (F.col("o_orderkey") % 17 == 0).alias("legal_hold"), (F.col("o_orderkey") % 19 == 0).alias("required_current"),
    )
    return V.retention_plan(o, {"F": 365, "O": 900}, F.lit("1999-01-01").cast("date")).select("asset_id", "verdict")


@query(
    "V14_export_inventory",
    f"""WITH r AS (SELECT c_custkey AS project, 'customer' AS kind, c_custkey::VARCHAR AS rid, length(c_name)::BIGINT AS bytes FROM customer UNION ALL SELECT o_custkey, 'order', o_orderkey::VARCHAR, length(o_orderpriority) FROM orders
  UNION ALL SELECT o_custkey, 'line', l_orderkey||'-'||l_linenumber, length(l_returnflag) FROM lineitem JOIN orders ON l_orderkey=o_orderkey),
 t AS (SELECT CASE WHEN c_custkey IS NULL THEN 'unowned' ELSE project::VARCHAR END AS owner, kind, rid, bytes FROM r LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey%10<>4) ON c_custkey=project),
 d AS (SELECT owner, kind, bytes, md5(concat_ws(chr(31),kind,rid)) AS d FROM t)
 SELECT owner, kind, sum(bytes)::BIGINT AS bytes, count(*) AS rows, sum(('0x'||substr(d,1,8))::BIGINT)::VARCHAR AS sum_a FROM d GROUP BY 1,2""",
)
def v14(spark, sf):
    c, o, li = (table(spark, sf, t) for t in ("customer", "orders", "lineitem"))
    res = c.select(F.col("c_custkey").alias("project"), F.lit("customer").alias("kind"), F.col("c_custkey").cast("string").alias("resource_id"), F.length("c_name").cast("bigint").alias("bytes"))
    res = res.union(o.select("o_custkey", F.lit("order"), F.col("o_orderkey").cast("string"), F.length("o_orderpriority").cast("bigint")))
    lines = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    res = res.union(lines.select("o_custkey", F.lit("line"), F.concat_ws("-", "l_orderkey", "l_linenumber"), F.length("l_returnflag").cast("bigint")))
    return V.export_inventory(res, c.where("c_custkey % 10 <> 4").select(F.col("c_custkey").alias("project"))).select("owner", "kind", "bytes", "rows", "sum_a")


@query(
    "V15_asset_cards",
    f"""WITH e AS (SELECT l_partkey AS id, arg_max(l_quantity, strftime(l_shipdate,'%Y-%m-%d')||lpad((l_quantity*100)::INT::VARCHAR,8,'0')) AS evaluation FROM lineitem WHERE l_returnflag='R' AND l_linenumber=7 GROUP BY 1),
 li AS (SELECT l_partkey AS id, min('S'||l_suppkey) AS licence FROM lineitem WHERE l_linenumber=6 GROUP BY 1),
 c AS (SELECT p_partkey AS asset_id, CASE WHEN p_size>5 THEN p_brand END AS owner, li.licence, e.evaluation, CASE WHEN p_partkey%3<>0 THEN 'lim' END AS limitations FROM part LEFT JOIN e ON e.id=p_partkey LEFT JOIN li ON li.id=p_partkey)
 SELECT asset_id, evaluation, licence, array_to_string(list_filter([CASE WHEN owner IS NULL THEN 'missing_owner' END, CASE WHEN licence IS NULL THEN 'missing_licence' END, CASE WHEN evaluation IS NULL THEN 'missing_evaluation' END,
 CASE WHEN limitations IS NULL THEN 'missing_limitations' END], lambda x: x IS NOT NULL),',') AS reasons FROM c""",
)
def v15(spark, sf):
    p, li = table(spark, sf, "part"), table(spark, sf, "lineitem")
    assets = p.select(F.col("p_partkey").alias("asset_id"), F.when(F.col("p_size") > 5, F.col("p_brand")).alias("owner"), F.when(F.col("p_partkey") % 3 != 0, "lim").alias("limitations"))
    evals = li.where("l_returnflag = 'R' and l_linenumber = 7").select(F.col("l_partkey").alias("asset_id"), F.col("l_quantity").alias("value"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("at"))
    lic = li.where("l_linenumber = 6").select(F.col("l_partkey").alias("asset_id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("licence"))
    return V.asset_cards(assets, evals, lic).select("asset_id", "evaluation", "licence", F.array_join("reasons", ",").alias("reasons"))


