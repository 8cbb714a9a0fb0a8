"""Queries over data-quality checks (Q1-Q12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions.columns import h32_sql as H
from sievework.operators import quality as Q
from sievework.plans.registry import query
from sievework.session import table

SPEC = [("null", "l_tax", 0.05, None), ("range", "l_discount", 0.02, 9.0), ("shift", "l_quantity", 0.1, 1000.0), ("flip", "l_linenumber", 0.03, None), ("duplicate", "", 0.04, None)]
_P = lambda i, r: f"({H(f"'s|{i}|'||k")} + 0.5)/4294967296.0 < {r}"
DIRTY = f"""d0 AS (SELECT *, (l_orderkey::VARCHAR||'-'||l_linenumber::VARCHAR) AS k FROM lineitem),
 d1 AS (SELECT k, l_orderkey, l_returnflag, CASE WHEN {_P(0, 0.05)} THEN NULL ELSE l_tax END AS l_tax, CASE WHEN {_P(1, 0.02)} THEN 9.0 ELSE l_discount END AS l_discount,
  CASE WHEN {_P(2, 0.1)} THEN l_quantity+1000.0 ELSE l_quantity END AS l_quantity, CASE WHEN {_P(3, 0.03)} THEN 1-l_linenumber ELSE l_linenumber END AS l_linenumber FROM d0),
 dirty AS (SELECT * FROM d1 UNION ALL SELECT * FROM d1 WHERE {_P(4, 0.04)})"""


def dirty(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("k", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    li = li.select("k", "l_orderkey", "l_returnflag", "l_tax", "l_discount", "l_quantity", "l_linenumber")
    return Q.inject_defects(li, "k", "s", SPEC)


@query(
    "Q1_check_not_null",
    f"WITH {DIRTY} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER ({c} IS NULL)/count(*)::DOUBLE AS null_ratio FROM dirty" for c in ("l_tax", "l_discount", "l_orderkey")),
)
def q1(spark, sf):
    return Q.check_not_null(dirty(spark, sf), ["l_tax", "l_discount", "l_orderkey"])


@query(
    "Q2_check_range",
    f"""WITH {DIRTY} SELECT 'l_discount' AS "column", count(*) FILTER (NOT (l_discount>=0 AND l_discount<=0.1)) AS out_of_range, count(l_discount) AS checked FROM dirty
 UNION ALL SELECT 'l_quantity', count(*) FILTER (NOT (l_quantity>0 AND l_quantity<=50)), count(l_quantity) FROM dirty UNION ALL SELECT 'l_tax', count(*) FILTER (NOT (l_tax<0.08)), count(l_tax) FROM dirty""",
)
def q2(spark, sf):
    return Q.check_range(dirty(spark, sf), {"l_discount": {"ge": 0.0, "le": 0.1}, "l_quantity": {"gt": 0.0, "le": 50.0}, "l_tax": {"lt": 0.08}})


@query(
    "Q3_check_domain",
    """SELECT o_orderstatus AS value, 'outside' AS problem, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F','O','X') GROUP BY 1
 UNION ALL SELECT v, 'never_seen', 0 FROM (VALUES ('F'),('O'),('X')) t(v) WHERE v NOT IN (SELECT o_orderstatus FROM orders)""",
)
def q3(spark, sf):
    return Q.check_domain(table(spark, sf, "orders"), "o_orderstatus", ["F", "O", "X"])


@query(
    "Q4_check_unique",
    """SELECT 'documents.text' AS subject, count(*) AS duplicate_keys, coalesce(sum(n-1),0)::BIGINT AS extra_rows FROM (SELECT md5(text), count(*) AS n FROM documents GROUP BY 1 HAVING count(*)>1)
 UNION ALL SELECT 'orders', count(*), coalesce(sum(n-1),0)::BIGINT FROM (SELECT o_orderkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*)>1)""",
)
def q4(spark, sf):
    d = table(spark, sf, "documents").select(F.md5("text").alias("h"))
    a = Q.check_unique(d, ["h"]).withColumn("subject", F.lit("documents.text"))
    return a.unionByName(Q.check_unique(table(spark, sf, "orders"), ["o_orderkey"]).withColumn("subject", F.lit("orders")))


@query(
    "Q5_check_leaky_names",
    "SELECT DISTINCT k AS name, term FROM (SELECT unnest(['a_'||event_type, 'sold_'||event_type, lower(event_type)||'_Label_closed']) AS k FROM events), (SELECT unnest(['target','label','sold','sale','closed','days_on_market']) AS term) WHERE contains(lower(k), term)",
)
def q5(spark, sf):
    e = table(spark, sf, "events")
    names = e.select(
        F.explode(F.array(F.concat(F.lit("a_"), "event_type"), F.concat(F.lit("sold_"), "event_type"), F.concat(F.lower("event_type"), F.lit("_Label_closed")))).alias("name")
    )
    return Q.check_leaky_names(names, "name")


@query(
    "Q6_check_leaky_values",
    """SELECT f AS feature, bool_and(v IS NOT DISTINCT FROM quality) AS equals_target, bool_and(v IS NOT DISTINCT FROM 1-quality) AS equals_inverse FROM
 (SELECT quality, unnest([quality, 1-quality, toxic]) AS v, unnest(['same','inverse','toxic']) AS f FROM labels) GROUP BY 1""",
)
def q6(spark, sf):
    la = table(spark, sf, "labels").select("quality", "toxic", F.col("quality").alias("same"), (1 - F.col("quality")).alias("inverse"))
    return Q.check_leaky_values(la, ["same", "inverse", "toxic"], "quality")


@query(
    "Q7_check_category_purity",
    """WITH j AS (SELECT d.lang, d.source, d.doc_id, l.quality FROM labels l JOIN documents d USING (doc_id)),
 s AS (SELECT 'lang' AS c, lang AS value, quality FROM j UNION ALL SELECT 'source', source, quality FROM j UNION ALL SELECT 'bucket', (doc_id%150)::VARCHAR, quality FROM j)
 SELECT c AS "column", value, count(DISTINCT quality) AS classes, count(*) AS n FROM s GROUP BY 1,2 HAVING count(DISTINCT quality) < (SELECT count(DISTINCT quality) FROM labels)""",
)
def q7(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    return Q.check_category_purity(j.withColumn("bucket", F.col("doc_id") % 150), ["lang", "source", "bucket"], "quality")


@query(
    "Q8_check_split_overlap",
    """WITH a AS (SELECT doc_id FROM documents WHERE doc_id%4<>0), b AS (SELECT doc_id FROM documents WHERE doc_id%4=0 AND doc_id%20<>0 OR doc_id%31=1)
 SELECT (SELECT count(*) FROM a WHERE doc_id IN (SELECT doc_id FROM b)) AS overlap_ids, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a) AND doc_id NOT IN (SELECT doc_id FROM b)) AS lost_rows,
 (SELECT count(*) FROM a) AS train_rows, (SELECT count(*) FROM b) AS test_rows""",
)
def q8(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    a, b = d.where("doc_id % 4 <> 0"), d.where("doc_id % 4 = 0 and doc_id % 20 <> 0 or doc_id % 31 = 1")
    return Q.check_split_overlap(a, b, d, "doc_id")


@query(
    "Q9_check_class_coverage",
    """WITH s AS (SELECT CASE WHEN doc_id%5=0 THEN 'test' ELSE 'train' END AS split, quality FROM labels), w AS (SELECT * FROM (VALUES ('train'),('test'),('valid')) a(split), (VALUES (0),(1)) b(quality))
 SELECT w.split, w.quality::INT AS quality, count(s.split) AS n, count(s.split)=0 AS missing FROM w LEFT JOIN s ON w.split=s.split AND w.quality=s.quality GROUP BY 1,2""",
)
def q9(spark, sf):
    la = table(spark, sf, "labels").select(F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"), F.col("quality").cast("int").alias("quality"))
    return Q.check_class_coverage(la, "split", "quality", ["train", "test", "valid"], [0, 1])


@query(
    "Q10_quality_report",
    f"""WITH {DIRTY}, r AS (SELECT 'not_null' AS "check", 'l_tax' AS subject, count(*) FILTER (l_tax IS NULL) AS o FROM dirty
 UNION ALL SELECT 'not_null','l_discount', count(*) FILTER (l_discount IS NULL) FROM dirty UNION ALL SELECT 'range','l_discount', count(*) FILTER (NOT (l_discount<=0.1)) FROM dirty
 UNION ALL SELECT 'domain','l_returnflag', count(DISTINCT l_returnflag) FILTER (l_returnflag NOT IN ('A','N','R')) FROM dirty
 UNION ALL SELECT 'unique','k', count(*)-count(DISTINCT k) FROM dirty UNION ALL SELECT 'leaky_names','columns', 1)
 SELECT "check", subject, CASE WHEN o<=0 THEN 'pass' ELSE 'fail' END AS status, o::DOUBLE AS observed, 0.0::DOUBLE AS threshold, 'error' AS severity FROM r""",
)
def q10(spark, sf):
    suite = {"not_null": ["l_tax", "l_discount"], "range": {"l_discount": {"le": 0.1}}, "domain": {"l_returnflag": ["A", "N", "R"]}, "unique": ["k"], "leaky_names": ["l_tax", "days_on_market"]}
    return Q.quality_report(dirty(spark, sf), suite)


@query(
    "Q11_quarantine",
    """SELECT event_id, array_to_string(list_filter([CASE WHEN event_type='error' THEN 'type' END, CASE WHEN value<=1 THEN 'value' END, CASE WHEN json_extract_string(props,'$.k')::BIGINT>90 THEN 'k' END], lambda x: x IS NOT NULL),',') AS broken
 FROM events WHERE event_type='error' OR value<=1 OR json_extract_string(props,'$.k')::BIGINT>90""",
)
def q11(spark, sf):
    e = table(spark, sf, "events")
    rules = [("type", F.col("event_type") == "error"), ("value", F.col("value") <= 1), ("k", F.get_json_object("props", "$.k").cast("bigint") > 90)]
    _, bad = Q.quarantine(e, rules, e.columns)
    return bad.select("event_id", F.array_join("broken_rules", ",").alias("broken"))


@query(
    "Q12_inject_defects",
    f"WITH {DIRTY} SELECT k, count(*) AS copies, max(l_tax) AS l_tax, max(l_discount) AS l_discount, max(l_quantity) AS l_quantity, max(l_linenumber) AS l_linenumber FROM dirty GROUP BY 1",
)
def q12(spark, sf):
    return dirty(spark, sf).groupBy("k").agg(
        F.count(F.lit(1)).alias("copies"), *[F.max(c).alias(c) for c in ("l_tax", "l_discount", "l_quantity", "l_linenumber")]
    )
