"""Queries over contract and policy predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions.columns import h32, h32_sql as H
from sievework.operators import contracts as K
from sievework.plans import derive as D
from sievework.plans.registry import query
from sievework.session import raw_table, table

LINE_CONTRACT = [
    {"name": "l_orderkey", "type": "bigint", "nullable": False},
    {"name": "l_partkey", "type": "int"},
    {"name": "l_suppkey", "type": "bigint"},
    {"name": "l_linenumber", "type": "int"},
    {"name": "l_quantity", "type": "double"},
    {"name": "l_extendedprice", "type": "double"},
    {"name": "l_discount", "type": "double"},
    {"name": "l_tax", "type": "double"},
    {"name": "l_returnflag", "type": "string", "values": ["A", "N"]},
    {"name": "l_shipdate", "type": "timestamp"},
    {"name": "l_comment", "type": "string"},
]


@query(
    "K1_schema_violations",
    """SELECT * FROM (VALUES ('l_partkey','type','bigint',1::BIGINT),('l_shipdate','timestamp_zone','timestamp_ntz',1),('l_comment','missing',NULL,1),('l_linestatus','extra','string',1)) t(field,rule,observed,n)
 UNION ALL SELECT 'l_returnflag','category',NULL, count(*) FROM lineitem WHERE l_returnflag NOT IN ('A','N') HAVING count(*)>0
 UNION ALL SELECT 'l_orderkey','null',NULL, count(*) FROM lineitem WHERE l_orderkey IS NULL HAVING count(*)>0""",
)
def k1(spark, sf):
    return K.schema_violations(table(spark, sf, "lineitem"), LINE_CONTRACT)


@query(
    "K2_schema_evolution",
    """WITH o AS (SELECT event_type AS et, ts FROM events WHERE ts < TIMESTAMP '2024-01-16'), n AS (SELECT event_type AS et FROM events WHERE ts >= TIMESTAMP '2024-01-16'),
 c AS (SELECT (SELECT count(*) FROM o) AS no, (SELECT count(*) FROM n) AS nn, (SELECT count(*) FROM n WHERE et<>'error') AS ne)
 SELECT 'k' AS name, 'widened' AS change, 'compatible' AS verdict FROM c WHERE no>0
 UNION ALL SELECT 'event_type', CASE WHEN ne<nn THEN 'made_nullable' ELSE 'same' END, 'compatible' FROM c
 UNION ALL SELECT 'ts','removed','breaking' FROM c UNION ALL SELECT 'value','added_required','breaking' FROM c""",
)
def k2(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    early, late = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    old = e.where(early).select(F.to_json(F.struct("k", "event_type", "ts")).alias("payload"))
    new = e.where(late).select(
        F.to_json(F.struct((F.col("k") * 1.5).alias("k"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"), "value")).alias("payload")
    )
    return K.schema_evolution(K.observed_fields(old, "payload"), K.observed_fields(new, "payload"))


K3_TABLES = ("customer", "documents", "events", "lineitem", "orders", "part")


@query(
    "K3_file_layout_audit",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, 0::BIGINT AS bad_partitions FROM {t}" for t in K3_TABLES),
)
def k3(spark, sf):
    out = None
    for t in K3_TABLES:
        one = K.file_layout_audit(raw_table(spark, sf, t), 1 << 20).agg(
            F.lit(t).alias("table_name"), F.sum("rows").alias("n_rows"), F.sum(F.size("bad_partitions")).alias("bad_partitions")
        )
        out = one if out is None else out.unionByName(one)
    return out


EVENT_SCHEMA = {
    "type": "object",
    "additionalProperties": False,
    "required": ["id", "kind", "value", "tags"],
    "properties": {
        "id": {"type": "integer"},
        "kind": {"$ref": "#/defs/kind"},
        "value": {"type": ["number", "null"]},
        "tags": {"type": "array", "minItems": 2, "items": {"type": "string", "minLength": 2, "pattern": "^t[0-9]+"}},
        "props": {"type": "object", "additionalProperties": {"type": "integer"}},
    },
    "defs": {"kind": {"type": "string", "enum": ["click", "view", "purchase", "signup"], "maxLength": 7}},
}


@query(
    "K4_record_violations",
    """WITH r AS (SELECT event_id, event_type, value, user_id, json_extract_string(props,'$.k')::BIGINT AS k FROM events)
 SELECT event_id, '$.kind' AS path, 'not in enum' AS message FROM r WHERE event_type='error'
 UNION ALL SELECT event_id, '$.kind', 'longer than 7' FROM r WHERE length(event_type)>7
 UNION ALL SELECT event_id, '$', 'missing required field value' FROM r WHERE event_id%13=0
 UNION ALL SELECT event_id, '$', 'unexpected field note' FROM r WHERE event_id%17=0
 UNION ALL SELECT event_id, '$.tags', 'fewer than 2 items' FROM r WHERE event_id%5=0
 UNION ALL SELECT event_id, '$.tags[0]', 'does not match pattern' FROM r WHERE event_id%7=0
 UNION ALL SELECT event_id, '$.tags[1]', 'expected string' FROM r WHERE event_id%5<>0 AND event_id%19=0
 UNION ALL SELECT event_id, '$.props.k', 'expected integer' FROM r WHERE event_id%23=0""",
)
def k4(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    i = F.col("event_id")
    kk = F.when(i % 23 == 0, F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k)
    first = F.when(i % 7 == 0, F.lit('"x1"')).otherwise(F.concat(F.lit('"t'), F.col("user_id").cast("string"), F.lit('"')))
    second = F.when(i % 5 == 0, "").when(i % 19 == 0, ",7").otherwise(',"t2"')
    text = F.concat(
        F.lit('{"id":'), i.cast("string"), F.lit(',"kind":"'), "event_type", F.lit('"'),
        F.when(i % 13 == 0, "").otherwise(F.concat(F.lit(',"value":'), F.col("value").cast("string"))),
        F.when(i % 17 == 0, ',"note":1').otherwise(""),
        F.lit(',"tags":['), first, second, F.lit('],"props":{"k":'), kk, F.lit("}}"),
    )
    return K.record_violations(e.select("event_id", text.alias("record")), "event_id", "record", EVENT_SCHEMA)


# documents stand in for assets: type, licence text and review state follow from the row
LICENCE = (
    ("Apache License, Version 2.0", "Apache-2.0"), ("MIT License", "MIT"),
    ("GNU General Public License, version 3", "GPL-3.0-only"), ("CC BY-NC 4.0", "CC-BY-NC-4.0"),
)
KINDS = ("software", "documentation", "dataset", "model-weights")


def licence_records(spark, sf):
    d = table(spark, sf, "documents")
    expr = F.lit(None).cast("string")
    for text, spdx in reversed(LICENCE):
        expr = F.when(F.col("text").contains(text), spdx).otherwise(expr)
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("doc_id") % 4 + 1).cast("int"))
    h = h32("doc_id", F.lit("k"))
    return d.select(
        "doc_id", kind.alias("record_type"), F.coalesce(expr, F.when(F.col("doc_id") % 9 == 0, "latest")).alias("expression"),
        F.when(h % 5 == 0, "source-available").otherwise("open").alias("classification"),
        F.when(h % 3 == 0, "review-required").otherwise("accepted").alias("review_status"),
        (h % 7 == 0).alias("remote_code"),
    )


LICENCE_SQL = f"""recs AS (SELECT doc_id, (['software','documentation','dataset','model-weights'])[doc_id%4+1] AS record_type,
 CASE WHEN contains(text,'Apache License, Version 2.0') THEN 'Apache-2.0' WHEN contains(text,'MIT License') THEN 'MIT' WHEN contains(text,'GNU General Public License, version 3') THEN 'GPL-3.0-only'
 WHEN contains(text,'CC BY-NC 4.0') THEN 'CC-BY-NC-4.0' WHEN doc_id%9=0 THEN 'latest' END AS expression,
 {H("doc_id::VARCHAR||'k'")} AS h FROM documents),
 rec AS (SELECT doc_id, record_type, expression, CASE WHEN h%5=0 THEN 'source-available' ELSE 'open' END AS classification,
 CASE WHEN h%3=0 THEN 'review-required' ELSE 'accepted' END AS review_status, h%7=0 AS remote_code FROM recs)"""


@query(
    "K5_conditional_required",
    f"""WITH {LICENCE_SQL} SELECT doc_id, 'record_type='||record_type||' needs '||s AS rule FROM (SELECT doc_id, record_type,
 CASE record_type WHEN 'model-weights' THEN 'model' WHEN 'dataset' THEN 'dataset' END AS s, {H("doc_id::VARCHAR||'s'")} % 3 AS z FROM rec) WHERE s IS NOT NULL AND z = 0""",
)
def k5(spark, sf):
    r = licence_records(spark, sf)
    section = F.when(h32("doc_id", F.lit("s")) % 3 != 0, F.struct("expression"))
    r = r.withColumn("model", section).withColumn("dataset", section)
    return K.conditional_required(r, "doc_id", [("record_type", "model-weights", "model"), ("record_type", "dataset", "dataset")])


_TERMS = "|".join(K.FORBIDDEN_TERMS)


@query(
    "K6_naming_audit",
    f"""WITH p AS (SELECT page_id, regexp_replace(url,'^https?:/','')||'/' AS prefix, replace(regexp_extract(url,'//([^/]*)',1),'.','-') AS slug,
  CASE WHEN page_id%3=0 THEN 'v'||page_id ELSE 'v'||lpad(page_id::VARCHAR,4,'0') END AS version FROM pages)
 SELECT page_id, 'prefix' AS "column", 'pattern' AS rule FROM p WHERE NOT regexp_matches(prefix,'^[a-z0-9][a-z0-9/_=.-]*/$')
 UNION ALL SELECT page_id,'prefix','length' FROM p WHERE length(prefix) NOT BETWEEN 3 AND 256
 UNION ALL SELECT page_id,'prefix','forbidden_term' FROM p WHERE regexp_matches(prefix,'{_TERMS}')
 UNION ALL SELECT page_id,'prefix','leading_slash' FROM p WHERE prefix[1]='/'
 UNION ALL SELECT page_id,'prefix','double_slash' FROM p WHERE contains(prefix,'//')
 UNION ALL SELECT page_id,'prefix','parent_step' FROM p WHERE contains(prefix,'..')
 UNION ALL SELECT page_id,'slug','pattern' FROM p WHERE NOT regexp_matches(slug,'^[a-z0-9]([-a-z0-9]*[a-z0-9])?$')
 UNION ALL SELECT page_id,'slug','length' FROM p WHERE length(slug) NOT BETWEEN 3 AND 63
 UNION ALL SELECT page_id,'slug','forbidden_term' FROM p WHERE regexp_matches(slug,'{_TERMS}')
 UNION ALL SELECT page_id,'version','pattern' FROM p WHERE NOT regexp_matches(version,'^v[0-9]{{4}}$')
 UNION ALL SELECT page_id,'labels','missing_label:owner' FROM p WHERE page_id%4=0""",
)
def k6(spark, sf):
    p = table(spark, sf, "pages")
    pad = F.concat(F.lit("v"), F.when(F.col("page_id") % 3 == 0, F.col("page_id").cast("string")).otherwise(F.format_string("%04d", "page_id")))
    have = F.array(*[F.lit(x) for x in K.REQUIRED_LABELS])
    have = F.when(F.col("page_id") % 4 == 0, F.array_remove(have, "owner")).otherwise(have)
    p = p.select(
        "page_id", F.concat(F.regexp_replace("url", "^https?:/", ""), F.lit("/")).alias("prefix"),
        F.replace(F.regexp_extract("url", "//([^/]*)", 1), F.lit("."), F.lit("-")).alias("slug"), pad.alias("version"),
        F.map_from_arrays(have, have).alias("labels"),
    )
    return K.naming_audit(p, "page_id", {"prefix": "object_prefix", "slug": "slug", "version": "dataset_version"}, "labels")


def _in(names):
    return "(" + ",".join(f"'{n}'" for n in names) + ")"


_ANY = sorted({n for v in K.ACCEPTED.values() for n in v})


@query(
    "K7_license_audit",
    f"""WITH {LICENCE_SQL} SELECT doc_id, CASE WHEN {" OR ".join(f"(record_type='{k}' AND expression IN {_in(v)})" for k, v in K.ACCEPTED.items())} THEN 'accepted'
 WHEN expression IN {_in(K.REVIEW)} OR expression IN {_in(_ANY)} THEN 'review-required' ELSE 'rejected' END AS default_class,
 array_to_string(list_filter([CASE WHEN classification='source-available' AND review_status='accepted' THEN 'closed_class_accepted' END,
 CASE WHEN lower(expression) IN ('latest','unknown','n/a') THEN 'unusable_expression' END,
 CASE WHEN record_type='model-weights' AND expression IS NULL THEN 'model_without_licence' END,
 CASE WHEN record_type='model-weights' AND remote_code THEN 'model_remote_code' END], lambda x: x IS NOT NULL),',') AS errors FROM rec""",
)
def k7(spark, sf):
    return K.license_audit(licence_records(spark, sf)).select("doc_id", "default_class", F.array_join("errors", ",").alias("errors"))


@query(
    "K8_inherited_licenses",
    f"""WITH {LICENCE_SQL}, cls AS (SELECT doc_id, coalesce(expression,'none') AS licence, CASE WHEN {" OR ".join(f"(record_type='{k}' AND expression IN {_in(v)})" for k, v in K.ACCEPTED.items())} THEN 'accepted'
 WHEN expression IN {_in(K.REVIEW)} OR expression IN {_in(_ANY)} THEN 'review-required' ELSE 'rejected' END AS status FROM rec),
 ad AS (SELECT p_partkey AS adapter_id, p_partkey % 300 AS base, p_partkey % 2 AS rev, [p_partkey%211, (p_partkey*7)%223] AS ds FROM part),
 ob AS (SELECT adapter_id, licence, coalesce(status,'rejected') AS status, m.doc_id IS NOT NULL AS pinned FROM ad LEFT JOIN cls m ON base=m.doc_id AND rev=m.doc_id%2
  UNION ALL SELECT adapter_id, licence, coalesce(status,'rejected'), NULL FROM (SELECT adapter_id, unnest(list_distinct(ds)) AS d FROM ad) LEFT JOIN cls ON d=doc_id)
 SELECT adapter_id, array_to_string(list_sort(list_distinct(list(licence) FILTER (licence IS NOT NULL))),',') AS licences,
 (['accepted','review-required','rejected'])[max(list_position(['accepted','review-required','rejected'],status))] AS status, coalesce(bool_or(pinned),false) AS base_pinned FROM ob GROUP BY 1""",
)
def k8(spark, sf):
    r = K.license_audit(licence_records(spark, sf)).select("doc_id", F.coalesce("expression", F.lit("none")).alias("licence"), F.col("default_class").alias("status"))
    p = table(spark, sf, "part")
    ad = p.select(
        F.col("p_partkey").alias("adapter_id"), (F.col("p_partkey") % 300).alias("base_model"), (F.col("p_partkey") % 2).alias("base_revision"),
        F.array_distinct(F.array(F.col("p_partkey") % 211, (F.col("p_partkey") * 7) % 223)).alias("datasets"),
    )
    models = r.select(F.col("doc_id").alias("model"), (F.col("doc_id") % 2).alias("revision"), "licence", "status")
    data = r.select(F.col("doc_id").alias("dataset"), "licence", "status")
    return K.inherited_licenses(ad, models, data).select("adapter_id", F.array_join("licences", ",").alias("licences"), "status", "base_pinned")


@query(
    "K9_pinned_version_audit",
    f"""WITH c AS (SELECT p_partkey AS name, CASE WHEN p_partkey%2=0 THEN 'image' ELSE 'package' END AS kind,
 CASE p_partkey%8 WHEN 0 THEN 'latest' WHEN 1 THEN '1.2.x' WHEN 2 THEN '>=1.2' WHEN 3 THEN '~1.0' WHEN 4 THEN '' WHEN 5 THEN NULL WHEN 6 THEN p_size||'.1.0' ELSE 'v'||p_size||'.4' END AS version,
 CASE WHEN p_partkey%5=0 THEN 'http://x' ELSE 'https://x' END AS source_url,
 CASE WHEN p_partkey%3=0 THEN NULL WHEN p_partkey%7=0 THEN 'sha256:'||md5(p_name) ELSE 'sha256:'||md5(p_name)||md5(p_brand) END AS digest FROM part),
 f AS (SELECT * REPLACE (name::VARCHAR AS name), 'repo@'||CASE WHEN name%11=0 THEN 'none' ELSE digest END AS reference, CASE WHEN name%9<>0 THEN 'repo' END AS repository,
  CASE WHEN name%10=0 THEN 'latest' WHEN name%14=0 THEN ' ' ELSE '1.0.0' END AS tag, CASE WHEN name%17<>0 THEN 'linux' END AS os, CASE WHEN name%19<>0 THEN 'amd64' END AS architecture FROM c)
 SELECT 'absent' AS name, 'component_missing' AS error UNION ALL SELECT name, 'repository_missing' FROM f WHERE kind='image' AND repository IS NULL UNION ALL SELECT name, 'tag_missing' FROM f WHERE kind='image' AND trim(tag)=''
 UNION ALL SELECT name, 'tag_floating' FROM f WHERE kind='image' AND tag='latest' UNION ALL SELECT name, 'os_missing' FROM f WHERE kind='image' AND os IS NULL UNION ALL SELECT name, 'architecture_missing' FROM f WHERE kind='image' AND architecture IS NULL
 UNION ALL SELECT name, 'reference_missing' FROM f WHERE kind='image' AND reference IS NULL
 UNION ALL SELECT name, 'version_missing' AS error FROM f WHERE version IS NULL OR trim(version)=''
 UNION ALL SELECT name,'version_floating' FROM f WHERE trim(version)<>'' AND NOT regexp_matches(version,'^v?[0-9]+\\.[0-9]+(\\.[0-9]+)?$')
 UNION ALL SELECT name,'source_not_https' FROM f WHERE source_url NOT LIKE 'https://%'
 UNION ALL SELECT name,'digest_missing' FROM f WHERE kind='image' AND digest IS NULL
 UNION ALL SELECT name,'digest_malformed' FROM f WHERE kind='image' AND NOT regexp_matches(digest,'^sha256:[0-9a-f]{{64}}$')
 UNION ALL SELECT name,'reference_without_digest' FROM f WHERE kind='image' AND NOT contains(reference,digest)""",
)
def k9(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    size = F.col("p_size").cast("string")
    version = (
        F.when(k % 8 == 0, "latest").when(k % 8 == 1, "1.2.x").when(k % 8 == 2, ">=1.2").when(k % 8 == 3, "~1.0").when(k % 8 == 4, "")
        .when(k % 8 == 6, F.concat(size, F.lit(".1.0"))).when(k % 8 == 7, F.concat(F.lit("v"), size, F.lit(".4")))
    )
    digest = F.when(k % 3 == 0, None).when(k % 7 == 0, F.concat(F.lit("sha256:"), F.md5("p_name"))).otherwise(F.concat(F.lit("sha256:"), F.md5("p_name"), F.md5("p_brand")))
    c = p.select(
        k.alias("name"), F.when(k % 2 == 0, "image").otherwise("package").alias("kind"), version.alias("version"),
        F.when(k % 5 == 0, "http://x").otherwise("https://x").alias("source_url"), digest.alias("digest"),
        F.concat(F.lit("repo@"), F.when(k % 11 == 0, "none").otherwise(digest)).alias("reference"), F.when(k % 9 != 0, "repo").alias("repository"),
        F.when(k % 10 == 0, "latest").when(k % 14 == 0, " ").otherwise("1.0.0").alias("tag"), F.when(k % 17 != 0, "linux").alias("os"), F.when(k % 19 != 0, "amd64").alias("architecture"),
    ).withColumn("name", F.col("name").cast("string"))
    return K.pinned_version_audit(c, ["2", "absent"])


@query(
    "K10_redact_values",
    """SELECT doc_id, md5(replace(replace(replace(array_to_string(list_slice(s, greatest(len(s)-3,1), len(s)), chr(10)),'mentation','<redacted>'),'token','<redacted>'),'the','<redacted>')) AS body
 FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)""",
)
def k10(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return K.redact_values(d, ["text"], ["the", "mentation", "token"], last_lines=4).select("doc_id", F.md5("text").alias("body"))


@query(
    "K11_class_prefix_coverage",
    """WITH m AS (SELECT page_id, (CASE WHEN starts_with(url,'http://') THEN 1 ELSE 0 END)+(CASE WHEN starts_with(url,'https://www.') THEN 1 ELSE 0 END)+(CASE WHEN starts_with(url,'http://th') THEN 1 ELSE 0 END) AS n,
 CASE WHEN starts_with(url,'http://') THEN 'public' ELSE 'internal' END AS c FROM pages)
 SELECT page_id, n::INT AS matches, CASE WHEN n=0 THEN 'unmatched' WHEN n>1 THEN 'ambiguous' ELSE 'owned' END AS status, CASE WHEN n=1 THEN c END AS data_class FROM m""",
)
def k11(spark, sf):
    rules = [("http://", "public", "web"), ("https://www.", "internal", "core"), ("http://th", "confidential", "team")]
    return K.class_prefix_coverage(table(spark, sf, "pages"), "url", rules).select("page_id", "matches", "status", "data_class")


def findings(spark, sf):
    d = table(spark, sf, "documents")
    kind = F.when(F.col("text").rlike('token = "'), "secret").when(F.col("text").contains("GNU General Public License"), "licence").otherwise("vulnerability")
    return d.select(
        F.col("source").alias("asset"), F.col("doc_id").alias("finding_id"), kind.alias("kind"), (h32("doc_id", F.lit("sev")) % 10).alias("severity")
    )


@query(
    "K12_findings_gate",
    f"""WITH f AS (SELECT source AS asset, doc_id AS finding_id, CASE WHEN regexp_matches(text,'token = "') THEN 'secret' WHEN contains(text,'GNU General Public License') THEN 'licence' ELSE 'vulnerability' END AS kind,
 {H("doc_id::VARCHAR||'sev'")} % 10 AS severity FROM documents),
 x AS (SELECT doc_id AS finding_id, CASE WHEN doc_id%8=0 THEN NULL ELSE 'team' END AS owner, DATE '2024-01-01' + ((doc_id%60)::INT) AS expires FROM documents WHERE doc_id%4=0),
 j AS (SELECT asset, x.finding_id IS NOT NULL AS ex, (kind='secret' OR severity>=9) AS bad FROM f LEFT JOIN (SELECT finding_id FROM x WHERE owner IS NOT NULL AND expires > DATE '2024-01-15') x USING (finding_id))
 SELECT asset, count(*) AS findings, count(*) FILTER (ex) AS excepted, count(*) FILTER (bad AND NOT ex) AS blocking, CASE WHEN bool_or(bad AND NOT ex) THEN 'deny' ELSE 'allow' END AS decision FROM j GROUP BY 1""",
)
def k12(spark, sf):
    d = table(spark, sf, "documents")
    ex = d.where("doc_id % 4 = 0").select(
        F.col("doc_id").alias("finding_id"), F.when(F.col("doc_id") % 8 != 0, "team").alias("owner"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).alias("expires"),
    )
    return K.findings_gate(findings(spark, sf), ex, F.lit("2024-01-15").cast("date"), 9, ["secret"])[0]
