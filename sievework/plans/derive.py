"""Relations derived from the given tables, with their SQL twins.

The tables hold no requests, versions, ACLs or predictions, so these follow
from them by md5 only; both engines make the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sievework.functions.columns import h32, h32_sql as H
from sievework.session import table


def requests(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), "user_id",
        (F.col("user_id") % 5).alias("service"), (F.col("event_type") == "error").alias("failed"),
        F.col("value").alias("latency_ms"), F.get_json_object("props", "$.k").cast("bigint").alias("tokens"), "event_type",
    )


REQUESTS = """requests AS (SELECT event_id AS request_id, ts, user_id, user_id % 5 AS service, event_type='error' AS failed,
 value AS latency_ms, json_extract_string(props,'$.k')::BIGINT AS tokens, event_type FROM events)"""


def predictions(spark: SparkSession, sf: str, seed: str = "p") -> DataFrame:
    """labels joined to documents with a hash score shifted by the truth."""
    la, d = table(spark, sf, "labels"), table(spark, sf, "documents")
    return la.join(d.select("doc_id", "lang", "source", "n_chars"), "doc_id").select(
        "doc_id", "lang", "source", "n_chars", "toxic", F.col("quality").alias("truth"),
        ((h32("doc_id", F.lit(seed)) % 700 + F.col("quality") * 300) / F.lit(1000.0)).alias("score"),
    ).withColumn("pred", (F.col("score") >= 0.5).cast("int"))


def predictions_sql(name: str = "predictions", seed: str = "p") -> str:
    return f"""{name} AS (SELECT *, (score >= 0.5)::INT AS pred FROM (SELECT l.doc_id, d.lang, d.source, d.n_chars, l.toxic, l.quality AS truth,
 ({H(f"l.doc_id::VARCHAR||'{seed}'")} % 700 + l.quality*300)/1000.0::DOUBLE AS score FROM labels l JOIN documents d USING (doc_id)))"""


def doc_versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf, "documents")
    v1 = d.where("doc_id % 10 <> 0")
    v2 = d.where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" rev2"))).otherwise(F.col("text")))
    return v1, v2


VERSIONS = """v1 AS (SELECT * FROM documents WHERE doc_id % 10 <> 0),
 v2 AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text||' rev2' ELSE text END AS text, lang, source, n_chars FROM documents WHERE doc_id % 11 <> 0)"""


def acl(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source")
    return d.withColumn("grp", F.when(F.col("doc_id") % 23 != 0, F.concat(F.lit("g"), (h32("source") % 4).cast("string"))))


ACL = f"acl AS (SELECT doc_id, source, CASE WHEN doc_id % 23 <> 0 THEN 'g'||({H('source')} % 4) END AS grp FROM documents)"


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """Change events with duplicates and late, disordered arrival."""
    e = table(spark, sf, "events")
    op = (
        F.when(F.col("event_type") == "signup", "create")
        .when(F.col("event_type").isin("view", "click"), "update")
        .when(F.col("event_type") == "purchase", "move")
        .otherwise("delete")
    )
    twice = F.when(h32("event_id", F.lit("d")) % 10 == 0, 2).otherwise(1)
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("user_id").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), ts.alias("ts"), "value",
        F.timestamp_seconds(F.floor(F.unix_micros(ts) / 1000000) + h32("event_id", F.lit("a")) % 7200).alias("arrival"),
        F.explode(F.sequence(F.lit(1), twice)).alias("copy"),
    )


CHANGES = f"""base_changes AS (SELECT user_id AS key, event_id AS seq, CASE WHEN event_type='signup' THEN 'create' WHEN event_type IN ('view','click') THEN 'update'
 WHEN event_type='purchase' THEN 'move' ELSE 'delete' END AS op, ts, value,
 make_timestamp((floor(epoch_us(ts)/1000000)::BIGINT + {H("event_id::VARCHAR||'a'")} % 7200)*1000000) AS arrival FROM events),
 changes AS (SELECT *, 1 AS copy FROM base_changes UNION ALL SELECT *, 2 FROM base_changes WHERE {H("seq::VARCHAR||'d'")} % 10 = 0)"""


def interactions(spark: SparkSession, sf: str) -> DataFrame:
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.col("o_orderdate").alias("at")
    )


INTERACTIONS = "interactions AS (SELECT o_custkey AS user_id, l_partkey AS item_id, o_orderdate AS at FROM lineitem JOIN orders ON l_orderkey=o_orderkey)"


def daily_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders per day over every calendar day, zero where none."""
    o = table(spark, sf, "orders")
    per = o.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    span = o.agg(F.min(F.col("o_orderdate").cast("date")).alias("a"), F.max(F.col("o_orderdate").cast("date")).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(per, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("double").alias("y"))


SERIES = """series AS (SELECT d.day, coalesce(p.n,0)::DOUBLE AS y FROM (SELECT unnest(generate_series(min(o_orderdate::DATE), max(o_orderdate::DATE), INTERVAL 1 DAY))::DATE AS day FROM orders) d
 LEFT JOIN (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1) p USING (day))"""


def experiment(spark: SparkSession, sf: str) -> DataFrame:
    """Units for experiment operators: customers."""
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("unit"), "c_mktsegment", "c_acctbal", "c_nationkey")


def facts(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_custkey").alias("subject"), F.lit("status").alias("predicate"), F.col("o_orderstatus").alias("value"),
        F.col("o_orderdate").cast("date").alias("valid_from"),
        F.date_add(F.col("o_orderdate").cast("date"), (30 + h32("o_orderkey", F.lit("v")) % 60).cast("int")).alias("valid_to"),
        F.date_add(F.col("o_orderdate").cast("date"), (h32("o_orderkey", F.lit("o")) % 30).cast("int")).alias("observed"),
        F.col("o_orderkey").alias("fact_id"),
    )


FACTS = f"""facts AS (SELECT o_custkey AS subject, 'status' AS predicate, o_orderstatus AS value, o_orderdate::DATE AS valid_from,
 o_orderdate::DATE + (30 + {H("o_orderkey::VARCHAR||'v'")} % 60)::INT AS valid_to, o_orderdate::DATE + ({H("o_orderkey::VARCHAR||'o'")} % 30)::INT AS observed, o_orderkey AS fact_id FROM orders)"""


def annotators(spark: SparkSession, sf: str) -> DataFrame:
    """Three annotators over the labelled documents; B and C flip some."""
    la = table(spark, sf, "labels").select("doc_id", "quality")
    flip = lambda tag, n: F.when(h32("doc_id", F.lit(tag)) % 10 < n, 1 - F.col("quality")).otherwise(F.col("quality"))
    pairs = F.array(
        *[F.struct(F.lit(a).alias("annotator"), c.cast("bigint").alias("label")) for a, c in (("A", F.col("quality")), ("B", flip("B", 1)), ("C", flip("C", 2)))]
    )
    return la.select(F.col("doc_id").alias("item"), F.inline(pairs))


ANNOTATORS = f"""annotators AS (SELECT doc_id AS item, 'A' AS annotator, quality::BIGINT AS label FROM labels UNION ALL
 SELECT doc_id, 'B', (CASE WHEN {H("doc_id::VARCHAR||'B'")} % 10 < 1 THEN 1-quality ELSE quality END)::BIGINT FROM labels UNION ALL
 SELECT doc_id, 'C', (CASE WHEN {H("doc_id::VARCHAR||'C'")} % 10 < 2 THEN 1-quality ELSE quality END)::BIGINT FROM labels)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n ".join(ctes)
