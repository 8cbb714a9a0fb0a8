"""Planted defects fire their own check; clean data passes."""

import json

import pytest
from pyspark.sql import functions as F

from sievework.operators import contracts as K, quality as Q, versions as V
from sievework.session import scratch_path, table

SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["id", "model"],
    "properties": {"id": {"$ref": "#/defs/name"}, "model": {"type": ["object", "null"], "additionalProperties": {"type": "number"}}, "tags": {"type": "array", "items": {"type": "integer"}}},
    "defs": {"name": {"type": "string", "pattern": "^run-"}},
}


@pytest.mark.parametrize(
    "record,want",
    [
        ({"id": "run-1", "model": None, "tags": [1, 2]}, []),
        ({"id": "run-1", "model": {"a": 1.5}}, []),
        ({"id": "x"}, [("$", "missing required field model"), ("$.id", "does not match pattern")]),
        ({"id": 5, "model": {"a": True}, "more": 1}, [("$", "unexpected field more"), ("$.id", "expected string"), ("$.model.a", "expected number")]),
        ({"id": "run-1", "model": None, "tags": [1, "b", 1.0]}, [("$.tags[1]", "expected integer"), ("$.tags[2]", "expected integer")]),
        ([1], [("$", "expected object")]),
    ],
)
def test_record_rules(spark, record, want):
    d = spark.createDataFrame([(1, json.dumps(record))], "k int, t string")
    assert sorted((r.path, r.message) for r in K.record_violations(d, "k", "t", SCHEMA).collect()) == want


def test_planted_defects(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("k", F.concat_ws("-", *["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]))
    suite = {"not_null": ["l_tax"], "range": {"l_discount": {"ge": 0, "le": 0.1}}, "unique": ["k"]}
    base = li.dropDuplicates(["k"])
    assert Q.quality_gate(Q.quality_report(base, suite)).first()["gate_status"] == "passed"
    for spec, check in (("null", "not_null"), ("range", "range"), ("duplicate", "unique")):
        col = {"null": "l_tax", "range": "l_discount", "duplicate": ""}[spec]
        bad = Q.inject_defects(base, "k", "t", [(spec, col, 0.05, 9.0)]).drop("defects")
        failed = [r.check for r in Q.quality_report(bad, suite).where("status = 'fail'").collect()]
        assert failed == [check]


def test_digest_ignores_order_and_partitions(spark, sf):
    o = table(spark, sf, "orders")
    a, b = V.dataset_checksum(o).first(), V.dataset_checksum(o.repartition(9).orderBy(F.desc("o_orderkey"))).first()
    assert a == b
    assert V.dataset_checksum(o.where("o_orderkey <> 3")).first()["digest"] != a["digest"]


def test_ledger_gate_and_no_op(spark, sf):
    d = table(spark, sf, "labels")
    ledger = scratch_path(spark, "ledger")
    gate = lambda x: Q.quality_gate(Q.quality_report(x, {"unique": ["doc_id"]}))
    run = lambda x, at: V.commit_version(x, "labels", scratch_path(spark, "labels"), ledger, gate, at)
    assert run(d, "1")["status"] == "committed"
    assert run(d.repartition(3), "2")["status"] == "no_op"
    assert run(d.union(d), "3")["status"] == "quality_failed"
    assert run(d.limit(10), "4")["version"] == 2
    assert V.read_as_of(spark, ledger, "labels", at="3").count() == d.count()
    with pytest.raises(LookupError):
        V.read_as_of(spark, ledger, "nothing")


def test_floating_versions(spark):
    rows = [("1.2.3", False), ("v1.2", False), ("latest", True), ("1.2.x", True), (">=1", True), ("~1.0", True), ("1", True), ("1.0.0-rc1", False)]
    d = spark.createDataFrame(rows, "v string, want boolean")
    assert d.where(K.floating(F.col("v")) != F.col("want")).count() == 0
