"""Ledgers, claims, graphs, listings and schemas at their edges."""

import os

import pytest
from pyspark.sql import functions as F

from sievework.operators import contracts as K, experiments as X, versions as V
from sievework.sources import tables as S


def test_refused_spend_costs_nothing(spark):
    d = spark.createDataFrame([("a", 1, 0.6), ("a", 2, 0.6), ("a", 3, 0.1), ("b", 1, 2.0)], "dataset string, at int, eps double")
    out = {(r.dataset, r["at"]): (r.spent, r.refused) for r in X.epsilon_ledger(d, "dataset", "at", "eps", 1.0).collect()}
    assert out == {("a", 1): (0.6, False), ("a", 2): (0.6, True), ("a", 3): (0.7, False), ("b", 1): (0.0, True)}


def test_version_is_claimed_once(spark, tmp_path):
    mark = f"file://{tmp_path}/claims/d/version=1"
    assert V._claim(spark, mark) and not V._claim(spark, mark)


def test_cycle_through_a_route(spark):
    nodes = spark.createDataFrame([("A", 1, 1, None), ("B", 1, 3, "choose:x"), ("C", 1, 4, "choose:x"), ("D", 2, 1, None)], "id string, grp int, number int, route string")
    edges = spark.createDataFrame([("A", "choose:x"), ("B", "A"), ("D", "A"), ("C", "C")], "id string, needs string")
    found = sorted(map(tuple, V.dependency_audit(nodes, edges, "^[A-Z]$").collect()))
    assert found == [("cycle", "A"), ("cycle", "B"), ("numbering_gap", "1/2"), ("self_dependency", "C")]


def test_refused_files_are_not_read(spark, tmp_path):
    for name in ("docs/a.txt", "docs-private/b.txt", "docs/big.txt"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("x" * (50 if "big" in name else 3))
    os.chmod(tmp_path / "docs-private" / "b.txt", 0)
    got = {r.rel_path: (r.status, r.sha256 is not None) for r in S.list_source_files(spark, str(tmp_path), ["docs", "absent"], max_bytes=10).collect()}
    assert got == {"docs/a.txt": ("listed", True), "docs/big.txt": ("oversize", False), "docs-private/b.txt": ("not_allowed", False)}


def test_schema_references(spark):
    schema = {"type": "object", "properties": {"a": {"$ref": "#/$defs/n"}}, "$defs": {"n": {"type": ["integer", "null"]}}}
    df = spark.createDataFrame([(1, '{"a": 3}'), (2, '{"a": "x"}'), (3, '{"a": null}'), (4, '{"a": 1.5}')], "id int, body string")
    assert {(r.id, r.path) for r in K.record_violations(df, "id", "body", schema).collect()} == {(2, "$.a"), (4, "$.a")}
    with pytest.raises(ValueError):
        K.flat_schema({"$ref": "#/$defs/n", "$defs": {"n": {"items": {"$ref": "#/$defs/n"}}}})


@pytest.mark.parametrize("version, moving", [("1.2.3", False), ("v1.2", False), ("1.2.3-rc1", False), ("1.2.3-SNAPSHOT", True), ("1.2-a.x", True), ("latest", True), (">=1.0", True), ("^1.2.3", True), ("1.x", True), ("main", True)])
def test_floating(spark, version, moving):
    assert spark.createDataFrame([(version,)], "v string").select(K.floating(F.col("v"))).first()[0] is moving


def test_manifests_hold_their_entries(spark):
    runs = spark.createDataFrame([(1, "r", "allow", "t"), (2, "s", "deny", "t")], "run_id int, name string, decision string, started_at string")
    arts = spark.createDataFrame([(1, "output", f"u{i:05d}", "c") for i in range(12_000)] + [(1, "input", "a", None)], "run_id int, role string, uri string, checksum string")
    pars = spark.createDataFrame([(1, "depth", "3")], "run_id int, name string, value string")
    mets = spark.createDataFrame([(1, "m", 1.5)], "run_id int, metric string, value double")
    out = V.build_manifests(runs, arts, pars, mets, part_rows=5000).collect()
    one = [r for r in out if r.run_id == 1]
    # A long run is numbered parts of a bounded size that hold every entry once.
    assert sorted((r.part, r.parts) for r in one) == [(0, 3), (1, 3), (2, 3)] and all(3500 < len(r.outputs) < 4500 for r in one)
    assert sorted(x.uri for r in one for x in r.outputs) == [f"u{i:05d}" for i in range(12_000)]
    assert [tuple(x) for r in one for x in r.inputs] == [("a", None)]
    assert [tuple(x) for r in one for x in r.params] == [("depth", "3")] and [tuple(x) for r in one for x in r.metrics] == [("m", 1.5)]
    assert [(r.part, r.parts, r.inputs, r.outputs, r.metrics, r.decision) for r in out if r.run_id == 2] == [(0, 1, [], [], [], "deny")]


def test_only_strongly_connected_nodes_are_on_cycles(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "x"), ("x", "y"), ("y", "p"), ("p", "q"), ("q", "p"), ("q", "z"), ("s", "s"), ("m", "a"), ("b", "a")]
    got = {r.id for r in V.on_cycles(spark.createDataFrame(edges, "id string, needs string")).collect()}
    # x and y lie on a way from one cycle to another, but on none.
    assert got == {"a", "b", "c", "p", "q"}
    assert V.on_cycles(spark.createDataFrame([("a", "b")], "id string, needs string")).collect() == []


@pytest.mark.parametrize("version, moving", [("v1.2.3+build.5", False), ("1.2-", True), ("1.2.", True), ("1", True), ("1.2.3.4", True), ("1.2-é", True), (" 1.2 ", False), ("vv1.2", True), ("1..2", True), ("1.2+x.X", True)])
def test_floating_shapes(spark, version, moving):
    assert spark.createDataFrame([(version,)], "v string").select(K.floating(F.col("v"))).first()[0] is moving
