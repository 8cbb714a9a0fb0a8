import hashlib
import re

import numpy as np
import pytest

from sievework.llm import decontaminate, licenses, sharding, topk


def test_matrix_rows_fit_both_margins():
    counts, sizes = np.array([0, 7, 100, 3, 55]), np.array([60, 60, 45])
    m = np.stack([sharding.matrix_row(counts, sizes, i, 3) for i in range(5)])
    assert (m.sum(axis=1) == counts).all() and (m.sum(axis=0) == sizes).all() and (m >= 0).all()


def test_matrix_is_hypergeometric():
    counts, sizes = np.array([3, 5]), np.array([4, 4])
    got = np.array([sharding.matrix_row(counts, sizes, 0, s)[0] for s in range(4000)])
    want = np.array([4, 24, 24, 4]) / 56
    assert np.abs(np.bincount(got, minlength=4) / got.size - want).max() < 0.03


def test_inversion_agrees_with_the_law(monkeypatch):
    monkeypatch.setattr(sharding, "NUMPY_LIMIT", 0)
    rng = np.random.default_rng(1)
    got = np.array([sharding.hypergeometric(30, 50, 20, rng) for _ in range(4000)])
    assert abs(got.mean() - 7.5) < 0.15 and abs(got.var() - 20 * 0.375 * 0.625 * 60 / 79) < 0.4
    assert sharding.split_sizes(np.array([5, 0, 9]), 6, rng).sum() == 6


@pytest.mark.parametrize("bucket_rows", [50_000, 7])
def test_shards(spark, bucket_rows):
    rows = [(i % 40 if i % 9 else None, None if i % 7 == 0 else "t" * (i % 5), "x", 1) for i in range(333)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard string, _key bigint").repartition(5)
    df.write.mode("overwrite").parquet(path := __import__("tempfile").mkdtemp() + "/d")
    out = sharding.shuffle_into_shards(spark.read.parquet(path), 16, bucket_rows=bucket_rows).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out if r["doc_id"] is not None and r["text"]) == sorted(
        (a, b) for a, b, _, _ in rows if a is not None and b
    )
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and {len(v) for v in by.values()} <= {20, 21} and len(out) == 333
    assert sharding.shuffle_into_shards(spark.read.parquet(path).limit(0), 16).count() == 0


def plain_topk(rows, k):
    out = {}
    for q, x in rows:
        if q % 20 == 0:
            s = sorted(((-int(np.dot(x, y)), i) for i, y in rows if i != q))
            out[q] = [(i, -v) for v, i in s[:k]]
    return out


@pytest.mark.parametrize("kind", ["random", "ties", "clusters"])
def test_topk_equals_brute_force(spark, kind):
    rng = np.random.default_rng(2)
    x = {"random": rng.normal(size=(400, 6)), "ties": rng.integers(-1, 2, (400, 6)) / 64, "clusters": rng.normal(size=(8, 6))[rng.integers(0, 8, 400)] * 5 + rng.normal(size=(400, 6)) * 0.01}[kind]
    rows = [(i, [float(v) for v in r], "a") for i, r in enumerate(x)]
    bad = [(1000, None, "b"), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0], "b"), (1020, [float("nan")] * 6, "b"), (None, [9.0] * 6, "b"), (7, rows[7][1], "again")]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>, score string")
    v = topk.integer_vectors(df)
    got = {}
    for r in topk.exact_topk(v.where("vec_id % 20 = 0"), v, 20, page=7, block_rows=64).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == plain_topk([(i, np.floor(64 * np.array(r)).astype(int)) for i, r, _ in rows], 20)
    few = v.where("vec_id < 3")
    assert topk.exact_topk(few.where("vec_id = 0"), few).count() == 2 and topk.exact_topk(v.limit(0), v).count() == 0


def test_decontamination(spark):
    item = " ".join(f"q{i}" for i in range(14))
    items = spark.createDataFrame([(1, item), (10, "Short ITEM"), (2, ""), (3, None), (4, item)], "item_id bigint, text string")
    docs = [
        (1, "Intro. " + item.upper().replace(" ", ", ") + " end", "n"),
        (2, " ".join(f"q{i}" for i in range(3, 12)), "n"),
        (3, "a short... item!", "n"),
        (4, None, "n"),
        (5, "", "n"),
        (None, "x é short item y " * 3000, None),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, n_hit string")
    for block_bytes in (1 << 20, 10):
        got = {r["doc_id"]: r for r in decontaminate.decontaminate(df, items, block_bytes=block_bytes).collect()}
        assert (got[1]["n_words"], got[1]["n_hit"], got[1]["hit_items"]) == (16, 14, ["1", "4"])
        s, e = map(int, got[1]["spans"][0].split(":"))
        assert docs[0][1][s:e] == item.upper().replace(" ", ", ")
        assert got[2]["n_hit"] == 0 and got[3]["hit_items"] == ["10"] and got[3]["n_hit"] == 2
        assert [(got[i]["n_words"], got[i]["n_hit"], got[i]["spans"]) for i in (4, 5)] == [(0, 0, [])] * 2
        assert got[None]["n_hit"] == 6000 and len(got[None]["spans"]) == 3000
    digest = {r["doc_id"]: r for r in decontaminate.decontamination_digest(df, items).collect()}
    assert digest[1]["items_sha256"] == hashlib.sha256(b"1,4").hexdigest() and digest[4]["contaminated"] is False
    assert decontaminate.decontamination_digest(df.limit(0), items).count() == 0
    assert decontaminate.decontamination_digest(df, items.limit(0)).where("contaminated").count() == 0


def test_licences(spark):
    full = "; ".join([licenses.SENTENCES["bsd-grant"] + ":\n1. " + licenses.SENTENCES["bsd-source"], ""])
    assert licenses.matched(["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"], licenses.RULES) == ["BSD-3-Clause"]
    assert licenses.matched(["bsd-source", "bsd-grant", "bsd-binary"], licenses.RULES) == []
    rows = [
        (1, "Some text. RELEASED under the MIT License!!\nmore"),
        (2, "A line.\n" + licenses.SENTENCES["mit-grant"] + ":\n\n" + licenses.SENTENCES["mit-notice"] + "."),
        (3, full), (4, None), (5, ""), (None, "Licensed under CC BY-NC 4.0. | Released under the MIT License."),
    ]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i]["licenses"] for i in (1, 2, 4, 5, None)] == ["MIT", "MIT", "", "", "CC-BY-NC-4.0,MIT"]
    name, s, e = got[1]["sentences"].split(":")
    assert name == "mit-ref" and re.fullmatch(r"RELEASED under the MIT License!+", rows[0][1][int(s) : int(e)].strip())


def test_lists_are_read_until_bounds_stop_or_they_end():
    """In clusters reading stops early; in noise the carried sums reach the end."""
    rng = np.random.default_rng(8)
    for kind, early in (("clusters", True), ("noise", False)):
        x = rng.integers(-60, 60, (600, 32)).astype(float)
        if kind == "clusters":
            x[:30] = 500 + rng.integers(0, 5, (30, 32))
        q = np.abs(rng.integers(1, 9, (4, 32))).astype(float) if early else x[:4].copy()
        ids, floor = np.arange(600), np.full(4, -np.inf)
        a, b, s, depth = topk.nra_block(np.full(4, -1), q, topk.SortedBlock(ids, x), floor, 20)
        exact = q @ x.T
        assert (s == exact[a, b]).all() and (depth < 1) == early
        for i in range(4):
            kth = np.sort(exact[i])[-20]
            assert set(np.flatnonzero(exact[i] >= kth)) <= set(b[a == i])


def test_large_values_stay_exact(spark):
    rows = [(i, [float((1 << 24) + i), float(-(1 << 24) - 3 * i), 1.0]) for i in range(60)]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    got = {}
    for r in topk.exact_topk(v.where("vec_id % 20 = 0"), v, 5, block_rows=16).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ints = {i: [int(64 * x) for x in e] for i, e in rows}
    want = {q: sorted(((i, sum(a * b for a, b in zip(ints[q], e))) for i, e in ints.items() if i != q), key=lambda t: (-t[1], t[0]))[:5] for q in (0, 20, 40)}
    assert got == want and max(s for r in want.values() for _, s in r) > 1 << 53
