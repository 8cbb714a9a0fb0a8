"""Streams give what their batch forms give, also after a restart and a replay."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sievework.plans import derive as D
from sievework.plans.stream_queries import as_arrivals, as_stream, events, late_changes
from sievework.session import scratch_path
from sievework.streaming import events as E


def same(a, b):
    return a.exceptAll(b.select(*a.columns)).isEmpty() and b.select(*a.columns).exceptAll(a).isEmpty()


def test_changes_replayed_twice_change_nothing(spark, sf):
    d = D.changes(spark, sf).select("key", "seq", "op", "value")
    log = scratch_path(spark, "log")
    for _ in range(2):
        E.drain(as_stream(spark, d, files=4), E.apply_changes(log, d.select("key")), scratch_path(spark, "cp"))
    assert same(E.current_state(spark, log), E.fold_state(d))


def test_features_equal_offline(spark, sf):
    e = events(spark, sf)
    features = E.feature_table(scratch_path(spark, "features"), e, "user_id", "ts", "event_id", ["value"])
    E.drain(as_stream(spark, e, files=4), E.materialize_features(features), scratch_path(spark, "cp"))
    offline = e.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    assert same(E.online_features(spark, features).select("user_id", "value"), offline)


def test_state_table_folds_and_reads_open_deltas_only(spark):
    table = E.change_table(scratch_path(spark, "state"), share=0.6)
    batches = [[(k, 10 * b + 1, "update", float(b)) for k in ks] for b, ks in enumerate([range(100), range(5), range(50, 60), range(90, 140), [1], [2]])]
    frames = [spark.createDataFrame(rows, table.schema) for rows in batches]
    want = {}
    for b, f in enumerate(frames):
        table.write(f, b)
        want.update({r[0]: (r[1], r[3]) for r in batches[b]})
        assert {r.key: (r.seq, r.value) for r in table.read(spark).collect()} == want
    # The first batch and the one that made deltas large were folded; the last two are open.
    version, last, rows = table.manifest(spark)
    assert (version, last, rows) == (2, 3, 140)
    assert {r.batch_id for r in table.deltas(spark, last).select("batch_id").distinct().collect()} == {4, 5}
    # Folded deltas are left out by their folders' names, before any file is opened.
    plan = table.read(spark)._jdf.queryExecution().executedPlan().toString()
    pruned = [part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:]]
    assert any("batch_id" in p and "> 3" in p for p in pruned)
    # Batches come again, folded ones and open ones, also with other rows in between.
    for b in (0, 3, 4, 5):
        table.write(frames[b], b)
    assert table.manifest(spark) == (2, 3, 140) and {r.key: (r.seq, r.value) for r in table.read(spark).collect()} == want
    some = spark.createDataFrame([(1,), (95,), (999,)], "key bigint")
    assert {r.key: r.value for r in table.lookup(spark, some).collect()} == {1: 4.0, 95: 3.0}


def test_deleted_keys_stay_deleted_after_folding(spark):
    table = E.change_table(scratch_path(spark, "state"), share=0.0)
    for b, rows in enumerate([[(1, 5, "delete", 0.0)], [(1, 4, "update", 9.0)], [(2, 1, "create", 1.0)]]):
        table.write(spark.createDataFrame(rows, table.schema), b)
    got = {r.key: r.alive for r in E.fold_state(table.read(spark)).collect()}
    assert got == {1: False, 2: True} and table.manifest(spark)[0] == 3
    empty = E.change_table(scratch_path(spark, "state"))
    assert empty.read(spark).collect() == [] and empty.compact(spark) == 0


def test_drift_detector_fires_on_shift(spark):
    rows = [(1, i, float(i), 0.0 if i < 200 else 30.0) for i in range(260)] + [(2, 1000 + i, float(i), 1.0) for i in range(260)]
    d = spark.createDataFrame(rows, "key long, event_id long, s double, value double").select("key", "event_id", F.timestamp_seconds("s").alias("ts"), "value")
    out = scratch_path(spark, "alarms")
    E.run_to_files(E.drift_detector(as_stream(spark, d, files=1), 0.5, 100.0, "m", "0 seconds", 10), out, scratch_path(spark, "cp"))
    got = spark.read.parquet(out).collect()
    assert got and {r.key for r in got} == {1} and min(r.event_id for r in got) in range(200, 210)


def test_windows_close_and_leave_no_state(spark, sf):
    d = late_changes(spark, sf)
    out = scratch_path(spark, "closed")
    q = E.run_to_files(E.closed_windows(as_arrivals(spark, d), "ts", "op", "value", 3600, "30 minutes"), out, scratch_path(spark, "cp"))
    figures = E.state_figures(q)
    closed = spark.read.parquet(out)
    dropped = sum(f["dropped"] for f in figures)
    assert dropped > 0 and closed.agg(F.sum("n")).first()[0] + dropped <= d.count()
    # What a batch leaves behind is what the watermark has not passed, not all it read.
    assert figures[-1]["held"] < 10 and max(f["held"] for f in figures) < closed.count() / 3


def test_dedup_forgets_old_keys(spark, sf):
    d = late_changes(spark, sf)
    out = scratch_path(spark, "deduped")
    q = E.run_to_files(E.dedup_events(as_arrivals(spark, d), ["key", "seq"], "ts", "30 minutes"), out, scratch_path(spark, "cp"))
    figures = E.state_figures(q)
    written = spark.read.parquet(out)
    assert written.count() == written.select("key", "seq").distinct().count()
    assert figures[-1]["held"] < 10 and sum(f["dropped"] for f in figures) > 0


def test_detector_takes_events_in_order_of_time(spark):
    """Batches in any arrival order give the alarms of the ordered events."""
    rows = [(1, i, float(60 * i + 3600), float((i * 7919) % 50) + (60.0 if 150 <= i < 180 else 0.0)) for i in range(300)]
    want, n, mean, m, low = [], 0, 0.0, 0.0, 0.0
    for _, i, s, v in rows:
        if s // 600 * 600 + 600 > 299 * 60 + 3600 - 7200:
            break
        n += 1
        mean += (v - mean) / n
        m += v - mean - 0.5
        low = min(low, m) if n > 1 else m
        if m - low > 100:
            want.append((i, round(m - low, 6)))
            n, mean, m, low = 0, 0.0, 0.0, 0.0
    d = spark.createDataFrame(rows, "key long, event_id long, s double, value double").select("key", "event_id", F.timestamp_seconds("s").alias("ts"), "value")
    path, out = scratch_path(spark, "arr"), scratch_path(spark, "alarms")
    # Each of four batches holds every fourth of the rows up to two hours around it.
    block = F.least(F.floor((F.unix_seconds("ts") + (F.col("event_id") * 37 % 100) * 60) / 4500), F.lit(4))
    E.write_arrivals(d, path, block, 5)
    E.run_to_files(E.drift_detector(E.replay_stream(spark, path, d.schema, 1), 0.5, 100.0, "m", "2 hours", 600), out, scratch_path(spark, "cp"))
    assert sorted((r.event_id, round(r.ph, 6)) for r in spark.read.parquet(out).collect()) == want and want


def test_logit_policies_equal_a_plain_replay(spark):
    rng = np.random.default_rng(3)
    rows, replay = [], []
    for i in range(400):
        x = [1.0, float(rng.normal()), float(rng.normal())]
        w = [0.2, 2.0, -1.0] if i < 200 else [0.2, -2.0, 1.0]
        rows.append((i % 2, i, 3600.0 + 60 * i, x, float(rng.random() < 1 / (1 + np.exp(-np.dot(w, x))))))
    model = E.LogitPolicies(3, 0.5, 40, 6000, 0.05, 3.0)
    end = (3600 + 60 * 399 - 600) // 600 * 600
    for key in (0, 1):
        state, young = model.start(), []
        for k, i, at, x, y in rows:
            if k != key or at // 600 * 600 + 600 > end:
                continue
            while young and young[0][0] + 300 <= at:
                model.learn(state, *young.pop(0))
            replay.append((i, *[round(p, 9) for p in model.scores(state, x)]))
            young.append((at, x, y))
        assert state["resets"][2] >= 2 and state["resets"][3] >= 1
    d = spark.createDataFrame(rows, "key bigint, event_id bigint, s double, x array<double>, y double").select("key", "event_id", F.timestamp_seconds("s").alias("ts"), "x", "y")
    path, out = scratch_path(spark, "arr"), scratch_path(spark, "scores")
    E.write_arrivals(d, path, F.least(F.floor((F.unix_seconds("ts") - 3600 + F.col("event_id") % 5 * 100) / 5000), F.lit(4)), 5)
    E.run_to_files(E.logit_policies(E.replay_stream(spark, path, d.schema, 1), model, 300, "10 minutes", 600), out, scratch_path(spark, "cp"))
    got = spark.read.parquet(out)
    assert sorted((r.event_id, *[round(r[p], 9) for p in E.POLICIES]) for r in got.collect()) == sorted(replay)
    losses = {(r.key, r.policy): r.log_loss for r in E.policy_losses(got, d.select("event_id", "y")).collect()}
    # After the change of law, a model that never learns again is the worst.
    assert all(losses[k, "static"] > losses[k, "drift"] for k in (0, 1))


class Kept:
    """List state of one key, in memory."""

    def __init__(self):
        self.rows = []

    def appendList(self, rows):
        self.rows += rows

    def put(self, rows):
        self.rows = list(rows)

    def get(self):
        return iter(self.rows)

    def clear(self):
        self.rows = []


class Timers(list):
    listTimers = lambda self: self
    registerTimer = list.append
    getCurrentWatermarkInMs = lambda self: 0


def test_waiting_rows_are_packed(monkeypatch):
    """Each state element is a call of its own, so many rows share one."""
    detector = E._PageHinkley(0.5, 100.0, "m", 1000)
    detector.waiting, detector.handle = Kept(), Timers()
    us = np.arange(5000)[::-1] * 1000 + 7
    batch = pd.DataFrame({"us": us, "event_id": us + 2**53, "value": us / 3})
    list(detector.handleInputRows((1,), iter([batch]), Timers()))
    assert len(detector.waiting.rows) == 1 and detector.handle == [1000]
    at, ids, rest = detector.due(2000)
    assert sorted(at.tolist()) == [i * 1000 + 7 for i in range(2000)] and (ids == at + 2**53).all() and (rest[:, 0] == at / 3).all()
    assert detector.handle == [1000, 3000] and len(E._unpack(detector.waiting.get(), 1)[0]) == 3000
    monkeypatch.setattr(E, "_PACK_ROWS", 700)
    assert [len(r[0]) for r in E._pack(us[:1500], us[:1500], np.zeros((1500, 2)))] == [700 * 32, 700 * 32, 100 * 32]
    assert E._LogitStream.order(np.array([3, 1, 1, 1]), np.array([0, 5, 5, 4]), np.array([[0.0, 1.0], [1.0, 9.0], [1.0, 10.0], [1.0, 0.0]])).tolist() == [3, 2, 1, 0]


def test_small_frames_share_a_state_element():
    """With each element added the store reads the whole list of the key."""
    detector = E._PageHinkley(0.5, 100.0, "m", 1000)
    detector.waiting, detector.handle = Kept(), Timers()
    us = np.arange(5000) * 1000
    frames = [pd.DataFrame({"us": us[i : i + 100], "event_id": us[i : i + 100], "value": us[i : i + 100] / 3}) for i in range(0, 5000, 100)]
    list(detector.handleInputRows((1,), iter(frames), Timers()))
    assert len(detector.waiting.rows) == 1 and E._unpack(detector.waiting.get(), 1)[0].tolist() == us.tolist()


def test_learning_in_a_row_is_learning_one_by_one():
    rng = np.random.default_rng(4)
    x = np.column_stack([np.ones(900), rng.normal(size=(900, 2)) * 3])
    y = (rng.random(900) < 1 / (1 + np.exp(-x[:, 1] * np.where(np.arange(900) < 400, 1, -1)))).astype(float)
    x[870, 2], y[880] = np.nan, np.nan
    model, at = E.LogitPolicies(3, 0.5, 40, 3000, 0.05, 3.0), np.arange(900) * 60.0
    one, row, learnt = model.start(), model.start(), np.repeat(np.arange(0, 300, 3), 3)
    for low in (0, 300, 600):
        want = []
        own = slice(low, low + 300)
        for i in range(300):
            if i % 3 == 0:
                want += [model.scores(one, v) for v in x[low + i : low + i + 3].tolist()]
            model.learn(one, at[low + i], x[low + i].tolist(), y[low + i])
        got = model.score_all(model.learn_all(row, at[own].tolist(), x[own].tolist(), y[own].tolist()), learnt, x[own])
        assert np.allclose(got, want, rtol=0, atol=1e-9)
    assert one["resets"] == row["resets"] and min(row["resets"][2:]) > 0 and np.isnan(row["w"][1]).all()
    assert np.allclose(one["w"], row["w"], equal_nan=True) and one["seen"] == row["seen"] and one["opened"] == row["opened"]
