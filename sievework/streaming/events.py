"""Replayable event processing: batch forms and Structured Streaming twins."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sievework.functions.columns import seconds
from sievework.functions.scan import running
from sievework.operators.quality import tag_broken
from sievework.operators.versions import dataset_checksum, diff_rows
from sievework.streaming.state_table import StateTable


def hour_block(ts: str) -> Column:
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 3600000000)


# --- sources and sinks ------------------------------------------------------


def replay_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int, fmt: str = "parquet") -> DataFrame:
    """Bounded file stream; a run with a fresh checkpoint reads the same files
    in the same groups."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(path)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE = "spark.sql.streaming.stateStore.providerClass"


def write_arrivals(df: DataFrame, path: str, block: Column, blocks: int) -> None:
    """Writes blocks 0 to ``blocks`` - 1 of the rows one after another, one file
    each, so that a file stream with one file a trigger reads them in that order.
    The rows are made once, kept by block beside ``path``, and only copied then."""
    marked = df.withColumn("_block", block.cast("bigint"))
    marked.where(F.col("_block").between(0, blocks - 1)).write.partitionBy("_block").parquet(f"{path}-blocks")
    made = df.sparkSession.read.schema(T.StructType([*df.schema, T.StructField("_block", T.LongType())])).parquet(f"{path}-blocks")
    for b in range(blocks):
        made.where(F.col("_block") == b).drop("_block").coalesce(1).write.mode("append").parquet(path)


def _drained(spark: SparkSession, writer) -> StreamingQuery:
    """Runs a writer over what is there, with state in RocksDB (event-time timers
    need it); the session's own setting comes back afterwards."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, ROCKSDB)
    try:
        q = writer.trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    return q


def run_to_files(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Drains what is there into parquet files. Update mode keeps every batch
    apart, so a repeated batch overwrites itself."""
    if mode == "append":
        q = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    else:
        q = stream.writeStream.outputMode(mode).foreachBatch(batch_writer(out)).option("checkpointLocation", checkpoint)
    return _drained(stream.sparkSession, q)


def state_figures(q: StreamingQuery) -> list[dict]:
    """For every batch of a finished run: rows read, rows that its stateful
    operators dropped as late, and rows they hold afterwards.

    A query keeps the figures of its last batches only
    (``spark.sql.streaming.numRecentProgressUpdates``); a longer run is an error."""
    seen = q.recentProgress
    if seen and seen[0]["batchId"] > 0:
        raise ValueError("the first batches' figures are gone: raise spark.sql.streaming.numRecentProgressUpdates")
    return [
        {"batch": p["batchId"], "read": p["numInputRows"], "dropped": sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"]), "held": sum(o["numRowsTotal"] for o in p["stateOperators"])}
        for p in seen
    ]


def batch_writer(out: str, shape: Callable[[DataFrame], DataFrame] = lambda d: d):
    """foreachBatch function writing each batch to its own folder; running a
    batch again replaces the folder."""

    def write(df: DataFrame, batch_id: int) -> None:
        shape(df).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return write


def drain(stream: DataFrame, writer: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    _drained(stream.sparkSession, stream.writeStream.outputMode(mode).foreachBatch(writer).option("checkpointLocation", checkpoint))


# --- conform, dedup, lateness, windows --------------------------------------


def conform_events(raw: DataFrame, payload: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(typed events, bad rows with reasons). raw: key, event_time, ingest_time,
    sequence, type, payload, all text. The idempotency key hashes key, sequence and type."""
    d = raw.select(
        F.col("key").try_cast("bigint").alias("key"), F.try_to_timestamp("event_time").alias("event_time"), F.try_to_timestamp("ingest_time").alias("ingest_time"),
        F.col("sequence").try_cast("bigint").alias("sequence"), "type", F.from_json("payload", payload, {"mode": "PERMISSIVE"}).alias("payload"),
        F.md5(F.concat_ws("|", "key", "sequence", "type")).alias("idempotency_key"), F.col("payload").alias("_raw"),
    )
    rules = [(f"bad_{c}", F.col(c).isNull()) for c in ("key", "event_time", "ingest_time", "sequence", "type")]
    rules += [("bad_payload", F.try_parse_json("_raw").isNull()), ("ingest_before_event", F.col("ingest_time") < F.col("event_time"))]
    d = tag_broken(d, rules).drop("_raw")
    return d.where(F.size("broken_rules") == 0).drop("broken_rules"), d.where(F.size("broken_rules") > 0)


def dedup_events(df: DataFrame, key: Sequence[str], ts: str, delay: str, tie: Sequence[str] = ()) -> DataFrame:
    """First event per idempotency key. A stream bounds its state by the delay;
    a batch keeps the least row by a partial aggregate."""
    if df.isStreaming:
        return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(key))
    rest = [c for c in df.columns if c not in key]
    first = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*tie, ts)).alias("_r"))
    return first.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def classify_lateness(df: DataFrame, arrival: Sequence[str], ts: str, delay_s: float) -> DataFrame:
    """on_time / out_of_order / late against the greatest event time seen before
    in arrival order; scanned in ten seconds of arrival."""
    block = F.floor(F.unix_micros(F.col(arrival[0]).cast("timestamp")) / 10_000_000)
    d = running(df, [], list(arrival), block, inclusive=False, _seen=("max", F.col(ts)))
    behind = seconds(F.col("_seen")) - seconds(F.col(ts))
    return d.withColumn("lateness", F.when(F.col("_seen").isNull() | (behind <= 0), "on_time").when(behind <= delay_s, "out_of_order").otherwise("late")).drop("_seen")


def window_counts(df: DataFrame, ts: str, kind: str, value: str, size: str, slide: str | None = None, delay: str | None = None) -> DataFrame:
    """Count, sum and mean per event-time window and type, batch or stream."""
    src = df.withWatermark(ts, delay) if delay and df.isStreaming else df
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = src.groupBy(w.alias("_w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return g.select(F.col("_w.start").alias("window_start"), kind, "n", "total", "mean")


class _ClosingWindow(StatefulProcessor):
    """Sums of one window and part of a type; a timer at the window's end emits
    them and ends the state."""

    def __init__(self, size_ms: int) -> None:
        self.size = size_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "n bigint, total double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, total = self.sums.get() if self.sums.exists() else (0, 0.0)
        if not n:
            self.handle.registerTimer(int(key[0]) + self.size)
        for b in rows:
            n, total = n + len(b), total + float(b["value"].sum())
        self.sums.update((int(n), float(total)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, total = self.sums.get()
        self.sums.clear()
        yield pd.DataFrame({"window_ms": [int(key[0])], "type": [key[1]], "n": [int(n)], "total": [float(total)]})


def closed_windows(stream: DataFrame, ts: str, kind: str, value: str, size_s: int, delay: str, parts: int = 8) -> DataFrame:
    """(window_ms, type, n, total) of tumbling windows once the watermark passes
    their end, in append mode: nothing is emitted twice and a closed window keeps
    no state. Rows behind the watermark are dropped and counted by Spark
    (``state_figures``). A type is dealt to ``parts`` states, so a hot one is not one
    task; a window has one row for each part, which ``window_totals`` sums."""
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    src = stream.withWatermark(ts, delay).select(
        (F.floor(ms / (size_s * 1000)) * size_s * 1000).cast("bigint").alias("window_ms"), F.col(kind).alias("type"), F.pmod(F.xxhash64(ts, value), F.lit(parts)).alias("part"), F.col(value).cast("double").alias("value"), ts
    )
    return src.groupBy("window_ms", "type", "part").transformWithStateInPandas(_ClosingWindow(size_s * 1000), "window_ms bigint, type string, n bigint, total double", "Append", "EventTime")


def window_totals(parts: DataFrame) -> DataFrame:
    g = parts.groupBy(F.timestamp_millis("window_ms").alias("window_start"), F.col("type").alias("event_type"))
    return g.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), (F.sum("total") / F.sum("n")).alias("mean"))


def late_counts(classified: DataFrame, ts: str, size: str) -> DataFrame:
    """Rows a watermark would drop, per window."""
    return classified.where("lateness = 'late'").groupBy(F.window(ts, size).alias("_w")).agg(F.count(F.lit(1)).alias("dropped")).select(F.col("_w.start").alias("window_start"), "dropped")


def newest_batch(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """Last written row per key of an update-mode sink."""
    d = spark.read.parquet(out)
    rest = [c for c in d.columns if c not in (*keys, "batch_id")]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


# --- state ------------------------------------------------------------------


def fold_state(events: DataFrame, key: str = "key") -> DataFrame:
    """Final state per key from duplicates and disorder: the greatest sequence
    wins, delete wins a tie. events(key, seq, op, value)."""
    at = F.struct("seq", (F.col("op") == "delete").cast("int"), "op", "value")
    f = events.groupBy(key).agg(F.max(at).alias("_m"))
    return f.select(key, F.col("_m.seq").alias("seq"), F.col("_m.op").alias("op"), F.when(F.col("_m.op") != "delete", F.col("_m.value")).alias("value"), (F.col("_m.op") != "delete").alias("alive"))


def fold_state_stream(stream: DataFrame, key: str = "key") -> DataFrame:
    """The same fold kept as stream state; emits the new state of touched keys.

    Each batch is folded by the partial aggregate of Spark's own state store
    (a struct maximum), so a hot key is combined before it is shuffled."""
    return fold_state(stream, key)


def change_table(log: str, key_type: str = "bigint", value_type: str = "double", key: str = "key", share: float = 0.5) -> StateTable:
    """State table of change events: the greatest sequence wins, delete wins a
    tie; deletes stay as rows, so that an older change cannot bring a key back."""
    schema = T.StructType.fromDDL(f"{key} {key_type}, seq bigint, op string, value {value_type}")
    return StateTable(log, key, [F.col("seq"), (F.col("op") == "delete").cast("int"), F.col("op"), F.col("value")], schema, share=share)


def apply_changes(log: str, sources: DataFrame, key: str = "key", table: StateTable | None = None):
    """foreachBatch function: changes of known keys go to the state table; unknown
    keys go to ``refused``. Running a batch again changes nothing."""
    state = table or change_table(f"{log}/state", key=key)

    def write(df: DataFrame, batch_id: int) -> None:
        known = sources.select(key).distinct()
        df.join(known, key, "left_anti").write.mode("overwrite").parquet(f"{log}/refused/batch_id={batch_id}")
        state.write(df.join(known, key, "left_semi"), batch_id)

    return write


def current_state(spark: SparkSession, log: str, key: str = "key", table: StateTable | None = None) -> DataFrame:
    """(key, seq, op, value, alive) of the state table: its base and open deltas."""
    return fold_state((table or change_table(f"{log}/state", key=key)).read(spark), key)


def replay_check(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: digests of two runs, equality, differing keys."""
    d = diff_rows(a, b.select(*a.columns), key).agg(F.count_if(F.col("change") != "same").alias("differing_keys"))
    x, y = dataset_checksum(a).select("digest").scalar(), dataset_checksum(b.select(*a.columns)).select("digest").scalar()
    return d.withColumns({"digest_a": x, "digest_b": y}).withColumn("same", F.col("digest_a") == F.col("digest_b"))


# --- labels and feedback ----------------------------------------------------


def join_labels(preds: DataFrame, labels: DataFrame, horizon_s: float, window_s: int) -> tuple[DataFrame, DataFrame]:
    """(first label within the horizon per prediction, counts per window).

    preds(project, id, ts), labels(project, id, label_id, ts, label). Labels are
    reduced to one row per (project, id) before the join, so a hot id stays small."""
    p = preds.select("project", "id", F.col("ts").alias("pred_ts"))
    rel = labels.join(p, ["project", "id"])
    gap = seconds(F.col("ts")) - seconds(F.col("pred_ts"))
    inside = (gap >= 0) & (gap <= horizon_s)
    per = rel.groupBy("project", "id").agg(
        F.min_by("label", F.when(inside, F.struct("ts", "label_id"))).alias("label"), F.count_if(inside).alias("inside"), F.count_if(gap > horizon_s).alias("late")
    )
    j = p.join(per, ["project", "id"], "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    w = F.timestamp_seconds(F.floor(seconds(F.col("pred_ts")) / window_s) * window_s)
    counts = j.groupBy("project", w.alias("window_start")).agg(
        F.count(F.lit(1)).alias("predictions"), F.count_if(z("inside") > 0).alias("labelled"), F.sum(F.greatest(z("inside") - 1, F.lit(0))).alias("duplicates"),
        F.sum(z("late")).alias("late"), F.count_if(z("inside") == 0).alias("missing"),
    )
    return j.select("project", "id", "pred_ts", "label"), counts


def stream_join_labels(preds: DataFrame, labels: DataFrame, horizon: str, delay: str) -> DataFrame:
    """Left outer stream join on (project, id) with a time bound on both sides."""
    p = preds.withWatermark("ts", delay).selectExpr("project", "id", "ts as pred_ts")
    la = labels.withWatermark("ts", delay).selectExpr("project as lp", "id as lid", "ts as label_ts", "label")
    cond = F.expr(f"project = lp and id = lid and label_ts >= pred_ts and label_ts <= pred_ts + interval {horizon}")
    return p.join(la, cond, "leftOuter").select("project", "id", "pred_ts", "label_ts", "label")


def dead_letter(good: str, bad: str, rules: Sequence[tuple[str, Column]], permanent: Sequence[str], stage: str):
    """foreachBatch function with two sinks: failing events keep id, stage,
    reasons, attempt and whether a retry can help; good rows go on."""

    def write(df: DataFrame, batch_id: int) -> None:
        d = tag_broken(df, rules)
        d.where(F.size("broken_rules") == 0).drop("broken_rules").write.mode("overwrite").parquet(f"{good}/batch_id={batch_id}")
        lost = d.where(F.size("broken_rules") > 0).withColumns(
            {"stage": F.lit(stage), "attempt": F.coalesce("attempt", F.lit(0)) + 1, "retryable": ~F.arrays_overlap("broken_rules", F.array(*[F.lit(p) for p in permanent]))}
        )
        lost.write.mode("overwrite").parquet(f"{bad}/batch_id={batch_id}")

    return write


def capture_feedback(feedback: DataFrame, requests: DataFrame, rate_limit: int, window_s: int) -> tuple[DataFrame, DataFrame]:
    """(accepted feedback, flagged callers). Counted once per idempotency key;
    the request must exist and belong to the caller. feedback(idem, request_id,
    caller, ts, rating), requests(request_id, caller)."""
    one = feedback if feedback.isStreaming else dedup_events(feedback, ["idem"], "ts", "0 seconds", ["request_id"])
    ok = one.join(requests.select("request_id", "caller").distinct(), ["request_id", "caller"], "left_semi")
    w = F.timestamp_seconds(F.floor(seconds(F.col("ts")) / window_s) * window_s)
    rate = one.groupBy("caller", w.alias("window_start")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rate_limit)
    return ok, rate


# --- drift and learning over streams ----------------------------------------


def page_hinkley(df: DataFrame, key: str, order: Sequence[str], value: str, delta: float, limit: float) -> DataFrame:
    """Batch form without reset: running deviation above its running minimum.
    Three block scans per key."""
    block = lambda: hour_block(order[0])
    keys = [key]
    d = running(df, keys, list(order), block(), _s=("sum", F.col(value)), _n=("count", F.lit(1)))
    d = running(d, keys, list(order), block(), _m=("sum", F.col(value) - F.col("_s") / F.col("_n") - delta))
    d = running(d, keys, list(order), block(), _low=("min", F.col("_m")))
    return d.withColumn("ph", F.col("_m") - F.col("_low")).withColumn("alarm", F.col("ph") > limit).drop("_s", "_n", "_m", "_low")


_PACKED = "rows binary"
_PACK_ROWS = 65_536


def _pack(us: np.ndarray, ids: np.ndarray, rest: np.ndarray) -> list[tuple[bytes]]:
    """Rows (time, id, numbers) as state elements of up to _PACK_ROWS rows: one
    element for many rows, since each costs a call of its own."""
    whole = np.empty((len(us), 2 + rest.shape[1]))
    # Longs keep their bits.
    whole[:, 0], whole[:, 1], whole[:, 2:] = us.astype(np.int64).view(np.float64), ids.astype(np.int64).view(np.float64), rest
    return [(whole[at : at + _PACK_ROWS].tobytes(),) for at in range(0, len(us), _PACK_ROWS)]


def _unpack(elements, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times, ids and ``width`` numbers a row of packed state elements."""
    whole = np.frombuffer(b"".join(bytes(e[0]) for e in elements)).reshape(-1, 2 + width)
    longs = whole[:, :2].copy().view(np.int64)
    return longs[:, 0], longs[:, 1], whole[:, 2:]


_ALARM = "key bigint, event_id bigint, ts timestamp, ph double, model_version string"


class _Slices(StatefulProcessor):
    """Rows wait in state until the watermark passes the end of their time slice; a
    timer then takes them out."""

    def __init__(self, slice_ms: int, width: int) -> None:
        self.slice, self.width = slice_ms, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _PACKED)

    def _end(self, us):
        """The end of a row's time slice in milliseconds."""
        return (us // 1000 // self.slice + 1) * self.slice

    def _wake(self, us: int, passed: int) -> None:
        """One timer ahead is enough: the one of the earliest slice that waits."""
        end = self._end(us)
        if not any(passed < t <= end for t in self.handle.listTimers()):
            self.handle.registerTimer(end)

    def numbers(self, b: pd.DataFrame) -> np.ndarray:
        """The numbers of a batch's rows, ``width`` a row."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, held, count = None, [], 0
        for b in rows:
            if len(b):
                us = b["us"].to_numpy()
                first = int(us.min()) if first is None else min(first, int(us.min()))
                held.append((us, b["event_id"].to_numpy(), self.numbers(b)))
                count += len(us)
            if count >= 4 * _PACK_ROWS:
                self._keep(held)
                count = 0
        if first is not None:
            self._keep(held)
            self._wake(first, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def _keep(self, held: list[tuple]) -> None:
        """Rows held go to the state in few elements: with each one added, the store
        reads the whole list of the key."""
        if held:
            self.waiting.appendList(_pack(*(np.concatenate(p) for p in zip(*held))))
            held.clear()

    def due(self, passed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """The rows of slices that the watermark has passed; others go on waiting."""
        us, ids, rest = _unpack(self.waiting.get(), self.width)
        out = self._end(us) <= passed
        if not out.any():
            return None
        if out.all():
            self.waiting.clear()
        else:
            self.waiting.put(_pack(us[~out], ids[~out], rest[~out]))
            self._wake(int(us[~out].min()), passed)
        return us[out], ids[out], rest[out]


class _PageHinkley(_Slices):
    """The detector is four numbers; rows go to it in event order."""

    def __init__(self, delta: float, limit: float, version: str, slice_ms: int) -> None:
        super().__init__(slice_ms, 1)
        self.delta, self.limit, self.version = delta, limit, version

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.figures = handle.getValueState("figures", "n bigint, mean double, m double, low double")

    def numbers(self, b: pd.DataFrame) -> np.ndarray:
        return b["value"].to_numpy(np.float64)[:, None]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = self.due(timerValues.getCurrentWatermarkInMs())
        if due is None:
            return
        us, ids, value = due[0], due[1], due[2][:, 0]
        order = np.lexsort((value, ids, us))
        n, mean, m, low = self.figures.get() if self.figures.exists() else (0, 0.0, 0.0, 0.0)
        out = []
        for i, v in zip(order.tolist(), value[order].tolist()):
            n += 1
            mean += (v - mean) / n
            m += v - mean - self.delta
            low = min(low, m) if n > 1 else m
            if m - low > self.limit:
                out.append((int(key[0]), int(ids[i]), pd.Timestamp(int(us[i]), unit="us"), m - low, self.version))
                n, mean, m, low = 0, 0.0, 0.0, 0.0
        self.figures.update((int(n), float(mean), float(m), float(low)))
        if out:
            yield pd.DataFrame(out, columns=["key", "event_id", "ts", "ph", "model_version"])


def drift_detector(stream: DataFrame, delta: float, limit: float, model_version: str, delay: str, slice_s: int = 3600) -> DataFrame:
    """Page-Hinkley per key with reset after each alarm, in event order whatever
    the arrival order within ``delay``. stream(key, event_id, ts, value).

    Rows behind the watermark are dropped and counted (``state_figures``). A key's
    state holds four numbers and the rows of the time slices that are still open,
    so it does not grow with the stream; what one watermark lets go of a key is
    ordered in memory, as arrays.
    Rows of slices that the last watermark has not passed wait in the checkpoint."""
    src = stream.withWatermark("ts", delay).select("key", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    return src.groupBy("key").transformWithStateInPandas(_PageHinkley(delta, limit, model_version, slice_s * 1000), _ALARM, "Append", "EventTime")


def prequential(df: DataFrame, key: str, order: Sequence[str], correct: Column, block_rows: str, window: int) -> DataFrame:
    """Test-then-train accuracy in stream order, cumulative and over the last
    ``window`` rows; both come from prefix sums, the sliding one by a lookup of
    the prefix ``window`` positions back."""
    d = running(df.withColumn("_ok", correct.cast("int")), [key], list(order), hour_block(block_rows), _k=("sum", F.col("_ok")), pos=("count", F.lit(1).cast("bigint")))
    back = d.select(F.col(key), (F.col("pos") + window).alias("pos"), F.col("_k").alias("_old"))
    j = d.join(back, [key, "pos"], "left")
    return j.select(
        *df.columns, "pos", F.round(F.col("_k") / F.col("pos"), 6).alias("cumulative"),
        F.round((F.col("_k") - F.coalesce("_old", F.lit(0))) / F.least(F.col("pos"), F.lit(window)), 6).alias("sliding"),
    )


POLICIES = ("static", "incremental", "window", "drift")


def _mean_errors(days: np.ndarray, n: np.ndarray, total: np.ndarray, delay: int, window: int, delta: float, limit: float) -> list[tuple]:
    """(policy, days, summed error) of one key, in one pass over its days: every
    forecast is a difference of two running sums."""
    sums = np.stack([np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0.0], np.cumsum(total)])])
    # First day after the last alarm, as known after each day.
    cut = np.zeros(days.size, np.int64)
    seen, mean, m, low, start = 0, 0.0, 0.0, 0.0, 0
    for i in range(days.size):
        v = total[i] / n[i]
        seen += 1
        mean += (v - mean) / seen
        m += v - mean - delta
        low = m if seen == 1 else min(low, m)
        if m - low > limit:
            seen, mean, m, low, start = 0, 0.0, 0.0, 0.0, i
        cut[i] = start
    known = np.searchsorted(days, days - delay, side="right")
    heads = {"static": np.zeros(days.size, np.int64), "incremental": np.zeros(days.size, np.int64), "window": np.searchsorted(days, days - delay - window, side="right"), "drift": cut[np.maximum(known - 1, 0)]}
    ends = {p: np.ones(days.size, np.int64) if p == "static" else known for p in POLICIES}
    out = []
    for p in POLICIES:
        some = (known > 0) & (ends[p] > heads[p])
        a, b = heads[p][some], ends[p][some]
        forecast = (sums[1, b] - sums[1, a]) / (sums[0, b] - sums[0, a])
        if (known > 0).any():
            out.append((p, int(some.sum()), float(np.abs(forecast - total[some] / n[some]).sum())))
    return out


def update_policies(daily: DataFrame, key: str, delay: int, window: int, delta: float, limit: float) -> DataFrame:
    """Mean absolute error per key and policy (static, incremental, window,
    drift) of a mean model under one label delay in days.

    daily(key, day_no, n, total): sums per key and day, so a key is as long as
    its days however many events it has. A day's forecast uses only days up to
    day - delay; static keeps the first seen day; drift starts again after a
    Page-Hinkley alarm on daily means. Time is in proportion to the days."""
    g = daily.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("day_no").cast("bigint").alias("day_no"), F.col("n").cast("bigint").alias("n"), F.col("total").cast("double").alias("total")))).alias("d"))
    kind = g.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, days, n, total in zip(b[key], b["day"], b["n"], b["total"]):
                out += [(k, *r) for r in _mean_errors(np.asarray(days), np.asarray(n), np.asarray(total), delay, window, delta, limit)]
            yield pd.DataFrame(out, columns=[key, "policy", "days", "err"])

    lists = g.select(key, F.col("d.day_no").alias("day"), F.col("d.n").alias("n"), F.col("d.total").alias("total"))
    rows = lists.mapInPandas(run, f"{key} {kind}, policy string, days bigint, err double")
    return rows.select(key, "policy", "days", F.round(F.try_divide("err", F.col("days").cast("double")), 6).alias("mae"))


class LogitPolicies:
    """Online logistic regression of one key under every update policy.

    Each event is scored before its label is used; a label is used once the event
    is ``delay`` seconds old. incremental learns from every label, static from the
    first ``warm`` ones, window starts anew every ``window`` seconds, drift after a
    Page-Hinkley alarm on its own log loss."""

    def __init__(self, size: int, rate: float, warm: int, window_s: int, delta: float, limit: float):
        self.size, self.rate, self.warm, self.window, self.delta, self.limit = size, rate, warm, window_s, delta, limit

    def start(self) -> dict:
        zero = lambda: [0.0] * self.size
        return {"w": [zero() for _ in POLICIES], "seen": 0, "opened": None, "ph": [0.0, 0.0, 0.0, 0.0], "resets": [0] * len(POLICIES)}

    @staticmethod
    def _p(w: list[float], x: list[float]) -> float:
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x))))))

    def scores(self, state: dict, x: list[float]) -> list[float]:
        return [self._p(w, x) for w in state["w"]]

    def learn(self, state: dict, at: float, x: list[float], y: float) -> None:
        if state["opened"] is None:
            state["opened"] = at
        if at - state["opened"] >= self.window:
            state["opened"], state["w"][2] = at, [0.0] * self.size
            state["resets"][2] += 1
        p = self._p(state["w"][3], x)
        loss = -math.log(max(1e-12, p if y else 1 - p))
        n, mean, m, low = state["ph"]
        n += 1
        mean += (loss - mean) / n
        m += loss - mean - self.delta
        low = m if n == 1 else min(low, m)
        if m - low > self.limit:
            n, mean, m, low, state["w"][3] = 0.0, 0.0, 0.0, 0.0, [0.0] * self.size
            state["resets"][3] += 1
        state["ph"] = [n, mean, m, low]
        for i, name in enumerate(POLICIES):
            if name != "static" or state["seen"] < self.warm:
                step = self.rate * (y - self._p(state["w"][i], x))
                state["w"][i] = [a + step * b for a, b in zip(state["w"][i], x)]
        state["seen"] += 1

    def learn_all(self, state: dict, at: list[float], x: list[list[float]], y: list[float]) -> list[np.ndarray]:
        """:meth:`learn` for one event after another. Gives every policy's weights
        before the first and after each of them, one row an event; static's rows end
        where it stops learning."""
        (w0, w1, w2, w3), seen, opened = state["w"], state["seen"], state["opened"]
        (n, mean, m, low), (window, rate, delta, limit) = state["ph"], (self.window, self.rate, self.delta, self.limit)
        exp, log, dot = math.exp, math.log, math.sumprod
        kept0, kept1, kept2, kept3 = [w0], [w1], [w2], [w3]
        for t, u, v in zip(at, x, y):
            if opened is None:
                opened = t
            if t - opened >= window:
                opened, w2 = t, [0.0] * self.size
                state["resets"][2] += 1
            # A score is cut at 30 both ways; what is no number counts as 30.
            z = dot(w3, u)
            p = 1.0 / (1.0 + exp(-(z if -30.0 < z < 30.0 else -30.0 if z <= -30.0 else 30.0)))
            loss = -log(max(1e-12, p if v else 1 - p))
            n += 1
            mean += (loss - mean) / n
            m += loss - mean - delta
            low = m if n == 1 else min(low, m)
            if m - low > limit:
                n, mean, m, low, w3, p = 0.0, 0.0, 0.0, 0.0, [0.0] * self.size, 0.5
                state["resets"][3] += 1
            step = rate * (v - p)
            w3 = [a + step * b for a, b in zip(w3, u)]
            kept3.append(w3)
            z = dot(w1, u)
            step = rate * (v - 1.0 / (1.0 + exp(-(z if -30.0 < z < 30.0 else -30.0 if z <= -30.0 else 30.0))))
            w1 = [a + step * b for a, b in zip(w1, u)]
            kept1.append(w1)
            z = dot(w2, u)
            step = rate * (v - 1.0 / (1.0 + exp(-(z if -30.0 < z < 30.0 else -30.0 if z <= -30.0 else 30.0))))
            w2 = [a + step * b for a, b in zip(w2, u)]
            kept2.append(w2)
            if seen < self.warm:
                step = rate * (v - self._p(w0, u))
                w0 = [a + step * b for a, b in zip(w0, u)]
                kept0.append(w0)
            seen += 1
        state |= {"w": [w0, w1, w2, w3], "seen": seen, "opened": opened, "ph": [n, mean, m, low]}
        return [np.array(k) for k in (kept0, kept1, kept2, kept3)]

    @staticmethod
    def score_all(weights: list[np.ndarray], learnt: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Scores of events under each policy, ``learnt`` events after the first weights."""
        out = np.empty((len(x), len(weights)))
        for i, w in enumerate(weights):
            z = np.einsum("ij,ij->i", w[np.minimum(learnt, len(w) - 1)], x)
            z = np.where(z < 30.0, z, 30.0)
            out[:, i] = 1.0 / (1.0 + np.exp(-np.maximum(z, -30.0)))
        return out


_LOGIT = "key bigint, event_id bigint, ts timestamp, " + ", ".join(f"{p} double" for p in POLICIES)


class _LogitStream(_Slices):
    """Events go in order: an event is scored after the labels that were old enough
    before it are used. The numbers of a row are its label and its features."""

    def __init__(self, model: LogitPolicies, delay_s: int, slice_ms: int) -> None:
        super().__init__(slice_ms, 1 + model.size)
        self.model, self.delay = model, delay_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("state", "body string")
        # Scored events whose labels are not old enough yet, in order.
        self.unlearnt = handle.getListState("unlearnt", _PACKED)

    def numbers(self, b: pd.DataFrame) -> np.ndarray:
        return np.column_stack([b["y"].to_numpy(np.float64), np.stack([np.asarray(x, np.float64) for x in b["x"]])])

    @staticmethod
    def order(us: np.ndarray, ids: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """By time, id and label; what is alike in these by the features' text."""
        order = np.lexsort((rest[:, 0], ids, us))
        a, b = order[1:], order[:-1]
        if ((us[a] == us[b]) & (ids[a] == ids[b]) & (rest[a, 0] == rest[b, 0])).any():
            text = [json.dumps(r) for r in rest[:, 1:].tolist()]
            order = np.array(sorted(order.tolist(), key=lambda i: (us[i], ids[i], rest[i, 0], text[i])))
        return order

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = self.due(timerValues.getCurrentWatermarkInMs())
        if due is None:
            return
        order = self.order(*due)
        young = _unpack(self.unlearnt.get(), self.width)
        us, ids, rest = (np.concatenate([a, b[order]]) for a, b in zip(young, due))
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.model.start()
        head, first, y, x = 0, len(young[0]), rest[:, 0], rest[:, 1:]
        # How many labels are old enough when an event comes; its own is not.
        ripe = np.minimum(np.searchsorted(us, us - self.delay * 1_000_000, side="right"), np.arange(len(us)))

        def learn(upto: int) -> list[np.ndarray]:
            nonlocal head
            own, head = slice(head, upto), upto
            return self.model.learn_all(state, (us[own] / 1e6).tolist(), x[own].tolist(), y[own].tolist())

        low = first
        while low < len(us):
            while ripe[low] - head > _PACK_ROWS:
                learn(head + _PACK_ROWS)
            # Events that a bounded number of labels goes before.
            high = min(low + _PACK_ROWS, int(np.searchsorted(ripe, head + _PACK_ROWS, side="right")))
            known = head
            scores = self.model.score_all(learn(int(ripe[high - 1])), ripe[low:high] - known, x[low:high])
            out = pd.DataFrame(scores, columns=list(POLICIES))
            yield out.assign(key=int(key[0]), event_id=ids[low:high], ts=pd.to_datetime(us[low:high], unit="us"))[["key", "event_id", "ts", *POLICIES]]
            low = high
        self.state.update((json.dumps(state),))
        if head < len(us):
            self.unlearnt.put(_pack(us[head:], ids[head:], rest[head:]))
        else:
            self.unlearnt.clear()


def logit_policies(stream: DataFrame, model: LogitPolicies, label_delay_s: int, delay: str, slice_s: int = 3600) -> DataFrame:
    """Scores of every event under all update policies, in event order, from
    stream(key, event_id, ts, x array<double>, y). State holds the weights, the rows
    of slices the watermark has not passed and those younger than the label delay."""
    src = stream.withWatermark("ts", delay).select("key", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("y").cast("double").alias("y"), "x")
    return src.groupBy("key").transformWithStateInPandas(_LogitStream(model, label_delay_s, slice_s * 1000), _LOGIT, "Append", "EventTime")


def policy_losses(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean log loss per key and policy. scored is what ``logit_policies`` gives,
    labels(event_id, y)."""
    long = scored.join(labels, "event_id").unpivot(["key", "event_id", "y"], list(POLICIES), "policy", "p")
    p = F.greatest(F.lit(1e-12), F.when(F.col("y") > 0, F.col("p")).otherwise(1 - F.col("p")))
    return long.groupBy("key", "policy").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(-F.ln(p)), 6).alias("log_loss"))


def feature_table(out: str, source: DataFrame, key: str, ts: str, tie: str, values: Sequence[str], share: float = 0.5) -> StateTable:
    """State table of the newest feature values per key."""
    schema = T.StructType([source.schema[c] for c in (key, ts, tie, *values)])
    return StateTable(out, key, [F.col(ts), F.col(tie)], schema, share=share)


def materialize_features(table: StateTable):
    """foreachBatch function: newest feature values per key, one delta per batch,
    folded into the base when deltas grow; read them with :func:`online_features`."""
    return table.write


def online_features(spark: SparkSession, table: StateTable, keys: DataFrame | None = None) -> DataFrame:
    """Newest features of all keys, or of some, which read their buckets only."""
    rows = table.read(spark) if keys is None else table.lookup(spark, keys)
    return rows
