"""Queries over event streams."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from sievework.functions.columns import h32, h32_sql as H, ts_text
from sievework.plans import derive as D
from sievework.plans.registry import query
from sievework.session import scratch_path, table
from sievework.streaming import events as E


def as_stream(spark, df, max_files=3, files=6):
    """The frame written as files and read back as a replayable stream."""
    path = scratch_path(spark, "stream-in")
    df.repartition(files).write.parquet(path)
    return E.replay_stream(spark, path, df.schema, max_files)


BLOCKS, BLOCK_DAYS = 6, 5


def as_arrivals(spark, df, at="arrival"):
    """The frame as a stream of one file a batch, in blocks of days of arrival."""
    path = scratch_path(spark, "arrivals")
    first = df.agg(F.date_trunc("DAY", F.min(at))).scalar()
    days = F.floor((F.unix_seconds(F.col(at)) - F.unix_seconds(first)) / (BLOCK_DAYS * 86400))
    E.write_arrivals(df, path, F.least(days, F.lit(BLOCKS - 1)), BLOCKS)
    return E.replay_stream(spark, path, df.schema, 1)


def late_changes(spark, sf):
    """Changes of which every eighth number arrives up to twelve days later."""
    n = h32("seq", F.lit("L"))
    slow = F.when(n % 8 == 0, (n % 13) * 86400).otherwise(0)
    return D.changes(spark, sf).withColumn("arrival", F.timestamp_seconds(F.unix_seconds("arrival") + slow))


# A row of batch b is late if the watermark of the batches up to b - 2 has reached it.
LATE_CHANGES = f"""slow AS (SELECT * REPLACE (make_timestamp(epoch_us(arrival) + (CASE WHEN {H("seq::VARCHAR||'L'")}%8=0 THEN {H("seq::VARCHAR||'L'")}%13 ELSE 0 END)*86400000000) AS arrival) FROM changes),
 blocks AS (SELECT *, least((epoch(arrival)::BIGINT - epoch(date_trunc('day',(SELECT min(arrival) FROM slow)))::BIGINT)//({BLOCK_DAYS}*86400),{BLOCKS - 1}) AS b FROM slow),
 marks AS (SELECT b, max(max(epoch_us(ts))) OVER (ORDER BY b) AS m FROM blocks GROUP BY b),
 timely AS (SELECT * FROM blocks WHERE epoch_us(ts) > coalesce((SELECT max(m) FROM marks WHERE marks.b<=blocks.b-2)//1000*1000-1800000000,0)),
 done AS (SELECT max(epoch_us(ts))//1000*1000-1800000000 AS wm FROM blocks)"""


def events(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("S5_replay_stream", "SELECT event_type, count(*) AS n, round(sum(value),6) AS total FROM events GROUP BY 1")
def s5(spark, sf):
    out = scratch_path(spark, "replayed")
    E.run_to_files(as_stream(spark, events(spark, sf)), out, scratch_path(spark, "cp"))
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query(
    "E1_conform_events",
    """SELECT event_id AS sequence, json_extract_string(props,'$.k')::BIGINT AS k, md5(user_id||'|'||event_id||'|'||event_type) AS idempotency_key FROM events WHERE event_id%41<>0 AND event_id%43<>0 AND event_id%47<>0""",
)
def e1(spark, sf):
    e = events(spark, sf)
    i = F.col("event_id")
    t = ts_text(F.col("ts"))
    raw = e.select(
        F.col("user_id").cast("string").alias("key"), F.when(i % 41 == 0, "yesterday").otherwise(t).alias("event_time"), F.when(i % 43 == 0, "2020-01-01 00:00:00").otherwise(t).alias("ingest_time"),
        i.cast("string").alias("sequence"), F.col("event_type").alias("type"), F.when(i % 47 == 0, "{k").otherwise(F.col("props")).alias("payload"),
    )
    return E.conform_events(raw, T.StructType([T.StructField("k", T.LongType())]))[0].select("sequence", "payload.k", "idempotency_key")


@query("E2_dedup_events", D.with_(D.CHANGES) + " SELECT DISTINCT key, seq, op FROM changes")
def e2(spark, sf):
    return E.dedup_events(D.changes(spark, sf), ["key", "seq"], "ts", "3 hours", ["arrival", "copy"]).select("key", "seq", "op")


@query("E2_dedup_events_stream", D.with_(D.CHANGES, LATE_CHANGES) + " SELECT DISTINCT key, seq, op FROM timely")
def e2s(spark, sf):
    """Keys live in state for 30 minutes of event time; rows behind it are dropped."""
    out = scratch_path(spark, "deduped")
    E.run_to_files(E.dedup_events(as_arrivals(spark, late_changes(spark, sf)), ["key", "seq"], "ts", "30 minutes"), out, scratch_path(spark, "cp"))
    return spark.read.parquet(out).select("key", "seq", "op")


LATE = """late AS (SELECT *, max(ts) OVER (ORDER BY arrival, seq, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM changes),
 cl AS (SELECT *, CASE WHEN seen IS NULL OR seen<=ts THEN 'on_time' WHEN epoch_us(seen)-epoch_us(ts)<=3600000000 THEN 'out_of_order' ELSE 'late' END AS lateness FROM late)"""


@query("E3_classify_lateness", D.with_(D.CHANGES, LATE) + " SELECT seq, copy, lateness FROM cl")
def e3(spark, sf):
    return E.classify_lateness(D.changes(spark, sf), ["arrival", "seq", "copy"], "ts", 3600.0).select("seq", "copy", "lateness")


_WIN = "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts),'%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value),6) AS total, round(avg(value),6) AS mean FROM events GROUP BY 1,2"


def shown(d):
    return d.select(ts_text(F.col("window_start")).alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"), F.round("mean", 6).alias("mean"))


@query("E4_window_counts", _WIN)
def e4(spark, sf):
    return shown(E.window_counts(events(spark, sf), "ts", "event_type", "value", "6 hours"))


@query("E4_window_counts_stream", _WIN)
def e4s(spark, sf):
    out = scratch_path(spark, "windows")
    E.run_to_files(E.window_counts(as_stream(spark, events(spark, sf)), "ts", "event_type", "value", "6 hours", delay="40 days"), out, scratch_path(spark, "cp"), "update")
    return shown(E.newest_batch(spark, out, ["window_start", "event_type"]))


@query(
    "E4_late_rows_stream",
    D.with_(D.CHANGES, LATE_CHANGES)
    + """ SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts),'%Y-%m-%d %H:%M:%S') AS window_start, op AS event_type, count(*) AS n, round(sum(value),6) AS total,
 (SELECT count(*) FROM blocks)-(SELECT count(*) FROM timely) AS dropped FROM timely, done GROUP BY time_bucket(INTERVAL 6 HOUR, ts), op, wm HAVING epoch_us(time_bucket(INTERVAL 6 HOUR, ts))+21600000000 <= wm""",
)
def e4d(spark, sf):
    """Windows that the watermark has closed, and the rows dropped behind it."""
    out = scratch_path(spark, "closed")
    q = E.run_to_files(E.closed_windows(as_arrivals(spark, late_changes(spark, sf)), "ts", "op", "value", 6 * 3600, "30 minutes"), out, scratch_path(spark, "cp"))
    dropped = sum(f["dropped"] for f in E.state_figures(q))
    return shown(E.window_totals(spark.read.parquet(out))).drop("mean").withColumn("dropped", F.lit(dropped).cast("bigint"))


@query(
    "E4_sliding_windows",
    """SELECT strftime(ws,'%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value),6) AS total, round(avg(value),6) AS mean FROM (SELECT *, unnest([time_bucket(INTERVAL 2 HOUR, ts), time_bucket(INTERVAL 2 HOUR, ts)-INTERVAL 2 HOUR]) AS ws FROM events) GROUP BY 1,2""",
)
def e4b(spark, sf):
    return shown(E.window_counts(events(spark, sf), "ts", "event_type", "value", "4 hours", "2 hours"))


@query("E4_late_rows", D.with_(D.CHANGES, LATE) + " SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts),'%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS dropped FROM cl WHERE lateness='late' GROUP BY 1")
def e4c(spark, sf):
    c = E.classify_lateness(D.changes(spark, sf), ["arrival", "seq", "copy"], "ts", 3600.0)
    return E.late_counts(c, "ts", "6 hours").withColumn("window_start", ts_text(F.col("window_start")))


_FOLD = D.with_(D.CHANGES) + " SELECT key, max(seq) AS seq, arg_max(op,seq) AS op, CASE WHEN arg_max(op,seq)<>'delete' THEN arg_max(value,seq) END AS value, arg_max(op,seq)<>'delete' AS alive FROM changes GROUP BY 1"


@query("E5_fold_state", _FOLD)
def e5(spark, sf):
    return E.fold_state(D.changes(spark, sf))


@query("E5_fold_state_stream", _FOLD)
def e5s(spark, sf):
    out = scratch_path(spark, "folded")
    E.run_to_files(E.fold_state_stream(as_stream(spark, D.changes(spark, sf).select("key", "seq", "op", "value"))), out, scratch_path(spark, "cp"), "update")
    return E.newest_batch(spark, out, ["key"])


@query("E6_replay_check", D.with_(D.CHANGES) + " SELECT 0::BIGINT AS differing_keys, true AS same, count(DISTINCT key) AS keys FROM changes")
def e6(spark, sf):
    d = D.changes(spark, sf).select("key", "seq", "op", "value", "copy")
    path = scratch_path(spark, "stream-in")
    d.repartition(6).write.parquet(path)
    runs = []
    for n in (2, 6):
        log, cp = scratch_path(spark, "log"), scratch_path(spark, "cp")
        writer = E.apply_changes(log, d.select("key").distinct())
        for _ in range(2):  # the second start resumes from the checkpoint
            E.drain(E.replay_stream(spark, path, d.schema, n), writer, cp)
        runs.append(E.current_state(spark, log))
    return E.replay_check(runs[0], runs[1], ["key"]).select("differing_keys", "same").withColumn("keys", runs[0].agg(F.count(F.lit(1))).scalar())


def preds_labels(spark, sf):
    e = events(spark, sf)
    p = e.where("event_type = 'view'").select((F.col("user_id") % 4).alias("project"), F.col("event_id").alias("id"), "ts")
    gap = (h32("event_id", F.lit("lg")) % 7200).cast("int")
    src = e.where("event_type = 'view' and event_id % 5 <> 0").withColumn("c", F.explode(F.sequence(F.lit(1), F.when(F.col("event_id") % 7 == 0, 2).otherwise(1))))
    la = src.select(
        F.when(F.col("event_id") % 11 == 0, 9).otherwise(F.col("user_id") % 4).cast("bigint").alias("project"), F.col("event_id").alias("id"), (F.col("event_id") * 10 + F.col("c")).alias("label_id"),
        F.timestamp_micros(F.unix_micros("ts") + gap.cast("bigint") * 1000000 + F.col("c") * 1000000).alias("ts"), (F.col("c") + F.col("event_id") % 2).cast("int").alias("label"),
    )
    return p, la


PL = f"""p AS (SELECT user_id%4 AS project, event_id AS id, ts FROM events WHERE event_type='view'), la AS (SELECT CASE WHEN event_id%11=0 THEN 9 ELSE user_id%4 END AS project, event_id AS id, event_id*10+c AS label_id, make_timestamp(epoch_us(ts)+({H("event_id::VARCHAR||'lg'")}%7200+c)*1000000) AS ts, (c+event_id%2)::INT AS label
  FROM (SELECT *, unnest(generate_series(1,CASE WHEN event_id%7=0 THEN 2 ELSE 1 END)) AS c FROM events WHERE event_type='view' AND event_id%5<>0)),
 j AS (SELECT p.project, p.id, p.ts AS pts, la.label, la.label_id, epoch_us(la.ts)-epoch_us(p.ts) AS g FROM p LEFT JOIN la ON la.project=p.project AND la.id=p.id)"""


@query("E7_join_labels", f"WITH {PL} SELECT project, id, first(label ORDER BY g, label_id) FILTER (g<=5400000000) AS label FROM j GROUP BY 1,2")
def e7(spark, sf):
    return E.join_labels(*preds_labels(spark, sf), 5400.0, 86400)[0].select("project", "id", "label")


@query(
    "E7_label_counts",
    f"""WITH {PL}, k AS (SELECT project, id, pts, count(*) FILTER (g<=5400000000) AS i, count(*) FILTER (g>5400000000) AS l FROM j GROUP BY 1,2,3)
 SELECT project, strftime(pts,'%Y-%m-%d') AS day, count(*) AS predictions, count(*) FILTER (i>0) AS labelled, sum(greatest(i-1,0))::BIGINT AS duplicates, sum(l)::BIGINT AS late, count(*) FILTER (i=0) AS missing FROM k GROUP BY 1,2""",
)
def e7b(spark, sf):
    c = E.join_labels(*preds_labels(spark, sf), 5400.0, 86400)[1]
    return c.select("project", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "predictions", "labelled", "duplicates", "late", "missing")


def joined_stream(spark, sf):
    """Predictions and labels, both in order of time, joined with half an hour of delay."""
    p, la = preds_labels(spark, sf)
    out = scratch_path(spark, "joined")
    E.run_to_files(E.stream_join_labels(as_arrivals(spark, p, "ts"), as_arrivals(spark, la, "ts"), "5400 seconds", "30 minutes"), out, scratch_path(spark, "cp"))
    return spark.read.parquet(out)


@query("E8_stream_join_labels", f"WITH {PL} SELECT project, id, label FROM j WHERE g<=5400000000")
def e8(spark, sf):
    return joined_stream(spark, sf).where("label is not null").select("project", "id", "label")


@query(
    "E8_unmatched",
    f"""WITH {PL}, done AS (SELECT least((SELECT max(epoch_us(ts)) FROM p), (SELECT max(epoch_us(ts)) FROM la))//1000*1000-1800000000 AS wm)
 SELECT project, id, strftime(pts,'%Y-%m-%d %H:%M:%S') AS at FROM j, done GROUP BY project, id, pts, wm HAVING count(*) FILTER (g<=5400000000)=0 AND epoch_us(pts)+5400000000 < wm""",
)
def e8b(spark, sf):
    """Predictions whose horizon the watermark has passed without a label."""
    return joined_stream(spark, sf).where("label is null").select("project", "id", ts_text(F.col("pred_ts")).alias("at"))


@query("E9_dead_letter", "SELECT event_id, CASE WHEN event_type='error' AND value<2 THEN 'type,value' WHEN event_type='error' THEN 'type' ELSE 'value' END AS reason, event_type<>'error' AS retryable, 1::INT AS attempt FROM events WHERE event_type='error' OR value<2")
def e9(spark, sf):
    good, bad = scratch_path(spark, "good"), scratch_path(spark, "bad")
    rules = [("type", F.col("event_type") == "error"), ("value", F.col("value") < 2)]
    src = events(spark, sf).withColumn("attempt", F.lit(None).cast("int"))
    E.drain(as_stream(spark, src), E.dead_letter(good, bad, rules, ["type"], "conform"), scratch_path(spark, "cp"))
    return spark.read.parquet(bad).select("event_id", F.array_join("broken_rules", ",").alias("reason"), "retryable", "attempt")


@query(
    "E10_apply_changes",
    D.with_(D.CHANGES) + " SELECT key, max(seq) AS seq, arg_max(op,seq) AS op, arg_max(op,seq)<>'delete' AS alive FROM changes WHERE key%9<>0 GROUP BY 1",
)
def e10(spark, sf):
    d = D.changes(spark, sf).select("key", "seq", "op", "value")
    log = scratch_path(spark, "log")
    E.drain(as_stream(spark, d), E.apply_changes(log, d.where("key % 9 <> 0").select("key")), scratch_path(spark, "cp"))
    return E.current_state(spark, log).select("key", "seq", "op", "alive")


@query(
    "E11_capture_feedback",
    """WITH f AS (SELECT event_id-event_id%3 AS request_id, user_id AS caller, min(event_id) AS e FROM events WHERE event_type='click' GROUP BY 1,2) SELECT f.request_id, f.caller FROM f JOIN events e ON e.event_id=f.request_id AND e.user_id=f.caller""",
)
def e11(spark, sf):
    e = events(spark, sf)
    req = (F.col("event_id") - F.col("event_id") % 3).alias("request_id")
    f = e.where("event_type = 'click'").select(F.concat_ws("|", req, "user_id").alias("idem"), req, F.col("user_id").alias("caller"), "ts", F.col("value").alias("rating"))
    return E.capture_feedback(f, e.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("caller")), 5, 3600)[0].select("request_id", "caller")


@query(
    "E11_feedback_rate",
    """WITH f AS (SELECT user_id AS caller, min(ts) AS ts FROM (SELECT *, event_id-event_id%3 AS r FROM events WHERE event_type IN ('click','view')) GROUP BY user_id, r) SELECT caller, strftime(ts,'%Y-%m-%d') AS day, count(*) AS n FROM f GROUP BY 1,2 HAVING count(*)>3""",
)
def e11b(spark, sf):
    e = events(spark, sf)
    req = (F.col("event_id") - F.col("event_id") % 3).alias("request_id")
    f = e.where("event_type in ('click', 'view')").select(F.concat_ws("|", req, "user_id").alias("idem"), req, F.col("user_id").alias("caller"), "ts", F.col("value").alias("rating"))
    r = E.capture_feedback(f, e.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("caller")), 3, 86400)[1]
    return r.select("caller", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n")


@query(
    "E12_page_hinkley",
    """WITH a AS (SELECT user_id%5 AS key, ts, event_id, value, avg(value) OVER w AS mn FROM events WINDOW w AS (PARTITION BY user_id%5 ORDER BY ts, event_id)), b AS (SELECT *, sum(value-mn-0.5::DOUBLE) OVER (PARTITION BY key ORDER BY ts, event_id) AS m FROM a)
 SELECT key, event_id, round(m-min(m) OVER (PARTITION BY key ORDER BY ts, event_id),4) AS ph FROM b""",
)
def e12(spark, sf):
    e = events(spark, sf).withColumn("key", F.col("user_id") % 5)
    return E.page_hinkley(e, "key", ["ts", "event_id"], "value", 0.5, 100.0).select("key", "event_id", F.round("ph", 4).alias("ph"))


@query(
    "E12_drift_detector_stream",
    """WITH RECURSIVE e AS (SELECT user_id%5 AS key, event_id, value, row_number() OVER (PARTITION BY user_id%5 ORDER BY ts, event_id) AS i FROM events WHERE (epoch_ms(ts)//3600000+1)*3600000 <= (SELECT max(epoch_ms(ts)) FROM events)-10800000),
 r AS (SELECT key, 0::BIGINT AS i, NULL::BIGINT AS event_id, 0::BIGINT AS n, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS m, 0.0::DOUBLE AS low, NULL::DOUBLE AS ph FROM e GROUP BY key
  UNION ALL SELECT key, i, event_id, CASE WHEN hit THEN 0 ELSE n END, CASE WHEN hit THEN 0 ELSE mean END, CASE WHEN hit THEN 0 ELSE m END, CASE WHEN hit THEN 0 ELSE low END, CASE WHEN hit THEN m-low END
  FROM (SELECT *, m-low > 100.0::DOUBLE AS hit FROM (SELECT key, i, event_id, n, mean, m, CASE WHEN n>1 THEN least(low,m) ELSE m END AS low
   FROM (SELECT key, i, event_id, n, mean, m+value-mean-0.5::DOUBLE AS m, low FROM (SELECT e.key, e.i, e.event_id, e.value, r.n+1 AS n, r.mean+(e.value-r.mean)/(r.n+1) AS mean, r.m, r.low FROM r JOIN e ON e.key=r.key AND e.i=r.i+1)))))
 SELECT key, event_id, round(ph,6) AS ph, 'm1' AS model_version FROM r WHERE ph IS NOT NULL""",
)
def e12s(spark, sf):
    out = scratch_path(spark, "alarms")
    e = events(spark, sf).withColumn("arrival", F.timestamp_seconds(F.unix_seconds("ts") + h32("event_id", F.lit("a")) % 7200))
    src = as_arrivals(spark, e.select((F.col("user_id") % 5).alias("key"), "event_id", "ts", "value", "arrival"))
    E.run_to_files(E.drift_detector(src, 0.5, 100.0, "m1", "3 hours"), out, scratch_path(spark, "cp"))
    return spark.read.parquet(out).select("key", "event_id", F.round("ph", 6).alias("ph"), "model_version")


@query(
    "E13_prequential",
    """SELECT user_id, event_id, round(avg(ok) OVER (PARTITION BY user_id ORDER BY ts, event_id),6) AS cumulative, round(avg(ok) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),6) AS sliding FROM (SELECT *, (event_type<>'error' AND value>3)::INT AS ok FROM events)""",
)
def e13(spark, sf):
    e = events(spark, sf).select("user_id", "event_id", "ts", "event_type", "value")
    p = E.prequential(e, "user_id", ["ts", "event_id"], (F.col("event_type") != "error") & (F.col("value") > 3), "ts", 10)
    return p.select("user_id", "event_id", "cumulative", "sliding")


@query(
    "E14_update_policies",
    """WITH d AS (SELECT user_id AS key, day(ts) AS dn, count(*) AS n, sum(value) AS t FROM events GROUP BY 1,2), x AS (SELECT a.key, a.dn, a.t/a.n AS y, sum(b.t)/sum(b.n) AS inc, arg_min(b.t/b.n,b.dn) AS st, sum(b.t) FILTER (b.dn>a.dn-2-7)/sum(b.n) FILTER (b.dn>a.dn-2-7) AS wi FROM d a JOIN d b ON a.key=b.key AND b.dn<=a.dn-2 GROUP BY a.key,a.dn,a.t,a.n)
 SELECT key, 'static' AS policy, count(*) AS days, round(avg(abs(st-y)),6) AS mae FROM x GROUP BY 1 UNION ALL SELECT key, 'incremental', count(*), round(avg(abs(inc-y)),6) FROM x GROUP BY 1 UNION ALL SELECT key, 'window', count(wi), round(avg(abs(wi-y)),6) FROM x GROUP BY 1""",
)
def e14(spark, sf):
    return policies(spark, sf).where("policy <> 'drift'")


@query(
    "E14_drift_policy",
    """WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY dn) AS i FROM (SELECT user_id AS key, day(ts) AS dn, count(*) AS n, sum(value) AS t FROM events GROUP BY 1,2)),
 r AS (SELECT DISTINCT key, 0::BIGINT AS i, 0::BIGINT AS dn, 0::BIGINT AS n, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS m, 0.0::DOUBLE AS low, -1::BIGINT AS cut FROM d
  UNION ALL SELECT key, i, dn, CASE WHEN hit THEN 0 ELSE n END, CASE WHEN hit THEN 0 ELSE mean END, CASE WHEN hit THEN 0 ELSE m END, CASE WHEN hit THEN 0 ELSE low END, CASE WHEN hit THEN dn ELSE cut END
  FROM (SELECT *, m-low > 20.0::DOUBLE AS hit FROM (SELECT key, i, dn, n, mean, m, CASE WHEN n=1 THEN m ELSE least(low,m) END AS low, cut
   FROM (SELECT key, i, dn, n, mean, m+v-mean-0.5::DOUBLE AS m, low, cut FROM (SELECT d.key, d.i, d.dn, d.t/d.n AS v, r.n+1 AS n, r.mean+(d.t/d.n-r.mean)/(r.n+1) AS mean, r.m, r.low, r.cut FROM r JOIN d ON d.key=r.key AND d.i=r.i+1))))),
 k AS (SELECT a.key, a.dn, a.t/a.n AS y, max(r.i) AS i FROM d a JOIN r ON r.key=a.key AND r.i>0 AND r.dn<=a.dn-2 GROUP BY ALL),
 x AS (SELECT k.key, k.dn, any_value(y) AS y, sum(b.t)/sum(b.n) AS f FROM k JOIN r ON r.key=k.key AND r.i=k.i JOIN d b ON b.key=k.key AND b.dn<=k.dn-2 AND b.dn>=r.cut GROUP BY 1,2)
 SELECT key, 'drift' AS policy, count(*) AS days, round(avg(abs(f-y)),6) AS mae FROM x GROUP BY 1""",
)
def e14b(spark, sf):
    return policies(spark, sf).where("policy = 'drift'")


def policies(spark, sf):
    d = events(spark, sf).groupBy(F.col("user_id").alias("key"), F.dayofmonth("ts").cast("bigint").alias("day_no")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return E.update_policies(d, "key", 2, 7, 0.5, 20.0)


def logit_events(spark, sf):
    e = events(spark, sf)
    x = F.array(F.lit(1.0), F.col("value") / 100, (F.hour("ts") / 24.0), (F.col("event_type") == "click").cast("double"))
    return e.select((F.col("user_id") % 5).alias("key"), "event_id", "ts", x.alias("x"), (F.col("event_type").isin("purchase", "click") & (F.col("value") > 20)).cast("double").alias("y"))


@query("E14_logit_policies")
def e14c(spark, sf):
    """Held against a plain replay in the tests."""
    e = logit_events(spark, sf)
    out = scratch_path(spark, "scores")
    E.run_to_files(E.logit_policies(as_arrivals(spark, e, "ts"), E.LogitPolicies(4, 0.3, 100, 7 * 86400, 0.05, 5.0), 6 * 3600, "1 hour"), out, scratch_path(spark, "cp"))
    return E.policy_losses(spark.read.parquet(out), e.select("event_id", "y"))


@query("E15_materialize_features", "SELECT user_id, arg_max(value,event_id) AS value, arg_max(event_type,event_id) AS event_type FROM events GROUP BY 1")
def e15(spark, sf):
    e = events(spark, sf)
    features = E.feature_table(scratch_path(spark, "features"), e, "user_id", "ts", "event_id", ["value", "event_type"])
    E.drain(as_stream(spark, e), E.materialize_features(features), scratch_path(spark, "cp"))
    return E.online_features(spark, features).select("user_id", "value", "event_type")


@query("E15_lookup_features", "SELECT user_id, arg_max(value,event_id) AS value FROM events WHERE user_id%7=3 GROUP BY 1")
def e15b(spark, sf):
    """Some keys, from their buckets and the open deltas."""
    e = events(spark, sf)
    features = E.feature_table(scratch_path(spark, "features"), e, "user_id", "ts", "event_id", ["value"])
    E.drain(as_stream(spark, e, max_files=1), E.materialize_features(features), scratch_path(spark, "cp"))
    return E.online_features(spark, features, e.where("user_id % 7 = 3").select("user_id")).select("user_id", "value")
