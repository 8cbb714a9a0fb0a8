"""Queries over service, cost and audit analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions.columns import h32, h32_sql as H
from sievework.operators import audit as A, monitoring as O, sketches as SK
from sievework.operators.evaluation import POISSON_ONE
from sievework.plans import derive as D
from sievework.plans.registry import query
from sievework.session import scratch_path, table

EV = lambda tag: H(f"event_id::VARCHAR||'{tag}'")


@query(
    "O1_service_sli",
    D.with_(D.REQUESTS)
    + """ SELECT service, strftime(date_trunc('day',ts),'%Y-%m-%d') AS day, count(*) AS n, round(1-count(*) FILTER (failed)/count(*)::DOUBLE,6) AS availability, round(count(*) FILTER (failed)/count(*)::DOUBLE,6) AS error_rate,
 round(count(*)/86400.0::DOUBLE,6) AS throughput, round(count(*)/86400.0::DOUBLE/0.01::DOUBLE,6) AS saturation, round(quantile_cont(latency_ms,0.5),6) AS p50, round(quantile_cont(latency_ms,0.95),6) AS p95, round(quantile_cont(latency_ms,0.99),6) AS p99 FROM requests GROUP BY 1,2""",
)
def o1(spark, sf):
    s = O.service_sli(D.requests(spark, sf), 86400, 0.01)
    return s.select("service", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n", "availability", "error_rate", "throughput", "saturation", "p50", "p95", "p99")


@query(
    "O2_burn_rate",
    D.with_(D.REQUESTS)
    + """, b AS (SELECT service, (floor(epoch_us(ts)/1e6/3600)*3600)::BIGINT AS bucket, count(*) AS n, count(*) FILTER (failed) AS bad FROM requests GROUP BY 1,2),
 w AS (SELECT *, round(sum(bad) OVER s/sum(n) OVER s/(1-0.9::DOUBLE),6) AS burn_short, round(sum(bad) OVER l/sum(n) OVER l/(1-0.9::DOUBLE),6) AS burn_long FROM b
  WINDOW s AS (PARTITION BY service ORDER BY bucket RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW), l AS (PARTITION BY service ORDER BY bucket RANGE BETWEEN 82800 PRECEDING AND CURRENT ROW))
 SELECT *, burn_short>2.5 AND burn_long>2.1 AS alert FROM w""",
)
def o2(spark, sf):
    return O.burn_rate(D.requests(spark, sf), 0.9, 3 * 3600, 24 * 3600, 2.1).withColumn("alert", (F.col("burn_short") > 2.5) & (F.col("burn_long") > 2.1))


@query(
    "O3_sustained_alerts",
    """WITH s AS (SELECT user_id%25 AS subject, strftime(ts,'%Y-%m-%d') AS day, count(*) AS n, avg(value) AS v FROM events GROUP BY 1,2), k AS (SELECT *, v>20 AS b FROM s WHERE n>=8),
 g AS (SELECT *, sum((NOT b)::INT) OVER (PARTITION BY subject ORDER BY day) AS g, min(CASE WHEN NOT b THEN day END) OVER (PARTITION BY subject ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS cl FROM k),
 r AS (SELECT *, row_number() OVER (PARTITION BY subject, g ORDER BY day) AS rk FROM g WHERE b)
 SELECT subject, min(day) FILTER (rk=3) AS opened, max(cl) AS closed, max(rk) AS length, round(max(v),6) AS worst, any_value(n_name) AS owner, 'v'||any_value(n_regionkey) AS model_version, 'd'||any_value(n_regionkey) AS data_version,
 'dashboards/'||subject AS dashboard, 'runbooks/'||subject AS runbook FROM r JOIN nation ON n_nationkey=subject GROUP BY subject, g HAVING count(*)>=3""",
)
def o3(spark, sf):
    e = table(spark, sf, "events").groupBy((F.col("user_id") % 25).alias("subject"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("v"))
    key = F.col("n_nationkey").cast("string")
    labels = table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("subject"), F.col("n_name").alias("owner"), F.concat(F.lit("v"), F.col("n_regionkey").cast("string")).alias("model_version"),
        F.concat(F.lit("d"), F.col("n_regionkey").cast("string")).alias("data_version"), F.concat(F.lit("dashboards/"), key).alias("dashboard"), F.concat(F.lit("runbooks/"), key).alias("runbook"),
    )
    return O.sustained_alerts(e, "subject", "day", "v", "n", 20.0, 3, 8, labels)


_PC = ["l_quantity", "l_extendedprice", "l_tax"]


def _hist(c: str) -> str:
    cells = "||','||".join(f"count(*) FILTER (least(floor(({c}-(SELECT min({c}) FROM lineitem))/((SELECT max({c}) FROM lineitem)-(SELECT min({c}) FROM lineitem))*5),4)={i})" for i in range(5))
    return f"SELECT '{c}' AS \"column\", count(*) AS n, 0::BIGINT AS nulls, min({c}) AS min, max({c}) AS max, round(avg({c}),6) AS mean, round(stddev_samp({c}),6) AS std, quantile_cont({c},0.25) AS q25, quantile_cont({c},0.5) AS q50, quantile_cont({c},0.75) AS q75, {cells} AS histogram FROM lineitem"


@query("O4_profile_numeric", " UNION ALL ".join(_hist(c) for c in _PC))
def o4(spark, sf):
    p = O.profile_numeric(table(spark, sf, "lineitem"), _PC, 5)
    return p.withColumn("histogram", F.array_join(F.transform("histogram", lambda x: x.cast("string")), ","))


@query(
    "O4_profile_categorical",
    """WITH c AS (SELECT 'event_type' AS "column", event_type AS value, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'user', substr(md5(user_id::VARCHAR),1,8), count(*) FROM events GROUP BY 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rk FROM c)
 SELECT "column", CASE WHEN rk<=3 THEN value ELSE '(other)' END AS value, sum(n)::BIGINT AS n FROM r GROUP BY 1,2""",
)
def o4b(spark, sf):
    e = table(spark, sf, "events").withColumn("user", F.col("user_id"))
    return O.profile_categorical(e, ["event_type", "user"], 3, restricted=["user"])


_SLOT = "least(9,greatest(0,floor((v-lo)/(hi-lo)*10)))"


@query(
    "O5_drift",
    f"""WITH b AS (SELECT CASE WHEN year(l_shipdate)<1998 THEN 0 ELSE 1 END AS side, l_quantity + CASE WHEN year(l_shipdate)>=1998 AND l_linenumber<3 THEN 9 ELSE 0 END AS q, l_extendedprice AS p FROM lineitem),
 s AS (SELECT 'q' AS c, side, q AS v FROM b UNION ALL SELECT 'p', side, p FROM b), st AS (SELECT c, min(v) FILTER (side=0) AS lo, max(v) FILTER (side=0) AS hi, count(*) FILTER (side=0) AS na, count(*) FILTER (side=1) AS nb FROM s GROUP BY 1),
 ce AS (SELECT s.c, {_SLOT} AS bin, count(*) FILTER (side=0) AS a, count(*) FILTER (side=1) AS b FROM s JOIN st USING (c) GROUP BY 1,2),
 fu AS (SELECT st.c, i AS bin, na, nb, coalesce(a,0) AS a, coalesce(b,0) AS b, greatest(coalesce(a,0)/na::DOUBLE,0.0001::DOUBLE) AS p, greatest(coalesce(b,0)/nb::DOUBLE,0.0001::DOUBLE) AS q FROM st CROSS JOIN (SELECT unnest(generate_series(0,9)) AS i) LEFT JOIN ce ON ce.c=st.c AND ce.bin=i),
 sh AS (SELECT c, any_value(na) AS na, any_value(nb) AS nb, sum((p-q)*ln(p/q)) AS psi, sum(p*ln(p/((p+q)/2)))/2+sum(q*ln(q/((p+q)/2)))/2 AS js, sum((b-p*nb)*(b-p*nb)/(p*nb)) AS chi2 FROM fu GROUP BY 1),
 cu AS (SELECT c, v, sum(x) OVER (PARTITION BY c ORDER BY v) AS ca, sum(y) OVER (PARTITION BY c ORDER BY v) AS cb FROM (SELECT c, v, count(*) FILTER (side=0) AS x, count(*) FILTER (side=1) AS y FROM s GROUP BY 1,2)),
 ks AS (SELECT c, max(abs(ca/na::DOUBLE-cb/nb::DOUBLE)) AS ks FROM cu JOIN st USING (c) GROUP BY 1)
 SELECT c AS "column", na, nb, round(psi,6) AS psi, round(ks,6) AS ks, round(js,6) AS js, round(chi2,6) AS chi2, CASE WHEN psi>0.2 OR ks>0.1 THEN 'drift' ELSE 'stable' END AS verdict FROM sh JOIN ks USING (c)""",
)
def o5(spark, sf):
    li = table(spark, sf, "lineitem")
    late = F.year("l_shipdate") >= 1998
    d = li.select(late.alias("late"), (F.col("l_quantity") + F.when(late & (F.col("l_linenumber") < 3), 9).otherwise(0)).alias("q"), F.col("l_extendedprice").alias("p"))
    return O.drift(d.where("not late"), d.where("late"), ["q", "p"])


@query(
    "O6_staleness",
    """SELECT event_type, count(*) AS n, round((epoch_us(TIMESTAMP '2024-01-31')-epoch_us(max(ts)))/1e6,3) AS age_s, round(count(*) FILTER (value<=2)/count(*)::DOUBLE,6) AS missing_truth, (epoch_us(TIMESTAMP '2024-01-31')-epoch_us(max(ts)))/1e6>1000 AS breach FROM events GROUP BY 1""",
)
def o6(spark, sf):
    e = table(spark, sf, "events")
    return O.staleness(e, "event_type", "ts", F.when(F.col("value") > 2, F.col("value")), F.lit("2024-01-31").cast("timestamp"), 1000)


@query(
    "O7_canary_split",
    f"""WITH v AS (SELECT CASE WHEN user_id%40=0 THEN 'v2' END AS pin, {H("'c|'||user_id")} % 100 AS b FROM events), w AS (SELECT pin, coalesce(pin, CASE WHEN b<80 THEN 'v1' WHEN b<95 THEN 'v2' ELSE 'v3' END) AS version FROM v)
 SELECT version, count(*) AS n, count(pin) AS pinned, round((count(*)-count(pin))/(SELECT count(*) FILTER (pin IS NULL) FROM w)::DOUBLE,6) AS share, CASE version WHEN 'v1' THEN 0.8 WHEN 'v2' THEN 0.15 ELSE 0.05 END::DOUBLE AS configured,
 abs((count(*)-count(pin))/(SELECT count(*) FILTER (pin IS NULL) FROM w)::DOUBLE - CASE version WHEN 'v1' THEN 0.8::DOUBLE WHEN 'v2' THEN 0.15::DOUBLE ELSE 0.05::DOUBLE END)<=0.04 AS within FROM w GROUP BY 1""",
)
def o7(spark, sf):
    return O.canary_split(table(spark, sf, "events"), "user_id", "c", {"v1": 80, "v2": 15, "v3": 5}, F.when(F.col("user_id") % 40 == 0, "v2"), 0.04)


@query(
    "O8_shadow_compare",
    f"""WITH p AS (SELECT event_id, event_type AS cls, (value>20)::INT AS label, value/100 AS score, value AS l FROM events WHERE event_type<>'signup'), s AS (SELECT event_id, CASE WHEN {EV('s')}%10=0 THEN (value<=20)::INT ELSE (value>20)::INT END AS sl, value/90 AS ss, value*1.25::DOUBLE AS sm FROM events WHERE {EV('f')}%20<>0)
 SELECT cls, count(*) AS n, count(*) FILTER (sl IS NULL) AS shadow_failures, round(avg((label=sl)::INT::DOUBLE),6) AS agreement, round(avg(ss-score),6) AS score_delta, round(avg(sm-l),6) AS latency_delta FROM p LEFT JOIN s USING (event_id) GROUP BY 1""",
)
def o8(spark, sf):
    e = table(spark, sf, "events")
    big = (F.col("value") > 20).cast("int")
    p = e.select(F.col("event_id").alias("request_id"), F.col("event_type").alias("cls"), big.alias("label"), (F.col("value") / 100).alias("score"), F.col("value").alias("latency_ms"))
    s = e.where(h32("event_id", F.lit("f")) % 20 != 0).select(
        F.col("event_id").alias("request_id"), F.when(h32("event_id", F.lit("s")) % 10 == 0, 1 - big).otherwise(big).alias("label"), (F.col("value") / 90).alias("score"), (F.col("value") * 1.25).alias("latency_ms")
    )
    return O.shadow_compare(p, s, ["signup"])


LOAD = f"""load AS (SELECT event_id, user_id%6 AS step, (epoch_us(ts)-epoch_us(TIMESTAMP '2024-01-01'))/1e6 AS t, event_type<>'error' AS ok, {EV('c')}%50<>0 AS correct, value*(1+user_id%6) AS latency_ms, value/50 AS cpu, json_extract_string(props,'$.k')::DOUBLE/100 AS mem FROM events)"""


def load(spark, sf):
    e = table(spark, sf, "events")
    step = F.col("user_id") % 6
    return e.select(
        "event_id", step.alias("step"), ((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1e6).alias("since_start_s"), (F.col("event_type") != "error").alias("ok"),
        (h32("event_id", F.lit("c")) % 50 != 0).alias("correct"), (F.col("value") * (1 + step)).alias("latency_ms"), (F.col("value") / 50).alias("cpu"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("mem"),
    )


@query(
    "O9_load_report",
    D.with_(LOAD)
    + """, w AS (SELECT * FROM load WHERE t>=86400), s AS (SELECT step, count(*) AS n, round(avg(correct::INT::DOUBLE),6) AS correctness, round(1-avg(ok::INT::DOUBLE),6) AS error_rate, round(count(*)/(max(t)-86400),6) AS throughput,
 round(quantile_cont(latency_ms,0.5),6) AS p50, round(quantile_cont(latency_ms,0.95),6) AS p95, round(quantile_cont(latency_ms,0.99),6) AS p99 FROM w GROUP BY 1), c AS (SELECT step, round(avg(latency_ms),6) AS cold_mean_ms FROM load WHERE t<86400 GROUP BY 1)
 SELECT *, CASE WHEN correctness<0.979::DOUBLE THEN 'fail_correctness' WHEN error_rate>0.021::DOUBLE THEN 'fail_errors' WHEN p95>200 THEN 'fail_latency' ELSE 'pass' END AS verdict FROM s LEFT JOIN c USING (step)""",
)
def o9(spark, sf):
    return O.load_report(load(spark, sf), 86400.0, 0.021, 200.0)


@query(
    "O10_token_latency",
    """WITH r AS (SELECT user_id||'/'||strftime(ts,'%Y-%m-%d') AS rid, epoch_us(date_trunc('day',min(ts)))/1e6 AS s, epoch_us(min(ts))/1e6 AS a, epoch_us(max(ts))/1e6 AS z, count(*) AS n FROM events GROUP BY 1),
 q AS (SELECT (n//2)*2 AS bucket, n, a-s AS ttft, z-s AS e2e, CASE WHEN n>1 THEN (z-a)/(n-1) END AS gap FROM r)
 SELECT bucket, count(*) AS requests, round(avg(gap),3) AS mean_gap, round(sum(n)/sum(e2e),6) AS tokens_per_s, round(quantile_cont(e2e,0.5),3) AS e2e_p50, round(quantile_cont(e2e,0.95),3) AS e2e_p95, round(quantile_cont(ttft,0.5),3) AS ttft_p50 FROM q GROUP BY 1""",
)
def o10(spark, sf):
    e = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    t = e.select(F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("at", "yyyy-MM-dd")).alias("request_id"), F.date_trunc("day", "at").alias("sent_at"), "at")
    return O.token_latency(t, 2).select("bucket", "requests", F.round("mean_gap", 3).alias("mean_gap"), "tokens_per_s", *[F.round(c, 3).alias(c) for c in ("e2e_p50", "e2e_p95", "ttft_p50")])


@query("O11_scrape_health", "SELECT user_id AS target, (arg_max(event_type, event_id)<>'error')::INT AS up, arg_max(event_type, event_id)<>'error' AS ready FROM events GROUP BY 1")
def o11(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("target"), "ts", "event_id", (F.col("event_type") != "error").cast("int").alias("v"))
    return O.scrape_health(e, "target", "ts", "event_id", "v")


@query(
    "O12_step_report",
    """WITH s AS (SELECT user_id||'/'||strftime(ts,'%Y-%m-%d') AS run_id, event_id, event_type||'-'||event_id AS name, (event_type='error')::INT AS rc, json_extract_string(props,'$.k')::BIGINT%20=0 AS ef, value FROM events)
 SELECT run_id, count(*) AS steps, count(*) FILTER ((rc<>0)<>ef) AS unmet, CASE WHEN bool_and((rc<>0)=ef) THEN 'passed' ELSE 'failed' END AS status, round(sum(value),3) AS elapsed_seconds, first(name ORDER BY value DESC, event_id) AS slowest FROM s GROUP BY 1""",
)
def o12(spark, sf):
    e = table(spark, sf, "events")
    return O.step_report(
        e.select(
            F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("run_id"), F.col("event_id").alias("position"), F.concat_ws("-", "event_type", F.col("event_id").cast("string")).alias("name"),
            (F.col("event_type") == "error").cast("int").alias("returncode"), (F.get_json_object("props", "$.k").cast("bigint") % 20 == 0).alias("expected_failure"), F.col("value").alias("elapsed_seconds"),
        )
    )


@query(
    "O13_showback",
    """WITH u AS (SELECT CASE WHEN s_suppkey%9=0 THEN NULL ELSE n_name END AS project, 's'||s_suppkey AS service, l_returnflag AS model, l_quantity*0.5::DOUBLE+l_extendedprice*0.01::DOUBLE AS cost FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey),
 p AS (SELECT coalesce(project,'(unattributed)') AS project, service, model, cost FROM u), t AS (SELECT sum(cost) FILTER (project<>'NATION_7') AS own, coalesce(sum(cost) FILTER (project='NATION_7'),0) AS sh FROM p),
 q AS (SELECT project, service, model, cost*(1+sh/own) AS cost FROM p, t WHERE project<>'NATION_7')
 SELECT coalesce(project,'(all)') AS project, coalesce(service,'(all)') AS service, coalesce(model,'(all)') AS model, (3-grouping(project)-grouping(service)-grouping(model))::INT AS level, count(*) AS rows, round(sum(cost),4) AS cost FROM q GROUP BY ROLLUP(project,service,model)""",
)
def o13(spark, sf):
    li, s, n = table(spark, sf, "lineitem"), table(spark, sf, "supplier"), table(spark, sf, "nation")
    u = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    u = u.select(
        F.when(F.col("s_suppkey") % 9 != 0, F.col("n_name")).alias("project"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("service"), F.col("l_returnflag").alias("model"),
        F.col("l_quantity").alias("cpu"), F.col("l_extendedprice").alias("tokens"),
    )
    return O.showback(u, ["project", "service", "model"], {"cpu": 0.5, "tokens": 0.01}, shared="NATION_7")


@query(
    "O14_accelerator_cost",
    """WITH a AS (SELECT user_id AS run, epoch_us(ts)/1e6 AS t, 0 AS side, epoch_us(ts)/1e6+json_extract_string(props,'$.k')::BIGINT*3600 AS e, NULL::DOUBLE AS v FROM events WHERE event_type='purchase' UNION ALL
  SELECT user_id, epoch_us(ts)/1e6, 1, NULL, value/100 FROM events WHERE event_type='view' AND user_id IN (SELECT user_id FROM events WHERE event_type='purchase')),
 s AS (SELECT *, max(e) OVER (PARTITION BY run ORDER BY t, side, e, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM a)
 SELECT run%10 AS queue, run, round(sum(e-t) FILTER (side=0),3) AS requested_s, round(sum(greatest(0.0,e-greatest(t,coalesce(reach,t)))) FILTER (side=0),3) AS covered_s, round(coalesce(sum(v*60) FILTER (side=1 AND reach>t),0),3) AS used_s,
 round(coalesce(sum(v*60) FILTER (side=1 AND reach>t),0)*300/3600,6) AS watt_hours FROM s GROUP BY 1,2""",
)
def o14(spark, sf):
    e = table(spark, sf, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    a = e.where("event_type = 'purchase'").select(
        F.col("user_id").alias("run"), F.col("s").alias("start_s"), (F.col("s") + F.get_json_object("props", "$.k").cast("bigint") * 3600).alias("end_s"), (F.col("user_id") % 10).alias("queue")
    )
    u = e.where("event_type = 'view'").select(F.col("user_id").alias("run"), F.col("s").alias("at_s"), (F.col("value") / 100).alias("value"))
    return O.accelerator_cost(a, u, ["queue", "run"], 300.0, 60.0)


@query(
    "O15_budget_audit",
    """WITH r AS (SELECT user_id, event_id, value, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id),6)>900 AS over FROM events)
 SELECT user_id, count(*) AS rows, round(sum(value),6) AS used, count(*) FILTER (over) AS rows_over, min(event_id) FILTER (over) AS first_over FROM r GROUP BY 1""",
)
def o15(spark, sf):
    return O.budget_audit(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("value"), 900.0, "ts")


ALLOWED = [("signup", "view"), ("view", "click"), ("click", "view"), ("view", "view"), ("click", "purchase"), ("view", "purchase"), ("view", "error"), ("click", "error"), ("click", "click"), ("signup", "click")]


@query(
    "O16_audit_trail",
    f"""WITH e AS (SELECT user_id AS run, ts, event_id, event_type AS st, md5(event_id::VARCHAR) AS link, lag(event_type) OVER w AS pst, lag(md5(event_id::VARCHAR)) OVER w AS pl, max((event_type='purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts,event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 f AS (SELECT *, CASE WHEN event_id%50=0 THEN 'x' ELSE coalesce(pl,'') END AS prev FROM e)
 SELECT run, count(*) AS events, count(*) FILTER (pst IS NOT NULL AND pst||'>'||st NOT IN ({",".join(f"'{a}>{b}'" for a, b in ALLOWED)})) AS undefined_transitions, count(*) FILTER (coalesce(ended,0)=1) AS after_terminal, max((st='purchase')::INT)=0 AS missing_terminal,
 count(*) FILTER (prev<>coalesce(pl,'')) AS link_breaks FROM f GROUP BY 1""",
)
def o16(spark, sf):
    from sievework.functions.scan import previous

    e = table(spark, sf, "events").select(F.col("user_id").alias("run"), "ts", "event_id", F.col("event_type").alias("state"), F.md5(F.col("event_id").cast("string")).alias("link"))
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000)
    e = previous(e, ["run"], ["ts", "event_id"], day, p=F.col("link"))
    e = e.withColumn("prev_link", F.when(F.col("event_id") % 50 == 0, "x").otherwise(F.coalesce("p", F.lit("")))).drop("p")
    return A.audit_trail(e, "run", ["ts", "event_id"], "state", ALLOWED, ["purchase"], day, "link", "prev_link")


OK = lambda tag: H(f"o_orderkey::VARCHAR||'{tag}'")


@query(
    "O17_approval_audit",
    f"""WITH c AS (SELECT o_orderkey AS k, md5(o_totalprice::VARCHAR) AS ah, o_custkey%20 AS rq, o_orderdate::DATE AS ef, {OK('a')} AS h FROM orders),
 p AS (SELECT *, CASE WHEN h%11=0 THEN 'x' ELSE ah END AS ph, h%20 AS ap, ef - (h%10)::INT + 3 AS aa, ef - (h%10)::INT + 3 + (h%8)::INT AS xp, h%5<>0 AS has FROM c),
 r AS (SELECT k, array_to_string(list_filter([CASE WHEN NOT has THEN 'not_approved' END, CASE WHEN has AND ah<>ph THEN 'arguments_changed' END, CASE WHEN has AND ef>=xp THEN 'expired' END, CASE WHEN has AND ap=rq THEN 'self_approved' END, CASE WHEN has AND aa>ef THEN 'approved_after_effect' END], lambda x: x IS NOT NULL),',') AS reasons FROM p)
 SELECT k AS call_id, reasons, reasons='' AS valid FROM r""",
)
def o17(spark, sf):
    o = table(spark, sf, "orders")
    h, day = h32("o_orderkey", F.lit("a")), F.col("o_orderdate").cast("date")
    calls = o.select(F.col("o_orderkey").alias("call_id"), F.md5(F.col("o_totalprice").cast("string")).alias("args_hash"), (F.col("o_custkey") % 20).alias("requester"), day.alias("effect_at"))
    at = F.date_add(F.date_sub(day, (h % 10).cast("int")), 3)
    ap = o.where(h % 5 != 0).select(
        F.col("o_orderkey").alias("call_id"), F.when(h % 11 == 0, "x").otherwise(F.md5(F.col("o_totalprice").cast("string"))).alias("approved_hash"), (h % 20).alias("approver"),
        at.alias("approved_at"), F.date_add(at, (h % 8).cast("int")).alias("expires_at"),
    )
    return A.approval_audit(calls, ap).select("call_id", F.array_join("reasons", ",").alias("reasons"), "valid")


@query(
    "O18_idempotency_audit",
    """SELECT md5(l_orderkey||'|'||l_partkey%100) AS exec_key, count(*) AS attempts, count(*) FILTER (l_linenumber%3<>0) AS effects, CASE WHEN count(*) FILTER (l_linenumber%3<>0)=0 THEN 'no_effect' ELSE 'repeated_effect' END AS problem FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_linenumber%3<>0)<>1""",
)
def o18(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("tool", F.col("l_partkey") % 100)
    return A.idempotency_audit(li, ["l_orderkey", "tool"], F.col("l_linenumber") % 3 != 0)


@query(
    "O19_agent_metrics",
    f"""WITH e AS (SELECT user_id||'/'||strftime(ts,'%Y-%m-%d') AS rid, event_type, value, json_extract_string(props,'$.k')::BIGINT AS k, {EV('t')} AS h FROM events),
 s AS (SELECT rid, count(*) AS len, sum((h%4<>0)::INT) AS tok, sum((h%4<>0 AND h%3<>0)::INT) AS aok, sum((k>95)::INT) AS vi, sum((event_type='purchase')::INT) AS ap, sum((event_type='error')::INT) AS rt, sum(value) AS la, sum(k) AS tk, max((event_type='purchase')::INT)=1 AS ok, CASE WHEN min(k)%2=0 THEN 'human' ELSE 'judge' END AS src FROM e GROUP BY 1)
 SELECT src AS label_source, count(*) AS runs, round(avg(ok::INT::DOUBLE),6) AS success_rate, round(sum(tok)/sum(len)::DOUBLE,6) AS tool_match, round(sum(aok)/sum(len)::DOUBLE,6) AS argument_match, round(avg(len),6) AS mean_length, sum(vi)::BIGINT AS violations, sum(ap)::BIGINT AS approvals, sum(rt)::BIGINT AS retries,
 round(avg(la),6) AS mean_latency_ms, sum(tk)::BIGINT AS tokens FROM s GROUP BY 1""",
)
def o19(spark, sf):
    e = table(spark, sf, "events")
    h, k = h32("event_id", F.lit("t")), F.get_json_object("props", "$.k").cast("bigint")
    rid = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("run_id")
    s = e.select(
        rid, F.col("event_type").alias("tool"), k.alias("args"), F.when(h % 4 != 0, F.col("event_type")).otherwise("none").alias("expected_tool"), F.when(h % 3 != 0, k).otherwise(-1).alias("expected_args"),
        (k > 95).alias("violation"), (F.col("event_type") == "purchase").alias("approved"), (F.col("event_type") == "error").alias("retry"), F.col("value").alias("latency_ms"), k.alias("tokens"),
    )
    r = s.groupBy("run_id").agg(F.when(F.min("tokens") % 2 == 0, "human").otherwise("judge").alias("label_source"), F.bool_or("approved").alias("success"))
    return A.agent_metrics(r, s)


@query(
    "O20_safety_gate",
    f"""WITH r AS (SELECT (['refusal','injection','pii','malformed'])[doc_id%4+1] AS category, toxic=0 AS b, CASE WHEN {H("doc_id::VARCHAR||'sg'")}%25=0 THEN toxic=1 ELSE toxic=0 END AS c, doc_id%16=0 AS s FROM labels),
 g AS (SELECT category, count(*) AS n, round(avg(b::INT::DOUBLE),6) AS base_rate, round(avg(c::INT::DOUBLE),6) AS cand_rate, count(*) FILTER (s AND b AND NOT c) AS seeded_regressions FROM r GROUP BY 1)
 SELECT *, CASE WHEN seeded_regressions>0 OR category='malformed' OR cand_rate<0.8 THEN 'deny' ELSE 'allow' END AS decision FROM g""",
)
def o20(spark, sf):
    la = table(spark, sf, "labels")
    cat = F.element_at(F.array(*[F.lit(c) for c in ("refusal", "injection", "pii", "malformed")]), (F.col("doc_id") % 4 + 1).cast("int"))
    r = la.select(
        cat.alias("category"), (F.col("toxic") == 0).alias("base_pass"), F.when(h32("doc_id", F.lit("sg")) % 25 == 0, F.col("toxic") == 1).otherwise(F.col("toxic") == 0).alias("cand_pass"), (F.col("doc_id") % 16 == 0).alias("seeded")
    )
    return O.safety_gate(r, {"refusal": 0.8, "injection": 0.8, "pii": 0.8})


@query(
    "O21_stage_latency",
    """WITH s AS (SELECT event_id AS id, CASE WHEN event_id=0 THEN NULL WHEN event_id%97=5 THEN -event_id ELSE event_id//4 END AS pa, event_type AS stage, user_id%3 AS version, value*CASE WHEN event_id%3=0 THEN 4 ELSE 1 END AS d FROM events),
 k AS (SELECT pa, sum(d) AS kids FROM s WHERE pa IS NOT NULL GROUP BY 1), j AS (SELECT s.*, greatest(0.0,d-coalesce(kids,0)) AS self, s.pa IS NOT NULL AND s.pa NOT IN (SELECT id FROM s) AS orphan FROM s LEFT JOIN k ON k.pa=s.id)
 SELECT stage, version, count(*) AS n, round(sum(self),6) AS self_total, count(*) FILTER (orphan) AS orphans, round(quantile_cont(self,0.95),6) AS p95 FROM j GROUP BY 1,2""",
)
def o21(spark, sf):
    i = F.col("event_id")
    s = table(spark, sf, "events").select(
        i.alias("span_id"), F.when(i == 0, None).when(i % 97 == 5, -i).otherwise(F.floor(i / 4)).cast("bigint").alias("parent_id"), F.col("event_type").alias("stage"), (F.col("user_id") % 3).alias("version"),
        (F.col("value") * F.when(i % 3 == 0, 4).otherwise(1)).alias("duration"),
    )
    return O.stage_latency(s)


@query(
    "O22_incident_times",
    """WITH i AS (SELECT user_id%5 AS service, event_id AS id, ts FROM events WHERE event_type='signup'), g AS (SELECT user_id%5 AS service, event_id AS id, ts, CASE event_type WHEN 'error' THEN 'detect' WHEN 'click' THEN 'ack' ELSE 'recover' END AS kind FROM events WHERE event_type IN ('error','click','purchase')),
 n AS (SELECT i.service, i.id, i.ts, kind, min(g.ts) AS nt FROM i JOIN g ON g.service=i.service AND (g.ts>i.ts OR g.ts=i.ts AND g.id>i.id) GROUP BY 1,2,3,4)
 SELECT i.service, i.id, max(CASE WHEN kind='detect' AND d<=1800 THEN round(d,3) END) AS detect_s, max(CASE WHEN kind='ack' AND d<=1800 THEN round(d,3) END) AS ack_s, max(CASE WHEN kind='recover' AND d<=1800 THEN round(d,3) END) AS recover_s
 FROM i LEFT JOIN (SELECT service, id, kind, epoch_us(nt)/1e6-epoch_us(ts)/1e6 AS d FROM n) q ON q.service=i.service AND q.id=i.id GROUP BY 1,2""",
)
def o22(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 5).alias("service"), F.col("event_id").alias("id"), "ts", "event_type")
    kind = F.when(F.col("event_type") == "error", "detect").when(F.col("event_type") == "click", "ack").when(F.col("event_type") == "purchase", "recover")
    return O.incident_times(e.where("event_type = 'signup'"), e.withColumn("kind", kind).where("kind is not null"), 1800.0)[0]


@query(
    "O22_alerts_without_injection",
    """WITH i AS (SELECT user_id%5 AS service, ts, event_id AS id FROM events WHERE event_type='signup'), d AS (SELECT user_id%5 AS service, event_id AS id, ts FROM events WHERE event_type='error')
 SELECT d.service, d.id FROM d LEFT JOIN i ON i.service=d.service AND i.ts<=d.ts GROUP BY 1,2,d.ts HAVING max(i.ts) IS NULL OR epoch_us(d.ts)/1e6-epoch_us(max(i.ts))/1e6>1800""",
)
def o22b(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 5).alias("service"), F.col("event_id").alias("id"), "ts", "event_type")
    kind = F.when(F.col("event_type") == "error", "detect").when(F.col("event_type") == "click", "ack").when(F.col("event_type") == "purchase", "recover")
    return O.incident_times(e.where("event_type = 'signup'"), e.withColumn("kind", kind).where("kind is not null"), 1800.0)[1]


@query(
    "O23_weighted_choice",
    """WITH a AS (SELECT p_brand AS option, p_type AS workload, avg(p_retailprice) AS c, avg(p_size) FILTER (p_size>3) AS q, avg(length(p_name)) FILTER (p_partkey%3=0) AS r FROM part GROUP BY 1,2),
 s AS (SELECT workload, min(c) AS lc, max(c) AS hc, min(q) AS lq, max(q) AS hq, min(r) AS lr, max(r) AS hr FROM a GROUP BY 1),
 z AS (SELECT a.workload, option, c IS NULL OR q IS NULL OR r IS NULL AS blocked, CASE WHEN NOT (c IS NULL OR q IS NULL OR r IS NULL) THEN round(0.0::DOUBLE+(1-CASE WHEN hc>lc THEN (c-lc)/(hc-lc) ELSE 1.0 END)*(5.0::DOUBLE/10)+(CASE WHEN hq>lq THEN (q-lq)/(hq-lq) ELSE 1.0 END)*(3.0::DOUBLE/10)+(CASE WHEN hr>lr THEN (r-lr)/(hr-lr) ELSE 1.0 END)*(2.0::DOUBLE/10),6) END AS score FROM a JOIN s USING (workload))
 SELECT *, coalesce(option=(SELECT option FROM z y WHERE y.workload=z.workload AND NOT blocked ORDER BY score DESC, option DESC LIMIT 1),false) AS best_here FROM z""",
)
def o23(spark, sf):
    p = table(spark, sf, "part")
    c = F.array(
        F.struct(F.lit("cost").alias("criterion"), F.col("p_retailprice").alias("value")), F.struct(F.lit("quality").alias("criterion"), F.when(F.col("p_size") > 3, F.col("p_size")).cast("double").alias("value")),
        F.struct(F.lit("recall").alias("criterion"), F.when(F.col("p_partkey") % 3 == 0, F.length("p_name")).cast("double").alias("value")),
    )
    long = p.select(F.col("p_brand").alias("option"), F.col("p_type").alias("workload"), F.inline(c))
    return O.weighted_choice(long, {"cost": 5.0, "quality": 3.0, "recall": 2.0}, {"cost": False, "quality": True, "recall": True})


_W = "+".join(f"(u>={t}::DOUBLE)::INT" for t in POISSON_ONE)


@query(
    "O24_capacity_estimate",
    D.with_(LOAD)
    + f""", s AS (SELECT step, count(*) AS n, quantile_cont(latency_ms,0.95) AS p95, 1-avg(ok::INT::DOUBLE) AS er, avg(cpu) AS cpu, avg(mem) AS mem FROM load GROUP BY 1), t AS (SELECT * FROM s WHERE p95<=260 AND er<=0.5 ORDER BY step DESC LIMIT 1),
 c AS (SELECT {H("'ce|b|'||event_id")}%64 AS b, sum((NOT ok)::INT) AS x, count(*) AS y FROM load WHERE step=(SELECT step FROM t) GROUP BY 1), r AS (SELECT *, (({H("'ce|'||b||'|'||r")}+0.5)/4294967296.0::DOUBLE) AS u FROM c, (SELECT unnest(generate_series(1,100)) AS r)),
 v AS (SELECT r, sum(({_W})*x)/sum(({_W})*y)::DOUBLE AS s FROM r GROUP BY 1)
 SELECT step, n, round(p95,6) AS p95, round(er,6) AS error_rate, CASE WHEN mem>=cpu THEN 'mem' ELSE 'cpu' END AS bottleneck, (SELECT round(quantile_cont(s,0.025),6) FROM v) AS low, (SELECT round(quantile_cont(s,0.975),6) FROM v) AS high FROM t""",
)
def o24(spark, sf):
    return O.capacity_estimate(load(spark, sf), 260.0, 0.5, ["cpu", "mem"], "event_id", 100, "ce")


def stored_sketches(spark, sf):
    """Sketches of every service and day, written and read back."""
    path = scratch_path(spark, "sketches")
    r = D.requests(spark, sf)
    SK.sketch_windows(r, ["service"], "ts", 86400, ["latency_ms"], "user_id", "event_type", "v1").write.parquet(path)
    return spark.read.parquet(path)


@query("O1_sketch_quantiles")
def o1_sketch(spark, sf):
    """Percentiles of services over all days from stored sketches; their rank
    error is held against the rows in the tests."""
    q = SK.merge_quantiles(stored_sketches(spark, sf), ["service"], "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return q.select("service", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


@query("O4_sketch_distinct", D.with_(D.REQUESTS) + " SELECT service, count(DISTINCT user_id) AS \"distinct\" FROM requests GROUP BY 1")
def o4_sketch(spark, sf):
    """Distinct users per service; exact for as few as the tables have."""
    return SK.merge_distinct(stored_sketches(spark, sf), ["service"])


@query(
    "O4_sketch_common",
    D.with_(D.REQUESTS) + ", c AS (SELECT service, event_type AS value, count(*) AS n FROM requests GROUP BY 1,2) SELECT service, value, n AS least, n AS most FROM c QUALIFY row_number() OVER (PARTITION BY service ORDER BY n DESC, value)<=3",
)
def o4_common(spark, sf):
    return SK.merge_common(stored_sketches(spark, sf), ["service"], 3)


@query(
    "O5_sketch_overlap",
    D.with_(D.REQUESTS)
    + """, a AS (SELECT DISTINCT service, user_id FROM requests WHERE day(ts)<=15), b AS (SELECT DISTINCT service, user_id FROM requests WHERE day(ts)>15)
 SELECT service, count(*) FILTER (a.user_id IS NOT NULL AND b.user_id IS NOT NULL) AS both, count(*) FILTER (b.user_id IS NULL) AS only_a, count(*) FILTER (a.user_id IS NULL) AS only_b FROM a FULL JOIN b USING (service, user_id) GROUP BY 1""",
)
def o5_sketch(spark, sf):
    """Users of the first and the second half of the month."""
    s = stored_sketches(spark, sf)
    first = F.dayofmonth("window_start") <= 15
    return SK.overlap(s.where(first), s.where(~first), ["service"])
