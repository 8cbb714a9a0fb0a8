"""Queries over splits, features, models and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions.columns import h32, h32_sql as H, uniform
from sievework.operators import anomaly as A, evaluation as E, forecasts as B, quality as Q, recommend as R, splits as S
from sievework.plans import derive as D
from sievework.plans.registry import query
from sievework.session import cut, table


def U(expr: str) -> str:
    return f"(({H(expr)} + 0.5)/4294967296.0::DOUBLE)"


@query(
    "entry_labelled_gate",
    f"""WITH j AS (SELECT l.doc_id, l.quality, {U("'split|'||l.doc_id")} < 0.75::DOUBLE AS tr FROM labels l JOIN documents d USING (doc_id)),
 mc AS (SELECT quality AS m FROM j WHERE tr GROUP BY 1 ORDER BY count(*) DESC, quality DESC LIMIT 1),
 a AS (SELECT CASE WHEN tr THEN 'train' ELSE 'test' END AS split, count(*) AS n, any_value(m) AS majority_class, round(avg((quality=m)::INT::DOUBLE),6) AS accuracy FROM j, mc GROUP BY 1)
 SELECT split, n, majority_class, accuracy, 'passed' AS quality_status, CASE WHEN accuracy>=0.67 THEN 'allow' ELSE 'deny' END AS decision FROM a""",
)
def entry_gate(spark, sf):
    la, d = table(spark, sf, "labels"), table(spark, sf, "documents").select("doc_id", "lang")
    rows = la.join(d, "doc_id").select("doc_id", "quality", "lang")
    gate = Q.quality_gate(Q.quality_report(rows, {"not_null": ["doc_id", "quality"], "range": {"quality": {"ge": 0, "le": 1}}, "unique": ["doc_id"]}))
    split = S.hash_split(rows, "doc_id", "split", fraction=0.75)
    train = split.where("split = 'train'")
    top = train.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("quality", F.struct("n", "quality"))).scalar()
    per = split.withColumn("_m", top).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.max("_m").alias("majority_class"), F.round(F.avg((F.col("quality") == F.col("_m")).cast("double")), 6).alias("accuracy")
    )
    verdict = E.metric_gate(per.select(F.col("split").alias("subject"), F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")), {"accuracy": 0.67}, "1.0.0")
    status = gate.select("gate_status").scalar()
    return per.join(verdict.select(F.col("subject").alias("split"), "decision"), "split").select(
        "split", "n", "majority_class", "accuracy", status.alias("quality_status"), F.when(status == "passed", F.col("decision")).otherwise("deny").alias("decision")
    )


@query(
    "M1_hash_split",
    "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('s|'||doc_id), doc_id) <= 150 THEN 'train' ELSE 'test' END AS split FROM documents",
)
def m1(spark, sf):
    return S.hash_split(table(spark, sf, "documents").select("doc_id"), "doc_id", "s", n_train=150)


@query(
    "M2_group_time_split",
    f"""SELECT o_orderkey, CASE WHEN NOT h AND d < DATE '1998-01-01' THEN 'train' WHEN h AND d > DATE '1998-01-31' THEN 'test' ELSE 'dropped' END AS split
 FROM (SELECT o_orderkey, o_orderdate::DATE AS d, {U("'g|'||o_custkey")} < 0.3::DOUBLE AS h FROM orders)""",
)
def m2(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return S.group_time_split(o, "o_custkey", "o_orderdate", "g", 0.3, F.lit("1998-01-01").cast("date"), 30).select("o_orderkey", "split")


def _case(u: str, weights) -> str:
    total, out = 0.0, "CASE"
    q = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}"
    for v, w in weights[:-1]:
        total += w
        out += f" WHEN {u} < {round(total, 10)}::DOUBLE THEN {q(v)}"
    return out + f" ELSE {q(weights[-1][0])} END"


def _map(c: str, pairs) -> str:
    return "CASE " + " ".join(f"WHEN {c}='{k}' THEN {v}::DOUBLE" for k, v in pairs) + " END"


def _g(c: str) -> str:
    k = f"'7|{c}|'||o_orderkey||"
    u1, u2 = U(k + "'|u1'"), U(k + "'|u2'")
    return f"(sqrt(-2.0::DOUBLE*ln({u1}))*cos(6.283185307179586::DOUBLE*{u2}))"


def _u(c: str) -> str:
    return U(f"'7|{c}|'||o_orderkey")


LISTINGS = f"""a AS (SELECT o_orderkey, {_case(_u('property'), S.PROPERTY_WEIGHTS)} AS property_type, {_case(_u('market'), S.MARKET_WEIGHTS)} AS market_temperature,
 {_case(_u('bedrooms'), S.BEDROOM_WEIGHTS)}::INT AS bedrooms, ({_case(_u('bathrooms'), S.BATHROOM_WEIGHTS)})::DOUBLE AS bathrooms, floor({_u('age')}*96)::INT AS home_age_years,
 greatest(1,least(10,round_even(6.2::DOUBLE+{_g('school')}*1.8::DOUBLE,0)::INT)) AS school_rating, greatest(5,least(98,round_even(56+{_g('walk')}*22,0)::INT)) AS walk_score,
 round_even(5.2::DOUBLE+{_u('rate')}*3.2::DOUBLE,2) AS mortgage_rate_percent FROM orders),
 b AS (SELECT *, greatest(650,least(3600,(round_even((780+bedrooms*430+bathrooms*115+{_g('feet')}*190)/10,0)*10)::INT)) AS square_feet FROM a),
 c AS (SELECT *, greatest(160000,least(1250000,(round_even(square_feet*({_map('property_type', S.PRICE_PER_FOOT)}+school_rating*11+walk_score*0.9::DOUBLE-home_age_years*0.55::DOUBLE+{_g('price')}*28)/1000,0)*1000)::INT)) AS listing_price_usd FROM b),
 listings AS (SELECT *, ({_u('sold')} < 1/(1+exp(-(0.95::DOUBLE*((school_rating-6)/2.2::DOUBLE+(walk_score-55)/35.0::DOUBLE)-1.05::DOUBLE*((listing_price_usd/square_feet-305)/85)-0.55::DOUBLE*((mortgage_rate_percent-6.5::DOUBLE)/1.25::DOUBLE)
 -0.35::DOUBLE*((home_age_years-35)/35.0::DOUBLE)+{_map('property_type', S.PROPERTY_BIAS)}+{_map('market_temperature', S.MARKET_BIAS)}+{_g('noise')}*0.55::DOUBLE))))::INT AS sold_within_30_days FROM c)"""


@query(
    "M3_generate_listings",
    f"WITH {LISTINGS} SELECT o_orderkey, listing_price_usd, square_feet, bedrooms, bathrooms, home_age_years, school_rating, walk_score, mortgage_rate_percent, property_type, market_temperature, sold_within_30_days FROM listings",
)
def m3(spark, sf):
    return S.generate_listings(table(spark, sf, "orders"), "o_orderkey", "7")


@query(
    "M4_standard_scale",
    """WITH f AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, avg(l_extendedprice) AS m2, stddev_pop(l_extendedprice) AS s2 FROM lineitem WHERE l_orderkey%4<>0)
 SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity-m)/s,6) AS q, round((l_extendedprice-m2)/s2,6) AS p, 0.0::DOUBLE AS z FROM lineitem, f WHERE l_orderkey%4=0""",
)
def m4(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("one", F.lit(1.0))
    out = S.standard_scale(li.where("l_orderkey % 4 <> 0"), li.where("l_orderkey % 4 = 0"), ["l_quantity", "l_extendedprice", "one"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("l_quantity_scaled", 6).alias("q"), F.round("l_extendedprice_scaled", 6).alias("p"), F.col("one_scaled").alias("z"))


@query(
    "M5_one_hot",
    "SELECT c_custkey, (c_mktsegment='BUILDING')::INT AS b, (c_mktsegment='HOUSEHOLD')::INT AS h, 3::BIGINT + 0*c_custkey AS n FROM customer",
)
def m5(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    out = S.one_hot(c.where("c_mktsegment in ('BUILDING', 'HOUSEHOLD', 'MACHINERY')"), c, ["c_mktsegment"])
    n = len([x for x in out.columns if "=" in x])
    return out.select("c_custkey", F.col("`c_mktsegment=BUILDING`").alias("b"), F.col("`c_mktsegment=HOUSEHOLD`").alias("h"), (F.lit(n) + 0 * F.col("c_custkey")).cast("bigint").alias("n"))


@query(
    "M6_majority_baseline",
    """WITH m AS (SELECT quality AS m FROM labels WHERE doc_id%4<>0 GROUP BY 1 ORDER BY count(*) DESC, quality DESC LIMIT 1)
 SELECT any_value(m) AS majority_class, count(*) AS n, round(avg((quality=m)::INT::DOUBLE),6) AS accuracy FROM labels, m WHERE doc_id%4=0""",
)
def m6(spark, sf):
    la = table(spark, sf, "labels")
    return E.majority_baseline(la.where("doc_id % 4 <> 0"), la.where("doc_id % 4 = 0"), "quality")


def labelled_features(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split("text", r"\s+")).cast("double").alias("n_words"),
        (F.length(F.regexp_replace("text", r"[^#*$%&]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("junk"), "lang", "source",
    )
    return table(spark, sf, "labels").join(d, "doc_id").select("doc_id", "quality", "n_chars", "n_words", "junk", "lang", "source")


NUM, CAT = ["n_chars", "n_words", "junk"], ["lang"]


@query("M7_train_gbt")
def m7(spark, sf):
    f = cut(S.hash_split(labelled_features(spark, sf), "doc_id", "gbt", fraction=0.75))
    out = E.train_gbt(f.where("split = 'train'"), "quality", NUM, CAT).transform(f)
    hit, good = F.avg((F.col("prediction") == F.col("quality")).cast("double")), F.avg(F.col("quality").cast("double"))
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(hit, 6).alias("accuracy"), F.round(F.greatest(good, 1 - good), 6).alias("majority_accuracy"))


@query("M8_batch_score")
def m8(spark, sf):
    """Half of the rows under a run key, then all under the same key."""
    f = cut(S.hash_split(labelled_features(spark, sf), "doc_id", "gbt", fraction=0.75))
    model = E.train_gbt(f.where("split = 'train'"), "quality", NUM, CAT)
    x = f.drop("quality", "split")
    first = cut(E.batch_score(model, x.where("doc_id % 2 = 0"), "doc_id", "run-1", "0.1.0"))
    return first.unionByName(E.batch_score(model, x, "doc_id", "run-1", "0.1.0", done=first))


@query(
    "M9_classification_metrics",
    D.with_(D.predictions_sql())
    + """, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score)-1)/2.0::DOUBLE AS rk FROM predictions), c AS (SELECT count(*) FILTER (truth=1 AND pred=1) AS tp, count(*) FILTER (truth=0 AND pred=1) AS fp,
 count(*) FILTER (truth=1 AND pred=0) AS fn, count(*) FILTER (truth=0 AND pred=0) AS tn, (sum(rk) FILTER (truth=1) - count(*) FILTER (truth=1)*(count(*) FILTER (truth=1)+1)/2.0::DOUBLE)/(count(*) FILTER (truth=1)*count(*) FILTER (truth=0)) AS auc FROM r)
 SELECT tp, fp, fn, tn, round((tp+tn)/(tp+fp+fn+tn)::DOUBLE,6) AS accuracy, round(tp/(tp+fp)::DOUBLE,6) AS precision, round(tp/(tp+fn)::DOUBLE,6) AS recall, round(2*tp/(2*tp+fp+fn)::DOUBLE,6) AS f1, round(auc,6) AS auc FROM c""",
)
def m9(spark, sf):
    return E.classification_metrics(D.predictions(spark, sf), "score", "pred", "truth")


@query(
    "M10_calibration_bins",
    D.with_(D.predictions_sql())
    + """, b AS (SELECT least(floor(score*10),9)::INT AS bin, count(*) AS n, avg(score) AS ms, avg(truth) AS ob, sum((score-truth)*(score-truth)) AS sq FROM predictions GROUP BY 1)
 SELECT bin, n, round(ms,6) AS mean_score, round(ob,6) AS observed, round((SELECT sum(n*abs(ms-ob))/sum(n) FROM b),6) AS ece, round((SELECT sum(sq)/sum(n) FROM b),6) AS brier FROM b""",
)
def m10(spark, sf):
    return E.calibration_bins(D.predictions(spark, sf), "score", "truth", 10)


@query(
    "M11_slice_metrics",
    D.with_(D.predictions_sql())
    + """, g AS (SELECT 'all' AS slice, 'all' AS value, count(*) AS n, sum((pred=truth)::INT) AS k FROM predictions UNION ALL SELECT 'lang', lang, count(*), sum((pred=truth)::INT) FROM predictions GROUP BY lang
 UNION ALL SELECT 'source', source, count(*), sum((pred=truth)::INT) FROM predictions GROUP BY source),
 s AS (SELECT slice, value, n, n<20 AS suppressed, CASE WHEN n>=20 THEN round(k/n::DOUBLE,6) END AS accuracy,
  CASE WHEN n>=20 THEN round((k/n::DOUBLE+1.96*1.96/(2*n)-1.96::DOUBLE*sqrt(k/n::DOUBLE*(1-k/n::DOUBLE)/n+1.96*1.96/(4*n*n)))/(1+1.96*1.96/n),6) END AS low,
  CASE WHEN n>=20 THEN round((k/n::DOUBLE+1.96*1.96/(2*n)+1.96::DOUBLE*sqrt(k/n::DOUBLE*(1-k/n::DOUBLE)/n+1.96*1.96/(4*n*n)))/(1+1.96*1.96/n),6) END AS high FROM g)
 SELECT *, coalesce(row(slice,value) = (SELECT row(slice,value) FROM s WHERE slice<>'all' AND NOT suppressed ORDER BY accuracy, slice, value LIMIT 1), false) AS worst FROM s""",
)
def m11(spark, sf):
    return E.slice_metrics(D.predictions(spark, sf), ["lang", "source"], F.col("pred") == F.col("truth"), 20)


@query(
    "M12_metric_gate",
    D.with_(D.predictions_sql())
    + """, m AS (SELECT source AS subject, avg((pred=truth)::INT::DOUBLE) AS acc, CASE WHEN count(*)>=20 THEN avg(score) END AS ms FROM predictions GROUP BY 1)
 SELECT subject, 'accuracy' AS metric, round(acc,6) AS value, 0.8::DOUBLE AS minimum, 'v1' AS threshold_version, CASE WHEN round(acc,6)>=0.8 THEN 'allow' ELSE 'deny' END AS decision, CASE WHEN round(acc,6)>=0.8 THEN 'reached' ELSE 'below_minimum' END AS reason FROM m
 UNION ALL SELECT subject, 'mean_score', round(ms,6), 0.5, 'v1', CASE WHEN round(ms,6)>=0.5 THEN 'allow' ELSE 'deny' END, CASE WHEN ms IS NULL THEN 'missing' WHEN round(ms,6)>=0.5 THEN 'reached' ELSE 'below_minimum' END FROM m
 UNION ALL SELECT subject, 'recall', NULL, 0.5, 'v1', 'deny', 'missing' FROM m""",
)
def m12(spark, sf):
    p = D.predictions(spark, sf).groupBy(F.col("source").alias("subject")).agg(
        F.round(F.avg((F.col("pred") == F.col("truth")).cast("double")), 6).alias("accuracy"), F.when(F.count(F.lit(1)) >= 20, F.round(F.avg("score"), 6)).alias("mean_score")
    )
    return E.metric_gate(p.unpivot(["subject"], ["accuracy", "mean_score"], "metric", "value"), {"accuracy": 0.8, "mean_score": 0.5, "recall": 0.5}, "v1")


@query(
    "M13_compare_candidates",
    D.with_(D.predictions_sql("pa", "p"), D.predictions_sql("pb", "c"))
    + """, a AS (SELECT lang, avg((pred=truth)::INT::DOUBLE) AS v FROM pa GROUP BY 1), b AS (SELECT lang, avg((pred=truth)::INT::DOUBLE) AS v FROM pb GROUP BY 1)
 SELECT lang, 'accuracy' AS metric, round(a.v,6) AS base, round(b.v,6) AS cand, round(b.v-a.v,6) AS delta, round(b.v-a.v,6)<0 AS regression, round(b.v-a.v,6)>=0.1 AS meets_gain FROM a JOIN b USING (lang)""",
)
def m13(spark, sf):
    acc = lambda p: p.groupBy("lang").agg(F.avg((F.col("pred") == F.col("truth")).cast("double")).alias("v")).withColumn("metric", F.lit("accuracy"))
    return E.compare_candidates(acc(D.predictions(spark, sf)), acc(D.predictions(spark, sf, "c")), ["lang", "metric"], "v", 0.1)


_POIS = "+".join(f"(u>={t}::DOUBLE)::INT" for t in E.POISSON_ONE)


@query(
    "M14_bootstrap_ci",
    D.with_(D.predictions_sql())
    + f""", c AS (SELECT lang, {H("'s|b|'||doc_id")} % 64 AS b, sum((pred=truth)::INT) AS x, count(*) AS y FROM predictions GROUP BY 1,2),
 r AS (SELECT *, {U("'s|'||b||'|'||r")} AS u FROM c, (SELECT unnest(generate_series(1,200)) AS r)), w AS (SELECT *, {_POIS} AS w FROM r),
 s AS (SELECT lang, r, CASE WHEN sum(w*y)>0 THEN sum(w*x)/sum(w*y)::DOUBLE END AS s FROM w GROUP BY 1,2)
 SELECT lang, (SELECT round(sum(x)/sum(y)::DOUBLE,6) FROM c WHERE c.lang=s.lang) AS estimate, round(quantile_cont(s,0.025),6) AS low, round(quantile_cont(s,0.975),6) AS high FROM s GROUP BY 1""",
)
def m14(spark, sf):
    ok = (F.col("pred") == F.col("truth")).cast("int")
    return E.bootstrap_ci(D.predictions(spark, sf), "doc_id", ok, F.lit(1), 200, "s", buckets=64, by=["lang"])


@query(
    "M15_point_in_time_join",
    """WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type='purchase'), f AS (SELECT event_id AS fid, user_id, ts, value FROM events WHERE event_type='view')
 SELECT e.event_id, e.user_id, CASE WHEN epoch_us(e.ts)-epoch_us(f.ts) <= 43200*1000000::BIGINT THEN f.value END AS value FROM e ASOF LEFT JOIN f ON e.user_id=f.user_id AND e.ts>=f.ts""",
)
def m15(spark, sf):
    e = table(spark, sf, "events")
    out = S.point_in_time_join(
        e.where("event_type = 'purchase'"), e.where("event_type = 'view'").withColumnRenamed("event_id", "fid"), "user_id", "ts", "event_id", "fid", ["value"], 43200
    )
    return out.select("event_id", "user_id", "value")


@query(
    "M16_latest_features",
    """SELECT user_id, arg_max(value, event_id) AS value, round((epoch_us(TIMESTAMP '2024-02-01')-epoch_us(max(ts)))/1e6,3) AS age_s, (epoch_us(TIMESTAMP '2024-02-01')-epoch_us(max(ts)))/1e6 > 345600 AS stale FROM events WHERE event_type='click' GROUP BY 1""",
)
def m16(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'click'")
    return S.latest_features(e, "user_id", "ts", "event_id", ["value"], F.lit("2024-02-01").cast("timestamp"), 345600).select("user_id", "value", F.round("age_s", 3).alias("age_s"), "stale")


FOLDS = """folds AS (SELECT f AS fold, (mx - (((5-f)*14)::INT)) + 1 AS origin FROM (SELECT max(day) AS mx FROM series), (SELECT unnest(generate_series(1,4)) AS f))"""


@query(
    "M17_backtest_folds",
    D.with_(D.SERIES, FOLDS)
    + """ SELECT fold::INT AS fold, strftime(origin,'%Y-%m-%d') AS origin, CASE WHEN day<origin THEN 'train' ELSE 'test' END AS role, count(*) AS n, sum(y) AS y FROM series JOIN folds ON day < origin + 14 GROUP BY 1,2,3""",
)
def m17(spark, sf):
    s = D.daily_orders(spark, sf)
    out = B.backtest_folds(s, "day", s.agg(F.max("day")).scalar(), 4, 14)
    return out.groupBy("fold", F.date_format("origin", "yyyy-MM-dd").alias("origin"), "role").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))


NAIVE = """base AS (SELECT t.day, h::INT AS horizon, p.y AS forecast, t.y AS actual FROM series t, (SELECT unnest(generate_series(1,10)) AS h) JOIN series p ON p.day = t.day - (ceil(h/7.0)*7)::INT),
 q AS (SELECT horizon, quantile_cont(actual-forecast,0.1) AS a, quantile_cont(actual-forecast,0.9) AS b FROM base GROUP BY 1),
 naive AS (SELECT day, horizon, forecast, forecast+a AS low, forecast+b AS high, actual FROM base JOIN q USING (horizon))"""


@query("M18_seasonal_naive", D.with_(D.SERIES, NAIVE) + " SELECT strftime(day,'%Y-%m-%d') AS day, horizon, forecast, round(low,6) AS low, round(high,6) AS high, actual FROM naive")
def m18(spark, sf):
    n = B.seasonal_naive(D.daily_orders(spark, sf), "day", "y", 7, 10)
    return n.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "horizon", "forecast", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "actual")


# Normal equations of every fold, solved by Gauss-Jordan steps on their rows.
def _ols_sql(size: int) -> str:
    x = "[1.0::DOUBLE, l7, l14, l28, (dayofweek(day)+1)::DOUBLE, month(day)::DOUBLE]"
    rows = ", ".join("[" + ", ".join([f"sum(x[{i}]*x[{j}]){'+0.01::DOUBLE' if i == j and i > 1 else ''}" for j in range(1, size + 1)] + [f"sum(x[{i}]*y)"]) + "]" for i in range(1, size + 1))
    steps = [f"e0 AS (SELECT fold, [{rows}] AS m FROM xf WHERE day<origin GROUP BY fold)"]
    for k in range(1, size + 1):
        one = f"list_transform(m[{k}], lambda v: v/m[{k}][{k}])"
        steps.append(f"e{k} AS (SELECT fold, list_transform(m, lambda r, i: CASE WHEN i={k} THEN p ELSE list_transform(r, lambda v, j: v-p[j]*r[{k}]) END) AS m FROM (SELECT fold, m, {one} AS p FROM e{k - 1}))")
    return f"""xs AS (SELECT s.day, s.y, {x} AS x FROM (SELECT s.day, s.y, a.y AS l7, b.y AS l14, c.y AS l28 FROM series s JOIN series a ON a.day=s.day-7 JOIN series b ON b.day=s.day-14 JOIN series c ON c.day=s.day-28) s),
 z AS (SELECT f AS fold, (SELECT max(day) FROM series)-(((4-f)*7)::INT)+1 AS origin FROM (SELECT unnest([1,2,3]) AS f)), xf AS (SELECT * FROM xs JOIN z ON day<origin+7), """ + ", ".join(steps)


@query(
    "M19_lag_regression_forecast",
    D.with_(D.SERIES, _ols_sql(6))
    + """ SELECT fold::INT AS fold, strftime(day,'%Y-%m-%d') AS day, date_diff('day',origin,day)::INT+1 AS horizon, y AS actual, round(list_inner_product(x, list_transform(m, lambda r: r[7])),4) AS forecast FROM xf JOIN e6 USING (fold) WHERE day>=origin""",
)
def m19(spark, sf):
    s = cut(D.daily_orders(spark, sf))
    out = B.lag_regression_forecast(s, "day", "y", s.agg(F.max("day")).scalar(), 3, 7)
    return out.select("fold", F.date_format("day", "yyyy-MM-dd").alias("day"), "horizon", "actual", F.round("forecast", 4).alias("forecast"))


@query(
    "M20_horizon_metrics",
    D.with_(D.SERIES, NAIVE)
    + """ SELECT horizon, count(*) AS n, round(avg(abs(actual-forecast)),6) AS mae, round(sqrt(avg((actual-forecast)*(actual-forecast))),6) AS rmse, round(avg(abs((actual-forecast)/actual)) FILTER (actual<>0),6) AS mape,
 round(avg((actual>=low AND actual<=high)::INT::DOUBLE),6) AS coverage, round(avg(high-low),6) AS width FROM naive GROUP BY 1""",
)
def m20(spark, sf):
    return B.horizon_metrics(B.seasonal_naive(D.daily_orders(spark, sf), "day", "y", 7, 10))


INTER_TRAIN = "inter AS (SELECT * FROM interactions WHERE \"at\" < DATE '1998-01-01' AND user_id%25<>0)"
POP = """items AS (SELECT item_id, row_number() OVER (ORDER BY count(*) DESC, item_id) AS rank FROM inter GROUP BY 1), seen AS (SELECT DISTINCT user_id, item_id FROM inter),
 cand AS (SELECT c_custkey AS user_id, item_id, row_number() OVER (PARTITION BY c_custkey ORDER BY rank) AS pos FROM customer, items WHERE (c_custkey, item_id) NOT IN (SELECT (user_id, item_id) FROM seen)),
 recs AS (SELECT user_id, item_id, pos::INT AS pos FROM cand WHERE pos<=10)"""


def train_inter(spark, sf):
    return D.interactions(spark, sf).where((F.col("at") < F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("user_id") % 25 != 0))


@query("M21_popularity_recs", D.with_(D.INTERACTIONS, INTER_TRAIN, POP) + " SELECT * FROM recs")
def m21(spark, sf):
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return R.popularity_recs(train_inter(spark, sf), users, 10)


@query(
    "M22_candidate_recs",
    D.with_(D.INTERACTIONS, INTER_TRAIN)
    + f""", seen AS (SELECT DISTINCT user_id, item_id FROM inter), raw AS (SELECT item_id, [{', '.join(f"sum(CASE WHEN substr(md5(user_id::VARCHAR),{j + 1},1)>='8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)" for j in range(16))}] AS v FROM seen GROUP BY 1),
 it AS (SELECT item_id, list_transform(v, lambda x: CASE WHEN list_inner_product(v,v)>0 THEN x/sqrt(list_inner_product(v,v)) ELSE 0.0::DOUBLE END) AS v FROM raw),
 us AS (SELECT user_id, [{', '.join(f'sum(v[{j + 1}])' for j in range(16))}] AS v FROM seen JOIN it USING (item_id) GROUP BY 1),
 sc AS (SELECT u.user_id, i.item_id, round(CASE WHEN list_inner_product(i.v,i.v)>0 AND list_inner_product(u.v,u.v)>0 THEN list_cosine_similarity(u.v,i.v) ELSE 0 END,6) AS score FROM us u CROSS JOIN it i ANTI JOIN seen s ON s.user_id=u.user_id AND s.item_id=i.item_id)
 SELECT user_id, item_id, score, (row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id))::INT AS pos FROM sc QUALIFY pos<=5""",
)
def m22(spark, sf):
    return R.candidate_recs(train_inter(spark, sf), 5)


@query(
    "M22_cooccurrence",
    D.with_(D.INTERACTIONS, INTER_TRAIN)
    + ", seen AS (SELECT DISTINCT user_id, item_id FROM inter) SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) AS users FROM seen a JOIN seen b ON a.user_id=b.user_id AND a.item_id<b.item_id GROUP BY 1,2 HAVING count(*)>1",
)
def m22b(spark, sf):
    return R.cooccurrence(train_inter(spark, sf)).where("users > 1")


@query("M22_factor_recs")
def m22c(spark, sf):
    """Implicit factors; their search is compared with brute force in the tests."""
    return R.factor_recs(train_inter(spark, sf), 5)


@query(
    "M23_rec_metrics",
    D.with_(D.INTERACTIONS, INTER_TRAIN, POP)
    + """, rel AS (SELECT DISTINCT user_id, item_id FROM interactions WHERE "at" >= DATE '1998-01-01'), pu AS (SELECT item_id, count(DISTINCT user_id) AS u FROM inter GROUP BY 1), nu AS (SELECT count(DISTINCT user_id) AS nu FROM inter),
 h AS (SELECT r.*, x.user_id IS NOT NULL AS hit, -log2(coalesce(u,1)/nu::DOUBLE) AS nov, p_brand AS cat FROM recs r LEFT JOIN rel x USING (user_id,item_id) LEFT JOIN pu USING (item_id), nu, part WHERE p_partkey=r.item_id),
 per AS (SELECT user_id, count(*) FILTER (hit) AS h, sum(CASE WHEN hit THEN 1/log2(pos+1) ELSE 0 END) AS dcg, avg(nov) AS nov FROM h GROUP BY 1),
 dv AS (SELECT user_id, 1-sum(c*(c-1))/(sum(c)*(sum(c)-1))::DOUBLE AS div FROM (SELECT user_id, cat, count(*) AS c FROM h GROUP BY 1,2) GROUP BY 1),
 w AS (SELECT user_id, count(*) AS r, list_sum(list_transform(generate_series(1,least(10,count(*))), lambda i: 1/log2(i+1))) AS idcg FROM rel GROUP BY 1),
 u AS (SELECT w.*, h, dcg, nov, div, CASE WHEN w.user_id IN (SELECT user_id FROM inter) THEN 'warm' ELSE 'cold' END AS users FROM w LEFT JOIN per USING (user_id) LEFT JOIN dv USING (user_id))
 SELECT users, count(*) AS n, round(avg(coalesce(h,0)/r::DOUBLE),6) AS recall, round(avg(coalesce(dcg,0)/idcg),6) AS ndcg, round(avg(div),6) AS diversity, round(avg(nov),6) AS novelty,
 round((SELECT count(DISTINCT item_id) FROM recs)/(SELECT count(*) FROM part)::DOUBLE,6) AS coverage FROM u GROUP BY 1""",
)
def m23(spark, sf):
    train = train_inter(spark, sf)
    truth = D.interactions(spark, sf).where(F.col("at") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("cat"))
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return R.rec_metrics(cut(R.popularity_recs(train, users, 10)), truth, train, items, 10)


@query(
    "M24_robust_outliers",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, CASE WHEN l_returnflag='N' AND l_linenumber<>3 THEN 7.0::DOUBLE ELSE l_extendedprice END AS x FROM lineitem),
 m AS (SELECT l_returnflag, median(x) AS med FROM s GROUP BY 1), d AS (SELECT s.*, med, abs(x-med) AS dev FROM s JOIN m USING (l_returnflag)), q AS (SELECT l_returnflag, median(dev) AS mad FROM d GROUP BY 1),
 z AS (SELECT l_returnflag, CASE WHEN mad>0 THEN round(0.6745::DOUBLE*(x-med)/mad,6) WHEN dev=0 THEN 0.0 END AS score FROM d JOIN q USING (l_returnflag))
 SELECT l_returnflag, count(*) AS n, count(*) FILTER (coalesce(abs(score)>3.5,true)) AS outliers, round(sum(score),3) AS total FROM z GROUP BY 1""",
)
def m24(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("x", F.when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") != 3), 7.0).otherwise(F.col("l_extendedprice")))
    out = A.robust_outliers(li, "x", "l_returnflag")
    return out.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if("outlier").alias("outliers"), F.round(F.sum("score"), 3).alias("total"))


def _iso_sql(trees: int, depth: int) -> str:
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    ax = [[int(A.cut_fraction("i", t, n, "axis") * 3) + 1 for n in range(1, 2**depth)] for t in range(trees)]
    ct = [[A.cut_fraction("i", t, n, "cut") for n in range(1, 2**depth)] for t in range(trees)]
    sp = ", ".join(f"({c}-(SELECT min({c}) FROM lineitem))/((SELECT max({c}) FROM lineitem)-(SELECT min({c}) FROM lineitem))" for c in cols)
    sql = f"x0 AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [{sp}] AS x FROM lineitem)"
    leaf = []
    for t in range(trees):
        node = "1"
        steps = []
        for d in range(depth):
            steps.append((f"n{t}_{d}", node))
            node = f"n{t}_{d + 1}"
        leaf.append(f"n{t}_{depth}")
    cur = "x0"
    for d in range(depth):
        prev = lambda t: "1" if d == 0 else f"n{t}_{d}"  # noqa: B023, E731
        exprs = ", ".join(f"{prev(t)}*2+(x[({ax[t]})[{prev(t)}]] > ({ct[t]}::DOUBLE[])[{prev(t)}])::INT AS n{t}_{d + 1}" for t in range(trees))
        sql += f", y{d} AS (SELECT *, {exprs} FROM {cur})"
        cur = f"y{d}"
    masses = [f"m{t} AS (SELECT {leaf[t]} AS leaf, count(*)::DOUBLE AS n FROM {cur} GROUP BY 1)" for t in range(trees)]
    cf = lambda n: f"(CASE WHEN {n}>2 THEN 2*(ln({n}-1)+0.5772156649::DOUBLE)-2*({n}-1)/{n} WHEN {n}=2 THEN 1.0 ELSE 0.0 END)"
    path = "(" + "+".join(f"{depth}+{cf(f'm{t}.n')}" for t in range(trees)) + f")/{trees}.0::DOUBLE"
    joins = " ".join(f"JOIN m{t} ON m{t}.leaf={leaf[t]}" for t in range(trees))
    total = "(SELECT count(*)::DOUBLE AS n FROM lineitem)"
    return f"WITH {sql}, {', '.join(masses)} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(pow(2.0::DOUBLE, -({path})/{cf('tt.n')}),6) AS score FROM {cur} {joins}, {total} tt"


@query("M25_isolation_scores", _iso_sql(8, 5))
def m25(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    return A.isolation_scores(li, ["l_quantity", "l_extendedprice", "l_discount"], 8, 5, "i").drop("l_quantity", "l_extendedprice", "l_discount")


@query(
    "M26_anomaly_eval",
    f"""WITH s AS (SELECT ts, event_type='error' AS truth, ({H("event_id::VARCHAR||'an'")} % 700 + CASE WHEN event_type='error' THEN 300 ELSE 0 END)/1000.0::DOUBLE AS score, ts < TIMESTAMP '2024-01-15' AS tune FROM events),
 m AS (SELECT t AS threshold, CASE WHEN tune THEN 'tune' ELSE 'test' END AS split, count(*) FILTER (score>=t AND truth) AS tp, count(*) FILTER (score>=t AND NOT truth) AS fp, count(*) FILTER (score<t AND truth) AS fn,
 min(ts) FILTER (score>=t AND truth) AS al, min(ts) FILTER (truth) AS fi FROM s, (SELECT unnest([0.2,0.4,0.6,0.7,0.9]::DOUBLE[]) AS t) GROUP BY 1,2),
 f AS (SELECT *, 2*tp/nullif(2*tp+fp+fn,0)::DOUBLE AS f1 FROM m)
 SELECT threshold, split, tp, fp, fn, round(tp/nullif(tp+fp,0)::DOUBLE,6) AS precision, round(tp/nullif(tp+fn,0)::DOUBLE,6) AS recall, round(f1,6) AS f1, threshold=(SELECT threshold FROM f WHERE split='tune' ORDER BY f1 DESC, threshold LIMIT 1) AS chosen,
 CASE WHEN split='test' THEN round(epoch_us(al)/1e6-epoch_us(fi)/1e6,3) END AS delay_s FROM f""",
)
def m26(spark, sf):
    e = table(spark, sf, "events")
    err = F.col("event_type") == "error"
    s = e.select("ts", err.cast("int").alias("truth"), ((h32("event_id", F.lit("an")) % 700 + F.when(err, 300).otherwise(0)) / F.lit(1000.0)).alias("score"))
    return A.anomaly_eval(s, "score", "truth", "ts", F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"), [0.2, 0.4, 0.6, 0.7, 0.9])


def causal(spark, sf):
    c = table(spark, sf, "customer")
    big = F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    t = (uniform("c_custkey", F.lit("t")) < F.when(big, 0.6).otherwise(0.3)).cast("int")
    y = 2 * F.col("t") + F.length("c_mktsegment") + F.col("c_acctbal") / 1000 + (h32("c_custkey", F.lit("n")) % 100) / F.lit(100.0)
    return c.withColumn("t", t).withColumn("y", y).select("c_custkey", F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("x"), "t", "y")


CAUSAL = f"""c0 AS (SELECT c_custkey, c_mktsegment AS seg, c_acctbal AS x, ({U("c_custkey::VARCHAR||'t'")} < CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END)::INT AS t FROM customer),
 causal AS (SELECT *, 2*t+length(seg)+x/1000+({H("c_custkey::VARCHAR||'n'")} % 100)/100.0::DOUBLE AS y FROM c0)"""
_STRAT = "SELECT sum(d*n)/sum(n) FROM (SELECT seg, count(*) AS n, avg(y) FILTER (t=1)-avg(y) FILTER (t=0) AS d FROM {0} GROUP BY 1)"


@query(
    "M27_treatment_effects",
    D.with_(CAUSAL)
    + f""" SELECT 'naive' AS method, round(avg(y) FILTER (t=1)-avg(y) FILTER (t=0),6) AS effect FROM causal UNION ALL SELECT 'stratified', round(({_STRAT.format('causal')}),6)
 UNION ALL SELECT 'inverse_propensity', round((sum(t*y/p)-sum((1-t)*y/(1-p)))/count(*),6) FROM causal JOIN (SELECT seg, avg(t) AS p FROM causal GROUP BY 1) USING (seg)
 UNION ALL SELECT 'regression', round((covar_pop(t,y)*var_pop(x)-covar_pop(x,y)*covar_pop(t,x))/(var_pop(t)*var_pop(x)-covar_pop(t,x)*covar_pop(t,x)),6) FROM causal""",
)
def m27(spark, sf):
    return A.treatment_effects(causal(spark, sf), "t", "y", "seg", "x")


@query(
    "M28_refute_effect",
    D.with_(CAUSAL)
    + f""", pl AS (SELECT seg, y, ({U("'r|p|'||c_custkey")} < 0.5::DOUBLE)::INT AS t FROM causal), rc AS (SELECT seg||'|'||({H("'r|c|'||c_custkey")} % 2) AS seg, y, t FROM causal), su AS (SELECT * FROM causal WHERE {U("'r|s|'||c_custkey")} < 0.8::DOUBLE)
 SELECT 'placebo' AS refuter, round(({_STRAT.format('pl')}),6) AS effect UNION ALL SELECT 'random_cause', round(({_STRAT.format('rc')}),6) UNION ALL SELECT 'subset', round(({_STRAT.format('su')}),6)""",
)
def m28(spark, sf):
    return A.refute_effect(causal(spark, sf), "c_custkey", "t", "y", "seg", "x", "r")


@query(
    "M29_neighbour_features",
    """WITH e AS (SELECT DISTINCT l_suppkey AS hub, l_partkey AS node FROM lineitem) SELECT hub, count(*) AS degree, round(avg((p_size>25)::INT::DOUBLE) FILTER (node%5<>0),6) AS label_rate, count(*) FILTER (node%5=0) AS test_edges FROM e JOIN part ON p_partkey=node GROUP BY 1""",
)
def m29(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("hub"), F.col("l_partkey").alias("node"))
    n = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") > 25).cast("int").alias("label"), F.when(F.col("p_partkey") % 5 == 0, "test").otherwise("train").alias("split"))
    return A.neighbour_features(e, n)


@query(
    "M29_graph_gain",
    """WITH e AS (SELECT DISTINCT l_suppkey AS hub, l_partkey AS node FROM lineitem), h AS (SELECT hub, round(avg((p_size>25)::INT::DOUBLE) FILTER (node%5<>0),6) AS lr FROM e JOIN part ON p_partkey=node GROUP BY 1),
 s AS (SELECT node, round(avg(lr),9) AS rate FROM e JOIN h USING (hub) GROUP BY 1), b AS (SELECT avg((p_size>25)::INT::DOUBLE) AS base FROM part WHERE p_partkey%5<>0)
 SELECT count(*) AS n, round(avg(((base>=0.5)::INT=(p_size>25)::INT)::INT::DOUBLE),6) AS plain_accuracy, round(avg((coalesce((rate>=base)::INT,0)=(p_size>25)::INT)::INT::DOUBLE),6) AS graph_accuracy FROM part LEFT JOIN s ON node=p_partkey, b WHERE p_partkey%5=0""",
)
def m29b(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("hub"), F.col("l_partkey").alias("node"))
    n = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") > 25).cast("int").alias("label"), F.when(F.col("p_partkey") % 5 == 0, "test").otherwise("train").alias("split"))
    return A.graph_gain(e, n)


@query(
    "M30_scaling_fit",
    """SELECT l_returnflag, count(*) AS n, round(regr_slope(ln(l_extendedprice),ln(l_quantity)),6) AS slope, round(regr_intercept(ln(l_extendedprice),ln(l_quantity)),6) AS intercept, round(regr_r2(ln(l_extendedprice),ln(l_quantity)),6) AS r2,
 round((regr_syy(ln(l_extendedprice),ln(l_quantity))-pow(regr_sxy(ln(l_extendedprice),ln(l_quantity)),2)/regr_sxx(ln(l_extendedprice),ln(l_quantity)))/(count(*)-2),6) AS residual_variance, min(l_quantity) AS from_compute, max(l_quantity) AS to_compute FROM lineitem GROUP BY 1""",
)
def m30(spark, sf):
    return A.scaling_fit(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice")


@query("M31_embed_clusters")
def m31(spark, sf):
    assigned, pairs = E.embed_clusters(table(spark, sf, "embeddings"), "vec_id", "embedding", 8, 10, [1, 2, 3])
    n = assigned.groupBy(F.col("seed").alias("seed_a")).agg(F.count(F.lit(1)).alias("assigned"), F.count_distinct("cluster").alias("clusters"))
    return pairs.join(n, "seed_a").select("seed_a", "seed_b", "assigned", "clusters", "rand_index")


@query(
    "M31_rand_index",
    """WITH j AS (SELECT label AS x, (vec_id*7+label)%10 AS y FROM embeddings), c AS (SELECT x,y,count(*) AS n FROM j GROUP BY 1,2), t AS (SELECT count(*)*(count(*)-1)/2.0::DOUBLE AS t FROM j)
 SELECT round((t+2*(SELECT sum(n*(n-1)/2.0::DOUBLE) FROM c)-(SELECT sum(n*(n-1)/2.0::DOUBLE) FROM (SELECT x,sum(n) AS n FROM c GROUP BY 1))-(SELECT sum(n*(n-1)/2.0::DOUBLE) FROM (SELECT y,sum(n) AS n FROM c GROUP BY 1)))/t,6) AS rand_index FROM t""",
)
def m31b(spark, sf):
    e = table(spark, sf, "embeddings")
    a = e.select("vec_id", F.col("label").alias("cluster"))
    return E.rand_index(a, e.select("vec_id", ((F.col("vec_id") * 7 + F.col("label")) % 10).alias("cluster")), "vec_id", "cluster")


@query("M32_budgeted_search")
def m32(spark, sf):
    f = cut(S.hash_split(labelled_features(spark, sf), "doc_id", "bs", fraction=0.75))
    grid = [{"regParam": r, "maxIter": 10} for r in (0.0, 0.01, 0.1, 1.0)]
    return E.budgeted_search(f.where("split = 'train'"), f.where("split = 'test'"), "quality", NUM, CAT, grid, 3, "doc_id")
