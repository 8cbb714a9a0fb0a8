"""Queries over experiments, annotation and privacy."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions.columns import h32, h32_sql as H
from sievework.operators import experiments as X
from sievework.plans import derive as D
from sievework.plans.model_queries import U
from sievework.plans.registry import query
from sievework.session import table

ALLOC = {"control": 5000, "treat": 3000, "other": 2000}
ASSIGN = f"""asg AS (SELECT c_custkey AS unit, c_acctbal, c_mktsegment, b AS bucket, CASE WHEN c_custkey%29=0 THEN NULL WHEN b<5000 THEN 'control' WHEN b<8000 THEN 'treat' ELSE 'other' END AS arm FROM (SELECT *, {H("'exp|v1|'||c_custkey")} % 10000 AS b FROM customer))"""


def assigned(spark, sf):
    return X.assign(D.experiment(spark, sf), "unit", "exp", "v1", ALLOC, F.col("unit") % 29 == 0)


@query("X1_assign", f"WITH {ASSIGN} SELECT unit, bucket, arm FROM asg")
def x1(spark, sf):
    return assigned(spark, sf).select("unit", "bucket", "arm")


@query(
    "X2_exposed_outcomes",
    """WITH f AS (SELECT o_custkey AS unit, min(o_orderdate) AS ea FROM orders WHERE o_orderkey%3=0 AND o_orderkey%15<>0 GROUP BY 1)
 SELECT o_custkey AS unit, o_orderkey AS outcome_id, o_totalprice AS value, CASE WHEN ea<o_orderdate THEN strftime(ea,'%Y-%m-%d') END AS exposed_at, coalesce(ea<o_orderdate,false) AS counted FROM orders LEFT JOIN f ON unit=o_custkey WHERE o_orderkey%3<>0""",
)
def x2(spark, sf):
    o = table(spark, sf, "orders")
    ex = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("unit"), F.col("o_orderdate").alias("at"), (F.col("o_orderkey") % 15 == 0).alias("shadow"))
    out = o.where("o_orderkey % 3 <> 0").select(F.col("o_custkey").alias("unit"), F.col("o_orderkey").alias("outcome_id"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("value"))
    return X.exposed_outcomes(ex, out).withColumn("exposed_at", F.date_format("exposed_at", "yyyy-MM-dd"))


@query(
    "X3_srm_test",
    f"""WITH {ASSIGN}, n AS (SELECT count(*) AS n, count(*) FILTER (arm='control') AS n_control, count(*) FILTER (arm='treat') AS n_treat, count(*) FILTER (arm='other') AS n_other FROM asg WHERE arm IS NOT NULL)
 SELECT *, round(pow(n_control-n*0.5,2)/(n*0.5)+pow(n_treat-n*0.3,2)/(n*0.3)+pow(n_other-n*0.2,2)/(n*0.2),6) AS chi2, pow(n_control-n*0.5,2)/(n*0.5)+pow(n_treat-n*0.3,2)/(n*0.3)+pow(n_other-n*0.2,2)/(n*0.2)>13.816 AS biased FROM n""",
)
def x3(spark, sf):
    return X.srm_test(assigned(spark, sf), "arm", ALLOC)


def outcomes(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("unit"), "o_totalprice", "o_orderdate", "o_orderkey")
    a = assigned(spark, sf).where("arm is not null").select("unit", "arm")
    return o.join(a, "unit").withColumn("spend", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice"))).withColumn("speed", -F.col("o_totalprice") / 1000)


OUT = f"""{ASSIGN}, outc AS (SELECT arm, o_orderdate::DATE AS day, CASE WHEN o_orderkey%13<>0 THEN o_totalprice END AS spend, -o_totalprice/1000 AS speed FROM orders JOIN asg ON unit=o_custkey WHERE arm IS NOT NULL)"""


@query(
    "X4_effect_report",
    f"""WITH {OUT}, l AS (SELECT arm, 'spend' AS metric, spend AS v FROM outc UNION ALL SELECT arm, 'speed', speed FROM outc), s AS (SELECT arm, metric, avg(v) AS m, var_samp(v) AS va, count(v) AS n FROM l GROUP BY 1,2),
 j AS (SELECT s.arm, s.metric, s.n, s.m-c.m AS d, sqrt(s.va/s.n+c.va/c.n) AS se, c.m AS cm FROM s JOIN s c ON c.metric=s.metric AND c.arm='control' WHERE s.arm<>'control')
 SELECT arm, metric, n, round(d,6) AS diff, round(d-1.96::DOUBLE*se,6) AS low, round(d+1.96::DOUBLE*se,6) AS high, round(d/cm,6) AS lift, d-1.96::DOUBLE*se>0 OR d+1.96::DOUBLE*se<0 AS significant, abs(d)>=CASE metric WHEN 'spend' THEN 1000 ELSE 5 END AS practical,
 CASE WHEN metric='spend' THEN 'not_guardrail' WHEN d<-2 THEN 'violated' ELSE 'held' END AS guardrail FROM j""",
)
def x4(spark, sf):
    return X.effect_report(outcomes(spark, sf), "arm", "control", {"spend": {"practical": 1000.0, "guardrail": None}, "speed": {"practical": 5.0, "guardrail": 2.0}})


@query(
    "X5_missingness_and_looks",
    f"""WITH {OUT}, d AS (SELECT arm, date_trunc('month',day)::DATE AS mo, count(*) AS u, count(*)-count(spend) AS m, coalesce(sum(spend),0) AS s FROM outc GROUP BY 1,2),
 c AS (SELECT arm, mo, sum(u) OVER w AS u, sum(m) OVER w AS m, sum(s) OVER w AS s FROM d WINDOW w AS (PARTITION BY arm ORDER BY mo))
 SELECT arm, strftime(mo,'%Y-%m') AS look, u::BIGINT AS units, round(m/u,6) AS missing, round(s/(u-m),6) AS metric, mo<(SELECT max(mo) FROM d) AS peek FROM c""",
)
def x5(spark, sf):
    o = outcomes(spark, sf).withColumn("look", F.date_format("o_orderdate", "yyyy-MM"))
    return X.missingness_and_looks(o, "arm", "look", "spend")


def _pair(a, b):
    j = f"(SELECT x.label AS x, y.label AS y FROM annotators x JOIN annotators y USING (item) WHERE x.annotator='{a}' AND y.annotator='{b}')"
    return f"""SELECT '{a}' AS a, '{b}' AS b, n, round(po,6) AS percent, round((po-pe)/(1-pe),6) AS kappa FROM (SELECT count(*) AS n, avg((x=y)::INT::DOUBLE) AS po, avg(x)*avg(y)+(1-avg(x))*(1-avg(y)) AS pe FROM {j})"""


PAIRS = [("A", "B"), ("A", "C"), ("B", "C")]


@query("X6_agreement_pairs", D.with_(D.ANNOTATORS) + " " + " UNION ALL ".join(_pair(a, b) for a, b in PAIRS))
def x6(spark, sf):
    return X.agreement(D.annotators(spark, sf), PAIRS)[0]


@query(
    "X6_agreement_fleiss",
    D.with_(D.ANNOTATORS)
    + """, c AS (SELECT item, label, count(*) AS c FROM annotators GROUP BY 1,2), p AS (SELECT avg((sq-r)/(r*(r-1))::DOUBLE) AS po, count(*) AS items FROM (SELECT item, sum(c) AS r, sum(c*c) AS sq FROM c GROUP BY 1)),
 s AS (SELECT label, sum(c)/(SELECT sum(c) FROM c) AS q FROM c GROUP BY 1), e AS (SELECT sum(q*q) AS pe FROM s)
 SELECT items, round(po,6) AS observed, round((po-pe)/(1-pe),6) AS fleiss_kappa, (SELECT round(max(q),6) FROM s) AS prevalence FROM p, e""",
)
def x6b(spark, sf):
    return X.agreement(D.annotators(spark, sf), PAIRS)[1]


@query(
    "X7_adjudicate",
    D.with_(D.ANNOTATORS)
    + """, a AS (SELECT * FROM annotators WHERE NOT (annotator='C' AND item%3=0)), p AS (SELECT item, sum(label) AS o, count(*) AS r FROM a GROUP BY 1), f AS (SELECT item, CASE WHEN item%9=0 THEN 1 WHEN o*2>r THEN 1 WHEN o*2<r THEN 0 END::BIGINT AS final, CASE WHEN item%9=0 THEN 'adjudicated' WHEN o*2<>r THEN 'majority' ELSE 'pending' END AS status FROM p)
 SELECT item, annotator, label, final, status FROM a JOIN f USING (item)""",
)
def x7(spark, sf):
    a = D.annotators(spark, sf).where("not (annotator = 'C' and item % 3 = 0)")
    dec = a.where("item % 9 = 0").select("item", F.lit(1).cast("bigint").alias("decided")).distinct()
    return X.adjudicate(a, dec)


@query(
    "X8_select_for_labeling",
    f"""WITH p AS (SELECT vec_id, label, {H("'sel|'||vec_id")} AS h, round(abs(({H("vec_id::VARCHAR||'sc'")} % 1000)/1000.0::DOUBLE-0.5),9) AS u FROM embeddings WHERE vec_id%10<>0)
 SELECT vec_id, 'uncertainty' AS strategy FROM (SELECT * FROM p ORDER BY u, vec_id LIMIT 40) UNION ALL SELECT vec_id, 'random' FROM (SELECT * FROM p ORDER BY h, vec_id LIMIT 40)
 UNION ALL SELECT vec_id, 'diversity' FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, vec_id) AS r FROM p ORDER BY r, label, vec_id LIMIT 40)""",
)
def x8(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", ((h32("vec_id", F.lit("sc")) % 1000) / F.lit(1000.0)).alias("score"))
    return X.select_for_labeling(e, "vec_id", "score", "label", e.where("vec_id % 10 = 0"), 40, "sel", "v1").select("vec_id", "strategy")


_RND = "SELECT '{0}' AS strategy, round, sum(c) OVER (ORDER BY round) AS labels, round(sum(k) OVER (ORDER BY round)/sum(c) OVER (ORDER BY round),6) AS metric FROM (SELECT ceil(pos/50.0)::INT AS round, sum((pred=truth)::INT) AS k, count(*) AS c FROM (SELECT *, row_number() OVER (ORDER BY {1}, doc_id) AS pos FROM predictions) GROUP BY 1)"


@query(
    "X9_label_efficiency",
    D.with_(D.predictions_sql())
    + f""", r AS ({_RND.format('random', H("'r|'||doc_id"))} UNION ALL {_RND.format('uncertainty', 'round(abs(score-0.5),9)')}), q AS (SELECT *, lag(labels) OVER (PARTITION BY strategy ORDER BY labels) AS pl, lag(metric) OVER (PARTITION BY strategy ORDER BY labels) AS pm FROM r WHERE labels<=300)
 SELECT strategy, count(*) AS rounds, round(sum((labels-pl)*(metric+pm)/2)/(max(labels)-min(labels)),6) AS auc, arg_max(metric,labels) AS final_metric FROM q GROUP BY 1""",
)
def x9(spark, sf):
    p = D.predictions(spark, sf).withColumn("h", h32(F.lit("r|"), F.col("doc_id"))).withColumn("u", F.round(F.abs(F.col("score") - 0.5), 9))
    ok = F.col("pred") == F.col("truth")
    r = X.label_rounds(p, ["h", "doc_id"], F.floor(F.col("h") / 65536), ok, 50, "random").unionByName(X.label_rounds(p, ["u", "doc_id"], F.floor(F.col("u") * 50000), ok, 50, "uncertainty"))
    return X.label_efficiency(r, 300)


@query(
    "X10_synthetic_utility",
    f"""WITH r AS (SELECT l_quantity AS q, l_extendedprice AS p, l_returnflag AS g, l_suppkey%400 AS s, l_linestatus='O' AS t FROM lineitem), y AS (SELECT l_quantity+{H("l_orderkey::VARCHAR||l_linenumber")}%3 AS q, l_extendedprice*0.9::DOUBLE AS p, l_returnflag AS g, (l_suppkey*2)%400 AS s, l_linestatus='O' AND l_linenumber<6 AS t FROM lineitem)
 SELECT 'correlation_gap' AS measure, 'q~p' AS subject, round(abs((SELECT corr(q,p) FROM r)-(SELECT corr(q,p) FROM y)),6) AS value
 UNION ALL SELECT 'rare_coverage','s', (SELECT round(count(*) FILTER (s IN (SELECT s FROM y))/count(*)::DOUBLE,6) FROM (SELECT s FROM r GROUP BY 1 HAVING count(*)<0.02::DOUBLE*(SELECT count(*) FROM r)))
 UNION ALL SELECT 'subgroup_gap', g, round(abs(a-b),6) FROM (SELECT g, avg(t::INT::DOUBLE) AS a FROM r GROUP BY 1) JOIN (SELECT g, avg(t::INT::DOUBLE) AS b FROM y GROUP BY 1) USING (g) UNION ALL SELECT 'schema_match','all',1.0""",
)
def x10(spark, sf):
    li = table(spark, sf, "lineitem")
    real = li.select(F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.col("l_returnflag").alias("g"), (F.col("l_suppkey") % 400).alias("s"), (F.col("l_linestatus") == "O").alias("t"))
    syn = li.select(
        (F.col("l_quantity") + h32("l_orderkey", "l_linenumber") % 3).alias("q"), (F.col("l_extendedprice") * 0.9).alias("p"), F.col("l_returnflag").alias("g"), ((F.col("l_suppkey") * 2) % 400).alias("s"),
        ((F.col("l_linestatus") == "O") & (F.col("l_linenumber") < 6)).alias("t"),
    )
    return X.synthetic_utility(real, syn, ["q", "p"], "g", F.col("t"), "s", 0.02).where("measure not in ('ks', 'psi')")


def _fit3(rows: str) -> str:
    """CTEs f0..f3: normal equations of x and y by set, solved row by row."""
    eq = ", ".join("[" + ", ".join([*[f"sum(x[{i}]*x[{j}])" for j in (1, 2, 3)], f"sum(x[{i}]*y)"]) + "]" for i in (1, 2, 3))
    steps = [f'f0 AS (SELECT "set", [{eq}] AS m FROM {rows} GROUP BY 1)']
    for k in (1, 2, 3):
        steps.append(
            f'f{k} AS (SELECT "set", list_transform(m, lambda r, i: CASE WHEN i={k} THEN p ELSE list_transform(r, lambda v, j: v-p[j]*r[{k}]) END) AS m FROM (SELECT "set", m, list_transform(m[{k}], lambda v: v/m[{k}][{k}]) AS p FROM f{k - 1}))'
        )
    return ", ".join(steps)


@query(
    "X10_train_on_synthetic",
    f"""WITH r AS (SELECT 'real' AS "set", [1.0::DOUBLE, l_quantity, l_extendedprice/1000] AS x, (l_linenumber>3)::INT::DOUBLE AS y, l_orderkey%4=0 AS held FROM lineitem
 UNION ALL SELECT 'synthetic', [1.0::DOUBLE, l_quantity+{H("l_orderkey::VARCHAR||l_linenumber")}%3, l_extendedprice*0.9::DOUBLE/1000], (l_linenumber>3 AND l_quantity>10)::INT::DOUBLE, false FROM lineitem),
 tr AS (SELECT * FROM r WHERE NOT held), {_fit3('tr')}, t AS (SELECT f3."set" AS train, r."set" AS test, (list_inner_product(x, list_transform(m, lambda q: q[4]))>=0.5)::INT::DOUBLE=y AS hit FROM r, f3 WHERE held OR r."set"='synthetic'),
 a AS (SELECT train, test, count(*) AS n, avg(hit::INT::DOUBLE) AS acc FROM t GROUP BY 1,2)
 SELECT a.train, a.test, a.n, round(a.acc,6) AS accuracy, round(o.acc-a.acc,6) AS gap FROM a JOIN a o ON o.train=a.test AND o.test=a.test""",
)
def x10b(spark, sf):
    li = table(spark, sf, "lineitem")
    real = li.select(F.col("l_quantity").alias("q"), (F.col("l_extendedprice") / 1000).alias("p"), (F.col("l_linenumber") > 3).alias("t"), (F.col("l_orderkey") % 4 == 0).alias("held"))
    syn = li.select(
        (F.col("l_quantity") + h32("l_orderkey", "l_linenumber") % 3).alias("q"), (F.col("l_extendedprice") * 0.9 / 1000).alias("p"), ((F.col("l_linenumber") > 3) & (F.col("l_quantity") > 10)).alias("t")
    )
    return X.train_on_synthetic(real, syn, ["q", "p"], F.col("t"), F.col("held"))


@query(
    "X12_private_aggregate",
    f"""WITH b AS (SELECT event_type, least(30.0,greatest(0.0,value)) AS c FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {H("'dp|'||event_id")}, event_id)<=20), g AS (SELECT event_type, count(*) AS exact_n, sum(c) AS s, {U("'dp|n|'||event_type")}-0.5 AS un, {U("'dp|s|'||event_type")}-0.5 AS us FROM b GROUP BY 1)
 SELECT event_type, exact_n, round(s,6) AS exact_sum, round(exact_n-40.0*sign(un)*ln(1-2*abs(un)),6) AS noisy_n, round(s-1200.0*sign(us)*ln(1-2*abs(us)),6) AS noisy_sum, 1.0::DOUBLE AS epsilon FROM g""",
)
def x12(spark, sf):
    b = X.bounded_contributions(table(spark, sf, "events"), "user_id", "event_id", F.col("value"), 20, 0.0, 30.0, "dp")
    return X.private_aggregate(b, "event_type", 1.0, 20, 0.0, 30.0, "dp")


@query(
    "X12_epsilon_ledger",
    """WITH RECURSIVE s AS (SELECT user_id AS dataset, strftime(ts,'%Y-%m-%d') AS day, count(*)*0.05::DOUBLE AS e, row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts,'%Y-%m-%d')) AS i FROM events GROUP BY 1,2),
 r AS (SELECT dataset, day, i, CASE WHEN round(e,9)>0.2 THEN 0 ELSE round(e,9) END AS spent, round(e,9)>0.2 AS refused FROM s WHERE i=1
  UNION ALL SELECT s.dataset, s.day, s.i, CASE WHEN round(r.spent+e,9)>0.2 THEN r.spent ELSE round(r.spent+e,9) END, round(r.spent+e,9)>0.2 FROM r JOIN s ON s.dataset=r.dataset AND s.i=r.i+1)
 SELECT dataset, day, spent, refused FROM r""",
)
def x12b(spark, sf):
    s = table(spark, sf, "events").groupBy(F.col("user_id").alias("dataset"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg((F.count(F.lit(1)) * 0.05).alias("eps"))
    return X.epsilon_ledger(s, "dataset", "day", "eps", 0.2).drop("eps")


def weak_functions():
    t = F.col("text")
    return [
        ("long", F.when(F.col("n_chars") > 300, 1)), ("junk", F.when(t.rlike(r"[#$%&*]{3}"), 0)), ("short", F.when(F.col("n_chars") < 80, 0)), ("english", F.when((F.col("lang") == "en") & t.contains(" the "), 1)),
    ]


_WF = """f AS (SELECT d.doc_id, l.quality AS t, [CASE WHEN n_chars>300 THEN 1 END, CASE WHEN regexp_matches(text,'[#$%&*]{3}') THEN 0 END, CASE WHEN n_chars<80 THEN 0 END, CASE WHEN lang='en' AND contains(text,' the ') THEN 1 END] AS a FROM documents d LEFT JOIN labels l USING (doc_id)),
 v AS (SELECT *, len(list_filter(a, lambda x: x IS NOT NULL))::INT AS n, coalesce(list_sum(a),0)::INT AS o FROM f)"""


@query("X13_weak_labels", f"WITH {_WF} SELECT doc_id, n AS votes, CASE WHEN o*2>n THEN 1 WHEN o*2<n AND n>0 THEN 0 END::INT AS label, o>0 AND o<n AS conflict FROM v")
def x13(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return X.weak_labels(d, "doc_id", weak_functions(), "quality", "v1")[0].drop("method_version")


@query(
    "X13_weak_label_quality",
    f"WITH {_WF} " + " UNION ALL ".join(f"SELECT '{n}' AS function, round(count(a[{i}])/count(*)::DOUBLE,6) AS coverage, round(count(*) FILTER (a[{i}] IS NOT NULL AND o>0 AND o<n)/count(*)::DOUBLE,6) AS conflict, round(avg((a[{i}]=t)::INT::DOUBLE),6) AS accuracy FROM v" for i, n in enumerate(["long", "junk", "short", "english"], 1)),
)
def x13b(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return X.weak_labels(d, "doc_id", weak_functions(), "quality", "v1")[1]
