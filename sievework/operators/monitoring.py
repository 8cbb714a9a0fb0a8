"""Service, profile, drift, cost and capacity analytics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sievework.functions.columns import h32, ratio, seconds
from sievework.functions.scan import exact_quantiles, last_known, running
from sievework.operators.evaluation import bootstrap_ci, metric_gate
from sievework.session import cut

PCTS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def _day_block(ts: str, width: int = 86400) -> Column:
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (1000000 * width))


def service_sli(requests: DataFrame, window_seconds: int, capacity_per_second: float, exact: bool = True) -> DataFrame:
    """Per service and window: availability, error rate, throughput, latency
    percentiles, saturation. ``exact=False`` uses the mergeable sketch."""
    start = F.timestamp_seconds(F.floor(seconds(F.col("ts")) / window_seconds) * window_seconds)
    src = requests.withColumn("window_start", start)
    n = F.count(F.lit(1))
    aggs = [
        n.alias("n"), F.round(1 - F.count_if("failed") / n, 6).alias("availability"), F.round(F.count_if("failed") / n, 6).alias("error_rate"),
        F.round(n / window_seconds, 6).alias("throughput"), F.round(n / window_seconds / capacity_per_second, 6).alias("saturation"),
    ]
    keys = ["service", "window_start"]
    if not exact:
        return src.groupBy(*keys).agg(*aggs, *[F.percentile_approx("latency_ms", p, 10000).alias(k) for k, p in PCTS.items()])
    q = exact_quantiles(src, keys, "latency_ms", PCTS)
    return src.groupBy(*keys).agg(*aggs).join(q.select(*keys, *[F.round(k, 6).alias(k) for k in PCTS]), keys)


def burn_rate(requests: DataFrame, objective: float, short_s: int, long_s: int, limit: float, bucket_s: int = 3600) -> DataFrame:
    """Error-budget burn over a short and a long trailing window per service;
    alert only when both exceed. Counts are bucketed first, so the range frames
    run over buckets and not over requests."""
    b = F.floor(seconds(F.col("ts")) / bucket_s) * bucket_s
    per = requests.groupBy("service", b.cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("bad"))
    out = per
    for name, span in (("short", short_s), ("long", long_s)):
        w = Window.partitionBy("service").orderBy("bucket").rangeBetween(-(span - bucket_s), 0)
        out = out.withColumn(f"burn_{name}", F.round(F.sum("bad").over(w) / F.sum("n").over(w) / (1 - objective), 6))
    return out.withColumn("alert", (F.col("burn_short") > limit) & (F.col("burn_long") > limit))


def sustained_alerts(series: DataFrame, subject: str, at: str, value: str, count: str, limit: float, n: int, min_n: int, labels: DataFrame | None = None) -> DataFrame:
    """Alerts that open at the n-th breach in a row and close at the next clear
    reading; windows with few samples neither fire nor clear.

    The series is one row per subject and window, so its windows are small.
    ``labels(subject, ...)`` adds versions, owner, dashboard and runbook."""
    s = series.where(F.col(count) >= min_n).withColumn("_b", F.col(value) > limit)
    w = Window.partitionBy(subject).orderBy(at)
    s = s.withColumn("_g", F.sum(F.when(F.col("_b"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("_k", F.sum(F.col("_b").cast("int")).over(Window.partitionBy(subject, "_g").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("_close", F.min(F.when(~F.col("_b"), F.col(at))).over(w.rowsBetween(1, Window.unboundedFollowing)))
    out = s.where(F.col("_b")).groupBy(subject, "_g").agg(
        F.min(F.when(F.col("_k") == n, F.col(at))).alias("opened"), F.max("_close").alias("closed"), F.max("_k").alias("length"), F.round(F.max(value), 6).alias("worst")
    ).where("opened is not null").drop("_g")
    return out if labels is None else out.join(labels, subject, "left")


def profile_numeric(df: DataFrame, cols: Sequence[str], bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Count, nulls, min, max, mean, deviation, quartiles and a histogram over
    the column's range, per column (and per ``by`` group)."""
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols]))
    long = df.select(*by, pairs)
    keys = [*by, "column"]
    base = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("v").isNull()).alias("nulls"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("std"),
    )
    q = exact_quantiles(long, keys, "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    j = long.where("v is not null").join(F.broadcast(base.select(*keys, "min", "max")) if not by else base.select(*keys, "min", "max"), keys)
    slot = F.when(F.col("max") > F.col("min"), F.least(F.floor((F.col("v") - F.col("min")) / (F.col("max") - F.col("min")) * bins), F.lit(bins - 1))).otherwise(0)
    h = j.groupBy(*keys, slot.cast("int").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    h = h.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("b", "c"))).alias("_m"))
    hist = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0)))
    return base.join(q, keys, "left").join(h, keys, "left").withColumn("histogram", hist).drop("_m")


def profile_categorical(df: DataFrame, cols: Sequence[str], top: int, restricted: Sequence[str] = ()) -> DataFrame:
    """Top-n values per column and the rest as ``(other)``; values of restricted
    columns are shown as digests."""
    val = lambda c: F.substring(F.md5(F.col(c).cast("string")), 1, 8) if c in restricted else F.col(c).cast("string")
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), val(c).alias("value")) for c in cols]))
    counts = df.select(pairs).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.withColumn("_r", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("_r") <= top)
    best = best.select("column", "value", "n")
    rest = counts.groupBy("column").agg(F.sum("n").alias("all")).join(best.groupBy("column").agg(F.sum("n").alias("shown")), "column")
    other = rest.select("column", F.lit("(other)").alias("value"), (F.col("all") - F.col("shown")).alias("n")).where("n > 0")
    return best.unionByName(other)


def drift(ref: DataFrame, cur: DataFrame, cols: Sequence[str], bins: int = 10, psi_limit: float = 0.2, ks_limit: float = 0.1, floor: float = 1e-4) -> DataFrame:
    """PSI, KS, Jensen-Shannon and chi-square per numeric column, with sample
    sizes and a verdict. Bin edges come from the reference range; KS scans
    distinct values in blocks."""
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols]))
    both = ref.select(F.lit(0).alias("side"), pairs).unionByName(cur.select(F.lit(1).alias("side"), pairs)).where("v is not null")
    # Read three times below, so both tables are counted once.
    vals = cut(both.groupBy("column", "v").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b")))
    stat = vals.groupBy("column").agg(
        F.min(F.when(F.col("a") > 0, F.col("v"))).alias("lo"), F.max(F.when(F.col("a") > 0, F.col("v"))).alias("hi"), F.sum("a").alias("na"), F.sum("b").alias("nb"),
        F.min("v").alias("_vlo"), F.max("v").alias("_vhi"),
    )
    vals = vals.join(stat, "column")
    wide = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    slot = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(wide * bins))).cast("int")
    cells = vals.groupBy("column", slot.alias("bin")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    cells = stat.select("column", "na", "nb").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(cells.drop("na", "nb"), ["column", "bin"], "left")
    p = F.greatest(F.coalesce("a", F.lit(0)) / F.col("na"), F.lit(floor))
    q = F.greatest(F.coalesce("b", F.lit(0)) / F.col("nb"), F.lit(floor))
    cells = cells.withColumn("p", p).withColumn("q", q).withColumn("m", (F.col("p") + F.col("q")) / 2)
    expected = F.col("p") * F.col("nb")
    shape = cells.groupBy("column").agg(
        F.sum((F.col("p") - F.col("q")) * F.ln(F.col("p") / F.col("q"))).alias("psi"),
        (F.sum(F.col("p") * F.ln(F.col("p") / F.col("m"))) / 2 + F.sum(F.col("q") * F.ln(F.col("q") / F.col("m"))) / 2).alias("js"),
        F.sum(F.pow(F.coalesce("b", F.lit(0)) - expected, F.lit(2.0)) / expected).alias("chi2"),
    )
    span = F.when(F.col("_vhi") > F.col("_vlo"), (F.col("v") - F.col("_vlo")) / (F.col("_vhi") - F.col("_vlo"))).otherwise(0.0)
    cum = running(vals, ["column"], ["v"], F.floor(span * 511).cast("int"), ca=("sum", F.col("a")), cb=("sum", F.col("b")))
    ks = cum.groupBy("column").agg(F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))).alias("ks"))
    out = stat.select("column", "na", "nb").join(shape, "column").join(ks, "column")
    hit = (F.col("psi") > psi_limit) | (F.col("ks") > ks_limit)
    return out.select("column", "na", "nb", *[F.round(c, 6).alias(c) for c in ("psi", "ks", "js", "chi2")], F.when(hit, "drift").otherwise("stable").alias("verdict"))


def staleness(assets: DataFrame, name: str, ts: str, truth: Column, now: Column, max_age_s: int) -> DataFrame:
    a = assets.groupBy(name).agg(F.max(ts).alias("_t"), F.count(F.lit(1)).alias("n"), F.round(F.count_if(truth.isNull()) / F.count(F.lit(1)), 6).alias("missing_truth"))
    age = seconds(now) - seconds(F.col("_t"))
    return a.select(name, "n", F.round(age, 3).alias("age_s"), "missing_truth", (age > max_age_s).alias("breach"))


def canary_split(requests: DataFrame, unit: str, salt: str, weights: dict[str, int], pinned: Column, tolerance: float) -> DataFrame:
    """Observed against configured share per version. ``pinned`` names the
    version of a pinned route, else null; weights are parts of 100."""
    b = h32(F.lit(f"{salt}|"), F.col(unit)) % 100
    total, arm = 0, F.lit(None).cast("string")
    for v, w in weights.items():
        arm = F.when(arm.isNull() & (b < total + w), v).otherwise(arm)
        total += w
    src = requests.withColumn("_pin", pinned).withColumn("version", F.coalesce("_pin", arm))
    per = src.groupBy("version").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_pin").isNull()).alias("routed"), F.count_if(F.col("_pin").isNotNull()).alias("pinned"))
    routed = per.agg(F.sum("routed")).scalar()
    want = reduce(lambda acc, kv: F.when(F.col("version") == kv[0], kv[1] / 100.0).otherwise(acc), weights.items(), F.lit(0.0))
    share = F.col("routed") / routed
    return per.select("version", "n", "pinned", F.round(share, 6).alias("share"), want.alias("configured"), (F.abs(share - want) <= tolerance).alias("within"))


def shadow_compare(primary: DataFrame, shadow: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """Per class: agreement, score and latency deltas, shadow failures.
    Both: (request_id, cls, label, score, latency_ms)."""
    p = primary.where(~F.col("cls").isin(*excluded)) if excluded else primary
    s = shadow.select("request_id", F.col("label").alias("sl"), F.col("score").alias("ss"), F.col("latency_ms").alias("sm"))
    j = p.join(s, "request_id", "left")
    return j.groupBy("cls").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("sl").isNull()).alias("shadow_failures"),
        F.round(F.avg((F.col("label") == F.col("sl")).cast("double")), 6).alias("agreement"), F.round(F.avg(F.col("ss") - F.col("score")), 6).alias("score_delta"),
        F.round(F.avg(F.col("sm") - F.col("latency_ms")), 6).alias("latency_delta"),
    )


def load_report(samples: DataFrame, warmup_s: float, max_error: float, max_p95: float) -> DataFrame:
    """Per load step after warm-up: correctness, errors, throughput, percentiles,
    verdict (correctness first), and the cold first-seconds mean.

    samples(step, since_start_s, ok, correct, latency_ms, duration_s)."""
    warm = samples.where(F.col("since_start_s") >= warmup_s)
    q = exact_quantiles(warm, ["step"], "latency_ms", PCTS)
    n = F.count(F.lit(1))
    s = warm.groupBy("step").agg(
        n.alias("n"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("correctness"), F.round(1 - F.avg(F.col("ok").cast("double")), 6).alias("error_rate"),
        F.round(n / (F.max("since_start_s") - warmup_s), 6).alias("throughput"),
    )
    cold = samples.where(F.col("since_start_s") < warmup_s).groupBy("step").agg(F.round(F.avg("latency_ms"), 6).alias("cold_mean_ms"))
    out = s.join(q.select("step", *[F.round(k, 6).alias(k) for k in PCTS]), "step").join(cold, "step", "left")
    verdict = F.when(F.col("correctness") < 1 - max_error, "fail_correctness").when(F.col("error_rate") > max_error, "fail_errors").when(F.col("p95") > max_p95, "fail_latency").otherwise("pass")
    return out.withColumn("verdict", verdict)


def token_latency(tokens: DataFrame, bucket_width: int) -> DataFrame:
    """Per output-length bucket: time to first token, mean gap, tokens per
    second and end-to-end percentiles. tokens(request_id, sent_at, at).

    Mean gap needs only first, last and count, so no per-request sort is made."""
    r = tokens.groupBy("request_id").agg(F.min("sent_at").alias("s"), F.min("at").alias("a"), F.max("at").alias("z"), F.count(F.lit(1)).alias("n"))
    sec = lambda x, y: seconds(F.col(x)) - seconds(F.col(y))
    r = r.select(
        (F.floor(F.col("n") / bucket_width) * bucket_width).alias("bucket"), "n", sec("a", "s").alias("ttft"), sec("z", "s").alias("e2e"),
        F.when(F.col("n") > 1, sec("z", "a") / (F.col("n") - 1)).alias("gap"),
    )
    q = exact_quantiles(r, ["bucket"], "e2e", {"e2e_p50": 0.5, "e2e_p95": 0.95}).join(exact_quantiles(r, ["bucket"], "ttft", {"ttft_p50": 0.5}), "bucket", "left")
    base = r.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("requests"), F.round(F.avg("gap"), 6).alias("mean_gap"), F.round(ratio(F.sum("n"), F.sum("e2e")), 6).alias("tokens_per_s")
    )
    return base.join(q, "bucket").select("bucket", "requests", "mean_gap", "tokens_per_s", *[F.round(c, 6).alias(c) for c in ("e2e_p50", "e2e_p95", "ttft_p50")])


def scrape_health(samples: DataFrame, target: str, ts: str, tie: str, value: str) -> DataFrame:
    """Latest up value per target; ready only when it is 1."""
    last = samples.groupBy(target).agg(F.max_by(value, F.struct(ts, tie)).alias("up"))
    return last.withColumn("ready", F.col("up") == 1)


def step_report(steps: DataFrame) -> DataFrame:
    """Per run: steps, unmet steps, status, total and slowest step.
    steps(run_id, position, name, returncode, expected_failure, elapsed_seconds).
    A step is met when it fails exactly if failure was expected."""
    met = (F.col("returncode") != 0) == F.col("expected_failure")
    return steps.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("steps"), F.count_if(~met).alias("unmet"), F.when(F.bool_and(met), "passed").otherwise("failed").alias("status"),
        F.round(F.sum("elapsed_seconds"), 3).alias("elapsed_seconds"),
        F.max_by("name", F.struct("elapsed_seconds", -F.col("position"))).alias("slowest"),
    )


def showback(usage: DataFrame, levels: Sequence[str], rates: dict[str, float], shared: str | None = None) -> DataFrame:
    """Cost by the level hierarchy with subtotals. A row with a null first level
    is unattributed; rows whose first level equals ``shared`` are split over the
    others by their own cost, so every cost counts once."""
    cost = reduce(lambda a, kv: a + F.coalesce(F.col(kv[0]).cast("double"), F.lit(0.0)) * kv[1], rates.items(), F.lit(0.0))
    src = usage.withColumn("cost", cost).withColumn(levels[0], F.coalesce(F.col(levels[0]).cast("string"), F.lit("(unattributed)")))
    if shared is not None:
        own = F.col(levels[0]) != shared
        t = src.agg(F.struct(F.sum(F.when(own, F.col("cost"))).alias("own"), F.coalesce(F.sum(F.when(~own, F.col("cost"))), F.lit(0.0)).alias("shared"))).scalar()
        src = src.where(own).withColumn("_t", t).withColumn("cost", F.col("cost") * (1 + F.col("_t.shared") / F.col("_t.own"))).drop("_t")
    g = src.rollup(*levels).agg(F.grouping_id().alias("_g"), F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("rows"))
    depth = F.lit(len(levels)) - F.length(F.replace(F.bin("_g"), F.lit("0"), F.lit("")))
    names = [F.when(F.lit(i) < depth, F.coalesce(F.col(c).cast("string"), F.lit("(none)"))).otherwise("(all)").alias(c) for i, c in enumerate(levels)]
    return g.select(*names, depth.alias("level"), "rows", F.round("cost", 4).alias("cost"))


def accelerator_cost(alloc: DataFrame, util: DataFrame, by: Sequence[str], watts: float, step_s: float) -> DataFrame:
    """Requested, covered (overlaps once) and used seconds with an energy proxy.

    alloc(run, start_s, end_s, *by), util(run, at_s, value). Intervals and
    samples are stacked and scanned in time with a running maximum of interval
    ends, so overlap needs no interval join."""
    day = 86400
    keys = list(dict.fromkeys([*by, "run"]))
    a = alloc.select(*keys, F.col("start_s").alias("t"), F.lit(0).alias("side"), F.col("end_s").alias("e"), F.lit(None).cast("double").alias("v"))
    u = util.join(alloc.select(*keys).distinct(), "run").select(*keys, F.col("at_s").alias("t"), F.lit(1).alias("side"), F.lit(None).cast("double").alias("e"), F.col("value").alias("v"))
    s = running(a.unionByName(u), keys, ["t", "side", "e", "v"], F.floor(F.col("t") / day), inclusive=False, reach=("max", F.col("e")))
    cover = F.when(F.col("side") == 0, F.greatest(F.lit(0.0), F.col("e") - F.greatest(F.col("t"), F.coalesce("reach", F.col("t")))))
    used = F.when((F.col("side") == 1) & (F.col("reach") > F.col("t")), F.col("v") * step_s)
    return s.groupBy(*by).agg(
        F.round(F.sum(F.when(F.col("side") == 0, F.col("e") - F.col("t"))), 3).alias("requested_s"), F.round(F.sum(cover), 3).alias("covered_s"),
        F.round(F.coalesce(F.sum(used), F.lit(0.0)), 3).alias("used_s"), F.round(F.coalesce(F.sum(used), F.lit(0.0)) * watts / 3600, 6).alias("watt_hours"),
    )


def budget_audit(usage: DataFrame, key: str, order: Sequence[str], amount: Column, limit: float, ts: str) -> DataFrame:
    """Per key: total, first row over the limit (exactly at it is not over) and
    rows over. Retries are rows like others; pass aborted use as amount or 0."""
    s = running(usage, [key], list(order), _day_block(ts), total=("sum", amount))
    over = F.round("total", 6) > limit
    return s.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum(amount), 6).alias("used"), F.count_if(over).alias("rows_over"),
        F.min_by(order[-1], F.when(over, F.struct(*order))).alias("first_over"),
    )


def stage_latency(spans: DataFrame) -> DataFrame:
    """Self time per stage and version: duration minus its children.
    spans(span_id, parent_id, stage, version, duration)."""
    kids = spans.where("parent_id is not null").groupBy("parent_id").agg(F.sum("duration").alias("kids"))
    ids = spans.select(F.col("span_id").alias("parent_id"), F.lit(True).alias("known"))
    s = spans.join(kids.withColumnRenamed("parent_id", "span_id"), "span_id", "left").join(ids, "parent_id", "left")
    s = s.withColumn("self", F.greatest(F.lit(0.0), F.col("duration") - F.coalesce("kids", F.lit(0.0)))).withColumn("orphan", F.col("parent_id").isNotNull() & F.col("known").isNull())
    q = exact_quantiles(s, ["stage", "version"], "self", {"p95": 0.95})
    return s.groupBy("stage", "version").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("self"), 6).alias("self_total"), F.count_if("orphan").alias("orphans")).join(
        q.select("stage", "version", F.round("p95", 6).alias("p95")), ["stage", "version"]
    )


def next_known(df: DataFrame, key: str, ts: str, tie: str, **values: Column) -> DataFrame:
    """Nearest following value per row: the scan of ``last_known`` mirrored."""
    us = -F.unix_micros(F.col(ts).cast("timestamp"))
    src = df.withColumn("_neg", us).withColumn("_negtie", -F.col(tie))
    return last_known(src, [key], ["_neg", "_negtie"], F.floor(F.col("_neg") / 86400000000), **values).drop("_neg", "_negtie")


def incident_times(injections: DataFrame, signals: DataFrame, horizon_s: float) -> tuple[DataFrame, DataFrame]:
    """(times per injection, alerts that follow no injection).

    injections(service, id, ts), signals(service, id, ts, kind) with kind
    detect, ack or recover; ids unique over both."""
    blank = F.lit(None).cast("string")
    both = injections.select("service", "id", "ts", blank.alias("kind")).unionByName(signals.select("service", "id", "ts", "kind"))
    pick = lambda k: F.when(F.col("kind") == k, F.col("ts"))
    nxt = next_known(both, "service", "ts", "id", detect=pick("detect"), ack=pick("ack"), recover=pick("recover")).where("kind is null")
    gap = lambda c: seconds(F.col(c)) - seconds(F.col("ts"))
    times = nxt.select("service", "id", *[F.when(gap(c) <= horizon_s, F.round(gap(c), 3)).alias(f"{c}_s") for c in ("detect", "ack", "recover")])
    prev = last_known(both, ["service"], ["ts", "id"], _day_block("ts"), inj=F.when(F.col("kind").isNull(), F.col("ts"))).where("kind = 'detect'")
    stray = prev.where(F.col("inj").isNull() | (seconds(F.col("ts")) - seconds(F.col("inj")) > horizon_s)).select("service", "id")
    return times, stray


def weighted_choice(results: DataFrame, weights: dict[str, float], higher_better: dict[str, bool]) -> DataFrame:
    """Score per option and workload from min-max normalized criteria; an
    untested criterion blocks the option there. results(option, workload,
    criterion, value)."""
    one = results.groupBy("option", "workload").agg(*[F.avg(F.when(F.col("criterion") == c, F.col("value"))).alias(c) for c in weights])
    span = one.groupBy("workload").agg(*[f(c).alias(f"{t}_{c}") for c in weights for t, f in (("lo", F.min), ("hi", F.max))])
    j = one.join(span, "workload")
    total = float(sum(weights.values()))
    score = F.lit(0.0)
    for c, w in weights.items():
        n = F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).when(F.col(c).isNotNull(), 1.0)
        score = score + (n if higher_better[c] else 1 - n) * (w / total)
    blocked = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in weights])
    out = j.select("workload", "option", blocked.alias("blocked"), F.when(~blocked, F.round(score, 6)).alias("score"))
    best = out.where("not blocked").groupBy("workload").agg(F.max_by("option", F.struct("score", "option")).alias("_best"))
    return out.join(best, "workload", "left").select("*", F.coalesce(F.col("option") == F.col("_best"), F.lit(False)).alias("best_here")).drop("_best")


def capacity_estimate(load: DataFrame, max_p95: float, max_error: float, resources: Sequence[str], key: str, b: int, seed: str) -> DataFrame:
    """Largest load step within the objectives, the fullest resource there, and
    a bootstrap interval of its error rate. load(step, latency_ms, ok, *resources)."""
    q = exact_quantiles(load, ["step"], "latency_ms", {"p95": 0.95})
    s = load.groupBy("step").agg(F.count(F.lit(1)).alias("n"), (1 - F.avg(F.col("ok").cast("double"))).alias("error_rate"), *[F.avg(r).alias(r) for r in resources]).join(q, "step")
    good = s.where((F.col("p95") <= max_p95) & (F.col("error_rate") <= max_error))
    top = good.agg(F.max("step")).scalar()
    at = s.where(F.col("step") == top)
    full = F.array_max(F.array(*[F.struct(F.col(r).alias("u"), F.lit(r).alias("r")) for r in resources]))
    ci = bootstrap_ci(load.where(F.col("step") == top), key, (~F.col("ok")).cast("int"), F.lit(1), b, seed, buckets=64)
    return at.select("step", "n", F.round("p95", 6).alias("p95"), F.round("error_rate", 6).alias("error_rate"), full["r"].alias("bottleneck")).withColumns(
        {"low": ci.select("low").scalar(), "high": ci.select("high").scalar()}
    )


def safety_gate(results: DataFrame, minimums: dict[str, float]) -> DataFrame:
    """Pass rate by category for base and candidate; a seeded item the base
    passes and the candidate fails denies, whatever the rate.

    results(category, base_pass, cand_pass, seeded)."""
    broke = F.col("seeded") & F.col("base_pass") & ~F.col("cand_pass")
    per = results.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("base_pass").cast("double")), 6).alias("base_rate"),
        F.round(F.avg(F.col("cand_pass").cast("double")), 6).alias("cand_rate"), F.count_if(broke).alias("seeded_regressions"),
    )
    gates = metric_gate(
        per.select(F.col("category").alias("subject"), F.concat(F.lit("pass_rate:"), "category").alias("metric"), F.col("cand_rate").alias("value")),
        {f"pass_rate:{c}": m for c, m in minimums.items()}, "safety",
    ).where(F.col("metric") == F.concat(F.lit("pass_rate:"), "subject"))
    j = per.join(gates.select(F.col("subject").alias("category"), F.col("decision").alias("_d")), "category", "left")
    return j.withColumn("decision", F.when((F.col("seeded_regressions") > 0) | F.coalesce(F.col("_d") != "allow", F.lit(True)), "deny").otherwise("allow")).drop("_d")
