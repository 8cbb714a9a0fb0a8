"""Data-quality checks: aggregates in, evidence rows out, never row values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sievework.functions.columns import ratio, reasons, uniform


def _inline(df: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """One aggregate pass, one output row per struct."""
    return df.agg(F.array(*structs).alias("_r")).select(F.inline("_r"))


def check_not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return _inline(
        df,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.count_if(F.col(c).isNull()).alias("nulls"),
                F.coalesce(ratio(F.count_if(F.col(c).isNull()), F.count(F.lit(1))), F.lit(0.0)).alias("null_ratio"),
            )
            for c in cols
        ],
    )


def check_range(df: DataFrame, bounds: dict[str, dict[str, float]]) -> DataFrame:
    """Counts outside bounds given as gt, ge, lt, le; nulls are not out of range."""
    out = []
    for c, b in bounds.items():
        ok = F.lit(True)
        for op, v in b.items():
            ok = ok & {"gt": F.col(c) > v, "ge": F.col(c) >= v, "lt": F.col(c) < v, "le": F.col(c) <= v}[op]
        out.append(F.struct(F.lit(c).alias("column"), F.count_if(~ok).alias("out_of_range"), F.count(c).alias("checked")))
    return _inline(df, out)


def check_domain(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    """(value, problem, n): values outside the set, and allowed values never seen."""
    seen = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    allowed = df.sparkSession.createDataFrame([(v,) for v in values], f"value {df.schema[col].dataType.simpleString()}")
    outside = seen.join(allowed, "value", "left_anti").select("value", F.lit("outside").alias("problem"), "n")
    unseen = allowed.join(seen, "value", "left_anti").select("value", F.lit("never_seen").alias("problem"), F.lit(0).cast("bigint").alias("n"))
    return outside.unionByName(unseen)


def check_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    dup = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return dup.agg(F.count(F.lit(1)).alias("duplicate_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"))


# fixed values: feature-name parts that give the answer away
LEAKY_TERMS = ("target", "label", "sold", "sale", "closed", "days_on_market")


def check_leaky_names(df: DataFrame, names: str, terms: Sequence[str] = LEAKY_TERMS) -> DataFrame:
    """(name, term) for feature names that contain a leaky term."""
    hits = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.lower(F.col(names)).contains(t))
    return df.select(names).distinct().select(names, F.explode(hits).alias("term"))


def check_leaky_values(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Features equal to the target, or to its binary inverse, on every row."""
    y = F.col(target)
    return _inline(
        df,
        [
            F.struct(
                F.lit(f).alias("feature"),
                F.coalesce(F.bool_and(F.col(f).eqNullSafe(y)), F.lit(False)).alias("equals_target"),
                F.coalesce(F.bool_and(F.col(f).eqNullSafe(F.lit(1) - y)), F.lit(False)).alias("equals_inverse"),
            )
            for f in features
        ],
    )


def check_category_purity(df: DataFrame, cats: Sequence[str], target: str) -> DataFrame:
    """Category values that do not occur with every target class."""
    classes = df.agg(F.count_distinct(target)).scalar()
    stacked = df.select(target, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cats])).alias("e"))
    return (
        stacked.groupBy("e.column", "e.value")
        .agg(F.count_distinct(target).alias("classes"), F.count(F.lit(1)).alias("n"))
        .where(F.col("classes") < classes)
    )


def check_split_overlap(train: DataFrame, test: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """Ids on both sides and rows the split lost, by one co-partitioned grouping."""
    tag = lambda d, a, b, w: d.select(key, *[F.lit(x).alias(n) for n, x in (("a", a), ("b", b), ("w", w))])
    per = (
        tag(train, 1, 0, 0).unionByName(tag(test, 0, 1, 0)).unionByName(tag(whole, 0, 0, 1))
        .groupBy(key).agg(*[F.sum(c).alias(c) for c in "abw"])
    )
    return per.agg(
        F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("overlap_ids"),
        F.coalesce(F.sum(F.greatest(F.col("w") - F.col("a") - F.col("b"), F.lit(0))), F.lit(0)).alias("lost_rows"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("train_rows"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("test_rows"),
    )


def check_class_coverage(df: DataFrame, split: str, target: str, splits: Sequence[str], classes: Sequence[int]) -> DataFrame:
    """Row count for every expected (split, class), with the empty ones flagged."""
    want = df.sparkSession.createDataFrame(
        [(s, c) for s in splits for c in classes],
        f"{split} {df.schema[split].dataType.simpleString()}, {target} {df.schema[target].dataType.simpleString()}",
    )
    have = df.groupBy(split, target).agg(F.count(F.lit(1)).alias("n"))
    return want.join(have, [split, target], "left").select(
        split, target, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n", F.lit(0)).__eq__(0).alias("missing")
    )


def evidence(df: DataFrame, check: str, subject: Column, observed: Column, threshold: float, severity: str) -> DataFrame:
    """Common evidence shape; a null observation fails."""
    ok = F.coalesce(observed.cast("double") <= F.lit(float(threshold)), F.lit(False))
    return df.select(
        F.lit(check).alias("check"),
        subject.cast("string").alias("subject"),
        F.when(ok, "pass").otherwise("fail").alias("status"),
        F.round(observed.cast("double"), 6).alias("observed"),
        F.lit(float(threshold)).alias("threshold"),
        F.lit(severity).alias("severity"),
    )


def quality_report(df: DataFrame, suite: dict) -> DataFrame:
    """Runs the suite's checks and unions their evidence.

    Keys: not_null, range, domain, unique, leaky_names, leaky_values, purity;
    each with its arguments and an optional severity map."""
    sev = suite.get("severity", {})
    parts = []
    if "not_null" in suite:
        r = check_not_null(df, suite["not_null"])
        parts.append(evidence(r, "not_null", F.col("column"), F.col("nulls"), 0, sev.get("not_null", "error")))
    if "range" in suite:
        r = check_range(df, suite["range"])
        parts.append(evidence(r, "range", F.col("column"), F.col("out_of_range"), 0, sev.get("range", "error")))
    for c, values in suite.get("domain", {}).items():
        r = check_domain(df, c, values).agg(F.count(F.lit(1)).alias("bad"))
        parts.append(evidence(r, "domain", F.lit(c), F.col("bad"), 0, sev.get("domain", "error")))
    if "unique" in suite:
        r = check_unique(df, suite["unique"])
        parts.append(evidence(r, "unique", F.lit(",".join(suite["unique"])), F.col("extra_rows"), 0, sev.get("unique", "error")))
    if "leaky_names" in suite:
        names = df.sparkSession.createDataFrame([(c,) for c in suite["leaky_names"]], "name string")
        r = check_leaky_names(names, "name").agg(F.count(F.lit(1)).alias("bad"))
        parts.append(evidence(r, "leaky_names", F.lit("columns"), F.col("bad"), 0, sev.get("leaky_names", "error")))
    if "leaky_values" in suite:
        feats, target = suite["leaky_values"]
        r = check_leaky_values(df, feats, target)
        bad = (F.col("equals_target") | F.col("equals_inverse")).cast("int")
        parts.append(evidence(r, "leaky_values", F.col("feature"), bad, 0, sev.get("leaky_values", "error")))
    if "purity" in suite:
        cats, target = suite["purity"]
        r = check_category_purity(df, cats, target).agg(F.count(F.lit(1)).alias("bad"))
        parts.append(evidence(r, "purity", F.lit(",".join(cats)), F.col("bad"), 0, sev.get("purity", "warning")))
    return reduce(DataFrame.unionByName, parts)


def quality_gate(report: DataFrame) -> DataFrame:
    """One row: failed checks by severity and the decision."""
    bad = (F.col("status") == "fail") & (F.col("severity") == "error")
    return report.agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(F.col("status") == "fail").alias("failed"),
        F.count_if(bad).alias("failed_errors"),
        F.when(F.count_if(bad) > 0, "quality_failed").otherwise("passed").alias("gate_status"),
    )


def tag_broken(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    return df.withColumn("broken_rules", reasons(rules))


def quarantine(df: DataFrame, rules: Sequence[tuple[str, Column]], known: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their broken rules); unknown fields raise."""
    extra = sorted(set(df.columns) - set(known))
    if extra:
        raise ValueError(f"unknown fields: {extra}")
    tagged = tag_broken(df, rules)
    return tagged.where(F.size("broken_rules") == 0).drop("broken_rules"), tagged.where(F.size("broken_rules") > 0)


def inject_defects(df: DataFrame, key: str, seed: str, spec: Sequence[tuple[str, str, float, object]]) -> DataFrame:
    """Plants seeded defects; the choice depends only on seed, defect and key.

    Spec items: (kind, column, rate, argument) with kind null, flip, range,
    shift or duplicate (column and argument unused). ``defects`` lists what was
    planted in a row."""
    out, tags = df, []
    copies = None
    for i, (kind, c, rate, arg) in enumerate(spec):
        chosen = uniform(F.lit(f"{seed}|{i}|"), F.col(key)) < F.lit(float(rate))
        if kind == "duplicate":
            copies = F.when(chosen, 2).otherwise(1)
            tags.append((f"duplicate:{key}", chosen))
            continue
        v = F.col(c)
        new = {"null": lambda: F.lit(None), "flip": lambda: F.lit(1) - v, "range": lambda: F.lit(arg), "shift": lambda: v + F.lit(arg)}[kind]()
        out = out.withColumn(c, F.when(chosen, new.cast(df.schema[c].dataType)).otherwise(v))
        tags.append((f"{kind}:{c}", chosen))
    out = out.withColumn("defects", reasons(tags))
    if copies is not None:
        out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")
    return out


