"""Contract and policy predicates over record tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sievework.functions.columns import let, reasons


# --- schema contracts -------------------------------------------------------


def schema_violations(df: DataFrame, contract: Sequence[dict[str, Any]], closed: bool = True) -> DataFrame:
    """Rows (field, rule, observed, n) for every breach of the contract.

    Contract items: name, type, nullable, optional values (closed category set).
    Type rules come from the plan's schema; null and category rules share one
    aggregate pass that reads only the columns concerned.
    """
    spark = df.sparkSession
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    fixed: list[tuple[str, str, str, int]] = []
    probes: list[tuple[str, str, Column]] = []
    for item in contract:
        name, want = item["name"], item["type"]
        if name not in have:
            fixed.append((name, "missing", None, 1))
            continue
        if have[name] != want:
            zone = {have[name], want} == {"timestamp", "timestamp_ntz"}
            fixed.append((name, "timestamp_zone" if zone else "type", have[name], 1))
        if not item.get("nullable", True):
            probes.append((name, "null", F.count_if(F.col(name).isNull())))
        if item.get("values") is not None:
            probes.append((name, "category", F.count_if(~F.col(name).isin(*item["values"]))))
    if closed:
        names = {i["name"] for i in contract}
        fixed += [(n, "extra", t, 1) for n, t in have.items() if n not in names]
    out = spark.createDataFrame(fixed, "field string, rule string, observed string, n bigint")
    if probes:
        one = df.agg(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(r).alias("rule"), c.alias("n")) for f, r, c in probes]).alias("p"))
        found = one.select(F.inline("p")).where("n > 0").select("field", "rule", F.lit(None).cast("string").alias("observed"), "n")
        out = out.unionByName(found)
    return out


def require_schema(df: DataFrame, contract: Sequence[dict[str, Any]]) -> DataFrame:
    """Raises before any output when the contract is broken."""
    broken = schema_violations(df, contract).limit(20).collect()
    if broken:
        raise ValueError("schema contract broken: " + "; ".join(f"{r.field}: {r.rule}" for r in broken))
    return df


def fields_of(df: DataFrame) -> DataFrame:
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "name string, type string, nullable boolean")


def observed_fields(df: DataFrame, text: str) -> DataFrame:
    """Field list (name, type, nullable) seen in a column of JSON objects."""
    entry = F.explode(F.map_entries(F.from_json(F.col(text), "map<string,string>"))).alias("e")
    kinds = (
        F.when(F.col("e.value").rlike(r"^-?\d+$"), 1)
        .when(F.col("e.value").rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"), 2)
        .when(F.col("e.value").isNotNull(), 3)
    )
    total = df.agg(F.count(F.lit(1))).scalar()
    return (
        df.select(entry)
        .groupBy(F.col("e.key").alias("name"))
        .agg(F.max(kinds).alias("k"), F.count("e.value").alias("n"))
        .select(
            "name",
            F.when(F.col("k") == 1, "bigint").when(F.col("k") == 2, "double").otherwise("string").alias("type"),
            (F.col("n") < total).alias("nullable"),
        )
    )


# fixed values: widening pairs that keep every value
WIDENINGS = (
    ("tinyint", "smallint"), ("tinyint", "int"), ("tinyint", "bigint"), ("smallint", "int"), ("smallint", "bigint"),
    ("int", "bigint"), ("int", "double"), ("bigint", "double"), ("float", "double"), ("date", "timestamp"),
)


def schema_evolution(old: DataFrame, new: DataFrame) -> DataFrame:
    """Verdict per field: added/removed/widened/narrowed/nullability, compatible or breaking."""
    a = old.select("name", F.col("type").alias("old_type"), F.col("nullable").alias("old_nullable"))
    b = new.select("name", F.col("type").alias("new_type"), F.col("nullable").alias("new_nullable"))
    wide = F.lit(False)
    for x, y in WIDENINGS:
        wide = wide | ((F.col("old_type") == x) & (F.col("new_type") == y))
    change = (
        F.when(F.col("old_type").isNull(), F.when(F.col("new_nullable"), "added_nullable").otherwise("added_required"))
        .when(F.col("new_type").isNull(), "removed")
        .when((F.col("old_type") != F.col("new_type")) & ~wide, "narrowed")
        .when(F.col("old_nullable") & ~F.col("new_nullable"), "made_required")
        .when(F.col("old_type") != F.col("new_type"), "widened")
        .when(~F.col("old_nullable") & F.col("new_nullable"), "made_nullable")
        .otherwise("same")
    )
    breaking = ("added_required", "removed", "narrowed", "made_required")
    return (
        a.join(b, "name", "full_outer")
        .withColumn("change", change)
        .select("name", "change", F.when(F.col("change").isin(*breaking), "breaking").otherwise("compatible").alias("verdict"))
    )


def file_layout_audit(df: DataFrame, floor_bytes: int) -> DataFrame:
    """Per file: rows, bytes, under-floor flag, partition directories that break naming.

    Only the hidden file metadata is read, no data column."""
    f = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
    dirs = F.filter(F.split("path", "/"), lambda p: p.contains("="))
    bad = F.filter(dirs, lambda p: ~p.rlike("^[a-z][a-z0-9_]*=[A-Za-z0-9_.:%-]+$"))
    return (
        f.groupBy("path", "bytes")
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("small", F.col("bytes") < floor_bytes)
        .withColumn("bad_partitions", bad)
    )


# --- JSON-Schema rules over variant columns ---------------------------------

_ROW = "array<struct<path:string,message:string>>"


def _hit(cond: Column, path: Column, message: Column | str) -> Column:
    msg = F.lit(message) if isinstance(message, str) else message
    one = F.array(F.struct(path.alias("path"), msg.alias("message")))
    return F.when(F.coalesce(cond, F.lit(False)), one).otherwise(F.array().cast(_ROW))


# Head word of a variant's type text -> the schema types it satisfies.
_HEADS = {
    "BIGINT": "integer number", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number", "STRING": "string",
    "BOOLEAN": "boolean", "VOID": "null", "OBJECT": "object", "ARRAY": "array",
}


def _is_type(head: Column, kind: str) -> Column:
    return head.isin(*[h for h, kinds in _HEADS.items() if kind in kinds.split()])


def flat_schema(schema: dict) -> dict:
    """The schema with every local reference replaced by what it names, so that
    the walk below never looks one up. A reference to itself is an error."""

    def flat(node: Any, open_refs: tuple[str, ...]) -> Any:
        if isinstance(node, list):
            return [flat(x, open_refs) for x in node]
        if not isinstance(node, dict):
            return node
        ref = node.get("$ref")
        if ref is None:
            return {k: flat(x, open_refs) for k, x in node.items()}
        if ref in open_refs or ref not in names:
            raise ValueError(f"schema reference is circular or not local: {ref}")
        return flat(names[ref], (*open_refs, ref))

    names: dict[str, Any] = {}

    def index(node: Any, at: str) -> None:
        names[at] = node
        for k, x in node.items() if isinstance(node, dict) else ():
            index(x, f"{at}/{k}")

    index(schema, "#")
    return flat(schema, ())


def _rules(v: Column, node: dict, path: Column) -> Column:
    """Violations of one node as an array column. The schema is walked once on
    the driver; data only meets built-in expressions. A node's value and type
    are worked out once and bound for its checks."""
    bound = F.struct(v.alias("v"), F.regexp_substr(F.schema_of_variant(v), F.lit("^[A-Z]+")).alias("t"))
    return let(bound, lambda s: _node_rules(s["v"], s["t"], node, path))


def _node_rules(v: Column, t: Column, node: dict, path: Column) -> Column:
    # fixed values: the violation messages below
    checks: list[Column] = []
    kinds = node.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if "enum" in node:
        texts = [str(x) for x in node["enum"] if isinstance(x, str)]
        inside = _is_type(t, "string") & F.try_variant_get(v, "$", "string").isin(*texts) if texts else F.lit(False)
        numbers = [x for x in node["enum"] if isinstance(x, (int, float)) and not isinstance(x, bool)]
        if numbers:
            inside = inside | (_is_type(t, "number") & F.try_variant_get(v, "$", "double").isin(*[float(x) for x in numbers]))
        if any(x is None for x in node["enum"]):
            inside = inside | _is_type(t, "null")
        for flag in (True, False):
            if any(x is flag for x in node["enum"]):
                inside = inside | (_is_type(t, "boolean") & (F.try_variant_get(v, "$", "boolean") == flag))
        checks.append(_hit(~inside, path, "not in enum"))
    text = F.when(_is_type(t, "string"), F.try_variant_get(v, "$", "string"))
    if "minLength" in node:
        checks.append(_hit(F.length(text) < node["minLength"], path, f"shorter than {node['minLength']}"))
    if "maxLength" in node:
        checks.append(_hit(F.length(text) > node["maxLength"], path, f"longer than {node['maxLength']}"))
    if "pattern" in node:
        checks.append(_hit(~text.rlike(node["pattern"]), path, "does not match pattern"))
    if "minItems" in node or "items" in node:
        items = F.when(_is_type(t, "array"), F.try_variant_get(v, "$", "array<variant>"))
        if "minItems" in node:
            checks.append(_hit(F.size(items) < node["minItems"], path, f"fewer than {node['minItems']} items"))
        if node.get("items"):
            inner = F.flatten(
                F.transform(
                    items,
                    lambda x, i: _rules(x, node["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))),
                )
            )
            checks.append(F.coalesce(inner, F.array().cast(_ROW)))
    props = node.get("properties", {})
    extra = node.get("additionalProperties")
    if props or node.get("required") or extra is not None:
        is_obj = _is_type(t, "object")
        member = {k: F.try_variant_get(v, f"$['{k}']", "variant") for k in {*props, *node.get("required", [])}}
        for k in node.get("required", []):
            checks.append(_hit(is_obj & member[k].isNull(), path, f"missing required field {k}"))
        if extra is False or isinstance(extra, dict):
            fields = F.when(is_obj, F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")))
            others = F.filter(fields, lambda e: ~e["key"].isin(*props)) if props else fields
            if extra is False:
                rows = F.transform(
                    F.array_sort(F.transform(others, lambda e: e["key"])),
                    lambda k: F.struct(path.alias("path"), F.concat(F.lit("unexpected field "), k).alias("message")),
                )
            else:
                rows = F.flatten(
                    F.transform(others, lambda e: _rules(e["value"], extra, F.concat(path, F.lit("."), e["key"])))
                )
            checks.append(F.coalesce(rows, F.array().cast(_ROW)))
        for k, sub in props.items():
            inner = _rules(member[k], sub, F.concat(path, F.lit(f".{k}")))
            checks.append(F.when(is_obj & member[k].isNotNull(), inner).otherwise(F.array().cast(_ROW)))
    deep = F.concat(*checks) if checks else F.array().cast(_ROW)
    if not kinds:
        return deep
    typed = F.lit(False)
    for k in kinds:
        typed = typed | _is_type(t, k)
    shown = kinds[0] if len(kinds) == 1 else str(kinds)
    return F.when(typed, deep).otherwise(F.array(F.struct(path.alias("path"), F.lit(f"expected {shown}").alias("message"))))


def record_violations(df: DataFrame, key: str, text: str, schema: dict) -> DataFrame:
    """Rows (key, path, message) for each broken JSON-Schema rule; text that is
    not JSON gives one row with the message ``not json``."""
    v = df.select(key, F.try_parse_json(text).alias("_v"), F.col(text).alias("_t"))
    found = _rules(F.col("_v"), flat_schema(schema), F.lit("$"))
    bad = F.array(F.struct(F.lit("$").alias("path"), F.lit("not json").alias("message")))
    rows = F.when(F.col("_v").isNull(), bad).otherwise(found)
    return v.select(key, F.inline(rows))


def conditional_required(df: DataFrame, key: str, rules: Sequence[tuple[str, Any, str]]) -> DataFrame:
    """Rows (key, rule) where field = constant but the section is absent."""
    checks = reasons([(f"{f}={c} needs {s}", (F.col(f) == c) & F.col(s).isNull()) for f, c, s in rules])
    return df.select(key, F.explode(checks).alias("rule"))


# --- naming, versions, licences ---------------------------------------------

# fixed values: terms a name must not contain, and the name patterns
FORBIDDEN_TERMS = ("password", "passwd", "secret", "token", "credential", "apikey", "api-key", "email", "user")
NAME_PATTERNS = {
    "slug": r"^[a-z0-9]([-a-z0-9]*[a-z0-9])?$",
    "dataset_version": r"^v\d{4}$",
    "semver": r"^\d+\.\d+\.\d+$",
    "run_id": r"^run-\d{8}t\d{6}z-[0-9a-f]{8}$",
    "object_prefix": r"^[a-z0-9][a-z0-9/_=.-]*/$",
}
REQUIRED_LABELS = ("name", "part-of", "phase", "component", "environment", "owner")


def naming_audit(df: DataFrame, key: str, kinds: dict[str, str], labels: str | None = None) -> DataFrame:
    """Rows (key, column, rule) for every broken naming rule.

    ``kinds`` maps a column to slug, dataset_version, semver, run_id or
    object_prefix; ``labels`` names a map column with the six required labels.
    """
    terms = "|".join(FORBIDDEN_TERMS)
    rules: list[tuple[str, str, Column]] = []
    for c, kind in kinds.items():
        v = F.col(c)
        rules.append((c, "pattern", ~v.rlike(NAME_PATTERNS[kind])))
        if kind in ("slug", "object_prefix"):
            top = 63 if kind == "slug" else 256
            rules += [(c, "length", ~F.length(v).between(3, top)), (c, "forbidden_term", v.rlike(terms))]
        if kind == "object_prefix":
            rules += [
                (c, "leading_slash", v.startswith("/")),
                (c, "double_slash", v.contains("//")),
                (c, "parent_step", v.contains("..")),
            ]
    cases = [F.when(F.coalesce(cond, F.lit(True)), F.struct(F.lit(c).alias("column"), F.lit(r).alias("rule"))) for c, r, cond in rules]
    broken = F.filter(F.array(*cases), lambda x: x.isNotNull()) if cases else F.array().cast("array<struct<column:string,rule:string>>")
    if labels:
        lost = F.array_except(F.array(*[F.lit(x) for x in REQUIRED_LABELS]), F.map_keys(labels))
        broken = F.concat(
            broken, F.transform(lost, lambda x: F.struct(F.lit(labels).alias("column"), F.concat(F.lit("missing_label:"), x).alias("rule")))
        )
    return df.select(key, F.inline(broken))


# fixed values: licence classes by asset type
ACCEPTED = {
    "software": ("Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD"),
    "documentation": ("CC-BY-4.0", "CC0-1.0", "Apache-2.0", "MIT"),
    "dataset": ("CC0-1.0", "CC-BY-4.0", "ODC-BY-1.0", "PDDL-1.0"),
    "model-weights": ("Apache-2.0", "MIT"),
}
REVIEW = (
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "AGPL-3.0-only",
    "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "EPL-2.0", "CDDL-1.0",
    "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-ND-4.0",
)
CLOSED_CLASSES = ("source-available", "restricted", "unknown")
UNUSABLE_EXPRESSIONS = ("latest", "unknown", "n/a")


def license_class(asset_type: Column, expression: Column) -> Column:
    """accepted / review-required / rejected by asset type and SPDX expression."""
    ok = F.lit(False)
    for kind, names in ACCEPTED.items():
        ok = ok | ((asset_type == kind) & expression.isin(*names))
    anywhere = sorted({n for names in ACCEPTED.values() for n in names})
    review = expression.isin(*REVIEW) | expression.isin(*anywhere)
    return F.when(F.coalesce(ok, F.lit(False)), "accepted").when(F.coalesce(review, F.lit(False)), "review-required").otherwise("rejected")


def license_audit(records: DataFrame) -> DataFrame:
    """Adds the default class and an array of policy errors.

    Columns: record_type, expression, classification, review_status, and for
    model weights remote_code (boolean)."""
    rules = [
        ("closed_class_accepted", F.col("classification").isin(*CLOSED_CLASSES) & (F.col("review_status") == "accepted")),
        ("unusable_expression", F.lower("expression").isin(*UNUSABLE_EXPRESSIONS)),
        ("model_without_licence", (F.col("record_type") == "model-weights") & F.col("expression").isNull()),
        ("model_remote_code", (F.col("record_type") == "model-weights") & F.col("remote_code")),
    ]
    return records.withColumn("default_class", license_class(F.col("record_type"), F.col("expression"))).withColumn(
        "errors", reasons(rules)
    )


# fixed values: review severity, strictest last
SEVERITY = ("accepted", "review-required", "rejected")


def inherited_licenses(adapters: DataFrame, models: DataFrame, datasets: DataFrame) -> DataFrame:
    """Obligations of each adapter: base-model and training-dataset licences,
    the strictest status, and whether the base is pinned to an exact revision.

    adapters(adapter_id, base_model, base_revision, datasets array),
    models(model, revision, licence, status), datasets(dataset, licence, status).
    """
    base = adapters.join(models, (F.col("base_model") == F.col("model")) & (F.col("base_revision") == F.col("revision")), "left").select(
        "adapter_id", F.col("licence"), F.coalesce("status", F.lit("rejected")).alias("status"), F.col("revision").isNotNull().alias("pinned")
    )
    data = (
        adapters.select("adapter_id", F.explode("datasets").alias("dataset"))
        .join(datasets, "dataset", "left")
        .select("adapter_id", "licence", F.coalesce("status", F.lit("rejected")).alias("status"), F.lit(None).cast("boolean").alias("pinned"))
    )
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("status"))
    return (
        base.unionByName(data)
        .groupBy("adapter_id")
        .agg(
            F.array_sort(F.collect_set("licence")).alias("licences"),
            F.max_by("status", rank).alias("status"),
            F.coalesce(F.bool_or("pinned"), F.lit(False)).alias("base_pinned"),
        )
    )


# fixed values: shape of a digest; ends of versions that move
DIGEST = r"^sha256:[0-9a-f]{64}$"
MOVING_ENDS = (".x", "-snapshot")
_DIGITS = "0123456789"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def floating(version: Column) -> Column:
    """A version is pinned when two or three numbers joined by dots stand before
    the first dash or plus, what follows it is made of letters, digits, dots and
    dashes and begins with a letter or digit, and the whole does not end in a
    moving token. A leading v is left out; anything else floats."""
    only = lambda c, allowed: F.translate(F.lower(c), allowed, "") == ""

    def judge(text: Column) -> Column:
        parts = F.split(F.when(text.startswith("v"), F.substr(text, F.lit(2))).otherwise(text), "[-+]", 2)
        numbers, label = F.split(parts[0], "[.]"), F.get(parts, F.lit(1))
        numbered = F.size(numbers).between(2, 3) & F.forall(numbers, lambda n: (n != "") & only(n, _DIGITS))
        start = F.substring(label, 1, 1)
        labelled = label.isNull() | ((start != "") & only(start, _DIGITS + _LETTERS) & only(label, _DIGITS + _LETTERS + ".-"))
        moving = F.lower(text).endswith(MOVING_ENDS[0]) | F.lower(text).endswith(MOVING_ENDS[1])
        return ~(numbered & labelled) | moving

    return let(F.trim(version), judge)


def pinned_version_audit(components: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    """Rows (name, error) for unpinned or untraceable components.

    components(name, kind, version, source_url, repository, tag, digest,
    reference, os, architecture); the last six are an image's."""
    image = F.col("kind") == "image"
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = [
        ("version_missing", F.col("version").isNull() | (F.trim("version") == "")),
        ("version_floating", (F.trim("version") != "") & floating(F.col("version"))),
        ("source_not_https", ~F.coalesce(F.col("source_url"), F.lit("")).startswith("https://")),
        *[(f"{c}_missing", image & blank(c)) for c in ("repository", "tag", "digest", "reference", "os", "architecture")],
        ("tag_floating", image & ~blank("tag") & floating(F.col("tag"))),
        ("digest_malformed", image & ~blank("digest") & ~F.col("digest").rlike(DIGEST)),
        ("reference_without_digest", image & ~blank("digest") & ~blank("reference") & ~F.col("reference").contains(F.col("digest"))),
    ]
    out = components.select("name", F.explode(reasons(rules)).alias("error"))
    if required:
        want = components.sparkSession.createDataFrame([(r,) for r in required], "name string")
        out = out.unionByName(want.join(components, "name", "left_anti").withColumn("error", F.lit("component_missing")))
    return out


def redact_values(df: DataFrame, cols: Sequence[str], secrets: Sequence[str], last_lines: int | None = None) -> DataFrame:
    """Replaces known secrets, longest first, and may keep only the last lines.

    The secret list is configuration, so it becomes part of the expression."""
    out = df
    for c in cols:
        v = F.col(c)
        if last_lines is not None:
            v = F.array_join(F.slice(F.split(v, "\n"), -F.least(F.lit(last_lines), F.size(F.split(v, "\n"))), last_lines), "\n")
        for s in sorted({s for s in secrets if s}, key=lambda s: (-len(s), s)):
            v = F.replace(v, F.lit(s), F.lit("<redacted>"))
        out = out.withColumn(c, v)
    return out


def class_prefix_coverage(assets: DataFrame, path: str, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Data class and owner of each asset by prefix rules (prefix, class, owner).

    Rules are configuration, so the theta join becomes one expression per rule."""
    hits = F.filter(
        F.array(*[F.when(F.col(path).startswith(p), F.struct(F.lit(k).alias("data_class"), F.lit(o).alias("owner"))) for p, k, o in rules]),
        lambda x: x.isNotNull(),
    )
    n = F.size("_hits")
    return (
        assets.withColumn("_hits", hits)
        .withColumn("matches", n)
        .withColumn("status", F.when(n == 0, "unmatched").when(n > 1, "ambiguous").otherwise("owned"))
        .withColumn("data_class", F.when(n == 1, F.get("_hits", F.lit(0))["data_class"]))
        .withColumn("owner", F.when(n == 1, F.get("_hits", F.lit(0))["owner"]))
        .drop("_hits")
    )


def findings_gate(findings: DataFrame, exceptions: DataFrame, now: Column, limit: int, forbidden: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(verdict per asset, expired exceptions).

    findings(asset, finding_id, kind, severity), exceptions(finding_id, owner, expires).
    Unfixed findings stay counted even when excepted."""
    live = exceptions.where(F.col("owner").isNotNull() & (F.col("expires") > now)).select("finding_id", F.lit(True).alias("excepted")).distinct()
    bad = F.col("kind").isin(*forbidden) | (F.col("severity") >= limit)
    per = findings.join(live, "finding_id", "left").withColumn("blocks", bad & F.col("excepted").isNull())
    verdict = per.groupBy("asset").agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_if("excepted").alias("excepted"),
        F.count_if("blocks").alias("blocking"),
        F.when(F.bool_or("blocks"), "deny").otherwise("allow").alias("decision"),
    )
    return verdict, exceptions.where(F.col("expires") <= now)


def records_frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Configuration rows as a frame."""
    return spark.createDataFrame(list(rows), schema)
