"""Digests, versions, lineage, catalogue and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sievework.functions.columns import reasons, seconds
from sievework.functions.graphs import reach
from sievework.session import cut


# --- digests ----------------------------------------------------------------


def row_digest(cols: Sequence[str]) -> Column:
    """md5 of a row: every column as text, unit separator, nulls marked."""
    return F.md5(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in cols]))


def digest_columns(cols: Sequence[str]) -> list[Column]:
    """Aggregates of an order-free digest; partial aggregation keeps it one pass."""
    d = row_digest(cols)
    half = lambda at: F.conv(F.substring(d, at, 8), 16, 10).cast("decimal(38,0)")
    return [
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(half(1)), F.lit(0)).cast("string").alias("sum_a"),
        F.coalesce(F.sum(half(9)), F.lit(0)).cast("string").alias("sum_b"),
        F.coalesce(F.bit_xor(F.conv(F.substring(d, 17, 8), 16, 10).cast("bigint")), F.lit(0).cast("bigint")).alias("xor_c"),
    ]


def dataset_checksum(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Row-order-free content digest, row count and schema hash, as one row."""
    cols = list(cols or df.columns)
    schema_text = ",".join(f"{c}:{df.schema[c].dataType.simpleString()}" for c in cols)
    out = df.agg(*digest_columns(cols)).withColumn("schema_hash", F.md5(F.lit(schema_text)))
    return out.withColumn("digest", F.md5(F.concat_ws("|", "rows", "sum_a", "sum_b", F.col("xor_c").cast("string"))))


# --- curation and versions --------------------------------------------------


def curate(
    df: DataFrame, key: Sequence[str], order: Sequence[str], rename: dict[str, str], casts: dict[str, str],
    trim: Sequence[str] = (), codes: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Rename, trim, cast, code categories and keep the first row per key.

    Keep-first uses a partial minimum per key, so copies of one key never meet
    in a sort. ``order`` must be unique within a key."""
    cols = []
    for c in df.columns:
        v = F.trim(F.col(c)) if c in trim else F.col(c)
        if c in casts:
            v = v.try_cast(casts[c])
        if codes and c in codes:
            v = F.array_position(F.array(*[F.lit(x) for x in codes[c]]), v).cast("int") - 1
        cols.append(v.alias(rename.get(c, c)))
    new = [rename.get(c, c) for c in df.columns]
    src = df.select(*cols)
    keys = [rename.get(k, k) for k in key]
    at = F.struct(*[rename.get(o, o) for o in order])
    rest = [c for c in new if c not in keys]
    return src.groupBy(*keys).agg(F.min_by(F.struct(*rest), at).alias("_r")).select(*[F.col(c) if c in keys else F.col(f"_r.{c}") for c in new])


LEDGER = "name string, version bigint, path string, digest string, rows bigint, committed_at string, note string"


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except Exception as exc:  # the first commit finds no folder
        if "PATH_NOT_FOUND" in str(exc):
            return spark.createDataFrame([], LEDGER)
        raise


def _claim(spark: SparkSession, path: str) -> bool:
    """Takes a version by creating its mark; of several writers one succeeds, as
    the file system creates a file without overwriting it in one step."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(path)
    fs = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        fs.create(mark, False).close()
    except Exception as exc:
        if "already exists" in str(exc):
            return False
        raise
    return True


def commit_version(df: DataFrame, name: str, run_path: str, ledger: str, gate, committed_at: str) -> dict:
    """Writes to a run-scoped path, runs the gate on what was written, and only
    then claims the next free version and appends the ledger row. Same digest as
    current is a linked no-op."""
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(run_path)
    back = spark.read.schema(df.schema).parquet(run_path)
    status = gate(back).first()["gate_status"]
    if status != "passed":
        return {"status": status, "version": None, "path": run_path}
    d = dataset_checksum(back).first()
    known = read_ledger(spark, ledger).where(F.col("name") == name)
    current = known.orderBy(F.desc("version")).limit(1).collect()
    if current and current[0]["digest"] == d["digest"]:
        return {"status": "no_op", "version": current[0]["version"], "path": current[0]["path"]}
    version = current[0]["version"] + 1 if current else 1
    while not _claim(spark, f"{ledger}-claims/{name}/version={version}"):
        version += 1
    # Another writer may have committed the same rows meanwhile; the claim stays unused.
    newest = read_ledger(spark, ledger).where(F.col("name") == name).orderBy(F.desc("version")).limit(1).collect()
    if newest and newest[0]["digest"] == d["digest"]:
        return {"status": "no_op", "version": newest[0]["version"], "path": newest[0]["path"]}
    row = [(name, version, run_path, d["digest"], d["rows"], committed_at, "commit")]
    spark.createDataFrame(row, LEDGER).coalesce(1).write.mode("append").parquet(ledger)
    return {"status": "committed", "version": version, "path": run_path}


def resolve_as_of(ledger: DataFrame, at: Column) -> DataFrame:
    """Immutable version of each name at a time; the numeric maximum wins."""
    return (
        ledger.where(F.col("committed_at") <= at)
        .groupBy("name")
        .agg(F.max(F.col("version").cast("bigint")).alias("version"), F.max_by("path", F.col("version").cast("bigint")).alias("path"))
    )


def read_as_of(spark: SparkSession, ledger: str, name: str, version: int | None = None, at: str | None = None) -> DataFrame:
    known = read_ledger(spark, ledger).where(F.col("name") == name)
    if version is not None:
        known = known.where(F.col("version") == version)
    hit = resolve_as_of(known, F.lit(at or "9999")).first()
    if hit is None:
        raise LookupError(f"no version of {name} for version={version} at={at}")
    return spark.read.parquet(hit["path"])


def diff_rows(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, change, changed_columns) by one full outer join."""
    cols = [c for c in a.columns if c in b.columns and c not in key]
    left = a.select(*key, F.struct(*cols).alias("_a")) if cols else a.select(*key, F.lit(1).alias("_a"))
    right = b.select(*key, F.struct(*cols).alias("_b")) if cols else b.select(*key, F.lit(1).alias("_b"))
    changed = reasons([(c, ~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))) for c in cols]) if cols else F.array().cast("array<string>")
    j = left.join(right, list(key), "full_outer").withColumn("changed_columns", changed)
    change = (
        F.when(F.col("_a").isNull(), "added")
        .when(F.col("_b").isNull(), "removed")
        .when(F.size("changed_columns") > 0, "changed")
        .otherwise("same")
    )
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return j.select(*key, change.alias("change"), F.when(both, F.col("changed_columns")).otherwise(F.array().cast("array<string>")).alias("changed_columns"))


def diff_versions(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Counts of added/removed/changed/same, changes per column, schema changes."""
    rows = diff_rows(a, b, key)
    tagged = rows.select(F.explode(F.concat(F.array(F.concat(F.lit("rows_"), "change")), F.transform("changed_columns", lambda c: F.concat(F.lit("column_"), c)))).alias("item"))
    out = tagged.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    ta, tb = dict(a.dtypes), dict(b.dtypes)
    moved = [(f"schema_{'removed' if c not in tb else 'added' if c not in ta else 'type'}_{c}", 1) for c in sorted({*ta, *tb}) if ta.get(c) != tb.get(c)]
    return out.unionByName(a.sparkSession.createDataFrame(moved, "item string, n bigint")) if moved else out


def restore_check(backup: DataFrame, restored: DataFrame, key: Sequence[str], event_time: str | None = None) -> DataFrame:
    """One row: counts, digests, missing/extra/changed rows, verdict and RPO.

    RPO is the age, at the newest backup row, of the newest row that was lost."""
    cols = backup.columns
    d = diff_rows(backup, restored.select(*cols), key)
    counts = d.agg(
        *[F.count_if(F.col("change") == c).alias(n) for c, n in (("removed", "missing"), ("added", "extra"), ("changed", "changed"))],
    )
    a, b = dataset_checksum(backup), dataset_checksum(restored.select(*cols))
    out = counts.withColumns(
        {
            "backup_rows": a.select("rows").scalar(), "restored_rows": b.select("rows").scalar(),
            "backup_digest": a.select("digest").scalar(), "restored_digest": b.select("digest").scalar(),
        }
    )
    out = out.withColumn("identical", F.col("backup_digest") == F.col("restored_digest"))
    if event_time:
        lost = backup.join(d.where("change = 'removed'"), list(key), "left_semi").agg(F.max(event_time)).scalar()
        newest = backup.agg(F.max(event_time)).scalar()
        out = out.withColumn("rpo_seconds", F.when(lost.isNotNull(), seconds(newest) - seconds(lost)))
    return out


# --- manifests and lineage --------------------------------------------------


def build_manifests(runs: DataFrame, artifacts: DataFrame, params: DataFrame, metrics: DataFrame, part_rows: int = 10_000) -> DataFrame:
    """Nested run records: run_id, part, parts, name, started_at, decision,
    inputs and outputs (arrays of uri and checksum, sorted), params and metrics
    (arrays of name and value, sorted).

    runs(run_id, name, decision, started_at), artifacts(run_id, role, uri,
    checksum), params(run_id, name, value), metrics(run_id, metric, value). A run
    with more than ``part_rows`` entries becomes several numbered parts of about
    that many, each a record with the run's own fields, so no record grows with the
    run; a run without entries is one part with empty arrays."""
    entry = lambda d, kind, a, b: d.select("run_id", kind.alias("_k"), F.col(a).alias("_a"), F.col(b).cast("string").alias("_b"))
    rows = entry(artifacts, F.col("role"), "uri", "checksum").unionByName(entry(params, F.lit("param"), "name", "value")).unionByName(entry(metrics, F.lit("metric"), "metric", "value"))
    parts = rows.groupBy("run_id").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"))
    dealt = rows.join(parts, "run_id").withColumn("part", F.pmod(F.hash("_k", "_a", "_b"), F.col("parts")))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("_k") == kind, F.struct("_a", "_b"))))
    kinds = {"inputs": "input", "outputs": "output", "params": "param", "metrics": "metric"}
    made = dealt.groupBy("run_id", "part").agg(*[of(k).alias(n) for n, k in kinds.items()])
    # A run has all of its numbered parts, also one that no entry was dealt to.
    numbered = runs.join(parts, "run_id", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    numbered = numbered.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    out = numbered.join(made, ["run_id", "part"], "left")
    none = F.array().cast("array<struct<_a:string,_b:string>>")
    pair = lambda c, a, b, kind: F.transform(F.coalesce(c, none), lambda x: F.struct(x["_a"].alias(a), x["_b"].cast(kind).alias(b))).alias(c)
    return out.select(
        "run_id", "part", "parts", "name", "started_at", "decision", pair("inputs", "uri", "checksum", "string"), pair("outputs", "uri", "checksum", "string"),
        pair("params", "name", "value", "string"), pair("metrics", "name", "value", "double"),
    )


def lineage_pairs(events: DataFrame) -> DataFrame:
    """Per run: open, double terminal, duration. events(run_id, kind, at)."""
    end = F.col("kind").isin("COMPLETE", "FAIL")
    return (
        events.groupBy("run_id")
        .agg(
            F.count_if(F.col("kind") == "START").alias("starts"),
            F.count_if(F.col("kind") == "COMPLETE").alias("completes"),
            F.count_if(F.col("kind") == "FAIL").alias("fails"),
            F.min(F.when(F.col("kind") == "START", F.col("at"))).alias("_s"),
            F.max(F.when(end, F.col("at"))).alias("_e"),
        )
        .select(
            "run_id", "starts", "completes", "fails",
            ((F.col("starts") > 0) & F.col("_e").isNull()).alias("open"),
            (F.col("completes") + F.col("fails") > 1).alias("double_terminal"),
            (F.col("starts") == 0).alias("no_start"),
            F.round(seconds(F.col("_e")) - seconds(F.col("_s")), 3).alias("duration_s"),
        )
    )


def lineage_uri_mismatch(events: DataFrame, manifests: DataFrame) -> DataFrame:
    """(run_id, uri) reported by an event but not in the run's manifest."""
    return events.select("run_id", "uri").distinct().join(manifests.select("run_id", "uri"), ["run_id", "uri"], "left_anti")


def lineage_trace(edges: DataFrame, starts: DataFrame, direction: str, max_depth: int) -> DataFrame:
    """Transitive downstream or upstream assets with least depth."""
    e = edges if direction == "downstream" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(e, starts, max_depth).where("depth > 0")


def orphan_outputs(artifacts: DataFrame, runs: DataFrame, sources: DataFrame) -> DataFrame:
    """(asset, problem): outputs whose run is unknown, inputs that nothing
    produced and no source mark covers. artifacts(asset, role, run_id)."""
    outs = artifacts.where("role = 'output'")
    no_run = outs.join(runs.select("run_id"), "run_id", "left_anti").select("asset", F.lit("no_run").alias("problem"))
    ins = artifacts.where("role = 'input'").select("asset").distinct()
    no_producer = (
        ins.join(outs.select("asset"), "asset", "left_anti")
        .join(sources.select("asset"), "asset", "left_anti")
        .select("asset", F.lit("no_producer").alias("problem"))
    )
    return no_run.unionByName(no_producer)


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges left after taking away, from both sides at once, nodes that need
    nothing open and nodes that nothing open needs."""
    left, count = edges, edges.count()
    while count:
        needed, needing = left.select(F.col("needs").alias("id")), left.select(F.col("id").alias("needs"))
        left = cut(left.join(needing.distinct(), "needs", "left_semi").join(needed.distinct(), "id", "left_semi").select("id", "needs"))
        now = left.count()
        if now == count:
            break
        count = now
    return left


def _spread(marks: DataFrame, along: DataFrame, name: str) -> DataFrame:
    """marks(node, name) pushed along along(src, dst) until nothing grows: each
    node ends with the greatest mark that reaches it."""
    while True:
        pushed = marks.join(along, marks["node"] == along["src"]).select(F.col("dst").alias("node"), F.col(name).alias("_n"))
        best = pushed.groupBy("node").agg(F.max("_n").alias("_n"))
        new = cut(marks.join(best, "node", "left").select("node", F.greatest(name, "_n").alias(name), (F.coalesce(F.col("_n") > F.col(name), F.lit(False))).alias("_up")))
        marks = new.drop("_up")
        if new.where("_up").isEmpty():
            return marks


def on_cycles(edges: DataFrame) -> DataFrame:
    """(id): nodes in a strongly connected set of two or more. edges(id, needs).

    Trimming leaves cycles and ways between them. Then the greatest id that
    reaches a node is its colour; the nodes of a colour from which its own root can
    be reached are one strongly connected set. Sets found are taken away and the
    rest is trimmed and coloured again."""
    left = _trimmed(cut(edges.where("id <> needs").select("id", "needs").distinct()))
    found = left.select("id").limit(0)
    while not left.isEmpty():
        nodes = left.select(F.col("id").alias("node")).union(left.select("needs")).distinct()
        forward = left.select(F.col("id").alias("src"), F.col("needs").alias("dst"))
        colour = cut(_spread(cut(nodes.withColumn("colour", F.col("node"))), forward, "colour"))
        # Back from each root along edges inside its colour.
        a, b = colour.withColumnsRenamed({"node": "src", "colour": "_a"}), colour.withColumnsRenamed({"node": "dst", "colour": "_b"})
        inside = cut(forward.join(a, "src").join(b, "dst").where("_a = _b").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        root = cut(colour.select("node", (F.col("node") == F.col("colour")).cast("int").alias("home")))
        sets = cut(_spread(root, inside, "home").where("home = 1").join(colour, "node"))
        big = sets.groupBy("colour").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("colour")
        found = cut(found.union(sets.join(big, "colour", "left_semi").select("node")))
        done = sets.select("node")
        rest = left.join(done.withColumnRenamed("node", "id"), "id", "left_anti").join(done.withColumnRenamed("node", "needs"), "needs", "left_anti")
        left = _trimmed(cut(rest.select("id", "needs")))
    return found.distinct()


def dependency_audit(nodes: DataFrame, edges: DataFrame, id_pattern: str) -> DataFrame:
    """(rule, subject) findings. nodes(id, grp, number, route), edges(id, needs).

    A dependency on a route name is one on each of the route's members. A gap
    finding names the group and the missing number, one row for each number."""
    find = lambda d, rule, c: d.select(F.lit(rule).alias("rule"), F.col(c).cast("string").alias("subject"))
    ids = nodes.select(F.col("id").alias("needs")).distinct()
    members = nodes.where("route is not null").select("route", F.col("id").alias("member")).distinct()
    routes = members.groupBy("route").agg(F.count(F.lit(1)).alias("n"))
    whole = edges.join(ids, "needs", "left_semi").select("id", "needs").unionByName(
        edges.join(members, F.col("needs") == F.col("route")).select("id", F.col("member").alias("needs"))
    )
    tops = nodes.groupBy("grp").agg(F.max("number").alias("top")).where("top >= 1")
    every = tops.select("grp", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("top").cast("bigint"))).alias("number"))
    missing = every.join(nodes.select("grp", F.col("number").cast("bigint").alias("number")).distinct(), ["grp", "number"], "left_anti")
    out = find(nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "duplicate_id", "id")
    out = out.unionByName(find(nodes.where(~F.col("id").rlike(id_pattern)), "malformed_id", "id"))
    out = out.unionByName(find(edges.where("id = needs"), "self_dependency", "id"))
    out = out.unionByName(find(edges.join(ids.union(routes.select("route")), "needs", "left_anti"), "unknown_dependency", "id"))
    out = out.unionByName(find(routes.where("n < 2"), "small_route_group", "route"))
    out = out.unionByName(missing.select(F.lit("numbering_gap").alias("rule"), F.concat_ws("/", "grp", "number").alias("subject")))
    return out.unionByName(find(on_cycles(whole), "cycle", "id"))

def catalog_search(assets: DataFrame, quality: DataFrame, lineage: DataFrame, text: str, owner: str | None = None) -> DataFrame:
    """Assets by name part and owner with newest quality status and lineage time."""
    hit = assets.where(F.lower("name").contains(text.lower()))
    if owner is not None:
        hit = hit.where(F.col("owner") == owner)
    q = quality.groupBy("asset_id").agg(F.max_by("status", F.struct("at", "check_id")).alias("quality_status"))
    li = lineage.groupBy("asset_id").agg(F.max("at").alias("last_lineage"))
    return hit.join(q, "asset_id", "left").join(li, "asset_id", "left")


def retention_plan(assets: DataFrame, rules: dict[str, int], now: Column) -> DataFrame:
    """Eligible / held / keep per asset, as a simulation.

    assets(asset_id, class, created, legal_hold, required_current); an asset
    whose class has no rule is kept."""
    days = F.lit(None).cast("int")
    for k, n in rules.items():
        days = F.when(F.col("class") == k, F.lit(n)).otherwise(days)
    due = F.date_add(F.col("created").cast("date"), days)
    verdict = (
        F.when(F.col("legal_hold"), "held")
        .when(F.col("required_current") | due.isNull(), "keep")
        .when(due <= now, "eligible")
        .otherwise("keep")
    )
    return assets.withColumn("due", due).withColumn("verdict", verdict)


def export_inventory(resources: DataFrame, projects: DataFrame) -> DataFrame:
    """Count, bytes and digest of every owned resource kind per project; rows
    whose project is unknown are the ``unowned`` leftovers.

    resources(project, kind, resource_id, bytes)."""
    known = projects.select("project", F.lit(True).alias("_known"))
    tagged = resources.join(known, "project", "left").withColumn("owner", F.when(F.col("_known"), F.col("project").cast("string")).otherwise("unowned"))
    return tagged.groupBy("owner", "kind").agg(
        F.sum("bytes").alias("bytes"), *digest_columns(["kind", "resource_id"])
    )


def deletion_list(resources: DataFrame, approved: str) -> DataFrame:
    """Resources of the one approved project only."""
    return resources.where(F.col("project") == approved).select("kind", "resource_id")


def asset_cards(assets: DataFrame, evals: DataFrame, licences: DataFrame) -> DataFrame:
    """Card per asset; each missing part is a reason not to publish."""
    e = evals.groupBy("asset_id").agg(F.max_by("value", F.struct("at", "value")).alias("evaluation"))
    li = licences.groupBy("asset_id").agg(F.min("licence").alias("licence"))
    card = assets.join(e, "asset_id", "left").join(li, "asset_id", "left")
    why = reasons([(f"missing_{c}", F.col(c).isNull()) for c in ("owner", "licence", "evaluation", "limitations")])
    return card.withColumn("reasons", why).withColumn("publishable", F.size("reasons") == 0)


