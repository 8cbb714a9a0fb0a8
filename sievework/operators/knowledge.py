"""Index life cycle, entities, graph traversal, facts and typed queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sievework.functions.columns import h32, normal, ratio
from sievework.functions.graphs import components
from sievework.functions.links import complete_links, edit_keys
from sievework.functions.scan import number_rows, running
from sievework.operators.versions import diff_rows
from sievework.session import cut, small
from sievework.streaming.state_table import StateTable


# --- index life cycle -------------------------------------------------------


def build_index(chunks: DataFrame, vectors: DataFrame, version: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """(index rows, completeness gate). The gate passes when every chunk has
    exactly one vector of the right size and no vector is left over."""
    per = vectors.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("_n"), F.first("vector").alias("vector"), F.count_if(F.col("vector").isNull() | (F.size("vector") != dim)).alias("_bad"))
    j = chunks.select("chunk_id", F.lit(True).alias("_c")).join(per, "chunk_id", "full_outer")
    gate = j.agg(
        F.count("_c").alias("chunks"), F.count_if(F.col("_c").isNotNull() & F.col("_n").isNull()).alias("missing"), F.count_if(F.col("_n") > 1).alias("repeated"),
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad_vectors"), F.count_if(F.col("_c").isNull()).alias("strays"),
    )
    gate = gate.withColumn("gate_status", F.when(F.col("missing") + F.col("repeated") + F.col("bad_vectors") + F.col("strays") == 0, "passed").otherwise("incomplete"))
    return chunks.join(per.select("chunk_id", "vector"), "chunk_id").withColumn("index_version", F.lit(version)), gate


def alias_history(attempts: DataFrame, root: int) -> DataFrame:
    """Activations per alias: only passing candidates; of all attempts that
    expect the same active version the first wins; the beaten version stays as
    ``previous``. attempts(alias, seq, expected, passing), version = seq.

    Winners form chains; a chain counts when it leads back to the root, found
    by pointer jumping in a logarithmic number of joins."""
    won = attempts.where(F.col("passing") & (F.col("seq") > F.col("expected"))).groupBy("alias", "expected").agg(F.min("seq").alias("seq"))
    cur = cut(won.select("alias", "seq", F.col("expected").alias("up"), F.lit(1).cast("bigint").alias("steps")))
    while True:
        nxt = cur.select("alias", F.col("seq").alias("up"), F.col("up").alias("_u"), F.col("steps").alias("_s"))
        new = cut(cur.join(nxt, ["alias", "up"], "left").select("alias", "seq", F.coalesce("_u", "up").alias("up"), (F.col("steps") + F.coalesce("_s", F.lit(0))).alias("steps"), F.col("_u").isNotNull().alias("moved")))
        cur = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    live = cur.where(F.col("up") == root).select("alias", "seq", F.col("steps").alias("activation"))
    return live.join(won, ["alias", "seq"]).select("alias", "activation", F.col("seq").alias("version"), F.col("expected").alias("previous"))


def incremental_index(prev: DataFrame, changes: DataFrame, rebuilt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new index, cursor). prev and rebuilt hold (doc_id, chunk_id, ...);
    changes(doc_id, kind, sequence). Only changed documents are replaced, the
    others keep their rows; the cursor is the greatest applied sequence."""
    touched = changes.select("doc_id").distinct()
    live = changes.where("kind <> 'delete'").select("doc_id").distinct()
    index = prev.join(touched, "doc_id", "left_anti").unionByName(rebuilt.join(live, "doc_id", "left_semi"))
    return index, changes.agg(F.max("sequence").alias("cursor"))


def index_table(path: str, columns: str, share: float = 0.25) -> StateTable:
    """Stored index rows by document: the greatest sequence wins. ``columns`` are
    what a document's row holds besides doc_id, sequence and deleted."""
    schema = T.StructType.fromDDL(f"doc_id bigint, sequence bigint, deleted boolean, {columns}")
    return StateTable(path, "doc_id", [F.col("sequence"), F.col("deleted").cast("int")], schema, share=share)


def update_index(table: StateTable, changes: DataFrame, rebuilt: DataFrame, batch_id: int) -> None:
    """Writes a batch of changes(doc_id, kind, sequence) as one delta: rebuilt rows
    of changed documents, marks for deleted ones. The rest of the index is neither
    read nor written, until deltas are large enough to be folded."""
    last = changes.groupBy("doc_id").agg(F.max(F.struct("sequence", "kind")).alias("_c"))
    gone = F.col("_c.kind") == "delete"
    rows = last.join(rebuilt, "doc_id", "left").where(gone | F.col(rebuilt.columns[-1]).isNotNull())
    values = [c for c in table.schema.names if c not in ("doc_id", "sequence", "deleted")]
    table.write(rows.select("doc_id", F.col("_c.sequence").alias("sequence"), gone.alias("deleted"), *[F.when(~gone, F.col(c)).alias(c) for c in values]), batch_id)


def read_index(spark: SparkSession, table: StateTable) -> DataFrame:
    """Live rows of the stored index."""
    return table.read(spark).where("not deleted").drop("deleted", "sequence")


def index_cursor(spark: SparkSession, table: StateTable) -> int | None:
    """The greatest sequence of the open deltas and the base."""
    return table.read(spark).agg(F.max("sequence")).first()[0]


def apply_tombstones(index: DataFrame, tombs: DataFrame, deletes: DataFrame, retention_days: int) -> tuple[DataFrame, DataFrame]:
    """(readable index, tombstones). deletes(doc_id, deleted_at); a repeated
    delete keeps the first time, so applying twice changes nothing."""
    t = tombs.select("doc_id", "deleted_at").unionByName(deletes.select("doc_id", "deleted_at")).groupBy("doc_id").agg(F.min("deleted_at").alias("deleted_at"))
    t = t.withColumn("purge_after", F.date_add(F.col("deleted_at").cast("date"), retention_days))
    return index.join(t.select("doc_id"), "doc_id", "left_anti"), t


def pending_reembed(chunks: DataFrame, done: DataFrame, key: str, revision: str, batch: int, block: Column, unit_cost: Column) -> DataFrame:
    """Chunks without the new revision in numbered batches with a cost each."""
    todo = chunks.join(done.where(F.col("revision") == revision).select(key), key, "left_anti")
    n = number_rows(todo.withColumn("cost", unit_cost), [key], block, "pos")
    return n.select(key, F.floor((F.col("pos") - 1) / batch).alias("batch"), "cost")


def cache_audit(entries: DataFrame, current: DataFrame, deleted: DataFrame) -> DataFrame:
    """Status per cache entry. entries(entry_id, tenant, request, model_v,
    prompt_v, index_v, acl_v, owner_tenant, doc_id), current(tenant, model_v,
    prompt_v, index_v, acl_v)."""
    vs = ["model_v", "prompt_v", "index_v", "acl_v"]
    key = F.md5(F.concat_ws("|", F.col("tenant").cast("string"), F.trim(F.lower("request")), *[F.col(v).cast("string") for v in vs]))
    c = current.select("tenant", *[F.col(v).alias(f"_{v}") for v in vs])
    d = deleted.select("doc_id", F.lit(True).alias("_gone")).distinct()
    j = entries.withColumn("cache_key", key).join(c, "tenant", "left").join(d, "doc_id", "left")
    same = F.lit(True)
    for v in vs:
        same = same & F.col(v).eqNullSafe(F.col(f"_{v}"))
    status = F.when(F.col("owner_tenant") != F.col("tenant"), "cross_tenant").when(F.col("_gone"), "deleted_reference").when(~same, "stale").otherwise("fresh")
    return j.select("entry_id", "tenant", "cache_key", status.alias("status"))


def cache_hits(audited: DataFrame) -> DataFrame:
    """Hits and misses per status: the first use of a key is a miss."""
    first = audited.groupBy("cache_key").agg(F.min("entry_id").alias("_f"))
    j = audited.join(first, "cache_key")
    hit = (F.col("entry_id") != F.col("_f")) & (F.col("status") == "fresh")
    return j.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"))


def feedback_lineage(feedback: DataFrame, traces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(joined feedback, counts of what was not joined and why).
    feedback(feedback_id, trace_id, caller, rating, reviewer_state),
    traces(trace_id, owner, index_v, prompt_v, model_v)."""
    j = feedback.join(traces, "trace_id", "left")
    why = F.when(F.col("owner").isNull(), "missing_trace").when(F.col("owner") != F.col("caller"), "unauthorized")
    j = j.withColumn("_why", why)
    ok = j.where("_why is null").select("feedback_id", "trace_id", "rating", "reviewer_state", "index_v", "prompt_v", "model_v")
    return ok, j.groupBy(F.coalesce("_why", F.lit("joined")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def generate_workload(ids: DataFrame, key: str, seed: str, dim: int, groups: int, words: int, queries_per: int) -> DataFrame:
    """Seeded document text, unit vector, group and queries that know their
    relevant id, one row per given id; a cell depends on seed, id and column."""
    k = F.col(key).cast("string")
    vec = F.array(*[normal(F.lit(f"{seed}|v{i}|"), k) for i in range(dim)])
    d = ids.select(key, vec.alias("_v"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), lambda i: F.concat(F.lit("w"), (h32(F.lit(f"{seed}|t|"), k, F.lit("|"), i.cast("string")) % 1000).cast("string"))), " ")
    qs = F.transform(F.sequence(F.lit(0), F.lit(queries_per - 1)), lambda i: F.concat(F.lit("w"), (h32(F.lit(f"{seed}|t|"), k, F.lit("|"), (i + 1).cast("string")) % 1000).cast("string")))
    return d.select(key, text.alias("text"), F.transform("_v", lambda x: x / norm).alias("vector"), F.concat(F.lit("g"), (h32(F.lit(f"{seed}|g|"), k) % groups).cast("string")).alias("grp"), qs.alias("queries"))


# --- entities ---------------------------------------------------------------


def resolve_entities(mentions: DataFrame, max_distance: float) -> DataFrame:
    """(mention_id, entity, evidence, confidence).

    mentions(mention_id, name, block, strong_id). Equal strong ids are one
    entity, settled by equality. Names of one block within the edit distance
    (a share of the longer name, below 0.5) are linked, unless their strong ids
    differ; candidates share a piece of the name (``edit_keys``). Where weak links would chain two strong identities together, both
    stay apart and the weak names form their own low-confidence entity."""
    m = mentions.select("mention_id", "name", "block", "strong_id")
    reps = m.groupBy("name", "block", "strong_id").agg(F.min("mention_id").alias("id"))
    rep = cut(reps)
    same = cut(m.join(rep, m["name"].eqNullSafe(rep["name"]) & m["block"].eqNullSafe(rep["block"]) & m["strong_id"].eqNullSafe(rep["strong_id"])).select("mention_id", "id", m["strong_id"]))
    strong = rep.where("strong_id is not null").groupBy("strong_id").agg(F.min("id").alias("leader"))
    links = rep.join(strong, "strong_id").where("id <> leader").select("leader", F.col("id").alias("member"))

    def close(a: Column, b: Column) -> Column:
        far = F.levenshtein(a["name"], b["name"]) / F.greatest(F.length(a["name"]), F.length(b["name"]), F.lit(1))
        clash = a["strong_id"].isNotNull() & b["strong_id"].isNotNull() & (a["strong_id"] != b["strong_id"])
        return (far <= max_distance) & ~clash

    keys = rep.where("block is not null and name is not null").select("id", F.col("block").alias("_b"), F.explode(edit_keys(F.col("name"), max_distance)).alias("_k"))
    weak = complete_links(keys.select(F.concat_ws("|", "_b", "_k").alias("block"), "id"), rep.select("id", F.struct("name", "strong_id").alias("payload")), close)
    comp = components(links.unionByName(weak), "leader", "member")
    tagged = cut(same.join(comp, same["id"] == comp["node"], "left").select("mention_id", "strong_id", F.coalesce("component", "id").alias("component")))
    ids = tagged.groupBy("component").agg(F.count_distinct("strong_id").alias("_ids"))
    t = tagged.join(ids, "component")
    text = F.col("component").cast("string")
    split = F.col("_ids") > 1
    entity = F.when(split & F.col("strong_id").isNotNull(), F.concat(F.lit("s:"), F.col("strong_id"))).when(split, F.concat(F.lit("w:"), text)).otherwise(F.concat(F.lit("c:"), text))
    evidence = F.when(F.col("strong_id").isNotNull(), "strong_id").when(split, "ambiguous_name").otherwise("name")
    return t.select("mention_id", entity.alias("entity"), evidence.alias("evidence"), F.when(evidence == "strong_id", 1.0).when(evidence == "name", 0.8).otherwise(0.3).alias("confidence"))


def resolution_metrics(pred: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Pairwise precision and recall, merge and split errors, from the
    contingency table. pred(key, entity), truth(key, true_entity)."""
    cells = pred.join(truth, key).groupBy("entity", "true_entity").agg(F.count(F.lit(1)).alias("n"))
    two = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2
    tp = cells.agg(F.sum(two("n"))).scalar()
    by = lambda c, d: cells.groupBy(c).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    p = by("entity", 0).agg(F.sum(two("n")).alias("pp"), F.count_if(F.col("k") > 1).alias("merge_errors"))
    t = by("true_entity", 0).agg(F.struct(F.sum(two("n")).alias("tt"), F.count_if(F.col("k") > 1).alias("se"))).scalar()
    return p.withColumns({"_tp": tp, "_t": t}).select(
        F.round(ratio(F.col("_tp"), F.col("pp")), 6).alias("precision"), F.round(ratio(F.col("_tp"), F.col("_t.tt")), 6).alias("recall"), "merge_errors", F.col("_t.se").alias("split_errors")
    )


# --- graph and facts --------------------------------------------------------


def k_hop(edges: DataFrame, seeds: DataFrame, k: int, denied: DataFrame) -> DataFrame:
    """(seed, node, depth, path): least depth and its least path. Denied edges
    go before any expansion, so nothing is reached through them.

    edges(src, dst, grp), seeds(seed), denied(grp). Few denied groups, and a small
    front, go to the edges, so that no group or hub of edges is one task."""
    e = cut(edges.join(small(cut(denied)), "grp", "left_anti").select("src", "dst").distinct())
    seen = cut(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"), F.col("seed").cast("string").alias("path")).distinct())
    front = seen
    for hop in range(1, k + 1):
        step = e.join(small(front), F.col("node") == e["src"]).groupBy("seed", F.col("dst").alias("node")).agg(F.min(F.concat("path", F.lit(">"), "dst")).alias("path"))
        front = cut(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", F.lit(hop).alias("depth"), "path"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def graph_diff(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Counts of added, removed, changed and same edges (or nodes)."""
    return diff_rows(a, b, key).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def facts_as_of(facts: DataFrame, valid_at: Column, observed_at: Column) -> DataFrame:
    """Facts known by ``observed_at`` that hold at ``valid_at``; per subject and
    predicate the latest observation wins, and a null valid_to is open.

    facts(subject, predicate, value, valid_from, valid_to, observed, fact_id)."""
    f = facts.where((F.col("observed") <= observed_at) & (F.col("valid_from") <= valid_at) & (F.col("valid_to").isNull() | (F.col("valid_to") > valid_at)))
    return f.groupBy("subject", "predicate").agg(F.max_by(F.struct("value", "fact_id", "observed"), F.struct("observed", "fact_id")).alias("_f")).select("subject", "predicate", "_f.*")


def conflict_segments(facts: DataFrame) -> DataFrame:
    """(subject, predicate, seg_from, seg_to, values): time where two or more
    values hold at once. One sweep over the ends of each value's intervals says
    when it begins and ceases to hold, one over those changes how many values do;
    no pair of facts is built."""
    keys = ["subject", "predicate", "value"]
    num = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date")).cast("bigint")
    two = F.array(F.struct(num("valid_from").alias("t"), F.lit(1).alias("d")), F.struct(num("valid_to").alias("t"), F.lit(-1).alias("d")))
    ends = facts.where("valid_to > valid_from").select(*keys, F.inline(two)).groupBy(*keys, "t").agg(F.sum("d").alias("d")).where("d <> 0")
    held = running(cut(ends), keys, ["t"], F.floor(F.col("t") / 64), n=("sum", F.col("d")))
    # A value begins to hold where its count leaves 0, and ceases where it returns.
    change = F.when(F.col("n") == F.col("d"), 1).when(F.col("n") == 0, -1)
    pts = held.withColumn("_c", change).where("_c is not null").groupBy("subject", "predicate", "t").agg(F.sum("_c").alias("d"))
    act = cut(running(cut(pts), ["subject", "predicate"], ["t"], F.floor(F.col("t") / 64), active=("sum", F.col("d"))))
    nxt = running(act.withColumn("_n", -F.col("t")), ["subject", "predicate"], ["_n"], F.floor(F.col("_n") / 64), inclusive=False, _p=("max", F.col("_n")))
    to = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), c.cast("int"))
    return nxt.where("active >= 2").select("subject", "predicate", to(F.col("t")).alias("seg_from"), to(-F.col("_p")).alias("seg_to"), F.col("active").alias("values"))


def fact_conflicts(facts: DataFrame) -> DataFrame:
    """Facts that overlap a different value of their subject and predicate,
    side by side with their own interval and the first time of conflict."""
    seg = cut(conflict_segments(facts))
    num = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date")).cast("bigint")
    keys = ["subject", "predicate"]
    f = facts.where("valid_to > valid_from").select(*keys, (-num("valid_from")).alias("k"), F.lit(1).alias("side"), F.col("fact_id"), F.lit(None).cast("bigint").alias("s"))
    # the first segment ending after the fact starts: scan segment ends from late to early
    s = seg.select(*keys, (-num("seg_to")).alias("k"), F.lit(0).alias("side"), F.lit(-1).cast("bigint").alias("fact_id"), (-num("seg_from")).alias("s"))
    both = cut(f.unionByName(s).withColumn("k2", F.when(F.col("side") == 0, F.col("k")).otherwise(F.col("k") - 1)))
    first = running(both, keys, ["k2", "side", "fact_id"], F.floor(F.col("k2") / 64), seg_start=("max", F.col("s")))
    first = first.where("side = 1").select("fact_id", (-F.col("seg_start")).alias("_s"))
    j = facts.join(first, "fact_id").where(F.col("_s").isNotNull() & (F.col("_s") < num("valid_to")))
    start = F.greatest(F.date_add(F.lit("1970-01-01").cast("date"), F.col("_s").cast("int")), F.col("valid_from"))
    return j.select(*keys, "fact_id", "value", "valid_from", "valid_to", start.alias("conflict_from"))


# --- typed queries ----------------------------------------------------------

_OPS = {"=": lambda c, v: c == v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "in": lambda c, v: c.isin(*v)}
_AGGS = {"count": lambda c: F.count(F.lit(1)), "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def structured_query(tables: dict[str, tuple[DataFrame, Sequence[str]]], spec: dict, max_rows: int) -> DataFrame:
    """Runs a typed spec: table, where [(column, op, value)], group [columns],
    measures {name: (agg, column)}, order, limit. Anything outside the
    allowlist is refused; there is no text and no way to write."""
    extra = set(spec) - {"table", "where", "group", "measures", "order", "limit"}
    if extra:
        raise PermissionError(f"unknown parts: {sorted(extra)}")
    if spec["table"] not in tables:
        raise PermissionError(f"unknown table: {spec['table']}")
    df, allowed = tables[spec["table"]]

    def col(name: str) -> Column:
        if name not in allowed:
            raise PermissionError(f"unknown column: {name}")
        return F.col(name)

    for c, op, v in spec.get("where", []):
        if op not in _OPS:
            raise PermissionError(f"unknown operation: {op}")
        df = df.where(_OPS[op](col(c), v))
    group = [col(g) for g in spec.get("group", [])]
    measures = []
    for name, (agg, c) in spec.get("measures", {}).items():
        if agg not in _AGGS:
            raise PermissionError(f"unknown measure: {agg}")
        measures.append(_AGGS[agg](col(c) if c is not None else None).alias(name))
    out = df.groupBy(*group).agg(*measures) if measures else df.select(*group)
    limit = int(spec.get("limit", max_rows))
    if limit > max_rows:
        raise PermissionError(f"limit over {max_rows}")
    order = spec.get("order", out.columns)
    if set(order) - set(out.columns):
        raise PermissionError("order names a column outside the result")
    return out.orderBy(*order).limit(limit)


