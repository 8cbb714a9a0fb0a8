"""Text corpora: cleaning, redaction, chunks, copies, contamination, shards."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from sievework.functions.columns import h32, let, ratio, reasons, words
from sievework.functions.graphs import components
from sievework.functions.links import complete_links, rare_blocks, rows_among
from sievework.functions.scan import previous, running
from sievework.functions.shingles import shingle_sets
from sievework.operators.versions import digest_columns
from sievework.session import cut


@pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x if x.isascii() else unicodedata.normalize("NFKC", x))


def squeeze(c: Column) -> Column:
    """Lower case with whitespace runs as one space."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def normalize_text(df: DataFrame, text: str) -> DataFrame:
    """Adds the normalized text and the offset of its first kept character; the
    original stays."""
    base = F.length(text) - F.length(F.regexp_replace(text, r"^\s+", ""))
    return df.withColumn("normalized", squeeze(nfkc(F.col(text)))).withColumn("offset_base", base)


# fixed values: detectors in the order they apply
PII_PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "SECRET": r'token = "[0-9a-f]{16,}"',
    "CARD": r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b",
    "IPV4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "PHONE": r"\b1 \(\d{3}\) \d{3}-\d{4}",
}


def luhn(c: Column) -> Column:
    """Check digit of a digit string, read from the right."""
    d = F.reverse(F.split(F.regexp_replace(c, r"\D", ""), ""))
    d = F.filter(d, lambda x: x != "")
    total = F.aggregate(
        F.transform(d, lambda x, i: F.when(i % 2 == 1, F.pmod(x.cast("int") * 2, F.lit(9)) + F.when(x == "9", 9).otherwise(0)).otherwise(x.cast("int"))), F.lit(0), lambda a, x: a + x
    )
    return (total % 10 == 0) & (F.size(d) > 0)


def _is_hit(name: str, allow: Sequence[str]):
    """Predicate on one match: not allowed, and a valid card number if a card."""

    def check(m: Column) -> Column:
        free = ~m.isin(*allow) if allow else F.lit(True)
        return free & luhn(m) if name == "CARD" else free

    return check


def _redact_step(name: str, allow: Sequence[str]):
    """One detector over struct(t: text, a: audit); texts without a hit pass."""
    pat, bad = PII_PATTERNS[name], _is_hit(name, allow)

    def weave(s: Column, hits: Column) -> Column:
        shown = F.transform(hits, lambda m: F.when(bad(m), f"<{name}>").otherwise(m))
        woven = F.array_join(F.flatten(F.zip_with(F.split(s["t"], pat, -1), shown, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
        n = F.size(F.filter(hits, bad))
        count = F.filter(F.array(F.struct(F.lit(name).alias("type"), n.alias("n"))), lambda x: x["n"] > 0)
        return F.struct(woven.alias("t"), F.concat(s["a"], count).alias("a"))

    def step(s: Column) -> Column:
        found = F.regexp_extract_all(s["t"], F.lit(f"({pat})"), F.lit(1))
        return let(found, lambda hits: F.when(F.size(hits) > 0, weave(s, hits)).otherwise(s))

    return step


def redact_pii(df: DataFrame, key: str, text: str, detectors: Sequence[str] | None = None, allow: Sequence[str] = ()) -> DataFrame:
    """Replaces hits by typed placeholders and counts them per type; allowed
    values and card numbers with a wrong check digit stay. No hit text leaves."""
    state = F.struct(F.col(text).alias("t"), F.array().cast("array<struct<type:string,n:int>>").alias("a"))
    for n in detectors or PII_PATTERNS:
        state = let(state, _redact_step(n, allow))
    out = df.withColumn("_s", state)
    return out.withColumn(text, F.col("_s.t")).withColumn("audit", F.col("_s.a")).drop("_s")


def chunk(df: DataFrame, key: str, text: str, version: str, max_tokens: int, overlap: int) -> DataFrame:
    """Windows of at most ``max_tokens`` tokens inside each paragraph.

    A token is a piece between single spaces, so ``substring(text, start + 1,
    length)`` gives a chunk back exactly. Offsets come from running lengths
    inside the row; nothing is shuffled."""
    stride = max_tokens - overlap
    if stride <= 0:
        raise ValueError("overlap must be smaller than the window")
    config = f"{max_tokens}/{overlap}"
    grow = lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))
    starts = lambda lens: F.aggregate(lens, F.array(F.lit(0)), grow)
    src = df.select(key, F.split(F.col(text), "\n", -1).alias("_paras"))
    src = src.select(key, F.posexplode(F.arrays_zip(F.col("_paras").alias("p"), F.slice(starts(F.transform("_paras", lambda p: F.length(p) + 1)), 1, F.size("_paras")).alias("s"))).alias("_no", "_z"))
    src = src.where(F.trim("_z.p") != "").select(key, F.col("_no").alias("paragraph"), F.col("_z.s").alias("_s"), F.split("_z.p", " ", -1).alias("_w"))
    n = F.greatest(F.lit(1), F.ceil((F.size("_w") - overlap) / F.lit(stride))).cast("int")
    src = src.withColumn("_n", n)
    lens = F.transform(F.sequence(F.lit(1), F.col("_n")), lambda i: F.length(F.array_join(F.slice("_w", (i - 1) * stride + 1, stride), " ")) + 1)
    wins = F.transform(F.sequence(F.lit(1), F.col("_n")), lambda i: F.struct(F.slice("_w", (i - 1) * stride + 1, max_tokens).alias("t"), F.element_at("_at", i).alias("o")))
    src = src.withColumn("_at", starts(lens)).select(key, "paragraph", "_s", F.explode(wins).alias("_c"))
    body = F.array_join("_c.t", " ")
    start = F.col("_s") + F.col("_c.o")
    cid = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(version), start.cast("string"), F.lit(config)))
    return src.select(key, "paragraph", cid.alias("chunk_id"), start.alias("start"), F.length(body).alias("length"), F.size("_c.t").alias("tokens"), body.alias("text"))


def dedup_exact(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(kept keys with copy counts, map of every row to its kept key)."""
    h = df.select(key, F.md5(squeeze(F.col(text))).alias("content_hash"))
    groups = h.groupBy("content_hash").agg(F.min(key).alias("canonical"), F.count(F.lit(1)).alias("copies"))
    return groups, h.join(groups.select("content_hash", "canonical"), "content_hash").select(key, "canonical")


def shingle_hashes(text: Column, n: int) -> Column:
    """Distinct 64-bit hashes of word n-grams; a shorter text is one shingle."""
    def build(w: Column) -> Column:
        last = F.greatest(F.lit(1), F.size(w) - n + 1)
        grams = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), " ")))
        return F.when(F.size(w) > 0, F.array_sort(F.array_distinct(grams))).otherwise(F.array().cast("array<bigint>"))

    return let(words(squeeze(text)), build)


def jaccard(a: Column, b: Column) -> Column:
    i = F.size(F.array_intersect(a, b))
    return i / (F.size(a) + F.size(b) - i)


def dedup_near(df: DataFrame, key: str, text: str, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """(key, canonical): components of all pairs of texts whose word shingles have
    a Jaccard similarity of ``threshold`` or more; canonical is the least key.

    Texts with one shingle set collapse first. Candidates share a rare shingle
    (``rare_blocks``), which is exact; links are verified on the whole sets."""
    docs = cut(shingle_sets(df, key, words(squeeze(F.col(text))), n))
    reps = docs.groupBy("digest").agg(F.min("id").alias("rep"))
    same = cut(docs.select("id", "digest").join(reps, "digest").select("id", "rep"))
    # Copies are left out where the sets are read, so that these are stored once.
    per = cut(same.where("id is not null").groupBy("id").agg(F.max((F.col("id") == F.col("rep")).cast("int")).alias("own"), F.count(F.lit(1)).alias("n")))
    rows = docs.select("id", "payload", "size").where("id is not null")
    items, again = rows_among(rows, "id", per.where("own = 0 or n > 1").select("id"), inside=False), per.where("own = 1 and n > 1").select("id")
    if not again.isEmpty():
        items = items.unionByName(cut(rows_among(rows, "id", again).dropDuplicates(["id"])))
    # Sets whose sizes differ by more than the threshold cannot reach it.
    fits = lambda x, y: F.least(x, y) >= F.lit(threshold - 1e-9) * F.greatest(x, y)
    links = complete_links(rare_blocks(items, threshold).join(items.select("id", "size"), "id"), items, lambda x, y: jaccard(x, y) >= threshold, fits)
    comp = components(links, "leader", "member")
    return same.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        F.col("id").alias(key), F.coalesce("component", "rep").alias("canonical")
    )


def merge_duplicate_acl(rows: DataFrame, group: str, key: str, acl: str) -> DataFrame:
    """(group, copies, allowed): principals granted by every copy's own policy.

    A principal counts when its number of granting copies equals the group
    size, so no list of policies is gathered. A missing policy grants nobody."""
    size = rows.groupBy(group).agg(F.count_distinct(key).alias("copies"))
    got = rows.select(group, key, F.explode(acl).alias("_p")).distinct().groupBy(group, "_p").agg(F.count(F.lit(1)).alias("_g"))
    ok = size.join(got, group).where("_g = copies").groupBy(group).agg(F.array_sort(F.collect_list("_p")).alias("allowed"))
    return size.join(ok, group, "left").select(group, "copies", F.coalesce("allowed", F.array().cast("array<string>")).alias("allowed"))


def contamination(train: DataFrame, train_key: str, train_text: str, held: DataFrame, held_key: str, held_text: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(per held-out item: exact copies, containing texts, n-gram share; pairs of
    item and containing text).

    Training n-grams are cut to those of the held-out side before anything is
    shuffled; a passage is verified on whole texts. Items shorter than n words
    use their own length, and only lengths that occur are expanded."""
    h = held.select(F.col(held_key).alias("item"), squeeze(F.col(held_text)).alias("ht")).withColumn("_w", words(F.col("ht"))).where(F.size("_w") > 0)
    h = h.withColumn("_n", F.least(F.lit(n), F.size("_w")))
    grams = lambda w, m: F.transform(F.sequence(F.lit(1), F.size(w) - m + 1), lambda i: F.concat_ws("|", m.cast("string"), F.array_join(F.slice(w, i, m), " ")))
    hg = cut(h.select("item", F.posexplode(grams(F.col("_w"), F.col("_n"))).alias("pos", "g")))
    sizes = sorted(r[0] for r in h.select("_n").distinct().limit(n).collect())
    t = train.select(F.col(train_key).alias("doc"), squeeze(F.col(train_text)).alias("tt"))
    tw = t.select("doc", words(F.col("tt")).alias("_w"))
    parts = F.concat(*[F.when(F.size("_w") >= m, grams(F.col("_w"), F.lit(m))).otherwise(F.array().cast("array<string>")) for m in sizes]) if sizes else F.array().cast("array<string>")
    want = hg.select("g").distinct()
    hit = cut(tw.select("doc", F.explode(F.array_distinct(parts)).alias("g")).join(want, "g", "left_semi"))
    share = hg.select("item", "g").distinct().join(hit.select("g").distinct().withColumn("_in", F.lit(True)), "g", "left")
    share = share.groupBy("item").agg(F.round(F.count_if("_in") / F.count(F.lit(1)), 6).alias("ngram_share"))
    seen = hit.groupBy("g").agg(F.count(F.lit(1)).alias("_df"))
    rare = hg.join(seen, "g").groupBy("item").agg(F.min_by("g", F.struct("_df", "g")).alias("g"))
    pairs = hit.join(rare, "g").select("doc", "item").join(t, "doc").join(h.select("item", "ht"), "item")
    pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    found = cut(pairs.where(F.contains(pad("tt"), pad("ht"))).select("item", "doc", (F.col("tt") == F.col("ht")).alias("exact")))
    per = found.groupBy("item").agg(F.count(F.lit(1)).alias("containing"), F.count_if("exact").alias("exact_copies"))
    none = F.lit(0).cast("bigint")
    return h.select("item").join(per, "item", "left").join(share, "item", "left").select(
        "item", F.coalesce("exact_copies", none).alias("exact_copies"), F.coalesce("containing", none).alias("containing"), "ngram_share"
    ), found


def pack_sequences(df: DataFrame, key: str, tokens: Column, length: int, shards: int, keep_remainder: bool) -> DataFrame:
    """Spans (shard, seq, key, from, to) of each document in fixed-length
    sequences; documents follow key order inside a hash shard."""
    d = df.select(key, tokens.cast("bigint").alias("_n")).where("_n > 0").withColumn("shard", F.pmod(h32(F.lit("shard|"), F.col(key)), F.lit(shards)).cast("int"))
    # The scan reads its rows twice: the counts are written once, not the texts read again.
    d = running(cut(d), ["shard"], [key], F.floor(F.col(key) / 65536), inclusive=False, _at=("sum", F.col("_n")))
    first, last = F.floor(F.col("_at") / length), F.floor((F.col("_at") + F.col("_n") - 1) / length)
    s = d.select("shard", key, "_at", "_n", F.explode(F.sequence(first, last)).alias("seq"))
    out = s.select(
        "shard", "seq", key, F.greatest(F.lit(0), F.col("seq") * length - F.col("_at")).alias("doc_from"),
        F.least(F.col("_n"), (F.col("seq") + 1) * length - F.col("_at")).alias("doc_to"),
    )
    if keep_remainder:
        return out
    full = d.groupBy("shard").agg(F.floor(F.sum("_n") / length).alias("_full"))
    return out.join(full, "shard").where("seq < _full").drop("_full")


def shard_manifest(df: DataFrame, key: str, tokens: Column, shards: int, cols: Sequence[str]) -> DataFrame:
    """Rows, tokens and digest per stable hash shard."""
    d = df.withColumn("shard", F.pmod(h32(F.lit("shard|"), F.col(key)), F.lit(shards)).cast("int")).withColumn("_n", tokens)
    return d.groupBy("shard").agg(F.sum("_n").cast("bigint").alias("tokens"), *digest_columns(cols))


def validate_conversations(df: DataFrame, block: int = 1024) -> DataFrame:
    """(conv_id, turns, reasons): broken rules per conversation; the previous
    turn comes from a block scan, so one very long conversation is spread."""
    d = previous(df, ["conv_id"], ["turn"], F.floor(F.col("turn") / block), pt=F.col("turn"), pr=F.col("role"))
    first = F.col("pt").isNull()
    rules = {
        "missing_role": F.col("role").isNull() | (F.trim("role") == ""),
        "missing_provenance": F.col("source").isNull() if "source" in df.columns else F.lit(False),
        "bad_first_role": first & ~F.col("role").isin("user", "system"),
        "no_alternation": ~first & ((F.col("role") == F.col("pr")) | (F.col("role") == "system")),
        "empty_turn": F.col("text").isNull() | (F.trim("text") == ""),
        "turn_gap": F.when(first, F.col("turn") != 0).otherwise(F.col("turn") != F.col("pt") + 1),
    }
    g = d.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), *[F.bool_or(F.coalesce(c, F.lit(False))).alias(f"_{r}") for r, c in rules.items()])
    return g.select("conv_id", "turns", reasons([(r, F.col(f"_{r}")) for r in rules]).alias("reasons"))


def render_dialogues(df: DataFrame, template: Sequence[tuple[str, str]], joiner: str = "\n", block: int = 1024) -> DataFrame:
    """One training string per conversation by role template ({text} is the
    turn), with prompt and answer token counts. Turns are joined per block of
    turns first, so partial strings are built in parallel."""
    line = F.col("text")
    for role, pattern in reversed(list(template)):
        a, b = pattern.split("{text}")
        line = F.when(F.col("role") == role, F.concat(F.lit(a), F.col("text"), F.lit(b))).otherwise(line)
    n = F.size(words(F.col("text")))
    src = df.select("conv_id", "turn", line.alias("_l"), F.floor(F.col("turn") / block).alias("_b"), F.when(F.col("role") == "assistant", n).otherwise(0).alias("_a"), F.when(F.col("role") != "assistant", n).otherwise(0).alias("_p"))
    join = lambda at: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "_l"))), lambda x: x["_l"]), joiner)
    part = src.groupBy("conv_id", "_b").agg(join("turn").alias("_l"), F.sum("_a").alias("_a"), F.sum("_p").alias("_p"))
    return part.groupBy("conv_id").agg(join("_b").alias("rendered"), F.sum("_p").alias("prompt_tokens"), F.sum("_a").alias("answer_tokens"))


def preference_pairs(answers: DataFrame) -> DataFrame:
    """Best against worst answer per prompt, one pair each, by aggregates only.

    answers(prompt, answer_id, text, score, source)."""
    a = F.struct("score", F.col("answer_id"), "text", "source")
    lo = F.struct("score", (-F.col("answer_id")).alias("answer_id"), "text", "source")
    g = answers.groupBy("prompt").agg(F.max(a).alias("c"), F.min(lo).alias("r"), F.count(F.lit(1)).alias("answers"))
    return g.where((F.col("c.text") != F.col("r.text")) & (F.col("c.score") > F.col("r.score"))).select(
        "prompt", "answers", F.col("c.answer_id").alias("chosen_id"), (-F.col("r.answer_id")).alias("rejected_id"), F.col("c.text").alias("chosen"), F.col("r.text").alias("rejected"),
        F.col("c.score").alias("chosen_score"), F.col("r.score").alias("rejected_score"), F.col("c.source").alias("source"),
    )


def preference_audit(pairs: DataFrame) -> DataFrame:
    """By annotator source: position bias, length preference and correlation,
    style rates, judge consistency under order swap.

    pairs(source, chosen, rejected, chosen_first, swap_agrees)."""
    lc, lr = F.length("chosen"), F.length("rejected")
    listy = lambda c: F.col(c).rlike(r"(?m)^\s*[-*]|\d\.").cast("double")
    return pairs.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("chosen_first").cast("double")), 6).alias("first_position_rate"),
        F.round(F.avg((lc > lr).cast("double")), 6).alias("longer_chosen_rate"), F.round(F.corr(lc.cast("double"), lr.cast("double")), 6).alias("length_corr"),
        F.round(F.avg(listy("chosen")) - F.avg(listy("rejected")), 6).alias("style_gap"), F.round(F.avg(F.col("swap_agrees").cast("double")), 6).alias("swap_consistency"),
    )


def verify_answers(df: DataFrame, answer: str, truth: str, tolerance: float) -> DataFrame:
    """Accepts a normalized exact match, or numbers within the tolerance."""
    a, t = squeeze(F.regexp_replace(answer, r"[.,;:!?]+$", "")), squeeze(F.regexp_replace(truth, r"[.,;:!?]+$", ""))
    x, y = F.col(answer).try_cast("double"), F.col(truth).try_cast("double")
    ok = F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= tolerance).otherwise(a == t)
    return df.withColumn("accepted", F.coalesce(ok, F.lit(False)))


def verifier_report(verified: DataFrame, by: str, reward: str, length: Column, limit: float) -> DataFrame:
    """Accept rate and reward-length correlation; a strong one flags an exploit."""
    c = F.corr(F.col(reward).cast("double"), length.cast("double"))
    g = verified.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("accepted").cast("double")), 6).alias("accept_rate"), F.round(c, 6).alias("reward_length_corr"))
    return g.withColumn("suspect", F.coalesce(F.abs("reward_length_corr") > limit, F.lit(False)))


def near_reference(records: DataFrame, key: str, text: str, reference: DataFrame, ref_text: str, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """Keys of records whose shingles have a Jaccard similarity of ``threshold`` or
    more with some reference text. Records with one shingle set are compared once;
    candidates share a rare shingle and have sizes that can reach the threshold."""
    digest = F.md5(F.array_join("payload", ","))
    mine = cut(records.select(F.col(key), shingle_hashes(F.col(text), n).alias("payload")).withColumn("digest", digest))
    sets = lambda d, tag: d.select(F.concat(F.lit(tag), "digest").alias("id"), "payload").where(F.size("payload") > 0).dropDuplicates(["id"])
    refs = reference.select(shingle_hashes(F.col(ref_text), n).alias("payload")).withColumn("digest", digest)
    items = cut(sets(mine, "r|").unionByName(sets(refs, "q|")))
    blocks = cut(rare_blocks(items, threshold).join(items.select("id", F.size("payload").alias("size")), "id"))
    side = lambda tag, name: blocks.where(F.col("id").startswith(tag)).select("block", F.col("id").alias(name), F.col("size").alias(f"_n{name}"))
    fits = F.least("_na", "_nb") >= F.lit(threshold - 1e-9) * F.greatest("_na", "_nb")
    pairs = side("r|", "a").join(side("q|", "b"), "block").where(fits).select("a", "b").distinct()
    both = pairs.join(items.select(F.col("id").alias("a"), F.col("payload").alias("_a")), "a").join(items.select(F.col("id").alias("b"), F.col("payload").alias("_b")), "b")
    hits = both.where(jaccard(F.col("_a"), F.col("_b")) >= threshold).select(F.substring("a", 3, 32).alias("digest")).distinct()
    return mine.join(hits, "digest", "left_semi").select(key)


def filter_generated(records: DataFrame, key: str, raw: str, text: str, reference: DataFrame, ref_text: str, violations: DataFrame) -> DataFrame:
    """Each generated record with its verdict: malformed, copied (equal to a
    reference text or a near copy of one), duplicate (kept once) or kept."""
    bad = violations.select(key).distinct().withColumn("_bad", F.lit(True))
    r = records.withColumn("_h", F.md5(squeeze(F.col(text)))).join(bad, key, "left")
    ref = reference.select(F.md5(squeeze(F.col(ref_text))).alias("_h")).distinct().withColumn("_copy", F.lit(True))
    near = near_reference(records, key, text, reference, ref_text).withColumn("_near", F.lit(True))
    r = r.join(ref, "_h", "left").join(near, key, "left").withColumn("_copy", F.coalesce("_copy", "_near")).drop("_near")
    good = r.where("_bad is null and _copy is null").groupBy("_h").agg(F.min(key).alias("_first"))
    verdict = F.when(F.col("_bad"), "malformed").when(F.col("_copy"), "copied").when(F.col(key) != F.col("_first"), "duplicate").otherwise("kept")
    return r.join(good, "_h", "left").withColumn("verdict", verdict).drop("_h", "_bad", "_copy", "_first")


def corpus_metrics(docs: DataFrame, chunks: DataFrame, key: str, text: str) -> DataFrame:
    """By source: documents, failures (empty text), chunked share, chunks per
    document, duplicate rate, token spread."""
    c = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("_c"))
    d = docs.select(key, "source", F.md5(squeeze(F.col(text))).alias("_h"), F.size(words(F.col(text))).alias("_n")).join(c, key, "left")
    first = d.groupBy("_h").agg(F.min(key).alias("_k"))
    d = d.join(first, "_h")
    n = F.count(F.lit(1))
    return d.groupBy("source").agg(
        n.alias("documents"), F.count_if(F.col("_n") == 0).alias("failures"), F.round(F.count("_c") / n, 6).alias("chunked"),
        F.round(ratio(F.coalesce(F.sum("_c"), F.lit(0)), n), 6).alias("chunks_per_doc"), F.round(F.count_if(F.col(key) != F.col("_k")) / n, 6).alias("duplicate_rate"),
        F.min("_n").alias("min_tokens"), F.round(F.avg("_n"), 6).alias("mean_tokens"), F.max("_n").alias("max_tokens"),
    )
