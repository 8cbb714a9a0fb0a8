"""Personal data by candidate spans and boosted trees, in DataFrame functions.

Generators with high recall propose spans of four kinds; spans may overlap. Base
spans follow exact rules (a pattern and a check) and always stay. All other
candidates are scored by gradient-boosted trees on features of their format and
context, and those above their kind's calibrated threshold are added.

There are no hand labels: the base rules teach. Base spans, and base spans
rewritten into the relaxed forms where they stand, are positive; other candidates
that overlap no base span, and base spans changed so that their check fails, are
negative. Trees are fitted on a bounded sample and become Column expressions;
scoring, like everything else here, runs in Spark's own functions inside each
row, without a shuffle. Thresholds come from counts over the half of the table's
texts that no tree has seen, base spans left aside, since they need none.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from sievework.functions.columns import let

KINDS = ("email", "ip", "card", "phone")

# fixed values: the base patterns, with possessive loops (no backtracking, no
# recursion in very long texts) and starts at the head of a run of characters
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Relaxed generators: other separators, masked marks, numbers without a country sign.
WIDE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++ ?(?:@|[(\[{](?:at|AT|@)[)\]}]) ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[{](?:dot|DOT|\.)[)\]}]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,3}+(?:\[\.\]|\(\.\))){3}[0-9]{1,3}+|(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}+:){4,7}+[0-9A-Fa-f]{1,4}+",
    "card": r"(?<![0-9])[0-9](?:[ ./ -]?[0-9])++",
    "phone": r"(?<![0-9])\(?[0-9]{2,4}+\)?[ ./-]{1,2}+[0-9]{3,4}+[ ./-][0-9]{3,4}+(?![0-9])",
}
# What a text must hold for a pattern to be tried at all.
GATE = {
    "email": lambda t: t.contains("@") | t.rlike(r"[(\[{](?:at|AT)[)\]}]"),
    "ip": lambda t: t.rlike(r"[0-9][\[(]?\.|[0-9A-Fa-f]:[0-9A-Fa-f]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ ./ -]?[0-9]){11}"),
    "phone": lambda t: t.contains("+") | t.rlike(r"[0-9]\)?[ ./-]"),
}
CONTEXT = r"(?i)mail|contact|write|tel\b|phone|call|fax|mobil|ip\b|host|server|addr|card|visa|pay|credit"
FEATURES = (
    "kind", "digits", "letters", "spaces", "dots", "dashes", "others", "plus", "at", "luhn", "over255", "parts", "longest", "before", "after", "context",
)
BLOCK = 256


def _prefix(a: Column) -> Column:
    """Sums of the elements before each element."""
    zero = F.struct(F.lit(0).cast("bigint").alias("s"), F.array().cast("array<bigint>").alias("a"))
    step = lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a"))
    return F.aggregate(a, zero, step, lambda acc: acc["a"])


def _prefix_blocks(a: Column) -> Column:
    """Like :func:`_prefix`, by blocks, so that time grows with the length."""
    total = lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda s, x: s + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda b: F.slice(a, b * BLOCK + 1, F.lit(BLOCK)))
    return let(
        blocks,
        lambda bs: F.flatten(F.zip_with(bs, _prefix(F.transform(bs, total)), lambda b, head: F.transform(_prefix(b), lambda s: s + head))),
    )


def _found(text: Column, pattern: str) -> Column:
    """[(start, end, text)] of the leftmost non-overlapping matches."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:bigint,end:bigint,text:string>>")

    def place(m: Column) -> Column:
        gaps = F.split(text, pattern, -1)

        def with_gaps(g: Column) -> Column:
            steps = F.zip_with(m, g, lambda x, y: (F.coalesce(F.length(x), F.lit(0)) + F.length(y)).cast("bigint"))
            starts = _prefix_blocks(F.slice(steps, F.lit(1), F.size(m)))
            at = F.zip_with(starts, F.slice(g, F.lit(1), F.size(m)), lambda s, y: s + F.length(y))
            return F.zip_with(at, m, lambda s, x: F.struct(s.alias("start"), (s + F.length(x)).alias("end"), x.alias("text")))

        return F.when(F.size(m) > 0, let(gaps, with_gaps)).otherwise(none)

    return let(hits, place)


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _count(t: Column, pattern: str) -> Column:
    return F.least(F.length(F.regexp_replace(t, pattern, "")), F.lit(40))


def _luhn(digits: Column) -> Column:
    """Luhn's sum of a digit text is a multiple of ten."""
    one = lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0)))
    return F.aggregate(F.transform(values, one), F.lit(0), lambda s, x: s + x) % 10 == 0


def _over255(t: Column) -> Column:
    """Number of dotted parts above 255."""
    parts = F.transform(F.split(F.regexp_replace(t, r"[\[\]()]", ""), r"\."), lambda p: F.ltrim(p, F.lit("0")))
    return F.size(F.filter(parts, lambda p: (F.length(p) > 3) | ((F.length(p) == 3) & (p > "255"))))


def _is_base(kind: str, t: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _over255(t) == 0
    if kind == "card":
        return let(_digits(t), lambda d: F.length(d).between(12, 19) & _luhn(d))
    return F.length(_digits(t)).between(9, 15)


def _neighbour(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike(r"\p{L}"), 3).otherwise(4)


def _features(kind: str, text: Column, x: Column) -> Column:
    t = x["text"]
    head = F.greatest(x["start"] - 24, F.lit(0))
    before = F.substring(text, (head + 1).cast("int"), (x["start"] - head).cast("int"))
    values = {
        "kind": F.lit(KINDS.index(kind)),
        "digits": _count(t, "[^0-9]"),
        "letters": _count(t, "[^A-Za-z]"),
        "spaces": _count(t, "[^ ]"),
        "dots": _count(t, "[^.]"),
        "dashes": _count(t, "[^-]"),
        "others": _count(t, "[A-Za-z0-9 .@+-]"),
        "plus": _count(t, "[^+]"),
        "at": _count(t, "[^@]"),
        "luhn": _luhn(_digits(t)).cast("int") if kind == "card" else F.lit(1),
        "over255": F.least(_over255(t), F.lit(9)) if kind == "ip" else F.lit(0),
        "parts": F.least(F.size(F.split(t, "[^0-9A-Za-z]+")), F.lit(20)),
        "longest": F.least(F.array_max(F.transform(F.split(t, "[^0-9A-Za-z]+"), F.length)), F.lit(40)),
        "before": _neighbour(F.when(x["start"] > 0, F.substring(text, x["start"].cast("int"), F.lit(1)))),
        "after": _neighbour(F.substring(text, (x["end"] + 1).cast("int"), F.lit(1))),
        "context": before.rlike(CONTEXT).cast("int"),
    }
    return F.struct(*[values[f].cast("int").alias(f) for f in FEATURES])


def _row(k: int, wide: int, text: Column):
    def row(x: Column) -> Column:
        base = F.lit(False) if wide else _is_base(KINDS[k], x["text"])
        return F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end"), base.alias("base"), _features(KINDS[k], text, x).alias("f"))

    return row


def with_candidates(df: DataFrame, text_col: str = "text", name: str = "_candidates") -> DataFrame:
    """Adds all candidates: kind number, start, end (code points), base, features."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.array().cast("array<struct<start:bigint,k:int,end:bigint,base:boolean,f:struct<" + ",".join(f"{f}:int" for f in FEATURES) + ">>>")
    found = []
    for k, kind in enumerate(KINDS):
        for wide, pattern in ((0, BASE[kind]), (1, WIDE[kind])):
            # Shorter digit runs than any rule takes are no candidates.
            spans = _found(text, pattern)
            if kind in ("card", "phone"):
                spans = F.filter(spans, lambda x: F.length(_digits(x["text"])) >= 7)
            if wide and kind in ("email", "card"):
                # What the base pattern takes too is its candidate already.
                spans = F.filter(spans, lambda x: ~x["text"].rlike(f"^(?:{BASE[kind]})$"))
            found.append(F.when(GATE[kind](text), F.transform(spans, _row(k, wide, text))).otherwise(none))
    return df.withColumn(name, F.concat(*found))


@dataclass
class Trees:
    """Boosted trees: nodes are (feature, limit, left, right) or a leaf's value."""

    bias: float = 0.0
    trees: list = field(default_factory=list)
    limits: dict = field(default_factory=dict)  # kind number -> margin from which spans are added

    def margin(self, f: Column) -> Column:
        def walk(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            name, limit, low, high = node
            return F.when(f[name] <= limit, walk(low)).otherwise(walk(high))

        out = F.lit(float(self.bias))
        for tree in self.trees:
            out = out + walk(tree)
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3, least: float = 1.0) -> Trees:
    """Second-order boosting of small trees on integer features."""
    p0 = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    out = Trees(bias=float(np.log(p0 / (1 - p0))))
    margin = np.full(len(y), out.bias)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int):
        score = lambda a, b: a * a / (b + 1.0)
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if level:
            for j in range(x.shape[1]):
                values = x[rows, j]
                a, b = np.bincount(values, g[rows]).cumsum(), np.bincount(values, h[rows]).cumsum()
                ok = (b >= least) & (hs - b >= least)
                gain = np.where(ok, score(a, b) + score(gs - a, hs - b) - score(gs, hs), -1.0)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], (j, at))
        if best[1] is None:
            value = float(-rate * gs / (hs + 1.0))
            margin[rows] += value
            return value
        j, at = best[1]
        low = x[rows, j] <= at
        return (FEATURES[j], at, grow(rows[low], g, h, level - 1), grow(rows[~low], g, h, level - 1))

    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-margin))
        out.trees.append(grow(np.arange(len(y)), p - y, p * (1 - p) + 1e-9, depth))
    return out


def margins(model: Trees, x: np.ndarray) -> np.ndarray:
    at = {f: j for j, f in enumerate(FEATURES)}

    def walk(node, rows: np.ndarray, out: np.ndarray) -> None:
        if not isinstance(node, tuple):
            out[rows] += node
            return
        low = x[rows, at[node[0]]] <= node[1]
        walk(node[2], rows[low], out)
        walk(node[3], rows[~low], out)

    out = np.full(len(x), model.bias)
    for t in model.trees:
        walk(t, np.arange(len(x)), out)
    return out


def calibrate(margin: np.ndarray, y: np.ndarray, precision: float, count: np.ndarray | None = None) -> float:
    """Least margin from which the share of positives, less its chance error, is
    at least ``precision``, halfway to the next lower one seen; infinity where
    there is none. ``count``: how often
    each pair of margin and label occurs (once, if not given)."""
    order = np.argsort(-margin, kind="stable")
    count = np.ones(len(y)) if count is None else count
    hits, n = np.cumsum((y * count)[order]), np.cumsum(count[order])
    ok = (hits / (n + 4.0)) >= precision
    ends = np.r_[margin[order][1:] != margin[order][:-1], True] if len(y) else np.zeros(0, bool)
    good = np.flatnonzero(ok & ends)
    if not good.size:
        return float("inf")
    least = float(margin[order][good[-1]])
    # Where all that was seen is good, what is likelier than not is good too.
    return min(least, 0.0) if good[-1] == len(y) - 1 else (least + float(margin[order][good[-1] + 1])) / 2


def _rewritten(kind: str, t: Column, n: Column) -> Column:
    """A base span's text in a relaxed form of its kind; ``n`` >= 0 chooses it."""
    pick = lambda *c: F.element_at(F.array(*c), (n % len(c) + 1).cast("int"))
    if kind == "email":
        marks = [("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "."), (" @ ", " . "), ("{AT}", "{DOT}"), ("(@)", "(.)")]
        domain = F.substring_index(t, "@", -1)
        return pick(*[F.concat(F.substring_index(t, "@", 1), F.lit(at), F.replace(domain, F.lit("."), F.lit(dot))) for at, dot in marks])
    if kind == "ip":
        return pick(*[F.replace(t, F.lit("."), F.lit(dot)) for dot in ("[.]", "(.)")])
    if kind == "card":
        return pick(*[F.regexp_replace(_digits(t), "([0-9]{4})(?=[0-9])", f"$1{mark}") for mark in "./"])
    return F.regexp_extract(F.substring(t, 2, 1 << 30), WIDE["phone"], 0)


def _broken(kind: str, t: Column) -> Column | None:
    """A base span's text changed so that its kind's check fails."""
    if kind == "ip":
        return F.regexp_replace(t, "[0-9]+$", "999")
    if kind == "card":
        return F.concat(F.substring(t, F.lit(1), F.length(t) - 1), F.translate(F.right(t, F.lit(1)), "0123456789", "1234567890"))
    return None


def with_lessons(df: DataFrame, text_col: str = "text", name: str = "_lessons") -> DataFrame:
    """Adds what the base rules teach about every text: label, whether it counts
    for thresholds (all but base spans do), features."""
    df = with_candidates(df, text_col).withColumn("_base", F.filter("_candidates", lambda c: c["base"]))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lesson = lambda y, counts, f: F.struct(y.alias("y"), F.lit(counts).alias("counts"), f.alias("f"))
    others = F.filter("_candidates", lambda c: ~c["base"] & ~F.exists("_base", lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"])))
    parts = [F.transform("_base", lambda c: lesson(F.lit(1), False, c["f"])), F.transform(others, lambda c: lesson(F.lit(0), True, c["f"]))]

    def place(c: Column) -> Column:
        """A span's text with what features read around it."""
        head = F.greatest(c["start"] - 24, F.lit(0))
        cut = lambda at, n: F.substring(text, (at + 1).cast("int"), n.cast("int"))
        t = cut(c["start"], c["end"] - c["start"])
        return F.struct(cut(head, c["start"] - head).alias("before"), t.alias("t"), cut(c["end"], F.lit(1)).alias("after"))

    def of_kind(k: int, kind: str) -> Column:
        """Lessons for ``kind`` from other texts in the places of base spans of kind
        number ``k``. Each step is a transform of its own, so that no text is made
        more than once."""

        def forms(v: Column) -> Column:
            form = lambda y, wide, w: F.struct(F.lit(y).alias("y"), F.lit(wide).alias("wide"), v["before"].alias("before"), w.alias("w"), v["after"].alias("after"))
            n, broken = F.pmod(F.xxhash64(v), F.lit(420)), _broken(kind, v["t"])
            if kind != KINDS[k]:  # a piece of a number with marks is no phone
                piece = F.regexp_extract(_rewritten(KINDS[k], v["t"], n), WIDE[kind], 0)
                return F.array(form(0, True, piece))
            # Several ways of hiding one span, of the kinds that have several.
            out = [form(1, True, _rewritten(kind, v["t"], n))]
            if kind != "phone":
                out.append(form(1, True, _rewritten(kind, v["t"], n + 1)))
            if broken is not None:
                out += [form(0, True, _rewritten(kind, broken, n)), form(0, False, broken)]
            return F.array(*out)

        def whole(x: Column) -> Column:
            at = F.length(x["before"]).cast("bigint")
            text = F.concat(x["before"], x["w"], x["after"]).alias("whole")
            return F.struct(x["y"].alias("y"), text, at.alias("start"), (at + F.length(x["w"])).alias("end"), x["w"].alias("text"))

        places = F.transform(F.filter("_base", lambda c: c["k"] == k), place)
        made = F.filter(F.flatten(F.transform(places, forms)), lambda x: ~x["wide"] | x["w"].rlike(f"^(?:{WIDE[kind]})$"))
        return F.transform(F.transform(made, whole), lambda x: lesson(x["y"], True, _features(kind, x["whole"], x)))

    return df.withColumn(name, F.concat(*parts, *[of_kind(k, kind) for k, kind in [*enumerate(KINDS), (2, "phone")]])).drop("_candidates", "_base")


# Margins are counted in steps of 1 / STEPS.
STEPS = 64


def fit_pii(df: DataFrame, text_col: str = "text", sample_docs: int = 50_000, sample_rows: int = 20_000, precision: float = 0.9) -> Trees:
    """Trees from at most ``sample_rows`` lessons, taken by hash from a seeded
    sample of about ``sample_docs`` rows (all, if there are fewer), so that what
    the driver gets does not grow with the table.

    Half of the texts, by hash, teach the trees. All texts of the other half give
    each kind's threshold, from counts per margin of what is no base span; a kind
    with few spans takes the threshold of all kinds (``kind_limits``). Without
    lessons, or with one class only, no span is added."""
    src = df.select(text_col)
    share = min(1.0, sample_docs / max(1, df.count()))
    half = F.pmod(F.xxhash64(F.col(text_col)), F.lit(2))
    some = (src if share == 1.0 else src.sample(share, seed=7)).where(half == 0)
    c = with_lessons(some, text_col).select(F.posexplode("_lessons").alias("i", "c"), F.xxhash64(text_col).alias("h"))
    rows = c.select("c.f.*", "c.y", F.xxhash64("h", "i").alias("h")).orderBy("h").limit(sample_rows).collect()
    if not rows or len({r["y"] for r in rows}) < 2:
        return Trees(limits={k: float("inf") for k in range(len(KINDS))})
    model = boost(np.array([r[: len(FEATURES)] for r in rows], np.int64), np.array([r["y"] for r in rows], np.float64))
    held = with_lessons(src.where(half == 1), text_col).select(F.explode(F.filter("_lessons", lambda c: c["counts"])).alias("c"))
    steps = held.select(F.col("c.f.kind").alias("k"), "c.y", F.floor(model.margin(F.col("c.f")) * STEPS).alias("m")).groupBy("k", "y", "m").count().collect()
    counted = np.array([(r["k"], r["m"] / STEPS, r["y"], r["count"]) for r in steps], np.float64).reshape(-1, 4)
    model.limits = kind_limits(counted, precision)
    return model


def kind_limits(counted: np.ndarray, precision: float) -> dict[int, float]:
    """Threshold of every kind from rows (kind, margin, label, count). A kind with
    too few spans for a threshold of its own takes that of all kinds together, if
    its own spans above that are good to the same share; else it gets none added."""
    pooled = calibrate(counted[:, 1], counted[:, 2], precision, counted[:, 3])
    out = {}
    for k in range(len(KINDS)):
        mine = counted[counted[:, 0] == k]
        out[k] = calibrate(mine[:, 1], mine[:, 2], precision, mine[:, 3])
        above = mine[mine[:, 1] >= pooled]
        n, hits = above[:, 3].sum(), (above[:, 2] * above[:, 3]).sum()
        if not np.isfinite(out[k]) and n and hits >= precision * n:
            out[k] = pooled
    return out


def select_spans(df: DataFrame, model: Trees, name: str = "_candidates") -> DataFrame:
    """Adds base_spans and spans: [(start, k, end)] by start, then kind.

    A candidate that is no base span is added where its margin reaches its kind's
    threshold, it overlaps no base span, and no better added one."""
    span = lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end"))
    base = F.array_sort(F.transform(F.filter(name, lambda x: x["base"]), span))
    limit = lambda k: F.element_at(F.array(*[F.lit(model.limits.get(j, float("inf"))) for j in range(len(KINDS))]), k + 1)
    df = df.withColumn("base_spans", base)
    if not model.trees:
        return df.withColumn("spans", F.col("base_spans"))
    scored = F.transform(
        F.filter(name, lambda x: ~x["base"] & ~F.exists("base_spans", lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))),
        lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end"), model.margin(x["f"]).alias("m")),
    )
    good = F.array_sort(F.filter(scored, lambda x: x["m"] >= limit(x["k"])))
    none = F.array().cast("array<struct<start:bigint,k:int,end:bigint,m:double>>")

    def keep(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        return (
            F.when((F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1))["end"] <= x["start"]), F.concat(acc, F.array(x)))
            .when(x["m"] > last["m"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(x)))
            .otherwise(acc)
        )

    added = F.when(F.size(name) > F.size("base_spans"), F.aggregate(good, none, keep)).otherwise(none)
    return df.withColumn("spans", F.array_sort(F.concat("base_spans", F.transform(added, span))))


def find_pii(df: DataFrame, model: Trees | None = None, text_col: str = "text") -> DataFrame:
    """Adds base_spans and spans to every row; offsets are code points of the
    whole text, ends exclusive. Null and empty texts have no spans; repeated rows
    are treated alike. Columns named base_spans, spans or _candidates are replaced."""
    df = df.drop("base_spans", "spans", "_candidates")
    model = model or fit_pii(df, text_col)
    return select_spans(with_candidates(df, text_col), model).drop("_candidates")


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Replaces the found spans by their kind in brackets; overlapping spans are
    one replacement that names the first kind. A null text stays null."""
    text = F.col(text_col)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
        tag = F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), x["k"] + 1)
        fresh = F.struct(x["end"].alias("at"), F.concat(acc["out"], F.array(gap, tag)).alias("out"))
        more = F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(x["start"] >= acc["at"], fresh).otherwise(more)

    done = F.aggregate("spans", start, step, lambda acc: F.concat(F.concat_ws("", acc["out"]), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return df.withColumn(text_col, F.when(F.size("spans") > 0, done).otherwise(text))


def span_text(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["k"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    found = find_pii(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["k"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(span_text(F.col("base_spans")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )
