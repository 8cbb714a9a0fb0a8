import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievework.llm import grades, pii, toxicity
import brute

SYLLABLES = "ba den for gul ha ner ti son ple re mo qua".split()


def corpus(n, seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 60))]
        toxic, poor = int(rng.random() < 0.3), int(rng.random() < 0.3)
        if toxic:
            for w in rng.sample(["idiot", "scumbag", "moron"], 2):
                words.insert(rng.randrange(len(words)), w)
        if poor:
            words = [words[0].upper() + "!!!"] * len(words)
            toxic = 0
        rows.append((i, " ".join(words), "k"))
        labels.append((i, 0 if poor else 1, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = corpus(700)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), labels


def test_toxicity_held_out_and_disguised(spark, fitted):
    docs, labels, plain = fitted
    model = toxicity.fit_toxicity(docs, labels)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()}
    truth = {i: t for i, _, t in plain}
    assert np.mean([(s >= 0.5) == truth[i] for i, s in scored.items()]) >= 0.95
    hidden = [
        (1, "baden forti 1d10t sonple scumbag"), (2, "baden i d i o t ner m.o.r.o.n tison"), (3, "baden idiooooot forti $cumb@g reti"),
        (4, "baden forti sonple hader"), (5, ""), (6, None), (7, "ba " * 20_000),
    ]
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(spark.createDataFrame(hidden, "doc_id bigint, text string"), model).collect()}
    assert min(got[i] for i in (1, 2, 3)) >= 0.5 and max(got[i] for i in (4, 5, 6, 7)) < 0.5
    none = toxicity.fit_toxicity(docs, labels.limit(0))
    assert toxicity.score_toxicity(docs, none).where("score <> 0").count() == 0
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_viterbi_is_the_best_path():
    """Against trying every path of short lattices."""
    rng = np.random.default_rng(0)
    model = toxicity.CharModel(rng.integers(0, 50, toxicity.SIDE**3).astype(float))
    for text in ("1d.t", "a@aa", "0", "b--b", "$x!"):
        paths = {(): 0.0}
        best = None
        for i in range(len(text)):
            paths = {(*p, c): s + cost for p, s in paths.items() for c, cost in model.options(text, i)}
        for p, s in paths.items():
            codes = [0, 0, *[c for c in p if c], 0]
            total = s + sum(model.log[a, b, c] for a, b, c in zip(codes, codes[1:], codes[2:]))
            word = "".join(toxicity.LETTERS[c - 1] for c in p if c)
            best = max(best or (total, word), (total, word))
        assert model.decode(text) == best[1]


@pytest.fixture(scope="module")
def given_model(spark):
    return toxicity.CharModel(toxicity.char_counts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))


@pytest.mark.parametrize(
    "written, word",
    [("1d10t", "idiot"), ("5cumb4g", "scumbag"), ("idioot", "idiot"), ("iddiiot", "idiot"), ("idiooooot", "idiot"), ("i.d.i.o.t", "idiot"), ("scumbag", "scumbag"), ("$cumb@g", "scumbag"), ("you.idiot", "idiot"), ("hello", "hello")],
)
def test_disguised_tokens_on_the_given_corpus(given_model, written, word):
    assert word in given_model.restore(written)


@pytest.mark.parametrize("run, word", [("a r e i d i o t", "idiot"), ("a i d i o t", "idiot"), ("i d i o t", "idiot"), ("s c u m b a g", "scumbag"), ("y o u i d i o t", "idiot")])
def test_spelled_out_words_on_the_given_corpus(given_model, run, word):
    assert word in given_model.spelled_out(run)


def test_edges_are_the_best_path():
    rng = np.random.default_rng(1)
    model = toxicity.CharModel(rng.integers(0, 50, toxicity.SIDE**3).astype(float))
    for text in ("a b", "1.d", "x-y.z"):
        paths = {(): 0.0}
        for i in range(len(text)):
            more = [(-1, toxicity.LOG_EDGE)] if i and text[i] in toxicity.SEPARATORS else []
            paths = {(*p, c): s + cost for p, s in paths.items() for c, cost in model.options(text, i) + more}
        best = None
        for p, s in paths.items():
            codes = [0, 0, *[max(c, 0) for c in p if c], 0]
            total = s + sum(model.log[a, b, c] for a, b, c in zip(codes, codes[1:], codes[2:]))
            word = "".join(" " if c < 0 else toxicity.LETTERS[c - 1] for c in p if c)
            best = max(best or (total, word), (total, word))
        assert model.decode(text, edges=True) == best[1]


def test_plain_tokens_have_the_places_of_others():
    import pyarrow as pa

    reader = toxicity.Reader(np.random.default_rng(2).integers(0, 9, toxicity.SIDE**3).astype(float))
    rng = random.Random(3)
    tokens = ["".join(rng.choices("abcdeé1.'\"([)]!?", k=rng.randrange(1, 14))) for _ in range(3000)] + ["a" * 40, "abcdefghij" * 4, "x", "-", "(abc", "abc)", "über", "ßß", "aab", "abb", "aabbcc", "éé!", "aaa", "abbba", "日本語"]
    places, counts = reader.tokens(pa.array(tokens, pa.large_string()))
    ends = counts.cumsum()
    for t, e, n in zip(tokens, ends.tolist(), counts.tolist()):
        assert places[e - n : e].tolist() == np.frombuffer(toxicity._places(reader.model.restore(t)), np.int32).tolist(), t


def test_repeated_ids_with_different_labels(spark, fitted):
    docs, labels, plain = fitted
    twice = labels.unionByName(labels.withColumn("toxic", F.lit(0))).unionByName(labels.withColumn("toxic", F.lit(None).cast("int")))
    a, b = toxicity.fit_toxicity(docs, labels), toxicity.fit_toxicity(docs, twice)
    # The greatest label of an id counts, and null is none.
    assert np.array_equal(a.weights, b.weights) and np.allclose(a.beta, b.beta)


def test_grades(spark, fitted):
    docs, labels, plain = fitted
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    model = grades.fit_grades(docs, labels.select("doc_id", grade.alias("grade")), 3)
    assert (np.diff(model.thresholds) > 0).all()
    truth = {i: 0 if not q else 1 if t else 2 for i, q, t in plain}
    out = grades.score_grades(docs, model).where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()
    assert np.mean([(r["tails"][0] >= 0.5) == (truth[r["doc_id"]] > 0) for r in out]) >= 0.95
    by = {g: np.mean([r["expected_grade"] for r in out if truth[r["doc_id"]] == g]) for g in range(3)}
    assert by[0] < by[1] < by[2] and all(r["tails"][0] >= r["tails"][1] for r in out)
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "x " * 50_000)], "doc_id bigint, text string")
    assert grades.score_grades(odd, model).where("expected_grade is null").count() == 0
    empty = grades.fit_grades(docs, labels.limit(0).select("doc_id", F.lit(0).alias("grade")), 3)
    assert grades.score_grades(docs.limit(0), empty).count() == 0


def pii_rows(n=300):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        card = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        card += next(d for d in "0123456789" if brute.luhn(card + d))
        bits = [f"mail a{i}.x@host-{i}.example.org", f"from {i % 300}.1.2.3", f"pay {card} now", f"call +1 (555) {i % 900 + 100}-{i:04d}", f"no {i * 7919} here", "plain words"]
        rows.append((i, " é ".join(rng.sample(bits, 3)), "x"))
    return rows


HARD = [
    "", None, "a@b.c_d@e.f x@y 1.2.3 1.2.3.4.5 256.1.1.1 00010.1.1.1", "+1 2 +123456789 +1234567890123456", "4111 1111 1111 1111 4111-1111-1111-1111",
    "4111  1111 1111 1111", "1 " * 20_000, "9" * 30_000, "a.b@c.d " * 3000, "x" * 60_000 + "@", "+4111111111111111", "é" * 30 + " a@b.co 𝒳 1.1.1.1",
]


def test_base_spans_equal_brute_force(spark):
    rows = [*pii_rows(60), *[(1000 + i, t, "x") for i, t in enumerate(HARD)], (1002, HARD[2], "x"), (None, HARD[2], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    text_of = {r[0]: r[1] for r in rows}
    got = pii.pii_digest(df).collect()
    assert len(got) == len(rows)
    for r in got:
        base = brute.base_spans(text_of[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(b[1] == k for b in base) for k in range(4)], r["doc_id"]
        assert r["base_sha256"] == brute.base_sha256(text_of[r["doc_id"]])
        assert not base or set(brute.span_text(base).split(",")) <= set(r["spans"].split(","))
    assert pii.pii_digest(df.limit(0)).count() == 0
    plan = pii.find_pii(df, pii.Trees(limits={}))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_trees_add_lookalikes_and_redact(spark):
    x = np.random.default_rng(0).integers(0, 6, (3000, len(pii.FEATURES)))
    y = ((x[:, 1] > 2) & (x[:, 9] > 3)).astype(float)
    model = pii.boost(x, y)
    m = pii.margins(model, x)
    assert ((m > 0) == (y > 0)).mean() > 0.98
    limit = pii.calibrate(m, y, 0.9)
    assert y[m >= limit].mean() >= 0.9 and pii.calibrate(m, np.zeros(3000), 0.9) == float("inf")
    row = spark.createDataFrame([([int(v) for v in x[0]],)], "x array<int>").select(F.struct(*[F.col("x")[j].alias(f) for j, f in enumerate(pii.FEATURES)]).alias("f"))
    assert abs(row.select(model.margin(F.col("f"))).first()[0] - m[0]) < 1e-9
    always = pii.Trees(bias=1.0, trees=[0.0], limits={k: 0.0 for k in range(4)})
    df = spark.createDataFrame([(1, "ring 555-123-4567 or bob[at]site[dot]org."), (2, "a@b.co and +1 555 123 4567"), (3, None)], "doc_id bigint, text string")
    out = {r["doc_id"]: r["text"] for r in pii.redact(pii.find_pii(df, always)).collect()}
    assert out == {1: "ring [PHONE] or [EMAIL].", 2: "[EMAIL] and [PHONE]", 3: None}


def test_fitted_trees_add_relaxed_forms(spark):
    """Base rules alone teach masked marks, missing signs and failing checks."""
    docs = spark.createDataFrame(pii_rows(), "doc_id bigint, text string, x string")
    model = pii.fit_pii(docs)
    new = [
        (1, "mail bob[at]site[dot]org now"), (2, "call (555) 123-4567 now"), (3, "from 10[.]1[.]2[.]3 here"), (4, "pay 4111.1111.1111.1111 now"),
        (5, "from 256.1.2.3 here"), (6, "from 256[.]1[.]2[.]3 here"), (7, "pay 4111.1111.1111.1112 now"), (8, "pay 4111111111111112 now"),
    ]
    got = {r["doc_id"]: r["text"] for r in pii.redact(pii.find_pii(spark.createDataFrame(new, "doc_id bigint, text string"), model)).collect()}
    added = {1: "mail [EMAIL] now", 2: "call [PHONE] now", 3: "from [IP] here", 4: "pay [CARD] now"}
    assert got == {**dict(new), **added}


def test_pipeline_stages(spark, tmp_path):
    """Each stage against a plain form, on its own input."""
    rows, labels = corpus(500, 8)
    rng = random.Random(1)
    clean = " ".join(rng.choice(SYLLABLES) + rng.choice(SYLLABLES) for _ in range(60))
    item = " ".join(f"bench{i}" for i in range(20))
    extra = [(9000, clean), (9001, clean + " end"), (9002, clean), (9003, "see " + item + " there"), (9004, "write a1@b2.org or 10.0.0.1 fine"), (9005, None), (9006, "")]
    docs = [(i, t, "en", "s", len(t), i) for i, t, _ in rows] + [(i, t, None, "s", len(t or ""), i) for i, t in extra]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_hit bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, str(tmp_path))
        df.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"]: r for r in df.collect()}
    toxic = {i for i, _, t in labels if t}
    kept = set(seen["toxicity"])
    assert len(kept & toxic) <= 0.1 * len(toxic) and {i for i, _ in extra} <= kept
    assert set(seen["ngram_jaccard"]) & {9000, 9001, 9002} == {9000} and {9005, 9006} <= set(seen["ngram_jaccard"])
    assert set(seen["decontamination"]) == set(seen["ngram_jaccard"]) - {9003}
    r = seen["pii"][9004]
    assert r["n_hit"] == 9004
    assert r["text"] == "write [EMAIL] or [IP] fine" and r["n_chars"] == len(r["text"]) and seen["pii"][9005]["text"] is None
    assert set(seen["packing"]) == set(seen["pii"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["packing"])


def test_thresholds_are_finite_on_the_small_table(spark):
    """82 base spans are enough; real hidden spans are then added."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.fit_pii(docs)
    assert all(np.isfinite(model.limits[k]) for k in (0, 3))
    new = [(1, "Please write to jane.doe[at]example[dot]org today."), (2, "plain text of 2020 and 12.5 percent"), (3, "call (030) 123-4567 now")]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(new, "doc_id bigint, text string"), model).collect()}
    assert [x["k"] for x in got[1]] == [0] and got[2] == []


def test_kind_limits_fall_back_to_all_kinds():
    rows = [(0, 3.0, 1, 200), (0, -3.0, 0, 200), (1, 3.0, 1, 5), (1, -3.0, 0, 5), (2, 3.0, 0, 5), (2, 3.5, 1, 1)]
    limits = pii.kind_limits(np.array(rows, float), 0.9)
    # Few spans of kind 1 agree with the others; those of kind 2 do not; kind 3 has none.
    assert np.isfinite(limits[0]) and limits[1] <= 3.0 and limits[2] == limits[3] == float("inf")
    assert pii.kind_limits(np.zeros((0, 4)), 0.9)[0] == float("inf")
