"""Copies, chunks, merges and redaction against brute force."""

import random
from collections import Counter

from pyspark.sql import functions as F

from sievework.operators import text as T, tokenizer as B
from sievework.session import table


def corpus():
    rng = random.Random(11)
    vocab = [f"word{i}" for i in range(400)]
    docs = [" ".join(rng.choice(vocab) for _ in range(120)) for _ in range(12)]
    base = docs[0].split()
    for j in range(30):  # one hot group: a third of the rows are near copies
        c = list(base)
        c[j * 4] = f"edit{j}"
        docs.append(" ".join(c))
    docs += docs[1:4] + ["", "", "tiny text"]
    return docs


def shingles(t, n=5):
    w = t.lower().split()
    return frozenset(" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def test_dedup_near_equals_brute_force(spark):
    docs = corpus()
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.canonical for r in T.dedup_near(d, "doc_id", "text").collect()}
    sets = [shingles(t) for t in docs]
    near = lambda a, b: a == b or (a and b and len(a & b) / len(a | b) >= 0.8)
    want = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if near(sets[i], sets[j]):
                a, b = sorted((want[i], want[j]))
                want = [a if w == b else w for w in want]
    assert len(got) == len(docs)
    assert got == dict(enumerate(want))


def test_chunks_resolve_to_text(spark, sf):
    d = table(spark, sf, "documents")
    c = T.chunk(d, "doc_id", "text", "v1", 20, 5).join(d.select("doc_id", F.col("text").alias("whole")), "doc_id")
    assert c.where("substring(whole, start + 1, length) <> text").count() == 0
    assert c.where("tokens > 20").count() == 0
    assert c.select("chunk_id").distinct().count() == c.count()


def test_redaction_keeps_allowed_and_bad_cards(spark):
    rows = [(1, "a.b@x.com and 10.0.0.1 and 10.0.0.2"), (2, "card 4539578763621486 not 4539578763621487"), (3, 'token = "0123456789abcdef0123" 1 (212) 555-0199')]
    out = {r.id: r.text for r in T.redact_pii(spark.createDataFrame(rows, "id int, text string"), "id", "text", allow=["10.0.0.2"]).collect()}
    assert out[1] == "<EMAIL> and <IPV4> and 10.0.0.2"
    assert out[2] == "card <CARD> not 4539578763621487"
    assert out[3] == "<SECRET> <PHONE>"


def test_bpe_equals_brute_force(spark):
    text = ["low lower lowest low", "new newer newest aaa", "wide wider a+b a+b"]
    got = B.train_bpe(spark.createDataFrame([(t,) for t in text], "text string"), "text", 6, every=2)
    vocab = Counter(w for t in text for w in t.split())
    words = {w: list(w) for w in vocab}
    want = []
    for _ in range(6):
        pairs = Counter()
        for w, p in words.items():
            for x in zip(p, p[1:]):
                pairs[x] += vocab[w]
        best = min(pairs, key=lambda x: (-pairs[x], x))
        if pairs[best] < 2:
            break
        want.append((*best, pairs[best]))
        for w, p in words.items():
            q, i = [], 0
            while i < len(p):
                if tuple(p[i : i + 2]) == best:
                    q.append(p[i] + p[i + 1])
                    i += 2
                else:
                    q.append(p[i])
                    i += 1
            words[w] = q
    assert got == want
    f = B.fertility(spark.createDataFrame([("x", t) for t in text], "lang string, text string"), "text", "lang", [(a, b) for a, b, _ in got]).first()
    assert f["broken_words"] == 0 and f["pieces_per_word"] < f["chars_per_word"]
