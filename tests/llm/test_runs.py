import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from sievework.llm import runs

DOCS = "doc_id bigint, text string, n_words string, _r int, periods double"


def plain_runs(w):
    """(start, length, period) by trying every period at every place."""
    found = {}
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - p:
            j = i
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_words(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def plain_digest(doc_id, text):
    w = plain_words(doc_id, text)
    got = plain_runs(w)
    best = max(got, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    gone = {i for s, n, p in got for i in range(s + p, s + n)}
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in got)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if got else None
    return (doc_id, len(got), *best, milli, sha(lines), sha(kept))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.lists(st.integers(1, 2), max_size=40), st.builds(lambda u, k, t: (u * k + t)[:90], st.lists(st.integers(1, 3), min_size=1, max_size=5), st.integers(1, 12), st.lists(st.integers(1, 3), max_size=4))), max_size=6))
def test_runs_of_a_batch(texts):
    sizes = np.array([len(t) for t in texts], np.int64)
    words = np.array([x for t in texts for x in t], np.int64)
    got = list(zip(*[c.tolist() for c in runs.find_runs(words, sizes)]))
    assert got == [(i, *r) for i, t in enumerate(texts) for r in plain_runs(t)]


def test_extensions_equal_plain_compare():
    rng = np.random.default_rng(3)
    texts = [rng.integers(1, 3, n) for n in (1, 40, 200)] + [np.tile([1, 2, 1], 50)]
    words = np.concatenate([np.append(t, 0) for t in texts])
    ext = runs.Extensions(words, np.repeat(np.arange(4), [t.size + 1 for t in texts]))
    base = 0
    for t in texts:
        i, j = np.triu_indices(t.size, 1)
        want = []
        for a, b in zip(i.tolist(), j.tolist()):
            n = 0
            while b + n < t.size and t[a + n] == t[b + n]:
                n += 1
            want.append(n)
        assert ext.lce(i + base, j + base).tolist() == want
        base += t.size + 1


def test_digest_of_odd_rows(spark):
    rnd = random.Random(7)
    vocabulary = ["aa", "b", "ünï", "日本", "x" * 50, " ", " y"]
    rows = [(None, "a " * 20), (None, None), (1, None), (2, ""), (3, " \t\r\n\x0b\x0c "), (3, "a b " * 9), (3, "a b " * 9), (4, "a " * 5), (5, "  a a a a a a"), (6, "k " * 3000)]
    rows += [(i, " ".join(rnd.choices(vocabulary, k=rnd.randrange(0, 60)))) for i in range(10, 150)]
    rows.append((4000, " ".join(map(str, range(3000))) + " " + "u v w " * 400))
    docs = spark.createDataFrame([(d, t, "z", 1, 0.5) for d, t in rows], DOCS)
    got = runs.run_digest(runs.with_planted_runs(docs)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((plain_digest(d, t) for d, t in rows), key=str)
    assert runs.run_digest(runs.with_planted_runs(docs.limit(0))).collect() == []


def test_operator_keeps_texts(spark):
    docs = spark.createDataFrame([(1, "so no no no no no no end"), (2, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in runs.periodic_runs(docs).collect()}
    assert (got[1].starts, got[1].lengths, got[1].periods, got[1].collapsed) == ([1], [6], [1], "so no end")
    assert (got[2].n_words, got[2].starts, got[2].collapsed) == (0, [], "")


def test_equal_powers_take_the_first(spark):
    text = "a a a a a a x b b b b b b y c d c d c d c d c d c d"
    row = runs.run_digest(spark.createDataFrame([(3, text)], "doc_id bigint, text string")).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (3, 0, 6, 1, 6000)
