import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from sievework.llm import alignment
from sievework.llm.tokens import _byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "a", "The tokenizers disagree about disagreements.", "The tokenizers disagree about disagreements.", "Straße, naïve café — 日本語 😀 x",
    "two  spaces and\ttabs\n", " <|endoftext|> <s> </s> <unk> <0x41> stay text", "▁ odd mark", "ﬁ ligature and ½", "aaaa " * 3000, "\x00\x01 control", "the the the",
    "٣٤ digits", "é combining",
]


def plain(texts):
    """Every row's figures by walking both token lists."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    back = {c: b for b, c in _byte_letters().items()}
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    of_a = lambda i: bytes(back[c] for c in a.id_to_token(i))
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    rows, counts = [], Counter()
    for t in texts:
        ids, ok = ([], []), bool(t)
        if t:
            ids = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            ok = all(b"".join(map(f, x)) == (" " + t).encode() for f, x in ((of_a, ids[0]), (of_b, ids[1])))
        ends = []
        for f, x in ((of_a, ids[0] if ok else []), (of_b, ids[1] if ok else [])):
            at, own = 0, {}
            for i in x:
                at += len(f(i))
                own[at] = i
            ends.append(own)
        links = [(ends[0][e], ends[1][e]) for e in sorted(ends[0].keys() & ends[1].keys())]
        counts.update(links)
        groups, last = [], 0
        for e in sorted(ends[0].keys() & ends[1].keys()):
            groups.append("|".join(",".join(str(i) for at, i in sorted(own.items()) if last < at <= e) for own in ends))
            last = e
        rows.append((ends, links, ";".join(groups)))
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    out = []
    for ends, links, groups in rows:
        best = sum(counts[p] == top[p[1]] for p in links)
        sha = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        out.append((len(ends[0]), len(ends[1]), len(links), len(links), best, sum(counts[p] for p in links), sha))
    return out


def test_digest_equals_walking_both_lists(spark):
    rows = [(i if i != 3 else None, t, 1, "g") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], 2, "h")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n int, batch string").repartition(3)
    got = alignment.alignment_digest(docs, A, B).collect()
    want = [(r[0], *p) for r, p in zip(rows, plain([r[1] for r in rows]))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert alignment.alignment_digest(docs.limit(0), A, B).collect() == []


def test_some_texts_are_refused(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    got = {r.doc_id: r.n_a for r in alignment.alignment_digest(docs, A, B).collect()}
    assert got[0] == got[1] == 0 and got[4] > 0 and got[6] > 0
    # The mark that stands for a space in pieces comes back as one.
    assert got[9] == 0


def test_overlaps_are_all_pairs_that_share_a_byte(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    for r in alignment.alignments(docs, A, B).collect():
        starts = [[0, *e[:-1]] for e in (r.a_ends, r.b_ends)]
        want = []
        if len(r.a_ends) < 200:
            for i, (s, e) in enumerate(zip(starts[0], r.a_ends)):
                want += [(i, j) for j, (x, y) in enumerate(zip(starts[1], r.b_ends)) if x < e and s < y]
            assert list(zip(r.over_a, r.over_b)) == want
        assert bool(r.groups) == bool(r.a_ids)


def test_words_give_the_ids_of_whole_texts():
    rnd = random.Random(2)
    parts = ["don't", "we'll", "x'S", "12345", "3rd", "(a)", "...", "naïve", "Ünder_score", "http://a.b/c?d=1", "\n", "\t", "\u00a0", "日本語", "😀👍🏽", "a\nb", "--", "'", "'s", "\u2028", "É", "#", "\x1c"]
    texts = ["".join(rnd.choice(parts) + rnd.choice(["", " ", " ", " ", "  "]) for _ in range(rnd.randrange(1, 30))) for _ in range(600)]
    texts += [t.strip() for t in texts]
    pair = alignment.Pair(A, B)
    whole = pair.texts(texts)
    got = pair.encode(pa.array(texts))
    for side in (0, 1):
        flat, counts = got[side]
        ends = counts.cumsum()
        for i, w in enumerate(whole):
            want = w[side].tolist() if w and texts[i] else []
            assert flat[ends[i] - counts[i] : ends[i]].tolist() == want, texts[i]


def test_words_that_are_not_spelt_leave_the_others():
    pair = alignment.Pair(A, B)
    texts = ["plain words here", None, "", "odd ▁ mark", " lead", "more words"]
    for side in (0, 1):
        assert [c > 0 for c in pair.encode(pa.array(texts))[side][1]] == [True, False, False, False, True, True]
    assert [c.tolist() for _, c in pair.encode(pa.array([None, ""], pa.string()))] == [[0, 0], [0, 0]]
