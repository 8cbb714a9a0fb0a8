import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from sievework.llm import packing, token_store
from sievework.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
ENC = Encoder(PATH, room=50)
LIB = Tokenizer.from_file(PATH)
TEXTS = [
    "", None, "  ", "It's I'LL DON'T 'STAND <|endoftext|>x a<|startoftext|>", "日本 語x　y z İI ΣΑΣ", "a\x85b\x1cc d", "1²³½ µ ª º ÷×",
    "Ünï̈cödé", "don’t “x”", "'''s ''ll .,;!! a.b-c_d 3.14", "É" * 100, "naïve Àà ÿŸ", "x" * 5000, "word " * 6000,
]


def ids_of(text):
    return [*LIB.encode(text or "", add_special_tokens=False).ids]


def test_batch_equals_library_also_on_slices():
    array = pa.array(TEXTS * 2).slice(3, 20)
    flat, counts = ENC.batch(array)
    at = 0
    for text, n in zip(array.to_pylist(), counts.tolist()):
        assert flat[at : at + n].tolist() == ids_of(text), text
        at += n
    assert ENC.batch(pa.array([], pa.string()))[0].size == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBé'’ .!1\n\t<|xs日́À"), max_size=40))
def test_any_text_equals_library(text):
    assert ENC.batch(pa.array([text, "plain text."]))[0].tolist() == ids_of(text) + ids_of("plain text.")
    assert np.frombuffer(ENC.ids(text), "<u4").tolist() == ids_of(text)


@given(st.lists(st.integers(0, 2**32 - 1), max_size=1500))
@settings(max_examples=40, deadline=None)
def test_codes_round_trip_and_random_access(values):
    ids = np.array(values, np.uint32)
    block = token_store.dac_encode(ids)
    assert token_store.dac_decode(block).tolist() == values
    for at in range(0, len(values), max(1, len(values) // 50)):
        assert token_store.dac_get(block, at) == values[at]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, shard string, piece string")


def test_token_files(spark, tmp_path):
    rows = [(i, t, "s", "p") for i, t in zip([5, 3, 3, None, 9, 1, 2, 4, 6, 7, 8, 10, 11, 12], TEXTS)]
    path = str(tmp_path / "tokens")
    token_store.write_tokens(frame(spark, rows), PATH, path, block_ids=4000)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) for r in token_store.read_tokens(spark, path).collect())
    assert [g[1] for g in got][1:] == sorted(g[1] for g in got[1:]) and got[0][1] is None
    at = 0
    for start, _, n, ids in got:
        assert start == at and n == len(ids) and ids[-1] == 1
        at += n
    assert sorted(g[3][:-1] for g in got) == sorted(ids_of(t) for t in TEXTS)
    first = spark.read.parquet(path).orderBy("shard", "block").first()
    assert token_store.token_at(spark, path, first["shard"], first["block"], 0) == got[0][3][0]
    empty = str(tmp_path / "none")
    token_store.write_tokens(frame(spark, []), PATH, empty)
    assert token_store.read_digests(spark, empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    cap = [64, 100, 4096][seed % 3]
    sizes, counts = np.unique(rng.integers(1, cap + 1, 400) if seed < 3 else (rng.pareto(1.0, 2000) * cap / 50 + 1).astype(int).clip(1, cap), return_counts=True)
    have = {int(s): int(c) for s, c in zip(sizes, counts)}
    plan = packing.plan_bins(have, cap)
    used = {}
    for bins, items in plan:
        assert bins > 0 and sum(s * m for s, m in items) <= cap
        for s, m in items:
            used[s] = used.get(s, 0) + bins * m
    assert used == have
    bound = -(-sum(s * c for s, c in have.items()) // cap)
    big = sum(c for s, c in have.items() if 2 * s > cap)
    assert sum(b for b, _ in plan) <= max(bound, big) * 1.15 + 2


def test_packing(spark):
    rows = [(i, t, "s", "p") for i, t in zip([5, 3, 3, None, 9, 1, 2, 4, 6, 7, 8, 10, 11, 12], TEXTS)] + [(100 + i, "same text", None, None) for i in range(50)]
    got = packing.pack_documents(frame(spark, rows), PATH).collect()
    whole = {}
    for r in got:
        if r["doc_id"] not in (3, None):
            whole.setdefault(r["doc_id"], []).append(r)
    for i, t, _, _ in rows:
        if i in (3, None):
            continue
        ids = np.array(ids_of(t) + [1], "<u4")
        pieces = sorted(whole[i], key=lambda r: r["piece"])
        assert [(r["start"], r["length"], r["ids_crc32"]) for r in pieces] == [
            (a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for a in range(0, len(ids), 4096)
        ]
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends.get(r["sequence_id"], 0) == r["offset"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096 and len(ends) == -(-sum(r["length"] for r in got) // 4096)
    assert packing.pack_documents(frame(spark, []), PATH).count() == 0
