"""Benchmark decontamination by one Aho-Corasick automaton.

Texts are normalised to words in one pass over their UTF-8 bytes (A-Z to a-z;
every ASCII byte that is neither letter nor digit separates words). The windows
of all items, ten consecutive words each, become the automaton's patterns, and a
document's normalised text is scanned once. Hits are ranges of words; word
numbers lead back to character offsets of the original text.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sievework.llm.common import one_model, pick, slices

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_KEEP = [b for b in range(256) if b > 0x7F or chr(b).isalnum()]
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEEP else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Normalised words of a text, as UTF-8; a null text has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows(text: str | None, n: int = 10) -> list[bytes]:
    """Every run of ``n`` words; a shorter text that has words is one window."""
    w = words(text)
    return [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def automaton(items: list[tuple[int, str | None]], n: int = 10):
    """Automaton whose values are (words of the window, items that hold it)."""
    owners: dict[bytes, set] = {}
    for item, text in items:
        for w in windows(text, n):
            owners.setdefault(w, set()).add(item)
    out = ahocorasick.Automaton()
    for w, ids in owners.items():
        out.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, tuple(ids)))
    out.make_automaton()
    return out


def scan(auto, w: list[bytes]) -> tuple[np.ndarray, set]:
    """(first word, end word) of every hit, and the items hit."""
    line = f" {b' '.join(w).decode('latin-1')} "
    found = list(auto.iter(line)) if len(auto) else []
    if not found:
        return np.zeros((0, 2), np.int64), set()
    # A hit ends at the separator behind its last word; separators before it count the words.
    gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    ends = np.searchsorted(gaps, [end for end, _ in found])
    return np.stack([ends - [v[0] for _, v in found], ends], axis=1), set().union(*[v[1] for _, v in found])


def covered(hits: np.ndarray, n_words: int) -> np.ndarray:
    """Which words lie inside a hit."""
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, hits[:, 0], 1)
    np.add.at(step, hits[:, 1], -1)
    return np.cumsum(step)[:-1] > 0


def original_spans(text: str, inside: np.ndarray) -> list[tuple[int, int]]:
    """Character ranges of the original text that the covered words take up."""
    out: list[tuple[int, int]] = []
    for k, m in enumerate(WORD.finditer(text)):
        if inside[k]:
            if k and inside[k - 1]:
                out[-1] = (out[-1][0], m.end())
            else:
                out.append((m.start(), m.end()))
    return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, str | None]]]:
    """Items in blocks of at most about ``block_bytes`` of text (one item at least)."""
    rows = pick(items, id_col, text_col).withColumn("_b", F.coalesce(F.octet_length("text"), F.lit(0)))
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and size + r["_b"] > block_bytes:
            yield block
            block, size = [], 0
        block.append((r["doc_id"], r["text"]))
        size += r["_b"]
    yield block


def _ready(held):
    """The automaton of a broadcast block."""
    key, blob, n = held.value
    return one_model(("automaton", key), lambda: automaton(pickle.loads(blob), n))


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", n: int = 10, block_bytes: int = 8 << 20
) -> DataFrame:
    """Adds n_words, n_hit, hit_items (sorted as text) and spans (start:end
    character offsets of the original text) to every row of ``docs``.

    A null or empty text has no words and no hits; items that are null or have no
    words have no window. Repeated rows are scanned each. Items larger in total
    than ``block_bytes`` are scanned block by block, so that one automaton stays
    bounded; the marks of the blocks are joined in the row. Columns of ``docs``
    with the names above are replaced, all others stay."""
    spark: SparkSession = docs.sparkSession
    made = {"n_words": "bigint", "n_hit": "bigint", "hit_items": "array<string>", "spans": "array<string>", "_inside": "array<bigint>"}
    out = docs.drop(*made).select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in made.items()])
    blocks = item_blocks(items, item_col, text_col, block_bytes)
    block, first = next(blocks), True
    while block is not None:
        after = next(blocks, None)
        blob = pickle.dumps(block)
        held = spark.sparkContext.broadcast((hashlib.sha256(blob).hexdigest() + str(n), blob, n))
        out = _mark(out, text_col, held, first, after is None)
        block, first = after, False
    return out.drop("_inside")


def _mark(df: DataFrame, text_col: str, held, first: bool, last: bool) -> DataFrame:
    """Joins one block's hits to the columns made so far; the last block's pass also
    turns word ranges into counts and offsets of the original text."""
    at = {c: k for k, c in enumerate(df.columns)}
    kept = ("n_words", "_inside", "hit_items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _ready(held)
        for b in slices(batches, 256):
            old = [(None, None, None)] * b.num_rows if first else list(zip(*[b.column(at[c]).to_pylist() for c in kept]))
            made: dict[str, list] = {c: [] for c in (*kept, "n_hit", "spans")}
            for text, (_, ranges, items) in zip(b.column(at[text_col]), old):
                text = text.as_py()
                w = words(text)
                hits, ids = scan(auto, w)
                if ids:
                    ranges = np.unique(np.concatenate([hits, np.array(ranges or [], np.int64).reshape(-1, 2)]), axis=0).ravel().tolist()
                    items = sorted({*map(str, ids), *(items or [])})
                inside = covered(np.array(ranges, np.int64).reshape(-1, 2), len(w)) if last and ranges else np.zeros(0, bool)
                made["n_words"].append(len(w))
                made["_inside"].append([] if last else ranges or [])
                made["hit_items"].append(items or [])
                made["n_hit"].append(int(inside.sum()) if last else None)
                made["spans"].append([f"{i}:{j}" for i, j in original_spans(text, inside)] if inside.size else [])
            for c, values in made.items():
                b = b.set_column(at[c], b.schema.field(at[c]), pa.array(values, b.schema.field(at[c]).type))
            yield b

    return df.mapInArrow(run, df.schema)


def decontamination_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    out = decontaminate(docs.select("doc_id", "text"), items)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
