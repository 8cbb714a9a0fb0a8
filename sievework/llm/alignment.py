"""Alignment of two tokenizers' tokens over the bytes of one text.

Both token sequences cut the same bytes (a space and the text). In each batch,
``merge_asof`` keyed by document finds for every token start the token of the
other side that covers it; the union of both directions holds every overlapping
pair once or twice. Overlapping pairs that end together are links, and their ends
cut both sequences into groups.

A: byte-level BPE of the tokenizers library over a space and the text. B: a
sentencepiece model, which adds the space itself. Both work on words with the
space before them, so a batch's distinct words are encoded once where white space
stands alone; other texts are encoded whole. Counts of linked id pairs over
the corpus come from the distinct pairs of each batch, so that hot pairs are
summed before they meet, and go back to the batches by a join on the pair.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sievework.llm.common import arrow_rows, byte_slices, pick, release_memory, saved
from sievework.llm.tokens import _byte_letters

BATCH_BYTES = 1 << 20
PAIR_BITS = 32


# White space of any of the two tokenizers. Where two such characters touch, a
# token can reach over a space; elsewhere words with the space before them are
# encoded on their own.
SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# The piece model's own mark for a space is no word character either.
TOUCHING = f"^{SPACE}|{SPACE}{SPACE}|{SPACE}$|^$|\\x{{2581}}"


class Side:
    """A tokenizer and the bytes of each id."""

    def __init__(self, blobs: list[bytes]):
        self.blobs = blobs
        self.sizes = np.array([len(b) for b in blobs], np.int64)
        self.names = np.array([str(i) for i in range(len(blobs))], object)
        self.opens = np.array([b.startswith(b" ") for b in blobs])

    def spells(self, ids: list[int], text: str) -> bool:
        """Whether the ids give back a space and the text, byte by byte."""
        return b"".join(map(self.blobs.__getitem__, ids)) == (" " + text).encode()


class ByteSide(Side):
    def __init__(self, path: str):
        # Spark spreads the work; a worker process stays on its own core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        # Their strings in a text are then plain text.
        self.model.encode_special_tokens = True
        letters = {ord(c): b for b, c in _byte_letters().items()}
        count = self.model.get_vocab_size(with_added_tokens=True)
        super().__init__([self.model.id_to_token(i).translate(letters).encode("latin-1") for i in range(count)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class PieceSide(Side):
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(i, self.model.id_to_piece(i)) for i in range(self.model.get_piece_size())]
        super().__init__([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces])
        # No piece goes on over a space, so words do not change each other.
        self.by_word = not any("▁" in p.lstrip("▁") for _, p in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _gather(pool: np.ndarray, sizes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The pool's runs number ``code``, one after another."""
    at = np.cumsum(sizes) - sizes
    n = sizes[code]
    ends = np.cumsum(n)
    return pool[np.arange(int(n.sum())) + np.repeat(at[code] - ends + n, n)]


class Pair:
    """Both tokenizers."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteSide(path_a), PieceSide(path_b)

    def texts(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides for whole texts; None where a side does not spell it."""
        out = []
        for t, a, b in zip(texts, self.a.encode(texts), self.b.encode(texts)):
            good = self.a.spells(a, t) and self.b.spells(b, t)
            out.append((np.array(a, np.int64), np.array(b, np.int64)) if good else None)
        return out

    def words(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """(all ids, ids of each word) of both sides, from texts of many words: a
        token that begins with a space begins the next word. None where a side
        does not spell them."""
        # Short texts: merging in the piece model costs more than in proportion.
        joined = [" ".join(words[i : i + 128]) for i in range(0, len(words), 128)]
        out = []
        for side in (self.a, self.b):
            ids = side.encode(joined)
            if not all(map(side.spells, ids, joined)):
                return None
            flat = np.array([i for x in ids for i in x], np.int64)
            out.append((flat, np.bincount(np.cumsum(side.opens[flat]) - 1, minlength=len(words))))
        return out

    def encode(self, texts: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """(all ids, ids of each text) of both sides; texts that are null or empty
        or that a side does not spell have none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        hard = pc.match_substring_regex(texts, TOUCHING).to_numpy(zero_copy_only=False) | (not self.b.by_word)
        easy = texts.filter(pa.array(~hard))
        lists = pc.split_pattern(easy, " ")
        coded = lists.flatten().dictionary_encode()
        found = self.words(coded.dictionary.to_pylist()) if len(coded) else None
        if found is None:
            # No word, or one of them is not spelt: all texts are taken whole.
            hard[:] = True
        whole = self.texts(texts.filter(pa.array(hard)).to_pylist())
        counts = [np.zeros(hard.size, np.int64) for _ in range(2)]
        out = []
        for side in (0, 1):
            counts[side][hard] = [len(x[side]) if x else 0 for x in whole]
            flat = np.zeros(0, np.int64)
            if found is not None:
                pool, sizes = found[side]
                code, offsets = coded.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
                counts[side][~hard] = np.diff(np.concatenate([[0], np.cumsum(sizes[code])])[offsets])
                flat = _gather(pool, sizes, code)
            own = np.repeat(hard, counts[side])
            ids = np.empty(own.size, np.int64)
            ids[~own], ids[own] = flat, np.concatenate([x[side] for x in whole if x] or [flat[:0]])
            out.append((ids, counts[side]))
        return out[0], out[1]


@lru_cache(maxsize=2)
def sides(path_a: str, path_b: str) -> Pair:
    """Both tokenizers, once for each worker process."""
    return Pair(path_a, path_b)


class Tokens:
    """All tokens of a batch on one side: text, id, start and end; places count on
    from text to text, so that they ascend over the whole batch."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, side: Side, base: np.ndarray):
        self.id, self.counts = ids, counts
        self.doc = np.repeat(np.arange(counts.size), counts)
        size = side.sizes[self.id]
        ends = np.cumsum(size)
        heads = np.concatenate([[0], ends])[np.cumsum(self.counts) - self.counts]
        self.end = ends + np.repeat(base - heads, self.counts)
        self.start = self.end - size

    def frame(self, name: str) -> pd.DataFrame:
        return pd.DataFrame({"doc": self.doc, "at": self.start, name: np.arange(self.id.size)})


def overlaps(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all overlapping tokens (a, b), ascending."""
    own, other = a.frame("a"), b.frame("b")
    ahead = pd.merge_asof(own, other, on="at", by="doc")
    back = pd.merge_asof(other, own, on="at", by="doc")
    pairs = np.concatenate([ahead["a"].to_numpy() * b.id.size + ahead["b"].to_numpy(), back["a"].to_numpy() * b.id.size + back["b"].to_numpy()])
    pairs = np.sort(pairs)
    pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if pairs.size else pairs
    return pairs // max(1, b.id.size), pairs % max(1, b.id.size)


class Aligned:
    """Tokens, overlaps, links and groups of a batch of texts."""

    def __init__(self, texts: pa.Array, pair: Pair):
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        self.base = np.cumsum(sizes) - sizes
        of_a, of_b = pair.encode(texts)
        self.a, self.b = Tokens(*of_a, pair.a, self.base), Tokens(*of_b, pair.b, self.base)
        self.over_a, self.over_b = overlaps(self.a, self.b)
        together = self.a.end[self.over_a] == self.b.end[self.over_b]
        self.link_a, self.link_b = self.over_a[together], self.over_b[together]
        self.link_doc = self.a.doc[self.link_a]
        ends = self.a.end[self.link_a]
        cut = np.r_[True, ends[1:] != ends[:-1]] if ends.size else np.zeros(0, bool)
        self.ends = ends[cut]
        self.n_groups = np.bincount(self.link_doc[cut], minlength=len(texts))
        self.n_links = np.bincount(self.link_doc, minlength=len(texts))
        self.names = pair.a.names, pair.b.names

    def group_texts(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        group = [np.searchsorted(self.ends, t.end) for t in (self.a, self.b)]
        # Tokens of a group in a row: first those of A, then those of B.
        key = np.concatenate([2 * group[0], 2 * group[1] + 1])
        order = np.argsort(key, kind="stable")
        names = np.concatenate([self.names[0][self.a.id], self.names[1][self.b.id]])[order]
        key, doc = key[order], np.concatenate([self.a.doc, self.b.doc])[order]
        marks = np.full(key.size, ",", object)
        new = np.flatnonzero(key[1:] != key[:-1])
        marks[new] = np.where(key[new] % 2 == 0, "|", ";")
        marks[np.flatnonzero(np.diff(doc))] = ""
        marks[-1:] = ""
        parts = (names + marks).tolist()
        at = np.searchsorted(doc, np.arange(self.n_groups.size + 1)).tolist()
        return ["".join(parts[i:j]) for i, j in zip(at[:-1], at[1:])]


ALIGNMENT = (
    "doc_id bigint, a_ids array<int>, b_ids array<int>, a_ends array<bigint>, b_ends array<bigint>, "
    "over_a array<int>, over_b array<int>, groups string"
)


def _lists(doc: np.ndarray, texts: int, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    bounds = np.searchsorted(doc, np.arange(texts + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(bounds, pa.array(values, kind))


def alignments(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a text: ids and end bytes of both sides' tokens, the numbers of all
    overlapping pairs of tokens (``over_a``, ``over_b``, from 0 in each text), and
    the groups as text.

    Bytes count from the space before the text. Texts that are null or empty, or
    that a side does not give back byte by byte, have no tokens. Rows with a null
    id keep it and repeated rows are all answered; other columns are not read. A
    text is worked on whole; short texts share a batch of bounded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = sides(path_a, path_b)
        for batch in byte_slices(batches, "text", BATCH_BYTES):
            got, n = Aligned(batch.column("text"), pair), batch.num_rows
            first = [np.cumsum(t.counts) - t.counts for t in (got.a, got.b)]
            over = got.a.doc[got.over_a]
            yield arrow_rows(
                ALIGNMENT,
                [
                    batch.column("doc_id"),
                    _lists(got.a.doc, n, got.a.id, pa.int32()),
                    _lists(got.b.doc, n, got.b.id, pa.int32()),
                    _lists(got.a.doc, n, got.a.end - got.base[got.a.doc], pa.int64()),
                    _lists(got.b.doc, n, got.b.end - got.base[got.b.doc], pa.int64()),
                    _lists(over, n, got.over_a - first[0][over], pa.int32()),
                    _lists(over, n, got.over_b - first[1][over], pa.int32()),
                    got.group_texts(),
                ],
            )

    return pick(docs, id_col, text_col).mapInArrow(run, ALIGNMENT)


BATCHES = (
    "batch bigint, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
    "digests array<string>, links binary, pairs array<bigint>, times array<bigint>"
)


def _batches(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row a batch of texts: figures of each text, its links as numbers among
    the batch's distinct id pairs (b above a), and how often each pair is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = sides(path_a, path_b)
        batch_id = TaskContext.get().partitionId() << 32
        for batch in byte_slices(batches, "text", BATCH_BYTES):
            got = Aligned(batch.column("text"), pair)
            linked = got.b.id[got.link_b] << PAIR_BITS | got.a.id[got.link_a]
            pairs, links, times = np.unique(linked, return_inverse=True, return_counts=True)
            digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in got.group_texts()]
            lists = [batch.column("doc_id").to_pylist(), got.a.counts, got.b.counts, got.n_groups, got.n_links, digests]
            yield arrow_rows(BATCHES, [[batch_id], *[[x] for x in lists], [links.astype("<u4").tobytes()], [pairs], [times]])
            batch_id += 1

    return docs.mapInArrow(run, BATCHES)


def pair_counts(batches: DataFrame) -> DataFrame:
    """(pair, n, best): how many links hold each id pair, and whether that is the
    highest count of its B id (ties included)."""
    each = batches.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    b = F.shiftrightunsigned("pair", PAIR_BITS).alias("b")
    top = counts.groupBy(b).agg(F.max("n").alias("top"))
    return counts.withColumn("b", b).join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


DIGEST = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


TOLD = "batch bigint, n array<bigint>, best array<boolean>"
TASK_BATCHES = 16


def _told(rows: DataFrame) -> DataFrame:
    """TOLD from (batch, at, n, best) rows in that order: one row a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def row() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            lists = [pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column(c).combine_chunks()) for c in ("n", "best")]
            return arrow_rows(TOLD, [[t.column("batch")[0].as_py()], *lists])

        for b in batches:
            own = b.column("batch").to_numpy()
            ends = [*(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), b.num_rows]
            for at, end in zip([0, *ends], ends):
                if at == end:
                    continue
                if held and held[0].column("batch")[0].as_py() != int(own[at]):
                    yield row()
                    held = []
                held.append(b.slice(at, end - at))
        if held:
            yield row()

    return rows.select("batch", "at", "n", "best").mapInArrow(run, TOLD)


def alignment_digest(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Figures of every text's alignment, with counts of its linked id pairs over
    all texts. Nulls, repeated rows and other columns are as in ``alignments``."""
    batches = saved(_batches(pick(docs, id_col, text_col), path_a, path_b), "alignment", wide=True)
    counts = saved(pair_counts(batches), "pair-counts")
    asked = batches.select("batch", F.posexplode("pairs").alias("at", "pair"))
    # A task holds a bounded number of batches, each of megabytes, however large the
    # session lets its tasks be.
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(batches.count() / TASK_BATCHES))
    # One small answer for each batch: its pairs' counts in their own order, put in
    # order by a sort that can spill, not gathered in lists of the heap.
    told = _told(asked.join(counts, "pair").select("batch", "at", "n", "best").repartition(tasks, "batch").sortWithinPartitions("batch", "at"))
    both = batches.drop("pairs", "times").repartition(tasks, "batch").join(told.repartition(tasks, "batch").hint("merge"), "batch", "left")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in rows:
            for i in range(group.num_rows):
                row = {c: group.column(c)[i] for c in group.schema.names}
                flat = {c: row[c].values.to_numpy(zero_copy_only=False) for c in ("n_a", "n_b", "n_groups", "n_links")}
                links = np.frombuffer(row["links"].as_py(), "<u4")
                doc = np.repeat(np.arange(flat["n_links"].size), flat["n_links"])
                sums = [np.zeros(flat["n_links"].size, np.int64) for _ in range(2)]
                if links.size:
                    for out, c in zip(sums, ("best", "n")):
                        np.add.at(out, doc, row[c].values.to_numpy(zero_copy_only=False).astype(np.int64)[links])
                yield arrow_rows(DIGEST, [row["doc_ids"].values, *flat.values(), *sums, row["digests"].values])
        release_memory()

    return both.select("doc_ids", "n_a", "n_b", "n_groups", "n_links", "digests", "links", "n", "best").mapInArrow(run, DIGEST)
