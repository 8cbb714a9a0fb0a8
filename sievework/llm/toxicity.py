"""Toxicity of texts behind leetspeak, spacing and repetition.

Noisy channel: a written token is a lattice of what each character may stand for
(itself, a letter it imitates, or nothing, for separators, decoration and
stretched letters; a separator may also be a word's edge). A Viterbi search under
a character trigram model picks the likeliest intended words; the written form
counts too. The trigram model counts every character of the corpus;
its alphabet is fixed, so its size is too. Restored words and their beginnings
are hashed to ``BUCKETS`` places; labelled documents give every place a weight
(smoothed log odds of toxic against clean documents), and a logistic model over
a few sums of a document's weights, fitted on another part of the labels, gives
the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from sievework.llm.common import arrow_rows, one_model, pick, slices

LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
SIDE = 64
_LATIN = np.array([CODE.get(chr(b).lower(), 0) for b in range(256)], np.int64)
BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
WINDOW = range(4, 11)

# fixed values: letters that digits and marks imitate in leetspeak
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "*": "aeiou", "#": "aeiou",
}
SEPARATORS = frozenset(" ._-~'`·,/\\")
LOG_SAME, LOG_LEET, LOG_MASK, LOG_DROP, LOG_SEPARATOR, LOG_STRETCH, LOG_EDGE = np.log([0.95, 0.5, 0.1, 0.01, 0.5, 0.2, 0.2]).tolist()
# A character that imitates letters is seldom mere decoration.
LOG_LOST = float(np.log(1e-8))
SPACED = re.compile(r"(?<!\S)\S(?:[ ._-]\S){3,}(?!\S)")
EDGE = re.compile(r"^[^\w@$€|+(<]+|[^\w@$]+$")
WORDLIKE = re.compile(r"[^\W\d_]+")
DOUBLED = re.compile(r"(.)\1")
INNER = re.compile(r"\w[ ._~'`·,/\\-]+\w")
# Tokens of Latin letters, as Arrow reads them; EDGE would cut the same marks.
LATIN = "a-zß-öø-ÿ"
PLAIN = rf"""^["'\[{{]*([{LATIN}]+)[.,;:!?)\]}}"']*$"""
PLAIN_LETTERS = 32


class CharModel:
    """Add-one trigram model over LETTERS; code 0 is a word's edge."""

    def __init__(self, counts: np.ndarray):
        table = counts.reshape(SIDE, SIDE, SIDE) + 0.05
        self.log = np.log(table / table.sum(axis=2, keepdims=True))
        self.flat = self.log.ravel().tolist()

    def options(self, text: str, i: int) -> list[tuple[int, float]]:
        """(code, log probability) of what text[i] may stand for; code 0 drops it."""
        c = text[i]
        out = []
        if c in CODE:
            out.append((CODE[c], LOG_SAME))
        if c in LEET:
            each = LOG_MASK if len(LEET[c]) > 2 else LOG_LEET
            out += [(CODE[x], each) for x in LEET[c]]
        if i and c == text[i - 1] and c in CODE:
            out.append((0, LOG_STRETCH))
        elif c not in CODE:
            out.append((0, LOG_SEPARATOR if c in SEPARATORS else LOG_LOST if c in LEET else LOG_DROP))
        return out

    def decode(self, text: str, edges: bool = False) -> str:
        """Likeliest intended word of a written token (Viterbi, time in proportion
        to the length). With ``edges`` a separator may also end a word: the result
        is then one or more words."""
        flat = self.flat
        best = {(0, 0): 0.0}
        back: list[dict] = []
        for i in range(len(text)):
            options = self.options(text, i)
            if edges and i and text[i] in SEPARATORS:
                options.append((-1, LOG_EDGE))
            nxt: dict[tuple[int, int], float] = {}
            step: dict[tuple[int, int], tuple] = {}
            for state, score in best.items():
                at = (state[0] * SIDE + state[1]) * SIDE
                for code, cost in options:
                    if code:
                        letter = max(code, 0)
                        to, s = (state[1], letter), score + cost + flat[at + letter]
                    else:
                        to, s = state, score + cost
                    if to not in nxt or s > nxt[to]:
                        nxt[to] = s
                        step[to] = (state, code)
            best = nxt
            back.append(step)
        state = max(best, key=lambda s: best[s] + flat[(s[0] * SIDE + s[1]) * SIDE])
        out = []
        for step in reversed(back):
            state, code = step[state]
            if code:
                out.append(" " if code < 0 else LETTERS[code - 1])
        return "".join(reversed(out))

    def restore(self, token: str) -> list[str]:
        """The words that a lower-case token may stand for, as written first."""
        core = EDGE.sub("", token)
        if not any(c in CODE for c in token) or (WORDLIKE.fullmatch(core) and not DOUBLED.search(core)):
            return [core]
        words = [core, self.decode(core)]
        if INNER.search(core):
            words += self.decode(core, edges=True).split()
        return list(dict.fromkeys(words))

    def spelled_out(self, run: str) -> list[str]:
        """The words behind a run of single characters with marks between them: as
        one word, cut where edges are likeliest, and the words of ``WINDOW`` letters
        that start at any letter, since one-letter words before a word leave its
        border open."""
        whole = self.decode(run)
        inside = [whole[i : i + n] for i in range(len(whole)) for n in WINDOW if i + n <= len(whole)]
        return list(dict.fromkeys([whole, *self.decode(run, edges=True).split(), *inside]))


def char_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts over every character of every text, added up on Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIDE**3, np.int64)
        for b in slices(batches, 256):
            joined = "  ".join(x for x in b.column(0).to_pylist() if x)
            code = _LATIN[np.frombuffer(f"  {joined}  ".encode("latin-1", "replace"), np.uint8)]
            total += np.bincount(code[:-2] * SIDE * SIDE + code[1:-1] * SIDE + code[2:], minlength=SIDE**3)
        at = np.flatnonzero(total)
        if at.size:
            yield arrow_rows("gram int, n bigint", [at.astype(np.int32), total[at]])

    rows = docs.select("text").mapInArrow(run, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SIDE**3)
    for r in rows:
        out[r["gram"]] = r["n"]
    return out


def _places(words: list[str]) -> bytes:
    """Hash places of words and of their beginnings, as packed 32-bit integers."""
    found: list[int] = []
    for word in words:
        found.append(crc32(b"=" + word.encode("utf-8", "replace")))
        found += [crc32(b"^" + word[:n].encode("utf-8", "replace")) for n in PREFIXES if len(word) >= n]
    return np.array([f % BUCKETS for f in found], np.int32).tobytes()


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def _step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _CRC[(state ^ byte) & 255] ^ (state >> 8)


def _plain_places(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of ``_places`` for Latin words, all at once: one row a word, -1
    where it is too short. data: their letters in Latin-1, one after another."""
    data = np.concatenate([data, np.zeros(PLAIN_LETTERS, np.uint8)])
    at = np.cumsum(size) - size
    hashes = [np.full(size.size, ~np.uint32(crc32(head)), np.uint32) for head in (b"=", b"^")]
    out = np.full((size.size, 1 + len(PREFIXES)), -1, np.int64)
    for j in range(int(size.max()) if size.size else 0):
        byte = data[at + j]
        wide = byte > 127
        for k, state in enumerate(hashes):
            if k and j >= PREFIXES[-1]:
                continue
            # A letter above 127 is two bytes of UTF-8.
            new = _step(np.where(wide, _step(state, 0xC0 | byte >> 6), state), np.where(wide, 0x80 | byte & 0x3F, byte))
            hashes[k] = np.where(j < size, new, state)
        if j + 1 in PREFIXES:
            out[:, 1 + PREFIXES.index(j + 1)] = np.where(size > j, (~hashes[1] % np.uint32(BUCKETS)).astype(np.int64), -1)
    out[:, 0] = ~hashes[0] % np.uint32(BUCKETS)
    return out


def undouble(model: CharModel, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(changed words, their letters, their sizes) of Latin words without a letter
    three times in a row, where dropping doubled letters is likelier. A doubled
    letter is a lattice of two ways that meet again one letter later, so each one
    is decided by its neighbours alone; the result is ``decode``'s."""
    word = np.repeat(np.arange(size.size), size)
    twin = np.flatnonzero((data[1:] == data[:-1]) & (word[1:] == word[:-1])) + 1
    code = np.concatenate([[0, 0], _LATIN[data], [0]])
    own = np.concatenate([[-1, -1], word, [-1]])
    near = lambda i, w: np.where(own[i + 2] == w, code[i + 2], 0)
    w, b = word[twin], code[twin + 2]
    before, after = near(twin - 2, w), near(twin + 1, w)
    keep = model.log[before, b, b] + model.log[b, b, after] + LOG_SAME
    drop = model.log[before, b, after] + LOG_STRETCH
    gone = twin[drop > keep]
    changed = np.unique(word[gone])
    left = np.isin(word, changed)
    left[gone] = False
    return changed, data[left], np.bincount(word[left], minlength=size.size)[changed]


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if x.size else x


class Reader:
    """Distinct hash places of texts, with a bounded cache of disguised tokens."""

    def __init__(self, counts: np.ndarray):
        model = CharModel(counts)
        self.model = model
        self.places = lru_cache(60_000)(lambda token: _places(model.restore(token)))

    def tokens(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place, number of places) token by token."""
        core = pc.replace_substring_regex(tokens, PLAIN, r"\1")
        plain = pc.match_substring_regex(core, f"^[{LATIN}]{{1,{PLAIN_LETTERS}}}$").to_numpy(zero_copy_only=False).copy()
        words = core.filter(pa.array(plain))
        size = pc.utf8_length(words).to_numpy().astype(np.int64)
        data = np.frombuffer("".join(words.to_pylist()).encode("latin-1"), np.uint8)
        word = np.repeat(np.arange(size.size), size)
        three = (data[2:] == data[1:-1]) & (data[2:] == data[:-2]) & (word[2:] == word[:-2]) if data.size > 2 else np.zeros(0, bool)
        hard = np.zeros(size.size, bool)
        hard[word[2:][three]] = True
        plain[np.flatnonzero(plain)[hard]] = False
        data, size = data[~hard[word]], size[~hard]
        own = _plain_places(data, size)
        changed, letters, sizes = undouble(self.model, data, size)
        more = np.full(own.shape, -1, np.int64)
        more[changed] = _plain_places(letters, sizes)
        both = np.concatenate([own, more], axis=1)
        other = [self.places(t) for t in tokens.filter(pa.array(~plain)).to_pylist()]
        counts = np.zeros(len(tokens), np.int64)
        counts[plain], counts[~plain] = (both >= 0).sum(1), [len(x) // 4 for x in other]
        mine = np.repeat(plain, counts)
        out = np.empty(mine.size, np.int64)
        out[mine], out[~mine] = both[both >= 0], np.frombuffer(b"".join(other), np.int32)
        return out, counts

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place) pairs without repeats, and the tokens of every row."""
        low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        lists = pc.utf8_split_whitespace(low)
        coded = lists.flatten().dictionary_encode()
        places, counts = self.tokens(coded.dictionary)
        n = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(texts), dtype=np.int64), n)
        pairs = _distinct(row * (len(coded.dictionary) + 1) + coded.indices.to_numpy())
        row, token = pairs // (len(coded.dictionary) + 1), pairs % (len(coded.dictionary) + 1)
        each = counts[token]
        first = (np.cumsum(counts) - counts)[token]
        ends = np.cumsum(each)
        own = places[np.arange(int(each.sum())) + np.repeat(first - ends + each, each)]
        keys = [np.repeat(row, each) * BUCKETS + own]
        spaced = pc.match_substring_regex(low, r"(^|\s)\S([ ._-]\S){3}")
        for i in np.flatnonzero(spaced.to_numpy(zero_copy_only=False)).tolist():
            for m in SPACED.finditer(low[i].as_py()):
                keys.append(i * BUCKETS + np.frombuffer(_places(self.model.spelled_out(m.group())), np.int32).astype(np.int64))
        pairs = _distinct(np.concatenate(keys))
        return pairs // BUCKETS, pairs % BUCKETS, n


def row_features(row: np.ndarray, weight: np.ndarray, rows: int, n: np.ndarray) -> np.ndarray:
    """Sums of each row's positive weights: the bias, the largest, the sum, the
    number of strong ones, that number against the length, and the length."""
    out = np.zeros((rows, 6))
    out[:, 0] = 1.0
    np.maximum.at(out[:, 1], row, weight)
    out[:, 2] = np.minimum(np.bincount(row, weight, rows), 60.0)
    strong = np.bincount(row, weight >= 2.0, rows)
    out[:, 3] = np.minimum(strong, 20.0)
    out[:, 4] = strong / np.sqrt(1.0 + n)
    out[:, 5] = np.log1p(n)
    return out


@dataclass
class ToxicityModel:
    counts: np.ndarray  # trigrams
    weights: np.ndarray  # log odds of places, float32
    beta: np.ndarray  # of row_features; zeros where no labels were given
    base: float  # score where there is no model
    key: str = field(default_factory=lambda: uuid4().hex)  # names the trigram model in worker processes


def _reader(held) -> Reader:
    return one_model(("reader", held.value[0]), lambda: Reader(held.value[1]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_rows: int = 60_000) -> ToxicityModel:
    """Fits on labels whose crc32(id as text) mod 5 is not 0.

    The trigram model counts all texts. Weights and the final logistic model use
    at most about ``label_rows`` labelled rows, chosen by hash, which are the only
    rows that are broadcast: remainders 1 to 3 give the weights, 4 the logistic
    model. Null labels are no labels; of repeated ids the greatest label counts."""
    spark = docs.sparkSession
    src = pick(docs, id_col, text_col)
    counts = char_counts(src)
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(fold != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    share = min(1.0, label_rows / max(1, total))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    rows = src.join(F.broadcast(known), "doc_id").withColumn("fold", fold.cast("int"))
    model = ToxicityModel(counts, np.zeros(BUCKETS, np.float32), np.zeros(6), 0.0)
    held = spark.sparkContext.broadcast((model.key, counts))
    out = "place int, toxic bigint, clean bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(held)
        sums = np.zeros((2, BUCKETS + 1), np.int64)
        for b in slices(batches, 256):
            y = b.column("toxic").to_numpy()
            row, place, _ = reader.read(b.column("text"))
            for label in (0, 1):
                sums[label, :BUCKETS] += np.bincount(place[y[row] == label], minlength=BUCKETS)
                sums[label, BUCKETS] += int((y == label).sum())
        at = np.flatnonzero(sums.any(axis=0))
        if at.size:
            yield arrow_rows(out, [at.astype(np.int32), sums[1, at], sums[0, at]])

    got = rows.where("fold <> 4").select("text", "toxic").mapInArrow(count, out).groupBy("place").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # A place counts where at least three toxic documents have it; there are BUCKETS places at most.
    table = got.where((F.col("toxic") >= 3) | (F.col("place") == BUCKETS)).toPandas()
    t, c = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    t[table["place"]], c[table["place"]] = table["toxic"], table["clean"]
    if t[-1] and c[-1]:
        odds = np.log(((t[:-1] + 0.1) / (t[-1] + 1.0)) / ((c[:-1] + 1.0) / (c[-1] + 1.0)))
        # One standard deviation below the estimate, so that rare chance words weigh little.
        odds -= np.sqrt(1.0 / (t[:-1] + 0.1) + 1.0 / (c[:-1] + 1.0))
        model.weights = np.where(t[:-1] >= 3, np.maximum(odds, 0.0), 0.0).astype(np.float32)
    sample = _features(rows.where("fold = 4"), model).toPandas()
    x, y = np.array(sample["x"].tolist(), np.float64).reshape(-1, 6), sample["toxic"].to_numpy(np.float64)
    if len(set(y)) == 2:
        model.beta = logistic_fit(x, y)
    else:
        model.base = float(y.mean()) if len(y) else 0.0
    return model


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton steps for a ridge logistic model."""
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (y - p) - penalty @ beta
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, grad)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _features(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast((model.key, model.counts, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, weights = _reader(held), held.value[2]
        for b in slices(batches, 256):
            row, place, n = reader.read(b.column("text"))
            x = row_features(row, weights[place].astype(np.float64), b.num_rows, n)
            yield arrow_rows("toxic int, x array<double>", [b.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))])

    return rows.select("text", "toxic").mapInArrow(run, "toxic int, x array<double>")


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """Adds ``name``, the probability of label 1, to every row of ``docs``.

    Null and empty texts get the score of a text without words. Where the labels
    held one class or none, every row gets that class's share (0 without labels).
    A column called ``name`` is replaced; all others stay."""
    df = docs.drop(name)
    at = df.columns.index(text_col)
    held = df.sparkSession.sparkContext.broadcast((model.key, model.counts, model.weights, model.beta, model.base))
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(held)
        weights, beta, base = held.value[2:]
        for b in slices(batches, 256):
            if beta.any():
                row, place, n = reader.read(b.column(at))
                x = row_features(row, weights[place].astype(np.float64), b.num_rows, n)
                score = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
            else:
                score = np.full(b.num_rows, base)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=[*b.schema.names, name])

    return df.mapInArrow(run, schema)
