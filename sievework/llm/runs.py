"""Periodic runs of words by difference-cover LCE and a harmonic grid.

Texts of a batch stand one after another, each closed by a mark of its own.
Only suffixes at places of a difference cover modulo 7 are sorted, by ranks of
7, 14, 28, ... words; the lengths of common prefixes of sorted neighbours go into
a sparse table. The longest common extension (LCE) of any two places compares at
most six words until both are on the cover, and is then one range minimum.

A run of period p and length 4p or more has 3p places in a row whose word comes
again p words later, so a grid of step 3p, summed over all p a harmonic number of
points, meets every run. A grid point whose word comes again is extended to the
right by one LCE and to the left by binary search over LCEs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sievework.llm.common import arrow_rows, byte_slices, pick

PERIOD = 7
COVER = np.array([0, 1, 3])
LEAST_POWER = 4
LEAST_WORDS = 6
GRID_POINTS = 1 << 20

_SLOT = np.full(PERIOD, -1)
_SLOT[COVER] = np.arange(COVER.size)
# Steps until both residues are on the cover.
_STEPS = np.array([[next(d for d in range(PERIOD) if _SLOT[(a + d) % PERIOD] >= 0 and _SLOT[(b + d) % PERIOD] >= 0) for b in range(PERIOD)] for a in range(PERIOD)])


def _bits(n: int) -> int:
    return max(1, int(n).bit_length())


class Extensions:
    """LCE of places of one text among ``words`` (0 closes a text, others are 1 and up)."""

    def __init__(self, words: np.ndarray, text_of: np.ndarray):
        blocks = words.size // PERIOD + 1
        spare = blocks * PERIOD + 2 * PERIOD - words.size
        self.words = np.concatenate([words, np.zeros(spare, words.dtype)])
        # Spare places are texts of their own, so that all suffixes differ.
        self.text_of = np.concatenate([text_of, text_of[-1] + 1 + np.arange(spare)])
        self.at = (np.arange(blocks)[:, None] * PERIOD + COVER).ravel()
        order, levels = self._sort()
        self.rank = levels[-1][1]
        self.table = self._minima(self._neighbours(order, levels))

    def slot(self, place: np.ndarray) -> np.ndarray:
        return place // PERIOD * COVER.size + _SLOT[place % PERIOD]

    def _packed(self, of: np.ndarray, skip: int, room: int) -> tuple[np.ndarray, int]:
        """The next words of sampled suffixes in one number of ``room`` bits."""
        width = _bits(self.words.max())
        count = min(PERIOD - skip, max(1, room // width))
        key = np.zeros(of.size, np.int64)
        for t in range(count):
            key = key << width | self.words[self.at[of] + skip + t]
        return key, count

    def _sort(self) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Sorted samples, and their ranks by the first 7, 14, 28, ... words."""
        n = self.at.size
        wide = _bits(n)
        order = np.argsort(self.text_of[self.at], kind="stable")
        rank = np.empty(n, np.int64)
        live = np.arange(n)  # places of the order that are not alone in their rank
        key = self.text_of[self.at[order]]
        known, levels = -1, []
        while True:
            # Sort the open places by what is known and the next words or rank.
            by = np.argsort(key, kind="stable")
            own, key = order[live][by], key[by]
            order[live] = own
            first = np.r_[True, key[1:] != key[:-1]] if key.size else np.zeros(0, bool)
            rank[own] = live[np.maximum.accumulate(np.where(first, np.arange(own.size), 0))] if own.size else own
            known = max(known, 0)
            if known and known % PERIOD == 0:
                levels.append((known, rank.copy()))
            alone = first & np.r_[first[1:], True] if first.size else first
            live, own = live[~alone], own[~alone]
            if not live.size and known and known % PERIOD == 0:
                return order, levels
            if known < PERIOD:
                nxt, count = self._packed(own, known, 62 - wide)
                key = rank[own] << (_bits(self.words.max()) * count) | nxt
                known += count
            else:
                ahead = np.minimum(own + known // PERIOD * COVER.size, n - 1)
                key = rank[own] << wide | rank[ahead]
                known *= 2

    def _neighbours(self, order: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Common prefix of each sorted suffix with the one before."""
        out = np.zeros(order.size, np.int64)
        a, b = order[:-1].copy(), order[1:].copy()
        same = np.flatnonzero(self.text_of[self.at[a]] == self.text_of[self.at[b]])
        a, b = a[same], b[same]
        got = np.zeros(same.size, np.int64)
        for known, rank in reversed(levels):
            eq = rank[a] == rank[b]
            got += known * eq
            a, b = a + eq * (known // PERIOD * COVER.size), b + eq * (known // PERIOD * COVER.size)
        left, right = self.at[a], self.at[b]
        eq = np.ones(same.size, bool)
        for t in range(PERIOD):
            eq &= self.words[left + t] == self.words[right + t]
            got += eq
        out[same + 1] = got
        return out

    def _minima(self, row: np.ndarray) -> list[np.ndarray]:
        """Sparse table of minima over 1, 2, 4, ... neighbours of one text."""
        most = int(np.bincount(self.text_of[self.at]).max()) if row.size else 1
        table, step = [row.astype(np.int32)], 1
        while 2 * step <= most:
            last = table[-1]
            table.append(np.minimum(last[:-step], last[step:]) if last.size > step else last)
            step *= 2
        return table

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from places i < j of one text on."""
        steps = _STEPS[i % PERIOD, j % PERIOD]
        out = np.zeros(i.size, np.int64)
        eq = np.ones(i.size, bool)
        for t in range(PERIOD - 1):
            now = eq & (t < steps)
            eq &= ~now | (self.words[i + t] == self.words[j + t])
            out += now & eq
        far = np.flatnonzero(eq)
        a, b = self.rank[self.slot((i + steps)[far])], self.rank[self.slot((j + steps)[far])]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        found = np.zeros(far.size, np.int64)
        for k in np.unique(level).tolist():
            sel = level == k
            found[sel] = np.minimum(self.table[k][lo[sel]], self.table[k][hi[sel] - (1 << k) + 1])
        out[far] += found
        return out


def _grid(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, period, place) of all grid points, a bounded number at a time."""
    most = np.where(sizes >= LEAST_WORDS, sizes // LEAST_POWER, 0)
    text = np.repeat(np.arange(sizes.size), most)
    period = np.arange(text.size) - np.repeat(np.cumsum(most) - most, most) + 1
    step = (LEAST_POWER - 1) * period
    count = -(-(sizes[text] - period) // step)
    ends = np.cumsum(count)
    at = 0
    while at < text.size:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GRID_POINTS)))
        c = count[at:upto]
        t, p = np.repeat(text[at:upto], c), np.repeat(period[at:upto], c)
        k = np.arange(t.size) - np.repeat(np.cumsum(c) - c, c)
        yield t, p, starts[t] + k * p * (LEAST_POWER - 1)
        at = upto


def find_runs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of every run of 4 periods and 6 words or more,
    ordered by text, start and period. ``words``: positive numbers of all texts,
    one text after another; ``sizes``: words of each text."""
    # Each text gets one closing mark.
    starts = np.cumsum(sizes + 1) - sizes - 1
    text_of = np.repeat(np.arange(sizes.size), sizes + 1)
    closed = np.zeros(text_of.size, np.int64)
    inside = np.ones(text_of.size, bool)
    inside[starts + sizes] = False
    closed[inside] = words
    ext = None
    found = [np.zeros((0, 4), np.int64)]
    for text, p, x in _grid(starts, sizes):
        hit = closed[x] == closed[x + p]
        text, p, x = text[hit], p[hit], x[hit]
        if not x.size:
            continue
        ext = ext or Extensions(closed, text_of)
        right = ext.lce(x, x + p)
        window = (LEAST_POWER - 1) * p
        # Words to the left that the run needs at least, and that it may have
        # before an earlier grid point answers for it.
        low, high = np.maximum(window - right, 0), np.minimum(window, x - starts[text])
        some = low <= high
        text, p, x, right, low, high = (v[some] for v in (text, p, x, right, low, high))
        some = ext.lce(x - low, x - low + p) >= low
        text, p, x, right, low, high = (v[some] for v in (text, p, x, right, low, high))
        while (low < high).any():
            mid = (low + high + 1) // 2
            good = ext.lce(x - mid, x - mid + p) >= mid
            low, high = np.where(good, mid, low), np.where(good, high, mid - 1)
        length = low + right + p
        own = (low < (LEAST_POWER - 1) * p) & (length >= np.maximum(LEAST_WORDS, LEAST_POWER * p))
        found.append(np.stack([text, x - low - starts[text], length, p], 1)[own])
    rows = np.concatenate(found)
    rows = rows[np.lexsort(rows.T[[3, 2, 1, 0]])]
    # A stretch found with multiples of its smallest period is one run.
    first = np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(1)] if len(rows) else np.zeros(0, bool)
    rows = rows[first]
    rows = rows[np.lexsort(rows.T[[3, 1, 0]])]
    return tuple(rows.T)


RUNS = "doc_id bigint, n_words bigint, starts array<bigint>, lengths array<bigint>, periods array<bigint>, collapsed string"


def _batch(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(full)])[offsets]
    flat, sizes = flat.filter(pa.array(full)), np.diff(ends)
    words = flat.dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    text, start, length, period = find_runs(words, sizes)
    # A word goes if a run holds it after the run's first period.
    edge = np.zeros(words.size + 1, np.int64)
    np.add.at(edge, ends[text] + start + period, 1)
    np.add.at(edge, ends[text] + start + length, -1)
    keep = np.cumsum(edge)[:-1] == 0
    kept = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(keep)])[ends].astype(np.int32), flat.filter(pa.array(keep)))
    bounds = np.searchsorted(text, np.arange(sizes.size + 1)).astype(np.int32)
    parts = [pa.ListArray.from_arrays(bounds, pa.array(v, pa.int64())) for v in (start, length, period)]
    return arrow_rows(RUNS, [ids, sizes, *parts, pc.binary_join(kept, pa.scalar(" ", pa.large_string())).cast(pa.string())])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, starts, lengths, periods, collapsed) of every row.

    Words are what ASCII white space parts, compared byte by byte. A run is a
    stretch with smallest period q, of 6 words and 4 q or more, that no neighbouring
    word extends; runs are ordered by start, then period. ``collapsed`` holds the
    words that no run contains after its first q words, joined by one space.
    Null, empty and blank texts have no words, no runs and an empty text; rows
    with a null id keep it, repeated rows are all answered. Other columns are not
    read. A text is worked on whole in one task, with memory in proportion to it;
    short texts share a batch of bounded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, "text", 4 << 20):
            yield _batch(b.column("doc_id"), b.column("text"))

    return pick(docs, id_col, text_col).mapInArrow(run, RUNS)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The contract's documents: with h = crc32(doc_id), g = h div 10, a document
    of n words with h divisible by 10 repeats from word a = g mod n on its next
    p = 1 + (n - a) div (3 + g mod 8) words. A null id changes nothing."""
    src = pick(docs, "doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    planted = src.withColumn("_g", F.floor(h / 10)).withColumn("_w", F.when(h % 10 == 0, words))
    n = F.size("_w")
    a = planted.withColumn("_a", F.when(n > 0, F.col("_g") % n))
    p = a.withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)))
    told = F.expr("array_join(transform(sequence(0L, size(_w) - 1L), i -> _w[int(if(i < _a, i, _a + (i - _a) % _p))]), ' ')")
    return p.select("doc_id", F.when(F.col("_a").isNotNull(), told).otherwise(F.col("text")).alias("text"))


def run_digest(docs: DataFrame) -> DataFrame:
    """Counts, strongest run and digests of ``periodic_runs``."""
    runs = periodic_runs(docs).withColumn("_r", F.arrays_zip("starts", "lengths", "periods"))
    # Runs come by start and period, so a later one must be stronger to win.
    best = runs.withColumn(
        "_b",
        F.expr("aggregate(_r, get(_r, 0), (m, r) -> if(r.lengths * m.periods > m.lengths * r.periods, r, m))"),
    )
    lines = F.expr("array_join(transform(_r, r -> concat(r.starts, ',', r.lengths, ',', r.periods, '\n')), '')")
    return best.select(
        "doc_id",
        F.size("_r").cast("bigint").alias("n_runs"),
        F.col("_b.starts").alias("start"),
        F.col("_b.lengths").alias("length"),
        F.col("_b.periods").alias("period"),
        F.floor(1000 * F.col("_b.lengths") / F.col("_b.periods")).cast("bigint").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
