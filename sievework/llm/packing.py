"""Best-fit packing of documents into sequences by linear grouping.

Only the histogram of piece lengths reaches the driver: it has at most
``capacity`` rows, whatever the corpus. The plan made from it is a list of bin
classes (equal bins with a count); it too is bounded by ``capacity``:

1. Lengths above ``capacity / 8`` are large. They are put in descending order
   into groups of equal cardinality and every length is rounded up to the
   longest of its group (linear grouping), which leaves few sizes.
2. Few-size configurations: the largest size that is left opens a configuration
   and a dynamic program over the capacity adds the sizes that fill it best; the
   configuration is used as often as its scarcest size allows.
3. Actual lengths replace the rounded ones, which only adds free room.
4. Small lengths go, longest first, to the bins with the least room that holds
   them (best fit), class by class; what is left opens new bins.

Pieces then find their bin by (length, rank among equal lengths) alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sievework.llm.common import arrow_rows, byte_slices, pick, saved
from sievework.llm.token_store import END_ID
from sievework.llm.tokens import encoder

PIECES = "part int, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, nth bigint"
# The arrays that encoding makes on the way are many times as large as the texts.
BATCH_BYTES = 1 << 20


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids; ``nth`` counts equal lengths in a partition."""
    src = pick(docs, id_col, text_col).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        seen = np.zeros(capacity + 1, np.int64)
        for b in byte_slices(batches, "text", BATCH_BYTES):
            part = b.column("part")[0].as_py()
            flat, counts = enc.batch(b.column("text"))
            rows = []
            at = 0
            for doc, n in zip(b.column("doc_id").to_pylist(), counts.tolist()):
                raw = flat[at : at + n].astype("<u4", copy=False).tobytes() + END_ID.to_bytes(4, "little")
                at += n
                for k, start in enumerate(range(0, n + 1, capacity)):
                    size = min(capacity, n + 1 - start)
                    rows.append((part, doc, k, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]), seen[size]))
                    seen[size] += 1
            yield arrow_rows(PIECES, list(zip(*rows)))

    return src.mapInArrow(run, PIECES)


def plan_bins(histogram: dict[int, int], capacity: int = 4096, groups: int = 16) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bin classes (bins, [(length, how many in each bin), ...])."""
    sizes = {s: c for s, c in histogram.items() if c > 0}
    done = [(sizes.pop(capacity), [(capacity, 1)])] if capacity in sizes else []
    limit = max(1, capacity // 8)
    large = sorted((s for s in sizes if s > limit), reverse=True)
    rooms: list[list[tuple[int, list[tuple[int, int]]]]] = [[] for _ in range(capacity + 1)]

    def put(bins: int, items: list[tuple[int, int]]) -> None:
        if bins:
            rooms[capacity - sum(s * m for s, m in items)].append((bins, items))

    for bins, items in _substitute(_configurations(_group(large, sizes, groups), capacity), large, sizes):
        put(bins, items)
    mask = sum(1 << r for r in range(capacity + 1) if rooms[r])
    for s in sorted((s for s in sizes if s <= limit), reverse=True):
        left = sizes[s]
        while left:
            fit = mask >> s
            if not fit:
                each = capacity // s
                full, rest = divmod(left, each)
                grown = [(full, [(s, each)]), (1 if rest else 0, [(s, rest)])]
                left = 0
            else:
                room = s + (fit & -fit).bit_length() - 1
                bins, items = rooms[room].pop()
                if not rooms[room]:
                    mask &= ~(1 << room)
                each = room // s
                full = min(bins, left // each)
                rest = min(left - full * each, each - 1) if full < bins else 0
                used = full + (1 if rest else 0)
                grown = [(full, [*items, (s, each)]), (1 if rest else 0, [*items, (s, rest)]), (bins - used, items)]
                left -= full * each + rest
            for n, them in grown:
                put(n, them)
                if n:
                    mask |= 1 << (capacity - sum(a * m for a, m in them))
    return done + [x for room in rooms for x in room]


def _group(large: list[int], count: dict[int, int], groups: int) -> list[list[int]]:
    """[rounded length, how many] of groups of equal cardinality, longest first."""
    total = sum(count[s] for s in large)
    share = -(-total // groups) if total else 0
    out: list[list[int]] = []
    for s in large:
        left = count[s]
        while left:
            if not out or out[-1][1] == share:
                out.append([s, 0])
            n = min(left, share - out[-1][1])
            out[-1][1] += n
            left -= n
    return out


def _configurations(grouped: list[list[int]], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(group, times), ...]) that use up every group."""
    left = [n for _, n in grouped]
    out = []
    while any(left):
        first = next(g for g, n in enumerate(left) if n)
        config = {first: 1}
        room = capacity - grouped[first][0]
        # best[r]: greatest filled length within r; via[r]: last group taken, longest first.
        alive = [g for g, n in enumerate(left) if n - config.get(g, 0) > 0 and grouped[g][0] <= room]
        best, via = np.zeros(room + 1, np.int64), np.full(room + 1, -1, np.int64)
        for g in alive:
            size = grouped[g][0]
            for _ in range(min(left[g] - config.get(g, 0), room // size)):
                cand = best[: room + 1 - size] + size
                better = cand > best[size:]
                if not better.any():
                    break
                fresh, mark = best.copy(), via.copy()
                fresh[size:][better], mark[size:][better] = cand[better], g
                best, via = fresh, mark
        r = room
        while r > 0 and via[r] >= 0:
            g = int(via[r])
            if config.get(g, 0) >= left[g]:
                break
            config[g] = config.get(g, 0) + 1
            r -= grouped[g][0]
        bins = min(left[g] // k for g, k in config.items())
        for g, k in config.items():
            left[g] -= bins * k
        out.append((bins, sorted(config.items())))
    return out


def _substitute(configs, large: list[int], count: dict[int, int]):
    """Replaces rounded lengths by actual ones, longest first within a group.

    Groups take actual lengths in the same descending order, so a group's slots
    are a stretch of that order; each configuration splits where a length ends."""
    order: dict[int, list[list[int]]] = {}
    stock = [[s, count[s]] for s in large]
    need: dict[int, int] = {}
    for bins, items in configs:
        for g, k in items:
            need[g] = need.get(g, 0) + bins * k
    at = 0
    for g in sorted(need):
        order[g] = []
        while need[g]:
            n = min(need[g], stock[at][1])
            order[g].append([stock[at][0], n])
            stock[at][1] -= n
            need[g] -= n
            at += stock[at][1] == 0
    for bins, items in configs:
        slots = [g for g, k in items for _ in range(k)]
        while bins:
            # As many bins as the current stretches of all slots allow.
            want: dict[int, int] = {}
            for g in slots:
                want[g] = want.get(g, 0) + 1
            step = bins
            for g, k in want.items():
                step = min(step, order[g][-1][1] // k if order[g][-1][1] >= k else 0)
            taken: dict[int, int] = {}
            if step:
                for g, k in want.items():
                    taken[order[g][-1][0]] = taken.get(order[g][-1][0], 0) + k
                    order[g][-1][1] -= step * k
            else:
                step = 1
                for g, k in want.items():
                    while k:
                        n = min(k, order[g][-1][1])
                        taken[order[g][-1][0]] = taken.get(order[g][-1][0], 0) + n
                        order[g][-1][1] -= n
                        k -= n
                        if not order[g][-1][1]:
                            order[g].pop()
            for g in want:
                if order[g] and not order[g][-1][1]:
                    order[g].pop()
            bins -= step
            yield step, sorted(taken.items(), reverse=True)


def slots_of(classes) -> dict[str, np.ndarray]:
    """Where the n-th piece of a length goes: runs of ranks, sorted by (length, rank)."""
    rows, used, first = [], {}, 0
    for bins, items in classes:
        offset = 0
        for s, each in items:
            rank = used.get(s, 0)
            rows.append((s, rank, first, each, offset))
            used[s] = rank + bins * each
            offset += s * each
        first += bins
    rows.sort()
    names = ("length", "rank", "sequence", "each", "offset")
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


def pack(pieces: DataFrame, capacity: int = 4096, groups: int = 16) -> DataFrame:
    """Adds sequence_id and offset to pieces written by :func:`cut_pieces`.

    ``pieces`` must be a written table: it is read for the counts and again for
    the places. Ranks among equal lengths come from counts per (partition,
    length), so a length that a third of all pieces have is no hot group."""
    counts = saved(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if not histogram:
        return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    slots = pieces.sparkSession.sparkContext.broadcast(slots_of(plan_bins(histogram, capacity, groups)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(counts.select("length", "part", before.alias("_before")), ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("nth")).alias("_rank"))
    out = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = slots.value
        firsts = np.searchsorted(t["length"], np.arange(capacity + 2))
        for b in batches:
            size, rank = (b.column(c).to_numpy() for c in ("length", "_rank"))
            run = np.empty(size.size, np.int64)
            for s in np.unique(size):
                lo, hi = firsts[s], firsts[s + 1]
                mine = size == s
                run[mine] = lo + np.searchsorted(t["rank"][lo:hi], rank[mine], side="right") - 1
            k = rank - t["rank"][run]
            seq = t["sequence"][run] + k // t["each"][run]
            off = t["offset"][run] + k % t["each"][run] * size
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield arrow_rows(out, [*cols, seq, off])

    return ranked.mapInArrow(place, out)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, groups: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts, plans and places all documents; see the module docstring.

    A null or empty text is one piece of the end id alone. Repeated rows and null
    ids are packed like any other row. An empty table gives no rows."""
    return pack(saved(cut_pieces(docs, vocabulary, capacity, id_col, text_col), "pieces"), capacity, groups)
