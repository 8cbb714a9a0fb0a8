"""Quality grades by ordinal cumulative-link regression.

P(grade <= k) = logistic(t_k - w.x) with one weight vector shared by all grades
and ordered thresholds t_0 < t_1 < ... Features are the hashed distinct words of
a text (scaled so that long and short texts weigh alike) and hashed steps of a
few shape measures. Selection uses the expected grade or the tail probability
P(grade >= k).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sievework.llm.common import arrow_rows, pick, slices

PLACES = 1 << 18
SHAPES = 8


def shape_steps(text: str, tokens: list[str], seen: Counter) -> list[str]:
    """Coarse steps of shape measures, as feature names."""
    n = max(1, len(tokens))
    lines = [x for x in text.split("\n") if x]
    measures = {
        "words": min(12, int(np.log2(1 + len(tokens)))),
        "distinct": int(10 * len(seen) / n),
        "commonest": int(10 * max(seen.values(), default=0) / n),
        "upper": int(10 * sum(map(str.isupper, tokens)) / n),
        "letters": int(20 * sum(map(str.isalpha, tokens)) / n),
        "long": min(20, int(sum(map(len, tokens)) / n)),
        "lines": int(10 * len(set(lines)) / max(1, len(lines))),
        "marks": min(10, int(20 * sum(t[-1:] in "!#%&*$|" for t in tokens) / n)),
    }
    return [f"\x00{k}={v}" for k, v in measures.items()]


def places_of(text: str | None) -> np.ndarray:
    """Shape places first (always SHAPES of them), then distinct word places."""
    text = text or ""
    tokens = text.split()
    seen = Counter(tokens)
    shape = [crc32(s.encode()) % PLACES for s in shape_steps(text, tokens, seen)]
    words = {crc32(w.lower().encode("utf-8", "replace")) % PLACES for w in seen}
    return np.array(shape + sorted(words), np.uint32)


@dataclass
class GradeModel:
    weights: np.ndarray  # float32, PLACES
    thresholds: np.ndarray  # ordered, one less than the grades

    def tails(self, texts: list[str | None]) -> np.ndarray:
        """P(grade >= k) for k = 1.. of every text."""
        z = np.zeros(len(texts))
        for i, t in enumerate(texts):
            p = places_of(t)
            z[i] = self.weights[p[:SHAPES]].sum() + self.weights[p[SHAPES:]].sum() / np.sqrt(max(1, p.size - SHAPES))
        return 1.0 / (1.0 + np.exp(-np.clip(z[:, None] - self.thresholds[None, :], -30, 30)))


def fit_cumulative(rows: list[np.ndarray], y: np.ndarray, grades: int, epochs: int = 6, rate: float = 0.1, ridge: float = 1e-5, batch: int = 32) -> GradeModel:
    """Adagrad on the cumulative-link likelihood; thresholds stay ordered because
    their steps are exponentials."""
    w, gw = np.zeros(PLACES), np.full(PLACES, 1e-8)
    share = np.clip([(y <= k).mean() for k in range(grades - 1)], 1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-2 * np.arange(grades - 1))
    raw = np.r_[start[:1], np.log(np.maximum(np.diff(start), 1e-2))]
    graw = np.full(raw.size, 1e-8)
    logistic = lambda v: 1.0 / (1.0 + np.exp(-np.clip(v, -30, 30)))
    rng = np.random.default_rng(1)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            ids = order[at : at + batch]
            t = np.cumsum(np.r_[raw[:1], np.exp(raw[1:])])
            flat = np.concatenate([rows[i] for i in ids]).astype(np.int64)
            sizes = np.array([rows[i].size for i in ids])
            value = np.concatenate([np.r_[np.ones(SHAPES), np.full(n - SHAPES, 1 / np.sqrt(max(1, n - SHAPES)))] for n in sizes.tolist()])
            z = np.add.reduceat(w[flat] * value, np.cumsum(sizes) - sizes)
            yi = y[ids]
            up = np.where(yi < grades - 1, t[np.minimum(yi, grades - 2)], np.inf) - z
            lo = np.where(yi > 0, t[np.maximum(yi - 1, 0)], -np.inf) - z
            fu, fl = np.where(np.isinf(up), 1.0, logistic(up)), np.where(np.isinf(lo), 0.0, logistic(lo))
            p = np.maximum(fu - fl, 1e-9)
            du, dl = np.where(np.isinf(up), 0.0, fu * (1 - fu)), np.where(np.isinf(lo), 0.0, fl * (1 - fl))
            dz = (du - dl) / p  # of the loss, for z
            gt = np.zeros(grades - 1)
            np.add.at(gt, np.minimum(yi, grades - 2), np.where(yi < grades - 1, -du / p, 0.0))
            np.add.at(gt, np.maximum(yi - 1, 0), np.where(yi > 0, dl / p, 0.0))
            tail = np.cumsum(gt[::-1])[::-1]
            g = np.r_[tail[:1], tail[1:] * np.exp(raw[1:])] / len(ids)
            graw += g * g
            raw -= rate * g / np.sqrt(graw)
            g = np.repeat(dz, sizes) * value / len(ids) + ridge * w[flat]
            np.add.at(gw, flat, g * g)
            np.add.at(w, flat, -rate * g / np.sqrt(gw[flat]))
    return GradeModel(w.astype(np.float32), np.cumsum(np.r_[raw[:1], np.exp(raw[1:])]))


def fit_grades(docs: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text", label_rows: int = 20_000) -> GradeModel:
    """Fits on at most about ``label_rows`` rated documents, chosen by hash, whose
    crc32(id as text) mod 5 is not 0. ``ratings(doc_id, grade)``: grades from 0;
    null or outside ones are left out, of repeated ids the least grade counts.
    Without ratings every weight and threshold is 0."""
    ids = F.col("doc_id").cast("bigint")
    known = ratings.select(ids.alias("doc_id"), F.col("grade").cast("int").alias("grade")).where(F.col("doc_id").isNotNull() & F.col("grade").between(0, grades - 1))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    share = min(1.0, label_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    out = "doc_id bigint, grade int, places binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            yield arrow_rows(out, [b.column("doc_id"), b.column("grade"), [places_of(t).tobytes() for t in b.column("text").to_pylist()]])

    rows = pick(docs, id_col, text_col).join(F.broadcast(known), "doc_id").select("doc_id", "grade", "text").mapInArrow(run, out).toPandas()
    if rows.empty:
        return GradeModel(np.zeros(PLACES, np.float32), np.zeros(grades - 1))
    rows = rows.sort_values(["doc_id", "places"])
    return fit_cumulative([np.frombuffer(p, np.uint32) for p in rows["places"]], rows["grade"].to_numpy(np.int64), grades)


def score_grades(docs: DataFrame, model: GradeModel, text_col: str = "text") -> DataFrame:
    """Adds expected_grade and tails (P(grade >= k) for k = 1, 2, ..) to every row.

    Null and empty texts are scored as texts without words. Columns with these
    names are replaced, all others stay."""
    df = docs.drop("expected_grade", "tails")
    at = df.columns.index(text_col)
    held = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*df.schema.fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("tails", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            tails = held.value.tails(b.column(at).to_pylist())
            made = [pa.array(tails.sum(axis=1)), pa.array(list(tails), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, "expected_grade", "tails"])

    return df.mapInArrow(run, schema)
