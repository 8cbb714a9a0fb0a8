"""Least squares from sums of products, for all groups at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def least_squares(rows: DataFrame, keys: Sequence[str], x: str, y: str, size: int, ridge: float = 0.0) -> DataFrame:
    """(keys, w): weights of the array column ``x`` (``size`` numbers, the first a
    constant) for ``y`` by group, plus ``ridge`` times the squared slopes.

    One aggregation sums the products; only those sums, one small row a group,
    meet the solver. Where features depend on each other, the shortest solution."""
    at = [(i, j) for i in range(size) for j in range(i, size)]
    sums = [F.sum(F.col(x)[i] * F.col(x)[j]) for i, j in at] + [F.sum(F.col(x)[i] * F.col(y)) for i in range(size)]
    fitted = rows.groupBy(*keys).agg(F.array(*sums).alias("s"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for s in b["s"]:
                m = np.diag([0.0] + [ridge] * (size - 1))
                for (i, j), v in zip(at, s):
                    m[i, j] += v
                    m[j, i] += v if i != j else 0.0
                out.append(np.linalg.lstsq(m, np.array(s[len(at) :]), rcond=None)[0])
            yield b.drop(columns="s").assign(w=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fitted.schema if f.name != "s")
    return fitted.mapInPandas(solve, (schema + ", " if schema else "") + "w array<double>")


def predicted(x: Column | str, w: Column | str) -> Column:
    """Inner product of features and weights."""
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
