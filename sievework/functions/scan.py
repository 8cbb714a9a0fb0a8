"""Ordered scans that never put a whole key into one task.

A plain window over one key sends every row of that key to one task, which
fails when a key holds a third of the data. Here the key is cut into blocks of
the order column: rows are scanned inside (key, block), block totals (one row
per block) are scanned over the key, and the two are joined on (key, block).
The join reuses the partitioning of the inner window. Where there is no key, the
totals of many blocks are scanned in the same way in two levels (groups of blocks,
then the groups' totals), so that no task holds them all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sievework.session import cut, small

GROUP = 4096

_FOLD = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}


def _merge(kind: str, head: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(head, F.lit(0)) + F.coalesce(local, F.lit(0))
    return (F.greatest if kind == "max" else F.least)(head, local)


def _group(totals: DataFrame) -> Column:
    """A group of blocks, non-decreasing along them: a range of numbers, or the
    first part of a struct."""
    kind = totals.schema["_blk"].dataType
    if isinstance(kind, T.StructType):
        return F.col("_blk")[kind.names[0]]
    return F.floor(F.col("_blk") / GROUP) if isinstance(kind, T.NumericType) else F.lit(0)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    inclusive: bool = True,
    **aggs: tuple[str, Column],
) -> DataFrame:
    """Adds running sum/count/max/min columns in (order) within (keys).

    ``block`` must be non-decreasing along the order; keys must be non-null.
    """
    src = df.withColumn("_blk", block)
    for name, (kind, c) in aggs.items():
        src = src.withColumn(f"_in_{name}", c)
    part = [*keys, "_blk"]
    end = Window.currentRow if inclusive else -1
    inner = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = src
    for name, (kind, _) in aggs.items():
        local = local.withColumn(f"_lo_{name}", _FOLD[kind](F.col(f"_in_{name}")).over(inner))
    totals = src.groupBy(*part).agg(*[_FOLD[k](F.col(f"_in_{n}")).alias(f"_to_{n}") for n, (k, _) in aggs.items()])
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    folded = lambda w: [_FOLD[k](F.col(f"_to_{n}")).over(w).alias(f"_hd_{n}") for n, (k, _) in aggs.items()]
    if keys:
        heads = totals.select(*part, *folded(before(Window.partitionBy(*keys).orderBy("_blk"))))
    else:
        grouped = totals.withColumn("_grp", _group(totals))
        inside = grouped.select("_grp", "_blk", *folded(before(Window.partitionBy("_grp").orderBy("_blk"))))
        sums = grouped.groupBy("_grp").agg(*[_FOLD[k](F.col(f"_to_{n}")).alias(f"_to_{n}") for n, (k, _) in aggs.items()])
        tops = sums.select("_grp", *folded(before(Window.orderBy("_grp")))).withColumnsRenamed({f"_hd_{n}": f"_gh_{n}" for n in aggs})
        heads = inside.join(tops, "_grp").select("_blk", *[_merge(k, F.col(f"_gh_{n}"), F.col(f"_hd_{n}")).alias(f"_hd_{n}") for n, (k, _) in aggs.items()])
    out = local.join(heads, part, "left")
    for name, (kind, _) in aggs.items():
        out = out.withColumn(name, _merge(kind, F.col(f"_hd_{name}"), F.col(f"_lo_{name}")))
    return out.select(*df.columns, *aggs)


def last_known(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    inclusive: bool = True,
    **values: Column,
) -> DataFrame:
    """Adds, per row, the newest non-null value at or before it within the key."""
    src = df.withColumn("_blk", block)
    for name, c in values.items():
        src = src.withColumn(f"_in_{name}", c)
    part = [*keys, "_blk"]
    end = Window.currentRow if inclusive else -1
    inner = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = src
    for name in values:
        local = local.withColumn(f"_lo_{name}", F.last(f"_in_{name}", ignorenulls=True).over(inner))
    at = F.struct(*order)
    totals = src.groupBy(*part).agg(
        *[F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), at)).alias(f"_to_{n}") for n in values]
    )
    outer = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.select(*part, *[F.last(f"_to_{n}", ignorenulls=True).over(outer).alias(f"_hd_{n}") for n in values])
    out = local.join(heads, part, "left")
    for name in values:
        out = out.withColumn(name, F.coalesce(F.col(f"_lo_{name}"), F.col(f"_hd_{name}")))
    return out.select(*df.columns, *values)


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, **values: Column) -> DataFrame:
    """Adds the value of the row just before, also where that value is null."""
    boxed = {f"_bx_{n}": F.struct(c.alias("v")) for n, c in values.items()}
    out = last_known(df, keys, order, block, inclusive=False, **boxed)
    return out.select(*df.columns, *[F.col(f"_bx_{n}")["v"].alias(n) for n in values])


def number_rows(df: DataFrame, order: Sequence[str], block: Column, name: str = "pos") -> DataFrame:
    """Global 1-based position in (order) without a single-task sort."""
    return running(df, [], order, block, **{name: ("count", F.lit(1).cast("bigint"))})


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """Exact interpolated quantiles per key, for keys of any size and any tail.

    A mergeable sketch gives, for each probability, two values of the key that
    bracket the wanted rank (its rank error is at most n / accuracy). One more
    scan counts the rows below each bracket and the values inside, so only about
    6 n / accuracy values of a key reach its window, whatever their spread; equal
    values are counted before the shuffle. The brackets go to the rows, so few keys
    do not make few tasks, and every sum is of plain numbers, so no rows are sorted."""
    keys = list(keys)
    part = keys or ["_all"]
    src = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    if not keys:
        src = src.withColumn("_all", F.lit(0))
    wide = 3.0 / accuracy
    names = list(probs)
    asked = [x for n in names for x in (max(0.0, probs[n] - wide), min(1.0, probs[n] + wide))]
    bounds = small(cut(src.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", asked, accuracy).alias("_q"))))
    low = {n: F.col("_q")[2 * i] for i, n in enumerate(names)}
    high = {n: F.col("_q")[2 * i + 1] for i, n in enumerate(names)}
    inside = {n: F.col("_v").between(low[n], high[n]) for n in names}
    any_ = F.lit(False)
    for n in names:
        any_ = any_ | inside[n]
    # A few values may round the bracket off by one rank, so its neighbours come along.
    below = [F.count_if(F.col("_v") < low[n]).alias(f"_b_{n}") for n in names]
    below += [F.max(F.when(F.col("_v") < low[n], F.col("_v"))).alias(f"_p_{n}") for n in names]
    below += [F.min(F.when(F.col("_v") > high[n], F.col("_v"))).alias(f"_s_{n}") for n in names]
    placed = src.join(bounds, part)
    rows = placed.groupBy(*part, F.when(any_, F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"), *below).join(bounds, part)
    whole, upto = Window.partitionBy(*part), Window.partitionBy(*part).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_t_{n}": F.sum(f"_b_{n}").over(whole) + F.coalesce(F.sum(F.when(inside[n], F.col("_c"))).over(upto), F.lit(0)) for n in names})
    picks = []
    for n in names:
        rank = F.lit(float(probs[n])) * (F.col("_n") - 1)
        for tag, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            hit = inside[n] & (F.col(f"_t_{n}") > at) & (F.col(f"_t_{n}") - F.col("_c") <= at)
            beside = F.max(f"_p_{n}") if tag == "lo" else F.min(f"_s_{n}")
            picks.append(F.coalesce(F.max(F.when(hit, F.col("_v"))), beside).alias(f"_{n}_{tag}"))
    agg = rows.groupBy(*part).agg(F.max("_n").alias("_n"), *picks)
    out = []
    for n in names:
        rank = F.lit(float(probs[n])) * (F.col("_n") - 1)
        lo, hi = F.col(f"_{n}_lo"), F.col(f"_{n}_hi")
        out.append((lo + (hi - lo) * (rank - F.floor(rank))).alias(n))
    return agg.select(*keys, *out)
