"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def h32(*parts: Column | str) -> Column:
    """First 32 bits of md5 over the concatenated parts, as a long."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat(*[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(*parts: Column | str) -> Column:
    """Hash-derived uniform in (0, 1), never exactly 0 or 1."""
    return (h32(*parts) + F.lit(0.5)) / F.lit(4294967296.0)


def normal(*parts: Column | str) -> Column:
    """Hash-derived standard normal (Box-Muller on two independent hashes)."""
    u1 = uniform(*parts, F.lit("|u1"))
    u2 = uniform(*parts, F.lit("|u2"))
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def logistic(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def reasons(rules: Sequence[tuple[str, Column]]) -> Column:
    """Names of the rules that are true, in rule order; a null rule is not true."""
    return F.filter(
        F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules]),
        lambda x: x.isNotNull(),
    )


def words(c: Column) -> Column:
    """Whitespace tokens; an empty text has none."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row; an expression used
    inside a lambda would else be computed once per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def date_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def ts_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def seconds(c: Column) -> Column:
    """Epoch seconds with the fraction kept."""
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


def h32_sql(expr: str) -> str:
    """DuckDB text for :func:`h32`."""
    return f"(('0x'||substr(md5({expr}),1,8))::BIGINT)"
