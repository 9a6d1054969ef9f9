"""Column expressions shared by the operators. All are built-ins, so they stay inside generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def order_key(key: Sequence[str], seed: int = 42) -> Column:
    """A reproducible shuffle order: md5 of seed and key, the same in any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))


def same_value(column: Column, dtype: T.DataType, value: Column) -> Column:
    """Compare a column with a value given as text: by number for numeric columns, else by text."""
    if isinstance(dtype, T.NumericType):
        return column.cast("double") == value.try_cast("double")
    return column.cast("string") == value


def group_pred(column: str, value, column2: str | None = None, value2=None) -> Column:
    """``column = value``, and ``column2 = value2`` if both of the second term are given."""
    pred = F.col(column) == F.lit(value)
    if column2 is not None and value2 is not None:
        pred = pred & (F.col(column2) == F.lit(value2))
    return F.coalesce(pred, F.lit(False))


def remap_column(column: Column, mapping: Mapping, dtype: T.DataType) -> Column:
    """Replace all codes at once, in the column's own type; a code that is not in the mapping stays as it is."""
    table = F.create_map(*[F.lit(x).cast(dtype) for pair in mapping.items() for x in pair])
    return F.coalesce(F.element_at(table, column), column)


def client_name(*parts: str | Column) -> Column:
    """``{client}_{i}``"""
    return F.concat_ws("_", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])


def share(part: Column, whole: Column, digits: int = 3) -> Column:
    """``part / whole`` rounded half to even."""
    return F.bround(part / whole, digits)


def chunk_bounds(n: Column, k: Column | int) -> Column:
    """Ranks after which chunks 1..k-1 end, when the first ``n mod k`` chunks get one more row."""
    k = F.lit(k) if isinstance(k, int) else k
    k, n = k.cast("long"), n.cast("long")
    q, m = F.floor(n / k).cast("long"), n % k
    ends = F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(k - 1, F.lit(1))),
                       lambda i: i * q + F.least(i, m))
    return F.when(k > 1, ends).otherwise(F.array().cast("array<bigint>"))


def chunk_of(rank: Column, n: Column, k: Column | int) -> Column:
    """The chunk, from 0, that holds a rank of ``n`` rows in ``k`` near-equal chunks."""
    k = F.lit(k) if isinstance(k, int) else k
    q, m = F.floor(n / k).cast("long"), n % k
    long_ones = m * (q + 1)
    early = F.floor((rank - 1) / (q + 1))
    late = m + F.floor((rank - 1 - long_ones) / F.greatest(q, F.lit(1)))
    return F.when(rank <= long_ones, early).otherwise(late).cast("int")


def fold_bounds(n: Column, fractions: Sequence[float]) -> list[Column]:
    """Ranks after which all folds but the last end: ``floor(n * cumulative fraction)``."""
    cumulative = [sum(fractions[: i + 1]) for i in range(len(fractions) - 1)]
    return [F.floor(n * F.lit(float(c))).cast("long") for c in cumulative]


def all_of(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)
