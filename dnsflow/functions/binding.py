"""Naming intermediate values so that they are computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, build: Callable[[Column], Column]) -> Column:
    """`build(value)` with `value` evaluated once, however often `build` uses it.

    Without it every use repeats the whole expression tree, and nested uses multiply.
    """
    return F.get(F.transform(F.array(value), build), F.lit(0))


def stage(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`withColumns` that keeps later filters and projections from repeating the expressions.

    The optimizer copies the expression of a column into every filter it pushes below it;
    over a chain of derived columns that multiplies. Generator output is not copied, stays
    inside generated code and yields exactly one row per row.
    """
    fields = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(fields)))
