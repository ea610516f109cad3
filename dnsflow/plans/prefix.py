"""Values of the rows before each row, also for keys too big for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What an operation does with the values of the rows before, and how two parts combine.
_INSIDE = {"last": lambda c: F.last(c, ignorenulls=True), "sum": F.sum, "max": F.max}


def _combine(kind: str, before: Column, inside: Column) -> Column:
    if kind == "last":
        return F.coalesce(inside, before)
    if kind == "max":
        return F.greatest(before, inside)
    return F.coalesce(before, F.lit(0)) + F.coalesce(inside, F.lit(0))


def with_prefix(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    ops: dict[str, tuple[str, Column]],
    chunk: str | None = None,
) -> DataFrame:
    """Adds, for every (kind, value) in `ops`, the last non-null value, sum or maximum of `value`
    over all earlier rows of the key.

    Without `chunk` this is one window per key. With `chunk`, a column that rises with the
    order, rows are ordered within (key, chunk) only; one summary row per chunk carries the
    value of all chunks before.
    """
    earlier = (Window.unboundedPreceding, -1)
    if chunk is None:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*earlier)
        made = {n: _INSIDE[kind](value).over(window) for n, (kind, value) in ops.items()}
        empty = {n: F.coalesce(c, F.lit(0)) if ops[n][0] == "sum" else c for n, c in made.items()}
        return df.withColumns(empty)
    at = F.struct(*order)
    whole = {
        "last": lambda c: F.max_by(c, F.when(c.isNotNull(), at)), "sum": F.sum, "max": F.max,
    }
    summary = df.groupBy(*keys, chunk).agg(
        *[whole[kind](value).alias(f"__{n}") for n, (kind, value) in ops.items()]
    )
    over_chunks = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(*earlier)
    carried = summary.select(
        *[F.col(k).alias(f"__k_{k}") for k in [*keys, chunk]],
        *[_INSIDE[kind](F.col(f"__{n}")).over(over_chunks).alias(f"__{n}") for n, (kind, _) in ops.items()],
    )
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(*earlier)
    local = df.withColumns({n: _INSIDE[kind](value).over(inside) for n, (kind, value) in ops.items()})
    same = [local[k].eqNullSafe(carried[f"__k_{k}"]) for k in [*keys, chunk]]
    joined = local.join(carried, same, "left")
    return joined.select(
        *df.columns,
        *[_combine(kind, F.col(f"__{n}"), F.col(n)).alias(n) for n, (kind, _) in ops.items()],
    )
