"""Per-tick tables without a single global window.

A window ordered over all ticks would run in one task. Ticks are cut into chunks instead:
frames get the rows they need from the chunk before, running totals get the sum of all
chunks before. Only chunk totals, one row per CHUNK ticks, are ordered globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096


def chunk_of(tick: Column) -> Column:
    return F.floor(tick / CHUNK).cast("bigint")


def fill_gaps(counts: DataFrame, tick: str, values: list[str]) -> DataFrame:
    """`counts` with a zero row for every missing tick between the first and the last."""
    bounds = counts.agg(F.min(tick).alias("a"), F.max(tick).alias("b")).filter("a is not null")
    chunks = bounds.select(
        "a", "b", F.explode(F.sequence(chunk_of(F.col("a")), chunk_of(F.col("b")))).alias("c")
    ).repartition("c")
    spine = chunks.select(
        F.explode(
            F.sequence(
                F.greatest(F.col("a"), F.col("c") * CHUNK),
                F.least(F.col("b"), F.col("c") * CHUNK + (CHUNK - 1)),
            )
        ).alias(tick),
        *[F.lit(0).cast("bigint").alias(v) for v in values],
    )
    both = counts.select(tick, *values).unionByName(spine)
    return both.groupBy(tick).agg(*[F.sum(v).alias(v) for v in values])


def trailing_frame(
    ticks: DataFrame, tick: str, values: list[str], size: int, make
) -> DataFrame:
    """Aggregates over the last `size` ticks (1 <= size <= CHUNK), tick by tick.

    `make(column, window)` builds the output columns. Every tick is also sent to the
    following chunk when that chunk's first frames reach back to it.
    """
    if not 1 <= size <= CHUNK:
        raise ValueError(f"frame must have 1 to {CHUNK} ticks")
    own = chunk_of(F.col(tick))
    tail = F.pmod(F.col(tick), F.lit(CHUNK)) >= CHUNK - (size - 1)
    spread = ticks.withColumn(
        "__chunk", F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    window = Window.partitionBy("__chunk").orderBy(tick).rowsBetween(-(size - 1), 0)
    framed = spread.select(
        "*", *[make(F.col(v), window).alias(f"__{v}") for v in values],
        F.count("*").over(window).alias("samples"),
    )
    kept = framed.filter(F.col("__chunk") == chunk_of(F.col(tick)))
    renamed = kept.drop("__chunk", *values).withColumnsRenamed({f"__{v}": v for v in values})
    return renamed


def running_totals(
    rows: DataFrame, tick: str, values: list[str], by: list[str] | None = None
) -> DataFrame:
    """Sums of `values` over all ticks up to and including each tick (per `by` group)."""
    by = by or []
    marked = rows.withColumn("__chunk", chunk_of(F.col(tick)))
    before = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = marked.groupBy(*by, "__chunk").agg(*[F.sum(v).alias(f"__{v}") for v in values])
    offsets = totals.select(
        *by, "__chunk",
        *[F.coalesce(F.sum(f"__{v}").over(before), F.lit(0)).alias(f"__{v}") for v in values],
    )
    inside = (
        Window.partitionBy(*by, "__chunk").orderBy(tick)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = marked.withColumns({v: F.sum(v).over(inside) for v in values})
    return (
        running.join(offsets, [*by, "__chunk"])
        .withColumns({v: (F.col(v) + F.col(f"__{v}")).cast("bigint") for v in values})
        .drop("__chunk", *[f"__{v}" for v in values])
    )
