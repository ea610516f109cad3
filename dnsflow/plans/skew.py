"""Keeping one busy key from becoming one task.

Sequence operators (matching, transfers, reassembly) work on all rows of a key in time
order. A key may hold a large share of all rows, so keys are first counted: a fixed-size
histogram of key hashes rules out most, the rest is counted exactly. A sketch taken while
the rows were written can spare that. Rows of crowded keys are cut into time
chunks; what is still open at the end of a chunk is handed to the next one by
`settle_carry`, which repeats until nothing changes. That is exact: after round n the
first n chunks of every key are final, and in practice two or three rounds settle all.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from dnsflow.plans.shared import shared_folder

HISTOGRAM_BUCKETS = 1 << 18
ROWS_PER_GROUP = 200_000


#: Crowded keys that are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 100_000


@dataclass(frozen=True)
class KeySketch:
    """Counters of key hashes: in every row of counters, each key adds to one of them."""

    counters: tuple[tuple[int, ...], ...]

    #: Counters in a row; what a task sends to the driver is bounded by it.
    WIDTH = 1 << 12

    @property
    def most(self) -> int:
        """No key occurs more often than this."""
        return min(max(row) for row in self.counters)

    @classmethod
    def parsed(cls, data: bytes) -> KeySketch:
        """From the bytes of Spark's count-min sketch: version, total, depth and width, a factor for each row, the counters."""
        depth, width = struct.unpack(">ii", data[12:20])
        flat = struct.unpack(f">{depth * width}q", data[20 + 8 * depth : 20 + 8 * depth + 8 * depth * width])
        return cls(tuple(flat[i : i + width] for i in range(0, len(flat), width)))


class Sketching:
    """Takes a sketch of the keys while the rows pass for another action, so that counting needs no scan of its own.

    `rows` must be used in an action, such as writing the table that is read afterwards; `sketch()` then has the counters.
    """

    def __init__(self, df: DataFrame, keys: list[str]):
        self._seen = Observation()
        sketch = F.count_min_sketch(F.xxhash64(*keys), F.lit(2.0 / KeySketch.WIDTH), F.lit(0.9), F.lit(7))
        self.rows = df.observe(self._seen, sketch.alias("sketch"))

    def sketch(self) -> KeySketch:
        return KeySketch.parsed(bytes(self._seen.get["sketch"]))


@dataclass(frozen=True)
class SkewPolicy:
    """How many rows of a key one group may hold, and a sketch of the keys if one was taken.

    The sketch must have been taken by the same key columns from these or more rows.
    """

    rows_per_group: int = ROWS_PER_GROUP
    enabled: bool = True
    sketch: KeySketch | None = None


def key_bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(HISTOGRAM_BUCKETS)).cast("int")


def crowded_keys(df: DataFrame, keys: list[str], time_us: Column, min_width_us: int, policy: SkewPolicy) -> DataFrame | None:
    """(__key, chunk_us): hashes of the keys that really hold more rows than a group may, or None.

    A histogram of fixed size rules out what it can: at most HISTOGRAM_BUCKETS rows come to the driver. Rows of the buckets
    that are left are then counted by key and by stretch of the least width, pre-aggregated before the shuffle, so a
    bucket that many ordinary keys fill costs a narrow aggregation and marks none of them. The busiest stretch
    decides how wide a chunk may be, so that a burst is cut as finely as it has to be.
    """
    large = (
        df.groupBy(key_bucket(keys).alias("__bucket")).agg(F.count("*").alias("n"))
        .filter(F.col("n") > policy.rows_per_group).select("__bucket").collect()
    )
    if not large:
        return None
    rows = df.select(key_bucket(keys).alias("__bucket"), F.xxhash64(*keys).alias("__key"), F.floor(time_us / min_width_us).alias("bin"))
    if len(large) < HISTOGRAM_BUCKETS:
        rows = rows.join(F.broadcast(df.sparkSession.createDataFrame(large, "__bucket int")), "__bucket")
    bins = rows.groupBy("__key", "bin").count()
    counted = bins.groupBy("__key").agg(F.sum("count").alias("n"), F.max("count").alias("most"))
    width = min_width_us * F.greatest(F.lit(1), F.floor(F.lit(policy.rows_per_group) / F.col("most")))
    crowded = cut_lineage(counted.filter(F.col("n") > policy.rows_per_group).select("__key", width.cast("bigint").alias("chunk_us")))
    return None if crowded.isEmpty() else crowded


def split_hot(
    df: DataFrame, keys: list[str], time_us: Column, min_width_us: int, policy: SkewPolicy
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of crowded keys with a `chunk` column or None).

    Crowded are only keys with more than `rows_per_group` rows. There are fewer of them than rows / rows_per_group;
    they are broadcast if a count shows them few, else joined by a shuffle.
    """
    if not policy.enabled or (policy.sketch is not None and policy.sketch.most <= policy.rows_per_group):
        return df, None
    hot = crowded_keys(df, keys, time_us, min_width_us, policy)
    if hot is None:
        return df, None
    if hot.count() <= BROADCAST_KEYS:
        hot = F.broadcast(hot)
    marked = df.withColumn("__key", F.xxhash64(*keys))
    cold_rows = marked.join(hot, "__key", "left_anti").drop("__key")
    hot_rows = (
        marked.join(hot, "__key")
        .withColumn("chunk", F.floor(time_us / F.col("chunk_us")).cast("bigint"))
        .drop("__key")
    )
    return cold_rows, hot_rows


def ensure_checkpoint_dir(df: DataFrame) -> None:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoint"))


def cut_lineage(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df)
    return df.checkpoint()


def settle_carry(
    chunks: DataFrame,
    keys: list[str],
    step: Callable[[DataFrame], DataFrame],
    carry_fields: list[str],
) -> DataFrame:
    """`chunks` joined with the carry each of them really receives.

    `step` maps chunks with their incoming carry columns to (keys, chunk, carry columns),
    the carry every chunk leaves behind; chunks that leave nothing may be missing. The
    carry reaches the directly following chunk only, so a chunk must be at least as wide
    as the longest time anything may stay open.
    """
    on = [*keys, "chunk"]
    schema = {f.name: f.dataType for f in chunks.schema.fields}
    incoming = chunks.select(*on, *carry_fields).limit(0)
    base = chunks.drop(*carry_fields)

    def received(carry: DataFrame) -> DataFrame:
        empty = {c: F.array().cast(schema[c]) for c in carry_fields}
        joined = base.join(carry, on, "left")
        return joined.withColumns({c: F.coalesce(F.col(c), empty[c]) for c in carry_fields})

    print_of = F.xxhash64(*carry_fields)
    while True:
        left = step(received(incoming)).withColumn("chunk", F.col("chunk") + 1)
        # Empty carries are dropped after the cut: a filter before it would be pushed into
        # `step` and repeat its expressions.
        left = cut_lineage(left.select(*on, *carry_fields)).filter(
            F.greatest(*[F.size(c) for c in carry_fields], F.lit(0)) > 0
        )
        before = incoming.select(*on, print_of.alias("__old"))
        after = left.select(*on, print_of.alias("__new"))
        moved = before.join(after, on, "full").filter(~F.col("__old").eqNullSafe(F.col("__new")))
        settled = moved.isEmpty()
        incoming = left
        if settled:
            return received(incoming)
