"""Helpers of the operators: shared tables, blocks of documents, folds and word positions."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are separated by these bytes: space, tab, line feed, vertical tab, form feed, return.
BLANKS = bytes([9, 10, 11, 12, 13, 32])
#: Text per block of documents that one Python call handles.
BLOCK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below spark.checkpoint.dir; its default in local mode is Spark's own temp folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        from dnsflow.plans.shared import shared_folder

        return shared_folder(spark, purpose)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows read back from a table in the shared folder: lineage ends there."""
    spark = df.sparkSession
    path = shared_path(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null ids belong to fold -1."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts)), F.lit(-1))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def in_blocks(docs: DataFrame, doc_id: str, column: str, total: int, size: int = BLOCK_BYTES) -> DataFrame:
    """(block, doc_id, text), dealt out evenly by a hash; about `size` bytes of text per block."""
    blocks = max(1, -(-total // size))
    return docs.select(
        F.pmod(F.xxhash64(F.col(doc_id), F.octet_length(column), F.substring(column, 1, 64)), F.lit(blocks)).cast("int").alias("block"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(column).cast("binary").alias("text"),
    )


def sorted_block(rows: pa.Table) -> tuple[list, list[bytes]]:
    """Ids and texts of a block in a fixed order: by id, null ids last, then by text. Null texts are empty."""
    pairs = sorted(
        zip(rows["doc_id"].to_pylist(), (t or b"" for t in rows["text"].to_pylist())),
        key=lambda p: (p[0] is None, p[0] or 0, p[1]),
    )
    return [p[0] for p in pairs], [p[1] for p in pairs]


def place(doc_id: str) -> Column:
    """A number in [0, 1) that a hash of the id gives."""
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << 30)) / F.lit(1 << 30)


def smallest(ids: DataFrame, n: int) -> DataFrame:
    """At most n rows of (doc_id): those with the smallest hashes. A cut by hash keeps the sort small at any size."""
    rows = ids.count()
    cut = min(1.0, 2 * n / max(1, rows) + 4 * (n / max(1, rows) / max(1, rows)) ** 0.5)
    return ids.filter(place("doc_id") <= cut).orderBy(place("doc_id"), "doc_id").limit(n)


# -- word hashes ---------------------------------------------------------------------------------

_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(BLANKS)] = True
_STEP = {0: 0x9E3779B97F4A7C15, 1: 0xC2B2AE3D27D4EB4F}  # odd multipliers of the two hash families
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(family: int, inverse: bool, n: int) -> np.ndarray:
    """The first n powers of the family's multiplier, or of its inverse, modulo 2**64."""
    have = _POWERS.get((family, inverse))
    if have is None or len(have) < n:
        base = _STEP[family] if not inverse else pow(_STEP[family], -1, 1 << 64)
        factors = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        factors[0] = 1
        have = _POWERS[family, inverse] = np.multiply.accumulate(factors)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int) -> np.ndarray:
    """Polynomial hashes of values[start:end], starts and ends counted in `values`."""
    n = len(values)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * _powers(family, False, n), out=total[1:])
    return (total[ends] - total[starts]) * _powers(family, True, n)[starts]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte array."""
    solid = np.zeros(len(data) + 2, dtype=np.int8)
    solid[1:-1] = ~_BLANK[data]
    edge = np.diff(solid)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int, piece: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of every word; works through the bytes in pieces that end between words."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + piece, side="right")))
        low, high = int(starts[at]), int(ends[stop - 1])
        s, e = starts[at:stop] - low, ends[at:stop] - low
        h = _ranges(data[low:high].astype(np.uint64) + np.uint64(1), s, e, family)
        out[at:stop] = mixed(h + (e - s).astype(np.uint64) * np.uint64(_STEP[1 - family]))
        at = stop
    return out


def window_hashes(words: np.ndarray, width: int, family: int) -> np.ndarray:
    """A 64-bit hash of every `width` consecutive word hashes; one shorter list has none."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    step = 1 << 16
    for low in range(0, n, step):
        high = min(n, low + step)
        at = np.arange(high - low)
        out[low:high] = mixed(_ranges(words[low:high + width - 1], at, at + width, family))
    return out
