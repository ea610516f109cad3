"""Embedding near-duplicates by Euclidean p-stable hashing with exact cosine checks.

Normalised vectors are projected on Gaussian directions, shifted and cut into steps; several such
numbers form the key of a table. Vectors that agree on a key of some table are compared by their
exact cosine. Equal vectors are first folded into one with a count. A crowded key is compared in
square blocks of bounded size that many tasks share; blocks return sums and star edges, never pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnsflow.llm import common, components

LEAST_COSINE = 0.98
#: Two vectors at cosine 0.98 agree on one number with probability 0.87, on a key with 0.24, and
#: miss all tables with 0.001; unrelated vectors share a key with 0.00001.
TABLES, NUMBERS, STEP, SEED = 24, 10, 1.2, 7
#: Rows on a side of a block.
BLOCK_ROWS = 256


def _directions(size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED + size)
    return rng.standard_normal((size, TABLES * NUMBERS)), rng.uniform(0, STEP, TABLES * NUMBERS)


def keys(vectors: np.ndarray) -> np.ndarray:
    """One 64-bit key per table for every normalised vector."""
    directions, shift = _directions(vectors.shape[1])
    steps = np.floor((vectors @ directions + shift) / STEP).astype(np.int64).view(np.uint64).reshape(len(vectors), TABLES, NUMBERS)
    h = np.zeros((len(vectors), TABLES), dtype=np.uint64)
    for i in range(NUMBERS):
        h = common.mixed(h * np.uint64(31) + steps[:, :, i])
    return h.view(np.int64)


def _vector(value) -> np.ndarray | None:
    """The vector in double precision, or None if it links with nothing."""
    if not value or any(x is None for x in value):
        return None
    v = np.array(value, dtype=np.float64)
    return v if np.isfinite(v).all() and v.any() else None


def _normal(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()  # no overflow or underflow in the norm
    return v / np.sqrt(v @ v)


def _identified(batches):
    """(vec_id, label, digest of the vector, its keys); no digest if the vector links with nothing."""
    for batch in batches:
        digest, signs = [], []
        for i, label, value in zip(batch[0], batch[1], batch[2]):
            v = _vector(value.as_py()) if i.is_valid and label.is_valid else None
            digest.append(hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest() if v is not None else None)
            signs.append(_normal(v) if v is not None else None)
        out: list = [None] * len(signs)
        for size in {len(v) for v in signs if v is not None}:
            at = [i for i, v in enumerate(signs) if v is not None and len(v) == size]
            for i, k in zip(at, keys(np.stack([signs[i] for i in at]))):
                out[i] = k
        yield pa.RecordBatch.from_arrays(
            [batch[0], batch[1], pa.array(digest, pa.binary()), pa.array(out, pa.list_(pa.int64())), batch[2]],
            ["vec_id", "label", "digest", "keys", "embedding"],
        )


def _linked(left: list[dict], right: list[dict], same: bool, out: dict, least: float) -> None:
    """Compares two sides of a block; `same`: both are the same rows."""
    a, b = (np.stack([_normal(np.array(r["embedding"], dtype=np.float64)) for r in side]) for side in (left, right))
    ka, kb = (np.array([r["keys"] for r in side], dtype=np.int64) for side in (left, right))
    ca, cb = (np.array([r["copies"] for r in side], dtype=np.int64) for side in (left, right))
    na, nb = (np.array([r["node"] for r in side], dtype=np.int64) for side in (left, right))
    table = left[0]["table"]
    sum_a, sum_b, low_a, low_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64), na.copy(), nb.copy()
    for i in range(0, len(a), 256):
        near = a[i:i + 256] @ b.T >= least
        if same:
            near &= np.arange(len(b))[None, :] > np.arange(i, min(len(a), i + 256))[:, None]
        x, y = np.nonzero(near)
        x += i
        new = np.ones(len(x), dtype=bool)  # a pair counts in the first table that holds it
        for t in range(table):
            new &= ka[x, t] != kb[y, t]
        x, y = x[new], y[new]
        np.add.at(sum_a, x, cb[y])
        np.add.at(sum_b, y, ca[x])
        np.minimum.at(low_a, x, nb[y])
        np.minimum.at(low_b, y, na[x])
        out["edges"].update((int(p), int(q)) for p, q in _spanning(na[x], nb[y]))
    for rows, sums in ((left, sum_a), (right, sum_b)):
        for r, n in zip(rows, sums):
            if n:
                key = (r["label"], r["digest"])
                out["sums"][key] = out["sums"].get(key, 0) + int(n)


def _spanning(x: np.ndarray, y: np.ndarray):
    """Edges that connect what the given ones connect, one per node at most."""
    nodes, at = np.unique(np.concatenate((x, y)), return_inverse=True)
    p, q, part = at[: len(x)], at[len(x):], np.arange(len(nodes))
    while True:
        low = np.minimum(part[p], part[q])
        new = part.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = np.minimum(new, new[new])
        if (new == part).all():
            break
        part = new
    other = part != np.arange(len(nodes))
    return zip(nodes[part[other]], nodes[other])


def _compared(least: float):
    """Rows sorted by block, each with its side; yields sums of copies by vector and edges."""

    def run(batches):
        rows, group = [], None
        empty = lambda: {"edges": set(), "sums": {}}
        out = empty()

        def handled():
            both = [r for r in rows if r["i"] == r["j"]]
            if both:
                _linked(both, both, True, out, least)
            else:
                left, right = ([r for r in rows if r["part"] == r[side]] for side in ("i", "j"))
                if left and right:
                    _linked(left, right, False, out, least)

        def batch():
            n, m = len(out["edges"]), len(out["sums"])
            edges, sums = sorted(out["edges"]), sorted(out["sums"].items())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([e[0] for e in edges] + [None] * m, pa.int64()), pa.array([e[1] for e in edges] + [None] * m, pa.int64()),
                    pa.array([None] * n + [s[0][0] for s in sums], pa.int32()), pa.array([None] * n + [s[0][1] for s in sums], pa.binary()),
                    pa.array([None] * n + [s[1] for s in sums], pa.int64()),
                ],
                ["a", "b", "label", "digest", "n"],
            )

        for b in batches:
            for r in b.to_pylist():
                mine = (r["label"], r["table"], r["key"], r["i"], r["j"])
                if mine != group and rows:
                    handled()
                    rows = []
                    if len(out["edges"]) + len(out["sums"]) > 50_000:
                        yield batch()
                        out = empty()
                group = mine
                rows.append(r)
        if rows:
            handled()
        yield batch()

    return run


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = LEAST_COSINE
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Vectors of one label and length link at a cosine of `least` or more, in double precision.
    n_links: other rows linked directly; component_id: the smallest id reachable; kept: the row has
    that id. Null ids or labels, null, empty and zero vectors and vectors with null or non-finite
    components link with nothing: no links, a component of their own (null if the id is). Rows that
    repeat an id are one node, and each counts as a link of the others it equals. An empty table
    gives an empty result; other columns are ignored.
    """
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("int").alias("label"), F.col(embedding).cast("array<double>").alias("embedding")
    )
    found = common.written(rows.mapInArrow(_identified, "vec_id long, label int, digest binary, keys array<long>, embedding array<double>"), "vectors")
    classes = common.written(
        found.filter("digest IS NOT NULL").groupBy("label", "digest").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("embedding").alias("embedding")),
        "classes",
    )
    keyed = classes.select("label", "digest", "node", F.posexplode("keys").alias("table", "key"))
    sizes = common.written(keyed.groupBy("label", "table", "key").agg(F.count("*").alias("n")).filter("n > 1"), "keys")
    crowd = keyed.join(sizes, ["label", "table", "key"])
    parts = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    part = F.pmod(F.xxhash64("digest"), parts).cast("int")
    crowd = crowd.select("label", "table", "key", "digest", "node", part.alias("part"), parts.alias("parts"))
    # a row meets every part of its key once; i <= j names the block
    crowd = crowd.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    crowd = crowd.select("label", "table", "key", "digest", "node", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    # the vector itself is fetched only for rows that share a key
    full = crowd.join(classes.select("label", "digest", "copies", "keys", "embedding"), ["label", "digest"])
    block = ["label", "table", "key", "i", "j"]
    got = common.written(
        full.repartition(*block).sortWithinPartitions(*block, "digest").select(*block, "part", "digest", "node", "copies", "keys", "embedding")
        .mapInArrow(_compared(least), "a long, b long, label int, digest binary, n long"),
        "links",
    )
    sums = got.filter("n IS NOT NULL").groupBy("label", "digest").agg(F.sum("n").alias("n"))
    counts = common.written(
        classes.select("label", "digest", "node", "copies").join(sums, ["label", "digest"], "left")
        .select("label", "digest", "node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
        "counts",
    )
    named = found.select("vec_id", "label", "digest").join(counts, ["label", "digest"], "left")
    repeated = named.filter("vec_id <> node").select(F.col("vec_id").alias("a"), F.col("node").alias("b"))
    # rows that are mere copies reach their class by its smallest id; only ids of several classes add edges
    several = named.filter("node IS NOT NULL").groupBy("vec_id").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x <> y").select("vec_id")
    edges = got.filter("a IS NOT NULL").select("a", "b").unionByName(repeated.join(several.withColumnRenamed("vec_id", "a"), "a", "left_semi"))
    roots = components.connected(edges)
    result = named.join(roots, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "node", "vec_id").alias("component_id")
    )
    return result.select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op7_embedding_pstable(spark, sf_dir) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    return near_vectors(common.table(spark, sf_dir, "embeddings"))
