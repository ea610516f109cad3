"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit of a fingerprint stands for a non-zero vector of four bits, and every non-zero vector v
gives a table whose key keeps the bits whose vector has an odd product with v. Three differing bits
span at most three dimensions, so some v is orthogonal to all of them: every pair within the radius
agrees on the key of some table, without exception.

A crowded key is not compared as a whole: the same construction on the bits that its key leaves out
divides it, twice if need be. After that at most eight bits are open, so a group stays small
whatever the data are, and no pair within the radius is lost.

For a radius r in general, vectors of r + 1 bits give 2^(r+1) - 1 tables. `candidates` takes any radius up to eight for
callers that compare the texts themselves, and divides a crowded key until at most nine bits are open;
fingerprints can be made of any shingles by `majority`.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnsflow.llm import common, components

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Fingerprints that are compared with each other in one step; more are divided further.
CROWD = 512
#: Open bits of a key that `candidates` does not divide further: no more than 2^9 fingerprints share it.
OPEN = 9
_STEP = 1 << 14


def majority(parts: Iterable[np.ndarray]) -> int:
    """A bit is 1 if it is set in over half the hashes of all parts; no hashes give 0."""
    set_bits, n = np.zeros(BITS, dtype=np.int64), 0
    for h in parts:
        bits = np.unpackbits(h.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int32)
        n += len(h)
    return int(np.packbits(set_bits * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes) -> int:
    """A bit is 1 if it is set in over half the XXH64 values of the three-word shingles; no words give 0."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    ends = list(itertools.accumulate(map(len, words)))
    ends = [e + i for i, e in enumerate(ends)]  # with one space between words
    joined = b" ".join(words)
    starts = [0] + [e + 1 for e in ends[:-1]]
    n, digest = len(words) - SHINGLE + 1, xxhash.xxh64_intdigest
    return majority(
        np.array([digest(joined[s:e], SEED) for s, e in zip(starts[low:min(n, low + _STEP)], ends[low + SHINGLE - 1:])], dtype="<u8")
        for low in range(0, n, _STEP)
    )


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def covering_masks(open_bits: int, radius: int = RADIUS, vectors: list[int] | None = None) -> list[int]:
    """2^(radius+1) - 1 masks over the given bits, 15 for three: any `radius` of these bits are all left out by one of the masks.

    vectors: all non-zero vectors of radius + 1 bits, in the order in which the bits take them.
    """
    places, number = [i for i in range(BITS) if open_bits >> i & 1], (1 << radius + 1) - 1
    vector = {place: vectors[j % number] if vectors else 1 + j % number for j, place in enumerate(places)}
    return [sum(1 << i for i, m in vector.items() if (m & v).bit_count() & 1) for v in range(1, number + 1)]


def _levels() -> list[list[list[int]]]:
    """For every level the masks below each mask of the level before, what that mask keeps included."""
    out, above = [], [0]
    for _ in range(3):
        out.append([[m | got for m in covering_masks(((1 << BITS) - 1) ^ got)] for got in above])
        above = [m for masks in out[-1] for m in masks]
    return out


LEVELS = _levels()


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint (its 64 bits as a long) of every row."""

    def run(batches):
        for batch in batches:
            got = np.array([fingerprint(t.as_py() or b"") for t in batch[1]], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(got.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, fp long"
    )


def _keyed(rows: DataFrame, level: list[list[int]]) -> DataFrame:
    """(node, fp, path, key): a row per mask; path numbers the masks chosen so far."""
    masks = F.array(*[F.array(*[F.lit(_signed(m)) for m in below]) for below in level])
    keys = F.transform(
        F.element_at(masks, F.col("path") + 1),
        lambda m, i: F.struct((F.col("path") * len(level[0]) + i).alias("path"), F.col("fp").bitwiseAND(m).alias("key")),
    )
    return rows.select("node", "fp", F.explode(keys).alias("k")).select("node", "fp", "k.path", "k.key")


@functools.cache
def _powers(radius: int) -> list[int]:
    """All non-zero vectors of radius + 1 bits as the powers of a generator of their field.

    As many in a row as they have bits are independent, so every mask over more places than that keeps some of them, about half.
    """
    n = radius + 1
    for polynomial in range((1 << n) + 1, 1 << n + 1, 2):
        out, x = [1], 2
        while x != 1:
            out.append(x)
            x <<= 1
            x ^= polynomial * (x >> n)
        if len(out) == (1 << n) - 1:
            break
    return out


@functools.lru_cache(1 << 12)
def _below(path: int, radius: int) -> np.ndarray:
    """The masks over the bits that a mask leaves out, as longs; what that mask keeps is in them."""
    kept = path % (1 << BITS)
    masks = covering_masks(((1 << BITS) - 1) ^ kept, radius, _powers(radius))
    return np.array([kept | m for m in masks], dtype=np.uint64).view(np.int64)


def _divided(radius: int):
    """Rows (node, fp, path) as rows (node, fp, path, key) for every mask below path, which is all that the masks chosen so far keep."""

    def run(batches):
        for batch in batches:
            paths, at = np.unique(batch[2].to_numpy(), return_inverse=True)
            masks = np.array([_below(int(p), radius) for p in paths], dtype=np.int64).reshape(-1, (1 << radius + 1) - 1)[at]
            node, fp = (np.repeat(batch[i].to_numpy(), masks.shape[1]) for i in (0, 1))
            path = masks.reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (node, fp, path, fp & path)], ["node", "fp", "path", "key"])

    return run


def _near(a: Column, b: Column, radius: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def _stars(radius: int):
    """Joins the fingerprints of every group that are linked to the smallest node of their part."""

    def run(batches):
        for batch in batches:
            left, right = [], []
            for group in batch[0]:
                rows = sorted((r["node"], r["fp"]) for r in group.as_py())
                node, fp = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]).view(np.uint64)
                linked = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
                part = np.arange(len(rows))
                while True:  # each takes the least part among its neighbours
                    least = np.where(linked, part[None, :], len(rows)).min(axis=1)
                    if (least == part).all():
                        break
                    part = least
                other = part != np.arange(len(rows))
                left.append(node[part[other]])
                right.append(node[other])
            empty = np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([empty, *x])) for x in (left, right)], ["a", "b"])

    return run


def _sizes(keyed: DataFrame) -> DataFrame:
    """(path, key, n, x, y): the keys of several fingerprints, with the first and the last of them."""
    pair = F.struct("node", "fp")
    counted = keyed.groupBy("path", "key").agg(F.count("*").alias("n"), F.min(pair).alias("x"), F.max(pair).alias("y"))
    return common.written(counted.filter("n > 1"), "keys")


def _met(keyed: DataFrame, sizes: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) that connect what fingerprints of one of these keys within the radius connect."""
    two = sizes.filter("n = 2").filter(_near(F.col("x.fp"), F.col("y.fp"), radius))
    some = keyed.join(sizes.filter("n > 2").select("path", "key"), ["path", "key"])
    stars = some.groupBy("path", "key").agg(F.collect_list(F.struct("node", "fp")).alias("rows")).select("rows").mapInArrow(_stars(radius), "a long, b long")
    return two.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).unionByName(stars)


def links(classes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect just what fingerprints within the radius connect.

    classes: (node, fp), one row per distinct fingerprint.
    """
    rows, out = classes.withColumn("path", F.lit(0)), []
    for level in LEVELS:
        keyed = _keyed(rows, level)
        sizes, last = _sizes(keyed), level is LEVELS[-1]
        out.append(_met(keyed, sizes if last else sizes.filter(f"n <= {CROWD}"), RADIUS))
        if last or sizes.filter(f"n > {CROWD}").isEmpty():
            break
        rows = common.written(keyed.join(sizes.filter(f"n > {CROWD}").select("path", "key"), ["path", "key"]).select("node", "fp", "path"), "crowds")
    edges = out[0]
    for more in out[1:]:
        edges = edges.unionByName(more)
    return edges


def candidates(classes: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) that connect just what fingerprints within any radius up to eight connect.

    A crowded key is divided by masks that tasks make, as more bits than RADIUS ask for too many of them to list; it is left
    alone once all its fingerprints are connected, be it by others or by the first of them.
    """
    masks = F.explode(F.array(*[F.lit(_signed(m)) for m in covering_masks((1 << BITS) - 1, radius)]))
    keyed = classes.select("node", "fp", masks.alias("path")).withColumn("key", F.col("fp").bitwiseAND(F.col("path")))
    edges = None
    while True:
        sizes = _sizes(keyed)
        crowded = (F.col("n") > CROWD) & (F.bit_count("path") < BITS - OPEN)
        met = _met(keyed, sizes.filter(~crowded), radius)
        edges = met if edges is None else edges.unionByName(met)
        if sizes.filter(crowded).isEmpty():
            return edges
        rows = keyed.join(sizes.filter(crowded).select("path", "key", "x"), ["path", "key"])
        first = rows.filter(_near(F.col("fp"), F.col("x.fp"), radius)).select(F.col("x.node").alias("a"), F.col("node").alias("b"))
        edges = common.written(edges.unionByName(first), "met")
        rows = rows.join(components.connected(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
        apart = rows.groupBy("path", "key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most")
        rows = rows.join(apart.select("path", "key"), ["path", "key"]).select("node", "fp", "path")
        keyed = common.written(rows, "crowds").mapInArrow(_divided(radius), "node long, fp long, path long, key long")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row.

    component_id is the smallest id reachable over fingerprints that differ in at most three bits.
    Null, empty and blank texts have fingerprint zero and are linked like any other. Rows with a
    null id get a fingerprint, link with nothing and have a null component. Rows that repeat an id
    are one node: their links are joined. An empty table gives an empty result; other columns are
    ignored.
    """
    prints = common.written(fingerprints(docs, doc_id, text), "prints")
    classes = common.written(prints.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    same = prints.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).filter("x <> y")
    # ids with several fingerprints join their classes
    repeated = prints.join(same.select("doc_id"), "doc_id", "left_semi").join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    roots = components.connected(links(classes).unionByName(repeated))
    found = prints.join(classes, "fp", "left").join(roots, "node", "left")
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "node")).alias("component_id"),
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that have the smallest id of their group; null ids stay.

    Of several rows with that id, the one with the smallest hash of its text stays.
    """
    first = groups(docs, doc_id, text).filter("doc_id = component_id").select(F.col("doc_id").alias(doc_id)).distinct()
    kept = docs.join(first, doc_id, "left_semi")
    hashed = F.struct(F.xxhash64(F.col(text)), F.octet_length(text))
    ranked = Window.partitionBy(doc_id).orderBy(hashed)
    number = next(n for n in map("row_{}".format, itertools.count()) if n not in docs.columns)
    kept = kept.withColumn(number, F.row_number().over(ranked)).filter(F.col(number) == 1).drop(number)
    return kept.unionByName(docs.filter(F.col(doc_id).isNull()))


def op5_simhash_covering(spark, sf_dir) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    return groups(common.table(spark, sf_dir, "documents"))
