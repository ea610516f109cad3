"""Near copies by the Jaccard similarity of five-word shingles, 0.8 or more.

The covering masks of `simhash` give the first candidates: every two rows whose fingerprints, made of
their five-word shingles, differ in at most RADIUS bits meet in the key of some mask, and rows that are
connected in this way share one key here. Similar sets differ in about ten of 64 bits at the threshold, which
would ask for two thousand masks and more; for what lies beyond the radius, minimum hashes in 32 bands of five give further
keys: a pair at the threshold shares two of them but for five in a hundred thousand. No key is capped.

All candidates are compared exactly. Rows are first compared with one row of the key that the masks gave them,
then with one other row of the keys that they share with it most often, which joins most of what belongs together. Keys whose rows then
still are in several components go the exact way: the shingles of their rows are put in one order, the
rarest first, and two similar sets share one of the first fifth of either. Rows that share such a
shingle, and whose sizes and places allow the similarity, meet in blocks of bounded size, which return
spanning edges and never pairs.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dnsflow.llm import common, components, simhash

SHINGLE, LEAST = 5, 0.8
#: Differing bits of fingerprints that the covering masks allow for: 63 masks.
RADIUS = 5
BANDS, ROWS = 32, 5
#: Rounds of comparing each row with one other; the first takes the candidates of the masks alone.
ROUNDS = 3
#: Rows, and shingles of all its rows, in a side of a block.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19
_draw = np.random.default_rng(42)
_FACTORS = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_STEP = 1 << 14


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of the lower-cased text; fewer words are one shingle, no words none."""
    data = np.frombuffer(text.lower(), dtype=np.uint8)
    words = common.word_hashes(data, *common.word_bounds(data), 0)
    return np.unique(common.window_hashes(words, min(SHINGLE, len(words)), 1)) if len(words) else np.empty(0, dtype=np.uint64)


def _band_keys(values: np.ndarray) -> np.ndarray:
    """A key for each band, from the least values of as many hash functions as a band has rows."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for low in range(0, len(values), _STEP):
        part = values[low:low + _STEP]
        for i, (factor, term) in enumerate(zip(_FACTORS, _TERMS)):
            h = part * factor + term
            least[i] = min(least[i], (h ^ (h >> np.uint64(32))).min() if i % 2 else h.min())
    return common.mixed(common.mixed(least.reshape(BANDS, ROWS)) @ _FACTORS[:ROWS] + _TERMS[:BANDS])


def _fingerprint(values: np.ndarray) -> int:
    return simhash.majority(values[low:low + _STEP] for low in range(0, len(values), _STEP))


def _class(values: np.ndarray) -> tuple[bytes, int]:
    """A digest of a set of shingles, and a part of it that tells the sets of one id apart."""
    digest = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
    return digest, int.from_bytes(digest[:8], "little", signed=True)


def _prints(batches):
    for batch in batches:
        classes, sizes, prints, keys = [], [], [], []
        for text in batch[1]:
            values = shingles(text.as_py() or b"")
            classes.append(_class(values))
            sizes.append(len(values))
            prints.append(_fingerprint(values))
            keys.append(_band_keys(values).view(np.int64))
        offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS)
        flat = pa.array(np.concatenate([np.empty(0, dtype=np.int64), *keys]))
        yield pa.RecordBatch.from_arrays(
            [batch[0], pa.array([c[0] for c in classes], pa.binary()), pa.array([c[1] for c in classes], pa.int64()),
             pa.array(sizes, pa.int64()), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), pa.ListArray.from_arrays(offsets, flat)],
            ["doc_id", "digest", "tag", "size", "fp", "keys"],
        )


def _sets(batches):
    for batch in batches:
        for at in range(batch.num_rows):
            values = shingles(batch[1][at].as_py() or b"")
            yield pa.RecordBatch.from_arrays(
                [batch[0].slice(at, 1), pa.array([_class(values)[1]], pa.int64()), pa.array([values.view(np.int64)], pa.list_(pa.int64()))],
                ["node", "tag", "shingles"],
            )


def _allowed(size: np.ndarray, place: np.ndarray, component: np.ndarray) -> np.ndarray:
    """The pairs of a shingle's rows that can be similar if no shingle before this one is shared, as a matrix.

    What is left of the shorter rest must make up the overlap that both sizes ask for.
    """
    rest = np.minimum.outer(size - place, size - place).astype(np.float64)
    return (rest * (1 + LEAST) >= LEAST * np.add.outer(size, size) - 1e-6) & np.not_equal.outer(component, component)


def _promising(rows: pa.Table) -> pa.Table:
    """The rows of a block that have a partner in it."""
    size, place, component = (rows[c].to_numpy() for c in ("size", "place", "component"))
    return rows.filter(pa.array(_allowed(size, place, component).any(axis=1))).select(["shingle", "node", "tag", "size", "place", "component"])


def _spanning(rows: pa.Table) -> pa.Table:
    """Edges that join the rows of a block as their similar pairs do; rows of one component are joined already."""
    sets, nodes = [r.values.to_numpy() for r in rows["shingles"]], rows["node"].to_numpy()
    sizes, part = np.array([len(s) for s in sets]), np.unique(rows["component"].to_numpy(), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), sizes)
    item, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    column_of = np.cumsum(times > 1) - 1  # columns of the shingles that several rows hold
    shared, column = owner[times[item] > 1], column_of[item[times[item] > 1]]
    overlap = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for low in range(0, int(column.max(initial=-1)) + 1, 4096):
        held = (column >= low) & (column < low + 4096)
        dense = np.zeros((len(sets), 4096), dtype=np.float32)
        dense[shared[held], column[held] - low] = 1
        overlap += dense @ dense.T
    left, right = [], []
    near = overlap.astype(np.float64) >= LEAST * (sizes[:, None] + sizes[None, :] - overlap)
    for a, b in zip(*np.nonzero(np.triu(near & np.not_equal.outer(part, part), 1))):
        if part[a] != part[b]:
            part[part == part[b]] = part[a]
            left.append(nodes[a])
            right.append(nodes[b])
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def _in_squares(rows: DataFrame) -> DataFrame:
    """Rows with the corners (low, high) of the blocks in which they meet the other rows of their shingle.

    Shingles whose rows are all in one component are left out. Only a shingle with more rows or longer sets than a side holds has several blocks.
    """
    sides = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    mixed = rows.groupBy("shingle").agg(sides.alias("sides"), F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y")
    sided = rows.join(mixed.select("shingle", "sides"), "shingle").withColumn("side", F.pmod(F.xxhash64("tag", "node"), "sides").cast("int"))
    sided = sided.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    return sided.withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other")).drop("side", "sides", "other")


def _stars(apart: DataFrame, sets: DataFrame, turn: int) -> DataFrame:
    """Edges (a, b): each row of the keys with the row of another component that it shares most keys with, of one drawn for every key."""
    drawn = F.xxhash64(F.lit(turn), "node", "tag")
    first = apart.groupBy("key").agg(F.min_by(F.struct("node", "tag", "size", "component"), drawn).alias("first"))
    met = apart.join(first, "key").filter(F.col("component") != F.col("first.component"))
    met = met.filter(F.least("size", "first.size") >= LEAST * F.greatest("size", "first.size") - F.lit(1e-6))
    often = met.groupBy("node", "tag", F.col("first.node").alias("with_node"), F.col("first.tag").alias("with_tag")).agg(F.sum("times").alias("times")).filter("times > 1")
    most = F.max_by(F.struct("with_node", "with_tag"), F.struct("times", "with_tag", "with_node"))
    one = common.written(often.groupBy("node", "tag").agg(most.alias("w")).select("node", "tag", "w.*"), "tried")
    others = sets.select(F.col("node").alias("with_node"), F.col("tag").alias("with_tag"), F.col("shingles").alias("other"))
    tried = one.join(sets, ["node", "tag"]).join(others, ["with_node", "with_tag"])
    both = F.size(F.array_intersect("shingles", "other"))
    similar = both >= LEAST * (F.size("shingles") + F.size("other") - both)
    return tried.filter(similar).select(F.col("node").alias("a"), F.col("with_node").alias("b"))


def _exact(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) that join the rows of different components as their similar pairs do."""
    rows = apart.groupBy("node", "tag", "size", "component").agg(F.sum("times").alias("times")).filter("times > 1").drop("times")
    each = common.written(rows.join(sets, ["node", "tag"]).withColumn("shingle", F.explode("shingles")).drop("shingles"), "shingles")
    # shingles of one component come before all others, then the rarest
    shared = each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y")
    held = each.join(shared.select("shingle", "n"), "shingle")
    of_row = Window.partitionBy("node", "tag")
    held = held.withColumn("place", F.col("size") - F.count("*").over(of_row) + F.row_number().over(of_row.orderBy("n", "shingle")) - 1)
    prefix = common.written(held.filter(F.col("place") <= (1 - LEAST) * F.col("size") + F.lit(1e-6)).drop("n"), "prefix")
    kind = "shingle long, node long, tag long, size long, place long, component long"
    meeting = _in_squares(prefix).groupBy("shingle", "low", "high").applyInArrow(_promising, kind)
    meeting = common.written(meeting.distinct(), "meeting")
    return _in_squares(meeting).join(sets, ["node", "tag"]).groupBy("shingle", "low", "high").applyInArrow(_spanning, "a long, b long")


def _covered(distinct: DataFrame) -> DataFrame:
    """(node, tag, size, key, times): a key for every row, the same for all that fingerprints within RADIUS connect.

    It counts as two keys: nothing else is asked of a pair that shares it before it is compared.
    """
    prints = common.written(distinct.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    near = components.connected(simhash.candidates(prints, RADIUS))
    roots = prints.join(near, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))
    return distinct.join(roots, "fp").select("node", "tag", "size", F.xxhash64(F.lit("masks"), "root").alias("key"), F.lit(2).alias("times"))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, root) of all ids that have near copies: the smallest id reachable over similar texts.

    Blank and null texts are copies of each other. Rows that repeat an id are one node. Null ids are left out.
    """
    texts = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    prints = common.written(texts.mapInArrow(_prints, "doc_id long, digest binary, tag long, size long, fp long, keys array<long>"), "prints")
    # equal sets of shingles are one class
    classes = common.written(prints.groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")
    copies = prints.select("doc_id", "digest").join(classes, "digest").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).filter("a <> b")
    copies = common.written(copies.distinct(), "copies")
    own = prints.join(classes.select("digest", F.col("node").alias("doc_id")), ["digest", "doc_id"])
    distinct = own.groupBy(F.col("doc_id").alias("node"), "tag").agg(*[F.first(c).alias(c) for c in ("size", "fp", "keys")])
    distinct = common.written(distinct, "distinct")
    banded = distinct.select("node", "tag", "size", F.explode("keys").alias("key"), F.lit(1).alias("times"))
    keyed = banded.unionByName(_covered(distinct))
    crowds = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    members = common.written(keyed.join(crowds, "key"), "members")
    wanted = members.groupBy("node", "tag").agg(F.sum("times").alias("times")).filter("times > 1").drop("times")
    held = texts.join(wanted.select(F.col("node").alias("doc_id")).distinct(), "doc_id").mapInArrow(_sets, "node long, tag long, shingles array<long>")
    sets = common.written(held.join(wanted, ["node", "tag"], "left_semi").groupBy("node", "tag").agg(F.first("shingles").alias("shingles")), "sets")
    links = copies
    for turn in range(ROUNDS + 1):
        roots = components.connected(links)
        met = members.filter("times = 2") if turn == 0 < ROUNDS else members
        apart = met.join(roots, "node", "left").withColumn("component", F.coalesce("root", "node")).drop("root")
        mixed = apart.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y")
        apart = common.written(apart.join(mixed.select("key"), "key"), "apart")
        if turn < ROUNDS:
            more = _stars(apart, sets, turn)
        else:
            more = _exact(apart, sets)
        links = more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return components.connected(links)


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that have the smallest id of their group; null ids stay.

    Of several rows with that id, the one with the smallest hash of its text stays.
    """
    later = groups(docs, doc_id, text).filter("node <> root").select(F.col("node").alias(doc_id))
    kept = docs.filter(F.col(doc_id).isNotNull()).join(later, doc_id, "left_anti")
    hashed = F.struct(F.xxhash64(F.col(text)), F.octet_length(text))
    ranked = Window.partitionBy(doc_id).orderBy(hashed)
    number = next(n for n in map("row_{}".format, itertools.count()) if n not in docs.columns)
    kept = kept.withColumn(number, F.row_number().over(ranked)).filter(F.col(number) == 1).drop(number)
    return kept.select(*docs.columns).unionByName(docs.filter(F.col(doc_id).isNull()))
