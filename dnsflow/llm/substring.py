"""Substring dedup with fixed-block anchors.

Every document is cut into non-overlapping anchors of `(window + 1) // 2` words; any `window`
words hold a whole anchor, so two equal windows always share one. Anchors of all documents are the
index, and every rolling run of that length probes it. Hits are then extended to whole windows,
which are compared by 128-bit hashes of their words; windows that touch form maximal exact repeats.

Documents are dealt into blocks by a hash of the id. A block sends each distinct value once, so a
passage that a third of all documents share costs one entry per block, and no task ever holds the
documents of a passage together. Three passes read the same shuffled blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnsflow.llm import common

WINDOW = 13
#: Text whose probes meet in one bucket.
BUCKET_BYTES = 16 << 20

_MESSAGE = "bucket int, block int, low binary, high binary, ids binary, mark binary"
_ANSWER = "block int, bucket int, bits binary, ids binary, mark binary"
_RESULT = (
    "doc_id long, n_words long, n_removed long, spans array<struct<first:long,last:long>>, kept_text string"
)


class _Block:
    """Words and window hashes of the documents of one block."""

    def __init__(self, rows: pa.Table, window: int):
        self.window, self.anchor = window, (window + 1) // 2
        self.ids, self.texts = common.sorted_block(rows)
        self.data = np.frombuffer(b"\n".join(self.texts), dtype=np.uint8)
        self.starts, self.ends = common.word_bounds(self.data)
        edges = np.concatenate(([0], np.cumsum([len(t) + 1 for t in self.texts])))
        self.first = np.searchsorted(self.starts, edges)  # first word of every document, and the end
        self.sizes = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.texts)), self.sizes)
        self.place = np.arange(len(self.starts)) - self.first[self.doc] if len(self.starts) else np.empty(0, int)
        self.known = np.array([i is not None for i in self.ids], dtype=bool)
        # windows may start here: whole window in a document that has an id
        room = self.sizes[self.doc] - self.place
        self.opens = (room >= window) & self.known[self.doc]
        self.probes = (room >= self.anchor) & (self.sizes[self.doc] >= window) & self.known[self.doc]

    def hashes(self, family: int) -> np.ndarray:
        return common.word_hashes(self.data, self.starts, self.ends, family)

    def padded(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.starts), dtype=values.dtype)
        out[: len(values)] = values
        return out


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, low, high) of the runs in a sorted array of buckets."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for low, high in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(bucket)]))):
        if high > low:
            yield int(bucket[low]), int(low), int(high)


def _probe_keys(block: _Block, words: np.ndarray, buckets: int):
    """Bucket and 32-bit value of every probe as one number: distinct ones, and each probe's place there."""
    h = block.padded(common.window_hashes(words, block.anchor, 0))[block.probes]
    bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.unique((bucket << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)), return_inverse=True)


def _candidates(block: _Block, hit: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Windows that hold a hit and no anchor of their own that occurs nowhere else."""
    reach = np.minimum(np.arange(len(hit)) + block.window - block.anchor + 1, len(hit))
    held = lambda marks: (total := np.concatenate(([0], np.cumsum(marks))))[reach] > total[:-1]
    return np.flatnonzero(block.opens & held(hit) & ~held(single))


def _grouped(block: _Block, words: np.ndarray, at: np.ndarray):
    h = [block.padded(common.window_hashes(words, block.window, 0))[at]]
    h.append(block.padded(common.window_hashes(block.hashes(1), block.window, 1))[at])
    order = np.lexsort((at, h[1], h[0]))
    a, b = h[0][order], h[1][order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
    return at, order, a, b, new


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    return pa.Table.from_arrays(
        [pa.array(list(c), type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_schema(ddl)), _schema(ddl))],
        schema=_schema(ddl),
    )


def _send_probes(window: int, buckets: int):
    def send(rows: pa.Table) -> pa.Table:
        block = _Block(rows, window)
        keys, place = _probe_keys(block, block.hashes(0), buckets)
        anchors = (block.place % block.anchor == 0)[block.probes]
        seen = np.bincount(place, minlength=len(keys)) if len(keys) else np.empty(0, int)
        held = np.bincount(place[anchors], minlength=len(keys)) if len(keys) else np.empty(0, int)
        flags = ((seen > 1) + 2 * np.minimum(held, 2)).astype(np.uint8)  # repeated; anchors 0, 1 or more
        number = rows["block"][0].as_py()
        low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        out = [
            (b, number, low[i:j].tobytes(), flags[i:j].tobytes(), None, None)
            for b, i, j in _slices((keys >> np.uint64(32)).astype(np.int64))
        ]
        return _table(out, _MESSAGE)

    return send


def _answer_probes(rows: pa.Table) -> pa.Table:
    """Two bits per value: probed more than once anywhere; an anchor anywhere."""
    values = [np.frombuffer(x, dtype=np.uint32) for x in rows["low"].to_pylist()]
    flags = np.concatenate([np.frombuffer(x, dtype=np.uint8) for x in rows["high"].to_pylist()])
    _, place, count = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    repeated = (count > 1) | (np.bincount(place, weights=flags & 1) > 0)
    anchored = np.bincount(place, weights=flags >> 1) > 0
    edges = np.concatenate(([0], np.cumsum([len(v) for v in values])))
    bucket = rows["bucket"].to_pylist()
    out = []
    for i, number in enumerate(rows["block"].to_pylist()):
        p = place[edges[i]:edges[i + 1]]
        out.append((number, bucket[i], np.packbits(np.concatenate((repeated[p], anchored[p]))).tobytes(), None, None))
    return _table(out, _ANSWER)


def _sorted_answers(rows: pa.Table) -> list[dict]:
    return sorted(rows.to_pylist(), key=lambda r: r["bucket"])


def _send_windows(window: int, buckets: int):
    def send(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows or not answers.num_rows:
            return _table([], _MESSAGE)
        block = _Block(rows, window)
        words = block.hashes(0)
        keys, place = _probe_keys(block, words, buckets)
        repeated, anchored = np.empty(len(keys), dtype=bool), np.empty(len(keys), dtype=bool)
        for answer, (_, i, j) in zip(_sorted_answers(answers), _slices((keys >> np.uint64(32)).astype(np.int64))):
            bits = np.unpackbits(np.frombuffer(answer["bits"], dtype=np.uint8), count=2 * (j - i)).astype(bool)
            repeated[i:j], anchored[i:j] = bits[: j - i], bits[j - i:]
        hit, single = np.zeros((2, len(block.starts)), dtype=bool)
        anchors = (block.place % block.anchor == 0)[block.probes]
        hit[block.probes] = np.where(anchors, repeated[place], anchored[place])
        single[block.probes] = anchors & ~repeated[place]
        at = _candidates(block, hit, single)
        if not len(at):
            return _table([], _MESSAGE)
        at, order, a, b, new = _grouped(block, words, at)
        a, b = a[new], b[new]
        ids = np.array([i or 0 for i in block.ids], dtype=np.int64)[block.doc[at[order[new]]]]  # the smallest: order is by position
        mark = np.zeros(len(block.starts), dtype=bool)
        mark[at] = True
        mark = np.packbits(mark).tobytes()
        number, out = rows["block"][0].as_py(), []
        for k, i, j in _slices((((a >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)):
            out.append((k, number, a[i:j].tobytes(), b[i:j].tobytes(), ids[i:j].tobytes(), None if out else mark))
        return _table(out, _MESSAGE)

    return send


def _answer_windows(rows: pa.Table) -> pa.Table:
    """For every value the smallest id anywhere, sent where it is below the block's own."""
    whole = lambda name, kind: np.concatenate([np.frombuffer(x, dtype=kind) for x in rows[name].to_pylist()])
    a, b, ids = whole("low", np.uint64), whole("high", np.uint64), whole("ids", np.int64)
    order = np.lexsort((ids, b, a))
    new = np.concatenate(([True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)))
    least = np.empty_like(ids)
    least[order] = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    edges = np.concatenate(([0], np.cumsum([len(x) // 8 for x in rows["low"].to_pylist()])))
    bucket, mark = rows["bucket"].to_pylist(), rows["mark"].to_pylist()
    out = []
    for i, number in enumerate(rows["block"].to_pylist()):
        s = slice(edges[i], edges[i + 1])
        below = least[s] < ids[s]
        out.append((number, bucket[i], np.packbits(below).tobytes(), least[s][below].tobytes(), mark[i]))
    return _table(out, _ANSWER)


def _finish(window: int, buckets: int):
    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        names = ("doc_id", "n_words", "n_removed", "spans", "kept_text")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.string())
        if not rows.num_rows:
            return pa.table({n: pa.array([], type=k) for n, k in zip(names, kinds)})
        block = _Block(rows, window)
        covered = np.zeros(len(block.starts) + 1, dtype=np.int64)
        if answers.num_rows:
            got = _sorted_answers(answers)
            mark = np.unpackbits(np.frombuffer(next(x["mark"] for x in got if x["mark"] is not None), dtype=np.uint8), count=len(block.starts))
            at, order, a, b, new = _grouped(block, block.hashes(0), np.flatnonzero(mark))
            ids = np.array([i or 0 for i in block.ids], dtype=np.int64)[block.doc[at[order]]]
            least, low = ids[new].copy(), 0
            sizes = np.bincount((np.cumsum(new) - 1))  # occurrences of every distinct window
            bucket = (((a[new] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
            for x in got:  # values of one bucket lie together, in the order in which they were sent
                n = int(np.searchsorted(bucket, x["bucket"], side="right")) - low
                below = np.unpackbits(np.frombuffer(x["bits"], dtype=np.uint8), count=n).astype(bool)
                least[low:low + n][below] = np.frombuffer(x["ids"], dtype=np.int64)
                low += n
            repeats = at[order[ids > np.repeat(least, sizes)]]
            np.add.at(covered, repeats, 1)
            np.add.at(covered, repeats + window, -1)
        gone = np.cumsum(covered)[:-1] > 0
        out = ([], [], [], [], [])
        for d, doc_id in enumerate(block.ids):
            i, j = block.first[d], block.first[d + 1]
            away = gone[i:j]
            if away.any():
                step = np.diff(np.concatenate(([0], away.astype(np.int8), [0])))
                spans = [{"first": int(x), "last": int(y) - 1} for x, y in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))]
                text = b" ".join(w for w, g in zip(block.texts[d].split(), away) if not g)
            else:
                spans, text = [], b" ".join(block.texts[d].split())
            for column, value in zip(out, (doc_id, int(j - i), int(away.sum()), spans, text)):
                column.append(value)
        out = (*out[:4], pa.array(out[4], type=pa.binary()).cast(pa.string()))
        return pa.table({n: c if isinstance(c, pa.Array) else pa.array(c, type=k) for n, k, c in zip(names, kinds, out)})

    return finish


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, block_bytes: int = common.BLOCK_BYTES
) -> DataFrame:
    """Documents without the words that a document with a smaller id already holds.

    A window is `window` consecutive words. Every word of a window that also starts in a document
    with a smaller id goes; all windows are judged on the input. Returns doc_id, n_words, n_removed,
    spans (maximal repeats, first and last word) and kept_text (words joined by one space).

    Null and empty texts have no words. Documents with a null id are kept whole and shield no
    others. Rows that repeat an id are judged one by one against smaller ids; equal ids never
    remove from each other. An empty table gives an empty result; other columns are ignored.
    """
    total = common.text_bytes(docs, text)
    buckets = max(1, -(-total // BUCKET_BYTES))
    blocks = common.in_blocks(docs, doc_id, text, total, block_bytes)
    answers = (
        blocks.groupBy("block").applyInArrow(_send_probes(window, buckets), _MESSAGE)
        .groupBy("bucket").applyInArrow(_answer_probes, _ANSWER)
    )
    answers = (
        blocks.groupBy("block").cogroup(answers.groupBy("block"))
        .applyInArrow(_send_windows(window, buckets), _MESSAGE)
        .groupBy("bucket").applyInArrow(_answer_windows, _ANSWER)
    )
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_finish(window, buckets), _RESULT)


def op1_substring_dedup(spark, sf_dir) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words of every document."""
    kept = remove_repeats(common.table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
