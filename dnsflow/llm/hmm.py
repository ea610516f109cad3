"""Language-model scores of a hidden Markov model.

Words are counted over the whole training corpus. A hidden state emits a class of words (a hash of
the word, or the end of the text), and a class emits its words by their smoothed share, so every
state has a proper distribution over all words. Baum-Welch passes run over every training document
in the executors; only expected counts, whose size is fixed by the model, are added up and
returned. A text's likelihood is the scaled forward recursion, made exact and parallel by products
of transfer matrices over runs of words.

Counts are looked up by blocks of documents: a block asks once for each distinct word, so a word
that occurs everywhere costs one entry per block.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnsflow.llm import common

STATES = 6
CLASSES = 4096
#: Class of the end of a text, and of words that training never saw (emitted alike by every state).
END, UNKNOWN = CLASSES, CLASSES + 1
#: Starting point: rounds of Baum-Welch over at most so many documents of at most so many bytes.
START_DOCS, START_BYTES, START_ROUNDS = 600, 20_000, 15
#: Passes of Baum-Welch over all training documents.
PASSES = 2
PARTS, HELD = 7, 2
RUN = 32
BATCH_WORDS = 1 << 18
BUCKET_BYTES = 32 << 20
#: Weight of the mean over states when a state's counts are smoothed.
SMOOTHING = 50.0


def learned_from(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % PARTS != HELD


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move = start, move
        self.emit = np.ascontiguousarray(np.concatenate((emit, np.ones((len(emit), 1))), axis=1).T)  # by class, then state


def estimated(first: np.ndarray, moves: np.ndarray, emitted: np.ndarray) -> Model:
    """The model that expected counts make most likely, smoothed."""
    first, moves = first + 0.1, moves + 0.1
    share = (emitted.sum(axis=0) + 0.01) / (emitted.sum() + 0.01 * emitted.shape[1])
    emitted = emitted + SMOOTHING * share
    return Model(first / first.sum(), moves / moves.sum(axis=1, keepdims=True), emitted / emitted.sum(axis=1, keepdims=True))


class _Runs:
    """Sequences of classes cut into runs of equal length; the last run of a sequence is padded."""

    def __init__(self, classes: np.ndarray, sizes: np.ndarray):
        self.count = -(-sizes // RUN)
        self.first = np.concatenate(([0], np.cumsum(self.count)))  # first run of every sequence
        self.total = int(self.first[-1])
        at = np.arange(len(classes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.place = np.repeat(self.first[:-1], sizes) * RUN + at
        self.classes = np.full(self.total * RUN, -1, dtype=np.int64)
        self.classes[self.place] = classes
        self.classes = self.classes.reshape(self.total, RUN).T.copy()  # by step, then run
        self.opens = np.zeros(self.total, dtype=bool)
        self.opens[self.first[:-1]] = True


def _transfer(model: Model, runs: _Runs) -> tuple[np.ndarray, np.ndarray]:
    """Product of the step matrices of every run, scaled, and the logarithm of the scale."""
    k = len(model.start)
    x = np.broadcast_to(np.eye(k), (runs.total, k, k)).copy()
    logs = np.zeros(runs.total)
    opening = np.broadcast_to(model.start, (k, k))
    for step in range(RUN):
        c = runs.classes[step]
        live = c >= 0
        new = (x.reshape(-1, k) @ model.move).reshape(x.shape)
        if step == 0:
            new[runs.opens] = x[runs.opens] @ opening
        new *= model.emit[c][:, None, :]
        x = new if live.all() else np.where(live[:, None, None], new, x)
        if step % 4 == 3:
            top = x.max(axis=(1, 2))
            x /= top[:, None, None]
            logs += np.log(top)
    return x, logs


def _chained(model: Model, runs: _Runs, x: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State shares before every run, and every sequence's log-likelihood."""
    k = len(model.start)
    before = np.zeros((runs.total, k))
    a = np.zeros((len(runs.count), k))
    a[:, 0] = 1
    out = np.zeros(len(runs.count))
    order = np.argsort(-runs.count, kind="stable")
    sizes = runs.count[order]
    for j in range(int(sizes[0]) if len(sizes) else 0):
        who = order[: int(np.searchsorted(-sizes, -j, side="left"))]  # sequences with more than j runs
        at = runs.first[who] + j
        before[at] = a[who]
        nxt = np.einsum("si,sij->sj", a[who], x[at])
        total = nxt.sum(axis=1)
        a[who] = nxt / total[:, None]
        out[who] += np.log(total) + logs[at]
    return before, out


def log_likelihoods(model: Model, classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural logarithm of the likelihood of every sequence of classes; no sequence is empty."""
    runs = _Runs(classes, sizes)
    return _chained(model, runs, *_transfer(model, runs))[1]


def expected_counts(model: Model, classes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One E-step: expected first states, moves and emissions, and the log-likelihood."""
    k = len(model.start)
    runs = _Runs(classes, sizes)
    x, logs = _transfer(model, runs)
    before, likelihood = _chained(model, runs, x, logs)
    # backward over runs
    after, b = np.ones((runs.total, k)), np.ones((len(runs.count), k))
    order = np.argsort(-runs.count, kind="stable")
    counts = runs.count[order]
    for j in range(int(counts[0]) if len(counts) else 0):
        who = order[: int(np.searchsorted(-counts, -j, side="left"))]
        at = runs.first[who + 1] - 1 - j
        after[at] = b[who]
        nxt = np.einsum("sij,sj->si", x[at], b[who])
        b[who] = nxt / nxt.max(axis=1, keepdims=True)
    # forward and backward inside the runs
    forward = np.empty((RUN, runs.total, k))
    a = before
    for step in range(RUN):
        c = runs.classes[step]
        new = a @ model.move
        if step == 0:
            new[runs.opens] = model.start
        new *= model.emit[c]
        new /= new.sum(axis=1, keepdims=True)
        a = forward[step] = np.where((c >= 0)[:, None], new, a)
    first, moves, emitted = np.zeros(k), np.zeros((k, k)), np.zeros((k, CLASSES + 2))
    b = after
    for step in range(RUN - 1, -1, -1):
        c = runs.classes[step]
        live = c >= 0
        g = forward[step] * b
        g /= g.sum(axis=1, keepdims=True)
        for state in range(k):
            emitted[state] += np.bincount(c[live], weights=g[live, state], minlength=CLASSES + 2)
        back = model.emit[c] * b
        if step == 0:
            first += g[runs.opens & live].sum(axis=0)
            live = live & ~runs.opens
        left = (forward[step - 1] if step else before)[live]
        right = back[live]
        whole = np.einsum("si,ij,sj->s", left, model.move, right, optimize=True)
        moves += model.move * ((left / whole[:, None]).T @ right)
        new = back @ model.move.T
        new /= new.max(axis=1, keepdims=True)
        b = np.where((c >= 0)[:, None], new, b)
    return first, moves, emitted[:, : CLASSES + 1], float(likelihood.sum())


def _classes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (common.word_hashes(data, starts, ends, 0) >> np.uint64(40)).astype(np.int64) % CLASSES


def _sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all words of lower-cased texts, the end included, and the length of every text."""
    data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    starts, ends = common.word_bounds(data)
    edges = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    first = np.searchsorted(starts, edges)
    sizes = np.diff(first) + 1
    out = np.full(len(starts) + len(texts), END, dtype=np.int64)
    out[np.arange(len(starts)) + np.repeat(np.arange(len(texts)), sizes - 1)] = _classes_of(data, starts, ends)
    return out, sizes


def _batched(texts, size: int = 2 << 20):
    """Lists of texts of about `size` bytes."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def _training(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    learned = F.col(doc_id).isNotNull() & (common.fold(doc_id, PARTS) != HELD)
    return docs.filter(learned).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))


def first_model(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", states: int = STATES) -> Model:
    """A starting point from a bounded sample: the documents with the smallest hashed ids among those of bounded length."""
    rows = _training(docs, doc_id, text).filter(F.octet_length("text") <= START_BYTES)
    chosen = F.broadcast(common.smallest(rows.select("doc_id").distinct(), START_DOCS))
    texts = [bytes(r["text"]).lower() for r in rows.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id").collect()]
    if not texts:
        return estimated(np.zeros(states), np.zeros((states, states)), np.zeros((states, CLASSES + 1)))
    classes, sizes = _sequences(texts)
    emitted = np.zeros((states, CLASSES + 1))
    np.add.at(emitted, (np.repeat(np.arange(len(texts)) % states, sizes), classes), 1.0)
    model = estimated(np.ones(states), np.eye(states) * 50 + 1, emitted)
    for _ in range(START_ROUNDS):
        model = estimated(*expected_counts(model, classes, sizes)[:3])
    return model


def baum_welch(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> Model:
    """One pass over all training documents."""
    states = len(model.start)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches):
        from pyspark import TaskContext

        total = np.zeros((states, 1 + states + CLASSES + 1))
        for batch in batches:
            for texts in _batched((t.as_py() or b"").lower() for t in batch[1]):
                first, moves, emitted, _ = expected_counts(held.value, *_sequences(texts))
                total += np.concatenate((first[:, None], moves, emitted), axis=1)
        group = [TaskContext.get().partitionId() // 512] * states
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(states), pa.int32()), pa.array(group, pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["state", "part", "x"]
        )

    def add(rows: pa.Table) -> pa.Table:
        x = np.sum(np.sort(np.array(rows["x"].combine_chunks().flatten()).reshape(rows.num_rows, -1), axis=0), axis=0)  # in a fixed order
        return pa.table({"state": pa.array([rows["state"][0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()), "x": pa.array([x], pa.list_(pa.float64()))})

    schema = "state int, part int, x array<double>"
    counts = _training(docs, doc_id, text).mapInArrow(count, schema)
    counts = counts.groupBy("state", "part").applyInArrow(add, schema).groupBy("state").applyInArrow(add, schema)
    rows = sorted(counts.collect(), key=lambda r: r["state"])  # one row per state
    if not rows:
        return model
    x = np.array([r["x"] for r in rows])
    return estimated(x[:, 0], x[:, 1:1 + states], x[:, 1 + states:])


def _words(rows: pa.Table) -> tuple[list, list[bytes], list[list[bytes]], Counter]:
    """Ids, lower-cased texts, their words, and how often training documents of the block use each distinct word."""
    ids, texts = common.sorted_block(rows)
    texts = [t.lower() for t in texts]
    words = [t.split() for t in texts]
    counts: Counter = Counter()
    for i, w in zip(ids, words):
        if learned_from(i):
            counts.update(w)
    for i, w in zip(ids, words):
        if not learned_from(i):
            for x in w:
                if x not in counts:
                    counts[x] = 0
    return ids, texts, words, counts


def _by_bucket(counts: Counter, buckets: int) -> list[list[bytes]]:
    out: list[list[bytes]] = [[] for _ in range(buckets)]
    for w in counts:
        out[zlib.crc32(w) % buckets].append(w)
    return out


def _send_words(buckets: int):
    def send(rows: pa.Table) -> pa.Table:
        _, _, _, counts = _words(rows)
        number, out = rows["block"][0].as_py(), []
        for b, words in enumerate(_by_bucket(counts, buckets)):
            if words:
                out.append((b, number, b"\n".join(words), np.array([counts[w] for w in words], dtype=np.uint32).tobytes()))
        names, kinds = ("bucket", "block", "words", "counts"), (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table({n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(zip(names, kinds))})

    return send


def _answer_words(rows: pa.Table) -> pa.Table:
    """Corpus counts of the words of every message; with block -1, the bucket's sums by class."""
    total: dict[bytes, int] = {}
    asked = [x.split(b"\n") for x in rows["words"].to_pylist()]
    for words, n in zip(asked, rows["counts"].to_pylist()):
        for w, c in zip(words, np.frombuffer(n, dtype=np.uint32).tolist()):
            total[w] = total.get(w, 0) + c
    bucket, block = rows["bucket"].to_pylist(), rows["block"].to_pylist()
    out = [(block[i], bucket[i], np.array([total[w] for w in words], dtype=np.int64).tobytes()) for i, words in enumerate(asked)]
    known = [w for w, c in total.items() if c]
    if known:
        data = np.frombuffer(b"\n".join(known), dtype=np.uint8)
        c = np.array([total[w] for w in known], dtype=np.int64)
        at = _classes_of(data, *common.word_bounds(data))
        sums = np.stack((np.bincount(at, weights=c, minlength=CLASSES), np.bincount(at, minlength=CLASSES))).astype(np.int64)
        out.append((-1, bucket[0], sums.tobytes()))
    return pa.table({"block": pa.array([r[0] for r in out], pa.int32()), "bucket": pa.array([r[1] for r in out], pa.int32()), "counts": pa.array([r[2] for r in out], pa.binary())})


def _class_sums(answers: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and distinct training words of every class."""

    def opened(batches):
        for batch in batches:
            for x in batch[0]:
                c, v = np.frombuffer(x.as_py(), dtype=np.int64).reshape(2, -1)
                at = np.flatnonzero(v)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(c[at]), pa.array(v[at])], ["class", "n", "v"])

    rows = answers.filter("block = -1").select("counts").mapInArrow(opened, "class long, n long, v long")
    n, v = np.zeros(CLASSES, dtype=np.int64), np.zeros(CLASSES, dtype=np.int64)
    for r in rows.groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():  # one row per class
        n[r["class"]], v[r["class"]] = r["n"], r["v"]
    return n, v


def _restricted(model: Model, held: np.ndarray) -> Model:
    """The model with classes that hold no known word left out."""
    emit = model.emit.T[:, : CLASSES + 1] * held
    return Model(model.start, model.move, emit / np.maximum(emit.sum(axis=1, keepdims=True), 1e-300))


def _score_block(buckets: int, held, sums: np.ndarray, n_ends: int):
    sizes = sums.sum(axis=0)  # tokens + distinct words, by class
    tokens, distinct = int(sums[0].sum()) + n_ends, int(sums[1].sum()) + (n_ends > 0)
    room = tokens + distinct + 1
    names = ("doc_id", "n_tokens", "n_known", "base_score", "score")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({n: pa.array([], k) for n, k in zip(names, kinds)})
        ids, texts, words, counts = _words(rows)
        got = {a["bucket"]: a["counts"] for a in answers.to_pylist()}
        for b, asked in enumerate(_by_bucket(counts, buckets)):
            if asked:
                for w, c in zip(asked, np.frombuffer(got[b], dtype=np.int64).tolist()):
                    counts[w] = c
        out = []
        at = 0
        for part in _batched(texts):
            classes, lengths = _sequences(part)
            seen = np.full(len(classes), n_ends, dtype=np.int64)
            seen[classes != END] = np.fromiter((counts[w] for d in words[at:at + len(part)] for w in d), dtype=np.int64)
            base = np.log10((seen + 1.0) / room)
            share = np.where(classes == END, 1.0, (seen + 1.0) / np.maximum(1, np.append(sizes, 1)[classes]))
            known = seen > 0
            inside = np.where(known, np.log10(share) + np.log10(max(1 - 1 / room, 1e-300)), -np.log10(room))
            total = log_likelihoods(held.value, np.where(known, classes, UNKNOWN), lengths) / np.log(10)
            edges = np.cumsum(lengths) - lengths
            total = total + np.add.reduceat(inside, edges)
            out.append((lengths, np.add.reduceat(known.astype(np.int64), edges), np.add.reduceat(base, edges), total))
            at += len(part)
        columns = [ids, *(np.concatenate(c) for c in zip(*out))]
        return pa.table({n: pa.array(c, k) for n, k, c in zip(names, kinds, columns)})

    return score


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", passes: int = PASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Learns from rows whose crc32(doc_id as text) mod 7 is not 2. Tokens are the words, A-Z
    lower-cased, and one end. base_score: smoothed unigram log10 probability; score: log10
    likelihood under the hidden Markov model. Null and empty texts are the end alone. Rows with a
    null id are scored, never learned from and not held out; repeated rows count as often as they
    occur. Without training rows every token is unknown and both scores are 0. An empty table gives
    an empty result; other columns are ignored.
    """
    model = first_model(docs, doc_id, text)
    for _ in range(passes):
        model = baum_welch(docs, model, doc_id, text)
    total = common.text_bytes(docs, text)
    buckets = max(1, -(-total // BUCKET_BYTES))
    blocks = common.in_blocks(docs, doc_id, text, total)
    answers = common.written(
        blocks.groupBy("block").applyInArrow(_send_words(buckets), "bucket int, block int, words binary, counts binary")
        .groupBy("bucket").applyInArrow(_answer_words, "block int, bucket int, counts binary"),
        "counts",
    )
    sums = np.stack(_class_sums(answers))
    n_ends = _training(docs, doc_id, text).count()
    train_tokens = int(sums[0].sum()) + n_ends
    held = docs.sparkSession.sparkContext.broadcast(_restricted(model, np.append(sums[1] > 0, n_ends > 0)))
    scored = blocks.groupBy("block").cogroup(answers.filter("block >= 0").groupBy("block")).applyInArrow(
        _score_block(buckets, held, sums, n_ends), "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(
        "doc_id", (common.fold("doc_id", PARTS) == HELD).alias("held_out"), "n_tokens", "n_known",
        F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


def op8_hmm_score(spark, sf_dir) -> DataFrame:
    """Scores of every document."""
    return score_texts(common.table(spark, sf_dir, "documents"))
