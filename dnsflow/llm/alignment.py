"""Cross-tokenizer alignment after exact-text deduplication.

Documents are shuffled by their full text, so each distinct text is tokenised by both tokenizers and
aligned once. Byte offsets where tokens of both end cut a text into groups. How many documents hold a
pair of ids linked is the sum over distinct texts weighted by their copies; blocks of texts of
bounded size exchange these counts, one row for each distinct pair of a block. The measures are then
joined to the documents by a digest of the text.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnsflow.llm import common

#: Bits of a pair of ids that hold the second tokenizer's id.
LOW = 15
#: Bytes of text, and links, that are handled in one step.
STEP_BYTES, STEP_LINKS = 1 << 20, 1 << 21
#: Behind a token: one of its own, of the other tokenizer, of another group, or none of its text.
_MARKS = np.frombuffer(b",|;\0", dtype=np.uint8)
_ALIGNED = "key binary, block int, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
_MEASURES = "key binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Pair:
    """Two tokenizers, the bytes of their tokens, and the alignment of texts."""

    def __init__(self, vocabulary: bytes, model: bytes, pattern: str):
        import sentencepiece
        import tiktoken

        file = json.loads(vocabulary)
        of, special = byte_values(), {t["id"] for t in file["added_tokens"]}
        ranks = {bytes(of[c] for c in token): i for token, i in file["model"]["vocab"].items() if i not in special}
        if not all(bytes([x]) in ranks for x in range(256)):
            raise ValueError("the byte-level vocabulary lacks a byte")
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.b_bytes = [self._piece(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        if len(self.b_bytes) > 1 << LOW or len(self.a_bytes) > 1 << 31 - LOW:
            raise ValueError("the vocabularies are too large for a pair of ids in 31 bits")
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        self.most = max(len(self.a_bytes), len(self.b_bytes))
        width = len(str(self.most))
        self.digits = np.array([list(str(i).rjust(width, "\0").encode()) for i in range(self.most)], dtype=np.uint8)

    @staticmethod
    def _piece(piece: str) -> bytes:
        if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def tokens(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Both tokenizers' ids of every text; None where the second's bytes are not a space and the text. The first's are, as it knows every byte."""
        out = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1)):
            same = text and b"".join(map(self.b_bytes.__getitem__, b)) == b" " + text.encode()
            out.append((self.a.encode_ordinary(" " + text), b) if same else None)
        return out

    def aligned(self, texts: list[str]):
        """For every text (n_a, n_b, n_groups, n_links, digest of the groups, distinct pairs, how often each is linked)."""
        found = self.tokens(texts)
        held = [x for x in found if x is not None]
        rest = iter(self._aligned(held) if held else [])
        none = (0, 0, 0, 0, "", np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int32))
        return [none if x is None else next(rest) for x in found]

    def _aligned(self, held):
        # all texts lie behind each other; each ends at the same byte for both tokenizers
        ids = [np.fromiter(itertools.chain.from_iterable(x[side] for x in held), dtype=np.int64) for side in (0, 1)]
        last = [np.cumsum([len(x[side]) for x in held]) for side in (0, 1)]
        ends = [np.cumsum(sizes[i]) for sizes, i in zip((self.a_sizes, self.b_sizes), ids)]
        shared = [np.isin(ends[0], ends[1], assume_unique=True), np.isin(ends[1], ends[0], assume_unique=True)]
        common_ends = ends[0][shared[0]]
        group = [np.cumsum(x) - x for x in shared]
        n = [np.bincount(g, minlength=len(common_ends)) for g in group]
        links = n[0] * n[1]
        text_end = ends[0][last[0] - 1]
        doc = np.searchsorted(text_end, common_ends)
        n_groups = np.bincount(doc, minlength=len(held))
        edges = np.concatenate(([0], np.cumsum(n_groups)))
        total = np.concatenate(([0], np.cumsum(links)))
        shown, ends_of = self._shown(ids, group, doc)
        marks = np.concatenate(([0], ends_of[np.cumsum([len(a) + len(b) for a, b in held]) - 1])).tolist()
        first = [np.concatenate(([0], np.cumsum(x))) for x in n]
        out = []
        for k, (a, b) in enumerate(held):
            pairs, times = self._linked(ids, first, links, int(edges[k]), int(edges[k + 1]))
            digest = hashlib.sha256(shown[marks[k]:marks[k + 1]]).hexdigest()
            out.append((len(a), len(b), int(n_groups[k]), int(total[edges[k + 1]] - total[edges[k]]), digest, pairs, times))
        return out

    def _shown(self, ids, group, doc) -> tuple[np.ndarray, np.ndarray]:
        """The text of all tokens, each as its id and the mark behind it, in order of groups, the first tokenizer's before the second's; where each ends."""
        groups, sides = np.concatenate(group), np.repeat([0, 1], [len(i) for i in ids])
        order = np.argsort(groups * 2 + sides, kind="stable")
        groups, sides, of = groups[order], sides[order], doc[groups[order]]
        mark = np.full(len(order), 3)
        mark[:-1] = np.where(of[1:] != of[:-1], 3, np.where(groups[1:] != groups[:-1], 2, np.where(sides[1:] != sides[:-1], 1, 0)))
        text = np.concatenate([self.digits[np.concatenate(ids)[order]], _MARKS[mark][:, None]], axis=1)
        kept = text != 0
        return text[kept], np.cumsum(kept.sum(axis=1))

    @staticmethod
    def _linked(ids, first, links, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs in the groups low to high, and how often each is linked; a few links at a time."""
        pairs, times = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        at = low
        while at < high:
            stop = max(at + 1, low + int(np.searchsorted(np.cumsum(links[low:high]), links[low:at].sum() + STEP_LINKS)))
            stop = min(stop, high)
            if stop == at + 1:  # a group of any size: by distinct ids
                a, n_a = np.unique(ids[0][first[0][at]:first[0][stop]], return_counts=True)
                b, n_b = np.unique(ids[1][first[1][at]:first[1][stop]], return_counts=True)
                step = max(1, STEP_LINKS // len(b))
                parts = [((a[i:i + step, None] << LOW | b).ravel(), (n_a[i:i + step, None] * n_b).ravel()) for i in range(0, len(a), step)]
            else:
                size_b = np.diff(first[1][at:stop + 1])
                size_a = np.diff(first[0][at:stop + 1])
                per_a = np.repeat(size_b, size_a)  # how many of the second each of the first meets
                start_b = np.repeat(first[1][at:stop], size_a)
                met = np.arange(per_a.sum()) - np.repeat(np.cumsum(per_a) - per_a, per_a) + np.repeat(start_b, per_a)
                a = np.repeat(ids[0][first[0][at]:first[0][stop]], per_a)
                parts = [(a << LOW | ids[1][met], None)]
            for keys, weights in parts:
                if weights is None:
                    keys, weights = np.unique(keys, return_counts=True)
                both, place = np.unique(np.concatenate([pairs, keys]), return_inverse=True)
                times = np.bincount(place, weights=np.concatenate([times, weights]).astype(np.float64), minlength=len(both)).astype(np.int64)
                pairs = both
            at = stop
        return pairs.astype(np.int32), times


@functools.lru_cache(maxsize=1)
def _pair(vocabulary: bytes, model: bytes, pattern: str) -> Pair:
    return Pair(vocabulary, model, pattern)


def _in_steps(rows):
    """(key, block, copies, text) of all batches, about STEP_BYTES of text at a time."""
    held, size = [], 0
    for batch in rows:
        for row in zip(*[c.to_pylist() for c in (batch[0], batch[1], batch[2])], batch[3]):
            text = row[3].as_py()
            held.append((*row[:3], text))
            size += len(text)
            if size >= STEP_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def aligned_texts(texts: DataFrame, vocabulary: bytes, model: bytes, pattern: str) -> DataFrame:
    """key, block, copies, the measures of the alignment and the linked pairs of every row of (key, block, copies, text)."""
    files = texts.sparkSession.sparkContext.broadcast((vocabulary, model))  # files of fixed size

    def run(batches):
        pair = _pair(*files.value, pattern)
        for rows in _in_steps(batches):
            got = pair.aligned([r[3] for r in rows])
            columns = [[r[k] for r in rows] for k in range(3)] + [[g[k] for g in got] for k in range(5)]
            columns += [[g[5].astype("<i4").tobytes() for g in got], [g[6].astype("<i8").tobytes() for g in got]]
            kinds = [pa.binary(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary()]
            names = [x.split()[0] for x in _ALIGNED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return texts.select("key", "block", "copies", "text").mapInArrow(run, _ALIGNED)


def _pairs_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a block's texts, and the numbers of pairs of each text."""
    held = rows["pairs"].to_pylist()
    return np.frombuffer(b"".join(held), dtype="<i4"), np.array([len(x) // 4 for x in held], dtype=np.int64)


def _send(rows: pa.Table) -> pa.Table:
    """Every distinct pair of a block with the number of documents in the block that hold it."""
    pairs, sizes = _pairs_of(rows)
    distinct, place = np.unique(pairs, return_inverse=True)
    copies = np.repeat(rows["copies"].to_numpy(), sizes)
    n = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(n, place, copies)
    block = np.full(len(distinct), rows["block"][0].as_py(), dtype=np.int32)
    return pa.table({"block": pa.array(block), "pair": pa.array(distinct, pa.int32()), "n": pa.array(n)})


def _finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
    names = [x.split()[0] for x in _MEASURES.split(", ")]
    if not rows.num_rows:
        return pa.table([pa.array([], k) for k in (pa.binary(), *[pa.int64()] * 6, pa.string())], names=names)
    pairs, sizes = _pairs_of(rows)
    times = np.frombuffer(b"".join(rows["times"].to_pylist()), dtype="<i8")
    sums = np.zeros((2, len(sizes)), dtype=np.int64)
    if len(pairs):
        order = np.argsort(answers["pair"].to_numpy())
        place = order[np.searchsorted(answers["pair"].to_numpy(), pairs, sorter=order)]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        np.add.at(sums[0], owner, times * answers["is_best"].to_numpy(zero_copy_only=False)[place])
        np.add.at(sums[1], owner, times * answers["n"].to_numpy()[place])
    columns = [rows[c].combine_chunks() for c in ("key", "n_a", "n_b", "n_groups", "n_links")]
    return pa.table([*columns, pa.array(sums[0]), pa.array(sums[1]), rows["groups_sha256"].combine_chunks()], names=names)


def pair_counts(sent: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked) and is_best (no pair of the same first id has more) of all blocks together."""
    totals = sent.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", LOW))
    most = totals.groupBy("a").agg(F.max("n").alias("most"))
    return totals.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("is_best"))


def align(
    docs: DataFrame, vocabulary: bytes, model: bytes, pattern: str, doc_id: str = "doc_id", text: str = "text", block_bytes: int = common.BLOCK_BYTES
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    vocabulary is the file of a byte-level BPE (A, which gets a space and the text), model that of a sentence-piece model
    (B). Null and empty texts, and those that either does not give back byte by byte, have no tokens: zeros and an empty
    digest. Rows with null or repeated ids are documents of their own; an empty table gives an empty result; other columns
    are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    blocks = max(1, -(-common.text_bytes(rows) // block_bytes))
    texts = rows.filter("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    texts = texts.select(
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"), F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int").alias("block"), "copies", "text"
    )
    aligned = common.written(aligned_texts(texts, vocabulary, model, pattern), "aligned")
    kind = "block int, pair int, n long"
    sent = common.written(aligned.select("block", "copies", "pairs").groupBy("block").applyInArrow(_send, kind), "sent")
    answers = sent.select("block", "pair").join(pair_counts(sent), "pair")
    measures = aligned.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_finish, _MEASURES)
    keyed = rows.select("doc_id", F.when(F.col("text") != "", F.unhex(F.sha2(F.col("text").cast("binary"), 256))).alias("key"))
    numbers = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    return keyed.join(measures, "key", "left").select(
        "doc_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")
    )


def op13_alignment(spark, sf_dir, vocabulary_file: str | None = None, model_file: str | None = None) -> DataFrame:
    """The alignment of both public tokenizers over every document."""
    import public_tokenizers

    with open(vocabulary_file or public_tokenizers.path("byte_bpe_50k.json"), "rb") as file:
        vocabulary = file.read()
    with open(model_file or public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    return align(common.table(spark, sf_dir, "documents"), vocabulary, model, public_tokenizers.PATTERN)
