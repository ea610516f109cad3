"""Byte-level BPE with prefix dynamic programming.

For every prefix of a piece there is exactly one last token that a valid encoding of the prefix can
end in, so one number per byte describes the encodings of all prefixes. A token may follow another
if merging the bytes of both gives these two tokens back. Appending bytes only adds numbers; after
an edit, numbers are computed anew from the edit until as many as the longest token agree with the
old ones.
"""

from __future__ import annotations

import base64
import itertools
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnsflow.llm import common

#: Pieces whose encodings a worker remembers.
REMEMBERED = 1 << 18
#: Texts beyond this many characters are split piece by piece.
LONG_TEXT = 1 << 20
#: Bytes of results after which a batch is handed on.
BATCH_BYTES = 4 << 20


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file whose lines hold a token in base64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) }


class PrefixCodec:
    """Encodes pieces of text by merge ranks; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self._follows: dict[int, bool] = {}
        self.sizes = list(map(len, self.tokens))
        self.finder = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.finder.add_word(token.decode("latin-1"), rank)  # one character per byte
        self.finder.make_automaton()

    def merged(self, data: bytes) -> list[int]:
        """Merges neighbours of lowest rank until none can be merged."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(itertools.pairwise(parts)))
            if best == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def follows(self, left: int, token: int) -> bool:
        """Whether a valid encoding may hold `token` after `left` (-1: at its start)."""
        key = (left << 20) | token
        known = self._follows.get(key)
        if known is None:
            if len(self._follows) > REMEMBERED * 4:
                self._follows.clear()
            whole = (self.tokens[left] if left >= 0 else b"") + self.tokens[token]
            known = self._follows[key] = self.merged(whole) == ([left, token] if left >= 0 else [token])
        return known

    def prefixes(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """The last token of every prefix; a given list covers the first prefixes and is continued in place."""
        last = [-1] if last is None else last
        return self._continued(data, last, len(data))

    def _continued(self, data: bytes, last: list[int], stop: int) -> list[int]:
        """Adds the last tokens of the prefixes up to `stop` bytes."""
        known, sizes, first = self._follows.get, self.sizes, len(last)
        low = max(0, first - self.longest)
        # every token in the bytes, by its end, the longest first
        for end, token in self.finder.iter(data[low:stop].decode("latin-1")):
            end += low + 1
            if end < len(last):
                continue
            start = end - sizes[token]
            if start < low:
                continue
            left = last[start]
            fits = known((left << 20) | token)
            if fits or fits is None and self.follows(left, token):
                last.append(token)
        return last

    def edited(self, data: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """Bytes and prefix tokens after data[start:stop] became `new`."""
        changed = data[:start] + new + data[stop:]
        shift, out, same = len(changed) - len(data), last[: start + 1], 0
        for end in range(start + 1, len(changed) + 1):
            self._continued(changed, out, end)
            old = end - shift
            same = same + 1 if old > stop and out[end] == last[old] and end > start + len(new) else 0
            if same >= self.longest:
                return changed, out + last[old + 1:]
        return changed, out

    def walked(self, data: bytes, last: list[int]) -> list[int]:
        """The encoding of the whole piece, from its prefix tokens."""
        out, end = [], len(data)
        while end:
            out.append(last[end])
            end -= len(self.tokens[last[end]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        """A piece that is itself a token stands for that token, however it merges."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.walked(data, self.prefixes(data))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Remembered(dict):
    """Piece to its ids as little-endian 32-bit integers. When full, only what is used again is kept."""

    def __init__(self, codec: PrefixCodec):
        super().__init__()
        self.codec, self.older = codec, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece)
        if ids is None:
            found = self.codec.encode_piece(piece.encode())
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class TextCodec:
    """Whole texts: each match of the pattern is a piece of its own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.codec = PrefixCodec(ranks)
        # White space by the Unicode property, which leaves out the four separators 1C to 1F.
        self.pattern = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.known = _Remembered(self.codec)

    def pieces(self, text: str, start: int = 0) -> list[str]:
        return self.pattern.findall(text, start)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if len(text) <= LONG_TEXT:
            return b"".join(map(self.known.__getitem__, self.pattern.findall(text)))
        found = (m.group() for m in self.pattern.finditer(text))
        return b"".join(b"".join(map(self.known.__getitem__, part)) for part in iter(lambda: list(itertools.islice(found, 1 << 16)), []))

    def decode(self, ids: bytes) -> bytes:
        step = 1 << 18
        return b"".join(self.codec.decode(np.frombuffer(ids[i:i + step], dtype="<u4").tolist()) for i in range(0, len(ids), step))

    def appended(self, text: str, pieces: list[str], more: str) -> list[str]:
        """Pieces of text + more: only the last piece of the old text is matched again."""
        if not pieces:
            return self.pieces(text + more)
        return pieces[:-1] + self.pieces(pieces[-1] + more)

    def edited(self, pieces: list[str], start: int, stop: int, new: str) -> list[str]:
        """Pieces after text[start:stop] became `new`: matched from two pieces before the edit until boundaries meet again."""
        text = "".join(pieces)
        edges = list(itertools.accumulate(map(len, pieces), initial=0))
        first = max(0, next((k for k, e in enumerate(edges) if e > start), len(pieces)) - 3)
        changed, shift = text[:start] + new + text[stop:], len(new) - (stop - start)
        old = {e + shift: k for k, e in enumerate(edges) if e >= stop}
        out, at = pieces[:first], edges[first]
        while at < len(changed):
            if at >= start + len(new) and at in old:
                return out + pieces[old[at]:]
            piece = self.pattern.match(changed, at).group()
            out.append(piece)
            at += len(piece)
        return out


@lru_cache(maxsize=4)
def _codec(data: bytes, pattern: str) -> TextCodec:
    return TextCodec(read_ranks(data), pattern)


def _handed_on(batches, work, names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Applies work to (id, value) pairs; result batches stay small."""
    for batch in batches:
        rows, size = [], 0
        for doc_id, value in zip(batch[0], batch[1]):
            row = work(doc_id.as_py(), value.as_py())
            rows.append(row)
            size += sum(len(x) for x in row if isinstance(x, (bytes, str)))
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def encode_texts(docs: DataFrame, ranks: bytes, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (binary, little-endian unsigned 32-bit integers) of every text.

    `ranks` is the content of a rank file. Null texts count as empty and have no tokens; null and
    repeated ids are passed on row by row; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        codec = _codec(held.value, pattern)

        def work(i, value):
            ids = codec.encode(value or "")
            return i, len(ids) // 4, ids

        return _handed_on(batches, work, ["doc_id", "n_tokens", "ids"], [pa.int64(), pa.int64(), pa.binary()])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids binary"
    )


def decode_ids(encoded: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """Adds the decoded bytes (column decoded) to rows of encode_texts; null ids decode to no bytes."""
    held = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        codec = _codec(held.value, pattern)

        def work(i, ids):
            return i, len(ids or b"") // 4, ids, codec.decode(ids or b"")

        return _handed_on(batches, work, ["doc_id", "n_tokens", "ids", "decoded"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def round_trip(docs: DataFrame, ranks: bytes, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids and decoded of every text, as encode_texts and decode_ids give them, in one pass."""
    held = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        codec = _codec(held.value, pattern)

        def work(i, value):
            ids = codec.encode(value or "")
            return i, len(ids) // 4, ids, codec.decode(ids)

        return _handed_on(batches, work, ["doc_id", "n_tokens", "ids", "decoded"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids binary, decoded binary"
    )


def digests(docs: DataFrame, rank_file: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and decoded bytes of every document."""
    import public_tokenizers

    with open(rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = file.read()
    return round_trip(docs, ranks, public_tokenizers.PATTERN).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_byte_bpe(spark, sf_dir) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return digests(common.table(spark, sf_dir, "documents"))
