"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: a slot holds one bit per language, so two slots
of an n-gram, joined by AND, name all languages that contain it. Bits are counted per language over
a whole text, corrected for the false positives that each language's share of set bits makes
likely, and the largest count decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dnsflow.llm import common

#: Most documents of a language that are learned from: those whose hashed ids are smallest.
SAMPLE_DOCS = 1000
SLOTS = 1 << 22
GRAM = 5
#: An n-gram belongs to a language if its share of documents there is at least this part of the largest.
LEAST_SHARE = 0.2
UNKNOWN = "und"
_PIECE = 1 << 20

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[65:91], _FOLD[97:123], _FOLD[128:] = np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)


def grams(text: bytes) -> np.ndarray:
    """Hashes of all 5-byte runs of a text: letters lower-cased, everything else one space, padded."""
    data = _FOLD[np.frombuffer(text, dtype=np.uint8)]
    blank = data == 32
    if len(data):
        data = data[~(blank & np.concatenate(([True], blank[:-1])))]
    data = np.concatenate(([32, 32], data, [32, 32])).astype(np.uint64)
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    v = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        v |= data[k:k + n] << np.uint64(8 * k)
    return common.mixed(v)


def slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(SLOTS - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(SLOTS - 1)).astype(np.int64)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Filters:
    """Slots of language bits, 64 languages to a slice."""

    def __init__(self, languages: list[str], slices: list[np.ndarray]):
        self.languages, self.slices = languages, slices
        fill = [
            np.count_nonzero(s & np.array(1 << bit, dtype=s.dtype)) / len(s)
            for k, s in enumerate(slices) for bit in range(min(64, len(languages) - 64 * k))
        ]
        self.false_rate = np.array(fill) ** 2

    def counts(self, text: bytes) -> tuple[np.ndarray, int]:
        """N-grams of a text found per language, and all of them; long texts in overlapping pieces."""
        out, total = np.zeros(len(self.languages)), 0
        for low in range(0, max(1, len(text)), _PIECE):
            h = grams(text[low:low + _PIECE + GRAM - 1] if low + _PIECE < len(text) else text[low:])
            a, b = slots(h)
            total += len(h)
            for k, s in enumerate(self.slices):
                found = s[a] & s[b]
                if s.dtype == np.uint8:  # up to eight languages: count the bytes, then their bits
                    seen = np.bincount(found, minlength=256)
                    for bit in range(len(self.languages)):
                        out[bit] += seen[(np.arange(256) >> bit) & 1 == 1].sum()
                else:
                    for bit in range(min(64, len(self.languages) - 64 * k)):
                        out[64 * k + bit] += np.count_nonzero(found & np.uint64(1 << bit))
        return out, total

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or text is None or not has_letter(text):
            return UNKNOWN, 0.0
        found, total = self.counts(text.encode())
        true = np.clip((found - total * self.false_rate) / np.maximum(1e-9, 1 - self.false_rate), 0, None)
        best = int(np.argmax(true))
        second = np.partition(true, -2)[-2] if len(true) > 1 else 0.0
        return self.languages[best], float(true[best] / (true[best] + second)) if true[best] > 0 else 0.0


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_DOCS) -> Filters:
    """Filters from at most `sample` whole documents of every language; languages in order of their rows."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # one row per language
    languages = [r["lang"] for r in sizes]
    if not languages:
        return Filters([], [])
    # about twice the sample of every language passes a cut by hash, however large the language is
    cut = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 2 * sample / r["count"]))])
    ranked = Window.partitionBy("lang").orderBy("place", "doc_id")
    chosen = rows.select("doc_id", "lang", common.place("doc_id").alias("place")).filter(F.col("place") <= F.element_at(cut, F.col("lang")))
    chosen = chosen.withColumn("n", F.row_number().over(ranked)).filter(F.col("n") <= sample).select("doc_id", "lang").distinct()
    # one text of every chosen id, however often it occurs
    texts = rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    docs_of = {r["lang"]: r["count"] for r in chosen.groupBy("lang").count().collect()}

    def gather(batches):
        for batch in batches:
            names = batch[1].to_pylist()
            for name in dict.fromkeys(names):
                distinct = [np.unique(grams(t.as_py().encode())) for t, other in zip(batch[2], names) if other == name]
                h, n = np.unique(np.concatenate(distinct), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    table = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    number = table(dict(zip(languages, range(len(languages)))))
    size = F.element_at(table(docs_of), F.col("lang"))
    counted = texts.mapInArrow(gather, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = counted.filter(F.col("n") >= F.when(size >= 20, 2).otherwise(1)).select("lang", "gram", (F.col("n") / size).alias("share"))
    held = (
        counted.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("held"))
        .select("gram", "top", F.explode("held").alias("h"))
        .filter(F.col("h.share") >= LEAST_SHARE * F.col("top"))
        .select("gram", F.element_at(number, F.col("h.lang")).alias("bit"))
    )
    both = F.array(F.col("gram").bitwiseAND(SLOTS - 1), F.shiftrightunsigned("gram", 32).bitwiseAND(SLOTS - 1))
    # what comes to the driver is the filter itself, of a fixed size, without its empty slots
    found = (
        held.select(F.explode(both).alias("slot"), "bit")
        .groupBy("slot", F.floor(F.col("bit") / 64).cast("int").alias("slice"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("mask"))
    ).toArrow()
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    slices = [np.zeros(SLOTS, dtype=kind) for _ in range(-(-len(languages) // 64))]
    slot, mask, part = np.array(found["slot"]), np.array(found["mask"]).view(np.uint64).astype(kind), np.array(found["slice"])
    for k, s in enumerate(slices):
        s[slot[part == k]] = mask[part == k]
    return Filters(languages, slices)


def predict(docs: DataFrame, filters: Filters, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(filters)  # SLOTS bytes, or 8 * SLOTS per 64 languages

    def run(batches):
        known = held.value
        for batch in batches:
            got = [known.predict(t.as_py()) for t in batch[1]]
            yield pa.RecordBatch.from_arrays(
                [batch[0], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double"
    )


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    Learns from rows whose crc32(doc_id as text) mod 4 is not 2 and whose language is known. Null
    texts and texts without a letter are `und` with score 0, and so is everything if nothing could
    be learned. Equal counts go to the language with more rows. Rows with a null id are predicted,
    never learned from. Repeated rows are predicted one by one; other columns are ignored.
    """
    filters = train(docs.filter(F.col("doc_id").isNotNull() & (common.fold("doc_id", 4) != 2)))
    return predict(docs, filters).select("doc_id", (common.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_language_id(spark, sf_dir) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    return identify(common.table(spark, sf_dir, "documents"))
