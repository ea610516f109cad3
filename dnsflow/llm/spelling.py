"""Spelling variants by a variable-length gram index.

Grams that many words hold are extended by another character, up to a length, so the lists of words
below a gram stay short; the grams to be extended form the frequency-pruned dictionary. A word is decomposed into the longest
grams at its positions, without those inside an earlier one. For every word the number of
grams that one edit can touch is bounded; what is left must be shared by a near word. So one of the rarest
grams of a word, one more than the bound, is shared by any near word, and the lists below these are merged
and verified code point by code point. Words whose bound leaves nothing are indexed once more by
grams of the shortest length, which always leave some.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dnsflow.llm import common, components

SHORTEST_WORD, LEAST_TIMES = 5, 3
#: Lengths of the grams, and the number of words from which a gram is extended.
SHORTEST, LONGEST, FREQUENT = 2, 4, 100
#: Every so-manieth run of letters, by its hash, loses a code point.
LOSES = 97
#: Rows that are merged in one step, rows in a side of a block, distinct words counted before they are handed on, bytes compared at once.
BUCKET_ROWS, BLOCK, HELD_WORDS, STEP_BYTES = 40_000, 2048, 400_000, 1 << 23
_RUN = re.compile("[a-zÀ-ÿ]+")


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the words that count: long enough, and often enough in all texts together."""

    def run(batches):
        held: Counter = Counter()

        def out():
            table = pa.table({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
            held.clear()
            return table.to_batches()

        for batch in batches:
            for i, value in zip(batch[0].to_pylist(), batch[1]):
                prefix = zlib.crc32(f"{'' if i is None else i}:".encode())
                for word, n in Counter(_RUN.findall((value.as_py() or b"").lower().decode())).items():
                    h = zlib.crc32(word.encode(), prefix)
                    if h % LOSES == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    if len(word) >= SHORTEST_WORD:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield from out()
        yield from out()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_TIMES)


def frequent_grams(words: DataFrame) -> set[str]:
    """The dictionary: grams shorter than the longest that over FREQUENT words hold. Their number is bounded by the letters there are."""
    lengths = [F.transform(F.sequence(F.lit(1), F.length("word") - (q - 1)), lambda i, q=q: F.substring("word", i, F.lit(q))) for q in range(SHORTEST, LONGEST)]
    grams = words.select(F.explode(F.array_distinct(F.concat(*lengths))).alias("gram"))
    return {r.gram for r in grams.groupBy("gram").count().filter(F.col("count") > FREQUENT).select("gram").collect()}


def inner_ends(frequent: set[str]) -> set[str]:
    """All ends of the dictionary's grams that leave out at least the first character."""
    return {g[k:] for g in frequent for k in range(1, len(g) + 1)}


def decomposed(word: str, frequent: set[str], ends: set[str]) -> tuple[list[tuple[int, int]], int]:
    """The grams (first, end) of a word, and the most of them that one edit can touch.

    An edit touches the grams around it, and those behind it that a gram beginning before could cover if it were extended that far.
    """
    size, grams, reach = len(word), [], 0
    for p in range(size - SHORTEST + 1):
        e = p + SHORTEST
        while e < size and e - p < LONGEST and word[p:e] in frequent:
            e += 1
        if e > reach:
            grams.append((p, e))
            reach = e
    touched = [0] * (size + 1)
    for p, e in grams:
        for j in range(p + 1, e + 1):
            touched[j] += 1
        for j in range(max(0, e + 1 - LONGEST), p + 1):
            if word[j:e - 1] in ends:
                touched[j] += 1
    return grams, max(touched)


def _indexed(words: DataFrame) -> DataFrame:
    """(word, n, size, level, bound, gram, place): the grams of every word; level 1 for words whose bound leaves nothing."""
    frequent = frequent_grams(words)
    held = words.sparkSession.sparkContext.broadcast(frequent)
    schema = "word string, n long, size int, level int, bound int, gram string, place int"

    def run(batches):
        frequent, ends = held.value, inner_ends(held.value)
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for word, n in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                grams, bound = decomposed(word, frequent, ends)
                levels = [(0, grams, bound)]
                if bound >= len(grams):
                    levels.append((1, *decomposed(word, set(), set())))
                for level, grams, bound in levels:
                    for p, e in grams:
                        for column, value in zip(out, (word, n, len(word), level, bound, word[p:e], p)):
                            column.append(value)
                if len(out[0]) >= 1 << 16:
                    yield from _batches(out, schema)
                    out = [[] for _ in range(7)]
            yield from _batches(out, schema)

    return words.select("word", "n").mapInArrow(run, schema)


def _batches(columns: list[list], schema: str):
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields]).to_batches()


def _in_lists(words: DataFrame) -> DataFrame:
    """(list, shorter, word, n, size): the lists in which near words meet.

    A list is a gram, its place and the length of words. Words that are one shorter are in it twice, as an insertion may move the gram.
    """
    grams = common.written(_indexed(words), "grams")
    often = grams.groupBy("level", "gram").agg(F.count("*").alias("often"))
    rarest = F.row_number().over(Window.partitionBy("level", "word").orderBy("often", "gram", "place"))
    prefix = grams.join(often, ["level", "gram"]).withColumn("rank", rarest).filter(F.col("rank") <= F.col("bound") + 1)
    own = F.struct(F.col("size").alias("of"), F.col("place").alias("at"), F.lit(False).alias("shorter"))
    longer = [F.struct((F.col("size") + 1).alias("of"), (F.col("place") + k).alias("at"), F.lit(True).alias("shorter")) for k in (0, 1)]
    rows = prefix.select("word", "n", "size", "level", "gram", F.explode(F.array(own, *longer)).alias("x"))
    return rows.select(F.concat_ws(" ", "level", "gram", "x.of", "x.at").alias("list"), "x.shorter", "word", "n", "size")


def _near(rows: pa.Table) -> pa.Table:
    """The pairs (a < b) of near words of every list in a bucket or block: same length with one code point replaced, or one left out."""
    rows = rows.select(["list", "shorter", "word", "n", "size"])
    lists = rows["list"].combine_chunks().dictionary_encode()
    key, shorter = lists.indices.to_numpy(), rows["shorter"].combine_chunks().to_numpy(zero_copy_only=False)
    size = rows["size"].to_numpy() + shorter
    order = np.lexsort((shorter, key, size))
    key, shorter, size = key[order], shorter[order], size[order]
    words, n = rows["word"].combine_chunks().take(pa.array(order)), rows["n"].to_numpy()[order]
    first = np.concatenate(([0], np.flatnonzero(np.diff(key) != 0) + 1, [len(key)])) if len(key) else np.array([0])
    where = np.repeat(np.arange(len(first) - 1), np.diff(first))
    last = first[1:][where] if len(key) else key
    out: list = []
    for length in np.unique(size):
        low, high = np.searchsorted(size, (length, length + 1))
        letters = np.zeros((high - low, length), dtype=np.uint8)  # every letter is below 256
        text = words[int(low):int(high)].to_pylist()
        for short in (False, True):
            at = np.flatnonzero(shorter[low:high] == short)
            if len(at):
                letters[at, :length - short] = np.frombuffer("".join(text[i] for i in at).encode("latin-1"), dtype=np.uint8).reshape(len(at), -1)
        # each own word with all rows behind it in its list
        left = np.flatnonzero(~shorter[low:high])
        partners = (last[low:high] - np.arange(low, high) - 1)[left]
        total = np.concatenate(([0], np.cumsum(partners)))
        step = max(1, STEP_BYTES // int(length))
        at = 0
        while at < len(left):
            stop = max(at + 1, int(np.searchsorted(total, total[at] + step, side="right")) - 1)
            per = partners[at:stop]
            a = np.repeat(left[at:stop], per)
            b = a + 1 + np.arange(per.sum()) - np.repeat(total[at:stop] - total[at], per)
            for x in range(0, len(a), step):
                out.append(low + _one_apart(letters, shorter[low:high], a[x:x + step], b[x:x + step]))
            at = stop
    pairs = np.unique(np.concatenate([np.empty((0, 2), dtype=np.int64), *out]), axis=0)
    # the lesser word first, as two words may meet in several lists in either order
    swap = pc.greater(words.take(pa.array(pairs[:, 0])), words.take(pa.array(pairs[:, 1]))).to_numpy(zero_copy_only=False)
    pairs[swap] = pairs[swap][:, ::-1]
    a, b = pa.array(pairs[:, 0]), pa.array(pairs[:, 1])
    return pa.table({"a": words.take(a), "b": words.take(b), "n_a": pa.array(n[pairs[:, 0]]), "n_b": pa.array(n[pairs[:, 1]])})


def _one_apart(letters: np.ndarray, shorter: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The pairs (a, b) that differ by just one edit; b may be one shorter."""
    found, length = [], letters.shape[1]
    same = ~shorter[b]
    x, y = a[same], b[same]
    if len(x):
        near = np.count_nonzero(letters[x] != letters[y], axis=1) == 1
        found.append(np.stack([x[near], y[near]], axis=1))
    x, y = a[~same], b[~same]
    if len(x):
        long, short = letters[x], letters[y][:, :length - 1]
        ahead = np.concatenate([long[:, :-1] != short, np.ones((len(x), 1), dtype=bool)], axis=1).argmax(axis=1)
        behind = np.concatenate([(long[:, 1:] != short)[:, ::-1], np.ones((len(x), 1), dtype=bool)], axis=1).argmax(axis=1)
        near = ahead + behind >= length - 1
        found.append(np.stack([x[near], y[near]], axis=1))
    return np.concatenate(found) if found else np.empty((0, 2), dtype=np.int64)


def near_words(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): every pair of words (word, n) that one inserted, deleted or replaced code point tells apart, once."""
    rows = common.written(_in_lists(words), "lists")
    sizes = rows.groupBy("list").agg(F.count("*").alias("rows"), F.min("shorter").alias("alone")).filter("rows > 1 AND NOT alone").select("list", "rows")
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    met = rows.join(sizes, "list")
    small = met.filter(F.col("rows") <= BLOCK).withColumn("bucket", F.pmod(F.xxhash64("list"), F.lit(buckets)).cast("int"))
    kind = "a string, b string, n_a long, n_b long"
    near = small.groupBy("bucket").applyInArrow(_near, kind)
    # a crowded list in square blocks
    sides = F.ceil(F.col("rows") / BLOCK).cast("int")
    large = met.filter(F.col("rows") > BLOCK).withColumn("sides", sides).withColumn("side", F.pmod(F.xxhash64("word"), "sides").cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    large = large.withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other"))
    return near.unionByName(large.groupBy("list", "low", "high").applyInArrow(_near, kind)).dropDuplicates(["a", "b"])


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of the texts.

    Words are runs of letters, long and frequent enough, after every LOSES-th run by its hash lost a code point. The form of a
    word is its most frequent near word, if that is at least twice as frequent; root is where the forms lead. Null and empty
    texts have no words, a null id is an empty string in the hash; repeated rows count as often as they occur. An empty table
    gives an empty result; other columns are ignored.
    """
    words = common.written(word_counts(docs, doc_id, text), "words")
    near = common.written(near_words(words), "near")
    other = lambda x, y: near.select(F.col(x).alias("word"), F.col(y).alias("near"), F.col(f"n_{y}").alias("near_n"))
    first = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    best = other("a", "b").unionByName(other("b", "a")).groupBy("word").agg(F.count("*").alias("n_near"), first)
    found = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.less") >= 2 * F.col("n"), -F.col("best.less")))
    found = found.withColumn("form", F.when(F.col("form_n").isNotNull(), F.col("best.near")))
    found = common.written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n"), "forms")
    roots = components.chain_ends(found.select(F.col("word").alias("node"), F.coalesce("form", "word").alias("parent")))
    return found.join(roots.select(F.col("node").alias("word"), F.col("parent").alias("root")), "word")


def op12_spelling_variants(spark, sf_dir) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of the documents."""
    return variants(common.table(spark, sf_dir, "documents"))
