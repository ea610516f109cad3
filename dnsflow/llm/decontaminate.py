"""Benchmark decontamination with DataFrame functions only.

The normalised windows of all benchmark items form a hash set, which is broadcast after its rows
were counted; beyond a fixed number the join shuffles instead. Every window of every document is
looked up by its words, so a hit is exact. Long documents are cut into overlapping runs of words, so
no row carries all windows of a long text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsflow.llm import common

WINDOW = 10
#: Most distinct windows of a benchmark, and most parts of windows, that are broadcast (about 100 bytes each). The rows are the same beyond it.
BROADCAST_WINDOWS = 500_000
#: Windows that begin in one run of words.
RUN = 1024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Digits, letters a to z (A-Z lower-cased) and everything beyond ASCII, as words; null has none."""
    text = F.coalesce(text, F.lit(""))
    # in pure ASCII lower() touches A-Z only, and is much faster
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.filter(F.split(low, _BETWEEN), lambda w: w != "")


def benchmark_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(window, width, item): every distinct window of every item; a shorter item is one window."""
    rows = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    width = F.least(F.size("w"), F.lit(window))
    rows = rows.select("item", width.alias("width"), "w").select(
        "item", "width",
        F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("width") + 1), lambda i: F.array_join(F.slice("w", i, F.col("width")), " "))).alias("window"),
    )
    return common.written(rows.select("window", "width", "item").distinct(), "windows")


def _anchors(windows: DataFrame) -> DataFrame:
    """(block, width): every run of half a window's words, rounded up, in every window."""
    w = F.split("window", " ")
    size = F.floor((F.col("width") + 1) / 2).cast("int")
    found = F.transform(F.sequence(F.lit(1), F.col("width") - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))
    return windows.select("width", F.explode(found).alias("block")).distinct()


def _blocks(part: Column, width: int) -> Column:
    """Non-overlapping blocks of a part, each with the words that windows around it may hold."""
    size = (width + 1) // 2
    last = F.floor(F.size(part) / size).cast("int") - 1

    def of(k: Column) -> Column:
        at = k * size
        low = F.greatest(F.lit(0), at - (width - size))
        return F.struct(
            low.alias("low"), F.lit(width).alias("width"), F.array_join(F.slice(part, at + 1, F.lit(size)), " ").alias("block"),
            F.array_join(F.slice(part, low + 1, at - low + width), " ").alias("around"),
        )

    none = F.array().cast("array<struct<low:int,width:int,block:string,around:string>>")
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), of)).otherwise(none)


def hits(docs: DataFrame, windows: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key columns, first, width and window of every occurrence of a benchmark window; first counts from 0.

    Any window holds a whole block of half its words, so blocks that no benchmark window contains
    rule out the windows around them. Occurrences may be listed twice.
    """
    known = windows.select("window", "width").distinct()
    widths = sorted(r["width"] for r in known.select("width").distinct().collect())  # at most WINDOW numbers
    if not widths:
        return docs.select(*key, F.lit(0).alias("first"), F.lit(0).alias("width"), F.lit("").alias("window")).filter("false")
    anchors = _anchors(known)
    if known.count() <= BROADCAST_WINDOWS:
        known = F.broadcast(known)
    if anchors.count() <= BROADCAST_WINDOWS:
        anchors = F.broadcast(anchors)
    reach = RUN + max(widths) - 1
    parts = docs.select(*key, words(F.col(text)).alias("w")).filter(F.size("w") >= min(widths))
    parts = parts.select(
        *key,
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.floor((F.size("w") - 1) / RUN).cast("int")),
                lambda k: F.struct((k * RUN).alias("from"), F.slice("w", k * RUN + 1, F.lit(reach)).alias("part")),
            )
        ).alias("p"),
    )
    blocks = parts.select(*key, F.col("p.from").alias("from"), F.explode(F.concat(*[_blocks(F.col("p.part"), w) for w in widths])).alias("x"))
    near = blocks.select(*key, (F.col("from") + F.col("x.low")).alias("low"), "x.width", "x.block", "x.around").join(anchors, ["block", "width"])
    near = near.select(*key, "low", "width", F.split("around", " ").alias("w")).filter(F.size("w") >= F.col("width"))
    starts = F.sequence(F.lit(0), F.size("w") - F.col("width"))
    found = near.select(
        *key, "width", F.explode(F.transform(starts, lambda i: F.struct((F.col("low") + i).alias("first"), F.array_join(F.slice("w", i + 1, F.col("width")), " ").alias("window")))).alias("x")
    )
    return found.select(*key, "width", "x.first", "x.window").join(known, ["window", "width"]).select(*key, "first", "width", "window")


def _covered(spans: Column) -> Column:
    """Words inside any of the spans (first, end)."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(
        F.array_sort(spans), zero,
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["first"]))).alias("n")
        ),
    )["n"]


def report(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row.

    A window is ten consecutive words of an item, or a whole shorter item. Null and empty texts have
    no words; items without words have no windows. Items with a null id mark words but are not
    listed; items that repeat an id are one. Rows with a null or repeated id are judged one by one
    by their texts. An empty benchmark hits nothing, an empty table gives an empty result; other
    columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("digest", F.xxhash64("text"))
    windows = benchmark_windows(items)
    key = ["doc_id", "digest"]
    found = common.written(hits(rows, windows, key), "hits")
    spans = found.groupBy(*key).agg(F.collect_set(F.struct("first", (F.col("first") + F.col("width")).alias("end"))).alias("spans"))
    listed = (
        found.select(*key, "window").distinct().join(windows.filter("item IS NOT NULL").select("window", "item"), "window")
        .groupBy(*key).agg(F.collect_set("item").alias("items"))
    )
    marked = common.written(
        spans.alias("s").join(listed.alias("l"), F.col("s.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("s.digest") == F.col("l.digest")), "left")
        .select(F.col("s.doc_id").alias("id"), F.col("s.digest").alias("of"), _covered(F.col("spans")).alias("n_hit"), F.array_sort("items").alias("items")),
        "marked",
    )
    sizes = rows.select("doc_id", "digest", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = sizes.join(marked, sizes["doc_id"].eqNullSafe(marked["id"]) & (sizes["digest"] == marked["of"]), "left")
    listed_items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(listed_items).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed_items, ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark window; null ids are judged like any other."""
    windows = benchmark_windows(items)
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("of"), F.col(text).cast("string").alias("text"))
    bad = common.written(hits(rows, windows, ["id", "of"]).select("id", "of").distinct(), "contaminated")
    same = docs[doc_id].eqNullSafe(bad["id"]) & (F.xxhash64(docs[text].cast("string")) == bad["of"])
    return docs.join(bad, same, "left_anti")


def op6_decontamination(spark, sf_dir) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    return report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
