"""Connected components by contraction, as Spark jobs.

Every node points to its smallest neighbour if that is smaller; pointers are followed to their ends,
and the edges are redrawn between these ends. Each round at least halves what is left of a
component. Tables are written to the shared folder between steps, so both sides of every join come
from a plain shuffle, and a hub's rows can be split among tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnsflow.llm import common


def chain_ends(parents: DataFrame) -> DataFrame:
    """(node, parent) with every parent replaced by the end of its chain; ends point to themselves."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        jumped = common.written(
            parents.join(up, "parent").select("node", F.col("next").alias("parent"), (F.col("next") != F.col("parent")).alias("moved")),
            "pointers",
        )
        parents = jumped.select("node", "parent")
        if jumped.filter("moved").isEmpty():
            return parents


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of the edges (columns a and b).

    Edges may repeat and point either way; loops and null ends are ignored. No edges, no rows.
    """
    spark = edges.sparkSession
    tidy = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    edges = common.written(tidy(edges.filter("a IS NOT NULL AND b IS NOT NULL")), "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("b"))
        parents = chain_ends(common.written(least.select(F.col("a").alias("node"), F.least("a", "b").alias("parent")), "parents"))
        if roots is None:
            roots = parents.select("node", F.col("parent").alias("root"))
        else:
            roots = common.written(
                roots.join(parents.select(F.col("node").alias("root"), "parent"), "root", "left")
                .select("node", F.coalesce("parent", "root").alias("root")),
                "roots",
            )
        ends = lambda side: parents.select(F.col("node").alias(side), F.col("parent").alias(f"{side}_end"))
        edges = common.written(
            tidy(edges.join(ends("a"), "a").join(ends("b"), "b").select(F.col("a_end").alias("a"), F.col("b_end").alias("b"))), "edges"
        )
    return roots if roots is not None else spark.createDataFrame([], "node long, root long")
