"""Connected components of a link table, as Spark joins on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelark.llm.storage import Scratch, written


def connected(links: DataFrame, scratch: Scratch | None = None) -> DataFrame | None:
    """node and root (the smallest node it can reach) for all nodes of ``links`` (a, b longs); None without links.

    The result is a table of ``scratch``, where that is given.

    Each round hooks every root to its smallest neighbour, shortens all chains by pointer jumping, and contracts
    the links to those between different roots; at least half of the roots that still have links go each round.
    """
    own, scratch = scratch is None, scratch or Scratch(links.sparkSession)
    cur = links.where("a <> b").select("a", "b")
    cur, left = scratch.counted(cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = None
    while left:
        parent = scratch.written(cur.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p")), "parents")
        while True:
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
            jumped, moved = scratch.counted(parent.join(up, "p").select("a", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "parents", "moved")
            parent = jumped.select("a", "p")
            if not moved:
                break
        if labels is None:
            labels = parent.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            up = parent.select(F.col("a").alias("root"), "p")
            labels = labels.join(up, "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        labels = scratch.written(labels, "labels")
        a, b = parent.select("a", F.col("p").alias("x")), parent.select(F.col("a").alias("b"), F.col("p").alias("y"))
        cur, left = scratch.counted(cur.join(a, "a").join(b, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
    if own:
        if labels is not None:
            labels = written(labels, "components")
        scratch.drop()
    return labels
