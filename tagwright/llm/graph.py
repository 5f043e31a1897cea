"""Connected components as a few joins per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.session import write_once


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("high", "low"))).first())


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``(node, root)`` for every node with an edge; the root is the component's smallest node.

    Large-star and small-star rounds: each node's larger neighbours, then its
    smaller ones, are hung on the smallest neighbour until nothing changes.  A
    round writes its edges to the shared folder, and a node of many edges is
    reduced before the shuffle, so no neighbourhood is gathered in a task.
    """
    high, low = F.greatest(left, right), F.least(left, right)
    edges = write_once(
        edges.select(high.alias("high"), low.alias("low")).filter("high > low").distinct(), "edges"
    )
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
        # The smallest of each node's neighbours and itself.
        smallest = both.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("least"))
        smallest = smallest.select("node", F.least("node", "least").alias("least"))
        large = edges.join(smallest, F.col("low") == F.col("node")).select("high", F.col("least").alias("low"))
        large = write_once(large.distinct(), "large-star")
        smallest = large.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("least"))
        small = large.join(smallest, F.col("high") == F.col("node"))
        hung = small.select(F.col("low").alias("high"), F.col("least").alias("low")).filter("high > low")
        kept = smallest.select(F.col("node").alias("high"), F.col("least").alias("low"))
        edges = write_once(hung.unionByName(kept).distinct(), "small-star")
        before, state = state, _state(edges)
        if state == before:
            break
    rows = edges.select(F.col("high").alias("node"), F.col("low").alias("root"))
    roots = edges.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
    return rows.unionByName(roots)
