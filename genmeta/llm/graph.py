"""Connected components of an edge table by repeated joins, for all components at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, written


def components(edges: DataFrame) -> DataFrame:
    """(v, c): c is the smallest vertex that v reaches. edges: (a, b), any direction, repeats allowed.

    Each round moves every vertex to the smallest label among itself and its neighbours, then to the label of that label, and
    carries the edges along: those within one label go, equal ones meet. So edges and vertices shrink from round to round
    and their sum over all rounds stays in proportion to the input; the number of rounds grows with the logarithm of a
    component's width. The moves of all rounds are joined from the last back to the first, smallest tables first.
    """
    lo_hi = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    rest, moves = written(lo_hi(edges), "edges"), []
    while not rest.isEmpty():
        both = rest.select(F.col("b").alias("v"), F.col("a").alias("o")).union(rest.select("a", "b"))
        near = both.groupBy("v").agg(F.min("o").alias("o")).select("v", F.least("v", "o").alias("c"))
        near = written(near, "near")
        up = near.filter("c <> v").select(F.col("v").alias("c"), F.col("c").alias("up"))
        move = written(near.join(up, "c", "left").select("v", F.coalesce("up", "c").alias("c")), "moves")
        carried = rest.join(move.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a").join(move.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b")
        after = written(lo_hi(carried.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "edges")
        drop_table(near)
        drop_table(rest)
        rest = after
        moves.append(move)
    drop_table(rest)
    if not moves:
        return rest.select(F.col("a").alias("v"), F.col("b").alias("c")).limit(0)
    labels = moves.pop()
    while moves:
        move = moves.pop()
        after = written(move.join(labels.select(F.col("v").alias("c"), F.col("c").alias("to")), "c", "left").select("v", F.coalesce("to", "c").alias("c")), "labels")
        drop_table(labels)
        drop_table(move)
        labels = after
    return labels


def extended(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (v, c) with more edges: only the components that the new edges join are worked on."""
    of = lambda col: labels.select(F.col("v").alias(col), F.col("c").alias(f"c{col}"))
    between = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a <> b")
    joined = components(between)
    known = labels.union(joined.select("v", F.col("v").alias("c"))).groupBy("v").agg(F.min("c").alias("c"))
    moved = known.join(joined.select(F.col("v").alias("c"), F.col("c").alias("to")), "c", "left").select("v", F.coalesce("to", "c").alias("c"))
    return written(moved, "labels")
