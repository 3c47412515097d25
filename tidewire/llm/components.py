"""Connected components of a graph of linked values, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.shared import forget, saved


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: the larger neighbours of u go to the least value around u. Small star: u and its lesser neighbours do."""
    if large:
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), F.least("u", "m").alias("m"))
    joined = around.join(least, around["u"] == least["at"])
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every value on an edge (u, v) of ``edges``: root is the least value it is connected with.

    Edges stay a table throughout: each round shuffles them by value twice, minima are taken on the map side first, and the
    join back is a plain one, whose partitions Spark can split where a value has very many edges. Rounds grow with the
    logarithm of the graph. Values without an edge don't appear.
    """
    current = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
    was = state(current)
    while was[0]:
        following = saved(_stars(_stars(current, large=True), large=False), "edges")
        now = state(following)
        forget(current)
        current = following
        if now == was:
            break
        was = now
    roots = current.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct()
    return current.select("u", F.col("v").alias("root")).union(roots)
