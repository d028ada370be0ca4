"""Connected components of a graph whose edges lie in a DataFrame.

Two star steps alternate: first the larger neighbours of every node, then the smaller ones, are
tied to the least node the node knows of, until nothing changes; the number of rounds grows with
the logarithm of the graph. The least neighbour is a grouped minimum, so a node with many edges
is combined before it is shuffled, and its edges meet it in a plain join that adaptive execution
can split. Every round is written, so a lost executor costs nothing that was reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bough.operators.staging import stage


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) of every node of ``edges``.

    The two columns of ``edges`` hold integers; repeated edges and either direction are fine, loops
    and rows with a null are not edges. An empty table gives no rows.
    """
    a, b = edges.columns
    known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ends = known.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = stage(ends.where("u > v").distinct(), "edges")
    mark = _mark(now)
    while True:
        now = stage(_small_star(_large_star(now)), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    # Every edge now leads from a node to its root.
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(now.select("v", "v").distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
    return edges.join(least, "v").select("u", F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    """One row that tells two sets of edges apart."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("u"), F.bit_xor(h), F.sum(h.bitwiseAND((1 << 31) - 1))).first())
