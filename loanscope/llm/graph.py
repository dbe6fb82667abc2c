"""Connected components by alternating large-star and small-star steps.

Every step is a group-by minimum and a join, so a vertex with very many
neighbours is combined before the shuffle; the number of rounds grows with
the logarithm of the component size.  Each round's edges are written to the
shared folder, which keeps the lineage short; the rounds end as soon as every
component is a star.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanscope.llm.tables import written


def _stars(edges: DataFrame) -> bool:
    """Whether every vertex has one smaller neighbour at most, and none if it
    is one itself: then each is linked with the smallest of its component.
    ``edges`` (u > v) must be distinct."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    of = ends.groupBy("x").agg((F.sum("up") + F.max("down")).alias("both"), F.sum("up").alias("up"))
    return not of.agg(F.count_if(F.expr("up > 0 AND both > 1"))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for all vertices of ``edges`` (u, v); component is
    the smallest vertex reachable.  Loops and nulls are ignored."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    e = written(e, "edges")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours move to the smallest of the neighbourhood
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours, and the vertex itself, move to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u")
        small = (
            moved.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        )
        e = written(small, "edges")
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("vertex"), F.col("v").alias("component"))
    ).distinct()
