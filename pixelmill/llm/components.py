"""Distributed union-find: connected components of an edge table by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import BROADCAST_ROWS, written

#: Edges of a task of the first round; a table of few edges may lie in many files.
TASK_EDGES = 1 << 16


def stars(edges: DataFrame) -> DataFrame:
    """(v, comp) for every vertex of the (written) edges (a, b) but the roots: comp is the smallest vertex that v reaches.

    A root is the smallest vertex of its component. Each round alternates two steps (large star, small star): the
    first links every larger neighbour of a vertex to the smallest vertex around it, the second does so for the
    smaller neighbours. Edges only ever shrink toward stars around the minima; the rounds grow with the logarithm of
    the vertices. Every step is grouped and joined by vertex, with partial minima before the shuffle; minima are
    broadcast where the edges are counted to be few. Rounds are written, and nothing passes the driver but a few
    figures.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rows, open_ = edges.count(), True
    edges = edges.coalesce(1 + rows // TASK_EDGES)
    while open_:
        few = F.broadcast if 2 * rows <= BROADCAST_ROWS else lambda df: df
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(few(lowest), "a").where("b > a").select(F.col("m").alias("a"), "b")
        # a < b holds: m <= a < b
        lowest = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(few(lowest), "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x <> y")
        edges = written(small.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(0).alias("up")), F.struct(F.col("b").alias("v"), F.lit(1).alias("up")))).alias("e")).select("e.*")
        # done when every vertex has one edge, to a vertex that has none of its own
        each = ends.groupBy("v").agg(F.sum("up").alias("ups"), F.count(F.lit(1)).alias("c"))
        rows, wrong = each.agg(F.coalesce(F.sum("ups"), F.lit(0)), F.count(F.when((F.col("ups") > 0) & (F.col("c") > 1), 1))).first()
        open_ = wrong > 0
    return edges.select(F.col("b").alias("v"), F.col("a").alias("comp"))


def with_roots(found: DataFrame) -> DataFrame:
    """What stars() returns, and a row for each root."""
    return found.unionAll(found.select(F.col("comp").alias("v"), "comp").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(v, comp) for every vertex of edges (a, b): comp is the smallest vertex that it reaches."""
    return with_roots(stars(edges))
