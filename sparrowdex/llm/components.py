"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written


def _pairs(df: DataFrame, a, b) -> DataFrame:
    return df.select(a.alias("a"), b.alias("b"))


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.union(_pairs(edges, F.col("b"), F.col("a")))
    least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "star")
    return _pairs(both.filter(F.col("b") > F.col("a")).join(least, "a"), F.col("b"), F.col("m")).filter("a <> b"), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = _pairs(edges, F.greatest("a", "b"), F.least("a", "b"))
    least = written(down.groupBy("a").agg(F.min("b").alias("m")), "star")
    joined = down.join(least, "a")
    return _pairs(joined, F.col("b"), F.col("m")).filter("a <> b").union(_pairs(least, F.col("a"), F.col("m"))).distinct(), least


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of links(a, b).

    Nodes without a link to another do not appear; loops, repeated and null links are ignored.  Each
    step keeps a row per link at most, aggregates before it shuffles, and is written to the shared
    folder; the driver sees two numbers a round.  A node with very many links is met in joins only.
    """
    edges = written(_pairs(links, F.greatest("a", "b"), F.least("a", "b")).filter("a <> b").distinct(), "links")
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select("b", "b").distinct()
            )
        seen = now
        large, t1 = _large_star(edges)
        mid = written(large, "large")
        small, t2 = _small_star(mid)
        new = written(small, "links")
        discard(edges, t1, mid, t2)
        edges = new
