"""Connected components by alternating star contractions, every round a few shuffles of narrow rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import hot_join
from tidemark.workspace import Workspace


def components(edges: DataFrame, space: Workspace) -> DataFrame:
    """``node``, ``root``: the smallest node of its component, for every node but the roots themselves.

    ``edges`` has bigint columns ``a`` and ``b``; loops, repeats and either direction are allowed, no edges give no
    rows. Each round first links all larger neighbours of a node to its smallest neighbour, then all smaller ones; the
    rounds are of the order of the logarithm of the longest path. A hub's edges are dealt over many tasks. Rounds are
    written to the shared folder, which cuts the lineage and survives lost executors.
    """
    stars = space.keep(_oriented(edges).distinct(), "edges")
    seen = _mark(stars)
    while True:
        stars = space.keep(_small_star(_large_star(stars, 2 * seen[0]), 2 * seen[0]), "stars")
        mark = _mark(stars)
        if mark == seen:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark


def _oriented(edges: DataFrame) -> DataFrame:
    """Edges from the larger node ``a`` to the smaller ``b``."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _mark(edges: DataFrame) -> tuple:
    """Tells sets of edges apart: their number and a hash that does not depend on order."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.hash("b", "a"))).first())


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    linked = hot_join(both, least.select("a", F.least("a", "m").alias("m")), ["a"], ["b"], least.select("a", "n"), total=total).filter("b > a")
    return _oriented(linked.select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    linked = hot_join(edges, least.select("a", "m"), ["a"], ["b"], least.select("a", "n"), total=total)
    down = linked.select("a", F.col("m").alias("b")).unionByName(linked.select(F.col("b").alias("a"), F.col("m").alias("b")))
    return _oriented(down).distinct()
