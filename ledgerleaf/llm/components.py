"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.tables import stored


def components(links: DataFrame) -> DataFrame:
    """The smallest node reachable from each node: node, component.

    ``links`` has two columns of ids, a and b, in either direction. Rounds of large-star
    and small-star steps: every node points its larger neighbours, then its smaller ones,
    at the smallest node that it knows, until nothing changes. Each round is a minimum per
    node, combined before the shuffle, and a join, so a node with very many links is no
    burden to one task. The minima are written before the join, which cuts the lineage and
    lets adaptive execution split such a node's rows.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b")
        .distinct(),
        "links",
    )
    before = None
    while True:
        starred = _small_star(_large_star(edges))
        edges = stored(starred, "links")
        now = edges.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))
        ).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.withColumn("component", F.col("node"))
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours linked to the smallest of its neighbours and itself."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return (
        both.filter("b > a")
        .join(stored(least, "least"), "a")
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours linked to the smallest of them."""
    least = stored(edges.groupBy("a").agg(F.min("b").alias("least")), "least")
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    kept = least.select("a", F.col("least").alias("b"))
    return moved.filter("a <> b").unionByName(kept).distinct()
