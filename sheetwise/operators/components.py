"""Connected components of links between numbered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.runtime import cut, cut_to, remove


def _least_neighbour(links: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``a``, and the smallest of itself and the nodes that it is linked to."""
    return links.groupBy(*keys, "a").agg(F.least(F.min("b"), F.first("a")).alias("m"))


def components(links: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``(keys, node, component)`` for links ``(keys, a, b)`` of whole numbers, a <> b; a component is named after its smallest node.

    Each node's larger neighbours are linked to its smallest one, then its smaller ones, in turn, until every component is a star. A chain of n nodes
    takes about log n rounds. No node's neighbours are collected: their minimum is an aggregate, and meets the links again in a join.
    """
    spark = links.sparkSession
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64(*keys, "a", "b")), F.lit(0))).first())
    # Links from the larger node a to the smaller node b.
    down = links.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now, path = cut_to(spark, down)
    seen = mark(now)
    while True:
        both = now.unionByName(now.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        larger = both.join(_least_neighbour(both, keys), [*keys, "a"]).where("b > a").select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
        large = larger.where("a <> b").distinct()
        found = large.join(_least_neighbour(large, keys), [*keys, "a"])
        smaller = found.where("b <> m").select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).unionByName(found.select(*keys, "a", F.col("m").alias("b"))).distinct()
        new, new_path = cut_to(spark, smaller)
        remove(spark, path)
        now, path = new, new_path
        after = mark(now)
        if after == seen:
            break
        seen = after
    named = now.select(*keys, F.col("a").alias("node"), F.col("b").alias("component"))
    return cut(spark, named.unionByName(now.select(*keys, F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
