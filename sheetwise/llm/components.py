"""Connected components of a table of links, by alternating large-star and small-star rounds.

Each round moves every link towards the smallest node of its neighbourhood; the number of rounds grows with the logarithm
of a component's size, whatever its shape. Rounds are written to the shared folder, so that a lost executor costs the tasks
of one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.runtime import cut_to, remove

#: Parts into which a node's links are dealt when they meet its smallest neighbour.
SALTS = 8


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links`` (u > v). Links each node's larger (or other) neighbours to its smallest one, itself included.

    The smallest neighbour comes from an aggregate with partial sums, so a node with very many links is never gathered.
    """
    if large:
        near = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = links
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    salted = least.select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = near.withColumn("salt", F.pmod(F.hash("v"), F.lit(SALTS))).join(salted, ["u", "salt"])
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of a link; ``component`` is the component's smallest node."""
    spark = links.sparkSession
    start = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, path = cut_to(spark, start)
    mark = None
    while True:
        made, new = cut_to(spark, _star(_star(now, True), False))
        seen = made.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        remove(spark, path)
        now, path = made, new
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
