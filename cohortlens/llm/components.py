"""Connected components of a link table, by repeated joins.

Alternating large-star and small-star steps: every node's links are replaced by
links to its smallest neighbour.  Each step is a grouping by node; a hot node's
neighbours are never gathered, only their minimum is, and joined back.  After a
logarithmic number of rounds every node links to its component's smallest one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SALTS = 16


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links of each node u to its smallest neighbour m, taken over by the neighbours.

    Large star: neighbours above u link to m.  Small star: u's neighbours below
    u, and u itself, link to m.  Links are (a, b) with a > b.
    """
    if large:
        near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links
    least = (near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    near = near.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(least, ["a", "salt"])
    if large:
        out = near.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = (near.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
               .unionByName(least.filter("salt = 0").select("a", F.col("m").alias("b"))))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node reachable."""
    now = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .distinct(), "links")
    state = None
    for _ in range(max_rounds):
        now = materialize(_star(_star(now, True), False), "links")
        # Done when the links are stars: a round changes neither the count nor the sum of hashes.
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return (now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct())
