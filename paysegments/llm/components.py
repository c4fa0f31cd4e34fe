"""Connected components of links, by alternating large and small stars.

Every round joins each node's links with the smallest node among them and writes the
links that result to the shared folder, so a lost executor costs one round at most. The
number of rounds grows with the logarithm of the longest chain, and nothing but a count
and a checksum reaches the driver. The minimum of a hub is combined before the shuffle,
and the join on a hub can be split as it is a plain equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysegments.functions.lineage import Scratch


def _smallest(links: DataFrame, by: str, of: str) -> DataFrame:
    found = links.groupBy(F.col(by).alias("node")).agg(F.min(of).alias("least"))
    return found.select("node", F.least("node", "least").alias("least"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined = both.where("b > a").join(_smallest(both, "a", "b"), F.col("a") == F.col("node"))
    return joined.select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    # links run from the larger node a to the smaller b
    joined = links.join(_smallest(links, "a", "b"), F.col("a") == F.col("node"))
    down = joined.select(F.col("b").alias("a"), F.col("least").alias("b"))
    own = joined.select("a", F.col("least").alias("b"))
    return down.unionAll(own).where("a <> b").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node and component (its smallest node) for the nodes of ``links`` (a, b: long).

    Nodes without a link to another node are not listed. The result lies in ``scratch``.
    """
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = scratch.write(ordered.distinct())
    mark = None
    while True:
        state = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")))
        seen = now.agg(state.alias("s")).first()["s"]
        if seen == mark:
            break
        mark, before = seen, now
        now = scratch.write(_small_star(_large_star(before)))
        scratch.remove(before)
    own = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(own)
