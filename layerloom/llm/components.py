"""Connected components of a distributed list of links, by alternating large-star and small-star contraction.

Links stay in Spark: nothing is collected but one count and one checksum a round. A hub's links meet in sums
(smallest neighbour, combined before the shuffle) and joins, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerloom.llm._spark import cut

MOST_ROUNDS = 60


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Links (u, v) with u > v; each node's neighbours are tied to the smallest of them and of the node itself."""
    if larger:
        around = links.select(F.col("u").alias("n"), F.col("v").alias("w")).unionAll(links.select(F.col("v").alias("n"), F.col("u").alias("w")))
        least = around.groupBy("n").agg(F.least(F.min("w"), F.col("n")).alias("m"))
        moved = around.filter("w > n").join(least, "n").select(F.col("w").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        moved = links.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return moved.filter("u > v").distinct()


def components(links: DataFrame, size: int | None = None) -> DataFrame:
    """(node, component) for each node of links (a, b): the smallest node that can be reached. Loops and nulls are ignored.

    size: a bound on the bytes of the links between different nodes, if known, for fewer files.
    """
    now = links.select(F.greatest("a", "b").cast("bigint").alias("u"), F.least("a", "b").cast("bigint").alias("v")).filter("u > v").distinct()
    now, before = cut(now, size), None
    for _ in range(MOST_ROUNDS):
        now = cut(_star(_star(now, True), False), size)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"links did not settle in {MOST_ROUNDS} rounds")
    tied = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return tied.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
