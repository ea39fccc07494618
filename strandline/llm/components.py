"""Connected components of a link table by alternating star steps, as Spark jobs with a written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import written


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One star step: hang a node's larger (or not larger) neighbours on the smallest node of its neighbourhood.

    The minimum is a plain aggregate with partial sums, so a node with very many links is no burden for one task;
    joining it back is a join that adaptive execution can split.
    """
    if large:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        hung = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        hung = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
    return hung.filter("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of a link table (a, b); root is the smallest node that can be reached.

    Links with a null end and loops are left out. Rounds grow with the logarithm of a component's size. Each round
    is written to the shared folder, so a lost executor costs one round at most.
    """
    now = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        now = written(_stars(_stars(now, large=True), large=False), "stars")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
        mark = tuple(seen)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
