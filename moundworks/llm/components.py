"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is two aggregations and two joins on the node.  The aggregates are written before they are joined, so either
side of a join is a plain shuffle and a hub's links are split like any skewed join; each round's links are written to the
shared folder, and the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundworks.llm.common import materialise


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(pairs: DataFrame, lowest: DataFrame) -> DataFrame:
    return pairs.join(lowest, "u")


def components(links: DataFrame, folder: str) -> DataFrame:
    """node, root (the least node it is connected with) for every node of ``links`` (a, b); roots included.

    Rounds are written below ``folder``, and the result reads the last of them.
    """
    links = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", folder)
    before = None
    while (now := _state(links)) != before:
        before = now
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        lowest = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "lowest", folder)
        large = _star(both.where("v > u"), lowest).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialise(large, "large", folder)
        lowest = materialise(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "lowest", folder)
        down = _star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), lowest)
        small = down.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(lowest.select(F.col("u").alias("a"), F.col("m").alias("b")))
        links = materialise(small.where("a <> b").distinct(), "links", folder)
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
