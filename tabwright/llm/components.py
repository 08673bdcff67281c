"""Connected components of a graph that is a table of links, without bringing any of it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import shared_table


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``links`` (a long, b long); a component's name is its smallest node.

    Alternates large-star and small-star steps until the links are stars around their smallest nodes, which the first
    table of a round shows: a node with a smaller neighbour has no other. Each step's minima are written tables, so that
    the joins with them have plain exchanges and hubs are split.
    """
    links = shared_table(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = shared_table(both.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n")), "large-star")
        if least.where("low < a and n > 1").isEmpty():
            break
        least = least.select("a", F.least("low", "a").alias("m"))
        wide = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        wide = shared_table(wide, "wide-links")
        least = shared_table(wide.groupBy("a").agg(F.min("b").alias("m")), "small-star")
        near = wide.join(least, "a")
        links = shared_table(near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
