"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import cut_lineage


def connected_components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of links(a, b): root is the smallest node of its component. Nulls are left out.

    Large-star and small-star steps in turn: each hangs the neighbours of a node on its smallest neighbour, so the edge
    table never grows beyond its size and becomes stars in a logarithmic number of rounds. A round is two aggregations
    with joins on the node (a hub is one key of a plain equi-join, which adaptive execution can split) and is
    written to the checkpoint folder. RuntimeError if `rounds` did not suffice.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = cut_lineage(edges)
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = cut_lineage(small.distinct())
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if before == mark:
            break
        before = mark
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
