"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodebook.session import materialize

ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b); label is the smallest node of its component.

    Each round hangs all neighbours of a node on the smallest one: first those larger than the node, then
    the node itself with its smaller ones. Only minima per node are joined, so a node of very many links is
    pre-aggregated in the tasks. Rounds end when a round changes nothing; each is written to the shared folder.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                        "links-0")
    for number in range(1, ROUNDS + 1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Larger neighbours of u hang on u's smallest neighbour.
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(small_least, "u")
                 .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where("u <> v").distinct())
        new = materialize(small, f"links-{number}")
        done = new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty()
        edges = new
        if done:
            break
    else:
        raise RuntimeError("the components have not settled")
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()))
