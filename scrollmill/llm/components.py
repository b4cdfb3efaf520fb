"""Connected components of a distributed table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrollmill.llm.common import cut, join_split


def components(links: DataFrame) -> DataFrame:
    """(id, component) of each end of links (a, b); a component is its least id.

    Large-star and small-star steps take turns until the edges are stars: each links every end to the least id near it,
    so that the rounds grow with the logarithm of the largest component. The links of a node that has very many are dealt
    over several places, to each of which its least neighbour is told.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = cut(both.groupBy("a").agg(F.min("b").alias("lo"), F.count(F.lit(1)).alias("n")), "near")
        # The edges are stars around their least nodes if a node that has one below it has no other.
        tangled, *known = near.agg(F.max((F.col("lo") < F.col("a")) & (F.col("n") > 1)), F.sum("n"), F.max("n")).first()
        if not tangled:
            break
        least = near.select("a", F.least("lo", "a").alias("m"), "n")
        large = join_split(both, least, ["a"], "n", ["b"], known=tuple(known)).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = cut(large, "large-star")
        least = cut(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "near")
        small = join_split(large, least, ["a"], "n", ["b"]).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = cut(small.where("a <> b").distinct(), "links")
    ends = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ends.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
