"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlab.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) of every linked node, from rows (x, y); the component is its least node.

    Each round hangs larger neighbours and then smaller ones on the least known node, until
    the links no longer change: a number of rounds that grows with the logarithm of the
    longest chain. Rounds are written to the shared folder. Minima are formed before the
    shuffle; no node's neighbours are gathered.
    """
    edges = scratch.keep(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u != v").distinct(), f"{name}-0")
    mark = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    seen, turn = mark(edges), 0
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = scratch.keep(large, f"{name}-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        turn += 1
        edges = scratch.keep(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{turn}")
        scratch.drop(f"{name}-large", f"{name}-{turn - 1}")
        before, seen = seen, mark(edges)
        if seen == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
