"""Connected components of a graph that is too large for the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import saved


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of `links` (a, b): component is the smallest node that can be reached.

    Alternating large-star and small-star rounds (Kiveris et al., 2014) turn the links into one star
    for each component in a logarithmic number of rounds. Each half-round takes a minimum for each node,
    which partial aggregation shrinks before the shuffle, and joins it back to the links with a
    shuffled join whose hot keys adaptive execution can split. The links of each round are written to
    the shared folder. Links with a null end, self links, repeated and reversed links are allowed;
    a node that only has self links is no node of the result. No links: no rows.
    """
    links = saved(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    before = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every large-star link runs from a node to a smaller one
        large = saved(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
