"""Connected components as DataFrame rounds: no link, node or label is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import forget, matched, saved


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b: long); component is the smallest node that can be reached.

    Large-star and small-star rounds until nothing changes: each round only rewires links to smaller nodes, so rows
    never outnumber the links given, and the number of rounds grows with the logarithm of the longest path. Links to
    itself and repeated links do no harm; an empty input gives an empty result.
    """
    links = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        before = links
        # large-star: what is larger than u goes to the least of u and its neighbours
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        links = both.where("b > a").transform(matched, least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small-star: u and its smaller neighbours go to the least of them
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        links = matched(links, least, ["a"]).select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        links = saved(links)
        forget(before)  # what the round began with is not needed again, so disk does not grow with the rounds
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
