"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens.llm.common import land

HUB_LINKS = 50_000  # a node with more links than this (and than 1/500 of all) is spread over SALTS join keys
SALTS = 64


def _star(links: DataFrame, total: int) -> DataFrame:
    """Links (u, v) with the smallest v of each u beside them: u, v, m.

    Hubs are at most 500 nodes (each holds over 1/500 of the links), so their list is
    bounded; their links are spread over salted keys.
    """
    least = land(links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "star")
    hubs = [r.u for r in least.filter(F.col("n") > max(HUB_LINKS, total // 500)).select("u").collect()]
    if not hubs:
        return links.join(least.drop("n"), "u")
    hub: Column = F.col("u").isin(hubs)
    salted = links.withColumn("s", F.when(hub, F.pmod(F.xxhash64("v"), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    least = least.withColumn("s", F.explode(F.when(hub, F.sequence(F.lit(0), F.lit(SALTS - 1)))
                                            .otherwise(F.array(F.lit(0))))).withColumn("s", F.col("s").cast("long"))
    return salted.join(least.drop("n"), ["u", "s"]).drop("s")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b of type long); root is the smallest node reachable.

    Large-star and small-star rounds: each round hangs the neighbours of a node on the
    smallest of them, until nothing changes. Every round is written to the shared
    folder. Self links and repeated links do no harm; an empty table gives an empty one.
    """
    e = land(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_star(both, 2 * before[0]).filter("v > u")
                 .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v").distinct())
        large = land(large, "large")
        stars = _star(large, before[0])
        e = land(stars.select("u", F.col("m").alias("v"))
                 .unionByName(stars.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "small")
        after = mark(e)
        if after == before:
            break
        before = after
    return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
