"""Connected components of a distributed link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import release, salted_join, stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long); component is the least node reachable.

    Alternates large-star and small-star steps until the links are stars. Each
    step is an aggregate (minimum per node, combined before the shuffle) and a
    join that deals a hub's links to several tasks, so a hub never meets its
    neighbours in one row, group or task. Every step's
    links are a table in the shared folder: lineage stays short, and nothing is
    collected but a count and a checksum. Self links are allowed, nulls are not.
    """
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    now = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        both = now.select(F.explode(F.array(pair("a", "b"), pair("b", "a"))).alias("l")).select("l.*")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = salted_join(both, least, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.where("a > m").select("a", F.col("m").alias("b"))).distinct()
        large = large.where("a > b")
        large = stored(large, "large")
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        after = salted_join(large, small, "a", "b").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l"))
        after = stored(after.select("l.*").where("a > b").distinct(), "links")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        release(now)
        now = after
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return out.unionByName(roots)
