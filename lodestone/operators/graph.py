"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, drop


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node that has an edge with the smallest node of its component.

    ``edges`` has two bigint columns ``src`` and ``dst``; direction, repeated
    edges and self loops do not matter, edges with a null end are ignored and no
    edges give no rows. Returns ``(node, component)``. Every round is two
    aggregations and two joins over the remaining edges, written to the shared
    folder, so no neighbour list is ever held by one task and a lost executor
    repeats one round at most. The number of rounds grows with the logarithm of
    the component size.
    """
    pairs = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    pairs = pairs.filter("u is not null and v is not null and u <> v")
    current = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    seen = _fingerprint(current)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(low, "u")
            .filter("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        large = cut(large, "cc-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        following = cut(small, "cc-small")
        drop(current, large)
        current, before = following, seen
        seen = _fingerprint(current)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _fingerprint(df: DataFrame) -> tuple:
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return (row[0], row[1])
