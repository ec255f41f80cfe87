"""Two runs compared: what grew, what shrank, what cannot be told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .vectors import cosine_distance


def verdicts(old: DataFrame, new: DataFrame, key: str, poisoned: Column | None = None) -> DataFrame:
    """Full outer comparison of two panels ``(key, members, authors, communities)``.

    Growth and loss count beyond a floor of two members or a tenth of the old ones;
    growth is broad if four tenths of it are new authors and no community is lost. A
    negative reading is withheld where ``poisoned`` holds.
    """
    o = old.select(key, *[F.col(c).alias(f"old_{c}") for c in ("members", "authors", "communities")])
    j = o.join(new, key, "full_outer")
    dm, da, dc = (F.col(c) - F.col(f"old_{c}") for c in ("members", "authors", "communities"))
    j = j.withColumns({"dm": dm, "da": da, "dc": dc, "floor": F.greatest(F.lit(2.0), 0.1 * F.col("old_members"))})
    share = F.col("da") / F.col("dm")
    negative = F.when(F.lit(False) if poisoned is None else poisoned, "unresolved").otherwise("shrank")
    verdict = (
        F.when(F.col("old_members").isNull(), "new")
        .when(F.col("members").isNull(), F.when(F.lit(False) if poisoned is None else poisoned, "unresolved").otherwise("vanished"))
        .when((F.col("dm") > F.col("floor")) & (F.col("da") > 0) & (F.col("dc") >= 0) & (share >= 0.4), "grew-broadly")
        .when(F.col("dm") > F.col("floor"), "grew-narrowly")
        .when(F.col("dm") < -F.col("floor"), negative)
        .otherwise("flat")
    )
    growth = F.when(F.col("dm") > 0, F.round(share, 2))
    return j.select(key, "old_members", "members", "dm", "da", "dc", growth.alias("author_share"), verdict.alias("verdict"))


def _distances(old: DataFrame, new: DataFrame, key: str, vector: str) -> DataFrame:
    """``(old, new, distance)`` of every pair of clusters of two snapshots, the new ones in blocks of about 1024 that are broadcast."""
    o, n = old.select(F.col(key).alias("old"), F.col(vector).alias("a")), new.select(F.col(key).alias("new"), F.col(vector).alias("b"))
    blocks, out = max(1, -(-n.count() // 1024)), None
    for i in range(blocks):
        part = n.filter(F.pmod(F.xxhash64("new"), F.lit(blocks)) == i)
        near = o.join(F.broadcast(part), F.lit(True)).select("old", "new", F.round(cosine_distance(F.col("a"), F.col("b")), 6).alias("distance"))
        out = near if out is None else out.unionByName(near)
    return out


def mutual_matches(old: DataFrame, new: DataFrame, key: str, cut_at: float, vector: str = "centroid") -> DataFrame:
    """Pairs that are each other's nearest within the cut, from two tables of centroids.

    Every pair is looked at, as a nearest one needs, block by block."""
    d = _distances(old, new, key, vector)
    forth = F.row_number().over(W.partitionBy("old").orderBy("distance", "new"))
    back = F.row_number().over(W.partitionBy("new").orderBy("distance", "old"))
    within = F.count_if(F.col("distance") <= cut_at).over(W.partitionBy("old"))
    m = d.withColumns({"f": forth, "b": back, "within": within}).filter((F.col("f") == 1) & (F.col("b") == 1) & (F.col("distance") <= cut_at))
    return m.select("old", "new", "distance", (F.col("distance") > 0.75 * cut_at).alias("loose"), (F.col("within") > 1).alias("split"))


def health_changes(health: DataFrame, order: str = "logged_at") -> DataFrame:
    """Per source the first and last status that was logged, and whether it got worse."""
    best = F.when(F.col("status") == "ok", 0).otherwise(1)
    r = health.groupBy("source").agg(F.min_by("status", F.struct(order, "seq")).alias("first_status"), F.max_by("status", F.struct(order, "seq")).alias("last_status"), F.count(F.lit(1)).alias("entries"), F.count_if(best == 1).alias("not_ok"))
    return r.withColumn("degraded", (F.col("first_status") == "ok") & (F.col("last_status") != "ok"))


def health_of_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Statuses of two runs ``(source, status)`` side by side, full outer; ``poisons`` where a source was ok and is not any more, or is gone."""
    j = old.select("source", F.col("status").alias("old_status")).join(new.select("source", F.col("status").alias("new_status")), "source", "full_outer")
    return j.withColumn("poisons", F.coalesce((F.col("old_status") == "ok") & (F.coalesce("new_status", F.lit("missing")) != "ok"), F.lit(False)))


def unmatched(old: DataFrame, new: DataFrame, key: str, cut_at: float, vector: str = "centroid") -> DataFrame:
    """Clusters of either run without a mutual nearest one within the cut, and the nearest there is: ``(side, key, nearest, distance)``."""
    d = _distances(old, new, key, vector)
    forth = d.groupBy("old").agg(F.min(F.struct("distance", "new")).alias("m")).select("old", "m.new", "m.distance")
    back = d.groupBy("new").agg(F.min(F.struct("distance", "old")).alias("m")).select("new", "m.old", "m.distance")
    both = forth.join(back.select("new", "old"), ["old", "new"], "left_semi").filter(F.col("distance") <= cut_at)
    gone = forth.join(both.select("old"), "old", "left_anti").select(F.lit("vanished").alias("side"), F.col("old").alias(key), F.col("new").alias("nearest"), "distance")
    fresh = back.join(both.select("new"), "new", "left_anti").select(F.lit("new").alias("side"), F.col("new").alias(key), F.col("old").alias("nearest"), "distance")
    return gone.unionByName(fresh)


def splits_and_merges(old: DataFrame, new: DataFrame, key: str, cut_at: float, vector: str = "centroid") -> DataFrame:
    """Clusters with more than one partner within the cut: an old one is split, a new one merged."""
    near = _distances(old, new, key, vector).filter(F.col("distance") <= cut_at).select("old", "new")
    split = near.groupBy(F.col("old").alias(key)).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("new")), ",").alias("partners")).withColumn("kind", F.lit("split"))
    merge = near.groupBy(F.col("new").alias(key)).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("old")), ",").alias("partners")).withColumn("kind", F.lit("merged"))
    return split.unionByName(merge).filter("n > 1")


def slope_change(old: Column, new: Column, old_shape: Column, new_shape: Column, days: Column, bucket_days: Column) -> Column:
    """What two readings of one series say: a change of slope within 15 points is noise, one of shape needs a whole bucket between them."""
    flip = F.when(~old_shape.eqNullSafe(new_shape), F.when(days >= bucket_days, "shape changed").otherwise("shape flip within a bucket"))
    slope = F.when(old.isNull() | new.isNull(), "not measured").when(F.abs(new - old) <= 15, "noise").when(new > old, "steeper").otherwise("less steep")
    return F.coalesce(flip, slope)
