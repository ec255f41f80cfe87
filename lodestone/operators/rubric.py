"""How often and how hard: two readings of a cluster, from ladders with printed thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of the two ladders and the corpus sizes they are calibrated for.
HIGH, MEDIUM = {"size": 20, "authors": 12, "comm": 3}, {"size": 8, "authors": 6, "comm": 2}
CALIBRATED = (300, 1500)
COST_MARKERS = ("money_loss", "time_quantified", "workaround_built", "abandonment")


def scaled(corpus: Column, base: int) -> Column:
    low, high = CALIBRATED
    factor = F.when(corpus < low, corpus / low).when(corpus > high, corpus / high).otherwise(F.lit(1.0))
    return F.greatest(F.lit(2), F.bround(F.lit(float(base)) * factor).cast("bigint"))


def thresholds(corpus: Column) -> dict[str, Column]:
    out = {}
    for field in ("size", "authors"):
        high, medium = scaled(corpus, HIGH[field]), scaled(corpus, MEDIUM[field])
        out[f"high_{field}"] = F.when(high <= medium, medium + 1).otherwise(high)
        out[f"medium_{field}"] = medium
    return out


def top_decile(panel: DataFrame, least: int = 10) -> DataFrame:
    """One row: the 90th percentile of engagement over clusters, null as zero; null under ``least`` clusters."""
    p90 = F.percentile(F.coalesce("engagement_sum", F.lit(0)), F.lit(0.9))
    return panel.agg(F.when(F.count(F.lit(1)) >= least, p90).alias("decile_floor"), F.sum("member_count").alias("corpus"))


def frequency_read(panel: DataFrame) -> DataFrame:
    """``read`` of each cluster with the rules that fired and the thresholds used.

    Volume gives a level; few communities cap it, repetition by few authors takes one
    level away, engagement in the top decile gives one back where communities allow.
    """
    p = panel.crossJoin(F.broadcast(top_decile(panel)))
    p = p.withColumns(thresholds(F.col("corpus")))
    m, a, c = F.col("member_count"), F.col("distinct_authors"), F.col("distinct_communities")
    high = (m >= F.col("high_size")) & (a >= F.col("high_authors"))
    medium = (m >= F.col("medium_size")) & (a >= F.col("medium_authors"))
    p = p.withColumn("volume", F.when(high, 3).when(medium, 2).otherwise(1))
    p = p.withColumn("capped", F.when((F.col("volume") == 3) & (c < HIGH["comm"]), 2).otherwise(F.col("volume")))
    repeat = (m > 0) & (a / m < 0.4)
    p = p.withColumn("demoted", F.when(repeat, F.greatest(F.lit(1), F.col("capped") - 1)).otherwise(F.col("capped")))
    loud = F.col("decile_floor").isNotNull() & (F.coalesce("engagement_sum", F.lit(0)) >= F.col("decile_floor")) & (c >= HIGH["comm"])
    p = p.withColumn("level", F.when((F.col("demoted") == 2) & loud, 3).otherwise(F.col("demoted")))
    notes = [
        F.when(F.col("capped") < F.col("volume"), F.when(c <= 1, "one community").otherwise("few communities")),
        F.when(F.col("demoted") < F.col("capped"), "few authors repeat"),
        F.when(F.col("level") > F.col("demoted"), "engagement in top decile"),
        F.when(F.col("level") < 3, "below the top level"),
    ]
    read = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("level"))
    return p.select(*panel.columns, read.alias("read"), F.nullif(F.concat_ws("; ", *notes), F.lit("")).alias("note"),
                    "high_size", "high_authors", "medium_size", "medium_authors", F.round("decile_floor", 4).alias("decile_floor"))


def intensity(quotes: DataFrame, cluster: str = "query") -> DataFrame:
    """Score 1 to 5 from ``(cluster, marker, author, recurring)``, one row per valid quote.

    A marker is present with any quote; levels above 2 count distinct identifying
    authors, so null authors make a marker present but no level.
    """
    cost = F.col("marker").isin(*COST_MARKERS)
    per = quotes.groupBy(cluster, "marker").agg(F.count_distinct("author").alias("authors"))
    sums = per.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("markers"),
        F.count_if(cost & (F.col("authors") >= 2)).alias("k"),
        F.coalesce(F.max(F.when(F.col("marker") == "complainer_is_buyer", F.col("authors"))), F.lit(0)).alias("b"),
        F.max(F.col("marker") != "profanity_urgency").alias("beyond_profanity"),
    )
    people = quotes.groupBy(cluster).agg(
        F.count_distinct(F.when(cost & F.col("recurring"), F.col("author"))).alias("r"), F.count_distinct("author").alias("people")
    )
    s = sums.join(people, cluster)
    level = F.when(F.col("k") >= 1, 3).otherwise(2)
    level = F.when((F.col("k") >= 2) & (F.col("b") >= 1), 4).otherwise(level)
    level = F.when((level == 4) & (F.col("r") >= 2) & (F.col("b") >= 2), 5).otherwise(level)
    level = F.when(((F.col("people") <= 1) | ~F.col("beyond_profanity")) & (level > 2), 2).otherwise(level)
    s = s.withColumn("score", level)
    read = F.when(F.col("score") >= 4, "high").when(F.col("score") == 3, "medium").otherwise("low")
    return s.select(cluster, "markers", "k", "b", "r", "score", read.alias("intensity_read"))


def quadrant(read: Column, score: Column) -> Column:
    return F.concat(F.when(read == "high", "high").otherwise("low"), F.lit("-freq/"), F.when(score >= 4, "high").otherwise("low"), F.lit("-intensity"))
