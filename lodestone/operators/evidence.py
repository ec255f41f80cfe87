"""Cleaning, deduplication with lineage, and per-cluster aggregates of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """Trimmed; blank is null."""
    return F.nullif(F.trim(c), F.lit(""))


def engagement(score: Column, comments: Column) -> Column:
    """Score plus comments over what is reported; null if neither is. Never a made-up zero."""
    none = score.isNull() & comments.isNull()
    return F.when(~none, F.coalesce(score, F.lit(0)) + F.coalesce(comments, F.lit(0)))


def cleaned(evidence: DataFrame) -> DataFrame:
    """Evidence with clean strings, ``engagement_value`` and ``body`` (title and text); rows without both dropped."""
    e = evidence.select(
        "row_id", clean(F.col("id")).alias("id"), clean(F.col("cell_id")).alias("cell_id"), F.lower(clean(F.col("source"))).alias("source"),
        clean(F.col("url")).alias("url"), clean(F.col("title")).alias("title"), clean(F.col("text")).alias("text"),
        clean(F.col("author")).alias("author"), clean(F.col("community")).alias("community"), F.lower(clean(F.col("query"))).alias("query"),
        F.col("engagement.score").alias("score"), F.col("engagement.comments").alias("comments"), "created_utc", "captured_utc",
    )
    e = e.withColumn("engagement_value", engagement(F.col("score"), F.col("comments")))
    return e.withColumn("body", F.concat_ws("\n", "title", "text")).filter("body <> ''")


def deduplicated(e: DataFrame) -> DataFrame:
    """Two passes: by id, then by (url, text without blanks and case) where a url is there.

    The first row by row_id wins. ``cells`` joins the distinct cell ids of all
    rows it stands for, ``dropped`` counts the others. Rows with a null id or
    url are never merged by it. Each pass is a partial aggregation; ``min`` finds the winner.
    """
    key = F.coalesce(F.concat(F.lit("i"), "id"), F.concat(F.lit("r"), F.col("row_id").cast("string")))
    text = F.lower(F.regexp_replace(F.trim(F.coalesce("text", F.lit(""))), r"[ \t\n\r]+", " "))
    # The wide columns are hashed before anything moves.
    content = F.when(F.col("url").isNotNull(), F.sha1(F.concat("url", F.lit("\n"), text)))
    narrow = e.select(key.alias("k"), F.struct("row_id", content.alias("content")).alias("row"), "cell_id")
    one = narrow.groupBy("k").agg(F.min("row").alias("first"), F.collect_set("cell_id").alias("cells"), F.count(F.lit(1)).alias("n"))
    # A set of cells is bounded by the frame; a list of rows is not.
    two = one.select(F.coalesce("first.content", "k").alias("c"), "first.row_id", "n", "cells")
    sums = two.groupBy("c").agg(F.min("row_id").alias("row_id"), F.sum("n").alias("n"))
    sets = two.select("c", F.explode("cells").alias("cell")).groupBy("c").agg(F.collect_set("cell").alias("cells"))
    j = sums.join(sets, "c", "left")
    return j.select("row_id", F.coalesce(F.array_join(F.array_sort("cells"), ","), F.lit("")).alias("cells"), (F.col("n") - 1).alias("dropped"))


def panel(e: DataFrame, cluster: str = "query") -> DataFrame:
    """Per cluster: members, distinct authors and communities, engagement (null if none is reported), cells."""
    return e.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("member_count"),
        F.count_distinct("author").alias("distinct_authors"),
        F.count_distinct("community").alias("distinct_communities"),
        F.sum("engagement_value").alias("engagement_sum"),
        F.array_join(F.array_sort(F.collect_set("cell_id")), ",").alias("cell_ids"),
    )


def first_urls(e: DataFrame, cluster: str = "query", most: int = 3) -> DataFrame:
    """The first distinct urls of each cluster, loudest first; unreported engagement and zero last."""
    loud = F.coalesce(F.nullif(F.col("engagement_value"), F.lit(0)), F.lit(-1))
    # One row per url before the ranking: the window sees distinct urls only.
    best = e.filter("url is not null").groupBy(cluster, "url").agg(F.max(F.struct(loud, -F.col("row_id"))).alias("b"))
    rank = F.row_number().over(W.partitionBy(cluster).orderBy(F.col("b").desc()))
    return best.withColumn("rank", rank).filter(F.col("rank") <= most).select(cluster, "rank", "url")


def shared_url_winner(e: DataFrame, sources: list[str]) -> DataFrame:
    """Of rows whose url is known to several of ``sources``, the longest text per url; ties to the earlier source, then row.

    Rows with a null url or a url known to one source only are left alone.
    """
    priority = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    u = F.regexp_replace("url", "/$", "")
    known = e.filter(F.col("url").isNotNull() & F.col("source").isin(*sources)).withColumn("u", u)
    best = known.groupBy("u").agg(
        F.count_distinct("source").alias("n_sources"),
        F.max(F.struct(F.length(F.coalesce("text", F.lit(""))), -priority, -F.col("row_id"))).alias("b"),
        F.count(F.lit(1)).alias("n"),
    )
    return best.filter("n_sources > 1").select(F.col("u").alias("url"), (-F.col("b").getField("col3")).alias("row_id"), (F.col("n") - 1).alias("dropped"))


def round_robin(e: DataFrame, group: str, order: str, slices: int = 1024) -> DataFrame:
    """Rows interleaved over groups: ``turn`` is 1 for the first row of each group, 2 for the second, and so on.

    The turn is counted inside slices of ``order`` (a unique bigint) and over the slices' counts, so
    that a group with most of the rows is spread over many tasks.
    """
    low, high = e.agg(F.min(order), F.max(order)).first()
    width = max(1, ((high or 0) - (low or 0)) // slices + 1)
    sliced = e.withColumn("slice", F.call_function("div", F.col(order) - F.lit(low or 0), F.lit(width)))
    upto = W.partitionBy(group).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    counts = sliced.groupBy(group, "slice").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(group, "slice", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy(group, "slice").orderBy(order))
    ranked = sliced.withColumn("inside", inside).join(before, [group, "slice"])
    return ranked.withColumn("turn", F.col("before") + F.col("inside")).drop("slice", "inside", "before")


def top_per_group(e: DataFrame, group: str, n: int, by: Column, order: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(group).orderBy(by.desc(), F.col(order)))
    return e.withColumn("rank", rank).filter(F.col("rank") <= n)


def source_health(e: DataFrame) -> DataFrame:
    """Per source: rows, rows without url, without engagement, and a status that says so."""
    h = e.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("url").isNull()).alias("no_url"),
        F.count_if(F.col("engagement_value").isNull()).alias("no_engagement"),
    )
    status = F.when((F.col("no_url") > 0) | (F.col("no_engagement") == F.col("n")), "degraded").otherwise("ok")
    return h.withColumn("status", status)
