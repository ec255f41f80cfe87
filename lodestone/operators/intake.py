"""What may come in: reading times, checking records, naming sources, planning windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Names that sources go by.
ALIASES = {"hn": "hackernews", "hacker-news": "hackernews", "so": "stackoverflow", "ph": "producthunt", "gh": "github"}


def parsed_epoch(c: Column) -> Column:
    """Epoch seconds of a number, an ISO-8601 or an RFC-2822 time; null if it is none. No zone means UTC."""
    forms = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "d MMM yyyy HH:mm:ss Z")
    short = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3}, ", "")
    return F.coalesce(F.when(c.rlike(r"^\s*-?[0-9]+\s*$"), F.trim(c).try_cast("bigint")), *[F.unix_seconds(F.try_to_timestamp(short, F.lit(f))) for f in forms])


def source_name(c: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(c)), r"[\s_]+", "-")
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.element_at(known, s), s)


def first_problem(hosts: Column | None = None) -> Column:
    """The first reason why a record is refused, null if it is sound; the order of the checks is fixed."""
    host = F.regexp_extract(F.lower("url"), r"^https?://([^/?#]+)", 1)
    checks = F.when(F.col("url").isNull() | ~F.col("url").rlike(r"^https?://"), "no web address")
    if hosts is not None:
        checks = checks.when(~hosts, "host not allowed")
    return (
        checks.when(host == "", "no host")
        .when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty text")
        .when(F.col("title").isNull(), "no title")
        .when(F.col("created_utc") > F.col("captured_utc"), "made after capture")
    )


def first_of_batch(rows: DataFrame, batch: str, key: str, order: str) -> DataFrame:
    """Whether a row is the first with its key in its batch; the firsts are aggregated, then joined."""
    firsts = rows.groupBy(batch, key).agg(F.min(order).alias("_first"))
    return rows.join(firsts, [batch, key]).withColumn("repeat", F.col(order) != F.col("_first")).drop("_first")


def newest_windows(windows: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """The newest ``most`` windows of each plan: the oldest are given up first."""
    return windows.withColumn("age", F.row_number().over(W.partitionBy(group).orderBy(F.col(order).desc()))).filter(F.col("age") <= most)


def balanced_groups(terms: DataFrame, term: str, most: int = 5) -> DataFrame:
    """Terms dealt in turn to as few groups of at most ``most`` as there can be; terms with a comma stay alone."""
    alone = F.contains(F.col(term), F.lit(","))
    n = terms.filter(~alone).count()
    groups = max(1, -(-n // most))
    turn = F.row_number().over(W.partitionBy(alone).orderBy(term)) - 1
    return terms.withColumn("grp", F.when(alone, groups + turn).otherwise(F.pmod(turn, F.lit(groups))))


def scoped_counts(rows: DataFrame, scope: str, bucket: str, live_after: Column) -> DataFrame:
    """Bucket sums that are valid only if every live scope answered; otherwise only ``partial_count``.

    A scope is live if its newest row satisfies ``live_after``; others would void every bucket and are excluded.
    """
    newest = rows.groupBy(scope).agg(F.max("created_utc").alias("newest")).filter(live_after)
    live = rows.join(newest.select(scope), scope, "left_semi")
    counts = live.groupBy(bucket, scope).agg(F.count(F.lit(1)).alias("n"))
    total = newest.agg(F.count(F.lit(1)).alias("scopes"))
    sums = counts.groupBy(bucket).agg(F.sum("n").alias("partial_count"), F.count(F.lit(1)).alias("answered"))
    out = sums.crossJoin(F.broadcast(total))
    return out.withColumn("count", F.when(F.col("answered") == F.col("scopes"), F.col("partial_count")))
