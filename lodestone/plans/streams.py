"""Queries that run as streams over what has arrived."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import capture


def stream_dedup(spark, d):
    """Rows per source after each id was let through once."""
    s = capture.source(spark, d, "evidence_sample").select("row_id", "id", "source", F.col("received_at").cast("timestamp").alias("received_at"))
    kept = capture.drained(capture.once(s))
    return kept.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def stream_tumbling(spark, d):
    """Events per day and type of all days that are closed."""
    s = capture.source(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return capture.drained(capture.tumbling(s, "ts", "1 day", "1 hour", "event_type"))


def stream_half_years(spark, d):
    """Posts per calendar half-year, kept up to date by every batch."""
    s = capture.source(spark, d, "evidence_sample").filter("created_utc is not null")
    return capture.drained(capture.half_years(s, "created_utc"), "complete")


QUERIES = {"stream_dedup": stream_dedup, "stream_tumbling": stream_tumbling, "stream_half_years": stream_half_years}
ORACLES = {
    "stream_half_years": """select year(to_timestamp(created_utc)) || case when month(to_timestamp(created_utc)) <= 6 then '-H1' else '-H2' end as period, count(*) as n
      from evidence_sample where created_utc is not null group by 1""",
}
