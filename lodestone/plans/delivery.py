"""Queries over redelivered messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.delivery import deduplicated, message_keys, surplus_deliveries
from ..operators.positions import FILE, POS, scan_with_positions


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per surplus delivery."""
    rows = scan_with_positions(spark, f"{sf_dir}/evidence_sample.parquet", ["row_id", "id", "url", "created_utc"])
    losers = surplus_deliveries(message_keys(rows, "row_id", (FILE, POS)), "row_id")
    return losers.select(F.col("first").alias("first_row_id"), "row_id")


def p7_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message once, with its whole payload flattened to scalar columns."""
    kept = deduplicated(spark, f"{sf_dir}/evidence_sample.parquet")
    return kept.select(
        "row_id", "batch_id", "id", "cell_id", "source", "url", "title", "text", "author", "community",
        F.col("engagement.score").alias("score"), F.col("engagement.comments").alias("comments"), "created_utc", "captured_utc", "query",
    )


QUERIES = {"p7_found": p7_found, "p7_messages": p7_messages}

_SQUEEZE = r"lower(regexp_replace({c}, '[\s\p{{Z}}\p{{Cc}}\p{{Cf}}]+', '', 'g'))"
_ID = f"regexp_replace({_SQUEEZE.format(c='id')}, '^(?:urn:)?[a-z][a-z0-9]*:', '')"
_BASE = rf"regexp_replace(regexp_replace(regexp_replace({_SQUEEZE.format(c='url')}, '#.*$', ''), '^(?:[a-z][a-z0-9+.-]*:)?//', ''), '^(?:www|old|new|np|m|amp|mobile)\.', '')"
MESSAGES_SQL = rf"""
raw as (
  select *, case when {_ID} not in ('', 'null', 'none', 'n/a', 'na', 'nan', 'unknown', 'undefined', '-') then {_ID} end as cid,
    {_BASE} as u from evidence_sample),
cleaned as (
  select * exclude (u), regexp_replace(regexp_replace(split_part(u, '?', 1), '/{{2,}}', '/', 'g'), '/$', '')
    || case when len(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_[a-z_]+|ref|ref_src|share_id|fbclid|gclid|si|source|context)(=.*)?$'))) > 0
       then '?' || array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_[a-z_]+|ref|ref_src|share_id|fbclid|gclid|si|source|context)(=.*)?$'))), '&') else '' end as link
  from raw),
owners as (
  select link, created_utc, arg_min(cid, row_id) as owner from cleaned where cid is not null group by link, created_utc),
messages as (
  select c.*, coalesce('id ' || c.cid, 'id ' || o.owner, 'link ' || c.link || ' ' || coalesce(c.created_utc::varchar, '?'), 'row ' || c.row_id) as message
  from cleaned c left join owners o on c.link = o.link and c.created_utc is not distinct from o.created_utc),
firsts as (select *, min(row_id) over (partition by message) as first_row_id from messages)
"""
ORACLES = {
    "p7_found": f"with {MESSAGES_SQL} select first_row_id, row_id from firsts where row_id <> first_row_id",
    "p7_messages": f"""with {MESSAGES_SQL} select row_id, batch_id, id, cell_id, source, url, title, text, author, community,
        engagement.score as score, engagement.comments as comments, created_utc, captured_utc, query from firsts where row_id = first_row_id""",
}
