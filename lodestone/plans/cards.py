"""Queries over cards: a cluster with its panels side by side, and the order in which a report shows them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import rubric
from ..runtime import table
from .comparison import CARDS
from .evidence import _clusters, _quotes

#: The share of authors over members below which a pain is one of few people.
TOP = 5


def _panels(spark, d) -> DataFrame:
    """One row per cluster: frequency always, intensity if any quote was found, competitors only if every row names a community."""
    f, i = rubric.frequency_read(_clusters(spark, d)), rubric.intensity(_quotes(spark, d))
    e = table(spark, d, "evidence_sample").filter("query is not null").select(F.lower(F.nullif(F.trim("query"), F.lit(""))).alias("query"), "community")
    c = e.groupBy("query").agg(F.count_if(F.col("community").isNull()).alias("gaps"), F.count_distinct(F.lower(F.trim("community"))).alias("n"))
    c = c.select("query", F.when(F.col("gaps") == 0, F.col("n")).alias("competitor_count"))
    return f.join(i, "query", "left").join(c, "query", "left")


def missing_panels(spark, d):
    """Which panels a cluster lacks; one without any lack can be rendered."""
    p = _panels(spark, d)
    lacks = F.array_compact(F.array(F.when(F.col("score").isNull(), "intensity"), F.when(F.col("competitor_count").isNull(), "saturation"), F.when(F.col("engagement_sum").isNull(), "engagement")))
    return p.select("query", F.array_join(lacks, ",").alias("missing"), (F.size(lacks) == 0).alias("renderable"))


def contract_order(spark, d):
    """Cards by score, then by what buyers say, then by fewest competitors with unknown ones last: keys side by side."""
    p = _panels(spark, d).withColumn("score", F.coalesce("score", F.lit(1)))
    buyers = F.when(F.col("b") >= 2, 3).when(F.col("b") == 1, 2).otherwise(1)
    place = F.row_number().over(W.orderBy(F.desc("score"), buyers.desc(), F.asc_nulls_last("competitor_count"), "query"))
    return p.select(place.cast("bigint").alias("place"), "query", F.col("score").cast("bigint").alias("score"), buyers.cast("bigint").alias("buyers"), "competitor_count")


def pain_order(spark, d):
    """Cards that pass the gate (read above low) and have a score, loudest first."""
    p = _panels(spark, d).filter("read <> 'low' and score is not null")
    return p.select(F.row_number().over(W.orderBy(F.desc("score"), F.desc("member_count"), "query")).cast("bigint").alias("place"), "query", F.col("score").cast("bigint").alias("score"), "member_count")


def top_cards(spark, d, n: int = TOP):
    """The first cards of the contract's order that are researched: those with a quote."""
    order = contract_order(spark, d).join(_panels(spark, d).filter("score is not null").select("query"), "query", "left_semi")
    return order.select("query", "place", "score").orderBy("place").limit(n)


def shown_cards(spark, d):
    """How many cards a report shows that is asked for high pain, and for buyers that speak."""
    p = _panels(spark, d)
    return p.agg(F.count(F.lit(1)).alias("cards"), F.count_if(F.col("score") >= 4).alias("high_pain"), F.count_if(F.col("b") > 0).alias("buyers_speak"), F.count_if(F.col("score").isNull()).alias("under_researched"))


def report_lines(spark, d):
    """A report in Markdown, one row a line: thresholds first, then the cards in the contract's order."""
    order = contract_order(spark, d).join(_panels(spark, d).select("query", "read", "note", "member_count", "distinct_authors"), "query")
    body = order.select("place", F.format_string("%d. **%s**: score %d, %s, %d rows by %d authors%s", "place", "query", "score", "read", "member_count", "distinct_authors", F.coalesce(F.concat(F.lit(" ("), "note", F.lit(")")), F.lit(""))).alias("line"))
    head = _panels(spark, d).agg(F.first("high_size").alias("s"), F.first("high_authors").alias("a")).filter("s is not null").select(F.lit(0).cast("bigint").alias("place"), F.format_string("Thresholds: %d rows by %d authors are high", "s", "a").alias("line"))
    return head.unionByName(body)


_NAMES = "missing_panels contract_order pain_order top_cards shown_cards report_lines".split()
QUERIES = {name: globals()[name] for name in _NAMES}

_P = f"""{CARDS}, cc as (select lower(nullif(trim(query), '')) as query, count(*) filter (community is null) as gaps, count(distinct lower(trim(community))) as n from evidence_sample where query is not null group by 1),
  p as (select freq.*, score, b, case when gaps = 0 then n end as competitor_count from freq left join intensity using (query) left join cc using (query)),
  co as (select row_number() over (order by coalesce(score, 1) desc, case when b >= 2 then 3 when b = 1 then 2 else 1 end desc, competitor_count nulls last, query) as place, query, coalesce(score, 1)::bigint as score,
    (case when b >= 2 then 3 when b = 1 then 2 else 1 end)::bigint as buyers, competitor_count from p)"""
ORACLES = {
    "missing_panels": f"""with {_P}, m as (select query, list_filter([case when score is null then 'intensity' end, case when competitor_count is null then 'saturation' end, case when engagement_sum is null then 'engagement' end], lambda x: x is not null) as l from p)
      select query, coalesce(array_to_string(l, ','), '') as missing, len(l) = 0 as renderable from m""",
    "contract_order": f"with {_P} select * from co",
    "pain_order": f"with {_P} select row_number() over (order by score desc, member_count desc, query) as place, query, score::bigint as score, member_count from p where read <> 'low' and score is not null",
    "top_cards": f"with {_P} select co.query, place, co.score from co join p using (query) where p.score is not null order by place limit {TOP}",
    "shown_cards": f"with {_P} select count(*) as cards, count(*) filter (score >= 4) as high_pain, count(*) filter (b > 0) as buyers_speak, count(*) filter (score is null) as under_researched from p",
    "report_lines": f"""with {_P} select place, place || '. **' || query || '**: score ' || co.score || ', ' || read || ', ' || member_count || ' rows by ' || distinct_authors || ' authors' || coalesce(' (' || note || ')', '') as line from co join p using (query)
      union all select 0, 'Thresholds: ' || max(high_size) || ' rows by ' || max(high_authors) || ' authors are high' from p having count(*) > 0""",
}
