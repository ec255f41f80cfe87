"""Queries over what comes in: times, records, scopes, JSON, plans of windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import half_year
from ..operators import intake, rubric
from ..operators import series as ts
from ..runtime import table
from .evidence import E, FREQ, _clusters, _e
from .series import S, SHAPES, _s


def parsed_times(spark, d):
    """Times written in five ways, by row, read back to epochs."""
    e = table(spark, d, "evidence_sample").filter("created_utc is not null").select("row_id", "created_utc")
    at, k = F.timestamp_seconds("created_utc"), F.col("row_id") % 6
    text = (
        F.when(k == 0, F.col("created_utc").cast("string")).when(k == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 2, F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
        .when(k == 3, F.date_format(at, "yyyy-MM-dd")).when(k == 4, F.lit("soon")).otherwise(F.concat(F.date_format(at, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000")))
    )
    return e.select("row_id", intake.parsed_epoch(text).alias("epoch"))


def record_problems(spark, d):
    """Why records would be refused, and how many repeat a url inside their batch."""
    e = table(spark, d, "evidence_sample").filter("url is not null").select("row_id", "batch_id", "url", "title", "text", "created_utc", "captured_utc")
    e = intake.first_of_batch(e, "batch_id", "url", "row_id")
    why = F.coalesce(intake.first_problem(), F.when(F.col("repeat"), "repeated in batch"), F.lit("sound"))
    return e.groupBy(why.alias("problem")).agg(F.count(F.lit(1)).alias("n"))


def source_names(spark, d):
    h = table(spark, d, "source_health").select(intake.source_name(F.col("source")).alias("source"), intake.source_name(F.col("fallback")).alias("fallback"))
    return h.groupBy("source", "fallback").agg(F.count(F.lit(1)).alias("n"))


def scoped_bucket_counts(spark, d):
    """Posts per half-year over the communities that are still alive."""
    e = _e(spark, d).filter("community is not null and created_utc is not null").withColumn("scope", F.lower("source")).withColumn("period", half_year(F.col("created_utc")))
    return intake.scoped_counts(e, "scope", "period", F.col("newest") >= 1735689600)


def archive_lag(spark, d):
    """Measured periods that close more than thirty days after a query's newest post: they say nothing."""
    newest = table(spark, d, "evidence_sample").filter("query is not null and created_utc is not null").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.max("created_utc").alias("newest"))
    s = _s(spark, d).join(newest, "source")
    return s.withColumn("beyond", (F.col("end_utc") - F.col("newest")) / 86400 > 30).groupBy("source").agg(F.count(F.lit(1)).alias("periods"), F.count_if("beyond").alias("beyond"))


def json_values(spark, d):
    """Event properties parsed with a guard: the value under ``k``, per type."""
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k bigint").alias("p"), F.get_json_object("props", "$.k").alias("raw"))
    return e.groupBy("event_type").agg(F.count("p.k").alias("parsed"), F.sum("p.k").alias("total"), F.count_distinct("raw").alias("kinds"))


def window_plan(spark, d):
    """The four newest periods of each query and source, when requests do not reach for all."""
    s = _s(spark, d).withColumn("plan", F.concat_ws("|", "query", "source"))
    return intake.newest_windows(s, "plan", "start_utc", 4).select("query", "source", "period", "age")


def comparison_groups(spark, d):
    """Queries dealt into groups that can be compared in one request."""
    return intake.balanced_groups(_s(spark, d).select("query").distinct(), "query")


def dense_series(spark, d):
    """Every query and source on the grid of all periods: what was not asked shows as null, not as zero."""
    s = _s(spark, d)
    keys, periods = s.select("query", "source").distinct(), s.groupBy("period").agg(F.min("start_utc").alias("at"))
    # The grid is keys times the few labels of calendar periods.
    grid = keys.crossJoin(F.broadcast(periods))
    return grid.join(s.select("query", "source", "period", "hits"), ["query", "source", "period"], "left").select("query", "source", "period", "hits", F.col("hits").isNotNull().alias("measured"))


def period_means(spark, d):
    """Mean hits per source and year, rounded half to even, partial periods left out; null if nothing is left."""
    s = _s(spark, d).withColumn("year", F.substring("period", 1, 4))
    return s.groupBy("source", "year").agg(F.bround(F.avg(F.when(~F.col("partial"), F.col("hits")))).cast("bigint").alias("mean_hits"), F.count(F.lit(1)).alias("periods"))


def status_pivot(spark, d):
    """Entries per source and status side by side, and the latest detail of what was not ok."""
    h = table(spark, d, "source_health").select("seq", F.lower(F.trim("source")).alias("source"), F.regexp_replace(F.lower(F.trim("status")), "[_ ]+", "-").alias("status"), "detail")
    p = h.groupBy("source").pivot("status", ["ok", "degraded", "unavailable"]).agg(F.count(F.lit(1)))
    worst = h.filter("status <> 'ok' and detail is not null").groupBy("source").agg(F.max_by("detail", "seq").alias("last_detail"))
    return p.join(worst, "source", "left").select("source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ok", "degraded", "unavailable")], "last_detail")


def two_deciles(spark, d):
    """The top decile of engagement in two readings: interpolated with null as zero, and by position without nulls."""
    p = _clusters(spark, d)
    one = p.agg(
        F.round(F.percentile(F.coalesce("engagement_sum", F.lit(0)), F.lit(0.9)), 4).alias("interpolated"),
        F.array_sort(F.collect_list("engagement_sum")).alias("a"),
    )
    at = F.least(F.floor(F.size("a") * 0.9), F.size("a") - 1).cast("int")
    return one.select("interpolated", F.get("a", at).alias("by_position"))


def thresholds_used(spark, d):
    """The thresholds of the frequency ladder for corpora of several sizes."""
    sizes = spark.createDataFrame([(n,) for n in (60, 300, 900, 1500, 4000, 10000)], "corpus bigint")
    return sizes.select("corpus", *[c.alias(n) for n, c in rubric.thresholds(F.col("corpus")).items()])


def two_curves(spark, d):
    """Demand against supply: the direction of posts on one source and of offers on another, per query."""
    def way(c):
        return F.when(c.isin("accelerating", "emerging", "rising"), "rising").when(c == "declining", "declining").when(c.isNotNull(), "flat")

    s = _s(spark, d)
    pain = ts.canonical_shapes(s).groupBy("query").agg(F.max_by("shape", F.struct("total", "source")).alias("p"))
    offer = ts.supply_shapes(s).groupBy("query").agg(F.max_by("shape", F.struct("total", "source")).alias("o"))
    j = pain.join(offer, "query").select("query", way(F.col("p")).alias("pain"), F.when(~F.col("o").isin("insufficient-data", "no-signal"), way(F.col("o"))).alias("offer"))
    read = (
        F.when(F.col("pain").isNull() | F.col("offer").isNull(), "unmeasured").when((F.col("pain") == "rising") & (F.col("offer") == "rising"), "contested")
        .when(F.col("pain") == "rising", "early").when((F.col("pain") == "declining") & (F.col("offer") == "rising"), "late").when(F.col("offer") == "rising", "being solved")
        .otherwise("underserved")
    )
    return j.withColumn("read", read)


def cells_recaptured(spark, d):
    """Whether all cells that a query had before are among those captured again."""
    e = _e(spark, d).filter("query is not null and cell_id is not null").withColumn("cell", F.lower("cell_id"))
    old = e.filter("created_utc < 1719792000").groupBy("query").agg(F.collect_set("cell").alias("old"))
    new = e.filter("created_utc >= 1719792000").groupBy("query").agg(F.collect_set("cell").alias("new"))
    return old.join(new, "query").select("query", F.size("old").alias("before"), F.size(F.array_except("old", "new")).alias("missing"), (F.size(F.array_except("old", "new")) == 0).alias("all_there"))


_NAMES = "parsed_times record_problems source_names scoped_bucket_counts archive_lag json_values window_plan comparison_groups dense_series period_means status_pivot two_deciles thresholds_used two_curves cells_recaptured".split()
QUERIES = {name: globals()[name] for name in _NAMES}

_NAME = lambda c: f"coalesce(map {{'hn': 'hackernews', 'hacker-news': 'hackernews', 'so': 'stackoverflow', 'ph': 'producthunt', 'gh': 'github'}}[regexp_replace(lower(trim({c})), '[\\s_]+', '-', 'g')], regexp_replace(lower(trim({c})), '[\\s_]+', '-', 'g'))"
_WAY = lambda c: f"case when {c} in ('accelerating', 'emerging', 'rising') then 'rising' when {c} = 'declining' then 'declining' when {c} is not null then 'flat' end"
SUPPLY = """p as (select *, row_number() over (partition by query, source order by start_utc, hits) - 1 as x from s where not partial),
  u2 as (select *, row_number() over (partition by query, source order by x) - 1 as k, count(*) over (partition by query, source) as n from p where hits is not null),
  a2 as (select query, source, count(*) as n, sum(hits)::bigint as total, regr_slope(hits, x) as sl, coalesce(sum(hits) filter (k < n // 2), 0) as first, max(hits) as top, arg_max(hits, k) as last, arg_min(hits, k) as start, list(hits order by k) as y from u2 group by 1, 2),
  g2 as (select query, source, count(*) as planned from p group by 1, 2),
  j2 as (select g2.query, g2.source, coalesce(n, 0) as n, total, first, top, last, start, list_position(y, top) - 1 as peak,
    case when coalesce(n, 0) < 3 then null when total = 0 then 0.0 else round(100 * sl / (total / n), 1) end as slope_pct from g2 left join a2 using (query, source)),
  supply as (select query, source, total, case when n < 3 then 'insufficient-data' when total = 0 then 'no-signal' when first = 0 and total - first > 0 then 'emerging'
    when peak > 0 and peak < n - 1 and last <= 0.5 * top and start <= 0.8 * top then 'spike-and-fade' when slope_pct >= 15 then 'rising' when slope_pct <= -15 then 'declining' else 'persistent-flat' end as shape from j2)"""
ORACLES = {
    "parsed_times": "select row_id, case row_id % 6 when 3 then created_utc - created_utc % 86400 when 4 then null else created_utc end as epoch from evidence_sample where created_utc is not null",
    "record_problems": """with e as (select *, row_id <> min(row_id) over (partition by batch_id, url) as repeat from evidence_sample where url is not null)
      select case when not regexp_matches(url, '^https?://') then 'no web address' when regexp_extract(lower(url), '^https?://([^/?#]+)', 1) = '' then 'no host' when coalesce(trim(text), '') = '' then 'empty text'
        when title is null then 'no title' when created_utc > captured_utc then 'made after capture' when repeat then 'repeated in batch' else 'sound' end as problem, count(*) as n from e group by 1""",
    "source_names": f"select {_NAME('source')} as source, {_NAME('fallback')} as fallback, count(*) as n from source_health group by 1, 2",
    "scoped_bucket_counts": f"""with {E}, v as (select lower(source) as scope, created_utc, year(to_timestamp(created_utc)) || case when month(to_timestamp(created_utc)) <= 6 then '-H1' else '-H2' end as period from e where community is not null and created_utc is not null),
      live as (select scope from v group by 1 having max(created_utc) >= 1735689600), t as (select count(*) as scopes from live),
      c as (select period, count(*) as partial_count, count(distinct scope) as answered from v where scope in (select scope from live) group by 1)
      select period, partial_count, answered, scopes, case when answered = scopes then partial_count end as count from c, t""",
    "archive_lag": f"""with {S}, n as (select lower(trim(source)) as source, max(created_utc) as newest from evidence_sample where query is not null and created_utc is not null group by 1)
      select source, count(*) as periods, count(*) filter ((end_utc - newest) / 86400 > 30) as beyond from s join n using (source) group by 1""",
    "json_values": "select event_type, count((props->>'k')::bigint) as parsed, sum((props->>'k')::bigint)::bigint as total, count(distinct props->>'k') as kinds from events group by 1",
    "window_plan": f"with {S}, r as (select *, row_number() over (partition by query, source order by start_utc desc) as age from s) select query, source, period, age from r where age <= 4",
    "comparison_groups": f"""with {S}, q as (select distinct query from s), n as (select greatest(1, ceil(count(*) filter (not contains(query, ',')) / 5.0))::bigint as g from q),
      t as (select query, contains(query, ',') as alone, row_number() over (partition by contains(query, ',') order by query) - 1 as turn from q)
      select query, case when alone then g + turn else turn % g end as grp from t, n""",
    "dense_series": f"with {S}, k as (select distinct query, source from s), p as (select distinct period from s) select query, source, period, hits, hits is not null as measured from k cross join p left join s using (query, source, period)",
    "period_means": f"with {S} select source, substr(period, 1, 4) as year, round_even(avg(hits) filter (not partial), 0)::bigint as mean_hits, count(*) as periods from s group by 1, 2",
    "status_pivot": """with h as (select seq, lower(trim(source)) as source, regexp_replace(lower(trim(status)), '[_ ]+', '-', 'g') as status, detail from source_health)
      select source, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'degraded') as degraded, count(*) filter (status = 'unavailable') as unavailable,
        arg_max(detail, seq) filter (status <> 'ok' and detail is not null) as last_detail from h group by 1""",
    "two_deciles": f"""with {FREQ}, a as (select round(quantile_cont(coalesce(engagement_sum, 0), 0.9), 4) as interpolated, list(engagement_sum order by engagement_sum) filter (engagement_sum is not null) as l from panel)
      select interpolated, l[least(floor(len(l) * 0.9), len(l) - 1)::int + 1] as by_position from a""",
    "thresholds_used": """with c as (select unnest([60, 300, 900, 1500, 4000, 10000])::bigint as corpus), f as (select *, case when corpus < 300 then corpus / 300.0::double when corpus > 1500 then corpus / 1500.0::double else 1.0 end as fac from c),
      t as (select corpus, greatest(2, round_even(20 * fac, 0)::bigint) as hs, greatest(2, round_even(8 * fac, 0)::bigint) as ms, greatest(2, round_even(12 * fac, 0)::bigint) as ha, greatest(2, round_even(6 * fac, 0)::bigint) as ma from f)
      select corpus, case when hs <= ms then ms + 1 else hs end as high_size, case when ha <= ma then ma + 1 else ha end as high_authors, ms as medium_size, ma as medium_authors from t""",
    "two_curves": f"""with {SHAPES}, {SUPPLY}, pn as (select query, arg_max_null(shape, row(total, source)) as p from shapes group by 1), ofr as (select query, arg_max_null(shape, row(total, source)) as o from supply group by 1),
      w as (select query, {_WAY('p')} as pain, case when o not in ('insufficient-data', 'no-signal') then {_WAY('o')} end as offer from pn join ofr using (query))
      select *, case when pain is null or offer is null then 'unmeasured' when pain = 'rising' and offer = 'rising' then 'contested' when pain = 'rising' then 'early' when pain = 'declining' and offer = 'rising' then 'late'
        when offer = 'rising' then 'being solved' else 'underserved' end as read from w""",
    "cells_recaptured": f"""with {E}, c as (select distinct query, lower(cell_id) as cell, created_utc >= 1719792000 as late from e where query is not null and cell_id is not null and created_utc is not null),
      o as (select query, count(*) as before, count(*) filter (cell not in (select cell from c n where late and n.query = c.query)) as missing from c where not late group by 1)
      select query, before, missing, missing = 0 as all_there from o where query in (select query from c where late)""",
}
