"""Queries over measured series and over evidence counted into periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import half_year
from ..operators import series as ts
from ..runtime import table


def _s(spark, d):
    return ts.cleaned(table(spark, d, "trend_series"))


def slope_shape_canonical(spark, d):
    return ts.canonical_shapes(_s(spark, d))


def supply_shape(spark, d):
    return ts.supply_shapes(_s(spark, d))


def censored_series(spark, d):
    return ts.censored(_s(spark, d))


def combined_series(spark, d):
    return ts.combined(_s(spark, d))


def sparklines(spark, d):
    return ts.sparkline(_s(spark, d))


def headline_series(spark, d):
    return ts.headline(ts.canonical_shapes(_s(spark, d)))


def series_health(spark, d):
    """Per source how many periods were asked, measured, partial, and the status that follows."""
    s = _s(spark, d)
    r = s.groupBy("source").agg(F.count(F.lit(1)).alias("asked"), F.count("hits").alias("measured"), F.count_if("partial").alias("partial"))
    return r.withColumn("status", F.when(F.col("measured") == 0, "unavailable").when(F.col("measured") < F.col("asked"), "degraded").otherwise("ok"))


def halfyear_series(spark, d):
    """Posts per source and half-year on a dense grid: a missing half-year is a counted zero, not a gap."""
    e = table(spark, d, "evidence_sample").filter("created_utc is not null").select(F.lower(F.trim("source")).alias("source"), half_year(F.col("created_utc")).alias("period"))
    counts = e.groupBy("source", "period").agg(F.count(F.lit(1)).alias("n"))
    # A handful of sources and half-years: both sides of the grid come from the aggregated counts.
    grid = counts.select("source").distinct().crossJoin(F.broadcast(counts.select("period").distinct()))
    return grid.join(counts, ["source", "period"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def period_join(spark, d):
    """Posts that fall into the measured half-open periods of the series, by a range join on period labels."""
    w = _s(spark, d).select("period", "start_utc", "end_utc").groupBy("period").agg(F.min("start_utc").alias("start_utc"), F.max("end_utc").alias("end_utc"))
    e = table(spark, d, "evidence_sample").filter("created_utc is not null").select("row_id", "created_utc")
    # As many windows as there are distinct period labels.
    j = e.join(F.broadcast(w), (F.col("created_utc") >= F.col("start_utc")) & (F.col("created_utc") < F.col("end_utc")))
    return j.groupBy("period").agg(F.count(F.lit(1)).alias("posts"))


def index_points(spark, d):
    """Mean, peak, share of non-zero points, median and r-squared of each series over real time in years."""
    s = _s(spark, d).filter("hits is not null and not partial")
    first = s.groupBy("query", "source").agg(F.min("start_utc").alias("t0"))
    j = s.join(first, ["query", "source"]).withColumn("x", (F.col("start_utc") - F.col("t0")) / 31556952.0).withColumn("y", F.col("hits").cast("double"))
    r = j.groupBy("query", "source").agg(
        F.count(F.lit(1)).alias("points"), F.round(F.avg("y"), 4).alias("mean"), F.max("hits").alias("peak"), F.round(F.avg((F.col("hits") > 0).cast("double")), 4).alias("nonzero"),
        F.percentile("hits", F.lit(0.5)).alias("median"), F.round(F.regr_r2("y", "x"), 3).alias("r2"),
    )
    over = F.when((F.col("median") > 0) & (F.col("peak") / F.col("median") >= 4) & (F.coalesce("r2", F.lit(0.0)) < 0.3), "spiky-episodic")
    thin = F.when(F.col("points") < 8, "thin").when(F.col("nonzero") < 0.25, "thin").otherwise("good")
    return r.withColumn("override", over).withColumn("coverage", thin)


_NAMES = "slope_shape_canonical supply_shape censored_series combined_series sparklines headline_series series_health halfyear_series period_join index_points".split()
QUERIES = {name: globals()[name] for name in _NAMES}

S = """s as (select lower(trim(query)) as query, lower(trim(source)) as source, period, max(hits) as hits, min(start_utc) as start_utc, max(end_utc) as end_utc,
    coalesce(bool_or(is_partial), false) as partial, bool_or(is_censored) as censored from trend_series group by 1, 2, 3)"""
SHAPES = f"""{S}, u as (select *, row_number() over (partition by query, source order by start_utc, hits) - 1 as i from s where hits is not null and not partial),
  un as (select *, count(*) over (partition by query, source) as n from u),
  a as (select query, source, count(*) as n, sum(hits)::bigint as total, max(hits) as top, regr_slope(hits, i) as sl, avg(hits) as mean,
    coalesce(sum(hits) filter (i < n // 2), 0)::bigint as first, coalesce(sum(hits) filter (i >= n - n // 2), 0)::bigint as last, count(*) filter (hits = 0) as zeros from un group by 1, 2),
  g as (select query, source, count(*) as planned, count(*) filter (hits is null) as failed, sum(hits) as total_all,
    max(case when contains(period, 'H') then 2.0 when contains(period, 'Q') then 4.0 else 1.0 end) as py from s group by 1, 2),
  j as (select g.query, g.source, planned, failed, total_all, coalesce(n, 0) as n, total, top, first, last, zeros,
    case when n >= 2 and mean > 0 then round(sl * py / mean * 100, 1) end as slope_pct from g left join a using (query, source)),
  shapes as (select query, source, planned, n, total, slope_pct,
    case when n = 0 or total < 5 then null when n >= 4 and top / total > 0.5 then 'spiky-episodic' when slope_pct is null then 'persistent-flat'
      when n >= 2 and first / total <= 0.15 and slope_pct > 15 then 'emerging' when slope_pct >= 60 then 'accelerating' when slope_pct <= -20 then 'declining' else 'persistent-flat' end as shape,
    case when n = 0 then null when total_all <= 0 then case when failed / planned <= 0.25 then 'none' end when total_all < 20 or failed / planned > 0.25 then 'thin' else 'good' end as coverage,
    case when n >= 4 and first > 0 then round((last - first) / first * 100, 1) end as half_growth,
    case when total > 0 and zeros >= 0.3 * n then 'intermittent' end as note from j)"""
ORACLES = {
    "slope_shape_canonical": f"with {SHAPES} select * from shapes",
    "supply_shape": f"""with {S}, p as (select *, row_number() over (partition by query, source order by start_utc, hits) - 1 as x from s where not partial),
      u as (select *, row_number() over (partition by query, source order by x) - 1 as k, count(*) over (partition by query, source) as n from p where hits is not null),
      a as (select query, source, count(*) as n, sum(hits)::bigint as total, regr_slope(hits, x) as sl, coalesce(sum(hits) filter (k < n // 2), 0) as first, max(hits) as top, arg_max(hits, k) as last, arg_min(hits, k) as start, list(hits order by k) as y from u group by 1, 2),
      g as (select query, source, count(*) as planned from p group by 1, 2),
      j as (select g.query, g.source, planned, coalesce(n, 0) as n, total, first, top, last, start, list_position(y, top) - 1 as peak,
        case when coalesce(n, 0) < 3 then null when total = 0 then 0.0 else round(100 * sl / (total / n), 1) end as slope_pct from g left join a using (query, source))
      select query, source, n, total, slope_pct, case when n < 3 then 'insufficient-data' when total = 0 then 'no-signal' when first = 0 and total - first > 0 then 'emerging'
        when peak > 0 and peak < n - 1 and last <= 0.5 * top and start <= 0.8 * top then 'spike-and-fade' when slope_pct >= 15 then 'rising' when slope_pct <= -15 then 'declining' else 'persistent-flat' end as shape,
        case when n = 0 then 'none' when n < planned or n < 3 then 'thin' when total = 0 then 'good' when total < 10 then 'thin' else 'good' end as coverage from j""",
    "censored_series": f"""with {S}, r as (select query, source, count(*) filter (hits is not null and not partial) as usable, count(*) filter (hits is not null and not partial and censored) as floors, count(*) filter (censored is null) as unknown from s group by 1, 2)
      select *, case when usable < 2 then 'one period' when floors / usable > 0.5 then 'shape withheld' when floors > 0 then 'lower bound' else 'as counted' end as verdict from r""",
    "combined_series": f"with {S} select query, period, sum(hits)::bigint as hits, count(hits) as answered, count(*) as asked, case when count(hits) = count(*) then sum(hits)::bigint end as complete from s group by 1, 2",
    "sparklines": f"""with {S}, t as (select *, max(hits) over (partition by query, source) as top from s)
      select query, source, string_agg(case when hits is null then '?' when hits = 0 then '·' else substr('▁▂▃▄▅▆▇█', least(8, floor(hits * 8 / top)::int + 1), 1) end || case when censored then '+' else '' end, '' order by start_utc, hits nulls first) as line from t group by 1, 2""",
    "headline_series": f"""with {SHAPES}, r as (select *, case coverage when 'good' then 3 when 'thin' then 2 when 'none' then 1 else 0 end as rank from shapes),
      b as (select *, max(rank) over (partition by query) as best from r)
      select query, rank, count(*) as series, case when count(distinct shape) = 1 then max(shape) end as shape from b where rank = best group by 1, 2""",
    "series_health": f"with {S}, r as (select source, count(*) as asked, count(hits) as measured, count(*) filter (partial) as partial from s group by 1) select *, case when measured = 0 then 'unavailable' when measured < asked then 'degraded' else 'ok' end as status from r",
    "halfyear_series": """with e as (select lower(trim(source)) as source, year(to_timestamp(created_utc)) || case when month(to_timestamp(created_utc)) <= 6 then '-H1' else '-H2' end as period from evidence_sample where created_utc is not null),
      c as (select source, period, count(*) as n from e group by 1, 2)
      select source, period, coalesce(n, 0) as n from (select distinct source from c) cross join (select distinct period from c) left join c using (source, period)""",
    "period_join": f"""with {S}, w as (select period, min(start_utc) as start_utc, max(end_utc) as end_utc from s group by 1)
      select period, count(*) as posts from evidence_sample join w on created_utc >= w.start_utc and created_utc < w.end_utc group by 1""",
    "index_points": f"""with {S}, u as (select *, (start_utc - min(start_utc) over (partition by query, source)) / 31556952.0 as x from s where hits is not null and not partial),
      r as (select query, source, count(*) as points, round(avg(hits), 4) as mean, max(hits) as peak, round(avg((hits > 0)::int), 4) as nonzero, quantile_cont(hits, 0.5) as median, round(regr_r2(hits, x), 3) as r2, count(distinct hits) as vals from u group by 1, 2)
      select query, source, points, mean, peak, nonzero, median, case when points < 2 then null else r2 end as r2,
        case when median > 0 and peak / median >= 4 and coalesce(r2, 0) < 0.3 then 'spiky-episodic' end as override, case when points < 8 or nonzero < 0.25 then 'thin' else 'good' end as coverage from r""",
}
