"""Queries over two runs, windows of the calendar, saturation and journeys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import snapshots, trends
from ..operators import series as ts
from ..runtime import table
from .comparison import _health, _label_centroids, _snapshot
from .evidence import E
from .series import S, SHAPES, _s

MID, NOW = 1_719_792_000, 1_750_000_000


def _run_health(spark, d, late: bool):
    """The last status that each source logged in the earlier or later half of the log."""
    h = _health(spark, d).filter("status is not null")
    half = h.filter((F.col("seq") % 2 == 1) if late else (F.col("seq") % 2 == 0))
    return half.groupBy("source").agg(F.max_by("status", "seq").alias("status"))


def run_health(spark, d):
    """Health of two runs, source by source, and whether a loss of it forbids negative readings."""
    return snapshots.health_of_runs(_run_health(spark, d, False), _run_health(spark, d, True))


def guarded_verdicts(spark, d):
    """Growth and loss of every cluster between two runs, with negative readings withheld where a source got worse, and the shares of both."""
    old, new = _snapshot(spark, d, False), _snapshot(spark, d, True)
    health = snapshots.health_of_runs(_run_health(spark, d, False), _run_health(spark, d, True))
    # One row: whether any source got worse, and the sizes of both runs.
    worse = health.agg(F.coalesce(F.max("poisons"), F.lit(False)).alias("poisoned"))
    sizes = old.agg(F.sum("members").alias("all_old")).crossJoin(F.broadcast(new.agg(F.sum("members").alias("all_new"))))
    plain = snapshots.verdicts(old, new, "query")
    j = plain.crossJoin(F.broadcast(worse)).crossJoin(F.broadcast(sizes))
    verdict = F.when(F.col("poisoned") & F.col("verdict").isin("shrank", "vanished"), "unresolved").otherwise(F.col("verdict"))
    return j.select("query", "dm", "da", verdict.alias("verdict"), F.round(F.col("old_members") / F.col("all_old"), 4).alias("old_share"), F.round(F.col("members") / F.col("all_new"), 4).alias("share"))


def rescan_order(spark, d):
    """Clusters in the order of a report: largest change in authors first."""
    from pyspark.sql import Window as W

    v = guarded_verdicts(spark, d).filter("da is not null")
    return v.withColumn("place", F.row_number().over(W.orderBy(F.abs("da").desc(), "query")).cast("bigint")).select("place", "query", "da", "verdict")


def corpus_shrink(spark, d):
    """Whether the later run captured over a quarter less than the earlier one, by source."""
    e = table(spark, d, "evidence_sample").filter("created_utc is not null").select(F.lower(F.trim("source")).alias("source"), (F.col("created_utc") >= MID).alias("late"))
    r = e.groupBy("source").agg(F.count_if(~F.col("late")).alias("old"), F.count_if("late").alias("new"))
    return r.withColumn("shrunk", F.col("new") < 0.75 * F.col("old"))


def unmatched_clusters(spark, d):
    return snapshots.unmatched(_label_centroids(spark, d, 0), _label_centroids(spark, d, 1), "label", 0.95)


def splits_and_merges(spark, d):
    return snapshots.splits_and_merges(_label_centroids(spark, d, 0), _label_centroids(spark, d, 1), "label", 0.95)


def slope_changes(spark, d):
    """Two readings of every series, without and with its last periods: what may be called a change."""
    s = _s(spark, d)
    old, new = ts.canonical_shapes(s.filter(F.col("start_utc") < 1_735_000_000)), ts.canonical_shapes(s)
    o = old.select("query", "source", F.col("slope_pct").alias("old_slope"), F.col("shape").alias("old_shape"))
    j = o.join(new.select("query", "source", F.col("slope_pct").alias("slope"), "shape"), ["query", "source"])
    bucket = F.when(F.col("source") == "reddit", 365).otherwise(183)
    return j.select("query", "source", "old_slope", "slope", snapshots.slope_change(F.col("old_slope"), F.col("slope"), F.col("old_shape"), F.col("shape"), F.lit(200), bucket).alias("change"))


def half_year_windows(spark, d):
    """Half-years of four years up to now, and the posts in each; the one in progress is marked and has no final count."""
    w = trends.bucket_windows(spark, NOW, 4, 6, "H")
    return _counted(spark, d, w)


def year_windows(spark, d):
    """Years and the year to date, with their posts."""
    return _counted(spark, d, trends.bucket_windows(spark, NOW, 5, 12, "Y"))


def quarter_windows(spark, d):
    return _counted(spark, d, trends.bucket_windows(spark, NOW, 2, 3, "Q"))


def _counted(spark, d, w):
    e = table(spark, d, "evidence_sample").filter("created_utc is not null").select("created_utc")
    # A few dozen windows at most.
    n = e.join(F.broadcast(w.select("period", "start_utc", "end_utc")), (F.col("created_utc") >= F.col("start_utc")) & (F.col("created_utc") < F.col("end_utc"))).groupBy("period").agg(F.count(F.lit(1)).alias("n"))
    j = w.join(n, "period", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.select("period", "start_utc", "end_utc", "partial", F.when(~F.col("partial"), F.col("n")).alias("posts"), F.when(F.col("partial"), F.col("n")).alias("posts_so_far"))


def measurement_guard(spark, d):
    """Series that have no shape at all, and why."""
    s = _s(spark, d).filter("hits is not null and not partial")
    a = s.groupBy("query", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("hits").alias("total"), F.max("hits").alias("top"))
    return a.withColumn("failure", trends.measurement_failure(F.col("n"), F.col("total"), F.col("top")))


def supply_vocabulary(spark, d):
    """Supply curves in the words of cards."""
    s = ts.supply_shapes(_s(spark, d))
    return s.groupBy(F.col("shape").alias("supply"), trends.card_shape(F.col("shape")).alias("card")).agg(F.count(F.lit(1)).alias("n"))


def undersampled(spark, d):
    """Coverage of series of packages, capped where few were examined or look-ups failed."""
    s = ts.supply_shapes(_s(spark, d)).filter("source = 'npm'")
    k = F.length("query") % 5
    j = s.select("query", "coverage", (15 - k).cast("bigint").alias("examined"), (12 + 2 * k).cast("bigint").alias("matches"), (2 * k).cast("bigint").alias("failed"))
    return j.withColumn("capped", trends.capped_coverage(F.col("coverage"), F.col("examined"), F.col("matches"), F.col("failed")))


def saturation_reads(spark, d):
    """How crowded the field of every query is: sources and communities of its rows stand for competitors."""
    e = table(spark, d, "evidence_sample").filter("query is not null").select(F.lower(F.trim("query")).alias("query"), F.lower(F.trim("source")).alias("source"), F.lower(F.trim("community")).alias("community"), F.lower("title").contains("software").alias("on"))
    g = e.groupBy("query").agg(F.count_distinct("community").alias("surfaced"), F.count_distinct(F.when(F.col("on"), F.col("community"))).alias("on_domain"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("community").isNull(), F.col("source")))), ", ").alias("gaps"))
    read = trends.saturation_read(F.col("on_domain"), F.col("surfaced"), F.col("surfaced") > 0, F.col("gaps"))
    count = F.when((F.col("surfaced") > 0) & (F.col("gaps") == ""), F.col("on_domain"))
    return g.select("query", "surfaced", "on_domain", count.alias("count"), read.alias("read"))


def cell_of_cluster(spark, d):
    """The framing of each query's heaviest cell, its cells being those of its rows."""
    e = table(spark, d, "evidence_sample").filter("query is not null and cell_id is not null").select(F.lower(F.trim("query")).alias("query"), F.lower(F.trim("cell_id")).alias("cell"))
    cells = e.groupBy("query").agg(F.collect_set("cell").alias("cells"))
    m = e.groupBy("cell").agg(F.count(F.lit(1)).alias("members"))
    values = table(spark, d, "matrix").select(F.col("cell_id").alias("cell"), "vertical").join(m, "cell")
    return trends.best_cell(cells, "query", "cells", values, "cell", "members", "vertical")


def last_non_direct(spark, d):
    """Journeys credited to the last event that is no plain view."""
    ev = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return trends.last_but(ev, "user_id", ["ts", "event_id"], "event_type", "view").groupBy("event_type").agg(F.count(F.lit(1)).alias("users"))


def shapley_credit(spark, d):
    """Each event type's fair share in the journeys that it takes part in."""
    ev = table(spark, d, "events").select("user_id", "event_type", F.floor(F.unix_timestamp("ts") / 86400).alias("day")).distinct()
    j = ev.groupBy("user_id", "day").agg(F.array_sort(F.collect_set("event_type")).alias("channels")).groupBy("channels").agg(F.count(F.lit(1)).alias("n"))
    types = sorted(r[0] for r in ev.select("event_type").distinct().limit(12).collect())
    return trends.shapley(j, types) if types else j.select(F.lit("").alias("channel"), F.lit(0.0).alias("credit")).limit(0)


def oldest_seen(spark, d):
    """Pages of every source read backwards in time, the cursor after each, and whether more can follow."""
    e = table(spark, d, "evidence_sample").select("row_id", F.lower(F.trim("source")).alias("source"), "created_utc")
    return trends.running_oldest(e, "source", "created_utc", 100)


def momentum(spark, d):
    """Posts of each source in its last 90 days, and how old the newest is at the end of all."""
    e = table(spark, d, "evidence_sample").filter("created_utc is not null").select(F.lower(F.trim("source")).alias("source"), "created_utc")
    end = e.agg(F.max("created_utc").alias("finish"))
    j = e.crossJoin(F.broadcast(end))
    return j.groupBy("source").agg(F.count_if(F.col("created_utc") >= F.col("finish") - 90 * 86400).alias("recent"), F.floor((F.max("finish") - F.max("created_utc")) / 86400).alias("newest_days"))


_NAMES = "run_health guarded_verdicts rescan_order corpus_shrink unmatched_clusters splits_and_merges slope_changes half_year_windows year_windows quarter_windows measurement_guard supply_vocabulary undersampled saturation_reads cell_of_cluster last_non_direct shapley_credit oldest_seen momentum".split()
QUERIES = {name: globals()[name] for name in _NAMES}

_H = "h as (select seq, lower(trim(source)) as source, regexp_replace(lower(trim(status)), '[_ ]+', '-', 'g') as status from source_health where status is not null)"
_RUNS = f"""{_H}, ho as (select source, arg_max(status, seq) as old_status from h where seq % 2 = 0 group by 1), hn as (select source, arg_max(status, seq) as new_status from h where seq % 2 = 1 group by 1),
  rh as (select coalesce(ho.source, hn.source) as source, old_status, new_status, coalesce(old_status = 'ok' and coalesce(new_status, 'missing') <> 'ok', false) as poisons from ho full outer join hn on ho.source = hn.source)"""
_VERDICTS = f"""{E}, {_RUNS}, s as (select query, created_utc >= {MID} as late, count(*) as members, count(distinct author) as authors, count(distinct community) as communities from e where query is not null and created_utc is not null group by 1, 2),
  j as (select coalesce(o.query, n.query) as query, o.members as old_members, n.members as members, n.members - o.members as dm, n.authors - o.authors as da, n.communities - o.communities as dc, greatest(2.0, 0.1 * o.members) as fl
    from (select * from s where not late) o full outer join (select * from s where late) n on o.query = n.query),
  t as (select (select coalesce(bool_or(poisons), false) from rh) as p, (select sum(members) from s where not late) as ao, (select sum(members) from s where late) as an),
  gv as (select query, dm, da, case when old_members is null then 'new' when members is null then case when p then 'unresolved' else 'vanished' end when dm > fl and da > 0 and dc >= 0 and da / dm >= 0.4 then 'grew-broadly' when dm > fl then 'grew-narrowly'
    when dm < -fl then case when p then 'unresolved' else 'shrank' end else 'flat' end as verdict, round(old_members / ao, 4) as old_share, round(members / an, 4) as share from j, t)"""
_CENT = """v as (select vec_id, label, embedding::double[] as e from embeddings), x as (select vec_id % 2 as half, label, unnest(e) as x, unnest(range(64)) as pos from v), t as (select half, label, pos, sum(x) as s from x group by 1, 2, 3),
  c as (select half, label, list(s order by pos) as t from t group by 1, 2), u as (select half, label, list_transform(t, lambda x: x / sqrt(list_inner_product(t, t))) as u from c),
  d as (select a.label as old, b.label as new, round(greatest(0, 1 - list_inner_product(a.u, b.u)), 6) as distance from u a join u b on a.half = 0 and b.half = 1)"""


def _windows(years: int, months: int, label: str) -> str:
    n = years * 12 // months
    name = {"H": "year(s) || '-H' || case when month(s) <= 6 then 1 else 2 end", "Q": "year(s) || '-Q' || quarter(s)", "Y": "year(s)::varchar"}[label]
    return f"""with b as (select make_date(year(to_timestamp({NOW}) at time zone 'UTC'), month(to_timestamp({NOW}) at time zone 'UTC') - (month(to_timestamp({NOW}) at time zone 'UTC') - 1) % {months}, 1) as f),
      w as (select (f - to_months(k::int * {months})) as s, (f + to_months((1 - k)::int * {months})) as e, k = 0 as partial from b, range({n + 1}) r(k)),
      n as (select {name} as period, epoch(s)::bigint as start_utc, epoch(e)::bigint as end_utc, partial from w),
      c as (select n.*, (select count(*) from evidence_sample where created_utc >= start_utc and created_utc < end_utc) as c from n)
      select period, start_utc, end_utc, partial, case when not partial then c end as posts, case when partial then c end as posts_so_far from c"""


ORACLES = {
    "run_health": f"with {_RUNS} select * from rh",
    "guarded_verdicts": f"with {_VERDICTS} select * from gv",
    "rescan_order": f"with {_VERDICTS} select row_number() over (order by abs(da) desc, query) as place, query, da, verdict from gv where da is not null",
    "corpus_shrink": f"with r as (select lower(trim(source)) as source, count(*) filter (created_utc < {MID}) as old, count(*) filter (created_utc >= {MID}) as new from evidence_sample where created_utc is not null group by 1) select *, new < 0.75 * old as shrunk from r",
    "unmatched_clusters": f"""with {_CENT}, r as (select *, row_number() over (partition by old order by distance, new) as f, row_number() over (partition by new order by distance, old) as b from d),
      m as (select old, new from r where f = 1 and b = 1 and distance <= 0.95)
      select 'vanished' as side, old as label, new as nearest, distance from r where f = 1 and old not in (select old from m) union all select 'new', new, old, distance from r where b = 1 and new not in (select new from m)""",
    "splits_and_merges": f"""with {_CENT}, n as (select old, new from d where distance <= 0.95)
      select old as label, count(*) as n, string_agg(new, ',' order by new) as partners, 'split' as kind from n group by 1 having count(*) > 1 union all select new, count(*), string_agg(old, ',' order by old), 'merged' from n group by 1 having count(*) > 1""",
    "half_year_windows": _windows(4, 6, "H"),
    "year_windows": _windows(5, 12, "Y"),
    "quarter_windows": _windows(2, 3, "Q"),
    "measurement_guard": f"""with {S}, a as (select query, source, count(*) as n, sum(hits)::bigint as total, max(hits) as top from s where hits is not null and not partial group by 1, 2)
      select *, case when n < 3 then 'fewer than three periods' when total < 10 then 'fewer than ten in all' when top <= 2 then 'never above two' end as failure from a""",
    "slope_changes": f"""with new_s as (with {SHAPES} select query, source, slope_pct, shape from shapes), old_s as (with {SHAPES.replace('from trend_series', 'from (select * from trend_series where start_utc < 1735000000)')} select query, source, slope_pct, shape from shapes)
      select query, source, o.slope_pct as old_slope, n.slope_pct as slope, coalesce(case when o.shape is distinct from n.shape then case when 200 >= case when source = 'reddit' then 365 else 183 end then 'shape changed' else 'shape flip within a bucket' end end,
        case when o.slope_pct is null or n.slope_pct is null then 'not measured' when abs(n.slope_pct - o.slope_pct) <= 15 then 'noise' when n.slope_pct > o.slope_pct then 'steeper' else 'less steep' end) as change from old_s o join new_s n using (query, source)""",
    "saturation_reads": """with e as (select lower(trim(query)) as query, lower(trim(source)) as source, lower(trim(community)) as community, contains(lower(title), 'software') as on_it from evidence_sample where query is not null),
      g as (select query, count(distinct community) as surfaced, count(distinct community) filter (on_it) as on_domain, coalesce(string_agg(distinct source, ', ' order by source) filter (community is null), '') as gaps from e group by 1)
      select query, surfaced, on_domain, case when surfaced > 0 and gaps = '' then on_domain end as count,
        case when surfaced = 0 then 'unknown: no source answered' || case when gaps <> '' then ' (' || gaps || ')' else '' end else
        case when on_domain = 0 and surfaced > 0 then 'unknown: ' || surfaced || ' surfaced, none on the subject' when on_domain = 0 then 'none surfaced' when on_domain <= 2 then 'sparsely populated' when on_domain <= 6 then 'moderately saturated' else 'heavily saturated' end
        || case when on_domain > 0 and surfaced > on_domain then ' (' || (surfaced - on_domain) || ' off the subject)' else '' end || case when gaps <> '' then '; a floor, incomplete: ' || gaps else '' end end as read from g""",
    "cell_of_cluster": """with e as (select lower(trim(query)) as query, lower(trim(cell_id)) as cell from evidence_sample where query is not null and cell_id is not null), m as (select cell, count(*) as members from e group by 1),
      v as (select cell_id as cell, vertical, members from matrix join m on cell_id = cell), x as (select distinct query, cell from e)
      select query, arg_max(vertical, row(members, cell)) as vertical, count(vertical) as known_cells from x left join v using (cell) group by 1""",
    "last_non_direct": "with l as (select user_id, arg_max(event_type, row((event_type <> 'view')::int, ts, event_id)) as event_type from events group by 1) select event_type, count(*) as users from l group by 1",
    "shapley_credit": """with j as (select user_id, epoch(ts)::bigint // 86400 as day, list_sort(list_distinct(list(event_type))) as s from events group by 1, 2), k as (select s, len(s) as m from j)
      select channel, round(sum(1.0::double / m), 4) as credit from (select unnest(s) as channel, m from k) group by 1""",
    "oldest_seen": """with r as (select lower(trim(source)) as source, created_utc, (row_number() over (partition by lower(trim(source)) order by created_utc desc, row_id) - 1) // 100 as page from evidence_sample where created_utc is not null),
      p as (select source, page, count(*) as n, min(created_utc) as oldest from r group by 1, 2) select *, min(oldest) over (partition by source order by page) as oldest_seen, n = 100 as more from p""",
    "momentum": """with e as (select lower(trim(source)) as source, created_utc, max(created_utc) over () as finish from evidence_sample where created_utc is not null)
      select source, count(*) filter (created_utc >= finish - 90 * 86400) as recent, (max(finish) - max(created_utc)) // 86400 as newest_days from e group by 1""",
}
from .series import ORACLES as _SERIES  # noqa: E402

ORACLES["supply_vocabulary"] = f"""with t as ({_SERIES['supply_shape']}) select shape as supply, case shape when 'rising' then 'accelerating' when 'spike-and-fade' then 'spiky-episodic' when 'emerging' then 'emerging' when 'declining' then 'declining'
  when 'persistent-flat' then 'persistent-flat' end as card, count(*) as n from t group by 1, 2"""
ORACLES["undersampled"] = f"""with t as ({_SERIES['supply_shape']}), k as (select query, coverage, 15 - length(query) % 5 as examined, 12 + 2 * (length(query) % 5) as matches, 2 * (length(query) % 5) as failed from t where source = 'npm')
  select *, case when coverage = 'good' and (matches > examined or failed / examined > 0.3) then 'thin' else coverage end as capped from k"""
