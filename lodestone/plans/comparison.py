"""Queries over vectors, rankings, snapshots, health, pages and journeys."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import rubric, snapshots, vectors
from ..runtime import table
from .evidence import E, FREQ, INTENSITY_CTE, _clusters, _e, _quotes

WALLS = ["sign in to continue", "log in to continue", "sign in to your account", "log in to your account", "please log in", "please sign in", "forgot your password", "you must be logged in", "login required", "create an account to continue", "subscribe to read", "subscribe to continue", "this content is for members", "members only", "enable javascript", "javascript is required", "javascript is disabled", "verify you are human", "verifying you are human", "checking your browser", "just a moment", "attention required", "access denied", "captcha", "unusual traffic"]


def _v(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding", "label")


def lexical_embed(spark, d):
    """Hashed words and trigrams of every record: how many buckets, their weight, and the heaviest one."""
    v = vectors.lexical_embedding(_e(spark, d), "row_id", F.col("body"))
    total = lambda f: F.aggregate("weights", F.lit(0.0), lambda s, x: s + f(x))
    # Buckets ascend, so the first of the heaviest is the smallest.
    first = F.element_at(F.col("buckets"), F.array_position(F.transform("weights", lambda x: F.round(x, 4)), F.round(F.array_max("weights"), 4)).cast("int"))
    return v.filter(F.size("buckets") > 0).select("row_id", F.size("buckets").cast("bigint").alias("buckets"), F.round(total(lambda x: x), 4).alias("weight"), F.round(total(lambda x: x * x), 4).alias("squares"), first.alias("heaviest"))


def centroid(spark, d):
    c = vectors.centroids(_v(spark, d), "label")
    return c.select("label", "n", F.posexplode("centroid").alias("pos", "x")).select("label", "n", "pos", F.round("x", 6).alias("x"))


def medoid(spark, d):
    return vectors.medoids(_v(spark, d), "label", "vec_id")


def centroid_p90_gate(spark, d):
    return vectors.centroid_gate(_v(spark, d), "label", "vec_id")


def nearest_neighbours(spark, d):
    """The three nearest vectors of every vector whose id is divisible by 50."""
    v = _v(spark, d)
    return vectors.searched(v, v.filter("vec_id % 50 = 0"), "vec_id", 3).select("query", "vec_id", "rank", "distance")


def distance_percentiles(spark, d):
    """Percentiles of the distance from the queries to all other vectors, per query."""
    v = _v(spark, d)
    d = vectors.query_distances(v, v.filter("vec_id % 50 = 0"), "vec_id")
    p = d.groupBy("query").agg(F.percentile("distance", F.array(F.lit(0.01), F.lit(0.35), F.lit(0.5), F.lit(0.75))).alias("p"))
    return p.select("query", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p1", "p35", "p50", "p75"))])


def _label_centroids(spark, d, half):
    return vectors.centroids(_v(spark, d).filter(F.col("vec_id") % 2 == half), "label")


def mutual_nn_match(spark, d):
    """Labels of the even and the odd vectors matched by their centroids."""
    return snapshots.mutual_matches(_label_centroids(spark, d, 0), _label_centroids(spark, d, 1), "label", 1.5)


def agglomerative_labels(spark, d):
    """Average linkage over the centroids of vectors grouped by label and id."""
    v = _v(spark, d).withColumn("pool", F.concat_ws("-", "label", F.col("vec_id") % 40))
    return vectors.linkage_labels(vectors.centroids(v, "pool"), "pool", 0.62)


def _cards(spark, d):
    f = rubric.frequency_read(_clusters(spark, d))
    return f.join(rubric.intensity(_quotes(spark, d)), "query", "left").withColumn("score", F.coalesce("score", F.lit(1)))


def contract_sort(spark, d):
    """Clusters by score, then by size, then by name: keys side by side, no blended score."""
    c = _cards(spark, d)
    order = [F.desc("score"), F.desc("member_count"), F.asc("query")]
    # One row per cluster: the ranking is over aggregated clusters.
    return c.withColumn("rank", F.row_number().over(W.orderBy(*order))).select("rank", "query", "score", "member_count", "read")


def analysis_cap(spark, d, top: int = 10):
    """The pool that is analysed further: three times ``top``, at least nine; the rest say their rank and the cap."""
    cap = max(3 * top, 9)
    c = contract_sort(spark, d)
    return c.select("query", "rank", (F.col("rank") <= cap).alias("analysed"), F.when(F.col("rank") > cap, F.lit(cap)).alias("cap"), F.floor((F.col("rank") - 1) / 4).alias("batch"))


def _snapshot(spark, d, late):
    e = _e(spark, d).filter("query is not null")
    mid = 1719792000
    return e.filter((F.col("created_utc") >= mid) if late else (F.col("created_utc") < mid)).groupBy("query").agg(
        F.count(F.lit(1)).alias("members"), F.count_distinct("author").alias("authors"), F.count_distinct("community").alias("communities")
    )


def rescan_verdict(spark, d):
    return snapshots.verdicts(_snapshot(spark, d, False), _snapshot(spark, d, True), "query")


def _health(spark, d):
    return table(spark, d, "source_health").select("seq", "run_slug", F.lower(F.trim("source")).alias("source"), F.regexp_replace(F.lower(F.trim("status")), "[_ ]+", "-").alias("status"), "logged_at", "received_at")


def health_compare(spark, d):
    return snapshots.health_changes(_health(spark, d))


def health_by_status(spark, d):
    return _health(spark, d).groupBy(F.coalesce("status", F.lit("unset")).alias("status")).agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count(F.lit(1)).alias("n"))


def health_rollup(spark, d):
    """Entries per run and status with totals."""
    return _health(spark, d).rollup("run_slug", "status").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def page_status(spark, d):
    """Documents read as pages: walls, thin pages and sound ones, by length of prose."""
    p = table(spark, d, "documents").withColumn("prose", tx.prose_length(F.coalesce("text", F.lit(""))))
    wall = (F.col("prose") < 3000) & F.lower("text").rlike("|".join(WALLS))
    status = F.when(F.col("text").isNull(), "failed").when(F.coalesce(wall, F.lit(False)), "blocked").when(F.col("prose") < 400, "degraded").otherwise("ok")
    return p.select(F.lower(F.trim("source")).alias("host"), status.alias("status"), "prose").groupBy("host", "status").agg(F.count(F.lit(1)).alias("pages"), F.max("prose").alias("longest"))


def attribution_models(spark, d):
    """Credit of each event type for a user's last event, by first, last, linear, decaying and position models."""
    ev = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    whole = W.partitionBy("user_id")
    j = ev.withColumn("i", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("end", F.max("ts").over(whole))
    days = (F.unix_micros("end") - F.unix_micros("ts")) / 86_400_000_000.0
    j = j.withColumn("decay", F.pow(F.lit(0.5), days / 7)).withColumn("all_decay", F.sum("decay").over(whole))
    position = F.when(F.col("n") == 1, 1.0).when(F.col("n") == 2, 0.5).when((F.col("i") == 1) | (F.col("i") == F.col("n")), 0.4).otherwise(0.2 / (F.col("n") - 2))
    return j.groupBy("event_type").agg(
        F.count_if(F.col("i") == 1).alias("first"), F.count_if(F.col("i") == F.col("n")).alias("last"), F.round(F.sum(1.0 / F.col("n")), 4).alias("linear"),
        F.round(F.sum(F.col("decay") / F.col("all_decay")), 4).alias("decaying"), F.round(F.sum(position), 4).alias("position"),
    )


def widest_share(spark, d):
    """Whether one cluster has fused what should be several: its share of all members."""
    c = _clusters(spark, d)
    r = c.agg(F.max("member_count").alias("widest"), F.sum("member_count").alias("members"), F.count(F.lit(1)).alias("clusters"))
    share = F.round(F.col("widest") / F.col("members"), 3)
    return r.withColumn("share", share).withColumn("fused", F.col("share") > 0.35).withColumn("enough", F.col("clusters") >= 6)


def member_changes(spark, d):
    """Authors of each query that are in the later half only, with the number of their rows."""
    e = _e(spark, d).filter("query is not null and author is not null").withColumn("late", F.col("created_utc") >= 1719792000)
    old, new = (e.filter(x).select("query", "author") for x in (~F.col("late"), F.col("late")))
    added = new.join(old.distinct(), ["query", "author"], "left_anti")
    return added.groupBy("query").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("author").alias("authors"))


_NAMES = "lexical_embed centroid medoid centroid_p90_gate nearest_neighbours distance_percentiles mutual_nn_match agglomerative_labels contract_sort analysis_cap rescan_verdict health_compare health_by_status health_rollup page_status attribution_models widest_share member_changes".split()
QUERIES = {name: globals()[name] for name in _NAMES}

_X = "v as (select vec_id, label, embedding::double[] as e from embeddings)"
_T = f"{_X}, x as (select vec_id, label, unnest(e) as x, unnest(range(64)) as pos from v), t as (select label, pos, sum(x) as s, count(*) as n from x group by 1, 2), c as (select label, max(n) as n, list(s order by pos) as total from t group by 1), cc as (select *, list_transform(total, lambda x: x / sqrt(list_inner_product(total, total))) as centroid from c)"
CARDS = f"{FREQ}, {INTENSITY_CTE}, cards as (select freq.*, coalesce(score, 1) as score from freq left join intensity using (query)), ranked as (select *, row_number() over (order by score desc, member_count desc, query) as rank from cards)"
_HEALTH = "h as (select seq, run_slug, lower(trim(source)) as source, regexp_replace(lower(trim(status)), '[_ ]+', '-', 'g') as status, logged_at from source_health)"
_SQUEEZED = "trim(regexp_replace({c}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"
_PROSE = "length(" + _SQUEEZED.format(c="regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '!?\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), 'https?://[^ \\n\\t\\r]+', '', 'g'), '<[^>]*>', '', 'g'), '[#*_`>|=~-]+', '', 'g')") + ")"
ORACLES = {
    "lexical_embed": f"""with {E}, w as (select row_id, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) as w from e),
      g as (select row_id, unnest(list_transform(range(1, greatest(length(body) - 2, 1) + 1), lambda i: substr(lower(body), i, 3))) as g from e),
      t as (select row_id, 'w:' || w as t, 1.6 as wt from w union all select row_id, 't:' || g, 1.0 from g),
      b as (select row_id, ('0x' || right(md5(t), 3))::int % 512 as bucket, sum(wt::double) as weight from t group by 1, 2)
      select row_id, count(*) as buckets, round(sum(weight), 4) as weight, round(sum(weight * weight), 4) as squares, -(max(row(round(weight, 4), -bucket))[2]) as heaviest from b group by 1""",
    "centroid": f"with {_T} select label, n, unnest(range(64)) as pos, round(unnest(centroid), 6) as x from cc",
    "medoid": f"""with {_T}, d as (select v.label, vec_id, n, round(n - list_inner_product(e, total), 6) as spread from v join c using (label)),
      r as (select *, row_number() over (partition by label order by spread, vec_id) as rk from d) select label, n, vec_id, spread from r where rk = 1""",
    "centroid_p90_gate": f"""with {_T}, d as (select v.label, vec_id, round(greatest(0, 1 - list_inner_product(e, centroid)), 3) as distance from v join cc using (label)),
      p as (select label, round(quantile_cont(distance, 0.9), 3) as p90 from d group by 1) select label, vec_id, distance, p90, distance <= p90 as inside from d join p using (label)""",
    "nearest_neighbours": f"""with {_X}, d as (select q.vec_id as query, v.vec_id, round(greatest(0, 1 - list_inner_product(q.e, v.e)), 6) as distance from v q join v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0),
      r as (select *, row_number() over (partition by query order by distance, vec_id) as rank from d) select query, vec_id, rank, distance from r where rank <= 3""",
    "distance_percentiles": f"""with {_X}, d as (select q.vec_id as query, greatest(0, 1 - list_inner_product(q.e, v.e)) as d from v q join v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0)
      select query, round(quantile_cont(d, 0.01), 6) as p1, round(quantile_cont(d, 0.35), 6) as p35, round(quantile_cont(d, 0.5), 6) as p50, round(quantile_cont(d, 0.75), 6) as p75 from d group by 1""",
    "mutual_nn_match": f"""with {_X}, x as (select vec_id % 2 as half, label, unnest(e) as x, unnest(range(64)) as pos from v), t as (select half, label, pos, sum(x) as s from x group by 1, 2, 3),
      c as (select half, label, list(s order by pos) as t from t group by 1, 2), u as (select half, label, list_transform(t, lambda x: x / sqrt(list_inner_product(t, t))) as u from c),
      d as (select a.label as old, b.label as new, round(greatest(0, 1 - list_inner_product(a.u, b.u)), 6) as distance from u a join u b on a.half = 0 and b.half = 1),
      r as (select *, row_number() over (partition by old order by distance, new) as f, row_number() over (partition by new order by distance, old) as b, count(*) filter (distance <= 1.5) over (partition by old) as within from d)
      select old, new, distance, distance > 1.125 as loose, within > 1 as split from r where f = 1 and b = 1 and distance <= 1.5""",
    "contract_sort": f"with {CARDS} select rank, query, score, member_count, read from ranked",
    "analysis_cap": f"with {CARDS} select query, rank, rank <= 30 as analysed, case when rank > 30 then 30 end as cap, floor((rank - 1) / 4)::bigint as batch from ranked",
    "rescan_verdict": f"""with {E}, s as (select query, created_utc >= 1719792000 as late, count(*) as members, count(distinct author) as authors, count(distinct community) as communities from e where query is not null and created_utc is not null group by 1, 2),
      j as (select coalesce(o.query, n.query) as query, o.members as old_members, n.members as members, n.members - o.members as dm, n.authors - o.authors as da, n.communities - o.communities as dc, greatest(2.0, 0.1 * o.members) as fl
        from (select * from s where not late) o full outer join (select * from s where late) n on o.query = n.query)
      select query, old_members, members, dm, da, dc, case when dm > 0 then round(da / dm, 2) end as author_share, case when old_members is null then 'new' when members is null then 'vanished'
        when dm > fl and da > 0 and dc >= 0 and da / dm >= 0.4 then 'grew-broadly' when dm > fl then 'grew-narrowly' when dm < -fl then 'shrank' else 'flat' end as verdict from j""",
    "health_compare": f"""with {_HEALTH}, r as (select source, arg_min_null(status, row(logged_at, seq)) as first_status, arg_max_null(status, row(logged_at, seq)) as last_status, count(*) as entries, count(*) filter (status is null or status <> 'ok') as not_ok from h group by 1)
      select *, first_status = 'ok' and last_status <> 'ok' as degraded from r""",
    "health_by_status": f"with {_HEALTH} select coalesce(status, 'unset') as status, string_agg(distinct source, ',' order by source) as sources, count(*) as n from h group by 1",
    "health_rollup": f"with {_HEALTH} select run_slug, status, count(*) as n, grouping_id(run_slug, status) as level from h group by rollup (run_slug, status)",
    "page_status": f"""with p as (select *, {_PROSE} as prose from documents),
      s as (select lower(trim(source)) as host, prose, case when text is null then 'failed' when prose < 3000 and regexp_matches(lower(text), '{"|".join(WALLS)}') then 'blocked' when prose < 400 then 'degraded' else 'ok' end as status from p)
      select host, status, count(*) as pages, max(prose) as longest from s group by 1, 2""",
    "attribution_models": """with j as (select *, row_number() over (partition by user_id order by ts, event_id) as i, count(*) over (partition by user_id) as n, max(ts) over (partition by user_id) as fin from events),
      k as (select *, pow(0.5, (epoch_us(fin) - epoch_us(ts)) / 86400000000.0 / 7) as decay from j), m as (select *, sum(decay) over (partition by user_id) as alld from k)
      select event_type, count(*) filter (i = 1) as first, count(*) filter (i = n) as last, round(sum(1.0::double / n), 4) as linear, round(sum(decay / alld), 4) as decaying,
        round(sum(case when n = 1 then 1.0::double when n = 2 then 0.5 when i = 1 or i = n then 0.4 else 0.2::double / (n - 2) end), 4) as position from m group by 1""",
    "widest_share": f"with {FREQ}, r as (select max(member_count) as widest, sum(member_count)::bigint as members, count(*) as clusters from panel) select *, round(widest / members, 3) as share, round(widest / members, 3) > 0.35 as fused, clusters >= 6 as enough from r",
    "member_changes": f"""with {E}, a as (select query, author, created_utc >= 1719792000 as late from e where query is not null and author is not null),
      n as (select * from a where late and not exists (select 1 from a b where b.query = a.query and b.author = a.author and not b.late)) select query, count(*) as rows, count(distinct author) as authors from n group by 1""",
}
