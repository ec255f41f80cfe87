"""Queries that look things up and hold them against a frame: members, queries, names, distances, notes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import vectors
from ..operators.spine import source_of
from ..runtime import table
from .comparison import _health, _v
from .evidence import E, INTENSITY_CTE, MARKERS, STOP, _e, _quotes
from .series import S, _s

FALLBACK = ("dialog", "producthunt")


def cluster_evidence(spark, d):
    """Evidence of the records that vectors were made for, by exact id."""
    return _e(spark, d).join(_v(spark, d).select(F.col("vec_id").alias("row_id")), "row_id", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("url").alias("with_url"))


def member_index(spark, d):
    """The record that stands for each url of a query, closing slashes aside: the last one."""
    e = _e(spark, d).filter("query is not null and url is not null")
    return e.groupBy("query", F.regexp_replace("url", "/+$", "").alias("url")).agg(F.max("row_id").alias("row_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")


def dropped_queries(spark, d):
    """Rows of fallback sources that ignored their query: withheld, or kept without the query where that is allowed."""
    e = _e(spark, d).filter(F.col("source").isin(*FALLBACK) & F.col("query").isNotNull())
    hits = F.filter(tx.distinctive_terms(F.col("query"), STOP), lambda t: F.contains(F.lower("body"), t))
    e = e.withColumn("ignored", F.size(hits) == 0)
    return e.groupBy("source", F.when(~F.col("ignored"), F.col("query")).alias("query")).agg(F.count(F.lit(1)).alias("opted_in"), F.count_if(~F.col("ignored")).alias("by_default"))


def frame_gate(spark, d):
    """Whether the frame of every run holds: six to twelve cells, ids that differ, three to six queries each and nothing blank."""
    m = table(spark, d, "matrix")
    whole = F.size("queries").between(3, 6) & (F.coalesce(F.trim("persona"), F.lit("")) != "") & (F.coalesce(F.trim("vertical"), F.lit("")) != "") & (F.coalesce(F.trim("framing"), F.lit("")) != "")
    g = m.groupBy("run_slug").agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("cell_id").alias("ids"), F.min(F.coalesce(whole, F.lit(False))).alias("whole"))
    return g.withColumn("holds", F.col("cells").between(6, 12) & (F.col("ids") == F.col("cells")) & F.col("whole"))


def exemplar_check(spark, d):
    """Titles as exemplars: those that are too long, and those whose stated number of words is wrong."""
    e = _e(spark, d).filter("title is not null").withColumn("actual", tx.word_count(F.col("title"))).withColumn("stated", F.size(F.split("title", " ")))
    return e.groupBy("source").agg(F.count_if(F.col("actual") > 15).alias("too_long"), F.count_if(F.col("actual") != F.col("stated")).alias("miscounted"), F.count(F.lit(1)).alias("n"))


def source_summary(spark, d):
    """Sources by how their entries ended, each list in order."""
    h = _health(spark, d)
    kind = F.when(F.col("status") == "ok", "ok").when(F.col("status") == "degraded", "partial").when(F.col("status") == "searched-no-results", "empty").when(F.col("status").isin("unavailable", "stopped"), "unavailable")
    return h.withColumn("kind", kind).filter("kind is not null").groupBy("run_slug").pivot("kind", ["ok", "partial", "empty", "unavailable"]).agg(F.array_join(F.array_sort(F.collect_set("source")), ",")).na.fill("")


def request_status(spark, d):
    """What the entries of each source add up to: ok, degraded or unavailable."""
    h = _health(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").isin("ok", "searched-no-results")).alias("answered"), F.count_if(F.col("status").isNull()).alias("silent"))
    return h.withColumn("status", F.when(F.col("answered") == 0, "unavailable").when(F.col("answered") < F.col("n"), "degraded").otherwise("ok"))


def cited_share(spark, d):
    """The share of rows of each query that can be cited."""
    e = _e(spark, d).filter("query is not null")
    return e.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("url").isNotNull().cast("double")), 4).alias("cited"))


def _distances(spark, d):
    """Every vector with its distance to its own group's centroid and to that of all."""
    v = _v(spark, d)
    own = vectors.centroids(v, "label").select("label", F.col("centroid").alias("own"))
    # One row: the centroid of all vectors. The groups are a handful, each of one vector.
    whole = vectors.centroids(v.withColumn("all", F.lit(0)), "all").select(F.col("centroid").alias("whole"))
    j = v.join(own, "label").crossJoin(F.broadcast(whole))
    return j.select("vec_id", "label", F.round(vectors.cosine_distance(F.col("embedding"), F.col("own")), 6).alias("pain"), F.round(vectors.cosine_distance(F.col("embedding"), F.col("whole")), 6).alias("incumbent"))


def _wedges(spark, d):
    best = _distances(spark, d).groupBy("label").agg(F.min(F.struct("pain", "vec_id", "incumbent")).alias("m")).select("label", "m.vec_id", "m.pain", "m.incumbent")
    return best.withColumn("place", F.row_number().over(W.orderBy(F.desc("incumbent"), "label")).cast("bigint"))


def wedge_rank(spark, d):
    """One candidate a group, the nearest to its pain, farthest from the incumbents first."""
    return _wedges(spark, d).select("place", "label", "vec_id", "pain", "incumbent")


def wedge_slots(spark, d):
    """Up to seven candidates, no more than two of one kind."""
    kind = _wedges(spark, d).withColumn("who", F.col("vec_id") % 3)
    few = kind.withColumn("turn", F.row_number().over(W.partitionBy("who").orderBy("place"))).filter("turn <= 2")
    return few.withColumn("slot", F.row_number().over(W.orderBy("place")).cast("bigint")).filter("slot <= 7").select("slot", "label", "who")


def incumbent_distance(spark, d):
    """The distance of each group to its incumbents, unknown under two of them, and how new that makes it."""
    v = _v(spark, d)
    own = vectors.centroids(v, "label").select("label", F.col("centroid").alias("own"))
    inc = vectors.centroids(v.filter("vec_id % 20 = 0"), "label").select("label", F.col("n").alias("incumbents"), F.col("centroid").alias("theirs"))
    j = own.join(inc, "label", "left").withColumn("incumbents", F.coalesce("incumbents", F.lit(0)).cast("bigint"))
    far = F.when(F.col("incumbents") >= 2, F.round(vectors.cosine_distance(F.col("own"), F.col("theirs")), 4))
    return j.select("label", "incumbents", far.alias("distance"), F.when(far >= 0.6, "new").when(far >= 0.35, "near").when(far.isNotNull(), "same").alias("novelty"))


def shape_drift(spark, d):
    """Whether the last vector of a group has moved away from its centroid, compared with the first."""
    g = _distances(spark, d).groupBy("label").agg(F.min_by("pain", "vec_id").alias("first"), F.max_by("pain", "vec_id").alias("last"))
    return g.withColumn("drifted", F.col("last") > F.col("first"))


def competitor_seed(spark, d):
    """Every source that any list names, with the status its log gives; not attempted where it has none."""
    lists = [table(spark, d, t).select(source_of(F.col("source")).alias("name")) for t in ("evidence_sample", "source_health", "trend_series")]
    seed = lists[0].distinct().union(lists[1].distinct()).union(lists[2].distinct()).filter("name is not null").distinct()
    h = _health(spark, d).filter("status is not null").groupBy(source_of(F.col("source")).alias("name")).agg(F.max_by("status", "seq").alias("status"))
    return seed.join(h, "name", "left").select("name", F.coalesce("status", F.lit("not attempted")).alias("status"))


def printed_prices(spark, d):
    """Amounts in rows that occur word for word in a document of the same community."""
    rx = F.lit(r"([0-9]+ (?:dollars|euros))")
    said = _e(spark, d).select("row_id", F.col("community"), F.explode(F.array_distinct(F.regexp_extract_all("body", rx, F.lit(1)))).alias("price")).filter("community is not null")
    seen = table(spark, d, "documents").select("community", F.explode(F.regexp_extract_all("text", rx, F.lit(1))).alias("price")).distinct()
    return said.join(seen, ["community", "price"], "left_semi").groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("price").alias("prices"))


def capture_outcomes(spark, d):
    """Batches that found nothing, that failed, and that never said: three different things."""
    b = table(spark, d, "capture_batch").select(F.regexp_replace(F.lower(F.trim("status")), "[_ ]+", "-").alias("status"), "n_lines")
    outcome = F.when(F.col("n_lines") > 0, "rows").when(F.col("status").isin("unavailable", "failed", "stopped"), "failed").when(F.col("n_lines") == 0, "searched, no results").otherwise("not said")
    return b.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def series_notes(spark, d):
    """What must be said beside every series: gaps, thin periods, single counts that are not stable."""
    s = _s(spark, d).filter("not partial")
    a = s.groupBy("query", "source").agg(F.count(F.lit(1)).alias("asked"), F.count("hits").alias("n"), F.count_if(F.col("hits") == 0).alias("zeros"), F.count_if(F.col("hits").between(1, 2)).alias("small"), F.sum("hits").alias("total"))
    notes = F.concat_ws("; ", F.when(F.col("n") < F.col("asked"), F.concat((F.col("asked") - F.col("n")).cast("string"), F.lit(" periods not measured"))), F.when((F.col("n") > 0) & (F.col("zeros") >= 0.3 * F.col("n")), "intermittent"),
                        F.when(F.col("total") < 20, "thin"), F.when(F.col("small") > 0, "periods of one or two may change"))
    return a.select("query", "source", F.nullif(notes, F.lit("")).alias("notes"))


def index_overrides(spark, d):
    """Why the shape of an index series is not to be taken as it is: nothing behind it, a floor, or one peak."""
    s = _s(spark, d).filter("source = 'google-trends' and hits is not null and not partial")
    a = s.groupBy("query").agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("hits") > 0).alias("nonzero"), F.max("hits").alias("peak"), F.percentile("hits", F.lit(0.5)).alias("median"))
    return a.withColumn("override", F.when(F.col("nonzero") == 0, "no support").when((F.col("nonzero") / F.col("points")) < 0.25, "floor").when((F.col("median") > 0) & (F.col("peak") >= 4 * F.col("median")), "one peak"))


def run_names(spark, d):
    """Names of runs made of titles and dates, and whether they are valid."""
    e = _e(spark, d).filter("title is not null and created_utc is not null")
    name = F.concat(tx.slug(F.col("title")), F.lit("-"), F.date_format(F.timestamp_seconds("created_utc"), "yyyy-MM-dd"))
    return e.select("row_id", name.alias("name"), name.rlike("^[a-z0-9][a-z0-9-]{0,80}$").alias("valid"))


def marker_map(spark, d):
    """All six markers of every query, shown or not."""
    q = _quotes(spark, d).groupBy("query").agg(F.collect_set("marker").alias("m"))
    return q.select("query", F.array_join(F.array(*[F.concat(F.lit(f"{m}="), F.array_contains("m", m).cast("int").cast("string")) for m in sorted(MARKERS)]), " ").alias("markers"))


def ranked_queries(spark, d):
    """The queries of every cell with their place."""
    return table(spark, d, "matrix").select("cell_id", F.posexplode("queries").alias("place", "query")).select("cell_id", (F.col("place") + 1).cast("bigint").alias("place"), "query")


def decoded_names(spark, d):
    """Names with a registry before them, read apart; stars belong to one registry only."""
    e = table(spark, d, "evidence_sample").select("row_id", F.element_at(F.array(F.lit("npm:"), F.lit("pypi:"), F.lit("")), (F.col("row_id") % 3 + 1).cast("int")).alias("p"), "community", F.col("engagement.score").alias("stars")).filter("community is not null")
    full = F.concat("p", "community")
    registry = F.when(full.startswith("npm:"), "npm").when(full.startswith("pypi:"), "pypi").otherwise("github")
    return e.select("row_id", registry.alias("registry"), F.regexp_replace(full, "^(npm|pypi):", "").alias("name"), F.when(registry == "github", F.col("stars")).alias("stars"))


_NAMES = "cluster_evidence member_index dropped_queries frame_gate exemplar_check source_summary request_status cited_share wedge_rank wedge_slots incumbent_distance shape_drift competitor_seed printed_prices capture_outcomes series_notes index_overrides run_names marker_map ranked_queries decoded_names".split()
QUERIES = {name: globals()[name] for name in _NAMES}

_H = "h as (select seq, run_slug, lower(trim(source)) as source, regexp_replace(lower(trim(status)), '[_ ]+', '-', 'g') as status from source_health)"
_C = """v as (select vec_id, label, embedding::double[] as e from embeddings), x as (select vec_id, label, unnest(e) as x, unnest(range(64)) as pos from v),
  c0 as (select label, list(s order by pos) as t from (select label, pos, sum(x) as s from x group by 1, 2) group by 1), w0 as (select list(s order by pos) as t from (select pos, sum(x) as s from x group by 1)),
  c as (select label, list_transform(t, lambda x: x / sqrt(list_inner_product(t, t))) as own from c0), w as (select list_transform(t, lambda x: x / sqrt(list_inner_product(t, t))) as whole from w0),
  dd as (select vec_id, v.label, round(greatest(0, 1 - list_inner_product(e, own)), 6) as pain, round(greatest(0, 1 - list_inner_product(e, whole)), 6) as incumbent from v join c using (label), w),
  b as (select *, row_number() over (partition by label order by pain, vec_id) as rk from dd), wg as (select row_number() over (order by incumbent desc, label) as place, label, vec_id, pain, incumbent from b where rk = 1)"""
_STOP = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"
_WSQ = "trim(regexp_replace(title, '[ \\t\\n\\r\\f]+', ' ', 'g'))"
from .spine import _SRC  # noqa: E402

ORACLES = {
    "cluster_evidence": f"with {E} select source, count(*) as n, count(url) as with_url from e where row_id in (select vec_id from embeddings) group by 1",
    "member_index": f"with {E} select query, regexp_replace(url, '/+$', '') as url, max(row_id) as row_id, count(*) as n from e where query is not null and url is not null group by 1, 2 having count(*) > 1",
    "dropped_queries": f"""with {E}, t as (select *, len(list_filter(list_distinct(list_filter(string_split(regexp_replace(query, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 4 and not list_contains({_STOP}, w))), lambda w: contains(lower(body), w))) = 0 as ignored from e where source in ('dialog', 'producthunt') and query is not null)
      select source, case when not ignored then query end as query, count(*) as opted_in, count(*) filter (not ignored) as by_default from t group by 1, 2""",
    "frame_gate": """with g as (select run_slug, count(*) as cells, count(distinct cell_id) as ids, bool_and(coalesce(len(queries) between 3 and 6 and coalesce(trim(persona), '') <> '' and coalesce(trim(vertical), '') <> '' and coalesce(trim(framing), '') <> '', false)) as whole from matrix group by 1)
      select *, cells between 6 and 12 and ids = cells and whole as holds from g""",
    "exemplar_check": f"""with {E}, t as (select source, case when {_WSQ} = '' then 0 else len(string_split({_WSQ}, ' ')) end as actual, len(string_split(title, ' ')) as stated from e where title is not null)
      select source, count(*) filter (actual > 15) as too_long, count(*) filter (actual <> stated) as miscounted, count(*) as n from t group by 1""",
    "source_summary": f"""with {_H}, k as (select run_slug, source, case status when 'ok' then 'ok' when 'degraded' then 'partial' when 'searched-no-results' then 'empty' when 'unavailable' then 'unavailable' when 'stopped' then 'unavailable' end as kind from h)
      select run_slug, """ + ", ".join(f"coalesce(string_agg(distinct source, ',' order by source) filter (kind = '{k}'), '') as {k}" for k in ("ok", "partial", "empty", "unavailable")) + " from k where kind is not null group by 1",
    "request_status": f"with {_H}, r as (select source, count(*) as n, count(*) filter (status in ('ok', 'searched-no-results')) as answered, count(*) filter (status is null) as silent from h group by 1) select *, case when answered = 0 then 'unavailable' when answered < n then 'degraded' else 'ok' end as status from r",
    "cited_share": f"with {E} select query, count(*) as n, round(avg((url is not null)::int), 4) as cited from e where query is not null group by 1",
    "wedge_rank": f"with {_C} select * from wg",
    "wedge_slots": f"with {_C}, k as (select *, vec_id % 3 as who from wg), t as (select *, row_number() over (partition by who order by place) as turn from k), s as (select row_number() over (order by place) as slot, label, who from t where turn <= 2) select * from s where slot <= 7",
    "incumbent_distance": f"""with {_C}, i0 as (select label, list(s order by pos) as t from (select label, pos, sum(x) as s from x where vec_id % 20 = 0 group by 1, 2) group by 1), m as (select label, count(*) as k from v where vec_id % 20 = 0 group by 1),
      j as (select c.label, coalesce(k, 0) as incumbents, case when k >= 2 then round(greatest(0, 1 - list_inner_product(own, list_transform(t, lambda x: x / sqrt(list_inner_product(t, t))))), 4) end as distance from c left join m using (label) left join i0 using (label))
      select *, case when distance >= 0.6 then 'new' when distance >= 0.35 then 'near' when distance is not null then 'same' end as novelty from j""",
    "shape_drift": f"with {_C}, g as (select label, arg_min(pain, vec_id) as first, arg_max(pain, vec_id) as last from dd group by 1) select *, last > first as drifted from g",
    "competitor_seed": f"""with n as (select {_SRC.format(c='source')} as name from evidence_sample union select {_SRC.format(c='source')} from source_health union select {_SRC.format(c='source')} from trend_series), {_H},
      st as (select {_SRC.format(c='source')} as name, arg_max(status, seq) as status from h where status is not null group by 1) select n.name, coalesce(status, 'not attempted') as status from n left join st using (name) where n.name is not null""",
    "printed_prices": f"""with {E}, s as (select distinct row_id, community, unnest(regexp_extract_all(body, '([0-9]+ (?:dollars|euros))', 1)) as price from e where community is not null), p as (select distinct community, unnest(regexp_extract_all(text, '([0-9]+ (?:dollars|euros))', 1)) as price from documents)
      select community, count(*) as n, count(distinct price) as prices from s where exists (select 1 from p where p.community = s.community and p.price = s.price) group by 1""",
    "capture_outcomes": "with b as (select regexp_replace(lower(trim(status)), '[_ ]+', '-', 'g') as status, n_lines from capture_batch) select case when n_lines > 0 then 'rows' when status in ('unavailable', 'failed', 'stopped') then 'failed' when n_lines = 0 then 'searched, no results' else 'not said' end as outcome, count(*) as n from b group by 1",
    "series_notes": f"""with {S}, a as (select query, source, count(*) as asked, count(hits) as n, count(*) filter (hits = 0) as zeros, count(*) filter (hits between 1 and 2) as small, sum(hits) as total from s where not partial group by 1, 2)
      select query, source, nullif(concat_ws('; ', case when n < asked then (asked - n) || ' periods not measured' end, case when n > 0 and zeros >= 0.3 * n then 'intermittent' end, case when total < 20 then 'thin' end, case when small > 0 then 'periods of one or two may change' end), '') as notes from a""",
    "index_overrides": f"""with {S}, a as (select query, count(*) as points, count(*) filter (hits > 0) as nonzero, max(hits) as peak, quantile_cont(hits, 0.5) as median from s where source = 'google-trends' and hits is not null and not partial group by 1)
      select *, case when nonzero = 0 then 'no support' when nonzero / points < 0.25 then 'floor' when median > 0 and peak >= 4 * median then 'one peak' end as override from a""",
    "run_names": f"""with {E}, s as (select row_id, created_utc, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as s from e where title is not null and created_utc is not null),
      n as (select row_id, case when length(s) > 40 then substr(regexp_replace(substr(s, 1, 41), '-[^-]*$', ''), 1, 40) else s end || '-' || strftime(to_timestamp(created_utc) at time zone 'UTC', '%Y-%m-%d') as name from s) select *, regexp_matches(name, '^[a-z0-9][a-z0-9-]{{0,80}}$') as valid from n""",
    "marker_map": f"with {E}, {INTENSITY_CTE}, g as (select query, list(distinct marker) as m from qm group by 1) select query, " + " || ' ' || ".join(f"'{m}=' || list_contains(m, '{m}')::int" for m in sorted(MARKERS)) + " as markers from g",
    "ranked_queries": "select cell_id, generate_subscripts(queries, 1)::bigint as place, unnest(queries) as query from matrix",
    "decoded_names": "select row_id, case row_id % 3 when 0 then 'npm' when 1 then 'pypi' else 'github' end as registry, regexp_replace(community, '^(npm|pypi):', '') as name, case when row_id % 3 = 2 then engagement.score end as stars from evidence_sample where community is not null",
}
