"""Queries along the spine of a capture: merge, lineage, quotes, mapping, health."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import spine
from ..runtime import cut, table
from .evidence import E, MARKERS, _e

BOTS = ["automoderator", "niche_digest_bot"]
HALF = 1_719_792_000


def merge_staging(spark, d):
    """Rows of later batches merged into those of earlier ones, by source; unknown sources are reported."""
    e = table(spark, d, "evidence_sample").select("row_id", "batch_id", F.nullif(F.trim("id"), F.lit("")).alias("id"), F.lower(F.trim("source")).alias("source"))
    return spine.merged(e.filter("batch_id % 3 <> 0"), e.filter("batch_id % 3 = 0"), [s for s in spine.ENUM if s != "dialog"])[1]


def dropped_rows(spark, d):
    """Rows of every source that are left out for having neither title nor text, beside those that stay."""
    e = table(spark, d, "evidence_sample").select(F.lower(F.nullif(F.trim("source"), F.lit(""))).alias("source"), F.concat_ws("", F.trim("title"), F.trim("text")).alias("body"))
    return e.groupBy("source").agg(F.count_if(F.col("body") == "").alias("dropped"), F.count_if(F.col("body") != "").alias("kept"))


def dedup_lineage(spark, d):
    return spine.lineage(_e(spark, d))


def _quotes(spark, d):
    """The first words of each row as a quote, some changed, with the marker that its text shows."""
    e = _e(spark, d).filter("query is not null and text is not null")
    found = F.explode(F.filter(F.array(*[F.when(F.lower("text").rlike(p), F.lit(m)) for m, p in MARKERS.items()]), lambda m: m.isNotNull()))
    start = F.array_join(F.slice(F.split(F.regexp_replace("text", r"[ \t\n\r\f]+", " "), " "), 1, 8), " ")
    k = F.col("row_id") % 50
    quote = F.when(k == 1, F.upper(start)).when(k == 2, F.concat(start, F.lit(" indeed"))).otherwise(start)
    url = F.when(k == 3, F.lit("ftp://elsewhere")).when(k == 4, F.concat("url", F.lit("/gone"))).otherwise(F.concat("url", F.lit("/")))
    q = e.select(F.col("query").alias("cluster"), found.alias("marker"), quote.alias("quote"), url.alias("url"), F.lower("text").rlike("every|each").alias("recurring"))
    return spine.resolved(q, e.select("row_id", F.col("query").alias("cluster"), "url", "author", "body"))


def quotes_resolved(spark, d):
    """Quotes by outcome and marker, resolved through the url they cite."""
    return _quotes(spark, d).groupBy(F.coalesce("problem", F.lit("sound")).alias("outcome"), "marker").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("author").alias("authors"))


def quote_verdicts(spark, d):
    """Clusters whose quotes are all sound, and what is wrong with the others."""
    return spine.all_or_nothing(_quotes(spark, d), list(MARKERS))


def exemplar_quotes(spark, d):
    return spine.exemplars(_quotes(spark, d))


def comment_targets(spark, d):
    """Threads by url: the first row is the post, the others comments that inherit its query; posts by bots go, their comments stay."""
    e = _e(spark, d).filter("url is not null").select("row_id", "url", "query", "community", F.lower("author").alias("author"))
    post = e.groupBy("url").agg(F.min_by(F.struct("row_id", "query", "author", "community"), "row_id").alias("p"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    from ..runtime import skew_join

    j = skew_join(e.select("row_id", "url"), cut(post, "threads"), ["url"], "n", e.count())
    kind = F.when(F.col("row_id") != F.col("p.row_id"), "comment").when(F.col("p.author").isin(*BOTS), "bot post").otherwise("post")
    return j.groupBy(F.coalesce("p.query", F.lit("?")).alias("query"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def comment_cap(spark, d, most: int = 40):
    """The threads whose comments are fetched: communities take turns until the cap is reached."""
    e = _e(spark, d).filter("url is not null and community is not null")
    post = e.groupBy("url").agg(F.min("row_id").alias("row_id"), F.min_by("community", "row_id").alias("community"))
    turn = F.row_number().over(W.partitionBy("community").orderBy("row_id"))
    # At most ``most`` of each community can be reached.
    few = post.withColumn("turn", turn).filter(F.col("turn") <= most)
    return few.withColumn("place", F.row_number().over(W.orderBy("turn", "row_id")).cast("bigint")).filter(F.col("place") <= most).select("place", "row_id", "community")


def captured_limit(spark, d, most: int = 25):
    """The first rows of every source and query, as a capture with a limit takes them."""
    e = _e(spark, d).filter("query is not null").select("row_id", "source", "query")
    at = F.row_number().over(W.partitionBy("source", "query").orderBy("row_id"))
    return e.withColumn("place", at.cast("bigint")).filter(F.col("place") <= most).groupBy("source").agg(F.count(F.lit(1)).alias("taken"), F.max("place").alias("most"))


def _items(spark, d):
    e = table(spark, d, "evidence_sample")
    k = F.col("row_id") % 4
    meta = F.to_json(F.struct(
        F.when(k == 0, F.col("author")).alias("author"), F.when(k == 1, F.col("author")).alias("by"), F.col("community").alias("subreddit"), F.when(k == 2, F.col("engagement.comments").cast("string")).alias("comments"),
        F.when(k == 3, F.col("engagement.comments").cast("string")).alias("num_comments"), F.col("row_id").cast("string").alias("id"), F.col("text").alias("selftext")))
    traffic = F.when(k < 2, F.concat(F.abs("engagement.score").cast("string"), F.lit(" points"))).when(k == 2, "12K searches")
    return e.select("row_id", F.when(k == 3, "HN").when(k == 2, "hackernews").otherwise(F.col("source")).alias("provider"), F.col("title").alias("keyword"), F.when(k != 2, F.col("url")).alias("url"), traffic.alias("traffic"), F.lit(None).cast("string").alias("published"), meta.alias("meta"))


def mapped_records(spark, d):
    """Foreign items read into evidence records, by source and what they carry."""
    m = spine.mapped(_items(spark, d))
    return m.select("row_id", "id", "source", "author", "community", F.col("engagement.score").alias("score"), F.col("engagement.comments").alias("comments"), F.col("engagement").isNull().alias("none"), F.length("text").cast("bigint").alias("length"))


def permalinks(spark, d):
    """Rows whose link the source gave, those where it follows from a number, and those without one."""
    m = spine.mapped(_items(spark, d))
    return m.groupBy("source", F.when(F.col("url").isNull(), "none").when(F.col("url").contains("item?id="), "derived").otherwise("given").alias("link")).agg(F.count(F.lit(1)).alias("n"))


def source_catalogue(spark, d):
    """Sources met in rows and health, whether they are known, can be asked by keyword, and how often each occurs."""
    e = table(spark, d, "evidence_sample").select(spine.source_of(F.col("source")).alias("source"), F.lit(1).alias("rows"), F.lit(0).alias("entries"))
    h = table(spark, d, "source_health").select(spine.source_of(F.col("source")).alias("source"), F.lit(0).alias("rows"), F.lit(1).alias("entries"))
    r = e.unionByName(h).groupBy("source").agg(F.sum("rows").alias("rows"), F.sum("entries").alias("entries"))
    return r.withColumn("known", F.coalesce(F.col("source").isin(*spine.ENUM), F.lit(False))).withColumn("by_keyword", F.col("known") & ~F.col("source").isin("google-trends", "wikipedia"))


def request_errors(spark, d):
    """Failed requests by what they say; the statuses by which each source refused."""
    h = table(spark, d, "source_health").select(F.lower(F.trim("source")).alias("source"), "seq", "detail")
    k = F.col("seq") % 7
    said = F.when(k == 0, F.col("detail")).when(k == 1, "HTTP 429 from host").when(k == 2, "status 404").when(k == 3, "request timed out").when(k == 4, "cannot connect").when(k == 5, "HTTP 503")
    status = F.when(k == 1, 429).when(k == 2, 404).when(k == 5, 503)
    return h.groupBy("source", F.coalesce(spine.error_kind(F.when(k > 0, said)), F.lit("none")).alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.array_join(spine.refused(F.collect_set(status)), ",").alias("refused"))


def community_lists(spark, d):
    """Lists of communities as typed, split and each once."""
    m = table(spark, d, "matrix").withColumn("typed", F.concat(F.lit("r/"), F.array_join("subreddits", ", /R/"), F.lit(",,r/"), F.element_at("subreddits", 1)))
    return m.select("cell_id", F.array_join(spine.communities(F.col("typed")), " ").alias("communities"))


_NAMES = "merge_staging dropped_rows dedup_lineage quotes_resolved quote_verdicts exemplar_quotes comment_targets comment_cap captured_limit mapped_records permalinks source_catalogue request_errors community_lists".split()
QUERIES = {name: globals()[name] for name in _NAMES}

_FOLD = "trim(regexp_replace(regexp_replace(translate({c}, '‘’‚‛“”„‟–—‒―', '''''''''\"\"\"\"----'), '…', '...', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'))"
_MARKS = "[" + ", ".join(f"case when regexp_matches(lower(text), '{p}') then '{m}' end" for m, p in MARKERS.items()) + "]"
_COST = "('money_loss', 'time_quantified', 'workaround_built', 'abandonment')"
_Q = f"""{E}, b as (select *, array_to_string(string_split(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ')[1:8], ' ') as start from e where query is not null and text is not null),
  q0 as (select query as cluster, unnest({_MARKS}) as marker, case row_id % 50 when 1 then upper(start) when 2 then start || ' indeed' else start end as quote,
    case row_id % 50 when 3 then 'ftp://elsewhere' when 4 then url || '/gone' else url || '/' end as url, regexp_matches(lower(text), 'every|each') as recurring from b),
  q1 as (select *, regexp_replace(url, '/+$', '') as u from q0 where marker is not null),
  ix as (select query as cluster, regexp_replace(url, '/+$', '') as u, max(row_id) as row_id from b where url is not null group by 1, 2),
  j as (select q1.*, ix.row_id as hit, b.body, b.author as a from q1 left join ix using (cluster, u) left join b on b.row_id = ix.row_id),
  k as (select *, {_FOLD.format(c='body')} as hay, {_FOLD.format(c='quote')} as needle from j),
  v as (select cluster, marker, quote, url, recurring, case when lower(trim(a)) not in ('', 'none', '[deleted]', '[removed]', 'u/[deleted]', 'u/[removed]', 'deleted', 'removed', 'automoderator', 'u/automoderator') then trim(a) end as author,
    case when coalesce(needle, '') = '' then 'empty' when len(string_split(needle, ' ')) > 15 then 'too long' when not coalesce(starts_with(url, 'http'), false) then 'no permalink' when hit is null then 'not in cluster'
      when contains(hay, needle) then null when contains(lower(hay), lower(needle)) then 'case differs' else 'not verbatim' end as problem, needle from k)"""
_ALIAS = "case k " + " ".join(f"when '{a}' then '{b}'" for a, b in spine.ALIASES.items()) + " else k end"
_SRC = "replace(" + _ALIAS.replace("case k", "case replace(lower(trim({c})), '-', '_')").replace("else k", "else replace(lower(trim({c})), '-', '_')") + ", '_', '-')"
_TRIM = "nullif(trim({c}), '')"
_ITEMS = f"""i as (select *, row_id % 4 as k, case row_id % 4 when 3 then 'HN' when 2 then 'hackernews' else source end as provider, case when row_id % 4 <> 2 then nullif(trim(url), '') end as u0 from evidence_sample),
  m0 as (select *, lower(trim(provider)) as p, {_SRC.format(c='provider')} as src, coalesce(u0, case when lower(trim(provider)) = 'hackernews' then 'https://news.ycombinator.com/item?id=' || row_id end) as u, nullif(trim(title), '') as t,
    case when k < 2 then {_TRIM.format(c='author')} end as a, {_TRIM.format(c='community')} as c, case when k < 2 then abs(engagement.score) end as score, case when k >= 2 then engagement.comments end as comments from i)"""
ORACLES = {
    "merge_staging": """with e as (select row_id, batch_id % 3 = 0 as staged, nullif(trim(id), '') as id, lower(trim(source)) as source from evidence_sample where batch_id is not null),
      f as (select source, id, bool_and(staged) as added from e where id is not null and source in ('reddit', 'hackernews', 'stackoverflow', 'producthunt', 'github', 'pypi', 'npm', 'wikipedia', 'google-trends') group by 1, 2),
      w as (select source, count(*) as written, count(*) filter (added) as added from f group by 1),
      c as (select coalesce(source, '?') as source, count(*) filter (not staged) as existing, count(*) filter (staged) as staged, count(*) filter (id is null) as without_id from e group by 1)
      select c.*, coalesce(written, 0) as written, coalesce(added, 0) as added, case when source in ('reddit', 'hackernews', 'stackoverflow', 'producthunt', 'github', 'pypi', 'npm', 'wikipedia', 'google-trends') then 'merged' else 'not merged: unknown source' end as status from c left join w using (source)""",
    "dropped_rows": "with e as (select lower(nullif(trim(source), '')) as source, concat(trim(title), trim(text)) as b from evidence_sample) select source, count(*) filter (b = '') as dropped, count(*) filter (b <> '') as kept from e group by 1",
    "dedup_lineage": f"""with {E}, k as (select row_id, id, case when url is not null then sha1(url || chr(10) || lower(regexp_replace(trim(coalesce(text, '')), '[ \\t\\n\\r]+', ' ', 'g'))) end as content from e),
      a as (select *, case when id is null then row_id else min(row_id) over (partition by id) end as f from k), b as (select *, case when content is null then row_id else min(row_id) over (partition by content) end as g from a where row_id = f)
      select coalesce(b.g, a.f) as kept_row_id, a.row_id, 'id' as by from a left join b on b.row_id = a.f where a.row_id <> a.f union all select g, row_id, 'content' from b where row_id <> g""",
    "quotes_resolved": f"with {_Q} select coalesce(problem, 'sound') as outcome, marker, count(*) as n, count(distinct author) as authors from v group by 1, 2",
    "quote_verdicts": f"""with {_Q}, g as (select cluster, count(*) as quotes, count(problem) as rejected, 0::bigint as unknown_markers, count(*) filter (problem is null and author is null) as anonymous, count(*) filter (recurring and marker not in {_COST}) as recurring_ignored from v group by 1)
      select *, rejected = 0 as accepted from g""",
    "exemplar_quotes": f"""with {_Q}, s as (select cluster, lower(needle) as key, min(row(case when marker in {_COST} then 0 when marker = 'complainer_is_buyer' then 1 else 2 end, quote, url)) as q from v where problem is null group by 1, 2),
      r as (select *, row_number() over (partition by cluster order by q) as place from s) select cluster, place, q[2] as quote, q[3] as url from r where place <= 6""",
    "comment_targets": f"""with {E}, t as (select url, min(row_id) as first, arg_min_null(query, row_id) as query, arg_min_null(lower(author), row_id) as author from e where url is not null group by url having count(*) > 1)
      select coalesce(t.query, '?') as query, case when e.row_id <> first then 'comment' when t.author in ('automoderator', 'niche_digest_bot') then 'bot post' else 'post' end as kind, count(*) as n from e join t using (url) group by 1, 2""",
    "comment_cap": f"""with {E}, p as (select url, min(row_id) as row_id, arg_min(community, row_id) as community from e where url is not null and community is not null group by 1),
      t as (select *, row_number() over (partition by community order by row_id) as turn from p), r as (select *, row_number() over (order by turn, row_id) as place from t) select place, row_id, community from r where place <= 40""",
    "captured_limit": f"with {E}, r as (select source, row_number() over (partition by source, query order by row_id) as place from e where query is not null) select source, count(*) as taken, max(place) as most from r where place <= 25 group by 1",
    "mapped_records": f"""with {_ITEMS} select row_id, sha1(concat_ws('|', src, coalesce(u, ''), coalesce(t, ''))) as id, src as source, case when p = 'reddit' and not starts_with(a, 'u/') then 'u/' || a else a end as author,
      case when p = 'reddit' and not starts_with(c, 'r/') then 'r/' || c else c end as community, score, comments, score is null and comments is null as "none", length(substr(nullif(trim(text), ''), 1, 4000)) as length from m0""",
    "permalinks": f"with {_ITEMS} select src as source, case when u is null then 'none' when contains(u, 'item?id=') then 'derived' else 'given' end as link, count(*) as n from m0 group by 1, 2",
    "source_catalogue": f"""with u as (select {_SRC.format(c='source')} as source, 1 as r, 0 as h from evidence_sample union all select {_SRC.format(c='source')}, 0, 1 from source_health), g as (select source, sum(r)::bigint as rows, sum(h)::bigint as entries from u group by 1)
      select *, coalesce(source in ('reddit', 'hackernews', 'stackoverflow', 'producthunt', 'github', 'pypi', 'npm', 'wikipedia', 'google-trends', 'dialog'), false) as known,
        coalesce(source in ('reddit', 'hackernews', 'stackoverflow', 'producthunt', 'github', 'pypi', 'npm', 'dialog'), false) as by_keyword from g""",
    "request_errors": """select lower(trim(source)) as source, case seq % 7 when 1 then 'retry 429' when 2 then 'terminal 404' when 3 then 'retry timeout' when 4 then 'retry connection' when 5 then 'retry 503' else 'none' end as kind, count(*) as n,
      max(case seq % 7 when 1 then '429' when 5 then '503' else '' end) as refused from source_health group by 1, 2""",
    "community_lists": "select cell_id, array_to_string(subreddits, ' ') as communities from matrix",
}
