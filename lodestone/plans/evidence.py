"""Queries over captured evidence: dedup, panels, readings, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.normal import epoch_seconds
from ..operators import evidence as ev
from ..operators import rubric
from ..runtime import table

# Stems of complaints, and the three searches of the corpus.
COMPLAINTS = ["abandon", "advice", "alternativ", "annoy", "anyone else", "avoid", "awful", "backlog", "bloat", "bottleneck", "broke", "bug", "burn", "can't", "cannot", "cant ", "chaos", "charge", "cheaper", "complain", "confus", "cost", "crash", "deprecat", "disaster", "downtime", "drown", "dumb", "duplicate", "error", "expensive", "fail", "fed up", "fix", "frustrat", "garbage", "hack togeth", "hard time", "hate", "headache", "help", "hidden fee", "horrible", "how do", "how to", "impossible", "inefficien", "issue", "junk", "lawsuit", "leav", "lock-in", "lockin", "lost", "manual", "mess", "migrat", "miss", "mistake", "nightmare", "no way to", "not working", "outage", "overwhelm", "pain", "paper", "pointless", "problem", "quit", "rant", "recommend", "refus", "regret", "replac", "ridiculous", "risk", "sick of", "slow", "spreadsheet", "struggl", "stuck", "suck", "switch", "tedious", "terrible", "tired of", "trash", "trouble", "unusable", "useless", "vent", "warn", "waste", "why does", "why is", "won't", "wont ", "workaround", "worse", "worst", "wrong"]
SPEND = r"\$[0-9]|per (seat|user|month|year)|licen[cs]e|invoice|renewal|quote|contract|we pay|paying for|subscription|retainer|consultant|vendor|rfp"
EFFORT = r"hrs?/(week|wk|month)|hours (a|per) (day|week|month)|full.?time|fte|headcount|temp|intern|every (monday|morning|month)|spreadsheet|excel|access db|airtable|zapier|script i wrote|by hand|manually"
BLOCKER = r"procure|rfp|purchas|po |sole.source|budget cycle|council|no api|export|read.only|integrat|tos|terms of service|hipaa|cjis|ferpa|union|civil service|it (won|will never)|security review|soc ?2|legal"
MARKERS = {"money_loss": r"dollars|euros|late fee|refund", "time_quantified": r"[0-9]+ (minutes|hours|times)", "workaround_built": r"workaround|i built|by hand", "abandonment": r"cancel|went back", "profanity_urgency": r"losing my mind|until further notice", "complainer_is_buyer": r"we pay|gladly pay|i paid"}
SOURCES = ["reddit", "hackernews", "stackoverflow", "github", "dialog", "producthunt"]
STOP = ["with", "that", "this", "from", "have", "they", "what", "when", "before", "after", "there", "which", "about", "every", "than", "then", "once", "your", "does", "into", "more", "only", "their", "them", "will", "would", "been"]


def _e(spark: SparkSession, d: str) -> DataFrame:
    return ev.cleaned(table(spark, d, "evidence_sample"))


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return ev.panel(_e(spark, d).filter("query is not null"))


def freq_panel(spark, d):
    return _clusters(spark, d)


def freq_read(spark, d):
    """Frequency reading of every cluster, loudest sort left to the caller."""
    return rubric.frequency_read(_clusters(spark, d)).drop("cell_ids")


def engagement_nulls(spark, d):
    e = _e(spark, d)
    return e.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("score").isNull() & F.col("comments").isNull()).alias("neither"),
        F.count_if(F.col("score").isNull() & F.col("comments").isNotNull()).alias("comments_only"), F.sum("engagement_value").alias("total"),
    )


def dedup_id_content(spark, d):
    return ev.deduplicated(_e(spark, d))


def source_health(spark, d):
    return ev.source_health(_e(spark, d))


def capture_gate(spark, d):
    """Whether each run slice (here: cell) has enough items from enough sources."""
    g = _e(spark, d).groupBy(F.lower("cell_id").alias("cell")).agg(F.count(F.lit(1)).alias("items"), F.count_distinct("source").alias("sources"))
    return g.withColumn("verdict", F.when((F.col("items") < 40) | (F.col("sources") < 3), "thin").otherwise("proceed"))


def cross_source_collapse(spark, d):
    return ev.shared_url_winner(_e(spark, d), SOURCES)


def exemplars_top3(spark, d):
    return ev.first_urls(_e(spark, d).filter("query is not null"))


def canonical_phrases(spark, d):
    return _e(spark, d).select("row_id", tx.canonical_phrase(F.col("title"), F.col("text")).alias("phrase"))


def complaint_filter(spark, d):
    """Posts without body whose title carries a complaint, and all posts with a body."""
    e = _e(spark, d).withColumn("gone", F.col("text").isNull() | F.lower("text").isin("[removed]", "[deleted]"))
    signal = F.lower(F.coalesce("title", F.lit(""))).rlike("|".join(COMPLAINTS)) | F.coalesce("title", F.lit("")).contains("?")
    return e.groupBy("source", "gone", signal.alias("signal")).agg(F.count(F.lit(1)).alias("n")).withColumn("kept", ~F.col("gone") | F.col("signal"))


def corpus_mining(spark, d):
    body = F.lower("body")
    e = _e(spark, d).select("row_id", body.rlike(SPEND).alias("spend"), body.rlike(EFFORT).alias("effort"), body.rlike(BLOCKER).alias("blocker"))
    return e.filter("spend or effort or blocker")


def _quotes(spark, d) -> DataFrame:
    """One quote per row and marker that occurs in it."""
    e = _e(spark, d).filter("query is not null and text is not null")
    found = F.explode(F.filter(F.array(*[F.when(F.lower("text").rlike(p), F.lit(m)) for m, p in MARKERS.items()]), lambda m: m.isNotNull()))
    author = F.when(~F.lower("author").isin("[deleted]", "[removed]", "deleted", "removed", "automoderator"), F.col("author"))
    return e.select("query", author.alias("author"), F.lower("text").rlike("every|each").alias("recurring"), found.alias("marker"))


def intensity_score(spark, d):
    return rubric.intensity(_quotes(spark, d))


def quadrant_counts(spark, d):
    f, i = rubric.frequency_read(_clusters(spark, d)), rubric.intensity(_quotes(spark, d))
    both = f.join(i, "query", "left").withColumn("quadrant", rubric.quadrant(F.col("read"), F.coalesce("score", F.lit(1))))
    return both.groupBy("quadrant").agg(F.count(F.lit(1)).alias("clusters"))


def quote_validation(spark, d):
    """Quotes judged against the record behind their url; the first failing reason is named.

    The quotes are the titles, altered by row: some upper-case, some with a word
    doubled, some with another record's url.
    """
    e = _e(spark, d).filter("title is not null and url is not null")
    k = F.col("row_id") % 5
    quote = F.when(k == 1, F.upper("title")).when(k == 2, F.concat(F.lit("indeed "), "title")).otherwise(F.col("title"))
    url = F.when(k == 3, F.lit("ftp://elsewhere")).otherwise(F.col("url"))
    q = e.select("row_id", "query", quote.alias("quote"), url.alias("u"))
    # Quotes meet records by id, not by url: no pair is made that is not asked for.
    j = q.join(e.select("row_id", "url", "body"), "row_id")
    hay, needle = tx.fold_quote(F.col("body")), tx.fold_quote(F.col("quote"))
    problem = (
        F.when(needle == "", "empty quote").when(tx.word_count(needle) > 15, "more than 15 words").when(~F.col("u").startswith("http"), "no web address")
        .when(F.col("u") != F.col("url"), "not in cluster").when(hay.contains(needle), None).when(F.lower(hay).contains(F.lower(needle)), "case differs").otherwise("not verbatim")
    )
    return j.groupBy(F.coalesce(problem, F.lit("valid")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def field_completeness(spark, d):
    e = _e(spark, d)
    return e.groupBy("source").agg(*[F.count_if(F.col(c).isNotNull()).alias(f"with_{c}") for c in ("id", "url", "text", "author", "community", "score", "query")])


def skip_reasons(spark, d):
    """Counted reasons for which a row would be left out: nothing is dropped silently."""
    e = _e(spark, d)
    reason = F.when(F.lower("author").rlike("_bot$"), "bot").when(F.col("score").isNull(), "no score reported").when(F.col("score") < 1, "below score floor").when(
        (F.col("captured_utc") - F.col("created_utc")).between(0, 172799), "fresh").otherwise("kept")
    return e.groupBy("source", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def round_robin(spark, d):
    """Interleaving of sources: the turn of every row."""
    return ev.round_robin(_e(spark, d), "source", "row_id").select("row_id", "source", "turn")


def top_comments(spark, d):
    """The three best rows of each thread that several rows share."""
    e = _e(spark, d).filter("url is not null")
    several = e.groupBy("url").count().filter("count > 3").select("url")
    return ev.top_per_group(e.join(several, "url", "left_semi"), "url", 3, F.coalesce("score", F.lit(0)), "row_id").select("url", "rank", "row_id")


def url_slugs(spark, d):
    return _e(spark, d).filter("url is not null").select("row_id", tx.url_slug(F.col("url")).alias("slug"))


def title_slugs(spark, d):
    return _e(spark, d).filter("title is not null").select("row_id", tx.slug(F.col("title")).alias("slug"), tx.word_count(F.col("title")).alias("words"))


def evidence_ids(spark, d):
    e = _e(spark, d)
    return e.select("row_id", tx.evidence_id(F.col("source"), F.col("url")).alias("plain"), tx.evidence_id(F.col("source"), F.col("url"), F.col("title"), sep="|").alias("piped"))


def vote_counts(spark, d):
    """Votes read from phrases built of score and unit."""
    e = _e(spark, d).filter("score is not null")
    unit = F.element_at(F.array(*map(F.lit, (" points", "K likes", " comments", " Upvotes"))), (F.col("row_id") % 4 + 1).cast("int"))
    phrase = F.concat(F.format_number(F.abs("score"), 0), unit)
    return e.select("row_id", tx.vote_count(phrase).alias("votes"))


def theme_terms(spark, d):
    """Distinctive terms of the titles and how many rows have each."""
    e = _e(spark, d).filter("title is not null")
    return e.select(F.explode(tx.distinctive_terms(F.col("title"), STOP)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")


def on_topic(spark, d):
    """Rows about the words of the query that captured them: two terms, or one of five letters."""
    e = _e(spark, d).filter("query is not null")
    terms = tx.distinctive_terms(F.col("query"), STOP + ["rant", "software", "complaints", "alternative"])
    hits = F.filter(terms, lambda t: F.contains(F.lower("body"), t))
    on = (F.size(hits) >= 2) | F.exists(hits, lambda t: F.length(t) >= 5)
    return e.withColumn("on", on).groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.count_if("on").alias("on_topic"))


def personas(spark, d):
    """The personas behind each query: cells of its rows, looked up in the frame."""
    m = table(spark, d, "matrix").select(F.col("cell_id").alias("cell"), "persona")
    e = _e(spark, d).filter("query is not null and cell_id is not null").select("query", F.lower("cell_id").alias("cell")).distinct()
    # The frame is a fixed small table; queries without a known cell stay, with no persona.
    return e.join(F.broadcast(m), "cell", "left").groupBy("query").agg(F.array_join(F.array_sort(F.collect_set("persona")), ",").alias("personas"))


def matrix_problems(spark, d):
    """Every rule a cell of the frame breaks."""
    m = table(spark, d, "matrix")
    bad = F.array_compact(F.array(
        F.when(~F.size("queries").between(3, 6), "queries not 3 to 6"), F.when(~F.col("cell_id").rlike("^m[0-9]{2}$"), "cell id"),
        F.when(F.coalesce(F.trim("persona"), F.lit("")) == "", "persona blank"), F.when(F.size("subreddits") > 1, "several communities")))
    return m.select("cell_id", F.array_join(bad, "; ").alias("problems"), F.size(bad).alias("n"))


def batch_audit(spark, d):
    """Lines announced per batch against lines that arrived."""
    b = table(spark, d, "capture_batch").select("batch_id", F.lower(F.trim("status")).alias("status"), "n_lines")
    n = table(spark, d, "evidence_sample").groupBy("batch_id").agg(F.count(F.lit(1)).alias("arrived"))
    j = b.join(n, "batch_id", "left").withColumn("arrived", F.coalesce("arrived", F.lit(0)))
    return j.withColumn("outcome", F.when(F.col("n_lines").isNull(), "not announced").when(F.col("n_lines") == F.col("arrived"), "complete").otherwise("differs"))


def sources_of_urls(spark, d):
    """Urls known to two given sources, and those known to the first alone."""
    e = _e(spark, d).filter("url is not null").withColumn("u", F.regexp_replace("url", "/$", ""))
    a, b = (e.filter(F.col("source") == s).select("u") for s in ("reddit", "dialog"))
    both = a.intersect(b).select(F.lit("both").alias("part"), "u")
    return both.unionByName(a.subtract(b).select(F.lit("first only").alias("part"), "u")).groupBy("part").agg(F.count(F.lit(1)).alias("urls"))


def late_rows(spark, d):
    """How many days after their capture rows were received, for those that were late."""
    e = table(spark, d, "evidence_sample").select("received_at", epoch_seconds(F.col("captured_utc")).alias("captured"))
    j = e.withColumn("days", F.floor((F.unix_timestamp("received_at") - F.col("captured")) / 86400))
    return j.filter("days >= 1").groupBy("days").agg(F.count(F.lit(1)).alias("n"))


_NAMES = "freq_panel freq_read engagement_nulls dedup_id_content source_health capture_gate cross_source_collapse exemplars_top3 canonical_phrases complaint_filter corpus_mining intensity_score quadrant_counts quote_validation field_completeness skip_reasons round_robin top_comments url_slugs title_slugs evidence_ids vote_counts theme_terms on_topic personas matrix_problems batch_audit sources_of_urls late_rows".split()
QUERIES = {name: globals()[name] for name in _NAMES}

E = """e as (
  select *, concat_ws(chr(10), title, text) as body,
    case when score is not null or comments is not null then coalesce(score, 0) + coalesce(comments, 0) end as engagement_value
  from (select row_id, nullif(trim(id), '') as id, nullif(trim(cell_id), '') as cell_id, lower(nullif(trim(source), '')) as source, nullif(trim(url), '') as url,
      nullif(trim(title), '') as title, nullif(trim(text), '') as text, nullif(trim(author), '') as author, nullif(trim(community), '') as community,
      lower(nullif(trim(query), '')) as query, engagement.score as score, engagement.comments as comments, created_utc, captured_utc from evidence_sample)
  where concat_ws(chr(10), title, text) <> '')"""
PANEL = f"""{E}, panel as (
  select query, count(*) as member_count, count(distinct author) as distinct_authors, count(distinct community) as distinct_communities,
    sum(engagement_value)::bigint as engagement_sum, coalesce(string_agg(distinct cell_id, ',' order by cell_id), '') as cell_ids
  from e where query is not null group by query)"""
FREQ = f"""{PANEL}, one as (
  select case when count(*) >= 10 then quantile_cont(coalesce(engagement_sum, 0), 0.9) end as decile_floor, sum(member_count) as corpus from panel),
f as (select *, case when corpus < 300 then corpus / 300.0 when corpus > 1500 then corpus / 1500.0 else 1.0 end as fac from one),
th as (select *, greatest(2, round_even(20 * fac, 0)::bigint) as hs0, greatest(2, round_even(8 * fac, 0)::bigint) as ms,
  greatest(2, round_even(12 * fac, 0)::bigint) as ha0, greatest(2, round_even(6 * fac, 0)::bigint) as ma from f),
l0 as (select p.*, decile_floor, case when hs0 <= ms then ms + 1 else hs0 end as high_size, case when ha0 <= ma then ma + 1 else ha0 end as high_authors,
  ms as medium_size, ma as medium_authors from panel p, th),
l1 as (select *, case when member_count >= high_size and distinct_authors >= high_authors then 3 when member_count >= medium_size and distinct_authors >= medium_authors then 2 else 1 end as volume from l0),
l2 as (select *, case when volume = 3 and distinct_communities < 3 then 2 else volume end as capped from l1),
l3 as (select *, case when distinct_authors / member_count < 0.4 then greatest(1, capped - 1) else capped end as demoted from l2),
l4 as (select *, case when demoted = 2 and decile_floor is not null and coalesce(engagement_sum, 0) >= decile_floor and distinct_communities >= 3 then 3 else demoted end as level from l3),
freq as (select query, member_count, distinct_authors, distinct_communities, engagement_sum, ['low', 'medium', 'high'][level] as read,
  nullif(concat_ws('; ', case when capped < volume then case when distinct_communities <= 1 then 'one community' else 'few communities' end end,
    case when demoted < capped then 'few authors repeat' end, case when level > demoted then 'engagement in top decile' end, case when level < 3 then 'below the top level' end), '') as note,
  high_size, high_authors, medium_size, medium_authors, round(decile_floor, 4) as decile_floor from l4)"""
_LIST = ", ".join(f"case when regexp_matches(lower(text), '{p}') then '{m}' end" for m, p in MARKERS.items())
QUOTES = f"""q as (
  select query, case when lower(author) not in ('[deleted]', '[removed]', 'deleted', 'removed', 'automoderator') then author end as author,
    regexp_matches(lower(text), 'every|each') as recurring, unnest([{_LIST}]) as marker
  from e where query is not null and text is not null),
qm as (select * from q where marker is not null),
per as (select query, marker, count(distinct author) as authors from qm group by 1, 2),
sums as (select query, count(*) as markers, count(*) filter (marker in ('money_loss', 'time_quantified', 'workaround_built', 'abandonment') and authors >= 2) as k,
  coalesce(max(case when marker = 'complainer_is_buyer' then authors end), 0) as b, bool_or(marker <> 'profanity_urgency') as beyond from per group by 1),
people as (select query, count(distinct case when marker in ('money_loss', 'time_quantified', 'workaround_built', 'abandonment') and recurring then author end) as r, count(distinct author) as people from qm group by 1),
s1 as (select *, case when k >= 2 and b >= 1 then 4 when k >= 1 then 3 else 2 end as l from sums join people using (query)),
s2 as (select *, case when l = 4 and r >= 2 and b >= 2 then 5 else l end as l2 from s1),
intensity as (select query, markers, k, b, r, case when (people <= 1 or not beyond) and l2 > 2 then 2 else l2 end as score from s2)"""
INTENSITY_CTE = QUOTES
_U = "case when regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://') then url else 'https://' || url end"
_WS = "trim(regexp_replace({c}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"
_ARR = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_TERMS = "list_distinct(list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 4 and not list_contains({s}, w)))"
_FOLD = _WS.format(c="regexp_replace(translate({c}, '‘’‚‛“”„‟–—‒―', '''''''''\"\"\"\"----'), '…', '...', 'g')")
ORACLES = {
    "freq_panel": f"with {PANEL} select * from panel",
    "freq_read": f"with {FREQ} select * from freq",
    "engagement_nulls": f"with {E} select source, count(*) as n, count(*) filter (score is null and comments is null) as neither, count(*) filter (score is null and comments is not null) as comments_only, sum(engagement_value)::bigint as total from e group by source",
    "dedup_id_content": f"""with {E}, k as (select *, coalesce('i' || id, 'r' || row_id) as k from e),
      one as (select k, min(row_id) as row_id, arg_min(coalesce(url, '~null'), row_id) as url, arg_min(coalesce(text, ''), row_id) as text, list(distinct cell_id) filter (cell_id is not null) as cells, count(*) as n from k group by k),
      c as (select *, case when url <> '~null' then sha1(url || chr(10) || lower(regexp_replace(trim(text), '[ \\t\\n\\r]+', ' ', 'g'))) else k end as c from one)
      select min(row_id) as row_id, coalesce(array_to_string(list_sort(list_distinct(flatten(list(coalesce(cells, []))))), ','), '') as cells, (sum(n) - 1)::bigint as dropped from c group by c""",
    "source_health": f"with {E} select source, count(*) as n, count(*) filter (url is null) as no_url, count(*) filter (engagement_value is null) as no_engagement, case when count(*) filter (url is null) > 0 or count(*) filter (engagement_value is null) = count(*) then 'degraded' else 'ok' end as status from e group by source",
    "capture_gate": f"with {E} select lower(cell_id) as cell, count(*) as items, count(distinct source) as sources, case when count(*) < 40 or count(distinct source) < 3 then 'thin' else 'proceed' end as verdict from e group by 1",
    "cross_source_collapse": f"""with {E}, k as (select *, regexp_replace(url, '/$', '') as u, list_position({_ARR(SOURCES)}, source) as p from e where url is not null and list_contains({_ARR(SOURCES)}, source)),
      r as (select *, row_number() over (partition by u order by length(coalesce(text, '')) desc, p, row_id) as rk, count(*) over (partition by u) as n from k),
      s as (select u, count(distinct source) as ns from k group by u)
      select u as url, row_id, n - 1 as dropped from r join s using (u) where rk = 1 and ns > 1""",
    "exemplars_top3": f"""with {E}, b as (select query, url, max(row(coalesce(nullif(engagement_value, 0), -1), -row_id)) as b from e where query is not null and url is not null group by 1, 2),
      r as (select *, row_number() over (partition by query order by b desc) as rank from b) select query, rank, url from r where rank <= 3""",
    "canonical_phrases": f"""with {E}, a as (select row_id, {_WS.format(c=f"coalesce(nullif({_WS.format(c='title')}, ''), text)")} as t from e),
      b as (select row_id, regexp_replace(t, '^[\\[(][^\\])]{{1,24}}[\\])] *[:-]? *', '') as t from a),
      c as (select row_id, regexp_replace(regexp_replace(t, '^[ \\t"''`*_#>-]+', ''), '[ \\t"''`*_#>-]+$', '') as t from b),
      h as (select *, regexp_extract(t, '^(.*?[.!?;]) ', 1) as head from c),
      p as (select row_id, regexp_replace(case when length(head) >= 25 then head else t end, '\\.+$', '') as p from h)
      select row_id, case when length(p) > 120 then regexp_replace(regexp_replace(substr(p, 1, 120), ' [^ ]*$', ''), '[ ,;:]+$', '') || '...' else p end as phrase from p""",
    "complaint_filter": f"""with {E}, g as (select source, text is null or lower(text) in ('[removed]', '[deleted]') as gone,
      regexp_matches(lower(coalesce(title, '')), '{"|".join(COMPLAINTS).replace("'", "''")}') or contains(coalesce(title, ''), '?') as signal from e)
      select source, gone, signal, count(*) as n, not gone or signal as kept from g group by all""",
    "corpus_mining": f"with {E}, m as (select row_id, regexp_matches(lower(body), '{SPEND}') as spend, regexp_matches(lower(body), '{EFFORT}') as effort, regexp_matches(lower(body), '{BLOCKER}') as blocker from e) select * from m where spend or effort or blocker",
    "intensity_score": f"with {E}, {QUOTES} select *, case when score >= 4 then 'high' when score = 3 then 'medium' else 'low' end as intensity_read from intensity",
    "quadrant_counts": f"with {FREQ}, {QUOTES} select (case when read = 'high' then 'high' else 'low' end) || '-freq/' || (case when coalesce(score, 1) >= 4 then 'high' else 'low' end) || '-intensity' as quadrant, count(*) as clusters from freq left join intensity using (query) group by 1",
    "quote_validation": f"""with {E}, q as (select row_id, body, url, case row_id % 5 when 1 then upper(title) when 2 then 'indeed ' || title else title end as quote, case when row_id % 5 = 3 then 'ftp://elsewhere' else url end as u from e where title is not null and url is not null),
      f as (select *, {_FOLD.format(c="body")} as hay, {_FOLD.format(c="quote")} as needle from q)
      select coalesce(case when needle = '' then 'empty quote' when len(string_split(needle, ' ')) > 15 then 'more than 15 words' when not starts_with(u, 'http') then 'no web address' when u <> url then 'not in cluster'
        when contains(hay, needle) then null when contains(lower(hay), lower(needle)) then 'case differs' else 'not verbatim' end, 'valid') as outcome, count(*) as n from f group by 1""",
    "field_completeness": f"with {E} select source, " + ", ".join(f"count({c}) as with_{c}" for c in ("id", "url", "text", "author", "community", "score", "query")) + " from e group by source",
    "skip_reasons": f"""with {E} select source, case when regexp_matches(lower(author), '_bot$') then 'bot' when score is null then 'no score reported' when score < 1 then 'below score floor'
      when captured_utc - created_utc between 0 and 172799 then 'fresh' else 'kept' end as reason, count(*) as n from e group by 1, 2""",
    "round_robin": f"with {E} select row_id, source, row_number() over (partition by source order by row_id) as turn from e",
    "top_comments": f"""with {E}, r as (select *, count(*) over (partition by url) as c, row_number() over (partition by url order by coalesce(score, 0) desc, row_id) as rank from e where url is not null)
      select url, rank, row_id from r where c > 3 and rank <= 3""",
    "url_slugs": f"""with {E}, u as (select row_id, {_U} as u from e where url is not null),
      s as (select row_id, u, substr(regexp_replace(regexp_replace(lower(regexp_replace(lower(regexp_extract(u, '^[^:]+://([^/?#]*)', 1)), '^www\\.', '') || regexp_extract(u, '^[^:]+://[^/?#]*([^?#]*)', 1)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 110) as s from u)
      select row_id, case when regexp_matches(u, '[?#]') then s || '-' || substr(sha1(u), 1, 6) else s end as slug from s""",
    "title_slugs": f"""with {E}, s as (select row_id, title, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as s from e where title is not null)
      select row_id, case when length(s) > 40 then substr(regexp_replace(substr(s, 1, 41), '-[^-]*$', ''), 1, 40) else s end as slug,
        case when {_WS.format(c="title")} = '' then 0 else len(string_split({_WS.format(c="title")}, ' ')) end as words from s""",
    "evidence_ids": f"with {E} select row_id, sha1(coalesce(source, '') || coalesce(url, '')) as plain, sha1(coalesce(source, '') || '|' || coalesce(url, '') || '|' || coalesce(title, '')) as piped from e",
    "vote_counts": f"with {E} select row_id, case when row_id % 4 in (0, 3) then abs(score) end as votes from e where score is not null",
    "theme_terms": f"with {E}, t as (select unnest({_TERMS.format(c='title', s=_ARR(STOP))}) as term from e where title is not null) select term, count(*) as n from t group by term having count(*) >= 3",
    "on_topic": f"""with {E}, t as (select query, body, {_TERMS.format(c='query', s=_ARR(STOP + ['rant', 'software', 'complaints', 'alternative']))} as terms from e where query is not null),
      h as (select query, list_filter(terms, lambda t: contains(lower(body), t)) as hits from t)
      select query, count(*) as n, count(*) filter (len(hits) >= 2 or len(list_filter(hits, lambda t: length(t) >= 5)) > 0) as on_topic from h group by query""",
    "personas": f"with {E} select query, coalesce(string_agg(distinct persona, ',' order by persona), '') as personas from e left join matrix m on m.cell_id = lower(e.cell_id) where query is not null and e.cell_id is not null group by query",
    "matrix_problems": """with p as (select cell_id, list_filter([case when len(queries) not between 3 and 6 then 'queries not 3 to 6' end, case when not regexp_matches(cell_id, '^m[0-9]{2}$') then 'cell id' end,
      case when coalesce(trim(persona), '') = '' then 'persona blank' end, case when len(subreddits) > 1 then 'several communities' end], lambda x: x is not null) as bad from matrix)
      select cell_id, coalesce(array_to_string(bad, '; '), '') as problems, len(bad) as n from p""",
    "batch_audit": """with n as (select batch_id, count(*) as arrived from evidence_sample group by 1)
      select b.batch_id, lower(trim(status)) as status, n_lines, coalesce(arrived, 0) as arrived, case when n_lines is null then 'not announced' when n_lines = coalesce(arrived, 0) then 'complete' else 'differs' end as outcome from capture_batch b left join n using (batch_id)""",
    "sources_of_urls": f"""with {E}, u as (select regexp_replace(url, '/$', '') as u, source from e where url is not null), a as (select u from u where source = 'reddit'), b as (select u from u where source = 'dialog')
      select 'both' as part, count(*) as urls from (select u from a intersect select u from b) union all select 'first only', count(*) from (select u from a except select u from b)""",
    "late_rows": """with e as (select received_at, case when captured_utc <= 0 then null when captured_utc >= 100000000000000000 then captured_utc // 1000000000 when captured_utc >= 100000000000000 then captured_utc // 1000000 when captured_utc >= 100000000000 then captured_utc // 1000 else captured_utc end as c from evidence_sample)
      select floor((epoch(date_trunc('second', received_at)) - c) / 86400)::bigint as days, count(*) as n from e group by 1 having days >= 1""",
}
