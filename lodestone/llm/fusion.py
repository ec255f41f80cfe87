"""The best representative of each post: truth discovery over its captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normal import canonical_id, epoch_seconds, permalink, score_value, squeezed
from ..operators.graph import connected_components
from ..runtime import cut, drop, key128, skew_join, table

#: Up to so many sources, a name and a number each, are broadcast to the votes; more are shuffled.
MOST_SOURCES = 10_000
FIELDS = ("cell_id", "score", "captured_utc")


def posts(rows: DataFrame, extra: tuple = ()) -> DataFrame:
    """``(row_id, *extra, post, n)`` of the rows whose post was captured at least twice.

    Rows capture one post if they have the same identifier, or the same permalink
    and creation time, however written, over any number of steps. ``post`` is the
    smallest row_id of the group and ``n`` its size. Rows with neither identifier
    nor permalink are a post by themselves and left out, as are all other posts
    with a single row. Identifier groups and permalink groups are aggregated
    first; only groups that differ in their first row become edges.
    """
    narrow = rows.select("row_id", *extra, canonical_id(F.col("id")).alias("_id"), permalink(F.col("url")).alias("_link"), "created_utc")
    at = F.coalesce(F.col("created_utc").cast("string"), F.lit("?"))
    by_id, by_link = key128(F.lit("id"), F.col("_id")), key128(F.lit("link"), F.col("_link"), at)
    names = ("hi", "lo")
    nodes = F.array(
        *[F.when(there.isNotNull(), F.struct(*[k.alias(n) for n, k in zip(names, keys)])) for there, keys in ((F.col("_id"), by_id), (F.col("_link"), by_link))]
    )
    keyed = cut(narrow.select("row_id", *extra, F.array_compact(nodes).alias("nodes")), "capture-nodes")
    ends = keyed.select("row_id", F.explode("nodes").alias("k")).select("row_id", "k.hi", "k.lo")
    firsts = ends.groupBy("hi", "lo").agg(F.min("row_id").alias("first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    firsts = cut(firsts, "capture-firsts")
    linked = skew_join(ends, firsts, ["hi", "lo"], "_n", keyed.count()).select("row_id", "first")
    linked = cut(linked, "capture-links")
    # A row is tied to the first row of each of its groups; rows between those firsts are the edges.
    reach = linked.groupBy("row_id").agg(F.min("first").alias("a"), F.max("first").alias("b"))
    reach = cut(reach, "capture-reach")
    labels = connected_components(reach.filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    sizes = reach.groupBy("a").agg(F.count(F.lit(1)).alias("_n"))
    named = sizes.join(labels.withColumnRenamed("node", "a"), "a", "left").select("a", "_n", F.coalesce("component", "a").alias("post"))
    named = cut(named, "capture-names")
    whole = named.groupBy("post").agg(F.sum("_n").alias("n"))
    named = named.join(whole, "post")
    member = skew_join(reach.select("row_id", "a"), named, ["a"], "_n", reach.count()).select("row_id", "post", "n")
    member = member.filter("n > 1")
    return keyed.select("row_id", *extra).join(member, "row_id")


def discover(claims: DataFrame, rounds: int = 40, tolerance: float = 0.01) -> tuple[DataFrame, DataFrame, dict]:
    """Truth discovery over ``(post, source, field, value, latest)`` claims.

    Starting with equal reliabilities, every round lets the sources vote for the values of
    each (post, field) with their reliability as weight, takes the value with most support
    (then the latest, then the smallest value), and sets the reliability of a source to
    ``-log`` of its smoothed share of lost claims, until none moves by more
    than ``tolerance``. From the ninth round on the mean of the old and the new reliability is taken, so that votes that swing come to rest. Claims that repeat
    are one claim with a count. Null values are no claims. Returns ``(post, field, value, support, voters)`` with
    one row per claimed field, ``(source, reliability)``, and how it ended: ``rounds``, ``settled`` and the last ``moved``.
    """
    tally = claims.filter("value is not null").groupBy("post", "field", "value", "source").agg(
        F.count(F.lit(1)).alias("n"), F.max("latest").alias("latest")
    )
    tally = cut(tally, "claims")
    trust = tally.select("source").distinct().withColumn("reliability", F.lit(1.0))
    trust = cut(trust, "trust")

    def vote(current: DataFrame) -> DataFrame:
        # One row a source: the sources are few, and a hot one must not meet in one task.
        support = tally.join(F.broadcast(current) if few else current, "source").groupBy("post", "field", "value").agg(
            F.round(F.sum(F.col("n") * F.col("reliability")), 9).alias("support"), F.sum("n").alias("voters"), F.max("latest").alias("latest")
        )
        ahead = F.struct((-F.col("support")).alias("support"), (-F.coalesce("latest", F.lit(-1))).alias("latest"), "value", "voters")
        best = support.groupBy("post", "field").agg(F.min(ahead).alias("best"))
        return best.select("post", "field", "best.value", (-F.col("best.support")).alias("support"), "best.voters")

    few = trust.count() <= MOST_SOURCES
    ended = {"rounds": 0, "settled": False, "moved": None}
    for k in range(rounds):
        lost = (
            tally.join(vote(trust).select("post", "field", F.col("value").alias("truth")), ["post", "field"])
            .groupBy("source")
            .agg(((F.sum(F.when(F.col("value") != F.col("truth"), F.col("n")).otherwise(0)) + 0.5) / (F.sum("n") + 1.0)).alias("error"))
        )
        former = trust.withColumnRenamed("reliability", "former")
        share = 1.0 if k < 8 else 0.5
        following = lost.join(former, "source").select("source", F.round(F.lit(share) * -F.log("error") + F.lit(1 - share) * F.col("former"), 6).alias("reliability"))
        following = cut(following, "trust")
        moved = following.join(former, "source").agg(F.max(F.abs(F.col("reliability") - F.col("former")))).first()[0]
        drop(trust)
        trust = following
        ended = {"rounds": k + 1, "settled": moved is None or moved <= tolerance, "moved": moved}
        if ended["settled"]:
            break
    return vote(trust), trust, ended


def fused_posts(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """One surviving record per post that has two or more rows.

    ``first_row_id`` is the smallest row of the post. ``best_row_id`` is the row with the
    most reported values among cell_id (names a cell of ``cells``), score (not
    null, no placeholder) and captured_utc (positive), then the latest capture in
    whole seconds (unreported first), then the smallest row_id. ``cell_id``,
    ``score`` and ``captured_utc`` hold the value of each field with most support
    after truth discovery with the rows' ``source`` as sources; null if no row reports one.
    """
    known = cells.select(squeezed(F.col("cell_id")).alias("cell"), F.col("cell_id").alias("known")).distinct()
    flat = rows.select(
        "row_id", "id", "url", "created_utc", F.coalesce(F.lower(F.trim("source")), F.lit("?")).alias("source"),
        squeezed(F.col("cell_id")).alias("cell"), score_value(F.col("engagement.score")).alias("score"), epoch_seconds(F.col("captured_utc")).alias("captured"),
    )
    grouped = posts(flat, ("source", "cell", "score", "captured"))
    grouped = cut(grouped.join(known, "cell", "left"), "captures")
    reported = sum(F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in ("known", "score", "captured"))
    rank = F.struct(reported, F.coalesce("captured", F.lit(-1)), -F.col("row_id"))
    records = grouped.groupBy(F.col("post").alias("first_row_id")).agg(F.max_by("row_id", rank).alias("best_row_id"), F.count(F.lit(1)).alias("n_rows"))
    claims = grouped.select(
        "post", "source", F.col("captured").alias("latest"),
        F.explode(F.create_map(*[x for name, c in zip(FIELDS, ("known", "score", "captured")) for x in (F.lit(name), F.col(c).cast("string"))])).alias("field", "value"),
    )
    values, _, _ = discover(claims)
    wide = values.groupBy(F.col("post").alias("first_row_id")).agg(
        *[F.max(F.when(F.col("field") == name, F.col("value"))).alias(name) for name in FIELDS],
        F.max(F.when(F.col("field") == "cell_id", F.col("voters"))).alias("cell_voters"),
    )
    return records.join(wide, "first_row_id", "left").select(
        "first_row_id", "best_row_id", "n_rows", "cell_id", F.col("score").cast("bigint").alias("score"),
        F.col("captured_utc").cast("bigint").alias("captured_utc"), "cell_voters",
    )


def p1_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One surviving record per post, with its fused fields."""
    return fused_posts(table(spark, sf_dir, "evidence_sample"), table(spark, sf_dir, "matrix"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best row of every post with two or more rows."""
    return p1_posts(spark, sf_dir).select("first_row_id", "best_row_id")


QUERIES = {"p1_found": p1_found, "p1_posts": p1_posts}

_SQUEEZE = r"lower(regexp_replace({c}, '[\s\p{{Z}}\p{{Cc}}\p{{Cf}}]+', '', 'g'))"
_ID = f"regexp_replace({_SQUEEZE.format(c='id')}, '^(?:urn:)?[a-z][a-z0-9]*:', '')"
_BASE = rf"regexp_replace(regexp_replace(regexp_replace({_SQUEEZE.format(c='url')}, '#.*$', ''), '^(?:[a-z][a-z0-9+.-]*:)?//', ''), '^(?:www|old|new|np|m|amp|mobile)\.', '')"
_KEPT = r"list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_[a-z_]+|ref|ref_src|share_id|fbclid|gclid|si|source|context)(=.*)?$'))"
#: Rounds of taking the smallest label over equal identifiers and over equal permalinks.
_ROUNDS = "".join(
    f", a{i} as (select *, min(l{i}) over (partition by coalesce(cid, 'r' || row_id)) as m{i} from b{i}), b{i + 1} as (select *, min(m{i}) over (partition by coalesce(link, 'r' || row_id), created_utc) as l{i + 1} from a{i})"
    for i in range(5)
)
_POSTS = rf"""raw as (
      select *, case when {_ID} not in ('', 'null', 'none', 'n/a', 'na', 'nan', 'unknown', 'undefined', '-') then {_ID} end as cid, {_BASE} as u from evidence_sample),
    b0 as (select row_id, cid, created_utc, cell_id, engagement, captured_utc, row_id as l0, regexp_replace(regexp_replace(split_part(u, '?', 1), '/{{2,}}', '/', 'g'), '/$', '')
      || case when len({_KEPT}) > 0 then '?' || array_to_string(list_sort({_KEPT}), '&') else '' end as link from raw){_ROUNDS},
    r as (select row_id, l5 as post, case when captured_utc <= 0 then null when captured_utc >= 100000000000000 then captured_utc // 1000000 when captured_utc >= 100000000000 then captured_utc // 1000 else captured_utc end as taken,
      (lower(trim(cell_id)) in (select cell_id from matrix))::int as cell, (engagement.score between -500 and 60000)::int as score from b5)"""
_BEST = """k as (select *, count(*) over (partition by post) as n, row_number() over (partition by post order by coalesce(cell, 0) + coalesce(score, 0) + (taken is not null)::int desc, coalesce(taken, -1) desc, row_id) as rk from r)"""


def _rounds(n: int) -> str:
    """Rounds of voting and of judging sources, as ``discover`` has them; a round after the last that moved anything repeats it."""
    out = ["t0 as (select distinct source, 1.0::double as reliability, false as done from tally)"]
    vote = """select post, field, value, support, voters from (select *, row_number() over (partition by post, field order by support desc, coalesce(latest, -1) desc, value) as rk
        from (select post, field, value, round(sum(n * reliability), 9) as support, sum(n)::bigint as voters, max(latest) as latest from tally join t{i} using (source) group by 1, 2, 3)) where rk = 1"""
    for i in range(n):
        share = 1.0 if i < 8 else 0.5
        out.append(f"v{i} as ({vote.format(i=i)})")
        out.append(f"l{i} as (select source, (sum(case when a.value <> v.value then n else 0 end) + 0.5) / (sum(n) + 1.0) as error from tally a join v{i} v using (post, field) group by 1)")
        out.append(f"n{i} as (select source, t.reliability as former, t.done, case when t.done then t.reliability else round({share}::double * -ln(error) + {1 - share}::double * t.reliability, 6) end as reliability from l{i} join t{i} t using (source))")
        out.append(f"t{i + 1} as (select source, reliability, done or max(abs(reliability - former)) over () <= 0.01 as done from n{i})")
    return ", ".join(out) + f", truth as ({vote.format(i=n)})"


ORACLES = {
    "p1_found": f"with {_POSTS}, {_BEST} select post as first_row_id, row_id as best_row_id from k where n > 1 and rk = 1",
    "p1_posts": f"""with {_POSTS}, {_BEST}, g as (select post, row_id, n from k where n > 1),
    src as (select e.row_id, coalesce(lower(trim(source)), '?') as source, (select max(cell_id) from matrix m where m.cell_id = {_SQUEEZE.format(c="e.cell_id")}) as known, case when engagement.score between -500 and 60000 then engagement.score end as score,
      case when captured_utc <= 0 then null when captured_utc >= 100000000000000 then captured_utc // 1000000 when captured_utc >= 100000000000 then captured_utc // 1000 else captured_utc end as captured from evidence_sample e),
    cl as (select post, source, captured as latest, unnest(['cell_id', 'score', 'captured_utc']) as field, unnest([known, score::varchar, captured::varchar]) as value from g join src using (row_id)),
    tally as (select post, field, value, source, count(*) as n, max(latest) as latest from cl where value is not null group by 1, 2, 3, 4), {_rounds(12)}
    select post as first_row_id, k.row_id as best_row_id, n as n_rows, max(value) filter (field = 'cell_id') as cell_id, max(value) filter (field = 'score')::bigint as score, max(value) filter (field = 'captured_utc')::bigint as captured_utc,
      max(voters) filter (field = 'cell_id') as cell_voters from k left join truth using (post) where n > 1 and rk = 1 group by 1, 2, 3""",
}
