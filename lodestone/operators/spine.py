"""From staged captures to cited quotes: merging, lineage, resolution by url, mapping of foreign records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..runtime import cut, skew_join

#: Names of sources as callers write them, and as records carry them.
ALIASES = {
    "google_trends": "google_trends", "googletrends": "google_trends", "trends": "google_trends", "google_news": "google_news", "googlenews": "google_news", "news": "google_news",
    "github_trending": "github", "githubtrending": "github", "hn": "hackernews", "hacker_news": "hackernews", "so": "stackoverflow", "stack_overflow": "stackoverflow",
    "ph": "producthunt", "product_hunt": "producthunt", "dev_to": "devto", "stackexchange": "stackoverflow",
}
ENUM = ["reddit", "hackernews", "stackoverflow", "producthunt", "github", "pypi", "npm", "wikipedia", "google-trends", "dialog"]
#: Statuses by which an origin refuses.
BLOCKING = [401, 402, 403, 407, 408, 409, 429, 451]
ANONYMOUS = ["", "none", "[deleted]", "[removed]", "u/[deleted]", "u/[removed]", "deleted", "removed", "automoderator", "u/automoderator"]
COST = ["money_loss", "time_quantified", "workaround_built", "abandonment"]
MOST_WORDS, MOST_EXEMPLARS = 15, 6


def merged(existing: DataFrame, staged: DataFrame, sources: list[str]) -> tuple[DataFrame, DataFrame]:
    """Existing and staged rows ``(source, id, row_id)`` as one row per source and id, and a report per source.

    What exists wins, then the first staged row, so merging twice changes nothing. Rows of sources that are not listed are reported and
    not merged; rows without id are counted and left out. Only id, source and position are shuffled.
    """
    both = existing.select("source", "id", "row_id", F.lit(0).alias("turn")).unionByName(staged.select("source", "id", "row_id", F.lit(1).alias("turn")))
    known = F.col("source").isin(*sources)
    one = both.filter(known & F.col("id").isNotNull()).groupBy("source", "id").agg(F.min(F.struct("turn", "row_id")).alias("first"))
    kept = one.select("source", "id", F.col("first.row_id").alias("row_id"), (F.col("first.turn") == 1).alias("added"))
    counts = both.groupBy(F.coalesce("source", F.lit("?")).alias("source")).agg(
        F.count_if(F.col("turn") == 0).alias("existing"), F.count_if(F.col("turn") == 1).alias("staged"), F.count_if(F.col("id").isNull()).alias("without_id")
    )
    written = kept.groupBy("source").agg(F.count(F.lit(1)).alias("written"), F.count_if("added").alias("added"))
    report = counts.join(written, "source", "left").withColumn("status", F.when(F.coalesce(F.col("source").isin(*sources), F.lit(False)), "merged").otherwise("not merged: unknown source"))
    return kept, report.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("written", "added")})


def lineage(e: DataFrame) -> DataFrame:
    """``(kept_row_id, row_id, by)``: every row that a kept row stands for, one row each, and the pass that dropped it.

    First rows with the same id, then rows with the same url and text, blanks and case aside, where a url is there. No list is ever built, so a text with most of the rows
    is as good as any; the wide text is hashed before it moves.
    """
    text = F.lower(F.regexp_replace(F.trim(F.coalesce("text", F.lit(""))), r"[ \t\n\r]+", " "))
    content = F.when(F.col("url").isNotNull(), F.sha1(F.concat("url", F.lit("\n"), text)))
    rows = cut(e.select("row_id", "id", content.alias("content")), "lineage")
    n = rows.count()
    by_id = rows.filter("id is not null").groupBy("id").agg(F.min("row_id").alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = cut(skew_join(rows.select("row_id", "id").filter("id is not null"), by_id, ["id"], "n", n).filter("row_id <> kept").select("row_id", "kept"), "lineage-ids")
    left = cut(rows.join(first.select("row_id"), "row_id", "left_anti"), "lineage-left")
    by_content = left.filter("content is not null").groupBy("content").agg(F.min("row_id").alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    second = cut(skew_join(left.select("row_id", "content").filter("content is not null"), by_content, ["content"], "n", n).filter("row_id <> kept").select("row_id", "kept"), "lineage-contents")
    # A row dropped by id follows its keeper if that was dropped by content.
    onward = first.join(second.select(F.col("row_id").alias("kept"), F.col("kept").alias("final")), "kept", "left")
    return onward.select(F.coalesce("final", "kept").alias("kept_row_id"), "row_id", F.lit("id").alias("by")).unionByName(second.select(F.col("kept").alias("kept_row_id"), "row_id", F.lit("content").alias("by")))


def resolved(quotes: DataFrame, records: DataFrame) -> DataFrame:
    """Quotes ``(cluster, marker, quote, url, recurring)`` with ``problem`` (null if sound), ``author`` and ``words``.

    A quote is looked for in the record of its cluster that stands behind its url, closing slash aside; of several records with one url the last counts. The author comes from
    the record, never from the quote, and is null if it identifies nobody. One record per cluster and url is kept before the
    join, and urls with many quotes are broadcast.
    """
    bare = F.regexp_replace(F.col("url"), "/+$", "")
    last = records.filter("url is not null and cluster is not null").groupBy("cluster", bare.alias("u")).agg(F.max("row_id").alias("row_id"))
    index = last.join(records.select("row_id", "body", F.col("author").alias("_author")), "row_id").select("cluster", "u", F.col("row_id").alias("found"), "body", "_author")
    asked = cut(quotes.withColumn("u", bare), "quotes")
    weight = asked.groupBy("cluster", "u").agg(F.count(F.lit(1)).alias("_n"))
    index = cut(index.join(weight, ["cluster", "u"]), "quote-index")
    hit = skew_join(asked, index, ["cluster", "u"], "_n", asked.count())
    missed = asked.join(index.select("cluster", "u"), ["cluster", "u"], "left_anti")
    j = hit.unionByName(missed, allowMissingColumns=True)
    hay, needle = tx.fold_quote(F.col("body")), tx.fold_quote(F.col("quote"))
    words = tx.word_count(F.coalesce("quote", F.lit("")))
    problem = (
        F.when(F.coalesce(needle, F.lit("")) == "", "empty").when(words > MOST_WORDS, "too long").when(~F.coalesce(F.col("url").startswith("http"), F.lit(False)), "no permalink")
        .when(F.col("found").isNull(), "not in cluster").when(hay.contains(needle), None).when(F.lower(hay).contains(F.lower(needle)), "case differs").otherwise("not verbatim")
    )
    author = F.when(~F.lower(F.trim("_author")).isin(*ANONYMOUS), F.trim("_author"))
    return j.select("cluster", "marker", "quote", "url", "recurring", problem.alias("problem"), author.alias("author"), words.alias("words"))


def all_or_nothing(verdicts: DataFrame, markers: list[str]) -> DataFrame:
    """Per cluster whether all of its quotes are sound; nothing of a cluster counts if one is not, or a marker is unknown."""
    unknown = ~F.col("marker").isin(*markers)
    v = verdicts.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("quotes"), F.count_if(F.col("problem").isNotNull()).alias("rejected"), F.count_if(unknown).alias("unknown_markers"),
        F.count_if(F.col("problem").isNull() & F.col("author").isNull()).alias("anonymous"), F.count_if(F.col("recurring") & ~F.col("marker").isin(*COST)).alias("recurring_ignored"),
    )
    return v.withColumn("accepted", (F.col("rejected") == 0) & (F.col("unknown_markers") == 0))


def exemplars(verdicts: DataFrame, most: int = MOST_EXEMPLARS) -> DataFrame:
    """Up to ``most`` sound quotes of each cluster, cost markers first, then buyers, the same words once."""
    rank = F.when(F.col("marker").isin(*COST), 0).when(F.col("marker") == "complainer_is_buyer", 1).otherwise(2)
    sound = verdicts.filter("problem is null").select("cluster", F.lower(tx.fold_quote(F.col("quote"))).alias("key"), F.struct(rank.alias("rank"), "quote", "url").alias("q"))
    once = sound.groupBy("cluster", "key").agg(F.min("q").alias("q"))
    place = F.row_number().over(W.partitionBy("cluster").orderBy("q.rank", "q.quote", "q.url"))
    return once.withColumn("place", place.cast("bigint")).filter(F.col("place") <= most).select("cluster", "place", "q.quote", "q.url")


def source_of(name: Column) -> Column:
    """A source as records carry it, from any spelling of it."""
    key = F.replace(F.lower(F.trim(name)), F.lit("-"), F.lit("_"))
    known = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), key), key)
    return F.replace(known, F.lit("_"), F.lit("-"))


def first_string(meta: Column, keys: list[str]) -> Column:
    """The first non-blank string under ``keys`` of a JSON object; a list counts as its first five entries joined."""
    out = []
    for key in keys:
        raw = F.get_json_object(meta, f"$.{key}")
        listed = F.from_json(raw, "array<string>")
        joined = F.array_join(F.filter(F.transform(F.slice(listed, 1, 5), F.trim), lambda x: x != ""), ", ")
        out.append(F.nullif(F.when(F.trim(raw).startswith("[") & listed.isNotNull() & (F.size(F.filter(listed, lambda x: x.isNotNull())) > 0), joined).otherwise(F.trim(raw)), F.lit("")))
    return F.coalesce(*out)


def first_number(meta: Column, keys: list[str]) -> Column:
    """The first whole number under ``keys``, written as one or as digits; true and false are none."""
    return F.coalesce(*[F.when(F.trim(F.get_json_object(meta, f"$.{key}")).rlike("^-?[0-9]+$"), F.trim(F.get_json_object(meta, f"$.{key}")).cast("bigint")) for key in keys])


def mapped(items: DataFrame, most: int = 4000) -> DataFrame:
    """Foreign items ``(row_id, provider, keyword, url, traffic, published, meta)`` as evidence records.

    Engagement is null where neither votes nor comments are reported, never zero. A url is derived for one provider only, from the number that it
    gives. The id covers source, url and title, so it stays the same over runs.
    """
    meta, provider = F.col("meta"), F.lower(F.trim("provider"))
    source = source_of(provider)
    number = F.trim(F.get_json_object(meta, "$.id"))
    url = F.coalesce(F.nullif(F.trim("url"), F.lit("")), F.when((provider == "hackernews") & number.rlike("^[0-9]+$"), F.concat(F.lit("https://news.ycombinator.com/item?id="), number)))
    title = F.nullif(F.trim("keyword"), F.lit(""))

    def prefixed(c, sigil):
        return F.when((provider == "reddit") & ~c.startswith(sigil), F.concat(F.lit(sigil), c)).otherwise(c)

    score, comments = tx.vote_count(F.col("traffic")), first_number(meta, ["comments", "num_comments"])
    return items.select(
        "row_id", F.sha1(F.concat_ws("|", source, F.coalesce(url, F.lit("")), F.coalesce(title, F.lit("")))).alias("id"), source.alias("source"), url.alias("url"), title.alias("title"),
        F.substring(first_string(meta, ["text", "selftext"]), 1, most).alias("text"), prefixed(first_string(meta, ["author", "by"]), "u/").alias("author"),
        prefixed(first_string(meta, ["subreddit", "tags"]), "r/").alias("community"), F.when(score.isNotNull() | comments.isNotNull(), F.struct(score.alias("score"), comments.alias("comments"))).alias("engagement"),
    )


def error_kind(detail: Column) -> Column:
    """What a failed request says: its status and whether trying again is of no use."""
    code = F.regexp_extract(detail, r"\b([1-5][0-9]{2})\b", 1)
    return F.when(detail.isNull(), None).when(code.isin("401", "403", "404", "410", "451"), F.concat(F.lit("terminal "), code)).when(code.isin("408", "425", "429", "500", "502", "503", "504"), F.concat(F.lit("retry "), code)).when(
        F.lower(detail).rlike("timed? ?out|timeout"), "retry timeout").when(F.lower(detail).rlike("connect|dns|resolve"), "retry connection").otherwise("unclassified")


def refused(statuses: Column) -> Column:
    """The statuses by which an origin refused or failed, each once, in order."""
    return F.array_sort(F.array_distinct(F.filter(statuses, lambda s: s.isin(*BLOCKING) | (s >= 500))))


def communities(listed: Column) -> Column:
    """A list of communities as people type it: split at commas and blanks, without sigil, each once in the order given."""
    parts = F.transform(F.split(listed, r"[,\s]+"), lambda x: F.regexp_replace(x, "^/?[rR]/", ""))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))
