"""Text expressions: slugs, phrases, quotes, counts hidden in prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\f]+", " "))


def slug(c: Column, most: int = 40) -> Column:
    """Lower-case words joined by hyphens, cut at a hyphen within ``most`` characters."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    short = F.regexp_replace(F.substring(s, 1, most + 1), "-[^-]*$", "")
    return F.when(F.length(s) > most, F.substring(short, 1, most)).otherwise(s)


def word_count(c: Column) -> Column:
    t = squeeze(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def fold_quote(c: Column) -> Column:
    """Typographic quotes, dashes and ellipses folded, blanks collapsed, case kept."""
    plain = F.translate(c, "‘’‚‛“”„‟–—‒―", "''''\"\"\"\"----")
    return squeeze(F.regexp_replace(plain, "…", "..."))


def canonical_phrase(title: Column, text: Column) -> Column:
    """The first sentence of title or text without tag and markup, at most 120 characters."""
    t = squeeze(F.coalesce(F.nullif(squeeze(title), F.lit("")), text))
    t = F.regexp_replace(t, r"^[\[(][^\])]{1,24}[\])] *[:-]? *", "")
    strip = F.regexp_replace(F.regexp_replace(t, "^[ \\t\"'`*_#>-]+", ""), "[ \\t\"'`*_#>-]+$", "")
    head = F.regexp_extract(strip, r"^(.*?[.!?;]) ", 1)
    pick = F.when(F.length(head) >= 25, head).otherwise(strip)
    pick = F.regexp_replace(pick, r"\.+$", "")
    cut = F.regexp_replace(F.substring(pick, 1, 120), " [^ ]*$", "")
    return F.when(F.length(pick) > 120, F.concat(F.regexp_replace(cut, "[ ,;:]+$", ""), F.lit("..."))).otherwise(pick)


def vote_count(c: Column) -> Column:
    """The number of votes a phrase like "1,024 points" reports; null for other units and abbreviated numbers."""
    unit = F.lower(F.regexp_extract(c, r"^\s*[0-9][0-9,]*\s*([A-Za-z]+)", 1))
    number = F.regexp_replace(F.regexp_extract(c, r"^\s*([0-9][0-9,]*)", 1), ",", "")
    return F.when(unit.isin("point", "points", "upvote", "upvotes", "vote", "votes", "like", "likes", "star", "stars"), number.try_cast("bigint"))


def with_scheme(c: Column) -> Column:
    return F.when(~c.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), F.concat(F.lit("https://"), c)).otherwise(c)


def url_slug(c: Column, most: int = 110) -> Column:
    """Host and path as a file name; six hex digits of the url's hash where a query or fragment was."""
    u = with_scheme(c)
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^[^:]+://([^/?#]*)", 1)), r"^www\.", "")
    path = F.regexp_extract(u, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    s = F.regexp_replace(F.regexp_replace(F.lower(F.concat(host, path)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    s = F.substring(s, 1, most)
    return F.when(u.rlike("[?#]"), F.concat(s, F.lit("-"), F.substring(F.sha1(u), 1, 6))).otherwise(s)


def prose_length(c: Column) -> Column:
    """Characters of a page without links, tags and markup."""
    t = F.regexp_replace(c, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"https?://[^ \n\t\r]+", "")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    return F.length(squeeze(F.regexp_replace(t, r"[#*_`>|=~-]+", "")))


def evidence_id(*parts: Column, sep: str = "") -> Column:
    """SHA-1 of the parts, missing ones as empty."""
    return F.sha1(F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def distinctive_terms(c: Column, stop: list[str], least: int = 4) -> Column:
    """Words of at least ``least`` letters that are no stop words, each once, in order."""
    words = F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*stop)))


def half_year(epoch: Column) -> Column:
    at = F.timestamp_seconds(epoch)
    return F.concat(F.year(at), F.when(F.month(at) <= 6, "-H1").otherwise("-H2"))
