"""Column expressions that bring dirty identifiers to one written form.

All of them stay inside the JVM and return null for null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[\s\p{Z}\p{Cc}\p{Cf}]+"
NOTHING = ("", "null", "none", "n/a", "na", "nan", "unknown", "undefined", "-")
GONE = NOTHING + ("[deleted]", "deleted", "[removed]", "removed")
REMOVAL_MARKS = ("removed", "deleted", "removedbymoderator", "deletedbyuser")
#: Query parameters that say how a link was shared, not what it points to.
TRACKING = r"^(utm_[a-z_]+|ref|ref_src|share_id|fbclid|gclid|si|source|context)(=.*)?$"


def squeezed(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, BLANKS, ""))


def canonical_id(c: Column) -> Column:
    """An identifier without blanks, scheme prefix and letter case; null if it was lost."""
    s = F.regexp_replace(squeezed(c), r"^(?:urn:)?[a-z][a-z0-9]*:", "")
    return F.when(~s.isin(*NOTHING), s)


def permalink(c: Column) -> Column:
    """A url without scheme, host prefix, fragment, tracking parameters and closing slash."""
    u = F.regexp_replace(squeezed(c), r"#.*$", "")
    u = F.regexp_replace(u, r"^(?:[a-z][a-z0-9+.-]*:)?//", "")
    u = F.regexp_replace(u, r"^(?:www|old|new|np|m|amp|mobile)\.", "")
    base = F.regexp_replace(F.regexp_replace(F.substring_index(u, "?", 1), r"/{2,}", "/"), r"/$", "")
    params = F.array_sort(
        F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    )
    full = F.when(u.contains("?"), F.concat_ws("?", base, F.nullif(F.array_join(params, "&"), F.lit("")))).otherwise(base)
    return F.when(~full.isin(*NOTHING), full)


def handle(c: Column, sigil: str) -> Column:
    """A handle without leading slash, its ``u/`` or ``r/`` sigil, blanks around it and letter case.

    Null for null, blank, placeholder and deleted handles.
    """
    s = F.lower(F.regexp_replace(c, rf"^{BLANKS}|{BLANKS}$", ""))
    s = F.regexp_replace(s, rf"^/?(?:{sigil}/)?", "")
    return F.when(~s.isin(*GONE), s)


def epoch_seconds(c: Column) -> Column:
    """Epoch in whole seconds whatever its unit; null if missing, zero or negative."""
    n = c.cast("bigint")
    return (
        F.when(n <= 0, None)
        .when(n >= 100_000_000_000_000_000, _div(n, 1_000_000_000))
        .when(n >= 100_000_000_000_000, _div(n, 1_000_000))
        .when(n >= 100_000_000_000, _div(n, 1_000))
        .otherwise(n)
    )


def _div(n: Column, by: int) -> Column:
    return F.call_function("div", n, F.lit(by))


def score_value(c: Column, low: int = -500, high: int = 60_000) -> Column:
    """A score inside the range that real scores have; null for placeholders."""
    return F.when(c.between(low, high), c.cast("bigint"))


def letters(c: Column) -> Column:
    """The letters and digits of a text in order, lower case, all else removed."""
    return F.regexp_replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]+", "")
