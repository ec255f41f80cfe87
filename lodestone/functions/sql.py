"""The library's functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name -> (parameters, type, body), all of them expressions that Spark inlines into the plan.
FUNCTIONS = {
    "cosine_distance": ("a array<double>, b array<double>", "double", "greatest(0D, 1 - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x))"),
    "canonical_url": ("u string", "string", "regexp_replace(lower(trim(u)), '/+$', '')"),
    "engagement_of": ("score bigint, comments bigint", "bigint", "case when score is not null or comments is not null then coalesce(score, 0) + coalesce(comments, 0) end"),
    "half_year": ("epoch bigint", "string", "concat(year(timestamp_seconds(epoch)), case when month(timestamp_seconds(epoch)) <= 6 then '-H1' else '-H2' end)"),
    "fold_quote": ("t string", "string", r"trim(regexp_replace(replace(translate(t, '‘’‚‛“”„‟–—‒―', '\'\'\'\'\"\"\"\"----'), '…', '...'), '\\s+', ' '))"),
    "word_count": ("t string", "int", r"case when trim(coalesce(t, '')) = '' then 0 else size(split(trim(regexp_replace(t, '\\s+', ' ')), ' ')) end"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to ``spark.sql`` for this session; returns their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {kind} return {body}")
    return sorted(FUNCTIONS)
