"""Counts over calendar periods: shape, coverage, censoring, and what may not be concluded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_year(period: Column) -> Column:
    """Periods per year, from how a label is written."""
    return F.when(period.contains("H"), 2.0).when(period.contains("Q"), 4.0).otherwise(1.0)


def cleaned(series: DataFrame) -> DataFrame:
    """One row per (query, source, period): of repeated periods the measured one with most hits. Null hits stay null."""
    key = [F.lower(F.trim("query")).alias("query"), F.lower(F.trim("source")).alias("source"), "period"]
    picked = F.max(F.struct("hits", "series_id")).alias("m")
    return series.groupBy(*key).agg(
        picked, F.min("start_utc").alias("start_utc"), F.max("end_utc").alias("end_utc"),
        F.coalesce(F.max("is_partial"), F.lit(False)).alias("partial"), F.max("is_censored").alias("censored"),
    ).select("query", "source", "period", F.col("m.hits").alias("hits"), "start_utc", "end_utc", "partial", "censored")


def _lists(s: DataFrame, group: list[str]) -> DataFrame:
    """One row per series with its usable counts in time order; a series has as many rows as periods."""
    usable = F.col("hits").isNotNull() & ~F.col("partial")
    rows = s.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.when(usable, F.struct("start_utc", "hits", "censored")))).alias("p"),
        F.count(F.lit(1)).alias("planned"), F.count_if(F.col("hits").isNull()).alias("failed"), F.sum("hits").alias("total_all"),
        F.max(per_year(F.col("period"))).alias("per_year"),
    )
    y = F.col("p.hits")
    return rows.withColumn("y", y).withColumn("n", F.size("y"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)


def _slope(y: Column, n: Column) -> Column:
    """OLS slope against 0..n-1 in closed form."""
    at = F.transform(y, lambda v, i: i.cast("double") * v)
    sxy = F.aggregate(at, F.lit(0.0), lambda s, x: s + x)
    mean_x, total = (n - 1) / 2, _sum(y)
    sxx = n * (n.cast("double") * n - 1) / 12
    return (sxy - mean_x * total) / sxx


def canonical_shapes(s: DataFrame, group: list[str] = ["query", "source"]) -> DataFrame:
    """``slope_pct`` a year, ``shape``, ``coverage``, half-over-half growth and notes of every series."""
    r = _lists(s, group)
    n, y, total = F.col("n"), F.col("y"), F.coalesce(_sum(F.col("y")), F.lit(0))
    r = r.withColumn("total", F.when(n > 0, total))
    mean = F.col("total") / n
    r = r.withColumn("slope_pct", F.when((n >= 2) & (mean > 0), F.round(_slope(y, n) * F.col("per_year") / mean * 100, 1)))
    half = F.floor(n / 2).cast("int")
    r = r.withColumn("first", _sum(F.slice("y", F.lit(1), half))).withColumn("last", F.when(half > 0, _sum(F.slice("y", n - half + 1, half))).otherwise(0))
    top = F.array_max("y")
    slope = F.col("slope_pct")
    shape = (
        F.when((n == 0) | (F.col("total") < 5), None)
        .when((n >= 4) & (top / F.col("total") > 0.5), "spiky-episodic")
        .when(slope.isNull(), "persistent-flat")
        .when((n >= 2) & (F.col("first") / F.col("total") <= 0.15) & (slope > 15), "emerging")
        .when(slope >= 60, "accelerating")
        .when(slope <= -20, "declining")
        .otherwise("persistent-flat")
    )
    share = F.col("failed") / F.col("planned")
    coverage = (
        F.when(n == 0, None)
        .when(F.col("total_all") <= 0, F.when(share <= 0.25, "none"))
        .when((F.col("total_all") < 20) | (share > 0.25), "thin")
        .otherwise("good")
    )
    growth = F.when((n >= 4) & (F.col("first") > 0), F.round((F.col("last") - F.col("first")) / F.col("first") * 100, 1))
    zero = F.size(F.filter("y", lambda v: v == 0))
    note = F.when((F.col("total") > 0) & (zero >= 0.3 * n), "intermittent")
    return r.select(*group, "planned", "n", "total", "slope_pct", shape.alias("shape"), coverage.alias("coverage"), growth.alias("half_growth"), note.alias("note"))


def supply_shapes(s: DataFrame, group: list[str] = ["query", "source"]) -> DataFrame:
    """Shape of what is offered: at least three measured periods, slope against their original places."""
    r = s.filter(~F.col("partial")).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("start_utc", "hits"))).alias("p"), F.count(F.lit(1)).alias("planned"))
    r = r.withColumn("xy", F.filter(F.transform(F.col("p.hits"), lambda v, i: F.struct(i.cast("double").alias("x"), v.alias("v"))), lambda t: t["v"].isNotNull()))
    r = r.withColumn("y", F.col("xy.v")).withColumn("n", F.size("xy"))
    n = F.col("n")
    r = r.withColumn("total", _sum(F.col("y")))
    add = lambda f: F.aggregate(F.transform("xy", f), F.lit(0.0), lambda a, b: a + b)
    sx, sxx, sxy = add(lambda t: t["x"]), add(lambda t: t["x"] * t["x"]), add(lambda t: t["x"] * t["v"])
    slope = (n * sxy - sx * F.col("total")) / (n * sxx - sx * sx)
    r = r.withColumn("slope_pct", F.when(n < 3, None).when(F.col("total") == 0, 0.0).otherwise(F.round(100 * slope / (F.col("total") / n), 1)))
    half = F.floor(n / 2).cast("int")
    first, peak = _sum(F.slice("y", F.lit(1), half)), F.array_position("y", F.array_max("y")) - 1
    top, last, start = F.array_max("y"), F.element_at("y", -1), F.element_at("y", 1)
    shape = (
        F.when(n < 3, "insufficient-data")
        .when(F.col("total") == 0, "no-signal")
        .when((first == 0) & (F.col("total") - first > 0), "emerging")
        .when((peak > 0) & (peak < n - 1) & (last <= 0.5 * top) & (start <= 0.8 * top), "spike-and-fade")
        .when(F.col("slope_pct") >= 15, "rising")
        .when(F.col("slope_pct") <= -15, "declining")
        .otherwise("persistent-flat")
    )
    coverage = (
        F.when(n == 0, "none").when((n < F.col("planned")) | (n < 3), "thin").when(F.col("total") == 0, "good").when(F.col("total") < 10, "thin").otherwise("good")
    )
    return r.filter("planned > 0").select(*group, "n", F.when(n > 0, F.col("total")).alias("total"), "slope_pct", shape.alias("shape"), coverage.alias("coverage"))


def censored(s: DataFrame, group: list[str] = ["query", "source"]) -> DataFrame:
    """Series whose counts are floors: the censored share, and whether a shape may be read at all."""
    usable = F.col("hits").isNotNull() & ~F.col("partial")
    r = s.groupBy(*group).agg(F.count_if(usable).alias("usable"), F.count_if(usable & F.col("censored")).alias("floors"), F.count_if(F.col("censored").isNull()).alias("unknown"))
    share = F.col("floors") / F.col("usable")
    verdict = F.when(F.col("usable") < 2, "one period").when(share > 0.5, "shape withheld").when(F.col("floors") > 0, "lower bound").otherwise("as counted")
    return r.withColumn("verdict", verdict)


def combined(s: DataFrame) -> DataFrame:
    """Per query and period the sum over sources; null only if none measured; complete only if all did."""
    r = s.groupBy("query", "period").agg(F.sum("hits").alias("hits"), F.count("hits").alias("answered"), F.count(F.lit(1)).alias("asked"))
    return r.withColumn("complete", F.when(F.col("answered") == F.col("asked"), F.col("hits")))


def sparkline(s: DataFrame, group: list[str] = ["query", "source"]) -> DataFrame:
    """A line of marks per series: ``?`` not measured, a dot for zero, eight heights of its own maximum, ``+`` a floor."""
    r = s.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("start_utc", "hits", "censored"))).alias("p"), F.max("hits").alias("top"))
    ramp = F.array(*map(F.lit, "▁▂▃▄▅▆▇█"))
    height = lambda v: F.least(F.lit(8), F.floor(v * 8 / F.col("top")).cast("int") + 1)
    mark = lambda t: F.concat(F.when(t["hits"].isNull(), "?").when(t["hits"] == 0, "·").otherwise(F.element_at(ramp, height(t["hits"]))), F.when(t["censored"], "+").otherwise(""))
    return r.select(*group, F.array_join(F.transform("p", mark), "").alias("line"))


def headline(shapes: DataFrame) -> DataFrame:
    """The series that speaks for a query: best coverage; no shape if the best ones contradict each other."""
    rank = F.when(F.col("coverage") == "good", 3).when(F.col("coverage") == "thin", 2).when(F.col("coverage") == "none", 1).otherwise(0)
    r = shapes.withColumn("rank", rank)
    best = r.groupBy("query").agg(F.max("rank").alias("rank"))
    j = r.join(best, ["query", "rank"])
    return j.groupBy("query", "rank").agg(F.count(F.lit(1)).alias("series"), F.count_distinct("shape").alias("shapes"), F.max("shape").alias("s")).select(
        "query", "rank", "series", F.when(F.col("shapes") == 1, F.col("s")).alias("shape")
    )
