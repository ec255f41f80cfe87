"""Windows of the calendar, guards of measurement, saturation, and credit over journeys."""

from __future__ import annotations

from itertools import combinations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The vocabulary of supply curves in that of cards; limits of the saturation reading.
VOCABULARY = {"rising": "accelerating", "spike-and-fade": "spiky-episodic", "emerging": "emerging", "declining": "declining", "persistent-flat": "persistent-flat"}
SPARSE, MODERATE = 2, 6


def bucket_windows(spark, now: int, years: int, months: int, label: str) -> DataFrame:
    """Calendar windows of ``months`` months over ``years`` years up to the one in progress: ``(period, start_utc, end_utc, partial)``.

    ``label`` is H, Q or Y. The window that holds ``now`` is marked partial and is not complete before its end.
    """
    at = F.timestamp_seconds(F.lit(now))
    month = F.month(at) - 1 - (F.month(at) - 1) % months
    first = F.make_date(F.year(at), month + 1, F.lit(1))
    n = years * 12 // months
    one = spark.range(1).select(F.explode(F.sequence(F.lit(n), F.lit(0), F.lit(-1))).alias("back")).select(
        F.add_months(first, -F.col("back") * months).alias("s"), F.add_months(first, (1 - F.col("back")) * months).alias("e"), (F.col("back") == 0).alias("partial"))
    return one.select(period_label(F.col("s"), label).alias("period"), F.unix_timestamp(F.col("s").cast("timestamp")).alias("start_utc"), F.unix_timestamp(F.col("e").cast("timestamp")).alias("end_utc"), "partial")


def period_label(day: Column, label: str) -> Column:
    year = F.year(day).cast("string")
    if label == "Y":
        return year
    part = F.when(F.month(day) <= 6, 1).otherwise(2) if label == "H" else F.quarter(day)
    return F.concat(year, F.lit(f"-{label}"), part.cast("string"))


def measurement_failure(n: Column, total: Column, top: Column) -> Column:
    """Why a series has no shape at all: too few periods, too little in all, or nothing above two; null if it can have one."""
    return F.when(n < 3, "fewer than three periods").when(total < 10, "fewer than ten in all").when(top <= 2, "never above two")


def card_shape(supply: Column) -> Column:
    """The shape of a supply curve in the words of cards; null where nothing was measured."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in VOCABULARY.items() for x in kv]), supply)


def capped_coverage(coverage: Column, examined: Column, matches: Column, failed: Column) -> Column:
    """Good coverage is thin if fewer were examined than matched, or more than three in ten look-ups failed."""
    return F.when((coverage == "good") & ((matches > examined) | ((examined > 0) & (failed / examined > 0.3))), "thin").otherwise(coverage)


def saturation_read(on_domain: Column, surfaced: Column, measured: Column, gaps: Column) -> Column:
    """What the number of competitors on the subject says, with every caveat in the reading itself.

    ``measured`` is false if no source answered; ``gaps`` names sources that answered in part. No blended number enters.
    """
    base = (
        F.when((on_domain == 0) & (surfaced > 0), F.concat(F.lit("unknown: "), surfaced.cast("string"), F.lit(" surfaced, none on the subject")))
        .when(on_domain == 0, "none surfaced").when(on_domain <= SPARSE, "sparsely populated").when(on_domain <= MODERATE, "moderately saturated").otherwise("heavily saturated")
    )
    off = F.when((on_domain > 0) & (surfaced > on_domain), F.concat(F.lit(" ("), (surfaced - on_domain).cast("string"), F.lit(" off the subject)"))).otherwise("")
    floor = F.when(gaps != "", F.concat(F.lit("; a floor, incomplete: "), gaps)).otherwise("")
    return F.when(~measured, F.concat(F.lit("unknown: no source answered"), F.when(gaps != "", F.concat(F.lit(" ("), gaps, F.lit(")"))).otherwise(""))).otherwise(F.concat(base, off, floor))


def best_cell(rows: DataFrame, key: str, cells: str, values: DataFrame, cell: str, weight: str, value: str) -> DataFrame:
    """The value of the cell with most weight for every key whose array ``cells`` names several; never a mean. Keys without a known cell stay with null."""
    each = rows.select(key, F.explode_outer(cells).alias(cell)).distinct()
    j = each.join(values.select(cell, weight, value), cell, "left")
    return j.groupBy(key).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(F.col(weight), F.col(cell)))).alias(value), F.count(value).alias("known_cells"))


def shapley(journeys: DataFrame, channels: list[str]) -> DataFrame:
    """``(channel, credit)``: each channel's mean gain over all coalitions, the worth of a coalition being the journeys it covers.

    ``journeys`` has ``(channels array, n)``; they are counted by their set of channels first, so at most ``2 ** len(channels)``
    rows are left, and the sum over coalitions is one expression a channel.
    """
    sets = journeys.groupBy(F.array_sort(F.array_distinct(F.array_intersect("channels", F.array(*map(F.lit, channels))))).alias("s")).agg(F.sum("n").alias("n")).filter(F.size("s") > 0)
    worth = {}
    for k in range(len(channels) + 1):
        for c in combinations(channels, k):
            inside = F.array(*map(F.lit, c)) if c else F.array().cast("array<string>")
            worth[c] = F.sum(F.when(F.size(F.array_except("s", inside)) == 0, F.col("n")).otherwise(0))
    names = {c: f"w{i}" for i, c in enumerate(worth)}
    row = sets.agg(*[w.alias(names[c]) for c, w in worth.items()])
    m = len(channels)
    credit = []
    for ch in channels:
        rest = [c for c in channels if c != ch]
        gain = F.lit(0.0)
        for k in range(m):
            for c in combinations(rest, k):
                with_it = tuple(x for x in channels if x in c or x == ch)
                gain = gain + F.lit(factorial(k) * factorial(m - k - 1) / factorial(m)) * (F.col(names[with_it]) - F.col(names[c]))
        credit.append(F.struct(F.lit(ch).alias("channel"), F.coalesce(gain, F.lit(0.0)).alias("credit")))
    return row.select(F.explode(F.array(*credit)).alias("c")).select("c.channel", F.round("c.credit", 4).alias("credit"))


def last_but(events: DataFrame, user: str, order: list, channel: str, direct: str) -> DataFrame:
    """Per user the last channel that is not ``direct``; the last one if all are."""
    place = F.struct((F.col(channel) != direct).cast("int"), *[F.col(c) for c in order])
    return events.groupBy(user).agg(F.max_by(channel, place).alias(channel))


def running_oldest(rows: DataFrame, scope: str, at: str, page: int) -> DataFrame:
    """The cursor of every page of a scope that is read from the newest row backwards: the oldest time it has seen, and whether more can follow."""
    place = F.row_number().over(W.partitionBy(scope).orderBy(F.desc(at), "row_id"))
    paged = rows.filter(F.col(at).isNotNull()).withColumn("page", F.floor((place - 1) / page).cast("bigint"))
    p = paged.groupBy(scope, "page").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("oldest"))
    return p.withColumn("oldest_seen", F.min("oldest").over(W.partitionBy(scope).orderBy("page").rowsBetween(W.unboundedPreceding, 0))).withColumn("more", F.col("n") == page)
