"""Exactly one copy of each message that was delivered at least once.

Only identifiers, the order of delivery and the position of the row in its file
are shuffled. The losing positions become deletion vectors, one per data file,
which are applied while the wide payload is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normal import canonical_id, permalink
from ..runtime import cut, key128, skew_join
from .positions import FILE, POS, position_filter, scan_with_positions, write_positions


def message_keys(rows: DataFrame, order: str = "row_id", extra: tuple = ()) -> DataFrame:
    """``(order, key_hi, key_lo, *extra)``: the message each row belongs to.

    Rows with the same identifier, however written, are one message. A row whose
    identifier was lost belongs to the message with its permalink and creation
    time; if several messages have these, to the one delivered first; if none
    has, the lost rows with one permalink and time are a message of their own. A
    row with neither identifier nor permalink is a message by itself. A missing
    creation time is a value like any other.
    """
    narrow = rows.select(
        order, *extra, canonical_id(F.col("id")).alias("_id"), permalink(F.col("url")).alias("_link"), F.col("created_utc").alias("_at")
    )
    by_id = key128(F.lit("id"), F.col("_id"))
    at = F.coalesce(F.col("_at").cast("string"), F.lit("?"))
    by_link = key128(F.lit("link"), F.col("_link"), at)
    alone = key128(F.lit("row"), F.col(order))
    keyed = narrow.select(
        order,
        *extra,
        F.col("_id").isNull().alias("_lost"),
        *[F.when(F.col("_id").isNotNull(), i).when(F.col("_link").isNotNull(), l).otherwise(a).alias(n)
          for n, i, l, a in zip(("key_hi", "key_lo"), by_id, by_link, alone)],
        *[F.when(F.col("_link").isNotNull(), l).alias(n) for n, l in zip(("link_hi", "link_lo"), by_link)],
    )
    keyed = cut(keyed, "messages")
    lost_links = keyed.filter("_lost and link_hi is not null").select("link_hi", "link_lo").distinct()
    owner = (
        keyed.filter("not _lost")
        .join(lost_links, ["link_hi", "link_lo"], "left_semi")
        .groupBy("link_hi", "link_lo")
        .agg(F.min_by(F.struct("key_hi", "key_lo"), order).alias("_owner"))
    )
    lost = keyed.filter("_lost").join(owner, ["link_hi", "link_lo"], "left")
    lost = lost.select(order, *extra, *[F.coalesce(F.col(f"_owner.{k}"), F.col(k)).alias(k) for k in ("key_hi", "key_lo")])
    return keyed.filter("not _lost").select(order, *extra, "key_hi", "key_lo").unionByName(lost)


def surplus_deliveries(keys: DataFrame, order: str = "row_id") -> DataFrame:
    """The rows of ``keys`` that are not the first of their message, with that first one.

    Every key is aggregated before the join, and a key that holds a large part of
    all rows is spread over all tasks. Rows that repeat the first order value
    itself are kept once by the caller's position, not here.
    """
    keys = cut(keys, "message-keys")
    sizes = keys.groupBy("key_hi", "key_lo").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    total = keys.count()
    return skew_join(keys, sizes, ["key_hi", "key_lo"], "_n", total).filter(F.col(order) != F.col("first")).drop("_n", "key_hi", "key_lo")


def deduplicated(spark: SparkSession, path: str, order: str = "row_id", columns: list | None = None) -> DataFrame:
    """The wide rows of ``path`` without surplus deliveries.

    Winners are the rows with the smallest ``order`` of their message. The result
    has the columns of the file; its other rows are never shuffled.
    """
    narrow = scan_with_positions(spark, path, [order, "id", "url", "created_utc"])
    losers = surplus_deliveries(message_keys(narrow, order, (FILE, POS)), order)
    vectors = write_positions(losers.select(FILE, POS), "deletion-vectors")
    wide = scan_with_positions(spark, path, columns)
    alive: Column = position_filter(vectors, inside=False)(FILE, POS)
    return wide.filter(alive).drop(FILE, POS)
