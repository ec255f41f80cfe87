"""At most so many records per contributor, chosen by quality inside strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normal import handle, score_value
from ..runtime import cut, table

ROW_SLICES = 65_536
#: Rows of the tables of seats and edges up to which they are broadcast; a row has some 60 bytes.
MOST_SENT = 100_000


def largest_remainder(weights: list[float], sizes: list[int], cap: int) -> list[int]:
    """Seats of ``cap`` for strata by weight, none above its size, spare seats given again.

    Equal remainders go to the earlier stratum. The seats sum to ``min(cap, sum(sizes))``.
    """
    seats = [0] * len(sizes)
    left = min(cap, sum(sizes))
    while left > 0:
        open_ = [i for i, n in enumerate(sizes) if seats[i] < n]
        total = sum(weights[i] for i in open_) or float(len(open_))
        shares = {i: left * (weights[i] if total != float(len(open_)) or weights[i] else 1.0) / total for i in open_}
        whole = {i: int(s) for i, s in shares.items()}
        rest = left - sum(whole.values())
        for i in sorted(open_, key=lambda i: (whole[i] - shares[i], i))[:rest]:
            whole[i] += 1
        before = left
        for i in open_:
            given = min(whole[i], sizes[i] - seats[i])
            seats[i] += given
            left -= given
        if left == before:
            break
    return seats


def split_by_cap(rows: DataFrame, caps: DataFrame, quality: str = "quality", order: str = "row_id", strata_power: float = 0.5) -> DataFrame:
    """Every row with ``kept``: whether it is inside the cap of its contributor.

    ``rows`` has ``kind, contributor, stratum, quality (bigint), row_id``; ``caps``
    has ``kind, cap``, a few rows. Contributors with at most ``cap`` rows keep all.
    The cap of another one is split over its strata by largest remainder, weighted
    by stratum size to the power ``strata_power``, spare seats are given again, and in a stratum
    the best quality is kept, unreported last, then the smallest row_id. Rows with
    a null contributor are kept; a null stratum is a stratum. Rows that repeat a
    row_id tie and are kept or dropped together only if they lie beyond or inside
    the same boundary slice; inside it they are ranked in any order.

    No contributor is ever collected: qualities are counted first, the counts
    give the quality at which the seats of a stratum run out, and rows that tie at that quality are
    decided by counts over slices of row_id. At most ``n / cap`` contributors can exceed
    a cap, which bounds the broadcast tables by that number times the strata.
    """
    from pyspark.sql import Window as W

    group = ["kind", "contributor"]
    cell = [*group, "stratum"]
    named = rows.filter("contributor is not null").withColumn("stratum", F.coalesce("stratum", F.lit("")))
    counted = cut(named.groupBy(*cell, quality).agg(F.count(F.lit(1)).alias("n")), "quota-counts")
    strata = counted.groupBy(*cell).agg(F.sum("n").alias("n"))
    totals = strata.groupBy(*group).agg(F.sum("n").alias("total"))
    over = totals.join(F.broadcast(caps), "kind").filter("total > cap").select(*group, "cap")

    def sent(df):
        return F.broadcast(df) if small else df


    def apportion(key, frame):
        import pandas as pd

        frame = frame.sort_values("stratum")
        sizes = [int(x) for x in frame["n"]]
        seats = largest_remainder([n**strata_power for n in sizes], sizes, int(frame["cap"].iloc[0]))
        return pd.DataFrame({"kind": key[0], "contributor": key[1], "stratum": frame["stratum"], "seats": seats})

    schema = "kind string, contributor string, stratum string, seats bigint"
    # One row per stratum of one contributor: already aggregated, a handful per group.
    seats = cut(strata.join(over, group).groupBy(*group).applyInPandas(apportion, schema), "quota-seats")
    small = seats.count() <= MOST_SENT

    best_first = W.partitionBy(*cell).orderBy(F.col(quality).desc_nulls_last())
    running = counted.join(sent(seats), cell).withColumn("upto", F.sum("n").over(best_first.rowsBetween(W.unboundedPreceding, 0)))
    edge = running.filter("upto > seats and upto - n <= seats").select(
        *cell, F.col(quality).alias("edge"), (F.col("seats") - F.col("upto") + F.col("n")).alias("seats_at_edge")
    )
    edge = cut(edge, "quota-edges")
    judged = named.join(sent(seats.select(*cell)), cell, "left_semi").join(sent(edge), cell, "left")
    beyond = F.col(quality).isNull() | (F.col(quality) < F.col("edge"))
    state = (
        F.when(F.col("seats_at_edge").isNull(), "in")
        .when(F.col(quality).eqNullSafe(F.col("edge")), "tie")
        .when(F.col("edge").isNull(), "in")
        .when(beyond, "out")
        .otherwise("in")
    )
    judged = judged.withColumn("state", state)

    low, high = rows.agg(F.min(order), F.max(order)).first()
    width = max(1, ((high or 0) - (low or 0)) // ROW_SLICES)
    ties = judged.filter("state = 'tie'").withColumn("slice", F.call_function("div", F.col(order) - F.lit(low or 0), F.lit(width)))
    by_slice = ties.groupBy(*cell, "seats_at_edge", "slice").agg(F.count(F.lit(1)).alias("n"))
    earliest = W.partitionBy(*cell).orderBy("slice")
    by_slice = by_slice.withColumn("upto", F.sum("n").over(earliest.rowsBetween(W.unboundedPreceding, 0)))
    turn = cut(by_slice.filter("upto > seats_at_edge and upto - n <= seats_at_edge").select(
        *cell, F.col("slice").alias("turn"), (F.col("seats_at_edge") - F.col("upto") + F.col("n")).alias("seats_at_turn")), "quota-turns")
    ties = ties.join(sent(turn), cell, "left")
    clear = ties.filter("turn is null or slice <> turn").withColumn("kept", F.col("turn").isNull() | (F.col("slice") < F.col("turn")))
    close = ties.filter("slice = turn").withColumn("at", F.row_number().over(W.partitionBy(*cell).orderBy(order)))
    close = close.withColumn("kept", F.col("at") <= F.col("seats_at_turn"))

    out = [*cell, quality, order, "kept"]
    parts = [judged.filter("state <> 'tie'").withColumn("kept", F.col("state") == "in"), clear, close]
    judged_rows = parts[0].select(*out).unionByName(parts[1].select(*out)).unionByName(parts[2].select(*out))
    return judged_rows


def contributions(rows: DataFrame, stratum: Column) -> DataFrame:
    """One row per record and kind of contributor (author, community)."""
    kinds = F.array(
        F.struct(F.lit("author").alias("kind"), handle(F.col("author"), "u").alias("contributor")),
        F.struct(F.lit("community").alias("kind"), handle(F.col("community"), "r").alias("contributor")),
    )
    narrow = rows.select("row_id", score_value(F.col("engagement.score")).alias("quality"), stratum.alias("stratum"), F.explode(kinds).alias("c"))
    return narrow.select("c.kind", "c.contributor", "stratum", "quality", "row_id").filter("contributor is not null")


def share_caps(spark: SparkSession, n: int, shares: dict[str, float]) -> DataFrame:
    caps = [(kind, max(1, int(n * share + 1e-9))) for kind, share in shares.items()]
    return spark.createDataFrame(caps, T.StructType([T.StructField("kind", T.StringType()), T.StructField("cap", T.LongType())]))


SHARES = {"author": 0.005, "community": 0.06}


def _judged(spark: SparkSession, sf_dir: str, stratum: Column) -> DataFrame:
    rows = table(spark, sf_dir, "evidence_sample")
    narrow = contributions(rows, stratum)
    return split_by_cap(narrow, share_caps(spark, rows.count(), SHARES))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows over the cap of their author or community, all periods in one stratum."""
    over = _judged(spark, sf_dir, F.lit("all")).filter("not kept")
    return over.select(F.col("kind").alias("contributor_kind"), "row_id")


def p2_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows over the cap if it is split over quarters of the year the post was made in."""
    at = F.timestamp_seconds("created_utc")
    quarter = F.concat(F.year(at), F.lit("Q"), F.quarter(at))
    over = _judged(spark, sf_dir, quarter).filter("not kept")
    return over.select(F.col("kind").alias("contributor_kind"), "contributor", "stratum", "row_id")


QUERIES = {"p2_found": p2_found, "p2_capped": p2_capped}

_HANDLE = r"regexp_replace(lower(regexp_replace({c}, '^[\s\p{{Z}}\p{{Cc}}\p{{Cf}}]+|[\s\p{{Z}}\p{{Cc}}\p{{Cf}}]+$', '', 'g')), '^/?(?:{s}/)?', '')"
_RANKED = f"""r as (
  select 'author' as kind, {_HANDLE.format(c="author", s="u")} as who, row_id, engagement.score as s, created_utc from evidence_sample
  union all
  select 'community', {_HANDLE.format(c="community", s="r")}, row_id, engagement.score, created_utc from evidence_sample),
named as (select kind, who, row_id, case when s between -500 and 60000 then s end as q, coalesce(year(to_timestamp(created_utc) at time zone 'UTC') || 'Q' || quarter(to_timestamp(created_utc) at time zone 'UTC'), '') as stratum from r
  where who is not null and who not in ('', 'null', 'none', 'n/a', 'na', 'nan', 'unknown', 'undefined', '-', '[deleted]', 'deleted', '[removed]', 'removed')),
caps as (select 'author' as kind, greatest(1, floor(count(*) * 0.005))::bigint as cap from evidence_sample union all select 'community', greatest(1, floor(count(*) * 0.06))::bigint from evidence_sample)"""


def _apportioned(rounds: int = 12) -> str:
    """Seats by largest remainder, spare ones given again round by round."""
    out = ["""cells as (select kind, who, stratum, count(*) as n from named group by 1, 2, 3),
      s0 as (select kind, who, stratum, n, pow(n, 0.5) as w, 0::bigint as seats, cap as spare from (select *, sum(n) over (partition by kind, who) as total from cells) join caps using (kind) where total > cap)"""]
    g = "partition by kind, who"
    for i in range(rounds):
        out.append(f"""a{i} as (select *, seats < n as open, case when seats < n then spare * w / sum(case when seats < n then w end) over ({g}) end as share from s{i}),
      b{i} as (select *, floor(share) as whole, spare - sum(floor(share)) over ({g}) as rest, row_number() over ({g} order by open desc, floor(share) - share, stratum) as rk from a{i}),
      c{i} as (select *, case when open then least(whole + (rk <= rest)::int, n - seats) else 0 end::bigint as give from b{i}),
      s{i + 1} as (select kind, who, stratum, n, w, seats + give as seats, (spare - sum(give) over ({g}))::bigint as spare from c{i})""")
    return ", ".join(out)


ORACLES = {
    "p2_found": f"""with {_RANKED}, ranked as (select *, row_number() over (partition by kind, who order by q desc nulls last, row_id) as rk from named)
      select kind as contributor_kind, row_id from ranked join caps using (kind) where rk > cap""",
    "p2_capped": f"""with {_RANKED}, {_apportioned()}, ranked as (select *, row_number() over (partition by kind, who, stratum order by q desc nulls last, row_id) as rk from named)
      select kind as contributor_kind, who as contributor, stratum, row_id from ranked join s12 using (kind, who, stratum) where rk > seats""",
}
