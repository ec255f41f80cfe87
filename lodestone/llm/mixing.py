"""Mixing sources to target shares by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import cut, table
from .encoding import TOKENIZERS, VOCABULARY, count_column


def queued(sized: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 7, scarce: str = "stop") -> tuple[DataFrame, DataFrame]:
    """Mix ``(doc_id, source, n_tokens)`` to the shares of ``(source, target_share, repeat_cap)``.

    Every document of a source gets a place in a shuffled order that depends on
    ``seed`` and doc_id alone, and a virtual finish time: the tokens of its
    source up to and with it, divided by the source's target weight; the second
    time a document is used, all of its source's tokens go before. The mixture is every use
    that finishes by the total budget, ranged by finish time. Weights are the target
    shares over sources that have tokens, scaled to sum 1; a listed source without
    documents gets nothing and an unlisted or null source takes no part, nor do
    documents without tokens. ``budget`` in tokens is by default the largest at which
    no source runs out of its allowed uses, so the shares hold to within one document a
    source; one scarce source then bounds the whole mixture. With a larger one, scarce sources stop at their caps
    and the shares reached show it: with ``scarce="stop"`` the others keep to their part of the budget, which is
    not used up; with ``scarce="fill"`` the queue is served on until the total reaches the budget, the
    others sharing by their weights what the scarce ones leave. Rows that repeat a doc_id are documents of their own.

    Returns the uses ``(doc_id, source, use, n_tokens, finish)`` and, per listed
    source, the report ``(source, target_share, weight, documents, tokens, uses,
    used_tokens, reached_share, most_uses)``.

    Running sums are taken inside slices of the shuffled order and over the
    slices' totals, so a source with most of the rows is spread like any other.
    """
    spark = sized.sparkSession
    listed = targets.filter("source is not null and target_share > 0 and repeat_cap > 0")
    listed = listed.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("repeat_cap").alias("repeat_cap"))
    usable = sized.filter("n_tokens > 0").join(F.broadcast(listed.select("source")), "source", "left_semi")
    place = F.xxhash64(F.lit(seed), F.col("doc_id"))
    rows = usable.select("doc_id", "source", "n_tokens", place.alias("place"), F.shiftrightunsigned(place, 64 - 12).cast("int").alias("slice"))
    rows = cut(rows, "mix-rows")
    slices = cut(rows.groupBy("source", "slice").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "mix-slices")
    totals = slices.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("documents"))
    # As many rows as the target table has: the plan of the mixture.
    plan = {r["source"]: r.asDict() for r in listed.join(totals, "source", "left").collect()}
    filled = {s: r for s, r in plan.items() if r["tokens"]}
    scale = sum(r["target_share"] for r in filled.values()) or 1.0
    weight = {s: r["target_share"] / scale for s, r in filled.items()}
    most = min((int(r["tokens"] * r["repeat_cap"] / weight[s]) for s, r in filled.items()), default=0)
    budget = most if budget is None else budget
    clock = float(budget) if scarce == "stop" else _served_until(budget, {s: (weight[s], int(r["tokens"]) * int(r["repeat_cap"])) for s, r in filled.items()})
    shares = spark.createDataFrame(
        [(s, float(r["target_share"]), weight.get(s, 0.0), int(r["tokens"] or 0), int(r["documents"] or 0), int(r["repeat_cap"])) for s, r in sorted(plan.items())],
        "source string, target_share double, weight double, source_tokens bigint, documents bigint, repeat_cap int",
    )
    upto = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = slices.withColumn("before", F.coalesce(F.sum("tokens").over(upto), F.lit(0))).select("source", "slice", "before")
    inside = W.partitionBy("source", "slice").orderBy("place", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    # The offsets meet the rows where the window has put them; one row per listed source is broadcast.
    ranked = rows.withColumn("run", F.sum("n_tokens").over(inside)).join(offsets.hint("merge"), ["source", "slice"]).join(F.broadcast(shares), "source")
    done = (F.col("before") + F.col("run")).cast("bigint")
    allowed = F.floor(F.lit(clock) * F.col("weight") + 1e-6).cast("bigint")
    last_use = F.least(F.col("repeat_cap").cast("bigint") - 1, F.call_function("div", allowed - done, F.col("source_tokens")))
    uses = ranked.filter(done <= allowed).select(
        "doc_id", "source", "n_tokens", "source_tokens", "weight", done.alias("done"), F.explode(F.sequence(F.lit(0).cast("bigint"), last_use)).alias("lap")
    )
    mixture = uses.select(
        "doc_id", "source", (F.col("lap") + 1).cast("int").alias("use"), "n_tokens",
        F.round((F.col("lap") * F.col("source_tokens") + F.col("done")) / F.col("weight"), 6).alias("finish"),
    )
    taken = mixture.groupBy("source").agg(F.count(F.lit(1)).alias("uses"), F.sum("n_tokens").alias("used_tokens"), F.max("use").alias("most_uses"))
    whole = mixture.agg(F.sum("n_tokens").alias("all_tokens"))
    report = shares.join(taken, "source", "left").crossJoin(F.broadcast(whole)).select(
        "source", "target_share", F.round("weight", 9).alias("weight"), "documents", F.col("source_tokens").alias("tokens"),
        F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"),
        F.round(F.coalesce(F.col("used_tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("reached_share"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )
    return mixture.orderBy("finish", "source", "doc_id"), report


def _served_until(budget: int, sources: dict[str, tuple[float, int]]) -> float:
    """The virtual time by which the queue has served ``budget`` tokens, each source ``(weight, most tokens)`` up to its most."""
    served, before, open_ = 0.0, 0.0, sum(w for w, _ in sources.values())
    for ends, w in sorted((most / w, w) for w, most in sources.values()):
        if served + open_ * (ends - before) >= budget:
            break
        served, before, open_ = served + open_ * (ends - before), ends, open_ - w
    return before + max(0.0, budget - served) / open_ if open_ > 1e-12 else before


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_column(table(spark, sf_dir, "documents"), "text", f"{TOKENIZERS}/{VOCABULARY}", ["doc_id", "source"])


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of a document in the mixture, in the order it is served."""
    return queued(_sized(spark, sf_dir), table(spark, sf_dir, "mix_target"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the mixture reaches, one row per listed source."""
    return queued(_sized(spark, sf_dir), table(spark, sf_dir, "mix_target"))[1]


def p9_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of a mixture of half as many tokens as all documents have, with scarce sources at their caps."""
    sized = cut(_sized(spark, sf_dir), "sized")
    budget = (sized.agg(F.sum("n_tokens")).first()[0] or 0) // 2
    return queued(sized, table(spark, sf_dir, "mix_target"), budget, scarce="fill")[1]


QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_filled": p9_filled}
ORACLES: dict[str, str] = {}
