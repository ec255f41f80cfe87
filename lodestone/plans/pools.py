"""Queries over pools of vectors and the clusters assembled from their labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pools
from ..runtime import cut, table
from .evidence import E, _e


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


def pool_cuts(spark, d):
    """Adaptive cut, median and upper quartile of the distances in each pool of vectors."""
    return pools.cuts(_vectors(spark, d), "label", "vec_id", "embedding")


def density_clusters(spark, d):
    """Clusters of every pool by density at its own cut, by linkage where density says nothing."""
    v = _vectors(spark, d)
    return pools.pool_labels(v, "label", "vec_id", "embedding", pools.cuts(v, "label", "vec_id", "embedding", 0.02))


def linked_vectors(spark, d):
    """How large the groups are that close pairs connect."""
    g = pools.linked_groups(_vectors(spark, d).withColumn("one", F.lit(0)), "one", "vec_id", "embedding", 0.72)
    return g.groupBy("component").agg(F.count(F.lit(1)).alias("n"))


def _members(spark, d):
    """The records behind the vectors, with a label each, some of them noise and some labels rare."""
    v = _vectors(spark, d).select(F.col("vec_id").alias("row_id"), F.when(F.col("vec_id") % 7 == 0, -1).when(F.col("vec_id") % 50 == 1, 1000 + F.col("vec_id")).otherwise(F.col("label")).alias("label"))
    e = _e(spark, d).select("row_id", "author", "community", "engagement_value", "cell_id", "url", "score")
    return pools.members(v.join(e, "row_id").withColumn("run", F.pmod(F.col("row_id"), F.lit(2))), 2)


def cluster_members(spark, d):
    """Every record with its cluster and rank; records of small clusters and noise have none."""
    return _members(spark, d).select("run", "row_id", "cluster_id", F.col("rank").cast("bigint").alias("rank"))


def cluster_panel(spark, d):
    return pools.assembled(_members(spark, d))


def unclustered(spark, d):
    """Records that no cluster of two or more holds, by why."""
    m = _members(spark, d).filter("cluster_id is null")
    return m.groupBy("run", F.when(F.col("label") < 0, "noise").otherwise("small cluster").alias("why")).agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"))


def fusion_advisory(spark, d):
    v = _vectors(spark, d)
    runs = v.withColumn("run", F.pmod(F.col("vec_id"), F.lit(2)))
    return pools.advisory(cut(_members(spark, d), "members"), v.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("v")), pools.cuts(runs, "run", "vec_id", "embedding"))


def cluster_sanity(spark, d):
    """Signs that a clustering is of no use: one cluster too large, only pairs, or most records left over."""
    m = _members(spark, d)
    c = m.filter("cluster_id is not null").groupBy("run", "cluster_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("author").alias("a"))
    r = c.groupBy("run").agg(F.count(F.lit(1)).alias("clusters"), F.max("n").alias("largest"), F.min((F.col("n") == 2) & (F.col("a") == 2)).alias("only_pairs"), F.sum("n").alias("clustered"))
    n = m.groupBy("run").agg(F.count(F.lit(1)).alias("records"))
    j = n.join(r, "run", "left")
    return j.select("run", "records", "clusters", (F.col("largest") / F.col("records") > 0.35).alias("one_too_large"), "only_pairs", (F.col("records") - F.coalesce("clustered", F.lit(0)) > F.col("records") / 2).alias("mostly_left_over"))


def loudest_added(spark, d):
    """The three members with the highest score that each cluster gained in the later half of its rows."""
    m = _members(spark, d).filter("cluster_id is not null")
    added = m.filter(F.col("row_id") >= 250)
    from pyspark.sql import Window as W

    at = F.row_number().over(W.partitionBy("run", "cluster_id").orderBy(F.coalesce("score", F.lit(0)).desc(), "row_id"))
    return added.withColumn("place", at.cast("bigint")).filter("place <= 3").select("run", "cluster_id", "place", "row_id")


def cluster_payload(spark, d):
    """Every run as one JSON document per cluster, not-a-number and infinite values left out."""
    c = pools.assembled(_members(spark, d))
    finite = F.when(F.isnan(F.col("engagement_sum").cast("double")), None).otherwise(F.col("engagement_sum"))
    return c.select("run", "cluster_id", F.to_json(F.struct("cluster_id", "member_count", "distinct_authors", finite.alias("engagement_sum"), F.split("cell_ids", ",").alias("cell_ids"))).alias("payload"))


_NAMES = "pool_cuts density_clusters linked_vectors cluster_members cluster_panel unclustered fusion_advisory cluster_sanity loudest_added cluster_payload".split()
QUERIES = {name: globals()[name] for name in _NAMES}

_V = "v as (select vec_id, label, vec_id % 2 as run, embedding::double[] as e from embeddings)"
_PAIRS = "select a.{g} as g, round(greatest(0, 1 - list_inner_product(a.e, b.e)), 6) as d from v a join v b on a.{g} = b.{g} and a.vec_id < b.vec_id"
_CUTS = """p as ({pairs}), twice as (select g, d from p union all select g, d from p),
  c1 as (select g, greatest(round(quantile_cont(d, 0.35), 6), 1e-6) as cut from twice group by g),
  cuts as (select c1.g, pairs, cut, median, p75 from c1 join (select g, count(*) as pairs, round(quantile_cont(d, 0.5), 4) as median, round(quantile_cont(d, 0.75), 4) as p75 from p group by g) using (g))"""
_M = f"""{E}, {_V}, l as (select vec_id as row_id, vec_id % 2 as run, case when vec_id % 7 = 0 then -1 when vec_id % 50 = 1 then 1000 + vec_id else label end as label, v.e as vector from v),
  r as (select l.*, author, community, engagement_value, cell_id, url, score from l join e using (row_id)),
  z as (select run, label, count(*) as n, sum(engagement_value) as s from r where label >= 0 group by 1, 2 having count(*) >= 2),
  nm as (select run, label, printf('c%02d', row_number() over (partition by run order by n desc, coalesce(nullif(s, 0), -1) desc, label)) as cluster_id from z),
  m as (select r.*, cluster_id, case when cluster_id is not null then row_number() over (partition by run, label order by coalesce(nullif(engagement_value, 0), -1) desc, row_id) end as rank from r left join nm using (run, label))"""
ORACLES = {
    "pool_cuts": f"with {_V}, {_CUTS.format(pairs=_PAIRS.format(g='label'))} select g as pool, pairs, cut, median, p75 from cuts",
    "linked_vectors": """with recursive v as (select vec_id, embedding::double[] as e from embeddings), p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id < b.vec_id where greatest(0, 1 - list_inner_product(a.e, b.e)) <= 0.72),
      w as (select a, b from p union all select b, a from p), reach as (select distinct a as x, a as y from w union select x, b from reach join w on y = a),
      c as (select x, min(y) as component from reach group by x) select component, count(*) as n from c group by 1""",
    "cluster_members": f"with {_M} select run, row_id, cluster_id, rank from m",
    "cluster_panel": f"""with {_M}, u as (select run, cluster_id, url, min(rank) as rank from m where cluster_id is not null and url is not null group by 1, 2, 3),
      f as (select *, row_number() over (partition by run, cluster_id order by rank) as place from u), x as (select run, cluster_id, string_agg(url, ' ' order by place) as exemplar_urls from f where place <= 3 group by 1, 2)
      select run, cluster_id, count(*) as member_count, count(distinct author) as distinct_authors, count(distinct community) as distinct_communities, sum(engagement_value)::bigint as engagement_sum,
        coalesce(string_agg(distinct cell_id, ',' order by cell_id), '') as cell_ids, max(exemplar_urls) as exemplar_urls from m left join x using (run, cluster_id) where cluster_id is not null group by 1, 2""",
    "unclustered": f"with {_M} select run, case when label < 0 then 'noise' else 'small cluster' end as why, count(*) as n, min(row_id) as first from m where cluster_id is null group by 1, 2",
    "fusion_advisory": f"""with {_M}, {_CUTS.format(pairs=_PAIRS.format(g='run'))}, t as (select * from m where cluster_id is not null and rank <= 40), k as (select run, cluster_id, count(*) as c from t group by 1, 2),
      w as (select a.run, round(max(greatest(0, 1 - list_inner_product(a.vector, b.vector))), 6) as spread from t a join t b on a.run = b.run and a.cluster_id = b.cluster_id and a.rank < b.rank join k on k.run = a.run and k.cluster_id = a.cluster_id where c >= 3 group by 1),
      s as (select run, count(*) as records, round(count(*) filter (cluster_id = 'c01') / count(*), 3) as share, count(*) filter (cluster_id is null) > count(*) / 2 as mostly_unclustered from m group by 1)
      select s.run, records, share, spread, p75, case when share > 0.35 then 'one cluster holds too much' when spread > p75 then 'members as far apart as strangers' end as advice, mostly_unclustered from s left join w using (run) left join cuts on cuts.g = s.run""",
    "cluster_sanity": f"""with {_M}, c as (select run, cluster_id, count(*) as n, count(distinct author) as a from m where cluster_id is not null group by 1, 2),
      q as (select run, count(*) as clusters, max(n) as largest, bool_and(n = 2 and a = 2) as only_pairs, sum(n) as clustered from c group by 1), s as (select run, count(*) as records from m group by 1)
      select run, records, clusters, largest / records > 0.35 as one_too_large, only_pairs, records - coalesce(clustered, 0) > records / 2 as mostly_left_over from s left join q using (run)""",
    "loudest_added": f"with {_M}, a as (select *, row_number() over (partition by run, cluster_id order by coalesce(score, 0) desc, row_id) as place from m where cluster_id is not null and row_id >= 250) select run, cluster_id, place, row_id from a where place <= 3",
}
