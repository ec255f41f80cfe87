"""Vectors: lexical embedding, centroids, medoids, nearest neighbours, average linkage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import cut, worker_cache
from .graph import connected_components

WORD_WEIGHT, GRAM_WEIGHT, BUCKETS = 1.6, 1.0, 512


def lexical_embedding(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """``(key, buckets, weights)``: hashed words and character trigrams of a text as a sparse vector, not yet of unit length.

    A text shorter than three characters is one gram; a null or empty text has an empty
    vector. Tokens are hashed once per worker and looked up afterwards: a text has one
    trigram per character, so hashing each of them anew in an expression is ten times slower. One row a text, nothing is shuffled.
    """
    kind = rows.select(key).schema[0].dataType.simpleString()

    class Buckets(dict):
        def __missing__(self, token):
            import hashlib

            if len(self) > 1_000_000:
                self.clear()
            v = self[token] = int(hashlib.md5(token.encode()).hexdigest()[-3:], 16) % BUCKETS
            return v

    def run(batches):
        import re

        import pyarrow as pa

        word = re.compile("[a-z0-9]+")
        get = worker_cache("lexical-buckets", Buckets).__getitem__
        for batch in batches:
            buckets, weights = [], []
            for t in batch.column("_text").to_pylist():
                total = np.zeros(0)
                if t:
                    t = t.lower()
                    grams = [get("t:" + t[j : j + 3]) for j in range(max(1, len(t) - 2))]
                    words = [get("w:" + w) for w in word.findall(t)]
                    total = np.bincount(grams, minlength=BUCKETS) * GRAM_WEIGHT + np.bincount(words, minlength=BUCKETS) * WORD_WEIGHT
                some = np.nonzero(total)[0].astype(np.int32)
                buckets.append(some)
                weights.append(total[some])
            offsets = pa.array(np.cumsum([0, *map(len, buckets)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else np.empty(0, k)).cast(t)) for x, k, t in ((buckets, np.int32, pa.int32()), (weights, float, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(key), *lists], names=[key, "buckets", "weights"])

    return rows.select(key, text.alias("_text")).mapInArrow(run, f"{key} {kind}, buckets array<int>, weights array<double>")


def unit(weights: Column) -> Column:
    """Weights scaled to length 1; an empty vector stays empty."""
    norm = F.sqrt(F.aggregate(weights, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(weights, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """``1 - a.b`` of unit vectors, never below 0."""
    return F.greatest(F.lit(0.0), 1 - dot(a, b))


def sums(rows: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """``(group, pos, s, n)``: element-wise sums, added up before anything is shuffled."""
    at = rows.select(group, F.posexplode(vector).alias("pos", "x"))
    return at.groupBy(group, "pos").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))


def centroids(rows: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """``(group, n, total, centroid)``: the sum of each group's vectors and its unit-length mean."""
    whole = sums(rows, group, vector).groupBy(group).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("p"))
    whole = whole.select(group, "n", F.col("p.s").alias("total"))
    norm = F.sqrt(F.aggregate("total", F.lit(0.0), lambda s, x: s + x * x))
    return whole.withColumn("centroid", F.transform("total", lambda x: x / F.when(norm == 0, 1.0).otherwise(norm)))


def medoids(rows: DataFrame, group: str, key: str, vector: str = "embedding") -> DataFrame:
    """The member with the smallest summed distance to its group, smallest key on a tie.

    For unit vectors the sum is ``n`` minus the dot product with the group's total,
    so no pair is ever formed.
    """
    c = centroids(rows, group, vector).select(group, "n", "total")
    d = rows.join(F.broadcast(c), group).withColumn("spread", F.round(F.col("n") - dot(F.col(vector), F.col("total")), 6))
    return d.groupBy(group).agg(F.min(F.struct("spread", key)).alias("m"), F.max("n").alias("n")).select(group, "n", f"m.{key}", "m.spread")


def centroid_gate(rows: DataFrame, group: str, key: str, vector: str = "embedding") -> DataFrame:
    """Distance of every member to its centroid and whether it is within the group's 90th percentile."""
    c = centroids(rows, group, vector).select(group, "centroid")
    d = rows.join(F.broadcast(c), group).select(group, key, F.round(cosine_distance(F.col(vector), F.col("centroid")), 3).alias("distance"))
    p90 = d.groupBy(group).agg(F.round(F.percentile("distance", F.lit(0.9)), 3).alias("p90"))
    return d.join(F.broadcast(p90), group).withColumn("inside", F.col("distance") <= F.col("p90"))


def query_distances(rows: DataFrame, queries: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """``(query, key, distance)`` of every query to every other row, in blocks of queries against all rows.

    A block has about 1024 queries, so what is broadcast at once has a bounded size.
    """
    numbered = queries.select(F.col(key).alias("query"), F.col(vector).alias("qv"))
    blocks = max(1, -(-numbered.count() // 1024))
    out = None
    for i in range(blocks):
        part = numbered.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i)
        near = rows.join(F.broadcast(part), F.col(key) != F.col("query")).select("query", key, cosine_distance(F.col(vector), F.col("qv")).alias("distance"))
        out = near if out is None else out.unionByName(near)
    return out


def searched(rows: DataFrame, queries: DataFrame, key: str, most: int, vector: str = "embedding") -> DataFrame:
    """The ``most`` nearest rows of each query; every partition keeps its best rows before anything is shuffled."""
    near = query_distances(rows, queries, key, vector).withColumn("distance", F.round("distance", 6))
    rank = F.row_number().over(W.partitionBy("query").orderBy("distance", key))
    return near.withColumn("rank", rank).filter(F.col("rank") <= most)


def average_linkage(n: int, distance: np.ndarray, cut_at: float) -> list[int]:
    """Labels of agglomerative clustering: merge the closest pair by mean distance while it is within the cut.

    Ties go to the pair with the smallest positions. Labels are the smallest position of each cluster.
    """
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n), np.arange(n)
    while n > 1:
        i, j = divmod(int(np.argmin(np.triu(d, 1) + np.tril(np.full_like(d, np.inf)))), n)
        if not d[i, j] <= cut_at:
            break
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
    return label.tolist()


def linkage_labels(vectors: DataFrame, key: str, cut_at: float, vector: str = "centroid") -> DataFrame:
    """``(key, cluster)`` by average linkage.

    A merge needs a pair within the cut, so it never crosses components of the graph of such
    pairs: pairs are looked for tile by tile, and each component is linked by itself, in one task that holds the
    square of its size. Positions follow the order of the keys.
    """
    from .pools import close_pairs

    numbered = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v")).orderBy("k").withColumn("i", F.monotonically_increasing_id())
    pool = cut(numbered.withColumn("one", F.lit(0)), "linkage")
    edges = close_pairs(pool, "one", "i", "v", cut_at).withColumnsRenamed({"a": "i", "b": "j"})
    comp = connected_components(edges.select(F.col("i").alias("src"), F.col("j").alias("dst")))
    placed = pool.join(comp.withColumnRenamed("node", "i"), "i", "left").withColumn("component", F.coalesce("component", "i"))

    def link(frame):
        import pandas as pd

        frame = frame.sort_values("i")
        x = np.stack(frame["v"].to_numpy())
        labels = average_linkage(len(x), np.maximum(0, 1 - x @ x.T), cut_at)
        firsts = frame["i"].to_numpy()
        return pd.DataFrame({"k": frame["k"], "cluster": firsts[labels]})

    kind = vectors.schema[key].dataType.simpleString()
    return placed.select("i", "k", "v", "component").groupBy("component").applyInPandas(link, f"k {kind}, cluster bigint").withColumnRenamed("k", key)
