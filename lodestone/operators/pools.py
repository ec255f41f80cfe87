"""Pools of vectors: exact distance percentiles, density and linkage clustering, assembly of clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import cut
from .graph import connected_components
from .vectors import average_linkage

TILE = 1024
#: Pools below this size are linked, not searched for density; the cut is never smaller; members looked at for the spread.
LEAST_DENSE, LEAST_CUT, SPREAD = 8, 1e-6, 40


def tiled(vectors: DataFrame, pool: str, key: str, vector: str) -> DataFrame:
    """Every vector once for each pair of blocks of its pool that it takes part in, so that each pair of vectors meets in one group.

    Blocks have about ``TILE`` vectors; a group ``(pool, i, j)`` has at most two of them, however large the pool.
    """
    rows = vectors.select(F.col(pool).alias("pool"), F.col(key).alias("k"), F.col(vector).alias("v")).filter("v is not null")
    sizes = rows.groupBy("pool").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks"))
    placed = rows.join(sizes, "pool").withColumn("b", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda t: F.struct(F.least(t, F.col("b")).alias("i"), F.greatest(t, F.col("b")).alias("j")))
    return placed.select("pool", "k", "v", "b", F.explode(meets).alias("m")).select("pool", "k", "v", "b", "m.i", "m.j")


def _pairs(frame: pd.DataFrame):
    """Keys, distances and the mask of pairs to look at, of one tile."""
    i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
    frame = frame.sort_values("k")
    one, two = (frame[frame["b"] == i], frame[frame["b"] == j])
    if not len(one) or not len(two):
        return None
    d = np.maximum(0, 1 - np.stack(one["v"].to_numpy()).astype(float) @ np.stack(two["v"].to_numpy()).astype(float).T)
    return one["k"].to_numpy(), two["k"].to_numpy(), d, np.triu(np.ones_like(d, bool), 1) if i == j else np.ones_like(d, bool)


def distance_counts(vectors: DataFrame, pool: str, key: str, vector: str) -> DataFrame:
    """``(pool, distance, n)``: how many pairs of a pool have each cosine distance, to six digits.

    All pairs are looked at, none is written: what is shuffled are counts of at most two million distances a pool and tile.
    """

    def run(frame):
        found = _pairs(frame)
        if found is None:
            return pd.DataFrame({"pool": [], "distance": [], "n": []})
        value, n = np.unique(np.round(found[2][found[3]], 6), return_counts=True)
        return pd.DataFrame({"pool": frame["pool"].iloc[0], "distance": value, "n": n})

    kind = vectors.schema[pool].dataType.simpleString()
    counts = tiled(vectors, pool, key, vector).groupBy("pool", "i", "j").applyInPandas(run, f"pool {kind}, distance double, n bigint")
    return counts.groupBy("pool", "distance").agg(F.sum("n").alias("n"))


def counted_percentiles(counts: DataFrame, wanted: dict[str, tuple[float, int]]) -> DataFrame:
    """Percentiles with linear interpolation of ``(pool, distance, n)``, each value standing ``n`` times; ``{name: (p, times)}``.

    ``times`` repeats all values, as the two directions of a pair do.
    """
    w = W.partitionBy("pool")
    c = counts.withColumn("upto", F.sum("n").over(w.orderBy("distance"))).withColumn("all", F.sum("n").over(w))
    out = []
    for name, (p, times) in wanted.items():
        at = F.lit(p) * (F.col("all") * times - 1)
        low = F.min(F.when(F.col("upto") * times > F.floor(at), F.col("distance")))
        high = F.min(F.when(F.col("upto") * times > F.ceil(at), F.col("distance")))
        part = F.first(at - F.floor(at))
        out.append((low + (high - low) * part).alias(name))
    return c.groupBy("pool").agg(F.first("all").alias("pairs"), *out)


def cuts(vectors: DataFrame, pool: str, key: str, vector: str, percentile: float = 0.35) -> DataFrame:
    """Per pool the number of pairs, the adaptive cut, and the median and upper quartile of its distances.

    The cut is the percentile over both directions of every pair and never below ``LEAST_CUT``. A pool of one has no row.
    """
    p = counted_percentiles(distance_counts(vectors, pool, key, vector), {"cut": (percentile, 2), "median": (0.5, 1), "p75": (0.75, 1)})
    return p.withColumn("cut", F.greatest(F.round("cut", 6), F.lit(LEAST_CUT))).withColumns({c: F.round(c, 4) for c in ("median", "p75")})


def spanning_tree(x: np.ndarray) -> np.ndarray:
    """``(distance, a, b)`` of a minimum spanning tree of unit vectors, one row of distances at a time."""
    n = len(x)
    best, parent, open_ = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    at, out = 0, []
    for _ in range(n - 1):
        open_[at] = False
        d = np.maximum(0, 1 - x @ x[at])
        closer = open_ & (d < best)
        best[closer], parent[closer] = d[closer], at
        at = int(np.argmin(np.where(open_, best, np.inf)))
        out.append((best[at], parent[at], at))
    return np.array(sorted(out)) if out else np.zeros((0, 3))


def density_labels(x: np.ndarray, least: int = 2, epsilon: float = 0.0) -> np.ndarray:
    """Hierarchical density clusters of unit vectors, neighbourhoods of one; -1 for points that no cluster claims.

    The tree of merges is condensed to splits into parts of at least ``least`` points. Of every
    branch the clusters with the most excess of mass are kept; those born below ``epsilon`` are
    merged upwards to the first ancestor born above it. The root is no cluster.
    """
    n = len(x)
    if n < 2:
        return np.full(n, -1)
    left, right, height, size = {}, {}, {}, {i: 1 for i in range(n)}
    root_of = list(range(2 * n - 1))

    def find(i):
        while root_of[i] != i:
            root_of[i] = root_of[root_of[i]]
            i = root_of[i]
        return i

    top = n - 1
    for k, (d, a, b) in enumerate(spanning_tree(x)):
        top = n + k
        a, b = find(int(a)), find(int(b))
        left[top], right[top], height[top], size[top] = a, b, d, size[a] + size[b]
        root_of[a] = root_of[b] = top

    def points(node):
        stack, out = [node], []
        while stack:
            m = stack.pop()
            if m < n:
                out.append(m)
            else:
                stack += [left[m], right[m]]
        return out

    # Condensed clusters: where each is born (as density), its parent, and when every point falls out of it.
    born, parent, mass, held = {0: 0.0}, {0: None}, {0: 0.0}, {0: []}
    stack, following = [(top, 0)], 1
    while stack:
        node, c = stack.pop()
        while node >= n:
            density = 1 / height[node] if height[node] > 0 else np.inf
            a, b = left[node], right[node]
            if size[a] >= least and size[b] >= least:
                mass[c] += size[node] * _gain(density, born[c])
                for part in (a, b):
                    born[following], parent[following], mass[following], held[following] = density, c, 0.0, []
                    stack.append((part, following))
                    following += 1
                node = None
                break
            big, small = (a, b) if size[a] >= size[b] else (b, a)
            if size[big] < least:
                fallen = points(node)
                mass[c] += len(fallen) * _gain(density, born[c])
                held[c] += fallen
                node = None
                break
            fallen = points(small)
            mass[c] += len(fallen) * _gain(density, born[c])
            held[c] += fallen
            node = big
        if node is not None and node < n:
            held[c].append(node)
    children = {c: [k for k, p in parent.items() if p == c] for c in parent}
    chosen, best = set(), dict(mass)
    for c in sorted(parent, reverse=True):
        if c == 0:
            continue
        below = sum(best[k] for k in children[c])
        if children[c] and below > mass[c]:
            best[c] = below
        else:
            chosen -= set(_below(c, children))
            chosen.add(c)
    if epsilon > 0:
        kept = set()
        for c in sorted(chosen):
            if any(c in _below(k, children) for k in kept):
                continue
            at = c
            while 1 / born[at] < epsilon and parent[at] not in (None, 0):
                at = parent[at]
            kept.add(at)
        chosen = {c for c in kept if not any(c in _below(k, children) for k in kept)}
    label = np.full(n, -1)
    for c in chosen:
        for k in [c, *_below(c, children)]:
            label[held[k]] = c
    return label


def _gain(density: float, born: float) -> float:
    return 0.0 if density == born else min(density, 1e12) - min(born, 1e12)


def _below(c: int, children: dict) -> list[int]:
    out, stack = [], list(children[c])
    while stack:
        k = stack.pop()
        out.append(k)
        stack += children[k]
    return out


def pool_labels(vectors: DataFrame, pool: str, key: str, vector: str, pool_cuts: DataFrame, least: int = 2) -> DataFrame:
    """``(pool, key, label, algorithm)``: the clusters of every pool, -1 for points that none claims.

    Pools of fewer than ``LEAST_DENSE`` and such that density calls all noise are
    linked by mean distance within their cut; a pool of one is one cluster. A pool is clustered in one task: its
    vectors are held there, distances one row at a time (the square of a pool only where it is linked). Null vectors are
    left out. Labels are the smallest key of each cluster's members.
    """
    kind, name = vectors.schema[key].dataType.simpleString(), vectors.schema[pool].dataType.simpleString()
    rows = vectors.select(F.col(pool).alias("pool"), F.col(key).alias("k"), F.col(vector).alias("v")).filter("v is not null")
    rows = rows.join(pool_cuts.select("pool", "cut"), "pool", "left")

    def run(frame):
        frame = frame.sort_values("k")
        x, keys = np.stack(frame["v"].to_numpy()).astype(float), frame["k"].to_numpy()
        if len(x) == 1:
            return pd.DataFrame({"pool": frame["pool"], "k": keys, "label": keys, "algorithm": "trivial"})
        cut_at = float(frame["cut"].iloc[0])
        labels = density_labels(x, least, cut_at) if len(x) >= LEAST_DENSE else np.full(len(x), -1)
        used = "density"
        if (labels == -1).all():
            labels, used = np.array(average_linkage(len(x), np.maximum(0, 1 - x @ x.T), cut_at)), "linkage"
        first = {c: keys[labels == c].min() for c in set(labels.tolist()) if c != -1}
        return pd.DataFrame({"pool": frame["pool"].iloc[0], "k": keys, "label": [first.get(c, -1) for c in labels.tolist()], "algorithm": used})

    return rows.groupBy("pool").applyInPandas(run, f"pool {name}, k {kind}, label bigint, algorithm string").withColumnsRenamed({"k": key})


def close_pairs(vectors: DataFrame, pool: str, key: str, vector: str, cut_at: float) -> DataFrame:
    """``(pool, a, b, distance)`` of the pairs of each pool within the cut, looked for tile by tile."""

    def run(frame):
        found = _pairs(frame)
        if found is None:
            return pd.DataFrame({"pool": [], "a": [], "b": [], "distance": []})
        one, two, d, look = found
        i, j = np.nonzero(look & (d <= cut_at))
        return pd.DataFrame({"pool": frame["pool"].iloc[0], "a": np.minimum(one[i], two[j]), "b": np.maximum(one[i], two[j]), "distance": d[i, j]})

    kind, name = vectors.schema[key].dataType.simpleString(), vectors.schema[pool].dataType.simpleString()
    return tiled(vectors, pool, key, vector).groupBy("pool", "i", "j").applyInPandas(run, f"pool {name}, a {kind}, b {kind}, distance double")


def linked_groups(vectors: DataFrame, pool: str, key: str, vector: str, cut_at: float) -> DataFrame:
    """``(key, component)``: what chains of pairs within the cut connect; merges by mean distance never cross these."""
    pairs = cut(close_pairs(vectors, pool, key, vector, cut_at), "close-pairs")
    return connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnsRenamed({"node": key})


def members(labelled: DataFrame, least: int = 2) -> DataFrame:
    """Labelled records with ``cluster_id`` and ``rank``; both null where the record is unclustered.

    ``labelled`` has ``run, label, row_id, author, community, engagement_value, cell_id, url``. Clusters below ``least`` members and
    label -1 are unclustered. Clusters are numbered by members, then engagement (unreported and zero last), then label; members are
    ranked by engagement, then row_id.
    """
    loud = F.coalesce(F.nullif("engagement_value", F.lit(0)), F.lit(-1))
    sizes = labelled.filter("label >= 0").groupBy("run", "label").agg(F.count(F.lit(1)).alias("member_count"), F.sum("engagement_value").alias("engagement_sum"))
    sizes = sizes.filter(F.col("member_count") >= least)
    order = W.partitionBy("run").orderBy(F.desc("member_count"), F.coalesce(F.nullif("engagement_sum", F.lit(0)), F.lit(-1)).desc(), "label")
    named = sizes.select("run", "label", F.format_string("c%02d", F.row_number().over(order)).alias("cluster_id"))
    j = labelled.join(named, ["run", "label"], "left")
    rank = F.row_number().over(W.partitionBy("run", "label").orderBy(loud.desc(), "row_id"))
    return j.withColumn("rank", F.when(F.col("cluster_id").isNotNull(), rank))


def assembled(ranked: DataFrame, urls: int = 3) -> DataFrame:
    """One row per cluster of ``members``: counts, engagement (null if none is reported), cells and the first distinct urls."""
    c = ranked.filter("cluster_id is not null")
    panel = c.groupBy("run", "cluster_id").agg(
        F.count(F.lit(1)).alias("member_count"), F.count_distinct("author").alias("distinct_authors"), F.count_distinct("community").alias("distinct_communities"),
        F.sum("engagement_value").alias("engagement_sum"), F.array_join(F.array_sort(F.collect_set("cell_id")), ",").alias("cell_ids"),
    )
    best = c.filter("url is not null").groupBy("run", "cluster_id", "url").agg(F.min("rank").alias("rank"))
    first = best.withColumn("at", F.row_number().over(W.partitionBy("run", "cluster_id").orderBy("rank"))).filter(F.col("at") <= urls)
    listed = first.groupBy("run", "cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "url"))), lambda x: x["url"]), " ").alias("exemplar_urls"))
    return panel.join(listed, ["run", "cluster_id"], "left")


def advisory(ranked: DataFrame, vectors: DataFrame, pool_cuts: DataFrame, most: int = SPREAD) -> DataFrame:
    """Per run whether its clusters look fused: the share of the first one, and the widest pair among the loudest members of any.

    Only the first ``most`` members of a cluster are compared, as the reading is defined; clusters of fewer than three are left out.
    """
    c = ranked.filter("cluster_id is not null").join(vectors, "row_id").filter(F.col("rank") <= most)

    def widest(frame):
        frame = frame.sort_values("rank")
        spread = np.nan
        if len(frame) >= 3:
            x = np.stack(frame["v"].to_numpy()).astype(float)
            spread = np.maximum(0, 1 - x @ x.T)[np.triu_indices(len(x), 1)].max()
        return pd.DataFrame({"run": [frame["run"].iloc[0]], "cluster_id": [frame["cluster_id"].iloc[0]], "spread": [spread]})

    kind = ranked.schema["run"].dataType.simpleString()
    spread = c.select("run", "cluster_id", "rank", "v").groupBy("run", "cluster_id").applyInPandas(widest, f"run {kind}, cluster_id string, spread double")
    spread = spread.filter(~F.isnan("spread")).groupBy("run").agg(F.round(F.max("spread"), 6).alias("spread"))
    shares = ranked.groupBy("run").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("cluster_id") == "c01").alias("first"), F.count_if(F.col("cluster_id").isNull()).alias("unclustered"))
    j = shares.join(spread, "run", "left").join(pool_cuts.select(F.col("pool").alias("run"), "p75"), "run", "left").withColumn("share", F.round(F.col("first") / F.col("records"), 3))
    says = F.when(F.col("share") > 0.35, "one cluster holds too much").when(F.col("spread") > F.col("p75"), "members as far apart as strangers")
    return j.select("run", "records", "share", "spread", "p75", says.alias("advice"), (F.col("unclustered") > F.col("records") / 2).alias("mostly_unclustered"))
