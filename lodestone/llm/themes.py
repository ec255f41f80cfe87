"""Clusters of similar records by spectral clustering with power iterations.

The affinity of two records is the dot product of their weighted terms. It is never
written down: with X the records-by-terms matrix and D the records' degrees, one
step multiplies the vectors by ``D^-1/2 X X' D^-1/2`` in two halves, from terms to
records and back. Records stay where they are; between steps only a terms-by-vectors
matrix moves, whose size is fixed by two parameters.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normal import REMOVAL_MARKS, letters
from ..runtime import cut, table, worker_cache

HASHED, TERMS, VECTORS = 65_536, 2_048, 44
LEAST_CLUSTERS, MOST_CLUSTERS = 10, 40
#: The weight of a term is this power of its idf: what most records have weighs next to nothing, and no share of the records is a limit.
FADE = 3
#: Steps that are always made, steps at most, and the relative change of the eigenvalues' sum at which they end.
STEPS, MOST_STEPS, STILL = 7, 24, 0.005
LLOYD, SEEDS = 4, 8_000
_WORD = re.compile(r"[^\W\d_]{3,}")


class _Terms(dict):
    def __missing__(self, word):
        import xxhash

        if len(self) > 2_000_000:
            self.clear()
        # Plural and singular are one term.
        stem = word[:-1] if len(word) > 4 and word.endswith("s") and not word.endswith("ss") else word
        h = self[word] = xxhash.xxh32_intdigest(stem) % HASHED
        return h


def hashed_terms(rows: DataFrame) -> DataFrame:
    """``(row_id, terms)``: the distinct hashed words of title and text as packed 16-bit numbers."""

    def run(batches):
        get = worker_cache("terms", _Terms).__getitem__
        for batch in batches:
            out = []
            for title, text in zip(batch.column("title").to_pylist(), batch.column("text").to_pylist()):
                seen = set(map(get, _WORD.findall(f"{title or ''} {text or ''}".lower())))
                out.append(np.fromiter(seen, np.uint16, count=len(seen)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(out, pa.binary())], names=["row_id", "terms"])

    return rows.select("row_id", "title", "text").mapInArrow(run, "row_id bigint, terms binary")


def _flat(batch) -> tuple[np.ndarray, np.ndarray]:
    """All terms of a batch and how many each record has."""
    parts = batch.column("terms").to_pylist()
    return np.frombuffer(b"".join(parts), np.uint16), np.array([len(p) // 2 for p in parts], np.int64)


def _summed(df: DataFrame, width: int, compute) -> np.ndarray:
    """The sum over partitions of a ``rows x width`` matrix that ``compute(batches)`` yields once a partition.

    Rows travel as records and are added by an aggregation, so the driver receives one
    matrix, however many partitions there are.
    """

    def run(batches):
        total = compute(batches)
        if total is None:
            return
        some = np.nonzero(np.any(total != 0, axis=1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(total[some, j].astype(np.float64)) for j in range(width))],
                                         names=["at", *(f"v{j}" for j in range(width))])

    parts = df.mapInArrow(run, "at int, " + ", ".join(f"v{j} double" for j in range(width)))
    rows = parts.groupBy("at").agg(*[F.sum(f"v{j}").alias(f"v{j}") for j in range(width)]).toPandas()
    top = int(rows["at"].max()) + 1 if len(rows) else 0
    out = np.zeros((top, width))
    if top:
        out[rows["at"].to_numpy()] = rows[[f"v{j}" for j in range(width)]].to_numpy()
    return out


def _grown(matrix: np.ndarray, rows: int) -> np.ndarray:
    out = np.zeros((rows, matrix.shape[1]))
    out[: min(rows, len(matrix))] = matrix[:rows]
    return out


def _dense(batch, place: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Records by chosen terms, every record of unit length (or zero)."""
    flat, sizes = _flat(batch)
    at = place[flat]
    row = np.repeat(np.arange(len(sizes)), sizes)
    keep = at >= 0
    x = np.zeros((len(sizes), len(weight)), np.float32)
    x[row[keep], at[keep]] = weight[at[keep]]
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    x /= np.where(norm > 0, norm, 1)[:, None]
    return x


def _blocks(batches, rows: int = 2048):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Themes:
    """A spectral clustering of records, fitted over all of them."""

    def __init__(self, terms: DataFrame, k: int | None = None, seed: int = 11):
        self.terms = terms
        found = _summed(terms, 1, lambda it: sum((np.bincount(_flat(b)[0], minlength=HASHED) for b in it), np.zeros(HASHED)).reshape(-1, 1))
        counts = _grown(found, HASHED)[:, 0]
        n = self.n = terms.count()
        # A term that every record has tells none apart.
        ranked = np.argsort(-np.where((counts < n) & (counts >= min(3, n)), counts, 0), kind="stable")[:TERMS]
        self.chosen = ranked[(counts[ranked] > 0) & (counts[ranked] < n)]
        self.place = np.full(HASHED, -1, np.int32)
        self.place[self.chosen] = np.arange(len(self.chosen))
        self.weight = (np.log(n / counts[self.chosen]) ** FADE).astype(np.float32) if len(self.chosen) else np.zeros(0, np.float32)
        self.k, self.centers, self.steps, self.moved = 0, np.zeros((0, 0)), 0, None
        if len(self.chosen) >= 2 * LEAST_CLUSTERS:
            self._iterate(seed)
            self._divide(k, seed)

    def _iterate(self, seed: int) -> None:
        place, weight, terms = self.place, self.weight, len(self.chosen)
        mass = _grown(_summed(self.terms, 1, lambda it: sum((_dense(b, place, weight).sum(axis=0, dtype=np.float64) for b in _blocks(it)), np.zeros(terms)).reshape(-1, 1)), terms)
        self.mass = mass[:, 0].astype(np.float32)
        vectors = min(VECTORS, terms // 2)
        y = np.random.default_rng(seed).standard_normal((terms, vectors)).astype(np.float32)
        total = self.mass

        before = None
        for step in range(MOST_STEPS):

            def multiply(batches, y=y):
                out = np.zeros((terms + vectors, vectors))
                for b in _blocks(batches):
                    x = _dense(b, place, weight)
                    degree = x @ total
                    scale = 1 / np.sqrt(np.where(degree > 0, degree, np.inf))
                    u = (x @ y) * scale[:, None]
                    out[:terms] += x.T @ (u * scale[:, None])
                    out[terms:] += u.T @ u
                return out

            both = _grown(_summed(self.terms, vectors, multiply), terms + vectors)
            gram = both[terms:] + 1e-9 * np.trace(both[terms:]) / vectors * np.eye(vectors)
            turn = np.linalg.inv(np.linalg.cholesky(gram)).T
            # The records' vectors become orthonormal by the same change of basis that is applied to the terms' side.
            y = (both[:terms] @ turn).astype(np.float32)
            # With orthonormal records' vectors, the trace of what a step makes of them is the sum of the eigenvalues found.
            now = float(np.sum(y.astype(np.float64) ** 2))
            self.steps, self.moved = step + 1, None if before is None else abs(now - before) / max(now, 1e-12)
            before = now
            if step + 1 >= STEPS and self.moved <= STILL:
                break
        values, basis = np.linalg.eigh(y.astype(np.float64).T @ y)
        self.values, self.y = values[::-1], (y @ basis[:, ::-1]).astype(np.float32)

    def _divide(self, k: int | None, seed: int) -> None:
        if k is None:
            values = self.values
            most = min(MOST_CLUSTERS, len(values) - 1)
            gaps = values[LEAST_CLUSTERS - 1 : most] / np.maximum(values[LEAST_CLUSTERS : most + 1], 1e-12)
            k = LEAST_CLUSTERS + int(np.argmax(gaps)) if len(gaps) else LEAST_CLUSTERS
        self.k = min(k, self.y.shape[1])
        basis = self.y[:, : self.k]
        place, weight, total = self.place, self.weight, self.mass

        def embed(batches):
            for b in _blocks(batches):
                x = _dense(b, place, weight)
                e = x @ basis
                norm = np.sqrt(np.einsum("ij,ij->i", e, e))
                e = (e / np.where(norm > 0, norm, 1)[:, None]).astype(np.float32)
                offsets = pa.array(np.arange(0, e.size + 1, e.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.ListArray.from_arrays(offsets, pa.array(e.ravel()))], names=["row_id", "e"])

        self.embedded = cut(self.terms.mapInArrow(embed, "row_id bigint, e array<float>"), "embedding")
        # Starting points come from a bounded sample; the centers are then moved by all records.
        share = min(1.0, SEEDS / max(1, self.n))
        drawn = F.pmod(F.xxhash64(F.lit(seed), "row_id"), F.lit(1_000_000)) < int(1_000_000 * share)
        sample = self.embedded.filter(drawn).limit(2 * SEEDS).toPandas()
        points = np.stack(sample["e"].to_numpy()) if len(sample) else np.zeros((0, self.k))
        centers = _best_start(points, self.k, seed)
        width = self.k

        for _ in range(LLOYD):

            def move(batches, centers=centers):
                out = np.zeros((width, width + 1))
                for b in batches:
                    e = _matrix(b, width)
                    at = np.argmax(e @ centers.T, axis=1)
                    for c in np.unique(at):
                        out[c, :width] += e[at == c].sum(axis=0)
                    out[:, width] += np.bincount(at, minlength=width)
                return out

            sums = _grown(_summed(self.embedded, width + 1, move), width)
            norm = np.linalg.norm(sums[:, :width], axis=1)
            centers = np.where(norm[:, None] > 0, sums[:, :width] / np.where(norm > 0, norm, 1)[:, None], centers).astype(np.float32)
        self.centers = centers

    def labels(self) -> DataFrame:
        """``(row_id, cluster, closeness)`` of every record; cluster -1 for records without a chosen term."""
        if not self.k:
            return self.terms.select("row_id", F.lit(-1).alias("cluster"), F.lit(0.0).alias("closeness"))
        centers, width = self.centers, self.k

        def run(batches):
            for b in batches:
                e = _matrix(b, width)
                near = e @ centers.T
                at = np.argmax(near, axis=1)
                none = ~np.any(e != 0, axis=1)
                yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array(np.where(none, -1, at).astype(np.int32)), pa.array(near.max(axis=1).astype(np.float64))],
                                                 names=["row_id", "cluster", "closeness"])

        return self.embedded.mapInArrow(run, "row_id bigint, cluster int, closeness double")

    def typical(self) -> DataFrame:
        """``(row_id, cluster, affinity)``: the mean affinity of each record to its cluster's members."""
        if not self.k:
            return self.labels().select("row_id", "cluster", F.lit(0.0).alias("affinity"))
        place, weight, basis, centers, width, terms = self.place, self.weight, self.y[:, : self.k], self.centers, self.k, len(self.chosen)

        def assigned(x):
            return np.argmax((x @ basis) @ centers.T, axis=1)

        def gather(batches):
            out = np.zeros((width, terms + 1))
            for b in _blocks(batches):
                x = _dense(b, place, weight)
                at = assigned(x)
                hot = np.zeros((width, len(at)), np.float32)
                hot[at, np.arange(len(at))] = np.any(x != 0, axis=1)
                out[:, :terms] += hot @ x
                out[:, terms] += hot.sum(axis=1)
            return out.T

        sums = _grown(_summed(self.terms, width, gather), terms + 1).T
        means = (sums[:, :terms] / np.maximum(sums[:, terms:], 1)).astype(np.float32)

        def run(batches):
            for b in _blocks(batches):
                x = _dense(b, place, weight)
                at = assigned(x)
                none = ~np.any(x != 0, axis=1)
                value = np.einsum("ij,ij->i", x, means[at])
                yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array(np.where(none, -1, at).astype(np.int32)), pa.array(value.astype(np.float64))],
                                                 names=["row_id", "cluster", "affinity"])

        return self.terms.mapInArrow(run, "row_id bigint, cluster int, affinity double")


def _matrix(batch, width: int) -> np.ndarray:
    column = batch.column("e")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _best_start(points: np.ndarray, k: int, seed: int, tries: int = 4) -> np.ndarray:
    """k-means++ with a few Lloyd steps on the sample; the best of some tries."""
    best, best_value = np.zeros((k, k), np.float32), -np.inf
    if not len(points):
        return best
    for t in range(tries):
        rng = np.random.default_rng(seed + t)
        centers = [points[rng.integers(len(points))]]
        far = 1 - points @ centers[0]
        while len(centers) < k:
            p = np.maximum(far, 0) ** 2
            pick = rng.choice(len(points), p=p / p.sum()) if p.sum() > 0 else rng.integers(len(points))
            centers.append(points[pick])
            far = np.minimum(far, 1 - points @ points[pick])
        centers = np.stack(centers)
        for _ in range(12):
            near = points @ centers.T
            at = np.argmax(near, axis=1)
            for c in range(k):
                if np.any(at == c):
                    m = points[at == c].sum(axis=0)
                    centers[c] = m / max(np.linalg.norm(m), 1e-12)
        value = (points @ centers.T).max(axis=1).sum()
        if value > best_value:
            best, best_value = centers.astype(np.float32), value
    return best


def themes(rows: DataFrame, k: int | None = None) -> Themes:
    """Cluster ``(row_id, title, text)`` into ``k`` clusters, or as many as the eigenvalues show.

    All rows take part and are counted. A null title or text is empty; rows with no
    term but such as are rare or in every row belong to cluster -1, as do all rows of a
    table too small to have twenty such terms. Repeated rows are rows.
    """
    text = F.when((F.length("text") > 60) | ~letters(F.col("text")).isin(*REMOVAL_MARKS), F.col("text"))
    return Themes(cut(hashed_terms(rows.select("row_id", "title", text.alias("text"))), "terms"), k)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audited pairs whose rows are in the same cluster."""
    labels = themes(table(spark, sf_dir, "evidence_sample")).labels().filter("cluster >= 0")
    pairs = table(spark, sf_dir, "cluster_audit").select("row_id_a", "row_id_b")
    wanted = pairs.select(F.explode(F.array("row_id_a", "row_id_b")).alias("row_id")).distinct()
    known = cut(labels.join(wanted, "row_id", "left_semi").select("row_id", "cluster"), "audited")
    one = known.select(F.col("row_id").alias("row_id_a"), F.col("cluster").alias("one"))
    two = known.select(F.col("row_id").alias("row_id_b"), F.col("cluster").alias("two"))
    return pairs.join(one, "row_id_a").join(two, "row_id_b").filter("one = two").select("row_id_a", "row_id_b")


def p5_clusters(spark: SparkSession, sf_dir: str, members: int = 5) -> DataFrame:
    """Every cluster with its size and its most typical rows, most typical first."""
    from pyspark.sql import Window as W

    ranked = cut(themes(table(spark, sf_dir, "evidence_sample")).typical().filter("cluster >= 0"), "typical")
    sizes = ranked.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    # Each partition keeps its best rows first, so no cluster meets in one task as a whole.
    part = ranked.withColumn("part", F.pmod(F.xxhash64("row_id"), F.lit(256)))
    order = [F.desc("affinity"), F.asc("row_id")]
    best = part.withColumn("at", F.row_number().over(W.partitionBy("cluster", "part").orderBy(*order))).filter(F.col("at") <= members)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("cluster").orderBy(*order))).filter(F.col("rank") <= members)
    return best.join(sizes, "cluster").select("cluster", "size", "rank", "row_id", F.round("affinity", 4).alias("affinity"))


QUERIES = {"p5_found": p5_found, "p5_clusters": p5_clusters}
ORACLES: dict[str, str] = {}
