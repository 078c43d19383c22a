"""Nearest centroids and k-means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.constants import SEED

#: A codebook beyond this many numbers is not sent to the workers.
MAX_CODEBOOK = 50_000_000


def codebook(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Cluster numbers and vectors, by number; the size is checked before it is collected."""
    size = centroids.agg(F.sum(F.size("vec"))).first()[0] or 0
    if size > MAX_CODEBOOK:
        raise ValueError(f"the codebook has {size} numbers")
    rows = sorted((r["cluster"], r["vec"]) for r in centroids.select("cluster", "vec").filter("vec is not null").collect())
    return np.array([c for c, _ in rows], dtype=np.int32), np.array([v for _, v in rows], dtype=float)


def assign(df: DataFrame, key: str, vector: str, centroids: DataFrame) -> DataFrame:
    """(key, cluster, distance2): the nearest centroid, the lower number of equally near ones; null vectors get null."""
    numbers, table = codebook(centroids)
    squares = (table**2).sum(1) if len(table) else np.zeros(0)
    rows = df.select(key, F.col(vector).cast("array<double>").alias(vector))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            valid = np.asarray(column.is_valid())
            cluster, distance = np.zeros(len(column), np.int32), np.zeros(len(column))
            if valid.any() and len(table):
                x = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(int(valid.sum()), -1)
                best = (squares - 2 * x @ table.T).argmin(1)
                cluster[valid], distance[valid] = numbers[best], ((x - table[best]) ** 2).sum(1)
            mask = ~valid if len(table) else np.ones(len(column), bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, mask=mask), pa.array(distance, mask=mask)], names=[key, "cluster", "distance2"])

    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, cluster int, distance2 double")


def inertia(assigned: DataFrame) -> DataFrame:
    """One row: the mean squared distance to the nearest centroid."""
    return assigned.agg(F.avg("distance2").alias("inertia"))


def fit(df: DataFrame, vector: str, clusters: int, max_iter: int = 100, runs: int = 20, seed: int = SEED) -> DataFrame:
    """(cluster, vec) of the best of ``runs`` fits by cost, each with its own seed."""
    data = df.filter(F.col(vector).isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features")).cache()
    best = None
    for i in range(runs):
        model = KMeans(k=clusters, initMode="k-means||", maxIter=max_iter, tol=0.0, seed=seed + i).fit(data)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    data.unpersist()
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(best.clusterCenters())]
    return df.sparkSession.createDataFrame(rows, "cluster int, vec array<double>")


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest center of each row, and its squared distance."""
    d = (x**2).sum(1)[:, None] - 2 * x @ centers.T + (centers**2).sum(1)
    best = d.argmin(1)
    return best, np.maximum(d[np.arange(len(x)), best], 0)


def _spread_out(x: np.ndarray, clusters: int, rng: np.random.Generator) -> np.ndarray:
    """First centers: rows drawn by their squared distance from those before."""
    centers = [x[rng.integers(len(x))]]
    far = ((x - centers[0]) ** 2).sum(1)
    for _ in range(clusters - 1):
        total = far.sum()
        centers.append(x[rng.choice(len(x), p=far / total) if total > 0 else rng.integers(len(x))])
        far = np.minimum(far, ((x - centers[-1]) ** 2).sum(1))
    return np.array(centers)


def fit_minibatch(df: DataFrame, vector: str, clusters: int, batch: int = 10_000, max_iter: int = 100, tol: float = 0.0, max_no_improvement: int = 100, n_init: int = 20, reassign: float = 0.0, pool: int = 500_000, seed: int = SEED) -> DataFrame:
    """(cluster, vec) by mini-batches: each moves the centers it is near to towards its rows, by the rows seen so far.

    Of ``n_init`` first choices on three batches the one of least cost goes on. It ends after ``max_iter``
    passes, when the smoothed cost of the batches has not improved ``max_no_improvement`` times in a
    row, or when the centers move less than ``tol`` (of the mean variance; 0 turns that off). With
    ``reassign``, centers with less than that share of the largest count are moved to rows of the
    batch. Mini-batches see a part of the data by design: they are drawn from one uniform sample of
    at most ``pool`` vectors, taken in one pass. Null vectors are left out; fewer vectors than
    ``clusters`` raise.
    """
    given = df.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    n = given.count()
    if n < clusters:
        raise ValueError(f"{n} vectors for {clusters} clusters")
    drawn = given if n <= pool else given.sample(min(1.0, pool / n), seed=seed)
    x = drawn.toArrow().column("v").combine_chunks()
    x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
    rng = np.random.default_rng(seed)
    pick = lambda k: x[rng.integers(len(x), size=min(k, len(x)))]
    check = pick(3 * batch)
    centers = min((_spread_out(pick(3 * batch), clusters, rng) for _ in range(n_init)), key=lambda c: _nearest(check, c)[1].sum())
    seen, smooth, best, stale = np.zeros(clusters), None, np.inf, 0
    share = min(1.0, 2 * batch / (n + 1))
    for _ in range(max(1, max_iter * n // batch)):
        rows = pick(batch)
        near, cost = _nearest(rows, centers)
        counts = np.bincount(near, minlength=clusters)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, rows)
        seen += counts
        moved = np.where(counts[:, None] > 0, (centers * (seen - counts)[:, None] + sums) / np.maximum(seen, 1)[:, None], centers)
        if reassign and (rare := np.flatnonzero(seen < reassign * seen.max())).size:
            moved[rare] = rows[rng.choice(len(rows), size=len(rare), replace=len(rare) > len(rows))]
        shift, centers = ((moved - centers) ** 2).sum(), moved
        smooth = cost.mean() if smooth is None else smooth * (1 - share) + cost.mean() * share
        stale = 0 if smooth < best else stale + 1
        best = min(best, smooth)
        if stale >= max_no_improvement or tol and shift < tol * x.var(0).mean():
            break
    return df.sparkSession.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(centers)], "cluster int, vec array<double>")
