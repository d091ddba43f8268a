"""K-means: best of several starts, fixed starts, and a grid over k."""

from __future__ import annotations

from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import squared_distance
from ..session import stage
from .blocks import vector
from .scores import calinski_harabasz, davies_bouldin, silhouettes

# Starts and scores whose jobs are submitted side by side.
PARALLEL_FITS = 8


def by_size(points: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Cluster labels renumbered from 0 by descending size, then by smallest member."""
    sizes = points.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    order = F.sort_array(
        F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("first"), F.col(cluster).alias("c")))
    )
    places = sizes.agg(F.transform(order, lambda s: s["c"]).alias("o")).scalar()
    return points.withColumn(cluster, (F.array_position(places, F.col(cluster)) - 1).cast("int"))


def _vectors(points: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="_vector").transform(points).withColumn("_x", vector(cols)).persist()


def _starts(vectors: DataFrame, runs: list[tuple[int, int]]) -> list[np.ndarray]:
    """Centers that all (k, seed) runs begin with."""

    def start(run: tuple[int, int]) -> np.ndarray:
        k, seed = run
        model = KMeans(k=k, seed=seed, maxIter=0, featuresCol="_vector", predictionCol="cluster").fit(vectors)
        return np.stack([np.asarray(c, dtype=float) for c in model.clusterCenters()])

    with ThreadPool(PARALLEL_FITS) as pool:
        return pool.map(start, runs, chunksize=1)


def _sums(runs: dict[int, np.ndarray]):
    """Per run and center the number and the sum of the points nearest to it and their squared distances, over the rows of a task."""
    tops = np.cumsum([len(c) for c in runs.values()])
    centers = np.concatenate(list(runs.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, cost, total = np.zeros(len(centers), np.int64), np.zeros(len(centers)), np.zeros(centers.shape)
        for batch in batches:
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, centers.shape[1])
            for at in range(0, len(x), 4_096):
                some = x[at : at + 4_096]
                gaps = (some * some).sum(1)[:, None] - 2 * some @ centers.T + (centers * centers).sum(1)
                for top, own in zip(tops, runs.values()):
                    best = gaps[:, top - len(own) : top].argmin(1)
                    place = best + top - len(own)
                    n += np.bincount(place, minlength=len(n))
                    cost += np.bincount(place, weights=np.maximum(gaps[np.arange(len(some)), place], 0.0), minlength=len(n))
                    total[top - len(own) : top] += (best == np.arange(len(own))[:, None]).astype(float) @ some
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"center": used, "n": n[used], "cost": cost[used], **{f"s{d}": total[used, d] for d in range(centers.shape[1])}})

    return run


def _fit_all(vectors: DataFrame, runs: list[tuple[int, int]], max_iter: int, tol: float) -> list[tuple[float, list[list[float]]]]:
    """(cost, centers) of all (k, seed) runs.

    All starts move together: one pass over the points serves every run whose centers still move farther than ``tol``. The cost is that of
    the last pass, a center without points stays where it is, and only centers and sums pass through the driver.
    """
    centers, costs = dict(enumerate(_starts(vectors, runs))), {}
    moving = dict(centers) if max_iter else {}
    for _ in range(max_iter):
        if not moving:
            break
        dims = next(iter(moving.values())).shape[1]
        sums = [f"s{d}" for d in range(dims)]
        layout = "center long, n long, cost double, " + ", ".join(f"{s} double" for s in sums)
        found = vectors.select("_x").mapInArrow(_sums(moving), layout).groupBy("center").agg(*[F.sum(c).alias(c) for c in ("n", "cost", *sums)])
        rows = {r["center"]: r for r in found.collect()}
        first = 0
        for run, old in list(moving.items()):
            own = [rows.get(first + c) for c in range(len(old))]
            first += len(old)
            new = np.stack([old[c] if r is None else np.array([r[s] for s in sums]) / r["n"] for c, r in enumerate(own)])
            costs[run] = sum(r["cost"] for r in own if r is not None)
            centers[run] = new
            if (((new - old) ** 2).sum(1) <= tol * tol).all():
                del moving[run]
            else:
                moving[run] = new
    return [(costs.get(run, 0.0), centers[run].tolist()) for run in centers]


def _cheapest(fits: list[tuple[float, list[list[float]]]]) -> list[list[float]]:
    return min(fits, key=lambda fit: fit[0])[1]


def kmeans(points: DataFrame, cols: list[str], k: int = 2, n_init: int = 10, seed: int = 42, max_iter: int = 300, tol: float = 1e-4) -> DataFrame:
    """``points`` with ``cluster``: the start of lowest cost among ``n_init`` seeded ones."""
    vectors = _vectors(points, cols)
    try:
        centers = _cheapest(_fit_all(vectors, [(k, seed + i) for i in range(n_init)], max_iter, tol))
    finally:
        vectors.unpersist()
    return stage(by_size(stage(points.withColumn("cluster", nearest_center(cols, centers)), "kmeans")), "labels")


def nearest_center(cols: list[str], centers: list[list[float]]) -> Column:
    """Index of the nearest of a few centers, the first on ties."""
    gaps = F.array(*[squared_distance([F.col(c) for c in cols], [F.lit(float(v)) for v in center]) for center in centers])
    return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")


def kmeans_lloyd(points: DataFrame, cols: list[str], centers: list[list[float]], iters: int) -> DataFrame:
    """``points`` with ``cluster`` after ``iters`` moves of the given centers.

    Only the k centers pass through the driver; a center without points stays where it is.
    """
    data = points.select(*cols).persist()
    centers = [list(map(float, c)) for c in centers]
    for _ in range(iters):
        moved = data.groupBy(nearest_center(cols, centers).alias("c")).agg(*[F.avg(c).alias(c) for c in cols]).collect()
        for row in moved:
            centers[row["c"]] = [row[c] for c in cols]
    data.unpersist()
    return points.withColumn("cluster", nearest_center(cols, centers))


def kmeans_grid(points: DataFrame, cols: list[str], ks: range = range(2, 7), n_init: int = 10, seed: int = 42) -> DataFrame:
    """(k, silhouette, davies_bouldin, calinski_harabasz) for each k."""
    vectors = _vectors(points, cols)
    try:
        runs = [(k, seed + i) for k in ks for i in range(n_init)]
        fits = _fit_all(vectors, runs, 300, 1e-4)
        labels = {k: nearest_center(cols, _cheapest([f for f, run in zip(fits, runs) if run[0] == k])).alias(f"c{k}") for k in ks}
    finally:
        vectors.unpersist()
    labelled = stage(points.select("id", *cols, *labels.values()), "labels")

    def scores(k: int) -> tuple:
        return tuple(t.first()[0] for t in (davies_bouldin(labelled, cols, f"c{k}"), calinski_harabasz(labelled, cols, f"c{k}")))

    with ThreadPool(PARALLEL_FITS) as pool:
        others = pool.map(scores, list(ks), chunksize=1)
    near = {r["clustering"]: r["silhouette"] for r in silhouettes(labelled, cols, [f"c{k}" for k in ks]).collect()}
    rows = [(k, near.get(n), *other) for n, (k, other) in enumerate(zip(ks, others))]
    return points.sparkSession.createDataFrame(rows, "k int, silhouette double, davies_bouldin double, calinski_harabasz double")
