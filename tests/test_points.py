"""Point operators against brute force in numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeloom.operators import blocks, hierarchy, kmeans, neighbors, projection, scaling, scores

COLS = ["x", "y"]


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    parts = [rng.normal((0, 0), 0.4, (60, 2)), rng.normal((5, 5), 0.6, (50, 2)), rng.uniform(-4, 9, (25, 2)), np.full((30, 2), 2.5)]
    return np.round(np.concatenate(parts), 3)


@pytest.fixture(scope="module")
def points(spark, cloud):
    rows = [(f"p{i:03d}", float(a), float(b)) for i, (a, b) in enumerate(cloud)]
    return spark.createDataFrame(rows, "id string, x double, y double")


@pytest.fixture(params=[False, True])
def limits(request, monkeypatch):
    """Second run: tiny blocks and hot-key limits, so that every path is taken."""
    if request.param:
        from routeloom import skew

        monkeypatch.setattr(skew, "HOT_ROWS", 8)
        monkeypatch.setattr(blocks.pack, "__defaults__", ([], 7))
        monkeypatch.setattr(blocks, "FAN_OUT", 3)
        monkeypatch.setattr(blocks, "_NUMBERS", 4)


def distances(cloud):
    return np.sqrt(((cloud[:, None] - cloud[None]) ** 2).sum(2))


def test_within_counts(points, cloud, limits):
    want = (distances(cloud) <= 1.0).sum(1)
    got = {r["id"]: r["n_within"] for r in neighbors.within(points, COLS, 1.0).collect()}
    assert got == {f"p{i:03d}": int(n) for i, n in enumerate(want)}


def test_knn(points, cloud, limits):
    d = distances(cloud)
    got = {}
    for r in neighbors.knn(points, COLS, 5).collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["nbr"], r["dist"])
    assert len(got) == len(cloud)
    for i in range(len(cloud)):
        order = sorted(range(len(cloud)), key=lambda j: (d[i, j], j != i, j))[:5]
        mine = [got[f"p{i:03d}"][k] for k in range(1, 6)]
        assert [m[0] for m in mine] == [f"p{j:03d}" for j in order]
        assert np.allclose([m[1] for m in mine], d[i, order])


def test_dbscan(points, cloud, limits):
    near = distances(cloud) <= 1.0
    core = near.sum(1) >= 5
    label, names = np.full(len(cloud), -1), 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if label[j] < 0:
                label[j] = names
                todo += [k for k in np.flatnonzero(near[j] & core) if label[k] < 0]
        names += 1
    for i in np.flatnonzero(~core):
        reach = label[near[i] & core]
        label[i] = reach.min() if len(reach) else -1
    got = {r["id"]: (r["cluster"], r["core"]) for r in neighbors.dbscan(points, COLS, 1.0, 5).collect()}
    assert got == {f"p{i:03d}": (int(label[i]), bool(core[i])) for i in range(len(cloud))}


def test_scores(points, cloud, limits):
    labelled = points.withColumn("cluster", F.when(F.col("x") + F.col("y") > 6, 1).when(F.col("id") == "p000", 2).otherwise(0))
    lab = np.where(cloud.sum(1) > 6, 1, 0)
    lab[0] = 1 if cloud[0].sum() > 6 else 2
    d, values = distances(cloud), []
    for i in range(len(cloud)):
        own = lab == lab[i]
        if own.sum() == 1:
            values.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) - {lab[i]})
        values.append((b - a) / max(a, b))
    assert math.isclose(scores.silhouette(labelled, COLS).first()[0], float(np.mean(values)), rel_tol=1e-9)
    centers = np.stack([cloud[lab == c].mean(0) for c in range(3)])
    spread = [np.sqrt(((cloud[lab == c] - centers[c]) ** 2).sum(1)).mean() for c in range(3)]
    db = np.mean([max((spread[i] + spread[j]) / np.linalg.norm(centers[i] - centers[j]) for j in range(3) if j != i) for i in range(3)])
    assert math.isclose(scores.davies_bouldin(labelled, COLS).first()[0], db, rel_tol=1e-9)
    w = sum(((cloud[lab == c] - centers[c]) ** 2).sum() for c in range(3))
    b = sum((lab == c).sum() * ((centers[c] - cloud.mean(0)) ** 2).sum() for c in range(3))
    assert math.isclose(scores.calinski_harabasz(labelled, COLS).first()[0], (b / 2) / (w / (len(cloud) - 3)), rel_tol=1e-9)


def test_blocks_are_bounded(points, cloud):
    merged = blocks.distinct_points(points, COLS)
    packed = blocks.pack(merged, len(COLS), ["weight"], size=16)
    sizes = [r[0] for r in packed.select(F.size("ids")).collect()]
    assert max(sizes) <= 16 and sum(sizes) == len(np.unique(cloud, axis=0))
    assert merged.agg(F.sum("weight")).first()[0] == len(cloud)


def test_standardize_uses_population_deviation(spark):
    df = spark.createDataFrame([(1, 1.0, 3.0), (2, 3.0, 3.0)], "id int, a double, b double")
    assert [(r["a"], r["b"]) for r in scaling.standardize(df, ["a", "b"]).orderBy("id").collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_kmeans_finds_plain_groups(points, cloud):
    found = kmeans.kmeans(points.filter("id < 'p110'"), COLS, 2, n_init=3)
    groups = {r["id"]: r["cluster"] for r in found.collect()}
    assert {groups[f"p{i:03d}"] for i in range(60)} == {0} and {groups[f"p{i:03d}"] for i in range(60, 110)} == {1}


def test_lloyd_keeps_an_empty_center(points):
    centers = [[0.0, 0.0], [5.0, 5.0], [1000.0, 1000.0]]
    labels = {r[0] for r in kmeans.kmeans_lloyd(points, COLS, centers, 3).select("cluster").distinct().collect()}
    assert labels == {0, 1}


def test_pca_matches_eigenvectors(points, cloud):
    projected, shares = projection.pca(points, COLS)
    centered = cloud - cloud.mean(0)
    values, vectors = np.linalg.eigh(np.cov(centered.T))
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), range(2)])
    assert np.allclose(shares, values / values.sum())
    got = np.array([[r["pca_1"], r["pca_2"]] for r in projected.orderBy("id").collect()])
    assert np.allclose(got, centered @ vectors)


def plain_ward(cloud):
    clusters = {i: (1, p) for i, p in enumerate(cloud)}
    merges = []
    while len(clusters) > 1:
        names = sorted(clusters)
        cost, a, b = min(
            (2 * clusters[a][0] * clusters[b][0] / (clusters[a][0] + clusters[b][0]) * ((clusters[a][1] - clusters[b][1]) ** 2).sum(), a, b)
            for i, a in enumerate(names) for b in names[i + 1 :]
        )
        (n, x), (m, y) = clusters.pop(a), clusters.pop(b)
        clusters[min(a, b)] = (n + m, (n * x + m * y) / (n + m))
        merges.append((math.sqrt(cost), n, m))
    return merges


@pytest.mark.parametrize("few", [256, 3])
def test_ward_tree(spark, cloud, few, monkeypatch):
    monkeypatch.setattr(hierarchy, "LAST_CLUSTERS", few)
    monkeypatch.setattr(blocks.pack, "__defaults__", ([], 16))
    some = cloud[::2]
    df = spark.createDataFrame([(f"q{i:02d}", float(a), float(b)) for i, (a, b) in enumerate(some)], "id string, x double, y double")
    want = plain_ward(some)[-9:]
    rows = hierarchy.ward_tree(df, COLS, groups=10).orderBy("step").collect()
    assert np.allclose([r["height"] for r in rows], [m[0] for m in want])
    assert [{r["left_size"], r["right_size"]} for r in rows] == [{m[1], m[2]} for m in want]
    assert sorted(x for r in rows for x in (r["left"], r["right"])) == list(range(18)) and rows[-1]["size"] == len(some)


def test_tiles_meet_once_however_many_blocks(spark, points, cloud):
    """Pairs of tiles, not pairs of blocks, move: 45 blocks here, at most 16 tiles."""
    from routeloom.operators import tiles

    packed = blocks.pack(blocks.distinct_points(points, COLS), 2, ["weight"], size=3)

    def run(left, right):
        return left.select([]).append_column("n", [[len(left)] * len(left)]).slice(0, 1).append_column("m", [[len(right)]])

    rows = tiles.tiled(packed, run, "n long, m long", ["block", "xs"], ["block"]).collect()
    count = packed.count()
    assert count > tiles.TILES and len(rows) <= tiles.TILES**2 and sum(r.n * r.m for r in rows) == count**2


def test_distances_by_product_are_exact_where_it_matters():
    from routeloom.operators import tiles

    rng = np.random.default_rng(4)
    x, y = 1e6 + rng.normal(size=(40, 8)), 1e6 + rng.normal(size=(50, 8))
    y[:10] = x[:10]
    d2 = ((x[:, None] - y[None]) ** 2).sum(2)
    assert np.array_equal(tiles.within(x, y, d2[20, 30]), d2 <= d2[20, 30])
    assert np.allclose(tiles.distances(x, y), np.sqrt(d2), rtol=1e-8, atol=0)
    x[0, 0], y[5, 1] = np.nan, np.inf
    with np.errstate(invalid="ignore"):
        assert np.array_equal(tiles.within(x, y, 4.0), ((x[:, None] - y[None]) ** 2).sum(2) <= 4.0)


def test_starts_that_move_together_end_like_single_fits(spark, points):
    from pyspark.ml.clustering import KMeans

    vectors, runs = kmeans._vectors(points, COLS), [(2, 1), (3, 7)]
    fits = kmeans._fit_all(vectors, runs, 300, 1e-4)
    for (k, seed), (cost, centers) in zip(runs, fits):
        model = KMeans(k=k, seed=seed, maxIter=300, tol=1e-4, featuresCol="_vector").fit(vectors)
        assert np.allclose(sorted(centers), sorted(c.tolist() for c in model.clusterCenters()))
        assert math.isclose(cost, model.summary.trainingCost, rel_tol=1e-6)
