"""Radius counts, nearest neighbours and density clustering on blocks of points."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from ..skew import hot_keys, lookup, salted_join
from . import tiles
from .blocks import aligned, distinct_points, link_copies, pack, vector, whole_numbered
from .components import components
from .ranks import row_numbers

HEAD = ["block", "low", "high"]
# A group of cores goes by its block and its place there.
_GROUPS = 1 << 16


def _count_within(dims: int, eps2: float):
    """Per left point the weight within reach on the right."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        l, r = tiles.Side(left, dims), tiles.Side(right, dims)
        weight = r.values("weight").astype(float)
        mass = np.add.reduceat(weight, r.bounds[:-1])
        n = np.zeros(len(l.x))
        for block in range(len(l.block)):
            near, far = l.gaps(r, block)
            # Blocks that lie wholly within reach need no distances.
            sure = far <= eps2 * (1 - 1e-12)
            own = l.rows(block)
            n[own] += mass[sure].sum()
            for part in r.parts(np.flatnonzero((near <= eps2 * (1 + 1e-9)) & ~sure)):
                n[own] += tiles.within(l.x[own], r.x[part], eps2) @ weight[part]
        return pa.table({"pid": l.values("ids"), "n": n})

    return run


def _within_blocks(blocks: DataFrame, dims: int, eps: float) -> DataFrame:
    """(pid, n_within) of merged points, themselves and their copies included."""
    eps2 = eps * eps
    counted = tiles.tiled(blocks, _count_within(dims, eps2), "pid long, n double", [*HEAD, "ids", "xs"], [*HEAD, "xs", "weight"], eps2)
    return counted.groupBy("pid").agg(F.sum("n").cast("bigint").alias("n_within"))


def within(points: DataFrame, cols: list[str], eps: float) -> DataFrame:
    """(id, n_within): points within ``eps`` of each point, itself included.

    Counts instead of pairs: a dense region has quadratically many pairs, but one count per point.
    """
    merged = distinct_points(points, cols)
    counts = _within_blocks(pack(merged, len(cols), ["weight"]), len(cols), eps)
    return link_copies(points, merged, cols).join(counts, "pid").select("id", "n_within")


def _own_reach(dims: int, k: int):
    """Squared distance within which every point of a block has ``k`` neighbours there, infinite without so many."""

    @F.pandas_udf("double")
    def run(xs: pd.Series) -> pd.Series:
        out = []
        for x in xs:
            x = np.reshape(np.asarray(x, dtype=float), (-1, dims))
            found, slack = tiles.squared(x, x)
            last = np.partition(found, k - 1, axis=1)[:, k - 1] if len(x) >= k else np.full(1, np.inf)
            out.append(float(np.where(np.isnan(last), np.inf, last + slack).max()))
        return pd.Series(out, dtype=float)

    return run


def _nearest(dims: int, k: int):
    """Nearest ``k`` on the right of each left point, ties to the smaller number."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        l, r = tiles.Side(left, dims), tiles.Side(right, dims)
        pids, names, reach = l.values("ids"), r.values("ids"), left.column("reach").to_numpy()
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for block in range(len(l.block)):
            own = l.rows(block)
            x = l.x[own]
            row, place, d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            edge = np.full(len(x), np.inf)
            near, _ = l.gaps(r, block)
            todo = np.flatnonzero(near <= reach[block] * (1 + 1e-9))
            for part in r.parts(todo[np.argsort(near[todo], kind="stable")]):
                rough, slack = tiles.squared(x, r.x[part])
                take = min(k, len(part)) - 1
                limit = np.fmin(np.partition(rough, take, axis=1)[:, take], edge) + 2 * slack
                i, j = np.nonzero(rough <= limit[:, None])
                row, place = np.concatenate([row, i]), np.concatenate([place, part[j]])
                d = np.concatenate([d, tiles.exact(x, r.x[part], i, j)])
                order = np.lexsort((names[place], d, row))
                row, place, d = row[order], place[order], d[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                edge[row[rank == k - 1]] = d[rank == k - 1]
                row, place, d = row[rank < k], place[rank < k], d[rank < k]
            found.append((pids[own][row], names[place], d))
        return pa.table(dict(zip(("pid", "nbr", "d"), map(np.concatenate, zip(*found)))))

    return run


def _first_copies(points: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Points split by their place among their own copies: the first ``k``, and the rest.

    Only the first ``k`` copies of a place can be anyone's neighbours, apart from a point itself.
    """
    sorted_rows = row_numbers(points, ["x", "pid"], "_rn")
    starts = sorted_rows.groupBy("x").agg(F.min("_rn").alias("_start"))
    placed = stage(
        lookup(sorted_rows, starts, ["x"], "inner", hot_keys(sorted_rows, ["x"]))
        .withColumn("_place", F.col("_rn") - F.col("_start") + 1)
        .drop("_rn"),
        "copies",
    )
    return placed.filter(F.col("_place") <= k), placed.filter(F.col("_place") > k)


def knn(points: DataFrame, cols: list[str], k: int = 5) -> DataFrame:
    """(id, nbr, dist, rank): the ``k`` nearest points of each point, itself first.

    Ties go to the smaller id. A first pass inside each block bounds how far the neighbours of its
    points can be; only block pairs within that bound are compared.
    """
    dims = len(cols)
    named = stage(whole_numbered(points.select("id", vector(cols)), "id"), "named")
    few, rest = _first_copies(named.select("pid", "x"), k)
    blocks = pack(few.select("pid", "x"), dims)
    bounded = stage(blocks.withColumn("reach", _own_reach(dims, k)("xs")), "bounded")
    found = tiles.tiled(bounded, _nearest(dims, k), "pid long, nbr long, d double", [*HEAD, "ids", "xs", "reach"], [*HEAD, "ids", "xs"], "reach")
    candidate = F.struct(F.col("d"), (F.col("nbr") != F.col("pid")).alias("other"), F.col("nbr"))
    best = found.groupBy("pid").agg(F.slice(F.sort_array(F.collect_list(candidate)), 1, k).alias("b"))
    near = best.select("pid", F.posexplode("b").alias("p", "n")).select(
        "pid", F.col("n.nbr").alias("nbr"), F.sqrt("n.d").alias("dist"), (F.col("p") + 1).alias("rank")
    )
    ahead = few.filter(F.col("_place") < k).select("x", F.col("pid").alias("nbr"), (F.col("_place") + 1).cast("int").alias("rank"))
    copies = rest.select("pid", "x")
    zero = F.lit(0.0).alias("dist")
    more = salted_join(ahead, copies, ["x"], "pid", hot_keys(copies, ["x"])).select("pid", "nbr", zero, "rank").unionByName(
        copies.select("pid", F.col("pid").alias("nbr"), zero, F.lit(1).alias("rank"))
    )
    names = named.select("pid", "id")
    return (
        near.unionByName(more)
        .join(names, "pid")
        .drop("pid")
        .join(names.select(F.col("pid").alias("nbr"), F.col("id").alias("nbr_id")), "nbr")
        .select("id", F.col("nbr_id").alias("nbr"), "dist", "rank")
    )


def kdist(points: DataFrame, cols: list[str], k: int = 5) -> DataFrame:
    """(id, dist): distance to the ``k``-th nearest point, itself counted."""
    return knn(points, cols, k).filter(F.col("rank") == k).select("id", "dist")


def _local_groups(dims: int, eps2: float):
    """Root place of each core point among the cores of its own block, -1 for other points."""

    @F.pandas_udf("array<int>")
    def run(xs: pd.Series, core: pd.Series) -> pd.Series:
        out = []
        for x, c in zip(xs, core):
            c = np.asarray(c, dtype=bool)
            x = np.reshape(np.asarray(x, dtype=float), (-1, dims))
            linked = tiles.within(x, x, eps2) & c[:, None] & c[None, :]
            root = np.where(c, np.arange(len(c)), -1)
            while True:
                best = np.where(linked, root[None, :], len(c)).min(1, initial=len(c))
                new = np.where(c, np.minimum(best, root), -1)
                if (new == root).all():
                    break
                root = new
            out.append(root.astype(np.int32))
        return pd.Series(out)

    return run


def _links(dims: int, eps2: float):
    """Pairs of groups of cores within reach, as few as connect all groups of both tiles that touch."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        l, r = tiles.Side(left, dims), tiles.Side(right, dims)
        groups = [s.values("grp").astype(np.int64) + np.repeat(s.block * _GROUPS, np.diff(s.bounds)) for s in (l, r)]
        cores = [s.values("grp") >= 0 for s in (l, r)]
        held = [[np.unique(g[s.rows(b)][c[s.rows(b)]]).tolist() for b in range(len(s.block))] for s, g, c in zip((l, r), groups, cores)]
        parent: dict[int, int] = {}

        def root(group: int) -> int:
            while (up := parent.get(group, group)) != group:
                parent[group] = group = parent.get(up, up)
            return group

        links = []
        for block in range(len(l.block)):
            own = l.rows(block)
            x, codes = l.x[own][cores[0][own]], groups[0][own][cores[0][own]]
            near, _ = l.gaps(r, block)
            todo = np.flatnonzero((near <= eps2 * (1 + 1e-9)) & (r.block > l.block[block]))
            roots = {root(g) for g in held[0][block]}
            # Blocks whose groups are all in one already have nothing to add.
            todo = [b for b in todo if len(roots | {root(g) for g in held[1][b]}) > 1 and held[1][b]] if roots else []
            for part in r.parts(np.array(todo, dtype=np.int64), cores[1]):
                hit = tiles.within(x, r.x[part], eps2)
                for group in held[0][block]:
                    for other in np.unique(groups[1][part][hit[codes == group].any(0)]).tolist():
                        a, b = root(group), root(other)
                        if a != b:
                            parent[max(a, b)] = min(a, b)
                            links.append((group, other))
        src, dst = np.array(links, dtype=np.int64).reshape(-1, 2).T
        return pa.table({"src": src, "dst": dst})

    return run


def _border_labels(dims: int, eps2: float):
    """Smallest cluster label among the cores within reach of each left point that is no core."""
    none = np.iinfo(np.int64).max

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        l, r = tiles.Side(left, dims), tiles.Side(right, dims)
        pids, core, known = l.values("ids"), np.equal(l.values("core"), True), r.values("cluster")
        label = np.where(np.isnan(known), -1, known).astype(np.int64) if known.dtype.kind == "f" else known
        best = np.full(len(l.x), none)
        for block in range(len(l.block)):
            own = np.arange(*l.bounds[block : block + 2])
            own = own[~core[own]]
            near, _ = l.gaps(r, block)
            for part in r.parts(np.flatnonzero(near <= eps2 * (1 + 1e-9)), label >= 0) if len(own) else ():
                hit = tiles.within(l.x[own], r.x[part], eps2)
                best[own] = np.minimum(best[own], np.where(hit, label[part][None, :], none).min(1, initial=none))
        met = best < none
        return pa.table({"pid": pids[met], "border": best[met]})

    return run


def dbscan(points: DataFrame, cols: list[str], eps: float = 1.0, min_pts: int = 5) -> DataFrame:
    """(id, cluster, core): density clusters numbered from 0 by their smallest core, noise -1.

    ``min_pts`` counts the point itself. A border point joins the reachable cluster with the
    smallest number. Cores of one block are grouped inside the task,
    tiles of blocks exchange only which of their groups touch, and the groups are joined by
    :func:`components`; pairs of points are never written.
    """
    dims, eps2 = len(cols), eps * eps
    merged = distinct_points(points, cols)
    blocks = pack(merged, dims, ["weight"])
    counts = _within_blocks(blocks, dims, eps)
    cores = stage(merged.select("pid").join(counts, "pid").select("pid", (F.col("n_within") >= min_pts).alias("core")), "cores")
    grouped = stage(aligned(blocks, cores, "core").withColumn("grp", _local_groups(dims, eps2)("xs", "core")), "grouped")
    member = grouped.select("block", F.explode(F.arrays_zip(F.col("ids").alias("pid"), F.col("grp").alias("g"), F.col("core").alias("core"))).alias("z")).select(
        "z.pid", (F.col("block") * _GROUPS + F.col("z.g")).alias("id"), "z.core"
    )
    core_members = stage(member.filter("core").select("pid", "id"), "core-members")
    touching = tiles.tiled(grouped, _links(dims, eps2), "src long, dst long", [*HEAD, "xs", "grp"], [*HEAD, "xs", "grp"], eps2)
    labels = components(core_members.select("id").distinct(), touching)
    core_points = core_members.join(labels, "id")
    names = core_points.groupBy("label").agg(F.min("pid").alias("first"))
    numbered = row_numbers(names, ["first"], "_rn").select("label", (F.col("_rn") - 1).alias("cluster"))
    core_cluster = stage(core_points.join(numbered, "label").select("pid", "cluster"), "core-cluster")
    named = aligned(grouped, core_cluster, "cluster")
    border = (
        tiles.tiled(named, _border_labels(dims, eps2), "pid long, border long", [*HEAD, "ids", "xs", "core"], [*HEAD, "xs", "cluster"], eps2)
        .groupBy("pid")
        .agg(F.min("border").alias("border"))
    )
    final = cores.select("pid", "core").join(core_cluster, "pid", "left").join(border, "pid", "left").select(
        "pid", "core", F.coalesce("cluster", "border", F.lit(-1)).cast("bigint").alias("cluster")
    )
    return link_copies(points, merged, cols).join(final, "pid").select("id", "cluster", "core")


def outliers(labels: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Points, noise points and inliers."""
    noise = F.col(cluster) == -1
    return labels.agg(
        F.count(F.lit(1)).alias("points"), F.count_if(noise).alias("outliers"), F.count_if(~noise).alias("inliers")
    )
