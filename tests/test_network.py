"""Network operators on small graphs with values worked out by hand or by brute force."""

from __future__ import annotations

import math
import random
from collections import deque
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from routeloom import Network
from routeloom.operators import clean, components, mixing, network, pagerank, paths, reconcile, removal


def make(spark, nodes, edges):
    vertices = spark.createDataFrame([(n,) for n in nodes], "id string")
    links = spark.createDataFrame(edges or [], "src string, dst string")
    return Network.build(vertices, links)


def values(df, col):
    return {r["id"]: r[col] for r in df.collect()}


@pytest.fixture(scope="module")
def random_graph(spark):
    rng = random.Random(7)
    nodes = [f"n{i:02d}" for i in range(40)]
    edges = {("n00", n) for n in nodes[1:25]} | {(n, "n01") for n in nodes[5:30]}
    while len(edges) < 110:
        edges.add((rng.choice(nodes[:36]), rng.choice(nodes[:36])))
    return nodes, sorted(edges)


def out_lists(nodes, edges):
    out = {n: [] for n in nodes}
    for a, b in edges:
        out[a].append(b)
    return out


def bfs(out, start):
    dist, queue = {start: 0}, deque([start])
    while queue:
        a = queue.popleft()
        for b in out[a]:
            if b not in dist:
                dist[b] = dist[a] + 1
                queue.append(b)
    return dist


def brandes(nodes, edges):
    out, score = out_lists(nodes, edges), dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, sigma, order, pred = {s: 0}, dict.fromkeys(nodes, 0.0), [], {n: [] for n in nodes}
        sigma[s], queue = 1.0, deque([s])
        while queue:
            a = queue.popleft()
            order.append(a)
            for b in out[a]:
                if b not in dist:
                    dist[b] = dist[a] + 1
                    queue.append(b)
                if dist[b] == dist[a] + 1:
                    sigma[b] += sigma[a]
                    pred[b].append(a)
        delta = dict.fromkeys(nodes, 0.0)
        for b in reversed(order):
            for a in pred[b]:
                delta[a] += sigma[a] / sigma[b] * (1 + delta[b])
            if b != s:
                score[b] += delta[b]
    n = len(nodes)
    return {k: v / ((n - 1) * (n - 2)) for k, v in score.items()}


def weak_components(nodes, edges):
    both = out_lists(nodes, [*edges, *[(b, a) for a, b in edges]])
    label = {}
    for n in sorted(nodes):
        if n not in label:
            for m in bfs(both, n):
                label[m] = n
    return label


def test_duplicate_ids_are_refused(spark):
    with pytest.raises(ValueError):
        make(spark, ["a", "a"], [])


def test_degrees_count_a_loop_twice(spark):
    net = make(spark, "abc", [("a", "a"), ("a", "b")])
    got = {r["id"]: (r["in_degree"], r["out_degree"], r["degree"]) for r in network.degrees(net.vertices, net.edges).collect()}
    assert got == {"a": (1, 2, 3), "b": (1, 0, 1), "c": (0, 0, 0)}


def test_pagerank_of_a_cycle_is_uniform(spark):
    got = values(pagerank.pagerank(make(spark, "abc", [("a", "b"), ("b", "c"), ("c", "a")])), "pagerank")
    assert all(abs(v - 1 / 3) < 1e-9 for v in got.values())


def test_pagerank_spreads_dangling_mass(spark):
    got = values(pagerank.pagerank(make(spark, "abcd", [("a", "d"), ("b", "d"), ("c", "d")]), tol=1e-10), "pagerank")
    # x = leaf, y = center: x = .15/4 + .85 y/4, y = x + .85 * 3 x
    leaf = (0.15 / 4) / (1 - 0.85 / 4 * 3.55)
    assert abs(sum(got.values()) - 1) < 1e-9
    assert abs(got["a"] - leaf) < 1e-7 and abs(got["d"] - 3.55 * leaf) < 1e-7


@pytest.mark.parametrize("hot", [False, True])
def test_components_giant_and_chain(spark, random_graph, hot, request):
    if hot:
        request.getfixturevalue("small_limits")
    nodes, edges = random_graph
    net = make(spark, nodes, edges)
    want = weak_components(nodes, edges)
    assert values(components.components(net.vertices, net.edges), "label") == want
    top = max(set(want.values()), key=lambda k: (sum(v == k for v in want.values()), k))
    assert {r["id"] for r in components.giant(net).vertices.collect()} == {n for n, v in want.items() if v == top}
    chain = [f"c{i:03d}" for i in range(60)]
    random.Random(1).shuffle(chain)
    line = make(spark, chain, list(zip(chain, chain[1:])))
    assert set(values(components.components(line.vertices, line.edges), "label").values()) == {"c000"}


@pytest.mark.parametrize("hot", [False, True])
def test_closeness_against_search(spark, random_graph, hot, request):
    if hot:
        request.getfixturevalue("small_limits")
    nodes, edges = random_graph
    label = weak_components(nodes, edges)
    biggest = max(set(label.values()), key=lambda k: sum(v == k for v in label.values()))
    core = [n for n in nodes if label[n] == biggest]
    back = out_lists(core, [(b, a) for a, b in edges if label[a] == biggest])
    want = dict.fromkeys(nodes, 0.0)
    for n in core:
        d = bfs(back, n)
        if len(d) > 1:
            want[n] = (len(d) - 1) / sum(d.values()) * (len(d) - 1) / (len(core) - 1)
    net = make(spark, nodes, edges)
    for rows in (None, 1):
        got = values(paths.closeness(net, state_rows=rows), "closeness")
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)


def test_closeness_with_many_groups_of_sources(spark):
    nodes = [f"r{i:04d}" for i in range(1100)]
    edges = [(nodes[i], nodes[(i + s) % 1100]) for i in range(1100) for s in (1, 37, 411)]
    out = out_lists(nodes, [(b, a) for a, b in edges])
    d = bfs(out, nodes[0])
    got = values(paths.closeness(make(spark, nodes, edges)), "closeness")
    want = (len(d) - 1) / sum(d.values())
    assert len(got) == 1100 and all(math.isclose(v, want, rel_tol=1e-12) for v in got.values())


def test_closeness_sends_a_node_once_per_block(spark, monkeypatch):
    sent, plain = [], network.Workspace.save_counted

    def save(work, df, name, **metrics):
        table, seen = plain(work, df, name, **metrics)
        if "closeness" in work.root and "kind" in table.columns:
            sent.append(sum(len(r["ids"]) // 4 for r in table.filter(F.col("kind") == paths._SENT).collect()))
        return table, seen

    monkeypatch.setattr(network.Workspace, "save_counted", save)
    monkeypatch.setattr(paths, "MIN_BLOCKS", 3)
    monkeypatch.setattr(paths, "_CHUNK", 2)
    monkeypatch.setattr(paths, "_STEP", 2 * paths.WORDS)
    leaves = [f"n{k:02d}" for k in range(20)]
    net = make(spark, ["hub", "top", *leaves], [("top", "hub"), *[("hub", leaf) for leaf in leaves]])
    got = values(paths.closeness(net), "closeness")
    assert got.pop("top") == 0.0 and math.isclose(got.pop("hub"), 1 / 21)
    assert all(math.isclose(v, 2 / 3 * 2 / 21) for v in got.values())
    # The hub has 20 edges, but 3 blocks to send to; the top has one edge.
    assert sent and sent[0] <= 3 + 1 and sent[1] <= 3


@pytest.mark.parametrize("hot", [False, True])
def test_betweenness_with_all_pivots_is_exact(spark, random_graph, hot, request):
    if hot:
        request.getfixturevalue("small_limits")
    nodes, edges = random_graph
    want = brandes(nodes, edges)
    got = values(paths.betweenness(make(spark, nodes, edges)), "betweenness")
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)


def test_betweenness_sends_a_node_once_per_block(spark, monkeypatch):
    sent, plain = {}, network.Workspace.save_counted

    def save(work, df, name, **metrics):
        table, seen = plain(work, df, name, **metrics)
        if name.startswith("out-"):
            sent[name] = sum(len(r["ids"]) // 4 for r in table.filter(F.col("kind") == paths._SENT).collect())
        return table, seen

    monkeypatch.setattr(network.Workspace, "save_counted", save)
    monkeypatch.setattr(paths, "MIN_BLOCKS", 3)
    monkeypatch.setattr(paths, "_CHUNK", 2)
    monkeypatch.setattr(paths, "_STEP", 7)
    leaves = [f"n{k:02d}" for k in range(20)]
    net = make(spark, ["hub", "top", *leaves], [("top", "hub"), *[("hub", leaf) for leaf in leaves]])
    got = values(paths.betweenness(net), "betweenness")
    assert math.isclose(got.pop("hub"), 20 / (21 * 20)) and not any(got.values())
    # Two groups of pivots; the hub has 20 edges, but 3 blocks to send to.
    assert sent["out-0"] <= 2 * 3 and sent["out-1"] <= 2 * 3


def test_betweenness_of_a_path_and_of_samples(spark):
    net = make(spark, "abc", [("a", "b"), ("b", "c")])
    assert values(paths.betweenness(net), "betweenness") == {"a": 0.0, "b": 0.5, "c": 0.0}
    assert all(v >= 0 for v in values(paths.betweenness(net, pivots=2), "betweenness").values())
    assert values(paths.betweenness(make(spark, "ab", [("a", "b")])), "betweenness") == {"a": 0.0, "b": 0.0}


def test_networks_without_edges(spark):
    net = make(spark, "abcd", [])
    assert values(paths.closeness(net), "closeness") == dict.fromkeys("abcd", 0.0)
    assert values(paths.betweenness(net), "betweenness") == dict.fromkeys("abcd", 0.0)
    assert all(abs(v - 0.25) < 1e-12 for v in values(pagerank.pagerank(net), "pagerank").values())


@pytest.mark.parametrize("hot", [False, True])
def test_mixing(spark, random_graph, hot, request):
    if hot:
        request.getfixturevalue("small_limits")
    nodes, edges = random_graph
    net = make(spark, nodes, edges)
    out = out_lists(nodes, edges)
    got = values(mixing.neighbor_degree(net), "knn")
    for n in nodes:
        want = sum(len(out[m]) for m in out[n]) / len(out[n]) if out[n] else 0.0
        assert math.isclose(got[n], want)
    ind = {n: sum(b == n for _, b in edges) for n in nodes}
    xs, ys = [len(out[a]) for a, _ in edges], [ind[b] for _, b in edges]
    mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
    r = sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / math.sqrt(sum((x - mx) ** 2 for x in xs) * sum((y - my) ** 2 for y in ys))
    rows = {(x["source"], x["target"]): x["r"] for x in mixing.assortativity(net).collect()}
    assert len(rows) == 4 and math.isclose(rows["out", "in"], r, abs_tol=1e-12)


@pytest.mark.parametrize("hot", [False, True])
def test_removal_curve(spark, random_graph, hot, request):
    if hot:
        request.getfixturevalue("small_limits")
    nodes, edges = random_graph
    net = make(spark, nodes, edges)
    metrics = network.degrees(net.vertices, net.edges).select("id", F.col("degree").cast("double").alias("pagerank"), F.lit(None).cast("double").alias("avg_delay"))
    orders = removal.removal_orders(metrics)
    rows = orders.collect()
    curve = {(r["strategy"], r["step"]): r["value"] for r in removal.removal_curve(net, orders).collect()}
    assert len(curve) == 33
    for strategy in ("Random", "Structural", "Operational"):
        order = [r["id"] for r in sorted((r for r in rows if r["strategy"] == strategy), key=lambda r: r["position"])]
        for step in range(11):
            gone = set(order[: int(len(nodes) * (step * 0.02))])
            left = [n for n in nodes if n not in gone]
            label = weak_components(left, [(a, b) for a, b in edges if a not in gone and b not in gone])
            size = max(sum(v == k for v in label.values()) for k in set(label.values()))
            assert math.isclose(curve[strategy, step], size / len(nodes))


def test_removal_curve_hands_over_an_edge_once_per_order(spark, random_graph, monkeypatch):
    nodes, edges = random_graph
    net = make(spark, nodes, edges)
    orders = removal.removal_orders(network.degrees(net.vertices, net.edges).withColumns({"pagerank": F.lit(0.0), "avg_delay": F.col("degree")}))
    given, plain = [], removal.components
    monkeypatch.setattr(removal, "components", lambda v, e, by: given.append(e.count()) or plain(v, e, by))
    curve = removal.removal_curve(net, orders, [0.0, 0.1, 0.2, 0.3, 0.2]).collect()
    assert len(curve) == 15 and 0 < sum(given) <= 3 * len(edges)
    assert {(r["step"], r["removed"]) for r in curve} == {(i, int(len(nodes) * f)) for i, f in enumerate([0.0, 0.1, 0.2, 0.3, 0.2])}


def test_removal_query_removes_by_pagerank(spark, monkeypatch):
    """The node of highest degree is not the one of highest rank."""
    from routeloom.catalog import queries

    nodes = [f"n{i:02d}" for i in range(60)]
    net = make(spark, nodes, [("n00", n) for n in nodes[1:41]] + [(n, "n41") for n in nodes[42:]] + [("n41", "n01")])
    known = network.degrees(net.vertices, net.edges).withColumn("avg_delay", F.lit(0.0))
    ranked = known.withColumn("pagerank", F.when(F.col("id") == "n41", 0.3).otherwise(0.01))
    monkeypatch.setattr(queries, "Inputs", lambda *_: SimpleNamespace(network=net, nodes=known, ranked_nodes=ranked))
    curve = {(r["strategy"], r["step"]): r["value"] for r in queries.QUERIES["graph_removal_curve"](spark, "").collect()}
    assert math.isclose(curve["Structural", 1], 41 / 60, abs_tol=1e-7)


def test_cleaning_and_reconciliation(spark):
    vertices = spark.createDataFrame([(n,) for n in ("AAA", "BBB", "CCC", "DDD")], "id string")
    raw = spark.createDataFrame([("AAA", "BBB"), ("AAA", "BBB"), ("BBB", "BBB"), ("AAA", "ZZZ"), ("BBB", "CCC")], "src string, dst string")
    nodes, edges = clean.clean_graph(vertices, raw)
    assert {tuple(r) for r in edges.collect()} == {("AAA", "BBB"), ("BBB", "CCC")}
    assert {r["id"] for r in nodes.collect()} == {"AAA", "BBB", "CCC"}
    report = {r["step"]: (r["rows_before"], r["rows_after"], r["dropped"]) for r in clean.cleaning_report(vertices, raw).collect()}
    assert report == {"referential": (5, 4, 1), "self_loops": (4, 3, 1), "duplicates": (3, 2, 1), "isolated": (4, 3, 1)}
    observed = spark.createDataFrame([("AAA", "BBB"), ("CCC", "AAA"), ("AAA", "AAA"), ("AAA", "QQQ"), ("QQQ", "AAA"), ("QQQ", "RRR")], "src string, dst string")
    lost = reconcile.missing(observed, edges)
    assert {r["reason"]: r["edges"] for r in reconcile.classify_missing(lost, nodes).collect()} == {
        "Both_Nodes_Exist": 2, "Only_Src_Exists": 1, "Only_Dst_Exists": 1, "Neither_Exists": 1,
    }
    full = {tuple(r) for r in reconcile.augment(nodes, edges, observed).collect()}
    assert full == {("AAA", "BBB"), ("BBB", "CCC"), ("CCC", "AAA"), ("AAA", "AAA")}
    assert ("AAA", "AAA") not in {tuple(r) for r in reconcile.augment(nodes, edges, observed, allow_loops=False).collect()}


def test_cells_hold_few_edges_and_read_rows_in_place():
    """What a cell receives, at most a row of a node for each of its edges, stays well below the memory of a worker."""
    import pyarrow as pa

    assert paths.EDGES_PER_BLOCK * max(8 * paths.PIVOTS_PER_ROW, 8 * paths.WORDS) <= 1 << 26
    table = pa.table({"kind": pa.array([1, 2], pa.int32()), "vals": pa.array([b"abcd" * 4, None], pa.binary())})
    first, second = paths._rows(table)
    at = table.column("vals").chunk(0).buffers()[2].address
    assert first["kind"] == 1 and first["vals"].address == at and second["vals"] is None
