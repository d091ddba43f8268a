"""Set similarity, banding and recommendations against brute force."""

from __future__ import annotations

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from routeloom import skew
from routeloom.operators import banding, overlap, recommend, similarity
from routeloom.session import stage


@pytest.fixture(scope="module")
def sets():
    rng = random.Random(5)
    found = {f"n{i:02d}": {"hub", *rng.sample([f"m{j}" for j in range(30)], rng.choice([1, 2, 4, 9]))} for i in range(40)}
    for i in range(40, 60):
        found[f"n{i}"] = {"hub", "m1", "m2"}
    found["n60"] = {"hub"}
    return found


@pytest.fixture(scope="module")
def table(spark, sets):
    return stage(spark.createDataFrame([(k, m) for k, v in sets.items() for m in v], "id string, member string"), "sets")


@pytest.fixture(params=[False, True])
def limits(request):
    if request.param:
        request.getfixturevalue("small_limits")


def jac(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("t", [0.125, 0.5, 1.0])
def test_all_pairs(table, sets, limits, t):
    profile = {}
    for k in sorted(sets):
        profile.setdefault(frozenset(sets[k]), []).append(k)
    names = {v[0]: (k, len(v)) for k, v in profile.items()}
    want = {(a, b): jac(names[a][0], names[b][0]) for a in names for b in names if a < b and jac(names[a][0], names[b][0]) >= t - 1e-12}
    want.update({(a, a): 1.0 for a in names if names[a][1] > 1})
    rows = similarity.jaccard_pairs(table, t).collect()
    got = {(r["a"], r["b"]): r["jaccard"] for r in rows}
    assert got.keys() == want.keys() and len(rows) == len(want) and all(math.isclose(got[k], want[k]) for k in want)
    assert all(r["members_a"] == names[r["a"]][1] and r["members_b"] == names[r["b"]][1] for r in rows)


def test_queries_against_all(spark, table, sets, limits):
    asked = spark.createDataFrame([("n03",), ("n41",), ("n60",)], "id string")
    want = {(a, b) for a in ("n03", "n41", "n60") for b in sets if a != b and jac(sets[a], sets[b]) >= 0.125}
    assert {(r["id"], r["other"]) for r in similarity.jaccard_against(asked, table).collect()} == want


def test_candidates_are_the_shared_buckets(spark, table, sets, limits):
    index = stage(similarity.bands(similarity.minhash(table)), "bands")
    buckets = {}
    for r in index.collect():
        buckets.setdefault((r["band"], r["bucket"]), set()).add(r["id"])
    asked = spark.createDataFrame([("n03",), ("n45",)], "id string")
    want = {(a, b) for group in buckets.values() for a in ("n03", "n45") if a in group for b in group if a != b}
    got = {(r["id"], r["other"]) for r in similarity.lsh_candidates(asked, index).collect()}
    assert got == want and {("n45", f"n{i}") for i in range(40, 60) if i != 45} <= got


def test_estimate_is_near_the_truth(spark, table, sets):
    pairs = spark.createDataFrame([("n40", "n41"), ("n00", "n01"), ("n02", "n60")], "id string, other string")
    for r in similarity.jaccard_estimate(pairs, similarity.minhash(table)).collect():
        assert abs(r["estimate"] - jac(sets[r["id"]], sets[r["other"]])) < 0.2
    exact = {(r["id"], r["other"]): r["jaccard"] for r in similarity.jaccard(pairs, table).collect()}
    assert exact["n40", "n41"] == 1.0 and math.isclose(exact["n02", "n60"], jac(sets["n02"], sets["n60"]))


def test_quality_counts_add_up(table, sets):
    plain = similarity.lsh_quality(table).first()
    with_self = similarity.lsh_quality(table, count_self=True).first()
    assert plain["tp"] + plain["fp"] + plain["fn"] + plain["tn"] == 50 * (len(sets) - 1)
    assert with_self["fp"] == plain["fp"] + 50 and with_self["tn"] == plain["tn"]
    assert plain["recall"] > 0.8


def test_empty_pair_tables_give_zero_rates(spark):
    none = spark.createDataFrame([], "id string, other string")
    got = similarity.pair_quality(none, none, 10).first()
    assert (got["tp"], got["tn"], got["precision"], got["recall"], got["f1"], got["accuracy"]) == (0, 10, 0.0, 0.0, 0.0, 1.0)


def test_recommendations(spark, limits):
    points = spark.createDataFrame(
        [("a", 1, 30.0, 10), ("b", 0, 10.0, 6), ("c", 0, 10.0, 4), ("d", 0, 26.0, 9), ("e", 1, 28.0, 9)],
        "id string, cluster int, avg_delay double, degree int",
    )
    sets = stage(spark.createDataFrame([(n, m) for n in "abcde" for m in ("x", "y", "z")] + [("b", "w")], "id string, member string"), "sets")
    rows = {(r["Bottleneck_Airport"], r["Recommended_Twin"]): r for r in recommend.with_score(recommend.recommend(points, sets)).collect()}
    # c is too small for a, d gains too little for both.
    assert rows.keys() == {("a", "b"), ("e", "b")}
    best = rows["a", "b"]
    assert (best["Cluster_Match"], best["Capacity_Match"], best["Similarity"], best["Potential_Gain"], best["Score"]) == ("1 vs 0", "10 vs 6", 0.75, 20.0, 15.0)
    summary = recommend.rec_summary(recommend.recommend(points, sets)).first()
    assert (summary["total"], summary["similar"], summary["mean_gain"], summary["max_gain"]) == (2, 2, 19.0, 20.0)


@pytest.mark.parametrize("small", [False, True])
def test_counted_pairs_and_curve_against_brute_force(spark, monkeypatch, small):
    """Equal sets, a member that all sets hold (hot on both sides), sets without common members."""
    if small:
        monkeypatch.setattr(overlap, "LEFT_BLOCK", 4)
        monkeypatch.setattr(overlap, "RIGHT_BLOCK", 16)
        monkeypatch.setattr(overlap, "_STEP", 50)
        monkeypatch.setattr(overlap, "_CELLS", 40)
    rng = random.Random(6)
    sets = {f"s{i:02d}": {"all"} | {rng.choice("abcdefghijklm") for _ in range(rng.randint(0, 6))} for i in range(60)}
    sets |= {f"t{i}": {f"own{i}", f"more{i}"} for i in range(3)} | {f"u{i}": {"x", "y", "all"} for i in range(5)}
    frame = spark.createDataFrame([(i, m) for i, s in sets.items() for m in s], "id string, member string")
    sim = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    names = {}
    for i in sorted(sets):
        names.setdefault(frozenset(sets[i]), []).append(i)
    first = {v[0]: len(v) for v in names.values()}
    want = sorted((a, b, first[a], first[b], round(sim(a, b), 9)) for a in first for b in first if a < b and sim(a, b) >= 0.3)
    want += [(a, a, n, n, 1.0) for a, n in first.items() if n > 1]
    got = similarity.jaccard_pairs(frame, 0.3).collect()
    assert sorted((*r[:4], round(r[4], 9)) for r in got) == sorted(want)

    candidates = {(r.a, r.b) for r in similarity.profile_candidates(frame).collect()}
    hits = lambda a, b: tuple(sorted((names[frozenset(sets[a])][0], names[frozenset(sets[b])][0]))) in candidates
    bins = {}
    for a in sets:
        for b in sets:
            if a != b:
                s = sim(a, b)
                n, h, t = bins.get(min(int(s * 20), 19), (0, 0, 0.0))
                bins[min(int(s * 20), 19)] = (n + 1, h + (sets[a] == sets[b] or hits(a, b)), t + s)
    curve = {r["bin"]: (r.pairs, round(r.observed, 9), round(r.s, 9)) for r in similarity.similarity_curve(frame).collect()}
    assert curve == {k: (n, round(h / n, 9), round(t / n, 9)) for k, (n, h, t) in bins.items()}
    assert sum(n for n, *_ in curve.values()) == len(sets) * (len(sets) - 1)


def test_join_with_a_key_hot_on_both_sides(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    left = spark.createDataFrame([(f"l{i}", 1 if i < 90 else i) for i in range(100)], "id string, key int")
    right = spark.createDataFrame([(f"r{i}", 1 if i < 80 else i) for i in range(100)], "other string, key int")
    joined = skew.salted_join(left, right, ["key"], "other", skew.hot_keys(right, ["key"]), "id", skew.hot_keys(left, ["key"]))
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, left.join(right, ["key"]).collect()))
    slots = skew.hot_keys(left, ["key"]).collect()[0]["_slots"], skew.hot_keys(right, ["key"]).collect()[0]["_slots"]
    assert slots == (9, 8)


def test_overlaps_of_sets_in_chunks(spark, monkeypatch):
    """Sets of one and of many chunks, members that one set alone holds, pairs without a common member."""
    monkeypatch.setattr(similarity, "CHUNK", 3)
    rng = random.Random(8)
    sets = {i: {f"m{j}" for j in rng.sample(range(60), n)} for i, n in enumerate([1, 2, 3, 7, 20, 40, 55])} | {7: {"alone"}}
    table = stage(spark.createDataFrame([(i, m) for i, s in sets.items() for m in s], "id long, member string"), "sets")
    pairs = stage(spark.createDataFrame([(a, b) for a in sets for b in sets if a < b], "id long, other long"), "pairs")
    packed = similarity.packed_sets(table)
    assert packed.filter("chunks > 1").count() > 0
    got = {(r.id, r.other): (r.common, r.n, r.m) for r in similarity.overlaps(pairs, packed).collect()}
    assert got == {(a, b): (len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b}


def test_candidates_name_the_members_of_every_profile(spark):
    sets = {"a": "xyz", "b": "xyz", "c": "xyz", "d": "xyzw", "e": "q"}
    frame = spark.createDataFrame([(i, m) for i, s in sets.items() for m in s], "id string, member string")
    rows = {(r.a, r.b): (r.members_a, r.members_b, r.common, r.jaccard) for r in similarity.profile_candidates(frame).collect()}
    assert {k: v for k, v in rows.items() if v[3] == 1} == {("a", b): (3, 3, 3, 1.0) for b in "abc"}
    assert rows["a", "d"] == (3, 1, 3, 0.75) and len(rows) == 4


@pytest.mark.parametrize("width", [2, 8, 64])
def test_all_nodes_meet_in_their_buckets(spark, monkeypatch, table, sets, width):
    """Every ordered pair of nodes, equal sets included, once; whichever tiles they are in."""
    monkeypatch.setattr(banding, "tile_width", lambda *_: width)
    signatures = stage(similarity.minhash(table), "signatures")
    minima = {r.id: r.signature for r in signatures.collect()}
    buckets = {}
    for r in similarity.bands(signatures).collect():
        buckets.setdefault((r.band, r.bucket), []).append(r.id)
    want = {(a, b) for group in buckets.values() for a in group for b in group if a != b}
    rows = [tuple(r) for r in similarity.node_candidates(signatures).collect()]
    assert len(rows) == len(want) and set(rows) == want and ("n41", "n40") in want
    estimates = {(r.id, r.other): r.estimate for r in similarity.node_estimates(signatures).collect()}
    assert estimates == {(a, b): sum(x == y for x, y in zip(minima[a], minima[b])) / 128 for a, b in want}


def test_lsh_queries_return_pairs_of_nodes(spark, monkeypatch):
    from types import SimpleNamespace

    from routeloom.catalog import queries

    sets = {"a": "xyz", "b": "xyz", "c": "xyz", "d": "q"}
    rows = stage(spark.createDataFrame([(i, m) for i, s in sets.items() for m in s], "id string, member string"), "sets")
    monkeypatch.setattr(queries, "Inputs", lambda *_: SimpleNamespace(sets=rows, _once=lambda name, make: make()))
    want = {(a, b) for a in "abc" for b in "abc" if a != b}
    assert {(r.id, r.other) for r in queries.QUERIES["join_lsh_candidates"](spark, "").collect()} == want
    assert {(r.id, r.other): r.estimate for r in queries.QUERIES["jaccard_estimate"](spark, "").collect()} == dict.fromkeys(want, 1.0)


def test_only_tiles_with_a_common_member_meet(spark, monkeypatch):
    monkeypatch.setattr(overlap, "LEFT_BLOCK", 4)
    monkeypatch.setattr(overlap, "RIGHT_BLOCK", 4)
    rows = [(i, f"m{i // 4}", 1) for i in range(1, 64)] + [(1, "far", 1), (63, "far", 1)]
    packed = similarity.packed_sets(stage(spark.createDataFrame(rows, "id long, member string, held long"), "sets"), "held")
    met = overlap._met(packed, 63).applyInArrow(lambda key, left, right: pa.table({"l": [key[0].as_py()], "r": [key[1].as_py()]}), "l long, r long")
    assert sorted(map(tuple, met.collect())) == sorted([(t, t) for t in range(16)] + [(0, 15)])


def test_sets_without_members_share_no_bucket_and_members_count_once(spark):
    rows = [("a", None), ("b", None), ("c", "x"), ("d", "x"), ("d", "x")]
    signatures = similarity.minhash(spark.createDataFrame(rows, "id string, member string"))
    assert {tuple(r) for r in similarity.node_candidates(stage(signatures, "signatures")).collect()} == {("c", "d"), ("d", "c")}
    side = pa.table({"at": pa.array([0, 1, 1], pa.int32()), "keys": pa.array([[5, 5, 7], [7], [5, 9]], pa.list_(pa.int64()))})
    common = banding.common_members(side, side, 2)
    assert common(pa.array([0, 0, 1]).to_numpy(), pa.array([0, 1, 1]).to_numpy()).tolist() == [2, 2, 3]
