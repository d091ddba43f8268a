"""Expressions, readers, metrics, ranks, statistics and name resolution."""

from __future__ import annotations

import difflib
import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeloom.functions import columns as C
from routeloom.functions.names import best_matches
from routeloom.functions import student_t
from routeloom.functions.student_t import log_two_sided_p, two_sided_p
from routeloom.catalog import inputs, queries
from routeloom.operators import clean, facts, ranks, removal, resolve, stats
from routeloom.sources import files


def test_delay_minutes(spark):
    df = spark.createDataFrame(
        [("2024-03-31 02:30:00", "2024-03-31 01:00:00"), ("2024-01-01 00:00:00", "2024-01-01 00:10:00"), ("bad", "2024-01-01 00:10:00")], "a string, s string"
    )
    a, s = C.parse_time("a"), C.parse_time("s")
    rows = df.select(C.delay_minutes(a, s).alias("clamped"), C.delay_minutes(a, s, clamp=False).alias("plain")).collect()
    assert [tuple(r) for r in rows] == [(90.0, 90.0), (0.0, -10.0), (None, None)]


def test_small_expressions(spark):
    df = spark.createDataFrame([("12.5", 3.0, 4.0, "Foo Airport (North)"), ("n/a", -0.2, 7.9, " bar ")], "t string, a double, b double, name string")
    rows = df.select(C.coerce("t"), C.versus("a", "b"), C.verdict("a"), C.normal_name("name"), C.before_bracket(C.query_name("name"))).collect()
    assert tuple(rows[0]) == (12.5, "3 vs 4", "CONFIRMED", "FOO (NORTH)", "FOO AIRPORT")
    assert tuple(rows[1]) == (0.0, "0 vs 7", "REJECTED", "BAR", "BAR")


def test_metrics_of_one_fact_have_no_deviation(spark):
    df = spark.createDataFrame([("A", 5.0), ("B", 1.0), ("B", 3.0), ("C", None)], "k string, delay double")
    got = {r["id"]: (r["avg_delay"], r["delay_std"], r["num_flights"]) for r in facts.delay_metrics(df, "k").collect()}
    assert got["A"] == (5.0, None, 1) and got["C"] == (None, None, 0)
    assert got["B"][0] == 2.0 and math.isclose(got["B"][1], math.sqrt(2))


def test_weighted_rows_and_merge(spark):
    rows = spark.createDataFrame([("A", 10.0, 1.0), ("A", 20.0, 3.0), ("Z", 5.0, 0.0)], "k string, avg double, cnt double")
    w = facts.weighted_delay(rows, "k")
    got = {r["id"]: r for r in w.collect()}
    assert got["A"]["avg_delay"] == 17.5 and got["A"]["num_flights"] == 4.0 and got["Z"]["avg_delay"] is None
    other = spark.createDataFrame([("A", 7.5, None, 6)], "id string, avg_delay double, delay_std double, num_flights int")
    mean = {r["id"]: r for r in facts.merge_sources([w, other]).collect()}["A"]
    assert (mean["avg_delay"], mean["num_flights"]) == (12.5, 5.0) and math.isclose(mean["delay_std"], got["A"]["delay_std"])
    both = {r["id"]: r for r in facts.merge_sources([w, other], how="weighted").collect()}["A"]
    assert (both["avg_delay"], both["num_flights"]) == (11.5, 10.0)


def test_translation_takes_the_last_row(spark):
    mapping = spark.createDataFrame([("X1", "OLD", 1), ("X1", "NEW", 2), ("X1", None, 3), (None, "Q", 4)], "code string, id string, row_order int")
    df = spark.createDataFrame([("X1", 1), ("X9", 2)], "k string, v int")
    assert [tuple(r) for r in facts.translate(df, mapping, "k").collect()] == [("NEW", 1)]


def test_static_and_monthly_readers(spark, tmp_path):
    (tmp_path / "s.csv").write_text('code,name,lat\nAAA,"One, Two",1.5\n\\N,None,x\n')
    rows = files.read_static(spark, str(tmp_path / "s.csv"), "code string, name string, lat string").collect()
    assert [tuple(r) for r in rows] == [("AAA", "One, Two", "1.5"), (None, "None", "x")]
    months = tmp_path / "m"
    months.mkdir()
    (months / "1.csv").write_text("Year,Origin,Delay\n1,A,2.5\n")
    (months / "2.csv").write_text("Year,Origin,Delay\n1,B,bad\n")
    got = files.read_monthly(spark, str(months), {"Origin": "string", "Delay": "double"})
    assert sorted(tuple(r) for r in got.collect()) == [("A", 2.5), ("B", None)]
    with pytest.raises(ValueError):
        files.read_monthly(spark, str(months), {"Nope": "string"})
    with pytest.raises(Exception):
        files.read_monthly(spark, str(tmp_path / "none"), {"Origin": "string"})


def test_readers_find_columns_by_name_in_each_file(spark, tmp_path):
    (tmp_path / "1.csv").write_text("Origin,Dest,Cancelled\nAAA,BBB,0\n")
    (tmp_path / "2.csv").write_text("Dest,Origin,Cancelled,More\nDDD,CCC,1,x\n")
    want = [("AAA", "BBB", 0), ("CCC", "DDD", 1)]
    columns = {"Origin": "string", "Dest": "string", "Cancelled": "int"}
    assert sorted(tuple(r) for r in files.read_monthly(spark, str(tmp_path), columns).collect()) == want
    layout = ", ".join(f"{c} {t}" for c, t in columns.items())
    assert sorted(tuple(r) for r in files.read_static(spark, str(tmp_path), layout).collect()) == want
    assert sorted(tuple(r) for r in files.read_encoded(spark, str(tmp_path), layout).collect()) == want
    (tmp_path / "3.csv").write_text("Dest,Cancelled\nEEE,1\n")
    for read in (lambda: files.read_monthly(spark, str(tmp_path), columns), lambda: files.read_static(spark, str(tmp_path), layout)):
        with pytest.raises(ValueError):
            read()


def test_banner_text_in_two_layouts(spark, tmp_path):
    (tmp_path / "1.csv").write_text("Atualizado em: x\nA;B\n1;2\nA;B\n")
    (tmp_path / "2.csv").write_text("Atualizado em: y\nB;C;A\n20;30;10\n")
    assert sorted(tuple(r) for r in files.read_banner_text(spark, str(tmp_path), ["A", "B"]).collect()) == [("1", "2"), ("10", "20")]
    with pytest.raises(ValueError):
        files.read_banner_text(spark, str(tmp_path), ["A", "C"])


@pytest.mark.parametrize("encoding", ["ISO-8859-1", "UTF-8"])
def test_banner_text(spark, tmp_path, encoding):
    head = "Situação Voo;Origem"
    for i, state in enumerate(("REALIZADO", "CANCELADO")):
        text = f"Atualizado em: 01/01/2025\n{head}\n{state};Aeródromo {i}\n"
        (tmp_path / f"{i}.csv").write_bytes(text.encode(encoding))
    rows = files.read_banner_text(spark, str(tmp_path), head.split(";"), encoding=encoding).collect()
    assert sorted(tuple(r) for r in rows) == [("CANCELADO", "Aeródromo 1"), ("REALIZADO", "Aeródromo 0")]


def test_encoded_reader_and_ranked_sink(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name,v\nSão,1\nÅrhus,\n".encode("latin1"))
    df = files.read_encoded(spark, str(tmp_path / "a.csv"), "name string, v double")
    assert {r["name"] for r in df.collect()} == {"São", "Århus"}
    more = df.union(spark.createDataFrame([("Top", 9.0)], "name string, v double"))
    files.write_ranked(more, ["name", "v"], "v", str(tmp_path / "out"), single=True)
    text = next((tmp_path / "out").glob("part-*.csv")).read_text()
    assert text.splitlines() == ["name,v", "Top,9.0", "São,1.0"]


def test_global_ranks(spark):
    rng = random.Random(2)
    data = [(f"i{i:03d}", float(rng.choice([1, 2, 2, 3, 3, 3, 7, i]))) for i in range(200)]
    df = spark.createDataFrame(data, "id string, v double").repartition(7)
    want = {k: n + 1 for n, (k, _) in enumerate(sorted(data, key=lambda r: (-r[1], r[0])))}
    assert {r["id"]: r["position"] for r in ranks.ranked(df, "v").collect()} == want
    values = [v for _, v in data]
    for r in ranks.average_rank(df, "v").collect():
        below, ties = sum(v < r["v"] for v in values), values.count(r["v"])
        assert r["rank"] == below + (ties + 1) / 2


def test_average_rank_with_hot_values(spark, small_limits):
    df = spark.createDataFrame([(i, 1.0 if i < 30 else float(i)) for i in range(40)], "id int, v double")
    got = {r["id"]: r["rank"] for r in ranks.average_rank(df, "v").collect()}
    assert got == {i: 15.5 if i < 30 else float(i + 1) for i in range(40)}


def test_quantiles_and_boxes(spark, small_limits):
    rng = np.random.default_rng(1)
    data = [(i, int(i % 3 == 0), float(v)) for i, v in enumerate(np.round(rng.standard_t(2, 90), 3))]
    df = spark.createDataFrame(data, "id int, cluster int, v double")
    for r in stats.cluster_boxes(df, "cluster", ["v"]).collect():
        v = np.array([x for _, c, x in data if c == r["cluster"]])
        q1, q2, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        assert np.allclose([r["q1"], r["median"], r["q3"]], [q1, q2, q3])
        assert (r["whisker_low"], r["whisker_high"], r["outliers"]) == (inside.min(), inside.max(), len(v) - len(inside))


def test_degree_ranks_keep_every_node(spark, monkeypatch):
    monkeypatch.setattr(ranks, "_EXPAND", 7)
    degree = [0, *[1] * 50, *[2] * 20, 5, 9]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(degree)], "id int, degree int")
    linked = sorted(d for d in degree if d)
    got = sorted((r["k"], -r["ccdf"]) for r in ranks.ccdf(df).collect())
    assert [k for k, _ in got] == linked and np.allclose([-c for _, c in got], 1 - np.arange(len(linked)) / len(linked))
    assert [r["k"] for r in ranks.rank_degree(df).orderBy("rank").collect()] == linked[::-1]
    x, y = np.log(linked), np.log(1 - np.arange(len(linked)) / len(linked))
    fit = stats.power_law(df, "ccdf").first()
    assert np.allclose([fit["slope"], fit["intercept"]], np.polyfit(x, y, 1)) and math.isclose(fit["gamma"], 1 - fit["slope"])


def test_histogram_and_density(spark):
    v = [0.0, 0.1, 0.2, 5.0, 10.0]
    df = spark.createDataFrame([(x,) for x in [*v, None]], "v double")
    rows = stats.histogram(df, "v", 10).orderBy("bin").collect()
    assert [r["rows"] for r in rows] == list(np.histogram(v, 10)[0])
    h = np.std(v, ddof=1) * len(v) ** -0.2
    got = stats.density(df, "v", 20).orderBy("point").collect()
    grid = np.linspace(0, 10, 20)
    want = [np.exp(-(((g - np.array(v)) / h) ** 2) / 2).sum() / (len(v) * h * math.sqrt(2 * math.pi)) for g in grid]
    assert np.allclose([r["density"] for r in got], want)


@pytest.mark.parametrize("n", [10**6, 10**9, 10**10, 10**12, 10**14, 10**15])
@pytest.mark.parametrize("t", [0.01, 0.5, 1.7, 5.0, 20.0, 30.0])
def test_student_t_of_many_rows_is_the_normal_tail(n, t):
    rho = t / math.sqrt(n - 2 + t * t)
    tail = math.log(math.erfc(t / math.sqrt(2)))
    # Student's t differs from the normal distribution by about (t^4 + t) / 4n in the logarithm.
    assert abs(log_two_sided_p(rho, n) - tail) < 1e-7 * max(1, abs(tail)) + (t**4 + t) / n


def test_student_t_of_many_rows_meets_the_fraction(monkeypatch):
    for rho in (1e-4, 0.001, 0.01, 0.2):
        exact = log_two_sided_p(rho, 400_000)
        monkeypatch.setattr(student_t, "MANY", 1)
        assert math.isclose(log_two_sided_p(rho, 400_000), exact, rel_tol=1e-9)
        monkeypatch.undo()
    with pytest.raises(ArithmeticError):
        monkeypatch.setattr(student_t, "_STEPS", 3)
        log_two_sided_p(0.01, 400_000)


def test_student_t():
    # Table values: t = 2.228 at 10 and 2.571 at 5 degrees of freedom leave 5 % outside.
    for t, dof in ((2.228139, 10), (2.570582, 5), (1.959964, 10_000_000)):
        rho = t / math.sqrt(dof + t * t)
        assert abs(two_sided_p(rho, dof + 2) - 0.05) < 1e-5
    # Reference values of numerical integration.
    for rho, n, p in ((0.1, 10_000, 1.19705042e-23), (0.3, 1000, 3.03748338e-22), (0.5, 1000, 2.27810186e-64), (0.05, 50, 0.73022457), (0.6, 7, 0.15437725), (0.7, 4, 0.3)):
        assert math.isclose(two_sided_p(rho, n), p, rel_tol=1e-7)
    assert math.isclose(log_two_sided_p(0.05, 1_000_000) / math.log(10), -545.343936239, rel_tol=1e-9)
    assert two_sided_p(0.3, 2) is None and two_sided_p(None, 9) is None and two_sided_p(1.0, 9) == 0.0


def test_spearman(spark):
    df = spark.createDataFrame([(i, float(i), float(i * i)) for i in range(12)] + [(99, None, 1.0)], "id int, a double, b double")
    got = stats.correlation(df, "a", "b", "spearman").first()
    assert (got["n"], got["verdict"]) == (12, "CONFIRMED") and math.isclose(got["r"], 1.0)


def test_best_matches_agree_with_a_full_scan():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcde ") for _ in range(rng.randint(3, 14))) for _ in range(120)]
    names = [w[:2] + rng.choice("abcx") + w[3:] for w in words[:60]] + ["zzzz"]
    for name, found in zip(names, best_matches(names, words, 0.7)):
        want = difflib.get_close_matches(name, words, n=1, cutoff=0.7)
        assert (found[1] if found else None) == (want[0] if want else None)


def test_resolution_tiers(spark, monkeypatch):
    monkeypatch.setattr(resolve, "NAME_BLOCK", 2)
    nodes = spark.createDataFrame(
        [("Foo Airport", "FOO", 1), ("Barcelona Airport", "BCN", 2), ("Nowhere", None, 3), ("Foo", "FO2", 4), ("Norwich", "NWI", 5)],
        "name string, code string, row_order int",
    )
    asked = spark.createDataFrame([("heathrow",), ("foo (main)",), ("Barcelone",), ("nowhere",), ("QQQQ",), ("Norwch ",)], "name string")
    got = {r["name"]: (r["code"], r["tier"]) for r in resolve.resolve_names(asked, resolve.directory_of(nodes)).collect()}
    assert got == {
        "heathrow": ("LHR", "manual"), "foo (main)": ("FO2", "exact"), "Barcelone": ("BCN", "similar"),
        "nowhere": (None, "exact"), "QQQQ": (None, "none"), "Norwch ": ("NWI", "similar"),
    }


def test_banner_text_of_several_layouts_moves_no_line(spark, tmp_path):
    (tmp_path / "a [1] b%20.csv").write_text("Atualizado em: x\nA;B\n1;2\n")
    (tmp_path / "c.csv").write_text("Atualizado em: x\nB;A\n20;10\n")
    table = files.read_banner_text(spark, str(tmp_path), ["A", "B"])
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert sorted(tuple(r) for r in table.collect()) == [("1", "2"), ("10", "20")]


@pytest.fixture
def lines_and_orders(spark, tmp_path):
    lines = spark.range(400).selectExpr(
        "id div 4 AS l_orderkey", "id % 30 AS l_partkey", "id % 7 AS l_suppkey", "if(id % 3 = 0, 'R', 'N') AS l_returnflag",
        "if(id % 2 = 0, 'F', 'O') AS l_linestatus", "cast(id % 50 AS double) AS l_quantity", "0.05D AS l_discount", "0.01D * (id % 9) AS l_tax",
        "timestamp '1995-01-01 00:00:00' + make_interval(0, 0, 0, int(id)) AS l_shipdate",
    )
    orders = spark.range(100).selectExpr(
        "id AS o_orderkey", "substr('FOP', int(id % 3) + 1, 1) AS o_orderstatus", "timestamp '1994-12-01 00:00:00' + make_interval(0, 0, 0, int(id)) AS o_orderdate"
    )
    nodes = {
        "part": spark.range(30).selectExpr("id AS p_partkey", "'part' || id AS p_name", "'Brand' AS p_brand", "1 AS p_size", "1.0D AS p_retailprice"),
        "supplier": spark.range(7).selectExpr("id AS s_suppkey", "'supplier' || id AS s_name", "1 AS s_nationkey", "1.0D AS s_acctbal"),
    }
    for name, table in {"lineitem": lines, "orders": orders, **nodes}.items():
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_banner_files_are_as_many_as_the_pieces_of_the_facts(spark, lines_and_orders, monkeypatch):
    seen, plain = [], files.read_banner_text
    monkeypatch.setattr(files, "read_banner_text", lambda s, folders, columns: seen.extend(folders) or plain(s, folders, columns))
    spread = property(lambda i: plain_facts(i).repartition(6))
    plain_facts = inputs.Inputs.facts.func
    monkeypatch.setattr(inputs.Inputs, "facts", spread)
    got = queries.QUERIES["src_banner_text"](spark, lines_and_orders)
    form = "yyyy-MM-dd HH:mm:ss"
    want = plain_facts(inputs.Inputs(spark, lines_and_orders)).select(
        "status", "origin", "dest", F.date_format("scheduled", form), F.coalesce(F.date_format("actual", form), F.lit(""))
    )
    rows = lambda t: sorted(tuple(v or "" for v in r) for r in t.collect())
    assert rows(got) == rows(want) and got.count() == 400
    assert all(len(list(Path(folder).glob("part-*"))) >= 6 for folder in seen)


def test_monthly_files_come_from_stored_facts(spark, lines_and_orders, monkeypatch):
    plans, plain = [], queries._in_layouts
    monkeypatch.setattr(queries, "_in_layouts", lambda t, *a: plans.append(t._jdf.queryExecution().executedPlan().toString()) or plain(t, *a))
    assert queries.QUERIES["src_monthly_csv"](spark, lines_and_orders).count() == 400
    assert len(plans) == 1 and "Join" not in plans[0] and "Exchange" not in plans[0]


def test_listed_nodes_come_from_the_stored_edges(spark, lines_and_orders, monkeypatch):
    plans, plain = [], clean.active
    monkeypatch.setattr(clean, "active", lambda v, e: plans.append(e._jdf.queryExecution().executedPlan().toString()) or plain(v, e))
    i = inputs.Inputs(spark, lines_and_orders)
    nodes, edges = clean.clean_graph(i.coded_nodes, i.coded_routes)
    assert i.listed.vertices.exceptAll(nodes).count() == 0 and nodes.exceptAll(i.listed.vertices).count() == 0
    assert i.listed.edges.exceptAll(edges).count() == 0 and i.listed.edges.count() == edges.count() > 0
    assert "Join" not in plans[-1]


def test_removal_orders_sort_narrow_rows(spark, monkeypatch):
    nodes = spark.createDataFrame([("a", 2, None, "x" * 50), ("b", 3, 1.0, "y"), ("c", 1, 4.0, "z")], "id string, degree int, avg_delay double, name string")
    seen, plain = [], removal.row_numbers
    monkeypatch.setattr(removal, "row_numbers", lambda t, *a: seen.append(set(t.columns)) or plain(t, *a))
    got = {(r["strategy"], r["position"]): r["id"] for r in removal.removal_orders(nodes, structural="degree").collect()}
    assert [got["Structural", p] for p in (1, 2, 3)] == ["b", "a", "c"] and [got["Operational", p] for p in (1, 2, 3)] == ["c", "b", "a"]
    assert len(got) == 9 and seen == [{"id"}, {"id", "degree"}, {"id", "avg_delay"}]
