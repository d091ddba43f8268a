"""Named SQL parts the oracle queries are put together from."""

from __future__ import annotations

import re

from ..operators.similarity import permutations
from .inputs import NODE_CENTERS, NODE_COLS, NODE_ITERS, POINT_CENTERS, POINT_COLS, POINT_ITERS, RADIUS

DEPTH = 12

_ORIGIN = "CASE WHEN l_returnflag = 'R' THEN 'P' || l_partkey ELSE 'S' || l_suppkey END"
_DEST = "CASE WHEN l_returnflag = 'R' THEN 'S' || l_suppkey ELSE 'P' || l_partkey END"


def rnd(expr: str, digits: int) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


def ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif({b}, 0))"


PARTS: dict[str, str] = {}


def part(name: str, sql: str, header: str = "") -> None:
    PARTS[name] = f"{name}{header} AS MATERIALIZED ({sql})"


part("raw_nodes", """
  SELECT CASE WHEN p_size = 50 THEN NULL WHEN p_size = 49 THEN 'p' || p_partkey ELSE 'P' || p_partkey END AS code,
    p_name AS name, p_brand AS region, p_partkey AS num, p_retailprice AS latitude, CAST(p_size AS DOUBLE) AS longitude
  FROM part
  UNION ALL SELECT 'S' || s_suppkey, s_name, 'Nation#' || s_nationkey, s_suppkey, s_acctbal, CAST(s_nationkey AS DOUBLE) FROM supplier""")
part("raw_routes", f"""
  SELECT CASE WHEN l_quantity = 50 THEN lower({_ORIGIN}) ELSE {_ORIGIN} END AS src,
    CASE WHEN l_discount = CAST(0.1 AS DOUBLE) THEN {_ORIGIN} ELSE {_DEST} END AS dst,
    CASE WHEN l_tax >= CAST(0.07 AS DOUBLE) THEN 1 ELSE 0 END AS stops
  FROM lineitem WHERE l_linestatus = 'F'""")
part("facts", f"""
  SELECT *, CASE WHEN actual IS NULL THEN NULL WHEN actual < scheduled THEN 0.0
    ELSE date_diff('second', scheduled, actual) / CAST(60 AS DOUBLE) END AS delay
  FROM (SELECT {_ORIGIN} AS origin, {_DEST} AS dest, CASE WHEN l_returnflag = 'R' THEN l_partkey ELSE l_suppkey END AS num,
      CAST(l_quantity = 49 AS INTEGER) AS diverted, CASE WHEN l_tax < CAST(0.08 AS DOUBLE) THEN l_shipdate END AS actual,
      l_returnflag AS flag, l_linestatus AS line_status, l_shipdate AS shipped, o_orderstatus AS status,
      CAST(o_orderstatus = 'P' AS INTEGER) AS cancelled, o_orderdate AS scheduled
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""")
part("coded_nodes", "SELECT code AS id, name, region, num, latitude, longitude FROM raw_nodes WHERE regexp_matches(code, '^[PS][0-9]+$')")
part("coded_routes", """
  SELECT src, dst FROM raw_routes
  WHERE regexp_matches(src, '^[PS][0-9]+$') AND regexp_matches(dst, '^[PS][0-9]+$') AND stops = 0""")
part("listed", """
  SELECT DISTINCT src, dst FROM coded_routes
  WHERE src IN (SELECT id FROM coded_nodes) AND dst IN (SELECT id FROM coded_nodes) AND src <> dst""")
part("nodes0", "SELECT * FROM coded_nodes WHERE id IN (SELECT src FROM listed UNION SELECT dst FROM listed)")
part("observed", f"""
  SELECT DISTINCT {_ORIGIN} AS src, CASE WHEN l_discount = CAST(0.1 AS DOUBLE) THEN {_ORIGIN} ELSE {_DEST} END AS dst
  FROM lineitem WHERE l_linestatus = 'O'""")
part("missing", "SELECT src, dst FROM observed EXCEPT SELECT src, dst FROM listed")
part("edges", """
  SELECT src, dst FROM listed UNION
  SELECT src, dst FROM missing WHERE src IN (SELECT id FROM nodes0) AND dst IN (SELECT id FROM nodes0)""")
part("degrees", """
  SELECT id, CAST(coalesce(i, 0) AS BIGINT) AS in_degree, CAST(coalesce(o, 0) AS BIGINT) AS out_degree,
    CAST(coalesce(i, 0) + coalesce(o, 0) AS BIGINT) AS degree
  FROM nodes0 LEFT JOIN (SELECT dst AS id, count(*) AS i FROM edges GROUP BY 1) USING (id)
    LEFT JOIN (SELECT src AS id, count(*) AS o FROM edges GROUP BY 1) USING (id)""")
part("completed", "SELECT * FROM facts WHERE cancelled = 0 AND diverted = 0")
part("source_a", """
  SELECT origin AS id, avg(delay) AS avg_delay, stddev_samp(delay) AS delay_std, count(delay) AS num_flights
  FROM completed WHERE num % 3 = 0 GROUP BY 1""")
part("mapping", """
  SELECT 'X' || id AS code, CASE WHEN num % 19 = 0 THEN NULL ELSE id END AS id, 2 AS row_order FROM coded_nodes
  UNION ALL SELECT 'X' || id, 'Z' || id, 1 FROM coded_nodes WHERE num % 17 = 0""")
part("last_mapping", """
  SELECT code, arg_max(id, row_order) AS id FROM mapping WHERE code IS NOT NULL AND id IS NOT NULL GROUP BY code""")
part("all_coded_facts", "SELECT 'X' || origin AS origin, 'X' || dest AS dest, status, scheduled, actual, delay FROM facts")
part("coded_facts", "SELECT 'X' || origin AS origin, 'X' || dest AS dest, status, scheduled, actual, delay FROM facts WHERE num % 3 = 1 OR num % 10 = 0")
part("source_b", """
  SELECT m.id, avg_delay, delay_std, num_flights FROM (
    SELECT origin, avg(delay) AS avg_delay, stddev_samp(delay) AS delay_std, count(delay) AS num_flights
    FROM coded_facts WHERE status = 'F' AND actual IS NOT NULL AND scheduled IS NOT NULL GROUP BY 1) f
  JOIN last_mapping m ON m.code = f.origin""")
for _name, _where in (("average_rows", "WHERE num % 3 = 2"), ("all_average_rows", "")):
    part(_name, f"""
  SELECT origin, direction, yr,
    CASE WHEN c = 0 OR yr % 5 = 0 THEN 'n/a' ELSE CAST(CAST(floor(s / c) AS BIGINT) AS VARCHAR) END AS avg_text,
    CAST(c AS VARCHAR) AS cnt_text
  FROM (SELECT origin, line_status AS direction, CAST(year(shipped) AS INTEGER) AS yr, sum(delay) AS s, count(delay) AS c
    FROM facts {_where} GROUP BY 1, 2, 3)""")
part("source_c", """
  SELECT origin AS id, sum(a * c) / nullif(sum(c), 0) AS avg_delay, stddev_samp(a) AS delay_std, sum(c) AS num_flights
  FROM (SELECT origin, coalesce(TRY_CAST(avg_text AS DOUBLE), 0.0) AS a, coalesce(TRY_CAST(cnt_text AS DOUBLE), 0.0) AS c
    FROM average_rows WHERE direction = 'F') GROUP BY 1""")
part("metrics", """
  SELECT id, avg(avg_delay) AS avg_delay, avg(delay_std) AS delay_std, avg(num_flights) AS num_flights FROM (
    SELECT id, avg_delay, delay_std, CAST(num_flights AS DOUBLE) AS num_flights FROM source_a
    UNION ALL SELECT id, avg_delay, delay_std, CAST(num_flights AS DOUBLE) FROM source_b
    UNION ALL SELECT id, avg_delay, delay_std, num_flights FROM source_c) GROUP BY id""")
part("nodes", """
  SELECT n.*, m.avg_delay, m.delay_std, m.num_flights, d.in_degree, d.out_degree, d.degree
  FROM nodes0 n LEFT JOIN metrics m USING (id) JOIN degrees d USING (id)""")
part("known_nodes", "SELECT * FROM nodes WHERE avg_delay IS NOT NULL AND delay_std IS NOT NULL AND degree IS NOT NULL")
part("both_ways", "SELECT src, dst FROM edges UNION SELECT dst, src FROM edges")
PARTS["reach"] = """reach(id, label) AS (
  SELECT id, id FROM nodes0 UNION SELECT b.dst, r.label FROM reach r JOIN both_ways b ON b.src = r.id WHERE r.label < b.dst)"""
part("component", "SELECT id, min(label) AS label FROM reach GROUP BY id")
part("giant_label", "SELECT label FROM component GROUP BY label ORDER BY count(*) DESC, label LIMIT 1")
part("giant_nodes", "SELECT id FROM component WHERE label = (SELECT label FROM giant_label)")
part("giant_edges", "SELECT src, dst FROM edges WHERE src IN (SELECT id FROM giant_nodes) AND dst IN (SELECT id FROM giant_nodes)")
part("out_degrees", "SELECT src, count(*) AS n FROM edges GROUP BY src")
PARTS["rank_rounds"] = """rank_rounds(it, id, rank, err) AS (
  SELECT 0, id, CAST(1 AS DOUBLE) / (SELECT count(*) FROM nodes0), CAST(1e9 AS DOUBLE) FROM nodes0
  UNION ALL
  SELECT it + 1, id, nw, sum(abs(nw - rank)) OVER () FROM (
    SELECT p.it, p.id, p.rank,
      CAST(0.85 AS DOUBLE) * (coalesce(i.s, 0) + (
        SELECT coalesce(sum(q.rank), 0) FROM rank_rounds q WHERE q.id NOT IN (SELECT src FROM out_degrees)) / (SELECT count(*) FROM nodes0))
      + (1 - CAST(0.85 AS DOUBLE)) / (SELECT count(*) FROM nodes0) AS nw
    FROM rank_rounds p LEFT JOIN (
      SELECT e.dst, sum(q.rank / o.n) AS s FROM rank_rounds q JOIN out_degrees o ON o.src = q.id JOIN edges e ON e.src = q.id GROUP BY e.dst
    ) i ON i.dst = p.id
    WHERE p.it < 100 AND p.err >= 1e-6 * (SELECT count(*) FROM nodes0)))"""
part("pageranks", "SELECT id, rank AS pagerank FROM rank_rounds WHERE it = (SELECT max(it) FROM rank_rounds)")

# Breadth-first levels over the giant component: (s, v) first met after d steps.
part("near0", "SELECT id AS s, id AS v FROM giant_nodes")
for _d in range(1, DEPTH + 1):
    _seen = " UNION ALL ".join(f"SELECT s, v FROM near{i}" for i in range(_d))
    part(f"near{_d}", f"""
      SELECT DISTINCT n.s, e.dst AS v FROM near{_d - 1} n JOIN giant_edges e ON e.src = n.v
      ANTI JOIN ({_seen}) seen ON seen.s = n.s AND seen.v = e.dst""")
part("distances", " UNION ALL ".join(f"SELECT s, v, {d} AS d FROM near{d}" for d in range(1, DEPTH + 1)))

# Path counts from the pivots, then dependencies on the way back.
part("pivots", "SELECT id FROM nodes0 ORDER BY sha1('42:' || id), id LIMIT 500")
part("lev0", "SELECT id AS p, id AS v, CAST(1 AS DOUBLE) AS sigma FROM pivots")
for _d in range(1, DEPTH + 1):
    _seen = " UNION ALL ".join(f"SELECT p, v FROM lev{i}" for i in range(_d))
    part(f"lev{_d}", f"""
      SELECT l.p, e.dst AS v, sum(l.sigma) AS sigma FROM lev{_d - 1} l JOIN edges e ON e.src = l.v
      ANTI JOIN ({_seen}) seen ON seen.p = l.p AND seen.v = e.dst GROUP BY 1, 2""")
part(f"dep{DEPTH}", f"SELECT p, v, sigma, CAST(0 AS DOUBLE) AS delta FROM lev{DEPTH}")
for _d in range(DEPTH - 1, -1, -1):
    part(f"dep{_d}", f"""
      SELECT l.p, l.v, l.sigma, coalesce(l.sigma * b.credit, 0) AS delta FROM lev{_d} l LEFT JOIN (
        SELECT n.p, e.src AS v, sum((1 + n.delta) / n.sigma) AS credit FROM dep{_d + 1} n JOIN edges e ON e.dst = n.v GROUP BY 1, 2
      ) b ON b.p = l.p AND b.v = l.v""")
part("all_deps", " UNION ALL ".join(f"SELECT p, v, delta FROM dep{d}" for d in range(DEPTH + 1)))
part("betweens", """
  SELECT id, coalesce(s, 0) * (CAST(1 AS DOUBLE) / ((n - 1) * (n - 2))) * (CAST(n AS DOUBLE) / least(500, n)) AS betweenness
  FROM nodes0 CROSS JOIN (SELECT count(*) AS n FROM nodes0) LEFT JOIN (SELECT v AS id, sum(delta) AS s FROM all_deps WHERE p <> v GROUP BY v) USING (id)""")
part("central_nodes", "SELECT * FROM nodes JOIN pageranks USING (id) JOIN betweens USING (id)")

# Removal scenarios: smallest label spreads for a fixed number of rounds, ample for these networks.
part("order_rows", """
  SELECT 'Random' AS strategy, id, row_number() OVER (ORDER BY sha1('42:' || id), id) AS pos FROM nodes0
  UNION ALL SELECT 'Structural', id, row_number() OVER (ORDER BY degree DESC, id) FROM nodes
  UNION ALL SELECT 'Operational', id, row_number() OVER (ORDER BY coalesce(avg_delay, 0) DESC, id) FROM nodes""")
part("steps", """
  SELECT i AS step, i * CAST(0.02 AS DOUBLE) AS fraction, CAST(floor((SELECT count(*) FROM nodes0) * (i * CAST(0.02 AS DOUBLE))) AS BIGINT) AS removed
  FROM (SELECT CAST(range AS INTEGER) AS i FROM range(11))""")
# Ranks of nodes that are placed alike differ by rounding alone.
part("attack_rows", """
  SELECT * FROM order_rows WHERE strategy <> 'Structural'
  UNION ALL SELECT 'Structural', id, row_number() OVER (ORDER BY round(pagerank, 12) DESC, id) FROM pageranks""")
part("alive", "SELECT strategy, step, id FROM attack_rows, steps WHERE pos > removed")
part("links", """
  SELECT a.strategy, a.step, b.src, b.dst FROM both_ways b JOIN alive a ON a.id = b.src
  JOIN alive c ON c.id = b.dst AND c.strategy = a.strategy AND c.step = a.step""")
part("spread0", "SELECT strategy, step, id, id AS label FROM alive")
for _d in range(1, DEPTH + 1):
    part(f"spread{_d}", f"""
      SELECT strategy, step, id, min(label) AS label FROM (
        SELECT * FROM spread{_d - 1} UNION ALL
        SELECT l.strategy, l.step, l.dst, s.label FROM links l JOIN spread{_d - 1} s ON s.strategy = l.strategy AND s.step = l.step AND s.id = l.src)
      GROUP BY 1, 2, 3""")

part("raw_points", "SELECT vec_id AS id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(POINT_COLS)) + " FROM embeddings")


def scaled(table: str, cols: list[str], keep: str) -> str:
    exprs = ", ".join(f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1) AS {c}" for c in cols)
    return f"SELECT {keep}, {exprs} FROM {table}"


def lloyd(prefix: str, table: str, cols: list[str], centers: list[list[float]], iters: int) -> None:
    """Parts ``prefix`` (id, cluster): fixed starts, ``iters`` moves, nearest center."""
    rows = ", ".join(f"({j}, {', '.join(f'CAST({v} AS DOUBLE)' for v in c)})" for j, c in enumerate(centers))
    names = ", ".join(cols)
    gap = " + ".join(f"(p.{c} - c.{c}) * (p.{c} - c.{c})" for c in cols)
    part(f"{prefix}_c0", f"VALUES {rows}", f"(j, {names})")
    for t in range(iters + 1):
        part(f"{prefix}_a{t}", f"""
          SELECT id, j FROM (SELECT p.id, c.j, row_number() OVER (PARTITION BY p.id ORDER BY {gap}, c.j) AS rn
            FROM {table} p CROSS JOIN {prefix}_c{t} c) WHERE rn = 1""")
        moved = ", ".join(f"coalesce(m.{c}, c.{c}) AS {c}" for c in cols)
        means = ", ".join(f"avg({c}) AS {c}" for c in cols)
        part(f"{prefix}_c{t + 1}", f"""
          SELECT c.j, {moved} FROM {prefix}_c{t} c LEFT JOIN (
            SELECT j, {means} FROM {prefix}_a{t} JOIN {table} USING (id) GROUP BY j) m ON m.j = c.j""")
    part(prefix, f"SELECT id, CAST(j AS INTEGER) AS cluster FROM {prefix}_a{iters}")


part("points", scaled("raw_points", POINT_COLS, "id, label"))
lloyd("point_clusters", "points", POINT_COLS, POINT_CENTERS, POINT_ITERS)
part("labelled", "SELECT * FROM points JOIN point_clusters USING (id)")
part("scaled_nodes", scaled("(SELECT id, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NODE_COLS) + " FROM known_nodes)", NODE_COLS, "id"))
lloyd("node_clusters", "scaled_nodes", NODE_COLS, NODE_CENTERS, NODE_ITERS)
part("clustered", "SELECT * FROM known_nodes JOIN node_clusters USING (id)")
part("worst", "SELECT cluster FROM clustered GROUP BY cluster ORDER BY avg(avg_delay) DESC, cluster LIMIT 1")

_GAP = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in POINT_COLS)
part("point_pairs", f"SELECT a.id AS a, b.id AS b, {_GAP} AS d2 FROM points a CROSS JOIN points b")
part("cores", f"SELECT a AS id FROM point_pairs WHERE d2 <= {RADIUS**2} GROUP BY a HAVING count(*) >= 5")
PARTS["core_reach"] = f"""core_reach(id, label) AS (
  SELECT id, id FROM cores UNION SELECT p.b, r.label FROM core_reach r JOIN point_pairs p ON p.a = r.id AND p.d2 <= {RADIUS**2}
  WHERE p.b IN (SELECT id FROM cores))"""
part("core_labels", "SELECT id, dense_rank() OVER (ORDER BY label) - 1 AS cluster FROM (SELECT id, min(label) AS label FROM core_reach GROUP BY id)")
part("density_clusters", f"""
  SELECT p.id, CAST(coalesce(c.cluster, b.cluster, -1) AS BIGINT) AS cluster, c.id IS NOT NULL AS core
  FROM points p LEFT JOIN core_labels c USING (id) LEFT JOIN (
    SELECT q.a AS id, min(k.cluster) AS cluster FROM point_pairs q JOIN core_labels k ON k.id = q.b WHERE q.d2 <= {RADIUS**2} GROUP BY 1) b ON b.id = p.id""")
part("near_points", "SELECT a AS id, b AS nbr, sqrt(d2) AS dist, row_number() OVER (PARTITION BY a ORDER BY d2, a <> b, b) AS rank FROM point_pairs")

# Principal components: a covariance matrix squared often enough leaves its leading direction in
# every column; the second comes from what the first leaves over.
part("long_points", f"SELECT id, unnest(range({len(POINT_COLS)})) AS i, unnest([{', '.join(POINT_COLS)}]) AS v FROM points")
part("cov_a0", "SELECT x.i, y.i AS j, covar_samp(x.v, y.v) AS v FROM long_points x JOIN long_points y ON x.id = y.id GROUP BY 1, 2")
for _side, _next in (("a", "b"), ("b", None)):
    for _t in range(20):
        part(f"cov_{_side}{_t + 1}", f"""
          SELECT i, j, v / sum(CASE WHEN i = j THEN v END) OVER () AS v FROM (
            SELECT x.i, y.j, sum(x.v * y.v) AS v FROM cov_{_side}{_t} x JOIN cov_{_side}{_t} y ON x.j = y.i GROUP BY 1, 2)""")
    part(f"axis_{_side}", f"""
      SELECT i, v / sqrt(sum(v * v) OVER ()) * (CASE WHEN arg_max(v, abs(v)) OVER () < 0 THEN -1 ELSE 1 END) AS v
      FROM cov_{_side}20 WHERE j = (SELECT j FROM cov_{_side}20 WHERE i = j ORDER BY v DESC LIMIT 1)""")
    part(f"spread_{_side}", f"""
      SELECT sum(x.v * c.v * y.v) AS v FROM cov_{_side}0 c JOIN axis_{_side} x ON x.i = c.i JOIN axis_{_side} y ON y.i = c.j""")
    if _next:
        part(f"cov_{_next}0", f"""
          SELECT c.i, c.j, c.v - (SELECT v FROM spread_{_side}) * x.v * y.v AS v
          FROM cov_{_side}0 c JOIN axis_{_side} x ON x.i = c.i JOIN axis_{_side} y ON y.i = c.j""")

part("sets", "SELECT src AS id, dst AS member FROM edges WHERE src IN (SELECT id FROM known_nodes)")
part("profiles", "SELECT min(id) AS id, count(*) AS held FROM (SELECT id, string_agg(member, ',' ORDER BY member) AS t FROM sets GROUP BY id) GROUP BY t")
part("memberships", """
  SELECT id, min(id) OVER (PARTITION BY t) AS profile, count(*) OVER (PARTITION BY t) AS held
  FROM (SELECT id, string_agg(member, ',' ORDER BY member) AS t FROM sets GROUP BY id)""")
part("set_sizes", "SELECT id, count(*) AS n FROM sets GROUP BY id")
_MINIMA = ", ".join(f"min((h * {a} + {b}) % 2147483647)" for a, b in permutations(128))
part("signatures", f"""
  SELECT id, [{_MINIMA}] AS sig FROM (
    SELECT id, CAST('0x' || substr(sha1(member), 1, 8) AS BIGINT) % 2147483647 AS h FROM sets) GROUP BY id""")
part("band_rows", """
  SELECT id, CAST(i AS INTEGER) AS band, sig[2 * i + 1] || '-' || sig[2 * i + 2] AS bucket
  FROM signatures CROSS JOIN (SELECT range AS i FROM range(64))""")
part("queries", "SELECT DISTINCT id, sha1('42:' || id) AS h FROM sets ORDER BY h, id LIMIT 50")
for _all, _asked in (("", "a.id IN (SELECT id FROM queries) AND "), ("all_", "")):
    part(f"{_all}candidates", f"""
  SELECT DISTINCT a.id, b.id AS other FROM band_rows a JOIN band_rows b ON a.band = b.band AND a.bucket = b.bucket
  WHERE {_asked}a.id <> b.id""")
    part(f"{_all}query_overlaps", f"""
  SELECT a.id, b.id AS other, count(*) AS common FROM sets a JOIN sets b ON a.member = b.member
  WHERE {_asked}a.id <> b.id GROUP BY 1, 2""")
    part(f"{_all}query_jaccard", f"""
  SELECT o.id, o.other, o.common, CAST(o.common AS DOUBLE) / (x.n + y.n - o.common) AS jaccard
  FROM {_all}query_overlaps o JOIN set_sizes x ON x.id = o.id JOIN set_sizes y ON y.id = o.other""")
    part(f"{_all}candidate_jaccard", f"""
  SELECT c.id, c.other, coalesce(o.common, 0) AS common, CAST(coalesce(o.common, 0) AS DOUBLE) / (x.n + y.n - coalesce(o.common, 0)) AS jaccard
  FROM {_all}candidates c LEFT JOIN {_all}query_overlaps o ON o.id = c.id AND o.other = c.other
    JOIN set_sizes x ON x.id = c.id JOIN set_sizes y ON y.id = c.other""")
part("profile_pairs", """
  SELECT c.id AS a, c.other AS b, p.held AS members_a, q.held AS members_b
  FROM all_candidates c JOIN profiles p ON p.id = c.id JOIN profiles q ON q.id = c.other WHERE c.id < c.other""")
part("rec_pairs", """
  SELECT DISTINCT a.id, b.id AS other FROM band_rows a JOIN band_rows b ON a.band = b.band AND a.bucket = b.bucket
  JOIN clustered x ON x.id = a.id JOIN clustered y ON y.id = b.id
  WHERE x.cluster = (SELECT cluster FROM worst) AND a.id <> b.id AND x.avg_delay - y.avg_delay > 5 AND y.degree >= 0.5 * x.degree""")
part("recs", """
  SELECT p.id AS "Bottleneck_Airport", x.cluster || ' vs ' || y.cluster AS "Cluster_Match", p.other AS "Recommended_Twin",
    CAST(coalesce(o.c, 0) AS DOUBLE) / (s.n + t.n - coalesce(o.c, 0)) AS "Similarity", x.avg_delay AS "Current_Delay",
    y.avg_delay AS "Expected_Delay", x.avg_delay - y.avg_delay AS "Potential_Gain", x.degree || ' vs ' || y.degree AS "Capacity_Match"
  FROM rec_pairs p JOIN clustered x ON x.id = p.id JOIN clustered y ON y.id = p.other
    JOIN set_sizes s ON s.id = p.id JOIN set_sizes t ON t.id = p.other
    LEFT JOIN (SELECT q.id, q.other, count(*) AS c FROM rec_pairs q JOIN sets a ON a.id = q.id JOIN sets b ON b.id = q.other AND b.member = a.member GROUP BY 1, 2) o
      ON o.id = p.id AND o.other = p.other""")

# p-value of Spearman's coefficient of betweenness and delay: the state of the continued fraction (modified Lentz) after m pairs of steps.
part("spearman", """
  SELECT count(*) AS n, corr(ra, rb) AS r FROM (
    SELECT rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / CAST(2 AS DOUBLE) AS ra,
      rank() OVER (ORDER BY avg_delay) + (count(*) OVER (PARTITION BY avg_delay) - 1) / CAST(2 AS DOUBLE) AS rb
    FROM (SELECT round(betweenness, 10) AS b, avg_delay FROM central_nodes WHERE avg_delay IS NOT NULL))""")
_ODD = "(-(a + m) * (a + 0.5 + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))"
_EVEN = "(m * (0.5 - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))"
part("lentz", f"""
  SELECT 0 AS m, n, r, a, x, CAST(1 AS DOUBLE) AS c, 1 / (1 - (a + 0.5) * x / (a + 1)) AS d, 1 / (1 - (a + 0.5) * x / (a + 1)) AS v
  FROM (SELECT n, r, CAST(n - 2 AS DOUBLE) / 2 AS a, 1 - r * r AS x FROM spearman)
  UNION ALL
  SELECT m, n, r, a, x, 1 + {_ODD} / c, 1 / (1 + {_ODD} * d), v * (1 + {_ODD} / c) / (1 + {_ODD} * d)
  FROM (SELECT m, n, r, a, x, 1 + {_EVEN} / c AS c, 1 / (1 + {_EVEN} * d) AS d, v * (1 + {_EVEN} / c) / (1 + {_EVEN} * d) AS v
    FROM (SELECT CAST(m + 1 AS DOUBLE) AS m, n, r, a, x, c, d, v FROM lentz WHERE m < 30))""")

_WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


def compose(body: str) -> str:
    """``body`` with all parts it needs, directly or through other parts, in defining order."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        for word in set(_WORD.findall(todo.pop())):
            if word in PARTS and word not in needed:
                needed.add(word)
                todo.append(PARTS[word])
    if not needed:
        return body
    return "WITH RECURSIVE " + ",\n".join(PARTS[name] for name in PARTS if name in needed) + "\n" + body
