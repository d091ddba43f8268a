"""Every operator as a query over the given tables, next to the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import (
    clean,
    components,
    facts,
    hierarchy,
    kmeans,
    mixing,
    neighbors,
    network,
    pagerank,
    paths,
    projection,
    ranks,
    recommend,
    reconcile,
    removal,
    resolve,
    scaling,
    scores,
    similarity,
    stats,
)
from ..session import Workspace, stage
from ..sources import files
from .inputs import CODE, NODE_COLS, POINT_COLS, RADIUS, Inputs
from .oracle import compose, ratio, rnd

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = compose(sql)
        return fn

    return register


def rounded(df: DataFrame, digits: int | dict[str, int] = 6) -> DataFrame:
    """Doubles rounded for comparison across engines."""
    places = digits if isinstance(digits, dict) else {f.name: digits for f in df.schema if f.dataType.typeName() == "double"}
    return df.withColumns({c: F.round(c, d) for c, d in places.items()})


def as_long(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})


# --- sources and sinks ------------------------------------------------------------------------

NODE_SCHEMA = "code string, name string, region string, num bigint"


def _in_layouts(table: DataFrame, layouts: list[list[str]], **options) -> list[str]:
    """Folders of headered CSV files that order their columns in different ways and hold the table between them."""
    work, folders = Workspace(table.sparkSession, "csv"), []
    for k, columns in enumerate(layouts):
        own = table.filter(F.pmod(F.xxhash64(*table.columns), F.lit(len(layouts))) == k)
        own.select(*columns).write.options(header=True, **options).csv(work.path(f"layout-{k}"))
        folders.append(work.path(f"layout-{k}"))
    return folders


@query("src_static_csv", "SELECT code, name, region, num FROM raw_nodes")
def _(i: Inputs) -> DataFrame:
    layouts = [["code", "name", "region", "num"], ["region", "num", "code", "name"]]
    return files.read_static(i.spark, _in_layouts(i.raw_nodes, layouts, nullValue="\\N"), NODE_SCHEMA)


@query("src_monthly_csv", "SELECT origin, dest, CAST(cancelled AS DOUBLE) AS cancelled, CAST(diverted AS DOUBLE) AS diverted, delay FROM facts")
def _(i: Inputs) -> DataFrame:
    layouts = [["flag", "dest", "origin", "status", "cancelled", "delay", "diverted"], ["diverted", "origin", "delay", "dest", "cancelled", "shipped"]]
    # Stored, because each layout reads them; the files follow the stored pieces.
    months = stage(i.facts.select("shipped", *layouts[0]), "months")
    return files.read_monthly(
        i.spark, _in_layouts(months, layouts), {"origin": "string", "dest": "string", "cancelled": "double", "diverted": "double", "delay": "double"}
    )


BANNER_COLUMNS = ["Situação Voo", "ICAO Aeródromo Origem", "ICAO Aeródromo Destino", "Partida Prevista", "Partida Real"]


@query(
    "src_banner_text",
    """SELECT status, origin, dest, strftime(scheduled, '%Y-%m-%d %H:%M:%S') AS scheduled,
       strftime(actual, '%Y-%m-%d %H:%M:%S') AS actual FROM facts""",
)
def _(i: Inputs) -> DataFrame:
    path, form = Workspace(i.spark, "csv").path("banner"), "yyyy-MM-dd HH:mm:ss"
    cells = [F.col("status"), F.col("origin"), F.col("dest"), F.date_format("scheduled", form), F.coalesce(F.date_format("actual", form), F.lit(""))]
    orders = [[0, 1, 2, 3, 4], [3, 2, 4, 0, 1]]

    def row(layout: int, kind: int, line: Column) -> Column:
        return F.struct(F.lit(layout).alias("layout"), F.lit(kind).alias("kind"), line.alias("line"))

    # A banner and a header in either layout.
    extra = [
        row(k, kind, line)
        for k, order in enumerate(orders)
        for kind, line in ((0, F.concat_ws("", F.lit("Atualizado em: "), "status")), (1, F.lit(";".join(BANNER_COLUMNS[n] for n in order))))
    ]
    own = [row(k, 2, F.concat_ws(";", *[cells[n] for n in order])) for k, order in enumerate(orders)]
    own = F.when(F.pmod(F.xxhash64(*i.facts.columns), F.lit(2)) == 0, own[0]).otherwise(own[1])
    # The first row of every task brings them along, so that each file begins with a banner without moving the lines.
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    data = i.facts.select(own.alias("own"), F.array(*extra).alias("extra"), first.alias("first"))
    data = data.select(F.explode(F.when(F.col("first"), F.concat("extra", F.array("own"))).otherwise(F.array("own"))).alias("r"))
    head = i.table("orders").select(F.col("o_orderstatus").alias("status")).distinct().select(F.explode(F.array(*extra)).alias("r"))
    rows = data.unionByName(head).select("r.*").sortWithinPartitions("layout", "kind").select("layout", "line")
    rows.write.partitionBy("layout").option("sep", "\u0001").option("quote", "\u0000").option("encoding", "ISO-8859-1").csv(path)
    folders = [f"{path}/layout={k}" for k in range(len(orders))]
    return files.read_banner_text(i.spark, folders, BANNER_COLUMNS).toDF("status", "origin", "dest", "scheduled", "actual")


@query("src_encoded_csv", "SELECT id, name || ' São João' AS name, region FROM coded_nodes")
def _(i: Inputs) -> DataFrame:
    names = i.coded_nodes.select("id", F.concat("name", F.lit(" São João")).alias("name"), "region")
    layouts = [["id", "name", "region"], ["name", "region", "id"]]
    return files.read_encoded(i.spark, _in_layouts(names, layouts, encoding="ISO-8859-1"), "id string, name string, region string")


@query(
    "sink_ranked_csv",
    f"SELECT id, name, region, cluster, {rnd('avg_delay', 4)} AS avg_delay, {rnd('delay_std', 4)} AS delay_std, degree FROM clustered",
)
def _(i: Inputs) -> DataFrame:
    path = Workspace(i.spark, "csv").path("ranked")
    cols = ["id", "name", "region", "cluster", "avg_delay", "delay_std", "degree"]
    files.write_ranked(i.clustered_nodes, cols, "avg_delay", path)
    schema = "id string, name string, region string, cluster int, avg_delay double, delay_std double, degree bigint"
    return rounded(i.spark.read.schema(schema).option("header", True).csv(path), 4)


@query("stage_table", f"SELECT id, name, {rnd('avg_delay', 4)} AS avg_delay, degree FROM nodes")
def _(i: Inputs) -> DataFrame:
    phase = facts.enrich(i.network.vertices, i.metrics).join(i.degrees, "id")
    return rounded(files.stage_table(phase, "phase1").select("id", "name", "avg_delay", "degree"), 4)


# --- projections, filters, predicates ----------------------------------------------------------


@query("filter_code_pattern", "SELECT code, name, num FROM raw_nodes WHERE regexp_matches(code, '^[PS][0-9]+$')")
def _(i: Inputs) -> DataFrame:
    return clean.keep_codes(i.raw_nodes, ["code"], CODE).select("code", "name", "num")


@query("filter_direct", "SELECT src, dst, stops FROM raw_routes WHERE stops = 0")
def _(i: Inputs) -> DataFrame:
    return clean.direct_only(i.raw_routes)


@query("filter_completed", "SELECT origin, dest, delay FROM facts WHERE cancelled = 0 AND diverted = 0")
def _(i: Inputs) -> DataFrame:
    return clean.completed(i.facts).select("origin", "dest", "delay")


@query("filter_status", "SELECT origin, dest, delay FROM facts WHERE status = 'F'")
def _(i: Inputs) -> DataFrame:
    return clean.with_status(i.facts, "status", "F").select("origin", "dest", "delay")


@query("filter_header_rows", "SELECT origin, dest, status FROM facts WHERE status <> 'O'")
def _(i: Inputs) -> DataFrame:
    return clean.drop_header_rows(i.facts, "status", "O").select("origin", "dest", "status")


@query(
    "filter_member_codes",
    "SELECT origin, dest, delay FROM facts WHERE origin IN (SELECT code FROM raw_nodes WHERE region IN ('Brand#1', 'Nation#7') AND code IS NOT NULL)",
)
def _(i: Inputs) -> DataFrame:
    codes = i.raw_nodes.filter(F.col("region").isin("Brand#1", "Nation#7")).select("code")
    return clean.restrict_to(i.facts, codes, "origin").select("origin", "dest", "delay")


@query("project_rename", "SELECT code AS id, name AS label, region AS area FROM raw_nodes")
def _(i: Inputs) -> DataFrame:
    return clean.to_vertices(i.raw_nodes, "code", label="name", area="region")


@query("project_cast", "SELECT origin, direction, TRY_CAST(avg_text AS DOUBLE) AS avg_text, TRY_CAST(cnt_text AS DOUBLE) AS cnt_text FROM all_average_rows")
def _(i: Inputs) -> DataFrame:
    return C.to_double(i.all_average_rows, ["avg_text", "cnt_text"]).select("origin", "direction", "avg_text", "cnt_text")


@query("coerce_number", "SELECT origin, direction, coalesce(TRY_CAST(avg_text AS DOUBLE), 0.0) AS avg_delay FROM all_average_rows")
def _(i: Inputs) -> DataFrame:
    return i.all_average_rows.select("origin", "direction", C.coerce("avg_text").alias("avg_delay"))


@query("drop_nulls", "SELECT origin, dest, delay FROM facts WHERE actual IS NOT NULL AND scheduled IS NOT NULL")
def _(i: Inputs) -> DataFrame:
    return clean.complete(i.facts, ["actual", "scheduled"]).select("origin", "dest", "delay")


@query("fill_nulls", f"SELECT id, {rnd('coalesce(avg_delay, 0)', 4)} AS avg_delay, {rnd('coalesce(num_flights, 0)', 4)} AS num_flights FROM nodes")
def _(i: Inputs) -> DataFrame:
    filled = clean.defaults(i.nodes, {"avg_delay": 0.0, "num_flights": 0.0})
    return rounded(filled.select("id", "avg_delay", "num_flights"), 4)


@query("delay_minutes", "SELECT origin, dest, delay FROM facts")
def _(i: Inputs) -> DataFrame:
    form = "yyyy-MM-dd HH:mm:ss"
    text = i.facts.select("origin", "dest", F.date_format("actual", form).alias("a"), F.date_format("scheduled", form).alias("s"))
    return text.select("origin", "dest", C.delay_minutes(C.parse_time("a"), C.parse_time("s")).alias("delay"))


@query("label_match", "SELECT id, in_degree || ' vs ' || out_degree AS label FROM degrees")
def _(i: Inputs) -> DataFrame:
    return i.degrees.select("id", C.versus("in_degree", "out_degree").alias("label"))


@query(
    "verdict_case",
    """SELECT yr, flag, CASE WHEN r > 0.1 THEN 'CONFIRMED' WHEN r < -0.1 THEN 'REJECTED' ELSE 'INCONCLUSIVE' END AS verdict
       FROM (SELECT CAST(year(shipped) AS INTEGER) AS yr, flag, corr(num, delay) AS r FROM facts GROUP BY 1, 2)""",
)
def _(i: Inputs) -> DataFrame:
    per_year = i.facts.groupBy(F.year("shipped").alias("yr"), "flag").agg(F.corr("num", "delay").alias("r"))
    return per_year.select("yr", "flag", C.verdict("r").alias("verdict"))


# --- joins -------------------------------------------------------------------------------------


@query("join_ref_integrity", "SELECT src, dst FROM coded_routes WHERE src IN (SELECT id FROM coded_nodes) AND dst IN (SELECT id FROM coded_nodes)")
def _(i: Inputs) -> DataFrame:
    return clean.referential(i.coded_routes, i.coded_nodes)


@query("join_active_nodes", "SELECT id, name FROM coded_nodes WHERE id IN (SELECT src FROM coded_routes UNION SELECT dst FROM coded_routes)")
def _(i: Inputs) -> DataFrame:
    return clean.active(i.coded_nodes, i.coded_routes).select("id", "name")


@query("join_enrich_left", f"SELECT id, name, {rnd('avg_delay', 4)} AS avg_delay, {rnd('delay_std', 4)} AS delay_std, {rnd('num_flights', 4)} AS num_flights FROM coded_nodes LEFT JOIN metrics USING (id)")
def _(i: Inputs) -> DataFrame:
    return rounded(facts.enrich(i.coded_nodes.select("id", "name"), i.metrics), 4)


@query("join_translate_keys", f"SELECT id, {rnd('avg_delay', 4)} AS avg_delay, num_flights FROM source_b")
def _(i: Inputs) -> DataFrame:
    return rounded(i.source_b.select("id", "avg_delay", "num_flights"), 4)


@query("join_resolve_names")
def _(i: Inputs) -> DataFrame:
    parts = i.table("part")
    at = F.col("p_partkey") % 5 + 1
    noisy = F.concat(F.substring("p_name", F.lit(1), at.cast("int")), F.substring("p_name", (at + 2).cast("int"), F.lit(200)))
    kind = F.col("p_partkey") % 4
    names = parts.select(
        F.when(kind == 0, noisy).when(kind == 1, F.concat("p_name", F.lit(" (Main)"))).when(kind == 2, F.col("p_type")).otherwise(F.col("p_name")).alias("name")
    )
    directory = resolve.directory_of(parts.select("p_name", "p_partkey"), "p_name", "p_partkey", "p_partkey")
    overrides = {"STANDARD": "-1", "ECONOMY": "-2"}
    return resolve.resolve_names(names, directory.withColumn("code", F.col("code").cast("string")), overrides)


@query(
    "match_rate",
    f"""SELECT count(*) AS total, count(n.id) AS matched, {rnd(ratio('count(n.id)', 'count(*)'), 6)} AS share
        FROM metrics m LEFT JOIN nodes0 n ON n.id = m.id""",
)
def _(i: Inputs) -> DataFrame:
    return rounded(facts.match_rate(i.metrics, i.network.vertices))


@query("edges_matched", "SELECT src, dst FROM observed INTERSECT SELECT src, dst FROM listed")
def _(i: Inputs) -> DataFrame:
    return reconcile.matched(i.observed, i.listed.edges)


@query("edges_missing", "SELECT src, dst FROM missing")
def _(i: Inputs) -> DataFrame:
    return reconcile.missing(i.observed, i.listed.edges)


@query(
    "edges_classified",
    f"""SELECT reason, count(*) AS edges, {rnd('count(*) / CAST((SELECT count(*) FROM missing) AS DOUBLE)', 6)} AS share FROM (
        SELECT CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'Both_Nodes_Exist' WHEN a.id IS NOT NULL THEN 'Only_Src_Exists'
          WHEN b.id IS NOT NULL THEN 'Only_Dst_Exists' ELSE 'Neither_Exists' END AS reason
        FROM missing m LEFT JOIN nodes0 a ON a.id = m.src LEFT JOIN nodes0 b ON b.id = m.dst) GROUP BY reason""",
)
def _(i: Inputs) -> DataFrame:
    return rounded(reconcile.classify_missing(reconcile.missing(i.observed, i.listed.edges), i.listed.vertices))


@query(
    "join_jaccard_exact",
    f"""SELECT a, b, members_a, members_b, {rnd('jaccard', 8)} AS jaccard FROM (
          WITH texts AS MATERIALIZED (SELECT id, string_agg(member, ',' ORDER BY member) AS t FROM sets GROUP BY id),
            profiles AS MATERIALIZED (SELECT min(id) AS id, count(*) AS held FROM texts GROUP BY t),
            kept AS MATERIALIZED (SELECT s.id, s.member FROM sets s WHERE s.id IN (SELECT id FROM profiles)),
            shared AS MATERIALIZED (SELECT x.id AS a, y.id AS b, count(*) AS c FROM kept x JOIN kept y ON x.member = y.member AND x.id < y.id GROUP BY 1, 2)
          SELECT o.a, o.b, p.held AS members_a, q.held AS members_b, CAST(c AS DOUBLE) / (m.n + n.n - c) AS jaccard
          FROM shared o JOIN set_sizes m ON m.id = o.a JOIN set_sizes n ON n.id = o.b JOIN profiles p ON p.id = o.a JOIN profiles q ON q.id = o.b
          WHERE CAST(c AS DOUBLE) / (m.n + n.n - c) >= 0.125
          UNION ALL SELECT id, id, held, held, 1.0 FROM profiles WHERE held > 1)""",
)
def _(i: Inputs) -> DataFrame:
    return rounded(similarity.jaccard_pairs(i.sets, similarity.THRESHOLD), 8)


def _signatures(i: Inputs) -> DataFrame:
    return i._once("signatures", lambda: similarity.minhash(i.sets))


def _queries(i: Inputs) -> DataFrame:
    return i._once("queries", lambda: similarity.sample_nodes(i.sets.select("id").distinct()))


def _profile_pairs(i: Inputs) -> DataFrame:
    return i._once("profile-pairs", lambda: similarity.profile_candidates(i.sets))


@query("join_lsh_candidates", "SELECT id, other FROM all_candidates")
def _(i: Inputs) -> DataFrame:
    return similarity.node_candidates(_signatures(i))


@query("join_radius", f"SELECT a AS id, count(*) AS n_within FROM point_pairs WHERE d2 <= {RADIUS**2} GROUP BY a")
def _(i: Inputs) -> DataFrame:
    return neighbors.within(i.points, POINT_COLS, RADIUS)


@query("join_knn", f"SELECT id, nbr, {rnd('dist', 8)} AS dist, CAST(rank AS INTEGER) AS rank FROM near_points WHERE rank <= 5")
def _(i: Inputs) -> DataFrame:
    return rounded(neighbors.knn(i.points, POINT_COLS, 5), 8)


@query("induced_subgraph", "SELECT src, dst FROM edges WHERE src IN (SELECT id FROM known_nodes) AND dst IN (SELECT id FROM known_nodes)")
def _(i: Inputs) -> DataFrame:
    return network.induced(i.network.edges, i.nodes.dropna(subset=NODE_COLS).select("id"))


# --- aggregations ------------------------------------------------------------------------------


@query("agg_delay_metrics", f"SELECT origin AS id, {rnd('avg(delay)', 4)} AS avg_delay, {rnd('stddev_samp(delay)', 4)} AS delay_std, count(delay) AS num_flights FROM completed GROUP BY 1")
def _(i: Inputs) -> DataFrame:
    return rounded(facts.delay_metrics(i.completed, "origin"), 4)


@query("agg_weighted_mean", f"SELECT id, {rnd('avg_delay', 4)} AS avg_delay, {rnd('delay_std', 4)} AS delay_std, CAST(num_flights AS DOUBLE) AS num_flights FROM source_c")
def _(i: Inputs) -> DataFrame:
    return rounded(i.source_c, 4)


@query("agg_merge_sources", f"SELECT id, {rnd('avg_delay', 4)} AS avg_delay, {rnd('delay_std', 4)} AS delay_std, {rnd('num_flights', 4)} AS num_flights FROM metrics")
def _(i: Inputs) -> DataFrame:
    return rounded(i.metrics, 4)


@query(
    "report_cleaning",
    """SELECT step, CAST(rows_before AS BIGINT) AS rows_before, CAST(rows_after AS BIGINT) AS rows_after, CAST(rows_before - rows_after AS BIGINT) AS dropped FROM (
        WITH c AS MATERIALIZED (SELECT count(*) AS n0, sum(CAST(s IS NOT NULL AND d IS NOT NULL AS INTEGER)) AS n1,
            sum(CAST(s IS NOT NULL AND d IS NOT NULL AND src <> dst AS INTEGER)) AS n2
          FROM (SELECT r.src, r.dst, a.id AS s, b.id AS d FROM coded_routes r LEFT JOIN coded_nodes a ON a.id = r.src LEFT JOIN coded_nodes b ON b.id = r.dst))
        SELECT 'referential' AS step, n0 AS rows_before, n1 AS rows_after FROM c
        UNION ALL SELECT 'self_loops', n1, n2 FROM c
        UNION ALL SELECT 'duplicates', n2, (SELECT count(*) FROM listed) FROM c
        UNION ALL SELECT 'isolated', (SELECT count(*) FROM coded_nodes), (SELECT count(*) FROM nodes0))""",
)
def _(i: Inputs) -> DataFrame:
    return clean.cleaning_report(i.coded_nodes, i.coded_routes)


@query(
    "report_coverage",
    f"""SELECT what, with_data, total, {rnd(ratio('with_data', 'total'), 6)} AS share FROM (
        SELECT 'nodes' AS what, count(avg_delay) AS with_data, count(*) AS total FROM nodes
        UNION ALL SELECT 'edges', count(o.src), count(*) FROM edges e LEFT JOIN observed o ON o.src = e.src AND o.dst = e.dst)""",
)
def _(i: Inputs) -> DataFrame:
    return rounded(reconcile.coverage(i.nodes, i.listed.edges, i.observed))


DESCRIBED = ["in_degree", "out_degree", "degree", "pagerank", "betweenness", "avg_delay", "delay_std"]


@query(
    "agg_describe",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS metric, count({c}) AS n, {rnd(f'avg({c})', 8)} AS mean, {rnd(f'stddev_samp({c})', 4)} AS std, {rnd(f'min({c})', 8)} AS min,
        {rnd(f'quantile_cont({c}, 0.25)', 8)} AS q1, {rnd(f'quantile_cont({c}, 0.5)', 8)} AS median, {rnd(f'quantile_cont({c}, 0.75)', 8)} AS q3,
        {rnd(f'max({c})', 8)} AS max FROM (SELECT CAST({c} AS DOUBLE) AS {c} FROM central_nodes)"""
        for c in DESCRIBED
    ),
)
def _(i: Inputs) -> DataFrame:
    wide = {c: 8 for c in ("mean", "min", "q1", "median", "q3", "max")}
    return rounded(stats.describe_metrics(i.central_nodes, DESCRIBED), {**wide, "std": 4})


@query("agg_degree_frequency", f"SELECT degree AS k, count(*) AS nodes, {rnd('count(*) / CAST((SELECT count(*) FROM degrees WHERE degree > 0) AS DOUBLE)', 8)} AS p FROM degrees WHERE degree > 0 GROUP BY 1")
def _(i: Inputs) -> DataFrame:
    return rounded(stats.degree_pdf(i.degrees), 8)


@query(
    "agg_histogram",
    f"""SELECT CAST(b.i AS INTEGER) AS bin, {rnd('low + i * (high - low) / 50', 4)} AS low, {rnd('low + (i + 1) * (high - low) / 50', 4)} AS high, count(v) AS rows FROM (
        SELECT range AS i FROM range(50)) b CROSS JOIN (SELECT min(avg_delay) AS low, max(avg_delay) AS high FROM nodes)
        LEFT JOIN (SELECT avg_delay AS v, least(floor((avg_delay - min(avg_delay) OVER ()) / (max(avg_delay) OVER () - min(avg_delay) OVER ()) * 50), 49) AS place
          FROM nodes WHERE avg_delay IS NOT NULL) ON place = b.i GROUP BY b.i, low, high""",
)
def _(i: Inputs) -> DataFrame:
    return rounded(stats.histogram(i.nodes, "avg_delay", 50), 4)


@query(
    "agg_density",
    f"""SELECT CAST(g.i AS INTEGER) AS point, {rnd('low + g.i * (high - low) / 199', 4)} AS x,
          {rnd('1e6 * sum(exp(-pow((low + g.i * (high - low) / 199 - avg_delay) / h, 2) / 2)) / (n * h * sqrt(2 * pi()))', 8)} AS density
        FROM (SELECT range AS i FROM range(200)) g CROSS JOIN (SELECT avg_delay FROM nodes WHERE avg_delay IS NOT NULL)
        CROSS JOIN (SELECT min(avg_delay) AS low, max(avg_delay) AS high, stddev_samp(avg_delay) * pow(count(avg_delay), -0.2) AS h, count(avg_delay) AS n FROM nodes)
        GROUP BY g.i, low, high, h, n""",
)
def _(i: Inputs) -> DataFrame:
    table = stats.density(i.nodes, "avg_delay", 200)
    return rounded(table.withColumn("density", F.col("density") * 1e6), {"x": 4, "density": 8})


BOXED = ["avg_delay", "delay_std", "degree"]


@query(
    "agg_cluster_boxes",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS metric, cluster, {rnd('q1', 4)} AS q1, {rnd('median', 4)} AS median, {rnd('q3', 4)} AS q3,
        {rnd(f'min({c}) FILTER ({c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1))', 4)} AS whisker_low,
        {rnd(f'max({c}) FILTER ({c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1))', 4)} AS whisker_high,
        count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers
        FROM clustered JOIN (SELECT cluster, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3
          FROM (SELECT cluster, CAST({c} AS DOUBLE) AS {c} FROM clustered) GROUP BY 1) USING (cluster) GROUP BY cluster, q1, median, q3"""
        for c in BOXED
    ),
)
def _(i: Inputs) -> DataFrame:
    return rounded(stats.cluster_boxes(i.clustered_nodes, "cluster", BOXED), 4)


@query("agg_worst_cluster", f"SELECT id, cluster, {rnd('avg_delay', 4)} AS avg_delay FROM clustered WHERE cluster = (SELECT cluster FROM worst)")
def _(i: Inputs) -> DataFrame:
    return rounded(stats.worst_cluster(i.clustered_nodes).select("id", "cluster", "avg_delay"), 4)


@query(
    "agg_confusion",
    f"""SELECT tp, fp, fn, tn, {rnd('CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn)', 6)} AS accuracy, {rnd('CAST(tp AS DOUBLE) / (tp + fp)', 6)} AS precision,
        {rnd('CAST(tp AS DOUBLE) / (tp + fn)', 6)} AS recall, {rnd('CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn)', 6)} AS f1 FROM (
        SELECT tp, fp, fn, CAST((SELECT count(*) FROM nodes0) * (SELECT count(*) FROM nodes0) - tp - fp - fn AS BIGINT) AS tn FROM (
          SELECT count(*) FILTER (l.src IS NOT NULL AND o.src IS NOT NULL) AS tp, count(*) FILTER (l.src IS NULL) AS fp, count(*) FILTER (o.src IS NULL) AS fn
          FROM listed l FULL JOIN observed o ON l.src = o.src AND l.dst = o.dst))""",
)
def _(i: Inputs) -> DataFrame:
    pairs = [t.select(F.col("src").alias("id"), F.col("dst").alias("other")) for t in (i.listed.edges, i.observed)]
    n = i.listed.vertices.count()
    return rounded(similarity.pair_quality(*pairs, n * n))


def _recs(i: Inputs) -> DataFrame:
    return recommend.recommend(i.clustered_nodes, i.sets, signatures=_signatures(i))


@query(
    "agg_rec_summary",
    f"""SELECT count(*) AS total, count(*) FILTER ("Similarity" > 0.4) AS similar, {rnd('avg("Potential_Gain")', 4)} AS mean_gain, {rnd('max("Potential_Gain")', 4)} AS max_gain FROM recs""",
)
def _(i: Inputs) -> DataFrame:
    return rounded(recommend.rec_summary(_recs(i)), 4)


# --- ranking, sort, limit ----------------------------------------------------------------------


@query(
    "topk_metric",
    f"""SELECT * FROM (SELECT 'pagerank' AS metric, id, {rnd('pagerank', 8)} AS value FROM pageranks ORDER BY pagerank DESC, id LIMIT 5)
        UNION ALL SELECT * FROM (SELECT 'avg_delay', id, {rnd('avg_delay', 4)} FROM nodes ORDER BY avg_delay DESC NULLS LAST, id LIMIT 5)""",
)
def _(i: Inputs) -> DataFrame:
    top = [
        ranks.topk(i.ranked_nodes, c, 5).select(F.lit(c).alias("metric"), "id", F.round(c, d).alias("value"))
        for c, d in (("pagerank", 8), ("avg_delay", 4))
    ]
    return top[0].unionByName(top[1])


@query("sort_desc", f"SELECT id, {rnd('avg_delay', 4)} AS avg_delay, row_number() OVER (ORDER BY avg_delay DESC, id) AS position FROM nodes WHERE avg_delay IS NOT NULL")
def _(i: Inputs) -> DataFrame:
    known = i.nodes.filter("avg_delay IS NOT NULL").select("id", "avg_delay")
    return rounded(ranks.ranked(known, "avg_delay"), 4)


@query("rank_ccdf", f"SELECT degree AS k, {rnd('1 - CAST(row_number() OVER (ORDER BY degree) - 1 AS DOUBLE) / count(*) OVER ()', 8)} AS ccdf FROM degrees WHERE degree > 0")
def _(i: Inputs) -> DataFrame:
    return rounded(ranks.ccdf(i.degrees), 8)


@query("rank_degree", "SELECT row_number() OVER (ORDER BY degree DESC) AS rank, degree AS k FROM degrees WHERE degree > 0")
def _(i: Inputs) -> DataFrame:
    return ranks.rank_degree(i.degrees)


@query("rank_average", f"SELECT id, degree, {rnd('rank() OVER (ORDER BY degree) + (count(*) OVER (PARTITION BY degree) - 1) / CAST(2 AS DOUBLE)', 1)} AS rank FROM degrees")
def _(i: Inputs) -> DataFrame:
    return rounded(ranks.average_rank(i.degrees.select("id", "degree"), "degree"), 1)


@query("rank_removal_prefix", "SELECT strategy, id, pos AS position FROM order_rows WHERE pos <= (SELECT CAST(floor(count(*) * CAST(0.1 AS DOUBLE)) AS BIGINT) FROM nodes0)")
def _(i: Inputs) -> DataFrame:
    orders = removal.removal_orders(i.nodes, structural="degree")
    return ranks.prefix(orders, int(i.network.vertices.count() * 0.1))


@query("kdist_curve", f"SELECT row_number() OVER (ORDER BY dist, id) AS position, {rnd('dist', 8)} AS dist FROM near_points WHERE rank = 5")
def _(i: Inputs) -> DataFrame:
    return rounded(ranks.sorted_curve(neighbors.kdist(i.points, POINT_COLS, 5), "dist"), 8)


@query("limit_sample", "SELECT id FROM queries")
def _(i: Inputs) -> DataFrame:
    return similarity.sample_nodes(i.sets.select("id").distinct(), 50)


@query(
    "topk_recommendations",
    f"""SELECT "Bottleneck_Airport", "Recommended_Twin", {rnd('"Potential_Gain" * "Similarity"', 4)} AS "Score"
        FROM recs ORDER BY "Potential_Gain" * "Similarity" DESC, 1, 2 LIMIT 20""",
)
def _(i: Inputs) -> DataFrame:
    return rounded(recommend.score(_recs(i), 20).select("Bottleneck_Airport", "Recommended_Twin", "Score"), 4)


# --- set operations ----------------------------------------------------------------------------


@query("set_union_distinct", "SELECT src AS id FROM raw_routes UNION SELECT dst FROM raw_routes")
def _(i: Inputs) -> DataFrame:
    return clean.endpoints(i.raw_routes)


@query("set_dedup_pairs", "SELECT DISTINCT src, dst FROM coded_routes")
def _(i: Inputs) -> DataFrame:
    return clean.dedup(i.coded_routes)


@query("set_distinct_routes", "SELECT DISTINCT origin AS src, dest AS dst FROM completed")
def _(i: Inputs) -> DataFrame:
    return clean.observed_routes(i.completed, "origin", "dest")


@query(
    "set_union_routes",
    """SELECT DISTINCT origin AS src, dest AS dst FROM completed UNION
       SELECT a.id, b.id FROM all_coded_facts f JOIN last_mapping a ON a.code = f.origin JOIN last_mapping b ON b.code = f.dest""",
)
def _(i: Inputs) -> DataFrame:
    first = clean.observed_routes(i.completed, "origin", "dest")
    coded = clean.observed_routes(i.all_coded_facts, "origin", "dest")
    second = facts.translate(facts.translate(coded, i.mapping, "src"), i.mapping, "dst")
    return clean.union_routes([first, second])


@query("set_except_routes", "SELECT src, dst FROM observed EXCEPT SELECT src, dst FROM listed")
def _(i: Inputs) -> DataFrame:
    return clean.except_routes(i.observed, i.listed.edges)


@query("set_intersect", "SELECT src, dst FROM observed INTERSECT SELECT src, dst FROM listed")
def _(i: Inputs) -> DataFrame:
    return clean.common(i.observed, i.listed.edges)


@query(
    "set_union_all",
    f"""SELECT id, {rnd('avg_delay', 4)} AS avg_delay, CAST(num_flights AS DOUBLE) AS num_flights FROM (
        SELECT id, avg_delay, CAST(num_flights AS DOUBLE) AS num_flights FROM source_a UNION ALL SELECT id, avg_delay, num_flights FROM source_b UNION ALL SELECT id, avg_delay, num_flights FROM source_c)""",
)
def _(i: Inputs) -> DataFrame:
    tables = [t.select("id", "avg_delay", F.col("num_flights").cast("double").alias("num_flights")) for t in (i.source_a, i.source_b, i.source_c)]
    return rounded(clean.stack(tables), 4)


# --- network -----------------------------------------------------------------------------------


@query("graph_clean", "SELECT src, dst FROM listed")
def _(i: Inputs) -> DataFrame:
    return clean.clean_graph(i.coded_nodes, i.coded_routes)[1]


@query(
    "graph_build",
    "SELECT e.src, e.dst, a.name AS src_name, b.name AS dst_name FROM listed e JOIN nodes0 a ON a.id = e.src JOIN nodes0 b ON b.id = e.dst",
)
def _(i: Inputs) -> DataFrame:
    built = network.Network.build(i.listed.vertices, i.coded_routes)
    names = built.vertices.select("id", "name")
    proper = clean.referential(built.edges.filter("src <> dst"), names)
    return proper.join(names.toDF("src", "src_name"), "src").join(names.toDF("dst", "dst_name"), "dst")


@query("graph_augment", "SELECT src, dst FROM edges")
def _(i: Inputs) -> DataFrame:
    return i.listed.augmented(i.observed).edges


@query("graph_successors", "SELECT src AS id, dst AS member, count(*) OVER (PARTITION BY src) AS set_size FROM edges")
def _(i: Inputs) -> DataFrame:
    return network.successors(i.network.edges)


@query("graph_degrees", "SELECT id, in_degree, out_degree, degree FROM degrees")
def _(i: Inputs) -> DataFrame:
    return network.degrees(i.network.vertices, i.network.edges)


@query("graph_components", "SELECT id, label FROM component")
def _(i: Inputs) -> DataFrame:
    return components.components(i.network.vertices, i.network.edges)


@query(
    "graph_giant",
    f"""SELECT (SELECT count(*) FROM giant_nodes) AS nodes, (SELECT count(*) FROM giant_edges) AS edges,
        {rnd('CAST((SELECT count(*) FROM giant_nodes) AS DOUBLE) / (SELECT count(*) FROM nodes0)', 6)} AS share""",
)
def _(i: Inputs) -> DataFrame:
    return rounded(components.giant_share(i.network))


@query("graph_pagerank", f"SELECT id, {rnd('pagerank', 9)} AS pagerank FROM pageranks")
def _(i: Inputs) -> DataFrame:
    return rounded(pagerank.pagerank(i.network), 9)


@query("graph_betweenness", f"SELECT id, {rnd('betweenness', 8)} AS betweenness FROM betweens")
def _(i: Inputs) -> DataFrame:
    return rounded(paths.betweenness(i.network), 8)


@query(
    "graph_closeness",
    f"""SELECT id, {rnd('coalesce(r / s * (r / ((SELECT count(*) FROM giant_nodes) - 1)), 0)', 8)} AS closeness FROM nodes0
        LEFT JOIN (SELECT v AS id, CAST(count(*) AS DOUBLE) AS r, CAST(sum(d) AS DOUBLE) AS s FROM distances GROUP BY v) USING (id)""",
)
def _(i: Inputs) -> DataFrame:
    return rounded(paths.closeness(i.network), 8)


@query(
    "graph_assortativity",
    " UNION ALL ".join(
        f"SELECT '{a}' AS source, '{b}' AS target, {rnd(f'corr(s.{a}_degree, t.{b}_degree)', 6)} AS r FROM edges e JOIN degrees s ON s.id = e.src JOIN degrees t ON t.id = e.dst"
        for a, b in (("out", "in"), ("out", "out"), ("in", "in"), ("in", "out"))
    ),
)
def _(i: Inputs) -> DataFrame:
    return rounded(mixing.assortativity(i.network))


@query("graph_neighbor_degree", f"SELECT d.id, {rnd('coalesce(avg(t.out_degree), 0)', 6)} AS knn FROM degrees d LEFT JOIN edges e ON e.src = d.id LEFT JOIN degrees t ON t.id = e.dst GROUP BY d.id")
def _(i: Inputs) -> DataFrame:
    return rounded(mixing.neighbor_degree(i.network))


@query(
    "graph_removal_curve",
    f"""SELECT g.strategy, g.step, {rnd('g.fraction', 4)} AS fraction, g.removed, {rnd('coalesce(m.size, 0) / CAST((SELECT count(*) FROM nodes0) AS DOUBLE)', 8)} AS value
        FROM (SELECT DISTINCT o.strategy, s.* FROM attack_rows o CROSS JOIN steps s) g LEFT JOIN (
          SELECT strategy, step, max(n) AS size FROM (SELECT strategy, step, label, count(*) AS n FROM spread12 GROUP BY 1, 2, 3) GROUP BY 1, 2) m
        ON m.strategy = g.strategy AND m.step = g.step""",
)
def _(i: Inputs) -> DataFrame:
    # Ranks of nodes that are placed alike differ by rounding alone.
    orders = removal.removal_orders(i.ranked_nodes.withColumn("pagerank", F.round("pagerank", 12)))
    return rounded(removal.removal_curve(i.network, orders), {"fraction": 4, "value": 8})


# --- statistics --------------------------------------------------------------------------------


def _fit_sql(method: str, points: str, gamma: str) -> str:
    return f"""SELECT '{method}' AS method, {rnd('slope', 6)} AS slope, {rnd('intercept', 6)} AS intercept, {rnd(gamma, 6)} AS gamma
      FROM (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM ({points}))"""


@query("fit_pdf", _fit_sql("pdf", "SELECT ln(degree) AS x, ln(count(*) / CAST((SELECT count(*) FROM degrees WHERE degree > 0) AS DOUBLE)) AS y FROM degrees WHERE degree > 0 GROUP BY degree", "-slope"))
def _(i: Inputs) -> DataFrame:
    return rounded(stats.power_law(i.degrees, "pdf"))


@query("fit_ccdf", _fit_sql("ccdf", "SELECT ln(degree) AS x, ln(1 - CAST(row_number() OVER (ORDER BY degree) - 1 AS DOUBLE) / count(*) OVER ()) AS y FROM degrees WHERE degree > 0", "1 - slope"))
def _(i: Inputs) -> DataFrame:
    return rounded(stats.power_law(i.degrees, "ccdf"))


@query("fit_rank", _fit_sql("rank", "SELECT ln(row_number() OVER (ORDER BY degree DESC)) AS x, ln(degree) AS y FROM degrees WHERE degree > 0", "1 - 1 / slope"))
def _(i: Inputs) -> DataFrame:
    return rounded(stats.power_law(i.degrees, "rank"))


@query("corr_pearson", f"SELECT count(*) AS n, {rnd('corr(betweenness, avg_delay)', 6)} AS r FROM central_nodes WHERE avg_delay IS NOT NULL")
def _(i: Inputs) -> DataFrame:
    return rounded(stats.correlation(i.central_nodes, "betweenness", "avg_delay"))


# The p-value in SQL: 30 pairs of steps of the continued fraction of the incomplete beta function, which converges within them here.
_P_VALUE = """
  SELECT n, r, (ln(1 - r * r) * a + ln(r * r) / 2 + lgamma(a + 0.5) - lgamma(a) - lgamma(CAST(0.5 AS DOUBLE)) - ln(a) + ln(v)) / ln(CAST(10 AS DOUBLE)) AS log10_p
  FROM (SELECT * FROM lentz WHERE m = 30)"""


@query(
    "corr_spearman",
    f"""SELECT n, {rnd('r', 6)} AS r, {rnd('log10_p', 4)} AS log10_p,
          CASE WHEN r > 0.1 THEN 'CONFIRMED' WHEN r < -0.1 THEN 'REJECTED' ELSE 'INCONCLUSIVE' END AS verdict FROM ({_P_VALUE})""",
)
def _(i: Inputs) -> DataFrame:
    nodes = i.central_nodes.withColumn("betweenness", F.round("betweenness", 10))
    return rounded(stats.correlation(nodes, "betweenness", "avg_delay", "spearman").select("n", "r", "log10_p", "verdict"), {"r": 6, "log10_p": 4})


@query("trend_line", f"SELECT regr_count(delay_std, avg_delay) AS n, {rnd('regr_slope(delay_std, avg_delay)', 6)} AS slope, {rnd('regr_intercept(delay_std, avg_delay)', 2)} AS intercept, {rnd('regr_r2(delay_std, avg_delay)', 6)} AS r2 FROM nodes")
def _(i: Inputs) -> DataFrame:
    fit = stats.trend(i.nodes, "avg_delay", "delay_std")
    return rounded(as_long(fit, "n"), {"slope": 6, "intercept": 2, "r2": 6})


@query("volume_vs_delay", f"SELECT id, {rnd('num_flights', 4)} AS num_flights, {rnd('CASE WHEN num_flights > 0 THEN log10(num_flights) END', 6)} AS log_flights, {rnd('avg_delay', 4)} AS avg_delay FROM nodes WHERE avg_delay IS NOT NULL")
def _(i: Inputs) -> DataFrame:
    return rounded(stats.volume_delay(i.nodes), {"num_flights": 4, "log_flights": 6, "avg_delay": 4})


@query("geo_coverage", f"SELECT id, latitude, longitude, avg_delay IS NOT NULL AS has_data, {rnd('avg_delay', 4)} AS avg_delay FROM nodes")
def _(i: Inputs) -> DataFrame:
    return rounded(stats.geo_coverage(i.nodes), {"avg_delay": 4})


# --- scaling, clustering, projection -----------------------------------------------------------


@query("features_matrix", f"SELECT id, {rnd('pagerank', 9)} AS pagerank, {rnd('betweenness', 8)} AS betweenness, {rnd('avg_delay', 4)} AS avg_delay, {rnd('delay_std', 4)} AS delay_std, CAST(degree AS DOUBLE) AS degree FROM central_nodes WHERE avg_delay IS NOT NULL AND delay_std IS NOT NULL")
def _(i: Inputs) -> DataFrame:
    return rounded(scaling.features(i.central_nodes), {"pagerank": 9, "betweenness": 8, "avg_delay": 4, "delay_std": 4})


@query("scale_standard", "SELECT id, " + ", ".join(f"{rnd(c, 8)} AS {c}" for c in POINT_COLS) + " FROM points")
def _(i: Inputs) -> DataFrame:
    return rounded(scaling.standardize(i.raw_points.drop("label"), POINT_COLS), 8)


@query("kmeans_fit")
def _(i: Inputs) -> DataFrame:
    return kmeans.kmeans(i.points, POINT_COLS, 2).select("id", "cluster")


@query("kmeans_lloyd", "SELECT id, cluster FROM labelled")
def _(i: Inputs) -> DataFrame:
    return i.labelled_points.select("id", "cluster")


@query("kmeans_grid")
def _(i: Inputs) -> DataFrame:
    return rounded(kmeans.kmeans_grid(i.points, POINT_COLS), 6)


@query(
    "score_silhouette",
    f"""SELECT {rnd('avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END)', 6)} AS silhouette FROM (
        SELECT id, max(size) FILTER (own) AS size, max(s / (size - 1)) FILTER (own) AS a, min(s / size) FILTER (NOT own) AS b FROM (
          SELECT p.a AS id, x.cluster = y.cluster AS own, y.cluster, sum(sqrt(p.d2)) AS s, CAST(count(*) AS DOUBLE) AS size
          FROM point_pairs p JOIN labelled x ON x.id = p.a JOIN labelled y ON y.id = p.b GROUP BY 1, 2, 3) GROUP BY id)""",
)
def _(i: Inputs) -> DataFrame:
    return rounded(scores.silhouette(i.labelled_points, POINT_COLS))


_CENTROIDS = "SELECT cluster, count(*) AS n, " + ", ".join(f"avg({c}) AS {c}" for c in POINT_COLS) + " FROM labelled GROUP BY cluster"


def _gap(a: str, b: str) -> str:
    return "(" + " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in POINT_COLS) + ")"


@query(
    "score_davies_bouldin",
    f"""SELECT * FROM (WITH c AS MATERIALIZED ({_CENTROIDS}), s AS MATERIALIZED (SELECT c.cluster, avg(sqrt({_gap('p', 'c')})) AS s FROM labelled p JOIN c ON c.cluster = p.cluster GROUP BY 1)
        SELECT {rnd('avg(w)', 6)} AS davies_bouldin FROM (SELECT a.cluster, max((x.s + y.s) / sqrt({_gap('a', 'b')})) AS w
          FROM c a JOIN c b ON a.cluster <> b.cluster JOIN s x ON x.cluster = a.cluster JOIN s y ON y.cluster = b.cluster GROUP BY 1))""",
)
def _(i: Inputs) -> DataFrame:
    return rounded(scores.davies_bouldin(i.labelled_points, POINT_COLS))


@query(
    "score_calinski_harabasz",
    f"""SELECT * FROM (WITH c AS MATERIALIZED ({_CENTROIDS}), m AS MATERIALIZED (SELECT {', '.join(f'avg({c}) AS {c}' for c in POINT_COLS)} FROM labelled)
        SELECT {rnd('(b / (k - 1)) / (w / (n - k))', 4)} AS calinski_harabasz FROM
          (SELECT sum(c.n * {_gap('c', 'm')}) AS b, count(*) AS k FROM c, m), (SELECT sum({_gap('p', 'c')}) AS w, count(*) AS n FROM labelled p JOIN c ON c.cluster = p.cluster))""",
)
def _(i: Inputs) -> DataFrame:
    return rounded(scores.calinski_harabasz(i.labelled_points, POINT_COLS), 4)


def _pca_sql(axis: str) -> str:
    return " + ".join(f"({c} - avg({c}) OVER ()) * (SELECT v FROM axis_{axis} WHERE i = {n})" for n, c in enumerate(POINT_COLS))


@query(
    "pca_project",
    f"""SELECT id, {rnd(_pca_sql('a'), 6)} AS pca_1, {rnd(_pca_sql('b'), 6)} AS pca_2,
        {rnd('(SELECT v FROM spread_a) / (SELECT sum(v) FROM cov_a0 WHERE i = j)', 6)} AS share_1,
        {rnd('(SELECT v FROM spread_b) / (SELECT sum(v) FROM cov_a0 WHERE i = j)', 6)} AS share_2 FROM points""",
)
def _(i: Inputs) -> DataFrame:
    projected, shares = projection.pca(i.points, POINT_COLS)
    with_shares = projected.select("id", "pca_1", "pca_2", *[F.lit(s).alias(f"share_{n + 1}") for n, s in enumerate(shares)])
    return rounded(with_shares)


@query("kdist", f"SELECT id, {rnd('dist', 8)} AS dist FROM near_points WHERE rank = 5")
def _(i: Inputs) -> DataFrame:
    return rounded(neighbors.kdist(i.points, POINT_COLS, 5), 8)


@query("dbscan", "SELECT id, cluster, core FROM density_clusters")
def _(i: Inputs) -> DataFrame:
    return neighbors.dbscan(i.points, POINT_COLS, RADIUS, 5)


@query("outlier_count", "SELECT count(*) AS points, count(*) FILTER (cluster = -1) AS outliers, count(*) FILTER (cluster <> -1) AS inliers FROM density_clusters")
def _(i: Inputs) -> DataFrame:
    return neighbors.outliers(neighbors.dbscan(i.points, POINT_COLS, RADIUS, 5))


@query("hierarchy_ward")
def _(i: Inputs) -> DataFrame:
    return rounded(hierarchy.ward_tree(i.points, POINT_COLS, 30), 6)


@query("cluster_profile", f"SELECT id, name, region, {rnd('avg_delay', 4)} AS avg_delay, {rnd('delay_std', 4)} AS delay_std, {rnd('num_flights', 4)} AS num_flights, cluster, degree FROM clustered")
def _(i: Inputs) -> DataFrame:
    return rounded(recommend.profile(i.clustered_nodes, ["id", "name", "region", "avg_delay", "delay_std", "num_flights", "cluster", "degree"]), 4)


# --- similarity and recommendation -------------------------------------------------------------


@query(
    "lsh_s_curve",
    f"""SELECT CAST(bin AS INTEGER) AS bin, CAST(sum(pairs) AS BIGINT) AS pairs, {rnd('sum(hits) / CAST(sum(pairs) AS DOUBLE)', 6)} AS observed, {rnd('sum(total) / sum(pairs)', 8)} AS s,
          {rnd('1 - pow(1 - pow(sum(total) / sum(pairs), 2), 64)', 6)} AS expected FROM (
        SELECT least(floor(q.jaccard * 20), 19) AS bin, count(*) AS pairs, count(c.id) AS hits, sum(q.jaccard) AS total
        FROM all_query_jaccard q LEFT JOIN all_candidates c ON c.id = q.id AND c.other = q.other GROUP BY 1
        UNION ALL SELECT 0, (SELECT count(*) * (count(*) - 1) FROM set_sizes) - (SELECT count(*) FROM all_query_jaccard),
          (SELECT count(*) FROM all_candidates c ANTI JOIN all_query_jaccard q ON c.id = q.id AND c.other = q.other), 0) GROUP BY bin HAVING sum(pairs) > 0""",
)
def _(i: Inputs) -> DataFrame:
    return rounded(similarity.similarity_curve(i.sets), {"observed": 6, "s": 8, "expected": 6})


@query("minhash_signature", "SELECT id, CAST(i AS INTEGER) AS slot, sig[i + 1] AS value FROM signatures CROSS JOIN (SELECT range AS i FROM range(128))")
def _(i: Inputs) -> DataFrame:
    return similarity.minhash(i.sets).select("id", F.posexplode("signature").alias("slot", "value"))


@query("minhash_bands", "SELECT id, band, bucket FROM band_rows")
def _(i: Inputs) -> DataFrame:
    return similarity.bands(similarity.minhash(i.sets))


@query(
    "jaccard_estimate",
    f"""SELECT id, other, {rnd('sum(CASE WHEN x = y THEN 1 ELSE 0 END) / CAST(128 AS DOUBLE)', 8)} AS estimate FROM (
        SELECT c.id, c.other, unnest(a.sig) AS x, unnest(b.sig) AS y
        FROM all_candidates c JOIN signatures a ON a.id = c.id JOIN signatures b ON b.id = c.other) GROUP BY id, other""",
)
def _(i: Inputs) -> DataFrame:
    return rounded(similarity.node_estimates(_signatures(i)), 8)


@query(
    "jaccard_exact",
    f"""SELECT a, b, members_a, members_b, common, {rnd('jaccard', 8)} AS jaccard FROM (
          SELECT p.*, j.common, j.jaccard FROM profile_pairs p JOIN all_candidate_jaccard j ON j.id = p.a AND j.other = p.b
          UNION ALL SELECT m.profile, m.id, m.held, m.held, z.n, 1.0 FROM memberships m JOIN set_sizes z ON z.id = m.id WHERE m.held > 1)""",
)
def _(i: Inputs) -> DataFrame:
    return rounded(_profile_pairs(i), 8)


@query(
    "lsh_quality",
    f"""SELECT tp, fp, fn, tn, {rnd('CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn)', 6)} AS accuracy, {rnd('CAST(tp AS DOUBLE) / (tp + fp)', 6)} AS precision,
        {rnd('CAST(tp AS DOUBLE) / (tp + fn)', 6)} AS recall, {rnd('CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn)', 6)} AS f1 FROM (
        SELECT tp, fp, fn, CAST((SELECT count(*) FROM queries) * ((SELECT count(*) FROM set_sizes) - 1) - tp - fp - fn AS BIGINT) AS tn FROM (
          SELECT count(*) FILTER (e.id IS NOT NULL AND c.id IS NOT NULL) AS tp, count(*) FILTER (e.id IS NULL) AS fp, count(*) FILTER (c.id IS NULL) AS fn
          FROM (SELECT id, other FROM query_jaccard WHERE jaccard >= 0.125) e FULL JOIN candidates c ON c.id = e.id AND c.other = e.other))""",
)
def _(i: Inputs) -> DataFrame:
    return rounded(similarity.lsh_quality(i.sets))


@query(
    "recommend_twins",
    f"""SELECT "Bottleneck_Airport", "Cluster_Match", "Recommended_Twin", {rnd('"Similarity"', 8)} AS "Similarity", {rnd('"Current_Delay"', 4)} AS "Current_Delay",
        {rnd('"Expected_Delay"', 4)} AS "Expected_Delay", {rnd('"Potential_Gain"', 4)} AS "Potential_Gain", "Capacity_Match" FROM recs""",
)
def _(i: Inputs) -> DataFrame:
    return rounded(_recs(i), {"Similarity": 8, "Current_Delay": 4, "Expected_Delay": 4, "Potential_Gain": 4})


@query(
    "recommend_score",
    f"""SELECT "Bottleneck_Airport", "Recommended_Twin", {rnd('"Potential_Gain"', 4)} AS "Potential_Gain", {rnd('"Similarity"', 8)} AS "Similarity", {rnd('"Potential_Gain" * "Similarity"', 4)} AS "Score" FROM recs""",
)
def _(i: Inputs) -> DataFrame:
    scored = recommend.with_score(_recs(i)).select("Bottleneck_Airport", "Recommended_Twin", "Potential_Gain", "Similarity", "Score")
    return rounded(scored, {"Potential_Gain": 4, "Similarity": 8, "Score": 4})
