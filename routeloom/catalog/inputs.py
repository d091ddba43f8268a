"""The library's concepts mapped onto the given tables.

Nodes are parts and suppliers. A returned line (flag R) travels from part to supplier, any other
line from supplier to part. Lines of status F are the listed routes, lines of status O the observed
ones. The facts are lines joined with their orders: scheduled on the order date, actual on the ship
date. Some column values stand for the defects the cleaning has to meet.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import clean, facts, kmeans, network, pagerank, paths, scaling
from ..session import stage

CODE = "^[PS][0-9]+$"
# All components of a vector.
POINT_COLS = [f"x{i + 1}" for i in range(64)]
# About the distance of the nearest neighbours of standardised vectors.
RADIUS = 9.25
NODE_COLS = ["degree", "avg_delay", "delay_std"]
NODE_CENTERS = [[-1.0, -1.0, -1.0], [1.0, 1.0, 1.0]]
NODE_ITERS = 3
POINT_CENTERS = [[c] * len(POINT_COLS) for c in (0.0, 0.25, -0.25)]
POINT_ITERS = 4

ORIGIN = "CASE WHEN l_returnflag = 'R' THEN 'P' || l_partkey ELSE 'S' || l_suppkey END"
DEST = "CASE WHEN l_returnflag = 'R' THEN 'S' || l_suppkey ELSE 'P' || l_partkey END"

_stored: dict[tuple, DataFrame] = {}


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _once(self, name: str, make) -> DataFrame:
        """Phase result, stored once per session and reused by every later query."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _stored:
            _stored[key] = stage(make(), name)
        return _stored[key]

    # --- raw tables -------------------------------------------------------------------------

    @cached_property
    def raw_nodes(self) -> DataFrame:
        parts = self.table("part").selectExpr(
            "CASE WHEN p_size = 50 THEN NULL WHEN p_size = 49 THEN 'p' || p_partkey ELSE 'P' || p_partkey END AS code",
            "p_name AS name", "p_brand AS region", "p_partkey AS num", "p_retailprice AS latitude", "cast(p_size AS double) AS longitude",
        )
        suppliers = self.table("supplier").selectExpr(
            "'S' || s_suppkey AS code", "s_name AS name", "'Nation#' || s_nationkey AS region", "s_suppkey AS num",
            "s_acctbal AS latitude", "cast(s_nationkey AS double) AS longitude",
        )
        return parts.unionByName(suppliers)

    @cached_property
    def raw_routes(self) -> DataFrame:
        return self.table("lineitem").filter("l_linestatus = 'F'").selectExpr(
            f"CASE WHEN l_quantity = 50 THEN lower({ORIGIN}) ELSE {ORIGIN} END AS src",
            f"CASE WHEN l_discount = 0.1D THEN {ORIGIN} ELSE {DEST} END AS dst",
            "CASE WHEN l_tax >= 0.07D THEN 1 ELSE 0 END AS stops",
        )

    @cached_property
    def facts(self) -> DataFrame:
        lines = self.table("lineitem").selectExpr(
            "l_orderkey", f"{ORIGIN} AS origin", f"{DEST} AS dest",
            "CASE WHEN l_returnflag = 'R' THEN l_partkey ELSE l_suppkey END AS num",
            "cast(l_quantity = 49 AS int) AS diverted", "CASE WHEN l_tax < 0.08D THEN l_shipdate END AS actual",
            "l_returnflag AS flag", "l_linestatus AS line_status", "l_shipdate AS shipped",
        )
        orders = self.table("orders").selectExpr(
            "o_orderkey AS l_orderkey", "o_orderstatus AS status", "cast(o_orderstatus = 'P' AS int) AS cancelled", "o_orderdate AS scheduled",
        )
        return lines.join(orders, "l_orderkey").drop("l_orderkey").withColumn("delay", C.delay_minutes("actual", "scheduled"))

    # --- network ----------------------------------------------------------------------------

    @cached_property
    def coded_nodes(self) -> DataFrame:
        return clean.to_vertices(clean.keep_codes(self.raw_nodes, ["code"], CODE), "code", name="name", region="region", num="num", latitude="latitude", longitude="longitude")

    @cached_property
    def coded_routes(self) -> DataFrame:
        return clean.to_edges(clean.direct_only(clean.keep_codes(self.raw_routes, ["src", "dst"], CODE)), "src", "dst")

    @cached_property
    def listed(self) -> network.Network:
        # The nodes come from the stored edges, which clean_graph would find a second time.
        edges = self._once("listed-edges", lambda: clean.clean_graph(self.coded_nodes, self.coded_routes)[1])
        return network.Network(self._once("listed-nodes", lambda: clean.active(self.coded_nodes, edges)), edges)

    @cached_property
    def observed(self) -> DataFrame:
        lines = self.table("lineitem").filter("l_linestatus = 'O'").selectExpr(
            f"{ORIGIN} AS src", f"CASE WHEN l_discount = 0.1D THEN {ORIGIN} ELSE {DEST} END AS dst"
        )
        return self._once("observed", lambda: lines.distinct())

    @cached_property
    def network(self) -> network.Network:
        listed = self.listed
        return network.Network(listed.vertices, self._once("edges", lambda: listed.augmented(self.observed).edges))

    @cached_property
    def degrees(self) -> DataFrame:
        return self._once("degrees", lambda: network.degrees(self.network.vertices, self.network.edges))

    # --- operational metrics ----------------------------------------------------------------

    @cached_property
    def completed(self) -> DataFrame:
        return clean.completed(self.facts)

    @cached_property
    def mapping(self) -> DataFrame:
        """Other code system of the nodes: every 17th has an older wrong row, every 19th no target."""
        right = self.coded_nodes.selectExpr("'X' || id AS code", "CASE WHEN num % 19 = 0 THEN NULL ELSE id END AS id", "2 AS row_order")
        wrong = self.coded_nodes.filter("num % 17 = 0").selectExpr("'X' || id AS code", "'Z' || id AS id", "1 AS row_order")
        return right.unionByName(wrong)

    @cached_property
    def source_a(self) -> DataFrame:
        return facts.delay_metrics(self.completed.filter("num % 3 = 0"), "origin")

    def _coded(self, rows: DataFrame) -> DataFrame:
        return rows.selectExpr("'X' || origin AS origin", "'X' || dest AS dest", "status", "scheduled", "actual", "delay")

    @cached_property
    def all_coded_facts(self) -> DataFrame:
        return self._coded(self.facts)

    @cached_property
    def coded_facts(self) -> DataFrame:
        """Second source: origin in the other code system, status text instead of flags."""
        return self._coded(self.facts.filter("num % 3 = 1 OR num % 10 = 0"))

    @cached_property
    def source_b(self) -> DataFrame:
        done = clean.complete(clean.with_status(self.coded_facts, "status", "F"), ["actual", "scheduled"])
        return facts.translate(facts.delay_metrics(done, "origin"), self.mapping, "id")

    @cached_property
    def average_rows(self) -> DataFrame:
        """Third source: rows of averages as text, some of them no numbers, with a direction."""
        return self._averages(self.facts.filter("num % 3 = 2"))

    @cached_property
    def all_average_rows(self) -> DataFrame:
        return self._averages(self.facts)

    def _averages(self, rows: DataFrame) -> DataFrame:
        return (
            rows.groupBy("origin", F.col("line_status").alias("direction"), F.year("shipped").alias("yr"))
            .agg(F.sum("delay").alias("s"), F.count("delay").alias("c"))
            .selectExpr(
                "origin", "direction", "yr",
                "CASE WHEN c = 0 OR yr % 5 = 0 THEN 'n/a' ELSE cast(cast(floor(s / c) AS bigint) AS string) END AS avg_text",
                "cast(c AS string) AS cnt_text",
            )
        )

    @cached_property
    def source_c(self) -> DataFrame:
        rows = clean.with_status(self.average_rows, "direction", "F").select("origin", C.coerce("avg_text").alias("avg"), C.coerce("cnt_text").alias("cnt"))
        return facts.weighted_delay(rows, "origin")

    @cached_property
    def metrics(self) -> DataFrame:
        return facts.merge_sources([self.source_a, self.source_b, self.source_c])

    @cached_property
    def nodes(self) -> DataFrame:
        """Master table: nodes of the network with their metrics and degrees."""
        return self._once(
            "nodes", lambda: facts.enrich(self.network.vertices, self.metrics).join(self.degrees, "id")
        )

    @cached_property
    def ranked_nodes(self) -> DataFrame:
        return self._once("ranked-nodes", lambda: self.nodes.join(pagerank.pagerank(self.network), "id"))

    @cached_property
    def central_nodes(self) -> DataFrame:
        return self._once("central-nodes", lambda: self.ranked_nodes.join(paths.betweenness(self.network), "id"))

    # --- points and sets --------------------------------------------------------------------

    @cached_property
    def raw_points(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("id"), "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(POINT_COLS)]
        )

    @cached_property
    def points(self) -> DataFrame:
        return self._once("points", lambda: scaling.standardize(self.raw_points, POINT_COLS))

    @cached_property
    def labelled_points(self) -> DataFrame:
        return self._once("labelled-points", lambda: kmeans.kmeans_lloyd(self.points, POINT_COLS, POINT_CENTERS, POINT_ITERS))

    @cached_property
    def clustered_nodes(self) -> DataFrame:
        """Nodes with complete metrics and a cluster by degree and delay."""

        def make() -> DataFrame:
            known = self.nodes.dropna(subset=NODE_COLS)
            scaled = scaling.standardize(known.select("id", *[F.col(c).cast("double").alias(c) for c in NODE_COLS]), NODE_COLS)
            labels = kmeans.kmeans_lloyd(scaled, NODE_COLS, NODE_CENTERS, NODE_ITERS).select("id", "cluster")
            return known.join(labels, "id")

        return self._once("clustered-nodes", make)

    @cached_property
    def sets(self) -> DataFrame:
        known = self.nodes.dropna(subset=NODE_COLS).select("id")
        return self._once("sets", lambda: network.successors(self.network.edges).join(known, "id", "left_semi"))
