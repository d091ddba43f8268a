"""Cleaning of raw node and route tables, and the set operations on routes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import matches_all

CODE = "^[A-Z]{3}$"


def keep_codes(df: DataFrame, cols: list[str], pattern: str = CODE) -> DataFrame:
    return df.filter(matches_all(cols, pattern))


def direct_only(routes: DataFrame, stops: str = "stops") -> DataFrame:
    return routes.filter(F.col(stops) == 0)


def completed(facts: DataFrame, cancelled: str = "cancelled", diverted: str = "diverted") -> DataFrame:
    return facts.filter((F.col(cancelled) == 0) & (F.col(diverted) == 0))


def with_status(df: DataFrame, col: str, value: str) -> DataFrame:
    return df.filter(F.col(col) == F.lit(value))


def drop_header_rows(df: DataFrame, col: str, header: str | None = None) -> DataFrame:
    """Rows that do not repeat the header; rows without a value go as well."""
    return df.filter(F.col(col) != F.lit(header or col))


def restrict_to(df: DataFrame, codes: DataFrame, col: str, code_col: str = "code") -> DataFrame:
    """Rows whose ``col`` is in the code table."""
    return df.join(codes.select(F.col(code_col).alias(col)).dropna(), col, "left_semi")


def to_vertices(df: DataFrame, id_col: str, **attributes: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), *[F.col(c).alias(a) for a, c in attributes.items()])


def to_edges(df: DataFrame, src: str, dst: str) -> DataFrame:
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst"))


def complete(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(subset=cols)


def defaults(df: DataFrame, values: dict) -> DataFrame:
    return df.fillna(values)


def referential(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges whose two ends both exist."""
    known = vertices.select("id")
    return edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(
        known.withColumnRenamed("id", "dst"), "dst", "left_semi"
    ).select(*edges.columns)


def dedup(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["src", "dst"])


def endpoints(edges: DataFrame) -> DataFrame:
    """Ids appearing at either end of an edge."""
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def active(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices with at least one edge."""
    return vertices.join(endpoints(edges), "id", "left_semi")


def clean_graph(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Known ends, no self-loops, one row per pair, no isolated vertices.

    Pairs are merged first, so that the two joins see each pair once.
    """
    pairs = dedup(edges.filter(F.col("src") != F.col("dst")).select("src", "dst"))
    kept = referential(pairs, vertices)
    return active(vertices, kept), kept


def cleaning_report(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows before, after and dropped per cleaning step, from one pass over each table."""
    known = vertices.select("id").distinct()
    pairs = (
        edges.groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("rows"))
        .join(known.select(F.col("id").alias("src"), F.lit(True).alias("_s")), "src", "left")
        .join(known.select(F.col("id").alias("dst"), F.lit(True).alias("_d")), "dst", "left")
    )
    known_ends = F.col("_s").isNotNull() & F.col("_d").isNotNull()
    proper = known_ends & (F.col("src") != F.col("dst"))
    edge_steps = pairs.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n0"),
        F.coalesce(F.sum(F.when(known_ends, F.col("rows"))), F.lit(0)).alias("n1"),
        F.coalesce(F.sum(F.when(proper, F.col("rows"))), F.lit(0)).alias("n2"),
        F.count_if(proper).alias("n3"),
    ).selectExpr("stack(3, 'referential', n0, n1, 'self_loops', n1, n2, 'duplicates', n2, n3) AS (step, rows_before, rows_after)")
    linked = endpoints(pairs.filter(proper)).withColumn("_linked", F.lit(True))
    node_steps = (
        vertices.join(linked, "id", "left")
        .agg(F.count(F.lit(1)).alias("m0"), F.count("_linked").alias("m1"))
        .selectExpr("'isolated' AS step", "m0 AS rows_before", "m1 AS rows_after")
    )
    return edge_steps.unionByName(node_steps).withColumn("dropped", F.col("rows_before") - F.col("rows_after"))


def observed_routes(facts: DataFrame, src: str, dst: str) -> DataFrame:
    return to_edges(facts, src, dst).distinct()


def union_routes(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables).distinct()


def except_routes(observed: DataFrame, listed: DataFrame) -> DataFrame:
    return observed.select("src", "dst").subtract(listed.select("src", "dst"))


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("src", "dst").intersect(b.select("src", "dst"))


def stack(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
