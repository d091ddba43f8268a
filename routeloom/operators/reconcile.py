"""Listed routes against observed routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REASONS = ["Both_Nodes_Exist", "Only_Src_Exists", "Only_Dst_Exists", "Neither_Exists"]


def matched(observed: DataFrame, listed: DataFrame) -> DataFrame:
    return observed.join(listed.select("src", "dst"), ["src", "dst"], "left_semi")


def missing(observed: DataFrame, listed: DataFrame) -> DataFrame:
    return observed.join(listed.select("src", "dst"), ["src", "dst"], "left_anti")


def missing_with_reason(missing_edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(src, dst, reason): which ends of a missing edge exist."""
    known = vertices.select("id").distinct()
    marked = missing_edges.join(
        known.select(F.col("id").alias("src"), F.lit(True).alias("_s")), "src", "left"
    ).join(known.select(F.col("id").alias("dst"), F.lit(True).alias("_d")), "dst", "left")
    has_src, has_dst = F.col("_s").isNotNull(), F.col("_d").isNotNull()
    reason = (
        F.when(has_src & has_dst, F.lit(REASONS[0]))
        .when(has_src, F.lit(REASONS[1]))
        .when(has_dst, F.lit(REASONS[2]))
        .otherwise(F.lit(REASONS[3]))
    )
    return marked.select("src", "dst", reason.alias("reason"))


def classify_missing(missing_edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Count and share of the missing edges per reason."""
    counts = missing_with_reason(missing_edges, vertices).groupBy("reason").agg(F.count(F.lit(1)).alias("edges"))
    total = counts.agg(F.sum("edges")).scalar()
    return counts.withColumn("share", F.col("edges") / total)


def augment(vertices: DataFrame, edges: DataFrame, observed: DataFrame, allow_loops: bool = True) -> DataFrame:
    """Edges plus the observed ones whose two ends exist. Observed loops are kept by default."""
    from .clean import referential

    extra = observed.select("src", "dst")
    if not allow_loops:
        extra = extra.filter(F.col("src") != F.col("dst"))
    return edges.select("src", "dst").union(referential(extra, vertices)).distinct()


def coverage(vertices: DataFrame, edges: DataFrame, observed: DataFrame, metric: str = "avg_delay") -> DataFrame:
    """Share of vertices with the metric, and of the augmented edges that were observed."""
    nodes = vertices.agg(F.count(F.lit(1)).alias("total"), F.count(metric).alias("with_data")).select(
        F.lit("nodes").alias("what"), "with_data", "total"
    )
    full = augment(vertices, edges, observed)
    seen = observed.select("src", "dst").distinct().withColumn("_seen", F.lit(1))
    routes = full.join(seen, ["src", "dst"], "left").agg(
        F.count(F.lit(1)).alias("total"), F.count("_seen").alias("with_data")
    ).select(F.lit("edges").alias("what"), "with_data", "total")
    return nodes.union(routes).withColumn("share", F.try_divide("with_data", "total"))
