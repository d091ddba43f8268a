"""How degrees mix along edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..skew import hot_keys, lookup, settled
from .network import Network, degrees


def assortativity(network: Network) -> DataFrame:
    """Pearson correlation over edges of source and target degree, for the four directions."""
    edges, total = settled(network.edges.select("src", "dst"))
    deg = degrees(network.vertices, edges)
    ends = {
        end: deg.select(F.col("id").alias(end), F.col("out_degree").alias(f"{end}_out"), F.col("in_degree").alias(f"{end}_in"))
        for end in ("src", "dst")
    }
    joined = lookup(edges, ends["src"], ["src"], "inner", hot_keys(edges, ["src"], total=total))
    joined = lookup(joined, ends["dst"], ["dst"], "inner", hot_keys(edges, ["dst"], total=total))
    one_row = joined.agg(
        *[F.corr(f"src_{a}", f"dst_{b}").alias(f"{a}_{b}") for a, b in (("out", "in"), ("out", "out"), ("in", "in"), ("in", "out"))]
    )
    return one_row.selectExpr(
        "stack(4, 'out', 'in', out_in, 'out', 'out', out_out, 'in', 'in', in_in, 'in', 'out', in_out) AS (source, target, r)"
    )


def neighbor_degree(network: Network) -> DataFrame:
    """(id, knn): mean out-degree of the out-neighbours, 0 without any."""
    edges, total = settled(network.edges.select("src", "dst"))
    out = edges.groupBy(F.col("src").alias("dst")).agg(F.count(F.lit(1)).alias("d"))
    means = (
        lookup(edges, out, ["dst"], "left", hot_keys(edges, ["dst"], total=total))
        .groupBy(F.col("src").alias("id"))
        .agg(F.avg(F.coalesce("d", F.lit(0))).alias("knn"))
    )
    return network.vertices.select("id").join(means, "id", "left").fillna(0.0, ["knn"])
