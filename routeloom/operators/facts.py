"""Delay metrics per node, and merging of several sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import stack

METRICS = ["avg_delay", "delay_std", "num_flights"]


def delay_metrics(facts: DataFrame, key: str, delay: str = "delay") -> DataFrame:
    """Mean, sample standard deviation and count of the known delays per key."""
    return facts.groupBy(F.col(key).alias("id")).agg(
        F.avg(delay).alias("avg_delay"),
        F.stddev_samp(delay).alias("delay_std"),
        F.count(delay).alias("num_flights"),
    )


def weighted_delay(rows: DataFrame, key: str, avg: str = "avg", cnt: str = "cnt") -> DataFrame:
    """Metrics from rows that are averages already.

    ``avg_delay`` weights each row by its count; ``delay_std`` is the plain sample deviation of the
    row averages, another statistic than that of :func:`delay_metrics`.
    """
    return (
        rows.groupBy(F.col(key).alias("id"))
        .agg(
            F.sum(F.col(avg) * F.col(cnt)).alias("_total"),
            F.sum(cnt).alias("num_flights"),
            F.stddev_samp(avg).alias("delay_std"),
        )
        .select("id", F.try_divide("_total", "num_flights").alias("avg_delay"), "delay_std", "num_flights")
    )


def merge_sources(tables: list[DataFrame], how: str = "mean") -> DataFrame:
    """One row per node from the metric tables of all sources.

    ``mean`` averages every column over the sources that know the node, the count included.
    ``weighted`` weights delays by flights and adds the flights up.
    """
    rows = stack([t.select("id", *METRICS).withColumn("num_flights", F.col("num_flights").cast("double")) for t in tables])
    if how == "mean":
        return rows.groupBy("id").agg(*[F.avg(c).alias(c) for c in METRICS])
    if how != "weighted":
        raise ValueError(f"unknown merge: {how}")
    weighted = {
        c: F.try_divide(
            F.sum(F.col(c) * F.col("num_flights")),
            F.sum(F.when(F.col(c).isNotNull(), F.col("num_flights"))),
        )
        for c in ("avg_delay", "delay_std")
    }
    return rows.groupBy("id").agg(
        *[e.alias(c) for c, e in weighted.items()], F.sum("num_flights").alias("num_flights")
    )


def translate(df: DataFrame, mapping: DataFrame, col: str, code: str = "code", to: str = "id", order: str = "row_order") -> DataFrame:
    """``col`` moved to another code system; the last mapping row wins, unknown codes are dropped.

    A mapping row without a code or a target does not count.
    """
    last = (
        mapping.dropna(subset=[code, to])
        .groupBy(F.col(code).alias(col))
        .agg(F.max_by(to, order).alias("_to"))
    )
    return df.join(last, col).withColumn(col, F.col("_to")).drop("_to")


def enrich(vertices: DataFrame, metrics: DataFrame) -> DataFrame:
    """All vertices, with metrics where there are any."""
    return vertices.join(metrics, "id", "left")


def match_rate(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """How many rows of ``left`` have their key in ``right``."""
    flag = right.select(key).distinct().withColumn("_hit", F.lit(1))
    return left.join(flag, key, "left").agg(
        F.count(F.lit(1)).alias("total"),
        F.count("_hit").alias("matched"),
        F.try_divide(F.count("_hit"), F.count(F.lit(1))).alias("share"),
    )
