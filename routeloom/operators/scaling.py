"""Feature tables and scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ["pagerank", "betweenness", "avg_delay", "delay_std", "degree"]


def features(nodes: DataFrame, cols: list[str] = FEATURES) -> DataFrame:
    """(id, features) of the rows where all of them are known."""
    return nodes.select("id", *[F.col(c).cast("double").alias(c) for c in cols]).dropna()


def standardize(points: DataFrame, cols: list[str]) -> DataFrame:
    """Columns minus their mean, over their population deviation (over 1 if that is 0)."""
    stats = points.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    return points.withColumns({
        c: (F.col(c) - stats.select(f"m_{c}").scalar())
        / F.coalesce(F.nullif(stats.select(f"s_{c}").scalar(), F.lit(0.0)), F.lit(1.0))
        for c in cols
    })
