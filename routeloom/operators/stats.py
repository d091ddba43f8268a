"""Distributions, power-law fits, correlations and the tables behind the diagnostic plots."""

from __future__ import annotations

from math import log, pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import verdict
from ..functions.student_t import log_two_sided_p, two_sided_p
from ..skew import hot_keys, lookup, settled
from .ranks import average_rank, ccdf, degree_histogram, exact_quantiles, rank_degree

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _long(df: DataFrame, keep: list[str], cols: list[str]) -> DataFrame:
    wide = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])
    return wide.unpivot(keep, cols, "metric", "value").filter(F.col("value").isNotNull())


def describe_metrics(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per column."""
    long, _ = settled(_long(df, [], cols))
    base = long.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, ["metric"], "value", QUARTILES)
    return base.join(quartiles, "metric").select("metric", "n", "mean", "std", "min", "q1", "median", "q3", "max")


def degree_pdf(vertices: DataFrame, col: str = "degree") -> DataFrame:
    """(k, nodes, p): share of the linked nodes per degree."""
    hist = degree_histogram(vertices, col)
    return hist.withColumn("p", F.col("nodes") / hist.agg(F.sum("nodes")).scalar())


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """(bin, low, high, rows) over equal widths; the last bin includes the maximum."""
    values = df.select(F.col(col).cast("double").alias("v")).dropna()
    span = values.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    low, high = span.select("low").scalar(), span.select("high").scalar()
    place = F.coalesce(F.least(F.floor(F.try_divide(F.col("v") - low, high - low) * bins), F.lit(bins - 1)), F.lit(0))
    counts = values.groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (high - low) / bins
    return grid.join(counts, "bin", "left").select(
        "bin", (low + F.col("bin") * width).alias("low"), (low + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"),
    )


def density(df: DataFrame, col: str, grid: int = 200) -> DataFrame:
    """(point, x, density): Gaussian kernel density from minimum to maximum, Scott's bandwidth.

    Equal values are counted first; the grid points are the sums of one aggregate, so the shuffle is one row per task.
    """
    values = df.select(F.col(col).cast("double").alias("v")).dropna()
    facts = values.agg(
        F.min("v").alias("low"), F.max("v").alias("high"),
        (F.stddev_samp("v") * F.pow(F.count(F.lit(1)).cast("double"), F.lit(-0.2))).alias("h"), F.count(F.lit(1)).alias("n"),
    ).first()
    low, high, h, n = facts
    if not n or not h:
        return df.sparkSession.createDataFrame([], "point int, x double, density double")
    step = (high - low) / (grid - 1)
    counted = values.groupBy("v").agg(F.count(F.lit(1)).alias("times"))
    kernel = lambda k: F.sum(F.col("times") * F.exp(-F.pow((F.lit(low + k * step) - F.col("v")) / h, F.lit(2.0)) / 2))
    wide = counted.agg(F.array(*[kernel(k) for k in range(grid)]).alias("w"))
    return wide.select(F.posexplode("w").alias("point", "w")).select(
        "point", (F.lit(low) + F.col("point") * F.lit(step)).alias("x"), (F.col("w") / (n * h * (2 * pi) ** 0.5)).alias("density")
    )


def cluster_boxes(points: DataFrame, cluster: str, cols: list[str]) -> DataFrame:
    """Box-plot figures per metric and cluster: quartiles, 1.5 IQR whiskers, rows outside them."""
    long, total = settled(_long(points, [cluster], cols))
    quartiles = exact_quantiles(long, ["metric", cluster], "value", QUARTILES)
    on = ["metric", cluster]
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach)
    return (
        lookup(long, quartiles, on, "inner", hot_keys(long, on, total=total))
        .groupBy(*on, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def power_law(vertices: DataFrame, method: str, col: str = "degree") -> DataFrame:
    """(method, slope, intercept, gamma) of a log-log least-squares line through the degrees."""
    if method == "pdf":
        points = degree_pdf(vertices, col).select(F.ln("k").alias("x"), F.ln("p").alias("y"))
        gamma = -F.col("slope")
    elif method == "ccdf":
        points = ccdf(vertices, col).select(F.ln("k").alias("x"), F.ln("ccdf").alias("y"))
        gamma = 1 - F.col("slope")
    elif method == "rank":
        points = rank_degree(vertices, col).select(F.ln("rank").alias("x"), F.ln("k").alias("y"))
        gamma = 1 - F.try_divide(F.lit(1.0), F.col("slope"))
    else:
        raise ValueError(f"unknown method: {method}")
    fit = points.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    return fit.select(F.lit(method).alias("method"), "slope", "intercept", gamma.alias("gamma"))


def correlation(df: DataFrame, a: str, b: str, method: str = "pearson") -> DataFrame:
    """One row with the coefficient over complete rows; Spearman adds the p-value, its logarithm and a reading."""
    rows = df.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    if method == "pearson":
        return rows.agg(F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("r"))
    if method != "spearman":
        raise ValueError(f"unknown method: {method}")
    placed = average_rank(average_rank(rows, "a", "ra"), "b", "rb")
    n, rho = placed.agg(F.count(F.lit(1)), F.corr("ra", "rb")).first()
    log_p = log_two_sided_p(rho, n)
    row = (n, rho, two_sided_p(rho, n), None if log_p is None else log_p / log(10))
    one = df.sparkSession.createDataFrame([row], "n bigint, r double, p double, log10_p double")
    return one.withColumn("verdict", verdict("r"))


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of ``y`` on ``x``."""
    return df.agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
    )


def volume_delay(nodes: DataFrame) -> DataFrame:
    """Traffic volume, on a log scale as well, against mean delay of the nodes with data."""
    return nodes.filter(F.col("avg_delay").isNotNull()).select(
        "id", "num_flights", F.when(F.col("num_flights") > 0, F.log10("num_flights")).alias("log_flights"), "avg_delay"
    )


def geo_coverage(nodes: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    return nodes.select("id", lat, lon, F.col("avg_delay").isNotNull().alias("has_data"), "avg_delay")


def worst_cluster(points: DataFrame, cluster: str = "cluster", metric: str = "avg_delay") -> DataFrame:
    """Members of the cluster with the largest mean; the smaller label wins a tie."""
    top = points.groupBy(cluster).agg(F.avg(metric).alias("_m")).orderBy(F.desc("_m"), cluster).limit(1).select(cluster).scalar()
    return points.filter(F.col(cluster) == top)
