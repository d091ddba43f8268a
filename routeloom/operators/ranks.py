"""Global ranks, running totals and exact quantiles without a one-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Workspace
from ..skew import hot_keys, lookup, settled

_LOCAL_BITS = 33
_EXPAND = 10_000


def _sorted_table(df: DataFrame, order: list) -> DataFrame:
    """Range-sorted copy of ``df`` with its sort partition ``_part`` and place ``_at`` in it."""
    marked = df.orderBy(*order).withColumn("_mark", F.monotonically_increasing_id())
    saved = Workspace(df.sparkSession, "sorted").save(marked, "rows")
    return saved.select(
        "*",
        F.shiftright("_mark", _LOCAL_BITS).alias("_part"),
        F.col("_mark").bitwiseAND((1 << _LOCAL_BITS) - 1).alias("_at"),
    ).drop("_mark")


def _part_offsets(rows: DataFrame, amount: Column) -> DataFrame:
    """Total of all earlier sort partitions; one row per partition, so it can be broadcast."""
    per_part = rows.groupBy("_part").agg(amount.alias("_amount"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(
        "_part", F.coalesce(F.sum("_amount").over(before), F.lit(0)).cast("bigint").alias("_offset")
    )


def row_numbers(df: DataFrame, order: list, name: str = "row_number") -> DataFrame:
    """1-based global row number in the given order. ``order`` should be total to be repeatable."""
    rows = _sorted_table(df, order)
    offsets = _part_offsets(rows, F.count(F.lit(1)))
    return (
        rows.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_at") + 1)
        .drop("_part", "_at", "_offset")
    )


def running_total(df: DataFrame, order: list, amount: str, name: str) -> DataFrame:
    """Sum of ``amount`` over all rows strictly before each row in the given order."""
    rows = _sorted_table(df, order)
    offsets = _part_offsets(rows, F.sum(amount))
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_local", F.coalesce(F.sum(amount).over(within), F.lit(0)))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_offset") + F.col("_local")).cast("bigint"))
        .drop("_part", "_at", "_offset", "_local")
    )


def average_rank(df: DataFrame, col: str, name: str = "rank") -> DataFrame:
    """Ascending rank of ``col``; tied rows share the mean of their places."""
    df, total = settled(df)
    values = df.groupBy(col).agg(F.count(F.lit(1)).alias("_ties"))
    placed = running_total(values, [col], "_ties", "_before").select(
        col, (F.col("_before") + (F.col("_ties") + 1) / 2).alias(name)
    )
    return lookup(df, placed, [col], "inner", hot_keys(df, [col], total=total))


def degree_histogram(vertices: DataFrame, col: str = "degree") -> DataFrame:
    """Nodes per positive degree. At most about ``2 * sqrt(edges)`` rows, since degrees add up."""
    return (
        vertices.filter(F.col(col) > 0)
        .groupBy(F.col(col).alias("k"))
        .agg(F.count(F.lit(1)).alias("nodes"))
    )


def _expand(hist: DataFrame, before: str) -> DataFrame:
    """One row per node with its 0-based position, in bounded steps however large one bar is."""
    blocks = hist.withColumn(
        "_block", F.explode(F.expr(f"sequence(0L, (nodes - 1) div {_EXPAND})"))
    ).repartition("k", "_block")
    first = F.col(before) + F.col("_block") * _EXPAND
    last = F.least(F.col(before) + F.col("nodes"), first + _EXPAND) - 1
    return blocks.withColumn("position", F.explode(F.sequence(first, last)))


def _spread_over_total(hist: DataFrame) -> Column:
    return hist.agg(F.sum("nodes")).scalar()


def ccdf(vertices: DataFrame, col: str = "degree") -> DataFrame:
    """(k, ccdf) per node: ascending position i gives 1 - i/n, ties not merged."""
    hist = degree_histogram(vertices, col)
    placed = running_total(hist, ["k"], "nodes", "_before")
    total = _spread_over_total(hist)
    return _expand(placed, "_before").select("k", (1 - F.col("position") / total).alias("ccdf"))


def rank_degree(vertices: DataFrame, col: str = "degree") -> DataFrame:
    """(rank, k) per node in descending order of degree, ranks from 1."""
    placed = running_total(degree_histogram(vertices, col), [F.desc("k")], "nodes", "_before")
    return _expand(placed, "_before").select((F.col("position") + 1).alias("rank"), "k")


def topk(df: DataFrame, metric: str, k: int = 5, id_col: str = "id") -> DataFrame:
    return df.orderBy(F.desc_nulls_last(metric), id_col).limit(k)


def ranked(df: DataFrame, by: str, id_col: str = "id") -> DataFrame:
    """``df`` with a descending global ``position`` by ``by``, ties by id."""
    return row_numbers(df, [F.desc_nulls_last(by), id_col], "position")


def prefix(order: DataFrame, size: int, position: str = "position") -> DataFrame:
    """First ``size`` rows of a ranked table."""
    return order.filter(F.col(position) <= size)


def sorted_curve(df: DataFrame, col: str, id_col: str = "id") -> DataFrame:
    """(position, value) of a column in ascending order, positions from 1."""
    return row_numbers(df.select(id_col, col), [col, id_col], "position").select("position", col)


def exact_quantiles(long: DataFrame, groups: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles, one row per group and one column per name in ``qs``.

    Equal values are counted first, so a frequent value is one row; one sort over all groups then
    places the values, and the value at place p is the largest one with fewer than p rows before
    it. No group is gathered in a task, however large it is.
    """
    counted, total = settled(
        long.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_ties"))
    )
    placed = running_total(counted, [*groups, value], "_ties", "_before")
    spans = placed.groupBy(*groups).agg(F.sum("_ties").alias("_n"), F.min("_before").alias("_start"))
    located = lookup(placed, spans, groups, "inner", hot_keys(placed, groups, total=total))
    before = F.col("_before") - F.col("_start")
    ends, exprs = [], []
    for name, q in qs.items():
        at = (F.col("_n") - 1) * q
        low = F.floor(at)
        ends += [
            F.max(F.when(before <= low, F.col(value))).alias(f"{name}_low"),
            F.max(F.when(before <= F.least(low + 1, F.col("_n") - 1), F.col(value))).alias(f"{name}_high"),
            F.max(at - low).alias(f"{name}_part"),
        ]
        part = F.col(f"{name}_part")
        exprs.append((F.col(f"{name}_low") * (1 - part) + F.col(f"{name}_high") * part).alias(name))
    return located.groupBy(*groups).agg(*ends).select(*groups, *exprs)
