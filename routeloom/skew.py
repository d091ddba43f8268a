"""Joins that stay balanced when a few keys hold a large share of the rows."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import Workspace, stage

# A key below this many rows is never a problem for one task.
HOT_ROWS = 1_000_000
# A key can only unbalance a join if it holds more than this share; at most 1/share keys can.
HOT_SHARE = 0.001


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int | None = None, total: int | None = None) -> DataFrame | None:
    """Keys holding more than ``max(hot_rows, HOT_SHARE * rows)`` rows, with their ``_slots``.

    By counting, at most ``1 / HOT_SHARE`` keys qualify, which bounds the returned table and makes
    it safe to broadcast. ``None`` when the table is too small to hold such a key. ``total`` saves
    counting a table of known size.
    """
    hot_rows = hot_rows or HOT_ROWS
    total = df.count() if total is None else total
    if total <= hot_rows:
        return None
    limit = max(hot_rows, ceil(total * HOT_SHARE))
    found = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > limit)
        .select(*keys, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_slots"))
    )
    return stage(found, "hot-keys")


def settled(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` as a stored table with its row count, for a plan that is about to be read repeatedly."""
    table, seen = Workspace(df.sparkSession, "settled").save_counted(df, "rows", n=F.count(F.lit(1)))
    return table, seen["n"]


def lookup(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "left", hot: DataFrame | None = None
) -> DataFrame:
    """Join ``left`` with ``right``, which has one row per key.

    ``hot`` is the result of :func:`hot_keys` for ``left``, which should be a stored table. Rows of hot keys meet their few matches
    by broadcast and are not shuffled; all others take the ordinary join.
    """
    if hot is None:
        return left.join(right, on, how)
    keys = F.broadcast(hot.select(*on))
    hot_rows = left.join(keys, on, "left_semi").join(
        F.broadcast(right.join(keys, on, "left_semi")), on, how
    )
    cold_rows = left.join(keys, on, "left_anti").join(right, on, how)
    return cold_rows.unionByName(hot_rows)


def salted_join(
    left: DataFrame, right: DataFrame, on: list[str], spread: str, hot: DataFrame | None, left_spread: str | None = None, left_hot: DataFrame | None = None
) -> DataFrame:
    """Inner join in which some keys are hot, on either side or on both.

    A key that is hot on the right is cut into slots by the hash of ``spread``, one that is hot on the left (``left_hot``) into slots by the
    hash of ``left_spread``; its rows meet in the grid of both, each row being repeated along the other side's slots.
    """
    if hot is None and left_hot is None:
        return left.join(right, on)

    def cut(rows: DataFrame, marks: DataFrame | None, by: str | None, slot: str) -> DataFrame:
        if marks is None:
            return rows.withColumn(slot, F.lit(0))
        marked = rows.join(F.broadcast(marks), on, "left")
        return marked.withColumn(slot, F.expr(f"pmod(xxhash64({by}), coalesce(_slots, 1))").cast("int")).drop("_slots")

    def repeated(rows: DataFrame, marks: DataFrame | None, slot: str) -> DataFrame:
        if marks is None:
            return rows.withColumn(slot, F.lit(0))
        marked = rows.join(F.broadcast(marks), on, "left")
        return marked.withColumn(slot, F.explode(F.sequence(F.lit(0), F.coalesce("_slots", F.lit(1)) - 1))).drop("_slots")

    there = repeated(cut(right, hot, spread, "_slot"), left_hot, "_left_slot")
    here = repeated(cut(left, left_hot, left_spread, "_left_slot"), hot, "_slot")
    return here.join(there, [*on, "_slot", "_left_slot"]).drop("_slot", "_left_slot")
