"""Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns as double; text that is no number becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols})


def coerce(c: ColumnOrName, default: float = 0.0) -> Column:
    """Number of a text column, ``default`` where it is missing or no number."""
    return F.coalesce(_col(c).try_cast("double"), F.lit(float(default)))


def delay_minutes(actual: ColumnOrName, scheduled: ColumnOrName, clamp: bool = True) -> Column:
    """Minutes from ``scheduled`` to ``actual``; early events count as 0 when clamped.

    A missing time gives NULL, never 0. Wall-clock times are subtracted, so the session time zone
    does not matter.
    """
    gap = _col(actual).cast("timestamp_ntz") - _col(scheduled).cast("timestamp_ntz")
    minutes = gap.cast("bigint") / 60
    return F.when(minutes < 0, F.lit(0.0)).otherwise(minutes) if clamp else minutes


def parse_time(c: ColumnOrName, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Timestamp of a text column, NULL where it does not match the pattern."""
    return F.try_to_timestamp(_col(c), F.lit(pattern)).cast("timestamp_ntz")


def versus(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Text ``a vs b`` of two whole numbers."""
    return F.format_string("%d vs %d", _col(a).cast("bigint"), _col(b).cast("bigint"))


def verdict(rho: ColumnOrName, margin: float = 0.1) -> Column:
    """Reading of a correlation coefficient."""
    rho = _col(rho)
    return (
        F.when(rho > margin, F.lit("CONFIRMED"))
        .when(rho < -margin, F.lit("REJECTED"))
        .otherwise(F.lit("INCONCLUSIVE"))
    )


def matches_all(cols: list[str], pattern: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).rlike(pattern) for c in cols])


def normal_name(c: ColumnOrName, noise: str = " AIRPORT") -> Column:
    """Upper-case name without ``noise`` and outer blanks."""
    return F.trim(F.replace(F.upper(_col(c)), F.lit(noise), F.lit("")))


def query_name(c: ColumnOrName) -> Column:
    """Upper-case name without outer blanks."""
    return F.upper(F.trim(_col(c)))


def before_bracket(c: ColumnOrName) -> Column:
    """Part of a name before its first opening bracket."""
    return F.trim(F.substring_index(_col(c), "(", 1))


def hash_order(c: ColumnOrName, seed: int) -> Column:
    """Repeatable pseudo-random sort key that any engine with SHA-1 can compute."""
    return F.sha1(F.concat(F.lit(f"{seed}:"), _col(c).cast("string")))


def squared_distance(a: list[Column], b: list[Column]) -> Column:
    """Over arrays, so that the plan stays small however many coordinates there are."""
    gaps = F.zip_with(F.array(*a), F.array(*b), lambda p, q: (p - q) * (p - q))
    return F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g)
