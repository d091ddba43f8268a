"""What several operators share: tables that cut lineage, partition counts, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Workspace


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


class Kept:
    """Tables of one operator call in the shared folder: they survive lost executors, have known sizes and end the lineage."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._tables: dict[str, Workspace] = {}

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        work = Workspace(self.spark, f"llm-{name}")
        self._tables[name] = work
        return work.save(df, name)

    def release(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in names:
            self._tables.pop(name).remove()


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table in the shared folder."""
    return Workspace(df.sparkSession, f"llm-{name}").save(df, name)


def kept_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """:func:`kept` with the number of rows."""
    table, seen = Workspace(df.sparkSession, f"llm-{name}").save_counted(df, name, n=F.count(F.lit(1)))
    return table, seen["n"]
