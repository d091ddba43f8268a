"""Session helper and the shared working folder for tables cut out of long plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_local_fallback: dict[str, str] = {}


def build_session(app: str = "routeloom", master: str | None = None, **conf) -> SparkSession:
    """Session with the adaptive settings the operators are written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master may go without it; it then gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _local_fallback:
        _local_fallback[context.applicationId] = tempfile.mkdtemp(prefix="routeloom-")
    return _local_fallback[context.applicationId]


class Workspace:
    """Tables of one operator call, written below the shared folder.

    Writing a table and reading it back cuts the lineage, gives the optimizer true sizes, and
    outlives any executor. Loops alternate between two names, so that they never hold more than
    two copies of their state.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.load(name, df)

    def save_counted(self, df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
        """:meth:`save`, with aggregates over the written rows taken by the same job."""
        seen = Observation()
        table = self.save(df.observe(seen, *[e.alias(n) for n, e in metrics.items()]), name)
        return table, seen.get

    def remove(self) -> None:
        """Deletes the folder with all its tables. For tables that no later action reads."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def load(self, names: str | list[str], like: DataFrame) -> DataFrame:
        names = [names] if isinstance(names, str) else names
        return self.spark.read.schema(like.schema).parquet(*[self.path(n) for n in names])


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and return the stored table."""
    return Workspace(df.sparkSession, "stage").save(df, name)
