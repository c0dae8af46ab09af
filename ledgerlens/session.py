"""Session checks and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def require_utc(spark: SparkSession) -> None:
    """Epoch arithmetic on zone-less timestamps needs a UTC session."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone must be UTC, not {zone!r}")


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder of the cluster; a local temporary one only in local mode."""
    context = spark.sparkContext
    shared = spark.conf.get(CHECKPOINT_KEY, None) or context.getCheckpointDir()
    if shared:
        return shared
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that every executor can reach")
    shared = tempfile.mkdtemp(prefix="ledgerlens-")
    context.setCheckpointDir(shared)
    return shared


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside sends at most so many rows at once to Python; whole texts need memory on both sides."""
    before = spark.conf.get(BATCH_KEY)
    if int(before) <= 0 or int(before) > rows:
        spark.conf.set(BATCH_KEY, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the scratch folder and read it back.

    Cuts the lineage, survives lost executors, and lets later passes read only
    the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_buckets(df: DataFrame, name: str, buckets: int, *keys: str) -> DataFrame:
    """``df`` written as a table in buckets of the keys and read back; groupings by them need no shuffle."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    # A task for each bucket, so each writes one file.
    df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).option("path", path).saveAsTable(table)
    return spark.table(table)


class Scratch:
    """Intermediate tables of one job in the shared folder; leaving the block drops them.

    They live in a database of their own, so that SQL removes their files on any storage.
    Whatever is still to be read afterwards must be written elsewhere before.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.name = f"scratch_{uuid.uuid4().hex}"
        self._tables = 0

    def __enter__(self) -> Scratch:
        self.spark.sql(f"CREATE DATABASE {self.name} LOCATION '{scratch_dir(self.spark).rstrip('/')}/{self.name}'")
        return self

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as a table and read back, as ``materialize`` does."""
        self._tables += 1
        table = f"{self.name}.{name.replace('-', '_')}_{self._tables}"
        df.write.format("parquet").saveAsTable(table)
        return self.spark.table(table)

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None,
                 trace: TracebackType | None) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.name} CASCADE")
