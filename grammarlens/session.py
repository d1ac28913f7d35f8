"""Where intermediate tables go."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_written: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as named in spark.checkpoint.dir.

    Where the setting is missing, a local master gets a folder of its own; on a
    cluster that would be a folder the executors can't see, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local:
        folder = tempfile.mkdtemp(prefix="grammarlens-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local[context.applicationId] = f"file://{folder}"
    return _local[context.applicationId]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder once and reads it back, which cuts its lineage.

    Unlike a checkpoint this computes df a single time, and a lost executor costs
    only a new read. The size of what was written is known to Spark, which therefore
    broadcasts it in joins only if it is small.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def discarded(spark: SparkSession) -> Iterator[None]:
    """Deletes what was staged within, when results made of it have been written."""
    begun = len(_written)
    try:
        yield
    finally:
        for path in _written[begun:]:
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
        del _written[begun:]
