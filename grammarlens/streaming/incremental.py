"""Hits that are counted as samples arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from grammarlens.operators import hits
from grammarlens.session import scratch_dir


def counted(spark: SparkSession, path: str, sample: str, files_per_batch: int = 8) -> DataFrame:
    """The hits of all samples in a folder of Parquet files, read as a stream until it is drained.

    A sample that is delivered again, which has the same visits, is dropped by the state of
    the stream, which holds the keys seen so far. Each batch writes its own counts under its
    number, so that a batch that is repeated after a failure replaces what it wrote before;
    the sum of all batches is then exact.
    """
    where = f"{scratch_dir(spark)}/hits-{uuid.uuid4().hex}"
    # A single file is read by its name, a folder with all that arrives in it.
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    arriving = (stream.option("pathGlobFilter", path.rsplit("/", 1)[1]).parquet(path.rsplit("/", 1)[0]) if _is_file(spark, path) else stream.parquet(path)).dropDuplicates([sample])

    def add(batch: DataFrame, number: int) -> None:
        hits.hits(batch).write.mode("overwrite").parquet(f"{where}/counts/batch={number}")

    arriving.writeStream.foreachBatch(add).option("checkpointLocation", f"{where}/progress").trigger(availableNow=True).start().awaitTermination()
    return hits.merged(spark.read.schema("grammar string, node_id string, hits bigint").parquet(f"{where}/counts"))


def _is_file(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(there).isFile()
