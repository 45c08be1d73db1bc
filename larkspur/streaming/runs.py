"""Running a bounded stream to its end."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.session import shared_dir


def stream_of(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of a Parquet table's files, with the schema the table has."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        # a table of one file: its folder, and of that only the file
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def run_to_end(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Process all there is, once, with a checkpoint in the shared folder; what was written is read back.

    With `each`, every micro-batch goes to that function instead.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if each is not None:
        writer.foreachBatch(each).start().awaitTermination()
        return None
    writer.outputMode(mode).format("parquet").option("path", f"{base}/out").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
