"""Streams of arriving records, beyond what batch runs need: first arrivals per key and event rates in windows."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.operators.scratch import shared_folder


def stream_of(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files appearing in a folder, or one file, as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).isFile(at):
        # A stream reads folders; the folder of one file is narrowed to it.
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def first_arrivals(stream: DataFrame, key: str, time: str, late: str = "7 days") -> DataFrame:
    """Rows whose key has not been met within the watermark; the state forgets keys older than ``late``."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def rates(stream: DataFrame, key: str, time: str, value: str, length: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Count and sum per key and window, final once the watermark has passed the window."""
    grouped = stream.withWatermark(time, late).groupBy(key, F.window(time, length).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n_events"), F.sum(value).alias("total")).select(key, F.col("w.start").alias("window_start"), "n_events", "total")


def drained(stream: DataFrame, mode: str = "append", label: str = "stream") -> DataFrame:
    """Everything a stream gives once all that is there has arrived, as a table in the shared folder.

    ``append`` rows are written as they become final; ``complete`` keeps the last
    version. The end of input does not move a watermark, so windows still open are
    only in ``complete``.
    """
    spark = stream.sparkSession
    where = f"{shared_folder(spark)}/{label}-{next(tempfile._get_candidate_names())}"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{where}/rows").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    else:
        write = lambda rows, _: rows.write.mode("overwrite").parquet(f"{where}/rows")
        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/rows")
