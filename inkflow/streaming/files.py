"""Directories of arriving files as a stream (beyond what a batch needs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import extension_or_empty
from ..sources.registry import FORMATS, parsed

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """path, modificationTime, ext, doc of files of known formats as they arrive."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", per_trigger).load(folder)
    ext = extension_or_empty(F.element_at(F.split("path", "/"), -1))
    return files.withColumn("ext", ext).where(F.col("ext").isin(*FORMATS)).select("path", "modificationTime", "ext", parsed(F.col("ext"), F.col("content")).alias("doc"))


def store(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Parsed documents as parquet, each file once, also after a restart."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def status_by_window(stream: DataFrame, size: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Results by window of arrival and status; windows close when files that are late have had their time."""
    return stream.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", size), F.col("doc.status").alias("status")).agg(F.count(F.lit(1)).alias("n"))
