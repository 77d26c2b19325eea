"""How many rows go to Python at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows of a batch between the JVM and Python; long texts and parsed documents make even these large.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the rows of an Arrow batch, which count rows and not bytes, to what long texts and parsed documents allow."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
