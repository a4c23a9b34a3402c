"""The engine over a stream of pages: new files are cleaned as they come, copies within the watermark once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import Options
from ..plans import engine

PAGES = "url string, source string, framework string, content string, fetched_at timestamp, content_hash string"


def read(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of PAGES as they arrive."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def clean(pages: DataFrame, options: Options | None = None, late: str = "7 days") -> DataFrame:
    """Results of the engine, each (url, content hash) once within the watermark; rows later than it are dropped from the check."""
    once = pages.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["url", "content_hash"])
    return engine.run(once, options)


def states_by_hour(results: DataFrame, late: str = "7 days") -> DataFrame:
    """Pages by hour of fetching and state."""
    return results.withWatermark("fetched_at", late).groupBy(F.window("fetched_at", "1 hour"), "status").agg(F.count(F.lit(1)).alias("pages"))


def start(results: DataFrame, folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append results as Parquet, exactly once; without an interval everything there is processed and the query ends."""
    writer = results.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
