"""Pages as a stream: the page pipeline on micro-batches, and counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.urls import base_domain_col
from corpusloom.operators import pages as P


def page_stream(spark: SparkSession, path: str, schema: str = "page_id long, url string, html string", files_per_trigger: int = 8) -> DataFrame:
    """Parquet files of pages as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def process_stream(pages: DataFrame, out: str, checkpoint: str, outputs: tuple[str, ...] = ("markdown", "links", "metadata"), **options) -> StreamingQuery:
    """Process pages as they come and append the results; exactly once by the checkpoint."""
    done = P.process(pages, outputs, **options)
    return done.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def domain_counts(pages: DataFrame, time_col: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Pages by domain and time window; rows later than `late` are left out and state is bounded."""
    return pages.withWatermark(time_col, late).groupBy(F.window(time_col, window), base_domain_col(F.col("url")).alias("base_domain")).agg(F.count("*").alias("pages"))
