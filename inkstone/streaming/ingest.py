"""An extension: incremental ingest as a stream, with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_articles(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """The first article of each URL within the watermark."""
    return stream.withWatermark("published_date", late).dropDuplicatesWithinWatermark(["url"])


def counts(stream: DataFrame, time: str, by: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows per window and value of by; windows close when the watermark passes them."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), by).agg(F.count(F.lit(1)).alias("n"))
