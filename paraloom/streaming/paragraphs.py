"""The corpus build as a stream: page rows in, judged paragraphs and running counts out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paraloom.sources.pages import page_paragraphs


def page_stream(spark: SparkSession, folder: str, files_per_batch: int = 50) -> DataFrame:
    """New Parquet files of page rows (filename, page_num, text, read_at) as they arrive."""
    schema = "filename string, page_num int, text string, read_at timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def judged(pages: DataFrame) -> DataFrame:
    """Paragraphs with their verdict; stateless, so it appends."""
    with_time = pages.where(F.col("text").isNotNull())
    found = page_paragraphs(with_time)
    return found


def windowed_counts(rows: DataFrame, time: str, by: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window, by, n) over event time; rows later than ``late`` behind the newest are dropped by the watermark."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"))


def append_to(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write a stream to Parquet; ``once`` takes what is there and stops."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start(path)
