"""A stream of text files into canonical documents, each content once. An extension: nothing it mirrors streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import documents

FILE_SCHEMA = "doc_id long, extension string, text string, arrived timestamp"


def read_files(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Parquet files of FILE_SCHEMA as they come."""
    return spark.readStream.schema(FILE_SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def content_ids(stream: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """doc_id, arrived, status and content_id of a stream's documents; parsing holds no state."""
    found = documents.canonical(stream, texts, keep=("arrived timestamp",))
    return found.select("doc_id", "arrived", "status", "error_kind", "content_id")


def new_content(stream: DataFrame, late: str = "1 hour", texts: dict[str, str] | None = None) -> DataFrame:
    """The first document of each content id; a later copy within the watermark is dropped, and state expires."""
    good = content_ids(stream, texts).where("status = 'ok'")
    return good.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["content_id"])


def anchored(batch: DataFrame) -> DataFrame:
    """For a batch of (work, pos, coord, text): each part with the last coordinate at or before it."""
    w = Window.partitionBy("work").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return batch.withColumn("coord", F.last("coord", ignorenulls=True).over(w))
