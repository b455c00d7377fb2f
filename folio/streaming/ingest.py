"""New volume files as a stream: an addition. The scans are stateless, so they run on streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.sources import volumes


def volume_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """htid, value of text files with one volume a line as they arrive below ``folder``."""
    df = spark.readStream.schema("value string").option("maxFilesPerTrigger", max_files).text(folder)
    return df.select(F.coalesce(F.get_json_object("value", "$.htid"), F.get_json_object("value", "$.id")).alias("htid"), "value")


def pos_totals(stream: DataFrame, section: str = "body") -> DataFrame:
    """Running tokens by part of speech (complete or update mode)."""
    return volumes.tokens(stream).where(F.col("section") == section).groupBy("pos").agg(F.sum("count").alias("count"))
