"""Findings of listings as they land in a folder: the stateless text rules over a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings as op
from ..sources import ingest


def landed(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """A stream of findings of the text rules; source is the file.  Collisions span files and are left to the batch audit."""
    raw = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_at_once).load(folder)
    documents = raw.select(F.col("_metadata.file_path").alias("source"), F.lit(0).alias("source_ord"), F.col("value").alias("content"))
    entities, _ = ingest.entities(documents)
    return op.detect(op.leaves(entities))
