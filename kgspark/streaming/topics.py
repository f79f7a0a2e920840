"""Sentences of a stream of topic files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions.text import sentences


def sentence_stream(spark: SparkSession, path: str) -> DataFrame:
    """topic, ord, sentence for each new JSON-lines file below path; stateless, so late files need no watermark."""
    rows = spark.readStream.schema("topic string, content string").json(path)
    return rows.select("topic", F.posexplode(sentences("content")).alias("ord", "sentence"))
