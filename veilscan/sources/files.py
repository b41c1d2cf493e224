"""Text files as sources, read strictly as UTF-8, and 32-byte keys."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """sources of whole files through Spark's reader; a file that is not UTF-8 fails the job. Newlines and marks stay as they are."""
    rows = spark.read.format("binaryFile").load(path)
    text = F.col("content").cast("string")
    strict = F.when(F.is_valid_utf8(text), text).otherwise(F.raise_error(F.lit("invalid_utf8")).cast("string"))
    return rows.select(F.col("path").alias("source_key"), F.lit(None).cast("long").alias("ordinal"), strict.alias("text"))


def read_key(path: str) -> bytes:
    """A key file: a regular file of exactly 32 bytes."""
    if not os.path.isfile(path):
        raise ValueError("key is not a regular file")
    with open(path, "rb") as f:
        key = f.read(33)
    if len(key) != 32:
        raise ValueError("key must have 32 bytes")
    return key
