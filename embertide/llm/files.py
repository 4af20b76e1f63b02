"""Binary files written and read through Spark's own file sources.

Tasks only hand rows to Spark, so any file system that Spark reaches works, and a
repeated or lost task is handled by Spark's commit protocol.
"""

from __future__ import annotations

import gzip

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_BYTES = 8_000_000  # a writer closes a file at about this size, so a reader can hold one whole


def write_files(df: DataFrame, path: str, compression: str = "none") -> None:
    """Write each row's ``content`` (binary ending in a newline) as one file.

    ``name`` (distinct per row) becomes the folder of the file below ``path``.
    Spark's text writer puts out a string's bytes as they are, then a newline: it
    stands for the last byte of ``content``. ``compression`` gzip makes gzip files.
    """
    body = F.expr("substring(content, 1, octet_length(content) - 1)")
    df.select(F.col("name"), body.cast("string").alias("value")).write.partitionBy("name").option(
        "compression", compression).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``name`` and ``content`` of the files below ``path``; one row, and one task at most, per file.

    Gzip files come as they are; see ``plain``.

    A folder without any file gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").option(
        "recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "name=([^/]*)/", 1).alias("name"), "content")


def plain(content: bytes) -> bytes:
    """The content of a file that may be a gzip file."""
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
