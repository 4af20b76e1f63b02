"""Relational tables and rule documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embertide.schemas import ALARM_RULE
from embertide.sources.topics import _camel

# Key prefixes of the stored documents.
RULE_PREFIX, THRESHOLD_PREFIX = "alarm:rule:", "alarm:threshold:"

_DOCUMENT = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from JSON documents ``{key, value}``; the id is the rest of the key.

    Undecodable documents are skipped.
    """
    body = T.StructType(
        [T.StructField(_camel(f.name), f.dataType) for f in ALARM_RULE.fields if f.name != "rule_id"]
    )
    rows = spark.read.schema(_DOCUMENT).json(path).where(F.col("key").startswith(RULE_PREFIX))
    parsed = rows.select("key", F.from_json("value", body).alias("_r"))
    return parsed.where(F.col("_r.deviceId").isNotNull()).select(
        F.substring("key", len(RULE_PREFIX) + 1, 2**31 - 1).alias("rule_id"),
        *[F.col(f"_r.{_camel(f.name)}").alias(f.name)
          for f in ALARM_RULE.fields if f.name != "rule_id"],
    )


def load_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """Thresholds from documents keyed ``device:sensor``."""
    rows = spark.read.schema(_DOCUMENT).json(path).where(F.col("key").startswith(THRESHOLD_PREFIX))
    rest = F.substring("key", len(THRESHOLD_PREFIX) + 1, 2**31 - 1)
    return rows.select(
        F.split_part(rest, F.lit(":"), F.lit(1)).alias("device_id"),
        F.split_part(rest, F.lit(":"), F.lit(2)).alias("sensor_type"),
        F.col("value").try_cast("double").alias("threshold"),
    ).where(F.col("threshold").isNotNull())


def read_relational(
    spark: SparkSession,
    url: str,
    table: str,
    column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 64,
    **options: str,
) -> DataFrame:
    """JDBC read; with a numeric column and its bounds it is split over ``partitions`` tasks.

    Filters and column selection are pushed into the database by Spark.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column and bounds:
        reader = (
            reader.option("partitionColumn", column)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", partitions)
        )
    return reader.load()


def write_relational(
    df: DataFrame, url: str, table: str, batch_rows: int = 1000, writers: int = 32, **options: str
) -> None:
    """JDBC append in batches, over at most ``writers`` connections."""
    (
        df.write.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("batchsize", batch_rows)
        .option("numPartitions", writers)
        .options(**options)
        .mode("append")
        .save()
    )
