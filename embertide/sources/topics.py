"""Topic sources and sinks (Kafka, or file streams of the same records).

Records are ``key`` (device id) and ``value`` (JSON text). The Kafka connector
is not part of plain PySpark; the file form carries the same two columns as
JSON lines and is what the tests use.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from embertide.functions.scalar import JSON_OPTIONS
from embertide.schemas import DEVICE_MESSAGE, RAISED_ALARM, SENSOR_DATA

# Topic names and records per poll of the consumers.
SENSOR_TOPIC, ALARM_TOPIC = "sensor-data-topic", "alarm-events-topic"
SENSOR_POLL, ALARM_POLL, PRESSED_POLL = 500, 100, 100

RECORD = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])


@dataclass(frozen=True)
class Topic:
    """Where a topic lives: ``fmt="kafka"`` with servers, or ``fmt="json"`` with a folder.

    ``per_trigger`` bounds a micro-batch in records (Kafka) or files. ``bytes_per_trigger`` bounds the
    bytes of the files of a micro-batch instead; a single larger file is a micro-batch of its own.
    """

    name: str
    fmt: str = "kafka"
    location: str = ""
    per_trigger: int = 1_000_000
    options: dict[str, str] = field(default_factory=dict)
    bytes_per_trigger: int | None = None

    def read(self, spark: SparkSession) -> DataFrame:
        """Streaming (key, value), from the earliest record."""
        reader = spark.readStream.format(self.fmt).options(**self.options)
        if self.fmt == "kafka":
            source = (
                reader.option("kafka.bootstrap.servers", self.location)
                .option("subscribe", self.name)
                .option("startingOffsets", "earliest")
                .option("maxOffsetsPerTrigger", self.per_trigger)
                .load()
            )
            return source.select(
                F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")
            )
        limit = ("maxFilesPerTrigger", self.per_trigger) if self.bytes_per_trigger is None else (
            "maxBytesPerTrigger", self.bytes_per_trigger)
        return reader.schema(RECORD).option(*limit).load(f"{self.location}/{self.name}")

    def write(self, records: DataFrame, checkpoint: str) -> DataStreamWriter:
        """Writer of a streaming (key, value); start it to run."""
        writer = records.writeStream.option("checkpointLocation", checkpoint)
        if self.fmt == "kafka":
            return (
                writer.format("kafka")
                .option("kafka.bootstrap.servers", self.location)
                .option("kafka.acks", "all")
                .option("kafka.retries", "3")
                .option("topic", self.name)
                .options(**self.options)
            )
        return writer.format(self.fmt).option("path", f"{self.location}/{self.name}")


# --- wire form -----------------------------------------------------------------------


def _camel(name: str) -> str:
    head, *rest = ("timestamp" if name == "ts" else name).split("_")
    return head + "".join(part.capitalize() for part in rest)


def wire_schema(schema: T.StructType) -> T.StructType:
    """The JSON field names of a table; instants stay text until ``wire_time``."""
    return T.StructType([
        T.StructField(
            _camel(f.name),
            T.StringType() if isinstance(f.dataType, T.TimestampType) else f.dataType,
        )
        for f in schema.fields
    ])


def wire_time(text: Column) -> Column:
    """ISO-8601 text or epoch milliseconds to a timestamp; null when neither."""
    number = text.try_cast("long")
    return F.when(number.isNotNull(), F.timestamp_millis(number)).otherwise(
        text.try_cast("timestamp")
    )


def decode(records: DataFrame, schema: T.StructType) -> DataFrame:
    """Typed rows from (key, value); undecodable records are dropped.

    The record key fills a missing device id.
    """
    parsed = records.select(
        "key", F.from_json("value", wire_schema(schema), {"mode": "PERMISSIVE"}).alias("_d")
    ).where(F.col("_d").isNotNull())
    columns = []
    for f in schema.fields:
        column = F.col(f"_d.{_camel(f.name)}")
        if isinstance(f.dataType, T.TimestampType):
            column = wire_time(column)
        if f.name == "device_id":
            column = F.coalesce(column, F.col("key"))
        columns.append(column.alias(f.name))
    whole = parsed.select(*columns)
    needed = [c for c in ("id", "device_id", "ts") if c in schema.fieldNames()]
    return whole.dropna(subset=needed)


def encode(rows: DataFrame, key: str = "device_id") -> DataFrame:
    """(key, value) records in wire form."""
    named = [F.col(c).alias(_camel(c)) for c in rows.columns]
    return rows.select(F.col(key).alias("key"), F.to_json(F.struct(*named), JSON_OPTIONS).alias("value"))


def sensor_stream(spark: SparkSession, topic: Topic) -> DataFrame:
    return decode(topic.read(spark), SENSOR_DATA)


def alarm_stream(spark: SparkSession, topic: Topic) -> DataFrame:
    return decode(topic.read(spark), RAISED_ALARM)


# --- device messages ---------------------------------------------------------------------

_MESSAGE = T.StructType([
    T.StructField("messageId", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("deviceId", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("readings", DEVICE_MESSAGE["readings"].dataType),
    T.StructField("sensorType", T.StringType()),
    T.StructField("value", T.DoubleType()),
])


def device_messages(records: DataFrame, ingest_time: Column | None = None) -> DataFrame:
    """Messages from raw device JSON, in array or flat form.

    A flat message becomes a one-reading message. The key (the session's
    device) wins over the body. A missing time is the ingest time; a missing id
    is a hash of key and text, so that a repeated delivery gets the same id.
    """
    now = F.current_timestamp() if ingest_time is None else ingest_time
    d = records.select("key", "value", F.from_json("value", _MESSAGE).alias("d")).where("d is not null")
    flat = F.when(
        F.col("d.sensorType").isNotNull(),
        F.array(F.struct(F.col("d.sensorType").alias("type"), F.col("d.value").alias("value"))),
    )
    return d.select(
        F.coalesce("d.messageId", F.xxhash64("key", "value")).alias("message_id"),
        F.coalesce("key", "d.deviceId").alias("device_id"),
        F.coalesce(wire_time(F.col("d.timestamp")), now).alias("ts"),
        F.coalesce("d.type", F.lit("data")).alias("type"),
        F.coalesce("d.readings", flat).alias("readings"),
    )
