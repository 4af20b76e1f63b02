"""Session settings and the two helpers that need the session."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024


def build_session(
    app: str = "embertide", master: str | None = None, shuffle_partitions: int | None = None
) -> SparkSession:
    """A session with the settings the library relies on (see ``configure``).

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the submit
    configuration decides, and AQE coalesces from there.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return configure(builder.getOrCreate())


# UTC and the state store decide results. The adaptive settings split a large
# join key even where a later aggregation would reuse the join's partitioning.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to an existing session; all can change at run time."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``.

    In local mode a temporary folder stands in where it is unset; on a cluster that is an
    error, as every executor would write to a disk of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="embertide-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def text_size(df: DataFrame):
    """Aggregate column: bytes of the text form of all rows."""
    text = F.struct(*[F.col(f"`{c}`") for c in df.columns]).cast("string")
    return F.coalesce(F.sum(F.octet_length(text)), F.lit(0))


def checked_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, rows: int | None = None, size: int = 0,
) -> DataFrame:
    """Hint a broadcast only when rows and bytes of ``df`` are proven small.

    ``rows`` is the count, when already known, and ``size`` the bytes of the text form (0 for a frame of
    fixed-width columns); else both are measured, see ``text_size``. Above a bound the frame is returned
    unhinted, so the join is planned as a shuffle join and AQE splits a skewed key.
    """
    if rows is None:
        rows, size = df.agg(F.count(F.lit(1)), text_size(df)).first()
    return F.broadcast(df) if rows <= max_rows and size <= BROADCAST_BYTES else df


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's reliable checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
