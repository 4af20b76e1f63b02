"""Scalar functions: ids, severities, keys, text templates, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Severities and ranks, id layout, alarm texts, agent keywords.
SEVERITY_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}
ID_EPOCH_MS = 1672531200000  # 2023-01-01T00:00:00Z
MACHINE_BITS, TYPE_BITS, SEQUENCE_BITS = 10, 5, 8
ALARM_TEXT = {
    "SMOKE_DETECTED": "Smoke detected by",
    "SMOKE_CLEARED": "Smoke cleared at",
    "HIGH_TEMPERATURE": "High temperature detected by",
    "TEMPERATURE_NORMAL": "Temperature returned to normal at",
    "FIRE_DETECTED": "Fire detected by",
    "FIRE_CLEARED": "Fire cleared at",
    "MOTION_DETECTED": "Motion detected by",
    "MOTION_CLEARED": "Motion cleared at",
}
ROOM_AGENTS = (("server", "gas"), ("data", "gas"), ("kitchen", "foam"), ("lab", "foam"))
DEFAULT_AGENT = "water"


def lookup(column: Column, table: dict, default: Column) -> Column:
    """CASE over a small constant table."""
    (first, value), *rest = table.items()
    case = F.when(column == first, F.lit(value))
    for key, value in rest:
        case = case.when(column == key, F.lit(value))
    return case.otherwise(default)


def severity_rank(severity: Column) -> Column:
    return lookup(severity, SEVERITY_RANK, F.lit(0))


def known_severity(severity: Column) -> Column:
    """Upper-cased severity; unknown and null become HIGH."""
    upper = F.upper(severity)
    return F.when(upper.isin(*SEVERITY_RANK), upper).otherwise("HIGH")


def same_text(left: Column, right: Column | str) -> Column:
    """Case-insensitive equality."""
    right = F.lit(right) if isinstance(right, str) else right
    return F.lower(left) == F.lower(right)


def suppression_agent(room: Column) -> Column:
    """Extinguishing agent by room name; the first keyword found decides."""
    text = F.lower(room)
    (word, agent), *rest = ROOM_AGENTS
    case = F.when(text.contains(word), agent)
    for word, agent in rest:
        case = case.when(text.contains(word), agent)
    return case.otherwise(DEFAULT_AGENT)


def alarm_text(alarm_type: Column, device_name: Column, zone: Column) -> Column:
    verb = lookup(
        alarm_type, ALARM_TEXT, F.concat(F.lit("Alarm "), alarm_type, F.lit(" triggered by"))
    )
    return F.concat(verb, F.lit(" "), device_name, F.lit(" in "), zone)


def location_text(floor: Column, zone: Column) -> Column:
    return F.concat(floor, F.lit(" - "), zone)


def composite_key(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def key_head(key: Column) -> Column:
    return F.split_part(key, F.lit(":"), F.lit(1))


def percent_text(number: Column) -> Column:
    return F.format_string("%.2f%%", number)


def ratio(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """``part / whole * scale``, 0 when the denominator is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(
        part.cast("double") / F.nullif(whole, F.lit(0)).cast("double") * scale
    )


def millis(ts: Column) -> Column:
    """Epoch milliseconds, rounded down."""
    return F.unix_millis(ts.cast("timestamp"))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


# --- time-ordered 64-bit ids -------------------------------------------------

_SHIFT_MS = MACHINE_BITS + TYPE_BITS + SEQUENCE_BITS
_SHIFT_MACHINE = TYPE_BITS + SEQUENCE_BITS


def _low_bits(value: Column, bits: int) -> Column:
    return value.bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")


def encode_id(ms: Column, machine: Column, kind: Column, sequence: Column) -> Column:
    """Pack time, machine, device type and sequence; out-of-range parts raise."""
    packed = (
        F.shiftleft(ms.cast("long") - ID_EPOCH_MS, _SHIFT_MS)
        .bitwiseOR(F.shiftleft(machine.cast("long"), _SHIFT_MACHINE))
        .bitwiseOR(F.shiftleft(kind.cast("long"), SEQUENCE_BITS))
        .bitwiseOR(sequence.cast("long"))
    )
    return (
        F.when(~kind.between(0, (1 << TYPE_BITS) - 1),
               F.raise_error(F.lit("device type id must be between 0 and 31")).cast("long"))
        .when(~machine.between(0, (1 << MACHINE_BITS) - 1),
              F.raise_error(F.lit("machine id must be between 0 and 1023")).cast("long"))
        .when(~sequence.between(0, (1 << SEQUENCE_BITS) - 1),
              F.raise_error(F.lit("more than 256 ids in one millisecond")).cast("long"))
        .otherwise(packed)
    )


def id_millis(packed: Column) -> Column:
    return F.shiftright(packed, _SHIFT_MS) + F.lit(ID_EPOCH_MS)


def id_machine(packed: Column) -> Column:
    return _low_bits(F.shiftright(packed, _SHIFT_MACHINE), MACHINE_BITS)


def id_kind(packed: Column) -> Column:
    return _low_bits(F.shiftright(packed, SEQUENCE_BITS), TYPE_BITS)


def id_sequence(packed: Column) -> Column:
    return _low_bits(packed, SEQUENCE_BITS)


# --- JSON --------------------------------------------------------------------

# The default format would cut instants to milliseconds.
JSON_OPTIONS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def to_document(df: DataFrame, name: str = "value") -> DataFrame:
    """One JSON text column from all columns."""
    return df.select(F.to_json(F.struct("*"), JSON_OPTIONS).alias(name))


def from_document(df: DataFrame, column: str, schema: T.StructType, bad_rows: str = "skip"):
    """Decode a JSON column into columns.

    ``bad_rows="skip"`` drops undecodable rows, ``"only"`` returns just them.
    """
    marker = "_corrupt_record"
    wide = T.StructType([*schema.fields, T.StructField(marker, T.StringType())])
    parsed = df.withColumn(
        "_doc", F.from_json(column, wide, {"columnNameOfCorruptRecord": marker})
    )
    bad = F.col("_doc").isNull() | F.col(f"_doc.{marker}").isNotNull()
    if bad_rows == "only":
        return parsed.where(bad).drop("_doc")
    return parsed.where(~bad).select(*[F.col(f"_doc.{f.name}") for f in schema.fields])


def json_or_null(text: Column) -> Column:
    """The text itself when it is valid JSON, else null."""
    return F.when(F.try_parse_json(text).isNotNull(), text)
