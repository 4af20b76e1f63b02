"""Explicit schemas; nothing in the library infers one."""

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_L, _S, _D = T.LongType(), T.StringType(), T.DoubleType()
_B, _I, _TS = T.BooleanType(), T.IntegerType(), T.TimestampType()

READING = _struct(type=_S, value=_D)

SENSOR_DATA = _struct(
    id=_L, device_id=_S, sensor_type=_S, value=_D, unit=_S, ts=_TS,
    location_x=_D, location_y=_D, location_z=_D, metadata=_S,
)

DEVICE_MESSAGE = _struct(
    message_id=_L, device_id=_S, ts=_TS, type=_S, readings=T.ArrayType(READING),
)

ALARM_RULE = _struct(
    rule_id=_S, name=_S, device_id=_S, sensor_type=_S, operator=_S, threshold=_D,
    time_window_seconds=_I, severity=_S, alarm_type=_S, building_id=_S, floor_id=_S,
    room_id=_S, zone_id=_S, enabled=_B, metadata=_S,
)

THRESHOLD = _struct(device_id=_S, sensor_type=_S, threshold=_D, changed_at=_TS)

_ALARM_TAIL = dict(
    value=_D, unit=_S, ts=_TS, location_x=_D, location_y=_D, location_z=_D,
    building_id=_S, floor_id=_S, room_id=_S, zone_id=_S,
    acknowledged=_B, acknowledged_at=_TS, acknowledged_by=_S,
    resolved=_B, resolved_at=_TS, resolved_by=_S, notes=_S, metadata=_S,
)

RAISED_ALARM = _struct(id=_L, device_id=_S, alarm_type=_S, severity=_S, **_ALARM_TAIL)

ALARM = _struct(
    id=_S, device_id=_S, type=_S, severity=_S, message=_S, location=_S, **_ALARM_TAIL
)

ALARM_ACTION = _struct(alarm_id=_L, action=_S, actor=_S, ts=_TS)
HEARTBEAT = _struct(device_id=_S, ts=_TS)
SUPPRESSION_REQUEST = _struct(
    request_id=_L, device_id=_S, zone_id=_S, suppression_type=_S, intensity=_I, ts=_TS
)
