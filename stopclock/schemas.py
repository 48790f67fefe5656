"""Schemas of landed and stored tables."""

from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
_TS, _DATE, _B, _SH, _F = T.TimestampType(), T.DateType(), T.BooleanType(), T.ShortType(), T.FloatType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TRIP_REF = _struct(trip_id=_S, route_id=_S, start_date=_S)
STOP_EVENT = _struct(time=_L, delay=_I)
STOP_TIME_UPDATE = _struct(
    stop_sequence=_I, stop_id=_S, schedule_relationship=_I, arrival=STOP_EVENT, departure=STOP_EVENT
)
VEHICLE = _struct(
    vehicle_id=_S,
    timestamp=_L,
    trip=TRIP_REF,
    position=_struct(latitude=_D, longitude=_D, bearing=_F, speed=_F),
    current_stop_sequence=_I,
    current_status=_I,
    occupancy_status=_I,
)
TRIP_UPDATE = _struct(
    timestamp=_L, vehicle_id=_S, trip=TRIP_REF, stop_time_update=T.ArrayType(STOP_TIME_UPDATE)
)
SNAPSHOT = _struct(
    feed=_S,
    header_ts=_L,
    entity=T.ArrayType(_struct(id=_S, vehicle=VEHICLE, trip_update=TRIP_UPDATE)),
)

VEHICLE_POSITIONS = _struct(
    vehicle_id=_S,
    ts=_TS,
    trip_id=_S,
    route_id=_S,
    start_date=_DATE,
    lat=_D,
    lon=_D,
    bearing=_F,
    speed=_F,
    current_stop_sequence=_I,
    current_status=_SH,
    occupancy_status=_SH,
)
PREDICTIONS = _struct(
    start_date=_DATE,
    trip_id=_S,
    stop_sequence=_I,
    observed_at=_TS,
    stop_id=_S,
    route_id=_S,
    arrival_time=_TS,
    departure_time=_TS,
    delay_seconds=_I,
    schedule_relationship=_SH,
    vehicle_id=_S,
)
POLL_LOG = _struct(
    feed=_S,
    started_at=_TS,
    duration_ms=_L,
    status=_S,
    http_code=_I,
    feed_timestamp=_TS,
    entity_count=_L,
    rows_written=_L,
    error=_S,
)
FEED_VERSIONS = _struct(
    feed_version=_S,
    source_url=_S,
    downloaded_at=_TS,
    loaded_at=_TS,
    content_length=_L,
    last_modified=_S,
    publisher_version=_S,
    feed_start_date=_DATE,
    feed_end_date=_DATE,
    row_counts=_S,
)
LOAD_LOG = _struct(
    started_at=_TS,
    duration_ms=_L,
    status=_S,
    http_code=_I,
    feed_version=_S,
    bytes=_L,
    rows_loaded=_S,
    error=_S,
)
MODEL_RUNS = _struct(
    trained_at=_TS,
    source=_S,
    train_from=_DATE,
    train_to=_DATE,
    test_from=_DATE,
    test_to=_DATE,
    train_rows=_L,
    test_rows=_L,
    features=_S,
    params=_S,
    mae_by_horizon=_S,
    notes=_S,
)

# Natural key of every stored table.
KEYS = {
    "vehicle_positions": ["vehicle_id", "ts"],
    "predictions": ["start_date", "trip_id", "stop_sequence", "observed_at"],
    "feed_versions": ["feed_version"],
    "agencies": ["feed_version", "agency_id"],
    "routes": ["feed_version", "route_id"],
    "stops": ["feed_version", "stop_id"],
    "trips": ["feed_version", "trip_id"],
    "stop_times": ["feed_version", "trip_id", "stop_sequence"],
    "shapes": ["feed_version", "shape_id", "shape_pt_sequence"],
    "calendar": ["feed_version", "service_id"],
    "calendar_dates": ["feed_version", "service_id", "service_date"],
    "service_dates": ["feed_version", "service_date", "service_id"],
    "arrivals": ["start_date", "trip_id", "stop_sequence"],
    "prediction_errors": ["start_date", "trip_id", "stop_sequence", "horizon_minutes", "source"],
    "segment_stats": [
        "feed_version",
        "from_stop_id",
        "to_stop_id",
        "hour_bin",
        "is_weekend",
        "fit_through_date",
    ],
}
