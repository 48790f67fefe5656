"""Values that must equal the published definitions for results to match."""

# Clock, horizons, sources.
SERVICE_TZ = "America/Los_Angeles"
HORIZONS_MINUTES = (1, 5, 10, 20)
AGENCY = "mts"
PERSIST_DELAY = "persist_delay"
SEGMENT_MEAN = "segment_mean"
TREES = "lgbm"
SOURCES = (AGENCY, PERSIST_DELAY, SEGMENT_MEAN, TREES)
VEHICLE_POSITIONS = "vehicle_positions"
TRIP_UPDATES = "trip_updates"
FEEDS = (VEHICLE_POSITIONS, TRIP_UPDATES)

# Scoring.
TIGHT_LABEL_SECONDS = 180
MAX_PREDICTION_AGE_SECONDS = 7200
CHANGE_THRESHOLD_SECONDS = 30
RETAIN_SERVICE_DAYS = 2

# Time bands, minutes past service midnight, [low, high); low > high wraps.
TIME_BANDS = {
    "all": None,
    "am_rush": (360, 540),
    "midday": (540, 900),
    "pm_rush": (900, 1140),
    "evening": (1140, 1440),
    "late": (1440, 360),
}

# Schedule text.
METRES_PER_MILE = 1609.344
REQUIRED_FILES = (
    "agency.txt",
    "routes.txt",
    "trips.txt",
    "stop_times.txt",
    "stops.txt",
    "shapes.txt",
    "calendar.txt",
)
OPTIONAL_FILES = ("calendar_dates.txt", "feed_info.txt")
EXCEPTION_ADDED = 1
EXCEPTION_REMOVED = 2
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

# Service day resolution.
GRACE_BEFORE_SECONDS = 900
GRACE_AFTER_SECONDS = 3600

# Map matching and arrival inference.
EARTH_RADIUS_M = 6_371_000.0
MAX_SPEED_MPS = 35.0
BACKTRACK_M = 300.0
MAX_OFFROUTE_M = 150.0
DWELL_RADIUS_M = 40.0
AT_STOP_M = 15.0
METHODS = ("interpolated", "dwell", "at_ping")

# Segments, conditions, training pairs.
MIN_SEGMENT_SECONDS = 1
MAX_SEGMENT_SECONDS = 1800
DEFAULT_SEGMENT_SECONDS = 60.0
MAX_HOUR_BIN = 29
BUCKET_SECONDS = 300
WINDOW_SECONDS = 1800
MAX_STOPS_AHEAD = 30
NEAR_PAIR_LIMIT = 12
FAR_PAIR_SAMPLE_PCT = 35
MAX_LABEL_SECONDS = 7200
FEATURES = (
    "stops_ahead",
    "scheduled_remaining_seconds",
    "anchor_delay_seconds",
    "segment_sum_seconds",
    "hour_bin",
    "is_weekend",
    "coarse_segment_share",
    "route_recent_delay_seconds",
    "route_recent_n",
    "trip_progress",
    "minute_of_day",
    "route_index",
)

# Reports and bias correction.
BIAS_HORIZON_MINUTES = 10
MIN_STOP_ROUTE_SAMPLE = 10
MIN_ROUTE_SAMPLE = 30
MEANINGFUL_CORRECTION_SECONDS = 20
COVERAGE_WARN_PCT = 80
COVERAGE_CRITICAL_PCT = 50
GAP_SECONDS = 120
STALE_AFTER_SECONDS = 300
NEVER_SUCCEEDED_AGE = 999999
FAILURES_BEFORE_ALERT = 2
RENOTIFY_SECONDS = 3600
MIN_HEADING_M = 12.0
METRES_PER_LON_DEGREE = 93_675.0
METRES_PER_LAT_DEGREE = 111_320.0
MAX_ERROR_CHARS = 1000

# Status domains.
POLL_STATUSES = ("ok", "skipped_unchanged", "http_error", "parse_error", "db_error")
LOAD_STATUSES = (
    "ok",
    "skipped_unchanged",
    "skipped_already_loaded",
    "http_error",
    "parse_error",
    "db_error",
)
INFERENCE_STATUSES = ("ok", "no_pings", "no_shape", "no_stops", "no_arrivals", "error")
