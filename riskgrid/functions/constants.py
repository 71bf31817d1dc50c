"""Fixed values that must equal the reference's for identical results.

FIXED VALUES (do not edit): patterns, sets, windows and feature order as the
reference defines them.
"""

# Intervention start / end patterns (case-insensitive), category and flag sets.
START_PATTERN = r"(?i)\b(SAFETY CAR|VIRTUAL SAFETY CAR|VSC)\b.*\b(DEPLOYED|OUT|PERIOD)\b"
END_PATTERN = r"(?i)\b(ENDING|WITHDRAWN|IN THIS LAP|RESUME|CLEAR)\b"
START_CATEGORIES = ("SafetyCar", "Vsc", "VirtualSafetyCar")
START_FLAGS = ("SC", "VSC", "SAFETY CAR", "VIRTUAL SAFETY CAR")

# Keyword flags searched in the space-joined text of the window.
KEYWORD_FLAGS = {
    "debris_flag": r"(?i)\bDEBRIS\b",
    "crash_flag": r"(?i)\b(CRASH|ACCIDENT|COLLISION|INCIDENT)\b",
    "stopped_flag": r"(?i)\bSTOPPED\b",
    "rain_flag": r"(?i)\b(RAIN|WET|SLIPPERY|AQUAPLANING)\b",
    "yellow_flag": r"(?i)\bYELLOW\b",
    "red_flag": r"(?i)\bRED FLAG\b",
    "track_limits_flag": r"(?i)\bTRACK LIMITS\b",
    "investigation_flag": r"(?i)\bINVESTIGATION\b",
}

# Time parameters (seconds).
GRID_INTERVAL_S = 30
HORIZON_S = 300
SHORT_WINDOW_S = 60
MEDIUM_WINDOW_S = 180
LONG_WINDOW_S = 600
DYNAMICS_WINDOW_S = 120
DYNAMICS_LONG_WINDOW_S = 300
TIME_TO_EVENT_CAP_S = 1800
MERGE_WINDOW_S = 300
WEATHER_TOLERANCE_S = 600
SESSION_FALLBACK_S = 2 * 3600

WEATHER_COLS = ("rainfall", "track_temperature", "air_temperature", "wind_speed", "humidity", "pressure")

ALERT_THRESHOLDS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7)

# Numeric model features, in this order.
NUMERIC_FEATURES = (
    "msg_count_60s", "msg_count_180s", "msg_count_600s", "category_entropy_180s", "unique_categories_180s",
    "debris_flag", "crash_flag", "stopped_flag", "rain_flag", "yellow_flag", "red_flag",
    "track_limits_flag", "investigation_flag",
    "rainfall", "track_temperature", "air_temperature", "wind_speed", "humidity", "pressure",
    "max_rainfall_5m", "track_temp_delta_5m",
    "position_changes_120s", "driver_position_volatility_300s", "gap_std_120s",
    "pack_density_1_5s", "pack_density_3_0s",
)

# Text model settings.
TFIDF_MAX_FEATURES = 5000
TFIDF_NGRAM_RANGE = (1, 3)
SVD_COMPONENTS = 100
SEED = 42

# Gradient-boosted trees.
GBT_TREES = 500
GBT_LEARNING_RATE = 0.05
GBT_MIN_CHILD = 20
GBT_EARLY_STOP = 50

# Display bands.
RISK_HIGH = 0.6
RISK_MEDIUM = 0.35
RATE_HIGH = 5
RATE_MEDIUM = 3
