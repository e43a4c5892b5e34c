"""Names, thresholds and lookup tables.

Everything in this module is a fixed value: results only agree with existing reports if these
are equal to the published ones, so they are written out plainly and in their natural order.
"""

# --- fixed values: the canonical station-hour table -------------------------------------------
MEASUREMENTS = [
    "solar_radiation_high_wm2", "uv_high", "winddir_avg_deg",
    "humidity_avg_pct", "humidity_high_pct", "humidity_low_pct",
    "temp_avg_c", "temp_high_c", "temp_low_c",
    "windspeed_avg_kmh", "windspeed_high_kmh", "windspeed_low_kmh",
    "windgust_avg_kmh", "windgust_high_kmh", "windgust_low_kmh",
    "dewpoint_avg_c", "dewpoint_high_c", "dewpoint_low_c",
    "windchill_avg_c", "windchill_high_c", "windchill_low_c",
    "heatindex_avg_c", "heatindex_high_c", "heatindex_low_c",
    "pressure_max_hpa", "pressure_min_hpa", "pressure_trend_hpa",
    "precip_rate_mmh", "precip_total_mm",
]
CANONICAL_COLUMNS = [
    "station_id", "hour_utc", "n_raw_records", "latitude", "longitude", "qc_status", "epoch",
    *MEASUREMENTS,
    "timestamp_utc_dt", "timestamp_utc", "timestamp_local", "data_present", "elevation",
]
METADATA_COLUMNS = [c for c in CANONICAL_COLUMNS if c not in MEASUREMENTS]

# --- fixed values: public raw and gap-filled headers ------------------------------------------
PUBLIC_REGISTRY_COLUMNS = [
    "station_id", "station_name", "city", "country", "latitude", "longitude", "elevation_m", "start_date",
]
RAW_MEASUREMENTS = [
    "solar_radiation_high_wm2", "uv_high", "winddir_avg_deg",
    "humidity_high_pct", "humidity_low_pct", "humidity_avg_pct", "qc_status",
    "temp_high_c", "temp_low_c", "temp_avg_c",
    "windspeed_high_kmh", "windspeed_low_kmh", "windspeed_avg_kmh",
    "windgust_high_kmh", "windgust_low_kmh", "windgust_avg_kmh",
    "dewpoint_high_c", "dewpoint_low_c", "dewpoint_avg_c",
    "windchill_high_c", "windchill_low_c", "windchill_avg_c",
    "heatindex_high_c", "heatindex_low_c", "heatindex_avg_c",
    "pressure_max_hpa", "pressure_min_hpa", "pressure_trend_hpa",
    "precip_rate_mmh", "precip_total_mm",
]
STATION_COLUMNS = ["station_id", "latitude", "longitude", "elevation_m"]
OBSERVED_COLUMNS = ["obs_time_utc", "obs_time_local", "epoch", *RAW_MEASUREMENTS]
RAW_COLUMNS = [*STATION_COLUMNS, "timezone", *OBSERVED_COLUMNS]
GAP_FILLED_COLUMNS = [
    *STATION_COLUMNS, "expected_time_utc", "date_utc", "data_present", "n_observations_in_bin",
    "timezone", *OBSERVED_COLUMNS,
]
EMPTY_TEXT = ["", "nan", "nat", "none", "null", "na", "n/a"]
FORBIDDEN_HEADER_TEXT = ["metric.", "obsTime", "qcStatus", "stationID"]
REDUNDANT_COLUMNS = [
    "registry_station_id", "registry_station_name", "registry_city", "registry_country",
    "registry_latitude", "registry_longitude", "registry_elevation_m", "registry_install_date",
    "api_request_date",
]
SNAKE_CASE_PATTERN = "^[a-z][a-z0-9_]*$"
DEFAULT_TIMEZONE = "Africa/Tripoli"

# --- fixed values: source names to canonical names --------------------------------------------
OBSERVATION_RENAMES = {
    "stationID": "station_id", "tz": "timezone",
    "obsTimeUtc": "obs_time_utc", "obsTimeLocal": "obs_time_local",
    "lat": "latitude", "lon": "longitude",
    "solarRadiationHigh": "solar_radiation_high_wm2", "uvHigh": "uv_high", "winddirAvg": "winddir_avg_deg",
    "humidityHigh": "humidity_high_pct", "humidityLow": "humidity_low_pct", "humidityAvg": "humidity_avg_pct",
    "qcStatus": "qc_status",
    "metric.tempHigh": "temp_high_c", "metric.tempLow": "temp_low_c", "metric.tempAvg": "temp_avg_c",
    "metric.windspeedHigh": "windspeed_high_kmh", "metric.windspeedLow": "windspeed_low_kmh",
    "metric.windspeedAvg": "windspeed_avg_kmh",
    "metric.windgustHigh": "windgust_high_kmh", "metric.windgustLow": "windgust_low_kmh",
    "metric.windgustAvg": "windgust_avg_kmh",
    "metric.dewptHigh": "dewpoint_high_c", "metric.dewptLow": "dewpoint_low_c",
    "metric.dewptAvg": "dewpoint_avg_c",
    "metric.windchillHigh": "windchill_high_c", "metric.windchillLow": "windchill_low_c",
    "metric.windchillAvg": "windchill_avg_c",
    "metric.heatindexHigh": "heatindex_high_c", "metric.heatindexLow": "heatindex_low_c",
    "metric.heatindexAvg": "heatindex_avg_c",
    "metric.pressureMax": "pressure_max_hpa", "metric.pressureMin": "pressure_min_hpa",
    "metric.pressureTrend": "pressure_trend_hpa",
    "metric.precipRate": "precip_rate_mmh", "metric.precipTotal": "precip_total_mm",
    "requested_date": "api_request_date",
}
REFERENCE_HOURLY_RENAMES = {
    "temperature_2m": "base_temperature_c", "relative_humidity_2m": "base_relative_humidity_pct",
    "dew_point_2m": "base_dew_point_c", "wind_speed_10m": "base_wind_speed_kmh",
    "wind_gusts_10m": "base_wind_gust_kmh", "wind_direction_10m": "base_wind_direction_deg",
    "surface_pressure": "base_surface_pressure_hpa", "pressure_msl": "base_msl_pressure_hpa",
    "rain": "base_rain_total_mm", "shortwave_radiation": "base_solar_radiation_wm2",
    "cloud_cover": "base_cloud_cover_pct", "cloud_cover_low": "base_cloud_cover_low_pct",
    "cloud_cover_mid": "base_cloud_cover_mid_pct", "cloud_cover_high": "base_cloud_cover_high_pct",
    "precipitation": "base_precipitation_mm", "weather_code": "base_weather_code", "is_day": "base_is_day",
    "sunshine_duration": "base_sunshine_seconds", "direct_radiation": "base_direct_radiation_wm2",
    "diffuse_radiation": "base_diffuse_radiation_wm2",
    "et0_fao_evapotranspiration": "base_evapotranspiration_mm", "snowfall": "base_snowfall_mm",
}
REFERENCE_DAILY_RENAMES = {
    "sunrise": "base_sunrise_utc", "sunset": "base_sunset_utc", "daylight_duration": "base_daylight_seconds",
    "sunshine_duration": "base_sunshine_daily_seconds", "temperature_2m_max": "base_temperature_max_c",
    "temperature_2m_min": "base_temperature_min_c", "precipitation_sum": "base_precipitation_daily_mm",
}

# --- fixed values: row states and station classes ---------------------------------------------
INVALID = "invalid_missing_id_or_time"
NEVER_ACTIVE = "station_never_active"
BEFORE_FIRST = "before_first_present"
WARMUP = "warmup"
TERMINAL_PADDED = "terminal_padded_absence"
TRUE_OUTAGE = "true_outage_candidate"
PARTIAL = "online_partial_missing"
COMPLETE = "online_complete"
# in the order in which a row is tested for them
ROW_STATES = [INVALID, NEVER_ACTIVE, BEFORE_FIRST, TERMINAL_PADDED, WARMUP, TRUE_OUTAGE, PARTIAL, COMPLETE]
PRESENT_STATES = [WARMUP, PARTIAL, COMPLETE]
INACTIVE_STATES = [
    "pre_install_padded_absence", "pre_install_padded_present", "pre_install_invalid_unknown",
    "terminal_padded_absence",
]
TIMELINE_BANDS = {"online": [COMPLETE, PARTIAL], "outage": [TRUE_OUTAGE], "warmup": [WARMUP]}  # others: padded
WARMUP_DAYS = 7
STATUS_CLASSES = [
    "outage_dominated", "weak", "usable", "reliable_but_terminal_gap", "reliable_reference_candidate",
]

# --- fixed values: outage classes and buckets -------------------------------------------------
LOCAL, MIDNIGHT, OTHER_NETWORK, UNKNOWN_CLASS = "local", "network_midnight", "network_other", "unknown"
NETWORK_CLASSES = [MIDNIGHT, OTHER_NETWORK]
OUTAGE_CLASSES = [LOCAL, MIDNIGHT, OTHER_NETWORK]
MIDNIGHT_HOURS = [22, 23]
DURATION_EDGES = [0, 3, 24, 168]
DURATION_LABELS = ["short", "medium", "long", "very_long"]
DISTANCE_EDGES_KM = [0, 25, 50, 100, 200, 500, 2000]
DISTANCE_LABELS = ["0-25km", "25-50km", "50-100km", "100-200km", "200-500km", ">500km"]
GAP_DAY_EDGES = [0, 1, 2, 3, 5, 7, 14, 30, 365]
GAP_DAY_LABELS = ["0-1d", "1-2d", "2-3d", "3-5d", "5-7d", "7-14d", "14-30d", ">30d"]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
OFFLINE_THRESHOLDS = [0.5, 0.7, 0.8, 0.9, 1.0]
EARTH_RADIUS_KM = 6371.0
REGION_SPLIT_LONGITUDE = 16.0
TIGHT_SYNC_SECONDS = 120.0

# --- fixed values: anomaly scoring ------------------------------------------------------------
FLAG_PERCENTILE = 99.7
STUCK_WINDOW = 24
STUCK_VARIANCE = 1e-6
STUCK_MAGNITUDE = 1e-9
COVERAGE_FLOOR = 1500
Z_THRESHOLD = 3.5
CIRCULAR_CHANNELS = ["winddir_avg_deg"]
LOG_CHANNELS = ["precip_total_mm", "precip_rate_mmh"]
UNSCORED_CHANNELS = [
    "dewpoint_avg_c", "dewpoint_high_c", "dewpoint_low_c",
    "windchill_avg_c", "windchill_high_c", "windchill_low_c",
    "heatindex_avg_c", "heatindex_high_c", "heatindex_low_c",
]
STUCK_IGNORE_ZERO = [
    "precip_rate_mmh", "solar_radiation_high_wm2", "uv_high", "windspeed_low_kmh", "windgust_low_kmh",
]
STUCK_SKIP = ["precip_total_mm"]
SENSOR_GROUPS = {
    "temp": "thermo_hygrometer", "humidity": "thermo_hygrometer",
    "windspeed": "anemometer", "windgust": "anemometer", "winddir": "wind_vane",
    "precip": "rain_gauge", "solar": "light_uv", "uv": "light_uv", "pressure": "barometer",
}
# channel: (minimum, maximum, maximum of the absolute value, kind)
HARD_LIMITS = {
    "temp_avg_c": (-60.0, 60.0, None, "temperature"),
    "temp_high_c": (-60.0, 60.0, None, "temperature"),
    "temp_low_c": (-60.0, 60.0, None, "temperature"),
    "humidity_avg_pct": (0.0, 100.0, None, "humidity"),
    "humidity_high_pct": (0.0, 100.0, None, "humidity"),
    "humidity_low_pct": (0.0, 100.0, None, "humidity"),
    "windspeed_avg_kmh": (0.0, 250.0, None, "wind"),
    "windspeed_high_kmh": (0.0, 250.0, None, "wind"),
    "windspeed_low_kmh": (0.0, 250.0, None, "wind"),
    "windgust_avg_kmh": (0.0, 300.0, None, "wind"),
    "windgust_high_kmh": (0.0, 300.0, None, "wind"),
    "windgust_low_kmh": (0.0, 300.0, None, "wind"),
    "winddir_avg_deg": (0.0, 360.0, None, "wind_direction"),
    "pressure_max_hpa": (870.0, 1085.0, None, "pressure"),
    "pressure_min_hpa": (870.0, 1085.0, None, "pressure"),
    "pressure_trend_hpa": (None, None, 20.0, "pressure_trend"),
    "precip_rate_mmh": (0.0, 1000.0, None, "rain_rate"),
    "precip_total_mm": (0.0, 1000.0, None, "rain_total"),
    "solar_radiation_high_wm2": (0.0, 1400.0, None, "solar"),
    "uv_high": (0.0, 25.0, None, "uv"),
}
SUSPECT_LIMITS = {
    "solar_radiation_high_wm2": (None, 1100.0, None, "solar"),
    "uv_high": (None, 16.0, None, "uv"),
    "windspeed_avg_kmh": (None, 150.0, None, "wind"),
    "windspeed_high_kmh": (None, 150.0, None, "wind"),
    "windspeed_low_kmh": (None, 150.0, None, "wind"),
    "windgust_avg_kmh": (None, 180.0, None, "wind"),
    "windgust_high_kmh": (None, 180.0, None, "wind"),
    "windgust_low_kmh": (None, 180.0, None, "wind"),
    "precip_rate_mmh": (None, 300.0, None, "rain_rate"),
    "precip_total_mm": (None, 300.0, None, "rain_total"),
    "pressure_trend_hpa": (None, None, 20.0, "pressure_trend"),
}

# --- fixed values: detectors, reasons and review roles ----------------------------------------
DETECTOR_PRIORITY = ["physical", "stuck", "iforest", "zscore"]
MAD_HIGH, STUCK_REASON, IFOREST_REASON = "mad_high", "stuck_variance_zero", "iforest_outlier"
HARD_REASON, SUSPECT_REASON = "physical_limit_breach", "physical_suspect_breach"
REASONS = [MAD_HIGH, STUCK_REASON, IFOREST_REASON, HARD_REASON, SUSPECT_REASON]
REASON_DETECTOR = {
    MAD_HIGH: "zscore", STUCK_REASON: "stuck", IFOREST_REASON: "iforest",
    HARD_REASON: "physical", SUSPECT_REASON: "physical",
}
ONSET_TOLERANCE_HOURS = 6
MIN_CLUSTER_SIZE, MIN_SAMPLES = 30, 10
SUSTAINED_NOISE_HOURS = 24
REVIEW_ROLES = ["representative", "boundary", "noise_sustained", "noise_check", "physical_limit"]

# --- fixed values: confirmation against five-minute readings ----------------------------------
FIVE_MIN_COLUMN = {
    "solar_radiation_high_wm2": "solar_radiation_high_wm2", "uv_high": "uv_high",
    "windspeed_avg_kmh": "windspeed_avg_kmh", "windspeed_high_kmh": "windspeed_high_kmh",
    "windspeed_low_kmh": "windspeed_low_kmh",
    "windgust_avg_kmh": "windgust_avg_kmh", "windgust_high_kmh": "windgust_high_kmh",
    "windgust_low_kmh": "windgust_low_kmh",
    "winddir_avg_deg": "winddir_avg_deg", "winddir_sin": "winddir_avg_deg", "winddir_cos": "winddir_avg_deg",
    "temp_high_c": "temp_high_c", "temp_low_c": "temp_low_c", "temp_avg_c": "temp_avg_c",
    "humidity_high_pct": "humidity_high_pct", "humidity_low_pct": "humidity_low_pct",
    "humidity_avg_pct": "humidity_avg_pct",
    "pressure_max_hpa": "pressure_max_hpa", "pressure_min_hpa": "pressure_min_hpa",
    "pressure_trend_hpa": "pressure_trend_hpa",
    "precip_rate_mmh": "precip_rate_mmh", "precip_total_mm": "precip_total_mm",
}
STUCK_PRIORITY = {
    "windspeed_avg_kmh": 0, "windgust_avg_kmh": 1, "windspeed_high_kmh": 2, "windgust_high_kmh": 3,
    "windspeed_low_kmh": 4, "windgust_low_kmh": 5,
    "temp_avg_c": 10, "temp_high_c": 11, "temp_low_c": 12,
    "humidity_avg_pct": 20, "humidity_high_pct": 21, "humidity_low_pct": 22,
    "pressure_max_hpa": 30, "pressure_min_hpa": 31, "pressure_trend_hpa": 32,
    "precip_rate_mmh": 40, "precip_total_mm": 41,
    "winddir_sin": 50, "winddir_cos": 51, "winddir_avg_deg": 52,
}
NO_PRIORITY = 999
MIN_FIVE_MIN_READINGS = 24
CONSTANCY_THRESHOLD = 0.99
VALUE_PRECISION = 2
LOW_VARIANCE_FLOOR = 0.80
RANGING_SPREAD, RANGING_DISTINCT = 5.0, 10
