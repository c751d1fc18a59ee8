"""Column names, labels and limits that results must carry exactly."""

# Raw hourly columns.
RAW_COLUMNS = [
    "temperature_2m", "apparent_temperature", "precipitation", "relative_humidity", "windspeed",
    "dew_point_2m", "pressure_msl",
    "cloud_cover", "cloud_cover_low", "cloud_cover_mid", "cloud_cover_high",
    "wind_direction_10m", "tcwv", "boundary_layer_height",
]

# The base feature list, in model order.
BASE_FEATURES = [
    "temperature_2m", "apparent_temperature", "precipitation", "relative_humidity", "windspeed",
    "temp_lag_1h", "temp_lag_3h", "temp_lag_24h",
    "precip_lag_1h", "precip_lag_3h", "precip_lag_24h",
    "humidity_lag_1h", "humidity_lag_3h",
    "temp_delta_1h", "humidity_delta_1h", "precip_delta_1h",
    "temp_rolling_6h", "humidity_rolling_6h",
    "precip_rolling_3h", "precip_rolling_6h", "precip_rolling_24h",
    "hour_sin", "hour_cos", "month_sin", "month_cos",
    "hour", "month", "weekday",
    "is_rainy_season", "is_peak_rain_month", "is_afternoon",
]

# The extended feature list, in model order.
EXTRA_FEATURES = [
    "dew_point_2m", "dewpoint_depression",
    "pressure_msl", "pressure_tend_3h", "pressure_tend_24h",
    "cloud_cover", "cloud_cover_low", "cloud_cover_mid", "cloud_cover_high", "cloud_low_delta_1h",
    "wind_dir_sin", "wind_dir_cos",
    "tcwv", "tcwv_delta_3h",
    "boundary_layer_height",
]

ALL_FEATURES = BASE_FEATURES + EXTRA_FEATURES

# Forecast models, their variables, and the models that carry CAPE.
ENSEMBLE_MODELS = ["best_match", "ecmwf_ifs025", "gfs_seamless", "icon_seamless", "jma_seamless", "gem_seamless"]
ENSEMBLE_VARIABLES = ["precipitation", "cloud_cover", "relative_humidity_2m", "cape"]
CAPE_MODELS = ["best_match", "gfs_seamless", "gem_seamless"]

# Variables of the single-model archived forecasts.
ARCHIVE_VARIABLES = [
    "precipitation", "temperature_2m", "apparent_temperature", "relative_humidity_2m",
    "dew_point_2m", "pressure_msl", "cloud_cover", "wind_speed_10m", "wind_direction_10m",
]

# Vendor column names and the names used in the tables.
VENDOR_RENAMES = {
    "relative_humidity_2m": "relative_humidity",
    "windspeed_10m": "windspeed",
    "total_column_integrated_water_vapour": "tcwv",
}

# Calendar flags.
RAINY_MONTHS = [10, 11, 12, 1, 2, 3]
PEAK_MONTHS = [1, 2, 12]
AFTERNOON_HOURS = (12, 18)

# Lowest probability of each alert level, highest level first.
ALERT_LEVELS = [
    (0.85, "🔴 CHUVA FORTE"),
    (0.65, "🟠 CHUVA PROVÁVEL"),
    (0.40, "🟡 POSSÍVEL CHUVA"),
]
ALERT_DEFAULT = "🟢 SEM CHUVA"

# Labels of the four outcomes of a yes/no forecast.
OUTCOME_LABELS = {
    (1, 1): "Verdadeiro Positivo",
    (0, 0): "Verdadeiro Negativo",
    (1, 0): "Falso Negativo",
    (0, 1): "Falso Positivo",
}

# Lead-time ranges, upper bound in hours.
LEAD_RANGES = [(6, "01–06 h"), (12, "07–12 h"), (18, "13–18 h")]
LEAD_REST = "19–24 h"

# Limits in mm and minimum counts.
WET_HOUR_MM = 0.2
WET_DAY_MM = 1.0
VOTE_MM = 0.1
CONTINGENCY_LIMITS_MM = [0.0, 0.5, 1.0]
MIN_HOURS_PER_MONTH = 600
MIN_HOURS_PER_DAY = 20
MIN_TEST_ROWS = 500
MIN_NEW_ROWS = 720
PROMOTION_TOLERANCE = 0.02

# Threshold grids in hundredths (first, last, step).
SWEEP_EVALUATION = (10, 85, 5)
SWEEP_RETRAIN = (30, 90, 5)
SWEEP_REGIONAL = (5, 90, 5)
SWEEP_ENSEMBLE = (5, 95, 5)

# Ledger schemas.
EXPERIMENTS_DDL = (
    "experimento string, variante string, n_features bigint, threshold double, f1 double, auc_roc double, "
    "accuracy double, `precision` double, recall double, train_size bigint, test_size bigint, created_at timestamp"
)
MODEL_VERSIONS_DDL = (
    "version int, run_id string, created_at timestamp, promoted boolean, f1 double, accuracy double, "
    "`precision` double, recall double, auc_roc double, train_size int, test_size int, "
    "test_rain_rate double, threshold double"
)
REGIONAL_VERSIONS_DDL = (
    "version int, run_id string, created_at timestamp, promoted boolean, threshold double, f1 double, "
    "`precision` double, recall double, accuracy double, auc_roc double, train_size int, test_size int, "
    "test_rain_rate double, estacoes string"
)
ENSEMBLE_VERSIONS_DDL = (
    "version int, run_id string, created_at timestamp, promoted boolean, threshold double, f1 double, "
    "f1_api double, `precision` double, recall double, accuracy double, auc_roc double, brier double, "
    "train_size int, test_size int, test_rain_rate double, estacoes string"
)
VALIDATION_DDL = (
    "metrica string, fonte string, ponto string, valor double, n bigint, created_at timestamp"
)
