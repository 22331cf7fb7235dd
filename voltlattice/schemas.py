"""Explicit schemas and column contracts. No source is ever inferred."""

from pyspark.sql import types as T

FEATURE_COLS = [
    "hour", "day_of_week", "month",
    "hour_sin", "hour_cos", "day_sin", "day_cos",
    "is_weekend", "is_holiday", "temperature_c",
    "lag_1h", "lag_24h", "lag_168h",
    "rolling_mean_6h", "rolling_mean_24h", "rolling_std_24h",
]
TARGET_COL = "occupancy_rate"
FORBIDDEN_FEATURES = ("occupancy_rate", "occupied_slots", "grid_load_kw")
KEY_FEATURES = ["hour", "lag_1h", "lag_24h", "lag_168h", "rolling_mean_24h", "temperature_c"]
STATUS_BANDS = ["AVAILABLE", "MODERATE", "BUSY", "CRITICAL"]

STATIONS = T.StructType([
    T.StructField("station_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("total_slots", T.IntegerType()),
    T.StructField("charger_type", T.StringType()),
    T.StructField("operator", T.StringType()),
    T.StructField("avg_power_kw", T.DoubleType()),
    T.StructField("installation_year", T.IntegerType()),
    T.StructField("amenities", T.StringType()),
    T.StructField("amenities_score", T.DoubleType()),
    T.StructField("tariff_per_kwh", T.DoubleType()),
    T.StructField("is_24x7", T.BooleanType()),
    T.StructField("has_fast_charger", T.BooleanType()),
    T.StructField("parking_fee_per_hr", T.IntegerType()),
])

SESSIONS = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("station_id", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("charger_type", T.StringType()),
    T.StructField("operator", T.StringType()),
    T.StructField("start_time", T.TimestampNTZType()),
    T.StructField("end_time", T.TimestampNTZType()),
    T.StructField("duration_hrs", T.DoubleType()),
    T.StructField("energy_kwh", T.DoubleType()),
    T.StructField("vehicle_type", T.StringType()),
    T.StructField("day_of_week", T.StringType()),
    T.StructField("hour", T.IntegerType()),
    T.StructField("is_weekend", T.BooleanType()),
    T.StructField("wait_time_mins", T.DoubleType()),
    T.StructField("revenue_inr", T.DoubleType()),
    T.StructField("user_segment", T.StringType()),
])

STATUS = T.StructType([
    T.StructField("station_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("operator", T.StringType()),
    T.StructField("charger_type", T.StringType()),
    T.StructField("total_slots", T.IntegerType()),
    T.StructField("available_slots", T.IntegerType()),
    T.StructField("occupied_slots", T.IntegerType()),
    T.StructField("queue_length", T.IntegerType()),
    T.StructField("current_load_kw", T.DoubleType()),
    T.StructField("estimated_wait_mins", T.DoubleType()),
    T.StructField("utilization_pct", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("last_updated", T.TimestampNTZType()),
])

HOURLY = T.StructType([
    T.StructField("station_id", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("city", T.StringType()),
    T.StructField("charger_type", T.StringType()),
    T.StructField("total_slots", T.IntegerType()),
    T.StructField("occupied_slots", T.IntegerType()),
    T.StructField("occupancy_rate", T.DoubleType()),
    T.StructField("grid_load_kw", T.DoubleType()),
    T.StructField("temperature_c", T.DoubleType()),
    T.StructField("is_weekend", T.BooleanType()),
    T.StructField("is_holiday", T.BooleanType()),
])

REQUESTS = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("station_id", T.StringType()),
    T.StructField("prediction_time", T.StringType()),
    T.StructField("temperature_c", T.DoubleType()),
    T.StructField("is_holiday", T.BooleanType()),
])

PREDICTION_LOG = T.StructType([
    T.StructField("prediction_id", T.StringType()),
    T.StructField("logged_at", T.StringType()),
    T.StructField("station_id", T.StringType()),
    T.StructField("prediction_time", T.StringType()),
    T.StructField("predicted_occupancy", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("inference_latency_ms", T.DoubleType()),
    T.StructField("source", T.StringType()),
    T.StructField("key_features", T.StructType([
        T.StructField("hour", T.IntegerType()),
        T.StructField("lag_1h", T.DoubleType()),
        T.StructField("lag_24h", T.DoubleType()),
        T.StructField("lag_168h", T.DoubleType()),
        T.StructField("rolling_mean_24h", T.DoubleType()),
        T.StructField("temperature_c", T.DoubleType()),
    ])),
])

# Star-schema test tables, as DDL.
STAR = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "benchmark": "item_id bigint, text string",
}
