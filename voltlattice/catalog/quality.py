"""Row, request and dataset validation."""

from pyspark.sql import functions as F

from voltlattice.catalog.registry import query
from voltlattice.operators import quality, windows
from voltlattice.plans import serving, training
from voltlattice.schemas import FEATURE_COLS
from voltlattice.sources import fixtures as fx


def text_features(spark, sf_dir):
    """Feature rows as text, some broken: a word instead of a number, a lag above 1, a missing value."""
    features = training.build_training_features(fx.hourly(spark, sf_dir))
    h = F.dayofmonth("timestamp")
    broken = {
        "temperature_c": F.when(h == 9, F.lit("warm")).otherwise(F.col("temperature_c").cast("string")),
        "lag_24h": F.when(h == 10, F.lit("1.5")).otherwise(F.col("lag_24h").cast("string")),
        "month": F.when(h == 11, F.lit(None).cast("string")).otherwise(F.col("month").cast("string")),
    }
    return features.withColumns(broken)


@query("val_1_feature_rows", """
    SELECT station_id, "timestamp", CASE day("timestamp") WHEN 9 THEN 'temperature_c:numeric' WHEN 10 THEN 'lag_24h:range'
        WHEN 11 THEN 'month:numeric' ELSE '' END AS errors, day("timestamp") NOT IN (9, 10, 11) AS is_valid FROM featured""")
def feature_rows(spark, sf_dir):
    return quality.validate_rows(text_features(spark, sf_dir), quality.feature_row_rules()).select(
        "station_id", "timestamp", F.array_join("errors", ",").alias("errors"), "is_valid"
    )


def ranged(spark, sf_dir):
    """Feature rows with values pushed out of range on some days."""
    features = training.build_training_features(fx.hourly(spark, sf_dir))
    day = F.dayofmonth("timestamp")
    return features.withColumns({
        "hour": F.when(day == 12, 24).otherwise(F.col("hour")),
        "temperature_c": F.when(day.isin(12, 13), -6.0).otherwise(F.col("temperature_c")),
        "rolling_std_24h": F.when(day == 14, -0.1).otherwise(F.col("rolling_std_24h")),
    })


@query("val_2_feature_ranges", """
    SELECT station_id, "timestamp", CASE day("timestamp") WHEN 12 THEN 'hour,temperature_c' WHEN 13 THEN 'temperature_c'
        WHEN 14 THEN 'rolling_std_24h' ELSE '' END AS errors, day("timestamp") NOT IN (12, 13, 14) AS is_valid FROM featured""")
def feature_ranges(spark, sf_dir):
    return quality.validate_rows(ranged(spark, sf_dir), quality.feature_range_rules()).select(
        "station_id", "timestamp", F.array_join("errors", ",").alias("errors"), "is_valid"
    )


def batches(spark, sf_dir):
    """One batch per station and day, and one oversize batch per day of the month 20."""
    day = F.to_date("timestamp").cast("string")
    batch = F.when(F.dayofmonth("timestamp") == 20, day).otherwise(F.concat_ws("/", "station_id", day))
    return ranged(spark, sf_dir).withColumn("batch_id", batch).withColumn(
        "index", F.hour("timestamp").cast("int")
    )


@query("val_3_batches", """
    WITH b AS (SELECT CASE WHEN day("timestamp") = 20 THEN strftime("timestamp", '%Y-%m-%d')
                 ELSE station_id || '/' || strftime("timestamp", '%Y-%m-%d') END AS batch_id,
               day("timestamp") IN (12, 13, 14) AS bad FROM featured)
    SELECT batch_id, count(*) AS n_items, count(*) <= 500 AND NOT bool_or(bad) AS accepted FROM b GROUP BY batch_id""")
def batch_rule(spark, sf_dir):
    checked = quality.validate_rows(batches(spark, sf_dir), quality.feature_range_rules())
    return quality.accept_batches(checked, ~F.col("is_valid"))


@query("val_3_batch_results", """
    WITH b AS (SELECT *, CASE WHEN day("timestamp") = 20 THEN strftime("timestamp", '%Y-%m-%d')
                 ELSE station_id || '/' || strftime("timestamp", '%Y-%m-%d') END AS batch_id,
               day("timestamp") IN (12, 13, 14) AS bad FROM featured),
      ok AS (SELECT batch_id FROM b GROUP BY batch_id HAVING count(*) <= 500 AND NOT bool_or(bad))
    SELECT batch_id, CAST(hour("timestamp") AS INTEGER) AS "index", lag_24h AS predicted_occupancy,
      CASE WHEN lag_24h >= CAST(0.9 AS DOUBLE) THEN 'CRITICAL' WHEN lag_24h >= CAST(0.7 AS DOUBLE) THEN 'BUSY'
           WHEN lag_24h >= CAST(0.4 AS DOUBLE) THEN 'MODERATE' ELSE 'AVAILABLE' END AS predicted_status
    FROM b JOIN ok USING (batch_id)""")
def batch_results(spark, sf_dir):
    from voltlattice.operators.forest import baseline_predict

    return serving.predict_batches(batches(spark, sf_dir), baseline_predict)


@query("val_4_request_errors", """
    SELECT request_id, station_id, prediction_time, error_code,
      CAST(CASE WHEN error_code = 'unknown_station' THEN 404 ELSE 422 END AS INTEGER) AS error_status
    FROM checked WHERE error_code IS NOT NULL""")
def request_errors(spark, sf_dir):
    return serving.rejected(serving.build_request_features(fx.requests(spark, sf_dir), fx.hourly(spark, sf_dir)))


@query("val_5_retrieval_requests", """
    SELECT vec_id, CASE WHEN vec_id % 3 = 0 AND vec_id % 5 = 0 THEN 'question,top_k' WHEN vec_id % 3 = 0 THEN 'question'
        WHEN vec_id % 5 = 0 THEN 'top_k' WHEN vec_id % 7 = 0 THEN 'threshold' ELSE '' END
      || CASE WHEN vec_id % 7 = 0 AND (vec_id % 3 = 0 OR vec_id % 5 = 0) THEN ',threshold' ELSE '' END AS errors FROM embeddings""")
def retrieval_requests(spark, sf_dir):
    v = F.col("vec_id")
    asked = fx.table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.when(v % 3 == 0, "?").otherwise("what?").alias("question"),
        F.when(v % 5 == 0, 11).when(v % 5 == 1, F.lit(None)).otherwise(3).alias("top_k"),
        F.when(v % 7 == 0, 1.5).when(v % 7 == 1, F.lit(None)).otherwise(0.4).alias("threshold"),
    )
    return quality.validate_rows(asked, quality.retrieval_rules()).select("vec_id", F.array_join("errors", ",").alias("errors"))


@query("val_5_decision_requests", """
    SELECT event_id, concat_ws(',', CASE WHEN NOT (value - 50 BETWEEN -20 AND 60) THEN 'temperature_c' END,
      CASE WHEN event_id % 13 > 10 OR event_id % 13 = 0 THEN 'max_alternatives' END) AS errors FROM events""")
def decision_requests(spark, sf_dir):
    n = F.col("event_id") % 13
    asked = fx.table(spark, sf_dir, "events").select(
        "event_id", (F.col("value") - 50).alias("temperature_c"),
        F.when(n == 5, F.lit(None)).otherwise(n).alias("max_alternatives"),
    )
    return quality.validate_rows(asked, quality.decision_rules()).select("event_id", F.array_join("errors", ",").alias("errors"))


def report_sql(rows: str, columns: list[str]) -> str:
    """The quality report of a table, its nulls counted over ``columns``."""
    nulls = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in columns)
    return f"""report AS (
      SELECT count(*) AS total_rows, count(DISTINCT station_id) AS unique_stations, min("timestamp") AS min_timestamp,
        max("timestamp") AS max_timestamp, {nulls} AS null_values,
        count(*) FILTER (NOT occupancy_rate BETWEEN 0 AND 1) AS target_out_of_range,
        count(*) FILTER (occupied_slots < 0 OR occupied_slots > total_slots) AS invalid_slots,
        count(*) - count(DISTINCT station_id || CAST("timestamp" AS VARCHAR)) AS duplicate_rows,
        count(*) FILTER (abs(lag_1h - previous) > CAST(0.00001 AS DOUBLE)) AS lag_mismatches,
        count(*) FILTER ("timestamp" < arrived_before) AS order_violations
      FROM (SELECT *, lag(occupancy_rate) OVER (PARTITION BY station_id ORDER BY "timestamp", occupancy_rate, lag_1h) AS previous,
        lag("timestamp") OVER (PARTITION BY station_id ORDER BY seq) AS arrived_before FROM {rows}))
    SELECT *, concat_ws(',', {", ".join(f"CASE WHEN {c} > 0 THEN '{c}' END" for c in quality.CHECKS)}) AS failed_checks,
      {" + ".join(quality.CHECKS)} = 0 AS is_valid FROM report"""


def arrival():
    """An arrival sequence: twice the hours since 1970."""
    return F.floor(F.unix_timestamp(F.col("timestamp").cast("timestamp")) / 3600) * 2


_ARRIVAL = """CAST(epoch("timestamp") // 3600 * 2 AS BIGINT)"""


@query("val_6_dataset_report", f"WITH arrived AS (SELECT *, {_ARRIVAL} AS seq FROM featured), " + report_sql("arrived", [
    "station_id", "occupancy_rate", "temperature_c", "lag_1h", "lag_24h", "lag_168h", "rolling_mean_6h", "rolling_mean_24h", "rolling_std_24h"]))
def dataset_report(spark, sf_dir):
    rows = training.build_training_features(fx.hourly(spark, sf_dir))
    return quality.dataset_report(rows.withColumn("seq", arrival()), "seq", block=1_000)


@query("val_6_dataset_report_dirty", f"""
    WITH hot AS (SELECT station_id, "timestamp", occupancy_rate + CASE WHEN day("timestamp") = 7 THEN 2 ELSE 0 END AS occupancy_rate,
        lag(occupancy_rate) OVER (PARTITION BY station_id ORDER BY "timestamp") + CASE WHEN day("timestamp") = 9 THEN 0.5 ELSE 0 END AS lag_1h,
        CASE WHEN day("timestamp") = 8 THEN -1 ELSE occupied_slots END AS occupied_slots, total_slots,
        {_ARRIVAL} + CASE WHEN day("timestamp") = 6 THEN 61 ELSE 0 END AS seq FROM hourly),
      dirty AS (SELECT * FROM hot UNION ALL SELECT * FROM hot WHERE day("timestamp") = 5),
      """ + report_sql("dirty", ["station_id", "occupancy_rate", "lag_1h", "occupied_slots", "total_slots"]))
def dataset_report_dirty(spark, sf_dir):
    """The report on data with doubled rows, missing and shifted lags, values out of range and a day that arrives late."""
    day = F.dayofmonth("timestamp")
    hot = fx.hourly(spark, sf_dir).withColumns({"lag_1h": windows.lag_columns()["lag_1h"]}).select(
        "station_id", "timestamp", (F.col("occupancy_rate") + F.when(day == 7, 2).otherwise(0)).alias("occupancy_rate"),
        (F.col("lag_1h") + F.when(day == 9, 0.5).otherwise(0.0)).alias("lag_1h"),
        F.when(day == 8, -1).otherwise(F.col("occupied_slots")).alias("occupied_slots"), "total_slots",
        (arrival() + F.when(day == 6, 61).otherwise(0)).alias("seq"),
    )
    return quality.dataset_report(hot.unionByName(hot.filter(day == 5)), "seq", block=1_000)


@query("val_7_leakage_guard", """
    SELECT count(*) AS n_rows, 16 AS n_features, count(*) FILTER (lag_1h IS NULL OR temperature_c IS NULL) AS incomplete FROM featured""")
def leakage_guard(spark, sf_dir):
    """Plan-time check of the inputs, then the rows that carry all of them."""
    features = training.build_training_features(fx.hourly(spark, sf_dir))
    columns = quality.check_features(features.columns)
    assert columns == FEATURE_COLS
    missing = F.exists(F.array(*[F.col(c).isNull() for c in columns]), lambda x: x)
    return features.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(columns)).alias("n_features"), F.count_if(missing).alias("incomplete")
    )


@query("val_8_split_disjoint", """
    SELECT min("timestamp") FILTER (split = 'train') AS train_min, max("timestamp") FILTER (split = 'train') AS train_max,
      min("timestamp") FILTER (split = 'val') AS val_min, max("timestamp") FILTER (split = 'val') AS val_max,
      min("timestamp") FILTER (split = 'test') AS test_min, max("timestamp") FILTER (split = 'test') AS test_max,
      max("timestamp") FILTER (split = 'train') < min("timestamp") FILTER (split = 'val')
        AND max("timestamp") FILTER (split = 'val') < min("timestamp") FILTER (split = 'test') AS disjoint FROM labelled""")
def split_disjoint(spark, sf_dir):
    features = training.build_training_features(fx.hourly(spark, sf_dir))
    return quality.splits_disjoint(windows.split_label(features, train=0.70, val=0.15, test=0.15))


@query("val_8_split_ranges", """
    SELECT split, count(*) AS n_rows, min("timestamp") AS min_ts, max("timestamp") AS max_ts FROM labelled GROUP BY split""")
def split_ranges(spark, sf_dir):
    features = training.build_training_features(fx.hourly(spark, sf_dir))
    return quality.split_ranges(windows.split_label(features, train=0.70, val=0.15, test=0.15))


@query("win_9_arrival_order", """
    WITH arrivals AS (SELECT station_id, ts + to_hours(CAST(CASE WHEN event_id % 17 = 0 THEN -48 ELSE 0 END AS BIGINT)) AS ts, event_id FROM located_events),
      steps AS (SELECT station_id, ts < lag(ts) OVER (PARTITION BY station_id ORDER BY event_id) AS back FROM arrivals)
    SELECT station_id, count(*) FILTER (back) AS violations FROM steps GROUP BY station_id""")
def arrival_order(spark, sf_dir):
    """Readings that arrive up to two days late, checked in blocks of the arrival sequence."""
    late = F.when(F.col("event_id") % 17 == 0, F.col("ts") - F.expr("interval 48 hours")).otherwise(F.col("ts"))
    arrivals = fx.with_station(spark, sf_dir, fx.table(spark, sf_dir, "events")).select(
        "station_id", late.alias("ts"), "event_id"
    )
    return quality.out_of_order(arrivals, "station_id", "ts", "event_id", block=1_000)
