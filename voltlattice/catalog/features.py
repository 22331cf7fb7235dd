"""Feature engineering, windows, serving features and the chronological split."""

from pyspark.sql import functions as F

from voltlattice.catalog.registry import clip, d, number_list, query, rnd
from voltlattice.functions import calendar as cal, occupancy as occ
from voltlattice.functions.rounding import pround
from voltlattice.operators import history as hist, spine, windows
from voltlattice.plans import serving, training
from voltlattice.sources import fixtures as fx

KEY = ["station_id", "timestamp"]


def rounded(df, keep, columns, digits=8):
    return df.select(*keep, *[pround(F.col(c), digits).alias(c) for c in columns])


@query("prj_1_calendar_parts", """
    SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
      CAST(month(ts) AS INTEGER) AS month FROM events""")
def calendar_parts(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select("event_id", *[
        c.alias(n) for n, c in cal.calendar_parts(F.col("ts")).items()
    ])


@query("prj_2_cyclical", f"""
    SELECT event_id, {rnd("sin(2 * pi() * hour(ts) / 24)", 8)} AS hour_sin, {rnd("cos(2 * pi() * hour(ts) / 24)", 8)} AS hour_cos,
      {rnd("sin(2 * pi() * (isodow(ts) - 1) / 7)", 8)} AS day_sin, {rnd("cos(2 * pi() * (isodow(ts) - 1) / 7)", 8)} AS day_cos FROM events""")
def cyclical(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select("event_id", *[
        pround(c, 8).alias(n) for n, c in cal.cyclical_parts(F.col("ts")).items()
    ])


@query("prj_3_flags", """
    SELECT station_id, "timestamp", CAST(is_weekend AS INTEGER) AS is_weekend, CAST(is_holiday AS INTEGER) AS is_holiday FROM hourly""")
def flags(spark, sf_dir):
    return fx.hourly(spark, sf_dir).select(
        *KEY, cal.flag(F.col("is_weekend")).alias("is_weekend"), cal.flag(F.col("is_holiday")).alias("is_holiday")
    )


@query("prj_4_holiday_lookup", f"""
    SELECT event_id, strftime(ts, '%Y-%m-%d') IN {tuple(fx.HOLIDAYS)} AS is_holiday FROM events""")
def holiday_lookup(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select(
        "event_id", cal.is_holiday(F.col("ts"), fx.HOLIDAYS).alias("is_holiday")
    )


@query("jn_11_hour_spine", """SELECT station_id, ts AS "timestamp" FROM spine""")
def hour_spine(spark, sf_dir):
    start, end = spine.hours_covered(fx.table(spark, sf_dir, "events").withColumnRenamed("ts", "start_time"))
    return spine.hour_spine(fx.stations(spark, sf_dir).select("station_id"), start, end)


@query("src_0_hourly_bucketing", """
    SELECT station_id, "timestamp", occupied_slots, occupancy_rate, grid_load_kw, temperature_c, is_weekend, is_holiday FROM hourly""")
def hourly_bucketing(spark, sf_dir):
    return fx.hourly(spark, sf_dir).select(
        *KEY, "occupied_slots", "occupancy_rate", "grid_load_kw", "temperature_c", "is_weekend", "is_holiday"
    )


@query("src_0_irregular_sessions", """
    WITH s AS (SELECT station_id, start_time, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 17 = 1 THEN start_time - INTERVAL 2 HOUR
        ELSE end_time END AS end_time FROM session_core),
      a AS (SELECT station_id, unnest(generate_series(date_trunc('hour', start_time), greatest(date_trunc('hour', start_time),
        least(coalesce(date_trunc('hour', end_time), date_trunc('hour', start_time)), (SELECT hi FROM covered))), INTERVAL 1 HOUR)) AS ts FROM s)
    SELECT p.station_id, p.ts AS "timestamp", count(a.ts) AS demand
    FROM spine p LEFT JOIN a ON a.station_id = p.station_id AND a.ts = p.ts GROUP BY ALL""")
def irregular_sessions(spark, sf_dir):
    """Hourly demand where some sessions have no end and some end before they start."""
    number, start = F.substring("session_id", 4, 9).cast("long") % 17, F.col("start_time")
    end = F.when(number == 0, None).when(number == 1, start - F.expr("INTERVAL 2 HOUR")).otherwise(F.col("end_time"))
    return spine.demand_per_hour(fx.sessions(spark, sf_dir).withColumn("end_time", end), fx.stations(spark, sf_dir))


@query("win_1_lags", """
    SELECT station_id, "timestamp", lag(occupancy_rate, 1) OVER w AS lag_1h, lag(occupancy_rate, 24) OVER w AS lag_24h,
      lag(occupancy_rate, 168) OVER w AS lag_168h FROM hourly WINDOW w AS (PARTITION BY station_id ORDER BY "timestamp")""")
def lags(spark, sf_dir):
    return fx.hourly(spark, sf_dir).select(*KEY, *[c.alias(n) for n, c in windows.lag_columns().items()])


def _rolling_sql(name, n, fn):
    return f"""
    SELECT station_id, "timestamp", {rnd(f"CASE WHEN count(occupancy_rate) OVER w = {n} THEN {fn}(occupancy_rate) OVER w END", 8)} AS {name}
    FROM hourly WINDOW w AS (PARTITION BY station_id ORDER BY "timestamp" ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"""


def _rolling(spark, sf_dir, *names):
    columns = windows.rolling_columns()
    return rounded(fx.hourly(spark, sf_dir).withColumns({n: columns[n] for n in names}), KEY, names)


@query("win_2_rolling_mean", f"""
    SELECT station_id, "timestamp",
      {rnd("CASE WHEN count(occupancy_rate) OVER a = 6 THEN avg(occupancy_rate) OVER a END", 8)} AS rolling_mean_6h,
      {rnd("CASE WHEN count(occupancy_rate) OVER b = 24 THEN avg(occupancy_rate) OVER b END", 8)} AS rolling_mean_24h
    FROM hourly WINDOW a AS (PARTITION BY station_id ORDER BY "timestamp" ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING),
      b AS (PARTITION BY station_id ORDER BY "timestamp" ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)""")
def rolling_mean(spark, sf_dir):
    return _rolling(spark, sf_dir, "rolling_mean_6h", "rolling_mean_24h")


@query("win_3_rolling_std", _rolling_sql("rolling_std_24h", 24, "stddev_samp"))
def rolling_std(spark, sf_dir):
    return _rolling(spark, sf_dir, "rolling_std_24h")


FEATURE_SQL = f"""
    SELECT station_id, "timestamp", hour, day_of_week, month, CAST(is_weekend AS INTEGER) AS is_weekend,
      CAST(is_holiday AS INTEGER) AS is_holiday, temperature_c, lag_1h, lag_24h, lag_168h,
      {rnd("sin(2 * pi() * hour / 24)", 8)} AS hour_sin, {rnd("cos(2 * pi() * hour / 24)", 8)} AS hour_cos,
      {rnd("sin(2 * pi() * day_of_week / 7)", 8)} AS day_sin, {rnd("cos(2 * pi() * day_of_week / 7)", 8)} AS day_cos,
      {rnd("rolling_mean_6h", 8)} AS rolling_mean_6h, {rnd("rolling_mean_24h", 8)} AS rolling_mean_24h,
      {rnd("rolling_std_24h", 8)} AS rolling_std_24h
    FROM featured"""
FEATURE_KEEP = [*KEY, "hour", "day_of_week", "month", "is_weekend", "is_holiday", "temperature_c", "lag_1h", "lag_24h", "lag_168h"]
FEATURE_ROUND = ["hour_sin", "hour_cos", "day_sin", "day_cos", "rolling_mean_6h", "rolling_mean_24h", "rolling_std_24h"]


@query("job_1_training_features", FEATURE_SQL)
def training_features(spark, sf_dir):
    return rounded(training.build_training_features(fx.hourly(spark, sf_dir)), FEATURE_KEEP, FEATURE_ROUND)


@query("job_1_training_features_blocked", FEATURE_SQL)
def training_features_blocked(spark, sf_dir):
    """The same features with each station's series cut into blocks of rows."""
    return rounded(training.build_training_features(fx.hourly(spark, sf_dir), block_rows=200), FEATURE_KEEP, FEATURE_ROUND)


@query("win_4_drop_incomplete", """
    SELECT station_id, count(*) AS n_rows, min("timestamp") AS first_ts FROM featured GROUP BY station_id""")
def drop_incomplete(spark, sf_dir):
    return training.build_training_features(fx.hourly(spark, sf_dir)).groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("timestamp").alias("first_ts")
    )


OBSERVED_SQL = """SELECT a.station_id, a.ts AS "timestamp", h.occupancy_rate
      FROM (SELECT DISTINCT station_id, ts FROM active) a JOIN hourly h ON h.station_id = a.station_id AND h."timestamp" = a.ts"""


def observed(spark, sf_dir):
    """History with gaps: only the hours in which a session was active."""
    return fx.hourly(spark, sf_dir).filter("demand > 0").select(*KEY, "occupancy_rate")


@query("win_5_time_true", f"""
    WITH gappy AS ({OBSERVED_SQL})
    SELECT station_id, "timestamp", max(occupancy_rate) OVER (w RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING) AS lag_1h,
      max(occupancy_rate) OVER (w RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 24 HOUR PRECEDING) AS lag_24h,
      max(occupancy_rate) OVER (w RANGE BETWEEN INTERVAL 168 HOUR PRECEDING AND INTERVAL 168 HOUR PRECEDING) AS lag_168h,
      {rnd("CASE WHEN count(*) OVER w6 = 6 THEN avg(occupancy_rate) OVER w6 END", 8)} AS rolling_mean_6h,
      {rnd("CASE WHEN count(*) OVER w24 = 24 THEN avg(occupancy_rate) OVER w24 END", 8)} AS rolling_mean_24h,
      {rnd("CASE WHEN count(*) OVER w24 = 24 THEN stddev_samp(occupancy_rate) OVER w24 END", 8)} AS rolling_std_24h
    FROM gappy WINDOW w AS (PARTITION BY station_id ORDER BY "timestamp"),
      w6 AS (PARTITION BY station_id ORDER BY "timestamp" RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING),
      w24 AS (PARTITION BY station_id ORDER BY "timestamp" RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING)""")
def time_true(spark, sf_dir):
    df = observed(spark, sf_dir).withColumns(windows.time_true_columns())
    return rounded(df, [*KEY, "lag_1h", "lag_24h", "lag_168h"], ["rolling_mean_6h", "rolling_mean_24h", "rolling_std_24h"])


@query("set_1_missing_hours", """
    SELECT p.station_id, p.ts AS "timestamp" FROM spine p
    WHERE NOT EXISTS (SELECT 1 FROM active a WHERE a.station_id = p.station_id AND a.ts = p.ts)""")
def missing_hours(spark, sf_dir):
    start, end = spine.hours_covered(fx.table(spark, sf_dir, "events").withColumnRenamed("ts", "start_time"))
    return spine.missing_hours(fx.stations(spark, sf_dir), observed(spark, sf_dir), start, end)


@query("win_6_chronological_split", """SELECT station_id, "timestamp", split FROM labelled""")
def chronological_split(spark, sf_dir):
    features = training.build_training_features(fx.hourly(spark, sf_dir))
    return windows.split_label(features, train=0.70, val=0.15, test=0.15).select(*KEY, "split")


@query("fn_17_baseline", f"""
    SELECT station_id, "timestamp", {clip("lag_24h", 0, 1)} AS predicted_occupancy FROM featured""")
def baseline(spark, sf_dir):
    from voltlattice.operators.forest import baseline_predict

    return baseline_predict(training.build_training_features(fx.hourly(spark, sf_dir))).select(*KEY, "predicted_occupancy")


@query("prj_14_expected_demand", f"""
    SELECT station_id, "timestamp", {rnd(clip(f'''(
        CASE WHEN is_weekend OR is_holiday THEN ({number_list(occ.DAY_OFF_DEMAND)})[CAST(hour("timestamp") AS INTEGER) + 1]
             ELSE ({number_list(occ.WORKDAY_DEMAND)})[CAST(hour("timestamp") AS INTEGER) + 1] END
        * coalesce(({number_list(fx.CITY_DEMAND.values())})[list_position({list(fx.CITY_DEMAND)}, city)], {d(1)})
        * ({number_list(occ.CHARGER_DEMAND.values())})[list_position({list(occ.CHARGER_DEMAND)}, charger_type)]
        * ({d(1)} + {d(0.003)} * greatest({d(0)}, temperature_c - 28)))''', 0.02, 0.98), 8)} AS expected FROM hourly""")
def expected_demand(spark, sf_dir):
    ts = F.col("timestamp")
    value = occ.expected_demand(
        F.hour(ts), F.col("is_weekend") | F.col("is_holiday"), F.col("city"), F.col("charger_type"),
        F.col("temperature_c"), fx.CITY_DEMAND,
    )
    return fx.hourly(spark, sf_dir).select(*KEY, pround(value, 8).alias("expected"))


def points(spark, sf_dir):
    return fx.requests(spark, sf_dir).withColumn("ts", cal.parse_naive(F.col("prediction_time")))


@query("jn_5_exact_time_lookup", """
    SELECT request_id, lag_1h, lag_24h, lag_168h FROM looked_up""")
def exact_time_lookup(spark, sf_dir):
    return hist.attach_history(points(spark, sf_dir), fx.hourly(spark, sf_dir)).select(
        "request_id", "lag_1h", "lag_24h", "lag_168h"
    )


@query("jn_6_window_lookup", f"""
    SELECT request_id, {rnd("rolling_mean_6h", 8)} AS rolling_mean_6h, {rnd("rolling_mean_24h", 8)} AS rolling_mean_24h,
      {rnd("rolling_std_24h", 8)} AS rolling_std_24h FROM looked_up""")
def window_lookup(spark, sf_dir):
    df = hist.attach_history(points(spark, sf_dir), fx.hourly(spark, sf_dir))
    return rounded(df, ["request_id"], ["rolling_mean_6h", "rolling_mean_24h", "rolling_std_24h"])


@query("job_2_request_features", f"""
    SELECT request_id, station_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
      CAST(month(ts) AS INTEGER) AS month, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend, CAST(is_holiday AS INTEGER) AS is_holiday,
      temperature_c, lag_1h, lag_24h, lag_168h, {rnd("rolling_mean_6h", 8)} AS rolling_mean_6h,
      {rnd("rolling_mean_24h", 8)} AS rolling_mean_24h, {rnd("rolling_std_24h", 8)} AS rolling_std_24h
    FROM checked WHERE error_code IS NULL""")
def request_features(spark, sf_dir):
    built = serving.build_request_features(fx.requests(spark, sf_dir), fx.hourly(spark, sf_dir))
    return rounded(
        serving.valid(built),
        ["request_id", "station_id", "hour", "day_of_week", "month", "is_weekend", "is_holiday", "temperature_c",
         "lag_1h", "lag_24h", "lag_168h"],
        ["rolling_mean_6h", "rolling_mean_24h", "rolling_std_24h"],
    )


@query("prj_10_context_labels", f"""
    SELECT request_id, CASE WHEN hour(ts) BETWEEN 7 AND 10 THEN 'morning peak (7–10 AM)'
        WHEN hour(ts) BETWEEN 12 AND 14 THEN 'midday period (12–2 PM)' WHEN hour(ts) BETWEEN 18 AND 21 THEN 'evening peak (6–9 PM)'
        WHEN hour(ts) BETWEEN 0 AND 5 THEN 'overnight off-peak (12–6 AM)' ELSE printf('hour %02d:00', hour(ts)) END AS time_period,
      CASE WHEN rolling_mean_24h >= {d(0.7)} THEN 'high' WHEN rolling_mean_24h >= {d(0.4)} THEN 'moderate' ELSE 'low' END AS recent_24h_trend,
      {rnd("lag_1h", 4)} AS context_lag_1h, {rnd("lag_24h", 4)} AS context_lag_24h, {rnd("lag_168h", 4)} AS context_lag_168h,
      {rnd("rolling_mean_24h", 4)} AS context_rolling_mean_24h, isodow(ts) >= 6 AS context_is_weekend,
      coalesce(is_holiday, FALSE) AS context_is_holiday
    FROM checked WHERE error_code IS NULL""")
def context_labels(spark, sf_dir):
    built = serving.build_request_features(fx.requests(spark, sf_dir), fx.hourly(spark, sf_dir))
    return serving.valid(built).withColumns(serving.context()).select(
        "request_id", *serving.context()
    )


@query("prj_11_key_features", f"""
    SELECT request_id, CAST(hour(ts) AS INTEGER) AS hour, lag_1h, lag_24h, lag_168h, {rnd("rolling_mean_24h", 8)} AS rolling_mean_24h,
      temperature_c FROM checked WHERE error_code IS NULL""")
def key_features(spark, sf_dir):
    built = serving.build_request_features(fx.requests(spark, sf_dir), fx.hourly(spark, sf_dir))
    keyed = serving.valid(built).select("request_id", serving.key_features()).select("request_id", "key_features.*")
    return keyed.withColumn("rolling_mean_24h", pround("rolling_mean_24h", 8))
