"""Operational tables, filters and top-N lists."""

import functools

from pyspark.sql import Window as W, functions as F

from voltlattice.catalog.registry import SQL, d, haversine, query, rnd
from voltlattice.functions import geo
from voltlattice.functions.rounding import pround
from voltlattice.operators import dashboard as dash, metrics, windows
from voltlattice.operators.forest import baseline_predict
from voltlattice.plans import network, training
from voltlattice.sources import fixtures as fx


def to_digits(df, digits, *columns):
    """Hide summation order in the last bits of means and sums."""
    return df.withColumns({c: pround(F.col(c), digits) for c in columns})


@query("agg_1_network_kpis", f"""
    SELECT count(*) AS total_stations, CAST(sum(occupied_slots) AS BIGINT) AS active_sessions,
      {rnd("avg(utilization_pct)", 1)} AS avg_utilization, count(*) FILTER (status.status = 'CRITICAL') AS critical_stations,
      count(*) FILTER (available_slots > 0) AS available_stations, {rnd("sum(current_load_kw)", 1)} AS total_load_kw,
      {rnd("avg(estimated_wait_mins)", 1)} AS avg_wait_mins FROM status""")
def network_kpis(spark, sf_dir):
    return dash.network_kpis(fx.status(spark, sf_dir))


@query("agg_2_dataset_summary", f"""
    SELECT (SELECT count(*) FROM stations) AS n_stations, (SELECT count(DISTINCT city) FROM stations) AS n_cities,
      (SELECT count(DISTINCT operator) FROM stations) AS n_operators, count(*) AS n_sessions, {rnd("avg(wait_time_mins)", 8)} AS avg_wait,
      {rnd("avg(wait_time_mins) FILTER (hour BETWEEN 18 AND 21)", 8)} AS evening_wait, {rnd("sum(revenue_inr)", 2)} AS revenue,
      {rnd("avg(energy_kwh)", 8)} AS avg_kwh, {rnd("(SELECT avg(utilization_pct) FROM status)", 8)} AS avg_util FROM sessions""")
def dataset_summary(spark, sf_dir):
    df = dash.dataset_summary(fx.stations(spark, sf_dir), fx.sessions(spark, sf_dir), fx.status(spark, sf_dir))
    return to_digits(to_digits(df, 8, "avg_wait", "evening_wait", "avg_kwh", "avg_util"), 2, "revenue")


@query("agg_3_hourly_sessions", f"""
    SELECT hour, count(*) AS sessions, {rnd("avg(wait_time_mins)", 8)} AS avg_wait FROM sessions GROUP BY hour""")
def hourly_sessions(spark, sf_dir):
    return to_digits(dash.hourly_sessions(fx.sessions(spark, sf_dir)), 8, "avg_wait")


@query("agg_4_city_utilization", f"""
    SELECT city, {rnd("avg(utilization_pct)", 8)} AS avg_util FROM status GROUP BY city ORDER BY avg_util, city""")
def city_utilization(spark, sf_dir):
    return to_digits(dash.mean_utilization(fx.status(spark, sf_dir), "city"), 8, "avg_util").orderBy("avg_util", "city")


@query("agg_5_operator_utilization", f"""
    SELECT operator, {rnd("avg(utilization_pct)", 8)} AS avg_util FROM status GROUP BY operator ORDER BY avg_util DESC, operator""")
def operator_utilization(spark, sf_dir):
    return to_digits(dash.mean_utilization(fx.status(spark, sf_dir), "operator"), 8, "avg_util").orderBy(
        F.desc("avg_util"), "operator"
    )


@query("agg_6_status_counts", "SELECT status, count(*) AS n FROM status GROUP BY status ORDER BY n DESC, status")
def status_counts(spark, sf_dir):
    return dash.status_counts(fx.status(spark, sf_dir))


@query("agg_7_map_summary", f"""
    SELECT count(*) AS stations_shown, count(*) FILTER (available_slots > 0) AS available, {rnd("avg(estimated_wait_mins)", 8)} AS avg_wait,
      {rnd("avg(utilization_pct)", 8)} AS avg_util, {rnd("avg(latitude)", 8)} AS center_lat, {rnd("avg(longitude)", 8)} AS center_lon
    FROM status WHERE charger_type = 'DC CCS2 (50 kW)'""")
def map_summary(spark, sf_dir):
    shown = dash.optional_filter(fx.status(spark, sf_dir), city=None, status=None, charger_type="DC CCS2 (50 kW)")
    return to_digits(dash.map_summary(shown), 8, "avg_wait", "avg_util", "center_lat", "center_lon")


PROFILE_SQL = f"""
    profile AS (SELECT hour, count(*) AS n_sessions, avg(wait_time_mins) AS avg_wait, coalesce(stddev_samp(wait_time_mins), {d(2)}) AS std_wait,
        avg(energy_kwh) AS avg_energy, avg(revenue_inr) AS avg_revenue FROM sessions GROUP BY hour),
    banded AS (SELECT *, n_sessions / (SELECT max(n_sessions) FROM profile) AS occupancy,
        std_wait / ((SELECT avg(avg_wait) FROM profile) + 1) * {d(0.12)} AS band FROM profile)"""


@query("agg_8_hourly_profile", f"""
    WITH {PROFILE_SQL}
    SELECT hour, n_sessions, {rnd("avg_wait", 8)} AS avg_wait, {rnd("std_wait", 8)} AS std_wait, {rnd("avg_energy", 8)} AS avg_energy,
      {rnd("avg_revenue", 8)} AS avg_revenue, {rnd("occupancy", 8)} AS occupancy,
      {rnd("least(1, greatest(0, occupancy + band))", 8)} AS occ_upper, {rnd("least(1, greatest(0, occupancy - band))", 8)} AS occ_lower FROM banded""")
def hourly_profile(spark, sf_dir):
    return to_digits(dash.hourly_profile(fx.sessions(spark, sf_dir)), 8, "avg_wait", "std_wait", "avg_energy",
                     "avg_revenue", "occupancy", "occ_upper", "occ_lower")


@query("agg_9_profile_insights", f"""
    WITH {PROFILE_SQL}
    SELECT (SELECT hour FROM banded ORDER BY occupancy DESC, hour LIMIT 1) AS peak_hour, max(occupancy) * 100 AS peak_pct,
      (SELECT hour FROM banded ORDER BY occupancy, hour LIMIT 1) AS low_hour,
      {rnd("sum(n_sessions) FILTER (hour BETWEEN 18 AND 21) / sum(n_sessions) * 100", 8)} AS evening_share FROM banded""")
def profile_insights(spark, sf_dir):
    return to_digits(dash.profile_insights(dash.hourly_profile(fx.sessions(spark, sf_dir))), 8, "evening_share")


_HOURS = ", ".join(f"count(*) FILTER (hour = {h}) AS h{h}" for h in range(24))


@query("agg_10_city_hour_pivot", f"SELECT city, {_HOURS} FROM sessions GROUP BY city")
def city_hour_pivot(spark, sf_dir):
    return dash.city_hour_pivot(fx.sessions(spark, sf_dir))


@query("agg_11_revenue_by_city", f"SELECT city, {rnd('sum(revenue_inr)', 2)} AS revenue FROM sessions GROUP BY city")
def revenue_by_city(spark, sf_dir):
    return to_digits(dash.revenue_by_city(fx.sessions(spark, sf_dir)), 2, "revenue")


@query("agg_11_sessions_by_vehicle", "SELECT vehicle_type, count(*) AS n FROM sessions GROUP BY vehicle_type")
def sessions_by_vehicle(spark, sf_dir):
    return dash.sessions_by_vehicle(fx.sessions(spark, sf_dir))


def _board_sql(best):
    return f"""
    WITH rev AS (SELECT operator, sum(revenue_inr) AS revenue FROM sessions GROUP BY operator),
      util AS (SELECT operator, avg(utilization_pct) AS avg_util, count(*) AS stations, count(*) FILTER (status.status = 'CRITICAL') AS critical
               FROM status GROUP BY operator),
      joined AS (SELECT util.*, coalesce(revenue, 0) AS revenue FROM util LEFT JOIN rev USING (operator)),
      scored AS (SELECT *, {rnd(f'''avg_util * {d(0.5)} + revenue / {best} * 100 * {d(0.4)}
          + (1 - critical / greatest(stations, 1)) * 10''', 1)} AS efficiency_score FROM joined)
    SELECT operator, {rnd("avg_util", 8)} AS avg_util, stations, critical, {rnd("revenue", 2)} AS revenue, efficiency_score,
      CAST(row_number() OVER (ORDER BY efficiency_score DESC, operator) AS INTEGER) AS rank FROM scored"""


@query("agg_12_leaderboard", _board_sql(f"greatest((SELECT max(revenue) FROM joined), {d(1)})"))
def leaderboard(spark, sf_dir):
    df = dash.operator_leaderboard(fx.sessions(spark, sf_dir), fx.status(spark, sf_dir))
    return to_digits(to_digits(df, 8, "avg_util"), 2, "revenue")


@query("agg_12_leaderboard_unguarded", _board_sql("(SELECT max(revenue) FROM joined)"))
def leaderboard_unguarded(spark, sf_dir):
    df = dash.operator_leaderboard(fx.sessions(spark, sf_dir), fx.status(spark, sf_dir), guard=False)
    return to_digits(to_digits(df, 8, "avg_util"), 2, "revenue")


@query("agg_13_expansion_matrix", f"""
    WITH dem AS (SELECT city, count(*) AS sessions, avg(wait_time_mins) AS avg_wait FROM sessions GROUP BY city),
      sup AS (SELECT city, count(*) AS n_stations FROM stations GROUP BY city)
    SELECT city, sessions, {rnd("avg_wait", 8)} AS avg_wait, n_stations, {rnd("sessions / n_stations", 1)} AS sessions_per_station
    FROM dem JOIN sup USING (city)""")
def expansion_matrix(spark, sf_dir):
    return to_digits(dash.expansion_matrix(fx.sessions(spark, sf_dir), fx.stations(spark, sf_dir)), 8, "avg_wait")


@query("agg_14_user_segments", f"""
    SELECT user_segment, count(*) AS sessions, {rnd("avg(revenue_inr)", 8)} AS avg_rev, {rnd("avg(wait_time_mins)", 8)} AS avg_wait,
      {rnd("avg(energy_kwh)", 8)} AS avg_kwh FROM sessions GROUP BY user_segment""")
def user_segments(spark, sf_dir):
    return to_digits(dash.user_segments(fx.sessions(spark, sf_dir)), 8, "avg_rev", "avg_wait", "avg_kwh")


@query("agg_15_session_minutes", f"""
    SELECT charger_type, {rnd("avg(duration_hrs * 60)", 8)} AS avg_session_mins FROM sessions GROUP BY charger_type""")
def session_minutes(spark, sf_dir):
    return to_digits(dash.session_minutes_per_type(fx.sessions(spark, sf_dir)), 8, "avg_session_mins")


@query("agg_16_demand_proxy", """
    SELECT session_id, least(greatest(wait_time_mins / (SELECT max(wait_time_mins) FROM sessions), 0), 1) AS demand_proxy FROM sessions""")
def demand_proxy(spark, sf_dir):
    return dash.demand_proxy(fx.sessions(spark, sf_dir)).select("session_id", "demand_proxy")


EXACT = (8, 8, 8)  # enough digits that summation order cannot show


def metric_sql(actual="occupancy_rate", predicted="predicted", digits=EXACT):
    sse = f"sum(pow({actual} - {predicted}, 2))"
    sst = f"(var_pop({actual}) * count(*))"
    return f"""{rnd(f"avg(abs({actual} - {predicted}))", digits[0])} AS mae, {rnd(f"sqrt(avg(pow({actual} - {predicted}, 2)))", digits[1])} AS rmse,
      {rnd(f"CASE WHEN count(*) < 2 THEN NULL WHEN {sst} = 0 THEN CASE WHEN {sse} = 0 THEN 1 ELSE 0 END ELSE 1 - {sse} / {sst} END", digits[2])} AS r2"""


def tested(spark, sf_dir):
    features = training.build_training_features(fx.hourly(spark, sf_dir))
    return baseline_predict(windows.split_label(features, train=0.70, val=0.15, test=0.15))


@query("agg_17_metrics", f"SELECT split, {metric_sql()} FROM labelled GROUP BY split")
def split_metrics(spark, sf_dir):
    return metrics.metrics(tested(spark, sf_dir), "predicted_occupancy", by=["split"], digits=EXACT)


@query("agg_18_error_slices", f"""
    SELECT 'city' AS dimension, city AS value, {metric_sql()} FROM labelled WHERE split = 'test' GROUP BY city
    UNION ALL SELECT 'hour', CAST(hour AS VARCHAR), {metric_sql()} FROM labelled WHERE split = 'test' GROUP BY hour
    UNION ALL SELECT 'charger_type', charger_type, {metric_sql()} FROM labelled WHERE split = 'test' GROUP BY charger_type""")
def error_slices(spark, sf_dir):
    return metrics.error_slices(tested(spark, sf_dir).filter("split = 'test'"), "predicted_occupancy", digits=EXACT)


@query("top_9_hours_by_error", f"""
    WITH h AS (SELECT hour, {metric_sql()} FROM labelled WHERE split = 'test' GROUP BY hour)
    SELECT 'worst' AS kind, * FROM (SELECT * FROM h ORDER BY mae DESC, hour LIMIT 5)
    UNION ALL SELECT 'best', * FROM (SELECT * FROM h ORDER BY mae, hour LIMIT 5)""")
def hours_by_error(spark, sf_dir):
    by_hour = metrics.metrics(tested(spark, sf_dir).filter("split = 'test'"), "predicted_occupancy", by=["hour"], digits=EXACT)
    worst = by_hour.orderBy(F.desc("mae"), "hour").limit(5).select(F.lit("worst").alias("kind"), "*")
    return worst.unionByName(by_hour.orderBy("mae", "hour").limit(5).select(F.lit("best").alias("kind"), "*"))


@query("agg_19_improvement", f"""
    WITH both_sides AS (SELECT *, CASE WHEN rolling_mean_24h IS NOT NULL THEN least(greatest(rolling_mean_24h, 0), 1) END AS second FROM labelled WHERE split = 'test'),
      m AS (SELECT {metric_sql(digits=(5, 5, 4)).replace(' AS mae', ' AS baseline_mae').replace(' AS rmse', ' AS baseline_rmse').replace(' AS r2', ' AS baseline_r2')},
        {metric_sql(predicted='second', digits=(5, 5, 4)).replace(' AS mae', ' AS model_mae').replace(' AS rmse', ' AS model_rmse').replace(' AS r2', ' AS model_r2')} FROM both_sides)
    SELECT *, {rnd("(baseline_mae - model_mae) / baseline_mae * 100", 2)} AS mae_improvement_pct,
      {rnd("(baseline_rmse - model_rmse) / baseline_rmse * 100", 2)} AS rmse_improvement_pct FROM m""")
def improvement(spark, sf_dir):
    """Improvement of a second predictor (the mean of the last day) over the baseline."""
    df = tested(spark, sf_dir).filter("split = 'test'").withColumn("second", F.col("rolling_mean_24h"))
    return metrics.compare_models(df, "predicted_occupancy", "second")


@query("agg_23_station_list", "SELECT DISTINCT station_id FROM hourly ORDER BY station_id")
def station_list(spark, sf_dir):
    return dash.station_list(fx.hourly(spark, sf_dir))


@query("agg_23_history_bounds", """
    SELECT station_id, min("timestamp") AS min_ts, max("timestamp") AS max_ts FROM hourly GROUP BY station_id""")
def history_bounds(spark, sf_dir):
    return dash.history_bounds(fx.hourly(spark, sf_dir))


@query("agg_23_filter_options", "SELECT DISTINCT charger_type FROM sessions ORDER BY charger_type")
def filter_options(spark, sf_dir):
    return dash.filter_options(fx.sessions(spark, sf_dir), "charger_type")


@query("flt_1_map_filters", """
    SELECT station_id, city, status, charger_type FROM status WHERE status.status = 'AVAILABLE' AND charger_type = 'AC Type 2 (22 kW)'""")
def map_filters(spark, sf_dir):
    return dash.optional_filter(
        fx.status(spark, sf_dir), city=None, status="AVAILABLE", charger_type="AC Type 2 (22 kW)"
    ).select("station_id", "city", "status", "charger_type")


@query("flt_2_session_filters", """
    SELECT session_id, city, charger_type, is_weekend FROM sessions WHERE city = 'NATION_7' AND charger_type = 'AC Type 2 (22 kW)' AND NOT is_weekend""")
def session_filters(spark, sf_dir):
    shown = dash.optional_filter(fx.sessions(spark, sf_dir), city="NATION_7", charger_type="AC Type 2 (22 kW)")
    return dash.day_type_filter(shown, "weekday").select("session_id", "city", "charger_type", "is_weekend")


@query("flt_3_alerts", """
    SELECT 'critical' AS kind, * FROM (SELECT station_id, name, city, utilization_pct, queue_length, current_load_kw FROM status
      WHERE status.status = 'CRITICAL' ORDER BY station_id LIMIT 4)
    UNION ALL SELECT 'underused', * FROM (SELECT station_id, name, city, utilization_pct, queue_length, current_load_kw FROM status
      WHERE utilization_pct < 20 ORDER BY station_id LIMIT 4)""")
def alerts(spark, sf_dir):
    return dash.alerts(fx.status(spark, sf_dir))


@query("top_1_recent_sessions", """
    SELECT session_id AS "Session", city AS "City", operator AS "Operator", vehicle_type AS "Vehicle", energy_kwh AS "Energy kWh",
      wait_time_mins AS "Wait min", revenue_inr AS "Revenue", user_segment AS "Segment"
    FROM sessions ORDER BY start_time DESC, session_id LIMIT 8""")
def recent_sessions(spark, sf_dir):
    return dash.recent_sessions(fx.sessions(spark, sf_dir))


@query("top_2_least_used", """
    SELECT station_id, name, city, operator, utilization_pct, total_slots FROM status ORDER BY utilization_pct, station_id LIMIT 5""")
def least_used(spark, sf_dir):
    return dash.least_used(fx.status(spark, sf_dir))


@query("top_3_station_table", """
    SELECT station_id, name, city, operator, charger_type, available_slots, total_slots, estimated_wait_mins, utilization_pct, status,
      current_load_kw FROM status ORDER BY utilization_pct DESC, station_id""")
def station_table(spark, sf_dir):
    return dash.station_table(fx.status(spark, sf_dir))


_DISCOVERY = """
    places AS (SELECT station_id, stations.city AS city, stations.tariff_per_kwh AS cost_per_kwh, CASE WHEN utilization_pct >= 95 THEN 'CLOSED' WHEN utilization_pct >= 90 THEN 'FULL'
        WHEN utilization_pct >= 70 THEN 'BUSY' WHEN utilization_pct >= 40 THEN 'RESERVED' ELSE 'AVAILABLE' END AS status,
        {km} AS distance_km FROM stations JOIN status USING (station_id))"""


@query("top_8_discovery_order", f"""
    WITH {_DISCOVERY.format(km=rnd(haversine(d(-40), d(-60), "stations.latitude", "stations.longitude"), 2))},
      leveled AS (SELECT *, CASE places.status WHEN 'AVAILABLE' THEN 0 WHEN 'BUSY' THEN 1 WHEN 'RESERVED' THEN 2 WHEN 'FULL' THEN 3 ELSE 4 END AS lvl FROM places)
    SELECT 'availability' AS sorted_by, CAST(row_number() OVER (PARTITION BY city ORDER BY lvl, station_id) AS INTEGER) AS place, station_id, city, leveled.status AS status, distance_km, cost_per_kwh FROM leveled
    UNION ALL SELECT 'distance', CAST(row_number() OVER (PARTITION BY city ORDER BY distance_km, station_id) AS INTEGER), station_id, city, leveled.status, distance_km, cost_per_kwh FROM leveled
    UNION ALL SELECT 'cost', CAST(row_number() OVER (PARTITION BY city ORDER BY cost_per_kwh, station_id) AS INTEGER), station_id, city, leveled.status, distance_km, cost_per_kwh FROM leveled""")
def discovery_order(spark, sf_dir):
    """All stations in each of the three orders, with the place they have in it in their city."""
    u = F.col("utilization_pct")
    cost = fx.stations(spark, sf_dir).select("station_id", F.col("tariff_per_kwh").alias("cost_per_kwh"))
    shown = fx.status(spark, sf_dir).join(cost, "station_id").select(
        "station_id", "city", "cost_per_kwh",
        F.when(u >= 95, "CLOSED").when(u >= 90, "FULL").when(u >= 70, "BUSY").when(u >= 40, "RESERVED").otherwise("AVAILABLE").alias("status"),
        pround(geo.haversine_km(F.lit(-40.0), F.lit(-60.0), F.col("latitude"), F.col("longitude")), 2).alias("distance_km"))
    placed = [shown.select(F.lit(by).alias("sorted_by"), F.row_number().over(W.partitionBy("city").orderBy(*dash.discovery_keys(by))).alias("place"), "*")
              for by in ("availability", "distance", "cost")]
    return functools.reduce(lambda a, b: a.unionByName(b), placed)


# Each dashboard table: the query that states it in SQL, its key columns, and its other columns with the
# digits that their values are shown to (None: as they are).
_HOUR_COLUMNS = {f"h{h}": None for h in range(24)}
DASHBOARD = {
    "kpis": ("agg_1_network_kpis", [], {"total_stations": None, "active_sessions": None, "avg_utilization": 1, "critical_stations": None,
                                        "available_stations": None, "total_load_kw": 1, "avg_wait_mins": 1}),
    "summary": ("agg_2_dataset_summary", [], {"n_stations": None, "n_cities": None, "n_operators": None, "n_sessions": None, "avg_wait": 8,
                                              "evening_wait": 8, "revenue": 2, "avg_kwh": 8, "avg_util": 8}),
    "hourly_sessions": ("agg_3_hourly_sessions", ["hour"], {"sessions": None, "avg_wait": 8}),
    "city_utilization": ("agg_4_city_utilization", ["city"], {"avg_util": 8}),
    "operator_utilization": ("agg_5_operator_utilization", ["operator"], {"avg_util": 8}),
    "status_counts": ("agg_6_status_counts", ["status"], {"n": None}),
    "map_summary": ("", [], {"stations_shown": None, "available": None, "avg_wait": 8, "avg_util": 8, "center_lat": 8, "center_lon": 8}),
    "hourly_profile": ("agg_8_hourly_profile", ["hour"], {"n_sessions": None, "avg_wait": 8, "std_wait": 8, "avg_energy": 8, "avg_revenue": 8,
                                                          "occupancy": 8, "occ_upper": 8, "occ_lower": 8}),
    "profile_insights": ("agg_9_profile_insights", [], {"peak_hour": None, "peak_pct": 8, "low_hour": None, "evening_share": 8}),
    "city_hour": ("agg_10_city_hour_pivot", ["city"], _HOUR_COLUMNS),
    "revenue_by_city": ("agg_11_revenue_by_city", ["city"], {"revenue": 2}),
    "sessions_by_vehicle": ("agg_11_sessions_by_vehicle", ["vehicle_type"], {"n": None}),
    "leaderboard": ("agg_12_leaderboard", ["operator"], {"avg_util": 8, "stations": None, "critical": None, "revenue": 2, "efficiency_score": 1, "rank": None}),
    "expansion": ("agg_13_expansion_matrix", ["city"], {"sessions": None, "avg_wait": 8, "n_stations": None, "sessions_per_station": 1}),
    "segments": ("agg_14_user_segments", ["user_segment"], {"sessions": None, "avg_rev": 8, "avg_wait": 8, "avg_kwh": 8}),
    "recent_sessions": ("top_1_recent_sessions", ["Session"], {"City": None, "Operator": None, "Vehicle": None, "Energy kWh": 6, "Wait min": 6,
                                                               "Revenue": 2, "Segment": None}),
    "least_used": ("top_2_least_used", ["station_id"], {"name": None, "city": None, "operator": None, "utilization_pct": 1, "total_slots": None}),
    "station_table": ("top_3_station_table", ["station_id"], {"name": None, "city": None, "operator": None, "charger_type": None, "available_slots": None,
                                                              "total_slots": None, "estimated_wait_mins": 1, "utilization_pct": 1, "status": None, "current_load_kw": 1}),
    "alerts": ("flt_3_alerts", ["kind", "station_id"], {"name": None, "city": None, "utilization_pct": 1, "queue_length": None, "current_load_kw": 1}),
}


def _long_sql(name):
    source, keys, columns = DASHBOARD[name]
    sql = SQL[source] if source else SQL["agg_7_map_summary"].split("WHERE charger_type = 'DC CCS2 (50 kW)'")[0]
    key = " || '/' || ".join(f'CAST("{k}" AS VARCHAR)' for k in keys) or "''"
    values = ", ".join(f"""{{'c': '{c}', 'v': {f"printf('%.{n}f', \"{c}\")" if n is not None else f'CAST("{c}" AS VARCHAR)'}}}""" for c, n in columns.items())
    return f"""SELECT '{name}' AS name, row_key, u.c AS "column", u.v AS "value" FROM (SELECT {key} AS row_key, unnest([{values}]) AS u FROM ({sql}))"""


def _long(name, table):
    """A table as (name, row_key, column, value) rows."""
    _, keys, columns = DASHBOARD[name]
    key = F.concat_ws("/", *(F.col(f"`{k}`").cast("string") for k in keys)) if keys else F.lit("")

    def shown(c, digits):
        value = F.col(f"`{c}`")
        if digits is None:
            return value.cast("string")
        return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", pround(value, digits)))

    cells = F.array(*(F.struct(F.lit(c).alias("column"), shown(c, digits).alias("value")) for c, digits in columns.items()))
    return table.select(F.lit(name).alias("name"), key.alias("row_key"), F.inline(cells))


@query("job_9_dashboard", " UNION ALL ".join(_long_sql(name) for name in DASHBOARD))
def dashboard_tables(spark, sf_dir):
    """Every value of every dashboard table, in long form."""
    tables = network.network_dashboard(fx.stations(spark, sf_dir), fx.sessions(spark, sf_dir), fx.status(spark, sf_dir))
    return functools.reduce(lambda a, b: a.unionByName(b), (_long(name, tables[name]) for name in DASHBOARD))


@query("job_9_dashboard_values", """
    SELECT name, count(DISTINCT row_key) AS n, count("value") AS n_values, bit_xor(CAST('0x' || substr(md5(name || '|' || row_key || '|' || "column" || '|' || coalesce("value", '')), 1, 15) AS BIGINT)) AS digest
    FROM (""" + " UNION ALL ".join(_long_sql(name) for name in DASHBOARD) + ") GROUP BY name")
def dashboard_values(spark, sf_dir):
    """Rows of every dashboard table, and a digest of all its values that doesn't depend on their order."""
    cell = F.concat_ws("|", "name", "row_key", "column", F.coalesce("value", F.lit("")))
    digest = F.conv(F.substring(F.md5(cell.cast("binary")), 1, 15), 16, 10).cast("long")
    return dashboard_tables(spark, sf_dir).groupBy("name").agg(
        F.countDistinct("row_key").alias("n"), F.count("value").alias("n_values"), F.bit_xor(digest).alias("digest"))
