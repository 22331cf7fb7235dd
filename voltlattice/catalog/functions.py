"""Scalar expressions: ratios, bands, waits, economics and queue formulas."""

from pyspark.sql import functions as F

from voltlattice.catalog.registry import SESSION_MINUTES, band, d, query, rnd
from voltlattice.functions import occupancy as occ, queueing
from voltlattice.functions.rounding import pround
from voltlattice.plans import waiting
from voltlattice.sources import fixtures as fx


@query("prj_5_ratios", f"""
    SELECT station_id, "timestamp", {rnd("occupied_slots / total_slots", 4)} AS occupancy_rate,
      {rnd("occupied_slots / total_slots * 100", 1)} AS utilization_pct, total_slots - occupied_slots AS available FROM hourly""")
def ratios(spark, sf_dir):
    o, t = F.col("occupied_slots"), F.col("total_slots")
    return fx.hourly(spark, sf_dir).select(
        "station_id", "timestamp", occ.occupancy_rate(o, t).alias("occupancy_rate"),
        occ.utilization_pct(o, t).alias("utilization_pct"), (t - o).alias("available"),
    )


@query("prj_6_status_fraction", f"""SELECT station_id, "timestamp", {band("occupancy_rate")} AS status FROM hourly""")
def status_fraction(spark, sf_dir):
    return fx.hourly(spark, sf_dir).select("station_id", "timestamp", occ.status_band(F.col("occupancy_rate")).alias("status"))


@query("prj_7_status_percent", f"""
    SELECT station_id, "timestamp", {band(rnd("occupied_slots / total_slots * 100", 1), 100)} AS status FROM hourly""")
def status_percent(spark, sf_dir):
    pct = occ.utilization_pct(F.col("occupied_slots"), F.col("total_slots"))
    return fx.hourly(spark, sf_dir).select("station_id", "timestamp", occ.status_band(pct, 100.0).alias("status"))


_LOAD_MINUTES = (f"greatest({d(20)}, 60 / greatest(greatest({d(7.4)}, grid_load_kw / greatest(occupied_slots, 1)) / 22, {d(0.1)}))")


def _wait(minutes):
    return f"CASE WHEN total_slots - occupied_slots > 0 THEN {d(0)} ELSE {rnd(f'queue / greatest(total_slots, 1) * {minutes}', 1)} END"


@query("prj_8_snapshot_wait", f"""
    SELECT station_id, "timestamp", {_wait(SESSION_MINUTES)} AS by_type, {_wait(f"greatest({d(30)}, {d(1320)} / greatest(avg_power_kw, 1))")} AS by_power,
      {_wait(_LOAD_MINUTES)} AS by_load
    FROM (SELECT h.*, s.avg_power_kw, greatest(demand - h.total_slots, 0) AS queue FROM hourly h JOIN stations s USING (station_id))""")
def snapshot_wait(spark, sf_dir):
    power = fx.stations(spark, sf_dir).select("station_id", "avg_power_kw")
    df = fx.hourly(spark, sf_dir).join(power, "station_id")
    o, t = F.col("occupied_slots"), F.col("total_slots")
    queue = F.greatest(F.col("demand") - t, F.lit(0))
    minutes = {
        "by_type": occ.session_minutes_by_type(F.col("charger_type")),
        "by_power": occ.session_minutes_by_power(F.col("avg_power_kw")),
        "by_load": occ.session_minutes_by_load(F.col("grid_load_kw"), o),
    }
    return df.select(
        "station_id", "timestamp", *[occ.snapshot_wait(t - o, queue, t, m).alias(n) for n, m in minutes.items()]
    )


@query("prj_12_session_economics", f"""
    WITH e AS (SELECT session_id, greatest({d(0.5)}, ((60 + event_id % 41) - (5 + event_id % 76)) / 100 * {d(40)}) AS energy, energy_kwh, tariff_per_kwh
      FROM session_core JOIN stations USING (station_id))
    SELECT session_id, {rnd("energy", 8)} AS energy_needed, {rnd("energy / 50 * 60", 0)} AS charge_minutes,
      {rnd("energy * tariff_per_kwh + 2", 1)} AS cost, {rnd(f"energy_kwh * {d(0.82)}", 1)} AS co2_saved FROM e""")
def session_economics(spark, sf_dir):
    rows = fx.session_columns(fx.with_station(spark, sf_dir, fx.table(spark, sf_dir, "events")))
    rows = rows.join(fx.stations(spark, sf_dir).select("station_id", "tariff_per_kwh"), "station_id")
    n = F.col("event_id")
    rows = rows.withColumn("energy", occ.energy_needed(60 + n % 41, 5 + n % 76))
    return rows.select(
        "session_id", pround("energy", 8).alias("energy_needed"), occ.charge_minutes(F.col("energy")).alias("charge_minutes"),
        occ.session_cost(F.col("energy"), F.col("tariff_per_kwh")).alias("cost"), occ.co2_saved(F.col("energy_kwh")).alias("co2_saved"),
    )


@query("prj_15_derived_station_fields", f"""
    SELECT station_id, {rnd("len(string_split(amenities, ', ')) / 8 * 10", 1)} AS amenities_score, avg_power_kw >= 50 AS has_fast_charger FROM stations""")
def derived_station_fields(spark, sf_dir):
    return fx.stations(spark, sf_dir).select(
        "station_id", occ.amenities_score(F.col("amenities")).alias("amenities_score"),
        (F.col("avg_power_kw") >= 50).alias("has_fast_charger"),
    )


@query("prj_15_derived_session_fields", "SELECT session_id, end_time, revenue_inr, day_of_week, is_weekend FROM sessions")
def derived_session_fields(spark, sf_dir):
    return fx.sessions(spark, sf_dir).select("session_id", "end_time", "revenue_inr", "day_of_week", "is_weekend")


_ERLANG = """CASE WHEN rho >= 1 THEN 1 ELSE (pow(c * rho, c) / factorial(CAST(c AS INTEGER)) / (1 - rho))
      / (list_sum(list_transform(range(CAST(c AS BIGINT)), lambda k: pow(c * rho, k) / factorial(CAST(k AS INTEGER)))) + pow(c * rho, c) / factorial(CAST(c AS INTEGER)) / (1 - rho)) END"""


@query("fn_2_erlang_c", f"""
    WITH load AS (SELECT event_id, CAST(1 + event_id % 20 AS INTEGER) AS c, (event_id % 53) / 50 AS rho FROM events)
    SELECT event_id, c, {rnd(_ERLANG, 8)} AS p_wait FROM load""")
def erlang_c(spark, sf_dir):
    e = F.col("event_id")
    load = fx.table(spark, sf_dir, "events").select("event_id", (1 + e % 20).cast("int").alias("c"), (e % 53 / 50).alias("rho"))
    return load.select("event_id", "c", pround(queueing.erlang_c(F.col("c"), F.col("rho")), 8).alias("p_wait"))


PHYSICS = f"""
    per_type AS (SELECT charger_type, avg(duration_hrs * 60) AS mins FROM sessions GROUP BY charger_type),
    queues AS (SELECT h.station_id, h."timestamp", greatest(h.demand - 1, 0) AS q, s.total_slots AS c, coalesce(p.mins, {d(45)}) AS mins
      FROM hourly h JOIN stations s USING (station_id) LEFT JOIN per_type p ON p.charger_type = s.charger_type),
    rates AS (SELECT *, greatest(q / greatest(mins, 1), {d(0.01)}) AS lam FROM queues),
    loads AS (SELECT *, {d(1)} / greatest(mins, 1) AS mu, lam / (c * ({d(1)} / greatest(mins, 1))) AS rho FROM rates),
    waits AS (SELECT *, CASE WHEN rho >= {d(1)} - {d(1e-9)} OR q = 0 THEN q * mins / c
      ELSE greatest(0, {rnd(f"({_ERLANG}) / (c * mu * (1 - rho)) + q / lam", 1)}) END AS physics FROM loads)"""


def queues(spark, sf_dir):
    """A queue per station and hour: whoever is beyond the first car."""
    return fx.hourly(spark, sf_dir).select(
        "station_id", "timestamp", F.greatest(F.col("demand") - 1, F.lit(0)).alias("queue_length"),
        F.hour("timestamp").alias("hour"), "is_weekend",
    )


@query("fn_3_queue_wait", f"""WITH {PHYSICS} SELECT station_id, "timestamp", {rnd("physics", 8)} AS wait FROM waits""")
def queue_wait(spark, sf_dir):
    inputs = waiting.queue_inputs(queues(spark, sf_dir), fx.sessions(spark, sf_dir), fx.stations(spark, sf_dir))
    return waiting.physics_wait(inputs).select("station_id", "timestamp", pround("physics_wait", 8).alias("wait"))


@query("fn_4_wait_without_model", f"""
    WITH {PHYSICS} SELECT station_id, "timestamp", {rnd("physics", 1)} AS physics_estimate_mins, {rnd("physics", 1)} AS ml_estimate_mins,
      {rnd(f"{d(0.6)} * physics + {d(0.4)} * physics", 1)} AS final_estimate_mins, c AS total_slots FROM waits""")
def wait_without_model(spark, sf_dir):
    """Without a trained model the physics stands in for the learned part."""
    df = waiting.estimate_wait(queues(spark, sf_dir), fx.sessions(spark, sf_dir), fx.stations(spark, sf_dir))
    return df.select("station_id", "timestamp", "physics_estimate_mins", "ml_estimate_mins", "final_estimate_mins", "total_slots")


class _KnownWait:
    """Stands for a fitted correction whose values SQL can state: negative, missing for one charger type and without an hour."""

    ML = "CASE WHEN charger_type LIKE '%CHAdeMO%' OR hour % 6 = 5 THEN NULL ELSE queue_length * 4.5 + total_slots - hour END"

    def predict(self, rows):
        return rows.withColumn("ml_wait", F.expr(self.ML).cast("double"))


_LEARNED = f"CASE WHEN s.charger_type LIKE '%CHAdeMO%' OR hour(w.\"timestamp\") % 6 = 5 THEN NULL ELSE w.q * {d(4.5)} + w.c - hour(w.\"timestamp\") END"


@query("fn_4_learned_blend", f"""
    WITH {PHYSICS}, learned AS (SELECT w.*, {_LEARNED} AS ml FROM waits w JOIN stations s USING (station_id)),
      parts AS (SELECT *, CASE WHEN ml IS NULL THEN physics ELSE greatest({d(0)}, ml) END AS used FROM learned)
    SELECT station_id, "timestamp", {rnd("physics", 1)} AS physics_estimate_mins, {rnd("used", 1)} AS ml_estimate_mins,
      {rnd(f"{d(0.6)} * physics + {d(0.4)} * used", 1)} AS final_estimate_mins, c AS total_slots FROM parts""")
def learned_blend(spark, sf_dir):
    """The blend with learned waits that are negative, or missing for a category or an hour: those take the physics."""
    df = waiting.estimate_wait(queues(spark, sf_dir), fx.sessions(spark, sf_dir), fx.stations(spark, sf_dir), _KnownWait())
    return df.select("station_id", "timestamp", "physics_estimate_mins", "ml_estimate_mins", "final_estimate_mins", "total_slots")
