"""Hour spine, hourly bucketing of sessions, and the missing-hours report."""

from pyspark.sql import Column, DataFrame, functions as F

from voltlattice.functions import calendar as cal, occupancy as occ
from voltlattice.functions.rounding import pround
from voltlattice.session import spread


def hour_spine(stations: DataFrame, start: Column, end: Column) -> DataFrame:
    """Every station at every hour: a generator on the station row, not a join.

    Stations are few rows in few files, so they are dealt out first: otherwise the task that reads
    them would make, and aggregate, the hours of all of them.
    """
    hours = F.sequence(start, end, F.expr("interval 1 hour"))
    return spread(stations, "station_id").withColumn("timestamp", F.explode(hours))


def hours_covered(sessions: DataFrame) -> tuple[Column, Column]:
    """First and last starting hour, as scalar subqueries."""
    bounds = sessions.agg(
        cal.hour_of(F.min("start_time")).alias("first"), cal.hour_of(F.max("start_time")).alias("last")
    )
    return bounds.select("first").scalar(), bounds.select("last").scalar()


def active_hours(sessions: DataFrame, end: Column) -> DataFrame:
    """One row per hour a session occupies a slot, no later than ``end``.

    A session without an end, or with one before its start, counts in the hour it starts. Sessions may
    be one row group of one file, so they are dealt out first: otherwise the task that reads them would
    hold, and aggregate, the hours of all of them. The start is part of the key, so a hot station is spread too.
    """
    sessions = spread(sessions, "station_id", "start_time")
    first = cal.hour_of(F.col("start_time"))
    last = F.greatest(first, F.least(F.coalesce(cal.hour_of(F.col("end_time")), first), end))
    hours = F.sequence(first, last, F.expr("interval 1 hour"))
    return sessions.filter(first <= end).select("station_id", F.explode(hours).alias("timestamp"))


def irregular_sessions(sessions: DataFrame) -> DataFrame:
    """One row: sessions without an end, and sessions that end before they start."""
    return sessions.agg(
        F.count_if(F.col("end_time").isNull()).alias("open_sessions"),
        F.count_if(F.col("end_time") < F.col("start_time")).alias("reversed_sessions"),
    )


def demand_per_hour(sessions: DataFrame, stations: DataFrame) -> DataFrame:
    """Concurrent sessions per station and hour, zero-filled on the spine.

    The spine is added as zero rows before one partial+final aggregation, so a hot
    station is spread over its hours and the facts are shuffled once, pre-aggregated.
    """
    start, end = hours_covered(sessions)
    ones = active_hours(sessions, end).withColumn("n", F.lit(1))
    zeros = hour_spine(stations.select("station_id"), start, end).withColumn("n", F.lit(0))
    return ones.unionByName(zeros).groupBy("station_id", "timestamp").agg(F.sum("n").alias("demand"))


def hourly_history(sessions: DataFrame, stations: DataFrame, temperature: Column, holidays) -> DataFrame:
    """Dense hourly occupancy series per station, plus the demand behind it."""
    # Hashed by part: unhinted, Spark may take the hours of all stations for the smaller side and broadcast them, to one task here.
    meta = stations.select("station_id", "city", "charger_type", "total_slots", "avg_power_kw").hint("shuffle_hash")
    ts = F.col("timestamp")
    occupied = F.least(F.col("demand"), F.col("total_slots")).cast("int")
    return demand_per_hour(sessions, stations).join(meta, "station_id").select(
        "station_id", "timestamp", "city", "charger_type", "total_slots",
        occupied.alias("occupied_slots"),
        occ.occupancy_rate(occupied, F.col("total_slots")).alias("occupancy_rate"),
        pround(occupied * F.col("avg_power_kw") * 0.9, 2).alias("grid_load_kw"),
        temperature.alias("temperature_c"),
        cal.is_weekend(ts).alias("is_weekend"),
        cal.is_holiday(ts, holidays).alias("is_holiday"),
        F.col("demand").cast("int").alias("demand"),
    )


def status_snapshot(hourly: DataFrame, stations: DataFrame) -> DataFrame:
    """Status row per station at the newest hour of the history."""
    newest = hourly.agg(F.max("timestamp").alias("t")).select("t").scalar()
    now = hourly.filter(F.col("timestamp") == newest).select(
        "station_id", "occupied_slots", F.col("timestamp").alias("last_updated"),
        F.greatest(F.col("demand") - F.col("total_slots"), F.lit(0)).alias("queue_length"),
    )
    return derive_status(now.join(stations, "station_id"))


def derive_status(telemetry: DataFrame) -> DataFrame:
    """Stateless telemetry derivation, shared by batch and stream."""
    occupied, total = F.col("occupied_slots"), F.col("total_slots")
    utilization = occ.utilization_pct(occupied, total)
    wait = occ.snapshot_wait(
        total - occupied, F.col("queue_length"), total, occ.session_minutes_by_type(F.col("charger_type"))
    )
    return telemetry.select(
        "station_id", "name", "city", "operator", "charger_type", "total_slots",
        (total - occupied).alias("available_slots"), "occupied_slots", "queue_length",
        pround(occupied * F.col("avg_power_kw") * 0.9, 1).alias("current_load_kw"),
        wait.alias("estimated_wait_mins"), utilization.alias("utilization_pct"),
        occ.status_band(utilization, 100.0).alias("status"),
        "latitude", "longitude", "last_updated",
    )


def missing_hours(stations: DataFrame, history: DataFrame, start: Column, end: Column) -> DataFrame:
    """Spine hours without an observation."""
    spine = hour_spine(stations.select("station_id"), start, end)
    return spine.join(history.select("station_id", "timestamp"), ["station_id", "timestamp"], "left_anti")
