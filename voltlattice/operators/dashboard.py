"""Operational tables: KPIs, profiles, pivots, leaderboards, top-N lists and filters.

Each is one partial+final aggregation; global maxima come in as scalar subqueries and
group keys that are NULL are left out.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voltlattice.functions.rounding import pround

EVENING = (18, 21)


def optional_filter(df: DataFrame, **wanted) -> DataFrame:
    """Conjunction of equality filters; ``None`` means no filter on that column."""
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def day_type_filter(sessions: DataFrame, day_type: str | None) -> DataFrame:
    if day_type == "weekday":
        return sessions.filter(~F.col("is_weekend"))
    if day_type == "weekend":
        return sessions.filter("is_weekend")
    return sessions


def grouped(df: DataFrame, *keys: str):
    return df.dropna(subset=list(keys)).groupBy(*keys)


def network_kpis(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count(F.lit(1)).alias("total_stations"),
        F.sum("occupied_slots").alias("active_sessions"),
        pround(F.avg("utilization_pct"), 1).alias("avg_utilization"),
        F.count_if(F.col("status") == "CRITICAL").alias("critical_stations"),
        F.count_if(F.col("available_slots") > 0).alias("available_stations"),
        pround(F.sum("current_load_kw"), 1).alias("total_load_kw"),
        pround(F.avg("estimated_wait_mins"), 1).alias("avg_wait_mins"),
    )


def dataset_summary(stations: DataFrame, sessions: DataFrame, status: DataFrame) -> DataFrame:
    evening = F.when(F.col("hour").between(*EVENING), F.col("wait_time_mins"))
    places = stations.agg(F.struct(
        F.count(F.lit(1)).alias("n_stations"),
        F.countDistinct("city").alias("n_cities"),
        F.countDistinct("operator").alias("n_operators"),
    ).alias("p")).scalar()
    use = sessions.agg(
        F.count(F.lit(1)).alias("n_sessions"),
        F.avg("wait_time_mins").alias("avg_wait"),
        F.avg(evening).alias("evening_wait"),
        F.sum("revenue_inr").alias("revenue"),
        F.avg("energy_kwh").alias("avg_kwh"),
    )
    now = status.agg(F.avg("utilization_pct").alias("u")).scalar()
    return use.withColumns({"_p": places, "avg_util": now}).select("_p.*", *use.columns, "avg_util")


def hourly_sessions(sessions: DataFrame) -> DataFrame:
    return grouped(sessions, "hour").agg(
        F.count("session_id").alias("sessions"), F.avg("wait_time_mins").alias("avg_wait")
    )


def mean_utilization(status: DataFrame, key: str) -> DataFrame:
    return grouped(status, key).agg(F.avg("utilization_pct").alias("avg_util"))


def status_counts(status: DataFrame) -> DataFrame:
    return grouped(status, "status").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "status")


def map_summary(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count(F.lit(1)).alias("stations_shown"),
        F.count_if(F.col("available_slots") > 0).alias("available"),
        F.avg("estimated_wait_mins").alias("avg_wait"),
        F.avg("utilization_pct").alias("avg_util"),
        F.avg("latitude").alias("center_lat"),
        F.avg("longitude").alias("center_lon"),
    )


def _scalar(df: DataFrame, aggregate: Column) -> Column:
    return df.agg(aggregate.alias("v")).scalar()


def hourly_profile(sessions: DataFrame) -> DataFrame:
    """Occupancy per hour relative to the busiest hour, with a spread band. At most 24 rows."""
    profile = grouped(sessions, "hour").agg(
        F.count("session_id").alias("n_sessions"),
        F.avg("wait_time_mins").alias("avg_wait"),
        F.coalesce(F.stddev_samp("wait_time_mins"), F.lit(2.0)).alias("std_wait"),
        F.avg("energy_kwh").alias("avg_energy"),
        F.avg("revenue_inr").alias("avg_revenue"),
    )
    # At most 24 rows reach this window.
    everything = W.partitionBy(F.lit(1))
    busiest = F.max("n_sessions").over(everything)
    mean_wait = F.avg("avg_wait").over(everything)
    band = F.col("std_wait") / (mean_wait + 1) * 0.12
    occupancy = F.col("n_sessions") / busiest
    one, zero = F.lit(1.0), F.lit(0.0)
    return profile.withColumn("occupancy", occupancy).withColumn("band", band).withColumns({
        "occ_upper": F.least(one, F.greatest(zero, F.col("occupancy") + F.col("band"))),
        "occ_lower": F.least(one, F.greatest(zero, F.col("occupancy") - F.col("band"))),
    }).drop("band")


def profile_insights(profile: DataFrame) -> DataFrame:
    """Peak hour and level, quietest hour (first on ties), and the evening share."""
    evening = F.when(F.col("hour").between(*EVENING), F.col("n_sessions")).otherwise(0)
    return profile.agg(
        F.max_by("hour", F.struct("occupancy", -F.col("hour"))).alias("peak_hour"),
        (F.max("occupancy") * 100).alias("peak_pct"),
        F.min_by("hour", F.struct("occupancy", "hour")).alias("low_hour"),
        (F.sum(evening) / F.sum("n_sessions") * 100).alias("evening_share"),
    )


def city_hour_pivot(sessions: DataFrame) -> DataFrame:
    """City by hour session counts with fixed columns h0..h23; no second pass to find them."""
    counts = [F.count_if(F.col("hour") == h).alias(f"h{h}") for h in range(24)]
    return grouped(sessions, "city").agg(*counts)


def revenue_by_city(sessions: DataFrame) -> DataFrame:
    return grouped(sessions, "city").agg(F.sum("revenue_inr").alias("revenue"))


def sessions_by_vehicle(sessions: DataFrame) -> DataFrame:
    return grouped(sessions, "vehicle_type").agg(F.count("session_id").alias("n"))


def operator_leaderboard(sessions: DataFrame, status: DataFrame, guard: bool = True) -> DataFrame:
    """Efficiency score and rank per operator.

    ``guard`` keeps the revenue share finite when no operator earned anything.
    """
    revenue = grouped(sessions, "operator").agg(F.sum("revenue_inr").alias("revenue"))
    use = grouped(status, "operator").agg(
        F.avg("utilization_pct").alias("avg_util"),
        F.count("station_id").alias("stations"),
        F.count_if(F.col("status") == "CRITICAL").alias("critical"),
    )
    board = use.join(revenue, "operator", "left").na.fill(0)
    best = F.max("revenue").over(W.partitionBy(F.lit(1)))  # one row per operator
    best = F.greatest(best, F.lit(1.0)) if guard else best
    score = (
        F.col("avg_util") * 0.5
        + F.col("revenue") / best * 100 * 0.4
        + (1 - F.col("critical") / F.greatest("stations", F.lit(1))) * 10
    )
    board = board.withColumn("efficiency_score", pround(score, 1))
    order = W.partitionBy(F.lit(1)).orderBy(F.desc("efficiency_score"), "operator")
    return board.withColumn("rank", F.row_number().over(order))


def expansion_matrix(sessions: DataFrame, stations: DataFrame) -> DataFrame:
    demand = grouped(sessions, "city").agg(
        F.count("session_id").alias("sessions"), F.avg("wait_time_mins").alias("avg_wait")
    )
    supply = grouped(stations, "city").agg(F.count("station_id").alias("n_stations"))
    return demand.join(supply, "city").withColumn(
        "sessions_per_station", pround(F.col("sessions") / F.col("n_stations"), 1)
    )


def user_segments(sessions: DataFrame) -> DataFrame:
    return grouped(sessions, "user_segment").agg(
        F.count("session_id").alias("sessions"),
        F.avg("revenue_inr").alias("avg_rev"),
        F.avg("wait_time_mins").alias("avg_wait"),
        F.avg("energy_kwh").alias("avg_kwh"),
    )


def session_minutes_per_type(sessions: DataFrame) -> DataFrame:
    return grouped(sessions, "charger_type").agg((F.avg(F.col("duration_hrs") * 60)).alias("avg_session_mins"))


def demand_proxy(sessions: DataFrame) -> DataFrame:
    """Wait time relative to the longest wait, clipped to [0, 1]."""
    longest = _scalar(sessions, F.max("wait_time_mins"))
    share = F.least(F.greatest(F.col("wait_time_mins") / longest, F.lit(0.0)), F.lit(1.0))
    return sessions.withColumn("demand_proxy", share)


def recent_sessions(sessions: DataFrame, n: int = 8) -> DataFrame:
    shown = sessions.orderBy(F.desc("start_time"), "session_id").limit(n)
    return shown.select(
        F.col("session_id").alias("Session"), F.col("city").alias("City"), F.col("operator").alias("Operator"),
        F.col("vehicle_type").alias("Vehicle"), F.col("energy_kwh").alias("Energy kWh"),
        F.col("wait_time_mins").alias("Wait min"), F.col("revenue_inr").alias("Revenue"),
        F.col("user_segment").alias("Segment"),
    )


def least_used(status: DataFrame, n: int = 5) -> DataFrame:
    return status.orderBy("utilization_pct", "station_id").limit(n).select(
        "station_id", "name", "city", "operator", "utilization_pct", "total_slots"
    )


def station_table(status: DataFrame) -> DataFrame:
    return status.select(
        "station_id", "name", "city", "operator", "charger_type", "available_slots", "total_slots",
        "estimated_wait_mins", "utilization_pct", "status", "current_load_kw",
    ).orderBy(F.desc("utilization_pct"), "station_id")


def alerts(status: DataFrame, n: int = 4) -> DataFrame:
    """First ``n`` critical and first ``n`` under-used (below 20 %) stations."""
    columns = ["station_id", "name", "city", "utilization_pct", "queue_length", "current_load_kw"]

    def first(kind, condition):
        return status.filter(condition).orderBy("station_id").limit(n).select(F.lit(kind).alias("kind"), *columns)

    return first("critical", F.col("status") == "CRITICAL").unionByName(
        first("underused", F.col("utilization_pct") < 20)
    )


def discovery_keys(by: str) -> list:
    """The order of station discovery: by distance, by availability status or by cost; ties by id."""
    status = F.col("status")
    level = F.when(status == "AVAILABLE", 0).when(status == "BUSY", 1).when(status == "RESERVED", 2)
    keys = {
        "distance": F.col("distance_km"),
        "availability": level.when(status == "FULL", 3).otherwise(4),
        "cost": F.col("cost_per_kwh"),
    }
    return [keys[by], F.col("station_id")]


def discovery_order(df: DataFrame, by: str) -> DataFrame:
    return df.orderBy(*discovery_keys(by))


def filter_options(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).dropna().distinct().orderBy(column)


def station_list(history: DataFrame) -> DataFrame:
    return filter_options(history, "station_id")


def history_bounds(history: DataFrame) -> DataFrame:
    return history.groupBy("station_id").agg(F.min("timestamp").alias("min_ts"), F.max("timestamp").alias("max_ts"))
