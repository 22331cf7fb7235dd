"""All dashboard tables as named DataFrames over their three inputs, which are written once."""

from pyspark.sql import DataFrame

from voltlattice.operators import dashboard as d
from voltlattice.session import materialize


def network_dashboard(stations: DataFrame, sessions: DataFrame, status: DataFrame) -> dict[str, DataFrame]:
    # Nineteen tables read these; worked out anew for each, their joins would be as many broadcasts held by the driver.
    stations, sessions = materialize(stations, "dashboard-stations"), materialize(sessions, "dashboard-sessions")
    status = materialize(status, "dashboard-status")
    profile = d.hourly_profile(sessions)
    return {
        "kpis": d.network_kpis(status),
        "summary": d.dataset_summary(stations, sessions, status),
        "hourly_sessions": d.hourly_sessions(sessions).orderBy("hour"),
        "city_utilization": d.mean_utilization(status, "city").orderBy("avg_util", "city"),
        "operator_utilization": d.mean_utilization(status, "operator").sort("avg_util", ascending=False),
        "status_counts": d.status_counts(status),
        "map_summary": d.map_summary(status),
        "hourly_profile": profile,
        "profile_insights": d.profile_insights(profile),
        "city_hour": d.city_hour_pivot(sessions),
        "revenue_by_city": d.revenue_by_city(sessions),
        "sessions_by_vehicle": d.sessions_by_vehicle(sessions),
        "leaderboard": d.operator_leaderboard(sessions, status),
        "expansion": d.expansion_matrix(sessions, stations),
        "segments": d.user_segments(sessions),
        "recent_sessions": d.recent_sessions(sessions),
        "least_used": d.least_used(status),
        "station_table": d.station_table(status),
        "alerts": d.alerts(status),
    }
