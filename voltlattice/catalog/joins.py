"""Dimension joins, candidate pools, decisions, radius joins and recommendations."""

from pyspark.sql import functions as F

from voltlattice.catalog.registry import band, d, haversine, query, rnd, standard, text_list
from voltlattice.functions import occupancy as occ, scoring
from voltlattice.functions.rounding import pround
from voltlattice.operators import boosting, dashboard as dash, ranking
from voltlattice.plans import decision, recommendation
from voltlattice.session import materialize
from voltlattice.sources import fixtures as fx


@query("jn_1_sessions_stations", """
    SELECT c.session_id, c.station_id, c.city, s.city AS station_city, s.charger_type AS station_charger_type, s.total_slots, s.avg_power_kw
    FROM sessions c LEFT JOIN stations s USING (station_id)""")
def sessions_stations(spark, sf_dir):
    return boosting.sessions_with_stations(fx.sessions(spark, sf_dir), fx.stations(spark, sf_dir)).select(
        "session_id", "station_id", "city", "station_city", "station_charger_type", "total_slots", "avg_power_kw"
    )


@query("jn_2_status_details", """
    SELECT t.station_id, t.utilization_pct, s.amenities_score, s.tariff_per_kwh, s.is_24x7, s.has_fast_charger
    FROM status t LEFT JOIN stations s USING (station_id)""")
def status_details(spark, sf_dir):
    return recommendation.status_with_details(fx.status(spark, sf_dir), fx.stations(spark, sf_dir)).select(
        "station_id", "utilization_pct", "amenities_score", "tariff_per_kwh", "is_24x7", "has_fast_charger"
    )


@query("jn_3_aggregates_filled", f"""
    WITH u AS (SELECT operator, city, count(*) AS n FROM status GROUP BY operator, city),
      cells AS (SELECT u.*, vehicle_type FROM u, (SELECT DISTINCT vehicle_type FROM sessions))
    SELECT operator, city, vehicle_type, n, {rnd("coalesce(revenue, 0)", 2)} AS revenue
    FROM cells LEFT JOIN (SELECT operator, city, vehicle_type, sum(revenue_inr) AS revenue FROM sessions WHERE duration_hrs >= 7 GROUP BY ALL) USING (operator, city, vehicle_type)""")
def aggregates_filled(spark, sf_dir):
    """Stations of each operator and city, with the revenue of long sessions by vehicle; 0 where there is none."""
    sessions = fx.sessions(spark, sf_dir)
    revenue = dash.grouped(sessions.filter("duration_hrs >= 7"), "operator", "city", "vehicle_type").agg(F.sum("revenue_inr").alias("revenue"))
    counts = dash.grouped(fx.status(spark, sf_dir), "operator", "city").agg(F.count(F.lit(1)).alias("n"))
    vehicles = sessions.agg(F.collect_set("vehicle_type").alias("v")).scalar()  # one value for each kind of vehicle
    cells = counts.withColumn("vehicle_type", F.explode(vehicles))
    return cells.join(revenue, ["operator", "city", "vehicle_type"], "left").na.fill(0).withColumn("revenue", pround("revenue", 2))


@query("jn_4_aggregates_joined", """
    SELECT city, a.n AS sessions, b.n AS stations FROM (SELECT city, count(*) AS n FROM sessions GROUP BY city) a
    JOIN (SELECT city, count(*) AS n FROM stations GROUP BY city) b USING (city)""")
def aggregates_joined(spark, sf_dir):
    return dash.expansion_matrix(fx.sessions(spark, sf_dir), fx.stations(spark, sf_dir)).select(
        "city", "sessions", F.col("n_stations").alias("stations")
    )


@query("prj_9_charger_standard", f"SELECT station_id, charger_type, {standard('charger_type')} AS standard FROM stations")
def charger_standard(spark, sf_dir):
    return decision.with_standard(fx.stations(spark, sf_dir)).select("station_id", "charger_type", "standard")


STANDARDS = f"st AS (SELECT *, {standard('charger_type')} AS standard FROM stations)"


@query("jn_7_same_standard_peers", f"""
    WITH {STANDARDS} SELECT a.station_id, b.station_id AS peer_id, a.city, a.standard FROM st a JOIN st b ON a.city = b.city AND a.standard = b.standard AND a.station_id <> b.station_id""")
def same_standard_peers(spark, sf_dir):
    """Every pair of candidates: stations of the same city and standard."""
    return ranking.peers(decision.with_standard(fx.stations(spark, sf_dir)))


@query("jn_8_city_fallback", f"""
    WITH {STANDARDS} SELECT a.station_id, a.city FROM st a
    WHERE NOT EXISTS (SELECT 1 FROM st b WHERE b.city = a.city AND b.standard = a.standard AND b.station_id <> a.station_id)""")
def city_fallback(spark, sf_dir):
    """Stations without a same-standard peer look at their whole city."""
    pooled = ranking.pools(decision.with_standard(fx.stations(spark, sf_dir)))
    return pooled.filter(F.col("pool.standard") == ranking.ANY_STANDARD).select("station_id", "city")


DECIDED = f"""
    st AS (SELECT *, {standard('charger_type')} AS standard FROM stations),
    targets AS (SELECT c.request_id, c.ts, s.*, {rnd("least(greatest(lag_24h, 0), 1)", 4)} AS occ, least(greatest(lag_24h, 0), 1) AS raw
      FROM checked c JOIN st s USING (station_id) WHERE error_code IS NULL),
    predicted AS (SELECT a.station_id, a."timestamp" + INTERVAL 24 HOUR AS ts, {rnd("least(greatest(a.occupancy_rate, 0), 1)", 4)} AS occ,
        least(greatest(a.occupancy_rate, 0), 1) AS raw
      FROM hourly a JOIN hourly b ON b.station_id = a.station_id AND b."timestamp" = a."timestamp" - INTERVAL 144 HOUR
      JOIN hourly c ON c.station_id = a.station_id AND c."timestamp" = a."timestamp" + INTERVAL 23 HOUR),
    same AS (SELECT t.request_id, o.station_id AS cid FROM targets t JOIN st o ON o.city = t.city AND o.standard = t.standard AND o.station_id <> t.station_id),
    pairs AS (SELECT * FROM same UNION ALL
      SELECT t.request_id, o.station_id FROM targets t JOIN st o ON o.city = t.city AND o.station_id <> t.station_id
      WHERE t.request_id NOT IN (SELECT request_id FROM same)),
    measured AS (SELECT p.request_id, o.station_id, o.name, o.city, o.charger_type, q.occ AS predicted_occupancy, {band("q.raw")} AS status,
        t.occ AS target_occupancy, {rnd(haversine("t.latitude", "t.longitude", "o.latitude", "o.longitude"), 2)} AS distance_km
      FROM pairs p JOIN targets t USING (request_id) JOIN st o ON o.station_id = p.cid JOIN predicted q ON q.station_id = p.cid AND q.ts = t.ts),
    ordered AS (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY predicted_occupancy, distance_km, station_id) AS INTEGER) AS rank,
      {rnd("predicted_occupancy - target_occupancy", 4)} AS occupancy_delta, {rnd("target_occupancy - predicted_occupancy", 4)} AS occupancy_improvement
      FROM measured)"""
ALTERNATIVES = ["request_id", "rank", "station_id", "name", "city", "charger_type", "predicted_occupancy", "status", "distance_km",
                "target_occupancy", "occupancy_delta", "occupancy_improvement"]


def decided(spark, sf_dir):
    history = materialize(fx.hourly(spark, sf_dir), "history")
    return decision.decide(fx.requests(spark, sf_dir), fx.stations(spark, sf_dir), history)


@query("top_6_alternatives", f"WITH {DECIDED} SELECT {', '.join(ALTERNATIVES)} FROM ordered WHERE rank <= 3")
def alternatives(spark, sf_dir):
    return decided(spark, sf_dir)[1].select(*ALTERNATIVES)


def percent_sql(value):
    return f"printf('%.1f%%', {value} * 100)"


BETTER = f"predicted_occupancy < occ AND occ - predicted_occupancy >= {d(0.1)}"
_REASON = f"""CASE WHEN occ < {d(0.7)} THEN 'Selected station ' || t.station_id || ' has acceptable predicted occupancy (' || {percent_sql("occ")}
        || ' < 70% policy threshold). No rerouting required.'
      WHEN {BETTER} THEN 'Selected station ' || t.station_id || ' has high predicted occupancy (' || {percent_sql("occ")}
        || '). Recommended reroute to ' || b.station_id || ' in ' || t.city || ' with lower predicted occupancy (' || {percent_sql("predicted_occupancy")}
        || ', improvement: ' || {percent_sql("(occ - predicted_occupancy)")} || ' >= 10% policy threshold).'
      WHEN b.station_id IS NOT NULL THEN 'Selected station ' || t.station_id || ' has high predicted occupancy (' || {percent_sql("occ")}
        || '), but best alternative ' || b.station_id || ' offers insufficient occupancy improvement (' || {percent_sql("(occ - predicted_occupancy)")}
        || ' < 10% policy threshold).'
      ELSE 'No compatible candidate alternative stations found in ' || t.city || '.' END"""


@query("job_6_decide", f"""
    WITH {DECIDED}
    SELECT t.request_id, t.station_id, t.name, t.occ AS predicted_occupancy, {band("t.raw")} AS status,
      CASE WHEN occ < {d(0.7)} THEN 'STAY' WHEN {BETTER} THEN 'REROUTE' ELSE 'NO_BETTER_ALTERNATIVE' END AS recommendation,
      {_REASON} AS recommendation_reason, b.station_id AS best_station, b.distance_km AS best_km, b.occupancy_improvement AS improvement
    FROM targets t LEFT JOIN (SELECT * FROM ordered WHERE rank = 1) b USING (request_id)""")
def decide(spark, sf_dir):
    return decided(spark, sf_dir)[0].select(
        "request_id", "selected_station.station_id", "selected_station.name", "selected_station.predicted_occupancy",
        "selected_station.status", "recommendation", "recommendation_reason",
        F.col("top_alternative.station_id").alias("best_station"), F.col("top_alternative.distance_km").alias("best_km"),
        F.col("top_alternative.occupancy_improvement").alias("improvement"),
    )


_UNKNOWN = "station_id NOT IN (SELECT station_id FROM stations)"


@query("job_6_rejected", f"""
    SELECT * FROM (SELECT request_id, station_id,
        CASE WHEN {_UNKNOWN} THEN 'unknown_station' WHEN NOT temperature_c BETWEEN -20 AND 60 THEN 'invalid_temperature_c'
          WHEN NOT request_id % 12 BETWEEN 1 AND 10 THEN 'invalid_max_alternatives' ELSE error_code END AS error_code,
        CAST(CASE WHEN {_UNKNOWN} THEN 404 ELSE 422 END AS INTEGER) AS error_status FROM checked)
    WHERE error_code IS NOT NULL""")
def rejected_decisions(spark, sf_dir):
    """Requests that get no decision; 0 and 11 alternatives are rejected and not cut."""
    asked = fx.requests(spark, sf_dir).withColumn("max_alternatives", (F.col("request_id") % 12).cast("int"))
    return decision.rejected_requests(asked, fx.stations(spark, sf_dir), materialize(fx.hourly(spark, sf_dir), "history"))


@query("fn_7_decision_policy", f"""
    WITH {DECIDED}
    SELECT CASE WHEN occ < {d(0.7)} THEN 'STAY' WHEN {BETTER} THEN 'REROUTE' ELSE 'NO_BETTER_ALTERNATIVE' END AS recommendation, count(*) AS n
    FROM targets t LEFT JOIN (SELECT * FROM ordered WHERE rank = 1) b USING (request_id) GROUP BY 1""")
def decision_policy(spark, sf_dir):
    return decided(spark, sf_dir)[0].groupBy("recommendation").agg(F.count(F.lit(1)).alias("n"))


@query("fn_8_deltas", f"""
    WITH {DECIDED} SELECT request_id, rank, occupancy_delta, occupancy_improvement FROM ordered WHERE rank <= 3""")
def deltas(spark, sf_dir):
    return decided(spark, sf_dir)[1].select("request_id", "rank", "occupancy_delta", "occupancy_improvement")


@query("jn_13_valid_candidates", f"""
    WITH {DECIDED}, conditions AS (SELECT DISTINCT t.city, t.ts, c.temperature_c, c.is_holiday FROM targets t JOIN checked c USING (request_id))
    SELECT c.city, c.ts, c.temperature_c, CAST(c.is_holiday AS INTEGER) AS is_holiday, count(*) AS n_valid
    FROM conditions c JOIN st s USING (city) JOIN predicted q ON q.station_id = s.station_id AND q.ts = c.ts GROUP BY ALL""")
def valid_candidates(spark, sf_dir):
    """Candidates per city and condition that survive validation."""
    from voltlattice.operators.forest import baseline_predict
    from voltlattice.plans import serving

    places = decision.with_standard(fx.stations(spark, sf_dir)).select(
        "station_id", "name", "city", "standard", "charger_type", "latitude", "longitude"
    )
    history = materialize(fx.hourly(spark, sf_dir), "history")
    built = serving.valid(serving.build_request_features(fx.requests(spark, sf_dir), history))
    conditions = built.join(places.select("station_id", "city"), "station_id").select("city", *decision.CONDITION).distinct()
    scored = decision.score_candidates(materialize(conditions, "conditions"), places, history, baseline_predict)
    return scored.groupBy("city", *decision.CONDITION).agg(F.count(F.lit(1)).alias("n_valid"))


@query("set_2_candidate_union", f"""
    WITH {DECIDED} SELECT CASE WHEN request_id IN (SELECT request_id FROM same) THEN 'standard' ELSE 'city' END AS kind, count(DISTINCT request_id) AS n_requests
    FROM pairs GROUP BY 1""")
def candidate_union(spark, sf_dir):
    """Requests served by the same-standard pools and by the city fallback, as one union."""
    _, found = decided(spark, sf_dir)
    pooled = ranking.pools(decision.with_standard(fx.stations(spark, sf_dir)))
    own = fx.requests(spark, sf_dir).select("request_id", "station_id").join(pooled.select("station_id", "pool"), "station_id")
    # Read by both parts of the union.
    served_once = materialize(found.select("request_id").distinct(), "served")
    asked = own.join(served_once, "request_id", "left_semi")
    fallback = F.col("pool.standard") == ranking.ANY_STANDARD

    def served(kind, condition):
        return asked.filter(condition).agg(F.count(F.lit(1)).alias("n_requests")).select(F.lit(kind).alias("kind"), "n_requests")

    return served("standard", ~fallback).unionByName(served("city", fallback)).filter("n_requests > 0")


@query("fn_1_haversine", f"""
    SELECT u.request_id, s.station_id, {rnd(haversine("u.user_lat", "u.user_lon", "s.latitude", "s.longitude"), 4)} AS distance_km
    FROM users u JOIN customer c ON c.c_custkey = u.request_id JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN stations s ON s.city = n.n_name""")
def haversine_distance(spark, sf_dir):
    from voltlattice.functions import geo

    homes = fx.table(spark, sf_dir, "customer").join(
        fx.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(F.col("c_custkey").alias("request_id"), F.col("n_name").alias("city"))
    users = fx.users(spark, sf_dir).join(homes, "request_id").select("request_id", "city", "user_lat", "user_lon")
    stations = fx.stations(spark, sf_dir).select("station_id", "city", "latitude", "longitude")
    pairs = ranking.within_group(users, stations, "city")
    km = geo.haversine_km(F.col("user_lat"), F.col("user_lon"), F.col("latitude"), F.col("longitude"))
    return pairs.select("request_id", "station_id", pround(km, 4).alias("distance_km"))


@query("jn_9_radius_join", f"""
    SELECT request_id, station_id, {rnd("km", 4)} AS distance_km FROM (
      SELECT u.request_id, s.station_id, {haversine("u.user_lat", "u.user_lon", "s.latitude", "s.longitude")} AS km FROM users u, stations s)
    WHERE km <= 25""")
def radius_join(spark, sf_dir):
    return ranking.within_radius(fx.users(spark, sf_dir), fx.stations(spark, sf_dir), 25.0).select(
        "request_id", "station_id", pround("distance_km", 4).alias("distance_km")
    )


_DEFAULTS = text_list(scoring.DEFAULT_CHARGERS)


def _member(table, key, value, default):
    cases = " ".join(f"WHEN '{name}' THEN {text_list(items)}" for name, items in table.items())
    return f"list_contains(CASE {key} {cases} ELSE {text_list(default)} END, {value})"


@query("flt_4_vehicle_chargers", f"""
    SELECT session_id, vehicle_type, charger_type FROM sessions
    WHERE {_member(scoring.VEHICLE_CHARGERS, 'vehicle_type', 'charger_type', scoring.DEFAULT_CHARGERS)}""")
def vehicle_chargers(spark, sf_dir):
    return fx.sessions(spark, sf_dir).filter(
        scoring.compatible_charger(F.col("vehicle_type"), F.col("charger_type"))
    ).select("session_id", "vehicle_type", "charger_type")


@query("flt_5_vehicle_providers", f"""
    SELECT session_id, vehicle_type, ({text_list(scoring.PROVIDERS)})[CAST(event_id % 6 AS INTEGER) + 1] AS provider,
      {_member(scoring.VEHICLE_PROVIDERS, 'vehicle_type', f"({text_list(scoring.PROVIDERS)})[CAST(event_id % 6 AS INTEGER) + 1]", scoring.PROVIDERS)} AS is_compatible
    FROM session_core""")
def vehicle_providers(spark, sf_dir):
    rows = fx.session_columns(fx.with_station(spark, sf_dir, fx.table(spark, sf_dir, "events")))
    provider = fx.pick(scoring.PROVIDERS, F.col("event_id") % 6)
    return rows.select("session_id", "vehicle_type", provider.alias("provider")).withColumn(
        "is_compatible", scoring.compatible_provider(F.col("vehicle_type"), F.col("provider"))
    )


_RAW = {
    "proximity_score": "1 / (1 + distance_km)",
    "availability_score": "available_slots / greatest(total_slots, 1)",
    "wait_score": "1 / (1 + estimated_wait_mins)",
    "amenity_score": "amenities_score / 10",
    "cost_score": "1 / (1 + tariff_per_kwh)",
}
_SCALED = ", ".join(
    f"CASE WHEN max({c}) OVER p = min({c}) OVER p THEN {d(1)} ELSE ({c} - min({c}) OVER p) / (max({c}) OVER p - min({c}) OVER p) END AS {c}"
    for c in _RAW
)
RECOMMENDED = f"""
    near AS (SELECT * FROM (SELECT u.*, t.*, s.amenities_score, s.tariff_per_kwh,
        {haversine("u.user_lat", "u.user_lon", "t.latitude", "t.longitude")} AS distance_km
        FROM users u, status t JOIN stations s USING (station_id)) WHERE distance_km <= 25
        AND {_member(scoring.VEHICLE_CHARGERS, 'vehicle_type', 'charger_type', scoring.DEFAULT_CHARGERS)}),
    raw AS (SELECT *, {", ".join(f"{sql} AS {c}" for c, sql in _RAW.items())} FROM near),
    scaled AS (SELECT * EXCLUDE ({", ".join(_RAW)}), {_SCALED} FROM raw WINDOW p AS (PARTITION BY request_id)),
    final AS (SELECT *, {" + ".join(f"{d(scoring.WEIGHTS[n])} * {scoring.SCORES[n]}" for n in scoring.SCORES)} AS final_score FROM scaled),
    best AS (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY final_score DESC, station_id) AS INTEGER) AS rank FROM final)"""


def recommended(spark, sf_dir):
    return recommendation.recommend_stations(fx.users(spark, sf_dir), fx.status(spark, sf_dir), fx.stations(spark, sf_dir))


_SCORE_SQL = ", ".join(f"{rnd(c, 6)} AS {c}" for c in _RAW)


@query("fn_5_weighted_scores", f"""
    WITH {RECOMMENDED} SELECT request_id, station_id, {_SCORE_SQL}, {rnd("final_score", 6)} AS final_score FROM best WHERE rank <= 3""")
def weighted_scores(spark, sf_dir):
    df = recommended(spark, sf_dir)
    return df.select("request_id", "station_id", *[pround(c, 6).alias(c) for c in [*_RAW, "final_score"]])


@query("win_7_min_max", f"""
    WITH {RECOMMENDED} SELECT request_id, count(*) AS n, {rnd("min(proximity_score)", 6)} AS low, {rnd("max(proximity_score)", 6)} AS high FROM scaled GROUP BY request_id""")
def min_max(spark, sf_dir):
    """Scaled proximity per user spans 0 to 1, or is 1 where all candidates are alike."""
    users, status, stations = fx.users(spark, sf_dir), materialize(fx.status(spark, sf_dir), "status"), fx.stations(spark, sf_dir)

    def raw(asked):
        return recommendation.candidates(asked, status, stations, 25.0).withColumn("p", 1 / (1 + F.col("distance_km")))

    # The pairs are too many rows to sort for a window, so they are worked out twice and only the bounds move.
    bounds = raw(users).groupBy("request_id").agg(F.min("p").alias("_low"), F.max("p").alias("_high"))
    scaled = raw(materialize(recommendation.of_request(users, bounds), "bounds")).withColumn(
        "p", scoring.min_max(F.col("p"), F.col("_low"), F.col("_high")))
    return scaled.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n"), pround(F.min("p"), 6).alias("low"), pround(F.max("p"), 6).alias("high")
    )


@query("top_7_recommend", f"""
    WITH {RECOMMENDED} SELECT request_id, rank, station_id, {rnd("distance_km", 4)} AS distance_km, status FROM best WHERE rank <= 3""")
def recommend(spark, sf_dir):
    return recommended(spark, sf_dir).select(
        "request_id", "rank", "station_id", pround("distance_km", 4).alias("distance_km"), "status"
    )


@query("win_8_rank_in_request", f"""
    WITH {RECOMMENDED} SELECT request_id, max(rank) AS n_shown FROM best WHERE rank <= 3 GROUP BY request_id""")
def rank_in_request(spark, sf_dir):
    return recommended(spark, sf_dir).groupBy("request_id").agg(F.max("rank").alias("n_shown"))


_PHRASES = """concat_ws(' | ',
      CASE WHEN proximity_score >= CAST(0.7 AS DOUBLE) THEN printf('📍 Only %.1f km away', distance_km) END,
      CASE WHEN available_slots > 0 THEN printf('✅ %d slots available now', available_slots) END,
      CASE WHEN estimated_wait_mins <= 5 THEN '⚡ Near-zero wait time'
           WHEN wait_score >= CAST(0.6 AS DOUBLE) THEN printf('⏱️ Short wait: ~%.0f mins', estimated_wait_mins) END,
      CASE WHEN amenity_score >= CAST(0.7 AS DOUBLE) THEN '☕ High amenity score (cafe, WiFi, shade)' END)"""


@query("fn_6_explanations", f"""
    WITH {RECOMMENDED} SELECT request_id, rank, CASE WHEN {_PHRASES} = '' THEN 'Balanced score across all criteria' ELSE {_PHRASES} END AS explanation
    FROM best WHERE rank <= 3""")
def explanations(spark, sf_dir):
    return recommended(spark, sf_dir).select("request_id", "rank", "explanation")


@query("job_7_recommend_stations", f"""
    WITH {RECOMMENDED} SELECT request_id, rank, station_id, name, city, operator, charger_type, available_slots, estimated_wait_mins,
      current_load_kw, status, {rnd("final_score", 6)} AS final_score FROM best WHERE rank <= 3""")
def recommend_stations(spark, sf_dir):
    return recommended(spark, sf_dir).select(
        "request_id", "rank", "station_id", "name", "city", "operator", "charger_type", "available_slots",
        "estimated_wait_mins", "current_load_kw", "status", pround("final_score", 6).alias("final_score"),
    )
