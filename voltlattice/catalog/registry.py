"""The query registry, and the SQL building blocks its counterparts share."""

import re

from voltlattice.sources import fixtures as fx

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``sql`` may use the common tables below by name."""
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = with_tables(sql)
        return fn
    return add


def d(number) -> str:
    """A number as a double literal."""
    return f"CAST({number} AS DOUBLE)"


def rnd(expression: str, digits: int) -> str:
    """Half-even rounding of the exact double value."""
    return f"(CAST(printf('%.{digits}f', CAST({expression} AS DOUBLE)) AS DOUBLE) + 0.0)"


def text_list(items) -> str:
    return "[" + ", ".join("'" + str(i) + "'" for i in items) + "]"


def number_list(items) -> str:
    return "[" + ", ".join(d(i) for i in items) + "]"


def pick(items: str, index: str) -> str:
    return f"({items})[CAST({index} AS INTEGER) + 1]"


def band(value: str, scale: int = 1) -> str:
    high, mid, low = (0.9, 0.7, 0.4) if scale == 1 else (90, 70, 40)
    return (f"CASE WHEN {value} >= {d(high)} THEN 'CRITICAL' WHEN {value} >= {d(mid)} THEN 'BUSY' "
            f"WHEN {value} >= {d(low)} THEN 'MODERATE' ELSE 'AVAILABLE' END")


def clip(value: str, low, high) -> str:
    return f"CASE WHEN {value} IS NOT NULL THEN least(greatest({value}, {d(low)}), {d(high)}) END"


def standard(value: str) -> str:
    return (f"CASE WHEN upper({value}) LIKE '%CCS2%' THEN 'CCS2' WHEN upper({value}) LIKE '%TYPE 2%' THEN 'TYPE 2' "
            f"WHEN upper({value}) LIKE '%CHADEMO%' THEN 'CHADEMO' ELSE upper({value}) END")


def haversine(lat1, lon1, lat2, lon2) -> str:
    a = (f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
         f"* pow(sin(radians({lon2} - {lon1}) / 2), 2)")
    return f"({d(6371)} * 2 * asin(sqrt(least({a}, {d(1)}))))"


def _place(key, n, lat_step, lon_step):
    return (rnd(f"-60 + {key} * 5 + (({n} * {lat_step}) % 101) * {d(0.002)}", 6),
            rnd(f"-150 + {key} * 12 + (({n} * {lon_step}) % 97) * {d(0.002)}", 6))


_LAT, _LON = _place("n_nationkey", "s_suppkey", 37, 53)
_ULAT, _ULON = _place("c_nationkey", "c_custkey", 29, 31)
_AMENITIES = (f"array_to_string(list_slice({text_list(fx.AMENITIES)}, 1 + s_suppkey % 4, "
              "s_suppkey % 4 + 2 + s_suppkey % 4), ', ')")
_MIDPOINTS = [(low + high) / 2 * 60 for low, high in fx.occ.SESSION_HOURS.values()]
SESSION_MINUTES = (
    f"coalesce({number_list(_MIDPOINTS)}[list_position({text_list(fx.CHARGERS)}, charger_type)], {d(_MIDPOINTS[0])})"
)
WAIT = f"CASE WHEN total_slots - occupied_slots > 0 THEN {d(0)} ELSE {rnd(f'queue_length / greatest(total_slots, 1) * {SESSION_MINUTES}', 1)} END"

# name -> SQL; a table may use those before it.
TABLES = {
    "station_count": "SELECT count(*) AS n FROM supplier",
    "stations": f"""
        SELECT 'STA' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS station_id, s_name AS name, n_name AS city,
          {_LAT} AS latitude, {_LON} AS longitude, CAST(1 + s_suppkey % 4 AS INTEGER) AS total_slots,
          {pick(text_list(fx.CHARGERS), 's_suppkey % 5')} AS charger_type,
          'Operator ' || CAST(s_suppkey % 8 + 1 AS VARCHAR) AS operator,
          {pick(number_list(fx.POWER_KW), 's_suppkey % 5')} AS avg_power_kw,
          CAST(2018 + s_suppkey % 7 AS INTEGER) AS installation_year, {_AMENITIES} AS amenities,
          {rnd("(2 + s_suppkey % 4) / 8 * 10", 1)} AS amenities_score,
          {rnd(f"12 + (s_suppkey % 11) * {d(0.73)}", 2)} AS tariff_per_kwh,
          s_suppkey % 3 <> 0 AS is_24x7, {pick(number_list(fx.POWER_KW), 's_suppkey % 5')} >= 50 AS has_fast_charger,
          CAST((s_suppkey % 4) * 10 AS INTEGER) AS parking_fee_per_hr
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "located_events": """
        SELECT e.*, 'STA' || lpad(CAST(user_id % (SELECT n FROM station_count) AS VARCHAR), 6, '0') AS station_id
        FROM events e""",
    "session_core": f"""
        SELECT event_id, 'SES' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS session_id, station_id,
          ts AS start_time, {d(0.25)} + (event_id % 29) * {d(0.25)} AS duration_hrs,
          ts + to_microseconds(CAST(900000000 * (1 + event_id % 29) AS BIGINT)) AS end_time,
          value / 10 AS energy_kwh, {pick(text_list(fx.VEHICLES), 'event_id % 10')} AS vehicle_type,
          dayname(ts) AS day_of_week, CAST(hour(ts) AS INTEGER) AS hour, isodow(ts) >= 6 AS is_weekend,
          CAST((event_id * 7) % 31 AS DOUBLE) AS wait_time_mins,
          {pick(text_list(fx.SEGMENTS), 'event_id % 4')} AS user_segment
        FROM located_events""",
    "sessions": f"""
        SELECT c.*, s.city, s.charger_type, s.operator, {rnd("c.energy_kwh * s.tariff_per_kwh", 2)} AS revenue_inr
        FROM session_core c JOIN stations s USING (station_id)""",
    "covered": "SELECT date_trunc('hour', min(ts)) AS lo, date_trunc('hour', max(ts)) AS hi FROM events",
    "active": """
        SELECT station_id, unnest(generate_series(date_trunc('hour', start_time),
          least(date_trunc('hour', end_time), (SELECT hi FROM covered)), INTERVAL 1 HOUR)) AS ts FROM session_core""",
    "demand": "SELECT station_id, ts, count(*) AS n FROM active GROUP BY ALL",
    "spine": """
        SELECT station_id, unnest(generate_series((SELECT lo FROM covered), (SELECT hi FROM covered), INTERVAL 1 HOUR)) AS ts
        FROM stations""",
    "hourly": f"""
        SELECT station_id, ts AS "timestamp", city, charger_type, total_slots, occupied_slots,
          {rnd("occupied_slots / total_slots", 4)} AS occupancy_rate,
          {rnd(f"occupied_slots * avg_power_kw * {d(0.9)}", 2)} AS grid_load_kw,
          {rnd(f"18 + 8 * sin(pi() * (hour(ts) - 9) / 12) + (day(ts) % 10) * {d(0.7)}", 1)} AS temperature_c,
          isodow(ts) >= 6 AS is_weekend, strftime(ts, '%Y-%m-%d') IN {tuple(fx.HOLIDAYS)} AS is_holiday, n AS demand
        FROM (SELECT p.station_id, p.ts, s.* EXCLUDE (station_id), CAST(coalesce(q.n, 0) AS INTEGER) AS n,
                CAST(least(coalesce(q.n, 0), s.total_slots) AS INTEGER) AS occupied_slots
              FROM spine p JOIN stations s USING (station_id) LEFT JOIN demand q ON q.station_id = p.station_id AND q.ts = p.ts)""",
    "newest": f"""
        SELECT h.station_id, h.occupied_slots, h."timestamp" AS last_updated,
          CAST(greatest(h.demand - h.total_slots, 0) AS INTEGER) AS queue_length
        FROM hourly h WHERE h."timestamp" = (SELECT hi FROM covered)""",
    "status": f"""
        SELECT station_id, name, city, operator, charger_type, total_slots, total_slots - occupied_slots AS available_slots,
          occupied_slots, queue_length, {rnd(f"occupied_slots * avg_power_kw * {d(0.9)}", 1)} AS current_load_kw,
          {WAIT} AS estimated_wait_mins, {rnd("occupied_slots / total_slots * 100", 1)} AS utilization_pct,
          {band(rnd("occupied_slots / total_slots * 100", 1), 100)} AS status, latitude, longitude, last_updated
        FROM newest JOIN stations USING (station_id)""",
    "requests": """
        SELECT event_id AS request_id, CASE WHEN event_id % 50 = 0 THEN 'STA_NONE' ELSE station_id END AS station_id,
          CASE WHEN event_id % 50 = 1 THEN 'not-a-time'
               WHEN event_id % 50 = 2 THEN substr(strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S'), 1, 14) || '30:00'
               WHEN event_id % 50 = 4 THEN strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') || '+05:30'
               ELSE strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') END AS prediction_time,
          CASE WHEN event_id % 50 = 3 THEN 75.0 ELSE 15.0 + event_id % 20 END::DOUBLE AS temperature_c,
          event_id % 25 = 0 AS is_holiday
        FROM located_events""",
    "timed": """
        SELECT *, TRY_CAST(regexp_replace(prediction_time, '[+-]\\d\\d:\\d\\d$', '') AS TIMESTAMP) AS ts FROM requests""",
    "looked_up": """
        SELECT r.request_id,
          max(h.occupancy_rate) FILTER (o = 1) AS lag_1h, max(h.occupancy_rate) FILTER (o = 24) AS lag_24h,
          max(h.occupancy_rate) FILTER (o = 168) AS lag_168h,
          CASE WHEN count(h.occupancy_rate) FILTER (o <= 6) = 6 THEN list_sum(list(h.occupancy_rate ORDER BY o DESC) FILTER (o <= 6)) / 6 END AS rolling_mean_6h,
          CASE WHEN count(h.occupancy_rate) FILTER (o <= 24) = 24 THEN list_sum(list(h.occupancy_rate ORDER BY o DESC) FILTER (o <= 24)) / 24 END AS rolling_mean_24h,
          CASE WHEN count(h.occupancy_rate) FILTER (o <= 24) = 24 THEN stddev_samp(h.occupancy_rate) FILTER (o <= 24) END AS rolling_std_24h
        FROM (SELECT request_id, station_id, ts, unnest(list_append(range(1, 25), 168)) AS o FROM timed) r
        LEFT JOIN hourly h ON h.station_id = r.station_id AND h."timestamp" = r.ts - to_hours(CAST(o AS BIGINT))
        GROUP BY r.request_id""",
    "checked": """
        SELECT t.*, l.* EXCLUDE (request_id),
          CASE WHEN t.station_id NOT IN (SELECT station_id FROM hourly) THEN 'unknown_station'
               WHEN ts IS NULL THEN 'bad_timestamp' WHEN ts <> date_trunc('hour', ts) THEN 'not_on_hour'
               WHEN NOT temperature_c BETWEEN -5 AND 50 THEN 'temperature_out_of_range'
               WHEN lag_1h IS NULL THEN 'missing_lag_1h' WHEN lag_24h IS NULL THEN 'missing_lag_24h'
               WHEN lag_168h IS NULL THEN 'missing_lag_168h' WHEN rolling_mean_6h IS NULL THEN 'missing_rolling_6h'
               WHEN rolling_mean_24h IS NULL THEN 'missing_rolling_24h' END AS error_code
        FROM timed t JOIN looked_up l USING (request_id)""",
    "users": f"""
        SELECT c_custkey AS request_id, {_ULAT} AS user_lat, {_ULON} AS user_lon,
          {pick(text_list([*fx.VEHICLES, 'Unlisted EV']), 'c_custkey % 11')} AS vehicle_type FROM customer""",
    "featured": """
        SELECT * FROM (SELECT h.*, CAST(hour("timestamp") AS INTEGER) AS hour, CAST(isodow("timestamp") - 1 AS INTEGER) AS day_of_week,
            CAST(month("timestamp") AS INTEGER) AS month,
            lag(occupancy_rate, 1) OVER w AS lag_1h, lag(occupancy_rate, 24) OVER w AS lag_24h, lag(occupancy_rate, 168) OVER w AS lag_168h,
            CASE WHEN count(occupancy_rate) OVER w6 = 6 THEN avg(occupancy_rate) OVER w6 END AS rolling_mean_6h,
            CASE WHEN count(occupancy_rate) OVER w24 = 24 THEN avg(occupancy_rate) OVER w24 END AS rolling_mean_24h,
            CASE WHEN count(occupancy_rate) OVER w24 = 24 THEN stddev_samp(occupancy_rate) OVER w24 END AS rolling_std_24h
          FROM hourly h
          WINDOW w AS (PARTITION BY station_id ORDER BY "timestamp"),
            w6 AS (PARTITION BY station_id ORDER BY "timestamp" ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING),
            w24 AS (PARTITION BY station_id ORDER BY "timestamp" ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
        WHERE lag_168h IS NOT NULL""",
    "hours": """SELECT list_sort(list(DISTINCT "timestamp")) AS t FROM featured""",
    "cuts": f"""
        SELECT t[CAST(floor(len(t) * {d(0.7)}) AS INTEGER) + 1] AS first_cut,
          t[CAST(floor(len(t) * {d(0.7 + 0.15)}) AS INTEGER) + 1] AS second_cut FROM hours""",
    "labelled": f"""
        SELECT f.*, CASE WHEN "timestamp" < (SELECT first_cut FROM cuts) THEN 'train'
          WHEN "timestamp" < (SELECT second_cut FROM cuts) THEN 'val' ELSE 'test' END AS split,
          {clip('lag_24h', 0, 1)} AS predicted FROM featured f""",
    "docs": """
        SELECT 'docs/doc ' || doc_id || CASE WHEN doc_id % 3 = 2 THEN '.csv' ELSE '.md' END AS source,
          CASE WHEN doc_id % 3 = 0 THEN '# Document ' || doc_id || chr(10) || replace(text, chr(10), chr(10) || '## ')
               ELSE text END AS content,
          CASE WHEN doc_id % 3 = 2 THEN 'csv_artifact' ELSE 'markdown_doc' END AS type FROM documents""",
    "questions": f"""
        SELECT 'Q' || lpad(CAST(vec_id AS VARCHAR), 8, '0') AS query_id,
          CASE WHEN vec_id % 40 = 7 THEN '  ' ELSE 'What about ' || vec_id || '?' END AS question,
          {pick(text_list(['SUPPORTED', 'PARAPHRASED', 'BORDERLINE', 'UNSUPPORTED']), 'vec_id % 4')} AS category,
          CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings""",
    "vectors": """
        SELECT lpad(CAST(vec_id AS VARCHAR), 8, '0') AS chunk_id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings""",
    "ranked": f"""
        SELECT * FROM (SELECT query_id, chunk_id, {rnd('s', 4)} AS score,
          CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS INTEGER) AS rank
          FROM (SELECT query_id, chunk_id, list_inner_product(q.embedding, v.embedding) AS s FROM questions q, vectors v
                WHERE trim(q.question) <> '')) WHERE rank <= 3""",
}


def with_tables(sql: str) -> str:
    """Prefix the SQL with the common tables it uses, directly or not, in order."""
    own = set(re.findall(r"\b(\w+) AS (?:MATERIALIZED )?\(", sql)) if sql.lstrip().upper().startswith("WITH") else set()
    needed: list[str] = []
    text = sql
    for name in reversed(list(TABLES)):
        if name not in own and re.search(rf"\b{name}\b(?!\s*\()", text):
            needed.append(name)
            text += "\n" + TABLES[name]
    if not needed:
        return sql
    head = ", ".join(f"{name} AS ({TABLES[name]})" for name in reversed(needed))
    body = sql.lstrip()
    if body.upper().startswith("WITH"):
        return f"WITH {head}, {body[4:]}"
    return f"WITH {head} {body}"
