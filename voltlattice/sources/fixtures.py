"""Domain tables derived from the star-schema test tables.

Stations come from ``supplier`` and ``nation``; sessions, hourly history and requests from
``events``; users from ``customer``; documents and vectors from their own tables. Nothing is
generated: every row stems from a table row, so the work grows with the tables.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from voltlattice.functions import calendar as cal, occupancy as occ
from voltlattice.functions.rounding import pround
from voltlattice.functions.scoring import VEHICLE_CHARGERS
from voltlattice.operators import spine
from voltlattice.schemas import STAR

CHARGERS = list(occ.SESSION_HOURS)
POWER_KW = [7.4, 22.0, 50.0, 150.0, 50.0]
VEHICLES = list(VEHICLE_CHARGERS)
# Invented test values.
SEGMENTS = ["segment a", "segment b", "segment c", "segment d"]
AMENITIES = ["shelter", "kiosk", "lounge", "air pump", "lockers", "playground", "car wash", "workshop"]
HOLIDAYS = ["2024-01-01", "2024-01-15", "2024-01-26"]
CITY_DEMAND = {"NATION_2": 1.3, "NATION_5": 1.2, "NATION_9": 0.85, "NATION_14": 0.7}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(STAR[name]).parquet(f"{sf_dir}/{name}.parquet")


def pick(options, index):
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index + 1).cast("int"))


def place(nation_key, n, lat_step: int, lon_step: int):
    """A spot within about 20 km of the city centre."""
    lat = -60 + nation_key * 5 + F.pmod(n * lat_step, F.lit(101)) * 0.002
    lon = -150 + nation_key * 12 + F.pmod(n * lon_step, F.lit(97)) * 0.002
    return pround(lat, 6), pround(lon, 6)


def stations(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    lat, lon = place(F.col("n_nationkey"), k, 37, 53)
    amenities = F.array_join(
        F.slice(F.array(*[F.lit(a) for a in AMENITIES]), (1 + k % 4).cast("int"), (2 + k % 4).cast("int")), ", "
    )
    joined = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.concat(F.lit("STA"), F.lpad(k.cast("string"), 6, "0")).alias("station_id"),
        F.col("s_name").alias("name"),
        F.col("n_name").alias("city"),
        lat.alias("latitude"),
        lon.alias("longitude"),
        (1 + k % 4).cast("int").alias("total_slots"),
        pick(CHARGERS, k % 5).alias("charger_type"),
        F.concat(F.lit("Operator "), (k % 8 + 1).cast("string")).alias("operator"),
        pick(POWER_KW, k % 5).alias("avg_power_kw"),
        (2018 + k % 7).cast("int").alias("installation_year"),
        amenities.alias("amenities"),
        occ.amenities_score(amenities).alias("amenities_score"),
        pround(12 + (k % 11) * 0.73, 2).alias("tariff_per_kwh"),
        (k % 3 != 0).alias("is_24x7"),
        (pick(POWER_KW, k % 5) >= 50).alias("has_fast_charger"),
        ((k % 4) * 10).cast("int").alias("parking_fee_per_hr"),
    )


def with_station(spark, sf_dir, events: DataFrame) -> DataFrame:
    """Users charge at one station each: user number modulo the number of stations."""
    n = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n")).scalar()
    k = F.pmod("user_id", n)
    return events.withColumn("station_id", F.concat(F.lit("STA"), F.lpad(k.cast("string"), 6, "0")))


def session_columns(events: DataFrame) -> DataFrame:
    """Station-free session columns of an event."""
    e = F.col("event_id")
    duration = F.lit(0.25) + (e % 29) * 0.25
    return events.select(
        F.concat(F.lit("SES"), F.lpad(e.cast("string"), 9, "0")).alias("session_id"),
        "station_id",
        F.col("ts").alias("start_time"),
        occ.end_time(F.col("ts"), duration).alias("end_time"),
        duration.alias("duration_hrs"),
        (F.col("value") / 10).alias("energy_kwh"),
        pick(VEHICLES, e % 10).alias("vehicle_type"),
        F.date_format("ts", "EEEE").alias("day_of_week"),
        F.hour("ts").alias("hour"),
        cal.is_weekend(F.col("ts")).alias("is_weekend"),
        ((e * 7) % 31).cast("double").alias("wait_time_mins"),
        pick(SEGMENTS, e % 4).alias("user_segment"),
        F.col("event_id"),
    )


def sessions(spark, sf_dir) -> DataFrame:
    meta = stations(spark, sf_dir).select("station_id", "city", "charger_type", "operator", "tariff_per_kwh")
    rows = session_columns(with_station(spark, sf_dir, table(spark, sf_dir, "events")))
    return rows.join(meta, "station_id").withColumn(
        "revenue_inr", occ.revenue(F.col("energy_kwh"), F.col("tariff_per_kwh"))
    ).drop("tariff_per_kwh", "event_id")


def temperature():
    ts = F.col("timestamp")
    return pround(18 + 8 * F.sin(F.pi() * (F.hour(ts) - 9) / 12) + (F.dayofmonth(ts) % 10) * 0.7, 1)


def hourly(spark, sf_dir) -> DataFrame:
    slim = session_columns(with_station(spark, sf_dir, table(spark, sf_dir, "events"))).select(
        "station_id", "start_time", "end_time"
    )
    return spine.hourly_history(slim, stations(spark, sf_dir), temperature(), HOLIDAYS)


def status(spark, sf_dir) -> DataFrame:
    return spine.status_snapshot(hourly(spark, sf_dir), stations(spark, sf_dir))


def requests(spark, sf_dir) -> DataFrame:
    """One request per event, with every kind of faulty request among them."""
    events = with_station(spark, sf_dir, table(spark, sf_dir, "events"))
    e = F.col("event_id")
    kind = e % 50
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss")
    return events.select(
        e.alias("request_id"),
        F.when(kind == 0, F.lit("STA_NONE")).otherwise(F.col("station_id")).alias("station_id"),
        F.when(kind == 1, F.lit("not-a-time"))
        .when(kind == 2, F.concat(F.substring(hour, 1, 14), F.lit("30:00")))
        .when(kind == 4, F.concat(hour, F.lit("+05:30")))
        .otherwise(hour).alias("prediction_time"),
        F.when(kind == 3, F.lit(75.0)).otherwise(15.0 + e % 20).alias("temperature_c"),
        (e % 25 == 0).alias("is_holiday"),
    )


def users(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    lat, lon = place(F.col("c_nationkey"), k, 29, 31)
    return table(spark, sf_dir, "customer").select(
        k.alias("request_id"), lat.alias("user_lat"), lon.alias("user_lon"),
        pick([*VEHICLES, "Unlisted EV"], k % 11).alias("vehicle_type"),
    )


def documents(spark, sf_dir) -> DataFrame:
    """Chunkable documents: a third Markdown with a heading per line, a third plain, a third data files."""
    d, body = F.col("doc_id"), F.col("text")
    kind = d % 3
    headed = F.concat(F.lit("# Document "), d.cast("string"), F.lit("\n"), F.regexp_replace(body, "\n", "\n## "))
    suffix = F.when(kind == 2, ".csv").otherwise(".md")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("docs/doc "), d.cast("string"), suffix).alias("source"),
        F.when(kind == 0, headed).otherwise(body).alias("content"),
        F.when(kind == 2, "csv_artifact").otherwise("markdown_doc").alias("type"),
    )


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("chunk_id"), "embedding",
        F.col("label").alias("label"),
    )


def questions(spark, sf_dir) -> DataFrame:
    """Every vector asked as a question, some of them blank."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("Q"), F.lpad(v.cast("string"), 8, "0")).alias("query_id"),
        F.when(v % 40 == 7, F.lit("  ")).otherwise(F.concat(F.lit("What about "), v.cast("string"), F.lit("?"))).alias("question"),
        "embedding",
        pick(["SUPPORTED", "PARAPHRASED", "BORDERLINE", "UNSUPPORTED"], v % 4).alias("category"),
    )
