"""File sources and sinks, and the streaming jobs, over the shared folder."""

from pyspark.sql import functions as F

from voltlattice import schemas
from voltlattice.catalog.registry import d, query, rnd
from voltlattice.operators.forest import baseline_predict
from voltlattice.plans import serving
from voltlattice.session import shared_dir
from voltlattice.sources import files, fixtures as fx
from voltlattice.streaming import jobs


@query("src_1_station_csv", "SELECT * FROM stations")
def station_csv(spark, sf_dir):
    columns = schemas.STATIONS.fieldNames()
    path = files.write_csv(fx.stations(spark, sf_dir).select(*columns), shared_dir(spark, "stations"))
    return files.read_stations(spark, path)


@query("src_1_session_csv", f"""
    SELECT {", ".join(schemas.SESSIONS.fieldNames())} FROM sessions""")
def session_csv(spark, sf_dir):
    columns = schemas.SESSIONS.fieldNames()
    path = files.write_csv(fx.sessions(spark, sf_dir).select(*columns), shared_dir(spark, "sessions"))
    return files.read_sessions(spark, path)


@query("src_1_status_csv", f"""SELECT {", ".join(schemas.STATUS.fieldNames())} FROM status""")
def status_csv(spark, sf_dir):
    columns = schemas.STATUS.fieldNames()
    path = files.write_csv(fx.status(spark, sf_dir).select(*columns), shared_dir(spark, "status"))
    return files.read_status(spark, path)


_HOURLY = ", ".join(f'"{c}"' for c in schemas.HOURLY.fieldNames())


@query("src_2_hourly_scan", f"SELECT {_HOURLY} FROM hourly")
def hourly_scan(spark, sf_dir):
    columns = schemas.HOURLY.fieldNames()
    path = files.write_csv(fx.hourly(spark, sf_dir).select(*columns), shared_dir(spark, "hourly"))
    return files.read_hourly(spark, path, "csv")


_SUFFIXES = ["json", "csv", "txt", "md", "bin"]


@query("src_3_document_scan", """
    SELECT 'part ' || doc_id % 7 || '/doc-' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.json' WHEN 1 THEN '.csv' WHEN 2 THEN '.txt' ELSE '.md' END AS source,
      CASE doc_id % 5 WHEN 0 THEN 'json_artifact' WHEN 1 THEN 'csv_artifact' ELSE 'markdown_doc' END AS type,
      md5(CASE doc_id % 5 WHEN 0 THEN 'JSON Artifact: doc-' || doc_id || '.json' || chr(10) || '["' || md5(coalesce(text, '')) || '"]'
        WHEN 1 THEN 'CSV Feature Importance Artifact:' || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END) AS digest
    FROM documents WHERE doc_id % 5 <> 4""")
def document_scan(spark, sf_dir):
    """All documents as files of several formats in bundles, read back by ranges: paths, types and introduced contents.

    One in five has a suffix that is skipped.
    """
    n, root = F.col("doc_id") % 5, shared_dir(spark, "documents")
    text = F.coalesce("text", F.lit(""))
    suffix = F.get(F.array(*(F.lit(s) for s in _SUFFIXES)), n.cast("int"))
    path = F.concat(F.lit("/store/part "), (F.col("doc_id") % 7).cast("string"), F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit("."), suffix)
    value = F.when(n == 0, F.concat(F.lit('["'), F.md5(text.cast("binary")), F.lit('"]'))).otherwise(text)
    rows = fx.table(spark, sf_dir, "documents").select(path.alias("path"), value.alias("value"))
    docs = files.read_bundles(spark, files.write_bundles(rows, root), "/store")
    return docs.select("source", "type", F.md5("content").alias("digest"))


def scored(spark, sf_dir):
    built = serving.build_request_features(fx.requests(spark, sf_dir), fx.hourly(spark, sf_dir))
    return baseline_predict(serving.valid(built))


LOG_SQL = f"""
    SELECT station_id, prediction_time, {rnd("least(greatest(lag_24h, 0), 1)", 4)} AS predicted_occupancy, 'baseline' AS model_version,
      'api' AS source, CAST(hour(ts) AS INTEGER) AS hour, {rnd("lag_1h", 6)} AS lag_1h, temperature_c,
      {rnd("rolling_mean_24h", 6)} AS rolling_mean_24h
    FROM checked WHERE error_code IS NULL"""
LOG_SHOWN = ["station_id", "prediction_time", "predicted_occupancy", "model_version", "source",
             "key_features.hour", "key_features.lag_1h", "key_features.temperature_c", "key_features.rolling_mean_24h"]


@query("snk_1_prediction_log", LOG_SQL)
def prediction_log(spark, sf_dir):
    path = shared_dir(spark, "log")
    files.append_log(files.log_rows(scored(spark, sf_dir), "baseline"), path)
    return files.read_log(spark, path).select(*LOG_SHOWN)


@query("src_4_log_read", "SELECT station_id, count(*) AS n, count(*) AS n_ids FROM checked WHERE error_code IS NULL GROUP BY station_id")
def log_read(spark, sf_dir):
    """A log that does not exist reads as empty; after an append it holds one id per prediction."""
    path = shared_dir(spark, "log")
    before = files.read_log(spark, path)
    files.append_log(files.log_rows(scored(spark, sf_dir), "baseline"), path)
    log = before.unionByName(files.read_log(spark, path))
    return log.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("prediction_id").alias("n_ids")
    )


@query("snk_2_csv_write", """SELECT station_id, "timestamp", occupancy_rate FROM hourly""")
def csv_write(spark, sf_dir):
    series = fx.hourly(spark, sf_dir).select("station_id", "timestamp", "occupancy_rate")
    path = files.write_csv(series, shared_dir(spark, "series"))
    return files.read_csv(spark, path, series.schema)


def event_stream(spark, sf_dir):
    return spark.readStream.schema(schemas.STAR["events"]).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def telemetry(spark, sf_dir, events):
    """One reading per event: its kind and value stand for occupied slots and queue."""
    slots = fx.stations(spark, sf_dir).select("station_id", F.col("total_slots").alias("_slots"))
    n = F.col("event_id")
    return fx.with_station(spark, sf_dir, events).join(slots, "station_id").select(
        "station_id", (n % (F.col("_slots") + 1)).cast("int").alias("occupied_slots"),
        (n % 3).cast("int").alias("queue_length"), F.col("ts").alias("last_updated"),
    )


READINGS = f"""
    readings AS (SELECT e.station_id, CAST(event_id % (total_slots + 1) AS INTEGER) AS occupied_slots, CAST(event_id % 3 AS INTEGER) AS queue_length, ts AS last_updated
      FROM located_events e JOIN stations USING (station_id)),
    derived AS (SELECT station_id, last_updated, total_slots - occupied_slots AS available_slots, queue_length,
        {rnd(f"occupied_slots * avg_power_kw * {d(0.9)}", 1)} AS current_load_kw, {rnd("occupied_slots / total_slots * 100", 1)} AS utilization_pct
      FROM readings JOIN stations USING (station_id))"""
READING_SHOWN = ["station_id", "last_updated", "available_slots", "queue_length", "current_load_kw", "utilization_pct"]


@query("str_1_telemetry_stream", f"WITH {READINGS} SELECT * FROM derived")
def telemetry_stream(spark, sf_dir):
    status = jobs.telemetry_status(telemetry(spark, sf_dir, event_stream(spark, sf_dir)), fx.stations(spark, sf_dir))
    root = shared_dir(spark, "telemetry")
    jobs.append_stream(status.select(*READING_SHOWN), f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("str_1_hourly_counts", """
    SELECT station_id, date_trunc('hour', ts) AS hour, count(*) AS n FROM located_events
    WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL""")
def hourly_counts(spark, sf_dir):
    """Hours the watermark has closed, appended once each."""
    located = fx.with_station(spark, sf_dir, event_stream(spark, sf_dir)).withColumnRenamed("ts", "start_time")
    root = shared_dir(spark, "counts")
    jobs.append_stream(jobs.hourly_counts(located), f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("str_2_score_stream", LOG_SQL.replace("'api'", "'stream'"))
def score_stream(spark, sf_dir):
    """Requests scored as a stream against the static history and logged exactly once."""
    root = shared_dir(spark, "requests")
    columns = schemas.REQUESTS.fieldNames()
    fx.requests(spark, sf_dir).select(*columns).write.parquet(f"{root}/in")
    history = files.read_hourly(spark, _history(spark, sf_dir, root))
    stream = spark.readStream.schema(schemas.REQUESTS).parquet(f"{root}/in")
    jobs.score_and_log(stream, history, f"{root}/log", f"{root}/state", stations=fx.stations(spark, sf_dir)).awaitTermination()
    return files.read_log(spark, f"{root}/log").select(*LOG_SHOWN)


def _history(spark, sf_dir, root):
    path = f"{root}/history"
    fx.hourly(spark, sf_dir).select(*schemas.HOURLY.fieldNames()).write.parquet(path)
    return path


LATEST = f"""
    WITH {READINGS} SELECT * FROM derived
    QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY last_updated DESC, available_slots DESC, queue_length DESC,
      current_load_kw DESC, utilization_pct DESC) = 1"""


@query("str_3_latest_status_batch", LATEST)
def latest_status_batch(spark, sf_dir):
    readings = telemetry(spark, sf_dir, fx.table(spark, sf_dir, "events"))
    return jobs.latest_status(jobs.telemetry_status(readings, fx.stations(spark, sf_dir)).select(*READING_SHOWN))


@query("str_3_latest_status_stream", LATEST)
def latest_status_stream(spark, sf_dir):
    """The same table from a stream of snapshots, a few files of readings at a time."""
    status = jobs.telemetry_status(telemetry(spark, sf_dir, event_stream(spark, sf_dir)), fx.stations(spark, sf_dir)).select(*READING_SHOWN)
    root = shared_dir(spark, "latest")
    jobs.upsert_latest(status, f"{root}/out", f"{root}/state").awaitTermination()
    return jobs.read_latest(spark, f"{root}/out", status.schema)
