"""Telemetry status, request scoring and latest status as streaming queries."""

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from voltlattice.operators import forest, history as hist, spine
from voltlattice.plans import serving
from voltlattice.session import delete, matching, materialize
from voltlattice.sources import files


def telemetry_status(telemetry: DataFrame, stations: DataFrame) -> DataFrame:
    """Telemetry (station_id, occupied_slots, queue_length, last_updated) to status rows; stateless."""
    return spine.derive_status(telemetry.join(stations, "station_id"))


def latest_status(status: DataFrame) -> DataFrame:
    """Newest status per station; an older event cannot win. One state row per station.

    The same aggregation serves batch and an update-mode stream.
    """
    fields = [c for c in status.columns if c not in ("station_id", "last_updated")]
    newest = F.max_by(F.struct("last_updated", *fields), F.struct("last_updated", *fields)).alias("s")
    return status.groupBy("station_id").agg(newest).select("station_id", "s.*")


def hourly_counts(sessions: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Sessions started per station and hour, closed by a watermark."""
    timed = sessions.withColumn("start_time", F.col("start_time").cast("timestamp"))  # watermarks need a zone
    return (
        timed.withWatermark("start_time", delay)
        .groupBy("station_id", F.window("start_time", "1 hour").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("station_id", F.col("w.start").cast("timestamp_ntz").alias("hour"), "n")
    )


def append_stream(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", mode: str = "append"):
    """Start an exactly-once file sink that drains what is there and stops."""
    return (
        stream.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )


def score_and_log(requests: DataFrame, history: DataFrame, log_path: str, checkpoint: str,
                  predict: Callable[[DataFrame], DataFrame] = forest.baseline_predict, model_version="baseline",
                  stations: DataFrame | None = None, packed_path: str | None = None):
    """Score each micro-batch of requests against history and add it to the log.

    The history is kept packed by day beside the checkpoint; a start merges only the hours that came
    since the last one, and a batch reads only the days that its requests look back at. Known are the
    ``stations`` given, else those with history.
    Each batch is a run of the log, so a batch that is replayed after a failure replaces its rows
    instead of doubling them.
    """
    packed = hist.update_packed(history, packed_path or f"{checkpoint.rstrip('/')}-history")
    known = materialize((stations if stations is not None else packed).select("station_id").distinct(), "known-stations")

    def write(batch: DataFrame, number: int):
        scored = predict(serving.valid(serving.build_request_features(batch, history, known, packed)))
        files.append_log(files.log_rows(scored, model_version, "stream"), log_path, f"batch-{number}")

    return (
        requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _snapshots(spark, path: str) -> list[int]:
    """The numbers of the whole snapshots: those whose write was committed."""
    return sorted(int(p.split("/snapshot-")[1].split("/")[0]) for p in matching(spark, f"{path}/snapshot-*/_SUCCESS"))


def upsert_latest(status: DataFrame, path: str, checkpoint: str, keep: int = 2):
    """Latest status per station as a stream of numbered snapshots.

    A batch merges its rows into the snapshot before it and writes the next one, numbered by the batch;
    a batch that is replayed starts from the same snapshot again. Readers take the last whole one.
    ``keep`` of the older ones stay for readers that have begun; the others are deleted.
    """
    def write(batch: DataFrame, number: int):
        spark = batch.sparkSession
        before = [n for n in _snapshots(spark, path) if n < number]
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(_snapshot(path, before[-1]))) if before else batch
        latest_status(rows).select(*batch.columns).write.mode("overwrite").parquet(_snapshot(path, number))
        for n in before[:-keep]:
            delete(spark, _snapshot(path, n))

    return (
        status.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _snapshot(path: str, number: int) -> str:
    return f"{path}/snapshot-{number:012d}"


def read_latest(spark, path: str, schema) -> DataFrame:
    """The latest status per station: the last whole snapshot, empty before the first."""
    found = _snapshots(spark, path)
    return spark.read.schema(schema).parquet(_snapshot(path, found[-1])) if found else spark.createDataFrame([], schema)
