"""Exact-time history lookups for requests, without a range join.

The requests say which days of which stations they look back at. Only those days of the
history are packed, into one array of 24 values per station and day (partial aggregation
before the shuffle), and a request then needs one equi-join on (station, day) for all 25
values it looks up. Streams join a table of packed days that each start brings up to date.
"""

from pyspark.sql import Column, DataFrame, functions as F

from voltlattice.functions import calendar as cal
from voltlattice.session import materialize, path_exists

LOOKBACK_DAYS = {"today": 0, "yesterday": 1, "week_ago": 7}


def pack_days(history: DataFrame, value: str = "occupancy_rate") -> DataFrame:
    """(station_id, day, v[24]); an hour without an observation is NULL."""
    hour = F.hour("timestamp")
    by_hour = [F.max(F.when(hour == h, F.col(value))) for h in range(24)]
    return history.groupBy("station_id", F.to_date("timestamp").alias("day")).agg(F.array(*by_hour).alias("v"))


def lookback_needs(days: DataFrame) -> DataFrame:
    """(station_id, day, back, source_day): the days of history that (station_id, day) rows look back at."""
    offsets = F.array(*[F.lit(n) for n in LOOKBACK_DAYS.values()])
    asked = days.select("station_id", "day").filter("station_id IS NOT NULL AND day IS NOT NULL").distinct()
    return asked.withColumn("back", F.explode(offsets)).withColumn("source_day", F.date_sub("day", F.col("back")))


def needed_history(history: DataFrame, needs: DataFrame) -> DataFrame:
    """The rows of history on the days needed; a table partitioned by day is pruned to them."""
    asked = needs.select("station_id", F.col("source_day").alias("_day")).distinct()
    match = (history["station_id"] == asked["station_id"]) & (F.to_date(history["timestamp"]) == asked["_day"])
    return history.join(asked, match, "left_semi")


def lookback_days(packed: DataFrame, needs: DataFrame) -> DataFrame:
    """(station_id, day, today, yesterday, week_ago) for every day asked for."""
    picks = [
        F.first(F.when(F.col("back") == n, F.col("v")), ignorenulls=True).alias(name)
        for name, n in LOOKBACK_DAYS.items()
    ]
    source = packed.withColumnRenamed("day", "source_day")
    return needs.join(source, ["station_id", "source_day"]).groupBy("station_id", "day").agg(*picks)


def _merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Packed days hour by hour: a new value replaces an old one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    hours = [F.max_by(F.get("v", F.lit(h)), F.when(F.get("v", F.lit(h)).isNotNull(), F.col("_new"))) for h in range(24)]
    return both.groupBy("station_id", "day").agg(F.array(*hours).alias("v"))


def update_packed(history: DataFrame, path: str, late_hours: int = 0) -> DataFrame:
    """Bring a table of packed days up to date with ``history`` and return it; one file group a day.

    Hours up to the one merged last are not read again, but for the last ``late_hours`` of them. Days
    that get new hours are merged with what is there and replaced as a whole; other days stay as they
    are. The mark of the last hour is written after them, so an update that is cut short is done again
    with the same result.
    """
    spark = history.sparkSession
    days, marks = f"{path}/days", f"{path}/mark"
    fresh = history
    schema = "station_id string, v array<double>, day date"
    known = path_exists(spark, f"{marks}/_SUCCESS")
    if known:
        mark = spark.read.schema("hour timestamp_ntz").parquet(marks).first()["hour"]
        if mark is not None:
            fresh = history.filter(F.col("timestamp") > F.lit(mark) - F.expr(f"interval {late_hours} hours"))
    last = fresh.agg(F.max("timestamp").alias("hour"))
    packed = pack_days(fresh)
    if path_exists(spark, days):
        packed = materialize(packed, "packed-new")
        touched = packed.select("day").distinct()
        packed = _merged(spark.read.schema(schema).parquet(days).join(touched, "day", "left_semi"), packed)
    packed = materialize(packed, "packed-days")
    if known and packed.isEmpty():
        return spark.read.schema(schema).parquet(days)
    # All rows of a day in one task, so a day is one file; only the days written here are replaced.
    packed.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(days)
    materialize(last, "packed-mark").write.mode("overwrite").parquet(marks)
    return spark.read.schema(schema).parquet(days)


def preceding_24h(ts: Column) -> Column:
    """The 24 values before ``ts``, oldest first, NULL where the hour is missing."""
    empty = F.array_repeat(F.lit(None).cast("double"), 24)
    both = F.concat(F.coalesce("yesterday", empty), F.coalesce("today", empty))
    return F.slice(both, F.hour(ts) + 1, 24)


def mean_of(values: Column, n: int) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n


def sample_std_of(values: Column, mean: Column, n: int) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (n - 1))


def attach_history(requests: DataFrame, history: DataFrame, stations: DataFrame | None = None,
                   packed: DataFrame | None = None) -> DataFrame:
    """Add the lag and rolling features at ``ts`` and ``known_station``.

    A missing observation gives NULL in every feature that needs it, never a near value;
    a time off the hour finds nothing. Known are the ``stations`` given, else those with
    history. ``packed`` is history as ``update_packed`` leaves it and replaces packing it here.
    """
    whole_hour = F.when(F.col("ts") == cal.hour_of(F.col("ts")), F.to_date("ts"))
    return _features(_looked_up(requests.withColumn("day", whole_hour), history, stations, packed), requests.columns)


def attach_hours(days: DataFrame, history: DataFrame, stations: DataFrame | None = None,
                 packed: DataFrame | None = None) -> DataFrame:
    """``attach_history`` for rows that ask for many hours of a station and day: each becomes one row an hour.

    ``day`` is the date and ``hours`` an array of structs with the whole hour ``ts`` of that day and what else
    belongs to it. The days are looked up, and moved, before the hours become rows.
    """
    kept = [c for c in days.columns if c not in ("day", "hours")]
    per_hour = [f.name for f in days.schema["hours"].dataType.elementType.fields]
    found = _looked_up(days, history, stations, packed).select("*", F.inline("hours")).drop("hours")
    return _features(found, [*kept, *per_hour])


def _looked_up(dated: DataFrame, history: DataFrame, stations: DataFrame | None, packed: DataFrame | None) -> DataFrame:
    """Rows with ``known_station`` and the values of the days that ``day`` looks back at."""
    needs = lookback_needs(dated)
    days = packed if packed is not None else pack_days(needed_history(history, needs))
    places = stations if stations is not None else history
    known = places.select("station_id").distinct().withColumn("known_station", F.lit(True))
    # Known first: after the days, rows are ten times as wide.
    return dated.join(known, "station_id", "left").join(lookback_days(days, needs), ["station_id", "day"], "left")


def _features(looked_up: DataFrame, columns: list[str]) -> DataFrame:
    looked_up = looked_up.withColumn("_w24", preceding_24h(F.col("ts")))
    w24, w6 = F.col("_w24"), F.slice("_w24", 19, 6)
    means = looked_up.withColumns({
        "known_station": F.coalesce("known_station", F.lit(False)),
        "rolling_mean_6h": mean_of(w6, 6),
        "rolling_mean_24h": mean_of(w24, 24),
    })
    # The mean is a column by now, so the lambda does not recompute it per value. The generator
    # keeps later filters on the features above it; pushed below, they would evaluate them again.
    features = F.struct(
        F.get(w24, F.lit(23)).alias("lag_1h"),
        F.get(w24, F.lit(0)).alias("lag_24h"),
        F.get("week_ago", F.hour("ts")).alias("lag_168h"),
        "rolling_mean_6h", "rolling_mean_24h",
        sample_std_of(w24, F.col("rolling_mean_24h"), 24).alias("rolling_std_24h"),
    )
    return means.select(*columns, "known_station", F.inline(F.array(features)))


def calendar_features(ts: Column) -> dict[str, Column]:
    return {**cal.calendar_parts(ts), **cal.cyclical_parts(ts), "is_weekend": cal.flag(cal.is_weekend(ts))}
