import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltlattice import schemas
from voltlattice.operators import history as hist, quality, windows
from voltlattice.plans import serving, training

START = dt.datetime(2025, 1, 6)


def make_hourly(spark, hours=400, stations=3, drop=(), seed=99):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(stations):
        for h in range(hours):
            if (s, h) in drop:
                continue
            ts = START + dt.timedelta(hours=h)
            occupied = int(rng.integers(0, 9))
            rows.append((f"STA{s:03d}", ts, "Pune", "DC CCS2 (50 kW)", 8, occupied, round(occupied / 8, 4),
                         occupied * 40.0, 25.0 + s, ts.weekday() >= 5, False))
    return spark.createDataFrame(rows, schemas.HOURLY)


def expected_features(pdf):
    pdf = pdf.sort_values(["station_id", "timestamp"]).reset_index(drop=True)
    by = pdf.groupby("station_id")["occupancy_rate"]
    for name, n in windows.LAGS.items():
        pdf[name] = by.shift(n)
    past = by.shift(1)
    for name, n, how in [("rolling_mean_6h", 6, "mean"), ("rolling_mean_24h", 24, "mean"), ("rolling_std_24h", 24, "std")]:
        pdf[name] = past.groupby(pdf["station_id"]).transform(lambda s: getattr(s.rolling(n), how)())
    return pdf.dropna().reset_index(drop=True)


LAGGED = [*windows.LAGS, *windows.ROLLING]


@pytest.mark.parametrize("block", [None, 168, 200, 1000])
def test_training_features_match_pandas(spark, block):
    gaps = {(1, h) for h in range(200, 230)}
    hourly = make_hourly(spark, drop=gaps)
    want = expected_features(hourly.toPandas())
    got = training.build_training_features(hourly, block).toPandas().sort_values(["station_id", "timestamp"]).reset_index(drop=True)
    assert len(got) == len(want)
    np.testing.assert_allclose(got[LAGGED], want[LAGGED], atol=1e-12)
    assert got["hour_sin"].pow(2).add(got["hour_cos"].pow(2)).sub(1).abs().max() < 1e-12


def test_serving_features_equal_training_features_on_whole_history(spark):
    hourly = make_hourly(spark)
    trained = training.build_training_features(hourly)
    asked = trained.select(
        F.monotonically_increasing_id().alias("request_id"), "station_id", F.col("timestamp").cast("string").alias("prediction_time"),
        "temperature_c", F.lit(False).alias("is_holiday"),
    )
    served = serving.valid(serving.build_request_features(asked, hourly)).toPandas()
    a = served.sort_values(["station_id", "ts"])[schemas.FEATURE_COLS].reset_index(drop=True)
    b = trained.toPandas().sort_values(["station_id", "timestamp"])[schemas.FEATURE_COLS].reset_index(drop=True)
    assert len(a) == len(b)
    np.testing.assert_allclose(a.astype(float), b.astype(float), atol=1e-12)


def test_request_errors_in_order(spark):
    hourly = make_hourly(spark, hours=200, drop={(0, 198), (1, 190)})
    end = START + dt.timedelta(hours=200)
    cases = [
        (1, "STA999", "rubbish", 99.0, "unknown_station"), (2, "STA000", "rubbish", 99.0, "bad_timestamp"),
        (3, "STA002", "2025-01-14 07:30:00", 99.0, "not_on_hour"), (4, "STA002", str(end), 51.0, "temperature_out_of_range"),
        (5, "STA002", str(end), 20.0, None), (6, "STA002", str(end + dt.timedelta(hours=1)), 20.0, "missing_lag_1h"),
        (7, "STA002", str(START + dt.timedelta(hours=10)), 20.0, "missing_lag_24h"),
        (8, "STA002", str(START + dt.timedelta(hours=100)), 20.0, "missing_lag_168h"),
        (9, "STA000", str(end), 20.0, "missing_rolling_6h"), (10, "STA001", str(end), 20.0, "missing_rolling_24h"),
    ]
    asked = spark.createDataFrame([(i, s, t, c, None) for i, s, t, c, _ in cases], schemas.REQUESTS)
    got = {r.request_id: (r.error_code, r.error_status) for r in serving.build_request_features(asked, hourly).collect()}
    assert got == {i: (e, None if e is None else 404 if e == "unknown_station" else 422) for i, *_, e in cases}


def test_features_do_not_see_the_hour_itself_or_later(spark):
    hourly = make_hourly(spark)
    cut = START + dt.timedelta(hours=300)
    changed = hourly.withColumn(
        "occupancy_rate", F.when(F.col("timestamp") >= F.lit(cut), 0.123).otherwise(F.col("occupancy_rate"))
    )
    at = F.col("timestamp") == F.lit(cut)
    a, b = (training.build_training_features(h).filter(at).select("station_id", *LAGGED).toPandas().sort_values("station_id")
            for h in (hourly, changed))
    pd.testing.assert_frame_equal(a.reset_index(drop=True), b.reset_index(drop=True))


def test_packed_history_keeps_gaps(spark):
    hourly = make_hourly(spark, hours=48, stations=1, drop={(0, 5)})
    days = {r.day: r.v for r in hist.pack_days(hourly).collect()}
    first = days[START.date()]
    assert len(first) == 24 and first[5] is None and first[4] is not None


def test_split_is_by_time_and_disjoint(spark):
    featured = training.build_training_features(make_hourly(spark))
    labelled = windows.split_label(featured, train=0.70, val=0.15, test=0.15)
    hours = sorted({r.timestamp for r in featured.select("timestamp").collect()})
    n = len(hours)
    got = {r["split"]: r for r in quality.split_ranges(labelled).collect()}
    assert got["val"].min_ts == hours[int(n * 0.70)] and got["test"].min_ts == hours[int(n * (0.70 + 0.15))]
    assert quality.splits_disjoint(labelled).first()["disjoint"]
    with pytest.raises(ValueError):
        windows.split_label(featured, train=0.9, val=0.15, test=0.15)


def test_quality_report(spark):
    featured = training.build_training_features(make_hourly(spark))
    assert quality.dataset_report(featured).first()["is_valid"]
    broken = featured.unionByName(featured.limit(5)).withColumn("occupied_slots", F.lit(9))
    row = quality.dataset_report(broken).first()
    assert not row.is_valid and row.duplicate_rows == 5 and row.invalid_slots == row.total_rows


def test_leakage_guard():
    with pytest.raises(ValueError):
        quality.check_features(["hour", "occupancy_rate"], ["hour", "occupancy_rate"])
    with pytest.raises(ValueError):
        quality.check_features(["hour"], ["hour", "lag_1h"])


def test_arrival_order_over_block_edges(spark):
    times = [0, 1, 5, 4, 6, 7, 3, 8]
    rows = [("a", START + dt.timedelta(hours=h), i) for i, h in enumerate(times)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, seq long")
    for block in (1, 2, 3, 100):
        assert quality.out_of_order(df, "k", "ts", "seq", block).first()["violations"] == 2


def test_batches_are_all_or_nothing(spark):
    featured = training.build_training_features(make_hourly(spark)).withColumn("index", F.hour("timestamp"))
    bad = featured.withColumn("batch_id", F.concat("station_id", F.to_date("timestamp").cast("string"))).withColumn(
        "lag_1h", F.when((F.col("station_id") == "STA001") & (F.hour("timestamp") == 3), 1.5).otherwise(F.col("lag_1h")))
    from voltlattice.operators.forest import baseline_predict

    kept = serving.predict_batches(bad, baseline_predict).select(F.substring("batch_id", 1, 6).alias("s")).distinct().collect()
    assert {r.s for r in kept} == {"STA000", "STA002"}
    whole = featured.withColumn("batch_id", F.lit("all"))
    assert serving.predict_batches(whole, baseline_predict).isEmpty()  # more than 500 items


def test_lookups_read_only_the_days_asked_for(spark):
    """One request needs three days of one station, from history as it is and from the packed table."""
    hourly = make_hourly(spark)
    when = START + dt.timedelta(days=10, hours=5)
    asked = spark.createDataFrame([("STA001", when)], "station_id string, ts timestamp_ntz").withColumn("day", F.to_date("ts"))
    needs = hist.lookback_needs(asked)
    days = {r.day for r in hist.needed_history(hourly, needs).select(F.to_date("timestamp").alias("day")).distinct().collect()}
    assert days == {when.date() - dt.timedelta(days=n) for n in (0, 1, 7)}
    assert hist.needed_history(hourly, needs).count() == 72
    text = hist.attach_history(asked.drop("day"), hourly)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in text


def test_packed_history_gives_the_same_features(spark, tmp_path):
    hourly = make_hourly(spark, drop={(1, 200)})
    packed = hist.update_packed(hourly, str(tmp_path / "packed"))
    times = [START + dt.timedelta(hours=h) for h in (3, 180, 201, 224, 399)]
    asked = spark.createDataFrame([(k, f"STA{k % 4:03d}", t) for k, t in enumerate(t for t in times for _ in range(4))], "request_id int, station_id string, ts timestamp_ntz")
    plain = hist.attach_history(asked, hourly).orderBy("request_id").collect()
    assert hist.attach_history(asked, hourly, packed.select("station_id").distinct(), packed).orderBy("request_id").collect() == plain
    assert [r.known_station for r in plain] == [r.station_id != "STA003" for r in plain]


def test_sessions_without_or_before_their_end(spark):
    from voltlattice.operators import spine

    t = lambda h, m=0: dt.datetime(2025, 1, 6, h, m)
    sessions = spark.createDataFrame([("a", t(0, 10), None), ("a", t(3), t(1)), ("a", t(4), t(6, 30)), ("a", t(9), t(23))],
                                     "station_id string, start_time timestamp_ntz, end_time timestamp_ntz")
    got = {r.timestamp.hour: r.demand for r in spine.demand_per_hour(sessions, sessions.select("station_id").distinct()).collect()}
    assert got == {h: int(h in (0, 3, 4, 5, 6, 9)) for h in range(10)}
    report = spine.irregular_sessions(sessions).first()
    assert (report.open_sessions, report.reversed_sessions) == (1, 1)


def test_a_second_start_reads_only_new_hours(spark, tmp_path, monkeypatch):
    hourly = make_hourly(spark, drop={(1, 200)})
    path = str(tmp_path / "packed")
    early = START + dt.timedelta(hours=205)
    read = []
    real = hist.pack_days
    monkeypatch.setattr(hist, "pack_days", lambda rows, *a: read.append(rows.count()) or real(rows, *a))
    hist.update_packed(hourly.filter(F.col("timestamp") <= F.lit(early)), path)
    hist.update_packed(hourly, path)
    hist.update_packed(hourly, path)
    everything = hourly.count()
    assert read == [hourly.filter(F.col("timestamp") <= F.lit(early)).count(), hourly.filter(F.col("timestamp") > F.lit(early)).count(), 0]
    # A late hour comes in with the next start that looks back far enough.
    late = hourly.unionByName(hourly.filter(F.col("timestamp") == F.lit(START + dt.timedelta(hours=199))).limit(1).withColumns(
        {"timestamp": F.lit(START + dt.timedelta(hours=200)), "station_id": F.lit("STA001"), "occupancy_rate": F.lit(0.125)}))
    hist.update_packed(late, path, late_hours=300)
    assert read[-1] < everything
    shown = lambda df: sorted((r.station_id, r.day, tuple(r.v)) for r in df.select("station_id", "day", "v").collect())
    assert shown(hist.update_packed(late, path)) == shown(real(late))
    # One file group a day.
    folders = [d for d in (tmp_path / "packed" / "days").iterdir() if d.name.startswith("day=")]
    assert len(folders) == real(late).select("day").distinct().count()
    assert all(len(list(d.glob("*.parquet"))) == 1 for d in folders)


def test_quality_report_counts_arrivals_and_lags_across_days(spark):
    hourly = make_hourly(spark)
    featured = training.build_training_features(hourly).withColumn("seq", F.floor(F.unix_timestamp(F.col("timestamp").cast("timestamp")) / 3600))
    clean = quality.dataset_report(featured, "seq", block=7).first()
    assert clean.is_valid and clean.order_violations == 0 and clean.failed_checks == ""
    # One station's rows arrive in reverse: every step goes back, across blocks too.
    one = featured.select(F.min("station_id")).first()[0]
    back = featured.withColumn("seq", F.when(F.col("station_id") == one, -F.col("seq")).otherwise(F.col("seq")))
    for block in (1, 7, 1_000_000):
        row = quality.dataset_report(back, "seq", block=block).first()
        assert row.order_violations == featured.filter(F.col("station_id") == one).count() - 1
        assert not row.is_valid and row.failed_checks == "order_violations"
    # A wrong lag at midnight is seen over the edge of its day's block, one at noon within it.
    for hour in (0, 12):
        wrong = featured.withColumn("lag_1h", F.col("lag_1h") + F.when(F.hour("timestamp") == hour, 0.25).otherwise(0.0))
        first = featured.groupBy("station_id").agg(F.min("timestamp").alias("t")).filter(F.hour("t") == hour).count()
        assert quality.lag_mismatches(wrong).first()[0] == featured.filter(F.hour("timestamp") == hour).count() - first


def test_hours_of_few_stations_are_made_in_many_tasks(spark):
    from voltlattice.operators import spine

    stations = spark.createDataFrame([(f"S{i}",) for i in range(40)], "station_id string").coalesce(1)
    bounds = [F.lit(x).cast("timestamp_ntz") for x in ("2025-01-01 00:00:00", "2025-01-01 04:00:00")]
    hours = spine.hour_spine(stations, *bounds)
    assert hours.count() == 200 and hours.select(F.spark_partition_id()).distinct().count() > 1


def test_hours_of_sessions_in_one_file_are_made_in_many_tasks(spark):
    from voltlattice.operators import spine

    rows = [("hot", dt.datetime(2025, 1, 1, h), dt.datetime(2025, 1, 1, h + 2, 30)) for h in range(20)] * 2
    sessions = spark.createDataFrame(rows, "station_id string, start_time timestamp_ntz, end_time timestamp_ntz").coalesce(1)
    hours = spine.active_hours(sessions, F.lit("2025-01-01 12:00:00").cast("timestamp_ntz"))
    counts = {r.timestamp.hour: r["count"] for r in hours.groupBy("timestamp").count().collect()}
    assert counts == {h: 2 * min(h + 1, 3) for h in range(13)}
    assert hours.select(F.spark_partition_id()).distinct().count() > 1


def test_hours_of_all_stations_are_never_broadcast(spark, sf_dir):
    """Unhinted, Spark may judge the aggregated hours the smaller side, send them to every task and join them in one."""
    from voltlattice.sources import fixtures

    plan = fixtures.hourly(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [station_id" in plan and "Inner, BuildRight" in plan.split("ShuffledHashJoin", 1)[1].split("\n")[0]
