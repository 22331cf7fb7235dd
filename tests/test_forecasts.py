import dataclasses
import inspect
import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_features import make_hourly
from voltlattice import schemas
from voltlattice.catalog import aggregates, forecasts
from voltlattice.operators import boosting, forest, growing, metrics, windows
from voltlattice.plans import serving, training
from voltlattice.session import shared_dir
from voltlattice.sources import files, fixtures
from voltlattice.sources.blobs import read_blob
from voltlattice.streaming import jobs


@pytest.fixture(scope="module")
def result(spark):
    return training.train_and_evaluate(make_hourly(spark, hours=500), trees=6, depth=4, min_leaf=10, max_bins=32)


def test_importances(result):
    rows = result.importances.orderBy("position").collect()
    values = [r.importance for r in rows]
    assert len(rows) == 16 and values == sorted(values, reverse=True) and sum(values) == pytest.approx(1, abs=1e-3)


def test_tree_spread(result):
    rows = forest.add_tree_dispersion(forest.tree_predictions(result.model, result.features.filter("split = 'test'")))
    scored = forest.predict(result.model, rows).limit(200).collect()
    for r in scored:
        trees, d = np.array(r.tree_predictions), r.tree_dispersion
        assert trees.mean() == pytest.approx(r.predicted_occupancy, abs=1e-9)
        assert (d.tree_mean, d.tree_std) == (pytest.approx(trees.mean(), abs=6e-5), pytest.approx(trees.std(), abs=6e-5))
        assert d.p10 == pytest.approx(np.percentile(trees, 10), abs=6e-5) and d.p90 == pytest.approx(np.percentile(trees, 90), abs=6e-5)
        assert d.tree_min <= d.p10 <= d.p90 <= d.tree_max and 0 < d.status_consensus_pct <= 100 and d.estimator_count == 6


def test_report(result):
    r = result.report.first()
    assert r.dataset.raw_rows == 1500 and r.dataset.featured_rows == (500 - 168) * 3
    assert r.splits.train.rows + r.splits.val.rows + r.splits.test.rows == r.dataset.featured_rows
    assert len(r.error_analysis.by_hour_worst5) == 5 and len(r.feature_importance_top5) == 5
    assert r.error_analysis.by_hour_worst5[-1].mae >= r.error_analysis.by_hour_best5[0].mae
    gain = (r.baseline.test_metrics.mae - r.splits.test.metrics.mae) / r.baseline.test_metrics.mae * 100
    assert r.improvement_over_baseline_pct.mae == pytest.approx(gain, abs=0.01)


def test_model_round_trip(spark, result):
    path = files.save_model(result.model, shared_dir(spark, "model"), training.model_metadata(result))
    loaded, metadata = files.load_model(spark, path)
    test = result.features.filter("split = 'test'").orderBy("station_id", "timestamp").limit(50)
    a, b = ([r.predicted_occupancy for r in forest.predict(m, test).collect()] for m in (result.model, loaded))
    assert a == b and metadata.first()["n_features"] == 16
    with pytest.raises(FileNotFoundError):
        files.load_model(spark, path + "-absent")


def test_metrics_on_toy_values(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.9), (0.6, 0.6, 0.1), (0.7, 0.7, 0.2)], "occupancy_rate double, good double, bad double")
    assert tuple(metrics.metrics(df, "good").first()) == (0.0, 0.0, 1.0)
    assert metrics.metrics(df, "bad").first()["r2"] < 0
    flat = spark.createDataFrame([(0.5, 0.5, 0.4), (0.5, 0.5, 0.4)], "occupancy_rate double, good double, bad double")
    assert (metrics.metrics(flat, "good").first()["r2"], metrics.metrics(flat, "bad").first()["r2"]) == (1.0, 0.0)


def test_explained_requests_and_concurrent_log(spark, result):
    hourly = make_hourly(spark, hours=500)
    asked = hourly.filter(F.hour("timestamp") == 7).select(
        F.monotonically_increasing_id().alias("request_id"), "station_id", F.col("timestamp").cast("string").alias("prediction_time"),
        "temperature_c", "is_holiday")
    explained = serving.explain_requests(asked, hourly, result.model).cache()
    row = explained.first()
    assert [i.feature for i in row.top_feature_context] == [n for n, _ in forest.importance_list(result.model)[:5]]
    assert row.time_period == "morning peak (7–10 AM)"
    path = shared_dir(spark, "log")
    assert files.read_log(spark, path).isEmpty()
    writers = [threading.Thread(target=files.append_log, args=(files.log_rows(explained, "v1"), path)) for _ in range(4)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    log = files.read_log(spark, path)
    n = explained.count()
    assert log.count() == 4 * n == log.select("prediction_id").distinct().count()
    one = json.loads(log.toJSON().first())
    assert set(one) <= set(schemas.PREDICTION_LOG.fieldNames()) and set(one["key_features"]) == set(schemas.KEY_FEATURES)


def test_stream_scores_what_batch_scores(spark):
    hourly = make_hourly(spark, hours=300)
    root = shared_dir(spark, "stream")
    asked = hourly.filter(F.hour("timestamp") == 8).select(
        F.monotonically_increasing_id().alias("request_id"), "station_id", F.col("timestamp").cast("string").alias("prediction_time"),
        "temperature_c", "is_holiday")
    asked.repartition(3).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(schemas.REQUESTS).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    jobs.score_and_log(stream, hourly, f"{root}/log", f"{root}/state").awaitTermination()
    shown = ["station_id", "prediction_time", "predicted_occupancy"]
    got = files.read_log(spark, f"{root}/log").select(*shown)
    want = serving.score_requests(asked, hourly).select(*shown)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 0


READING = "station_id string, last_updated timestamp_ntz, n int"


def test_late_event_does_not_replace_newer_status(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', timestamp_ntz'2025-01-02 00:00:00', 1), ('a', timestamp_ntz'2025-01-01 00:00:00', 2), "
                   "('b', timestamp_ntz'2025-01-01 00:00:00', 3), ('b', timestamp_ntz'2025-01-03 00:00:00', 4) AS t(station_id, last_updated, n)")
    root = shared_dir(spark, "late")
    for n in (1, 2, 3, 4):
        df.filter(F.col("n") == n).select("station_id", "last_updated", "n").coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(READING).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    assert jobs.read_latest(spark, f"{root}/out", stream.schema).isEmpty()
    jobs.upsert_latest(stream, f"{root}/out", f"{root}/state", keep=1).awaitTermination()
    assert sorted(r.n for r in jobs.read_latest(spark, f"{root}/out", stream.schema).collect()) == [1, 4]
    # Readers see one snapshot, and old ones go: the last and those that are kept.
    assert jobs._snapshots(spark, f"{root}/out") == [2, 3]
    # A batch that is replayed starts from the snapshot before it and ends in the same one.
    batches = []
    (spark.readStream.schema(READING).parquet(f"{root}/in").writeStream.foreachBatch(lambda b, n: batches.append(b.count()))
     .option("checkpointLocation", f"{root}/other").trigger(availableNow=True).start().awaitTermination())
    assert batches == [4]
    (stream.writeStream.foreachBatch(lambda b, n: None).option("checkpointLocation", f"{root}/third").trigger(availableNow=True).start().awaitTermination())
    jobs.upsert_latest(stream, f"{root}/out", f"{root}/replay", keep=9).awaitTermination()
    assert sorted(r.n for r in jobs.read_latest(spark, f"{root}/out", stream.schema).collect()) == [1, 4]


def test_a_run_that_is_repeated_replaces_its_rows(spark, result):
    hourly = make_hourly(spark, hours=300)
    asked = hourly.filter(F.hour("timestamp") == 9).select(
        F.monotonically_increasing_id().alias("request_id"), "station_id", F.col("timestamp").cast("string").alias("prediction_time"),
        "temperature_c", "is_holiday")
    rows = files.log_rows(serving.score_requests(asked, hourly), "v1")
    path, n = shared_dir(spark, "log"), rows.count()
    for _ in range(3):
        assert files.append_log(rows, path, "run-1") == "run-1"
    assert files.read_log(spark, path).count() == n > 0
    files.append_log(rows, path)
    assert files.read_log(spark, path).count() == 2 * n
    # Files of a run without an entry in the manifest are no part of the log.
    rows.write.json(f"{path}/runs/run=unfinished")
    assert files.read_log(spark, path).count() == 2 * n
    with pytest.raises(ValueError):
        files.append_log(rows, path, "../elsewhere")


def test_trees_are_those_of_exhaustive_search(spark):
    """Every split is the best of all, on the sample that the tree drew; nodes, values and gains agree with the rows."""
    rng = np.random.default_rng(2)
    rows = [(float(rng.integers(0, 6)), float(rng.normal()), float(rng.integers(0, 2))) for _ in range(400)]
    rows = [(a, b, c, a * 0.1 + (b > 0) * 0.3 * c + float(rng.normal()) * 0.05) for a, b, c in rows]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    model = forest.train(df, trees=3, depth=4, min_leaf=10, seed=3, max_bins=16, feature_cols=["a", "b", "c"], target="y")
    edges = growing.bounds(df, ["a", "b", "c"], 16)
    blocks = growing.binned(df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)), ["a", "b", "c"], "y", edges).collect()
    for t in model.grown:
        tree = read_blob(model.path, forest._file(t), growing.NODE)
        codes = np.concatenate([np.frombuffer(r.codes, np.uint8).reshape(-1, 3) for r in blocks])
        y = np.concatenate([np.frombuffer(r.target) for r in blocks])
        w = np.concatenate([growing.sample(3, t, r.part, r.block, len(r.target) // 8) for r in blocks]).astype(float)
        reached = {0: np.ones(len(y), bool)}
        for n in range(len(tree)):
            mine = reached[n]
            assert tree["rows"][n] == w[mine].sum() and tree["value"][n] == pytest.approx((w * y)[mine].sum() / w[mine].sum())
            best = 0.0
            for f in range(3):
                for b in range(len(edges[f])):
                    left, right = mine & (codes[:, f] <= b), mine & (codes[:, f] > b)
                    if w[left].sum() >= 10 and w[right].sum() >= 10:
                        parts = sum((w * y)[s].sum() ** 2 / w[s].sum() for s in (left, right))
                        best = max(best, parts - (w * y)[mine].sum() ** 2 / w[mine].sum())
            if tree["feature"][n] >= 0:
                assert tree["gain"][n] == pytest.approx(best)
                f, b, child = tree["feature"][n], tree["bin"][n], tree["child"][n]
                assert tree["threshold"][n] == edges[f][b]
                reached[child], reached[child + 1] = mine & (codes[:, f] <= b), mine & (codes[:, f] > b)


def test_large_nodes_are_split_by_all_tasks(spark):
    """The upper parts grown from summed histograms give the trees that one task would grow."""
    rng = np.random.default_rng(5)
    rows = [(float(rng.integers(0, 20)), float(rng.normal()), float(rng.normal())) for _ in range(3000)]
    df = spark.createDataFrame([(a, b, c, float(np.sin(a) + b * c)) for a, b, c in rows], "a double, b double, c double, y double").repartition(5)
    made = {}
    for limit in (1 << 20, 300):
        path = shared_dir(spark, "forest")
        told = growing.fit(df, ["a", "b", "c"], "y", path, 4, 6, 5, 1, 32, local_rows=limit).collect()
        assert sorted(r.tree for r in told) == [0, 1, 2, 3]
        made[limit] = [read_blob(path, forest._file(t), growing.NODE) for t in range(4)]

    def flat(tree, n=0):
        """A tree in depth-first order, whatever its numbering."""
        here = [(int(tree["feature"][n]), int(tree["bin"][n]) if tree["feature"][n] >= 0 else -1, float(tree["rows"][n]), round(float(tree["value"][n]), 9))]
        return here + (flat(tree, tree["child"][n]) + flat(tree, tree["child"][n] + 1) if tree["feature"][n] >= 0 else [])

    for whole, parts in zip(made[1 << 20], made[300]):
        assert [x[:3] for x in flat(whole)][:1][0][:2] == [x[:3] for x in flat(parts)][:1][0][:2]
        assert sorted(x for x in flat(whole) if x[0] < 0) == sorted(x for x in flat(parts) if x[0] < 0)


@pytest.mark.parametrize("whole", [True, False])
def test_large_nodes_are_counted_by_the_smaller_child(monkeypatch, whole):
    """Joint histograms, and siblings as what is left of their parent, give the same trees for less counting."""
    rng = np.random.default_rng(8)
    edges = [np.arange(n, dtype=float) for n in (30, 12, 5, 1, 40, 7)]
    codes = np.stack([rng.integers(0, len(e) + 1, 6000) for e in edges], axis=1).astype(np.uint8)
    # Sums of quarters are exact in any order; those of other numbers have rounding errors.
    target = rng.integers(0, 9, 6000) / 4.0 + (codes[:, 0] > 11) if whole else np.sin(codes[:, 0]) * codes[:, 1] + rng.normal(size=6000)
    target[codes[:, 1] == 3] = 0.3
    weight, real, counted, made = rng.poisson(1.0, 6000).astype(np.uint8), np.bincount, [], []
    monkeypatch.setattr(np, "bincount", lambda x, *a, **k: counted.append(len(x)) or real(x, *a, **k))
    for name, value in (("CHUNK_ROWS", 500), ("JOINT_CELLS", 64)):
        monkeypatch.setattr(growing, name, value)
    for many, most in ((1 << 40, 1), (1, 1 << 22), (1, 12 * growing.Bins(edges).cells)):
        monkeypatch.setattr(growing, "MANY_ROWS", many)
        monkeypatch.setattr(growing, "MOST_CELLS", most)
        counted.clear()
        made.append((growing.grow(codes, target, weight, edges, 7, 5), sum(counted)))
    (plain, plainly), (upper, fewer), (part, _) = made
    assert fewer < 0.6 * plainly
    for tree in (upper, part):
        for name in ("feature", "bin", "threshold", "child", "rows"):
            assert tree[name].tolist() == plain[name].tolist()
        assert np.allclose(tree["value"], plain["value"]) and np.allclose(tree["gain"], plain["gain"])


def test_cut_times_read_written_features(spark, monkeypatch):
    """The split asks for the features' hours; the lags and windows are not made again for them."""
    seen, real = [], windows.split_label
    monkeypatch.setattr(windows, "split_label", lambda df, **k: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, **k))
    rows = spark.range(400).selectExpr("'s' AS station_id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, id) AS timestamp", "double(id % 7) / 7 AS occupancy_rate",
                                       "20.0D AS temperature_c", "id % 2 = 0 AS is_weekend", "false AS is_holiday")
    monkeypatch.setattr(forecasts, "history", lambda *_: rows)
    made = forecasts.features(spark, "")
    assert len(seen) == 1 and "Window" not in seen[0] and made.count() == 400 - 168


def test_trees_are_sent_some_at_a_time(spark, monkeypatch):
    """Batches of trees and slabs of rows give the trees of one pass, and shuffle files go when a batch is written."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(float(rng.integers(0, 20)), float(rng.normal()), float(rng.integers(0, 9))) for _ in range(2000)], "a double, b double, y double").repartition(5)
    real, made, seen = growing._grown, [], []

    def told(*args):
        seen.append((list(args[2]), spark.conf.get(growing.CLEANUP)))
        return real(*args)

    monkeypatch.setattr(growing, "_grown", told)
    before = spark.conf.get(growing.CLEANUP)
    for rows, least, slab in ((1 << 27, 8, 1 << 22), (1, 2, 100)):
        for name, value in (("BATCH_ROWS", rows), ("LEAST_TREES", least), ("SLAB_ROWS", slab)):
            monkeypatch.setattr(growing, name, value)
        path = shared_dir(spark, "forest")
        rows = growing.fit(df, ["a", "b"], "y", path, 5, 6, 5, 1, 32, local_rows=400).collect()
        assert sorted(r.tree for r in rows) == list(range(5))
        made.append([read_blob(path, forest._file(t), growing.NODE) for t in range(5)])
    assert seen == [(part, "true") for part in ([0, 1, 2, 3, 4], [0, 1], [2, 3], [4])]
    assert spark.conf.get(growing.CLEANUP) == before
    for one, other in zip(*made):
        assert all((one[c] == other[c]).all() for c in ("feature", "bin", "rows"))


def test_rows_reach_the_leaves_of_a_plain_descent():
    rng = np.random.default_rng(7)
    tree = np.zeros(7, growing.NODE)
    tree["feature"], tree["threshold"], tree["child"] = [0, 1, -1, -1, 0, -1, -1], [0.0, 0.5, 0, 0, -1.0, 0, 0], [1, 3, 0, 0, 5, 0, 0]
    rows = np.concatenate([rng.normal(size=(200, 2)), [[np.nan, np.inf], [-np.inf, np.nan], [np.inf, -np.inf]]])

    def plain(row, n=0):
        return n if tree["feature"][n] < 0 else plain(row, tree["child"][n] + int(row[tree["feature"][n]] > tree["threshold"][n]))

    assert growing.descend(tree, tree["threshold"], np.inf, rows).tolist() == [plain(r) for r in rows]
    assert growing.descend(tree, tree["threshold"], np.inf, rows[:0]).tolist() == []


def test_a_forest_is_fitted_once_for_a_table(spark, monkeypatch):
    df = spark.createDataFrame([(float(k % 7), float(k % 3), float(k % 7 > 2)) for k in range(300)], "a double, b double, y double")
    fits = []
    real = growing.fit
    monkeypatch.setattr(growing, "fit", lambda *a, **k: fits.append(1) or real(*a, **k))
    ask = lambda rows, **k: forest.fitted(rows, **{"trees": 2, "depth": 3, "min_leaf": 5, "feature_cols": ["a", "b"], "target": "y", **k})
    first = ask(df)
    assert ask(df.repartition(7)).path == first.path and len(fits) == 1
    assert ask(df, depth=2).path != first.path and len(fits) == 2
    assert ask(df.union(df.limit(1))).path != first.path and len(fits) == 3


def test_trees_stay_off_the_driver_at_300_by_16(spark, monkeypatch):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(rng.normal()), float(rng.normal()), float(rng.normal())) for _ in range(2000)], "a double, b double, y double")
    model = forest.train(df, trees=300, depth=16, min_leaf=1, feature_cols=["a", "b"], target="y", max_bins=64)
    rows = forest.tree_predictions(model, df).withColumn("mean", model.mean)
    for r in rows.limit(50).collect():
        assert len(r.tree_predictions) == 300
    assert model.nodes > 300 * 200
    # What the driver holds of a model is its description.
    assert len(json.dumps(dataclasses.asdict(model))) < 10_000


def test_a_forest_without_rows(spark):
    df = spark.createDataFrame([], "a double, y double")
    model = forest.train(df, trees=2, depth=3, feature_cols=["a"], target="y")
    assert model.grown == [] and model.nodes == 0
    one = spark.createDataFrame([(1.0, 0.5)], "a double, y double")
    assert forest.predict(model, one).first().predicted_occupancy is None
    assert forest.tree_predictions(model, one).first().tree_predictions == []


def test_registered_models_have_the_plans_sizes(spark, sf_dir, monkeypatch):
    asked = {}

    def told(name, fn):
        def stub(*args, **kwargs):
            bound = inspect.signature(fn).bind(*args, **kwargs)
            bound.apply_defaults()
            asked[name] = {k: v for k, v in bound.arguments.items() if k in ("trees", "depth", "min_leaf", "max_bins", "rounds")}
        return stub

    for name, module, attribute in (("forest", forest, "fitted"), ("job", training, "train_and_evaluate"),
                                    ("demand", boosting, "SessionDemandModel"), ("wait", boosting, "WaitTimeModel")):
        monkeypatch.setattr(module, attribute, told(name, getattr(module, attribute)))
    rows = spark.createDataFrame([], "split string")
    monkeypatch.setattr(forecasts, "features", lambda *_: rows)
    for build in (lambda s, d: forecasts.model(rows), forecasts.trained, forecasts.demand_model, forecasts.wait_model):
        build(spark, sf_dir)
    full = {"trees": 200, "depth": 16, "min_leaf": 10, "max_bins": 128}
    assert asked == {"forest": full, "job": full, "demand": {"trees": 100, "depth": 8}, "wait": {"rounds": 80, "depth": 4}}


def test_model_queries_cover_all_feature_rows(spark, sf_dir, result, monkeypatch):
    """Train and validation rows too; a small model stands in, as only rows are counted."""
    monkeypatch.setattr(forecasts, "model", lambda *_: result.model)
    rows = forecasts.features(spark, sf_dir)
    n = rows.count()
    assert n > rows.filter("split = 'test'").count()
    assert forecasts.tree_dispersion(spark, sf_dir).count() == n
    assert forecasts.feature_context(spark, sf_dir).filter("position = 0").count() == n
    assert {r.n_rows for r in forecasts.ablation(spark, sf_dir).collect()} == {n}


def test_dashboard_values_are_those_of_its_tables(spark, sf_dir, monkeypatch):
    """The digest tells values apart and doesn't depend on the order of rows."""
    shapes = {"a": ("", ["k"], {"v": None, "x": 2}), "b": ("", ["k"], {"v": None})}
    kind = "k int, v string, x double"
    tables = {"a": spark.createDataFrame([(1, "x", 0.5), (2, None, None)], kind), "b": spark.createDataFrame([], kind)}
    monkeypatch.setattr(aggregates, "DASHBOARD", shapes)
    monkeypatch.setattr(aggregates.network, "network_dashboard", lambda *_: tables)
    told = lambda: {r["name"]: (r.n, r.n_values, r.digest) for r in aggregates.dashboard_values(spark, sf_dir).collect()}
    first = told()
    assert first["a"][:2] == (2, 2) and "b" not in first
    assert sorted(tuple(r) for r in aggregates.dashboard_tables(spark, sf_dir).filter("row_key = '1'").collect()) == [("a", "1", "v", "x"), ("a", "1", "x", "0.50")]
    tables["a"] = spark.createDataFrame([(2, None, None), (1, "x", 0.5)], kind)
    assert told() == first
    tables["a"] = spark.createDataFrame([(2, None, None), (1, "y", 0.5)], kind)
    assert told()["a"] != first["a"]


def test_every_dashboard_table_and_column_is_shown(spark, sf_dir):
    tables = aggregates.network.network_dashboard(fixtures.stations(spark, sf_dir), fixtures.sessions(spark, sf_dir), fixtures.status(spark, sf_dir))
    assert tables.keys() == aggregates.DASHBOARD.keys() and len(tables) == 19
    for name, (_, keys, columns) in aggregates.DASHBOARD.items():
        assert sorted(tables[name].columns) == sorted([*keys, *columns]), name


def test_dashboard_tables_share_written_inputs(spark, sf_dir):
    from voltlattice.plans import network

    tables = network.network_dashboard(fixtures.stations(spark, sf_dir), fixtures.sessions(spark, sf_dir), fixtures.status(spark, sf_dir))
    for name, source in [("kpis", "status"), ("alerts", "status"), ("segments", "sessions"), ("expansion", "stations")]:
        assert any(f"dashboard-{source}-" in f for f in tables[name].inputFiles())
