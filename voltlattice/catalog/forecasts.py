"""Forest, booster and the jobs built on them. Checked by invariants instead of SQL.

Models have the plans' own sizes. A forest is fitted once for a training table and stored by the
table's digest; the queries that need it load it.
"""

from pyspark.sql import functions as F

from voltlattice.catalog.aggregates import metric_sql
from voltlattice.catalog.functions import queues
from voltlattice.catalog.joins import BETTER, DECIDED
from voltlattice.catalog.registry import band, d, query
from voltlattice.functions.rounding import pround
from voltlattice.operators import boosting, forest, metrics, windows
from voltlattice.plans import decision, serving, training, waiting
from voltlattice.schemas import FEATURE_COLS
from voltlattice.session import materialize, shared_dir
from voltlattice.sources import files, fixtures as fx

#: Sizes of the full forest, as the plans have them by default.
TREES, DEPTH = 200, 16


def history(spark, sf_dir):
    return materialize(fx.hourly(spark, sf_dir), "history")


def features(spark, sf_dir, hours=None):
    # The cut times read the features too: unwritten, they would be made twice.
    made = materialize(training.build_training_features(history(spark, sf_dir) if hours is None else hours), "unsplit")
    return materialize(windows.split_label(made, train=0.70, val=0.15, test=0.15), "features")


def model(rows):
    """The forest of the training rows; fitted once for a table and loaded afterwards."""
    return forest.fitted(rows.filter("split = 'train'"))


def trained(spark, sf_dir):
    return training.train_and_evaluate(history(spark, sf_dir))


def scored(spark, sf_dir):
    rows = features(spark, sf_dir)
    return forest.predict(model(rows), rows)


@query("ml_1_train_forest")
def train_forest(spark, sf_dir):
    """Train and validation metrics of the fitted forest."""
    return metrics.metrics(scored(spark, sf_dir).filter("split <> 'test'"), "predicted_occupancy", by=["split"])


@query("ml_2_test_metrics")
def test_metrics(spark, sf_dir):
    return metrics.metrics(scored(spark, sf_dir).filter("split = 'test'"), "predicted_occupancy")


@query("ml_3_predict", """SELECT station_id, "timestamp", split, TRUE AS in_range, TRUE AS status_matches FROM labelled""")
def predict(spark, sf_dir):
    """Every feature row predicted: inside [0, 1], with the status of its unrounded value."""
    from voltlattice.functions.occupancy import status_band

    p = F.col("predicted_occupancy")
    return scored(spark, sf_dir).select(
        "station_id", "timestamp", "split", p.between(0, 1).alias("in_range"),
        (F.col("predicted_status") == status_band(p)).alias("status_matches"),
    )


@query("ml_4_importances")
def importances(spark, sf_dir):
    return forest.importances(model(features(spark, sf_dir)), spark)


@query("ml_5_tree_predictions", f"""SELECT station_id, "timestamp", CAST({TREES} AS INTEGER) AS n_trees, TRUE AS mean_is_prediction FROM labelled""")
def tree_predictions(spark, sf_dir):
    """The mean of the per-tree values is the forest's prediction on every row."""
    rows = features(spark, sf_dir)
    fitted = model(rows)
    trees = forest.tree_predictions(fitted, forest.predict(fitted, rows))
    values = F.col("tree_predictions")
    return trees.select(
        "station_id", "timestamp", F.size(values).alias("n_trees"),
        (F.abs(forest.mean_of_trees(values) - F.col("predicted_occupancy")) < 1e-9).alias("mean_is_prediction"),
    )


@query("agg_21_tree_dispersion")
def tree_dispersion(spark, sf_dir):
    rows = features(spark, sf_dir)
    return forest.add_tree_dispersion(forest.tree_predictions(model(rows), rows)).select("station_id", "timestamp", "tree_dispersion.*")


@query("top_10_feature_context")
def feature_context(spark, sf_dir):
    rows = features(spark, sf_dir)
    return context_rows(rows, forest.importance_list(model(rows)))


def context_rows(rows, importances):
    items = forest.top_feature_context(importances, 5)
    return rows.select("station_id", "timestamp", F.posexplode(items).alias("position", "item")).select(
        "station_id", "timestamp", "position", "item.*"
    )


@query("ml_8_ablation")
def ablation(spark, sf_dir):
    """Mean change of the prediction per zeroed feature group."""
    rows = features(spark, sf_dir)
    return group_means(forest.ablation(model(rows), rows))


def group_means(rows):
    return rows.groupBy("feature_group").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("baseline").alias("baseline"), F.avg("ablated").alias("ablated"),
        F.avg("delta").alias("delta"),
    )


_CYCLES = {"hour_sin": "sin(2 * pi() * hour / 24)", "hour_cos": "cos(2 * pi() * hour / 24)",
           "day_sin": "sin(2 * pi() * day_of_week / 7)", "day_cos": "cos(2 * pi() * day_of_week / 7)"}


def _zeroed_sql():
    for name, columns in forest.ABLATION_GROUPS.items():
        sums = ", ".join(f"(CAST(printf('%.4f', {'0.0' if c in columns else f'sum(CAST({_CYCLES.get(c, c)} AS DOUBLE))'}) AS DOUBLE) + 0.0) AS {c}_sum" for c in FEATURE_COLS)
        yield f"SELECT station_id, '{name}' AS feature_group, count(*) AS n_rows, {sums} FROM labelled GROUP BY station_id"


@query("jn_12_feature_group_rows", " UNION ALL ".join(_zeroed_sql()))
def feature_group_rows(spark, sf_dir):
    """Every feature row once for each group, with the group's columns zeroed: their sums by station."""
    rows = forest.zeroed(features(spark, sf_dir))
    return rows.groupBy("station_id", "feature_group").agg(
        F.count(F.lit(1)).alias("n_rows"), *(pround(F.sum(F.col(c).cast("double")), 4).alias(f"{c}_sum") for c in FEATURE_COLS))


def _compared(spark, sf_dir):
    rows = features(spark, sf_dir)
    test = forest.baseline_predict(rows.filter("split = 'test'")).withColumnRenamed(
        "predicted_occupancy", "baseline").drop("predicted_status")
    return metrics.compare_models(forest.predict(model(rows), test), "baseline", "predicted_occupancy")


@query("ml_9_model_comparison")
def model_comparison(spark, sf_dir):
    return _compared(spark, sf_dir)


@query("ml_9_baseline_side", f"SELECT {metric_sql(digits=(5, 5, 4))} FROM labelled WHERE split = 'test'")
def baseline_side(spark, sf_dir):
    """The baseline half of the comparison, which SQL can state."""
    return _compared(spark, sf_dir).select(*[F.col(f"baseline_{m}").alias(m) for m in ("mae", "rmse", "r2")])


# A target that two features decide: a forest of full size must learn it exactly, so SQL can state its values.
SEPARABLE = "CASE WHEN hour < 8 THEN 0.25 WHEN lag_24h <= 0.5 THEN 0.5 ELSE 1.0 END"
SEPARABLE_SQL = f"SELECT *, CAST({SEPARABLE} AS DOUBLE) AS y FROM labelled"


def separable(spark, sf_dir):
    """(feature rows with the target, the full-size forest fitted to it)."""
    rows = features(spark, sf_dir).withColumn("y", F.expr(SEPARABLE).cast("double"))
    return rows, forest.fitted(rows.filter("split = 'train'"), target="y")


@query("ml_3_separable_target", f"""
    SELECT station_id, "timestamp", split, y AS predicted_occupancy,
      CASE WHEN y >= 0.9 THEN 'CRITICAL' WHEN y >= 0.7 THEN 'BUSY' WHEN y >= 0.4 THEN 'MODERATE' ELSE 'AVAILABLE' END AS predicted_status
    FROM ({SEPARABLE_SQL})""")
def predict_separable(spark, sf_dir):
    """Predictions of every row, checked by value."""
    rows, fitted = separable(spark, sf_dir)
    return forest.predict(fitted, rows).select("station_id", "timestamp", "split", "predicted_occupancy", "predicted_status")


@query("agg_21_separable_dispersion", f"""
    SELECT station_id, "timestamp", y AS tree_mean, CAST(0 AS DOUBLE) AS tree_std, y AS tree_min, y AS tree_max, y AS p10, y AS p90,
      CAST({TREES} AS INTEGER) AS estimator_count, CAST(100 AS DOUBLE) AS status_consensus_pct FROM ({SEPARABLE_SQL})""")
def separable_dispersion(spark, sf_dir):
    """The spread of trees that all learn the same function."""
    rows, fitted = separable(spark, sf_dir)
    return forest.add_tree_dispersion(forest.tree_predictions(fitted, rows)).select("station_id", "timestamp", "tree_dispersion.*")


@query("ml_8_separable_ablation", " UNION ALL ".join(f"""
    SELECT '{name}' AS feature_group, count(*) AS n_rows, (CAST(printf('%.6f', avg(y)) AS DOUBLE) + 0.0) AS baseline,
      (CAST(printf('%.6f', avg({zeroed})) AS DOUBLE) + 0.0) AS ablated, (CAST(printf('%.6f', avg({zeroed} - y)) AS DOUBLE) + 0.0) AS delta FROM ({SEPARABLE_SQL})"""
    for name, columns in forest.ABLATION_GROUPS.items()
    for zeroed in ["0.25" if "hour" in columns else "CAST(CASE WHEN hour < 8 THEN 0.25 ELSE 0.5 END AS DOUBLE)" if "lag_24h" in columns else "y"]))
def separable_ablation(spark, sf_dir):
    """Mean predictions with each feature group zeroed, checked by value."""
    rows, fitted = separable(spark, sf_dir)
    means = group_means(forest.ablation(fitted, rows))
    return means.withColumns({c: pround(c, 6) for c in ("baseline", "ablated", "delta")})


def demand_model(spark, sf_dir):
    return boosting.SessionDemandModel(fx.sessions(spark, sf_dir), fx.stations(spark, sf_dir))


@query("ml_6_session_demand")
def session_demand(spark, sf_dir):
    """A 24-hour forecast for every station on every day it has sessions."""
    fitted = demand_model(spark, sf_dir)
    days = fx.sessions(spark, sf_dir).select("station_id", F.to_date("start_time").alias("date")).distinct()
    return fitted.predict_day(days)


@query("ml_6_session_demand_metrics")
def session_demand_metrics(spark, sf_dir):
    return demand_model(spark, sf_dir).evaluate()


def wait_model(spark, sf_dir):
    return boosting.WaitTimeModel(fx.sessions(spark, sf_dir), fx.stations(spark, sf_dir))


@query("ml_7_wait_model")
def wait_model_error(spark, sf_dir):
    return wait_model(spark, sf_dir).evaluate()


@query("job_8_estimate_wait")
def estimate_wait(spark, sf_dir):
    return waiting.estimate_wait(
        queues(spark, sf_dir), fx.sessions(spark, sf_dir), fx.stations(spark, sf_dir), wait_model(spark, sf_dir)
    )


@query("job_3_train_and_evaluate")
def train_and_evaluate(spark, sf_dir):
    report = trained(spark, sf_dir).report
    return report.select("dataset.*", "baseline.test_metrics.*", F.col("improvement_over_baseline_pct.mae").alias("mae_gain"),
                         F.size("error_analysis.by_city").alias("n_cities"), F.size("error_analysis.by_hour_worst5").alias("n_worst"))


@query("snk_3_evaluation_report", """
    SELECT count(*) AS featured_rows, count(*) FILTER (split = 'test') AS rows, 16 AS n_features, 'occupancy_rate' AS target_col FROM labelled""")
def evaluation_report(spark, sf_dir):
    path = shared_dir(spark, "report")
    trained(spark, sf_dir).report.write.json(path)
    back = spark.read.json(path)
    return back.select("dataset.featured_rows", "splits.test.rows", F.size("feature_cols").alias("n_features"), "target_col")


def saved(spark, result):
    return files.save_model(result.model, shared_dir(spark, "model"), training.model_metadata(result))


@query("snk_4_save_model", f"""
    SELECT 'RandomForestRegressor' AS model_type, CAST({TREES} AS BIGINT) AS n_estimators, CAST({DEPTH} AS BIGINT) AS max_depth,
      CAST(16 AS BIGINT) AS n_features, count(*) AS rows FROM labelled WHERE split = 'train'""")
def save_model(spark, sf_dir):
    _, metadata = files.load_model(spark, saved(spark, trained(spark, sf_dir)))
    return metadata.select("model_type", "n_estimators", "max_depth", "n_features", "splits.train.rows")


@query("src_5_load_model", """SELECT station_id, "timestamp", TRUE AS same FROM labelled WHERE split = 'test'""")
def load_model(spark, sf_dir):
    """A reloaded model predicts what the fitted one does."""
    result = trained(spark, sf_dir)
    loaded, _ = files.load_model(spark, saved(spark, result))
    test = result.features.filter("split = 'test'")
    first = forest.predict(result.model, test).withColumnRenamed("predicted_occupancy", "first").drop("predicted_status")
    return forest.predict(loaded, first).select(
        "station_id", "timestamp", (F.col("first") == F.col("predicted_occupancy")).alias("same")
    )


@query("job_4_score_requests")
def score_requests(spark, sf_dir):
    fitted = model(features(spark, sf_dir))
    df = serving.score_requests(
        fx.requests(spark, sf_dir), history(spark, sf_dir), lambda rows: forest.predict(fitted, rows), fx.stations(spark, sf_dir)
    )
    return df.select("request_id", "station_id", "predicted_occupancy", "predicted_status", *serving.context())


@query("job_4_score_requests_baseline", """
    SELECT request_id, station_id, (CAST(printf('%.4f', least(greatest(lag_24h, 0), 1)) AS DOUBLE) + 0.0) AS predicted_occupancy,
      CASE WHEN lag_24h >= CAST(0.9 AS DOUBLE) THEN 'CRITICAL' WHEN lag_24h >= CAST(0.7 AS DOUBLE) THEN 'BUSY'
           WHEN lag_24h >= CAST(0.4 AS DOUBLE) THEN 'MODERATE' ELSE 'AVAILABLE' END AS predicted_status
    FROM checked WHERE error_code IS NULL""")
def score_requests_baseline(spark, sf_dir):
    df = serving.score_requests(fx.requests(spark, sf_dir), history(spark, sf_dir), stations=fx.stations(spark, sf_dir))
    return df.select("request_id", "station_id", "predicted_occupancy", "predicted_status")


@query("job_5_explain_requests")
def explain_requests(spark, sf_dir):
    df = serving.explain_requests(fx.requests(spark, sf_dir), history(spark, sf_dir), model(features(spark, sf_dir)), stations=fx.stations(spark, sf_dir))
    path = shared_dir(spark, "explained")
    df = materialize(df, "explained")
    files.append_log(files.log_rows(df, "forest"), path)
    logged = files.read_log(spark, path).groupBy("station_id").agg(F.count(F.lit(1)).alias("n_logged"))
    spread = df.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n"), pround(F.avg("tree_dispersion.tree_std"), 4).alias("mean_std"),
        F.min("tree_dispersion.estimator_count").alias("trees"), F.min(F.size("top_feature_context")).alias("n_top"),
    )
    return spread.join(logged, "station_id")


_STATUS_AT = "AVAILABLE MODERATE BUSY CRITICAL".split()


@query("job_6_decision_documents", f"""
    WITH {DECIDED}, listed AS (SELECT request_id, count(*) AS n, string_agg(rank || ':' || station_id || ':' || printf('%.4f', predicted_occupancy) || ':' || printf('%.2f', distance_km), ';' ORDER BY rank) AS told
      FROM ordered WHERE rank <= 3 GROUP BY request_id)
    SELECT t.request_id, CASE WHEN occ < {d(0.7)} THEN 'STAY' WHEN {BETTER} THEN 'REROUTE' ELSE 'NO_BETTER_ALTERNATIVE' END AS recommendation,
      coalesce(n, 0) AS n_alternatives, coalesce(told, '') AS alternatives, CAST({TREES} AS INTEGER) AS estimator_count,
      CASE WHEN t.raw_status IN ('BUSY', 'CRITICAL') THEN 'How should an operator handle a ' || t.raw_status || ' occupancy prediction at an EV charging station?' END AS asked
    FROM (SELECT *, {band("raw")} AS raw_status FROM targets) t LEFT JOIN (SELECT * FROM ordered WHERE rank = 1) b USING (request_id) LEFT JOIN listed l USING (request_id)""")
def decision_documents(spark, sf_dir):
    """Decisions with nested alternatives, a forest's diagnostics of the target, and retrieved context for crowded ones.

    The baseline predicts, so that SQL can state the decisions; the forest only explains the targets.
    """
    hours = history(spark, sf_dir)
    fitted = model(features(spark, sf_dir, hours))
    decisions, alternatives = decision.decide(
        fx.requests(spark, sf_dir), fx.stations(spark, sf_dir), hours, forest.baseline_predict, model=fitted, explain_only=True)
    # Some vectors stand for the embeddings of the four questions.
    number = F.col("vec_id").cast("int")
    asked = fx.table(spark, sf_dir, "embeddings").filter(number < 4).select(
        F.get(F.array(*(F.lit(s) for s in _STATUS_AT)), number).alias("status"), F.col("embedding").cast("array<double>").alias("embedding"))
    chunks = fx.vectors(spark, sf_dir).select("chunk_id", F.lit("vectors").alias("source"), F.lit("").alias("section_title"), F.col("chunk_id").alias("text"))
    told = decision.with_retrieval_context(
        decision.decision_documents(decisions, alternatives), asked, fx.vectors(spark, sf_dir), chunks,
        wanted=F.col("selected_station.status").isin("BUSY", "CRITICAL"))
    listed = F.transform(F.coalesce("alternatives", F.array().cast(told.schema["alternatives"].dataType)), lambda a: F.concat_ws(
        ":", a["rank"].cast("string"), a["station_id"], F.format_string("%.4f", a["predicted_occupancy"]), F.format_string("%.2f", a["distance_km"])))
    return told.select("request_id", "recommendation", F.size(listed).cast("long").alias("n_alternatives"), F.array_join(listed, ";").alias("alternatives"),
                       "tree_dispersion.estimator_count", F.col("retrieval_context.question").alias("asked"))
