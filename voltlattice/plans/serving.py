"""Request tables in, features, scores and explanations out."""

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from voltlattice.functions import calendar as cal, occupancy as occ
from voltlattice.functions.rounding import pround
from voltlattice.operators import forest, history as hist, quality
from voltlattice.schemas import KEY_FEATURES


def features_at(points: DataFrame, history: DataFrame, stations: DataFrame | None = None,
                packed: DataFrame | None = None) -> DataFrame:
    """Features and ``error_code`` for rows (station_id, ts, temperature_c, is_holiday)."""
    return complete_features(hist.attach_history(points, history, stations, packed))


def complete_features(looked_up: DataFrame) -> DataFrame:
    """Calendar features, flags and ``error_code`` beside features from history."""
    return looked_up.withColumns({
        **hist.calendar_features(F.col("ts")),
        "is_holiday": F.coalesce(cal.flag(F.col("is_holiday")), F.lit(0)),
        "error_code": quality.request_error(),
    })


def build_request_features(requests: DataFrame, history: DataFrame, stations: DataFrame | None = None,
                           packed: DataFrame | None = None) -> DataFrame:
    """Every request with its features, or with the first error that applies."""
    timed = requests.withColumn("ts", cal.parse_naive(F.col("prediction_time")))
    return features_at(timed, history, stations, packed).withColumn("error_status", quality.error_status(F.col("error_code")))


def valid(built: DataFrame) -> DataFrame:
    return built.filter("error_code IS NULL").drop("error_code", "error_status", "known_station")


def rejected(built: DataFrame) -> DataFrame:
    return built.filter("error_code IS NOT NULL").select(
        "request_id", "station_id", "prediction_time", "error_code", "error_status"
    )


def context() -> dict:
    """Descriptive context columns of a feature row."""
    return {
        "time_period": occ.time_period(F.col("hour")),
        "context_lag_1h": pround("lag_1h", 4),
        "context_lag_24h": pround("lag_24h", 4),
        "context_lag_168h": pround("lag_168h", 4),
        "context_rolling_mean_24h": pround("rolling_mean_24h", 4),
        "context_is_weekend": F.col("is_weekend") == 1,
        "context_is_holiday": F.col("is_holiday") == 1,
        "recent_24h_trend": occ.trend_label(F.col("rolling_mean_24h")),
    }


def key_features():
    return F.struct(*KEY_FEATURES).alias("key_features")


def score_requests(requests: DataFrame, history: DataFrame,
                   predict: Callable[[DataFrame], DataFrame] = forest.baseline_predict, stations: DataFrame | None = None) -> DataFrame:
    """Valid requests with prediction, status from the unrounded value, and context.

    Known are the ``stations`` given; without them, the distinct ones of the whole history.
    """
    scored = predict(valid(build_request_features(requests, history, stations)))
    return scored.withColumns({**context(), "predicted_occupancy": pround("predicted_occupancy", 4)})


def explain_requests(requests: DataFrame, history: DataFrame, model, top_n: int = 5, stations: DataFrame | None = None) -> DataFrame:
    """Scored requests with the top feature context and the spread of the trees."""
    rows = valid(build_request_features(requests, history, stations))
    spread = forest.add_tree_dispersion(forest.tree_predictions(model, rows))
    mean = forest.mean_of_trees(F.col("tree_predictions"))
    return spread.withColumns({
        **context(),
        "predicted_occupancy": pround(mean, 4),
        "predicted_status": occ.status_band(mean),
        "top_feature_context": forest.top_feature_context(forest.importance_list(model), top_n),
    }).drop("tree_predictions")


def predict_batches(items: DataFrame, predict, batch: str = "batch_id") -> DataFrame:
    """Results of accepted batches with the index each item had on input (column ``index``)."""
    checked = quality.validate_rows(items, quality.feature_range_rules())
    verdict = quality.accept_batches(checked, ~F.col("is_valid"), batch).filter("accepted")
    kept = checked.join(verdict.select(batch), batch, "left_semi").drop("errors", "is_valid")
    return predict(kept).select(batch, "index", "predicted_occupancy", "predicted_status")
