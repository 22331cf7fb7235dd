"""Training features, chronological split, training and evaluation."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from voltlattice.functions import calendar as cal
from voltlattice.operators import forest, metrics, quality, windows
from voltlattice.schemas import FEATURE_COLS, TARGET_COL
from voltlattice.session import materialize


def calendar_columns(df: DataFrame) -> DataFrame:
    ts = F.col("timestamp")
    return df.withColumns({
        **cal.calendar_parts(ts), **cal.cyclical_parts(ts),
        "is_weekend": cal.flag(F.col("is_weekend")), "is_holiday": cal.flag(F.col("is_holiday")),
    })


def build_training_features(hourly: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Hourly history to leakage-free features; rows with any NULL are dropped.

    All lags and rolling statistics share one window, so there is one shuffle and one sort.
    ``block_rows`` cuts long station series into blocks for more parallelism, with equal results.
    """
    base = calendar_columns(hourly)
    if block_rows:
        featured = windows.blocked_lags(base, TARGET_COL, block_rows)
    else:
        featured = base.withColumns({**windows.lag_columns(), **windows.rolling_columns()})
    return featured.na.drop("any")


@dataclass
class TrainingResult:
    model: forest.ForestModel
    features: DataFrame
    report: DataFrame
    importances: DataFrame
    slices: DataFrame


def train_and_evaluate(hourly: DataFrame, trees=200, depth=16, min_leaf=10, seed=42, max_bins=128) -> TrainingResult:
    """Features, 70/15/15 split by time, forest, metrics against the lag-24h baseline, report."""
    spark = hourly.sparkSession
    # The cut times read the features too: unwritten, they would be made twice.
    made = materialize(build_training_features(hourly), "unsplit")
    features = materialize(windows.split_label(made, train=0.70, val=0.15, test=0.15), "features")
    if not quality.splits_disjoint(features).first()["disjoint"]:
        raise ValueError("the time ranges of the splits overlap")
    model = forest.fitted(features.filter("split = 'train'"), trees, depth, min_leaf, seed, max_bins)
    baseline = F.least(F.greatest("lag_24h", F.lit(0.0)), F.lit(1.0))
    # Every part of the report reads the predictions, so the forest scores the rows once.
    scored = materialize(forest.predict(model, features).withColumn("baseline", baseline), "scored")
    test = scored.filter("split = 'test'")
    importances = forest.importances(model, spark)
    slices = metrics.error_slices(test, "predicted_occupancy")
    report = evaluation_report(hourly, scored, slices, importances, trees, depth, min_leaf, seed)
    return TrainingResult(model, features, report, importances, slices)


def evaluation_report(hourly, scored, slices, importances, trees, depth, min_leaf, seed) -> DataFrame:
    """One nested row: sizes, date ranges, metrics, improvement, slices, top importances."""
    def gathered(df, *order):
        # At most one row per city, hour or charger type, or one per feature.
        return df.agg(F.array_sort(F.collect_list(F.struct(*order))).alias("v")).scalar()

    per_split = {
        name: scored.filter(F.col("split") == name).agg(F.struct(
            F.count(F.lit(1)).alias("rows"), F.min("timestamp").cast("string").alias("min"),
            F.max("timestamp").cast("string").alias("max"),
            F.struct(*metrics.metric_columns(TARGET_COL, "predicted_occupancy")).alias("metrics"),
        ).alias("v")).scalar()
        for name in ("train", "val", "test")
    }
    by_hour = slices.filter("dimension = 'hour'")
    hour_fields = [F.col("value").cast("int").alias("hour"), F.col("mae"), F.col("rmse"), F.col("r2")]
    worst = by_hour.orderBy(F.desc("mae"), F.col("value").cast("int")).limit(5)
    best = by_hour.orderBy(F.asc("mae"), F.col("value").cast("int")).limit(5)
    compared = metrics.compare_models(scored.filter("split = 'test'"), "baseline", "predicted_occupancy")
    return compared.select(
        F.lit(TARGET_COL).alias("target_col"),
        F.array(*[F.lit(c) for c in FEATURE_COLS]).alias("feature_cols"),
        F.struct(
            hourly.agg(F.count(F.lit(1)).alias("n")).scalar().alias("raw_rows"),
            scored.agg(F.count(F.lit(1)).alias("n")).scalar().alias("featured_rows"),
        ).alias("dataset"),
        F.struct(*[per_split[n].alias(n) for n in per_split]).alias("splits"),
        F.struct(
            F.lit("Seasonal Lag-24h Baseline").alias("name"),
            F.struct(*[F.col(f"baseline_{m}").alias(m) for m in ("mae", "rmse", "r2")]).alias("test_metrics"),
        ).alias("baseline"),
        F.struct(
            F.lit(trees).alias("n_estimators"), F.lit(depth).alias("max_depth"),
            F.lit(min_leaf).alias("min_samples_leaf"), F.lit(seed).alias("random_state"),
        ).alias("random_forest"),
        F.struct(
            F.col("mae_improvement_pct").alias("mae"), F.col("rmse_improvement_pct").alias("rmse")
        ).alias("improvement_over_baseline_pct"),
        F.struct(
            gathered(slices.filter("dimension = 'city'"), "value", "mae", "rmse", "r2").alias("by_city"),
            gathered(slices.filter("dimension = 'charger_type'"), "value", "mae", "rmse", "r2").alias("by_charger_type"),
            gathered(worst, F.col("mae"), *hour_fields[:1], F.col("rmse"), F.col("r2")).alias("by_hour_worst5"),
            gathered(best, F.col("mae"), *hour_fields[:1], F.col("rmse"), F.col("r2")).alias("by_hour_best5"),
        ).alias("error_analysis"),
        gathered(importances.limit(5), "position", "feature", "importance").alias("feature_importance_top5"),
    )


def model_metadata(result: TrainingResult) -> DataFrame:
    """Metadata row stored with a model."""
    return result.report.select(
        F.lit("RandomForestRegressor").alias("model_type"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("trained_at"),
        "random_forest.*", "feature_cols", "target_col", F.size("feature_cols").alias("n_features"), "splits",
    )
