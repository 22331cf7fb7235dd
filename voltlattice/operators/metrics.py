"""Regression metrics, error slices, comparisons and retrieval score summaries."""

from pyspark.sql import Column, DataFrame, functions as F

from voltlattice.functions.rounding import pround
from voltlattice.schemas import TARGET_COL


def metric_columns(actual: str, predicted: str, digits=(5, 5, 4)) -> list[Column]:
    """MAE, RMSE and R2 as one mergeable aggregation.

    A constant target scores 1 when every prediction is exact, else 0; R2 of a single row is NULL.
    """
    error = F.col(actual) - F.col(predicted)
    sse = F.sum(error * error)
    sst = F.var_pop(actual) * F.count(F.col(actual))
    r2 = F.when(sst == 0, F.when(sse == 0, 1.0).otherwise(0.0)).otherwise(1 - sse / sst)
    return [
        pround(F.avg(F.abs(error)), digits[0]).alias("mae"),
        pround(F.sqrt(F.avg(error * error)), digits[1]).alias("rmse"),
        pround(F.when(F.count(F.lit(1)) > 1, r2), digits[2]).alias("r2"),
    ]


def metrics(df: DataFrame, predicted: str, actual: str = TARGET_COL, by=(), digits=(5, 5, 4)) -> DataFrame:
    """Metrics overall or per group; rows without a group key are left out."""
    columns = metric_columns(actual, predicted, digits)
    return df.dropna(subset=list(by)).groupBy(*by).agg(*columns) if by else df.agg(*columns)


def error_slices(df: DataFrame, predicted: str, by=("city", "hour", "charger_type"), digits=(5, 5, 4)) -> DataFrame:
    """Every slice in one pass with grouping sets: (dimension, value, mae, rmse, r2)."""
    keys = [F.col(c) for c in by]
    grouped = df.groupingSets([[k] for k in keys], *keys).agg(
        *[F.grouping(k).alias(f"_g_{c}") for k, c in zip(keys, by)], *metric_columns(TARGET_COL, predicted, digits)
    )
    dimension = F.coalesce(*[F.when(F.col(f"_g_{c}") == 0, F.lit(c)) for c in by])
    value = F.coalesce(*[F.when(F.col(f"_g_{c}") == 0, F.col(c).cast("string")) for c in by])
    return grouped.select(dimension.alias("dimension"), value.alias("value"), "mae", "rmse", "r2").filter(
        F.col("value").isNotNull()
    )


def improvement_pct(baseline: Column, model: Column, digits: int = 2) -> Column:
    return pround((baseline - model) / baseline * 100, digits)


def compare_models(df: DataFrame, baseline: str, model: str) -> DataFrame:
    """Two metric rows and the improvement in percent, from one scan."""
    def named(prefix, predicted):
        return [c.alias(f"{prefix}_{n}") for c, n in zip(metric_columns(TARGET_COL, predicted), ("mae", "rmse", "r2"))]

    return df.agg(*named("baseline", baseline), *named("model", model)).withColumns({
        "mae_improvement_pct": improvement_pct(F.col("baseline_mae"), F.col("model_mae")),
        "rmse_improvement_pct": improvement_pct(F.col("baseline_rmse"), F.col("model_rmse")),
    })


def retrieval_summary(scored: DataFrame, prior: DataFrame) -> DataFrame:
    """Old against new scores per category; a question without a prior score counts 0.0."""
    joined = scored.join(prior, "query_id", "left").withColumn("old_score", F.coalesce("old_score", F.lit(0.0)))
    return joined.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.avg("old_score").alias("old_avg"), F.avg("score").alias("new_avg"),
        F.min("score").alias("new_min"), F.max("score").alias("new_max"),
        F.avg(F.col("score") - F.col("old_score")).alias("delta_avg"),
    )
