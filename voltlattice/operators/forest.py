"""Forest training, clipped prediction, importances and per-tree spread.

Trees are grown by ``growing`` and kept as files of flat nodes, which tasks map into memory: neither a
fitted forest nor its leaf values pass through the driver.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voltlattice.functions.occupancy import clip, status_band
from voltlattice.functions.rounding import pround
from voltlattice.operators import growing
from voltlattice.operators.quality import check_features
from voltlattice.schemas import FEATURE_COLS, TARGET_COL
from voltlattice.session import shared_dir, store_dir
from voltlattice.sources.blobs import read_blob, write_blob

# Feature groups of the ablation.
ABLATION_GROUPS = {
    "lag features": ["lag_1h", "lag_24h", "lag_168h"],
    "rolling features": ["rolling_mean_6h", "rolling_mean_24h", "rolling_std_24h"],
    "calendar": ["hour", "day_of_week", "month"],
    "cyclical": ["hour_sin", "hour_cos", "day_sin", "day_cos"],
    "flags": ["is_weekend", "is_holiday"],
    "temperature": ["temperature_c"],
}


@dataclass
class ForestModel:
    """A fitted forest: what it was fitted with, the gains of each feature and where its trees are."""

    path: str
    feature_cols: list[str]
    target: str
    trees: int
    depth: int
    min_leaf: int
    seed: int
    max_bins: int
    #: Trees with at least one sampled row; each has the file ``tree-N.bin``.
    grown: list[int] = field(default_factory=list)
    nodes: int = 0
    importances: list[float] = field(default_factory=list)

    def save(self, path: str, spark: SparkSession) -> None:
        """Copy the trees, task by task, and write the description last."""
        source, grown = self.path, self.grown

        def copied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for t in batch["id"]:
                    write_blob(path, _file(t), read_blob(source, _file(t), growing.NODE).tobytes())
                yield batch

        spark.createDataFrame([(t,) for t in grown], "id long").repartition(8).mapInPandas(copied, "id long").write.format("noop").mode("overwrite").save()
        ForestModel(**{**asdict(self), "path": path}).describe(spark)

    def describe(self, spark: SparkSession) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/description")

    @staticmethod
    def load(path: str, spark: SparkSession) -> ForestModel:
        told = json.loads(spark.read.text(f"{path}/description").first()[0])
        return ForestModel(**{**told, "path": path})

    @cached_property
    def values(self) -> Column:
        """One value for each tree: an array over the feature columns."""
        return _tree_values(self)(*(F.col(c).cast("double") for c in self.feature_cols))

    @cached_property
    def mean(self) -> Column:
        return _mean_value(self)(*(F.col(c).cast("double") for c in self.feature_cols))


def _file(tree: int) -> str:
    return f"tree-{tree:05d}.bin"


@lru_cache(maxsize=2)
def _mapped(path: str, grown: tuple[int, ...]) -> list[np.ndarray]:
    """The trees of a forest in a worker, mapped once."""
    return [read_blob(path, _file(t), growing.NODE) for t in grown]


def _leaf_values(path: str, grown: tuple[int, ...], columns: tuple[pd.Series, ...]) -> Iterator[np.ndarray]:
    """For each tree, the value of every row's leaf."""
    rows = np.stack([c.to_numpy(np.float64) for c in columns], axis=1)
    for tree in _mapped(path, grown):
        yield tree["value"][growing.descend(tree, tree["threshold"], np.inf, rows)]


def _tree_values(model: ForestModel):
    path, grown = model.path, tuple(model.grown)

    @F.pandas_udf("array<double>")
    def values(*columns: pd.Series) -> pd.Series:
        found = list(_leaf_values(path, grown, columns))
        return pd.Series(list(np.stack(found, axis=1)) if found and len(columns[0]) else [[]] * len(columns[0]), dtype=object)

    return values


def _mean_value(model: ForestModel):
    path, grown = model.path, tuple(model.grown)

    @F.pandas_udf("double")
    def mean(*columns: pd.Series) -> pd.Series:
        total = np.zeros(len(columns[0]))
        for values in _leaf_values(path, grown, columns):
            total += values
        return pd.Series(total / len(grown) if grown else total * np.nan)

    return mean


def train(df: DataFrame, trees=200, depth=16, min_leaf=10, seed=42, max_bins=128,
          feature_cols=FEATURE_COLS, target=TARGET_COL) -> ForestModel:
    """Fit a forest on bootstrap samples, every feature a candidate at every split."""
    spark, columns = df.sparkSession, check_features(df.columns, feature_cols)
    path = shared_dir(spark, "forest")
    told = growing.fit(df, columns, target, path, trees, depth, min_leaf, seed, max_bins)
    # One row for each tree, of its number, its size and a gain for each feature.
    rows = told.orderBy("tree").collect()
    shares = [np.array(r.gains) / total for r in rows if (total := sum(r.gains)) > 0]
    mean = np.sum(shares, axis=0) / max(len(shares), 1) if shares else np.zeros(len(columns))
    model = ForestModel(path, columns, target, trees, depth, min_leaf, seed, max_bins, [r.tree for r in rows],
                        sum(r.nodes for r in rows), [float(x) for x in mean])
    model.describe(spark)
    return model


def fitted(df: DataFrame, trees=200, depth=16, min_leaf=10, seed=42, max_bins=128,
           feature_cols=FEATURE_COLS, target=TARGET_COL) -> ForestModel:
    """The stored forest of this table and these parameters; fitted and stored if there is none.

    The key is a digest over the values of all rows, whatever their order, so a changed table has
    a model of its own. Jobs that fit the same one at the same time each store a valid pointer.
    """
    spark, columns = df.sparkSession, check_features(df.columns, feature_cols)
    hashes = df.select(F.xxhash64(*columns, target).alias("a"), F.xxhash64(target, *columns).alias("b"))
    told = hashes.agg(F.count(F.lit(1)), *(F.sum(F.col(c).cast("decimal(38,0)")) for c in "ab"), *(F.bit_xor(c) for c in "ab")).first()
    key = hashlib.sha256(repr((tuple(told), columns, target, trees, depth, min_leaf, seed, max_bins)).encode()).hexdigest()[:32]
    pointer = store_dir(spark, f"forest-{key}")
    try:
        return ForestModel.load(spark.read.text(pointer).first()[0], spark)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error.getCondition()):
            raise
    model = train(df, trees, depth, min_leaf, seed, max_bins, feature_cols, target)
    spark.createDataFrame([(model.path,)], "value string").coalesce(1).write.mode("overwrite").text(pointer)
    return model


def predict(model: ForestModel, df: DataFrame) -> DataFrame:
    """Add ``predicted_occupancy`` (clipped, unrounded) and ``predicted_status`` from it."""
    check_features(df.columns, model.feature_cols)
    return df.withColumn("predicted_occupancy", clip(model.mean, 0.0, 1.0)).withColumn(
        "predicted_status", status_band(F.col("predicted_occupancy"))
    )


def baseline_predict(df: DataFrame) -> DataFrame:
    """The same two columns from lag-24h persistence."""
    return df.withColumn("predicted_occupancy", clip(F.col("lag_24h"), 0.0, 1.0)).withColumn(
        "predicted_status", status_band(F.col("predicted_occupancy"))
    )


#: The features it reads: rows that differ in others only need one prediction (see ``decision.told_apart``).
baseline_predict.reads = frozenset({"lag_24h"})


def importance_list(model: ForestModel) -> list[tuple[str, float]]:
    """(feature, importance rounded to 5), largest first; one number per feature."""
    values = model.importances
    order = sorted(range(len(values)), key=lambda i: -values[i])
    return [(model.feature_cols[i], round(float(values[i]), 5)) for i in order]


def importances(model: ForestModel, spark) -> DataFrame:
    rows = [(n + 1, name, value) for n, (name, value) in enumerate(importance_list(model))]
    return spark.createDataFrame(rows, "position int, feature string, importance double")


def top_feature_context(importances: list[tuple[str, float]], n: int = 5) -> Column:
    """Array of (feature, importance, value) for the first n features of an importance list, most important first."""
    return F.array(*[
        F.struct(
            F.lit(name).alias("feature"), F.lit(value).alias("importance"),
            pround(F.col(name).cast("double"), 6).alias("value"),
        )
        for name, value in importances[:n]
    ])


def tree_predictions(model: ForestModel, df: DataFrame) -> DataFrame:
    """Add ``tree_predictions``, one clipped value per tree, without a shuffle."""
    check_features(df.columns, model.feature_cols)
    return df.withColumn("tree_predictions", model.values).withColumn(
        "tree_predictions", F.transform("tree_predictions", lambda x: clip(x, 0.0, 1.0)))


def percentile_of(ordered: Column, p: float) -> Column:
    """Linear-interpolated percentile of a sorted array."""
    place = (F.size(ordered) - 1) * F.lit(p)
    low = F.floor(place).cast("int")
    below = F.get(ordered, low)
    above = F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return below + (above - below) * (place - low)


def mean_of_trees(trees: Column) -> Column:
    return F.aggregate(trees, F.lit(0.0), lambda a, x: a + x) / F.size(trees)


def add_tree_dispersion(df: DataFrame) -> DataFrame:
    """Add ``tree_dispersion``: spread of the trees around their mean; no confidence interval.

    The mean is a column of its own, so the lambdas below do not recompute it per tree.
    """
    trees, mean, ordered = F.col("tree_predictions"), F.col("_mean"), F.col("_ordered")
    n = F.size(trees)
    variance = F.aggregate(trees, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    agree = F.size(F.filter(trees, lambda x: status_band(x) == F.col("_band")))
    spread = F.struct(
        pround(mean, 4).alias("tree_mean"),
        pround(F.sqrt(variance), 4).alias("tree_std"),
        pround(F.array_min(trees), 4).alias("tree_min"),
        pround(F.array_max(trees), 4).alias("tree_max"),
        pround(percentile_of(ordered, 0.10), 4).alias("p10"),
        pround(percentile_of(ordered, 0.90), 4).alias("p90"),
        n.alias("estimator_count"),
        pround(agree / n * 100, 1).alias("status_consensus_pct"),
    )
    prepared = df.withColumn("_mean", mean_of_trees(trees)).withColumn("_ordered", F.array_sort(trees))
    prepared = prepared.withColumn("_band", status_band(mean))
    return prepared.withColumn("tree_dispersion", spread).drop("_mean", "_ordered", "_band")


def zeroed(df: DataFrame) -> DataFrame:
    """Each row once per feature group, with the columns of that group zeroed."""
    rows = df.withColumn("feature_group", F.explode(F.array(*[F.lit(name) for name in ABLATION_GROUPS])))
    return rows.withColumns({
        c: F.when(F.col("feature_group") == group, F.lit(0).cast(df.schema[c].dataType)).otherwise(F.col(c))
        for group, columns in ABLATION_GROUPS.items() for c in columns
    })


def ablation(model: ForestModel, df: DataFrame) -> DataFrame:
    """Each row once per feature group with that group zeroed, and the change in prediction."""
    base = predict(model, df).withColumnRenamed("predicted_occupancy", "baseline").drop("predicted_status")
    return predict(model, zeroed(base)).withColumnRenamed("predicted_occupancy", "ablated").withColumn(
        "delta", F.col("ablated") - F.col("baseline")
    )
