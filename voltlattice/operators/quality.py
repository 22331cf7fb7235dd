"""Row validation, request validation and dataset quality checks."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voltlattice.functions import calendar as cal
from voltlattice.schemas import FEATURE_COLS, FORBIDDEN_FEATURES, TARGET_COL

# Allowed range of every feature.
FEATURE_RANGES = {
    "hour": (0, 23), "day_of_week": (0, 6), "month": (1, 12),
    "hour_sin": (-1, 1), "hour_cos": (-1, 1), "day_sin": (-1, 1), "day_cos": (-1, 1),
    "is_weekend": (0, 1), "is_holiday": (0, 1), "temperature_c": (-5, 50),
    "lag_1h": (0, 1), "lag_24h": (0, 1), "lag_168h": (0, 1),
    "rolling_mean_6h": (0, 1), "rolling_mean_24h": (0, 1), "rolling_std_24h": (0, 1),
}
LAG_FEATURES = ["lag_1h", "lag_24h", "lag_168h"]
MAX_BATCH = 500
MAX_ALTERNATIVES = 10
# Client-facing code of each request error.
ERROR_STATUS = {"unknown_station": 404}
DEFAULT_ERROR_STATUS = 422


def check_features(columns, feature_cols=FEATURE_COLS) -> list[str]:
    """Plan-time leakage guard: no forbidden input and nothing missing."""
    leaked = sorted(set(feature_cols) & set(FORBIDDEN_FEATURES))
    if leaked:
        raise ValueError(f"forbidden features: {leaked}")
    missing = [c for c in feature_cols if c not in columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    return list(feature_cols)


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that fail; a NULL outcome counts as a failure."""
    failed = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return F.array_compact(F.array(*failed))


def feature_row_rules() -> dict[str, Column]:
    """Present and numeric for all features, lags inside [0, 1]; inputs may be text."""
    number = {c: F.col(c).cast("string").try_cast("double") for c in FEATURE_COLS}
    rules = {f"{c}:numeric": number[c].isNotNull() for c in FEATURE_COLS}
    rules.update({f"{c}:range": number[c].between(0.0, 1.0) for c in LAG_FEATURES})
    return rules


def feature_range_rules() -> dict[str, Column]:
    return {c: F.col(c).between(low, high) for c, (low, high) in FEATURE_RANGES.items()}


def validate_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``errors`` (failed rule names) and ``is_valid``."""
    return df.withColumn("errors", violations(rules)).withColumn("is_valid", F.size("errors") == 0)


def accept_batches(items: DataFrame, is_bad: Column, batch="batch_id") -> DataFrame:
    """All-or-nothing batches of 1 to 500 items: verdict per batch.

    A count and a maximum, both partially aggregated, so a hot batch costs one row per task.
    """
    return items.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n_items"), F.max(F.coalesce(is_bad, F.lit(True)).cast("int")).alias("bad")
    ).select(batch, "n_items", ((F.col("n_items") <= MAX_BATCH) & (F.col("bad") == 0)).alias("accepted"))


def request_error() -> Column:
    """First error of a request in the contract's order, NULL when it is valid.

    Reads known_station, ts, temperature_c and the history features.
    """
    ts = F.col("ts")
    return (
        F.when(~F.col("known_station"), "unknown_station")
        .when(ts.isNull(), "bad_timestamp")
        .when(ts != cal.hour_of(ts), "not_on_hour")
        .when(~F.coalesce(F.col("temperature_c").between(-5.0, 50.0), F.lit(False)), "temperature_out_of_range")
        .when(F.col("lag_1h").isNull(), "missing_lag_1h")
        .when(F.col("lag_24h").isNull(), "missing_lag_24h")
        .when(F.col("lag_168h").isNull(), "missing_lag_168h")
        .when(F.col("rolling_mean_6h").isNull(), "missing_rolling_6h")
        .when(F.col("rolling_mean_24h").isNull(), "missing_rolling_24h")
    )


def error_status(code: Column) -> Column:
    special = [part for pair in ERROR_STATUS.items() for part in map(F.lit, pair)]
    return F.when(
        code.isNotNull(), F.coalesce(F.try_element_at(F.create_map(*special), code), F.lit(DEFAULT_ERROR_STATUS))
    )


def retrieval_rules() -> dict[str, Column]:
    """Retrieval requests: question of at least 2 characters, top_k 1-10, threshold 0-1; NULL takes the default."""
    return {
        "question": F.length("question") >= 2,
        "top_k": F.coalesce(F.col("top_k"), F.lit(3)).between(1, 10),
        "threshold": F.col("threshold").isNull() | F.col("threshold").between(0.0, 1.0),
    }


def decision_rules() -> dict[str, Column]:
    """Decision requests: temperature -20 to 60 and 1-10 alternatives, NULL meaning 3."""
    return {
        "temperature_c": F.col("temperature_c").between(-20.0, 60.0),
        "max_alternatives": F.coalesce(F.col("max_alternatives"), F.lit(3)).between(1, MAX_ALTERNATIVES),
    }


def duplicate_rows(df: DataFrame, keys=("station_id", "timestamp")) -> DataFrame:
    """Rows beyond the first of each key, as one count."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def out_of_order(df: DataFrame, key: str, ts: str, seq: str, block: int = 1_000_000) -> DataFrame:
    """Per key: steps where time goes back in arrival order.

    Neighbours are compared inside blocks of the arrival sequence; then the edges of
    consecutive blocks are compared, so no key is sorted in one task.
    """
    block_no = F.floor(F.col(seq) / block)
    inside = W.partitionBy(key, "_block").orderBy(seq)
    steps = df.select(key, ts, seq, block_no.alias("_block")).withColumn(
        "_back", (F.col(ts) < F.lag(ts).over(inside)).cast("int")
    )
    blocks = steps.groupBy(key, "_block").agg(
        F.coalesce(F.sum("_back"), F.lit(0)).alias("n"),
        F.min_by(ts, seq).alias("head"), F.max_by(ts, seq).alias("tail"),
    )
    across = W.partitionBy(key).orderBy("_block")
    seams = blocks.withColumn("n", F.col("n") + F.coalesce((F.col("head") < F.lag("tail").over(across)).cast("int"), F.lit(0)))
    return seams.groupBy(key).agg(F.sum("n").alias("violations"))


def lag_mismatches(df: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Rows whose lag_1h is not the previous target of the same station.

    A station's rows are compared inside blocks of a day; then the first row of each block is compared
    with the last one of the block before, so that no station's history is sorted in one task. Rows of
    one time are ordered by target and lag.
    """
    order = ["timestamp", TARGET_COL, "lag_1h"]
    inside = W.partitionBy("station_id", "_day").orderBy(*order)

    def off(lag, previous):
        return F.abs(lag - previous) > tolerance

    rows = df.select("station_id", *order, F.to_date("timestamp").alias("_day"))
    marked = rows.withColumn("_off", F.coalesce(off(F.col("lag_1h"), F.lag(TARGET_COL).over(inside)), F.lit(False)))
    days = marked.groupBy("station_id", "_day").agg(
        F.count_if("_off").alias("n"), F.min(F.struct(*order)).alias("head"), F.max(F.struct(*order)).alias("tail"))
    # One row for each day of a station: the calendar bounds this window.
    before = F.lag("tail").over(W.partitionBy("station_id").orderBy("_day"))
    seam = F.coalesce(off(F.col("head.lag_1h"), before[TARGET_COL]), F.lit(False)).cast("long")
    return days.select((F.col("n") + seam).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("lag_mismatches"))


#: The counts of a quality report that must be 0.
CHECKS = ["duplicate_rows", "null_values", "target_out_of_range", "invalid_slots", "order_violations", "lag_mismatches"]


def dataset_report(df: DataFrame, seq: str | None = None, block: int = 1_000_000) -> DataFrame:
    """One row of quality counts, the names of the checks that fail, and ``is_valid``.

    ``seq`` is the column of the arrival sequence: ``order_violations`` counts the steps of a station
    where time goes back in it. A table without one has no order, and the count is 0.
    """
    slots = F.col("occupied_slots")
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns[1:]), F.count_if(F.col(df.columns[0]).isNull()))
    counts = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.countDistinct("station_id").alias("unique_stations"),
        F.min("timestamp").alias("min_timestamp"),
        F.max("timestamp").alias("max_timestamp"),
        nulls.alias("null_values"),
        F.count_if(~F.col(TARGET_COL).between(0.0, 1.0)).alias("target_out_of_range"),
        F.count_if((slots < 0) | (slots > F.col("total_slots"))).alias("invalid_slots"),
    )
    back = F.lit(0).cast("long")
    if seq:
        steps = out_of_order(df, "station_id", "timestamp", seq, block)
        back = steps.agg(F.coalesce(F.sum("violations"), F.lit(0).cast("long")).alias("n")).scalar()
    report = counts.withColumns({
        "duplicate_rows": duplicate_rows(df).scalar(),
        "lag_mismatches": lag_mismatches(df).scalar(),
        "order_violations": back,
    })
    failed = F.array_compact(F.array(*(F.when(F.col(c) > 0, F.lit(c)) for c in CHECKS)))
    return report.withColumn("failed_checks", F.array_join(failed, ",")).withColumn("is_valid", F.col("failed_checks") == "")


def split_ranges(df: DataFrame) -> DataFrame:
    """Rows and time range of each split."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("timestamp").alias("min_ts"), F.max("timestamp").alias("max_ts")
    )


def splits_disjoint(df: DataFrame) -> DataFrame:
    """One row: does every split end before the next one starts?"""
    edges = df.agg(*[
        fn(F.when(F.col("split") == name, F.col("timestamp"))).alias(f"{name}_{label}")
        for name in ("train", "val", "test") for fn, label in ((F.min, "min"), (F.max, "max"))
    ])
    ok = (F.col("train_max") < F.col("val_min")) & (F.col("val_max") < F.col("test_min"))
    return edges.withColumn("disjoint", F.coalesce(ok, F.lit(False)))
