"""Lags, full-window rolling statistics and the chronological split.

Rows per station are bounded by the hours of the calendar because (station, hour) is
the key. Where a station's series is still too long for one task, ``blocked_lags``
cuts it into row blocks with a halo and gives the same values.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

LAGS = {"lag_1h": 1, "lag_24h": 24, "lag_168h": 168}
ROLLING = {"rolling_mean_6h": (6, F.avg), "rolling_mean_24h": (24, F.avg), "rolling_std_24h": (24, F.stddev_samp)}


def lag_columns(value: str = "occupancy_rate", keys=("station_id",), order="timestamp") -> dict[str, Column]:
    """Row-shift lags."""
    w = W.partitionBy(*keys).orderBy(order)
    return {name: F.lag(value, n).over(w) for name, n in LAGS.items()}


def rolling_columns(value: str = "occupancy_rate", keys=("station_id",), order="timestamp") -> dict[str, Column]:
    """Statistics of the preceding rows only; NULL unless the window is full."""
    w = W.partitionBy(*keys).orderBy(order)

    def full(n, fn):
        frame = w.rowsBetween(-n, -1)
        return F.when(F.count(value).over(frame) == n, fn(value).over(frame))

    return {name: full(n, fn) for name, (n, fn) in ROLLING.items()}


def time_true_columns(value: str = "occupancy_rate", ts: str = "timestamp") -> dict[str, Column]:
    """The same features by exact clock time: gaps give NULL instead of older rows."""
    w = W.partitionBy("station_id").orderBy(ts)

    def between(first, last):
        # RANGE frames over a timestamp order take interval bounds, which only SQL text can state.
        return (
            f"OVER (PARTITION BY station_id ORDER BY {ts} "
            f"RANGE BETWEEN INTERVAL {first} HOURS PRECEDING AND INTERVAL {last} HOURS PRECEDING)"
        )

    out = {name: F.expr(f"max({value}) {between(n, n)}") for name, n in LAGS.items()}
    for name, (n, fn) in ROLLING.items():
        sql = "avg" if fn is F.avg else "stddev_samp"
        out[name] = F.expr(f"CASE WHEN count({value}) {between(n, 1)} = {n} THEN {sql}({value}) {between(n, 1)} END")
    return out


def blocked_lags(df: DataFrame, value: str, block_rows: int, key="station_id", order="timestamp") -> DataFrame:
    """Lags and rolling statistics with each station cut into blocks of rows.

    Row numbers come from day counts (a small table) plus the row's place in its day.
    Each block also receives the last 168 rows of the block before it.
    """
    halo = max(LAGS.values())
    if block_rows < halo:
        raise ValueError(f"blocks must hold at least {halo} rows")
    day = F.to_date(order)
    days = df.groupBy(key, day.alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(key).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    days = days.select(key, "_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    in_day = W.partitionBy(key, "_day").orderBy(order)
    rows = (
        df.withColumn("_day", day)
        .withColumn("_place", F.row_number().over(in_day))
        .join(days, [key, "_day"])
        .withColumn("_pos", F.col("_before") + F.col("_place") - 1)
        .drop("_before", "_place", "_day")
    )
    own = F.floor(F.col("_pos") / block_rows)
    into_next = F.floor((F.col("_pos") + halo) / block_rows) > own
    blocks = F.when(into_next, F.array(own, own + 1)).otherwise(F.array(own))
    spread = rows.withColumn("_own", own).withColumn("_block", F.explode(blocks))
    columns = {
        **lag_columns(value, (key, "_block"), order),
        **rolling_columns(value, (key, "_block"), order),
    }
    return spread.withColumns(columns).filter("_block = _own").drop("_pos", "_own", "_block")


def split_cuts(df: DataFrame, train: float = 0.70, val: float = 0.15, test: float = 0.15) -> tuple[Column, Column]:
    """The two cut times of the chronological split, as scalar subqueries.

    Distinct hours are the only thing gathered: about 8,760 per year of history.
    """
    if abs(train + val + test - 1.0) >= 1e-6:
        raise ValueError("split ratios must sum to 1.0")
    hours = df.select("timestamp").distinct().agg(F.array_sort(F.collect_set("timestamp")).alias("t"))

    def cut(ratio):
        index = F.floor(F.size("t") * F.lit(ratio)).cast("int")
        return hours.select(F.get("t", index).alias("cut")).scalar()

    return cut(train), cut(train + val)


def split_label(df: DataFrame, **ratios: float) -> DataFrame:
    """Add ``split``: train before the first cut, then val, then test."""
    first, second = split_cuts(df, **ratios)
    ts = F.col("timestamp")
    return df.withColumn("split", F.when(ts < first, "train").when(ts < second, "val").otherwise("test"))
