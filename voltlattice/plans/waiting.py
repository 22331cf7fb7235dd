"""Queue wait estimates from the queue formula and the learned correction."""

from pyspark.sql import DataFrame, functions as F

from voltlattice.functions import calendar as cal, queueing
from voltlattice.functions.rounding import pround
from voltlattice.operators import dashboard

DEFAULT_SESSION_MINUTES = 45.0


def queue_inputs(queues: DataFrame, sessions: DataFrame, stations: DataFrame) -> DataFrame:
    """Queues (station_id, queue_length, hour, is_weekend) with slots and mean session length."""
    meta = stations.select("station_id", "charger_type", "city", "total_slots", "avg_power_kw")
    per_type = dashboard.session_minutes_per_type(sessions)
    return queues.join(meta, "station_id").join(per_type, "charger_type", "left").withColumns({
        "duration_mins": F.coalesce("avg_session_mins", F.lit(DEFAULT_SESSION_MINUTES)),
        "is_weekend": cal.flag(F.coalesce("is_weekend", F.lit(False))),
    }).drop("avg_session_mins")


def physics_wait(inputs: DataFrame) -> DataFrame:
    queue, minutes = F.col("queue_length"), F.col("duration_mins")
    rate = queueing.arrival_rate(queue, minutes)
    return inputs.withColumn("physics_wait", queueing.mmc_wait(queue, F.col("total_slots"), minutes, rate))


def estimate_wait(queues: DataFrame, sessions: DataFrame, stations: DataFrame, model=None) -> DataFrame:
    """Physics, learned and blended wait per queue; without a model or an hour physics stands alone."""
    physics = physics_wait(queue_inputs(queues, sessions, stations))
    scored = model.predict(physics) if model is not None else physics.withColumn("ml_wait", F.lit(None).cast("double"))
    learned = queueing.learned_or_physics(F.col("physics_wait"), F.col("ml_wait"))
    return scored.select(
        *[c for c in queues.columns if c not in ("is_weekend",)],
        pround("physics_wait", 1).alias("physics_estimate_mins"),
        pround(learned, 1).alias("ml_estimate_mins"),
        queueing.blend_wait(F.col("physics_wait"), F.col("ml_wait")).alias("final_estimate_mins"),
        "total_slots",
    )
