"""M/M/c queue formulas."""

from pyspark.sql import Column, functions as F

from voltlattice.functions.rounding import pround


def erlang_c(servers: Column, rho: Column) -> Column:
    """Probability of waiting, by the stable blocking recurrence B <- aB / (k + aB)."""
    load = servers * rho
    blocking = F.aggregate(
        F.sequence(F.lit(1), servers.cast("int")), F.lit(1.0),
        lambda b, k: load * b / (k + load * b),
    )
    return F.when(rho >= 1.0, F.lit(1.0)).otherwise(blocking / (1 - rho * (1 - blocking)))


def arrival_rate(queue: Column, session_minutes: Column) -> Column:
    return F.greatest(queue / F.greatest(session_minutes, F.lit(1.0)), F.lit(0.01))


SATURATED = 1 - 1e-9  # an intensity of 1 may come out a bit lower in binary


def mmc_wait(queue: Column, chargers: Column, session_minutes: Column, rate: Column) -> Column:
    """Expected wait in minutes; saturated or empty queues use plain turnover."""
    servers = F.greatest(chargers, F.lit(1))
    service = 1.0 / F.greatest(session_minutes, F.lit(1.0))
    lam = F.greatest(rate, F.lit(0.01))
    rho = lam / (servers * service)
    waiting = erlang_c(servers, rho) / (servers * service * (1 - rho)) + queue / lam
    return (
        F.when((rho >= SATURATED) | (queue == 0), queue * session_minutes / servers)
        .otherwise(F.greatest(F.lit(0.0), pround(waiting, 1)))
    )


def blend_wait(physics: Column, learned: Column) -> Column:
    """60 % physics and 40 % learned; without a learned value the physics stands alone."""
    return pround(0.6 * physics + 0.4 * learned_or_physics(physics, learned), 1)


def learned_or_physics(physics: Column, learned: Column) -> Column:
    """The learned wait, not below zero, or the physics where there is none."""
    return F.when(learned.isNull(), physics).otherwise(F.greatest(F.lit(0.0), learned))
