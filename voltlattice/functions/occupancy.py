"""Occupancy ratios, status bands, snapshot waits, session economics, demand profile."""

from pyspark.sql import Column, functions as F

from voltlattice.functions.rounding import pround

# Typical session length range per charger type, in hours.
SESSION_HOURS = {
    "AC Type 2 (7.4 kW)": (0.75, 3.0),
    "AC Type 2 (22 kW)": (0.5, 1.5),
    "DC CCS2 (50 kW)": (0.33, 0.75),
    "DC CCS2 (150 kW)": (0.2, 0.5),
    "DC CHAdeMO (50 kW)": (0.33, 0.75),
}
# Demand multipliers; anything not listed counts as 1.0.
CITY_DEMAND = {"Bengaluru": 1.15, "Delhi": 1.10, "Mumbai": 1.05, "Pune": 0.95, "Hyderabad": 0.90}
CHARGER_DEMAND = {
    "DC CCS2 (150 kW)": 1.18,
    "DC CCS2 (50 kW)": 1.08,
    "AC Type 2 (22 kW)": 0.95,
    "AC Type 2 (7.4 kW)": 0.85,
    "DC CHAdeMO (50 kW)": 0.80,
}
# Hourly base demand on working days and on days off.
WORKDAY_DEMAND = [
    0.10, 0.08, 0.06, 0.05, 0.06, 0.10, 0.25, 0.60, 0.85, 0.70, 0.50, 0.55,
    0.65, 0.55, 0.50, 0.48, 0.55, 0.70, 0.90, 0.95, 0.85, 0.70, 0.45, 0.20,
]
DAY_OFF_DEMAND = [
    0.12, 0.08, 0.06, 0.05, 0.05, 0.08, 0.15, 0.25, 0.45, 0.60, 0.70, 0.75,
    0.80, 0.80, 0.75, 0.70, 0.75, 0.85, 0.90, 0.85, 0.70, 0.50, 0.35, 0.20,
]


def lookup(key: Column, table: dict[str, float], default: float) -> Column:
    """Small fixed table as a literal map: no join, no shuffle."""
    entries = [F.lit(part) for pair in table.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), key), F.lit(default))


def clip(value: Column, low: float, high: float) -> Column:
    """Clamp, leaving NULL as NULL."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def occupancy_rate(occupied: Column, total: Column) -> Column:
    return pround(occupied / total, 4)


def utilization_pct(occupied: Column, total: Column) -> Column:
    return pround(occupied / total * 100, 1)


def status_band(value: Column, scale: float = 1.0) -> Column:
    """Band of an occupancy fraction (scale 1) or percentage (scale 100)."""
    critical, busy, moderate = (0.90, 0.70, 0.40) if scale == 1.0 else (90.0, 70.0, 40.0)
    return (
        F.when(value >= critical, "CRITICAL")
        .when(value >= busy, "BUSY")
        .when(value >= moderate, "MODERATE")
        .otherwise("AVAILABLE")
    )


def session_minutes_by_type(charger_type: Column) -> Column:
    """Midpoint of the session range; unknown types behave like the slowest charger."""
    midpoints = {name: (low + high) / 2 * 60 for name, (low, high) in SESSION_HOURS.items()}
    return lookup(charger_type, midpoints, midpoints["AC Type 2 (7.4 kW)"])


def session_minutes_by_power(power_kw: Column) -> Column:
    return F.greatest(F.lit(30.0), F.lit(22.0 * 60) / F.greatest(power_kw, F.lit(1.0)))


def session_minutes_by_load(load_kw: Column, occupied: Column) -> Column:
    power = F.greatest(F.lit(7.4), load_kw / F.greatest(occupied, F.lit(1)))
    return F.greatest(F.lit(20.0), F.lit(60.0) / F.greatest(power / 22, F.lit(0.1)))


def snapshot_wait(available: Column, queue: Column, total: Column, session_minutes: Column) -> Column:
    busy = pround(queue / F.greatest(total, F.lit(1)) * session_minutes, 1)
    return F.when(available > 0, F.lit(0.0)).otherwise(busy)


def charger_standard(charger_type: Column) -> Column:
    upper = F.upper(charger_type)
    return (
        F.when(upper.contains("CCS2"), "CCS2")
        .when(upper.contains("TYPE 2"), "TYPE 2")
        .when(upper.contains("CHADEMO"), "CHADEMO")
        .otherwise(upper)
    )


def time_period(hour: Column) -> Column:
    # Fixed labels of the day periods.
    return (
        F.when(hour.between(7, 10), "morning peak (7–10 AM)")
        .when(hour.between(12, 14), "midday period (12–2 PM)")
        .when(hour.between(18, 21), "evening peak (6–9 PM)")
        .when(hour.between(0, 5), "overnight off-peak (12–6 AM)")
        .otherwise(F.format_string("hour %02d:00", hour))
    )


def trend_label(rolling_mean: Column) -> Column:
    return F.when(rolling_mean >= 0.70, "high").when(rolling_mean >= 0.40, "moderate").otherwise("low")


def energy_needed(target_pct: Column, soc_pct: Column, pack_kwh: float = 40.0) -> Column:
    return F.greatest(F.lit(0.5), (target_pct - soc_pct) / 100 * pack_kwh)


def charge_minutes(energy_kwh: Column, power_kw: float = 50.0) -> Column:
    return pround(energy_kwh / power_kw * 60, 0)


def session_cost(energy_kwh: Column, tariff: Column, fee: float = 2.0) -> Column:
    return pround(energy_kwh * tariff + fee, 1)


def co2_saved(energy_kwh: Column) -> Column:
    return pround(energy_kwh * 0.82, 1)


def expected_demand(
    hour: Column, day_off: Column, city: Column, charger_type: Column, temperature: Column,
    city_demand: dict[str, float] = CITY_DEMAND,
    charger_demand: dict[str, float] = CHARGER_DEMAND,
) -> Column:
    """Deterministic demand: hourly profile x city x charger x heat, clipped to [0.02, 0.98]."""
    workday = F.element_at(F.array(*[F.lit(v) for v in WORKDAY_DEMAND]), hour + 1)
    holiday = F.element_at(F.array(*[F.lit(v) for v in DAY_OFF_DEMAND]), hour + 1)
    base = F.when(day_off, holiday).otherwise(workday)
    heat = 1.0 + 0.003 * F.greatest(F.lit(0.0), temperature - 28.0)
    raw = base * lookup(city, city_demand, 1.0) * lookup(charger_type, charger_demand, 1.0) * heat
    return clip(raw, 0.02, 0.98)


def amenities_score(amenities: Column, catalog_size: int = 8) -> Column:
    """Share of the amenity catalogue on offer, on a 0-10 scale."""
    return pround(F.size(F.split(amenities, ", ")) / catalog_size * 10, 1)


def end_time(start: Column, duration_hrs: Column) -> Column:
    return start + F.make_dt_interval(secs=duration_hrs * 3600)


def revenue(energy_kwh: Column, tariff: Column) -> Column:
    return pround(energy_kwh * tariff, 2)
