"""Recommendation sub-scores, explanation text and the reroute policy."""

from pyspark.sql import Column, functions as F

from voltlattice.functions.rounding import pround

# Weights of the sub-scores.
WEIGHTS = {"distance": 0.35, "availability": 0.30, "wait_time": 0.20, "amenities": 0.10, "tariff": 0.05}
SCORES = {
    "distance": "proximity_score",
    "availability": "availability_score",
    "wait_time": "wait_score",
    "amenities": "amenity_score",
    "tariff": "cost_score",
}

# Chargers each vehicle can use, and the default for unknown vehicles.
VEHICLE_CHARGERS = {
    "Tata Nexon EV": ["AC Type 2 (7.4 kW)", "AC Type 2 (22 kW)", "DC CCS2 (50 kW)"],
    "MG ZS EV": ["AC Type 2 (7.4 kW)", "AC Type 2 (22 kW)", "DC CCS2 (50 kW)"],
    "Hyundai Kona Electric": ["AC Type 2 (7.4 kW)", "AC Type 2 (22 kW)", "DC CCS2 (50 kW)"],
    "Ather 450X": ["AC Type 2 (7.4 kW)"],
    "Ola S1 Pro": ["AC Type 2 (7.4 kW)"],
    "Tata Tigor EV": ["AC Type 2 (7.4 kW)", "AC Type 2 (22 kW)"],
    "Mahindra XUV400": ["AC Type 2 (7.4 kW)", "AC Type 2 (22 kW)", "DC CCS2 (50 kW)"],
    "BYD Atto 3": ["AC Type 2 (22 kW)", "DC CCS2 (50 kW)", "DC CCS2 (150 kW)"],
    "Kia EV6": ["AC Type 2 (22 kW)", "DC CCS2 (150 kW)"],
    "BMW iX": ["AC Type 2 (22 kW)", "DC CCS2 (150 kW)"],
}
DEFAULT_CHARGERS = ["AC Type 2 (7.4 kW)", "AC Type 2 (22 kW)"]

# Providers whose network each vehicle can use; unknown vehicles use all of them.
PROVIDERS = ["Tata Power EZ", "ChargeZone", "Statiq", "BPCL EV", "NTPC Vidyut", "Ather Grid"]
VEHICLE_PROVIDERS = {
    "Tata Nexon EV": ["Tata Power EZ", "ChargeZone", "Statiq", "BPCL EV", "NTPC Vidyut"],
    "MG ZS EV": ["Tata Power EZ", "ChargeZone", "BPCL EV", "NTPC Vidyut"],
    "Ather 450X": ["Ather Grid", "Statiq"],
    "Kia EV6": ["ChargeZone", "BPCL EV"],
    "BYD Atto 3": ["ChargeZone", "BPCL EV", "Tata Power EZ"],
}

# The reroute policy.
BUSY_THRESHOLD = 0.70
MIN_IMPROVEMENT = 0.10


def member_of(key: Column, value: Column, table: dict[str, list[str]], default: list[str]) -> Column:
    """Is ``value`` listed for ``key``? A fixed table as a literal map, so no join."""
    def words(items):
        return F.array(*[F.lit(i) for i in items])

    entries = [part for name, items in table.items() for part in (F.lit(name), words(items))]
    allowed = F.coalesce(F.try_element_at(F.create_map(*entries), key), words(default))
    return F.array_contains(allowed, value)


def compatible_charger(vehicle: Column, charger_type: Column) -> Column:
    return member_of(vehicle, charger_type, VEHICLE_CHARGERS, DEFAULT_CHARGERS)


def compatible_provider(vehicle: Column, provider: Column) -> Column:
    return member_of(vehicle, provider, VEHICLE_PROVIDERS, PROVIDERS)


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    if abs(sum(weights.values()) - 1.0) >= 1e-6:
        raise ValueError("weights must sum to 1.0")
    return weights


def sub_scores(distance, available, total, wait, amenities, tariff) -> dict[str, Column]:
    """The five raw sub-scores; higher is better."""
    return {
        "proximity_score": 1 / (1 + distance),
        "availability_score": available / F.greatest(total, F.lit(1)),
        "wait_score": 1 / (1 + wait),
        "amenity_score": amenities / 10.0,
        "cost_score": 1 / (1 + tariff),
    }


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Min-max scaling; a constant set scales to 1.0."""
    return F.when(high == low, F.lit(1.0)).otherwise((value - low) / (high - low))


def weighted_score(weights: dict[str, float] = WEIGHTS) -> Column:
    terms = [F.lit(check_weights(weights)[name]) * F.col(SCORES[name]) for name in SCORES]
    return sum(terms[1:], terms[0])


def explain_recommendation() -> Column:
    """Phrases that apply, joined by a spaced pipe; reads the recommendation columns."""
    phrases = [
        F.when(F.col("proximity_score") >= 0.7, F.format_string("📍 Only %.1f km away", pround("distance_km", 1))),
        F.when(F.col("available_slots") > 0, F.format_string("✅ %d slots available now", F.col("available_slots"))),
        F.when(F.col("estimated_wait_mins") <= 5, F.lit("⚡ Near-zero wait time")).when(
            F.col("wait_score") >= 0.6,
            F.format_string("⏱️ Short wait: ~%.0f mins", pround("estimated_wait_mins", 0)),
        ),
        F.when(F.col("amenity_score") >= 0.7, F.lit("☕ High amenity score (cafe, WiFi, shade)")),
    ]
    text = F.concat_ws(" | ", *phrases)
    return F.when(text == "", F.lit("Balanced score across all criteria")).otherwise(text)


def recommendation(target: Column, best: Column, busy=BUSY_THRESHOLD, improvement=MIN_IMPROVEMENT) -> Column:
    """STAY, REROUTE or NO_BETTER_ALTERNATIVE from two 4-digit occupancies."""
    better = (best < target) & (target - best >= improvement)
    return (
        F.when(target < busy, "STAY").when(better, "REROUTE").otherwise("NO_BETTER_ALTERNATIVE")
    )


def percent(value: Column) -> Column:
    return F.format_string("%.1f%%", pround(value * 100, 1))


def recommendation_reason(
    station: Column, city: Column, target: Column, best_id: Column, best: Column,
    busy=BUSY_THRESHOLD, improvement=MIN_IMPROVEMENT,
) -> Column:
    # Fixed wording of the decision texts.
    busy_text, step_text = f"{busy * 100:.0f}%", f"{improvement * 100:.0f}%"
    gain = percent(target - best)
    stay = F.concat(
        F.lit("Selected station "), station, F.lit(" has acceptable predicted occupancy ("), percent(target),
        F.lit(f" < {busy_text} policy threshold). No rerouting required."),
    )
    reroute = F.concat(
        F.lit("Selected station "), station, F.lit(" has high predicted occupancy ("), percent(target),
        F.lit("). Recommended reroute to "), best_id, F.lit(" in "), city,
        F.lit(" with lower predicted occupancy ("), percent(best), F.lit(", improvement: "), gain,
        F.lit(f" >= {step_text} policy threshold)."),
    )
    no_better = F.concat(
        F.lit("Selected station "), station, F.lit(" has high predicted occupancy ("), percent(target),
        F.lit("), but best alternative "), best_id, F.lit(" offers insufficient occupancy improvement ("), gain,
        F.lit(f" < {step_text} policy threshold)."),
    )
    none = F.concat(F.lit("No compatible candidate alternative stations found in "), city, F.lit("."))
    choice = recommendation(target, best, busy, improvement)
    return (
        F.when(choice == "STAY", stay)
        .when(choice == "REROUTE", reroute)
        .when(best_id.isNotNull(), no_better)
        .otherwise(none)
    )
