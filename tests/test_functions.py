import math
import random

import pytest
from pyspark.sql import functions as F

from voltlattice.functions import calendar as cal, geo, occupancy as occ, queueing, scoring, text as tx
from voltlattice.functions.rounding import pround


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_rounding_is_that_of_the_exact_value(spark):
    rng = random.Random(7)
    values = [rng.choice([rng.uniform(-99, 99), rng.randint(-10**6, 10**6) / 10 ** rng.randint(1, 7), rng.randint(0, 999) / 16])
              for _ in range(3000)] + [2.675, 0.0625, 6.25, 1e18]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    rows = df.select("x", *[pround("x", n).alias(f"r{n}") for n in range(9)]).collect()
    assert [(r.x, n) for r in rows for n in range(9) if r[f"r{n}"] != round(r.x, n)] == []


def test_rounding_passes_null_nan_and_infinity(spark):
    df = spark.createDataFrame([(None,), (math.nan,), (math.inf,)], "x double").select(pround("x", 2).alias("v"))
    null, nan, inf = [r.v for r in df.collect()]
    assert null is None and math.isnan(nan) and inf == math.inf


def test_status_bands(spark):
    values = [0.0, 0.3999, 0.4, 0.6999, 0.7, 0.8999, 0.9, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.s for r in df.select(occ.status_band(F.col("v")).alias("s")).collect()]
    assert got == ["AVAILABLE", "AVAILABLE", "MODERATE", "MODERATE", "BUSY", "BUSY", "CRITICAL", "CRITICAL"]


def test_calendar_counts_from_monday_and_keeps_the_wall_clock(spark):
    df = spark.sql("SELECT timestamp_ntz'2025-06-15 19:00:00' AS ts, '2025-06-15 19:00:00+05:30' AS text, 'soon' AS bad")
    parts = cal.calendar_parts(F.col("ts"))
    row = df.select(*[c.alias(n) for n, c in parts.items()], cal.parse_naive(F.col("text")).alias("p"),
                    cal.parse_naive(F.col("bad")).alias("b"), F.col("ts")).first()
    assert (row.hour, row.day_of_week, row.month) == (19, 6, 6)
    assert row.p == row.ts and row.b is None


@pytest.mark.parametrize("place", [(0, 0), (89.9, 10), (-33.9, 151.2), (12.97, 179.99)])
def test_distance_and_grid(spark, place):
    lat, lon = place
    assert one(spark, geo.haversine_km(*[F.lit(float(v)) for v in (lat, lon, lat, lon)])) == 0.0
    rng = random.Random(3)
    near = [(lat + rng.uniform(-0.3, 0.3), lon + rng.uniform(-0.3, 0.3)) for _ in range(200)]
    df = spark.createDataFrame([(float(min(a, 90.0)), float(b)) for a, b in near], "a double, b double")
    edge = geo.chord(25.0)
    km = geo.haversine_km(F.lit(float(lat)), F.lit(float(lon)), F.col("a"), F.col("b"))
    here = geo.cube_of(geo.sphere_point(F.lit(float(lat)), F.lit(float(lon))), F.lit(edge))
    there = geo.cube_of(geo.sphere_point(F.col("a"), F.col("b")), F.lit(edge))
    rows = df.select(km.alias("km"), F.array_contains(geo.cubes_around(here, edge), there).alias("seen")).collect()
    assert any(r.km <= 25 for r in rows)
    assert all(r.seen for r in rows if r.km <= 25)


def test_known_distance(spark):
    km = one(spark, geo.haversine_km(F.lit(12.9716), F.lit(77.5946), F.lit(13.0827), F.lit(80.2707)))
    assert km == pytest.approx(290.2, abs=0.5)


def test_erlang_c_against_factorials(spark):
    for c, rho in [(1, 0.5), (4, 0.8), (12, 0.95), (60, 0.9)]:
        a = c * rho
        top = a**c / math.factorial(c) / (1 - rho)
        want = top / (sum(a**k / math.factorial(k) for k in range(c)) + top)
        assert one(spark, queueing.erlang_c(F.lit(c), F.lit(rho))) == pytest.approx(want, rel=1e-12)
    assert one(spark, queueing.erlang_c(F.lit(3), F.lit(1.2))) == 1.0


def test_wait_falls_back_to_physics(spark):
    assert one(spark, queueing.blend_wait(F.lit(10.0), F.lit(None).cast("double"))) == 10.0
    assert one(spark, queueing.blend_wait(F.lit(10.0), F.lit(-5.0))) == 6.0
    assert one(spark, queueing.mmc_wait(F.lit(0), F.lit(2), F.lit(30.0), F.lit(0.01))) == 0.0


def test_policy_compares_binary_doubles(spark):
    def choice(target, best):
        return one(spark, scoring.recommendation(F.lit(target), F.lit(best).cast("double")))

    assert choice(0.69, 0.1) == "STAY"
    assert choice(0.9, 0.8) == "NO_BETTER_ALTERNATIVE"  # 0.9 - 0.8 is below 0.1 in binary
    assert choice(0.8, 0.7) == "REROUTE"
    assert choice(0.9, None) == "NO_BETTER_ALTERNATIVE"


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        scoring.check_weights({**scoring.WEIGHTS, "tariff": 0.5})


def test_strip_and_slug(spark):
    assert one(spark, tx.strip(F.lit(" \x1c a b 　\n"))) == "a b"
    assert one(spark, tx.slugify(F.lit("docs/Problem  Framing.md"))) == "docs_problem_framing_md"


@pytest.mark.parametrize("size,overlap", [(500, 100), (10, 3), (10, 7), (4, 0)])
def test_windows_match_slices(spark, size, overlap):
    body = "".join(random.Random(size).choice("ab é\n😀") for _ in range(1234))
    got = one(spark, tx.windows(F.lit(body), size, overlap))
    assert got == [body[i:i + size] for i in range(0, len(body), size - overlap)]
