import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from voltlattice import schemas
from voltlattice.functions import geo
from voltlattice.operators import ranking
from voltlattice.plans import decision, recommendation

NOW = dt.datetime(2025, 6, 15, 19)


def km(a, b):
    p, q = math.radians(b[0] - a[0]), math.radians(b[1] - a[1])
    h = math.sin(p / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(q / 2) ** 2
    return 6371.0 * 2 * math.asin(math.sqrt(h))


def network(n=120, seed=5, levels=3, spots=None):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        city = rng.choice(["Pune", "Delhi"]) if i < n - 1 else "Goa"
        spot = rng.choice(spots) if spots else (18.5 + rng.uniform(-0.2, 0.2), 73.8 + rng.uniform(-0.2, 0.2))
        out.append({
            "station_id": f"S{i:04d}", "name": f"n{i}", "city": city, "standard": rng.choice(["CCS2", "TYPE 2"]) if i else "CHADEMO",
            "charger_type": "x", "latitude": spot[0], "longitude": spot[1],
            "occ": rng.choice([round(0.2 + 0.1 * j, 4) for j in range(levels)]), "valid": rng.random() > 0.1,
        })
    return out


def brute_force(stations, k):
    answer = {}
    for i, t in enumerate(stations):
        same = [c for c in stations if c["city"] == t["city"] and c["standard"] == t["standard"] and c is not t]
        pool = same or [c for c in stations if c["city"] == t["city"] and c is not t]
        ranked = sorted(
            (c["occ"], round(km((t["latitude"], t["longitude"]), (c["latitude"], c["longitude"])), 2), c["station_id"])
            for c in pool if c["valid"]
        )
        answer[i] = ranked[:k]
    return answer


@pytest.mark.parametrize("direct_ties", [4, 64])
@pytest.mark.parametrize("levels,spots", [(3, None), (1, None), (1, [(18.5, 73.8), (18.6, 73.9)]), (40, None)])
def test_alternatives_match_brute_force(spark, direct_ties, levels, spots):
    stations = network(levels=levels, spots=spots)
    rows = [(s["station_id"], s["name"], s["city"], s["standard"], s["charger_type"], s["latitude"], s["longitude"]) for s in stations]
    places = ranking.pools(spark.createDataFrame(
        rows, "station_id string, name string, city string, standard string, charger_type string, latitude double, longitude double"))
    values = spark.createDataFrame([(s["station_id"], i, s["occ"], s["valid"]) for i, s in enumerate(stations)],
                                   "station_id string, request_id int, predicted_occupancy double, valid boolean")
    joined = places.join(values, "station_id").withColumns({"ts": F.lit(NOW), "status": F.lit("BUSY")})
    targets = joined.withColumn("target_occupancy", F.lit(0.9))
    got = {}
    for r in ranking.top_alternatives(targets, joined.filter("valid"), 3, ["ts"], direct_ties).collect():
        got.setdefault(r.request_id, {})[r["rank"]] = (r.predicted_occupancy, r.distance_km, r.station_id)
    want = {i: v for i, v in brute_force(stations, 3).items() if v}
    assert {i: [v[n] for n in sorted(v)] for i, v in got.items()} == want


def test_search_cells_reach_far_enough():
    for level in ranking.GRID_LEVELS:
        edge, reach = 2.0 / 2**level, 2.0 / 2 ** max(level - 2, 0)
        assert level == 0 or reach >= math.sqrt(3) * edge + 0.01 / geo.EARTH_KM


def make_history(spark, occupancy):
    rows = []
    for sid, value in occupancy.items():
        for h in range(1, 200):
            ts = NOW - dt.timedelta(hours=h)
            rows.append((sid, ts, "c", "t", 10, int(value * 10), value, 0.0, 25.0, False, False))
    return spark.createDataFrame(rows, schemas.HOURLY)


def station_row(sid, city, charger, lat, lon):
    return (sid, sid.lower(), city, lat, lon, 10, charger, "op", 50.0, 2020, "Cafe", 1.3, 12.0, True, True, 0)


@pytest.fixture(scope="module")
def small(spark):
    stations = spark.createDataFrame([
        station_row("A", "Pune", "DC CCS2 (50 kW)", 18.5, 73.8), station_row("B", "Pune", "DC CCS2 (150 kW)", 18.6, 73.8),
        station_row("C", "Pune", "AC Type 2 (22 kW)", 18.5, 73.9), station_row("D", "Goa", "AC Type 2 (22 kW)", 15.5, 73.9),
        station_row("E", "Pune", "DC CCS2 (50 kW)", 18.5, 73.81), station_row("F", "Goa", "DC CCS2 (50 kW)", 15.6, 73.9),
    ], schemas.STATIONS)
    return stations, make_history(spark, {"A": 0.9, "B": 0.5, "C": 0.8, "D": 0.95, "F": 0.9})


def ask(spark, *ids, limit=None):
    rows = [(i, s, str(NOW), 25.0, False) for i, s in enumerate(ids)]
    df = spark.createDataFrame(rows, schemas.REQUESTS)
    return df if limit is None else df.withColumn("max_alternatives", F.lit(limit))


def test_decisions(spark, small):
    decisions, alternatives = decision.decide(ask(spark, "A", "B", "C", "D", "E", "ZZ"), *small)
    got = {r.selected_station.station_id: r for r in decisions.collect()}
    # E has no history: it is no valid target and no valid candidate, and ZZ is unknown.
    assert set(got) == {"A", "B", "C", "D"}
    assert got["A"].recommendation == "REROUTE" and got["A"].top_alternative.station_id == "B"
    assert got["B"].recommendation == "STAY"
    assert got["C"].recommendation == "REROUTE" and got["C"].top_alternative.station_id == "B"  # city fallback
    assert got["D"].recommendation == "NO_BETTER_ALTERNATIVE" and "insufficient" in got["D"].recommendation_reason
    nested = decision.decision_documents(decisions, alternatives).collect()
    for r in nested:
        assert [a["rank"] for a in r.alternatives] == list(range(1, len(r.alternatives) + 1))
        assert r.selected_station.station_id not in {a["station_id"] for a in r.alternatives}


def test_diagnostics_and_context_of_a_decision(spark, small):
    stations, history = small
    from voltlattice.operators import forest
    from voltlattice.schemas import FEATURE_COLS

    rng = random.Random(3)
    rows = [(*(rng.random() for _ in FEATURE_COLS), rng.random()) for _ in range(200)]
    known = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*FEATURE_COLS, "occupancy_rate"]))
    model = forest.train(known, trees=5, depth=3, min_leaf=5)
    plain = {r.request_id: r for r in decision.decide(ask(spark, "A", "B", "D"), stations, history)[0].collect()}
    assert all(r.tree_dispersion is None and r.top_feature_context is None for r in plain.values())
    decisions, alternatives = decision.decide(ask(spark, "A", "B", "D"), stations, history, model=model, top_features=4)
    for r in decisions.collect():
        assert r.tree_dispersion.estimator_count == 5 and r.tree_dispersion.tree_min <= r.tree_dispersion.tree_mean <= r.tree_dispersion.tree_max
        assert r.tree_dispersion.tree_mean == pytest.approx(r.selected_station.predicted_occupancy, abs=2e-4)
        assert [f.feature for f in r.top_feature_context] == [n for n, _ in forest.importance_list(model)[:4]]
    explained, _ = decision.decide(ask(spark, "A", "B", "D"), stations, history, model=model, explain_only=True)
    for r in explained.collect():
        assert r.recommendation == plain[r.request_id].recommendation and r.selected_station == plain[r.request_id].selected_station

    vectors = spark.createDataFrame([("c1", [1.0, 0.0]), ("c2", [0.8, 0.6]), ("c3", [0.0, 1.0])], "chunk_id string, embedding array<double>")
    chunks = spark.createDataFrame([(c, "doc.md", "Title", f"text of {c}") for c in ("c1", "c2", "c3")], "chunk_id string, source string, section_title string, text string")
    asked = spark.createDataFrame([("CRITICAL", [1.0, 0.0]), ("AVAILABLE", [-1.0, 0.0])], "status string, embedding array<double>")
    base = decision.decide(ask(spark, "A", "B", "D"), stations, history)[0]
    told = {r.selected_station.status: r for r in decision.with_retrieval_context(base, asked, vectors, chunks).collect()}
    context = told["CRITICAL"].retrieval_context
    assert "CRITICAL occupancy prediction" in context.question and context.grounded
    assert [(x.rank, x.chunk_id) for x in context.sources] == [(1, "c1"), (2, "c2")]
    for status, r in told.items():
        assert r.recommendation == plain[r.request_id].recommendation
        if status == "AVAILABLE":
            assert not r.retrieval_context.grounded and r.retrieval_context.sources == []


def test_a_large_pool_moves_its_lowest_candidates_only(spark):
    members = spark.range(20000).select(
        F.concat(F.lit("S"), F.col("id").cast("string")).alias("station_id"), F.lit("p").alias("pool"), F.lit(NOW).alias("ts"),
        (F.col("id") % 5000 / 10000).alias("predicted_occupancy")).repartition(8)
    kept = ranking.reachable(members, 3, ["pool", "ts"])
    assert sorted({r.predicted_occupancy for r in kept.collect()}) == [0.0] and kept.count() == 4
    few = ranking.reachable(members, 9, ["pool", "ts"]).groupBy("predicted_occupancy").agg(F.count(F.lit(1)).alias("n"), F.max("ties").alias("ties"))
    assert {(r.predicted_occupancy, r.n, r.ties) for r in few.collect()} == {(0.0, 4, 4), (0.0001, 4, 4), (0.0002, 4, 4)}


def test_a_crowded_cell_is_dealt_out(spark):
    """100,000 users in one cell: every pair is found once, and no part of the join holds more than its share."""
    users = spark.range(100_000).select(F.col("id").alias("request_id"), (F.lit(18.5) + F.col("id") % 100 * 1e-5).alias("user_lat"), F.lit(73.8).alias("user_lon"))
    users = users.unionByName(spark.createDataFrame([(-1, 50.0, 0.0), (-2, 18.6, 73.8)], "request_id long, user_lat double, user_lon double"))
    places = spark.createDataFrame([("a", 18.51, 73.8), ("b", 18.6, 73.8), ("far", 40.0, 73.8)], "station_id string, latitude double, longitude double")
    pairs = ranking.within_radius(users, places, 25.0)
    assert pairs.count() == 200_002 and pairs.select("request_id", "station_id").distinct().count() == 200_002
    assert {r.station_id for r in pairs.select("station_id").distinct().collect()} == {"a", "b"}
    plain = ranking.within_radius(users, places, 25.0, crowded_share=1)
    assert plain.count() == 200_002
    dealt = users.withColumn("_part", F.pmod(F.xxhash64(*users.columns), F.lit(ranking.CROWDED_SHARE))).groupBy("_part").count()
    assert dealt.agg(F.max("count")).first()[0] < 100_000 / ranking.CROWDED_SHARE * 1.5


def test_requested_number_of_alternatives(spark, small):
    _, alternatives = decision.decide(ask(spark, "C", limit=1), *small)
    assert alternatives.count() == 1


def test_same_standard_pool_with_only_invalid_members_does_not_widen(spark, small):
    stations, _ = small
    history = make_history(spark, {"A": 0.9, "C": 0.1})
    decisions, alternatives = decision.decide(ask(spark, "A"), stations, history)
    assert alternatives.isEmpty()
    assert decisions.first()["recommendation"] == "NO_BETTER_ALTERNATIVE"


def test_recommendations(spark):
    stations = spark.createDataFrame([
        station_row("A", "Pune", "AC Type 2 (22 kW)", 18.5, 73.8), station_row("B", "Pune", "AC Type 2 (22 kW)", 18.51, 73.8),
        station_row("C", "Pune", "DC CHAdeMO (50 kW)", 18.5, 73.8), station_row("D", "Pune", "AC Type 2 (22 kW)", 20.0, 73.8),
    ], schemas.STATIONS)
    status = spark.createDataFrame([
        (s, s, "Pune", "op", c, 4, free, 4 - free, 0, 1.0, wait, 50.0, "MODERATE", lat, 73.8, NOW)
        for s, c, free, wait, lat in [("A", "AC Type 2 (22 kW)", 0, 30.0, 18.5), ("B", "AC Type 2 (22 kW)", 3, 0.0, 18.51),
                                      ("C", "DC CHAdeMO (50 kW)", 4, 0.0, 18.5), ("D", "AC Type 2 (22 kW)", 4, 0.0, 20.0)]
    ], schemas.STATUS)
    users = spark.createDataFrame([(1, 18.5, 73.8, "Kia EV6"), (2, 50.0, 0.0, "Kia EV6")],
                                  "request_id long, user_lat double, user_lon double, vehicle_type string")
    rows = recommendation.recommend_stations(users, status, stations).orderBy("rank").collect()
    assert [r.station_id for r in rows] == ["B", "A"]  # C does not fit the vehicle, D is too far
    assert rows[0].explanation.startswith("✅ 3 slots available now | ⚡ Near-zero wait time")
    assert rows[1].explanation.startswith("📍 Only 0.0 km away")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_tables_of_a_decision_are_not_broadcast(spark):
    """Spark judges a written table by its files, which may be a hundredth of its rows in memory."""
    kept = spark.createDataFrame([("p", 0.1, "S1", 18.5, 73.8, "Pune", "BUSY")],
                                 "pool string, predicted_occupancy double, station_id string, latitude double, longitude double, city string, status string")
    targets = spark.createDataFrame([("p", 1, "S0", 18.5, 73.8, 0.9)],
                                    "pool string, request_id long, _self string, _lat double, _lon double, target_occupancy double")
    near = plan_of(ranking.nearest_ties(targets, kept, 3, ["pool"]))
    assert near.count("SortMergeJoin") >= 2  # with the cells of the targets and with those of the ties
    assert "BroadcastHashJoin" not in plan_of(ranking.reachable(kept, 3, ["pool"]))


def test_places_of_a_radius_join_are_dealt_and_not_broadcast(spark):
    users = spark.createDataFrame([(i, 18.5, 73.8) for i in range(9)], "request_id long, user_lat double, user_lon double")
    places = spark.createDataFrame([("S1", 18.5, 73.8)], "station_id string, latitude double, longitude double")
    found = ranking.within_radius(users, places, 25.0)
    plan = plan_of(found)
    assert "SortMergeJoin" in plan and "REPARTITION_BY_NUM" in plan
    assert found.count() == 9


def test_recommendations_move_few_candidates_and_match_brute_force(spark):
    rng = random.Random(3)
    kinds = ["AC Type 2 (7.4 kW)", "AC Type 2 (22 kW)", "DC CCS2 (50 kW)"]
    rows = []
    for i in range(160):
        free, wait = rng.randrange(5), rng.choice([0.0, 4.0, 20.0, None])
        rows.append((f"S{i:03d}", "n", "Pune", "op", rng.choice(kinds), 4, free, 4 - free, 0, 1.0, wait, 50.0, "BUSY",
                     18.5 + rng.uniform(-0.1, 0.1), 73.8 + rng.choice([0.0, 0.05]), NOW, rng.choice([2.0, 8.0, 8.0]), rng.choice([9.0, 12.0])))
    details = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.STATUS)
    places = spark.createDataFrame(rows, f"{details}, amenities_score double, tariff_per_kwh double")
    people = [(i, 18.5 + rng.uniform(-0.1, 0.1), 73.8, rng.choice(["Ather 450X", "Tata Nexon EV"])) for i in range(6)]
    people += [(1, *people[1][1:]), (None, 18.52, 73.8, "Ather 450X"), (None, 18.47, 73.8, "Tata Nexon EV")]
    users = spark.createDataFrame(people, "request_id long, user_lat double, user_lon double, vehicle_type string")

    from pyspark.sql import Window as W

    from voltlattice.functions import scoring

    raw = recommendation.near(users, places, 25.0).withColumns(scoring.sub_scores(
        F.col("distance_km"), F.col("available_slots"), F.col("total_slots"), F.col("estimated_wait_mins"), F.col("amenities_score"), F.col("tariff_per_kwh")))
    mine = W.partitionBy("request_id")
    scaled = raw.withColumns({c: scoring.min_max(F.col(c), F.min(c).over(mine), F.max(c).over(mine)) for c in scoring.SCORES.values()})
    order = mine.orderBy(F.desc("final_score"), "station_id")
    columns = ["request_id", "rank", "station_id", "final_score", *scoring.SCORES.values()]

    def told(df):
        best = df.withColumn("rank", F.row_number().over(order)).filter("rank <= 3").select(*columns)
        return sorted(map(tuple, best.collect()), key=repr)

    kept = recommendation.contenders(users, places, 25.0, 3)
    assert told(kept) == told(scaled.withColumn("final_score", scoring.weighted_score()))
    assert raw.count() > 10 * kept.count()


def test_groups_of_few_requests_are_paired_whole(spark, monkeypatch):
    """Each tie would be repeated for every level of the grid, far more rows than a few requests have pairs."""
    stations = [s for s in network(levels=1) if s["valid"]]
    rows = [("p", s["station_id"], s["latitude"], s["longitude"], s["city"], "x", 0.1, "BUSY", NOW) for s in stations]
    scored = spark.createDataFrame(rows, "standard string, station_id string, latitude double, longitude double, city string, name string, "
                                         "predicted_occupancy double, status string, ts timestamp")
    scored = scored.withColumn("city", F.lit("Pune"))
    pool = F.struct("city", "standard").alias("pool")
    targets = scored.limit(5).select("station_id", "latitude", "longitude", "ts", pool, F.lit(0.9).alias("target_occupancy"),
                                     F.xxhash64("station_id").alias("request_id"))
    searched, search = [], ranking.nearest_ties

    def watched(asked, ties, k, group):
        searched.append(ties.count())
        return search(asked, ties, k, group)

    monkeypatch.setattr(ranking, "nearest_ties", watched)

    def found(**options):
        return sorted(map(str, ranking.top_alternatives(targets, scored, 3, ["ts"], 4, **options).collect()))

    assert found() == found(direct_requests=0) and len(found()) == 15
    assert searched[:2] == [0, len(stations)]


def test_pairs_of_a_few_groups_are_dealt_out(spark):
    """Few rows of few groups make many pairs: neither their bytes nor the number of groups may decide how many tasks make them."""
    users = spark.createDataFrame([(i, "Pune" if i else None) for i in range(200)] + [(7, "Pune")], "request_id long, city string")
    places = spark.createDataFrame([("A", "Pune"), ("B", "Pune"), ("B", "Pune"), ("C", "Goa"), ("D", None)], "station_id string, city string")
    pairs = ranking.within_group(users, places, "city")
    want = users.join(places, "city").select(*pairs.columns)
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, want.collect()))
    busy = pairs.select(F.spark_partition_id().alias("p")).distinct().count()
    assert busy >= min(4, int(spark.conf.get("spark.sql.shuffle.partitions")))


def test_conditions_that_no_prediction_tells_apart_are_scored_once(spark, small, monkeypatch):
    """The baseline reads a lag alone, so requests of one hour share their candidates whatever their temperature."""
    from voltlattice.operators import forest

    rows = [(i, s, str(NOW), 20.0 + i, bool(i % 2)) for i, s in enumerate("ABCD")] + [(9, "A", str(NOW), 25.0, None)]
    requests, scored, score = spark.createDataFrame(rows, schemas.REQUESTS), [], decision.score_candidates

    def watched(conditions, *args):
        found = score(conditions, *args)
        scored.append((conditions.count(), found.count()))
        return found

    monkeypatch.setattr(decision, "score_candidates", watched)

    def told(predict):
        return [sorted(map(str, df.collect())) for df in decision.decide(requests, *small, predict)]

    assert told(forest.baseline_predict) == told(lambda df: forest.baseline_predict(df))
    # Pune and Goa at one hour, with three and two valid stations; four conditions if they are told apart.
    assert scored == [(2, 5), (4, 11)]


def test_only_pairs_that_can_be_among_the_best_become_rows(spark):
    rng = random.Random(7)
    spots = [(18.5 + rng.uniform(-0.1, 0.1), 73.8 + rng.uniform(-0.1, 0.1)) for _ in range(300)] + [(None, 73.8), (float("nan"), 73.8)] + [(18.5, 73.8)] * 40
    places = [("p" if i % 9 else "q", f"S{i:03d}", *spot, rng.choice([0.1, 0.1, 0.1, 0.2]) if i != 50 else 0.05) for i, spot in enumerate(spots)] * 2
    kept = spark.createDataFrame(places, "pool string, station_id string, latitude double, longitude double, predicted_occupancy double")
    people = [("p" if i % 4 else "q", i, f"S{i:03d}", 18.5 + rng.uniform(-0.1, 0.1), 73.8) for i in range(60)] + [("p", 60, "S000", None, 73.8), ("r", 61, "S001", 18.5, 73.8)]
    asked = spark.createDataFrame(people, "pool string, request_id int, _self string, _lat double, _lon double")
    kept = ranking.reachable(kept.join(asked.groupBy("pool").agg(F.count(F.lit(1)).alias("_requests")), "pool"), 3, ["pool"]).drop("ties")

    from pyspark.sql import Window as W

    def best(pairs):
        km_ = ranking.pround(geo.haversine_km(F.col("_lat"), F.col("_lon"), F.col("latitude"), F.col("longitude")), 2)
        order = W.partitionBy("request_id").orderBy("predicted_occupancy", "km", "station_id")
        ranked = pairs.filter("station_id <> _self").withColumn("km", km_).withColumn("rank", F.row_number().over(order)).filter("rank <= 3")
        return sorted(map(str, ranked.select("request_id", "rank", "station_id", "predicted_occupancy", "km").collect()))

    whole, found = asked.join(kept, "pool").drop("pool", "_requests"), ranking.paired(asked, kept, 3, ["pool"])
    assert sorted(found.columns) == sorted(whole.columns) and best(found) == best(whole)
    assert found.filter("request_id < 60").count() * 10 < whole.filter("request_id < 60").count()


def test_large_groups_are_paired_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "PART_REQUESTS", 10)
    rng = random.Random(2)
    asked = spark.createDataFrame([("p", i, f"S{i}", 18.5 + rng.uniform(-0.1, 0.1), 73.8) for i in range(95)],
                                  "pool string, request_id int, _self string, _lat double, _lon double")
    kept = spark.createDataFrame([("p", f"S{i}", 18.5 + i * 0.001, 73.8, 0.1, 95) for i in range(40)],
                                 "pool string, station_id string, latitude double, longitude double, predicted_occupancy double, _requests long")
    found = ranking.paired(asked, kept, 2, ["pool"])
    assert found.groupBy("request_id").count().agg(F.count(F.lit(1)), F.min("count")).first()[:] == (95, 2)
    assert found.select("request_id", "station_id").distinct().count() == found.count()


def test_written_tables_leave_no_shuffle_files(spark):
    from voltlattice import session

    before = spark.conf.get(session.CLEANUP)
    made = session.materialize(spark.range(1000).repartition(7).groupBy(F.col("id") % 10).count(), "no-files")
    assert made.count() == 10 and spark.conf.get(session.CLEANUP) == before


def test_pairs_of_recommendations_are_chosen_in_arrays(spark, sf_dir):
    """Of a user's places, those with the least and largest sub-scores and the best become rows, and no window sorts all pairs."""
    from voltlattice.catalog import joins

    rng = random.Random(4)
    rows = [(f"S{i}", 18.5 + rng.uniform(-0.3, 0.3), 73.8 + rng.uniform(-0.3, 0.3), "AC Type 2 (7.4 kW)", rng.randrange(4), 4, float(rng.randrange(9)),
             rng.choice([1.0, 2.0, None]), 9.0) for i in range(500)]
    places = spark.createDataFrame(rows, "station_id string, latitude double, longitude double, charger_type string, available_slots int, "
                                         "total_slots int, estimated_wait_mins double, amenities_score double, tariff_per_kwh double")
    users = spark.createDataFrame([(i, 18.5 + rng.uniform(-0.1, 0.1), 73.8, v) for i, v in enumerate(["Ather 450X", None, "?"] * 7)],
                                  "request_id long, user_lat double, user_lon double, vehicle_type string")
    users = users.unionByName(users.limit(1).withColumns({"request_id": F.lit(99).cast("long"), "user_lat": F.lit(None).cast("double")}))
    all_pairs = recommendation.near(users, places, 25.0)
    ends = ranking.chosen_within_radius(users, recommendation._with_scores(places), 25.0, recommendation.extremes(25.0))
    assert 0 < ends.count() < 12 * 21 < all_pairs.count() / 10

    def bounds(df):
        columns = ("distance_km", "available_slots", "estimated_wait_mins", "amenities_score", "tariff_per_kwh")
        told = df.groupBy("request_id").agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in columns))
        return sorted(map(str, told.collect()))

    assert bounds(recommendation._exact(ends, 25.0)) == bounds(all_pairs)
    assert recommendation.contenders(users, places, 25.0, 3).count() < 6 * 21
    assert "Window" not in plan_of(joins.min_max(spark, sf_dir))
