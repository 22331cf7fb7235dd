"""Candidate pools, pruned top-k alternatives and radius joins.

The reroute ranking orders a pool of candidates by (occupancy, distance, id). Three exact
cuts keep the pairs per request small however large a city is:

1. only the lowest occupancy levels, down to the one that completes k+1 candidates, can reach
   a top-k; each task cuts its share of a pool to them before anything moves or is written;
2. of candidates at the same spot and level only the k+1 smallest ids can;
3. pairs are compared in arrays, and only those that can be among the k nearest become rows; a level with many
   ties that many requests ask for is searched through a nested sphere grid instead, nearest cells first.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from voltlattice.functions import geo
from voltlattice.functions.rounding import pround
from voltlattice.session import materialize, spread, spread_tasks, unbroadcast

GRID_LEVELS = range(0, 21)  # cube edges from the whole globe down to about 12 m
#: Levels of so few ties, or groups of so few requests, are paired whole: a pair takes about 20 ns and no row there,
#: while the grid makes a row of each tie for every level, twice over, and some hundred of each request.
DIRECT_TIES, DIRECT_REQUESTS = 1 << 13, 1 << 11
#: Requests of a group that one task pairs, and pairs that it looks at together.
PART_REQUESTS, PAIR_CELLS = 1 << 14, 1 << 20
#: Distances are compared after rounding to 0.01 km; so much farther than another, one is surely farther.
SURELY_KM = 0.011
ANY_STANDARD = "*"
ALTERNATIVE = ["station_id", "city", "latitude", "longitude", "predicted_occupancy", "status"]


def pools(stations: DataFrame) -> DataFrame:
    """Give each station its pool: same city and standard if another one exists, else the city.

    Decided on metadata alone, so candidates that later fail validation do not widen a pool.
    """
    peers = stations.groupBy("city", "standard").agg(F.count(F.lit(1)).alias("_peers"))
    pool = F.when(F.col("_peers") > 1, F.struct("city", "standard")).otherwise(
        F.struct("city", F.lit(ANY_STANDARD).alias("standard"))
    )
    return stations.join(peers, ["city", "standard"]).withColumn("pool", pool).drop("_peers")


def peers(stations: DataFrame) -> DataFrame:
    """(station_id, peer_id, city, standard): every pair of different stations with the same city and standard.

    For reports and tests; decisions never pair whole pools (see ``top_alternatives``).
    """
    other = stations.select("city", "standard", F.col("station_id").alias("peer_id"))
    return stations.select("station_id", "city", "standard").join(other, ["city", "standard"]).filter(
        F.col("station_id") != F.col("peer_id")).select("station_id", "peer_id", "city", "standard")


def pool_members(scored: DataFrame) -> DataFrame:
    """Each candidate once in its city-and-standard pool and once in its city pool."""
    whole_city = F.struct("city", F.lit(ANY_STANDARD).alias("standard"))
    return scored.withColumn("pool", F.explode(F.array(F.struct("city", "standard"), whole_city)))


def _edge(level):
    return F.lit(2.0) / F.pow(F.lit(2.0), level)


def _cell(point, level):
    cube = geo.cube_of(point, _edge(level))
    return F.struct(level.alias("level"), cube.alias("cube"))


def _all_cells(lat, lon):
    point = geo.sphere_point(lat, lon)
    return F.array(*[_cell(point, F.lit(n)) for n in GRID_LEVELS])


def nearest_ties(targets: DataFrame, ties: DataFrame, k: int, group: list[str]) -> DataFrame:
    """Targets paired with candidates that include at least the k nearest other ties of each.

    The finest cell around a target with more than k+1 candidates bounds the distance of the
    k-th by its diagonal. The 27 cells two levels up reach at least that far, including the
    width of the distance rounding, so the k nearest are all in them.
    """
    spot = W.partitionBy(*group, "predicted_occupancy", "latitude", "longitude").orderBy("station_id")
    ties = ties.withColumn("_s", F.row_number().over(spot)).filter(F.col("_s") <= k + 1).drop("_s")
    in_cells = ties.withColumn("cell", F.explode(_all_cells(F.col("latitude"), F.col("longitude"))))
    crowded = in_cells.groupBy(*group, "cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > k + 1)
    own = targets.select(
        *group, "request_id", F.explode(_all_cells(F.col("_lat"), F.col("_lon"))).alias("cell")
    )
    finest = unbroadcast(own).join(crowded, [*group, "cell"]).groupBy("request_id").agg(F.max("cell.level").alias("found"))
    start = F.greatest(F.coalesce("found", F.lit(0)) - 2, F.lit(0))
    searched = targets.join(finest, "request_id", "left").withColumn("search", start).drop("found")
    edge = _edge(F.col("search"))
    here = geo.cube_of(geo.sphere_point(F.col("_lat"), F.col("_lon")), edge)
    cells = F.transform(
        geo.cubes_around(here, edge), lambda c: F.struct(F.col("search").alias("level"), c.alias("cube"))
    )
    probes = searched.withColumn("cell", F.explode(cells)).drop("search")
    return unbroadcast(probes).join(unbroadcast(in_cells), [*group, "cell"]).drop("cell")


def reachable(members: DataFrame, k: int, group: list[str]) -> DataFrame:
    """The members that can be among the k best of a group but one, with the ``ties`` of their occupancy.

    Those are all with at most k candidates below them. Spark applies the rank's limit in each task
    before the shuffle, so of a group of any size only its lowest candidates and their ties move; the
    result is written, and nothing else of the group is.
    """
    lowest = F.rank().over(W.partitionBy(*group).orderBy("predicted_occupancy"))
    kept = members.withColumn("_below", lowest).filter(F.col("_below") <= k + 1).drop("_below").filter("predicted_occupancy IS NOT NULL")
    ties = F.count(F.lit(1)).over(W.partitionBy(*group, "predicted_occupancy"))
    return materialize(kept.withColumn("ties", ties), "reachable")


def nearest_pairs(here: np.ndarray, own: np.ndarray, there: np.ndarray, ids: np.ndarray, occupancy: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(request, candidate): the pairs of a group, without those that surely have k better ones of the same request.

    ``here`` and ``there`` are latitudes and longitudes, ``own`` and ``ids`` numbers of stations in the order of their ids.
    Only pairs of the highest occupancy are left out. Their distances are chords, which order as distances do; where
    a place is unknown nothing is. The ranking decides among the pairs that are left, by exact distances.
    """
    if len(ids) <= 2 * k:
        return np.nonzero(ids != own[:, None])
    high = np.isnan(occupancy) if np.isnan(occupancy).any() else occupancy == occupancy.max()
    low, last = np.flatnonzero(~high), np.flatnonzero(high)
    # Of one spot, the k+1 smallest ids are enough.
    last = last[np.lexsort((ids[last], there[last, 1], there[last, 0]))]
    new_spot = np.append(True, (np.diff(there[last], axis=0) != 0).any(axis=1))
    number = np.cumsum(new_spot | np.append(True, np.diff(ids[last]) != 0))
    last = last[number - number[np.maximum.accumulate(np.where(new_spot, np.arange(len(last)), 0))] <= k]

    def points(places):
        phi, lam = np.radians(places).T
        return np.stack([np.cos(phi) * np.cos(lam), np.cos(phi) * np.sin(lam), np.sin(phi)])

    at, to = points(here), points(there[last])
    odd, lost = ~np.isfinite(to).all(axis=0), ~np.isfinite(at).all(axis=0)
    found = []
    for a in range(0, len(here), max(1, PAIR_CELLS // max(1, len(ids)))):
        rows = np.arange(a, min(len(here), a + max(1, PAIR_CELLS // max(1, len(ids)))))
        r, c = np.nonzero(ids[low] != own[rows, None])
        found.append((rows[r], low[c]))
        missing = k - np.bincount(r, minlength=len(rows))
        others = ids[last] != own[rows, None]
        square = (at[0, rows, None] - to[0]) ** 2
        square += (at[1, rows, None] - to[1]) ** 2
        square += (at[2, rows, None] - to[2]) ** 2
        square[~others | odd] = np.inf
        if len(last) > k:
            nearest = np.sort(np.partition(square, k - 1, axis=1)[:, :k], axis=1)
            angle = 2 * np.arcsin(np.minimum(np.sqrt(nearest[np.arange(len(rows)), np.clip(missing, 1, k) - 1]) / 2, 1.0))
            limit = 4 * np.sin(np.minimum(angle + SURELY_KM / geo.EARTH_KM, np.pi) / 2) ** 2
            limit[~(angle < np.pi - 1e-3)] = np.inf
            near = square <= limit[:, None]
            near |= odd
            near |= lost[rows, None]
            near &= others
        else:
            near = others
        near &= (missing > 0)[:, None]
        r, c = np.nonzero(near)
        found.append((rows[r], last[c]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def in_groups(left: DataFrame, right: DataFrame, key: list[str], prepare, rows: int = 0) -> DataFrame:
    """Rows of ``left`` with rows of ``right`` of the same ``key``, which go: the pairs that are chosen in arrays.

    ``prepare(left, right)`` gets the rows of many groups as tables and returns a function that, for the places of one
    group's rows in them, gives the places of its pairs. Groups are told apart by 128 bits of hashes. As most have few
    rows, a task takes many together: about ``BUCKET_ROWS`` of ``rows``, or one that is larger.
    """
    buckets = max(4 * spread_tasks(left.sparkSession), rows // BUCKET_ROWS)

    def dealt(df: DataFrame) -> DataFrame:
        hashed = df.withColumns({"_a": F.xxhash64(*key), "_b": F.xxhash64(F.lit(1), *key)}).drop(*key)
        return spread(hashed.withColumn("_bucket", F.pmod("_a", F.lit(buckets))), "_bucket")

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        m = len(left)
        a, b = (np.concatenate([left[n].to_numpy(), right[n].to_numpy()]) for n in ("_a", "_b"))
        order = np.lexsort((b, a))
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(np.append(True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0))[:len(order)])
        sides = [(np.argsort(n, kind="stable"), n) for n in (number[:m], number[m:])]
        choose, found = prepare(left, right), [(np.zeros(0, np.int64),) * 2]
        for n in np.intersect1d(number[:m], number[m:]):
            found.append(choose(*(rows[slice(*np.searchsorted(numbers[rows], [n, n + 1]))] for rows, numbers in sides)))
        sides = [t.drop_columns(["_a", "_b", "_bucket"]).take(pa.array(np.concatenate(rows))) for t, rows in zip((left, right), zip(*found))]
        return pa.table([c for t in sides for c in t.columns], names=[n for t in sides for n in t.column_names])

    left, right = dealt(left), dealt(right)
    fields = [f for df in (left, right) for f in df.schema.fields if f.name not in ("_a", "_b", "_bucket")]
    return left.groupBy("_bucket").cogroup(right.groupBy("_bucket")).applyInArrow(together, T.StructType(fields))


#: Rows that a task holds at a time while it pairs groups; a larger group is held alone.
BUCKET_ROWS = 1 << 17


def numbers(table: pa.Table, *names: str) -> np.ndarray:
    """Columns as doubles, side by side; NULL is NaN."""
    return np.stack([table[n].cast(pa.float64()).to_numpy() for n in names], axis=1)


def paired(asked: DataFrame, kept: DataFrame, k: int, group: list[str]) -> DataFrame:
    """Requests with the candidates of their group that can be among their k best, paired in arrays.

    ``kept`` holds the candidates that ``reachable`` leaves and ``_requests``, the number of requests of the group. Groups
    of many requests are dealt to several tasks, to which their candidates are repeated.
    """
    rows = asked.count() + kept.count()
    # A pair without either id is none.
    asked, kept = asked.filter("_self IS NOT NULL"), kept.filter("station_id IS NOT NULL")
    parts = F.ceil(F.col("_requests") / PART_REQUESTS).cast("int")
    large = kept.filter(F.col("_requests") > PART_REQUESTS).select(*group, parts.alias("_parts")).distinct()
    part = F.pmod(F.xxhash64("request_id"), F.coalesce("_parts", F.lit(1))).cast("int")
    asked = asked.join(large, group, "left").withColumn("_part", part).drop("_parts")
    kept = kept.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_requests")

    def prepare(requests: pa.Table, candidates: pa.Table):
        m = len(requests)
        ids = [c for t, n in ((requests, "_self"), (candidates, "station_id")) for c in t[n].cast(pa.string()).chunks]
        ids = pa.concat_arrays(ids or [pa.array([], pa.string())]).dictionary_encode()
        rank = np.empty(len(ids.dictionary), np.int64)
        rank[np.argsort(ids.dictionary.to_numpy(zero_copy_only=False).astype(object))] = np.arange(len(rank))
        station = rank[ids.indices.to_numpy()]
        here, there = numbers(requests, "_lat", "_lon"), numbers(candidates, "latitude", "longitude")
        occupancy = numbers(candidates, "predicted_occupancy")[:, 0]

        def choose(r, c):
            i, j = nearest_pairs(here[r], station[r], there[c], station[m + c], occupancy[c], k)
            return r[i], c[j]

        return choose

    return in_groups(asked, kept, [*group, "_part"], prepare, rows)


def top_alternatives(targets: DataFrame, scored: DataFrame, k: int, condition: list[str],
                     direct_ties: int = DIRECT_TIES, direct_requests: int = DIRECT_REQUESTS) -> DataFrame:
    """The k best alternatives of every target by (occupancy, distance, id), with rank.

    Targets are paired with all they can reach where a level has at most ``direct_ties`` candidates, or a group
    at most ``direct_requests`` targets; only other levels are searched through the grid.

    ``targets`` hold request_id, station_id, pool, latitude, longitude, target_occupancy and the
    condition columns; ``scored`` holds valid candidates with 4-digit occupancies per condition.
    ``k`` bounds the per-request limit in column ``max_alternatives`` where there is one.
    """
    group = ["pool", *condition]
    direct_ties = max(direct_ties, k + 1)
    wanted = targets.groupBy(*group).agg(F.count(F.lit(1)).alias("_requests"))
    # Pools that no request has go before anything moves; they are most of those of whole cities.
    asked_pools = targets.select("pool").distinct()
    members = pool_members(scored.select(*condition, "standard", *ALTERNATIVE)).drop("standard").join(asked_pools, "pool", "left_semi")
    members = members.join(wanted, group)
    kept = reachable(members, k, group)
    asked = targets.select(
        *group, "request_id", F.col("station_id").alias("_self"), F.col("latitude").alias("_lat"),
        F.col("longitude").alias("_lon"), "target_occupancy",
        *[c for c in ("max_alternatives",) if c in targets.columns],
    )
    direct = (F.col("ties") <= direct_ties) | (F.col("_requests") <= direct_requests)
    few = paired(asked, kept.filter(direct).drop("ties"), k, group)
    many = asked.join(wanted.filter(F.col("_requests") > direct_requests), group, "left_semi")
    pairs = few.unionByName(nearest_ties(many, kept.filter(~direct).drop("ties", "_requests"), k, group).drop(*group))

    km = geo.haversine_km(F.col("_lat"), F.col("_lon"), F.col("latitude"), F.col("longitude"))
    order = W.partitionBy("request_id").orderBy("predicted_occupancy", "distance_km", "station_id")
    limit = F.coalesce("max_alternatives", F.lit(3)) if "max_alternatives" in asked.columns else F.lit(k)
    occ, target = F.col("predicted_occupancy"), F.col("target_occupancy")
    return (
        pairs.filter(F.col("station_id") != F.col("_self"))
        .withColumn("distance_km", pround(km, 2))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .filter(F.col("rank") <= limit)
        .withColumns({
            "occupancy_delta": pround(occ - target, 4),
            "occupancy_improvement": pround(target - occ, 4),
        })
        .drop("_self", "_lat", "_lon", "max_alternatives")
    )


#: A cell with more than one of so many users is dealt out; fewer than that many cells can be.
CROWDED_SHARE = 256


def within_radius(users: DataFrame, places: DataFrame, radius_km: float, crowded_share: int = CROWDED_SHARE) -> DataFrame:
    """User x place pairs within the radius: one grid-cell equi-join, then the exact distance.

    ``users`` carry user_lat and user_lon; ``places`` latitude and longitude. The small fan-out
    (the cells around a point) is on the places, the dimension, so each user is one row of the join.

    A cell with more than 1/``crowded_share`` of the users, as a metropolis has, is split: its users are
    numbered by a hash into as many parts as it takes, and only the places near that cell are repeated
    for each part. Counts of cells are added up in each task first, and there are fewer crowded cells
    than ``crowded_share``, so both sides get them by broadcast. The pairs are far more than the rows on either
    side, so the join is dealt to a number of tasks that doesn't follow from the bytes it reads.
    """
    asked, around = _in_cells(users, places, radius_km, crowded_share)
    km = geo.haversine_km(F.col("user_lat"), F.col("user_lon"), F.col("latitude"), F.col("longitude"))
    return (
        spread(asked, "_cell", "_part").join(unbroadcast(around), ["_cell", "_part"]).drop("_cell", "_part")
        .withColumn("distance_km", km)
        .filter(F.col("distance_km") <= radius_km)
    )


def _in_cells(users: DataFrame, places: DataFrame, radius_km: float, crowded_share: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_cell`` and ``_part``, in which all places within the radius of a user are."""
    edge = geo.chord(radius_km) * (1 + 1e-9)
    here = geo.cube_of(geo.sphere_point(F.col("user_lat"), F.col("user_lon")), F.lit(edge))
    there = geo.cube_of(geo.sphere_point(F.col("latitude"), F.col("longitude")), F.lit(edge))
    counts = users.groupBy(here.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    total = users.agg(F.count(F.lit(1)).alias("n")).scalar()
    crowded = F.broadcast(counts.filter(F.col("_n") * crowded_share > total).select(
        F.col("_cell").alias("_crowd"), F.ceil(F.col("_n") * crowded_share / total).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    asked = users.withColumn("_cell", here).join(crowded, F.col("_cell") == F.col("_crowd"), "left")
    asked = asked.withColumn("_part", F.pmod(F.xxhash64(*users.columns), parts).cast("int")).drop("_crowd", "_parts")
    around = places.withColumn("_cell", F.explode(geo.cubes_around(there, edge))).join(crowded, F.col("_cell") == F.col("_crowd"), "left")
    return asked, around.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_crowd", "_parts")


def chosen_within_radius(users: DataFrame, places: DataFrame, radius_km: float, prepare, crowded_share: int = CROWDED_SHARE) -> DataFrame:
    """``within_radius`` for pairs that are chosen in arrays (see ``in_groups``); a user's places are all in one group."""
    asked, around = _in_cells(users, places, radius_km, crowded_share)
    return in_groups(asked, around, ["_cell", "_part"], prepare)


#: Parts the users of a group are dealt to.
PAIR_PARTS = 16


def within_group(users: DataFrame, places: DataFrame, key: str, parts: int = PAIR_PARTS) -> DataFrame:
    """Every user with every place that has the same ``key``.

    Groups may be few and the pairs are far more than the rows on either side, so users are numbered by a hash into
    parts, places, the dimension, are repeated for each, and the join is dealt to a number of tasks that doesn't
    follow from the bytes it reads.
    """
    asked = users.withColumn("_part", F.pmod(F.xxhash64(*users.columns), F.lit(parts)).cast("int"))
    around = places.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return spread(asked, key, "_part").join(unbroadcast(around), [key, "_part"]).drop("_part")
