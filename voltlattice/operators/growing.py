"""Growing regression trees on bootstrap samples, for tables of any size.

Features are binned once to one byte each and written in blocks of rows. A tree's weight of a row is a
Poisson number drawn from the seed, the tree and the row's place in those blocks, so every pass sees
the same sample without storing it. Then:

* While a node holds more than ``LOCAL_ROWS`` sampled rows, a level is one pass over the blocks: tasks sum
  histograms by (tree, node) over up to ``SLAB_ROWS`` rows at a time, tree by tree, Spark adds them up, and only
  the chosen splits reach the driver, of which there are at most ``trees * rows / LOCAL_ROWS`` a level.
* The rows of every other node are sent once to one task, as packed bytes, and the whole subtree is grown
  there level by level. A node has at most ``LOCAL_ROWS`` rows, so a task's memory is bounded. Trees are sent
  some at a time, and what was shuffled for them is deleted before the next: see ``BATCH_ROWS``.
* A tree's parts are joined into one flat array of nodes (at most ``2 ** (depth + 1)``) and written as a file.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from voltlattice.session import CLEANUP, materialize
from voltlattice.sources.blobs import write_blob

#: Sampled rows of a node that are grown in one task: about 70 MB of packed rows, 400 MB while it grows.
LOCAL_ROWS = 1 << 22
#: Rows that a task adds up to one histogram of a node before it sends it: about 100 MB.
SLAB_ROWS = 1 << 22
#: Rows of all the trees that are sent at a time, about 25 bytes each, but never fewer than ``LEAST_TREES`` trees.
BATCH_ROWS, LEAST_TREES = 1 << 27, 8
#: Histogram cells that are looked at together, and bytes of rows that a task holds before it sends them.
CELLS, HELD_BYTES = 1 << 20, 16 << 20
#: From how many rows on the upper levels of a subtree are grown by ``_upper``, and the most histogram cells of a level there (16 bytes each).
MANY_ROWS, MOST_CELLS = 1 << 17, 1 << 22
#: Cells of a joint histogram of several features, and rows that are added up at a time.
JOINT_CELLS, CHUNK_ROWS = 1 << 12, 1 << 17
#: Rows that walk down a tree together.
STEP_ROWS = 1 << 14

#: A node: split feature (-1: leaf), bin and threshold (up to it goes left), left child (right is the next),
#: mean and number of sampled rows, and what its split takes off the sum of squares.
NODE = np.dtype([("feature", "<i2"), ("bin", "<i2"), ("threshold", "<f8"), ("child", "<i4"),
                 ("value", "<f8"), ("rows", "<f8"), ("gain", "<f8")])


def bounds(df: DataFrame, columns: list[str], max_bins: int) -> list[np.ndarray]:
    """Ascending thresholds of each feature: its quantiles, all its values if they are few."""
    shares = [k / max_bins for k in range(1, max_bins)]
    found = df.agg(*(F.percentile_approx(c, shares, 100 * max_bins).alias(f"b{k}") for k, c in enumerate(columns))).first()
    return [np.unique(np.array(found[k] or [], np.float64)) for k in range(len(columns))]


def binned(df: DataFrame, columns: list[str], target: str, edges: list[np.ndarray]) -> DataFrame:
    """(part, block, codes, target): blocks of rows as bytes, one code a feature."""
    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for block, batch in enumerate(batches):
            codes = np.stack([np.searchsorted(e, batch[c].to_numpy(np.float64), "left").astype(np.uint8) for c, e in zip(columns, edges)], axis=1)
            yield pd.DataFrame({"part": [part], "block": [block], "codes": [codes.tobytes()], "target": [batch[target].to_numpy("<f8").tobytes()]})

    rows = df.select(*(F.col(c).cast("double").alias(c) for c in columns), F.col(target).cast("double").alias(target))
    return materialize(rows.mapInPandas(packed, "part int, block int, codes binary, target binary"), "forest-blocks")


def sample(seed: int, tree: int, part: int, block: int, rows: int) -> np.ndarray:
    """How often each row of a block is drawn for a tree."""
    return np.random.default_rng([seed, tree, part, block]).poisson(1.0, rows)


class Bins:
    """Places of the features' bins in one row of cells."""

    def __init__(self, edges: list[np.ndarray]):
        self.sizes = np.array([len(e) + 1 for e in edges])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.cells = int(self.sizes.sum())
        self.feature = np.repeat(np.arange(len(edges)), self.sizes)
        #: Features that share a joint histogram, of at most ``JOINT_CELLS`` cells; the largest first.
        self.bundles: list[list[int]] = []
        room: list[int] = []
        for f in np.argsort(-self.sizes, kind="stable").tolist():
            k = next((k for k, r in enumerate(room) if self.sizes[f] <= r), len(room))
            if k == len(room):
                self.bundles.append([])
                room.append(JOINT_CELLS)
            self.bundles[k].append(f)
            room[k] //= int(self.sizes[f])
        #: Cells of the widest joint histogram.
        self.widest = max((int(np.prod(self.sizes[b])) for b in self.bundles), default=1)

    def joint(self, codes) -> list[np.ndarray]:
        """For each bundle, the cell of every row in its joint histogram."""
        out = []
        for bundle in self.bundles:
            at = codes[:, bundle[0]].astype(np.uint16)
            for f in bundle[1:]:
                at *= np.uint16(self.sizes[f])
                at += codes[:, f]
            out.append(at)
        return out

    def joint_histograms(self, joint, weight, weighted, node, nodes: int) -> tuple[np.ndarray, np.ndarray]:
        """``histograms`` by joint cells: two counts a bundle, not a feature; for many rows a node."""
        out = np.empty((2, nodes, self.cells))
        step = max(CHUNK_ROWS, nodes * self.widest)
        for bundle, cell in zip(self.bundles, joint):
            sizes = self.sizes[bundle]
            size = int(np.prod(sizes))
            totals = np.zeros((2, nodes * size))
            for a in range(0, len(node), step):
                at = node[a:a + step] * size
                at += cell[a:a + step]
                totals[0] += np.bincount(at, weight[a:a + step], nodes * size)
                totals[1] += np.bincount(at, weighted[a:a + step], nodes * size)
            totals = totals.reshape(2, nodes, *sizes)
            for k, f in enumerate(bundle):
                others = tuple(2 + j for j in range(len(bundle)) if j != k)
                out[:, :, self.starts[f]:self.starts[f] + self.sizes[f]] = totals.sum(others)
        return out[0], out[1]

    def histograms(self, codes, weight, weighted, node, nodes: int) -> tuple[np.ndarray, np.ndarray]:
        """(weights, weighted targets) by node and cell."""
        drawn, summed = np.empty((nodes, self.cells)), np.empty((nodes, self.cells))
        for feature, (start, size) in enumerate(zip(self.starts.tolist(), self.sizes.tolist())):
            at = node * size
            at += codes[:, feature]
            drawn[:, start:start + size] = np.bincount(at, weight, nodes * size).reshape(nodes, size)
            summed[:, start:start + size] = np.bincount(at, weighted, nodes * size).reshape(nodes, size)
        return drawn, summed

    def best(self, drawn, summed, min_leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """(cell, gain) of each node's best split; gain 0 where there is none."""
        first = slice(0, self.sizes[0])
        rows, total = drawn[:, first].sum(1)[:, None], summed[:, first].sum(1)[:, None]
        # Every feature holds all rows of the node, so the running sum before it is known.
        left = np.cumsum(drawn, 1) - self.feature * rows
        left_sum = np.cumsum(summed, 1) - self.feature * total
        right = rows - left
        able = (left >= min_leaf) & (right >= min_leaf)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left_sum**2 / left + (total - left_sum) ** 2 / right - total**2 / rows
        gain = np.where(able, gain, 0.0)
        cell = gain.argmax(1)
        return cell, gain[np.arange(len(cell)), cell]


#: A split must take off more than rounding does.
LEAST_GAIN = 1e-10


def _divide(out: np.ndarray, edges: list[np.ndarray], count: int) -> np.ndarray:
    """Thresholds and children of a level's split nodes, whose numbers come back."""
    parents = np.flatnonzero(out["feature"] >= 0)
    out["threshold"][parents] = [edges[f][b] for f, b in zip(out["feature"][parents], out["bin"][parents])]
    out["child"][parents] = count + 2 * np.arange(len(parents))
    return parents


def _upper(codes, target, weight, edges: list[np.ndarray], depth: int, min_leaf: int):
    """The upper levels over many rows: (levels, nodes so far, the rows left, their node, nodes of the next level).

    Rows stay in their order. Histograms are joint ones while nodes are large. Of two siblings only the one of fewer
    rows is added up; the other is what is left of their parent's. That leaves rounding errors in the sums, of the size
    of the parent's, so a node whose own rows hardly differ is not looked at.
    """
    bins, levels, count = Bins(edges), [], 1
    joint, weighted = bins.joint(codes), weight * target
    squares = weighted * target
    node, nodes, before = np.zeros(len(target), np.int64), 1, None
    flat, begins = codes.ravel(), np.arange(len(target)) * codes.shape[1]
    for level in range(depth + 1):
        # Rows of finished nodes have the number ``nodes``.
        out = np.zeros(nodes, NODE)
        out["feature"] = -1
        out["rows"] = np.bincount(node, weight, nodes + 1)[:nodes]
        total = np.bincount(node, weighted, nodes + 1)[:nodes]
        out["value"] = total / np.maximum(out["rows"], 1e-300)
        spread = np.bincount(node, squares, nodes + 1)[:nodes] - total * out["value"]
        able = np.flatnonzero((out["rows"] >= 2 * min_leaf) & (spread > LEAST_GAIN * out["rows"]))
        if level < depth and len(able) * bins.cells > MOST_CELLS:
            break
        levels.append(out)
        if level == depth or not len(able):
            return levels, count, None, None, 0
        counted = able
        if before is not None:
            here = np.bincount(node, minlength=nodes + 1)
            small = np.arange(0, nodes, 2) + (here[1:nodes:2] < here[0:nodes:2])
            counted = small[np.unique(able // 2)]
        place = np.full(nodes + 1, -1)
        place[counted] = np.arange(len(counted))
        spot = place.take(node, mode="clip")
        some = np.flatnonzero(spot >= 0)
        if len(some) < len(spot):
            spot, mine, mine_weighted = spot.take(some), weight.take(some), weighted.take(some)
        else:
            mine, mine_weighted = weight, weighted
        if len(some) >= len(counted) * bins.widest:
            cells = joint if len(some) == len(node) else [j.take(some) for j in joint]
            drawn, summed = bins.joint_histograms(cells, mine, mine_weighted, spot, len(counted))
        else:
            drawn, summed = np.zeros((len(counted), bins.cells)), np.zeros((len(counted), bins.cells))
            step = max(CHUNK_ROWS, len(counted) * int(bins.sizes.max()))
            for a in range(0, len(some), step):
                rows = slice(a, a + step)
                for whole, part in zip((drawn, summed), bins.histograms(codes.take(some[rows], 0), mine[rows], mine_weighted[rows], spot[rows], len(counted))):
                    whole += part
        if before is not None:
            own = np.full(nodes, -1)
            own[counted] = np.arange(len(counted))
            other = own[able ^ 1]
            left = (own[able] < 0)[:, None]
            drawn, summed = (np.where(left, was[able // 2] - now[other], now[own[able]]) for was, now in zip(before, (drawn, summed)))
        for a in range(0, len(able), max(1, CELLS // bins.cells)):
            part = slice(a, a + max(1, CELLS // bins.cells))
            cell, gain = bins.best(drawn[part], summed[part], min_leaf)
            split = gain > LEAST_GAIN * out["rows"][able[part]]
            chosen, feature = able[part][split], bins.feature[cell[split]]
            out["feature"][chosen] = feature
            out["bin"][chosen] = cell[split] - bins.starts[feature]
            out["gain"][chosen] = gain[split]
        parents = _divide(out, edges, count)
        if not len(parents):
            return levels, count, None, None, 0
        kept = np.isin(able, parents)
        before = drawn[kept], summed[kept]
        feature, limit = np.append(out["feature"], -1).astype(np.int64), np.append(out["bin"], 0).astype(np.uint8)
        child = np.full(nodes + 1, 2 * len(parents))
        child[parents] = 2 * np.arange(len(parents))
        tested = feature.take(node, mode="clip")
        live = tested >= 0
        alive = np.count_nonzero(live)
        if alive < 0.75 * len(node):
            keep = np.flatnonzero(live)
            codes, target, weight, weighted, squares = codes.take(keep, 0), target.take(keep), weight.take(keep), weighted.take(keep), squares.take(keep)
            joint, node, tested = [j.take(keep) for j in joint], node.take(keep), tested.take(keep)
            flat, begins, live = codes.ravel(), begins[:alive], True
        right = flat.take(begins + tested, mode="clip") > limit.take(node, mode="clip")
        node = child.take(node, mode="clip")
        node += right & live
        nodes, count = 2 * len(parents), count + 2 * len(parents)
    keep = np.flatnonzero(node < nodes)
    return levels, count, (codes.take(keep, 0), target.take(keep), weight.take(keep)), node.take(keep), nodes


def grow(codes, target, weight, edges: list[np.ndarray], depth: int, min_leaf: int) -> np.ndarray:
    """The nodes of one tree over these rows, children side by side, the root first."""
    bins, levels, count = Bins(edges), [], 1
    node, nodes = np.zeros(len(target), np.int64), 1
    weight = weight.astype(np.float64)
    if len(target) >= MANY_ROWS:
        levels, count, left, node, nodes = _upper(codes, target, weight, edges, depth, min_leaf)
        if left is None:
            return np.concatenate(levels)
        codes, target, weight = left
    for level in range(len(levels), depth + 1):
        out = np.zeros(nodes, NODE)
        out["feature"] = -1
        out["rows"] = np.bincount(node, weight, nodes)
        out["value"] = np.bincount(node, weight * target, nodes) / np.maximum(out["rows"], 1e-300)
        levels.append(out)
        wide = out["rows"] >= 2 * min_leaf
        if level == depth or not wide.any():
            break
        order = np.flatnonzero(wide[node])
        # Numbers of two bytes are sorted by counting.
        order = order[np.argsort(node[order].astype(np.uint16 if nodes <= 1 << 16 else np.int64), kind="stable")]
        codes, target, weight, node = codes.take(order, 0), target.take(order), weight.take(order), node.take(order)
        able = np.flatnonzero(wide)
        for at in range(0, len(able), max(1, CELLS // bins.cells)):
            some = able[at:at + max(1, CELLS // bins.cells)]
            place = np.full(nodes, -1)
            place[some] = np.arange(len(some))
            a, b = np.searchsorted(node, [some[0], some[-1] + 1])
            drawn, summed = np.zeros((len(some), bins.cells)), np.zeros((len(some), bins.cells))
            for c in range(a, b, 1 << 17):
                rows = slice(c, min(b, c + (1 << 17)))
                for total, part in zip((drawn, summed), bins.histograms(codes[rows], weight[rows], weight[rows] * target[rows], place[node[rows]], len(some))):
                    total += part
            cell, gain = bins.best(drawn, summed, min_leaf)
            split = gain > LEAST_GAIN * np.maximum(out["rows"][some], 1)
            chosen, feature = some[split], bins.feature[cell[split]]
            out["feature"][chosen] = feature
            out["bin"][chosen] = cell[split] - bins.starts[feature]
            out["gain"][chosen] = gain[split]
        parents = _divide(out, edges, count)
        if not len(parents):
            break
        feature, limit, child = (np.ascontiguousarray(out[c]) for c in ("feature", "bin", "child"))
        keep = np.flatnonzero(feature[node] >= 0)
        codes, target, weight, node = codes.take(keep, 0), target.take(keep), weight.take(keep), node.take(keep)
        right = codes.ravel().take(np.arange(len(node)) * len(edges) + feature[node]) > limit[node]
        node = (child[node] - count + right).astype(np.int64)
        nodes, count = 2 * len(parents), count + 2 * len(parents)
    return np.concatenate(levels)


def walk(tree: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The leaf of each row of codes."""
    return descend(tree, tree["bin"], np.iinfo(np.int16).max, codes)


def descend(tree: np.ndarray, limits: np.ndarray, most, rows: np.ndarray) -> np.ndarray:
    """The leaf of each row of values, which go left up to the node's limit; none is above ``most``.

    A leaf is its own child, so that all rows take the same steps.
    """
    leaf = tree["feature"] < 0
    feature = np.where(leaf, 0, tree["feature"]).astype(np.int64)
    limit = np.where(leaf, most, limits)
    child = np.where(leaf, np.arange(len(tree)), tree["child"]).astype(np.int64)
    values = np.ascontiguousarray(rows).ravel()
    out = np.zeros(len(rows), np.int64)
    # Some rows at a time, which stay in the processor's cache; every place is within its array.
    for a in range(0, len(rows) if not leaf.all() else 0, STEP_ROWS):
        at = out[a:a + STEP_ROWS]
        begins = np.arange(a, a + len(at)) * rows.shape[1]
        while True:
            place = feature.take(at, mode="clip")
            place += begins
            below = child.take(at, mode="clip")
            below += values.take(place, mode="clip") > limit.take(at, mode="clip")
            if np.array_equal(below, at):
                break
            at = below
        out[a:a + STEP_ROWS] = at
    return out


def _unpacked(row, features: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row.codes, np.uint8).reshape(-1, features), np.frombuffer(row.target, "<f8")


def _slabs(batches: Iterator[pd.DataFrame], features: int) -> Iterator[list[tuple]]:
    """The blocks as lists of (part, block, codes, target), each of at least ``SLAB_ROWS`` rows but the last."""
    held, rows = [], 0
    for batch in batches:
        for row in batch.itertuples(index=False):
            held.append((row.part, row.block, *_unpacked(row, features)))
            rows += len(held[-1][3])
            if rows >= SLAB_ROWS:
                yield held
                held, rows = [], 0
    if held:
        yield held


def _tops(blocks: DataFrame, edges: list[np.ndarray], trees: int, depth: int, min_leaf: int, seed: int, local_rows: int) -> list[np.ndarray]:
    """The upper part of each tree: its leaves hold at most ``local_rows`` sampled rows or are at the full depth."""
    spark, features = blocks.sparkSession, len(edges)
    rows = blocks.agg(F.sum(F.octet_length("target") / 8)).first()[0] or 0
    root = np.zeros(1, NODE)
    root["feature"], root["rows"] = -1, rows
    tops, active = [root.copy() for _ in range(trees)], {t: [0] for t in range(trees)}
    bins = Bins(edges)
    for _ in range(depth):
        active = {t: [n for n in nodes if tops[t]["rows"][n] > local_rows] for t, nodes in active.items()}
        active = {t: nodes for t, nodes in active.items() if nodes}
        if not active:
            break
        shared = spark.sparkContext.broadcast((tops, active))

        def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tops, active = shared.value
            for slab in _slabs(batches, features):
                codes, target = np.concatenate([c for *_, c, _ in slab]), np.concatenate([y for *_, y in slab])
                joint = bins.joint(codes)
                for t, nodes in active.items():
                    place = np.full(len(tops[t]), -1)
                    place[nodes] = np.arange(len(nodes))
                    weight = np.concatenate([sample(seed, t, part, block, len(y)).astype(np.uint8) for part, block, _, y in slab])
                    mine = np.flatnonzero(weight)
                    node = np.empty(len(mine), np.int64)
                    for a in range(0, len(mine), CHUNK_ROWS):
                        node[a:a + CHUNK_ROWS] = place.take(walk(tops[t], codes.take(mine[a:a + CHUNK_ROWS], 0)), mode="clip")
                    if (node < 0).any():
                        inside = np.flatnonzero(node >= 0)
                        mine, node = mine.take(inside), node.take(inside)
                    drawn = weight.take(mine).astype(float)
                    weighted = drawn * target.take(mine)
                    if len(mine) >= len(nodes) * bins.widest:
                        cells = np.stack(bins.joint_histograms([j.take(mine) for j in joint], drawn, weighted, node, len(nodes)))
                    else:
                        cells = np.zeros((2, len(nodes), bins.cells))
                        for a in range(0, len(mine), CHUNK_ROWS):
                            some = slice(a, a + CHUNK_ROWS)
                            cells += bins.histograms(codes.take(mine[some], 0), drawn[some], weighted[some], node[some], len(nodes))
                    for a in range(0, len(nodes), max(1, HELD_BYTES // (16 * bins.cells))):
                        spots = range(a, min(len(nodes), a + max(1, HELD_BYTES // (16 * bins.cells))))
                        yield pd.DataFrame([(t, nodes[k], cells[:, k].tobytes()) for k in spots], columns=["tree", "node", "cells"])

        def chosen(group: pd.DataFrame) -> pd.DataFrame:
            drawn, summed = np.sum([np.frombuffer(c, "<f8").reshape(2, 1, -1) for c in group["cells"]], axis=0)
            cell, gain = (x[0] for x in bins.best(drawn, summed, min_leaf))
            feature = int(bins.feature[cell])
            here = slice(bins.starts[feature], cell + 1)
            total = drawn[0, : bins.sizes[0]].sum()
            left = drawn[0, here].sum()
            found = gain > LEAST_GAIN * total
            return pd.DataFrame({"tree": group["tree"][:1], "node": group["node"][:1], "feature": [feature if found else -1], "bin": [int(cell - bins.starts[feature])],
                                 "gain": [gain], "n_left": [left], "n_right": [total - left]})

        sums = blocks.mapInPandas(counted, "tree int, node int, cells binary")
        splits = sums.groupBy("tree", "node").applyInPandas(chosen, "tree int, node int, feature int, bin int, gain double, n_left double, n_right double").toPandas()
        active = {}
        for t, part in splits.groupby("tree"):
            grown = [tops[t]]
            for s in part.sort_values("node").itertuples():
                if s.feature < 0:
                    continue
                count = sum(map(len, grown))
                node = tops[t][s.node:s.node + 1]
                node["feature"], node["bin"], node["threshold"], node["child"], node["gain"] = s.feature, s.bin, edges[s.feature][s.bin], count, s.gain
                pair = np.zeros(2, NODE)
                pair["feature"], pair["rows"] = -1, (s.n_left, s.n_right)
                grown.append(pair)
                active.setdefault(t, []).extend([count, count + 1])
            tops[t] = np.concatenate(grown)
    return tops


def _levels(tree: np.ndarray) -> np.ndarray:
    """The depth of each node; children come after their parent."""
    level = np.zeros(len(tree), np.int64)
    for n in np.flatnonzero(tree["feature"] >= 0):
        level[tree["child"][n]:tree["child"][n] + 2] = level[n] + 1
    return level


def fit(df: DataFrame, columns: list[str], target: str, folder: str, trees: int, depth: int, min_leaf: int, seed: int,
        max_bins: int, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Write ``tree-N.bin`` for each tree to ``folder``; (tree, nodes, gains by feature) comes back."""
    spark, features = df.sparkSession, len(columns)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    edges = bounds(df, columns, min(max_bins, 256))
    blocks = binned(df.repartition(n), columns, target, edges)
    tops = _tops(blocks, edges, trees, depth, min_leaf, seed, local_rows)
    shared = spark.sparkContext.broadcast((tops, edges))
    rows = blocks.agg(F.sum(F.octet_length("target") / 8)).first()[0] or 0
    at_once = max(LEAST_TREES, int(BATCH_ROWS // max(rows, 1)))
    told, before = [], spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        for first in range(0, max(trees, 1), at_once):
            told.append(_grown(blocks, shared, range(first, min(trees, first + at_once)), folder, features, depth, min_leaf, seed, n))
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return functools.reduce(DataFrame.unionByName, told)


def _grown(blocks: DataFrame, shared, chosen: range, folder: str, features: int, depth: int, min_leaf: int, seed: int, n: int) -> DataFrame:
    """Grow and write the chosen trees below their upper parts."""
    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The sampled rows of a block, by tree and leaf of its upper part."""
        tops, _ = shared.value
        out, held = [], 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                codes, values = _unpacked(row, features)
                for t in chosen:
                    weight = sample(seed, t, row.part, row.block, len(values)).astype(np.uint8)
                    drawn = np.flatnonzero(weight)
                    sampled = codes.take(drawn, 0)
                    leaf = walk(tops[t], sampled)
                    # Numbers of two bytes are sorted by counting.
                    order = np.argsort(leaf.astype(np.uint16 if len(tops[t]) <= 1 << 16 else np.int64), kind="stable")
                    leaf, drawn, sampled = leaf.take(order), drawn.take(order), sampled.take(order, 0)
                    drawn_values, drawn_weight = values.take(drawn), weight.take(drawn)
                    ends = np.flatnonzero(np.diff(leaf, append=-1)) + 1
                    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
                        out.append((t, int(leaf[a]), sampled[a:b].tobytes(), drawn_values[a:b].tobytes(), drawn_weight[a:b].tobytes()))
                    held += len(drawn) * (features + 9)
                    if held >= HELD_BYTES:
                        yield pd.DataFrame(out, columns=["tree", "node", "codes", "target", "weight"])
                        out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=["tree", "node", "codes", "target", "weight"])

    def grown(group: pd.DataFrame) -> pd.DataFrame:
        tops, edges = shared.value
        t, n = int(group["tree"].iloc[0]), int(group["node"].iloc[0])
        group = group.sort_values("codes")  # the order of arrival doesn't matter
        codes = np.frombuffer(b"".join(group["codes"]), np.uint8).reshape(-1, features)
        values, weight = np.frombuffer(b"".join(group["target"]), "<f8"), np.frombuffer(b"".join(group["weight"]), np.uint8)
        part = grow(codes, values, weight, edges, depth - int(_levels(tops[t])[n]), min_leaf)
        return pd.DataFrame({"tree": [t], "node": [n], "part": [part.tobytes()]})

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        tops, _ = shared.value
        t = int(group["tree"].iloc[0])
        tree = [tops[t].copy()]
        count = len(tree[0])
        for n, data in sorted(zip(group["node"], group["part"])):
            part = np.frombuffer(data, NODE).copy()
            inner = part["feature"] >= 0
            part["child"][inner] += count - 1  # its root takes the place of the upper part's leaf
            tree[0][n] = part[0]
            tree.append(part[1:])
            count += len(part) - 1
        tree = np.concatenate(tree)
        write_blob(folder, f"tree-{t:05d}.bin", tree.tobytes())
        split = tree["feature"] >= 0
        gains = np.bincount(tree["feature"][split], tree["gain"][split], features)
        return pd.DataFrame({"tree": [t], "nodes": [len(tree)], "gains": [gains.tolist()]})

    # Four groups a core: with an explicit number, small inputs are not merged into one task.
    sent = blocks.mapInPandas(dealt, "tree int, node int, codes binary, target binary, weight binary").repartition(4 * n, "tree", "node")
    parts = sent.groupBy("tree", "node").applyInPandas(grown, "tree int, node int, part binary")
    return materialize(parts.repartition(n, "tree").groupBy("tree").applyInPandas(joined, "tree int, nodes long, gains array<double>"), "forest-trees")
