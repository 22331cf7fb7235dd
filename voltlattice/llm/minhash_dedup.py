"""Near-duplicate classes by MinHash with tensored banding, verified on full shingle sets.

A document's set holds its distinct 5-word shingles (ASCII-lower-cased words between ASCII white
space); with fewer words the whole sequence is its one shingle, without words the set is empty.
Shingles are 64-bit hashes.

Banding: two collections of ``HALF`` min-hashes are computed, 2 * HALF in all. Every pair of one
hash of either collection is the key of a table, so that HALF**2 tables of two-hash keys come from
2 * HALF hashes rather than 2 * HALF**2. Two sets of similarity s share no table with probability
below 2 * (1 - s)**HALF: with HALF = 6 that is 2.3e-5 at s = 0.85 and 1.3e-4 at s = 0.8.

1. Equal sets are one class, found by their size and a 128-bit digest. Only one member goes on.
2. Keys that one class has alone are settled. A pair of classes is a candidate if their sizes allow the
   similarity and they agree in ``AGREED`` hashes.
3. Only components matter, so each key's classes are first compared with a leader, the one that shares
   keys with most others: one pair a class, the same pair of several keys once. A second round takes a
   leader among those that the first left apart. Pairs are compared on full sets, built from the texts.
4. Keys whose classes are now in one component are settled, and so are keys of two classes. What is left
   is compared in blocks: the classes of the key's largest component in blocks of their own, each with
   every block of the others, never two blocks of what is connected already. So a class of a large
   group is one row, and only those that stand apart are repeated. First only min-hashes are looked at;
   the sets of classes with candidates follow. A pair is a candidate under its first common key only.
5. Components by star contraction; see ``graph``.

The work on classes that stay apart under one key is quadratic in their number, in array operations of
a few nanoseconds a shingle: that is what similarity without transitivity takes.

Cases: null, empty and blank texts have an empty set and are linked with nothing. Rows with the
same id are one document with several texts: they share a component. A row with a null id is linked
with nothing, has a null component and is kept. Repeated rows: each is in the result. Similarity
ties at the threshold are links. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from voltlattice.llm.common import Bitmap, materialize, text_of
from voltlattice.llm.graph import components

WORDS = 5
HALF = 6
#: Classes of a block, and bytes of their sets: what a task holds of a key at once is two blocks.
BLOCK, BLOCK_BYTES = 2048, 32 << 20
#: Rounds of leaders.
ROUNDS = 2
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Min-hashes, of 2 * HALF, that two sets must share to be compared. Sets of similarity 0.85 share
#: fewer with probability 5e-6, sets of similarity 0.8 with 6e-5.
AGREED = 4

_M = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95  # odd, so that it has an inverse modulo 2**64
_random = np.random.Generator(np.random.PCG64(20))
_BYTES = _random.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_A = _random.integers(1, 2**63, 2 * HALF, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(1, 2**63, 2 * HALF, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n``."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@np.errstate(over="ignore")
def shingle_sets(texts, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [(t or "").encode().lower() for t in texts]
    data = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
    power, inverse = _grown(len(data) + 1)
    space = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    begins, ends = edges[::2], edges[1::2]
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * power[:len(data)], dtype=np.uint64)])
    word = _mix((running[ends] - running[begins]) * inverse[begins] + (ends - begins).astype(np.uint64))
    at = np.searchsorted(begins, np.cumsum([1, *(len(r) + 1 for r in raw)]))
    rolled = np.zeros(max(len(word) - words + 1, 0), np.uint64)
    for k in range(words):
        rolled = rolled * _M + word[k:k + len(rolled)]
    rolled = _mix(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a:b - words + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for w in word[a:b]:
                h = h * _M + w
            out.append(_mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@np.errstate(over="ignore")
def _digest(s: np.ndarray) -> tuple[int, int]:
    return int(_mix(s ^ _M).sum(dtype=np.uint64).view(np.int64)), int(_mix(s + _M).sum(dtype=np.uint64).view(np.int64))


@np.errstate(over="ignore")
def _signature(s: np.ndarray) -> np.ndarray:
    return np.array([(s * a + b).min() for a, b in zip(_A, _B)]).view(np.int64)


_HASHES = [f"h{k}" for k in range(2 * HALF)]


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, d1, d2, h0 ...): set size, set digest and min-hashes (null for an empty set)."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n", "d1", "d2", *_HASHES]

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = shingle_sets(batch["text"])
            hashes = np.array([_signature(s) if len(s) else np.zeros(2 * HALF, np.int64) for s in sets]).reshape(-1, 2 * HALF)
            digests = np.array([_digest(s) for s in sets], np.int64).reshape(-1, 2)
            out = {"id": batch["id"], "n": [len(s) for s in sets], "d1": digests[:, 0], "d2": digests[:, 1]}
            yield pd.DataFrame({**out, **{name: hashes[:, k] for k, name in enumerate(_HASHES)}}, columns=names)

    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInPandas(
        signed, f"id {kind}, n long, d1 long, d2 long, " + ", ".join(f"{h} long" for h in _HASHES))


_KEY = ["table", "other", "key"]
_GROUP = [*_KEY, "first", "second"]


def _shared(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key belongs to more than one class."""
    crowded = rows.groupBy(*key).agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high")
    return rows.join(crowded.select(*key), key, "left_semi")


def _keyed(classes: DataFrame) -> DataFrame:
    """(table, other, key, rep): the tables' keys that classes share.

    Hashes of the first collection that one class has alone are settled before keys are formed.
    """
    halves = F.array(*(F.struct(F.lit(k).alias("table"), F.col(h).alias("a")) for k, h in enumerate(_HASHES[:HALF])))
    others = F.array(*(F.struct(F.lit(k).alias("other"), F.col(h).alias("b")) for k, h in enumerate(_HASHES[HALF:])))
    first = classes.select("rep", F.explode(halves).alias("x")).select("rep", "x.table", "x.a")
    pairs = (_shared(first, ["table", "a"]).join(classes.select("rep", others.alias("others")), "rep")
             .select("rep", "table", "a", F.explode("others").alias("y"))
             .select("table", "y.other", F.xxhash64("a", "y.b").alias("key"), "rep"))
    return _shared(pairs, _KEY)


def _pairs(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): each leader with the classes of its keys that it may be linked to, once.

    ``members`` holds the keys with rep, component, degree and ``apart``: whether it can be a leader now.
    """
    leaders = members.filter("apart").groupBy(*_KEY).agg(F.max_by(F.struct("rep", "component"), F.struct("degree", "rep")).alias("x"))
    pairs = members.join(leaders, _KEY).filter("component != x.component").select(F.col("x.rep").alias("a"), F.col("rep").alias("b")).distinct()
    told = classes.select("rep", "n", F.array(*_HASHES).alias("hashes"))
    for side in ("a", "b"):
        pairs = pairs.join(told.select(F.col("rep").alias(side), F.struct("n", "hashes").alias(f"{side}_told")), side)
    agreed = F.size(F.filter(F.zip_with("a_told.hashes", "b_told.hashes", lambda x, y: x == y), lambda same: same))
    low, high = F.least("a_told.n", "b_told.n"), F.greatest("a_told.n", "b_told.n")
    return pairs.filter((100 * low >= percent * high) & (agreed >= AGREED)).select("a", "b")


def _verified(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(u, v): the pairs whose full sets are similar."""
    kind = docs.schema[id_col].dataType.simpleString()
    sets = materialize(_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), id_col, text_col), "minhash-sets")
    sides = pairs.join(sets.select(F.col("rep").alias("b"), F.col("members").alias("b_set")), "b")
    sides = sides.join(sets.select(F.col("rep").alias("a"), F.col("members").alias("a_set")), "a")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            linked = [_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch["a_set"], batch["b_set"])]
            yield batch.loc[np.array(linked, bool), ["a", "b"]].rename(columns={"a": "u", "b": "v"})

    return sides.select("a", "b", "a_set", "b_set").mapInPandas(compared, f"u {kind}, v {kind}")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    spot = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[spot] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _labelled(keyed: DataFrame, found: DataFrame | None) -> DataFrame:
    """The keys' classes with the component that the links so far put them in."""
    if found is None:
        return keyed.withColumn("component", F.col("rep"))
    labels = components(found).select(F.col("u").alias("rep"), F.col("v").alias("_least"))
    return keyed.join(labels, "rep", "left").withColumn("component", F.coalesce("_least", "rep")).drop("_least")


def _open(members: DataFrame) -> DataFrame:
    """The members of keys with three classes or more in two components or more, and whether they are apart from the largest."""
    counts = members.groupBy(*_KEY, "component").agg(F.count(F.lit(1)).alias("size"))
    keys = counts.groupBy(*_KEY).agg(F.sum("size").alias("all"), F.count(F.lit(1)).alias("several"),
                                     F.max_by("component", F.struct("size", "component")).alias("major"))
    keys = keys.filter("several > 1 AND all > 2").select(*_KEY, "major")
    return members.drop("apart").join(keys, _KEY).withColumn("apart", F.col("component") != F.col("major")).drop("major")


def _blocks(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of blocks of a key with the rows of both: their component, chunk, set size and min-hashes.

    Chunks from 0 up hold the classes apart from the largest component, those from -1 down that component.
    """
    sized = members.join(classes.select("rep", "n", *_HASHES), "rep")
    needed = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("long")
    chunks = members.join(classes.select("rep", "n"), "rep").groupBy(*_KEY, "apart").agg(needed.alias("chunks"))
    each = chunks.groupBy(*_KEY).agg(F.max(F.when(F.col("apart"), F.col("chunks"))).alias("others"), F.max(F.when(~F.col("apart"), F.col("chunks"))).alias("own"))
    spot = F.pmod(F.xxhash64("rep"), F.when(F.col("apart"), F.col("others")).otherwise(F.col("own")))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    met = F.when(F.col("apart"), F.sequence(-F.col("own"), F.col("others") - one)).otherwise(F.sequence(zero, F.col("others") - one))
    placed = (sized.join(each, _KEY).withColumn("chunk", F.when(F.col("apart"), spot).otherwise(-spot - 1))
              .withColumn("with", F.explode(met)))
    return placed.select(*_KEY, F.least("chunk", "with").alias("first"), F.greatest("chunk", "with").alias("second"), "chunk", "rep", "component", "n", *_HASHES)


def _sets(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rep, members): the full sets of the given classes' first members, as sorted 64-bit hashes.

    A bitmap of fixed size keeps most other rows from being hashed; texts are never shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    told = Bitmap(reps, "rep").test()

    def built(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            wanted = batch[told(batch["hash"].to_numpy(np.int64))]
            yield pd.DataFrame({"rep": wanted["rep"], "members": [s.tobytes() for s in shingle_sets(wanted["text"])]})

    # Tested in the worker that builds the sets: a filter before it would be a second worker for each task.
    rows = docs.select(F.col(id_col).alias("rep"), F.xxhash64(id_col).alias("hash"), text_of(text_col).alias("text")).filter("rep IS NOT NULL")
    return rows.mapInPandas(built, f"rep {kind}, members binary").filter("octet_length(members) > 0")


def _candidates(x: int, ys: np.ndarray, table: int, other: int, sizes: np.ndarray, hashes: np.ndarray, comps: np.ndarray, percent: int) -> np.ndarray:
    """Of ``ys``, those of another component that first share this table with ``x``, whose sizes allow the similarity and that agree in enough hashes."""
    ys = ys[comps[ys] != comps[x]]
    same = hashes[ys] == hashes[x]
    low, high = np.minimum(sizes[ys], sizes[x]), np.maximum(sizes[ys], sizes[x])
    agreed = same.sum(1)
    fits = (~same[:, :table].any(1) & ~same[:, HALF:HALF + other].any(1) & same[:, table] & same[:, HALF + other]
            & (100 * low >= percent * high) & (agreed >= AGREED))
    return ys[fits][np.argsort(-agreed[fits], kind="stable")]


def _sides(chunks: np.ndarray, first: int, second: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each row with those it is to be compared with, every pair once."""
    left = np.flatnonzero(chunks == first)
    right = left if first == second else np.flatnonzero(chunks == second)
    for x in left.tolist():
        yield x, right[right > x] if first == second else right


def _plausible(sizes: np.ndarray, hashes: np.ndarray, comps: np.ndarray, chunks: np.ndarray, group: tuple, percent: int) -> np.ndarray:
    """The places of rows that have a candidate."""
    table, other, _, first, second = group
    hit = np.zeros(len(sizes), bool)
    for x, ys in _sides(chunks, first, second):
        found = _candidates(x, ys, table, other, sizes, hashes, comps, percent)
        hit[found] = True
        hit[x] |= len(found) > 0
    return np.flatnonzero(hit)


def _linked(reps: np.ndarray, members: list[bytes], hashes: np.ndarray, comps: np.ndarray, chunks: np.ndarray, group: tuple, percent: int) -> list[tuple]:
    """Links that span what the full sets of a group connect."""
    table, other, _, first, second = group
    sets = [np.frombuffer(m, np.uint64) for m in members]
    sizes = np.array([len(s) for s in sets])
    parent = list(range(len(reps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    firsts: dict = {}
    for k, c in enumerate(comps.tolist()):  # what is connected already
        parent[k] = firsts.setdefault(c, k)
    links = []
    for x, ys in _sides(chunks, first, second):
        for y in _candidates(x, ys, table, other, sizes, hashes, comps, percent).tolist():
            if root(x) != root(y) and _similar(sets[x], sets[y], percent):
                parent[root(y)] = root(x)
                links.append((reps[x], reps[y]))
    return links


def _by_group(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int, tuple]]]]:
    """Rows sorted by group as frames of whole groups, and the groups of two or more rows in each.

    A group has at most two blocks and may span batches, so memory is bounded.
    """
    held = None
    for batch in itertools.chain(batches, [None]):
        rows = batch if held is None else held if batch is None else pd.concat([held, batch], ignore_index=True)
        if rows is None or not len(rows):
            continue
        keys = rows[_GROUP].to_numpy(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
        end = len(rows) if batch is None else int(starts[-1])
        ends = [*starts[1:].tolist(), len(rows)]
        yield rows.iloc[:end], [(a, b, tuple(keys[a].tolist())) for a, b in zip(starts.tolist(), ends) if b <= end and b - a > 1]
        held = None if batch is None else rows.iloc[end:]


def _sorted_groups(rows: DataFrame) -> DataFrame:
    """Groups are small and many, so a task reads them as one sorted stream."""
    return rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP)


def links(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(u, v): links between classes that span their components."""
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = materialize(_keyed(classes), "minhash-keys")
    sizes = keyed.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("size"))
    degrees = keyed.join(sizes, _KEY).groupBy("rep").agg(F.sum("size").alias("degree"))
    members = _labelled(keyed.join(degrees, "rep"), None).withColumn("apart", F.lit(True))
    found = None
    for _ in range(ROUNDS):
        pairs = materialize(_pairs(members, classes, percent), "minhash-pairs")
        linked = _verified(docs, pairs, id_col, text_col, percent)
        found = materialize(linked if found is None else found.unionByName(linked), "minhash-links")
        members = materialize(_open(_labelled(members.drop("component"), found)), "minhash-open")
    blocks = _sorted_groups(_blocks(members, classes))

    def narrowed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, groups in _by_group(batches):
            told = rows["n"].to_numpy(), rows[_HASHES].to_numpy(np.int64), rows["component"].to_numpy(), rows["chunk"].to_numpy()
            kept = [a + _plausible(*(x[a:b] for x in told), group, percent) for a, b, group in groups]
            yield rows.iloc[np.concatenate(kept) if kept else []]

    narrow = materialize(blocks.mapInPandas(narrowed, blocks.schema), "minhash-candidates")
    sets = _sets(docs, narrow.select("rep").distinct(), id_col, text_col)
    full = _sorted_groups(narrow.select(*_GROUP, "chunk", "rep", "component", *_HASHES).join(sets, "rep"))

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, groups in _by_group(batches):
            told = rows["rep"].to_numpy(), rows["members"].tolist(), rows[_HASHES].to_numpy(np.int64), rows["component"].to_numpy(), rows["chunk"].to_numpy()
            spans = [link for a, b, group in groups for link in _linked(*(x[a:b] for x in told), group, percent)]
            yield pd.DataFrame(spans, columns=["u", "v"]).astype(rows["rep"].dtype)

    return found.unionByName(full.mapInPandas(compared, f"u {kind}, v {kind}"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row."""
    signed = materialize(signatures(docs, id_col, text_col), "minhash-signatures")
    known = signed.filter("n > 0 AND id IS NOT NULL")
    groups = known.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), *(F.first(h).alias(h) for h in _HASHES))
    classes = materialize(groups, "minhash-classes")
    # Members are tied to their class by a link as well, so that an id with several texts joins their classes.
    member = known.select("id", "n", "d1", "d2").join(classes.select("n", "d1", "d2", "rep"), ["n", "d1", "d2"])
    tied = member.filter("id != rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    found = components(links(docs, classes, id_col, text_col, percent).unionByName(tied))
    return (signed.select("id", "n").join(found.select(F.col("u").alias("id"), F.col("v").alias("least")), "id", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.coalesce("least", "id").alias("component_id"),
                    F.col("id").eqNullSafe(F.coalesce("least", "id")).alias("kept")))
