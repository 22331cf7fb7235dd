"""Exact, line and near-duplicate removal against brute force, on odd rows and on the small tables."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltlattice.llm import exact_dedup, graph, line_dedup, minhash_dedup
from voltlattice.llm.catalog import QUERIES
from voltlattice.llm.common import read_table

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_exact_dedup_of_odd_rows(odd, nothing):
    got = rows_of(exact_dedup.dedup(odd))
    groups = collections.defaultdict(list)
    for r in odd.collect():
        groups[hashlib.sha256(SPACE.sub(" ", r["text"] or "").encode()).hexdigest()].append(r["doc_id"])
    expected = []
    for digest, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        expected += [(i, keep, len(ids), i == keep, digest) for i in ids]
    assert sorted(map(repr, expected)) == sorted(repr((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])) for r in got)
    assert exact_dedup.dedup(nothing).count() == 0


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows, percent):
    """Least id by row number, from all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    for k, s in enumerate(sets):
        for j, n in collections.Counter(j for x in s for j in where[x] if j < k).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[root(k)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return [(i, len(sets[k]), least[root(k)], i == least[root(k)]) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash_matches_brute_force(llm_spark, sf_dir, percent):
    docs = read_table(llm_spark, sf_dir, "documents")
    got = sorted(tuple(r) for r in minhash_dedup.near_duplicates(docs, percent=percent).collect())
    assert got == sorted(brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], percent))


def test_minhash_query_is_at_85(llm_spark, sf_dir):
    docs = read_table(llm_spark, sf_dir, "documents").collect()
    got = sorted(tuple(r) for r in QUERIES["op6_minhash_dedup"](llm_spark, sf_dir).collect())
    assert got == sorted(brute_components([(r["doc_id"], r["text"]) for r in docs], 85))


def test_minhash_of_a_large_group_of_near_copies(llm_spark, monkeypatch):
    """More sets in a bucket than a block holds: chains of copies stay connected."""
    base = [f"b{k}" for k in range(120)]
    rows = [(k, " ".join(base[:10] + [f"c{k // 2}"] + base[11:60] + [f"d{k // 3}"] + base[61:])) for k in range(700)]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in minhash_dedup.near_duplicates(docs, percent=85).collect())
    assert got == sorted(brute_components(rows, 85))


def test_rows_of_blocks_grow_with_the_copies(llm_spark, monkeypatch):
    """Near copies of one text, of which many pairs are not linked: each copy is about as many rows whatever the group's size."""
    counted = {}
    for n in (500, 2000):
        rng = np.random.default_rng(n)
        rows = []
        for k in range(n):
            words = [f"b{j}" for j in range(100)]
            for j in rng.choice(100, 2, replace=False):
                words[j] = f"n{k}x{j}"
            rows.append((k, " ".join(words)))
        seen = []
        real = minhash_dedup._blocks
        monkeypatch.setattr(minhash_dedup, "_blocks", lambda members, classes: seen.append(real(members, classes).count()) or real(members, classes))
        found = minhash_dedup.near_duplicates(llm_spark.createDataFrame(rows, "doc_id long, text string").repartition(4), percent=80)
        assert found.count() == n
        monkeypatch.undo()
        counted[n] = seen[0]
    assert counted[2000] <= 5 * max(counted[500], 2000), counted


def test_minhash_of_odd_rows(odd, nothing):
    got = {(r["doc_id"], r["n_shingles"]): r for r in rows_of(minhash_dedup.near_duplicates(odd))}
    assert minhash_dedup.near_duplicates(odd).count() == odd.count()
    assert got[(4, 1)]["component_id"] == 3 and not got[(4, 1)]["kept"]
    assert got[(11, 56)]["component_id"] == 7 and got[(10, 56)]["component_id"] == 7
    assert got[(None, 56)]["component_id"] is None and got[(None, 56)]["kept"]
    for i in (0, 1, 2, 22):
        assert got[(i, 0)]["component_id"] == i and got[(i, 0)]["kept"]
    assert got[(13, len(shingles(next(r["text"] for r in odd.collect() if r["doc_id"] == 13))))]["component_id"] == 12
    assert minhash_dedup.near_duplicates(nothing).count() == 0


def test_shingle_hashes_tell_sets_apart():
    texts = ["A b\tc  d e f", "a B c d e f", "a b c d e g", "a b", "A\nb", "b a", "", None, "é É"]
    sets = minhash_dedup.shingle_sets(texts)
    for i, x in enumerate(texts):
        assert len(sets[i]) == len(shingles(x))
        for j, y in enumerate(texts):
            assert len(np.intersect1d(sets[i], sets[j])) == len(shingles(x) & shingles(y))


def test_components_of_chains_and_stars(llm_spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (5, 4), (4, 5)]
    got = {r["u"]: r["v"] for r in graph.components(llm_spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, **{k: 100 for k in range(101, 160)}}
    assert graph.components(llm_spark.createDataFrame([], "u long, v long")).count() == 0


def brute_lines(rows, min_words=50):
    """From the definition: a line goes if a run of equal lines around it, as long as it gets at one earlier place, has enough words.

    ``rows``: distinct (id, text) in ascending order.
    """
    trim = lambda x: x.strip(" \t\n\v\f\r")
    places = [(d, k, trim(x)) for d, (_, t) in enumerate(rows) for k, x in enumerate((t or "").split("\n")) if trim(x)]
    first = {}
    for p, (d, _, _) in enumerate(places):
        first.setdefault(d, p)
    words = [len(SPACE.sub(" ", x).split(" ")) for _, _, x in places]
    where = collections.defaultdict(list)
    for p, (_, _, x) in enumerate(places):
        where[x].append(p)
    same = lambda p, q: p < len(places) and places[p][2] == places[q][2]
    gone = collections.defaultdict(set)
    for p, (d, _, x) in enumerate(places):
        for q in where[x]:
            if q >= p:
                break
            # Only where a run begins: neither place has an equal line before it in its own document.
            if p > first[d] and q > first[places[q][0]] and same(p - 1, q - 1):
                continue
            n = 0
            while p + n < len(places) and places[p + n][0] == d and places[q + n][0] == places[q][0] and same(p + n, q + n):
                n += 1
            if sum(words[p:p + n]) >= min_words:
                gone[d].update(places[p + k][1] for k in range(n))
    return ["\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone[d]) if gone[d] else text for d, (_, text) in enumerate(rows)]


def test_glued_pieces_of_several_documents_stay(llm_spark):
    """A third document made of two pieces that earlier ones hold, each under the limit, repeats no run of 50 words."""
    rows = []
    for k in range(50):
        a, b, c = (" ".join(f"{name}{k}w{j}" for j in range(20)) for name in "abc")
        rows += [(3 * k, f"{a}\n{b}\nx{k} end"), (3 * k + 1, f"y{k} head\n{b}\n{c}"), (3 * k + 2, f"{a}\n{b}\n{c}")]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(tuple(r) for r in line_dedup.dedup_lines(docs).collect()) == rows


def test_repeated_runs_of_random_lines(llm_spark):
    """Few distinct lines of many lengths, so that runs overlap, nest and repeat inside a document."""
    rng = np.random.default_rng(12)
    lines = [" ".join(f"l{k}{j}" for j in range(int(rng.integers(1, 30)))) for k in range(12)] + ["", "  "]
    rows = [(d, "\n".join(lines[k] for k in rng.integers(0, 14, int(rng.integers(1, 40))))) for d in range(60)]
    rows += [(60 + d, rows[d][1] + "\n" + rows[d + 1][1]) for d in range(0, 20, 2)]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in line_dedup.dedup_lines(docs).collect())
    assert [t for _, t in got] == brute_lines(rows)
    assert sum(t != r[1] for (_, t), r in zip(got, rows)) > 10


def test_line_dedup_matches_brute_force(llm_spark, sf_dir):
    docs = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in read_table(llm_spark, sf_dir, "documents").collect())
    got = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in QUERIES["op2_line_dedup"](llm_spark, sf_dir).collect())
    expected = brute_lines([d[:2] for d in docs])
    assert [g[:2] for g in got] == [(d[0], t) for d, t in zip(docs, expected)]
    assert all(n == (len(t) if t != d[1] else d[2]) for (_, t, n), d in zip(got, docs))
    assert sum(a != d[1] for a, d in zip(expected, docs)) > 5


def test_line_dedup_of_odd_rows(odd, nothing):
    result = line_dedup.dedup_lines(odd)
    assert result.columns == odd.columns and result.count() == odd.count()
    got = collections.defaultdict(list)
    for r in result.collect():
        got[r["doc_id"]].append(r)
    text = lambda i: sorted((r["text"] or "") for r in got[i])
    # Null ids come first, so the passage stays in the row without an id.
    assert any(t.startswith("word0") for t in text(None))
    assert text(7) == [""] and text(8) == ["A head.\nA tail."] and text(9) == [""] and text(10) == [""]
    assert got[0][0]["text"] is None and text(1) == [""] and text(14) == ["short line\nshort line\nshort line"]
    assert len(text(12)) == 2 and text(12)[0] == text(12)[1] != ""
    assert got[8][0]["n_chars"] == len("A head.\nA tail.") and got[8][0]["id"] == "clash"
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_shared_runs_share_a_fingerprint(llm_spark):
    """The guarantee of the windows: every shared run of enough words has a fingerprint in both."""
    rng = np.random.default_rng(3)
    run = [" ".join(f"r{k}{j}" for j in range(int(rng.integers(1, 9)))) for k in range(20)]
    while sum(len(x.split()) for x in run[:-1]) >= 50:
        run.pop()
    rows = [(i, "\n".join([*(f"x{i} {k}" for k in range(int(rng.integers(0, 9)))), *run, *(f"y{i} {k}" for k in range(30))])) for i in range(6)]
    prints = collections.defaultdict(set)
    for r in line_dedup.windows(llm_spark.createDataFrame(rows, "doc_id long, text string")).collect():
        prints[r["id"]].add(r["print"])
    assert set.intersection(*prints.values())
