"""Resampling, conversation repair and top-k search against plain versions, on the small tables and on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

import oracle
from voltlattice.llm import conversation_repair, resampling, topk_search
from voltlattice.llm.catalog import QUERIES, SQL
from voltlattice.llm.common import read_table


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def features_of(text, ngrams):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return len(ws), [" ".join(ws[k:k + n]) for n in range(1, ngrams + 1) for k in range(len(ws) - n + 1)]


def brute_resample(raw, target, ngrams, buckets, seed, min_words, percent):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    docs = [(i, *features_of(t, ngrams)) for i, t in raw]
    s = collections.Counter(bucket(f) for _, _, fs in docs for f in fs)
    t = collections.Counter(bucket(f) for x in target for f in features_of(x, ngrams)[1])
    s_all, t_all = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * float(s_all + buckets) / ((s[b] + 1) * float(t_all + buckets))))

    rows = []
    for i, n_words, fs in docs:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n_words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((-score, i is None, i or 0) for i, n_words, _, _, score in rows if n_words >= min_words)
    ranks = collections.defaultdict(list)
    for place, key in enumerate(able[: percent * len(able) // 100]):
        ranks[key].append(place + 1)
    out = []
    for i, n_words, n, weight, score in rows:
        mine = ranks[(-score, i is None, i or 0)] if n_words >= min_words else []
        out.append((i, n, weight, score, mine.pop(0) if mine else None))
    return out


def same_rows(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op13_topk_search"])
def test_queries_match_sql(name, llm_spark, sf_dir):
    assert oracle.compare(llm_spark, oracle.connection(sf_dir), QUERIES[name], SQL[name], sf_dir)[0] == "ok"


@pytest.mark.parametrize("ngrams", [1, 3])
def test_resampling_of_odd_rows(ngrams, odd, llm_spark, nothing):
    aim = llm_spark.createDataFrame([(1, "One two word1 word2\nword3 a"), (2, None), (3, "w1 w2 w3 w4")], "item_id long, text string")
    got = resampling.resample(odd, aim, ngrams, 50, 7, 2, 60)
    raw = [(r["doc_id"], r["text"]) for r in odd.collect()]
    same_rows([tuple(r) for r in got.collect()], brute_resample(raw, [r["text"] for r in aim.collect()], ngrams, 50, 7, 2, 60))
    assert resampling.resample(nothing, aim).count() == 0
    assert resampling.resample(odd, aim.limit(0), ngrams).count() == odd.count()


def test_resampling_of_copies_and_a_hot_line(llm_spark):
    rows = [(k % 7, f"a frequent line\nword{k % 11} more") for k in range(600)] + [(8, "the same text twice over")] * 300
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    aim = llm_spark.createDataFrame([(1, "frequent word3 same")], "item_id long, text string")
    got = sorted(tuple(r) for r in resampling.resample(docs, aim, 2, 100, 3, 4, 50).select("doc_id", "n_features", "weight", "score").collect())
    want = brute_resample(rows, ["frequent word3 same"], 2, 100, 3, 4, 50)
    assert got == sorted(w[:4] for w in want)
    ranks = sorted(r[0] for r in resampling.resample(docs, aim, 2, 100, 3, 4, 50).filter("rank IS NOT NULL").select("rank").collect())
    assert ranks == list(range(1, sum(w[4] is not None for w in want) + 1))


def test_a_distinct_line_is_cut_once(llm_spark):
    docs = llm_spark.createDataFrame([(k, "same line\nsame line\n\n !? \nown " + str(k)) for k in range(50)], "doc_id long, text string")
    lines = resampling.distinct_lines(docs, 1, 1000)
    assert lines.count() == 51
    assert lines.agg(F.max("occurrences")).first()[0] == 100


# Conversations --------------------------------------------------------------------------------


def damaged(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        if way:
            convs[conv] += [(turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    return convs


def brute_repair(rows):
    """Cheapest edits from the front: for each role sequence class, the least (cost, edits) that reaches it."""
    def digest(role, text):
        return hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest()

    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[1], r[2])))
    seen, faults = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+", "", text)
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))

    def shortened(roles):
        """A prefix of the pattern, cut to two roles that stand for all like it; None if it is no prefix."""
        head, body = ("s", roles[1:]) if roles[:1] == "s" else ("", roles)
        if not re.fullmatch("(ua)*u?", body):
            return None
        return head + body if len(body) < 3 else head + body[len(body) - len(body) % 2 - 2:][:2] + body[len(body) - len(body) % 2:]

    def put(best, roles, way):
        if roles is not None and (roles not in best or way[:2] < best[roles][:2]):
            best[roles] = way

    def inserted(best):
        best = dict(best)
        for _ in range(4):
            for roles, (cost, edits, out) in list(best.items()):
                for name in ("user", "assistant"):
                    put(best, shortened(roles + name[0]), (cost + 5, edits + "I", (*out, (name, ""))))
        return best

    best = inserted({"": (0, "", ())})
    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for roles, (cost, edits, out) in best.items():
            put(after, roles, (cost + 2, edits + "D", out))
            if fault not in ("b", "d"):
                paid = cost + (5 if fault == "t" else 0)
                if role[:1]:
                    put(after, shortened(roles + role[:1]), (paid, edits + "K", (*out, (role, text))))
                for name in ("user", "assistant"):
                    put(after, shortened(roles + name[0]), (paid + 1, edits + "R", (*out, (name, text))))
        best = inserted(after)
    cost, edits, out = min((way for roles, way in best.items() if re.fullmatch("(s?(ua)+)?", roles)), key=lambda w: w[:2])
    return (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, edits,
            hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()), edits, out


def check_repair(df, query=None):
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    want = {conv: brute_repair(kept)[0] for conv, kept in damaged(rows).items()}
    got = [tuple(r) for r in (query or conversation_repair.repair_damaged(df)).collect()]
    assert len(got) == len(want)
    for conv, *told in got:
        assert tuple(told) == want[conv], conv


def odd_conversations(seed=5):
    rnd, rows = random.Random(seed), []
    for conv in [*range(250), None]:
        for _ in range(rnd.randint(1, 9)):
            rows.append((conv, rnd.choice([None, 0, 1, 2, 3, 4, 5, 6, 9]), rnd.choice(["user", "assistant", "system", None, "", "tool", "user", "assistant"]),
                         rnd.choice(["a.", "b", "c!", "", None, " \n", "d?  ", "e f g.", "a.", "x\x85", "."]), "clash", -1))
    return rows


ODD_TURNS = "conv_id long, turn long, role string, text string, digest string, fault int"


def test_repair_query_matches_brute_force(llm_spark, sf_dir):
    check_repair(read_table(llm_spark, sf_dir, "conversations"), QUERIES["op12_conversation_repair"](llm_spark, sf_dir))


def test_repair_of_odd_conversations(llm_spark):
    check_repair(llm_spark.createDataFrame(odd_conversations(), ODD_TURNS).repartition(5))
    assert conversation_repair.repair_damaged(llm_spark.createDataFrame([], ODD_TURNS)).count() == 0
    # The first turns of these ids are dropped by the damage, so no row is left.
    lost = [k for k in range(400) if zlib.crc32(f"{k}:0".encode()) % 20 == 0]
    got = conversation_repair.repair_damaged(llm_spark.createDataFrame([(k, 0, "user", "x.", "", 0) for k in lost], ODD_TURNS)).collect()
    assert {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())} and len(got) == len(lost)


def test_a_giant_conversation_is_carried_over_batches(llm_spark):
    rnd = random.Random(7)
    rows = [(1, k % 2000, rnd.choice(["user", "assistant", "system"]), rnd.choice(["a.", "b", f"q{k}.", f"r{k}"]), "", 0) for k in range(3000)]
    df = llm_spark.createDataFrame(rows + [(2, 0, "user", "hi.", "", 0), (2, 1, "assistant", "ho.", "", 0)], ODD_TURNS).repartition(4)
    held = llm_spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    llm_spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        check_repair(df)
    finally:
        llm_spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def test_spilled_pointers_come_back_in_order(monkeypatch):
    monkeypatch.setattr(conversation_repair, "SPILL_BYTES", 300)
    spill = conversation_repair._Spill()
    records = [(k % 256, f"r{k}", "x" * (k % 40)) for k in range(200)]
    for r in records:
        spill.push(*r)
    assert len(spill.chunks) > 5
    assert list(spill) == records[::-1]


def test_repaired_turns(llm_spark):
    rows = odd_conversations(9)
    df = llm_spark.createDataFrame([(c, t, r, x, "", 0) for c, t, r, x, _, _ in rows], ODD_TURNS).repartition(3)
    by_conv = collections.defaultdict(list)
    for conv, turn, role, text, _, _ in rows:
        by_conv[conv].append((turn, " " if role is None else role, " " if text is None else text))
    want = [(conv, k, role, text) for conv, kept in by_conv.items() for k, (role, text) in enumerate(brute_repair(kept)[2])]
    got = conversation_repair.repair(df).collect()
    same_rows([(r["conv_id"], r["position"], r["role"], r["text"]) for r in got], want)
    assert {r["edit"] for r in got} <= set("KRI")


# Search -----------------------------------------------------------------------------------------


def brute_search(rows, k, scale, is_query):
    def whole(v):
        return [min(max(math.floor(scale * x), -(2**63)), 2**63 - 1) for x in v]

    usable = [(i, whole(v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if q is not None and is_query(q):
            scored = [(-min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1), i is None, i or 0) for i, b in usable if i != q]
            out += [(q, n + 1, None if null else i, -s) for n, (s, null, i) in enumerate(sorted(scored)[:k])]
    return out


def check_search(spark, rows, k=3, lists=2, divisor=5):
    df = spark.createDataFrame([Row(vec_id=i, embedding=v, query="x", score=0) for i, v in rows],
                               "vec_id long, embedding array<double>, query string, score int").repartition(4)
    got = [tuple(r) for r in topk_search.search(df, F.col("vec_id") % divisor == 0, k, lists).collect()]
    same_rows(got, brute_search(rows, k, 256, lambda q: q % divisor == 0))


@pytest.mark.parametrize("lists", [1, 2, 3, 7])
def test_search_of_random_vectors(lists, llm_spark):
    rnd = np.random.default_rng(lists)
    check_search(llm_spark, [(i, (rnd.normal(size=6) / 2).tolist()) for i in range(200)], lists=lists)


def test_search_of_odd_vectors(llm_spark):
    copy = [0.5, -0.25, 0.125]
    rows = [(0, copy), (0, [0.1, 0.2, 0.3]), (5, copy), (5, copy), (None, copy), (1, None), (2, [0.1, None, 0.2]), (3, [float("nan"), 0.0, 1.0]),
            (10, [float("inf"), 0.0, 1.0]), (4, []), (15, []), (6, [1.0]), (7, [1e30, -1e30, 1.0]), (20, [1e18, 1.0, 0.0]), (8, [3e7, 2e8, 1e7]), (25, [-3e7, -2e8, 5.0]),
            (9, [0.0, 0.0, 0.0, 4.0])] + [(k, copy) for k in range(30, 60)]
    check_search(llm_spark, rows)
    check_search(llm_spark, rows, k=100)
    empty = llm_spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_search.search(empty, F.col("vec_id") % 5 == 0).count() == 0
    assert topk_search.search(llm_spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>"), F.col("vec_id") % 5 == 0).count() == 0


def test_search_in_several_slices(llm_spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SLICE_BYTES", 400)
    monkeypatch.setattr(topk_search, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 16)
    rnd = np.random.default_rng(3)
    check_search(llm_spark, [(i, (rnd.integers(-3, 4, size=5) / 4).tolist()) for i in range(120)])


def test_the_threshold_resolves_few_vectors():
    """Phases two and three look at a small part of the vectors and keep every one that counts."""
    rnd = np.random.default_rng(1)
    block = rnd.normal(size=(4000, 64))
    block = np.floor(256 * block / np.linalg.norm(block, axis=1, keepdims=True)).astype(np.int64)
    queries, slices = block[:20], [slice(0, 32), slice(32, 64)]
    entries = topk_search._products(block, queries, slices, np.float32)
    mine = np.arange(20)[:, None] == np.arange(4000)[None, :]
    rows, cols = topk_search._listed(entries, mine, 5)
    found = topk_search._resolved(entries, rows, cols)
    cuts = np.array([np.sort(found[rows == q])[-5] for q in range(20)])
    reach = np.logical_or.reduce([2 * e >= cuts[:, None] for e in entries]) & ~mine
    scores = np.where(mine, -(2**60), queries @ block.T)
    for q in range(20):
        best = np.sort(scores[q])[-5:]
        assert (np.sort(scores[q][reach[q]])[-5:] == best).all() and cuts[q] <= best[0]
    assert reach.mean() < 0.2
