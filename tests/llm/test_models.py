"""The quality ranker and language models: held-out accuracy, brute-force arithmetic and odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltlattice.llm import language_id, quality_rank
from voltlattice.llm.catalog import QUERIES
from voltlattice.llm.common import materialize, read_table


def test_quality_on_held_out_documents(llm_spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op10_quality_rank"](llm_spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(read_table(llm_spark, sf, "labels"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_pairwise_loss_is_least():
    """No small step from the fitted weights lowers the penalised pair loss."""
    rng = np.random.default_rng(5)
    good, bad = rng.random((40, 18)), rng.random((25, 18)) + 0.15
    model = quality_rank.train(good, bad, 0.3)
    g, b = (np.clip((quality_rank._expanded(v) - model.center) / model.scale, -8, 8) for v in (good, bad))
    k = np.arange(max(len(g), len(b)) * quality_rank.OPPONENTS)
    order = np.random.default_rng(7)
    d = g[order.permutation(k) % len(g)] - b[order.permutation(k) % len(b)]
    loss = lambda w: np.logaddexp(0, -d @ w).mean() + quality_rank.RIDGE / 2 * w @ w
    assert all(loss(model.weights) <= loss(model.weights + 1e-3 * rng.standard_normal(len(model.weights))) for _ in range(50))


def test_threshold_is_the_quantile_of_bad_documents():
    rng = np.random.default_rng(1)
    good, bad = rng.random((300, 18)) + 0.5, rng.random((100, 18))
    model = quality_rank.train(good, bad, 0.25)
    both = np.concatenate([model.strengths(good), model.strengths(bad)])
    assert abs((both < model.threshold).mean() - 0.25) < 0.01


def test_threshold_covers_all_labelled_documents(llm_spark, monkeypatch):
    """With a sample far smaller than the labels, as many labelled documents are rejected as are labelled bad."""
    monkeypatch.setattr(quality_rank, "SAMPLE", 60)
    sf = "/root/testdata/sf0.01"
    docs, labels = read_table(llm_spark, sf, "documents"), read_table(llm_spark, sf, "labels").filter("quality IN (0, 1)")
    # Labels that the text doesn't tell, so that a sample's quantile isn't all rows' one.
    labels = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 < 4, 1 - F.col("quality")).otherwise(F.col("quality")))
    model = quality_rank.fit(docs, labels)
    rows = docs.select("doc_id", quality_rank.score_column(model).alias("s")).join(labels, "doc_id").collect()
    assert len(rows) > 4 * quality_rank.SAMPLE
    assert abs(sum(r["s"] < quality_rank.ACCEPT for r in rows) - sum(r["quality"] == 0 for r in rows)) <= 1


def test_a_repeated_id_counts_once_in_a_fit(llm_spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = materialize(read_table(llm_spark, sf, "documents").limit(60), "test-documents"), read_table(llm_spark, sf, "labels")
    one = materialize(docs.join(labels.filter("quality = 0"), "doc_id", "left_semi").orderBy("doc_id").limit(1), "test-document")
    copies = docs.union(one.crossJoin(llm_spark.range(300).select()))
    plain, repeated = quality_rank.fit(docs, labels), quality_rank.fit(copies, labels)
    assert copies.count() == 360
    assert np.allclose(plain.weights, repeated.weights) and plain.threshold == pytest.approx(repeated.threshold)


def test_quality_of_odd_rows(llm_spark, odd, nothing):
    labels = llm_spark.createDataFrame([(3, 0), (3, 1), (7, 1), (8, 1), (None, 1), (12, None), (15, 0), (99, 1)], "doc_id long, quality int")
    model = quality_rank.fit(odd, labels)
    rows = odd.select("doc_id", "text", quality_rank.score_column(model).alias("s")).collect()
    assert len(rows) == odd.count() and all(0 <= r["s"] <= 1 for r in rows)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r["text"] or "", r["s"]) == r["s"]
    assert by_text["one"] < 0.7 <= by_text[next(t for t in by_text if t.startswith("A head."))]
    assert nothing.select(quality_rank.score_column(model)).count() == 0
    for some in (labels.filter("quality = 1"), labels.limit(0)):
        unfit = quality_rank.fit(odd, some)
        assert all(r["s"] >= 0.7 - 1e-12 for r in odd.select(quality_rank.score_column(unfit).alias("s")).collect())


def test_languages_on_held_out_documents(llm_spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op8_language_id"](llm_spark, sf)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(read_table(llm_spark, sf, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]) > 0.99
    assert all(0 <= r["score"] <= 1 for r in rows)


def plain_kneser_ney(words):
    """Interpolated Kneser-Ney over the words' letters, from dictionaries."""
    counts = {}
    for w in words:
        s = [0, 0, *(ord(c) - 96 for c in w), 0]
        for a, b, c in zip(s[1:], s[2:], s[3:]):
            counts[(a if b else 0, b, c)] = counts.get((a if b else 0, b, c), 0) + 1
        counts[(0, 0, s[2])] = counts.get((0, 0, s[2]), 0) + 1
    d3 = language_id._discount(np.array(list(counts.values())))
    pairs = {}
    for _, b, c in counts:
        pairs[(b, c)] = pairs.get((b, c), 0) + 1
    d2 = language_id._discount(np.array(list(pairs.values())))
    ends = {}
    for _, c in pairs:
        ends[c] = ends.get(c, 0) + 1

    def p1(c):
        return max(ends.get(c, 0) - 0.5, 0) / len(pairs) + 0.5 * len(ends) / len(pairs) / 64

    def p2(b, c):
        total = sum(n for (x, _), n in pairs.items() if x == b)
        if not total:
            return p1(c)
        kinds = sum(1 for x, _ in pairs if x == b)
        return max(pairs.get((b, c), 0) - d2, 0) / total + d2 * kinds / total * p1(c)

    def p3(a, b, c):
        total = sum(n for (x, y, _), n in counts.items() if (x, y) == (a, b))
        if not total:
            return p2(b, c)
        kinds = sum(1 for x, y, _ in counts if (x, y) == (a, b))
        return max(counts.get((a, b, c), 0) - d3, 0) / total + d3 * kinds / total * p2(b, c)

    return p3


def test_models_match_plain_kneser_ney():
    words = "the then than hat hut to tot ten net nest sent these those".split()
    codes, _ = language_id.trigrams([" ".join(words)])
    counts = np.bincount(codes, minlength=language_id.CODES)
    model = language_id.CharModel.train(np.flatnonzero(counts), counts[counts > 0])
    plain = plain_kneser_ney(words)
    for key in [(0, 0, 20), (20, 8, 5), (8, 5, 0), (20, 8, 26), (26, 26, 26), (0, 20, 8), (5, 14, 20)]:
        code = np.array([(key[0] * 64 + key[1]) * 64 + key[2]])
        assert model.probability(code)[0] == pytest.approx(plain(*key), rel=1e-9)
    for context in [(0, 0), (20, 8), (26, 26)]:
        assert model.probability((context[0] * 64 + context[1]) * 64 + np.arange(64)).sum() == pytest.approx(1, abs=1e-9)


def test_trigrams_ignore_neighbours_in_a_batch():
    texts = ["Abc de", None, "", "x", "?!", "éß-42 zz", "a"]
    codes, at = language_id.trigrams(texts)
    for k, t in enumerate(texts):
        alone, where = language_id.trigrams([t])
        assert codes[at[k]:at[k + 1]].tolist() == alone[where[0]:where[1]].tolist()


def test_languages_of_odd_rows(llm_spark, odd, nothing):
    model = language_id.train(odd)
    assert model.names == ["de", "en"]
    rows = odd.select("doc_id", "text", language_id.predict_column(llm_spark, model, F.col("text")).alias("p")).collect()
    for r in rows:
        has_letter = any(c.isalpha() for c in r["text"] or "")
        assert (r["p"]["lang"] == "und") == (not has_letter) and 0 <= r["p"]["score"] <= 1
        assert has_letter or not r["p"]["accepted"] and r["p"]["score"] == 0
    unknown = language_id.train(nothing)
    assert unknown.names == []
    assert {r["p"]["lang"] for r in odd.select(language_id.predict_column(llm_spark, unknown, F.col("text")).alias("p")).collect()} == {"und"}
    assert nothing.select(language_id.predict_column(llm_spark, model, F.col("text"))).count() == 0
