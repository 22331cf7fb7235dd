"""The pipeline: each stage on its own input against brute force, and on odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_dedup import brute_components, brute_lines
from test_outputs import check_packing
from voltlattice.llm import language_id, quality_rank
from voltlattice.llm.common import materialize, read_table

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def staged(llm_spark, sf_dir):
    """The rows before and after each stage."""
    docs = read_table(llm_spark, sf_dir, "documents")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(materialize(stage(llm_spark, seen[-1], sf_dir), "test-stage"))
    return seen


def pairs(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_are_those_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "lines", "near_duplicates", "pack"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_quality_and_language_stages(llm_spark, sf_dir, staged):
    raw, good, known = staged[:3]
    assert good.columns == known.columns == DOCUMENT
    model = quality_rank.fit(raw, read_table(llm_spark, sf_dir, "labels"))
    assert pairs(good) == [(i, t) for i, t in pairs(raw) if model.scores([t])[0] >= 0.7]
    labels = {r["doc_id"]: r["quality"] for r in read_table(llm_spark, sf_dir, "labels").collect()}
    kept = {i for i, _ in pairs(good)}
    assert np.mean([(i in kept) == (q == 1) for i, q in labels.items()]) > 0.97
    languages = language_id.train(good)
    assert pairs(known) == [(i, t) for i, t in pairs(good) if languages.predict([t])["accepted"][0]]
    assert known.count() > 0.98 * good.count()


def test_line_and_near_duplicate_stages(staged):
    known, cut, single = staged[2:5]
    assert cut.columns == single.columns == DOCUMENT
    before = pairs(known)
    assert pairs(cut) == list(zip([i for i, _ in before], brute_lines(before)))
    kept = {i for i, _, _, stays in brute_components(pairs(cut), 80) if stays}
    assert pairs(single) == [(i, t) for i, t in pairs(cut) if i in kept]


def test_pack_stage_and_run(llm_spark, sf_dir, staged):
    rows = staged[5].collect()
    check_packing(rows, pairs(staged[4]), 0, 2048)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    told = sorted(tuple(r) for r in corpus_pipeline.run(llm_spark, sf_dir).select(columns).collect())
    assert told == sorted(tuple(r[c] for c in columns) for r in rows)


def test_stages_on_odd_rows(llm_spark, sf_dir, odd, nothing):
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        some, none = stage(llm_spark, odd, sf_dir), stage(llm_spark, nothing, sf_dir)
        assert none.count() == 0
        if k < 4:
            assert some.columns == odd.columns and none.columns == odd.columns
            assert some.filter(F.col("id") != "clash").count() == 0 and some.count() <= odd.count()
        else:
            check_packing(some.collect(), [(r["doc_id"], r["text"]) for r in odd.collect()], 0, 2048)
    kept = corpus_pipeline.near_duplicates(llm_spark, odd, sf_dir)
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None and r["doc_id"] < 12) == sorted(
        i for i, _, _, stays in brute_components([(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] is not None and r["doc_id"] < 12], 80) if stays)
