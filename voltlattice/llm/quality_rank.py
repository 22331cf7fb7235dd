"""Quality classifier by Bradley-Terry pairwise ranking, thresholded at a quantile of the scores.

A document's strength is ``w . x(text)``; of a good and a bad document, the good one wins with
probability ``sigmoid(strength difference)``. ``w`` minimises the logistic loss of feature
differences of such pairs. The threshold is the quantile of the strengths at the share of bad
documents among all labelled ones, and scores are shifted so that it lies at ``ACCEPT``.

The weights are fitted on a bounded sample: at most ``SAMPLE`` rows of each label, by the hash of their
id. The threshold isn't the sample's: the shares of the labels are counted over all labelled rows, and the
quantile is taken over the strengths of all labelled documents, one for each id (the least of repeated ones).

Cases: a null text is empty and is scored like any other. Null labels are left out; a document
with contradicting labels counts as bad. Without labels of both kinds every score is ``ACCEPT``
(nothing is rejected). Repeated rows are scored alike; a fit counts an id once, by the least of its rows'
features. An empty table gives an empty result.
Only the text decides; other columns are kept and never read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from voltlattice.llm.common import crc_fold, materialize, text_of

#: Labelled rows of each class that a fit reads at most.
SAMPLE = 4000
#: Opponents of each sampled row in the pairs.
OPPONENTS = 8
#: Up to half as many labelled documents, their quantile is exact; from there its rank is off by at most 1 in ACCURACY.
ACCURACY = 100_000
#: Scores from here on are predicted as good.
ACCEPT = 0.7
RIDGE = 1e-3
STEPS = 30

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[b for b in b"#$%&*+<=>@^~{}[]\\_/"]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in b"!\"'(),-.:;?"]] = True


def features(text: str | None) -> np.ndarray:
    """Shape of a text: shares of character kinds, repetition, and lengths of words and lines."""
    raw = (text or "").encode()
    n = max(len(raw), 1)
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, high = kinds[65:91].sum(), kinds[97:123].sum(), kinds[128:].sum()
    words = raw.split()
    m = max(len(words), 1)
    lines = raw.split(b"\n")
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    return np.array([
        upper / max(upper + lower + high, 1),
        kinds[_SYMBOLS].sum() / n, kinds[_PUNCTUATION].sum() / n, kinds[33] / n, kinds[124] / n,
        kinds[48:58].sum() / n, (upper + lower + high) / n, kinds[:32].sum() / n,
        len(zlib.compress(raw, 1)) / (n + 40), repeats / m, len(set(words)) / m,
        1 - len(set(lines)) / max(len(lines), 1),
        np.log1p(n) / 10, min(n / m, 60) / 10, np.log1p(n / len(lines)) / 10, kinds[46] / m,
        min(sum(w.isupper() for w in words) / m, 1), float(m < 5),
    ])


def _expanded(x: np.ndarray) -> np.ndarray:
    """Shares near zero differ by orders of magnitude, so their roots are features too."""
    return np.hstack([x, np.sqrt(np.abs(x))])


@dataclass
class RankModel:
    weights: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    threshold: float

    def strengths(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((_expanded(x) - self.center) / self.scale, -8, 8)
        return z @ self.weights

    def scores(self, texts) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        gap = self.strengths(np.array([features(t) for t in texts])) - self.threshold
        return 1 / (1 + np.exp(-np.clip(gap + np.log(ACCEPT / (1 - ACCEPT)), -500, 500)))


def train(good: np.ndarray, bad: np.ndarray, bad_share: float) -> RankModel:
    """Newton steps on the pairs' logistic loss."""
    both = _expanded(np.vstack([good, bad])) if len(good) or len(bad) else np.zeros((1, 36))
    center, scale = both.mean(0), np.maximum(both.std(0), 1e-3)
    if not len(good) or not len(bad):
        return RankModel(np.zeros_like(center), center, scale, 0.0)
    g, b = (np.clip((_expanded(v) - center) / scale, -8, 8) for v in (good, bad))
    pairs = max(len(g), len(b)) * OPPONENTS
    k = np.arange(pairs)
    order = np.random.default_rng(7)
    d = g[order.permutation(k) % len(g)] - b[order.permutation(k) % len(b)]
    w = np.zeros(d.shape[1])
    for _ in range(STEPS):
        lose = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        gradient = d.T @ lose / pairs - RIDGE * w
        curvature = (d * (lose * (1 - lose))[:, None]).T @ d / pairs + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    strengths = np.concatenate([g @ w, b @ w])
    weights = np.concatenate([np.full(len(g), (1 - bad_share) / len(g)), np.full(len(b), bad_share / len(b))])
    by = np.argsort(strengths, kind="stable")
    ordered, below = strengths[by], np.cumsum(weights[by])
    at = int(np.searchsorted(below, bad_share - 1e-9))
    upper = ordered[min(at + 1, len(ordered) - 1)]
    return RankModel(w, center, scale, float((ordered[min(at, len(ordered) - 1)] + upper) / 2))


def fit(docs: DataFrame, labels: DataFrame, keep: Column | None = None, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "quality") -> RankModel:
    """Learn from ``labels`` rows that ``keep`` (a condition on ``id_col``) admits."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    known = known.filter(keep) if keep is not None else known
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for label in (0, 1):
        part = known.filter(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
        picked = part if picked is None else picked.unionByName(part)
    shape = F.pandas_udf(lambda t: pd.Series([features(x) for x in t]), T.ArrayType(T.DoubleType()))
    # At most 2 * SAMPLE ids, so the broadcast is bounded; one row for each, so what is collected is too.
    rows = (docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t")).join(F.broadcast(picked), "id")
            .select("id", "label", shape("t").alias("x")).groupBy("id", "label").agg(F.min("x").alias("x")).collect())
    rows.sort(key=lambda r: (r["id"], r["x"]))
    x = {label: np.array([r["x"] for r in rows if r["label"] == label]).reshape(-1, 18) for label in (0, 1)}
    total = sum(shares.values())
    bad_share = shares.get(0, 0) / total if total else 0.0
    model = train(x[1], x[0], bad_share)
    if len(x[0]) and len(x[1]):
        model.threshold = threshold(model, docs, known, bad_share, id_col, text_col)
    return model


def threshold(model: RankModel, docs: DataFrame, known: DataFrame, bad_share: float, id_col: str, text_col: str) -> float:
    """Midway between the quantile of all labelled documents' strengths and the next strength above it."""
    strength = F.pandas_udf(lambda t: pd.Series(model.strengths(np.array([features(x) for x in t]))), T.DoubleType())
    # Strengths are computed before the join, so no text is shuffled.
    made = docs.select(F.col(id_col).alias("id"), strength(text_of(text_col)).alias("s")).groupBy("id").agg(F.min("s").alias("s"))
    made = materialize(made.join(known, "id", "left_semi").select("s"), "strengths")
    at = made.agg(F.percentile_approx("s", bad_share, ACCURACY)).first()[0]
    upper = made.filter(F.col("s") > at).agg(F.min("s")).first()[0]
    return at if upper is None else (at + upper) / 2


def score_column(model: RankModel, text_col: str | Column = "text") -> Column:
    @F.pandas_udf(T.DoubleType())
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(model.scores(text.tolist()))

    return scored(text_of(text_col))


def outside_fold(id_col: str = "doc_id") -> Column:
    """Rows a fit may learn from; the others are held out."""
    return crc_fold(id_col, 4) != 2
