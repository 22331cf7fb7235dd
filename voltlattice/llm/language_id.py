"""Language identification by interpolated Kneser-Ney character models, one per language.

A text is lower-cased; every run of other characters than letters is one word boundary. Letters
are folded to 63 symbols (a to z for themselves, all others by a hash), so a model of order three
has at most 2**18 entries: the size of what is collected and broadcast is bounded for each
language, whatever the corpus. Contexts don't reach over a word boundary.

Counts come from all training texts, summed per task before they are shuffled. Models are sorted
arrays of hashed n-grams, searched for the distinct n-grams of a batch. The language with the
lowest cross-entropy per symbol wins; ties go to the first name. Per language, a rejection limit is
calibrated on all training texts: their 99.9 % quantile of the cross-entropy, plus half its
distance from the median.

Cases: texts that are null, empty or without a letter are ``und`` with score 0 and are rejected.
Rows with a null language or text train nothing. Without training rows everything is ``und``.
Repeated rows are predicted alike, an empty table gives an empty result. Only the text decides.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from voltlattice.llm.common import crc_fold

SYMBOLS = 64
CODES = SYMBOLS**3
UNKNOWN = "und"
#: Languages a counting task holds before it emits their counts.
HELD_LANGUAGES = 64
#: Symbols of evidence that a score may count on.
EVIDENCE = 30


@functools.cache
def _symbol_table() -> np.ndarray:
    letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    points = np.arange(0x110000, dtype=np.uint64)
    table = np.where(letters, 27 + ((points * np.uint64(2654435761)) >> np.uint64(16)) % np.uint64(37), 0).astype(np.uint8)
    table[97:123] = np.arange(1, 27)
    return table


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all texts one after the other, and where each text's begin (one more than texts)."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer(" ".join(["", *lowered, ""]).encode("utf-32-le", "replace"), np.uint32)
    symbols = _symbol_table()[np.minimum(points, 0x10FFFF)]
    starts = np.cumsum([0, *(len(t) + 1 for t in lowered)])
    kept = np.empty(len(symbols), bool)
    kept[0] = True
    np.logical_or(symbols[1:] != 0, symbols[:-1] != 0, out=kept[1:])
    at = np.cumsum(kept)[starts] - 1
    s = symbols[kept].astype(np.int32)
    before = np.zeros(len(s), np.int32)
    before[2:] = np.where(s[1:-1] != 0, s[:-2], 0)
    codes = (before[1:] * SYMBOLS + s[:-1]) * SYMBOLS + s[1:]
    return codes, at


def _hash(keys: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit keys."""
    return ((keys.astype(np.uint64) * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


@dataclass
class HashArray:
    """Values by hashed key, sorted by the hash."""

    hashes: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> HashArray:
        h = _hash(keys)
        by = np.argsort(h)
        return cls(h[by], values[by])

    def get(self, keys: np.ndarray, default: float) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(keys), default)
        h = _hash(keys)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.values[at], default)


def _discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5


@dataclass
class CharModel:
    """Interpolated Kneser-Ney of order three from trigram counts."""

    full: HashArray
    full_rest: HashArray
    pair: HashArray
    pair_rest: HashArray
    single: np.ndarray

    @classmethod
    def train(cls, codes: np.ndarray, counts: np.ndarray) -> CharModel:
        def grouped(keys, weights):
            unique, inverse = np.unique(keys, return_inverse=True)
            return unique, np.bincount(inverse, weights, len(unique)), np.bincount(inverse, minlength=len(unique))

        counts = counts.astype(float)
        contexts, totals, kinds = grouped(codes // SYMBOLS, counts)
        d = _discount(counts)
        full = np.maximum(counts - d, 0) / totals[np.searchsorted(contexts, codes // SYMBOLS)]
        pairs, continued, _ = grouped(codes % SYMBOLS**2, np.ones(len(codes)))
        heads, head_totals, head_kinds = grouped(pairs // SYMBOLS, continued)
        d2 = _discount(continued)
        pair = np.maximum(continued - d2, 0) / head_totals[np.searchsorted(heads, pairs // SYMBOLS)]
        single = np.bincount(pairs % SYMBOLS, minlength=SYMBOLS).astype(float)
        d1 = 0.5
        seen = max(single.sum(), 1)
        single = np.maximum(single - d1, 0) / seen + d1 * max((single > 0).sum(), 1) / seen / SYMBOLS
        return cls(HashArray.of(codes, full), HashArray.of(contexts, d * kinds / totals),
                   HashArray.of(pairs, pair), HashArray.of(heads, d2 * head_kinds / head_totals), single)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        pairs = codes % SYMBOLS**2
        low = self.pair.get(pairs, 0.0) + self.pair_rest.get(pairs // SYMBOLS, 1.0) * self.single[codes % SYMBOLS]
        return self.full.get(codes, 0.0) + self.full_rest.get(codes // SYMBOLS, 1.0) * low


@dataclass
class LanguageModel:
    names: list[str]
    models: list[CharModel]
    middles: np.ndarray = field(default_factory=lambda: np.zeros(0))
    limits: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol by text and language, and the number of symbols (0: no letter)."""
        codes, at = trigrams(texts)
        lengths = np.diff(at)
        used = np.flatnonzero(np.bincount(codes, minlength=CODES)) if len(codes) else np.zeros(0, np.int64)
        place = np.zeros(CODES, np.int32)
        place[used] = np.arange(len(used))
        spots = place[codes]
        out = np.zeros((len(texts), len(self.names)))
        for k, model in enumerate(self.models):
            running = np.concatenate([[0.0], np.cumsum(-np.log(model.probability(used))[spots])])
            out[:, k] = (running[at[1:]] - running[at[:-1]]) / np.maximum(lengths, 1)
        return out, lengths

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        h, n = self.entropies(texts)
        if not self.names or not len(texts):
            return pd.DataFrame({"lang": [UNKNOWN] * len(texts), "score": 0.0, "accepted": False, "entropy": 0.0})
        best = h.argmin(1)
        low = h[np.arange(len(h)), best]
        known = n > 0
        share = 1 / np.exp(-(h - low[:, None]) * np.minimum(n, EVIDENCE)[:, None]).sum(1)
        accepted, fits = known.copy(), np.ones(len(h))
        if len(self.limits):
            room = (self.limits[best] - low) / np.maximum(self.limits[best] - self.middles[best], 1e-6)
            fits = 1 / (1 + np.exp(-np.clip(8 * room, -50, 50)))
            accepted &= room >= 0
        names = np.array(self.names, object)
        return pd.DataFrame({"lang": np.where(known, names[best], UNKNOWN), "score": np.where(known, share * fits, 0.0),
                             "accepted": accepted, "entropy": low})


def count_trigrams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, code, n) over all rows with a text and a language."""
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}

        def emitted():
            for lang, counts in held.items():
                codes = np.flatnonzero(counts)
                yield pd.DataFrame({"lang": lang, "code": codes.astype(np.int32), "n": counts[codes]})
            held.clear()

        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                if lang not in held and len(held) >= HELD_LANGUAGES:
                    yield from emitted()
                codes, _ = trigrams(texts.tolist())
                held.setdefault(lang, np.zeros(CODES, np.int64))
                held[lang] += np.bincount(codes, minlength=CODES)
        yield from emitted()

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    return (rows.mapInPandas(counted, "lang string, code int, n long")
            .groupBy("lang", "code").agg(F.sum("n").alias("n")))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Models and rejection limits from all rows of ``docs`` with a text and a language."""
    counts = count_trigrams(docs, text_col, lang_col).toPandas().sort_values(["lang", "code"])
    names = sorted(counts["lang"].unique())
    by_name = dict(tuple(counts.groupby("lang")))
    model = LanguageModel(names, [CharModel.train(by_name[n]["code"].to_numpy(np.int64), by_name[n]["n"].to_numpy()) for n in names])
    if not names:
        return model
    column = predict_column(docs.sparkSession, model, F.col(text_col))
    fits = (docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
            .select(F.col(lang_col).alias("lang"), column.alias("p")).groupBy("lang")
            # Not a filter: pushed below the prediction, it would predict a second time.
            .agg(F.percentile_approx(F.when(F.col("p.lang") == F.col("lang"), F.col("p.entropy")), [0.5, 0.999], 10000).alias("q")).collect())
    quantiles = {r["lang"]: r["q"] for r in fits if r["q"]}
    middle, high = (np.array([quantiles.get(n, [np.log(SYMBOLS)] * 2)[k] for n in names]) for k in (0, 1))
    model.middles, model.limits = middle, high + np.maximum((high - middle) / 2, 0.05)
    return model


def predict_column(spark, model: LanguageModel, text: Column) -> Column:
    """struct(lang, score, accepted, entropy) of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, accepted boolean, entropy double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return shared.value.predict(texts.tolist())

    return predicted(text)


def outside_fold(id_col: str = "doc_id") -> Column:
    """Rows a model may learn from; the others are held out."""
    return crc_fold(id_col, 3) != 1
