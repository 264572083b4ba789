"""Quality classifier: heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer.

No ground-truth label is used: the labellers vote on every document, the vote patterns of the whole corpus give each
labeller's accuracy, and the posterior labels of a bounded sample train the scorer.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .common import bounded_batches

GOOD, BAD, NONE = 2, 0, 1
LABELLERS = ("symbols", "capitals", "repetition", "bars", "function_words", "sentences")
# Frequent function words of the languages at hand.
FUNCTION_WORDS = frozenset(
    b"the of and to in is that for it with as on by this be are at from or an "
    b"der die das und ist nicht ein eine zu mit von auf den im "
    b"el la los las de que y en un una es por con para se del "
    b"le les des et est dans pour sur qui que une du avec par".split()
)
#: Documents that train the scorer, at most; slots of the feature hash; steps and rate of the descent.
SAMPLE, SLOTS, STEPS, RATE = 4096, 4096, 300, 0.5
#: Slots that the document statistics take, at the end of the hash.
STATISTIC_SLOTS = 64
SEED = 11


def statistics(raw: bytes) -> np.ndarray:
    """Shares of a text: symbols, capitals, repeated neighbours, distinct words, bars, function words, sentence ends; and
    its words. A text without words has zeros."""
    words = raw.split()
    n = len(words)
    if not n:
        return np.zeros(8)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    symbols = counts[[33, 35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 91, 92, 93, 94, 95, 123, 125, 126]].sum()
    same = sum(map(bytes.__eq__, words, words[1:]))
    plain = [w.lower().strip(b".,;:!?") for w in words]
    function = sum(map(FUNCTION_WORDS.__contains__, plain))
    return np.array([symbols / n, upper / max(1, upper + lower), same / n, len(set(plain)) / n, counts[124] / n, function / n, (counts[46] + counts[63]) / n, n])


def votes(s: np.ndarray) -> list[int]:
    """What each labeller says of statistics: GOOD, BAD or NONE."""
    symbols, capitals, same, distinct, bars, function, ends, n = s
    say = lambda bad, good: BAD if bad else GOOD if good else NONE
    if not n:
        return [NONE] * len(LABELLERS)
    return [
        say(symbols > 0.5, symbols < 0.1),
        say(capitals > 0.5, capitals < 0.2),
        say(same > 0.2 or (n >= 50 and distinct < 0.15), same < 0.05 and (n < 50 or distinct > 0.25)),
        say(bars > 0.3, bars < 0.02),
        say(n >= 20 and function < 0.05, function > 0.15),
        say(n >= 30 and ends < 0.005, 0.01 < ends < 0.5),
    ]


def slots(raw: bytes, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashed features of a text: slots and values. Character trigrams, by share and in one pass over the bytes with
    letters, digits and other bytes beyond ASCII each as one class next to exact case and punctuation; and statistics in
    steps."""
    data = _CLASS[np.frombuffer(raw, np.uint8)].astype(np.uint32)
    grams = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) if len(data) > 2 else data[:0]
    hashed = ((grams * np.uint32(2654435761)) >> np.uint32(8)) % np.uint32(SLOTS - STATISTIC_SLOTS)
    counts = np.bincount(hashed, minlength=SLOTS).astype(np.float32)
    if len(grams):
        counts /= len(grams)
    edges = ((0.1, 0.5, 1.0), (0.1, 0.2, 0.5), (0.02, 0.05, 0.2), (0.15, 0.25, 0.5), (0.02, 0.1, 0.3), (0.05, 0.1, 0.15), (0.005, 0.02, 0.1))
    for k, (value, steps) in enumerate(zip(s, edges)):
        step = int(np.searchsorted(steps, value))
        counts[SLOTS - STATISTIC_SLOTS + zlib.crc32(bytes([k, step])) % STATISTIC_SLOTS] += 0.2
    used = np.flatnonzero(counts)
    return used, counts[used]


_CLASS = np.arange(256)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 97, 65, 48, 97
_CLASS = _CLASS.astype(np.uint8)


@dataclass(frozen=True)
class LabelModel:
    """prior: the share of good documents; tables[k][c][v]: how often labeller k says v of class c (0 bad, 1 good)."""

    prior: float
    tables: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Of rows of votes, the probability of being good."""
        k = np.arange(patterns.shape[1])
        good = np.log(self.prior) + np.log(self.tables[k, 1, patterns]).sum(1)
        bad = np.log(1 - self.prior) + np.log(self.tables[k, 0, patterns]).sum(1)
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts, from the start that a document is bad if any labeller
    says so. Each step weighs every labeller by the accuracy that the others' agreement gives it."""
    good = np.where((patterns == BAD).any(1), 0.1, 0.95)
    model = LabelModel(0.5, np.full((patterns.shape[1], 2, 3), 1 / 3))
    for _ in range(rounds):
        weights = np.stack([counts * (1 - good), counts * good])
        tables = np.stack([np.stack([np.bincount(patterns[:, k], w, 3) + 1 for w in weights]) for k in range(patterns.shape[1])])
        total = weights.sum(1)
        model = LabelModel(float((total[1] + 1) / (total.sum() + 2)), tables / tables.sum(2, keepdims=True))
        new = model.posterior(patterns)
        if np.abs(new - good).max() < 1e-6:
            break
        good = new
    return model


def fit_scorer(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights and bias of a logistic scorer of soft labels, both classes weighing equally, by gradient descent."""
    x = np.hstack([features, np.ones((len(features), 1), np.float32)])
    scale = np.sqrt((x * x).mean(0)) + 1e-4
    x /= scale
    good, bad = labels.sum(), (1 - labels).sum()
    importance = np.where(labels >= 0.5, 0.5 / max(good, 1), 0.5 / max(bad, 1)).astype(np.float32)
    w, speed = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        speed = 0.9 * speed - RATE / len(w) ** 0.5 * (x.T @ ((p - labels) * importance) + 1e-4 * w)
        w += speed
    return (w / scale).astype(np.float64)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


@F.pandas_udf(T.StringType())
def vote_pattern(texts: pd.Series) -> pd.Series:
    """A digit for each labeller: 2 good, 0 bad, 1 neither."""
    return pd.Series(["".join(map(str, votes(statistics(_raw(t))))) for t in texts], dtype=object)


_FEATURES = T.StructType([T.StructField("pattern", T.StringType()), T.StructField("slots", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.FloatType()))])


@F.pandas_udf(_FEATURES)
def _features(texts: pd.Series) -> pd.DataFrame:
    out = []
    for t in texts:
        raw = _raw(t)
        s = statistics(raw)
        out.append(("".join(map(str, votes(s))), *slots(raw, s)))
    return pd.DataFrame(out, columns=_FEATURES.names)


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[LabelModel, np.ndarray]:
    """The label model from the vote patterns of all documents (3^6 at most come to the driver) and the scorer from the
    posterior labels of `sample` documents at most, those whose doc_id and text hash lowest."""
    counted = docs.select(vote_pattern("text").alias("pattern")).groupBy("pattern").count().orderBy("pattern").collect()
    if not counted:
        return LabelModel(0.5, np.full((len(LABELLERS), 2, 3), 1 / 3)), np.zeros(SLOTS + 1)
    patterns = np.array([[int(v) for v in r["pattern"]] for r in counted])
    model = fit_labels(patterns, np.array([r["count"] for r in counted], float))
    hashed = F.xxhash64(F.lit(SEED), F.col("doc_id"), F.xxhash64("text")).alias("h")
    # the lowest hashes alone are sorted; only texts below the greatest of them move
    most = docs.select(hashed).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    chosen = docs.select(hashed, "text").where(F.col("h") <= most).dropDuplicates(["h"])
    rows = chosen.select(_features("text").alias("f")).select("f.*").orderBy("pattern", "slots", "values").collect()
    dense = np.zeros((len(rows), SLOTS), np.float32)
    for i, r in enumerate(rows):
        dense[i, r["slots"]] = r["values"]
    labels = model.posterior(np.array([[int(v) for v in r["pattern"]] for r in rows])).astype(np.float32)
    return model, fit_scorer(dense, labels)


def scored(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with `quality_score`, the scorer's probability of good quality, rounded to six places.

    A null text counts as empty; a text without words scores 0. Every row stays, with all its columns (one called
    quality_score is replaced). Nothing is shuffled but vote counts and the bounded sample.
    """
    return docs.withColumn("quality_score", _scorer(docs, sample)("text"))


def _scorer(docs: DataFrame, sample: int):
    """The fitted scorer as a function of a text column."""
    bounded_batches(docs.sparkSession)
    _, weights = fit(docs, sample)

    def score(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            raw = _raw(t)
            s = statistics(raw)
            used, values = slots(raw, s)
            z = float(weights[used] @ values) + weights[-1]
            out.append(round(float(1 / (1 + np.exp(-max(-30.0, min(30.0, z))))), 6) if s[-1] else 0.0)
        return pd.Series(out, dtype="float64")

    score.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(score, T.DoubleType())


def keep_good(docs: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs whose score reaches `least`; all columns stay, whatever their names.

    A null or empty text scores 0 and goes; repeated rows stay or go together. An empty table gives an empty result.
    """
    return docs.where(_scorer(docs, sample)(F.col("text")) >= least)


def all_scores(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, quality_score, kept) of every row; kept where the score reaches `least`, as in keep_good.

    Null texts score 0; null and repeated doc_ids stay as rows. An empty table gives an empty result.
    """
    return scored(docs.select("doc_id", "text")).select("doc_id", "quality_score", (F.col("quality_score") >= least).alias("kept"))
