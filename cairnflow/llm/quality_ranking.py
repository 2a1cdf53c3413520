"""Quality classifier by Bradley-Terry pairwise ranking.

A labelled good document should win against a labelled bad one. Its chance to win is the logistic function of the
difference of the two scores, and a score is linear in statistics of the text; the weights minimise the logistic loss
over preference pairs. A document is good when its score is above a quantile of the learning scores: the quantile that
separates the labels best. Reported scores are moved so that this threshold stands at ``CUT``.

Learning reads at most ``LABEL_ROWS`` labelled rows and draws ``PAIRS`` pairs from them; everything is scored.

Defined cases: null and empty texts get the score of a text without words; without labelled rows of both kinds every
score is ``CUT``; repeated ids are scored row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.llm.common import batch_of, held_out, labelled, map_batches, texts
from cairnflow.llm.quality_rules import statistics
from cairnflow.llm.text import Words, row_sums, slices

LABEL_ROWS = 20_000
PAIRS = 60_000
MODULUS, HELD_OUT = 4, 2
CUT = 0.7
RIDGE = 1e-3
QUANTILES = 1000
ALPHA = np.zeros(256, bool)
ALPHA[list(range(0x41, 0x5B)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of statistics per text; all saturate, so that no text dominates."""
    found = statistics(data, bounds)
    words = Words(data, bounds)
    keys = np.unique(words.hashes(data) ^ (words.row_of().astype(np.uint64) << np.uint64(44)), return_index=True)[1]
    distinct = np.bincount(words.row_of()[keys], minlength=len(bounds) - 1)
    n = found["n_words"]
    some, size = np.maximum(n, 1), np.maximum(np.diff(bounds), 1)
    columns = [
        np.log1p(n),
        np.minimum(n, 50) / 50.0,
        found["n_repeat_words"] / some,
        np.minimum(found["n_dup_lines"], 20) / 20.0,
        distinct / some,
        row_sums(ALPHA[data], bounds) / size,
        *(np.sqrt(found[f]) for f in ("f_symbols", "f_joined", "f_upper", "f_marks")),
        found["f_word_length"],
        (n >= 50) * 1.0,
        (2 * found["n_repeat_words"] > n) * 1.0,
    ]
    return np.column_stack(columns)


WIDTH = 13


@dataclass
class Ranker:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return ((rows - self.centre) / self.scale) @ self.weights

    def scores(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip(self.raw(rows) - self.threshold + math.log(CUT / (1 - CUT)), -30, 30)
        return 1.0 / (1.0 + np.exp(-x))


def fit_ranker(rows: np.ndarray, label: np.ndarray, pairs: int = PAIRS, seed: int = 1) -> Ranker:
    """Newton's method on the pairwise logistic loss with a small ridge."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Ranker(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH))
    centre, scale = rows.mean(0), rows.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    x = (rows - centre) / scale
    rng = np.random.default_rng(seed)
    gap = x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]
    weights = np.zeros(rows.shape[1])
    for _ in range(25):
        win = 1.0 / (1.0 + np.exp(-np.clip(gap @ weights, -30, 30)))
        slope = gap.T @ (win - 1.0) / pairs + RIDGE * weights
        bend = (gap * (win * (1.0 - win))[:, None]).T @ gap / pairs + RIDGE * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    ranker = Ranker(centre, scale, weights)
    raw = ranker.raw(rows)
    cuts = np.quantile(raw, np.arange(1, QUANTILES) / QUANTILES)
    right = 1.0 - np.searchsorted(np.sort(raw[good]), cuts) / len(good)
    wrong = 1.0 - np.searchsorted(np.sort(raw[bad]), cuts) / len(bad)
    best = np.flatnonzero(right - wrong >= (right - wrong).max() - 1e-12)
    ranker.threshold = float(cuts[best].mean())
    return ranker


def learn(docs: DataFrame, labels: DataFrame, rows: int = LABEL_ROWS) -> Ranker:
    def kernel(batch: pa.RecordBatch):
        for first, stop, data, bounds in slices(batch.column("text")):
            found = features(data, bounds)
            listed = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), WIDTH).cast(pa.list_(pa.float64()))
            yield batch_of(label=batch.column("label").slice(first, stop - first), x=listed)

    sample = map_batches(labelled(docs, labels, "quality", MODULUS, HELD_OUT, rows), kernel, "label int, x array<double>").toPandas()
    found = np.vstack([*sample["x"]]) if len(sample) else np.zeros((0, WIDTH))
    order = np.lexsort((*found.T, sample["label"].to_numpy()))
    return fit_ranker(found[order], sample["label"].to_numpy()[order])


def inspect(docs: DataFrame, labels: DataFrame, rows: int = LABEL_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    ranker = learn(docs, labels, rows)

    def kernel(batch: pa.RecordBatch):
        for first, stop, data, bounds in slices(batch.column("text")):
            yield batch_of(doc_id=batch.column("doc_id").slice(first, stop - first), score=ranker.scores(features(data, bounds)))

    scored = map_batches(texts(docs), kernel, "doc_id long, score double")
    return scored.select("doc_id", held_out(MODULUS, HELD_OUT), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
