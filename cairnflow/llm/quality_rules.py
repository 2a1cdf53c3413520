"""Quality rules: rule statistics of whole texts, and an isolation forest that flags the anomalous ones.

Random axis-parallel splits isolate unusual rows after few steps; the mean path length over the trees gives
an anomaly score. Small subsamples keep a crowd of like junk from hiding itself. The forest is grown on bounded ones (``trees`` times ``SUBSAMPLE`` rows, the documented
bound of the method itself). Its threshold is calibrated on the scores of *all* labelled rows: among those that
reject at most ``FALSE_REJECTS`` of the rows of quality 1, the one that separates the two kinds best.

Defined cases: a null or empty text has no words and fails the base rule; repeated ids are judged row by row;
an empty table gives an empty result; without labelled rows of both kinds the forest rejects nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.llm.common import batch_of, bounded, map_batches, stage, texts
from cairnflow.llm.text import (
    BYTE_CODES,
    WORD_BYTE,
    RangeHash,
    Words,
    mix,
    row_sums,
    slices,
)

TREES = 256
SUBSAMPLE = 64
FALSE_REJECTS = 0.005
BINS = 4096

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("f_symbols", "f_joined", "f_upper", "f_marks", "f_word_length")
COUNT_SCHEMA = ", ".join(f"{c} long" for c in COUNTS)
FEATURE_SCHEMA = ", ".join(f"{c} double" for c in FEATURES)

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
LETTER = UPPER.copy()
LETTER[0x61:0x7B] = True
MARK = np.zeros(256, bool)
MARK[list(b"!?")] = True
JOINT = np.zeros(256, bool)
JOINT[list(b"|:;=_{}[]()/\\")] = True


def repeated_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is the key found twice or more, is it equal to an earlier one) for every key."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    if len(keys) > 1:
        ordered = keys[order]
        same[1:-1] = ordered[1:] == ordered[:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return twice, later


def duplicate_lines(data: np.ndarray, bounds: np.ndarray, words: Words) -> np.ndarray:
    """Lines of each row that hold a word and equal an earlier line of the row."""
    breaks = np.flatnonzero(data == 0x0A)
    begin = np.concatenate([bounds[:-1], breaks + 1])
    row = np.concatenate([np.arange(len(bounds) - 1), np.searchsorted(bounds, breaks, "right") - 1])
    order = np.lexsort((begin, row))
    begin, row = begin[order], row[order]
    last = np.append(row[1:] != row[:-1], True)[: len(row)]
    end = np.where(last, bounds[row + 1], np.append(begin[1:], 0) - 1)
    held = np.searchsorted(words.begin, end) > np.searchsorted(words.begin, begin)
    begin, end, row = begin[held], end[held], row[held]
    keys = RangeHash(BYTE_CODES[data]).ranges(begin, end) ^ mix(row.astype(np.uint64), 7)
    return np.bincount(row[repeated_keys(keys)[1]], minlength=len(bounds) - 1)


def repeated_words(words: Words, codes: np.ndarray, width: int = 3) -> np.ndarray:
    """Words of each row inside ``width``-word windows that the row has twice or more."""
    row = words.row_of()
    grams = RangeHash(codes).grams(width)
    inside = row[: len(grams)] == row[len(codes) - len(grams) :]
    at = np.flatnonzero(inside)
    keys = grams[at] ^ mix(row[at].astype(np.uint64), 7)
    hit = np.zeros(len(codes) + 1, np.int64)
    found = at[repeated_keys(keys)[0]]
    hit[found] += 1
    np.subtract.at(hit, found + width, 1)
    return row_sums(np.cumsum(hit[:-1]) > 0, words.rows)


def statistics(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    words = Words(data, bounds)
    codes = words.hashes(data)
    count = lambda flags: row_sums(flags, bounds)
    n = words.counts
    inside = WORD_BYTE[data]
    found = {
        "n_words": n.astype(np.int64),
        "word_chars": count(inside & ((data & 0xC0) != 0x80)),
        "n_symbols": count(SYMBOL[data]),
        "n_dup_lines": duplicate_lines(data, bounds, words).astype(np.int64),
        "n_repeat_words": repeated_words(words, codes),
    }
    some = np.maximum(n, 1)
    letters = np.maximum(count(LETTER[data]), 1)
    return found | {
        "f_symbols": np.minimum(found["n_symbols"] / some, 3.0),
        "f_upper": count(UPPER[data]) / letters,
        "f_marks": np.minimum(count(MARK[data]) / some, 3.0),
        "f_word_length": np.minimum(found["word_chars"] / some, 20.0) / 20.0,
        "f_joined": np.minimum(count(JOINT[data]) / some, 3.0),
    }


def statistics_kernel(batch: pa.RecordBatch):
    ids = batch.column("doc_id")
    for first, stop, data, bounds in slices(batch.column("text")):
        yield batch_of(doc_id=ids.slice(first, stop - first), **statistics(data, bounds))


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and the ratios that the forest sees; one row per row of ``docs``."""
    return map_batches(texts(docs), statistics_kernel, f"doc_id long, {COUNT_SCHEMA}, {FEATURE_SCHEMA}")


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a random tree over ``n`` rows."""
    return 0.0 if n < 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


def grow(rows: np.ndarray, rng: np.random.Generator, depth: int) -> list[tuple[int, float, int, int, float]]:
    """A tree as (feature or -1, cut, left, right, path length at a leaf) per node."""
    nodes: list = []

    def node(part: np.ndarray, level: int) -> int:
        at = len(nodes)
        nodes.append(None)
        low, high = part.min(0), part.max(0)
        usable = np.flatnonzero(high > low)
        if level >= depth or len(part) < 2 or not len(usable):
            nodes[at] = (-1, 0.0, at, at, level + expected_path(len(part)))
            return at
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(low[feature], high[feature]))
        under = part[:, feature] <= cut
        left = node(part[under], level + 1)
        nodes[at] = (feature, cut, left, node(part[~under], level + 1), 0.0)
        return at

    node(rows, 0)
    return nodes


@dataclass
class Forest:
    """Grown trees padded to one shape, so that all rows and trees descend together."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    size: int
    threshold: float = math.inf

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2^(-mean path / expected path): near 1 for anomalies."""
        total = np.zeros(len(rows))
        at_row = np.arange(len(rows))
        for feature, cut, left, right, path in zip(self.feature, self.cut, self.left, self.right, self.path):
            at = np.zeros(len(rows), np.int64)
            while True:
                chosen = feature[at]
                live = chosen >= 0
                if not live.any():
                    break
                below = rows[at_row, np.maximum(chosen, 0)] <= cut[at]
                at = np.where(below, left[at], right[at])
            total += path[at]
        return 2.0 ** (-(total / max(len(self.path), 1)) / max(expected_path(self.size), 1e-9))


def fit_forest(rows: np.ndarray, trees: int, subsample: int, seed: int = 1) -> Forest | None:
    """Each tree is grown on rows drawn without replacement; ``None`` when there is nothing to split."""
    if len(rows) < 2:
        return None
    rng = np.random.default_rng(seed)
    size = min(subsample, len(rows))
    depth = math.ceil(math.log2(size))
    grown = [grow(rows[rng.choice(len(rows), size, replace=False)], rng, depth) for _ in range(trees)]
    width = max(map(len, grown))
    parts = [np.array([[n[i] for n in t] + [t[0][i] if i != 0 else -1] * (width - len(t)) for t in grown]) for i in range(5)]
    return Forest(parts[0].astype(int), parts[1], parts[2].astype(int), parts[3].astype(int), parts[4], size)


def fit(stats: DataFrame, labels: DataFrame, trees: int = TREES, false_rejects: float = FALSE_REJECTS) -> Forest | None:
    """Grow the forest on a bounded sample of rows that pass the base rule; calibrate it on all labelled ones."""
    passed = stats.where(~base_failed())
    sample = bounded(passed.select("doc_id", *FEATURES), trees * SUBSAMPLE, "doc_id", *FEATURES).toPandas()
    forest = fit_forest(sample[list(FEATURES)].to_numpy(), trees, SUBSAMPLE)
    if forest is None:
        return None
    marks = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    scored = score(passed.join(marks, "doc_id"), forest, "quality int").groupBy("quality", F.floor(F.col("anomaly") * BINS).alias("bin")).count()
    counts = {q: np.zeros(BINS + 1) for q in (0, 1)}
    for r in scored.collect():  # at most two times BINS rows
        if r.quality in counts:
            counts[r.quality][r.bin] += r["count"]
    above = {q: c[::-1].cumsum()[::-1] for q, c in counts.items()}
    if above[0][0] and above[1][0]:
        right, wrong = above[0] / above[0][0], above[1] / above[1][0]
        gain = np.where(wrong <= false_rejects, right - wrong, 0.0)
        if gain.max() > 0:
            forest.threshold = float(np.flatnonzero(gain == gain.max())[-1]) / BINS
    return forest


def score(stats: DataFrame, forest: Forest | None, extra: str = "") -> DataFrame:
    """``stats`` with ``anomaly`` (0 without a forest)."""
    names = [x.split()[0] for x in extra.split(",") if x]

    def kernel(batch: pa.RecordBatch):
        rows = np.column_stack([batch.column(f).to_numpy() for f in FEATURES])
        found = forest.scores(rows) if forest else np.zeros(len(rows))
        keep = {c: batch.column(c) for c in ("doc_id", *COUNTS, *names)}
        yield batch_of(**keep, anomaly=found)

    schema = f"doc_id long, {COUNT_SCHEMA}, {extra + ', ' if extra else ''}anomaly double"
    return map_batches(stats, kernel, schema)


def judge(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the anomaly score of every row."""
    stats = stage(rule_statistics(docs), "rules")
    forest = fit(stats, labels, **parameters)
    threshold = forest.threshold if forest else math.inf
    return score(stats, forest).withColumn("base_failed", base_failed()).select(
        "doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("anomaly") < F.lit(threshold))).alias("kept"), "anomaly"
    )


def keep_good(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns. The texts are scanned twice, not shuffled."""
    forest = fit(stage(rule_statistics(docs), "rules"), labels, **parameters)

    def kernel(batch: pa.RecordBatch):
        for first, stop, data, bounds in slices(batch.column("text")):
            found = statistics(data, bounds)
            failed = (found["n_words"] < 50) | (100 * found["n_repeat_words"] > 50 * found["n_words"])
            if forest:
                failed |= forest.scores(np.column_stack([found[f] for f in FEATURES])) >= forest.threshold
            yield batch.slice(first, stop - first).filter(pa.array(~failed))

    return map_batches(docs, kernel, docs.schema)
