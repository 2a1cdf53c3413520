"""Toxicity classifier: a factorization machine over hashed terms.

Terms are the words of a text and their beginnings (which stand for inflected forms), hashed into ``BUCKETS`` buckets.
Every bucket of at least ``LEAST_TEXTS`` learning texts that tells the labels apart by more than chance becomes an input,
so what is learned grows with the labelled rows up to the size of the hash space. The machine adds to the linear weights a pairwise
weight for every two terms, the product of their factors, so a word can matter only in the company of another.

Learning reads at most ``LABEL_ROWS`` labelled rows; everything is scored.

Defined cases: null and empty texts get the score of a text without terms; without labelled rows of both kinds every
score is the share of toxic ones (0 without any); repeated ids are scored row by row; an empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.llm.common import batch_of, held_out, labelled, map_batches, texts
from cairnflow.llm.text import BYTE_CODES, LOWER, NORMAL_BYTE, RangeHash, Words, slices

LABEL_ROWS = 20_000
MODULUS, HELD_OUT = 5, 0
BUCKETS = 1 << 18
LEAST_TEXTS = 4
# Standard errors between the shares of toxic and clean texts that have a term, below which it counts as noise.
LEAST_APART = 3.0
BEGINNINGS = (3, 4, 5, 6)
FACTORS = 8
EPOCHS = 40


def terms(data: np.ndarray, bounds: np.ndarray, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) pairs, each once: buckets, or numbers of chosen terms when ``chosen`` maps buckets to them."""
    data = LOWER[data]
    words = Words(data, bounds, NORMAL_BYTE)
    hashes = RangeHash(BYTE_CODES[data])
    row = words.row_of()
    keys = []
    for size in (0, *BEGINNINGS):
        at = np.flatnonzero(words.end - words.begin >= size) if size else np.arange(len(row))
        end = words.begin[at] + size if size else words.end[at]
        bucket = (hashes.ranges(words.begin[at], end, 40 + size) & np.uint64(BUCKETS - 1)).astype(np.int64)
        if chosen is not None:
            bucket = chosen[bucket]
            at, bucket = at[bucket >= 0], bucket[bucket >= 0]
        keys.append(row[at] * BUCKETS + bucket)
    found = np.unique(np.concatenate(keys))
    return found // BUCKETS, found % BUCKETS


@dataclass
class Machine:
    """Factorization machine on 0/1 inputs; ``chosen`` maps buckets to inputs, -1 elsewhere."""

    chosen: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        linear = self.bias + np.bincount(row, self.weights[term], rows)
        if not len(row):
            return linear
        for f in range(self.factors.shape[1]):
            v = self.factors[term, f]
            linear = linear + 0.5 * (np.bincount(row, v, rows) ** 2 - np.bincount(row, v * v, rows))
        return linear

    def scores(self, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(row, term, rows), -30, 30)))


def fit_machine(chosen: np.ndarray, size: int, row: np.ndarray, term: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> Machine:
    """Adam on the logistic loss over mini-batches of rows; ``row`` is sorted."""
    rng = np.random.default_rng(seed)
    share = float(label.mean()) if len(label) else 0.0
    start = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
    state = {"b": np.array([start]), "w": np.zeros(size), "v": rng.normal(0, 0.02, (size, FACTORS))}
    if not 0 < share < 1 or not size:
        return Machine(chosen, float(start), state["w"], state["v"] * 0)
    first = {k: np.zeros_like(p) for k, p in state.items()}
    second = {k: np.zeros_like(p) for k, p in state.items()}
    edges = np.searchsorted(row, np.arange(len(label) + 1))
    step, batch = 0, 512
    for _ in range(epochs):
        shuffled = rng.permutation(len(label))
        for lo in range(0, len(shuffled), batch):
            part = shuffled[lo : lo + batch]
            lengths = edges[part + 1] - edges[part]
            mine = np.repeat(np.arange(len(part)), lengths)
            at = np.repeat(edges[part] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            t = term[at]
            machine = Machine(chosen, state["b"][0], state["w"], state["v"])
            error = machine.scores(mine, t, len(part)) - label[part]
            e = error[mine]
            slope = {"b": np.array([error.mean()]), "w": np.bincount(t, e, size) / len(part) + 1e-5 * state["w"], "v": 1e-4 * state["v"]}
            for f in range(FACTORS):
                v = state["v"][t, f]
                together = np.bincount(mine, v, len(part))[mine] - v
                slope["v"][:, f] += np.bincount(t, e * together, size) / len(part)
            step += 1
            for k, g in slope.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                state[k] = state[k] - 0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Machine(chosen, float(state["b"][0]), state["w"], state["v"])


def bucket_counts(sample: DataFrame) -> DataFrame:
    """bucket, label, texts: in how many texts of either label a bucket is found. Summed within a task first."""

    def run(batches):
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            label = batch.column("label").to_numpy()
            for first, stop, data, bounds in slices(batch.column("text")):
                row, bucket = terms(data, bounds)
                for kind in (0, 1):
                    counts[kind] += np.bincount(bucket[label[first:stop][row] == kind], minlength=BUCKETS)
        for kind in (0, 1):
            at = np.flatnonzero(counts[kind])
            yield batch_of(bucket=at, label=np.full(len(at), kind, np.int32), texts=counts[kind][at])

    return sample.mapInArrow(run, "bucket long, label int, texts long").groupBy("bucket", "label").agg(F.sum("texts").alias("texts"))


def learn(docs: DataFrame, labels: DataFrame, rows: int = LABEL_ROWS) -> Machine:
    sample = labelled(docs, labels, "toxic", MODULUS, HELD_OUT, rows).where("label IN (0, 1)")
    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    chosen = np.full(BUCKETS, -1, np.int64)
    if not toxic or not clean:
        share = toxic / max(toxic + clean, 1)
        return fit_machine(chosen, 0, np.zeros(0, np.int64), np.zeros(0, np.int64), np.full(1, share))
    counts = bucket_counts(sample).groupBy("bucket").agg(
        F.sum(F.expr("if(label = 1, texts, 0)")).alias("t"), F.sum(F.expr("if(label = 0, texts, 0)")).alias("c")
    )
    pooled = (F.col("t") + F.col("c")) / (toxic + clean)
    apart = (F.col("t") / toxic - F.col("c") / clean) / F.sqrt(pooled * (1 - pooled) * (1 / toxic + 1 / clean) + 1e-12)
    best = counts.where((F.col("t") + F.col("c") >= LEAST_TEXTS) & (F.abs(apart) >= LEAST_APART)).orderBy("bucket").select("bucket").collect()  # at most BUCKETS rows
    for nth, r in enumerate(best):
        chosen[r.bucket] = nth

    def kernel(batch: pa.RecordBatch):
        for first, stop, data, bounds in slices(batch.column("text")):
            row, term = terms(data, bounds, chosen)
            cuts = np.searchsorted(row, np.arange(stop - first + 1)).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(cuts), pa.array(term.astype(np.int32)))
            yield batch_of(label=batch.column("label").slice(first, stop - first), found=found)

    listed = map_batches(sample, kernel, "label int, found array<int>").toPandas()
    listed = listed.assign(key=[(int(a), *map(int, b)) for a, b in zip(listed.label, listed.found)]).sort_values("key")
    lengths = listed.found.map(len).to_numpy()
    row = np.repeat(np.arange(len(listed)), lengths)
    term = np.concatenate([*listed.found]).astype(np.int64) if len(listed) else np.zeros(0, np.int64)
    return fit_machine(chosen, len(best), row, term, listed.label.to_numpy().astype(float))


def inspect(docs: DataFrame, labels: DataFrame, rows: int = LABEL_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    machine = learn(docs, labels, rows)

    def kernel(batch: pa.RecordBatch):
        for first, stop, data, bounds in slices(batch.column("text")):
            row, term = terms(data, bounds, machine.chosen)
            yield batch_of(doc_id=batch.column("doc_id").slice(first, stop - first), score=machine.scores(row, term, stop - first))

    scored = map_batches(texts(docs), kernel, "doc_id long, score double")
    return scored.select("doc_id", held_out(MODULUS, HELD_OUT), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
