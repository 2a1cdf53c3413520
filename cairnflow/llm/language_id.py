"""Language identification of mixed-language text, word by word.

Every word is scored in every language by the log-likelihood of its byte trigrams (counts over all learning documents,
hashed into ``BUCKETS`` buckets). The script of a word narrows the candidates: a language that hardly uses the script
cannot have the word. Viterbi decoding with a penalty for each change of language then labels spans of words, all texts
of a slice step by step together. A text is in the language that labels most of its letters; the score is their share.

Learning sees text and language only. Defined cases: a null text, or one without letters, is ``und`` with score 0;
without learning documents every text is ``und``; repeated ids are judged row by row; an empty table gives an empty
result; equal shares go to the first language by name.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.llm.common import batch_of, held_out, map_batches, remainder, texts
from cairnflow.llm.text import LOWER, row_sums, slices

MODULUS, HELD_OUT = 3, 1
BUCKETS = 1 << 15
SWITCH = 6.0
# Share of a language's letters below which it does not use a script.
SCRIPT_SHARE = 0.001
FAR = -40.0
SLICE = 2 << 20

# First code points of script ranges, and the script that starts there (0: no certain script).
RANGES = (
    (0x0000, 1), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0780, 0), (0x0900, 7), (0x0980, 8),
    (0x0E00, 9), (0x0E80, 0), (0x10A0, 10), (0x1100, 11), (0x1200, 12), (0x13A0, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0),
    (0x3040, 13), (0x3100, 0), (0x3130, 11), (0x3190, 0), (0x3400, 14), (0xA000, 0), (0xAC00, 11), (0xD7B0, 0), (0xF900, 14),
    (0xFB00, 1), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0), (0xFF21, 1), (0xFF66, 13), (0xFFA0, 11), (0xFFE0, 0), (0x20000, 14), (0x30000, 0),
)
SCRIPTS = 16
STARTS = np.array([a for a, _ in RANGES])
KINDS = np.array([b for _, b in RANGES])
ASCII_LETTER = np.zeros(128, bool)
ASCII_LETTER[list(range(0x41, 0x5B)) + list(range(0x61, 0x7B))] = True


def letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes that belong to letters, script of the letter that starts at a byte, else -1)."""
    script = np.full(len(data), -1, np.int8)
    inside = np.zeros(len(data), bool)
    narrow = data < 0x80
    plain = narrow & ASCII_LETTER[np.where(narrow, data, 0)]
    inside |= plain
    script[plain] = 1
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int64)
        more = 1 + (first >= 0xE0) + (first >= 0xF0)
        point = np.where(more == 1, first & 0x1F, np.where(more == 2, first & 0x0F, first & 0x07))
        for k in (1, 2, 3):
            has = more >= k
            point = np.where(has, (point << 6) | (data[np.minimum(lead + k, len(data) - 1)] & 0x3F), point)
        kinds, back = np.unique(point, return_inverse=True)
        alpha = np.array([unicodedata.category(chr(p))[0] == "L" for p in kinds])[back]
        where, more = lead[alpha], more[alpha]
        script[where] = KINDS[np.searchsorted(STARTS, point[alpha], "right") - 1]
        for k in range(4):
            inside[where[more >= k] + k] = True
    return inside, script


def trigrams(data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Bucket of the trigram around every byte, with everything but letters as blanks."""
    clean = np.concatenate([[0x20], np.where(inside, LOWER[data], 0x20), [0x20]]).astype(np.uint32)
    code = clean[:-2] * np.uint32(0x9E3779B1) ^ clean[1:-1] * np.uint32(0x85EBCA77) ^ clean[2:] * np.uint32(0xC2B2AE3D)
    code ^= code >> np.uint32(15)
    return ((code * np.uint32(0x2C1B3C6D)) >> np.uint32(17)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # bucket, language
    uses: np.ndarray  # script, language


def learn(docs: DataFrame) -> Model:
    """Trigram and script counts of all learning documents, summed within a task first."""
    known = docs.where(F.col("lang").isNotNull() & (remainder(MODULUS) != HELD_OUT)).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column("lang").to_pylist()
            for first, stop, data, bounds in slices(batch.column("text"), SLICE):
                inside, script = letters(data)
                found = trigrams(data, inside)
                for name in sorted(set(names[first:stop])):
                    mine = np.repeat([n == name for n in names[first:stop]], np.diff(bounds))
                    counts = total.setdefault(name, np.zeros(BUCKETS + SCRIPTS, np.int64))
                    counts[:BUCKETS] += np.bincount(found[mine & inside], minlength=BUCKETS)
                    counts[BUCKETS:] += np.bincount(script[mine & (script >= 0)], minlength=SCRIPTS)
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            yield batch_of(lang=pa.array([name] * len(at), pa.string()), cell=at, n=counts[at])

    # At most BUCKETS + SCRIPTS rows a language.
    sums = known.mapInArrow(run, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sums.lang.unique())
    counts = np.zeros((BUCKETS + SCRIPTS, len(languages)))
    if languages:
        counts[sums.cell.to_numpy(), np.searchsorted(languages, sums.lang.to_numpy())] = sums.n.to_numpy()
    grams, scripts = counts[:BUCKETS], counts[BUCKETS:]
    logs = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS))
    uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
    uses[~uses.any(1)] = True  # a script that no language is known for says nothing
    return Model(languages, logs.astype(np.float32), uses)


def decode(score: np.ndarray, rows: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Language of every word; ``score`` is word by language, ``rows`` the word bounds of the texts."""
    counts = np.diff(rows)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    label = np.zeros(len(score), np.int64)
    if not len(order):
        return label
    start, length = rows[:-1][order], counts[order]
    live = np.searchsorted(-length, -np.arange(length[0]), "left")  # texts longer than each step
    best = score[start].astype(np.float64)
    stays = np.ones(score.shape, bool)
    came = np.zeros(len(score), np.int64)
    for t in range(1, length[0]):
        n = live[t]
        at, now = start[:n] + t, best[:n]
        top = now.argmax(1)
        jump = now[np.arange(n), top] - penalty
        stay = now >= jump[:, None]
        stays[at], came[at] = stay, top
        best[:n] = np.where(stay, now, jump[:, None]) + score[at]
    current = best.argmax(1)
    for t in range(length[0] - 1, -1, -1):
        n = live[t]
        at = start[:n] + t
        label[at] = current[:n]
        current[:n] = np.where(stays[at, current[:n]], current[:n], came[at])
    return label


def label_words(model: Model, data: np.ndarray, bounds: np.ndarray):
    """(begin, end, word bounds of the texts, letters, language) of the words of a slice."""
    inside, script = letters(data)
    n = len(data)
    fresh = np.zeros(n + 1, bool)
    fresh[bounds] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | fresh[1:n]
    last[:-1] &= ~inside[1:] | fresh[1:n]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    rows = np.searchsorted(begin, bounds)
    if not len(begin):
        return begin, end, rows, begin, begin
    score = model.logs[trigrams(data, inside)]
    score[~inside] = 0
    score = np.add.reduceat(score, begin, axis=0)
    score += np.where(model.uses[script[begin]], 0.0, FAR * (end - begin)[:, None]).astype(np.float32)
    size = row_sums(script >= 0, np.concatenate([begin, [n]])) if len(begin) else begin
    return begin, end, rows, size, decode(score, rows)


def inspect(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans of every row."""
    model = learn(docs)

    def kernel(batch: pa.RecordBatch):
        count = max(len(model.languages), 1)
        for first, stop, data, bounds in slices(batch.column("text"), SLICE):
            size = stop - first
            shares, spans = np.zeros((size, count)), np.zeros(size, np.int64)
            if model.languages:
                _, _, rows, weight, label = label_words(model, data, bounds)
                row = np.repeat(np.arange(size), np.diff(rows))
                shares = np.bincount(row * count + label, weight, size * count).reshape(size, count)
                change = np.append(True, (label[1:] != label[:-1]) | (row[1:] != row[:-1]))[: len(row)]
                spans = np.bincount(row[change], minlength=size)
            total, best = shares.sum(1), shares.argmax(1)
            names = [model.languages[b] if t > 0 else "und" for b, t in zip(best, total)]
            score = shares[np.arange(size), best] / np.maximum(total, 1)
            yield batch_of(doc_id=batch.column("doc_id").slice(first, size), lang_pred=pa.array(names, pa.string()), score=score, n_spans=spans)

    found = map_batches(texts(docs), kernel, "doc_id long, lang_pred string, score double, n_spans long")
    return found.select("doc_id", held_out(MODULUS, HELD_OUT), "lang_pred", "score", "n_spans")


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, lang and text of every span of words in one language, in order."""
    model = learn(docs)

    def kernel(batch: pa.RecordBatch):
        for first, stop, data, bounds in slices(batch.column("text"), SLICE):
            if not model.languages:
                continue
            begin, end, rows, _, label = label_words(model, data, bounds)
            row = np.repeat(np.arange(stop - first), np.diff(rows))
            change = np.append(True, (label[1:] != label[:-1]) | (row[1:] != row[:-1]))[: len(row)]
            at = np.flatnonzero(change)
            stops = np.append(at[1:], len(row)) - 1
            parts = [data[begin[a] : end[b]].tobytes().decode() for a, b in zip(at, stops)]
            ids = batch.column("doc_id").slice(first, stop - first).take(pa.array(row[at]))
            yield batch_of(doc_id=ids, nth=at - rows[row[at]], lang=pa.array([model.languages[k] for k in label[at]], pa.string()), text=pa.array(parts, pa.string()))

    return map_batches(texts(docs), kernel, "doc_id long, nth long, lang string, text string")
