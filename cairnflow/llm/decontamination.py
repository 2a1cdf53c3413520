"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

The automaton accepts every run of words that some item contains. A document's words are streamed through it; at
each word the state and the longest matching length tell which windows and short items end there. Runs of words
that no item knows are skipped at array speed, since they reset the automaton.

A test set is split into blocks of at most about ``BLOCK_BYTES`` bytes of items, each with an automaton of its own;
the documents pass the blocks one after another in the same tasks, so nothing is shuffled and what a worker holds
is bounded by a block.

Defined cases: null or empty texts and items have no words; an empty test set hits nothing; repeated items with one
id count once; repeated documents are judged row by row; an item without id counts under the empty name.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.llm.common import batch_of, texts
from cairnflow.llm.text import LOWER, NORMAL_BYTE, Words, WordTable, buffers, row_sums, slices

WINDOW = 13
BLOCK_BYTES = 1 << 20
DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window and of each short item."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.window = window
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = self.read(items)
        for _, words in sequences:
            last = 0
            for word in words:
                last = self.extend(last, word)
        states = len(self.step)
        self.windows: dict[int, list[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        self.shortest = window
        for name, words in sequences:
            self.shortest = min(self.shortest, len(words))
            state = 0
            for at, word in enumerate(words):
                state = self.step[state][word]
                if at + 1 >= window:
                    self.windows.setdefault(self.holder(state, window), []).append(name)
            if len(words) < window:
                self.short.setdefault(state, []).append((len(words), name))
        self.windows = {k: sorted(set(v)) for k, v in self.windows.items()}
        self.short = {k: sorted(set(v)) for k, v in self.short.items()}
        # Nearest state on the way to the root that has short items, itself included.
        self.up = [-1] * states
        for state in sorted(range(states), key=self.length.__getitem__):
            self.up[state] = state if state in self.short else self.up[self.link[state]] if state else -1

    def read(self, items: list[tuple[str, str]]) -> list[tuple[str, list[int]]]:
        """Items as word numbers."""
        data, bounds = buffers(pa.array([text for _, text in items], pa.string()))
        data = LOWER[data]
        words = Words(data, bounds, NORMAL_BYTE)
        codes, numbers = np.unique(words.hashes(data), return_inverse=True)
        self.table = WordTable(codes)
        sequences = [(name, numbers[a:b].tolist()) for (name, _), a, b in zip(items, words.rows[:-1], words.rows[1:])]
        return [(name, numbers) for name, numbers in sequences if numbers]

    def add(self, length: int, link: int, step: dict[int, int]) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def split(self, state: int, word: int, target: int) -> int:
        """The part of ``target`` that ends the strings of ``state`` plus ``word``, as a state of its own."""
        if self.length[target] == self.length[state] + 1:
            return target
        part = self.add(self.length[state] + 1, self.link[target], dict(self.step[target]))
        self.link[target] = part
        while state >= 0 and self.step[state].get(word) == target:
            self.step[state][word] = part
            state = self.link[state]
        return part

    def extend(self, last: int, word: int) -> int:
        known = self.step[last].get(word)
        if known is not None:
            return self.split(last, word, known)
        fresh = self.add(self.length[last] + 1, 0, {})
        state = last
        while state >= 0 and word not in self.step[state]:
            self.step[state][word] = fresh
            state = self.link[state]
        if state >= 0:
            self.link[fresh] = self.split(state, word, self.step[state][word])
        return fresh

    def holder(self, state: int, length: int) -> int:
        """The state that has the suffix of this length."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def stream(self, words: list[int], start: int, spans: list[tuple[int, int]], items: set[str]) -> None:
        """Append the word ranges that windows or short items cover in a run of words from number ``start`` on."""
        step, link, length, window = self.step, self.link, self.length, self.window
        state = matched = 0
        for at, word in enumerate(words, start + 1):
            while state and word not in step[state]:
                state = link[state]
                matched = length[state]
            target = step[state].get(word)
            if target is None:
                matched = 0
                continue
            state, matched = target, matched + 1
            if matched >= window:
                spans.append((at - window, at))
                items.update(self.windows[self.holder(state, window)])
            near = self.up[state]
            while near > 0:
                for size, name in self.short[near]:
                    if size <= matched:
                        spans.append((at - size, at))
                        items.add(name)
                near = self.up[link[near]]


def hits(automaton: Automaton, data: np.ndarray, bounds: np.ndarray) -> tuple[Words, np.ndarray, dict[int, set[str]]]:
    """Words of a slice, which of them are hit, and the items found by row."""
    data = LOWER[data]
    words = Words(data, bounds, NORMAL_BYTE)
    change = np.zeros(len(words.begin) + 1, np.int64)
    found: dict[int, set[str]] = {}
    if len(words.begin):
        numbers = automaton.table.numbers(words.hashes(data))
        known = numbers >= 0
        first = known.copy()
        first[1:] &= ~known[:-1]
        starts = words.rows[:-1][words.counts > 0]
        first[starts] = known[starts]
        last = np.append(~known[1:] | np.isin(np.arange(1, len(known)), starts, assume_unique=True), True) & known
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        for a, b in zip(begin, end):
            if b - a >= automaton.shortest:
                spans: list[tuple[int, int]] = []
                items: set[str] = set()
                automaton.stream(numbers[a:b].tolist(), int(a), spans, items)
                if spans:
                    row = int(np.searchsorted(words.rows, a, "right")) - 1
                    found.setdefault(row, set()).update(items)
                    edges = np.array(spans)
                    np.add.at(change, edges[:, 0], 1)
                    np.subtract.at(change, edges[:, 1], 1)
    return words, np.cumsum(change[:-1]) > 0, found


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[list[tuple[str, str]]]:
    """The test items, dealt by hash into as many blocks as their size asks for."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text").where("text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    count = max(1, math.ceil(size / block_bytes))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(count)))
    return [[(r.name, r.text) for r in dealt.where(F.col("block") == b).select(F.col("name"), "text").collect()] for b in range(count)]


def scan(docs: DataFrame, benchmark: DataFrame, finish, schema, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pass ``docs`` through the automaton of every block, then each slice with its hits through ``finish``.

    Between the blocks the word hits travel with their row as a bit array, the items as an array of names.
    """
    spark = docs.sparkSession.sparkContext
    columns = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    state = docs.select(row, F.col("text").cast("string").alias("text"), F.lit(None).cast("binary").alias("bits"), F.lit(None).cast("array<string>").alias("names"))
    groups = blocks(benchmark, block_bytes)
    for nth, group in enumerate(groups):
        shared = spark.broadcast(cloudpickle.dumps(Automaton(sorted(group), window)))
        last = nth == len(groups) - 1

        def kernel(batch: pa.RecordBatch, automaton: Automaton, last=last):
            for first, stop, data, bounds in slices(batch.column("text")):
                part = batch.slice(first, stop - first)
                words, hit, found = hits(automaton, data, bounds)
                earlier, names = part.column("bits").to_pylist(), part.column("names").to_pylist()
                for i, bits in enumerate(earlier):
                    if bits is not None:
                        a, b = words.rows[i], words.rows[i + 1]
                        hit[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
                    if names[i]:
                        found.setdefault(i, set()).update(names[i])
                if last:
                    yield from finish(part, words, hit, found, data)
                    continue
                packed = [np.packbits(hit[a:b]).tobytes() for a, b in zip(words.rows[:-1], words.rows[1:])]
                listed = pa.array([sorted(found.get(i, ())) for i in range(stop - first)], pa.list_(pa.string()))
                yield batch_of(row=part.column("row"), text=part.column("text"), bits=pa.array(packed, pa.binary()), names=listed)

        def run(batches, shared=shared, kernel=kernel):
            automaton = cloudpickle.loads(shared.value)
            for batch in batches:
                if batch.num_rows:
                    yield from kernel(batch, automaton)

        state = state.mapInArrow(run, schema if last else state.schema)
    return state


def contaminated(n_words: np.ndarray, n_hit: np.ndarray, share: int = 20) -> np.ndarray:
    """Hit at all, and at least one word in ``share``."""
    return (n_hit > 0) & (share * n_hit >= n_words)


def digest(part: pa.RecordBatch, words: Words, hit: np.ndarray, found: dict[int, set[str]], data: np.ndarray):
    rows = part.num_rows
    n_hit = row_sums(hit, words.rows)
    nothing = hashlib.sha256(b"").hexdigest()
    names = [hashlib.sha256(",".join(sorted(found[i])).encode()).hexdigest() if i in found else nothing for i in range(rows)]
    yield batch_of(
        doc_id=part.column("row").field("doc_id"), n_words=words.counts.astype(np.int64), n_hit=n_hit,
        n_items=np.array([len(found.get(i, ())) for i in range(rows)], np.int64),
        items_sha256=pa.array(names, pa.string()), contaminated=contaminated(words.counts, n_hit),
    )


def inspect(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    return scan(texts(docs), benchmark, digest, DIGEST, **limits)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged."""

    def finish(part, words, hit, found, data):
        good = ~contaminated(words.counts, row_sums(hit, words.rows))
        yield pa.RecordBatch.from_struct_array(part.column("row").filter(pa.array(good)))

    return scan(docs, benchmark, finish, docs.schema, **limits)


def cut_passages(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """doc_id and text of every row, without the bytes from the first to the last word of each run of hit words."""

    def finish(part, words, hit, found, data):
        keep = np.zeros(len(data) + 1, np.int64)
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        np.add.at(keep, words.begin[np.flatnonzero(edge == 1)], 1)
        np.subtract.at(keep, words.end[np.flatnonzero(edge == -1) - 1], 1)
        kept = np.cumsum(keep[:-1]) == 0
        column = part.column("text")
        _, bounds = buffers(column)
        parts = [data[a:b][kept[a:b]].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:])]
        cut = pa.array([x if y else None for x, y in zip(parts, column.is_valid().to_pylist())], pa.string())
        yield batch_of(doc_id=part.column("row").field("doc_id"), text=cut)

    return scan(texts(docs), benchmark, finish, "doc_id long, text string", **limits)
