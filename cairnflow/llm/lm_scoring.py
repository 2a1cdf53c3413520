"""LM scoring by cross-entropy difference.

Two word-bigram models, one of the target documents (labelled as good) and one of the background (all others), are
matched: same order, same smoothing, one shared vocabulary, and about as much text. The larger side is drawn down by a
hash of its documents to the bytes of the smaller one; otherwise words that neither knows would cost less under
the smaller model, and noise would look like target. Both grow with the corpus. A document is scored by the mean
difference of the losses of its tokens under both; a high score means that the target model predicts it better.

A document must not vouch for itself: texts are dealt by hash into two folds (so copies stay together), and each fold
is scored by models that were counted on the other one.

The vocabulary is every word of the corpus (``size`` keeps the most frequent ones instead; all others are then one
unknown word). Neither words nor bigrams are ever collected: their counts are a DataFrame, and the tokens of the
documents are dealt to it by key. A group of keys hands on the bigrams of both folds, and of all others only sums by word. The loss of word v after word u,

    -log(seen(u, v) + rest(u) p(v)) = -log rest(u) - log p(v) - log(1 + seen(u, v) / (rest(u) p(v))),

falls into a part for each word and a part for each bigram that the scoring model has seen; so a document needs the
value of its words and bigrams, which is 0 for all that the other fold does not have. Keys that make up more than
1/``HOT_SHARE`` of the tokens are broadcast, at most that many words and as many bigrams; all others are dealt over
groups of about ``GROUP_BYTES`` of text. Values are multiples of 2^-18, so sums do not depend on their order.

Defined cases: null and empty texts have no tokens and score 0; without target or background documents that model
falls back on the uniform distribution; repeated ids are scored row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cairnflow.llm.common import Stages, batch_of, map_batches, texts
from cairnflow.llm.text import BASE, LOWER, NORMAL_BYTE, U64, Words, WordTable, mix, signed, slices
from cairnflow.operators.skew import join_by_weight

DISCOUNT = 0.75
# Distinct words, and bigrams of slices, that a task holds before it hands on its counts.
HELD_WORDS = 1 << 20
HELD_PAIRS = 1 << 20
# Bigrams are counted in so many passes, since what they shuffle takes more space than the texts.
PASSES = 2
# Bytes of text that a group of keys stands for.
GROUP_BYTES = 8 << 20
HOT_SHARE = 1 << 16
GRAIN = 1 << 18
# Codes of the start of a text, of an unknown word and of the end of a text.
START, UNKNOWN, END = U64(0x5BD1E9955BD1E995), U64(0x2545F4914F6CDD1D), U64(0x369DEA0F31A53F85)
KINDS = range(4)
# Texts that were not drawn are counted as kind 4 + fold: no model uses them, but they tell which keys a fold has.
COUNTED = range(6)
# The kinds (2 fold + target) whose counts score folds 0 and 1: target and background each.
SCORED_BY = (3, 2, 1, 0)
VALUES = ("t0", "b0", "t1", "b1")


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, Words]:
    data = LOWER[data]
    words = Words(data, bounds, NORMAL_BYTE)
    return words.hashes(data), words


def vocabulary(docs: DataFrame, size: int) -> WordTable:
    """The most frequent words (ties by hash) of all documents."""

    def run(batches):
        codes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for _, _, data, bounds in slices(batch.column("text")):
                found, number = np.unique(tokens(data, bounds)[0], return_counts=True)
                codes, back = np.unique(np.concatenate([codes, found]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, number])).astype(np.int64)
                if len(codes) > HELD_WORDS:
                    yield batch_of(code=signed(codes), n=counts)
                    codes, counts = codes[:0], counts[:0]
        yield batch_of(code=signed(codes), n=counts)

    words = docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    top = words.orderBy(F.desc("n"), "code").limit(size).collect()
    return WordTable(np.array([r.code for r in top], np.int64).view(np.uint64))


def pairs(table: WordTable | None, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of the word before each token, code of the token, token bounds of the rows)."""
    now, words = tokens(data, bounds)
    if table:
        now = np.where(table.numbers(now) < 0, UNKNOWN, now)
    before = np.append(START, now[:-1])[: len(now)]
    before[words.rows[:-1][words.counts > 0]] = START
    return before, now, words.rows


def word_keys(codes: np.ndarray) -> np.ndarray:
    return mix(codes, 11)


def last_keys(codes: np.ndarray) -> np.ndarray:
    return mix(codes, 12)


def pair_keys(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    return mix(mix(before, 13) * U64(BASE) + now, 14)


def group_of(keys: np.ndarray, groups: int) -> np.ndarray:
    return ((keys >> U64(32)) * U64(groups) >> U64(32)).astype(np.int64)


def blobs(group: np.ndarray, groups: int, **columns: np.ndarray):
    """(group, bytes of each column) of the groups that have rows; ``group`` is sorted."""
    cuts = np.searchsorted(group, np.arange(groups + 1))
    some = np.flatnonzero(np.diff(cuts))
    ends = np.append(cuts[some], cuts[-1])
    # The columns themselves are the values, cut where a group ends: nothing is copied.
    buffers = {k: [None, pa.py_buffer((ends * c.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(c))] for k, c in columns.items()}
    return some.astype(np.int32), {k: pa.Array.from_buffers(pa.binary(), len(some), b) for k, b in buffers.items()}


def joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    """The bytes of all rows of a binary column as one array, read where Arrow has them: no object per row."""
    found = []
    for chunk in table.column(name).chunks:
        _, offsets, data = chunk.buffers()
        wide = np.dtype(np.int64 if pa.types.is_large_binary(chunk.type) else np.int32)
        first, last = np.frombuffer(offsets, wide, len(chunk) + 1, wide.itemsize * chunk.offset)[[0, -1]] if len(chunk) else (0, 0)
        if last > first:
            found.append(np.frombuffer(data, np.uint8, last - first, first))
    return (found[0] if len(found) == 1 else np.concatenate(found)).view(kind) if found else np.zeros(0, kind)


def matched_texts(docs: DataFrame, target: DataFrame) -> DataFrame:
    """All texts with their kind: 2 fold + target for about as many bytes of target as of background documents, else 4 + fold."""
    ids = target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().withColumn("kind", F.lit(1))
    # The number of target documents has no bound, so they are never broadcast; only they are held, so no text is sorted.
    # Documents without an id are no target and need not meet the list.
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(1 << 20)) / (1 << 20)
    sized = docs.select("doc_id", F.octet_length("text").cast("long").alias("size"))
    kind = F.coalesce("kind", F.lit(0))
    known, lost = "doc_id IS NOT NULL", "doc_id IS NULL"
    sizes = sized.where(known).join(ids.hint("shuffle_hash"), "doc_id", "left").groupBy(kind.alias("kind")).agg(F.sum("size").alias("size"))
    by_kind = {r.kind: r.size or 0 for r in sizes.collect()}
    by_kind[0] = by_kind.get(0, 0) + (sized.where(lost).agg(F.sum("size")).first()[0] or 0)
    least = min(by_kind[0], by_kind.get(1, 0)) or max(by_kind.values())
    shares = F.when(F.col("target") == 1, least / max(by_kind.get(1, 0), 1)).otherwise(least / max(by_kind[0], 1))
    placed = docs.select("doc_id", "text", "fold", place.alias("place"))
    marked = placed.where(known).join(ids.hint("shuffle_hash"), "doc_id", "left").withColumn("target", kind).drop("kind")
    marked = marked.unionByName(placed.where(lost).withColumn("target", F.lit(0)))
    drawn = F.col("place") < shares
    return marked.select("text", F.when(drawn, 2 * F.col("fold") + F.col("target")).otherwise(4 + F.col("fold")).alias("kind"))


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a run of rows begins that are equal in all columns."""
    fresh = np.ones(len(columns[0]), bool)
    fresh[1:] = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(fresh)


def by_pair(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    """An order in which equal pairs are neighbours: that of one key, or of both words where two pairs have the same key."""
    keys = pair_keys(before, now)
    order = np.argsort(keys)
    if len(runs(keys[order])) != len(runs(before[order], now[order])):
        order = np.lexsort((now, before))
    return order


def cell_counts(before: np.ndarray, now: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, with its counts by kind; ``n`` is 8 times a count plus its kind."""
    order = by_pair(before, now)
    before, now, n = before[order], now[order], n[order]
    fresh = runs(before, now)
    nth = np.repeat(np.arange(len(fresh)), np.diff(np.append(fresh, len(n))))
    counts = np.bincount(nth * len(COUNTED) + (n & 7), n >> 3, len(fresh) * len(COUNTED))
    return before[fresh], now[fresh], counts.astype(np.int64).reshape(-1, len(COUNTED))


CELL_SCHEMA = "u long, v long, " + ", ".join([f"{x} long" for x in (*(f"n{k}" for k in COUNTED), *(f"e{k}" for k in COUNTED), *(f"d{k}" for k in KINDS), "after")])


def count(marked: DataFrame, table: WordTable | None, groups: int, part: int) -> DataFrame:
    """u, v, n0 .. n5: how often a word follows another in the texts of each kind, for the pairs that both folds have.

    All pairs are in the rows without v. They hold the sums over the pairs of a group that begin with u: n0 .. n5 of all pairs and
    e0 .. e5 of those with the end of a text, d0 .. d3 the number of words after it, and after how many pairs of both folds it begins.
    Every word of a text begins a pair, since its last one stands before its end; so n0 .. n5 are the occurrences of the word.

    Of the groups, every ``PASSES``-th from ``part`` on.
    """

    def packed(held: list[tuple[np.ndarray, ...]]):
        """Counts by group; empties ``held``, so that its rows are not there twice."""
        before, now, n = (np.concatenate(x) for x in zip(*held))
        held.clear()
        # Groups are ranges of keys, so the order of the keys is one by group, also with the kind as their last bits.
        # Equal keys of other words are told apart below; a count that stays in parts is added up where its group is.
        keys = pair_keys(before, now) & ~U64(7) | (n & 7).astype(np.uint64)
        order = np.argsort(keys)
        before, now, n, group = before[order], now[order], n[order], group_of(keys[order], groups)
        del order, keys
        fresh = runs(before, now, n & 7)
        n = (np.add.reduceat(n >> 3, fresh) << 3) + (n[fresh] & 7)
        some, columns = blobs(group[fresh], groups, u=before[fresh], v=now[fresh], n=n)
        return batch_of(p=some, **columns)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            kinds = batch.column("kind").to_numpy().astype(np.int64)
            for first, stop, data, bounds in slices(batch.column("text")):
                before, now, rows = pairs(table, data, bounds)
                last = np.flatnonzero(np.diff(rows))
                kind = np.append(np.repeat(kinds[first:stop], np.diff(rows)), kinds[first:stop][last])
                before, now = np.append(before, now[rows[1:][last] - 1]), np.append(now, np.full(len(last), END))
                keys = pair_keys(before, now)
                mine = np.flatnonzero(group_of(keys, groups) % PASSES == part)
                if len(mine):
                    keys = keys[mine] ^ mix(np.arange(len(COUNTED), dtype=np.uint64), 15)[kind[mine]]
                    order = np.argsort(keys)
                    fresh = runs(keys[order])
                    at, number = mine[order[fresh]], np.diff(np.append(fresh, len(mine)))
                    held.append((before[at], now[at], (number << 3) + kind[at]))
                    size += len(at)
                if size > HELD_PAIRS:
                    yield packed(held)
                    size = 0
        if held:
            yield packed(held)

    def merge(part: pa.Table) -> pa.Table:
        before, now, n = cell_counts(joined(part, "u", np.uint64), joined(part, "v", np.uint64), joined(part, "n", np.int64))
        ends = now == END
        shared = (n[:, (0, 1, 4)].any(1)) & (n[:, (2, 3, 5)].any(1)) & ~ends
        cells = {"u": signed(before[shared]), "v": signed(now[shared]), **{f"n{k}": n[shared, k] for k in COUNTED}}
        order = np.argsort(before)
        fresh = runs(before[order])
        added = lambda x: np.add.reduceat(x[order].astype(np.int64), fresh)
        words = {"u": signed(before[order[fresh]]), "v": pa.nulls(len(fresh), pa.int64()), **{f"n{k}": added(n[:, k]) for k in COUNTED}}
        words |= {f"e{k}": added(np.where(ends, n[:, k], 0)) for k in COUNTED}
        words |= {f"d{k}": added((n[:, k] > 0) & ~ends) for k in KINDS} | {"after": added(shared)}
        none = pa.nulls(int(shared.sum()), pa.int64())
        return pa.concat_tables([pa.table({x: cells.get(x, none) for x in words}), pa.table(words)])

    sent = marked.mapInArrow(run, "p int, u binary, v binary, n binary")
    return sent.groupBy("p").applyInArrow(merge, CELL_SCHEMA)


def both(*prefixes: str) -> str:
    """Do both folds have it; what only one has never meets a model that knows it."""
    fold = lambda kinds: " + ".join(f"{p}{k}" for p in prefixes for k in kinds)
    return f"{fold((0, 1, 4))} > 0 AND {fold((2, 3, 5))} > 0"


def occurrences(prefix: str) -> str:
    return "(" + " + ".join(f"{prefix}{k}" for k in COUNTED) + ")"


def word_counts(counted: DataFrame) -> DataFrame:
    """code, c (as a word), m (before a word), d (distinct words after it) by kind; pairs of both folds before and after."""
    sums = [F.sum(x).alias(x) for x in counted.columns if x not in "uv"]
    words = counted.where("v IS NULL").groupBy(F.col("u").alias("code")).agg(*sums)
    second = counted.where("v IS NOT NULL").groupBy(F.col("v").alias("code")).agg(F.count("*").alias("before"))
    # The start of a text begins pairs, but is no word of it.
    occurs = [F.when(F.col("code") == F.lit(START.astype(np.int64)), 0).otherwise(F.col(f"n{k}")).alias(f"c{k}") for k in COUNTED]
    begins = [(F.col(f"n{k}") - F.col(f"e{k}")).alias(f"m{k}") for k in COUNTED]
    both_sides = words.join(second.hint("shuffle_hash"), "code", "left")
    return both_sides.select("code", *occurs, *begins, *[f"d{k}" for k in KINDS], "after", F.coalesce("before", F.lit(0)).alias("before"))


def rounded(values: list[np.ndarray]) -> dict[str, np.ndarray]:
    return {name: (np.round(values[k] * GRAIN) / GRAIN).astype(np.float32) for name, k in zip(VALUES, SCORED_BY)}


def rests(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The mass that each model leaves to unseen words after the word."""
    m = [batch.column(f"m{k}").to_numpy() for k in KINDS]
    return [np.where(m[k] > 0, DISCOUNT * batch.column(f"d{k}").to_numpy() / np.maximum(m[k], 1), 1.0) for k in KINDS]


VALUE_SCHEMA = "key long, " + ", ".join(f"{v} float" for v in VALUES)


def word_values(words: DataFrame) -> DataFrame:
    """The parts of a loss for a word, over that of an unseen one, and what its last place in a text takes off."""

    def kernel(batch: pa.RecordBatch):
        codes = batch.column("code").to_numpy().view(np.uint64)
        after = [-np.log(r) for r in rests(batch)]
        whole = [after[k] - np.log(batch.column(f"c{k}").to_numpy() + 1.0) for k in KINDS]
        yield batch_of(key=signed(word_keys(codes)), **rounded(whole))
        yield batch_of(key=signed(last_keys(codes)), **rounded([-a for a in after]))

    return map_batches(words, kernel, VALUE_SCHEMA)


def pair_values(cells: DataFrame, words: DataFrame, spaces: list[float]) -> DataFrame:
    """The part of a loss for each bigram of both folds; ``spaces`` are the tokens of each kind plus the size of the vocabulary."""
    firsts = words.where("after > 0").select(F.col("code").alias("u"), *[f"{x}{k}" for x in "md" for k in KINDS], F.col("after").alias("weight"))
    seconds = words.where("before > 0").select(F.col("code").alias("v"), *[f"c{k}" for k in KINDS], F.col("before").alias("weight"))
    sided = join_by_weight(join_by_weight(cells, firsts, ["u"], "weight", "v").drop("weight"), seconds, ["v"], "weight", "u")

    def kernel(batch: pa.RecordBatch):
        column = lambda name: batch.column(name).to_numpy()
        found = []
        for k, rest in zip(KINDS, rests(batch)):
            seen = np.maximum(column(f"n{k}") - DISCOUNT, 0.0) / np.maximum(column(f"m{k}"), 1)
            found.append(-np.log1p(seen / (rest * (column(f"c{k}") + 1.0) / spaces[k])))
        keys = pair_keys(column("u").view(np.uint64), column("v").view(np.uint64))
        yield batch_of(key=signed(keys), **rounded(found))

    return map_batches(sided, kernel, VALUE_SCHEMA)


def dealt(docs: DataFrame, table: WordTable | None, groups: int, hot: pd.DataFrame, unseen: np.ndarray) -> DataFrame:
    """Keys of the tokens by group, for all that is not ``hot``; what is goes into the sums of the documents at once.

    ``row`` is twice the place in the slice plus the fold, ``rid`` the number of the first row of the slice.
    """
    order = np.argsort(hot.key.to_numpy().view(np.uint64))
    keys = hot.key.to_numpy().view(np.uint64)[order]
    shared = docs.sparkSession.sparkContext.broadcast((keys, [hot[v].to_numpy().astype(np.float64)[order] for v in VALUES]))

    def kernel(batch: pa.RecordBatch):
        known, values = WordTable(shared.value[0]), shared.value[1]
        for first, stop, data, bounds in slices(batch.column("text")):
            before, now, rows = pairs(table, data, bounds)
            n, some = np.diff(rows), np.flatnonzero(np.diff(rows))
            row = np.repeat(np.arange(stop - first), n)
            fold = batch.column("fold").to_numpy()[first:stop]
            key = np.concatenate([pair_keys(before, now), word_keys(now), last_keys(now[rows[1:][some] - 1]), word_keys(np.full(len(some), START))])
            row = np.concatenate([row, row, some, some])
            number = known.numbers(key)
            at = np.flatnonzero(number >= 0)
            second = fold[row[at]] == 1
            sums = {}
            for name, a, b in (("t", 0, 2), ("b", 1, 3)):
                sums[name] = np.bincount(row[at], np.where(second, values[b][number[at]], values[a][number[at]]), stop - first)
                sums[name] += n * np.where(fold == 1, unseen[b], unseen[a])
            rid = int(batch.column("rid")[first].as_py())
            single = lambda x: pa.ListArray.from_arrays(pa.array([0, stop - first], pa.int32()), x)
            own = {"ids": single(batch.column("doc_id").slice(first, stop - first)), "n": single(pa.array(n.astype(np.int64)))}
            none = pa.array([None], pa.binary())
            yield batch_of(p=np.array([rid % groups], np.int32), rid=np.array([rid]), key=none, row=none, **own, **{k: single(pa.array(s)) for k, s in sums.items()})
            key, row = key[number < 0], row[number < 0]
            group = group_of(key, groups)
            order = np.argsort(group * (stop - first) + row)
            packed_at, packed = blobs(group[order], groups, key=key[order], row=(2 * row + fold[row])[order].astype(np.int32))
            empty = {k: pa.nulls(len(packed_at), pa.list_(pa.float64() if k in "tb" else pa.int64())) for k in ("ids", "n", "t", "b")}
            yield batch_of(p=packed_at, rid=np.full(len(packed_at), rid), **packed, **empty)

    numbered = docs.withColumn("rid", F.monotonically_increasing_id())
    return map_batches(numbered, kernel, "p int, rid long, key binary, row binary, ids array<long>, n array<long>, t array<double>, b array<double>")


FOUND = "slice long, at binary, t binary, b binary, ids array<long>, n array<long>, own_t array<double>, own_b array<double>"


def look_up(sent: pa.Table, values: pa.Table) -> pa.Table:
    """For each slice the places of its rows with their sums over the keys of one group, packed; and what slices report here."""
    keys = values.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys = keys[order]
    size = pc.fill_null(pc.binary_length(sent.column("key")), 0).to_numpy() // 8
    key, row = joined(sent, "key", np.uint64), joined(sent, "row", np.int32)
    rids = sent.column("rid").to_numpy()
    nth = np.repeat(np.arange(len(size)), size)
    at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
    hit = np.flatnonzero(keys[at] == key) if len(keys) else np.zeros(0, np.int64)
    at, second = order[at[hit]] if len(keys) else hit, row[hit] & 1 == 1
    # The rows of a slice come in order, so equal places are neighbours.
    places = (nth[hit] << 32) + (row[hit] >> 1)
    fresh = runs(places)
    back = np.repeat(np.arange(len(fresh)), np.diff(np.append(fresh, len(places))))
    places = places[fresh]
    value = [values.column(v).to_numpy().astype(np.float64) for v in VALUES]
    sums = [np.bincount(back, np.where(second, value[b][at], value[a][at]), len(places)) for a, b in ((0, 2), (1, 3))]
    some, packed = blobs(places >> 32, len(size), at=(places & 0xFFFFFFFF).astype(np.int32), t=sums[0], b=sums[1])
    lists = {"ids": pa.int64(), "n": pa.int64(), "own_t": pa.float64(), "own_b": pa.float64()}
    parts = {"slice": pa.array(rids[some]), **packed, **{k: pa.nulls(len(some), pa.list_(t)) for k, t in lists.items()}}
    own = sent.filter(sent.column("ids").is_valid())
    none = pa.nulls(own.num_rows, pa.binary())
    reports = {"slice": own.column("rid"), "at": none, "t": none, "b": none, **{k: own.column(c).cast(pa.list_(lists[k])) for k, c in zip(lists, ("ids", "n", "t", "b"))}}
    return pa.concat_tables([pa.table(parts), pa.table(reports)])


def add_up(found: pa.Table) -> pa.Table:
    """doc_id, n_tokens, t, b of the rows of one slice."""
    own = found.filter(found.column("ids").is_valid()).to_pylist()[0]
    sums = [np.array(own["own_t"], np.float64), np.array(own["own_b"], np.float64)]
    at = joined(found, "at", np.int32)
    for total, name in zip(sums, "tb"):
        np.add.at(total, at, joined(found, name, np.float64))
    return pa.table({"doc_id": pa.array(own["ids"], pa.int64()), "n_tokens": pa.array(own["n"], pa.int64()), "t": sums[0], "b": sums[1]})


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What a query has shuffled is deleted with its end: all that is read twice here is staged."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scores(docs: DataFrame, target: DataFrame, size: int | None) -> DataFrame:
    stage = Stages()
    rows = texts(docs, F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(2)).alias("fold"))
    size_of = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    groups = max(1, math.ceil(size_of / GROUP_BYTES))
    table = None if size is None else vocabulary(rows, size)
    marked = stage(matched_texts(rows, target), "learned")
    counted = [stage(count(marked, table, groups, part), "cells") for part in range(PASSES)]
    stage.release(marked)
    counts = reduce(DataFrame.unionByName, counted)
    cells = counts.where("v IS NOT NULL").select("u", "v", *[f"n{k}" for k in COUNTED])
    measured = Observation()
    totals = [F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias(f"n{k}") for k in COUNTED]
    words = word_counts(counts).observe(measured, *totals, F.count_if(F.expr("c0 + c1 + c2 + c3 > 0")).alias("words"))
    # Words that only one fold has count for the sizes alone.
    words = stage(words.where(both("c", "m")), "words")
    sizes = measured.get
    distinct = sizes["words"] if table is None else len(table.codes)
    spaces = [float(sizes[f"n{k}"] + distinct + 1) for k in KINDS]
    unseen = np.round(np.log(np.array(spaces)[list(SCORED_BY)]) * GRAIN) / GRAIN
    total = sum(sizes[f"n{k}"] for k in COUNTED)
    # The start of a text stands before a word in every document.
    hot_word = f"{occurrences('c')} * {HOT_SHARE} > {total} OR code = {START.astype(np.int64)}"
    hot_pair = f"{occurrences('n')} * {HOT_SHARE} > {total}"
    hot = word_values(words.where(hot_word)).unionByName(pair_values(cells.where(hot_pair), words, spaces))
    cold = word_values(words.where(f"NOT ({hot_word})")).unionByName(pair_values(cells.where(f"NOT ({hot_pair})"), words, spaces))
    place = F.shiftrightunsigned("key", 32) * groups
    cold = cold.withColumn("p", F.shiftrightunsigned(place, 32).cast("int"))
    cold = stage(cold, "values")
    hot = hot.toPandas()  # at most 3 times HOT_SHARE rows, and the start of a text
    stage.release(*counted, words)
    sent = dealt(rows, table, groups, hot, unseen)
    found = sent.groupBy("p").cogroup(cold.groupBy("p")).applyInArrow(look_up, FOUND)
    sums = found.groupBy("slice").applyInArrow(add_up, "doc_id long, n_tokens long, t double, b double")
    means = sums.select("doc_id", "n_tokens", *[(F.col(x) / F.greatest("n_tokens", F.lit(1))).alias(y) for x, y in (("t", "loss_target"), ("b", "loss_background"))])
    return stage.result(means.withColumn("score", F.col("loss_background") - F.col("loss_target")), "scores")


def inspect(docs: DataFrame, target: DataFrame, size: int | None = None) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background (means in nats) and score of every row."""
    with freed_shuffles(docs.sparkSession):
        return scores(docs, target, size)
