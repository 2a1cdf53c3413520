"""Suffix-array and substring dedup against brute force, crowded anchors and odd rows included."""

from __future__ import annotations

import random

import numpy as np
import pytest
from brute_windows import bytes_removed, words_removed

from cairnflow.llm import substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, cuts string, row int"


def key(row):
    return tuple((x is None, x) if not isinstance(x, str) else (False, x) for x in row)


def fixture(seed: int) -> list[tuple]:
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 4)))
    passage = " ".join(word() for _ in range(30))
    texts = [" ".join(word() for _ in range(rnd.randint(0, 60))) for _ in range(25)]
    texts += [f"{' '.join(word() for _ in range(9))} {passage}\n{' '.join(word() for _ in range(9))}" for _ in range(25)]
    texts += texts[:4] + ["la " * 80, "la " * 40, "", None, "   \n ", passage + " " + passage, "x" * 300]
    rows = [(i if i % 13 else None, t) for i, t in enumerate(texts)]
    return rows + [rows[30], (5, "another text under an id that is taken"), (40, rows[41][1])]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, len(t or ""), 1, "x", 2) for i, t in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("crowd", [2000, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed, crowd):
    rows = fixture(seed)
    found = suffix_dedup.inspect(frame(spark, rows), size=40, gram=8, crowd=crowd).collect()
    assert sorted(map(key, found)) == sorted(map(key, bytes_removed(rows, 40)))


@pytest.mark.parametrize("crowd", [2000, 3])
@pytest.mark.parametrize("seed", [3, 4])
def test_words(spark, seed, crowd):
    rows = fixture(seed)
    found = substring_dedup.inspect(frame(spark, rows), size=10, gram=3, crowd=crowd).collect()
    assert sorted(map(key, found)) == sorted(map(key, words_removed(rows, 10)))


def test_empty_tables(spark):
    assert suffix_dedup.inspect(frame(spark, [])).collect() == []
    assert substring_dedup.inspect(frame(spark, [])).collect() == []
    assert substring_dedup.remove_repeats(frame(spark, [])).collect() == []


def test_remainders_and_rewritten_texts(spark):
    shared = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"one  two\n{shared}"), (2, f"three {shared} four"), (3, shared), (4, "left\talone")]
    docs = frame(spark, rows)
    kept = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    assert substring_dedup.remove_repeats(docs).schema == docs.schema
    assert sorted(kept) == [1, 2, 4]
    assert kept[1].text == rows[0][1] and kept[4].text == "left\talone"
    assert kept[2].text == "three four" and kept[2].n_chars == 10
    assert {r.doc_id: bytes(r.kept) for r in suffix_dedup.remainders(docs).collect()}[4] == b"left\talone"


def test_common_prefixes_of_a_collection():
    rnd = random.Random(5)
    for _ in range(20):
        strings = [bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 30))) for _ in range(rnd.randint(1, 9))]
        suffixes = sorted((s[k:], i) for i, s in enumerate(strings) for k in range(len(s) + 1))
        shared = [0]
        for (a, _), (b, _) in zip(suffixes, suffixes[1:]):
            shared.append(next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))))
        assert suffix_dedup.column_wise([np.frombuffer(s, np.uint8) for s in strings], 99)[1].tolist() == shared


def test_parts_of_a_tree_are_bounded_and_whole():
    symbols = np.array([0, 1, 0, 1, 0, 1, 2, 0, 1, 0, 1, 3] * 20)
    starts = np.arange(len(symbols) - 10)
    parts = substring_dedup.prefix_parts(symbols, starts, 10, most=30)
    assert sorted(np.concatenate([m for _, m in parts])) == starts.tolist()
    for length, members in parts:
        assert len({tuple(symbols[m : m + length]) for m in members}) == 1
        assert len(members) <= 30 or length == 10
