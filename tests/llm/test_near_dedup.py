"""BagMinHash near-dedup: unbiased signatures, and classes against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from brute_windows import SPACED

from cairnflow.llm import near_dedup
from cairnflow.llm.text import buffers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, class string, n int"


def bag(text):
    words = SPACED.findall(text or "")
    if 0 < len(words) < 5:
        return Counter([tuple(words)])
    return Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def brute_classes(rows, similarity=0.8):
    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = bags[i], bags[j]
            if a and b and sum((a & b).values()) >= similarity * sum((a | b).values()) - 1e-9:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return {frozenset(g) for g in groups.values()}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), 7, "c", 1) for i, t in rows], SCHEMA).repartition(3)


def varied(rnd, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rnd.randrange(len(out))] = f"z{rnd.randrange(10**6)}"
    return " ".join(out)


def fixture(seed):
    rnd = random.Random(seed)
    texts = []
    for _ in range(12):
        words = [f"w{rnd.randrange(300)}" for _ in range(rnd.randint(30, 150))]
        texts += [varied(rnd, words, rnd.randint(0, 3)) for _ in range(rnd.randint(1, 8))]
    # A hub that is near to many which are not near to each other.
    words = [f"h{k}" for k in range(160)]
    texts += [" ".join(words)] + [varied(rnd, words, 3) for _ in range(25)]
    texts += ["la " * 400, "la " * 390, "la " * 100, "one", "one", "two words", "", None, "  \n"]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_classes_equal_brute_force(spark):
    for seed in (1, 2):
        rows = fixture(seed)
        found = near_dedup.inspect(frame(spark, rows)).collect()
        groups = {}
        for r in found:
            groups.setdefault(r.class_id, []).append(r.doc_id)
        assert {frozenset(g) for g in groups.values()} == brute_classes(rows)
        assert all(min(g) == c for c, g in groups.items())
        assert {r.doc_id: r.class_size for r in found} == {i: len(g) for g in groups.values() for i in g}


def test_one_row_of_each_class_stays_with_its_columns(spark):
    rows = fixture(3) + [(0, fixture(3)[0][1]), (None, "one"), (None, None)]
    docs = frame(spark, rows)
    kept = near_dedup.keep_first(docs)
    assert kept.schema == docs.schema
    # The repeated row and the row without id are copies; the two texts without words are alone.
    assert kept.count() == len(brute_classes(rows))


def test_empty_table(spark):
    assert near_dedup.inspect(frame(spark, [])).collect() == []
    assert near_dedup.keep_first(frame(spark, [])).collect() == []


def test_signatures_are_unbiased_for_weights():
    rnd = random.Random(4)
    texts, exact = [], []
    for _ in range(150):
        words = [rnd.choice("abc") for _ in range(60)] + ["x"] * rnd.randint(1, 50) + [rnd.choice("pqrstu") for _ in range(80)]
        other = varied(rnd, words, rnd.randint(0, 9))
        texts += [" ".join(words), other]
        a, b = bag(texts[-2]), bag(other)
        exact.append(sum((a & b).values()) / sum((a | b).values()))
    row, code, weight = near_dedup.weighted(*near_dedup.shingles(*buffers(pa.array(texts))))
    found = near_dedup.signatures(row, code, weight, len(texts))
    assert np.isfinite(found).all()
    error = (found[::2] == found[1::2]).mean(1) - np.array(exact)
    assert abs(error.mean()) < 0.01 and error.std() < 0.05


def similar_pairs(bags, similarity):
    """All pairs of at least this similarity: two such sets share one of the rarest elements of either."""
    sets = [frozenset((s, k) for s, n in b.items() for k in range(n)) for b in bags]
    often = Counter(e for s in sets for e in s)
    index = defaultdict(list)
    for i, mine in enumerate(sets):
        near = set()
        for e in sorted(mine, key=lambda e: (often[e], e))[: len(mine) - math.ceil(similarity * len(mine)) + 1]:
            near.update(index[e])
            index[e].append(i)
        yield from ((j, i) for j in near if len(mine & sets[j]) >= similarity * len(mine | sets[j]) - 1e-9)


def test_no_similar_pair_of_the_test_data_is_missed(spark):
    folder = Path("/root/testdata/sf0.01")
    if not folder.exists():
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, bag(r.text)) for r in docs.select("doc_id", "text").collect()]
    rows = [(i, b) for i, b in rows if b]
    found = {r.doc_id: r.class_id for r in near_dedup.inspect(docs).collect()}
    pairs = [(rows[a][0], rows[b][0]) for a, b in similar_pairs([b for _, b in rows], 0.8)]
    assert len(pairs) > 50 and all(found[a] == found[b] for a, b in pairs)
