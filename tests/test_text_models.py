"""Cleaning rules, the word-count classifier and the projecting encoder against plain computations."""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnflow.operators import classify, cleaning, encode

WORD = re.compile(r"\w{2,}")


def test_cleaning_equals_brute_force(spark):
    rnd = random.Random(2)
    common = ["All rights reserved.", "Subscribe to café news", "  Share this  "]
    rows = []
    for i in range(120):
        lines = [f"line {rnd.randrange(10**6)} of text" for _ in range(rnd.randint(0, 4))]
        lines += [line for line in common if rnd.random() < 0.7]
        lines += ["rare footer"] * (i % 3 == 0) + ["", "   "]
        rnd.shuffle(lines)
        rows.append((i % 100, "\n".join(lines), "x"))
    rows += [(None, None, "y"), (500, "", "y"), (501, "Subscribe to café news", "y"), (502, "é" * 50_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, clean_text string").drop("clean_text").withColumn("reason", F.lit("old")).drop("reason")
    got = cleaning.clean_documents(docs.repartition(4), min_length=20, share=0.5)
    assert got.columns == ["doc_id", "text", "clean_text", "removed_lines", "reason"]
    texts = [unicodedata.normalize("NFC", t or "") for _, t, _ in rows]
    counts = Counter(line for t in texts for line in {x.strip(" ") for x in t.split("\n")} - {""})
    often = {line for line, n in counts.items() if n > 0.5 * len(texts) and n >= 10}
    assert often == {"All rights reserved.", "Subscribe to café news", "Share this"}
    want = []
    for (i, t, _), text in zip(rows, texts):
        kept = [line for line in text.split("\n") if line.strip(" ") not in often]
        clean = "\n".join(kept)
        size = len(clean.strip(" \t\r\n"))
        want.append((i, t, clean, len(text.split("\n")) - len(kept), "empty" if not size else "too short" if size < 20 else None))
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)
    assert cleaning.clean_documents(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        cleaning.boilerplate(docs, share=1.0)


def items(spark, rows):
    return spark.createDataFrame(rows, "id long, document_text string, is_problem boolean")


def test_word_counts_classify_as_plain_bayes(spark):
    rnd = random.Random(5)
    pool = {True: ["wish", "slow", "broken", "manual", "the"], False: ["release", "new", "shipped", "the", "blog"]}
    rows = []
    for i in range(150):
        side = rnd.random() < 0.4
        rows.append((i, " ".join(rnd.choice(pool[side] if rnd.random() < 0.8 else pool[not side]) for _ in range(rnd.randint(0, 12))), side if i % 2 else None))
    rows += [(900, None, None), (901, "", True), (902, "unknown wordings", None)]
    table = items(spark, rows)
    learned = [(t, e) for _, t, e in rows if e is not None]
    got = {r.id: r for r in classify.classify_by_counts(table, table.filter("is_problem IS NOT NULL").select("document_text", F.col("is_problem").alias("expected"))).collect()}
    counts = {side: Counter(w for t, e in learned if e == side for w in WORD.findall((t or "").lower())) for side in (True, False)}
    vocabulary = set(counts[True]) | set(counts[False])
    size = {side: sum(counts[side].values()) + len(vocabulary) for side in counts}
    prior = math.log((sum(e for _, e in learned) + 1) / (sum(not e for _, e in learned) + 1))
    for i, t, _ in rows:
        total = prior + sum(
            math.log((counts[True][w] + 1) / size[True]) - math.log((counts[False][w] + 1) / size[False]) for w in WORD.findall((t or "").lower()) if w in vocabulary
        )
        assert got[i].is_problem == (total >= 0) and math.isclose(got[i].problem_confidence, 1 / (1 + math.exp(-abs(total))), rel_tol=1e-9)
    assert len(got) == len(rows)


def test_projection_keeps_cosines(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(f"w{int(rnd.paretovariate(0.6)) % 3000}" for _ in range(rnd.randint(20, 200))), True) for i in range(60)] + [(70, "a b c", True), (71, "not one", False)]
    table = items(spark, rows)
    weights = {}
    for r in encode.document_weights(table.filter("is_problem")).collect():
        weights.setdefault(r.id, {})[r.term] = r.weight
    size = 512
    found = {r.id: np.array(r.embedding, float) for r in encode.encode_by_projection(table, size).collect()}
    assert set(found) == {i for i, _, p in rows if p} and all(math.isclose(np.linalg.norm(v), 1, rel_tol=1e-5) for v in found.values())
    assert found[70][0] == 1
    errors = []
    for a in range(60):
        for b in range(a):
            dot = sum(weights[a].get(t, 0) * w for t, w in weights[b].items())
            true = dot / math.sqrt(sum(w * w for w in weights[a].values()) * sum(w * w for w in weights[b].values()))
            errors.append(found[a] @ found[b] - true)
    assert np.sqrt(np.mean(np.square(errors))) < 1.5 / math.sqrt(size) and abs(np.mean(errors)) < 0.01
