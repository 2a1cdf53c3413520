"""Quality rules, decontamination, mixing and the pipeline against brute force; odd rows included."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from brute_windows import SPACED, words_removed
from test_near_dedup import brute_classes

import corpus_pipeline
from cairnflow.llm import decontamination, mixing, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string, bits int, size string, turn int"
NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def key(row):
    return tuple((x is None, x) if not isinstance(x, str) else (False, x) for x in row)


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), True, "r", 1, "s", 2) for i, t, s in rows], schema).repartition(3)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def brute_counts(text):
    words = SPACED.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    hit = [False] * len(words)
    for k in range(len(words) - 2):
        if grams[tuple(words[k : k + 3])] > 1:
            hit[k : k + 3] = [True] * 3
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, sum(hit)


def prose(rnd, n, vocabulary=400):
    return " ".join(f"{rnd.choice('abcdé')}{rnd.randrange(vocabulary)}" for _ in range(n))


def rule_rows():
    rnd = random.Random(1)
    texts = [prose(rnd, rnd.randint(0, 200)) for _ in range(60)]
    texts += [f"{prose(rnd, 20)}\n\n{prose(rnd, 3)}\nsame line\nsame line\n \n \n{prose(rnd, 30)}" for _ in range(10)]
    texts += ["# * $ % & | < > ", "a b c a b c", "\n\n", "", None, "une é 　 fin", "w " * 300]
    return [(i if i % 9 else None, t, "s") for i, t in enumerate(texts)] + [(3, texts[3], "s"), (3, "other", None)]


def test_rule_counts(spark):
    rows = rule_rows()
    found = quality_rules.judge(frame(spark, rows), labels(spark, [])).collect()
    want = []
    for i, t, _ in rows:
        c = brute_counts(t)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        want.append((i, *c, failed, not failed))
    assert sorted(key(tuple(r)[:8]) for r in found) == sorted(map(key, want))


def test_forest_rejects_labelled_junk_and_keeps_the_rest(spark):
    rnd = random.Random(2)
    rows = [(i, prose(rnd, rnd.randint(60, 150)), "s") for i in range(400)]
    rows += [(400 + i, " ".join(f"{w}%%%" for w in prose(rnd, 80).split()), "s") for i in range(40)]
    docs, marks = frame(spark, rows), labels(spark, [(i, int(i < 400), 0) for i in range(0, 440, 2)] + [(0, None, 0), (None, 1, 0)])
    judged = {r.doc_id: r.kept for r in quality_rules.judge(docs, marks).collect()}
    assert sum(judged[i] for i in range(400)) >= 390 and sum(judged[i] for i in range(400, 440)) <= 4
    kept = quality_rules.keep_good(docs, marks)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {i for i, k in judged.items() if k}


def test_path_lengths_of_a_forest():
    rng = np.random.default_rng(1)
    rows = np.vstack([rng.normal(size=(500, 3)), [[9.0, 9.0, 9.0]]])
    scores = quality_rules.fit_forest(rows, 50, 128).scores(rows)
    assert scores.argmax() == 500 and 0 < scores.min() < 0.5 < scores.max() < 1


def brute_hits(rows, items, window=13):
    wins = {}
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    for i, t in items:
        words = NORMAL.findall(lower(t))
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            wins.setdefault(tuple(words[k : k + size]), set()).add("" if i is None else str(i))
    out = []
    for i, t, _ in rows:
        words = NORMAL.findall(lower(t))
        hit, names = [False] * len(words), set()
        for size in {len(w) for w in wins}:
            for k in range(len(words) - size + 1):
                if (name := wins.get(tuple(words[k : k + size]))) is not None:
                    names |= name
                    hit[k : k + size] = [True] * size
        n, h = len(words), sum(hit)
        out.append((i, n, h, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), h > 0 and 20 * h >= n))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_contamination(spark, block_bytes):
    rnd = random.Random(3)
    items = [(i, prose(rnd, rnd.choice([2, 5, 13, 30]), 30)) for i in range(12)] + [(90, "A-b C"), (91, "x"), (92, ""), (93, None), (None, "no id here"), (5, prose(rnd, 15))]
    texts = [prose(rnd, rnd.randint(0, 300), 30) for _ in range(40)]
    texts += [f"{prose(rnd, 30)} {items[k][1].upper()} {prose(rnd, 500)} {items[k + 1][1]}" for k in range(0, 11)]
    texts += ["", None, "a b c", "x", "X y", "no id here", items[3][1] + items[4][1], prose(rnd, 9) + "-" + items[3][1]]
    rows = [(i if i % 11 else None, t, None) for i, t in enumerate(texts)] + [(1, texts[45], "s")] * 2
    docs, tests = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.inspect(docs, tests, block_bytes=block_bytes).collect()
    want = brute_hits(rows, items)
    assert sorted(map(key, found)) == sorted(map(key, want))
    kept = decontamination.drop_contaminated(docs, tests, block_bytes=block_bytes)
    assert kept.schema == docs.schema
    assert sorted(key((r.doc_id, r.text)) for r in kept.collect()) == sorted(key((i, t)) for (i, t, _), w in zip(rows, want) if not w[5])


def test_cut_passages(spark):
    items = spark.createDataFrame([(1, "red green blue"), (2, "one")], "item_id long, text string")
    rows = [(1, "So: Red, green -- BLUE! end", None), (2, "a one b", None), (3, "nothing", None), (4, None, None)]
    cut = {r.doc_id: r.text for r in decontamination.cut_passages(frame(spark, rows), items).collect()}
    assert cut == {1: "So: ! end", 2: "a  b", 3: "nothing", 4: None}


def test_no_test_items(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    found = decontamination.inspect(frame(spark, [(1, "a b", "s")]), none).collect()
    assert [tuple(r)[:4] for r in found] == [(1, 2, 0, 0)]
    assert decontamination.inspect(frame(spark, []), none).collect() == []


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mix(spark):
    rnd = random.Random(4)
    rows = [(i, prose(rnd, rnd.randint(0, 40)), rnd.choice(["a", "a", "a", "B", "c", "d", None])) for i in range(300)]
    rows += [(None, "no id", "a"), (1, None, "a"), (7, "", "empty"), (8, None, "empty"), (2, "one two", "tiny"), (2, "one two", "tiny")]
    docs = frame(spark, rows)
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    assert sorted(map(key, found)) == sorted(map(key, mixing.mix(docs.repartition(5)).collect()))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(SPACED.findall(t or ""))
    targets = brute_targets(dict(sizes))
    taken, largest = Counter(), Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-5
        assert r.size == 0 and r.taken == 0 or r.taken % r.size == 0 and r.taken <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert targets[s] - largest[s] - 1e-6 <= taken[s] <= targets[s] + 1e-6
    rows_taken = mixing.mixed(docs)
    assert rows_taken.columns == [*docs.columns, "mix_pass", "mix_finish"]
    got = rows_taken.collect()
    assert len(got) == sum(r.taken // r.size for r in found if r.size)
    assert [r.mix_finish for r in got] == sorted(r.mix_finish for r in got)
    assert mixing.mix(frame(spark, [])).collect() == [] and mixing.mixed(frame(spark, [])).collect() == []


def test_pipeline_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name, d: stages[name](spark, d, folder).collect()
    judged = {r.doc_id: r for r in quality_rules.judge(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    good = step("quality rules", docs)
    assert {r.doc_id for r in good} == {i for i, r in judged.items() if r.kept}
    frames = spark.createDataFrame(good, docs.schema)
    single = step("near-duplicates", frames)
    groups = brute_classes([(r.doc_id, r.text) for r in good])
    assert {r.doc_id for r in single} == {min(good[i].doc_id for i in g) for g in groups}
    frames = spark.createDataFrame(single, docs.schema)
    lean = step("substring dedup", frames)
    want = {w[0]: w for w in words_removed([(r.doc_id, r.text) for r in single], 50)}
    assert {r.doc_id for r in lean} == {i for i, w in want.items() if w[2] < w[1] or not w[1]}
    for r in lean:
        assert hashlib.sha256(" ".join(SPACED.findall(r.text)).encode()).hexdigest() == want[r.doc_id][3]
    frames = spark.createDataFrame(lean, docs.schema)
    clean = step("decontamination", frames)
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    assert {r.doc_id for r in clean} == {w[0] for w in brute_hits([(r.doc_id, r.text, None) for r in lean], items) if not w[5]}
    mix = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in mix} <= {r.doc_id for r in clean} and len(mix) > 0
    assert max(Counter(r.doc_id for r in mix).values()) <= 3
