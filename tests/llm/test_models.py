"""LM scoring, language identification and the two classifiers: held-out accuracy, brute force, odd rows."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from cairnflow.llm import language_id, lm_scoring, quality_ranking, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, kind int, fold long, held_out boolean"


def frame(spark, rows):
    """Rows of (doc_id, text, lang) with columns named like the operators' own."""
    return spark.createDataFrame([(i, t, g, "s", len(t or ""), 0.5, 1, 2, 3, True) for i, t, g in rows], SCHEMA).repartition(3)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


ODD = [(None, "no id", None), (9001, None, None), (9002, "", "en"), (9003, " 123 \n", "en"), (9004, "x" * 60000, None), (1, "again", "en"), (1, "again", "en")]
NONE = "doc_id long, quality int, toxic int"


def words(rnd, letters, n):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(n))


def learned_rows(docs, marks):
    """(text, kind) of the documents that the matched models learn from."""
    rows = docs.selectExpr("doc_id", "text", "pmod(xxhash64(text), 2) AS fold")
    return [(r.text, r.kind) for r in lm_scoring.matched_texts(rows, marks).collect() if r.kind < 4]


def test_matched_models_separate_a_planted_domain_and_do_not_favour_noise(spark):
    rnd = random.Random(8)
    draw = lambda pool, n: " ".join(rnd.choice(pool) for _ in range(n))
    phrases = [draw([f"w{i}" for i in range(400)], 5) for _ in range(600)]
    domain, other = phrases[:300], phrases[300:]
    rows = [(i, draw(domain if i % 4 == 0 else other, rnd.randint(5, 30)), None) for i in range(800)]
    noise = [(1000 + i, " ".join(f"z{rnd.randrange(10**6)}" for _ in range(40)), None) for i in range(60)]
    docs = frame(spark, [*rows, *noise])
    marks = labels(spark, [(i, 1, 0) for i in range(0, 400, 4)])
    learned = learned_rows(docs, marks)
    size = [sum(len(t.encode()) for t, kind in learned if kind % 2 == side) for side in (0, 1)]
    assert 0.8 < size[0] / size[1] < 1.25 and sum(kind % 2 for _, kind in learned) == 100
    score = {r.doc_id: r.score for r in lm_scoring.inspect(docs, marks).collect()}
    held = [score[i] for i in range(400, 800, 4)]
    rest = [score[i] for i, *_ in rows if i % 4]
    assert sum(a > b for a in held for b in rest) >= 0.99 * len(held) * len(rest)
    assert sum(a > score[i] for a in held for i, *_ in noise) >= 0.9 * len(held) * len(noise)


def test_languages_of_held_out_and_mixed_texts(spark):
    rnd = random.Random(1)
    sets = {"aa": "abcdeio", "bb": "stuvwzo", "gr": "αβγδεζη"}
    rows = [(i, words(rnd, sets[g], rnd.randint(3, 40)), g) for i in range(300) for g in [rnd.choice([*sets])]]
    mixed = (7777, words(rnd, sets["aa"], 10) + " " + words(rnd, sets["gr"], 30), "gr")
    found = {r.doc_id: r for r in language_id.inspect(frame(spark, [*rows, mixed, *ODD])).collect()}
    assert len(found) == len({i for i, _, _ in [*rows, mixed, *ODD]})
    held = [(i, g) for i, _, g in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(found[i].held_out for i, _ in held) and not found[None].held_out
    assert sum(found[i].lang_pred == g for i, g in held) >= 0.97 * len(held)
    assert found[7777].lang_pred == "gr" and 0.6 < found[7777].score < 0.9 and found[7777].n_spans == 2
    assert [found[i].lang_pred for i in (9001, 9002, 9003)] == ["und"] * 3 and found[9001].score == 0
    spans = [r for r in language_id.spans(frame(spark, [*rows, mixed])).collect() if r.doc_id == 7777]
    assert " ".join(r.text for r in sorted(spans, key=lambda r: r.nth)) == mixed[1]


def test_no_languages_to_learn_from(spark):
    found = language_id.inspect(frame(spark, [(i, "some text", None) for i in range(9)])).collect()
    assert {(r.lang_pred, r.score) for r in found} == {("und", 0.0)}
    assert language_id.inspect(frame(spark, [])).collect() == []


def test_viterbi_equals_trying_all_labels():
    rng = np.random.default_rng(1)
    score = rng.normal(0, 3, (13, 3))
    rows = np.array([0, 5, 5, 6, 13])
    label = language_id.decode(score, rows, 2.5)
    value = lambda path, part: part[np.arange(len(path)), path].sum() - 2.5 * sum(a != b for a, b in zip(path, path[1:]))
    for a, b in zip(rows[:-1], rows[1:]):
        if b > a:
            best = max(value(p, score[a:b]) for p in product(range(3), repeat=b - a))
            assert math.isclose(value(tuple(label[a:b]), score[a:b]), best)


def test_ranking_separates_held_out_labels(spark):
    rnd = random.Random(2)
    good = lambda: words(rnd, "abcdefgh", rnd.randint(60, 120)).capitalize() + "."
    rows = [(i, good() if i % 4 else good().upper().replace(" ", "!! # "), None) for i in range(400)]
    marks = [(i, int(i % 4 > 0), 0) for i in range(400)] + [(None, 1, 0), (5, None, None), (6, 1, 1)]
    found = {r.doc_id: r for r in quality_ranking.inspect(frame(spark, rows + ODD), labels(spark, marks)).collect()}
    held = [i for i in range(2, 400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(found[i].held_out for i in held)
    assert sum(found[i].predicted == int(i % 4 > 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found.values())


def test_toxic_terms_and_their_company(spark):
    rnd = random.Random(3)
    rows, marks = [], []
    for i in range(600):
        text = words(rnd, "abcdefgh", rnd.randint(20, 60)).split()
        insult, group = i % 2 == 0, i % 3 == 0
        text[3:3] = ["zonk" + rnd.choice(["", "er", "ing"])] * insult + ["wibbles"] * group
        rows.append((i, " ".join(text), None))
        marks.append((i, 1, int(insult and group)))
    found = {r.doc_id: r for r in toxicity.inspect(frame(spark, rows + ODD), labels(spark, marks)).collect()}
    held = [i for i in range(2, 600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(found[i].predicted == marks[i][2] for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.values())


def test_machine_equals_a_sum_over_pairs_and_its_loss_falls():
    rng = np.random.default_rng(3)
    texts = [sorted(rng.choice(12, rng.integers(0, 9), replace=False)) for _ in range(200)]
    label = np.array([float({2, 5} <= set(t) or 9 in t) for t in texts])
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    term = np.concatenate(texts).astype(np.int64)
    losses = []
    for epochs in (0, 5, 200):
        machine = toxicity.fit_machine(np.arange(12), 12, row, term, label, epochs)
        plain = []
        for t in texts:
            value = machine.bias + sum(machine.weights[a] for a in t)
            value += sum(float(machine.factors[a] @ machine.factors[b]) for n, a in enumerate(t) for b in t[n + 1 :])
            plain.append(value)
        assert np.allclose(machine.raw(row, term, len(texts)), plain)
        losses.append(np.mean(np.logaddexp(0, np.where(label == 1, -1, 1) * np.array(plain))))
    assert losses[0] > losses[1] > losses[2] and losses[2] < 0.1


def test_terms_equal_a_plain_cut_of_words():
    """Every word and its beginnings of 3 to 6 bytes, each bucket once a text, whatever the batch around it."""
    rnd = random.Random(5)
    rows = [words(rnd, "abCD", rnd.randint(0, 8)) for _ in range(30)]
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    bounds = np.cumsum([0, *(len(t) for t in rows)])
    row, bucket = toxicity.terms(data, bounds)
    for i, text in enumerate(rows):
        parts = {(w, 0) for w in text.lower().split()} | {(w[:n], n) for w in text.lower().split() for n in (3, 4, 5, 6) if len(w) >= n}
        alone = toxicity.terms(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[1]
        assert sorted(bucket[row == i]) == sorted(alone) and len(alone) <= len(parts)
        assert len(alone) >= len(parts) - 1, "two terms of so few should hardly ever share a bucket"


def test_terms_beyond_a_thousand_are_learned(spark):
    """1,500 insults, each too rare to matter alone in a list of the 1,024 strongest."""
    rnd = random.Random(11)
    insults = ["q" + "".join(rnd.choice("uvwxyz") for _ in range(9)) for _ in range(1500)]
    texts = [" ".join([*(rnd.choice(insults) for _ in range(12)), words(rnd, "abcdefgh", 5)]) if i % 2 else words(rnd, "abcdefgh", 15) for i in range(3000)]
    docs = frame(spark, [(i, t, None) for i, t in enumerate(texts)])
    marks = labels(spark, [(i, 1, i % 2) for i in range(3000)])
    machine = toxicity.learn(docs, marks)
    assert len(machine.weights) > 1024
    found = toxicity.inspect(docs, marks).where("held_out").collect()
    assert sum(r.predicted == r.doc_id % 2 for r in found) >= 0.98 * len(found)


def test_ranker_equals_plain_gradient_descent():
    rng = np.random.default_rng(9)
    label = rng.integers(0, 2, 120)
    rows = rng.normal(size=(120, 3)) + label[:, None] * np.array([0.8, -0.5, 0.0])
    ranker = quality_ranking.fit_ranker(rows, label, pairs=500, seed=4)
    x = (rows - rows.mean(0)) / rows.std(0)
    draw = np.random.default_rng(4)
    gap = x[draw.choice(np.flatnonzero(label == 1), 500)] - x[draw.choice(np.flatnonzero(label == 0), 500)]
    weights = np.zeros(3)
    for _ in range(3000):
        slope = quality_ranking.RIDGE * weights - (gap / (1 + np.exp(gap @ weights))[:, None]).mean(0)
        weights = weights - 0.5 * slope
    assert np.allclose(ranker.weights, weights, atol=1e-4)
    raw = x @ weights
    cuts = sorted(np.quantile(raw, k / quality_ranking.QUANTILES) for k in range(1, quality_ranking.QUANTILES))
    gains = [np.mean(raw[label == 1] >= c) - np.mean(raw[label == 0] >= c) for c in cuts]
    best = [c for c, g in zip(cuts, gains) if g >= max(gains) - 1e-12]
    assert abs(ranker.threshold - np.mean(best)) < 1e-2
    assert ((ranker.scores(rows) >= quality_ranking.CUT) == (ranker.raw(rows) >= ranker.threshold)).mean() > 0.99


@pytest.mark.parametrize("module", [quality_ranking, toxicity])
def test_classifiers_without_labels_or_rows(spark, module):
    none = spark.createDataFrame([], NONE)
    assert module.inspect(frame(spark, []), none).collect() == []
    found = module.inspect(frame(spark, [(1, "a b", None), (2, None, None)]), none).collect()
    assert len({r.score for r in found}) == 1
    one = labels(spark, [(1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 1), (6, 1, 1)])
    assert len(module.inspect(frame(spark, [(i, "a b", None) for i in range(1, 7)]), one).collect()) == 6


def test_losses_equal_a_plain_model(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["red", "green", "blue", "Pink", "x9"]) for _ in range(rnd.randint(0, 30))), None) for i in range(60)] + ODD[:4]
    target = {i for i in range(0, 60, 2)}
    docs = frame(spark, rows)
    found = {r.doc_id: r for r in lm_scoring.inspect(docs, labels(spark, [(i, 1, 0) for i in target] + [(None, 1, 0)]), 4).collect()}
    folds = {r.doc_id: r.f for r in docs.selectExpr("doc_id", "pmod(xxhash64(text), 2) AS f").collect()}
    learned = learned_rows(docs, labels(spark, [(i, 1, 0) for i in target] + [(None, 1, 0)]))
    split = lambda t: [w for w in "".join(c.lower() if c.isalnum() else " " for c in (t or "")).split()]
    counts = Counter(w for _, t, _ in rows for w in split(t))
    top = [w for w, _ in counts.most_common(4)]
    assert counts.most_common(5)[3][1] > counts.most_common(5)[4][1], "the fixture must have no tie at the edge"
    paired = lambda t: [(a if a in top or a == "^" else "?", b if b in top else "?") for a, b in zip(["^", *split(t)], split(t))]
    pairs = {i: paired(t) for i, t, _ in rows}

    def loss(fold, wanted, pair):
        seen = Counter(p for t, kind in learned if kind == 2 * (1 - fold) + wanted for p in paired(t))
        single = Counter()
        for (_, b), n in seen.items():
            single[b] += n
        unigram = (single[pair[1]] + 1) / (sum(seen.values()) + 5)
        after = {p: n for p, n in seen.items() if p[0] == pair[0]}
        total = sum(after.values())
        if not total:
            return -math.log(unigram)
        return -math.log(max(after.get(pair, 0) - 0.75, 0) / total + 0.75 * len(after) / total * unigram)

    for i, _, _ in rows:
        n = len(pairs[i])
        assert found[i].n_tokens == n
        for name, wanted in (("loss_target", True), ("loss_background", False)):
            want = sum(loss(folds[i], wanted, p) for p in pairs[i]) / n if n else 0.0
            assert abs(found[i][name] - want) < 1e-4
        assert abs(found[i].score - (found[i].loss_background - found[i].loss_target)) < 1e-9
    assert lm_scoring.inspect(frame(spark, []), labels(spark, [])).collect() == []


@pytest.mark.parametrize("hot", [4, 1 << 16])
def test_losses_of_every_word(spark, monkeypatch, hot):
    """More words than any fixed vocabulary, in several groups of keys, with few and with all keys broadcast."""
    monkeypatch.setattr(lm_scoring, "HOT_SHARE", hot)
    monkeypatch.setattr(lm_scoring, "GROUP_BYTES", 5000)
    monkeypatch.setattr(lm_scoring, "HELD_PAIRS", 1000)
    rnd = random.Random(6)
    draw = lambda: "the" if rnd.random() < 0.3 else f"w{rnd.randrange(3000)}"
    phrases = [" ".join(draw() for _ in range(4)) for _ in range(1200)]
    rows = [(i, " ".join(rnd.choice(phrases) for _ in range(rnd.randint(0, 15))), None) for i in range(200)] + ODD
    target = {i for i in range(0, 200, 2)}
    docs = frame(spark, rows)
    marks = labels(spark, [(i, 1, 0) for i in target])
    found = lm_scoring.inspect(docs, marks).collect()
    learned = learned_rows(docs, marks)
    folds = {r.text: r.f for r in docs.selectExpr("text", "pmod(xxhash64(text), 2) AS f").collect()}
    split = lambda t: "".join(c.lower() if c.isalnum() else " " for c in (t or "")).split()
    size = len({w for t, _ in learned for w in split(t)})
    assert size > 1024
    models = {}
    for fold, wanted in product((0, 1), (True, False)):
        seen = Counter(p for t, kind in learned if kind == 2 * (1 - fold) + wanted for p in zip(["^", *split(t)], split(t)))
        single, after, kinds = Counter(), Counter(), Counter()
        for (a, b), n in seen.items():
            single[b] += n
            after[a] += n
            kinds[a] += 1
        models[fold, wanted] = seen, single, after, kinds

    def loss(text, wanted):
        seen, single, after, kinds = models[folds[text], wanted]
        total = 0.0
        for a, b in zip(["^", *split(text)], split(text)):
            unigram = (single[b] + 1) / (sum(single.values()) + size + 1)
            total -= math.log((max(seen[a, b] - 0.75, 0) + 0.75 * kinds[a] * unigram) / after[a] if after[a] else unigram)
        return total / max(len(split(text)), 1)

    want = sorted((i is None, i or 0, len(split(t)), loss(t, True), loss(t, False)) for i, t, _ in rows)
    have = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.loss_target, r.loss_background) for r in found)
    assert [w[:3] for w in want] == [h[:3] for h in have]
    assert np.allclose([w[3:] for w in want], [h[3:] for h in have], atol=1e-4)
