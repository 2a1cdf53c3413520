"""Texts longer than a slice, empty tables and tables without labels, for the operators on documents and the pipeline."""

from __future__ import annotations

import hashlib
import random

import pytest

import corpus_pipeline
from cairnflow.llm import decontamination, mixing, near_dedup, quality_rules, substring_dedup, suffix_dedup
from cairnflow.llm.text import slices

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row int, size long"
LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id string, text string"
ITEM = " ".join(f"item{i}" for i in range(13))
PASSAGE = " ".join(f"shared{i}" for i in range(60))


def word(i):
    return f"w{i:x}"


LONG = " ".join([*(word(i) for i in range(250_000)), PASSAGE, ITEM, *(word(i) for i in range(250_000, 300_000))])
OTHER = " ".join([*(f"o{i}" for i in range(80)), PASSAGE, *(f"p{i}" for i in range(80))])
TEXTS = [(1, LONG), (2, OTHER), (3, None), (4, ""), (5, LONG)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, f"s{i % 2}", len(t or ""), 3, 4) for i, t in TEXTS], DOCS).repartition(2)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([("a", ITEM), ("b", "not in any of the texts"), ("c", None), (None, "")], ITEMS)


def rows(frame):
    return {r.doc_id: r for r in frame.collect()}


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_the_long_text_is_longer_than_a_slice():
    import pyarrow as pa

    assert len(LONG) > 2_000_000 and len(list(slices(pa.array([LONG, OTHER, LONG])))) > 1


def test_substring_dedup(docs):
    found = rows(substring_dedup.inspect(docs))
    size = len(LONG.split())
    assert (found[1].n_words, found[1].n_removed, found[1].kept_sha256) == (size, 0, digest(LONG))
    assert (found[5].n_words, found[5].n_removed, found[5].kept_sha256) == (size, size, digest(""))
    assert (found[2].n_removed, found[2].kept_sha256) == (60, digest(OTHER.replace(PASSAGE + " ", "")))
    assert [found[i].n_words for i in (3, 4)] == [0, 0]


def test_suffix_dedup(docs):
    found = rows(suffix_dedup.inspect(docs))
    for i in (1, 5):
        assert (found[i].n_bytes, found[i].n_removed, found[i].n_spans, found[i].kept_sha256) == (len(LONG), len(LONG), 1, digest(""))
    # The passage with the blanks around it: what follows differs.
    assert (found[2].n_removed, found[2].kept_sha256) == (len(PASSAGE) + 2, digest(OTHER.replace(f" {PASSAGE} ", "")))
    assert [(found[i].n_bytes, found[i].n_spans) for i in (3, 4)] == [(0, 0)] * 2


def test_decontamination(docs, items):
    found = rows(decontamination.inspect(docs, items))
    for i in (1, 5):
        assert (found[i].n_words, found[i].n_hit, found[i].n_items, found[i].contaminated) == (len(LONG.split()), 13, 1, False)
        assert found[i].items_sha256 == digest("a")
    assert [(found[i].n_hit, found[i].contaminated) for i in (2, 3, 4)] == [(0, False)] * 3


def test_quality_rules(spark, docs):
    found = rows(quality_rules.judge(docs, spark.createDataFrame([], LABELS)))
    assert [found[1][c] for c in quality_rules.COUNTS] == [len(LONG.split()), len(LONG.replace(" ", "")), 0, 0, 0]
    assert {i: r.kept for i, r in found.items()} == {1: True, 2: True, 3: False, 4: False, 5: True}


def test_near_duplicates(docs):
    found = rows(near_dedup.inspect(docs))
    assert {i: (r.class_id, r.class_size) for i, r in found.items()} == {1: (1, 2), 5: (1, 2), 2: (2, 1), 3: (3, 1), 4: (4, 1)}


def test_mixing(docs):
    found = rows(mixing.mix(docs))
    assert [found[i]["size"] for i in (1, 2, 3, 4)] == [len(LONG.split()), 220, 0, 0]
    assert sum(r.taken for r in found.values()) <= sum(r["size"] for r in found.values())
    taken = mixing.mixed(docs.drop("_row"))
    assert set(docs.columns) - {"_row"} < set(taken.columns)
    clashing = mixing.mixed(docs).collect()
    assert {r._row for r in clashing} == {3} and len(clashing) == taken.count()


def test_empty_tables(spark, docs, items):
    none, marks = docs.limit(0), spark.createDataFrame([], LABELS)
    assert quality_rules.judge(none, marks).collect() == [] and quality_rules.keep_good(none, marks).collect() == []
    assert decontamination.inspect(none, items).collect() == [] and near_dedup.inspect(none).collect() == []
    assert substring_dedup.inspect(none).collect() == [] and suffix_dedup.inspect(none).collect() == []


@pytest.fixture
def folder(spark, tmp_path):
    def write(docs, items):
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        items.write.parquet(f"{tmp_path}/benchmark.parquet")
        spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return write


def test_pipeline_on_empty_tables(spark, docs, items, folder):
    assert corpus_pipeline.run(spark, folder(docs.limit(0), items.limit(0))).collect() == []


def test_pipeline_without_labels_on_long_and_repeated_rows(spark, docs, items, folder):
    rnd = random.Random(1)
    plain = [(i, " ".join(f"q{rnd.randrange(10**6)}" for _ in range(60)), None, "s0", 1, 3, 4) for i in range(10, 20)]
    repeated = spark.createDataFrame([*plain, plain[0], (None, plain[1][1], None, None, 1, 3, 4)], DOCS)
    found = corpus_pipeline.run(spark, folder(docs.unionByName(repeated), items)).collect()
    ids = {r.doc_id for r in found}
    assert ids <= {1, 2, *range(10, 20)} and 5 not in ids and None not in ids and ids & set(range(10, 20))
    assert all(r.text == OTHER.replace(PASSAGE + " ", "") for r in found if r.doc_id == 2)
