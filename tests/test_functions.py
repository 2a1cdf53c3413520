"""Scalars against literals and against the standard library."""

from __future__ import annotations

import datetime as dt
import hashlib
import html
import re

import pytest
from pyspark.sql import functions as F

from cairnflow.functions import numbers as N
from cairnflow.functions import text as T
from cairnflow.functions import vectors as V

TEXTS = [
    "Hello&nbsp;<b>HN</b>",
    "a &amp;lt; b &lt;i&gt;gone&lt;/i&gt;",
    "AT&T &eacute;t&eacute; &notit; &#x41;&#66; &copy 2024",
    "  tabs\tand\x1cseparators and wide\x85lines\n\n",
    "R&D & more &; &",
    "",
    None,
    "nothing special",
    "&hellip;&middot;&apos;&#39;&quot;",
]


def reference_clean(text):
    text = re.sub(r"<[^>]+>", " ", html.unescape(text or ""))
    return " ".join(text.split())


def test_clean_text_equals_standard_library(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = [r[0] for r in df.select(T.clean_text(F.col("t"))).collect()]
    assert got == [reference_clean(t) for t in TEXTS]


def test_document_text_and_hash(spark):
    df = spark.createDataFrame([("Hello HN", "Body content"), (" ", "only body"), ("only title", ""), ("", "")], "a string, b string")
    text = T.document_text(F.col("a"), F.col("b"))
    rows = df.select(text.alias("t"), T.text_hash(text).alias("h")).collect()
    assert [r.t for r in rows] == ["Hello HN\n\nBody content", "only body", "only title", ""]
    assert [r.h for r in rows] == [hashlib.sha256(" ".join(r.t.lower().split()).encode()).hexdigest() for r in rows]


def test_excerpt_cuts_only_long_text(spark):
    df = spark.createDataFrame([("x" * 180,), ("y " * 200,)], "t string")
    short, long = [r[0] for r in df.select(T.excerpt(F.col("t"))).collect()]
    assert short == "x" * 180 and len(long) == 181 and long.endswith("…")


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-05-01T10:00:00Z", dt.datetime(2024, 5, 1, 10)),
        ("2024-05-01T10:00:00+02:00", dt.datetime(2024, 5, 1, 8)),
        ("2024-05-01T10:00:00.250-0130", dt.datetime(2024, 5, 1, 11, 30, 0, 250000)),
        ("2024-05-01T10:00:00", None),
        ("yesterday", None),
        ("2024-13-01T10:00:00Z", None),
        (None, None),
    ],
)
def test_iso_timestamp_needs_an_offset(spark, text, expected):
    epoch = F.unix_micros(N.iso_timestamp(F.lit(text).cast("string")))
    got = spark.range(1).select(epoch).head()[0]
    want = None if expected is None else int(expected.replace(tzinfo=dt.UTC).timestamp() * 1_000_000)
    assert got == want


def test_week_starts_on_monday(spark):
    day = F.lit("2025-01-01 12:00:00").cast("timestamp")
    row = spark.range(1).select(*[F.date_format(N.period_start(day, g), "yyyy-MM-dd") for g in ("day", "week", "month")]).head()
    assert tuple(row) == ("2025-01-01", "2024-12-30", "2025-01-01")
    with pytest.raises(ValueError):
        N.period_start(day, "year")


@pytest.mark.parametrize(
    "current, previous, status",
    [(15, 10, "rising"), (7, 10, "falling"), (12, 10, "stable"), (8, 10, "stable"), (3, 0, "rising"), (0, 0, "stable")],
)
def test_trend_status_boundaries(spark, current, previous, status):
    growth = N.growth_rate(F.lit(current), F.lit(previous))
    got = N.trend_status(F.lit(True), F.lit(current - previous), growth)
    assert spark.range(1).select(got).head()[0] == status


def test_vectors(spark):
    df = spark.createDataFrame(
        [([3.0, 4.0], True), ([0.0, 0.0], True), ([1.0], False), ([float("nan"), 1.0], False), ([float("inf"), 1.0], False), ([None, 1.0], False), (None, False)],
        "v array<double>, ok boolean",
    )
    rows = df.select("ok", V.is_valid_vector(F.col("v"), 2).alias("got"), V.normalize(F.col("v")).alias("unit")).collect()
    assert [r.got for r in rows] == [r.ok for r in rows]
    assert rows[0].unit == [0.6, 0.8] and rows[1].unit is None
