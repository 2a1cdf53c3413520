"""Cleaning of documents: Unicode composition, repeated lines by document frequency, minimum length.

A line is boilerplate when more than ``share`` of all documents (and at least ``least_documents``) have it. Frequencies are
counted over digests of distinct lines before any text moves, and the texts themselves are never shuffled:
boilerplate lines number at most the mean number of lines of a document divided by ``share``, so they are broadcast.

A null text counts as empty; repeated ids are documents of their own; nothing is dropped, ``reason`` says what fails.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MIN_LENGTH = 40
SHARE = 0.5
LEAST_DOCUMENTS = 10
LINE = "\n"


@F.pandas_udf(StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: unicodedata.normalize("NFC", text), na_action="ignore")


def composed(text: Column) -> Column:
    """NFC form; texts of ASCII characters alone, which have only one, do not travel to Python."""
    wide = text.rlike(r"[^\x00-\x7F]")
    return F.when(wide, _compose(F.when(wide, text))).otherwise(text)


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, LINE), lambda line: F.trim(line))


def boilerplate(documents: DataFrame, text: str = "text", share: float = SHARE, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``(line_digest, documents)`` of the lines, stripped of blanks, that too many documents have."""
    if not 0 < share < 1:
        raise ValueError("share must lie between 0 and 1")
    total = documents.count()
    lines = F.filter(F.array_distinct(_lines(F.coalesce(F.col(text), F.lit("")))), lambda line: line != "")
    digests = documents.select(F.explode(F.transform(lines, lambda line: F.unhex(F.sha2(line, 256)))).alias("line_digest"))
    counted = digests.groupBy("line_digest").agg(F.count("*").alias("documents"))
    return counted.filter((F.col("documents") > share * total) & (F.col("documents") >= least_documents))


def clean_documents(
    documents: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, share: float = SHARE, least_documents: int = LEAST_DOCUMENTS
) -> DataFrame:
    """``documents`` with ``clean_text``, ``removed_lines`` and ``reason``: ``empty``, ``too short`` or NULL for a good one."""
    given = documents.withColumn("_text", composed(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    common = boilerplate(given, "_text", share, least_documents)
    # One row, bounded as said above; ``collect_list`` of nothing is an empty array.
    listed = common.agg(F.collect_list(F.hex("line_digest")).alias("_common"))
    joined = given.crossJoin(F.broadcast(listed))
    known = F.col("_common")
    repeated = lambda line: (F.trim(line) != "") & F.array_contains(known, F.upper(F.sha2(F.trim(line), 256)))
    lines = F.split("_text", LINE)
    # Without any common line no line is hashed.
    kept = F.when(F.size(known) == 0, lines).otherwise(F.filter(lines, lambda line: ~repeated(line)))
    body = F.array_join("_kept", LINE)
    length = F.length(F.trim(F.col("clean_text"), F.lit(" \t\r\n")))
    reason = F.when(length == 0, "empty").when(length < min_length, "too short")
    return (
        joined.withColumn("_kept", kept)
        .withColumns({"clean_text": body, "removed_lines": F.size(lines) - F.size("_kept")})
        .withColumn("reason", reason)
        .select(*documents.columns, "clean_text", "removed_lines", "reason")
    )
