"""Text expressions. All of them stay on the JVM except rare HTML entities."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the characters a Unicode-aware ``\s`` matches, spelled so that Java and RE2 agree.
WHITESPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
WHITESPACE_CHARACTERS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# Fixed value: a word is a run of two or more letters, digits or underscores.
WORD = r"[\p{L}\p{N}_]{2,}"
# Fixed value.
TAG = r"<[^>]+>"

# Bytes of text whose words one task counts; their hash table takes some thirteen times as much.
SHARE_BYTES = 16 << 20

# Entities decoded on the JVM; their characters come from the standard library's table.
# ``amp`` stays last, so a decoded ampersand never starts another entity.
COMMON_ENTITIES = {
    name: html.unescape(f"&{name};")
    for name in ("lt", "gt", "quot", "apos", "#39", "nbsp", "copy", "middot", "hellip", "amp")
}
# An ampersand that is neither a common entity nor plainly literal needs the full decoder.
RARE_ENTITY = r"&(?!(?:" + "|".join(COMMON_ENTITIES) + r");|[\t\n\f <&;]|\z)"


@F.pandas_udf(T.StringType())
def _unescape(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(html.unescape, na_action="ignore")


def unescape_common(text: Column) -> Column:
    for name, char in COMMON_ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def unescape_html(text: Column) -> Column:
    """Decode every HTML entity; only texts with uncommon ones travel to Python."""
    marked = F.contains(text, F.lit("&"))
    rare = marked & text.rlike(RARE_ENTITY)
    return F.when(~marked, text).when(rare, _unescape(F.when(rare, text))).otherwise(unescape_common(text))


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{WHITESPACE}+", " "))


def strip(text: Column) -> Column:
    # A character set instead of a pattern: only the ends of the text are looked at.
    return F.trim(text, F.lit(WHITESPACE_CHARACTERS))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def clean_text(text: Column, entities: str = "exact") -> Column:
    """Decode entities first, then drop tags, then collapse whitespace.

    ``entities="common"`` keeps the whole expression in code generation for feeds known to use
    only the entities of ``COMMON_ENTITIES``.
    """
    text = F.coalesce(text, F.lit(""))
    decoded = {"exact": unescape_html, "common": unescape_common}[entities](text)
    return collapse_whitespace(F.regexp_replace(decoded, TAG, " "))


def document_text(title: Column, body: Column) -> Column:
    """Both parts stripped, empty parts dropped, joined by a blank line."""
    return F.concat_ws("\n\n", F.nullif(strip(title), F.lit("")), F.nullif(strip(body), F.lit("")))


def text_hash(text: Column) -> Column:
    return F.sha2(collapse_whitespace(F.lower(text)), 256)


def excerpt(text: Column, limit: int = 180) -> Column:
    collapsed = collapse_whitespace(text)
    return F.when(F.length(collapsed) <= limit, collapsed).otherwise(
        F.concat(F.substring(collapsed, 1, limit), F.lit("…"))
    )


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def counted_words(items: DataFrame, name: str, share: int = SHARE_BYTES) -> tuple[DataFrame, int]:
    """``(id, name, tf)``: how often an id has a word; and the number of items.

    The words of an id are many times its text in memory, so texts are dealt in shares of about ``share`` bytes first:
    what a task holds does not grow with the files. The text is in the key, since an id may have very many rows.
    """
    size = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("document_text")).alias("bytes")).head()
    texts = items.select("id", "document_text").repartition(max(1, -(-(size["bytes"] or 0) // share)), "id", "document_text")
    found = texts.select("id", F.explode(words(F.col("document_text"))).alias(name))
    return found.groupBy("id", name).agg(F.count("*").alias("tf")), size["n"]


def label_text(keywords: Column) -> Column:
    return F.concat_ws(", ", keywords)
