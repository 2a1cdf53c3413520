"""Typed reads of untyped JSON, with the type of every value tested rather than coerced.

A payload is parsed once into a Variant; the readers below answer "what is it" and "its value if
it is of that type".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGER = ("BIGINT",)


def parse(text: Column) -> Column:
    """The Variant of a JSON text; NULL when malformed or when an object repeats a key."""
    return F.try_parse_json(text)


def kind(value: Column, path: str) -> Column:
    """NULL when the path is absent, else a type name: VOID, STRING, BOOLEAN, BIGINT, DOUBLE, ..."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def has(value: Column, path: str) -> Column:
    return kind(value, path).isNotNull()


def non_null(value: Column, path: str) -> Column:
    """Present and not a JSON null."""
    return F.coalesce(kind(value, path) != "VOID", F.lit(False))


def string(value: Column, path: str) -> Column:
    return F.when(kind(value, path) == "STRING", F.try_variant_get(value, path, "string"))


def boolean(value: Column, path: str) -> Column:
    return F.when(kind(value, path) == "BOOLEAN", F.try_variant_get(value, path, "boolean"))


def integer(value: Column, path: str) -> Column:
    """A JSON integer (not a fraction, not a boolean)."""
    return F.when(kind(value, path).isin(*INTEGER), F.try_variant_get(value, path, "long"))


def number(value: Column, path: str) -> Column:
    """Any JSON number as a double (booleans are not numbers)."""
    of_kind = kind(value, path)
    numeric = of_kind.isin("BIGINT", "DOUBLE", "FLOAT") | of_kind.startswith("DECIMAL")
    return F.when(numeric, F.try_variant_get(value, path, "double"))


def keys(text: Column) -> Column:
    """Top-level keys as written, repeats included; NULL when not an object."""
    return F.json_object_keys(text)


def has_exact_keys(text: Column, names: tuple[str, ...]) -> Column:
    expected = F.array(*[F.lit(name) for name in sorted(names)])
    return F.coalesce(F.array_sort(keys(text)) == expected, F.lit(False))


def has_repeated_keys(text: Column) -> Column:
    return F.coalesce(F.size(F.array_distinct(keys(text))) < F.size(keys(text)), F.lit(False))
