"""The shared output contract of the normalisers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnflow.functions.checks import row_limit
from cairnflow.schemas import RAW_ITEMS


def raw_items(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """Select exactly the declared columns, in order and with their types; a value that does not fit becomes NULL,
    and a row whose time does not fit goes."""
    rows = df.select(
        *[columns[f.name].try_cast(f.dataType).alias(f.name) for f in RAW_ITEMS.fields],
        *[F.col(name) for name in keep],
    )
    return rows.filter(F.col("published_at").isNotNull())


def first_rows(df: DataFrame, limit: int | None) -> DataFrame:
    """All rows of ``df``, or the first ``limit`` by ``seen`` when a limit is given."""
    limit = row_limit(limit)
    return df if limit is None else df.orderBy("seen").limit(limit)


def evaluate_once(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """Add ``columns`` behind a generator of one row.

    The optimizer pushes filters below a projection by repeating its expressions, which would parse
    a payload once per test. It does not push them below a generator, so each column is computed
    a single time and the generated code stays small enough to compile.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))
