"""A join whose hot keys are known by count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is heavy when it covers more than 1/HEAVY_SHARE of the rows, so at most that many are.
HEAVY_SHARE = 1000
SPREAD = 256


def join_by_weight(
    left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str, spread: str
) -> DataFrame:
    """Inner join of ``left`` with the unique-keyed ``right``, whose ``weight`` counts its left rows.

    Heavy keys number at most ``HEAVY_SHARE`` (each covers that share of the rows), so their side is
    broadcast within a proven bound. The rows they serve are then spread over ``SPREAD`` values by a
    hash of ``spread``, so no task receives all rows of one key. One pass over ``left``.
    """
    total = right.agg(F.sum(weight)).scalar()
    payload = [c for c in right.columns if c not in keys]
    packed = right.select(*keys, F.struct(*payload).alias("_row"), (F.col(weight) * HEAVY_SHARE > total).alias("_heavy"))
    heavy = packed.filter("_heavy").select(*keys, F.col("_row").alias("_hot"))
    light = packed.filter("NOT _heavy").select(*keys, F.col("_row").alias("_cold"), F.lit(0).alias("_salt"))
    salt = F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(SPREAD))).cast("int")
    tagged = left.join(F.broadcast(heavy), list(keys), "left").withColumn("_salt", salt)
    joined = tagged.join(light, [*keys, "_salt"], "left").withColumn("_row", F.coalesce("_hot", "_cold"))
    return joined.filter(F.col("_row").isNotNull()).select(*left.columns, *[F.col(f"_row.{c}").alias(c) for c in payload])
