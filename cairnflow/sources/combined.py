"""All configured sources as one DataFrame, in declared order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.sources import github, hackernews, reddit, scopes


def union_sources(items: Mapping[str, DataFrame], enabled: Sequence[str]) -> DataFrame:
    """Concatenate raw items of the enabled sources, tagged with their place in the order."""
    names = scopes.sources(enabled)
    missing = [name for name in names if name not in items]
    if missing:
        raise ValueError(f"no reader configured for {', '.join(missing)}")
    tagged = [
        items[name].withColumn("source_order", F.lit(position))
        for position, name in enumerate(names, start=1)
    ]
    return reduce(DataFrame.unionByName, tagged)


def read_sources(spark: SparkSession, path: str, enabled: Sequence[str], options: Mapping[str, dict]) -> DataFrame:
    """Read ``<path>/<source>`` for each enabled source with its own reader options."""
    readers = {"hackernews": hackernews.read, "reddit": reddit.read, "github": github.read}
    names = scopes.sources(enabled)
    items = {
        name: readers[name](spark, f"{path}/{name}", **options.get(name, {})) for name in names
    }
    return union_sources(items, names)
