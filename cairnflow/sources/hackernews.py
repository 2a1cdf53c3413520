"""Hacker News: item payloads, feed id lists, and the scan of several feeds in order.

Landing layout: ``items/`` holds one item payload per line; ``feeds/<feed>.json`` holds one JSON
array of ids per file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.functions import jsonvalue as J
from cairnflow.functions.numbers import epoch_timestamp
from cairnflow.sources import scopes
from cairnflow.sources.common import evaluate_once, first_rows, raw_items

# Fixed value.
ITEM_LINK = "https://news.ycombinator.com/item?id="


def normalize(payloads: DataFrame, *keep: str) -> DataFrame:
    """``value`` (one item payload per row) to raw items; ``keep`` names pass-through columns."""
    item = F.col("item")
    parsed = evaluate_once(payloads, *keep, "value", item=J.parse(F.col("value")))
    typed = evaluate_once(
        parsed,
        *keep,
        "value",
        type=J.string(item, "$.type"),
        deleted=F.coalesce(J.boolean(item, "$.deleted"), F.lit(False)),
        item_id=J.integer(item, "$.id"),
        title=J.string(item, "$.title"),
        time=J.integer(item, "$.time"),
        # A missing text is an empty body, any other non-string text makes the item unusable.
        body=F.when(J.has(item, "$.text"), J.string(item, "$.text")).otherwise(F.lit("")),
        item_url=J.string(item, "$.url"),
        author=J.string(item, "$.by"),
        score=J.integer(item, "$.score"),
    )
    usable = typed.filter(
        (F.col("type") == "story")
        & ~F.col("deleted")
        & F.col("item_id").isNotNull()
        & (F.col("title") != "")
        & F.col("time").isNotNull()
        & F.col("body").isNotNull()
    )
    return raw_items(
        usable,
        *keep,
        external_id=F.col("item_id").cast("string"),
        source=F.lit("hackernews"),
        title=F.col("title"),
        body=F.col("body"),
        url=F.coalesce(
            F.nullif(F.col("item_url"), F.lit("")), F.concat(F.lit(ITEM_LINK), F.col("item_id"))
        ),
        author=F.col("author"),
        published_at=epoch_timestamp(F.col("time")),
        engagement_score=F.col("score"),
        raw_payload=F.col("value"),
    )


def feed_ids(lists: DataFrame, *keep: str) -> DataFrame:
    """``value`` (a JSON array per row) to ``(keep..., position, item_id)``.

    A payload that is not a list gives no rows, and entries that are not integers are dropped.
    """
    parsed = evaluate_once(lists, *keep, ids=J.parse(F.col("value")))
    is_list = F.coalesce(F.schema_of_variant("ids").startswith("ARRAY"), F.lit(False))
    entries = F.when(is_list, F.try_variant_get("ids", "$", "array<variant>"))
    return (
        parsed.select(*keep, F.posexplode(entries).alias("position", "entry"))
        .select(*keep, "position", J.integer(F.col("entry"), "$").alias("item_id"))
        .filter(F.col("item_id").isNotNull())
    )


def scan_feeds(
    ids: DataFrame,
    payloads: DataFrame,
    feeds: Sequence[str] = scopes.HACKERNEWS_DEFAULT_FEEDS,
    limit: int | None = None,
) -> DataFrame:
    """The valid stories of the feeds, or the first ``limit`` of them in feed order then list order (``seen``).

    ``ids`` is ``(feed, position, item_id)``; ``payloads`` is ``(item_id, value)``. An id belongs to
    the first feed that lists it, whether or not its item turns out to be usable.
    """
    names = scopes.feeds(feeds)
    order = F.array_position(F.array(*[F.lit(name) for name in names]), F.col("feed"))
    first_seen = (
        ids.filter(F.col("feed").isin(*names))
        .groupBy("item_id")
        .agg(F.min(F.struct(order.alias("feed_order"), F.col("position"))).alias("seen"))
    )
    wanted = payloads.join(first_seen, "item_id").select("value", "seen")
    return first_rows(normalize(wanted, "seen"), limit)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(F.trim("value") != "")


def read_feed_lists(spark: SparkSession, path: str) -> DataFrame:
    """One whole file per feed; the feed is the file name."""
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("feed"), "value"
    )


def read(
    spark: SparkSession,
    path: str,
    feeds: Sequence[str] = scopes.HACKERNEWS_DEFAULT_FEEDS,
    limit: int | None = None,
) -> DataFrame:
    item_id = J.integer(J.parse(F.col("value")), "$.id").alias("item_id")
    payloads = read_payloads(spark, f"{path}/items").select(item_id, "value")
    ids = feed_ids(read_feed_lists(spark, f"{path}/feeds"), "feed")
    return scan_feeds(ids, payloads, feeds, limit).drop("seen")
