"""Reddit posts: post payloads, listing payloads, and the scan of several listings in order.

Landing layout: ``<subreddit>.json`` holds one listing payload per file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.functions import jsonvalue as J
from cairnflow.functions.numbers import epoch_timestamp
from cairnflow.functions.text import is_blank
from cairnflow.sources import scopes
from cairnflow.sources.common import evaluate_once, first_rows, raw_items

# Fixed value.
SITE = "https://www.reddit.com"
# How the site marks removed authors and bodies.
DELETED_AUTHOR = "[deleted]"
REMOVED_BODIES = ("[removed]", "[deleted]")


def normalize_variants(posts: DataFrame, *keep: str) -> DataFrame:
    """``post`` (Variant) rows to raw items."""
    post = F.col("post")
    typed = evaluate_once(
        posts,
        *keep,
        value=F.to_json("post"),
        post_id=J.string(post, "$.id"),
        title=J.string(post, "$.title"),
        selftext=J.string(post, "$.selftext"),
        post_url=J.string(post, "$.url"),
        permalink=J.string(post, "$.permalink"),
        author=J.string(post, "$.author"),
        created_utc=J.number(post, "$.created_utc"),
        score=J.integer(post, "$.score"),
        removed=J.non_null(post, "$.removed_by_category") | J.non_null(post, "$.removed_by"),
    )
    gone = (
        F.col("removed")
        | F.coalesce(F.col("author") == DELETED_AUTHOR, F.lit(False))
        | F.coalesce(F.col("selftext").isin(*REMOVED_BODIES), F.lit(False))
    )
    url = F.when(~is_blank(F.col("post_url")), F.col("post_url")).otherwise(
        F.when(F.col("permalink").startswith("/"), F.concat(F.lit(SITE), F.col("permalink")))
    )
    usable = typed.withColumn("link", url).filter(
        ~gone
        & ~is_blank(F.col("post_id"))
        & ~is_blank(F.col("title"))
        & F.col("created_utc").isNotNull()
        & F.col("link").isNotNull()
    )
    return raw_items(
        usable,
        *keep,
        external_id=F.col("post_id"),
        source=F.lit("reddit"),
        title=F.col("title"),
        body=F.coalesce("selftext", F.lit("")),
        url=F.col("link"),
        author=F.when(~is_blank(F.col("author")), F.col("author")),
        published_at=epoch_timestamp(F.col("created_utc")),
        engagement_score=F.col("score"),
        raw_payload=F.col("value"),
    )


def normalize(payloads: DataFrame, *keep: str) -> DataFrame:
    """``value`` (one post payload per row) to raw items."""
    return normalize_variants(evaluate_once(payloads, *keep, post=J.parse(F.col("value"))), *keep)


def listing_posts(listings: DataFrame, *keep: str) -> DataFrame:
    """Unwrap ``data.children[].data`` of listing payloads; children without an object are dropped."""
    children = F.try_variant_get(J.parse(F.col("value")), "$.data.children", "array<variant>")
    post = F.try_variant_get(F.col("child"), "$.data", "variant")
    return (
        listings.select(*keep, F.posexplode(children).alias("position", "child"))
        .select(*keep, "position", post.alias("post"))
        .filter(J.is_object(F.col("post")))
    )


def scan_listings(posts: DataFrame, subreddits: Sequence[str], limit: int | None = None) -> DataFrame:
    """The valid posts, or the first ``limit`` in listing order (``seen``); repeats stay, the upsert absorbs them.

    ``posts`` is ``(subreddit, position, post)``.
    """
    names = scopes.subreddits(subreddits)
    declared = F.array(*[F.lit(name) for name in names])
    # A subreddit named twice is read twice.
    turns = F.filter(
        F.sequence(F.lit(1), F.lit(len(names))), lambda i: F.element_at(declared, i) == F.col("subreddit")
    )
    ordered = posts.filter(F.col("subreddit").isin(*set(names))).select(
        "position", "post", F.explode(turns).alias("turn")
    )
    seen = F.struct("turn", "position").alias("seen")
    return first_rows(normalize_variants(ordered.select("post", seen), "seen"), limit)


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("subreddit"), "value"
    )


def read(spark: SparkSession, path: str, subreddits: Sequence[str], limit: int | None = None) -> DataFrame:
    posts = listing_posts(read_listings(spark, path), "subreddit")
    return scan_listings(posts, subreddits, limit).drop("seen")
