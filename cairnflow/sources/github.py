"""GitHub issues: issue payloads and the paged scan of several repositories.

Landing layout: ``<owner>/<repository>/page-<n>.json`` holds one issue payload per line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnflow.functions import jsonvalue as J
from cairnflow.functions.numbers import iso_timestamp
from cairnflow.functions.text import is_blank
from cairnflow.schemas import RAW_ITEMS
from cairnflow.sources import scopes
from cairnflow.sources.common import evaluate_once, first_rows, raw_items

# Fixed value: a page shorter than this is the last one.
PAGE_SIZE = 100


def normalize(payloads: DataFrame, *keep: str) -> DataFrame:
    """``(repository, value)`` rows to raw items. Pull requests are not issues."""
    issue = F.col("issue")
    parsed = evaluate_once(payloads, *keep, "repository", "value", issue=J.parse(F.col("value")))
    typed = evaluate_once(
        parsed,
        *keep,
        "repository",
        "value",
        # The key alone marks a pull request, whatever its value (even null).
        is_pull_request=J.has(issue, "$.pull_request"),
        number=J.integer(issue, "$.number"),
        title=J.string(issue, "$.title"),
        html_url=J.string(issue, "$.html_url"),
        created_at=iso_timestamp(J.string(issue, "$.created_at")),
        body=J.string(issue, "$.body"),
        login=J.string(issue, "$.user.login"),
        comments=J.integer(issue, "$.comments"),
    )
    usable = typed.filter(
        ~F.col("is_pull_request")
        & F.col("number").isNotNull()
        & ~is_blank(F.col("title"))
        & ~is_blank(F.col("html_url"))
        & F.col("created_at").isNotNull()
    )
    return raw_items(
        usable,
        *keep,
        external_id=F.concat_ws("#", "repository", F.col("number").cast("string")),
        source=F.lit("github"),
        title=F.col("title"),
        body=F.coalesce("body", F.lit("")),
        url=F.col("html_url"),
        author=F.when(~is_blank(F.col("login")), F.col("login")),
        published_at=F.col("created_at"),
        engagement_score=F.col("comments"),
        raw_payload=F.col("value"),
    )


def reachable_pages(payloads: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """``(repository, page)`` of the pages a reader gets to: all earlier ones exist and are full."""
    sizes = payloads.groupBy("repository", "page").agg(F.count("*").alias("issues"))
    # The list of pages, not of issues: one short row per page.
    earlier = Window.partitionBy("repository").orderBy("page")
    return (
        sizes.select(
            "repository",
            "page",
            F.row_number().over(earlier).alias("nth"),
            F.coalesce(
                F.min("issues").over(earlier.rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(page_size),
            ).alias("smallest_before"),
        )
        .filter((F.col("page") == F.col("nth")) & (F.col("smallest_before") >= page_size))
        .select("repository", "page")
    )


def scan_repositories(
    payloads: DataFrame,
    repositories: Sequence[str],
    limit: int | None = None,
    page_size: int = PAGE_SIZE,
) -> DataFrame:
    """The valid, distinct issues, or the first ``limit`` in repository, page, position order (``seen``).

    ``payloads`` is ``(repository, page, position, value)`` with pages counted from 1.
    """
    names = scopes.repositories(repositories)
    wanted = payloads.filter(F.col("repository").isin(*names))
    order = F.array_position(F.array(*[F.lit(name) for name in names]), F.col("repository"))
    reached = wanted.join(reachable_pages(wanted, page_size), ["repository", "page"], "left_semi")
    valid = normalize(
        reached.withColumn("seen", F.struct(order.alias("repository_order"), "page", "position")),
        "seen",
    )
    columns = [f.name for f in RAW_ITEMS.fields]
    first = valid.groupBy("external_id").agg(
        F.min_by(F.struct(*columns), "seen").alias("item"), F.min("seen").alias("seen")
    )
    return first_rows(first, limit).select("item.*", "seen")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages as ``(repository, page, position, value)``; positions follow file offsets."""
    location = F.col("_metadata.file_path")
    return (
        spark.read.text(path, recursiveFileLookup=True)
        .filter(F.trim("value") != "")
        .select(
            F.lower(F.regexp_extract(location, r"([^/]+/[^/]+)/page-\d+\.json$", 1)).alias("repository"),
            F.regexp_extract(location, r"page-(\d+)\.json$", 1).cast("int").alias("page"),
            F.monotonically_increasing_id().alias("position"),
            "value",
        )
    )


def read(spark: SparkSession, path: str, repositories: Sequence[str], limit: int | None = None) -> DataFrame:
    return scan_repositories(read_pages(spark, path), repositories, limit).drop("seen")
