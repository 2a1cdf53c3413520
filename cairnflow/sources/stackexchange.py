"""Stack Exchange questions: question payloads and the paged scan of several sites.

Landing layout: ``<site>/page-<n>.json`` holds one answer of the interface, ``{"items": [...], "has_more": bool}``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnflow.functions import jsonvalue as J
from cairnflow.functions.text import is_blank, unescape_html
from cairnflow.schemas import RAW_ITEMS
from cairnflow.sources.common import evaluate_once, first_rows, raw_items

SOURCE = "stackexchange"


def normalize(payloads: DataFrame, *keep: str) -> DataFrame:
    """``(site, value)`` rows to raw items, keyed ``site#question_id``.

    A question needs an integer id, a title, a link and a creation time in epoch seconds; titles and names arrive with HTML
    entities, which are decoded. The body stays HTML, as cleaning expects it. Tags and the number of answers
    travel in the payload. An owner that is missing, removed or nameless leaves no author.
    """
    question = F.col("question")
    parsed = evaluate_once(payloads, *keep, "site", "value", question=J.parse(F.col("value")))
    typed = evaluate_once(
        parsed,
        *keep,
        "site",
        "value",
        number=J.integer(question, "$.question_id"),
        title=unescape_html(J.string(question, "$.title")),
        link=J.string(question, "$.link"),
        created=J.integer(question, "$.creation_date"),
        body=J.string(question, "$.body"),
        owner=unescape_html(J.string(question, "$.owner.display_name")),
        score=J.integer(question, "$.score"),
    )
    usable = typed.filter(F.col("number").isNotNull() & ~is_blank(F.col("title")) & ~is_blank(F.col("link")) & F.col("created").isNotNull())
    return raw_items(
        usable,
        *keep,
        external_id=F.concat_ws("#", "site", F.col("number").cast("string")),
        source=F.lit(SOURCE),
        title=F.col("title"),
        body=F.coalesce("body", F.lit("")),
        url=F.col("link"),
        author=F.when(~is_blank(F.col("owner")), F.col("owner")),
        published_at=F.timestamp_seconds("created"),
        engagement_score=F.col("score"),
        raw_payload=F.col("value"),
    )


def questions(pages: DataFrame) -> DataFrame:
    """``(site, page, position, value, has_more)`` of page answers ``(site, page, value)``; an answer that is no object has none."""
    parsed = pages.withColumn("answer", J.parse(F.col("value")))
    more = F.coalesce(J.boolean(F.col("answer"), "$.has_more"), F.lit(False))
    items = F.when(J.is_object(F.col("answer")), F.try_variant_get("answer", "$.items", "array<variant>"))
    listed = parsed.select("site", "page", more.alias("has_more"), F.posexplode_outer(items).alias("position", "item"))
    return listed.select("site", "page", "position", F.to_json("item").alias("value"), "has_more")


def reachable(pages: DataFrame) -> DataFrame:
    """``(site, page)`` of the pages a reader gets to: all earlier ones are there and say that there are more."""
    flags = pages.groupBy("site", "page").agg(F.max("has_more").alias("has_more"))
    # One short row per page.
    order = Window.partitionBy("site").orderBy("page")
    ended = F.coalesce(F.min("has_more").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    return flags.select("site", "page", F.row_number().over(order).alias("nth"), ended.alias("open")).filter("page = nth AND open").select("site", "page")


def scan_sites(pages: DataFrame, sites: Sequence[str], limit: int | None = None) -> DataFrame:
    """The valid, distinct questions of ``sites``, or the first ``limit`` in site, page, position order (``seen``)."""
    names = [site.strip().lower() for site in sites]
    if not names or "" in names or len(set(names)) < len(names):
        raise ValueError("sites must be distinct names")
    wanted = questions(pages.filter(F.col("site").isin(*names)))
    order = F.array_position(F.array(*[F.lit(name) for name in names]), F.col("site"))
    reached = wanted.join(reachable(wanted), ["site", "page"], "left_semi").filter("value IS NOT NULL")
    valid = normalize(reached.withColumn("seen", F.struct(order.alias("site_order"), "page", "position")), "seen")
    columns = [f.name for f in RAW_ITEMS.fields]
    first = valid.groupBy("external_id").agg(F.min_by(F.struct(*columns), "seen").alias("item"), F.min("seen").alias("seen"))
    return first_rows(first, limit).select("item.*", "seen")


def read(spark: SparkSession, path: str, sites: Sequence[str], limit: int | None = None) -> DataFrame:
    """The landed pages of ``sites``; a page is one file, which the interface bounds to a hundred questions."""
    location = F.col("_metadata.file_path")
    pages = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.lower(F.regexp_extract(location, r"([^/]+)/page-\d+\.json$", 1)).alias("site"),
        F.regexp_extract(location, r"page-(\d+)\.json$", 1).cast("int").alias("page"),
        "value",
    )
    return scan_sites(pages, sites, limit).drop("seen")
