"""Raw payloads rendered from the documents table, with defects spread by ``doc_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.fixtures import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", "source", "n_chars", F.substring_index("text", "\n", 1).alias("title")
    )


def field(name: str, value: Column) -> Column:
    """One ``"name":value`` member; NULL values vanish, as do NULL members in ``record``."""
    text = F.to_json(F.struct(value.alias(name)))
    return F.when(value.isNotNull(), F.substring(text, F.lit(2), F.length(text) - 2))


def member(text: str) -> Column:
    return F.lit(text)


def record(*members: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def defect(modulus: int) -> Column:
    return F.pmod("doc_id", F.lit(modulus))


def hackernews(docs: DataFrame) -> DataFrame:
    m = defect(17)
    value = record(
        field("id", F.col("doc_id")),
        F.when(m == 4, member('"type":"comment"')).otherwise(member('"type":"story"')),
        F.when(m == 0, member('"deleted":true')),
        F.when(m == 8, member('"dead":true')),
        field("by", F.col("source")),
        F.when(m == 5, member('"time":"soon"')).otherwise(field("time", F.lit(1704067200) + F.col("doc_id"))),
        F.when(m == 7, member('"title":""')).when(m != 1, field("title", F.col("title"))),
        F.when(m == 2, member('"text":null')).when(m != 3, field("text", F.col("text"))),
        F.when(m != 6, field("url", F.concat(F.lit("https://example.test/"), F.col("doc_id")))),
        field("score", F.col("n_chars")),
    )
    return docs.select("doc_id", value.alias("value"))


def github(docs: DataFrame) -> DataFrame:
    m = defect(17)
    seconds = F.lit(1704067200) + F.col("doc_id")
    stamp = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.when(m == 2, "").when(m == 7, "+02:00").otherwise("Z")
    value = record(
        F.when(m == 0, member('"pull_request":null')).when(m == 1, member('"pull_request":{"url":"x"}')),
        F.when(m == 6, member('"number":"7"')).otherwise(field("number", F.col("doc_id"))),
        F.when(m == 4, member('"title":"  "')).otherwise(field("title", F.col("title"))),
        F.when(m != 5, field("html_url", F.concat(F.lit("https://example.test/"), F.col("doc_id")))),
        field("created_at", F.concat(stamp, zone)),
        F.when(m == 3, member('"body":null')).otherwise(field("body", F.col("text"))),
        F.when(m == 9, member('"user":{"login":" "}')).when(
            m != 8, F.concat(F.lit('"user":{'), field("login", F.col("source")), F.lit("}"))
        ),
        F.when(m == 10, member('"comments":true')).otherwise(field("comments", F.col("n_chars"))),
    )
    return docs.select(
        "doc_id", F.concat(F.lit("org/"), "source").alias("repository"), value.alias("value")
    )


def reddit(docs: DataFrame) -> DataFrame:
    m = defect(17)
    seconds = F.lit(1704067200) + F.col("doc_id")
    value = record(
        F.when(m == 9, member('"id":9')).otherwise(field("id", F.col("doc_id").cast("string"))),
        F.when(m == 10, member('"title":" "')).otherwise(field("title", F.col("title"))),
        F.when(m == 1, member('"selftext":"[removed]"')).otherwise(field("selftext", F.col("text"))),
        F.when(~m.isin(4, 5), field("url", F.concat(F.lit("https://example.test/"), F.col("doc_id")))),
        F.when(m == 4, field("permalink", F.concat(F.lit("/r/"), F.col("doc_id")))),
        F.when(m == 0, member('"author":"[deleted]"'))
        .when(m == 11, member('"author":" "'))
        .otherwise(field("author", F.col("source"))),
        F.when(m == 2, member('"removed_by_category":"moderator"')),
        F.when(m == 3, member('"removed_by":null')),
        F.when(m == 7, member('"created_utc":true'))
        .when(m == 6, F.concat(F.lit('"created_utc":'), seconds, F.lit(".5")))
        .otherwise(field("created_utc", seconds)),
        F.when(m == 8, member('"score":1.5')).otherwise(field("score", F.col("n_chars"))),
    )
    return docs.select("doc_id", "source", value.alias("value"))


def stackexchange(docs: DataFrame) -> DataFrame:
    m = defect(17)
    seconds = F.lit(1704067200) + F.col("doc_id")
    value = record(
        F.when(m == 0, member('"question_id":"7"')).otherwise(field("question_id", F.col("doc_id"))),
        F.when(m == 1, member('"title":" "')).when(m == 2, member('"title":"Why &amp; how?"')).otherwise(field("title", F.col("title"))),
        F.when(m != 3, field("link", F.concat(F.lit("https://example.test/"), F.col("doc_id")))),
        F.when(m == 4, member('"creation_date":"today"')).otherwise(field("creation_date", seconds)),
        F.when(m == 5, member('"body":null')).otherwise(field("body", F.col("text"))),
        F.when(m == 6, member('"owner":{"user_type":"does_not_exist"}'))
        .when(m == 7, member('"owner":{"display_name":" "}'))
        .when(m != 8, F.concat(F.lit('"owner":{'), field("display_name", F.col("source")), F.lit("}"))),
        F.when(m == 9, member('"score":1.5')).otherwise(field("score", F.col("n_chars"))),
        member('"answer_count":2'),
        member('"tags":["etl","automation"]'),
    )
    return docs.select("doc_id", F.concat(F.lit("site"), F.pmod("doc_id", F.lit(3))).alias("site"), value.alias("value"))


def classifications(docs: DataFrame) -> DataFrame:
    """Classification lines; the good ones agree with the rule ``n_chars >= 400``."""
    m = defect(13)
    key = [field("source", F.col("source")), field("external_id", F.col("doc_id").cast("string"))]
    rest = [
        F.when(m == 2, member('"is_problem":"true"')).otherwise(field("is_problem", F.col("n_chars") >= 400)),
        F.when(m == 3, member('"confidence":1.5'))
        .when(m == 4, member('"confidence":true'))
        .otherwise(field("confidence", F.pmod(F.col("doc_id") * 37, F.lit(101)) / 100.0)),
        F.when(m == 6, member('"reason":"  "')).otherwise(member('"reason":" by length "')),
        F.when(m != 0, member('"classifier_name":"rule"')),
        F.when(m == 1, member('"note":"x"')),
        F.when(m == 5, member('"reason":"again"')),
    ]
    line = (
        F.when(m == 7, F.lit("{not json"))
        .when(m == 8, F.lit("   "))
        .when(m == 9, F.lit("[1,2]"))
        .otherwise(record(*key, *rest))
    )
    return docs.select("doc_id", line.alias("value"))


def model_answers(docs: DataFrame) -> DataFrame:
    m = defect(11)
    good = record(
        field("is_problem", F.col("n_chars") >= 400),
        field("confidence", F.pmod(F.col("doc_id") * 37, F.lit(101)) / 100.0),
        field("reason", F.concat(F.lit(" length "), F.col("n_chars"))),
    )
    fence = "`" * 3
    answer = (
        F.when(m == 0, F.concat(F.lit(f"{fence}json\n"), good, F.lit(f"\n{fence}")))
        .when(m == 1, F.concat(F.lit(f"{fence}\n"), good, F.lit(f"\n{fence}")))
        .when(m == 2, F.concat(F.lit("Sure: "), good))
        .when(m == 3, F.concat(good, F.lit(fence)))
        .when(m == 4, F.lit('{"is_problem":true,"confidence":2,"reason":"x"}'))
        .when(m == 5, F.lit('{"is_problem":true,"is_problem":false,"confidence":1,"reason":"x"}'))
        .when(m == 6, F.lit(""))
        .when(m == 7, F.concat(F.lit(f'{fence}json\n{{"is_problem":true,"confidence":0.5,"reason":"uses {fence} marks"}}\n{fence}')))
        .otherwise(F.concat(F.lit("\n "), good, F.lit(" ")))
    )
    return docs.select("doc_id", answer.alias("output"))


def id_lists(docs: DataFrame) -> DataFrame:
    """JSON arrays of up to 500 entries, some of them not integers; one payload is no array."""
    m = defect(7)
    entry = (
        F.when(m == 0, F.lit("true"))
        .when(m == 1, F.lit('"x"'))
        .when(m == 2, F.lit("1.5"))
        .otherwise(F.col("doc_id").cast("string"))
    )
    page = F.floor(F.col("doc_id") / 500)
    lists = docs.groupBy(page.alias("page")).agg(
        F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("entry")))).alias("entries")
    )
    array = F.concat(F.lit("["), F.array_join(F.transform("entries", lambda e: e["entry"]), ","), F.lit("]"))
    return lists.select("page", F.when(F.pmod("page", F.lit(5)) == 3, F.lit('{"a":1}')).otherwise(array).alias("value"))
