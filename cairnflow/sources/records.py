"""Strict JSON-lines records: exact fields, no repeated keys, typed and trimmed values.

Every contract yields the parsed rows plus ``rejected`` (NULL when the row is fine, else the first
rule it breaks). ``accepted`` fails the job on the first bad row; ``split`` separates the two.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.functions import jsonvalue as J
from cairnflow.functions.text import is_blank, strip
from cairnflow.sources.common import evaluate_once


@dataclass(frozen=True)
class Contract:
    """Field names by the type they must have."""

    name: str
    text: tuple[str, ...]
    boolean: tuple[str, ...] = ()
    fraction: tuple[str, ...] = ()
    trimmed: bool = True

    @property
    def fields(self) -> tuple[str, ...]:
        return self.text + self.boolean + self.fraction


# The fields of each interchange record.
CLASSIFICATION = Contract(
    "classification",
    text=("source", "external_id", "reason", "classifier_name"),
    boolean=("is_problem",),
    fraction=("confidence",),
)
WORK_ITEM = Contract("work item", text=("source", "external_id", "document_text"), trimmed=False)
EVALUATION_CASE = Contract(
    "evaluation case", text=("id", "text", "category"), boolean=("expected_is_problem",)
)
MODEL_OUTPUT = Contract(
    "model output", text=("reason",), boolean=("is_problem",), fraction=("confidence",)
)


def _text(record: Column, name: str) -> Column:
    return J.string(record, f"$.{name}")


def _first_broken_rule(contract: Contract, line: Column, record: Column) -> Column:
    rules = [
        ("blank line", is_blank(line)),
        ("repeated key", J.has_repeated_keys(line)),
        ("malformed JSON", record.isNull()),
        ("not an object", ~J.is_object(record)),
        ("wrong fields", ~J.has_exact_keys(line, contract.fields)),
    ]
    rules += [(f"{name} must be non-blank text", is_blank(_text(record, name))) for name in contract.text]
    rules += [
        (f"{name} must be a boolean", J.boolean(record, f"$.{name}").isNull()) for name in contract.boolean
    ]
    for name in contract.fraction:
        value = J.number(record, f"$.{name}")
        rules.append((f"{name} must be a number", value.isNull()))
        rules.append((f"{name} must be between 0 and 1", ~value.between(0.0, 1.0)))
    broken = F.lit(None).cast("string")
    for reason, test in reversed(rules):
        broken = F.when(test, F.lit(reason)).otherwise(broken)
    return broken


def parse(lines: DataFrame, contract: Contract, *keep: str, column: str = "value") -> DataFrame:
    """``keep`` columns, the contract's fields (NULL on rejected rows) and ``rejected``."""
    line, record = F.col(column), F.col("record")
    read = evaluate_once(lines, *keep, column, record=J.parse(line))
    parsed = evaluate_once(read, *keep, "record", rejected=_first_broken_rule(contract, line, record))
    fine = F.col("rejected").isNull()
    clean = strip if contract.trimmed else (lambda text: text)
    return parsed.select(
        *keep,
        *[F.when(fine, clean(_text(record, name))).alias(name) for name in contract.text],
        *[F.when(fine, J.boolean(record, f"$.{name}")).alias(name) for name in contract.boolean],
        *[F.when(fine, J.number(record, f"$.{name}")).alias(name) for name in contract.fraction],
        "rejected",
    )


def split(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The accepted rows without the verdict, and the rejected rows with it."""
    fine = F.col("rejected").isNull()
    return parsed.filter(fine).drop("rejected"), parsed.filter(~fine)


def accepted(parsed: DataFrame) -> DataFrame:
    """All rows, or a failed job as soon as one was rejected."""
    checked = F.when(
        F.col("rejected").isNotNull(), F.raise_error(F.concat(F.lit("invalid record: "), "rejected"))
    ).otherwise(F.lit(True))
    return parsed.filter(checked.cast("boolean")).drop("rejected")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Reject an empty file; looks at one row only."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def repeated_keys(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, and whether their rows are identical or contradictory.

    Only the smallest and the largest row per key are kept while aggregating, so a key that holds
    most of the file costs no memory.
    """
    row = F.struct(*[c for c in rows.columns])
    return (
        rows.groupBy(*key)
        .agg(F.count("*").alias("occurrences"), F.min(row).alias("low"), F.max(row).alias("high"))
        .filter(F.col("occurrences") > 1)
        .select(
            *key,
            "occurrences",
            F.when(F.col("low") == F.col("high"), "identical").otherwise("contradictory").alias("kind"),
        )
    )


def unfenced(answer: Column) -> Column:
    """What a model wrote, without the code fence around it, if there is one.

    Only marks at both ends make a fence; what stands between them counts, less the language name. Marks elsewhere belong
    to the text, where they are either inside a string or make it no object and so malformed.
    """
    text = strip(F.coalesce(answer, F.lit("")))
    fenced = text.startswith("```") & text.endswith("```") & (F.length(text) >= 6)
    inner = strip(F.substring(text, F.lit(4), F.length(text) - 6))
    body = F.when(fenced, F.when(inner.startswith("json"), strip(F.substring(inner, F.lit(5), F.length(inner)))).otherwise(inner)).otherwise(text)
    # A parser stops behind the first value; as the only entry of a list, nothing may follow it.
    listed = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    alone = listed.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(alone, body).otherwise("")


def parse_model_output(outputs: DataFrame, column: str = "output", *keep: str) -> DataFrame:
    """Raw model answers to ``is_problem, confidence, reason`` and ``malformed``.

    An answer is one JSON object with exactly those fields, bare or inside one code fence.
    """
    parsed = parse(outputs.withColumn("_answer", unfenced(F.col(column))), MODEL_OUTPUT, *keep, column="_answer")
    return parsed.withColumn("malformed", F.col("rejected").isNotNull()).drop("rejected")
