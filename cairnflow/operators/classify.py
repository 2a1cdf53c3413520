"""Problem classification: pluggable batch scorers, a lexical scorer, a trained linear scorer.

A scorer is ``Iterator[pd.DataFrame] -> Iterator[pd.DataFrame]`` over ``(row_id, document_text)`` that
returns ``(row_id, output)`` with the raw model answer; a model is loaded once per task, before the loop.
Answers are validated on the JVM, and malformed ones become conservative non-problems.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnflow.functions.text import counted_words, is_blank, words
from cairnflow.operators.skew import join_by_weight
from cairnflow.session import materialize, shared_folder
from cairnflow.sources.records import parse_model_output

Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

# Fixed value: the stored reason of an answer that could not be read.
MALFORMED_REASON = "Malformed classifier output"

# Phrases that announce a pain point, an unmet need or a request for a tool.
PROBLEM_CUES = (
    r"\bi wish\b",
    r"\bis there (a|an|any) (tool|app|way|service|library)\b",
    r"\b(frustrat\w+|annoy\w+|tedious|painful|struggl\w+)\b",
    r"\b(manual(ly)?|by hand|copy(ing)? and past\w+)\b",
    r"\b(keeps?|kept) (fail\w+|break\w+|copying|crash\w+)\b",
    r"\b(los(e|ing)|wast(e|ing)) (\w+ ){0,3}(hours?|days?|time)\b",
    r"\b(can ?not|can't|unable to|no way to)\b",
    r"\b(fails?|breaks?|crash(es)?) (unpredictably|randomly|every)\b",
)
LEXICAL_NAME = "lexical-cues"


def classify(items: DataFrame, scorer: Scorer, classifier_name: str, key: Sequence[str] = ("source", "external_id")) -> DataFrame:
    """Items with verdict columns and ``malformed``.

    Each different text of a key is scored once and its verdict goes to all rows that have it, so repeats neither
    multiply nor swap verdicts. Blank documents are not sent to the scorer; their verdict columns stay NULL, which
    ``quality.classification_violations`` reports. Only an id and the text travel to Python; filters belong before
    this call, since the optimizer does not move them through it.
    """
    row_id = F.sha2(F.to_json(F.struct(*key, "document_text")), 256)
    items = items.withColumn("row_id", F.when(~is_blank(F.col("document_text")), row_id))
    sent = items.filter(F.col("row_id").isNotNull()).select("row_id", "document_text").dropDuplicates(["row_id"])
    answers = sent.mapInPandas(scorer, T.StructType([sent.schema["row_id"], T.StructField("output", T.StringType())]))
    parsed = parse_model_output(answers, "output", "row_id")
    verdicts = parsed.select(
        "row_id",
        F.col("malformed").alias("answer_malformed"),
        F.coalesce("is_problem", F.lit(False)).alias("is_problem"),
        F.coalesce("confidence", F.lit(0.0)).alias("problem_confidence"),
        F.coalesce("reason", F.lit(MALFORMED_REASON)).alias("problem_reason"),
        F.lit(classifier_name).alias("problem_classifier"),
    )
    bare = items.drop("is_problem", "problem_confidence", "problem_reason", "problem_classifier", "malformed")
    judged = bare.join(verdicts, "row_id", "left")
    return judged.withColumn("malformed", F.coalesce("answer_malformed", F.lit(False))).drop("row_id", "answer_malformed")


def cue_count(text: Column, cues: Sequence[str] = PROBLEM_CUES) -> Column:
    """How many different cues occur in the text."""
    lowered = F.lower(text)
    total = F.lit(0)
    for cue in cues:
        total = total + F.when(lowered.rlike(cue), 1).otherwise(0)
    return total


def classify_lexically(items: DataFrame, cues: Sequence[str] = PROBLEM_CUES) -> DataFrame:
    """A rule-based scorer made of column expressions: no Python, no shuffle."""
    counted = items.withColumn("_cues", cue_count(F.col("document_text"), cues))
    found = F.col("_cues") > 0
    return counted.withColumns(
        {
            "is_problem": found,
            # One cue 0.6, two 0.8, more 0.9; none is a weak negative.
            "problem_confidence": F.when(F.col("_cues") > 2, 0.9)
            .when(F.col("_cues") == 2, 0.8)
            .when(F.col("_cues") == 1, 0.6)
            .otherwise(0.5),
            "problem_reason": F.when(found, F.concat(F.lit("problem cues: "), F.col("_cues"))).otherwise("no problem cue"),
            "problem_classifier": F.lit(LEXICAL_NAME),
            "malformed": F.lit(False),
        }
    ).drop("_cues")


def train_linear(labelled: DataFrame, features: int = 1 << 14, iterations: int = 20):
    """A logistic model over hashed words of ``(document_text, expected)``."""
    rows = labelled.select(
        words(F.col("document_text")).alias("words"), F.col("expected").cast("double").alias("label")
    )
    stages = [
        HashingTF(inputCol="words", outputCol="features", numFeatures=features, binary=True),
        LogisticRegression(maxIter=iterations, regParam=0.01),
    ]
    # Saved and read back: the stored model leaves out the training summary, which would carry the
    # training session into every scoring task.
    path = f"{shared_folder(labelled.sparkSession)}/cairnflow-model-{uuid.uuid4().hex}"
    Pipeline(stages=stages).fit(rows).write().save(path)
    return PipelineModel.load(path)


def classify_linearly(items: DataFrame, model, name: str = "hashed-logistic") -> DataFrame:
    """Verdicts of a trained model; confidence is the probability of the verdict."""
    scored = model.transform(items.withColumn("words", words(F.col("document_text"))))
    probability = F.element_at(vector_to_array("probability"), 2)
    verdict = probability >= 0.5
    return scored.withColumns(
        {
            "is_problem": verdict,
            "problem_confidence": F.when(verdict, probability).otherwise(1 - probability),
            "problem_reason": F.lit("linear model over document words"),
            "problem_classifier": F.lit(name),
            "malformed": F.lit(False),
        }
    ).drop("words", "features", "rawPrediction", "probability", "prediction")


# --- word counts ------------------------------------------------------------------------------

COUNTS_NAME = "word-counts"


def word_counts(labelled: DataFrame) -> DataFrame:
    """``(word, yes, no)``: how often a word occurs in the problems and the others of ``(document_text, expected)``."""
    known = labelled.filter(F.col("expected").isNotNull())
    found = known.select(F.explode(words(F.col("document_text"))).alias("word"), "expected")
    return found.groupBy("word").agg(F.count_if("expected").alias("yes"), F.count_if(~F.col("expected")).alias("no"))


def classify_by_counts(items: DataFrame, labelled: DataFrame) -> DataFrame:
    """``(id, is_problem, problem_confidence)``: multinomial Bayes over the words that the labelled documents have.

    The model is a table of counts that stays a DataFrame. Documents are reduced to counted words before the join, and words that
    very many documents have are spread. Words are smoothed by one; a document without a known word goes by the shares of the labels.
    """
    counts = materialize(word_counts(labelled), "word-counts")
    sums = counts.agg(F.coalesce(F.sum("yes"), F.lit(0)).alias("yes"), F.coalesce(F.sum("no"), F.lit(0)).alias("no"), F.count("*").alias("words")).head()
    priors = labelled.agg(F.count_if("expected").alias("yes"), F.count_if(~F.col("expected")).alias("no")).head()
    ratio = F.log((F.col("yes") + 1) / (sums["yes"] + sums["words"])) - F.log((F.col("no") + 1) / (sums["no"] + sums["words"]))
    tokens = materialize(counted_words(items, "word")[0], "document-words")
    spread = tokens.groupBy("word").agg(F.count("*").alias("documents"))
    weighted = join_by_weight(tokens, counts.join(spread, "word").select("word", ratio.alias("ratio"), "documents"), ["word"], "documents", "id")
    odds = weighted.groupBy("id").agg(F.sum(F.col("tf") * F.col("ratio")).alias("odds"))
    prior = F.lit(math.log((priors["yes"] + 1) / (priors["no"] + 1)))
    total = F.coalesce("odds", F.lit(0.0)) + prior
    scored = items.select("id").join(odds, "id", "left").withColumn("total", total)
    return scored.select("id", (F.col("total") >= 0).alias("is_problem"), (1 / (1 + F.exp(-F.least(F.abs("total"), F.lit(700.0))))).alias("problem_confidence"))
