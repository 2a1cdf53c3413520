"""Text to unit vectors: pluggable batch encoders and a built-in hashing encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnflow.functions.text import counted_words, is_blank, words
from cairnflow.functions.vectors import is_valid_vector
from cairnflow.operators.skew import join_by_weight
from cairnflow.schemas import EMBEDDING_SIZE
from cairnflow.session import materialize

Encoder = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
VECTOR_TYPE = T.ArrayType(T.FloatType())


def encode(items: DataFrame, encoder: Encoder, model_name: str, size: int = EMBEDDING_SIZE) -> DataFrame:
    """Problem items with ``embedding`` and ``embedding_model`` from a batch encoder.

    The encoder maps ``(id, document_text)`` batches to ``(id, embedding)``, loading its model once
    per task. A vector of the wrong length or with a non-finite value fails the job.
    """
    if not model_name.strip():
        raise ValueError("model_name must not be blank")
    texts = items.filter(F.col("is_problem") & ~is_blank(F.col("document_text"))).select("id", "document_text")
    schema = T.StructType([texts.schema["id"], T.StructField("embedding", VECTOR_TYPE)])
    vectors = texts.mapInPandas(encoder, schema)
    checked = F.when(is_valid_vector(F.col("embedding"), size), F.col("embedding")).otherwise(
        F.raise_error(F.lit(f"encoder must return {size} finite values"))
    )
    return items.drop("embedding", "embedding_model").join(
        vectors.select("id", checked.alias("embedding"), F.lit(model_name.strip()).alias("embedding_model")), "id"
    )


def hashed_vector(text: Column, size: int = EMBEDDING_SIZE) -> Column:
    """A deterministic unit vector of the words of the whole text.

    Splitting and hashing stay on the JVM; Python only folds the hashes of a batch into ``size``
    signed counters, so no text is sent to it.
    """

    @F.pandas_udf(VECTOR_TYPE)
    def fold(batch: pd.Series) -> pd.Series:
        lengths = batch.map(len).to_numpy()
        hashes = np.concatenate([np.asarray(h, dtype=np.int64) for h in batch]) if lengths.sum() else np.empty(0, np.int64)
        row = np.repeat(np.arange(len(batch)), lengths)
        slot = (hashes >> 1) % size
        sign = np.where(hashes & 1, 1.0, -1.0)
        table = np.bincount(row * size + slot, weights=sign, minlength=len(batch) * size)
        table = table.astype(float).reshape(len(batch), size)
        # A text without words, or whose words cancel out, still gets a unit vector.
        table[~table.any(axis=1), 0] = 1.0
        table /= np.linalg.norm(table, axis=1, keepdims=True)
        return pd.Series(list(table.astype(np.float32)))

    return fold(F.transform(words(text), lambda word: F.xxhash64(word)))


def hashing_model_name(size: int = EMBEDDING_SIZE) -> str:
    return f"hashed-words-{size}"


def encode_by_hashing(items: DataFrame, size: int = EMBEDDING_SIZE) -> DataFrame:
    """Problem items with a hashing vector; other items are left out."""
    return items.filter(F.col("is_problem") & ~is_blank(F.col("document_text"))).withColumns(
        {"embedding": hashed_vector(F.col("document_text"), size), "embedding_model": F.lit(hashing_model_name(size))}
    )


# --- weighted words ---------------------------------------------------------------------------


def document_weights(items: DataFrame) -> DataFrame:
    """``(id, term, weight)``: count of each word of a document times its rarity ``ln((1 + n) / (1 + df)) + 1`` in all of them."""
    terms, n = counted_words(items, "term")
    terms = materialize(terms, "document-terms")
    rarity = terms.groupBy("term").agg(F.count("*").alias("df")).select("term", "df", (F.log((1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    # A word that all documents have is one key with a row per document.
    joined = join_by_weight(terms, rarity, ["term"], "df", "id")
    return joined.select("id", "term", (F.col("tf") * F.col("idf")).alias("weight"))


def encode_by_projection(items: DataFrame, size: int = EMBEDDING_SIZE, seed: int = 7) -> DataFrame:
    """Problem items with the projection of their weighted words onto ``size`` unit coordinates; rarity is that of the problems.

    The projection adds each word, with a sign, to one coordinate; both are drawn by ``seed`` and the word. The cosine of two
    documents is kept with a standard error of about ``1 / sqrt(size)``. A document without words gets the first coordinate.
    """
    problems = items.filter(F.col("is_problem") & ~is_blank(F.col("document_text")))
    drawn = F.xxhash64("term", F.lit(seed))
    slot = F.pmod(F.shiftright(drawn, 1), F.lit(size)).cast("int")
    sign = F.when(drawn % 2 == 0, 1.0).otherwise(-1.0)
    weights = document_weights(problems).select("id", slot.alias("slot"), (sign * F.col("weight")).alias("value"))
    summed = weights.groupBy("id", "slot").agg(F.sum("value").alias("value")).filter("value <> 0")
    # At most ``size`` entries a document.
    sparse = summed.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("entries"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("length"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (F.coalesce(F.element_at("entries", i), F.lit(0.0)) / F.col("length")).cast("float"))
    empty = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == 0, 1.0).otherwise(0.0).cast("float"))
    vectors = sparse.select("id", dense.alias("embedding"))
    encoded = problems.drop("embedding", "embedding_model").join(vectors, "id", "left")
    return encoded.withColumns({"embedding": F.coalesce("embedding", empty), "embedding_model": F.lit(f"projected-words-{size}")})
