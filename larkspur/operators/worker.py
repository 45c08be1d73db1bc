"""The text worker: validated messages to chunks, embeddings and reduced embeddings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.chunking import sentence_chunks
from larkspur.operators.embedding import pca_by, placeholder_embedding

# Defaults of a message, and what a response says of an error.
NO_TEXT = "No text provided"
FAILED = "The embeddings could not be reduced"
DEFAULT_SIZE = 1000
DEFAULT_COMPONENTS = 256


def size_of(column: str = "chunk_size") -> Column:
    """A message's chunk size, the default for null and for less than 1."""
    return F.when(F.col(column) >= 1, F.col(column)).otherwise(DEFAULT_SIZE)


def status(messages: DataFrame) -> DataFrame:
    """Adds status_code: 400 for a null or empty text, else 200."""
    return messages.withColumn("status_code", F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 400).otherwise(200))


def reduced_chunks(messages: DataFrame, key: str, components: int = DEFAULT_COMPONENTS, embed: Callable[[Column], Column] = placeholder_embedding) -> DataFrame:
    """(key, chunk_no, chunk, reduced): chunk, embed and reduce each message's text for itself, to its own pca_components.

    These are `components` where null, below 1 or not given, and at most the places of an embedding and the message's chunks.
    """
    asked = F.when(F.col("pca_components") >= 1, F.col("pca_components")).otherwise(components) if "pca_components" in messages.columns else F.lit(components)
    chunks = sentence_chunks(messages.where(F.length("text") > 0).withColumn("k", asked), "text", size_of(), key, "k")
    # the vectors are made where they are reduced, so only chunks are shuffled
    embedded = chunks.repartition(key).select(key, "k", "chunk_no", "chunk", embed(F.col("chunk")).alias("v"))
    return pca_by(embedded, "v", "k", key, "chunk_no", "chunk")


def processed(messages: DataFrame, key: str, components: int = DEFAULT_COMPONENTS, embed: Callable[[Column], Column] = placeholder_embedding) -> DataFrame:
    """(key, status_code, chunk_count, embedding_dimensions): one row per message.

    400 for a null or empty text, 500 for one whose embeddings can't be reduced, as where they differ in length or are null.
    """
    reduced = reduced_chunks(messages, key, components, embed)
    sizes = reduced.groupBy(key).agg(F.count("*").alias("chunks"), F.max(F.size("reduced")).alias("dims"), F.bool_or(F.col("reduced").isNull()).alias("failed"))
    out = status(messages.groupBy(key).agg(F.max("text").alias("text"))).join(sizes, key, "left")
    failed = F.coalesce("failed", F.lit(False))
    count, dims = (F.when(failed, 0).otherwise(F.coalesce(c, F.lit(0))) for c in ("chunks", "dims"))
    return out.select(key, F.when(failed, 500).otherwise(F.col("status_code")).alias("status_code"), count.alias("chunk_count"), dims.alias("embedding_dimensions"))


def responses(messages: DataFrame, key: str, components: int = DEFAULT_COMPONENTS, embed: Callable[[Column], Column] = placeholder_embedding) -> DataFrame:
    """(key, response): what a caller of the worker gets, as JSON with its body as JSON text inside."""
    lists = reduced_chunks(messages, key, components, embed).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk", "reduced"))).alias("l"))  # one message's chunks
    told = processed(messages, key, components, embed).join(lists, key, "left")
    made = F.to_json(F.struct(F.transform("l", lambda x: x["chunk"]).alias("chunks"), F.transform("l", lambda x: x["reduced"]).alias("embeddings"), "chunk_count", "embedding_dimensions"))
    none = F.to_json(F.struct(F.array().cast("array<string>").alias("chunks"), F.array().cast("array<array<double>>").alias("embeddings"), "chunk_count", "embedding_dimensions"))
    code = F.col("status_code")
    error = F.to_json(F.struct(F.when(code == 400, NO_TEXT).otherwise(FAILED).alias("error")))
    body = F.when(code != 200, error).when(F.col("l").isNull(), none).otherwise(made)
    return told.select(key, F.to_json(F.struct(code.alias("statusCode"), body.alias("body"))).alias("response"))
