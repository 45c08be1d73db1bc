"""Transcript sources: landed caption files of several methods, with language preference, and retries for remote ones.

Files lie under <folder>/<method>/<video_id>.<language>.json3, generated ones with ~auto after the language. They are read by
Spark's own file source, so from any file system and as many tasks as there is data for.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import language_rank
from larkspur.operators.fusion import keep_first

METHODS = ["caption_clip", "transcript_api", "subtitle_json3"]
# Fixed value: what an error says that is worth another try.
TRY_AGAIN = "no element found"


def with_retries(fetch: Callable[[], str], attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> str:
    """The result of fetch, tried again after uniform(1, 3) * attempt seconds where the error is one of input, or says so."""
    for attempt in range(1, attempts + 1):
        try:
            return fetch()
        except Exception as e:
            if attempt == attempts or not (isinstance(e, OSError) or TRY_AGAIN in str(e)):
                raise
            wait(random.uniform(1, 3) * attempt)
    raise AssertionError


def tracks(spark: SparkSession, folder: str) -> DataFrame:
    """(video_id, method, language, is_generated, body): one row per file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json3").load(folder)
    parts = F.split("path", "/")
    name = F.split(F.element_at(parts, -1), "\\.")
    language = F.get(name, F.lit(1))
    return files.select(
        F.get(name, F.lit(0)).alias("video_id"), F.element_at(parts, -2).alias("method"),
        F.regexp_replace(language, "~auto$", "").alias("language"), language.endswith("~auto").alias("is_generated"), F.decode("content", "UTF-8").alias("body"),
    )


def preferred(tracks: DataFrame) -> DataFrame:
    """One track per video and method: English kinds first, then manual, then generated; ties by language."""
    ranked = tracks.withColumn("_r", language_rank(F.col("language"), F.col("is_generated")))
    return keep_first(ranked, ["video_id", "method"], ["_r", "language"]).drop("_r")


def method_rank(method: str = "method") -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col(method))
