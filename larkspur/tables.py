"""Reading the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def latest(df: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """One row per key: the one with the greatest `order` values, ties by the kept values.

    A map-side-combined aggregate, so a key that fills a third of all rows is merged before the shuffle.
    Rows without key are dropped: without a key they can't be told from each other.
    """
    packed = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in keep if c not in order])
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(packed).alias("_row"))
    return out.select(key, *[F.col(f"_row.`{c}`").alias(c) for c in keep])
