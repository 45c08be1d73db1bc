"""Fusing and deduplicating ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import NOTHING_FOUND

K = 60


def reciprocal_rank_fusion(lists: DataFrame, query: str = "qid", list_no: str = "list_no", rank: str = "rank", key: str = "doc_key", k: int = K) -> DataFrame:
    """(qid, doc_key, score, place): sum of 1 / (rank + k), ranks from 0; ties by first appearance (list, then rank), place from 1.

    Rows without key or rank are dropped.
    """
    rows = lists.where(F.col(key).isNotNull() & F.col(rank).isNotNull())
    fused = rows.groupBy(query, key).agg(F.sum(1.0 / (F.col(rank) + k)).alias("score"), F.min(F.struct(list_no, rank)).alias("first"))
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(F.round("score", 12)), "first", key))
    return fused.withColumn("place", place).drop("first")


def with_placeholder(queries: DataFrame, fused: DataFrame, query: str = "qid", key: str = "doc_key", placeholder: str = NOTHING_FOUND) -> DataFrame:
    """(qid, doc_key): the fused rows, and one placeholder for each query whose lists were all empty."""
    empty = queries.select(query).distinct().join(fused.select(query), query, "left_anti")
    return fused.select(query, key).union(empty.select(query, F.lit(placeholder).cast(dict(fused.dtypes)[key]).alias(key)))


def unique_union(lists: DataFrame, query: str = "qid", list_no: str = "list_no", rank: str = "rank", key: str = "doc_key") -> DataFrame:
    """(qid, doc_key, place): each document once, in order of first appearance."""
    first = lists.groupBy(query, key).agg(F.min(F.struct(list_no, rank)).alias("first"))
    place = F.row_number().over(Window.partitionBy(query).orderBy("first", key))
    return first.select(query, key, place.alias("place"))


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First row of each key; nulls in the key are one value. Whole rows compete in a map-side-combined minimum, so a hot key is merged before the shuffle."""
    others = [c for c in df.columns if c not in key]
    row = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in others if c not in order])
    return df.groupBy(*key).agg(F.min(row).alias("_row")).select(*key, *[F.col(f"_row.`{c}`").alias(c) for c in others if c in others])


def zipped(df: DataFrame, left: str, right: str, *keep: str) -> DataFrame:
    """(keep..., no, left, right): two arrays side by side, as far as both go; no from 1. A null array gives no rows."""
    pairs = F.slice(F.arrays_zip(F.col(left).alias("left"), F.col(right).alias("right")), F.lit(1), F.least(F.size(left), F.size(right)))
    both = df.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(*keep, F.posexplode(pairs).alias("no", "p"))
    return both.select(*keep, (F.col("no") + 1).alias("no"), "p.left", "p.right")
