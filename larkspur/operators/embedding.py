"""Embedders and PCA."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def placeholder_embedding(text: Column, dims: int = 768) -> Column:
    """The same number, 0 to 999, in every place, from a stable hash of the text; null for null."""
    number = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 1000
    return F.when(text.isNotNull(), F.array_repeat(number.cast("double"), dims))


def letter_embedding(text: Column) -> Column:
    """Deterministic stand-in for a model, by expressions only: how often each letter from a to z occurs; null for null."""
    low = F.lower(text)
    return F.when(text.isNotNull(), F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c)))).cast("float") for c in "abcdefghijklmnopqrstuvwxyz"]))


def hash_embedder(dims: int = 64) -> Callable[[Column], Column]:
    """Deterministic stand-in for a model: signed word hashing, unit length (all zeros for a text without words)."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        from larkspur.functions.grams import words

        given = [t if isinstance(t, str) else "" for t in texts]
        hashes, of = words(given)
        out = np.zeros((len(given), dims))
        np.add.at(out, (of, (hashes % np.uint64(dims)).astype(int)), np.where((hashes >> np.uint64(40)) & np.uint64(1), 1.0, -1.0))
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return pd.Series(list((out / np.where(length == 0, 1, length)).astype(np.float32)))

    return embed


def pca(df: DataFrame, vector: str, k: int, key: str) -> DataFrame:
    """(key, reduced): centred projections on the first min(k, dims, rows) components; each component's largest loading is positive.

    Rows with a null vector are dropped; no rows give no rows. The covariance is summed over partitions, so only a
    matrix of dims x dims is gathered.
    """
    rows = df.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v"))
    n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return rows.select(key, F.col("v").alias("reduced"))
    model = PCA(k=min(k, dims, n), inputCol="x", outputCol="y").fit(rows.select(array_to_vector("v").alias("x")))
    load = model.pc.toArray()
    load = load * np.where(load[np.abs(load).argmax(axis=0), np.arange(load.shape[1])] < 0, -1.0, 1.0)
    # the mean vector: one row per place
    mean = np.array([r["m"] for r in rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()])
    shift = mean @ load

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = np.asarray(batch.column(1).to_pylist(), dtype=np.float64) @ load - shift
                yield pa.record_batch([batch.column(0), pa.array(list(flat), pa.list_(pa.float64()))], names=[key, "reduced"])

    return rows.mapInArrow(project, f"{key} {dict(rows.dtypes)[key]}, reduced array<double>")


def pca_by(df: DataFrame, vector: str, k: str, group: str, key: str, *keep: str) -> DataFrame:
    """(group, key, keep..., reduced): `pca` of each group's vectors for itself, with the components that column k gives for the group.

    A group is reduced in one task and must fit there. Where its vectors differ in length, or one is null, `reduced` is null.
    """
    rows = df.select(group, key, *keep, F.col(k).alias("_k"), F.col(vector).cast("array<double>").alias("_v"))
    kinds = dict(rows.dtypes)

    def reduce(table: pa.Table) -> pa.Table:
        v = table.column("_v").combine_chunks()
        columns = {c: table.column(c) for c in (group, key, *keep)}
        lengths = set(v.value_lengths().to_pylist())
        if len(lengths) > 1 or None in lengths or 0 in lengths:
            return pa.table(columns | {"reduced": pa.nulls(len(v), pa.list_(pa.float64()))})
        flat = np.asarray(v.flatten()).reshape(len(v), -1)
        centred = flat - flat.mean(axis=0)
        _, _, load = np.linalg.svd(centred, full_matrices=False)
        load = load[: table.column("_k")[0].as_py()].T  # of at most min(dims, rows) components
        load = load * np.where(load[np.abs(load).argmax(axis=0), np.arange(load.shape[1])] < 0, -1.0, 1.0)
        return pa.table(columns | {"reduced": pa.array(list(centred @ load), pa.list_(pa.float64()))})

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in (group, key, *keep)), "reduced array<double>"])
    return rows.groupBy(group).applyInArrow(reduce, schema)
