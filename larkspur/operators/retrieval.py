"""Exact inner-product search: top k of every query against all rows, thresholds and metadata filters.

A query set of a checked size (`most_bytes`) is held as matrices by every task, and the rows stream past it: each task keeps
k rows per query, so rows aren't shuffled at all. A larger one meets the rows in a grid of cells: both sides are packed into
blocks, written once, and joined on the number of their cell; a cell keeps k rows per query and block. The ranks of a
query are made of these partial results. Ties go by id. A null vector, one with a null or NaN in it, or one of another
length than the query's, is in no result; nor is a row without id, or a query without any of its key's columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import materialize

STEP = 4096
CELLS = 1 << 20  # scores made at once


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) of the vectors of each length, those with a null or NaN left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dim)
        rows = flat[begin[at][:, None] + np.arange(dim)]
        good = ~np.isnan(rows).any(axis=1)
        yield at[good], rows[good]


class _Best:
    """The k best rows so far of each query, fed block by block. Scores are made for some queries at a time, so that their matrix has at most CELLS numbers."""

    def __init__(self, matrices: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> None:
        self.matrices, self.k = matrices, k
        self.parts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.least = {dim: np.full(len(at), -np.inf) for dim, (at, _) in matrices.items()}  # the k-th best, once there are k

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        dim = rows.shape[1]
        if dim not in self.matrices or not len(ids) or self.k < 1:
            return
        for at in range(0, len(ids), STEP):
            some, turned = ids[at : at + STEP], rows[at : at + STEP].T
            for first in range(0, len(self.matrices[dim][0]), CELLS // STEP):
                self._meet(dim, slice(first, first + CELLS // STEP), some, turned)

    def _meet(self, dim: int, chosen: slice, ids: np.ndarray, rows: np.ndarray) -> None:
        scores = self.matrices[dim][1][chosen] @ rows
        least = self.least[dim][chosen]
        if scores.shape[1] > self.k and not np.isfinite(least).all():
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        q, r = np.nonzero(scores >= least[:, None])
        if not len(q):
            return
        name = (dim, chosen.start)
        new = (q, ids[r], scores[q, r])
        q, i, s = (np.concatenate(x) for x in zip(self.parts[name], new, strict=True)) if name in self.parts else new
        order = np.lexsort((i, -s, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.k
        self.parts[name] = (q[kept], i[order[kept]], s[order[kept]])
        last = place == self.k - 1
        self.least[dim][chosen.start + q[last]] = s[order[last]]

    @property
    def held(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By length: (number of the query, id, score)."""
        out = {}
        for dim in self.matrices:
            of = [(q + first, i, s) for (d, first), (q, i, s) in self.parts.items() if d == dim]
            if of:
                out[dim] = tuple(np.concatenate(x) for x in zip(*of, strict=True))
        return out

    def batch(self, keys: pa.Table, names: list[str]) -> pa.RecordBatch:
        parts = [(self.matrices[d][0][q], i, s) for d, (q, i, s) in self.held.items()]
        at, ids, scores = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        taken = keys.take(pa.array(at, pa.int64())).combine_chunks()
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in taken.columns]
        return pa.record_batch([*columns, pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], names=names)


def _packed(df: DataFrame, columns: list[str], block: int) -> DataFrame:
    """(no, raw): blocks of rows as Arrow files, numbered without gaps within each task's own numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                sink = pa.BufferOutputStream()
                part = batch.slice(at, block)
                with pa.ipc.new_stream(sink, part.schema) as writer:
                    writer.write_batch(part)
                yield pa.record_batch([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["raw"])

    return materialize(df.select(*columns).mapInArrow(run, "raw binary").select(F.monotonically_increasing_id().alias("no"), "raw"), "blocks")


def top_k(queries: DataFrame, rows: DataFrame, k: int, query_key: str | Sequence[str] = "qid", row_key: str = "vec_id", vector: str = "embedding", block: int = STEP, most_bytes: int = 64 << 20) -> DataFrame:
    """(query key..., vec_id, score, rank), rank from 1. The key of a query may have several columns."""
    keys = [query_key] if isinstance(query_key, str) else list(query_key)
    kinds = dict(queries.dtypes)
    chosen = queries.where(F.col(vector).isNotNull()).dropna(subset=keys).select(*keys, F.col(vector).cast("array<double>").alias("_v"))
    stored = rows.where(F.col(row_key).isNotNull() & F.col(vector).isNotNull()).select(F.col(row_key).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
    names = [*keys, "vec_id", "score"]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "vec_id long", "score double"])
    size = 8 * (chosen.agg(F.sum(F.size("_v"))).first()[0] or 0)

    def matrices(table: pa.Table | pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        return {m.shape[1]: (at, m) for at, m in _by_length(table.column("_v")) if len(at)}

    if size <= most_bytes:
        table = chosen.toArrow()
        shared = rows.sparkSession.sparkContext.broadcast((table.select(keys), matrices(table)))

        def past(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            given, by_dim = shared.value
            best = _Best(by_dim, k)
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for at, m in _by_length(batch.column(1)):
                    best.add(ids[at], m)
            yield best.batch(given, names)

        return ranked(stored.mapInArrow(past, schema), k, keys)

    left, right = _packed(chosen, [*keys, "_v"], block), _packed(stored, ["_id", "_v"], block)
    # a grid of cells, about square in data: each query block goes to every column, each row block to every line
    across = max(1, math.isqrt(right.count()))
    down = max(1, math.isqrt(left.count()))
    left = left.select(F.pmod(F.xxhash64("no"), F.lit(down)).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("j"), F.col("raw").alias("q"))
    right = right.select(F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("i"), F.pmod(F.xxhash64("no"), F.lit(across)).alias("j"), F.col("raw").alias("r"))
    met = left.withColumn("i", F.col("i").cast("int")).join(right.withColumn("j", F.col("j").cast("int")), ["i", "j"])

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, r in zip(batch.column(0), batch.column(1), strict=True):
                given, stored_rows = (pa.ipc.open_stream(x.as_buffer()).read_all() for x in (q, r))
                best = _Best(matrices(given), k)
                ids = stored_rows.column("_id").to_numpy()
                for at, m in _by_length(stored_rows.column("_v")):
                    best.add(ids[at], m)
                yield best.batch(given.select(keys), names)

    return ranked(met.select("q", "r").mapInArrow(cell, schema), k, keys)


def ranked(hits: DataFrame, k: int, keys: Sequence[str] = ("qid",)) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def over_threshold(hits: DataFrame, threshold: float, comparator: str = "ge") -> DataFrame:
    """Applied after the top k, so fewer than k rows may be left. 'le' is the other reading of a distance threshold."""
    score = F.col("score")
    return hits.where(score >= threshold if comparator == "ge" else score <= threshold)


def has_facet(column: str, value: str) -> Column:
    """True for an empty value; else whether the facet array holds it (false for null)."""
    return F.lit(True) if value == "" else F.coalesce(F.array_contains(column, value), F.lit(False))


def fetched_then_filtered(hits: DataFrame, keep, k: int) -> DataFrame:  # noqa: ANN001
    """The other order: filter the nearest fetch_k, then cut to k; a rare facet can leave fewer than k."""
    return ranked(hits.where(keep).drop("rank"), k)


def title_distinct(hits: DataFrame, title: str, keep=None) -> DataFrame:  # noqa: ANN001
    """First hit of each title and query passes; titles are marked seen before the other tests."""
    first = F.row_number().over(Window.partitionBy("qid", title).orderBy("rank"))
    out = hits.withColumn("_first", first).where("_first = 1").drop("_first")
    return out if keep is None else out.where(keep)


def single_top_k(rows: DataFrame, query: list[float], k: int = 4, row_key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, score) for one query vector, by expressions only: TakeOrderedAndProject."""
    q = F.array(*[F.lit(float(x)) for x in query])
    score = F.aggregate(F.zip_with(F.col(vector), q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return rows.select(F.col(row_key).alias("vec_id"), score.alias("score")).where("score is not null").orderBy(F.desc("score"), "vec_id").limit(k)
