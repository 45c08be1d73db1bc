"""Sets of hashed items as a bit table of fixed size, for filters that are broadcast."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.grams import mix


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (mix(hashes.view(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def bit_table(hashes: DataFrame, bits: int) -> Broadcast:
    """Broadcast table of 2**bits bits in which every hash (first column, BIGINT) is marked; packed, in bytes."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, dtype=bool)
        for batch in batches:
            table[slots(batch.column(0).to_numpy(), bits)] = True
        yield pa.record_batch([pa.array([zlib.compress(np.packbits(table).tobytes(), 1)], pa.binary())], names=["raw"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((1 << bits) // 8, dtype=np.uint8)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                out |= np.frombuffer(zlib.decompress(raw), dtype=np.uint8)
        yield pa.record_batch([pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())], names=["raw"])

    merged = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for row in hashes.mapInArrow(mark, "raw binary").repartition(8).mapInArrow(merge, "raw binary").collect():  # 8 rows of fixed size
        merged |= np.frombuffer(zlib.decompress(row["raw"]), dtype=np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(merged)


def unpacked(table: Broadcast) -> np.ndarray:
    return np.unpackbits(table.value).astype(bool)


def keep_marked(df: DataFrame, column: str, table: Broadcast, bits: int) -> DataFrame:
    """Rows whose BIGINT column is marked in the table, and a few others."""
    at = df.columns.index(column)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = unpacked(table)
        for batch in batches:
            yield batch.filter(pa.array(flags[slots(batch.column(at).to_numpy(), bits)]))

    return df.where(F.col(column).isNotNull()).mapInArrow(keep, df.schema)
