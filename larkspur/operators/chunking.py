"""Chunkers: by size, by sentences, by separators, and by time.

Sizes are in code points. A null or empty text has no chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Separators of the recursive splitter, from coarse to fine.
SEPARATORS = ["\n\n", "\n", " ", ""]


def fixed_chunks(df: DataFrame, text: str, size: Column | int, *keep: str) -> DataFrame:
    """(keep..., chunk_no, chunk): cuts every `size` code points, chunk_no from 0."""
    size = F.lit(size) if isinstance(size, int) else size
    rows = df.where(F.length(text) > 0).select(*keep, F.col(text).alias("_t"), size.alias("_n"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length("_t") - 1) / F.col("_n")).cast("int")), lambda i: F.substring(F.col("_t"), i * F.col("_n") + 1, F.col("_n")))
    return rows.select(*keep, F.posexplode(parts).alias("chunk_no", "chunk"))


def _packed_lengths(lengths: pd.Series, limits: pd.Series) -> pd.Series:
    """The number of each sentence's chunk."""
    out = []
    for each, limit in zip(lengths, limits, strict=True):
        no, filled, of = -1, 0, []
        for n in each:
            if no >= 0 and filled + n <= limit:
                filled += n + 1
            else:
                no, filled = no + 1, n
            of.append(no)
        out.append(of)
    return pd.Series(out)


def sentence_chunks(df: DataFrame, text: str, size: Column | int, *keep: str) -> DataFrame:
    """(keep..., chunk_no, chunk): sentences packed greedily, so that chunk plus sentence, without the space between, is at most `size`.

    A sentence is what ends with . ! or ?; it is trimmed, and blank ones are left out. A longer sentence stays whole.
    """
    size = F.lit(size) if isinstance(size, int) else size
    rows = df.where(F.length(text) > 0).select(*keep, F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]*"), 0).alias("_s"), size.alias("_n"))
    rows = rows.withColumn("_s", F.filter(F.transform("_s", lambda s: F.trim(s, F.lit(" \n\r\t"))), lambda s: s != ""))
    # only lengths go to the fold, in Arrow batches: an accumulated array would be copied for every sentence
    folded = rows.withColumn("_of", F.pandas_udf(_packed_lengths, "array<int>")(F.transform("_s", lambda s: F.length(s)), F.col("_n")))
    each = folded.select(*keep, F.posexplode(F.arrays_zip("_of", "_s")).alias("_p", "_x"))
    joined = each.groupBy(*keep, F.col("_x._of").alias("chunk_no")).agg(F.array_sort(F.collect_list(F.struct("_p", "_x._s"))).alias("_l"))  # one chunk's sentences
    return joined.select(*keep, "chunk_no", F.array_join(F.transform("_l", lambda x: x["_s"]), " ").alias("chunk"))


def recursive_split(text: str, size: int = 512, overlap: int = 32) -> list[str]:
    """Split at the first separator that occurs, long parts at the next ones; join neighbours up to `size`, keeping up to `overlap` of the last ones."""

    def pieces(part: str, level: int) -> list[str]:
        while level < len(SEPARATORS) - 1 and SEPARATORS[level] not in part:
            level += 1
        mark = SEPARATORS[level]
        if not mark:
            return list(part)
        cut = re.split(f"(?={re.escape(mark)})", part)
        out: list[str] = []
        for x in cut:
            if x and len(x) < size:
                out.append(x)
            elif x:
                out.append("\0")  # what is longer is joined by itself
                out += [*join(pieces(x, level + 1)), "\0"]
        return out

    def join(parts: list[str]) -> list[str]:
        out: list[str] = []
        held: list[str] = []
        total = 0
        whole = False

        def flush() -> None:
            if chunk := "".join(held).strip():
                out.append(chunk)

        for x in parts:
            if x == "\0":
                flush()
                held, total, whole = [], 0, not whole
                continue
            if whole:
                out.append(x)
                continue
            if held and total + len(x) > size:
                flush()
                while held and (total > overlap or total + len(x) > size):
                    total -= len(held.pop(0))
            held.append(x)
            total += len(x)
        flush()
        return out

    return join(pieces(text, 0)) if text else []


def recursive_chunks(df: DataFrame, text: str, *keep: str, size: int = 512, overlap: int = 32) -> DataFrame:
    """(keep..., chunk_no, chunk) of the recursive splitter; the parent's columns go with every chunk."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: recursive_split(t, size, overlap) if isinstance(t, str) else [])

    return df.select(*keep, F.posexplode(cut(F.col(text))).alias("chunk_no", "chunk"))


def two_level_chunks(df: DataFrame, text: str, *keep: str, outer: tuple[int, int] = (4000, 200), inner: tuple[int, int] = (512, 32)) -> DataFrame:
    """Pages cut large first, then each part small: (keep..., part_no, chunk_no, chunk)."""
    parts = recursive_chunks(df, text, *keep, size=outer[0], overlap=outer[1]).withColumnsRenamed({"chunk_no": "part_no", "chunk": "_part"})
    return recursive_chunks(parts, "_part", *keep, "part_no", size=inner[0], overlap=inner[1])


def _given_start(df: DataFrame, group: str, start: str) -> DataFrame:
    return df.where(F.col(group).isNotNull() & F.col(start).isNotNull() & ~F.isnan(start))


def anchored_starts(df: DataFrame, group: str, start: str, length: float, window: float = 3600.0) -> DataFrame:
    """(group, start, anchor): for each distinct start the beginning of its chunk.

    A chunk begins at the first start that is at least `length` after the chunk before began; the first one counts from
    0. That is a chain over a whole group, but what one window of it does depends only on where the chain enters it: at the
    first start at least `length` after the last anchor, so in the window's first `length` or at the first start after.
    Each window tabulates where the chain leaves it for each of those entries; the chain then runs over these small
    tables, and every window fills in its own anchors. No task holds more of a group than a window or its tables.
    """
    schema = df.select(group).schema[0].dataType.simpleString()
    rows = _given_start(df, group, start).select(F.col(group).alias("g"), F.col(start).cast("double").alias("s")).distinct()
    # a first start after `length` finds nothing to close, so it stays in the chunk that begins at 0
    late = rows.groupBy("g").agg(F.min("s").alias("s")).where(F.col("s") >= length).withColumn("anchor", F.lit(0.0))
    rows = rows.join(late.select("g", "s"), ["g", "s"], "left_anti").withColumn("w", F.floor(F.col("s") / window).cast("long"))

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.sort(pdf["s"].to_numpy())
        nxt = np.searchsorted(s, s + length, side="left")
        leave = np.arange(len(s))
        for i in range(len(s) - 1, -1, -1):
            if nxt[i] < len(s):
                leave[i] = leave[nxt[i]]
        n = int(np.searchsorted(s, pdf["w"].iloc[0] * window + length, side="left")) + 1
        n = min(n, len(s))
        return pd.DataFrame({"g": pdf["g"].iloc[0], "w": pdf["w"].iloc[0], "entry": [s[:n].tolist()], "leave": [s[leave[:n]].tolist()]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("w")
        anchor, out = 0.0, []
        for entry, leave in zip(pdf["entry"], pdf["leave"], strict=True):
            out.append(anchor)
            at = int(np.searchsorted(entry, anchor + length, side="left"))
            if at < len(entry):
                anchor = leave[at]
        return pd.DataFrame({"g": pdf["g"], "w": pdf["w"], "carry": out})

    tables = rows.groupBy("g", "w").applyInPandas(table, f"g {schema}, w long, entry array<double>, leave array<double>")
    carried = tables.groupBy("g").applyInPandas(chain, f"g {schema}, w long, carry double")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.sort(pdf["s"].to_numpy())
        anchor, out = float(pdf["carry"].iloc[0]), []
        for x in s.tolist():
            if x - anchor >= length:
                anchor = x
            out.append(anchor)
        return pd.DataFrame({"g": pdf["g"].iloc[0], "s": s, "anchor": out})

    got = rows.join(carried, ["g", "w"]).groupBy("g", "w").applyInPandas(fill, f"g {schema}, s double, anchor double")
    return got.union(late.select("g", "s", "anchor")).select(F.col("g").alias(group), F.col("s").alias(start), "anchor")


def anchored_chunks(df: DataFrame, group: str, start: str, text: str, order: str, length: float = 60.0) -> DataFrame:
    """(group, start_seconds, end_seconds, text): chunks of at least `length` between anchors; the last has no end.

    Entries of equal start are in one chunk, in order of `order`. A first start at or after `length` stays in the chunk that
    begins at 0. Null texts add nothing. Rows without group or start are dropped.
    """
    rows = _given_start(df, group, start).withColumn(start, F.col(start).cast("double"))
    anchors = anchored_starts(rows, group, start, length)
    by_chunk = rows.join(anchors, [group, start])
    low = Window.partitionBy(group).orderBy("anchor")
    lists = by_chunk.groupBy(group, "anchor").agg(F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(start, order, text)))).alias("l"))  # one chunk's entries
    chunks = lists.select(group, F.col("anchor").alias("start_seconds"), F.lead("anchor").over(low).alias("end_seconds"), F.array_join(F.transform("l", lambda x: x[text]), " ").alias("text"))
    return chunks


def grid_chunks(df: DataFrame, group: str, start: str, duration: str, text: str, order: str, length: float = 60.0) -> DataFrame:
    """(group, chunk_no, start_seconds, text): an entry that ends after the limit closes the chunk (if it has entries) and moves the limit on by one step.

    One step for each such entry, so after a long gap the limit lags behind. Each group streams through a fold in order of
    start, held in one chunk of memory at a time. Null durations are 0, null texts add nothing.
    """
    kind = df.select(group).schema[0].dataType.simpleString()
    rows = _given_start(df, group, start).select(F.col(group).alias("g"), F.col(start).cast("double").alias("s"), F.coalesce(F.when(~F.isnan(duration), F.col(duration)), F.lit(0.0)).alias("d"), F.col(text).alias("t"), F.col(order).alias("o"))
    rows = rows.repartition("g").sortWithinPartitions("g", "s", "o")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, limit, no, begin = None, length, 0, 0.0
        held: list[str] = []
        filled = False
        for batch in batches:
            out: list[tuple] = []
            for g, s, d, t in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if g != now:
                    if filled:
                        out.append((now, no, begin, " ".join(held)))
                    now, limit, no, begin, held, filled = g, length, 0, 0.0, [], False
                if s + d > limit:
                    if filled:
                        out.append((g, no, begin, " ".join(held)))
                        no += 1
                        held, filled = [], False
                    begin = limit
                    limit += length
                filled = True
                if t is not None:
                    held.append(t)
            yield _rows(out, batch.schema.field(0).type)
        if filled:
            yield _rows([(now, no, begin, " ".join(held))], batch.schema.field(0).type)

    def _rows(out: list[tuple], key) -> pa.RecordBatch:  # noqa: ANN001
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (key, pa.int32(), pa.float64(), pa.string()), strict=True)], names=["g", "chunk_no", "start_seconds", "text"])

    return rows.mapInArrow(run, f"g {kind}, chunk_no int, start_seconds double, text string").withColumnRenamed("g", group)


def tumbling_chunks(df: DataFrame, group: str, start: str, text: str, order: str, length: float = 60.0) -> DataFrame:
    """(group, bucket, text): plain buckets of `length`, the simple form of the grid."""
    rows = _given_start(df, group, start).withColumn("bucket", F.floor(F.col(start) / length).cast("long"))
    lists = rows.groupBy(group, "bucket").agg(F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(start, order, text)))).alias("l"))
    return lists.select(group, "bucket", F.array_join(F.transform("l", lambda x: x[text]), " ").alias("text"))
