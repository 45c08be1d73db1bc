"""Anchored time chunks and incremental loading over streams."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspur.session import materialize

MERGED = 8  # key tables of a load that are made into one
OUT = "video_id string, start_seconds double, end_seconds double, text string"
STATE = "anchor double, top double, starts array<double>, ids array<bigint>, texts array<string>"


def anchored_stream(entries: DataFrame, length: float = 60.0, lateness: float = 0.0) -> DataFrame:
    """(video_id, start_seconds, end_seconds, text) of chunks as they close; the open one stays in the state.

    Entries are (video_id, entry_id, start, text). A chunk closes with the first entry at least `length` after it began, once an
    entry `lateness` after that one has been seen; until then entries may come in any order, and more than once. What comes
    for a closed chunk is dropped. The state holds the entries of a chunk and of `lateness`, whatever a recording's length.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        anchor, top, starts, ids, texts = state.get if state.exists else (0.0, 0.0, [], [], [])
        held = {(s, i): t for s, i, t in zip(starts, ids, texts, strict=True)}
        for frame in frames:
            for s, i, t in frame[["start", "entry_id", "text"]].itertuples(index=False):
                if s >= anchor:
                    held.setdefault((s, i), t if isinstance(t, str) else None)
        rows = [(s, i, t) for (s, i), t in sorted(held.items(), key=lambda x: x[0])]
        top = max([top, *(r[0] for r in rows[-1:])])
        out, words, at, first = [], [], 0, None
        for i, (start, _, text) in enumerate(rows):
            first = start if first is None else first
            if start - anchor >= length and start != first:
                if start > top - lateness:
                    break
                out.append((key[0], anchor, start, " ".join(words)))
                anchor, words, at, first = start, [], i, start
            if text is not None:
                words.append(text)
        kept = rows[at:]
        state.update((anchor, top, [r[0] for r in kept], [r[1] for r in kept], [r[2] for r in kept]))
        yield pd.DataFrame(out, columns=["video_id", "start_seconds", "end_seconds", "text"])

    rows = entries.where("video_id is not null and start is not null and not isnan(start)").select("video_id", "entry_id", "start", "text")
    return rows.groupBy("video_id").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def load_batches(target: str, key: str, parts: int = 64):  # noqa: ANN201
    """A function for foreachBatch that appends rows whose key isn't stored yet.

    The store is partitioned by the key's hash, a file for each part and batch. A batch that is run again adds nothing. Any
    failure but that of a store that isn't there yet is raised. A batch is checked against key tables, which are merged as
    they grow in number, so that it doesn't open every file of the store. They are made from the store itself at first, and
    again whenever its files aren't those that the last batch left.
    """
    levels: list[list[DataFrame]] = []
    left: list[tuple[int, int]] = []  # number and bytes of the store's files after the last batch

    def hold(keys: DataFrame) -> None:
        for no in itertools.count():
            if no == len(levels):
                levels.append([])
            levels[no].append(materialize(keys.repartition(key) if no else keys, "keys"))
            if len(levels[no]) < MERGED:
                return
            keys, levels[no] = functools.reduce(DataFrame.union, levels[no]), []

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(target)
        system = where.getFileSystem(spark._jsc.hadoopConfiguration())

        def files() -> tuple[int, int]:
            found = system.getContentSummary(where)
            return found.getFileCount(), found.getLength()

        new = batch.dropDuplicates([key]).withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        there = system.exists(where)
        if not there or left != [files()]:
            levels.clear()
            if there:
                hold(spark.read.schema(new.schema).parquet(target).select(key))
        left.clear()  # of a batch that fails nothing is known
        if known := list(itertools.chain.from_iterable(levels)):
            new = new.join(functools.reduce(DataFrame.union, known), key, "left_anti")
        new.select(*batch.columns, "part").repartition("part").write.mode("append").partitionBy("part").parquet(target)
        hold(batch.select(key).distinct())
        left.append(files())

    return write


class Progress(StreamingQueryListener):
    """State of a load: initializing, adding_documents, complete or error, with rows so far."""

    def __init__(self, total: int = 0) -> None:
        self.current, self.total, self.status = 0, total, "initializing"

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.status = "adding_documents"

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        self.current += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.status = "error" if event.exception else "complete"

    def row(self) -> dict:
        done = self.status in ("complete", "error")
        return {"current": self.current, "total": max(self.total, self.current), "status": self.status, "is_loading": not done}


def windowed_counts(events: DataFrame, time: str, by: str, minutes: int = 5, delay: str = "10 minutes") -> DataFrame:
    """Counts in tumbling windows with late rows dropped after the delay."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return timed.groupBy(F.window(time, f"{minutes} minutes"), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), by, "n")
