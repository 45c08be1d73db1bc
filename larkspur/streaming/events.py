"""Ordered answer events: numbering, filtering by tag, idempotent consumption, frames, the terminal error."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspur.functions.json_doc import sse_frame

# Fixed value: what a client is told when an answer fails.
FAILED = "An error occurred while processing your query."


def numbered(events: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds `order`, from 0, counting every internal event, so that emitted ones rise with gaps."""
    return events.withColumn("order", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)


def numbered_stream(events: DataFrame, group: str, order: str) -> DataFrame:
    """As `numbered`, over a stream of (group, order column, message): the count goes on over micro-batches and is all the state there is."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (n,) = state.get if state.exists else (0,)
        rows = pd.DataFrame([r for f in frames for r in f[[group, order, "message"]].itertuples(index=False)], columns=[group, order, "message"]).sort_values(order, kind="stable")
        rows["order"] = range(n, n + len(rows))
        state.update((n + len(rows),))
        yield rows

    kinds = dict(events.dtypes)
    schema = f"{group} {kinds[group]}, {order} {kinds[order]}, message string, `order` long"
    rows = events.where(F.col(group).isNotNull()).select(group, order, "message")
    return rows.groupBy(group).applyInPandasWithState(fold, schema, "n long", "append", GroupStateTimeout.NoTimeout)


def emitted(events: DataFrame, tags: str = "tags", wanted: tuple[str, ...] = ("final_answer", "retriever_end", "reformulated")) -> DataFrame:
    return events.where(F.arrays_overlap(F.col(tags), F.array(*[F.lit(t) for t in wanted])))


def frames(events: DataFrame) -> DataFrame:
    """(qid, order, frame): server-sent events of messages and contexts."""
    return events.select("qid", "order", sse_frame(F.col("order"), F.col("message"), F.col("context")).alias("frame"))


def error_events(failed: DataFrame, qid: str = "qid") -> DataFrame:
    """(qid, order, frame): the terminal event of each failed answer."""
    frame = sse_frame(F.lit(FAILED).alias("message"), F.lit(1).alias("order"))
    return failed.select(qid, F.lit(1).alias("order"), frame.alias("frame"))


def once(stream: DataFrame, keys: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """Rows whose keys haven't been seen within the watermark; state is bounded by the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def folded(events: DataFrame, group: str = "qid", order: str = "order", message: str = "message") -> DataFrame:
    """(group, text): messages of an answer put together in order, each order once (its first message by text)."""
    one = events.where(F.col(message).isNotNull()).groupBy(group, order).agg(F.min(message).alias(message))
    lists = one.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, message))).alias("l"))  # one answer
    return lists.select(group, F.array_join(F.transform("l", lambda x: x[message]), "").alias("text"))
