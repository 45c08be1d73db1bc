"""Queues: at-least-once messages, dead letters, size cap, depth alarm, rate limit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspur.operators.fusion import keep_first

# The queues' limits.
MOST_RECEIVES = 3
MOST_BYTES = 262_144
BATCH = 10
DEPTHS = {"text-processing-input": 100, "processed-chunks": 50, "embedding-results": 50}


def latest_delivery(messages: DataFrame, key: str = "request_id") -> DataFrame:
    """A message's last delivery: most receives, then latest, which is idempotent under redelivery."""
    turned = messages.withColumn("_r", -F.col("receive_count")).withColumn("_t", -F.unix_micros("sent_at"))
    return keep_first(turned, [key], ["_r", "_t", "text"]).drop("_r", "_t")


def outcome(text: str = "text", receives: str = "receive_count") -> Column:
    """dead_letter after MOST_RECEIVES receives, too_large over the size cap, rejected for an empty text, else accepted."""
    return (
        F.when(F.col(receives) >= MOST_RECEIVES, "dead_letter")
        .when(F.octet_length(text) > MOST_BYTES, "too_large")
        .when(F.coalesce(F.length(text), F.lit(0)) == 0, "rejected")
        .otherwise("accepted")
    )


def depth(messages: DataFrame, queue: str, time: str, minutes: int = 5) -> DataFrame:
    """(queue, window_start, messages) in tumbling windows."""
    start = F.window(F.col(time).cast("timestamp"), f"{minutes} minutes")["start"]
    return messages.where(F.col(queue).isNotNull() & F.col(time).isNotNull()).groupBy(queue, start.alias("window_start")).agg(F.count("*").alias("messages"))


def most(queue: str) -> Column:
    """A queue's alarm threshold; null, so never crossed, for another queue."""
    out = F.lit(None).cast("int")
    for name, limit in DEPTHS.items():
        out = F.when(F.col(queue) == name, limit).otherwise(out)
    return out


def alarms(depths: DataFrame, queue: str, threshold: Column | int, minutes: int = 5) -> DataFrame:
    """Windows over the threshold that follow one over it without a gap: two periods in a row."""
    over = depths.where(F.col("messages") > threshold)
    before = over.select(queue, (F.col("window_start") + F.make_dt_interval(mins=F.lit(minutes))).alias("window_start"))
    return over.join(before, [queue, "window_start"], "left_semi")


def rate_limited(requests: DataFrame, client: str, time: str, rate: float = 10.0, burst: int = 5) -> DataFrame:
    """(client, time, excess, allowed): a leaky bucket per client, streamed in order of time with one number of state."""
    rows = requests.where(F.col(client).isNotNull() & F.col(time).isNotNull()).select(F.col(client).cast("string").alias("client"), F.col(time).cast("timestamp").alias("time"))
    ordered = rows.repartition("client").sortWithinPartitions("client", "time")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, level, seen = None, 0.0, 0
        for batch in batches:
            excess, allowed = [], []
            for c, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.int64()).to_pylist(), strict=True):
                if c != now:
                    now, level, seen = c, 0.0, t
                level = max(0.0, level - (t - seen) / 1e6 * rate)
                seen = t
                ok = level <= burst
                excess.append(level)
                allowed.append(ok)
                level += ok
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(excess, pa.float64()), pa.array(allowed, pa.bool_())], names=["client", "time", "excess", "allowed"])

    return ordered.mapInArrow(run, "client string, time timestamp, excess double, allowed boolean")


def dead_letter_batches(accepted: str, dead: str):  # noqa: ANN201
    """A function for foreachBatch that writes accepted messages and dead letters to two tables, partitioned by batch: one that is run again replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        told = batch.withColumn("outcome", outcome())
        told.where("outcome = 'accepted'").drop("outcome").write.mode("overwrite").parquet(f"{accepted}/batch={number}")
        told.where("outcome <> 'accepted'").write.mode("overwrite").parquet(f"{dead}/batch={number}")

    return write


DELIVERY = "message_id string, at timestamp, happened string, receives int, visible_at timestamp"


def deliveries(events: DataFrame, receives: int = MOST_RECEIVES, hidden_s: float = 300.0) -> DataFrame:
    """(message_id, at, happened, receives, visible_at) for a stream of events (message_id, kind, at): what each one does.

    send makes a message available. receive delivers it, unless it is hidden, for `hidden_s` seconds after a delivery, or has been
    delivered `receives` times already, in which case it becomes a dead letter. delete ends it, and acknowledges its delivery.
    An event that doesn't apply is ignored, and so is one that comes again. State is one small row per message, until it ends.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, n, visible, last = state.get if state.exists else ("new", 0, 0, 0)
        rows = sorted((int(t.value // 1000), order, k) for f in frames for k, t in f[["kind", "at"]].itertuples(index=False) for order in [("send", "delete", "receive").index(k) if k in ("send", "delete", "receive") else 3])
        out = []
        for at, _, kind in dict.fromkeys(rows):
            happened = "ignored"
            if kind == "send" and status == "new":
                status, happened, visible = "available", "sent", at
            elif kind == "delete" and status == "available":
                status, happened = "ended", "deleted"
            elif kind == "receive" and status == "available" and at < visible:
                happened = "hidden"
            elif kind == "receive" and status == "available" and n >= receives:
                status, happened = "ended", "dead_letter"
            elif kind == "receive" and status == "available":
                n, visible, happened = n + 1, at + int(hidden_s * 1e6), "delivered"
            out.append((key[0], pd.Timestamp(at, unit="us"), happened, n, pd.Timestamp(visible, unit="us")))
            last = at
        state.update((status, n, visible, last))
        yield pd.DataFrame(out, columns=["message_id", "at", "happened", "receives", "visible_at"])

    rows = events.where("message_id is not null and at is not null").select(F.col("message_id").cast("string").alias("message_id"), "kind", "at")
    return rows.groupBy("message_id").applyInPandasWithState(fold, DELIVERY, "status string, n int, visible long, last long", "append", GroupStateTimeout.NoTimeout)


class FileQueue:
    """A queue of JSON files in a shared folder: sending adds files, receiving is a stream over them, a checkpoint acknowledges."""

    SCHEMA = "request_id long, queue_name string, text string, chunk_size int, pca_components int, receive_count int, sent_at timestamp"

    def __init__(self, spark, path: str) -> None:  # noqa: ANN001
        self.spark, self.path = spark, path

    def _folder(self):  # noqa: ANN202
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def create(self) -> None:
        """Makes the queue's folder; one that is there stays as it is."""
        system, where = self._folder()
        system.mkdirs(where)

    def delete(self) -> None:
        """Removes the queue with all its messages."""
        system, where = self._folder()
        system.delete(where, True)

    def send(self, messages: DataFrame) -> None:
        """Messages over the size cap aren't sent."""
        messages.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MOST_BYTES).write.mode("append").json(self.path)

    def receive(self, batch: int = BATCH, archive: str | None = None) -> DataFrame:
        """A stream of the messages, at most `batch` files at a time; read files move to `archive`, if given."""
        reader = self.spark.readStream.schema(self.SCHEMA).option("maxFilesPerTrigger", batch)
        if archive:
            reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
        return reader.json(self.path)

    def attributes(self) -> dict[str, int]:
        return {"ApproximateNumberOfMessages": self.spark.read.schema(self.SCHEMA).json(self.path).count()}
