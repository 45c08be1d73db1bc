"""The streaming forms, run over whole tables to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.plans.registry import Registry
from larkspur.plans.texts import ANCHORED
from larkspur.streaming import chunks, events
from larkspur.streaming.runs import run_to_end, stream_of

plans = Registry()


@plans.add("select distinct qid, event_no, rank_no from search_results where emitted_at is not null")
def stream_dedupe(spark: SparkSession, directory: str) -> DataFrame:
    stream = stream_of(spark, f"{directory}/search_results.parquet").where("emitted_at is not null")
    once = events.once(stream.select("qid", "event_no", "rank_no", "emitted_at"), ["qid", "event_no", "rank_no"], "emitted_at")
    return run_to_end(once.drop("emitted_at"))


# an entry delivered again with another duration is the same entry here, where durations don't count
@plans.add(f"with c as ({ANCHORED.replace('start, duration, text', 'start, text')}) select * from c where end_seconds is not null")
def stream_anchored(spark: SparkSession, directory: str) -> DataFrame:
    """The chunks that have closed when the stream ends: all but each recording's last."""
    out = run_to_end(chunks.anchored_stream(stream_of(spark, f"{directory}/transcript.parquet")))
    return out.select("video_id", "start_seconds", "end_seconds", F.md5("text").alias("text_md5"))


@plans.add("""with w as (select epoch_us(time_bucket(interval 1 day, ts)) as window_us, event_type, count(*) as n from events group by all)
select * from w where window_us + 86400000000 <= (select epoch_us(max(ts)) - 600000000 from events)""")
def stream_windows(spark: SparkSession, directory: str) -> DataFrame:
    """Windows the watermark has closed when the stream ends."""
    counted = chunks.windowed_counts(stream_of(spark, f"{directory}/events.parquet"), "ts", "event_type", 1440)
    return run_to_end(counted).select(F.unix_micros("window_start").alias("window_us"), "event_type", "n")


@plans.add("select distinct chunk_id from chunks where chunk_id is not null")
def stream_load(spark: SparkSession, directory: str) -> DataFrame:
    """Chunks appended to a store batch by batch, each key once."""
    import uuid

    from larkspur.session import shared_dir

    target = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    run_to_end(stream_of(spark, f"{directory}/chunks.parquet", 1).where("chunk_id is not null"), each=chunks.load_batches(target, "chunk_id"))
    return spark.read.parquet(target).select("chunk_id")
