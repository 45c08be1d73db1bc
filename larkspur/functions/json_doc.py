"""JSON: subtitle files, event frames, and a document's identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JSON3 = "events array<struct<tStartMs:bigint,dDurationMs:bigint,segs:array<struct<utf8:string>>>>"


def subtitle_entries(df: DataFrame, body: str, *keep: str) -> DataFrame:
    """One row (keep..., text, start, duration) per caption with text in json3 files; missing times are 0, broken files give no row."""
    events = F.from_json(body, JSON3)["events"]
    rows = df.select(*keep, F.explode(events).alias("e")).where("e.segs is not null")
    text = F.trim(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""))
    out = rows.select(*keep, text.alias("text"), (F.coalesce("e.tStartMs", F.lit(0)) / 1000.0).alias("start"), (F.coalesce("e.dDurationMs", F.lit(0)) / 1000.0).alias("duration"))
    return out.where("text <> ''")


def identity(*columns: str) -> Column:
    """Key of a whole document: hash of its columns as JSON, nulls kept apart from empty values."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def sse_frame(*columns: Column) -> Column:
    """A server-sent event."""
    return F.concat(F.lit("data: "), F.to_json(F.struct(*columns)), F.lit("\n\n"))
