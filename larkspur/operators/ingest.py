"""From sources to chunks: source fallback, skipping what is known, metadata enrichment, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import NO_TITLE, NO_TRANSCRIPT_NOTE, metadata_text
from larkspur.operators.fusion import keep_first


def first_source(tried: DataFrame, key: str, priority: str) -> DataFrame:
    """All rows of the first source (least priority) that gave any for a key."""
    best = tried.where(F.col(priority).isNotNull()).groupBy(key).agg(F.min(priority).alias(priority))
    return tried.join(best, [key, priority]).select(*tried.columns)


def not_loaded(urls: DataFrame, url_to_title: DataFrame, titles: DataFrame) -> DataFrame:
    """URLs to load: those without a title, or whose title has no chunks. Both lookups must hit for a URL to be skipped."""
    known = url_to_title.join(titles.select("title").distinct(), "title", "left_semi").select("url").distinct()
    return urls.join(known, "url", "left_anti")


# What a clip carries of its recording.
CLIP_COLUMNS = ["duration", "uploader", "channel", "upload_date", "view_count", "tags", "categories", "language"]


def enriched(clips: DataFrame, metadata: DataFrame, url: str) -> DataFrame:
    """Clips with title, type, source and CLIP_COLUMNS of their recording, which replace the clip's own, with defaults where they are null.

    A page is kept, and made of the clip's start where there is none. Clips without metadata stay, with all defaults.
    """
    given = ["title", *CLIP_COLUMNS]
    meta = with_defaults(metadata.select(F.col(url).alias("_url"), *given)).select("_url", *[F.col(c).alias(f"_{c}") for c in given])
    joined = clips.join(meta, clips["source"] == meta["_url"], "left")
    kinds = dict(meta.dtypes)
    new = {c: F.coalesce(f"_{c}", default(c, kinds[f"_{c}"])) for c in given} | {"type": F.lit("youtube"), "page": F.coalesce("page", "start_seconds", F.lit(0.0))}
    kept = [c for c in clips.columns if c not in new]
    return joined.select(*kept, *[value.alias(c) for c, value in new.items()])


def with_metadata_documents(clips: DataFrame, metadata: DataFrame, url: str) -> DataFrame:
    """Enriched clips, and for each recording that no source gave any clip of a document made of its metadata.

    Such a document begins at 0, says that there is no transcript, and carries the same columns as a clip; columns it has no
    value for are null.
    """
    meta = with_defaults(metadata.select(F.col(url).alias("source"), "title", "description", *CLIP_COLUMNS)).drop("uploaded_on")
    lone = meta.join(clips.select("source").where("source is not null").distinct(), "source", "left_anti").where("source is not null")
    made = metadata_text(*[F.col(c) for c in ("title", "source", "description", "uploader", "duration", "tags")])
    lone = lone.withColumn("page_content", made).drop("description")
    lone = lone.withColumns({"type": F.lit("youtube"), "page": F.lit(0.0), "transcript_available": F.lit(False), "note": F.lit(NO_TRANSCRIPT_NOTE)})
    return enriched(clips, metadata, url).unionByName(lone, allowMissingColumns=True)


def progress(status: DataFrame) -> DataFrame:
    """(current, total, failed, percent) over rows (url, ok): percent is rounded half up, 0 for no rows."""
    total, done = F.count("*"), F.count_if(F.coalesce("ok", F.lit(False)))
    out = status.agg(done.alias("current"), total.alias("total"))
    percent = F.when(F.col("total") == 0, 0).otherwise(F.floor(100 * F.col("current") / F.col("total") + 0.5)).cast("long")
    return out.select("current", "total", (F.col("total") - F.col("current")).alias("failed"), percent.alias("percent"))


def result_rows(chunks: DataFrame) -> DataFrame:
    """What a client gets of a chunk: nulls as empty text, and the start only of recordings."""
    def text(c: str) -> Column:
        return F.coalesce(c, F.lit("")).alias({"source": "link"}.get(c, c))

    return chunks.select("chunk_id", text("summary"), text("source"), text("type"), text("title"), F.when(F.col("type") == "youtube", F.col("page")).alias("timestamp_seconds"))


def one_per_prefix(chunks: DataFrame, group: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """(group, title, page, keep): first chunk of each (group, title, page, first 100 characters of its content).

    Contents stay behind: only their hashes are shuffled, and who needs the text joins it by key afterwards.
    """
    named = dict.fromkeys([*group, "title", "page", *order, *keep])
    keyed = chunks.select(*named, F.md5(F.substring("page_content", 1, 100)).alias("_h"))
    return keep_first(keyed, [*group, "title", "page", "_h"], order).select(*dict.fromkeys([*group, "title", "page", *keep]))


# What a recording's metadata is where a key is missing.
DEFAULTS = {"title": NO_TITLE, "description": "", "duration": 0, "view_count": 0, "upload_date": "", "uploader": "", "channel": "", "channel_id": "", "tags": [], "categories": [], "language": "", "subtitles_available": False, "like_count": 0, "age_limit": 0}


def default(column: str, kind: str) -> Column:
    value = DEFAULTS[column]
    return (F.array() if value == [] else F.lit(value)).cast(kind)


def with_defaults(metadata: DataFrame) -> DataFrame:
    """Nulls as each key's default, and the upload date, where there is one, parsed where it can be."""
    kinds = dict(metadata.dtypes)
    out = metadata.select(*[F.coalesce(c, default(c, kinds[c])).alias(c) if c in DEFAULTS else F.col(c) for c in metadata.columns])
    return out.withColumn("uploaded_on", F.try_to_date("upload_date", "yyyyMMdd")) if "upload_date" in kinds else out
