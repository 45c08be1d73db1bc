"""Chunkers and column functions over transcripts, chunks, recordings and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import json_doc, text
from larkspur.operators import chunking, ingest
from larkspur.operators.worker import size_of
from larkspur.plans.registry import Registry
from larkspur.tables import latest, read

plans = Registry()
_SIZE = "case when chunk_size >= 1 then chunk_size else 1000 end"
_MESSAGES = f"m as (select distinct request_id, text, {_SIZE} as n from process_request where length(text) > 0)"


def _messages(spark: SparkSession, directory: str) -> DataFrame:
    return read(spark, directory, "process_request").select("request_id", "text", size_of().alias("n")).distinct()


@plans.add(f"with {_MESSAGES} select request_id, i::int as chunk_no, md5(substr(text, (i * n + 1)::bigint, n)) as chunk_md5 from (select *, unnest(range(0, (length(text) - 1) // n + 1)) as i from m)")
def fixed_chunks(spark: SparkSession, directory: str) -> DataFrame:
    out = chunking.fixed_chunks(_messages(spark, directory), "text", F.col("n"), "request_id", "n")
    return out.select("request_id", "chunk_no", F.md5("chunk").alias("chunk_md5"))


@plans.add(f"""with recursive {_MESSAGES},
s as (select request_id, n, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: trim(x, ' ' || chr(10) || chr(13) || chr(9))), lambda x: x <> '') as s from m),
f(request_id, n, s, i, no, cur) as (
  select request_id, n, s, 1, 0, s[1] from s where len(s) > 0
  union all
  select request_id, n, s, i + 1, case when length(cur) + length(s[i + 1]) <= n then no else no + 1 end, case when length(cur) + length(s[i + 1]) <= n then cur || ' ' || s[i + 1] else s[i + 1] end
  from f where i < len(s))
select request_id, no as chunk_no, md5(arg_max(cur, i)) as chunk_md5 from f group by request_id, n, no, s""")
def sentence_pack(spark: SparkSession, directory: str) -> DataFrame:
    rows = _messages(spark, directory).withColumn("id", F.monotonically_increasing_id())
    out = chunking.sentence_chunks(rows, "text", F.col("n"), "request_id", "id")
    return out.select("request_id", "chunk_no", F.md5("chunk").alias("chunk_md5"))


_ENTRIES = "e as (select distinct video_id, entry_id, start, duration, text from transcript where start is not null and not isnan(start) and video_id is not null)"


def _entries(spark: SparkSession, directory: str) -> DataFrame:
    return read(spark, directory, "transcript").select("video_id", "entry_id", "start", "duration", "text").distinct()


ANCHORED = f"""with recursive {_ENTRIES}, d as (select video_id, start, lead(start) over (partition by video_id order by start) as nxt from (select distinct video_id, start from e)),
f as (select video_id, min(start) as first from d group by 1),
a(video_id, anchor) as (
  select video_id, 0.0::double from f
  union all
  select a.video_id, (select min(d.start) from d, f where d.video_id = a.video_id and f.video_id = a.video_id and d.start - a.anchor >= 60 and d.start > f.first) from a where a.anchor is not null),
ch as (select video_id, anchor, lead(anchor) over (partition by video_id order by anchor) as stop from a where anchor is not null)
select e.video_id, ch.anchor as start_seconds, max(ch.stop) as end_seconds, md5(coalesce(string_agg(e.text, ' ' order by e.start, e.entry_id, e.text), '')) as text_md5
from e join ch on e.video_id = ch.video_id and e.start >= ch.anchor and (ch.stop is null or e.start < ch.stop) group by e.video_id, ch.anchor"""


@plans.add(ANCHORED)
def anchored_chunks(spark: SparkSession, directory: str) -> DataFrame:
    out = chunking.anchored_chunks(_entries(spark, directory), "video_id", "start", "text", "entry_id")
    return out.select("video_id", "start_seconds", "end_seconds", F.md5("text").alias("text_md5"))


@plans.add(f"""with recursive {_ENTRIES}, o as (select video_id, start, start + coalesce(case when not isnan(duration) then duration end, 0) as stop, text, entry_id, row_number() over (partition by video_id order by start, entry_id, text nulls first) as i from e),
f(video_id, i, no, most, begin) as (
  select video_id, 1, 0, case when stop > 60 then 120.0::double else 60 end, case when stop > 60 then 60.0::double else 0 end from o where i = 1
  union all
  select o.video_id, o.i, case when stop > most then no + 1 else no end, case when stop > most then most + 60 else most end, case when stop > most then most else begin end from f join o on o.video_id = f.video_id and o.i = f.i + 1)
select video_id, no as chunk_no, min(begin) as start_seconds, md5(coalesce(string_agg(text, ' ' order by i), '')) as text_md5 from f join o using (video_id, i) group by video_id, no""")
def grid_chunks(spark: SparkSession, directory: str) -> DataFrame:
    out = chunking.grid_chunks(_entries(spark, directory), "video_id", "start", "duration", "text", "entry_id")
    return out.select("video_id", "chunk_no", "start_seconds", F.md5("text").alias("text_md5"))


@plans.add(f"with {_ENTRIES} select video_id, floor(start / 60)::bigint as bucket, md5(coalesce(string_agg(text, ' ' order by start, entry_id, text), '')) as text_md5 from e group by 1, 2")
def tumbling_chunks(spark: SparkSession, directory: str) -> DataFrame:
    out = chunking.tumbling_chunks(_entries(spark, directory), "video_id", "start", "text", "entry_id")
    return out.select("video_id", "bucket", F.md5("text").alias("text_md5"))


@plans.add()
def recursive_split(spark: SparkSession, directory: str) -> DataFrame:
    rows = latest(read(spark, directory, "chunks"), "chunk_id", ["ingested_at"], ["title", "page_content"])
    return chunking.recursive_chunks(rows, "page_content", "chunk_id", "title")


@plans.add()
def two_level_split(spark: SparkSession, directory: str) -> DataFrame:
    return chunking.two_level_chunks(read(spark, directory, "documents"), "text", "doc_id")


@plans.add("""select url, concat_ws(chr(10), 'YouTube video: ' || coalesce(title, 'Title not found'), 'URL: ' || url,
  case when coalesce(description, '') <> '' then 'Description: ' || case when length(description) > 500 then left(description, 500) || '...' else description end end,
  case when coalesce(uploader, '') <> '' then 'Channel: ' || uploader end,
  case when coalesce(duration, 0) <> 0 then 'Duration: ' || (duration // 60) || 'm ' || (duration % 60) || 's' end,
  case when len(tags) > 0 then 'Tags: ' || array_to_string(tags[1:10], ', ') end,
  'Note: No transcript available for this video.') as page_content from video_metadata""")
def metadata_doc(spark: SparkSession, directory: str) -> DataFrame:
    made = text.metadata_text(*[F.col(c) for c in ("title", "url", "description", "uploader", "duration", "tags")])
    return read(spark, directory, "video_metadata").select("url", made.alias("page_content"))


@plans.add("""with s as (select distinct source, string_split(source, '/')[-1] as name from chunks where type = 'pdf')
select source, replace(replace(trim(left(name, greatest(length(name) - 4, 0)), ' '), '_', ' '), '  ', ' ') as title from s""")
def title_norm(spark: SparkSession, directory: str) -> DataFrame:
    rows = read(spark, directory, "chunks").where("type = 'pdf'").select("source").distinct()
    return rows.select("source", text.normal_title(F.col("source")).alias("title"))


_LINK = "coalesce(source, '') || case when type = 'youtube' and coalesce(page, 0) <> 0 then '&t=' || page::varchar || 's' else '' end"
_BLOCK = """'content: ' || coalesce(page_content, 'None') || chr(10) || 'title: ' || coalesce(title, 'Unknown Source') || chr(10) || 'type: ' || coalesce(type, 'unknown') || chr(10) || 'link: ' || link || chr(10)
|| 'timestamp_seconds: ' || coalesce(case when type = 'youtube' then page::varchar end, 'None') || chr(10) || 'summary: ' || coalesce(note, 'None')"""


@plans.add(f"with c as (select distinct chunk_id, title, type, source, page, note, page_content, {_LINK} as link from chunks) select chunk_id, md5({_BLOCK}) as block_md5 from c")
def doc_format(spark: SparkSession, directory: str) -> DataFrame:
    """The note stands for the summary, which chunks don't have."""
    link = text.deep_link(F.col("source"), F.col("type"), F.col("page"))
    rows = read(spark, directory, "chunks").select("chunk_id", "title", "type", "source", "page", "note", "page_content").distinct()
    block = text.document_block(F.col("page_content"), F.col("title"), F.col("type"), link, F.col("page"), F.col("note"))
    return rows.select("chunk_id", F.md5(block).alias("block_md5"))


@plans.add(f"select distinct chunk_id, {_LINK} as link from chunks")
def deep_link(spark: SparkSession, directory: str) -> DataFrame:
    link = text.deep_link(F.col("source"), F.col("type"), F.col("page"))
    return read(spark, directory, "chunks").select("chunk_id", link.alias("link")).distinct()


@plans.add("select result_id, case when coalesce(type, '') = 'youtube' or lower(link) like '%youtube%' then 'YouTube' else 'Site' end as tag from search_results")
def source_tag(spark: SparkSession, directory: str) -> DataFrame:
    return read(spark, directory, "search_results").select("result_id", text.source_tag(F.col("type"), F.col("link")).alias("tag"))


@plans.add("select result_id, case when timestamp_seconds > 0 then (timestamp_seconds // 60) || ':' || lpad((timestamp_seconds % 60)::varchar, 2, '0') end as label from search_results")
def ts_label(spark: SparkSession, directory: str) -> DataFrame:
    return read(spark, directory, "search_results").select("result_id", text.time_label(F.col("timestamp_seconds")).alias("label"))


@plans.add("select result_id, regexp_replace(link, '/waiting_room', '') as link from search_results")
def link_clean(spark: SparkSession, directory: str) -> DataFrame:
    return read(spark, directory, "search_results").select("result_id", text.first_removed(F.col("link")).alias("link"))


@plans.add("""select chunk_id, coalesce(note, '') as summary, coalesce(source, '') as link, coalesce(type, '') as type, coalesce(title, '') as title,
case when type = 'youtube' then page end as timestamp_seconds from chunks""")
def result_projection(spark: SparkSession, directory: str) -> DataFrame:
    return ingest.result_rows(read(spark, directory, "chunks").withColumn("summary", F.col("note")))


@plans.add("""select result_id, coalesce(title, '') <> '' as shows_content, coalesce(summary, '') <> '' and summary is distinct from title as shows_summary, count(*) over (partition by qid, event_no) > 3 as view_all from search_results""")
def optional_sections(spark: SparkSession, directory: str) -> DataFrame:
    from pyspark.sql import Window

    rows = read(spark, directory, "search_results")
    many = F.count("*").over(Window.partitionBy("qid", "event_no")) > 3  # one answer's results
    shows = (F.coalesce("summary", F.lit("")) != "") & ~F.col("summary").eqNullSafe(F.col("title"))
    return rows.select("result_id", (F.coalesce("title", F.lit("")) != "").alias("shows_content"), shows.alias("shows_summary"), many.alias("view_all"))


@plans.add("select request_id from process_request where regexp_matches(coalesce(text, ''), '[^ \\t\\n\\r\\f\\v]')")
def blank_guard(spark: SparkSession, directory: str) -> DataFrame:
    return read(spark, directory, "process_request").where(~text.is_blank(F.col("text"))).select("request_id")


# literal links: the forms a video can be named by
LINKS = ["https://youtu.be/abc?si=1", "https://www.youtube.com/watch?v=xyz&t=3", "https://youtube.com/embed/e1", "https://www.youtube.com/v/v1/x", "https://m.youtube.com/watch?v=no", "https://www.youtube.com/shorts/s1", "https://www.youtube.com/watch", "not a url", None]


@plans.add("""with u as (select url from video_metadata union all select page_url from documents union all select * from (values
('https://youtu.be/abc?si=1'), ('https://www.youtube.com/watch?v=xyz&t=3'), ('https://youtube.com/embed/e1'), ('https://www.youtube.com/v/v1/x'),
('https://m.youtube.com/watch?v=no'), ('https://www.youtube.com/shorts/s1'), ('https://www.youtube.com/watch'), ('not a url'), (null)))
select url, case when regexp_matches(url, '^https?://youtu\\.be/.') then nullif(regexp_extract(url, '^https?://youtu\\.be/([^?#]*)', 1), '')
when regexp_matches(url, '^https?://(www\\.)?youtube\\.com/watch\\?') then nullif(regexp_extract(url, '[?&]v=([^&#]*)', 1), '')
when regexp_matches(url, '^https?://(www\\.)?youtube\\.com/(embed|v)/') then nullif(regexp_extract(url, '^https?://(www\\.)?youtube\\.com/(embed|v)/([^/?#]*)', 3), '') end as video_id,
coalesce(starts_with(url, 'http'), false) as is_url from u""")
def url_video_id(spark: SparkSession, directory: str) -> DataFrame:
    urls = read(spark, directory, "video_metadata").select("url").union(read(spark, directory, "documents").select("page_url"))
    urls = urls.union(spark.createDataFrame([(x,) for x in LINKS], "url string"))
    return urls.select("url", text.video_id(F.col("url")).alias("video_id"), text.is_url(F.col("url")).alias("is_url"))


# literal states and errors, one for each outcome and some for the order of the tests
STATES = [("public", None), ("private", None), ("premium_only", None), ("subscriber_only", None), (None, None), (None, "Private video. Sign in"), (None, "Video unavailable"), (None, "This video was DELETED by its owner"), (None, "HTTP error 500"), ("private", "Video unavailable: Private video"), (None, "Transcripts are disabled"), (None, "no element found: line 1")]
_STATES = ", ".join("(" + ", ".join("null" if x is None else f"'{x}'" for x in row) + ")" for row in STATES)


@plans.add(f"""with s as (select case when age_limit >= 18 then 'premium_only' end as state, case when not coalesce(subtitles_available, true) then 'Subtitles are disabled for this video' end as error from video_metadata union all select * from (values {_STATES}))
select state, error, case when error like '%Private video%' then 'private' when error like '%Video unavailable%' then 'unavailable' when lower(error) like '%deleted%' then 'deleted' when error is not null then 'access_error' when state in ('private', 'premium_only', 'subscriber_only') then 'restricted' else 'available' end as availability,
case when error is null then null when lower(error) like '%disabled%' then 'disabled' when lower(error) like '%unavailable%' then 'unavailable' when lower(error) like '%private%' then 'private' when lower(error) like '%no element found%' then 'retry' else 'other' end as error_class from s""")
def availability(spark: SparkSession, directory: str) -> DataFrame:
    error = F.when(~F.coalesce("subtitles_available", F.lit(True)), "Subtitles are disabled for this video")
    rows = read(spark, directory, "video_metadata").select(F.when(F.col("age_limit") >= 18, "premium_only").alias("state"), error.alias("error"))
    rows = rows.union(spark.createDataFrame(STATES, "state string, error string"))
    return rows.select("state", "error", text.availability(F.col("state"), F.col("error")).alias("availability"), text.error_class(F.col("error")).alias("error_class"))


@plans.add("""with c as (select distinct chunk_id, source, case source_method when 'caption_clip' then 1 when 'transcript_api' then 2 when 'subtitle_json3' then 3 else 4 end as p from chunks where type = 'youtube' and source is not null and source_method is distinct from 'transcript_api'),
f as (select chunk_id, source from c where p = (select min(p) from c d where d.source = c.source)),
m as (select * from video_metadata where url is not null qualify row_number() over (partition by url order by fetched_at desc nulls last) = 1)
select source, chunk_id, null::boolean as transcript_available, null as content_md5 from f
union all select url, null, false, md5(concat_ws(chr(10), 'YouTube video: ' || coalesce(title, 'Title not found'), 'URL: ' || url,
  case when coalesce(description, '') <> '' then 'Description: ' || case when length(description) > 500 then left(description, 500) || '...' else description end end,
  case when coalesce(uploader, '') <> '' then 'Channel: ' || uploader end, case when coalesce(duration, 0) <> 0 then 'Duration: ' || (duration // 60) || 'm ' || (duration % 60) || 's' end,
  case when len(tags) > 0 then 'Tags: ' || array_to_string(tags[1:10], ', ') end, 'Note: No transcript available for this video.')) from m where url not in (select source from f)""")
def fallback_chain(spark: SparkSession, directory: str) -> DataFrame:
    """Clips of the first source that has any, and a document of metadata for recordings without; the second source is taken to be down."""
    order = F.when(F.col("source_method") == "caption_clip", 1).when(F.col("source_method") == "transcript_api", 2).when(F.col("source_method") == "subtitle_json3", 3).otherwise(4)
    clips = read(spark, directory, "chunks").where("type = 'youtube' and source is not null and not source_method <=> 'transcript_api'")
    columns = ["chunk_id", "source", "page", "start_seconds", "title", *ingest.CLIP_COLUMNS]
    clips = clips.withColumn("p", order).dropDuplicates(["chunk_id", "source", "p"]).select(*columns, "p")
    meta = latest(read(spark, directory, "video_metadata"), "url", ["fetched_at"], ["title", "description", *ingest.CLIP_COLUMNS])
    out = ingest.with_metadata_documents(ingest.first_source(clips, "source", "p").drop("p"), meta, "url")
    return out.select("source", "chunk_id", "transcript_available", F.md5("page_content").alias("content_md5"))


@plans.add("""with t as (select distinct title, language, source_method = 'transcript_api' as gen from chunks where type = 'youtube' and title is not null)
select title, language, gen as is_generated from t
qualify row_number() over (partition by title order by case language when 'en' then 0 when 'en-US' then 1 when 'en-GB' then 2 when 'en-orig' then 3 else case when gen then 5 else 4 end end, language nulls first, gen) = 1""")
def lang_preference(spark: SparkSession, directory: str) -> DataFrame:
    from larkspur.operators.fusion import keep_first

    rows = read(spark, directory, "chunks").where("type = 'youtube' and title is not null").select("title", "language", (F.col("source_method") == "transcript_api").alias("is_generated")).distinct()
    ranked = rows.withColumn("_r", text.language_rank(F.col("language"), F.col("is_generated")))
    return keep_first(ranked, ["title"], ["_r", "language", "is_generated"]).select("title", "language", "is_generated")


@plans.add("select event_id, json_extract(props, '$.k')::bigint as k, '{\"id\":' || event_id || ',\"k\":' || json_extract(props, '$.k') || '}' as body from events")
def json_props(spark: SparkSession, directory: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return read(spark, directory, "events").select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), k.alias("k"))).alias("body"))


@plans.add("""select video_id, trim(text, ' ') as text, round(start * 1000)::bigint / 1000.0 as start, coalesce(round(case when isnan(duration) then 0 else duration end * 1000)::bigint, 0) / 1000.0 as duration
from (select distinct video_id, entry_id, start, duration, text from transcript) where text is not null and trim(text, ' ') <> '' and start is not null and not isnan(start)""")
def json3_entries(spark: SparkSession, directory: str) -> DataFrame:
    """Captions written as json3 files, one each, and read back."""
    rows = _entries(spark, directory).where("text is not null and start is not null and not isnan(start)")
    ms = lambda c: F.round(F.nanvl(c, F.lit(0.0)) * 1000).cast("long")
    event = F.struct(ms(F.col("start")).alias("tStartMs"), ms(F.col("duration")).alias("dDurationMs"), F.array(F.struct(F.col("text").alias("utf8"))).alias("segs"))
    files = rows.select("video_id", F.to_json(F.struct(F.array(event).alias("events"))).alias("body"))
    return json_doc.subtitle_entries(files, "body", "video_id")


@plans.add("select request_id, len(string_split(text, chr(10))) as lines, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) as queries from process_request where text is not null")
def fanout_queries(spark: SparkSession, directory: str) -> DataFrame:
    rows = read(spark, directory, "process_request").where("text is not null")
    return rows.select("request_id", F.size(text.split_lines(F.col("text"), False)).cast("long").alias("lines"), F.size(text.split_lines(F.col("text"), True)).cast("long").alias("queries"))


@plans.add("""select doc_id, case when lower(title) like '%document request%' or lower(title) like '%a primer%' then 'retrieval' else 'general' end as intent,
case when title like '%Handbook%' then 'decompose' when title like '%Notes%' then 'hyde' else 'multiquery' end as method from documents""")
def route(spark: SparkSession, directory: str) -> DataFrame:
    """A model's label made from the title by rule, then routed."""
    from larkspur.operators.translation import routed

    rows = read(spark, directory, "documents")
    label = F.concat(F.when(F.lower("title").contains("a primer"), "Document Request ").otherwise("chat "), F.coalesce("title", F.lit("")), F.when(F.col("title").contains("Handbook"), " decompose").when(F.col("title").contains("Notes"), " hyde").otherwise(""))
    return routed(rows.withColumn("label", label), "label").select("doc_id", "intent", "method")
