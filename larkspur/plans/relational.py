"""Joins, deduplication, ordered aggregates and counts over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.functions.json_doc import identity, sse_frame
from larkspur.operators import fusion, ingest, translation
from larkspur.operators.asking import ask as answers
from larkspur.operators.embedding import letter_embedding
from larkspur.operators.fusion import zipped
from larkspur.operators.retrieval import has_facet
from larkspur.operators.worker import processed, status
from larkspur.plans.registry import Registry
from larkspur.streaming import events as answer_events
from larkspur.streaming import queue
from larkspur.tables import latest, read

plans = Registry()


@plans.add("""select title, page, chunk_id from chunks qualify row_number() over (partition by title, page, md5(substr(page_content, 1, 100)) order by chunk_id) = 1""")
def dedupe_chunk_key(spark: SparkSession, directory: str) -> DataFrame:
    rows = read(spark, directory, "chunks").select("title", "page", "chunk_id", "page_content")
    return ingest.one_per_prefix(rows, [], ["chunk_id"], ["chunk_id"])


@plans.add("""select qid, title, timestamp_seconds, result_id from search_results qualify row_number() over (partition by qid, title, timestamp_seconds order by event_no, rank_no, result_id) = 1""")
def dedupe_client(spark: SparkSession, directory: str) -> DataFrame:
    rows = read(spark, directory, "search_results").select("qid", "title", "timestamp_seconds", "event_no", "rank_no", "result_id")
    return fusion.keep_first(rows, ["qid", "title", "timestamp_seconds"], ["event_no", "rank_no", "result_id"]).select("qid", "title", "timestamp_seconds", "result_id")


@plans.add("select count(*) as documents, count(distinct doc_key) as kinds from (select md5(concat_ws('|', coalesce(lang, '-'), coalesce(source, '-'), coalesce(text, '-'))) as doc_key from documents)")
def document_identity(spark: SparkSession, directory: str) -> DataFrame:
    rows = read(spark, directory, "documents").select("lang", "source", "text").select(identity("lang", "source", "text").alias("doc_key"))
    return rows.agg(F.count("*").alias("documents"), F.countDistinct("doc_key").alias("kinds"))


@plans.add("select distinct title from (select title from chunks union all select title from video_metadata) where title is not null")
def title_union(spark: SparkSession, directory: str) -> DataFrame:
    return read(spark, directory, "chunks").select("title").union(read(spark, directory, "video_metadata").select("title")).where("title is not null").distinct()


@plans.add("""with known as (select distinct v.url from video_metadata v where v.title in (select title from chunks where title is not null)),
u as (select url from video_metadata union select source from chunks where type = 'youtube')
select url from u where url is not null and url not in (select url from known where url is not null)""")
def new_urls_anti(spark: SparkSession, directory: str) -> DataFrame:
    """Recordings named by the metadata or by a clip that aren't loaded: a clip's source may have no metadata."""
    meta, clips = read(spark, directory, "video_metadata"), read(spark, directory, "chunks")
    urls = meta.select("url").union(clips.where("type = 'youtube'").select("source")).where("url is not null").distinct()
    return ingest.not_loaded(urls, meta.select("url", "title"), clips.select("title"))


@plans.add("select url, title from video_metadata where title in (select title from chunks where title is not null)")
def indexed_semi(spark: SparkSession, directory: str) -> DataFrame:
    return read(spark, directory, "video_metadata").select("url", "title").join(read(spark, directory, "chunks").select("title"), "title", "left_semi").select("url", "title")




@plans.add("""with m as (select * from video_metadata where url is not null qualify row_number() over (partition by url order by fetched_at desc nulls last) = 1)
select c.chunk_id, coalesce(m.title, 'Title not found') as title, 'youtube' as type, c.source, coalesce(m.duration, 0) as duration, coalesce(m.uploader, '') as uploader, coalesce(m.channel, '') as channel,
coalesce(m.upload_date, '') as upload_date, coalesce(m.view_count, 0) as view_count, array_to_string(coalesce(m.tags, []), '|') as tags, array_to_string(coalesce(m.categories, []), '|') as categories, coalesce(m.language, '') as language,
coalesce(c.page, c.start_seconds, 0) as page from chunks c left join m on c.source = m.url where c.type = 'youtube'""")
def enrich_join(spark: SparkSession, directory: str) -> DataFrame:
    meta = latest(read(spark, directory, "video_metadata"), "url", ["fetched_at"], ["title", *ingest.CLIP_COLUMNS])
    clips = read(spark, directory, "chunks").where("type = 'youtube'").select("chunk_id", "source", "page", "start_seconds", "title", *ingest.CLIP_COLUMNS)
    out = ingest.enriched(clips, meta, "url").withColumn("tags", F.array_join("tags", "|")).withColumn("categories", F.array_join("categories", "|"))
    return out.drop("start_seconds")


@plans.add("""select v.url, v.title, count(c.chunk_id) as chunks from (select distinct url, title from video_metadata) v left join (select distinct title, chunk_id from chunks) c on v.title = c.title group by v.url, v.title""")
def url_title_chunks(spark: SparkSession, directory: str) -> DataFrame:
    pairs = read(spark, directory, "video_metadata").select("url", "title").distinct()
    counts = read(spark, directory, "chunks").select("title", "chunk_id").distinct().groupBy("title").agg(F.count("chunk_id").alias("chunks"))
    return pairs.join(counts, "title", "left").select("url", "title", F.coalesce("chunks", F.lit(0)).alias("chunks"))


_MAIN = "^https?://(?:www\\.youtube\\.com|youtube\\.com|video\\.openmeadow\\.example)"
_VIDEO = f"coalesce(nullif(regexp_extract({{0}}, '{_MAIN}/watch\\?(?:[^#]*&)?v=([^&#]+)', 1), ''), nullif(regexp_extract({{0}}, '{_MAIN}/(?:embed|v)/([^/?#]+)', 1), ''))"
HOSTS = (*text.VIDEO_HOSTS, "video.openmeadow.example")  # the host of these tables beside the usual ones


@plans.add(f"""with v as (select distinct {_VIDEO.format('url')} as video_id, channel from video_metadata)
select distinct t.entry_id, v.channel from transcript t join v using (video_id)""")
def facet_join(spark: SparkSession, directory: str) -> DataFrame:
    """What a recording's link says about it, at each of its captions, by the video the link names."""
    facets = read(spark, directory, "video_metadata").select(text.video_id(F.col("url"), HOSTS).alias("video_id"), "channel").where("video_id is not null").distinct()
    return read(spark, directory, "transcript").select("entry_id", "video_id").join(facets, "video_id").select("entry_id", "channel").distinct()


@plans.add(f"""with v as (select {_VIDEO.format('url')} as video_id, tags, categories from video_metadata where url is not null),
c as (select distinct chunk_id, {_VIDEO.format('source')} as video_id from chunks where type = 'youtube')
select distinct c.chunk_id from c join v using (video_id) where list_contains(coalesce(tags, []), 'campus press rights') and list_contains(coalesce(categories, []), 'Education')""")
def facet_filter(spark: SparkSession, directory: str) -> DataFrame:
    """Clips of recordings with a tag and a category; the third facet is left open."""
    facets = read(spark, directory, "video_metadata").select(text.video_id(F.col("url"), HOSTS).alias("video_id"), "tags", "categories")
    wanted = facets.where(has_facet("tags", "campus press rights") & has_facet("categories", "Education") & has_facet("tags", ""))
    clips = read(spark, directory, "chunks").where("type = 'youtube'").select("chunk_id", text.video_id(F.col("source"), HOSTS).alias("video_id"))
    return clips.join(wanted, "video_id", "left_semi").select("chunk_id").distinct()


@plans.add("""select url, i as no, tags[i] as tag, categories[i] as category from (select url, tags, categories, unnest(generate_series(1, least(len(tags), len(categories)))) as i from (select distinct url, tags, categories from video_metadata))""")
def positional_zip(spark: SparkSession, directory: str) -> DataFrame:
    rows = read(spark, directory, "video_metadata").select("url", "tags", "categories").distinct()
    return zipped(rows, "tags", "categories", "url").select("url", F.col("no").cast("long").alias("no"), F.col("left").alias("tag"), F.col("right").alias("category"))


_PRIORITY = "case source_method when 'caption_clip' then 1 when 'transcript_api' then 2 when 'subtitle_json3' then 3 else 4 end"


@plans.add(f"""with c as (select distinct chunk_id, source, source_method, {_PRIORITY} as p from chunks where type = 'youtube' and source is not null)
select chunk_id, source, source_method from c where p = (select min(p) from c d where d.source = c.source)""")
def fallback_first(spark: SparkSession, directory: str) -> DataFrame:
    order = F.when(F.col("source_method") == "caption_clip", 1).when(F.col("source_method") == "transcript_api", 2).when(F.col("source_method") == "subtitle_json3", 3).otherwise(4)
    rows = read(spark, directory, "chunks").where("type = 'youtube' and source is not null").select("chunk_id", "source", "source_method", order.alias("p")).distinct()
    return ingest.first_source(rows, "source", "p").select("chunk_id", "source", "source_method")


@plans.add("""with r as (select distinct qid, event_no, rank_no, result_id, coalesce(summary, '') as summary from search_results)
select qid, md5(string_agg(summary, ' ' order by event_no, rank_no, result_id)) as text_md5 from r group by qid""")
def ordered_concat(spark: SparkSession, directory: str) -> DataFrame:
    rows = read(spark, directory, "search_results").select("qid", "event_no", "rank_no", "result_id", F.coalesce("summary", F.lit("")).alias("summary")).distinct()
    lists = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("event_no", "rank_no", "result_id", "summary"))).alias("l"))  # one answer's results
    return lists.select("qid", F.md5(F.array_join(F.transform("l", lambda x: x["summary"]), " ")).alias("text_md5"))


@plans.add("""with r as (select distinct qid, result_id, coalesce(summary, '') as summary from search_results)
select qid, result_id, md5(coalesce(string_agg(summary, chr(10)) over (partition by qid order by result_id rows between unbounded preceding and 1 preceding), '')) as history_md5 from r""")
def history_prefix(spark: SparkSession, directory: str) -> DataFrame:
    rows = read(spark, directory, "search_results").select("qid", "result_id", F.coalesce("summary", F.lit("")).alias("summary")).distinct()
    return translation.with_history(rows, "qid", "result_id", "summary").select("qid", "result_id", F.md5("history").alias("history_md5"))


@plans.add("""select qid, event_no, rank_no, row_number() over (partition by qid order by event_no, rank_no, result_id) as position from (select distinct qid, event_no, rank_no, result_id from search_results)""")
def ordinal_numbers(spark: SparkSession, directory: str) -> DataFrame:
    rows = read(spark, directory, "search_results").select("qid", "event_no", "rank_no", "result_id").distinct()
    out = answer_events.numbered(rows, "qid", ["event_no", "rank_no", "result_id"])
    return out.select("qid", "event_no", "rank_no", (F.col("order") + 1).cast("long").alias("position"))


@plans.add("""select count(*) filter (where ok) as current, count(*) as total, count(*) - count(*) filter (where ok) as failed, case when count(*) = 0 then 0 else floor(100.0 * count(*) filter (where ok) / count(*) + 0.5)::bigint end as percent
from (select distinct url, coalesce(subtitles_available, false) as ok from video_metadata)""")
def progress(spark: SparkSession, directory: str) -> DataFrame:
    return ingest.progress(read(spark, directory, "video_metadata").select("url", F.coalesce("subtitles_available", F.lit(False)).alias("ok")).distinct())


@plans.add("select request_id, receive_count, case when coalesce(length(text), 0) = 0 then 400 else 200 end as status_code from process_request")
def worker_status(spark: SparkSession, directory: str) -> DataFrame:
    return status(read(spark, directory, "process_request")).select("request_id", "receive_count", "status_code")


@plans.add("""with recursive l as (select * from process_request qualify row_number() over (partition by request_id order by receive_count desc nulls last, sent_at desc nulls last, text nulls first) = 1),
s as (select request_id, case when chunk_size >= 1 then chunk_size else 1000 end as n, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: trim(x, ' ' || chr(10) || chr(13) || chr(9))), lambda x: x <> '') as s from l where length(text) > 0),
f(request_id, n, s, i, no, filled) as (
  select request_id, n, s, 1, 0, length(s[1]) from s where len(s) > 0
  union all
  select request_id, n, s, i + 1, case when filled + length(s[i + 1]) <= n then no else no + 1 end, case when filled + length(s[i + 1]) <= n then filled + 1 + length(s[i + 1]) else length(s[i + 1]) end from f where i < len(s)),
c as (select request_id, max(no) + 1 as chunks from f group by 1)
select request_id, case when coalesce(length(text), 0) = 0 then 400 else 200 end as status_code, coalesce(chunks, 0) as chunk_count, case when chunks is null then 0 else least(chunks, 768, case when pca_components >= 1 then pca_components else 256 end) end as embedding_dimensions
from l left join c using (request_id)""")
def worker_process(spark: SparkSession, directory: str) -> DataFrame:
    out = processed(queue.latest_delivery(read(spark, directory, "process_request")), "request_id")
    return out.select("request_id", "status_code", F.col("chunk_count").cast("long").alias("chunk_count"), F.col("embedding_dimensions").cast("long").alias("embedding_dimensions"))


@plans.add("""with l as (select * from process_request qualify row_number() over (partition by request_id order by receive_count desc nulls last, sent_at desc nulls last, text nulls first) = 1)
select request_id, case when receive_count >= 3 then 'dead_letter' when strlen(text) > 262144 then 'too_large' when coalesce(length(text), 0) = 0 then 'rejected' else 'accepted' end as outcome from l""")
def queue_outcome(spark: SparkSession, directory: str) -> DataFrame:
    return queue.latest_delivery(read(spark, directory, "process_request")).select("request_id", queue.outcome().alias("outcome"))


@plans.add("""with d as (select case when event_type = 'view' then 'text-processing-input' when event_type = 'click' then 'processed-chunks' else 'embedding-results' end as queue_name, time_bucket(interval 2 days, ts, timestamp '1970-01-01') as window_start, count(*) as messages from events group by all),
a as (select *, case when queue_name = 'text-processing-input' then 100 else 50 end as most, lag(messages) over w as before, lag(window_start) over w as prev from d window w as (partition by queue_name order by window_start))
select queue_name, epoch_us(window_start) as window_us, messages from a where before > most and messages > most and window_start - prev = interval 2 days""")
def queue_alarm(spark: SparkSession, directory: str) -> DataFrame:
    """The queues' own thresholds; periods are two days long, in which these events cross them."""
    name = F.when(F.col("event_type") == "view", "text-processing-input").when(F.col("event_type") == "click", "processed-chunks").otherwise("embedding-results")
    depths = queue.depth(read(spark, directory, "events").withColumn("queue_name", name), "queue_name", "ts", 2880)
    return queue.alarms(depths, "queue_name", queue.most("queue_name"), 2880).select("queue_name", F.unix_micros("window_start").alias("window_us"), "messages")


@plans.add("""with recursive r as (select client, epoch_us(emitted_at) as t, row_number() over (partition by client order by emitted_at) as i from search_results where client is not null and emitted_at is not null),
f(client, i, t, level, allowed) as (
  select client, i, t, 0.0::double, true from r where i = 1
  union all
  select r.client, r.i, r.t, greatest(0, f.level + f.allowed::int - (r.t - f.t) / 1e6 * 10), greatest(0, f.level + f.allowed::int - (r.t - f.t) / 1e6 * 10) <= 5 from f join r on r.client = f.client and r.i = f.i + 1)
select client, t as time_us, level as excess, allowed from f""")
def rate_limit(spark: SparkSession, directory: str) -> DataFrame:
    out = queue.rate_limited(read(spark, directory, "search_results"), "client", "emitted_at")
    return out.select("client", F.unix_micros("time").alias("time_us"), "excess", "allowed")


@plans.add("""select distinct qid, event_no, 'data: {"order":' || event_no || ',"context":[{' || coalesce('"title":' || to_json(title), '') || '}]}' || chr(10) || chr(10) as frame from search_results""")
def sse_frames(spark: SparkSession, directory: str) -> DataFrame:
    rows = read(spark, directory, "search_results")
    frame = sse_frame(F.col("event_no").alias("order"), F.array(F.struct("title")).alias("context"))
    return rows.select("qid", "event_no", frame.alias("frame")).distinct()


@plans.add("""with e as (select event_id, case when event_type in ('view', 'click') then ['final_answer'] when event_type = 'purchase' then ['retriever_end', 'seq'] else ['internal'] end as tags, user_id, ts from events),
n as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as "order" from e)
select user_id, event_id, "order" from n where list_has_any(tags, ['final_answer', 'retriever_end', 'reformulated'])""")
def ordered_events(spark: SparkSession, directory: str) -> DataFrame:
    kind = F.col("event_type")
    tags = F.when(kind.isin("view", "click"), F.array(F.lit("final_answer"))).when(kind == "purchase", F.array(F.lit("retriever_end"), F.lit("seq"))).otherwise(F.array(F.lit("internal")))
    rows = answer_events.numbered(read(spark, directory, "events").withColumn("tags", tags), "user_id", ["ts", "event_id"])
    return answer_events.emitted(rows).select("user_id", "event_id", F.col("order").cast("long").alias("order"))


@plans.add("""with m as (select distinct qid, event_no as "order", coalesce(summary, '') as message from search_results), o as (select qid, "order", min(message) as message from m group by all)
select qid, md5(string_agg(message, '' order by "order")) as text_md5 from o group by qid""")
def answer_text(spark: SparkSession, directory: str) -> DataFrame:
    rows = read(spark, directory, "search_results").select("qid", F.col("event_no").alias("order"), F.coalesce("summary", F.lit("")).alias("message"))
    return answer_events.folded(rows).select("qid", F.md5("text").alias("text_md5"))


@plans.add("select source as url, coalesce(starts_with(source, 'http'), false) as ok from (select distinct source from chunks)")
def load_outcome(spark: SparkSession, directory: str) -> DataFrame:
    return read(spark, directory, "chunks").select("source").distinct().select(F.col("source").alias("url"), text.is_url(F.col("source")).alias("ok"))


@plans.add("""select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem group by all""")
def pricing_summary(spark: SparkSession, directory: str) -> DataFrame:
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return read(spark, directory, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), revenue.alias("revenue"), F.count("*").alias("n"))


@plans.add("""select url, coalesce(description, '') as description, coalesce(duration, 0) as duration, coalesce(view_count, 0) as view_count, coalesce(uploader, '') as uploader, coalesce(channel, '') as channel,
coalesce(language, '') as language, coalesce(like_count, 0) as like_count, len(coalesce(tags, []))::int as tags, coalesce(subtitles_available, false) as subtitles, try_strptime(upload_date, '%Y%m%d')::date as uploaded_on from video_metadata""")
def metadata_defaults(spark: SparkSession, directory: str) -> DataFrame:
    rows = ingest.with_defaults(read(spark, directory, "video_metadata"))
    return rows.select("url", "description", "duration", "view_count", "uploader", "channel", "language", "like_count", F.size("tags").alias("tags"), F.col("subtitles_available").alias("subtitles"), "uploaded_on")


@plans.add("""select doc_id, replace(replace(replace(replace(replace(url_encode(title), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*') as query from documents where title is not null""")
def url_params(spark: SparkSession, directory: str) -> DataFrame:
    return read(spark, directory, "documents").where("title is not null").select("doc_id", text.url_component(F.col("title")).alias("query"))


@plans.add("""select distinct qid, 1 as "order", 'data: {"message":"An error occurred while processing your query.","order":1}' || chr(10) || chr(10) as frame from search_results where summary is null""")
def error_event(spark: SparkSession, directory: str) -> DataFrame:
    """Answers with a result that has no summary stand for failed ones."""
    failed = read(spark, directory, "search_results").where("summary is null").select("qid").distinct()
    return answer_events.error_events(failed)


@plans.add("""with q as (select vec_id, embedding from embeddings where vec_id % 20 = 0),
hits as (select q.vec_id as qid, e.vec_id, list_inner_product(q.embedding::double[], e.embedding::double[]) as score from q, embeddings e),
top as (select * from hits qualify row_number() over (partition by qid order by score desc, vec_id) <= 3)
select t.qid, t.vec_id, d.title, d.lang from top t join documents d on d.doc_id = t.vec_id""")
def docstore_join(spark: SparkSession, directory: str) -> DataFrame:
    """Index ids to documents, after the search."""
    from larkspur.operators.retrieval import top_k

    rows = read(spark, directory, "embeddings")
    hits = top_k(rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding"), rows, 3)
    docs = read(spark, directory, "documents").select(F.col("doc_id").alias("vec_id"), "title", "lang")
    return hits.select("qid", "vec_id").join(docs, "vec_id").select("qid", "vec_id", "title", "lang")


_NL = "chr(10) || "
_ASK = f"""with d as (select doc_id, text, list_transform(range(26), lambda i: (length(lower(text)) - length(replace(lower(text), chr((97 + i)::int), '')))::double) as v,
  'content: ' || text || {_NL}'title: ' || coalesce(title, 'Unknown Source') || {_NL}'type: pdf' || {_NL}'link: ' || coalesce(page_url, '') || {_NL}'timestamp_seconds: None' || {_NL}'summary: None' as block from documents where text <> ''),
q as (select doc_id as qid, title as question, case when doc_id % 40 = 0 then source end as history, (doc_id // 20) % 6 as m from documents where doc_id % 20 = 0 and title is not null),
s as (select *, coalesce(nullif(history, '') || ' ', '') || question as standalone from q),
asked as (
  select qid, m, unnest(range(5)) as no, unnest([standalone, 'What about ' || standalone, 'Explain ' || standalone, 'Details of ' || standalone, 'Sources on ' || standalone]) as query from s where m = 0
  union all select qid, m, unnest(range(4)), unnest([standalone, standalone || ' overview', standalone || ' law', standalone || ' example']) from s where m = 1
  union all select qid, m, unnest(range(3)), unnest(['What is ' || standalone, 'Why ' || standalone, 'How ' || standalone]) from s where m = 2
  union all select qid, m, unnest(range(2)), unnest([standalone, 'What is known about ' || standalone]) from s where m = 3
  union all select qid, m, 0, standalone from s where m = 4),
v as (select qid, m, no, query, list_transform(range(26), lambda i: (length(lower(query)) - length(replace(lower(query), chr((97 + i)::int), '')))::double) as w from asked),
hits as (select qid, m, no, query, d.doc_id, d.block, row_number() over (partition by qid, no order by list_inner_product(w, d.v) desc, d.doc_id) - 1 as rank from v, d qualify rank < 3),
united as (select qid, string_agg(block, chr(10) || chr(10) order by first, doc_id) as context from (select qid, doc_id, block, min(no * 1000 + rank) as first from hits where m = 0 group by all) group by qid),
fused as (select qid, string_agg(block, chr(10) || chr(10) order by score desc, first, doc_id) as context from (select qid, doc_id, block, round(sum(1.0 / (rank + 60)), 12) as score, min(no * 1000 + rank) as first from hits where m = 1 group by all) group by qid),
lists as (select qid, m, no, query, string_agg(block, chr(10) || chr(10) order by rank) as text from hits where m > 1 group by all),
p0 as (select qid, 'Question: ' || query || {_NL}'Answer: answer: ' || query || ' | ' || text || ' | ' as pairs from lists where m = 2 and no = 0),
p1 as (select qid, pairs || {_NL}'---' || {_NL}'Question: ' || query || {_NL}'Answer: answer: ' || query || ' | ' || text || ' | ' || pairs as pairs from lists join p0 using (qid) where m = 2 and no = 1),
p2 as (select qid, pairs || {_NL}'---' || {_NL}'Question: ' || query || {_NL}'Answer: answer: ' || query || ' | ' || text || ' | ' || pairs as pairs from lists join p1 using (qid) where m = 2 and no = 2),
contexts as (
  select * from united union all select * from fused union all select qid, 'synthesis: ' || pairs from p2
  union all select a.qid, 'stepback: ' || a.text || ' | ' || b.text || ' | ' || a.query from lists a join lists b on a.qid = b.qid and a.no = 0 and b.no = 1 where a.m = 3
  union all select qid, 'hyde: ' || text from lists where m = 4),
answers as (select s.qid, case when m = 5 then 'general: ' else 'final: ' || coalesce(context, 'No documents available') || ' | ' end || coalesce(nullif(history, '') || ' | ', '') || question as answer from s left join contexts using (qid))
select qid, length(answer) as answer_length, md5(answer) as answer_md5 from answers"""


@plans.add(_ASK)
def ask(spark: SparkSession, directory: str) -> DataFrame:
    """Every document whose id is divisible by 20 asks with its title, against all documents; labels go round all methods, and every second question has a history."""
    docs = read(spark, directory, "documents")
    chunks = docs.select("doc_id", F.col("text").alias("page_content"), "title", F.lit("pdf").alias("type"), F.col("page_url").alias("source"), F.lit(0.0).alias("page"), F.lit(None).cast("string").alias("summary"))
    labels = ["document request", "Document Request: ragfusion", "document request, decompose", "document request stepback", "document request (hyde)", "chat"]
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), (F.floor(F.col("doc_id") / 20) % 6 + 1).cast("int"))
    asking_docs = docs.where("doc_id % 20 = 0 and title is not null")
    questions = asking_docs.select(F.col("doc_id").alias("qid"), F.col("title").alias("question"), label.alias("label"))
    history = asking_docs.where("doc_id % 40 = 0").select(F.col("doc_id").alias("qid"), F.col("source").alias("history"))
    out = answers(questions, chunks, "doc_id", translation.rule_model, letter_embedding, history=history)
    return out.select("qid", F.length("answer").alias("answer_length"), F.md5("answer").alias("answer_md5"))
