"""Retrieval and fusion over the embeddings table: every row whose id is divisible by 20 is a query against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import fusion, retrieval, translation
from larkspur.operators.embedding import letter_embedding, pca, placeholder_embedding
from larkspur.plans.registry import Registry
from larkspur.tables import read

plans = Registry()
K = 3

_HITS = """hits as (
  select q.vec_id as qid, e.vec_id, e.label, list_inner_product(q.embedding::double[], e.embedding::double[]) as score
  from embeddings q, embeddings e where q.vec_id % 20 = 0 {where}),
top as (select *, row_number() over (partition by qid order by score desc, vec_id) as rank from hits qualify rank <= {k})"""


def _hits(k: int = K, where: str = "") -> str:
    return _HITS.format(k=k, where=where)


def _queries(rows: DataFrame) -> DataFrame:
    return rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def _top(rows: DataFrame, k: int = K) -> DataFrame:
    return retrieval.top_k(_queries(rows), rows, k)


def _labels(hits: DataFrame, rows: DataFrame) -> DataFrame:
    # late materialisation: only hits meet the other columns
    return hits.join(rows.select("vec_id", "label"), "vec_id")



def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("qid", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_SHOW = "select qid, vec_id, round(score, 6) as score, rank from top"


@plans.add(f"with {_hits()} {_SHOW}")
def vec_topk(spark: SparkSession, directory: str) -> DataFrame:
    return _shown(_top(read(spark, directory, "embeddings")))


@plans.add(f"with {_hits()} {_SHOW} where score >= 0.3")
def vec_topk_threshold(spark: SparkSession, directory: str) -> DataFrame:
    return _shown(retrieval.over_threshold(_top(read(spark, directory, "embeddings")), 0.3))


@plans.add(f"with {_hits()} {_SHOW} where score <= 0.7")
def vec_topk_distance_reading(spark: SparkSession, directory: str) -> DataFrame:
    return _shown(retrieval.over_threshold(_top(read(spark, directory, "embeddings")), 0.7, "le"))


@plans.add(f"with {_hits(where='and e.label in (1, 3, 5)')} {_SHOW}")
def vec_topk_filtered(spark: SparkSession, directory: str) -> DataFrame:
    rows = read(spark, directory, "embeddings")
    return _shown(retrieval.top_k(_queries(rows), rows.where("label in (1, 3, 5)"), K))


@plans.add(f"with {_hits(20)}, kept as (select qid, vec_id, score, row_number() over (partition by qid order by score desc, vec_id) as rank from top where label = 2) select qid, vec_id, round(score, 6) as score, rank from kept where rank <= 3")
def vec_topk_fetched(spark: SparkSession, directory: str) -> DataFrame:
    rows = read(spark, directory, "embeddings")
    return _shown(retrieval.fetched_then_filtered(_labels(_top(rows, 20), rows), F.col("label") == 2, K))


@plans.add(f"with {_hits(20)}, firsts as (select * from top qualify row_number() over (partition by qid, label order by rank) = 1) select qid, vec_id, round(score, 6) as score, rank from firsts where label <> 4")
def vec_title_distinct(spark: SparkSession, directory: str) -> DataFrame:
    rows = read(spark, directory, "embeddings")
    return _shown(retrieval.title_distinct(_labels(_top(rows, 20), rows), "label", F.col("label") != 4))


@plans.add("""select e.vec_id, round(list_inner_product(q.embedding::double[], e.embedding::double[]), 6) as score
from embeddings e, (select embedding from embeddings where vec_id = 0) q
order by list_inner_product(q.embedding::double[], e.embedding::double[]) desc, e.vec_id limit 4""")
def vec_single_topk(spark: SparkSession, directory: str) -> DataFrame:
    rows = read(spark, directory, "embeddings")
    query = rows.where("vec_id = 0").select("embedding").first()[0]
    return retrieval.single_top_k(rows, query).select("vec_id", F.round("score", 6).alias("score"))


def _variants(rows: DataFrame) -> DataFrame:
    """Three rewritings of each query: itself, and the vectors with the next two ids."""
    vectors = rows.select(F.col("vec_id").alias("of"), "embedding")
    base = _queries(rows).select("qid", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("list_no"))
    return base.withColumn("of", F.col("qid") + F.col("list_no")).join(vectors, "of").drop("of")


_LISTS = """v as (select q.vec_id as qid, n.n as list_no, w.embedding from embeddings q, (values (0), (1), (2)) n(n), embeddings w where q.vec_id % 20 = 0 and w.vec_id = q.vec_id + n.n),
hits as (select v.qid, v.list_no, e.vec_id, list_inner_product(v.embedding::double[], e.embedding::double[]) as score from v, embeddings e),
lists as (select qid, list_no, vec_id, row_number() over (partition by qid, list_no order by score desc, vec_id) - 1 as rank from hits qualify rank < 3)"""
_RRF = """fused as (select qid, vec_id, sum(1.0 / (rank + 60)) as score, min(list_no * 1000 + rank) as first from lists group by qid, vec_id)"""


@plans.add(f"with {_LISTS}, {_RRF} select qid, vec_id, round(score, 9) as score, row_number() over (partition by qid order by round(score, 12) desc, first, vec_id) as place from fused")
def rag_fusion(spark: SparkSession, directory: str) -> DataFrame:
    rows = read(spark, directory, "embeddings")
    return translation.rag_fusion(_variants(rows), rows).select("qid", "vec_id", F.round("score", 9).alias("score"), F.col("place").cast("long").alias("place"))


@plans.add(f"with {_LISTS}, f as (select qid, vec_id, min(list_no * 1000 + rank) as first from lists group by qid, vec_id) select qid, vec_id, row_number() over (partition by qid order by first, vec_id) as place from f")
def multi_query(spark: SparkSession, directory: str) -> DataFrame:
    rows = read(spark, directory, "embeddings")
    return translation.multi_query(_variants(rows), rows).select("qid", "vec_id", F.col("place").cast("long").alias("place"))


@plans.add(f"with {_LISTS} select qid, case when list_no = 0 then 'normal_context' else 'step_back_context' end as context, rank, vec_id from lists where list_no < 2")
def step_back(spark: SparkSession, directory: str) -> DataFrame:
    rows = read(spark, directory, "embeddings")
    hits = translation.step_back(_variants(rows).where("list_no < 2"), rows)
    return hits.select("qid", "context", F.col("rank").cast("long").alias("rank"), "vec_id")


@plans.add(f"with {_LISTS} select qid, rank, vec_id from lists where list_no = 1")
def hyde(spark: SparkSession, directory: str) -> DataFrame:
    rows = read(spark, directory, "embeddings")
    passages = _variants(rows).where("list_no = 1").drop("list_no")
    return translation.hyde(passages, rows).select("qid", F.col("rank").cast("long").alias("rank"), "vec_id")


@plans.add("""with lists as (select qid, event_no as list_no, rank_no as rank, link as doc_key from search_results where link is not null and rank_no is not null group by all),
f as (select qid, doc_key, sum(1.0 / (rank + 60)) as score, min({'l': list_no, 'r': rank}) as first from lists group by qid, doc_key)
select qid, doc_key, round(score, 9) as score, row_number() over (partition by qid order by round(score, 12) desc, first, doc_key) as place from f""")
def rrf_fusion(spark: SparkSession, directory: str) -> DataFrame:
    lists = read(spark, directory, "search_results").where("rank_no is not null").select("qid", F.col("event_no").alias("list_no"), F.col("rank_no").alias("rank"), F.col("link").alias("doc_key")).distinct()
    return fusion.reciprocal_rank_fusion(lists).select("qid", "doc_key", F.round("score", 9).alias("score"), F.col("place").cast("long").alias("place"))


@plans.add("""with lists as (select distinct qid, link from search_results where link is not null and type = 'youtube')
select qid, link as doc_key from lists union all select distinct qid, 'No relevant documents found.' from search_results where qid not in (select qid from lists)""")
def rrf_empty_guard(spark: SparkSession, directory: str) -> DataFrame:
    rows = read(spark, directory, "search_results")
    lists = rows.where("type = 'youtube'").select("qid", F.col("event_no").alias("list_no"), F.col("rank_no").alias("rank"), F.col("link").alias("doc_key"))
    return fusion.with_placeholder(rows.select("qid"), fusion.reciprocal_rank_fusion(lists).select("qid", "doc_key"))


@plans.add("""with f as (select qid, link as doc_key, min({'l': event_no, 'r': rank_no}) as first from search_results where link is not null group by all)
select qid, doc_key, row_number() over (partition by qid order by first, doc_key) as place from f""")
def unique_union(spark: SparkSession, directory: str) -> DataFrame:
    lists = read(spark, directory, "search_results").where("link is not null").select("qid", F.col("event_no").alias("list_no"), F.col("rank_no").alias("rank"), F.col("link").alias("doc_key"))
    return fusion.unique_union(lists).select("qid", "doc_key", F.col("place").cast("long").alias("place"))


@plans.add()
def pca_reduce(spark: SparkSession, directory: str) -> DataFrame:
    out = pca(read(spark, directory, "embeddings"), "embedding", 8, "vec_id")
    return out.select("vec_id", F.transform("reduced", lambda x: F.round(x, 6)).alias("reduced"))


@plans.add("""select doc_id, case when text is null then -1 else 768 end as dims, case when text is not null then ('0x' || substr(md5(text), 1, 8))::bigint % 1000 end::double as least, least as greatest from documents""")
def placeholder_embed(spark: SparkSession, directory: str) -> DataFrame:
    v = placeholder_embedding(F.col("text"))
    return read(spark, directory, "documents").select("doc_id", F.coalesce(F.size(v), F.lit(-1)).alias("dims"), F.array_min(v).alias("least"), F.array_max(v).alias("greatest"))


@plans.add("""with d as (select doc_id, list_transform(range(26), lambda i: (length(lower(text)) - length(replace(lower(text), chr((97 + i)::int), '')))::double) as v from documents where text <> ''),
top as (select q.doc_id as qid, d.doc_id as vec_id, list_inner_product(q.v, d.v) as score, row_number() over (partition by q.doc_id order by list_inner_product(q.v, d.v) desc, d.doc_id) as rank from d q, d where q.doc_id % 20 = 0 qualify rank <= 3)
select qid, vec_id, round(score, 6) as score, rank from top""")
def text_search(spark: SparkSession, directory: str) -> DataFrame:
    """Texts embedded by a stand-in for a model; every document whose id is divisible by 20 asks with its text."""
    docs = read(spark, directory, "documents").where("text <> ''").select("doc_id", letter_embedding(F.col("text")).alias("embedding"))
    return _shown(retrieval.top_k(docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "qid"), docs, K, row_key="doc_id"))
