"""From questions to answers: route, rewrite, translate, retrieve, fuse, format, answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import NO_DOCUMENTS, NOTHING_FOUND, deep_link, document_block
from larkspur.operators import retrieval, translation
from larkspur.operators.fusion import reciprocal_rank_fusion, unique_union
from larkspur.session import materialize

# A context is of several documents and can have a million characters: rows go to Python by their bytes, not by number.
BATCH_BYTES = 8 << 20


def indexed(chunks: DataFrame, key: str, text: str, embed: Callable[[Column], Column]) -> DataFrame:
    """(vec_id, embedding) for a numeric key; texts stay behind until after the search."""
    return chunks.where(F.col(text) != "").select(F.col(key).cast("long").alias("vec_id"), embed(F.col(text)).alias("embedding"))


def translated(questions: DataFrame, model: translation.Model) -> DataFrame:
    """(qid, method, list_no, query) for questions (qid, question, method): the queries each method searches with.

    Several wordings for multiquery and ragfusion, the parts of a question for decompose, the question itself and a broader one
    for stepback, and a passage that could answer it for hyde.
    """
    def of(method: str) -> DataFrame:
        return questions.where(F.col("method") == method)

    def one(method: str, kind: str, no: int) -> DataFrame:
        return of(method).select("qid", F.lit(no).alias("list_no"), translation.asked(model)(F.concat(F.lit(f"{kind}|"), "question")).alias("query"))

    each = [
        ("multiquery", translation.fan_out(of("multiquery"), model, "multi")),
        ("ragfusion", translation.fan_out(of("ragfusion"), model, "fusion")),
        ("decompose", translation.fan_out(of("decompose"), model, "parts", strip=True)),
        ("stepback", of("stepback").select("qid", F.lit(0).alias("list_no"), F.col("question").alias("query")).union(one("stepback", "broader", 1))),
        ("hyde", one("hyde", "passage", 0)),
    ]
    out = None
    for method, queries in each:
        some = queries.select("qid", F.lit(method).alias("method"), "list_no", "query")
        out = some if out is None else out.union(some)
    return out.where("query is not null")


def hits(queries: DataFrame, index: DataFrame, embed: Callable[[Column], Column], k: int = 3, threshold: float | None = None) -> DataFrame:
    """(qid, method, list_no, rank, vec_id), ranks from 0, for translated queries: k hits each."""
    found = retrieval.top_k(queries.select("qid", "method", "list_no", embed(F.col("query")).alias("embedding")), index, k, query_key=["qid", "method", "list_no"])
    if threshold is not None:
        found = retrieval.over_threshold(found, threshold)
    return found.withColumn("rank", F.col("rank") - 1).drop("score")


def _joined(placed: DataFrame, blocks: DataFrame, *by: str) -> DataFrame:
    """(by..., text): a list's documents as prompt text, in order of `place`."""
    docs = placed.join(blocks, "vec_id")
    lists = docs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", "block"))).alias("l"))  # a few documents
    return lists.select(*by, F.array_join(F.transform("l", lambda x: x["block"]), "\n\n").alias("text"))


def contexts(queries: DataFrame, found: DataFrame, chunks: DataFrame, key: str, model: translation.Model) -> DataFrame:
    """(qid, context): what each question is answered from. Hits are joined to their texts only here.

    multiquery: the documents of all wordings; ragfusion: the same by fused rank, or a placeholder where nothing was found;
    decompose, stepback and hyde: what the model made of the documents of the parts, of the two contexts, and of the passage's.
    """
    link = deep_link(F.col("source"), F.col("type"), F.col("page"))
    block = document_block(F.col("page_content"), F.col("title"), F.col("type"), link, F.col("page"), F.col("summary"))
    blocks = chunks.select(F.col(key).cast("long").alias("vec_id"), block.alias("block"))
    null = F.lit(None).cast("string")
    nothing = document_block(F.lit(NOTHING_FOUND), null, null, F.lit(""), null, null)

    def answers(method: str) -> DataFrame:
        return queries.where(F.col("method") == method).select("qid").distinct()

    def of(method: str) -> DataFrame:
        return found.where(F.col("method") == method)

    def context(method: str, placed: DataFrame, otherwise: Column) -> DataFrame:
        text = _joined(placed.select("qid", "vec_id", "place"), blocks, "qid")
        return answers(method).join(text, "qid", "left").select("qid", F.coalesce("text", otherwise).alias("context"))

    united = context("multiquery", unique_union(of("multiquery"), key="vec_id"), F.lit(NO_DOCUMENTS))
    fused = context("ragfusion", reciprocal_rank_fusion(of("ragfusion"), key="vec_id"), nothing)
    listed = found.where("method in ('decompose', 'stepback', 'hyde')").withColumnRenamed("rank", "place")
    lists = queries.where("method in ('decompose', 'stepback', 'hyde')").join(_joined(listed, blocks, "qid", "list_no"), ["qid", "list_no"], "left")
    lists = lists.select("qid", "method", "list_no", "query", F.coalesce("text", F.lit(NO_DOCUMENTS)).alias("text"))
    parts = translation.decompose(lists.where("method = 'decompose'"), model).select("qid", F.col("answer").alias("context"))
    said = translation.asked(model)
    normal, broader = (lists.where(f"method = 'stepback' and list_no = {no}").select("qid", "query", F.col("text").alias(f"text_{no}")) for no in (0, 1))
    both = normal.join(broader.drop("query"), "qid", "left")
    stepped = both.select("qid", said(F.concat(F.lit("stepback|"), "text_0", F.lit(" | "), F.coalesce("text_1", F.lit(NO_DOCUMENTS)), F.lit(" | "), "query")).alias("context"))
    passed = lists.where("method = 'hyde'").select("qid", said(F.concat(F.lit("hyde|"), "text")).alias("context"))
    return united.union(fused).union(parts).union(stepped).union(passed)


def ask(questions: DataFrame, chunks: DataFrame, key: str, model: translation.Model, embed: Callable[[Column], Column], k: int = 3, history: DataFrame | None = None, threshold: float | None = None) -> DataFrame:
    """(qid, answer) for questions (qid, question, label): retrieval for document requests, else a plain answer.

    With a history (qid, history), what is searched is the question rewritten to stand alone; the answer sees both.
    The session's Arrow batches are limited to BATCH_BYTES.
    """
    questions.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    history = questions.select("qid", F.lit(None).cast("string").alias("history")).limit(0) if history is None else history.select("qid", "history")
    routed = contextualised(translation.routed(questions, "label"), history, model)
    searched = routed.where("intent = 'retrieval'").select("qid", "method", F.col("standalone").alias("question"))
    queries = materialize(translated(searched, model), "queries")  # the model is asked once
    found = materialize(hits(queries, indexed(chunks, key, "page_content", embed), embed, k, threshold), "hits")
    told = routed.join(contexts(queries, found, chunks, key, model), "qid", "left")
    return translation.answered(told, model)


def contextualised(questions: DataFrame, history: DataFrame, model: translation.Model) -> DataFrame:
    """Adds `history` and `standalone`: the question rewritten with its conversation's history (qid, history) in view."""
    both = questions.join(history, "qid", "left")
    prompt = F.concat(F.lit("standalone|"), F.when(F.coalesce("history", F.lit("")) != "", F.concat("history", F.lit(" "))).otherwise(""), "question")
    return both.withColumn("standalone", translation.asked(model)(prompt))
