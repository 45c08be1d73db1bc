"""Query translation and answering as relational plans around a pluggable language model.

A model is a function of a pandas Series of prompts to a Series of answers. `rule_model` is a deterministic stand-in.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import NO_DOCUMENTS, intent_of, method_of, split_lines
from larkspur.operators.fusion import reciprocal_rank_fusion, unique_union
from larkspur.operators.retrieval import top_k

Model = Callable[[pd.Series], pd.Series]


def rule_model(prompts: pd.Series) -> pd.Series:
    """Answers by rule: a prompt `kind|text` gives rewritings of the text, one a line."""
    def answer(p: str) -> str:
        kind, _, text = (p or "").partition("|")
        if kind == "multi":
            return "\n".join([text, f"What about {text}", f"Explain {text}", f"Details of {text}", f"Sources on {text}"])
        if kind == "fusion":
            return "\n".join([text, f"{text} overview", f"{text} law", f"{text} example"])
        if kind == "parts":
            return "\n".join([f"What is {text}", f"Why {text}", f"How {text}"])
        if kind == "broader":
            return f"What is known about {text}"
        return text if kind in ("standalone", "passage", "clean") else f"{kind}: {text}"

    return prompts.map(answer)


def asked(model: Model) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return model(prompts)

    return run


def fan_out(questions: DataFrame, model: Model, kind: str, strip: bool = False, drop_blank: bool = False) -> DataFrame:
    """(qid, list_no, query): the lines of the model's answer, from 0, as many as it gives.

    Blank lines are queries unless dropped; `strip` takes white space off the whole answer first.
    """
    said = asked(model)(F.concat(F.lit(f"{kind}|"), "question"))
    lines = split_lines(F.trim(said, F.lit(" \n\r\t")) if strip else said, drop_blank)
    return questions.select("qid", F.posexplode(lines).alias("list_no", "query"))


def retrieved(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(qid, list_no, rank, vec_id), ranks from 0, for queries (qid, list_no, embedding)."""
    hits = top_k(queries, rows, k, query_key=["qid", "list_no"])
    return hits.select("qid", "list_no", (F.col("rank") - 1).alias("rank"), "vec_id")


def multi_query(queries: DataFrame, rows: DataFrame, k: int = 3) -> DataFrame:
    return unique_union(retrieved(queries, rows, k), key="vec_id")


def rag_fusion(queries: DataFrame, rows: DataFrame, k: int = 3) -> DataFrame:
    return reciprocal_rank_fusion(retrieved(queries, rows, k), key="vec_id")


def step_back(queries: DataFrame, rows: DataFrame, k: int = 3) -> DataFrame:
    """(qid, context, rank, vec_id): the question's hits (list 0) and the general question's (list 1), kept as two contexts."""
    hits = retrieved(queries, rows, k)
    return hits.select("qid", F.when(F.col("list_no") == 0, "normal_context").otherwise("step_back_context").alias("context"), "rank", "vec_id")


def hyde(passages: DataFrame, rows: DataFrame, k: int = 3) -> DataFrame:
    """(qid, rank, vec_id): hits of the passage written for a question instead of the question."""
    return retrieved(passages.withColumn("list_no", F.lit(0)), rows, k).drop("list_no")


def running_context(answered: DataFrame, group: str, order: str, question: str, answer: str) -> DataFrame:
    """Adds `context`: all earlier question and answer pairs of a group, in order; empty for the first.

    Its length grows with the group, as what it must hold does; groups are the parts of one question.
    """
    pair = F.concat(F.lit("Question: "), question, F.lit("\nAnswer: "), answer)
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return answered.withColumn("context", F.array_join(F.collect_list(pair).over(before), "\n---\n"))


def decompose(parts: DataFrame, model: Model) -> DataFrame:
    """(qid, answer): parts (qid, list_no, query, text) of a question answered one after another, then together.

    Each part is answered from its own documents' text with all earlier pairs in view. The fold is per question and
    bounded by its parts.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs: list[str] = []
        for q, text in pdf.sort_values("list_no")[["query", "text"]].itertuples(index=False):
            earlier = "\n---\n".join(pairs)
            said = model(pd.Series([f"answer|{q} | {text or ''} | {earlier}"])).iloc[0]
            pairs.append(f"Question: {q}\nAnswer: {said}")
        final = model(pd.Series(["synthesis|" + "\n---\n".join(pairs)])).iloc[0]
        return pd.DataFrame({"qid": [pdf["qid"].iloc[0]], "answer": [final]})

    return parts.select("qid", "list_no", "query", "text").groupBy("qid").applyInPandas(fold, "qid long, answer string")


def routed(questions: DataFrame, label: str) -> DataFrame:
    """Adds `intent` and `method` from a model's label."""
    return questions.withColumn("intent", F.coalesce(intent_of(F.col(label)), F.lit("general"))).withColumn("method", method_of(F.col(label)))


def with_history(history: DataFrame, conversation: str, turn: str, text: str) -> DataFrame:
    """Adds `history`: the conversation's earlier texts, in order, one a line. Each conversation has its own."""
    before = Window.partitionBy(conversation).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return history.withColumn("history", F.array_join(F.collect_list(text).over(before), "\n"))


def answered(questions: DataFrame, model: Model) -> DataFrame:
    """(qid, answer): the final answer to (qid, question, intent, context, history): from context where the intent is retrieval, else without.

    The question is the one that was asked, not the reformulated one; the history goes with both kinds of answer.
    """
    earlier = F.when(F.coalesce("history", F.lit("")) != "", F.concat("history", F.lit(" | "))).otherwise("")
    with_documents = F.concat(F.lit("final|"), F.coalesce("context", F.lit(NO_DOCUMENTS)), F.lit(" | "), earlier, "question")
    prompt = F.when(F.col("intent") == "retrieval", with_documents).otherwise(F.concat(F.lit("general|"), earlier, "question"))
    return questions.select("qid", asked(model)(prompt).alias("answer"))
