"""Retrieval, fusion, embedding, joins, translation, queues and sources on small cases."""

import json
from urllib.parse import quote

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspur.functions import json_doc, text
from larkspur.operators import embedding, fusion, ingest, retrieval, translation, worker
from larkspur.plans import relational
from larkspur.sources import files, transcripts
from larkspur.streaming import chunks, events, queue
from larkspur.streaming.runs import run_to_end, stream_of


def vectors(spark, n, dim, seed=0):
    v = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    return v, spark.createDataFrame([(i, x.tolist(), int(i % 3)) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")


def test_top_k(spark):
    v, df = vectors(spark, 300, 8)
    df = df.union(spark.createDataFrame([(900, None, 1), (901, [1.0], 1), (None, [0.0] * 8, 1)], df.schema)).repartition(5)
    queries = df.where("vec_id % 20 = 0 and vec_id < 300").select(F.col("vec_id").alias("qid"), "embedding")
    got = {(r.qid, r["rank"]): r.vec_id for r in retrieval.top_k(queries, df, 4, block=37).collect()}
    score = v.astype(float) @ v.astype(float).T
    want = {(q, k + 1): int(i) for q in range(0, 300, 20) for k, i in enumerate(np.lexsort((np.arange(300), -score[q]))[:4])}
    assert got == want
    # a query set too large to be held: a grid of cells
    grid = retrieval.top_k(queries.withColumn("part", F.lit("p")), df, 4, query_key=["part", "qid"], block=7, most_bytes=1)
    assert {(r.qid, r["rank"]): r.vec_id for r in grid.collect()} == want
    assert "BroadcastNestedLoop" not in grid._jdf.queryExecution().toString() and "CartesianProduct" not in grid._jdf.queryExecution().toString()


def test_top_k_ties_and_few(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in (5, 3, 4)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, embedding array<float>")
    assert [r.vec_id for r in retrieval.top_k(q, df, 2).orderBy("rank").collect()] == [3, 4]
    assert retrieval.top_k(q, df, 9).count() == 3
    assert retrieval.top_k(q, df.limit(0), 9).count() == 0
    assert retrieval.over_threshold(retrieval.top_k(q, df, 2), 2.0).count() == 0


def test_rrf(spark):
    rows = [(1, 0, 0, "A"), (1, 0, 1, "B"), (1, 1, 0, "B"), (1, 1, 1, "C"), (1, 1, 2, None)]
    df = spark.createDataFrame(rows, "qid long, list_no int, rank int, doc_key string")
    out = fusion.reciprocal_rank_fusion(df).orderBy("place").collect()
    assert [r.doc_key for r in out] == ["B", "A", "C"]
    assert abs(out[0].score - (1 / 61 + 1 / 60)) < 1e-12
    queries = spark.createDataFrame([(1,), (2,)], "qid long")
    assert fusion.with_placeholder(queries, fusion.reciprocal_rank_fusion(df)).where("qid = 2").first().doc_key == "No relevant documents found."
    assert [r.doc_key for r in fusion.unique_union(df.where("doc_key is not null")).orderBy("place").collect()] == ["A", "B", "C"]


def test_keep_first(spark):
    df = spark.createDataFrame([("t", None, 2), ("t", None, 1), ("t", 5, 3), (None, None, 4)], "title string, ts long, no int")
    assert sorted(r.no for r in fusion.keep_first(df, ["title", "ts"], ["no"]).collect()) == [1, 3, 4]


def test_pca(spark):
    v, df = vectors(spark, 50, 6, 3)
    out = {r.vec_id: r.reduced for r in embedding.pca(df, "embedding", 3, "vec_id").collect()}
    x = v.astype(float) - v.astype(float).mean(axis=0)
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    axes = axes[:3] * np.sign(axes[:3][np.arange(3), np.abs(axes[:3]).argmax(axis=1)])[:, None]
    assert np.allclose(np.array([out[i] for i in range(50)]), x @ axes.T, atol=1e-5)
    assert embedding.pca(df.limit(0), "embedding", 3, "vec_id").count() == 0
    assert len(embedding.pca(df.where("vec_id < 2"), "embedding", 8, "vec_id").first().reduced) == 2


def test_text_functions(spark):
    def one(column, **values):
        return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]

    assert one(text.normal_title(F.col("p")), p="a/b/ My__Title   x .pdf") == "My Title  x"
    assert one(text.first_removed(F.col("p")), p="/waiting_room/a/waiting_room/b") == "/a/waiting_room/b"
    assert one(text.error_class(F.col("p")), p="no element found") == "retry"
    assert one(text.availability(F.lit(None).cast("string"), F.col("p")), p="Video was Deleted") == "deleted"
    assert one(text.method_of(F.col("p")), p="use hyde or decompose") == "decompose"
    assert one(text.method_of(F.col("p")), p="HYDE") == "multiquery"
    assert one(text.intent_of(F.col("p")), p="a Document Request") == "retrieval"


def test_json3(spark):
    body = '{"events":[{"tStartMs":1500,"dDurationMs":700,"segs":[{"utf8":"a"},{"utf8":"b "}]},{"tStartMs":9},{"segs":[{"utf8":" "}]}]}'
    df = spark.createDataFrame([("v", body), ("w", "not json"), ("x", None)], "video_id string, body string")
    assert [tuple(r) for r in json_doc.subtitle_entries(df, "body", "video_id").collect()] == [("v", "ab", 1.5, 0.7)]


def test_translation(spark):
    q = spark.createDataFrame([(1, "fees")], "qid long, question string")
    parts = spark.createDataFrame([(1, 2, "How fees", "c2"), (1, 0, "What is fees", "c0"), (1, 1, "Why fees", None)], "qid long, list_no int, query string, text string")
    answer = translation.decompose(parts, translation.rule_model).first().answer
    assert answer.startswith("synthesis: Question: What is fees\nAnswer: answer: What is fees | c0 | ") and "How fees | c2 | Question: What is fees" in answer
    hist = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "z")], "c long, t int, x string")
    assert {(r.c, r.t): r.history for r in translation.with_history(hist, "c", "t", "x").collect()} == {(1, 1): "", (1, 2): "a", (2, 1): ""}
    routed = translation.routed(q.withColumn("label", F.lit("document request")), "label").withColumn("context", F.lit("ctx")).withColumn("history", F.lit("old"))
    assert translation.answered(routed, translation.rule_model).first().answer == "final: ctx | old | fees"


def test_worker(spark):
    df = spark.createDataFrame([(1, "One. Two.", 4), (2, "", 5), (3, None, None)], "request_id long, text string, chunk_size int")
    assert {r.request_id: r.status_code for r in worker.status(df).collect()} == {1: 200, 2: 400, 3: 400}
    assert {r.request_id: r.chunk_count for r in worker.processed(df, "request_id").collect()} == {1: 2, 2: 0, 3: 0}


def test_worker_components(spark):
    """Each message is reduced for itself, to the components it asks for."""
    five = "One. Two. Three. Four. Five."
    rows = [(1, five, 5, 2), (2, five, 5, None), (3, five, 5, 0), (4, five, 5, 64), (5, "One.", 5, 128), (6, "", 5, 2)]
    df = spark.createDataFrame(rows, "request_id long, text string, chunk_size int, pca_components int")
    got = {r.request_id: (r.status_code, r.chunk_count, r.embedding_dimensions) for r in worker.processed(df, "request_id").collect()}
    assert got == {1: (200, 5, 2), 2: (200, 5, 5), 3: (200, 5, 5), 4: (200, 5, 5), 5: (200, 1, 1), 6: (400, 0, 0)}


def test_worker_responses(spark):
    """400 without text, 500 where the vectors of a message differ in length, and else the chunks with their vectors."""
    rows = [(1, "One. Two.", 4), (2, None, 4), (3, "One. Threee.", 4), (4, " ", 4)]
    df = spark.createDataFrame(rows, "request_id long, text string, chunk_size int")
    uneven = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: i.cast("double"))
    got = {r.request_id: json.loads(r.response) for r in worker.responses(df, "request_id", embed=uneven).collect()}
    assert {k: v["statusCode"] for k, v in got.items()} == {1: 200, 2: 400, 3: 500, 4: 200}
    body = json.loads(got[1]["body"])
    assert body["chunks"] == ["One.", "Two."] and body["chunk_count"] == 2 and len(body["embeddings"]) == 2 and body["embedding_dimensions"] == 2
    assert json.loads(got[2]["body"]) == {"error": "No text provided"} and "error" in json.loads(got[3]["body"])
    assert json.loads(got[4]["body"]) == {"chunks": [], "embeddings": [], "chunk_count": 0, "embedding_dimensions": 0}


def test_pca_by(spark):
    """A group's reduction is that of the group alone."""
    draw = np.random.default_rng(3)
    rows = [(g, i, 2 + g, [float(x) for x in draw.normal(size=4) * [8, 4, 2, 1]]) for g in range(2) for i in range(6)]
    df = spark.createDataFrame(rows, "g int, i int, k int, v array<double>")
    got = {(r.g, r.i): r.reduced for r in embedding.pca_by(df, "v", "k", "g", "i").collect()}
    for g in range(2):
        alone = {r.i: r.reduced for r in embedding.pca(df.where(F.col("g") == g), "v", 2 + g, "i").collect()}
        assert all(got[g, i] == pytest.approx(alone[i], abs=1e-6) and len(alone[i]) == 2 + g for i in range(6))


def test_url_component(spark, tmp_path):
    """Every title is encoded as a browser does it."""
    titles = ["Plain title 1.2_3-4", "Reporter's Privilege (in brief)!", "Añadir & más: 100 %", 'He said "no"', "a*b~c/d?e=f#g+h", "北京 🙂", "", None]
    spark.createDataFrame(list(enumerate(titles)), "doc_id long, title string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.query for r in relational.url_params(spark, str(tmp_path)).collect()}
    assert got == {i: quote(t, safe="-_.!~*'()") for i, t in enumerate(titles) if t is not None}


def test_ingest(spark):
    urls = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "url string")
    known = spark.createDataFrame([("u1", "t1"), ("u2", "t2")], "url string, title string")
    titles = spark.createDataFrame([("t1",)], "title string")
    assert sorted(r.url for r in ingest.not_loaded(urls, known, titles).collect()) == ["u2", "u3"]
    status = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "url string, ok boolean")
    assert tuple(ingest.progress(status).first()) == (1, 3, 2, 33)
    assert tuple(ingest.progress(status.limit(0)).first()) == (0, 0, 0, 0)


def test_queue(spark):
    rows = [("a", 1, "x"), ("b", 3, "x"), ("c", 1, ""), ("d", 1, "y" * 300_000), ("e", 1, None)]
    df = spark.createDataFrame(rows, "request_id string, receive_count int, text string")
    assert {r[0]: r[1] for r in df.select("request_id", queue.outcome()).collect()} == {"a": "accepted", "b": "dead_letter", "c": "rejected", "d": "too_large", "e": "rejected"}
    t = [(0, "c"), (0, "c"), (50_000, "c"), (60_000, "c"), (70_000, "c"), (80_000, "c"), (90_000, "c"), (95_000, "c"), (5_000_000, "c")]
    req = spark.createDataFrame(t, "us long, client string").select(F.timestamp_micros("us").alias("time"), "client")
    out = queue.rate_limited(req, "client", "time", rate=10, burst=5).orderBy("time").collect()
    assert [r.allowed for r in out][-1] and sum(r.allowed for r in out) == 7


def test_stream_equals_batch(spark, data, tmp_path):
    """Closed chunks of the stream are the batch's chunks but each video's last."""
    from larkspur.operators.chunking import anchored_chunks

    path = f"{data}/transcript.parquet"
    batch = anchored_chunks(spark.read.parquet(path).select("video_id", "entry_id", "start", "text").distinct(), "video_id", "start", "text", "entry_id")
    got = run_to_end(chunks.anchored_stream(stream_of(spark, path)))
    closed = {tuple(r) for r in batch.where("end_seconds is not null").collect()}
    assert {tuple(r) for r in got.collect()} == closed and closed


def test_stream_over_batches(spark, tmp_path):
    """The state goes over batches; late and repeated entries of an open chunk count once, in their place."""
    rows = [[(1, 0.0, "a"), (2, 30.0, "b")], [(4, 70.0, "d"), (1, 0.0, "a")], [(3, 50.0, "c"), (5, 140.0, "e")], [(6, 10.0, "late"), (7, 300.0, "f")]]
    for i, part in enumerate(rows):
        df = spark.createDataFrame([("v", n, t, x) for n, t, x in part], "video_id string, entry_id long, start double, text string")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stream_of(spark, str(tmp_path / "in"), 1)
    got = run_to_end(chunks.anchored_stream(stream, lateness=60.0)).orderBy("start_seconds").collect()
    assert [tuple(r) for r in got] == [("v", 0.0, 70.0, "a b c"), ("v", 70.0, 140.0, "d"), ("v", 140.0, 300.0, "e")][: len(got)] and len(got) >= 2


def test_load_batches(spark, tmp_path):
    target = str(tmp_path / "store")
    write = chunks.load_batches(target, "k")
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "k string, n int")
    for batch in (df, df, spark.createDataFrame([("c", 3), ("b", 2)], df.schema)):
        write(batch, 0)
    assert sorted(r.k for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]
    (tmp_path / "store" / "part=0").mkdir(exist_ok=True)
    for path in (tmp_path / "store").glob("part=*/*.parquet"):
        path.write_bytes(b"broken")
    with pytest.raises(Exception):  # noqa: B017 - a store that can't be read isn't an empty one
        write(df, 1)


def test_load_of_many_batches(spark, tmp_path):
    """A part gets one file a batch, keys of any earlier batch are known, as are those that others have stored since, and after a restart."""
    target = str(tmp_path / "store")
    write = chunks.load_batches(target, "k", 2)
    for b in range(10):
        write(spark.range(100 * b, 100 * b + 150).selectExpr("cast(id as string) as k", f"{b} as n").repartition(8), b)
    assert len(list((tmp_path / "store").glob("part=*/*.parquet"))) <= 20
    rows = spark.read.parquet(target)
    assert sorted(int(r.k) for r in rows.collect()) == list(range(1050)) and rows.where("n != least(9, int(k) div 100) and n != int(k) div 100 - 1").isEmpty()
    chunks.load_batches(target, "k", 2)(spark.createDataFrame([("5", 1), ("other", 1)], "k string, n int"), 0)
    write(spark.createDataFrame([("other", 2), ("own", 2)], "k string, n int"), 10)
    assert spark.read.parquet(target).where("k in ('5', 'other', 'own')").count() == 3 and spark.read.parquet(target).count() == 1052


def test_stream_dead_letters(spark, data, tmp_path):
    good, dead = str(tmp_path / "good"), str(tmp_path / "dead")
    run_to_end(stream_of(spark, f"{data}/process_request.parquet"), each=queue.dead_letter_batches(good, dead))
    n = spark.read.parquet(f"{data}/process_request.parquet").count()
    assert spark.read.parquet(good).count() + spark.read.parquet(dead).count() == n


def test_progress_listener():
    p = chunks.Progress(10)
    assert p.row() == {"current": 0, "total": 10, "status": "initializing", "is_loading": True}
    p.onQueryTerminated(type("E", (), {"exception": None}))
    assert p.row()["status"] == "complete" and not p.row()["is_loading"]


def test_events(spark):
    df = spark.createDataFrame([(1, 4, "Hel"), (1, 7, "lo"), (1, 7, "lo"), (1, 9, None)], "qid long, `order` long, message string")
    assert events.folded(df).first().text == "Hello"
    assert tuple(events.error_events(df.select("qid").distinct()).first()) == (1, 1, 'data: {"message":"An error occurred while processing your query.","order":1}\n\n')


def test_sources(spark, tmp_path):
    (tmp_path / "a_b  c.pdf").write_bytes(b"page one\fpage two")
    (tmp_path / "x.txt").write_text("no")
    pages = files.pdf_pages(files.pdf_files(spark, str(tmp_path))).orderBy("page").collect()
    assert [(r.title, r.page, r.page_content) for r in pages] == [("a b c", 0.0, "page one"), ("a b c", 1.0, "page two")]
    assert files.pdf_pages(files.pdf_files(spark, str(tmp_path)), lambda b: 1 / 0).count() == 0
    (tmp_path / "urls.txt").write_text(" http://a \n\n  \nnope\n")
    assert [r.url for r in files.url_list(spark, str(tmp_path / "urls.txt")).collect()] == ["http://a", "nope"]
    tried = spark.createDataFrame([("http://a", True), ("nope", False)], "url string, ok boolean")
    files.split_outcome(tried, str(tmp_path / "done"), str(tmp_path / "wait"))
    assert spark.read.text(str(tmp_path / "wait")).first()[0] == "nope"
    paths = spark.createDataFrame([("docs/by_audience/journalist/x.txt",)], "path string")
    assert files.facets_of_path(paths, "path").first().audience == "journalist"


def test_transcript_source(spark, tmp_path):
    for method, name in (("transcript_api", "v1.en~auto.json3"), ("transcript_api", "v1.fr.json3"), ("subtitle_json3", "v1.en.json3")):
        (tmp_path / method).mkdir(exist_ok=True)
        (tmp_path / method / name).write_text('{"events":[]}')
    got = transcripts.preferred(transcripts.tracks(spark, str(tmp_path)))
    assert {(r.method, r.language) for r in got.collect()} == {("transcript_api", "en"), ("subtitle_json3", "en")}
    best = ingest.first_source(got.withColumn("p", transcripts.method_rank()), "video_id", "p").collect()
    assert [r.method for r in best] == ["transcript_api"]
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "ok"

    assert transcripts.with_retries(flaky, wait=lambda s: None) == "ok"


def test_hash_embedder(spark):
    out = spark.createDataFrame([("a b",), (None,), ("",)], "t string").select(embedding.hash_embedder(8)("t").alias("v")).collect()
    assert abs(np.linalg.norm(out[0].v) - 1) < 1e-6 and not any(out[1].v) and not any(out[2].v)
    assert isinstance(translation.rule_model(pd.Series(["clean|x"])).iloc[0], str)


def test_ask(spark):
    from larkspur.operators import asking

    chunks = spark.createDataFrame([(1, "fees for public records", "Fees", "pdf", "s1", 0.0, None), (2, "court access rules", "Court", "youtube", "s2", 12.5, "sum"), (3, None, "None", "pdf", "s3", 0.0, None)], "id long, page_content string, title string, type string, source string, page double, summary string")
    questions = spark.createDataFrame([(1, "fees for records", "document request ragfusion"), (2, "court access", "document request"), (3, "hello", "chat"), (4, None, None), (5, "fees", "document request decompose"), (6, "court", "document request stepback"), (7, "court", "document request hyde"), (5_000_000_000_000_000_000, "fees", "document request")], "qid long, question string, label string")
    got = {r.qid: r.answer for r in asking.ask(questions, chunks, "id", translation.rule_model, embedding.hash_embedder(), 1).collect()}
    fees = "content: fees for public records\ntitle: Fees\ntype: pdf\nlink: s1\ntimestamp_seconds: None\nsummary: None"
    assert got[1].startswith(f"final: {fees}") and got[1].endswith(" | fees for records")
    assert "link: s2&t=12.5s\ntimestamp_seconds: 12.5\nsummary: sum" in got[2] and got[3] == "general: hello" and 4 in got
    assert got[5].startswith("final: synthesis: Question: What is fees\nAnswer: answer: What is fees | content: ") and got[5].count("\n---\nQuestion: ") >= 2
    assert got[6].startswith("final: stepback: content: court access rules") and got[7].startswith("final: hyde: content: court access rules")
    assert 5_000_000_000_000_000_000 in got and "Fees" in got[5_000_000_000_000_000_000]
    empty = {r.qid: r.answer for r in asking.ask(questions, chunks.limit(0), "id", translation.rule_model, embedding.hash_embedder()).collect()}
    assert empty[2].startswith("final: No documents available | ") and empty[1].startswith("final: content: No relevant documents found.\ntitle: Unknown Source\ntype: unknown\nlink: \ntimestamp_seconds: None\nsummary: None | ")
    hist = spark.createDataFrame([(1, "earlier")], "qid long, history string")
    assert {r.qid: r.standalone for r in asking.contextualised(questions.where("qid < 3"), hist, translation.rule_model).collect()} == {1: "earlier fees for records", 2: "court access"}
    said = {r.qid: r.answer for r in asking.ask(questions.where("qid < 4"), chunks, "id", translation.rule_model, embedding.hash_embedder(), 1, history=hist).collect()}
    assert said[1].endswith(" | earlier | fees for records") and said[3] == "general: hello"


def test_ask_in_bounded_batches(spark):
    """Rows with long texts come to the model in batches of some MB, however many there are."""
    from larkspur.operators import asking

    n = 120
    questions = spark.range(n).select(F.col("id").alias("qid"), F.lit("q").alias("question"), F.lit("chat").alias("label"))
    history = questions.select("qid", F.repeat(F.lit("x"), 1 << 20).alias("history"))
    chunks = spark.createDataFrame([], "id long, page_content string, title string, type string, source string, page double, summary string")
    out = asking.ask(questions, chunks, "id", lambda prompts: prompts.map(lambda _: str(prompts.str.len().sum())), embedding.hash_embedder(), history=history).collect()
    assert len(out) == n and max(int(r.answer) for r in out) <= asking.BATCH_BYTES + (2 << 20)


def test_top_k_of_many_queries():
    """All scores of 20,000 queries with a block of rows would take 655 MB."""
    import tracemalloc

    rng = np.random.default_rng(7)
    given, rows = rng.integers(0, 9, (20_000, 4)).astype(float), rng.integers(0, 9, (5_000, 4)).astype(float)
    ids = rng.permutation(5_000)
    best = retrieval._Best({4: (np.arange(20_000), given)}, 3)
    tracemalloc.start()
    best.add(ids, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    q, i, _ = best.held[4]
    assert peak < 100 << 20 and len(q) == 60_000
    for x in range(0, 20_000, 997):
        order = np.lexsort((ids, -(rows @ given[x])))[:3]
        assert sorted(i[q == x]) == sorted(ids[order])


def test_fan_out_takes_all_lines(spark):
    questions = spark.createDataFrame([(1, "q")], "qid long, question string")
    many = translation.fan_out(questions, lambda s: s.map(lambda _: "\n".join("abcdefg") + "\n"), "multi")
    assert [r.query for r in many.orderBy("list_no").collect()] == [*"abcdefg", ""]
    assert translation.fan_out(questions, lambda s: s.map(lambda _: "\n a\nb \n"), "parts", strip=True).count() == 2


def test_deliveries(spark, tmp_path):
    """Messages are hidden after a delivery, delivered three times at most, and ended by a delete; the counts stay over batches."""
    batches = [
        [("a", "send", 0), ("a", "receive", 1), ("a", "receive", 10), ("b", "send", 0)],
        [("a", "receive", 400), ("a", "receive", 800), ("b", "receive", 5)],
        [("a", "receive", 1200), ("a", "receive", 1600), ("b", "delete", 6), ("b", "receive", 700)],
    ]
    for rows in batches:
        df = spark.createDataFrame(rows, "message_id string, kind string, t long").select("message_id", "kind", F.timestamp_seconds("t").alias("at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = run_to_end(queue.deliveries(stream_of(spark, str(tmp_path / "in"), 1))).orderBy("at").collect()
    assert [(r.happened, r.receives) for r in got if r.message_id == "a"] == [("sent", 0), ("delivered", 1), ("hidden", 1), ("delivered", 2), ("delivered", 3), ("dead_letter", 3), ("ignored", 3)]
    assert [r.happened for r in got if r.message_id == "b"] == ["sent", "delivered", "deleted", "ignored"]


def test_deleted_is_not_delivered_again(spark, tmp_path):
    rows = [("b", "send", 0), ("b", "receive", 5), ("b", "delete", 6), ("b", "receive", 700), ("c", "receive", 1)]
    df = spark.createDataFrame(rows, "message_id string, kind string, t long").select("message_id", "kind", F.timestamp_seconds("t").alias("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = run_to_end(queue.deliveries(stream_of(spark, str(tmp_path / "in")))).orderBy("message_id", "at").collect()
    assert [(r.message_id, r.happened) for r in got] == [("b", "sent"), ("b", "delivered"), ("b", "deleted"), ("b", "ignored"), ("c", "ignored")]


def test_batch_run_again(spark, tmp_path):
    good, dead = str(tmp_path / "good"), str(tmp_path / "dead")
    write = queue.dead_letter_batches(good, dead)
    df = spark.createDataFrame([(1, 1, "x"), (2, 3, "x")], "request_id long, receive_count int, text string")
    for number in (0, 0, 1):
        write(df, number)
    assert spark.read.parquet(good).count() == 2 and spark.read.parquet(dead).count() == 2


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    for rows in ([("a", 1), ("a", 2), ("b", 1)], [("a", 3), ("c", 1)]):
        files.upsert(spark.createDataFrame(rows, "title string, n int"), path, "title")
    assert sorted((r.title, r.n) for r in spark.read.parquet(path).collect()) == [("a", 3), ("b", 1), ("c", 1)]


def test_pdf_path(spark, tmp_path):
    (tmp_path / "One.pdf").write_bytes(("word " * 2000 + "\f" + "short").encode())
    read_files = files.pdf_files(spark, str(tmp_path))
    parts = files.pdf_chunks(read_files).collect()
    assert all(len(r.chunk) <= 512 for r in parts) and {r.page for r in parts} == {0.0, 1.0} and len({(r.page, r.part_no) for r in parts}) == 4
    assert files.pdf_errors(read_files, lambda b: 1 / 0).first().error == "division by zero" and files.pdf_errors(read_files).count() == 0


def test_metadata_documents(spark):
    clips = spark.createDataFrame([("c1", "u1", None, 7.0, "old", 1, "x", "x", "", 1, ["t"], ["k"], "en")], "chunk_id string, source string, page double, start_seconds double, title string, duration long, uploader string, channel string, upload_date string, view_count long, tags array<string>, categories array<string>, language string")
    meta = spark.createDataFrame([("u1", "T1", "d", 5, None, "ch", None, None, None, None, "fr"), ("u2", None, None, None, "up", None, None, None, None, None, None)], "url string, title string, description string, duration long, uploader string, channel string, upload_date string, view_count long, tags array<string>, categories array<string>, language string")
    got = {r.source: r for r in ingest.with_metadata_documents(clips, meta, "url").collect()}
    one, two = got["u1"], got["u2"]
    assert (one.title, one.duration, one.uploader, one.language, one.page, one.tags) == ("T1", 5, "", "fr", 7.0, []) and one.page_content is None
    assert two.page_content == "YouTube video: Title not found\nURL: u2\nChannel: up\nNote: No transcript available for this video." and two.transcript_available is False and two.page == 0


def test_file_queue(spark, tmp_path):
    q = queue.FileQueue(spark, str(tmp_path / "q"))
    q.create()
    assert q.attributes() == {"ApproximateNumberOfMessages": 0}
    q.send(spark.createDataFrame([(1, "in", "x", 5), (2, "in", "y" * 300_000, 5)], "request_id long, queue_name string, text string, chunk_size int"))
    assert q.attributes() == {"ApproximateNumberOfMessages": 1}
    assert [r.request_id for r in run_to_end(q.receive(archive=str(tmp_path / "a"))).collect()] == [1]
    q.delete()
    assert not (tmp_path / "q").exists()


def test_numbered_stream(spark, tmp_path):
    for rows in ([("x", 2, "b"), ("x", 1, "a"), ("y", 1, "c")], [("x", 3, "d"), ("y", 2, "e")]):
        spark.createDataFrame(rows, "qid string, t long, message string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = run_to_end(events.numbered_stream(stream_of(spark, str(tmp_path / "in"), 1), "qid", "t"))
    assert sorted((r.qid, r.order, r.message) for r in got.collect()) == [("x", 0, "a"), ("x", 1, "b"), ("x", 2, "d"), ("y", 0, "c"), ("y", 1, "e")]


def test_placeholder_and_two_levels(spark):
    from larkspur.operators import chunking

    df = spark.createDataFrame([(1, "same"), (2, "same"), (3, None), (4, "x y. " * 3000)], "id long, t string")
    got = {r.id: r.v for r in df.select("id", embedding.placeholder_embedding(F.col("t"), 5).alias("v")).collect()}
    assert got[1] == got[2] and len(set(got[1])) == 1 and 0 <= got[1][0] < 1000 and got[3] is None
    parts = chunking.two_level_chunks(df, "t", "id").where("id = 4").collect()
    assert all(len(r.chunk) <= 512 for r in parts) and len({r.part_no for r in parts}) == 4 and len({(r.part_no, r.chunk_no) for r in parts}) == len(parts)
