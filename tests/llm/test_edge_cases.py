"""Every pN_ query on empty tables, on nulls everywhere, on repeated rows and on extra columns with clashing names."""

import datetime as dt

import pytest

from larkspur.llm import queries as llm

TS = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMAS = {
    "transcript": "entry_id long, video_id string, text string, start double, duration double, ingested_at timestamp",
    "chunks": "chunk_id string, page_content string, title string, type string, source string, source_method string, page double, start_seconds double, end_seconds double, language string, ingested_at timestamp",
    "search_results": "result_id long, qid long, event_no long, rank_no int, client string, title string, link string, type string, timestamp_seconds long, summary string, emitted_at timestamp",
    "process_request": "request_id long, queue_name string, text string, chunk_size int, pca_components int, receive_count int, sent_at timestamp",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, title string, page_url string, published_at timestamp, fetched_at timestamp",
    "speakers": "speaker_key string, full_name string, affiliation string",
    "split_limits": "item_table string, size_limit int, overlap int",
    "pack_sizes": "container_kind string, capacity_tokens int",
    "mix_targets": "source string, target_share double, max_repeats int",
}
LONG = "The panel on open meetings drew 52 people from Arbelport. " * 4000
ROWS = {
    "transcript": [(1, "v", "Ann Lee: hello uh there.", 0.0, 1.0, TS), (2, "v", None, 1.0, None, TS), (3, "v", "", 1.0, 1.0, None), (4, "v", "BO TALL: " + LONG, 1.0, 1.0, TS), (5, None, "Bo Tall: x", 2.0, 1.0, TS), (6, "v", "Bo Tall: x", None, 1.0, TS), (7, "v", "Bo Tall: y", float("nan"), 1.0, TS)],
    "chunks": [("a", LONG, "T", "pdf", "s", "pdf_loader", 0.0, None, None, "en", TS), ("b", LONG + "More words here now", "T", "pdf", "s", "pdf_loader", 1.0, 3.0, None, "xx", TS), ("c", None, None, "pdf", None, None, None, None, None, None, None), ("d", "", None, None, None, None, None, None, None, "", TS), ("e", "one two", "T", "pdf", "s", "m", 0.0, 0.0, 0.0, "es", TS), ("f", "\n \n", "T", "pdf", "s", "m", 0.0, 0.0, 0.0, "es", TS)],
    "search_results": [(1, 1, 1, 0, "c", "t", "l", "pdf", None, "The panel drew 52 peop", TS), (2, 1, 1, 1, None, None, None, None, None, None, None), (3, 1, 1, 2, "c", "t", "l", "pdf", 1, "", TS)],
    "process_request": [(1, "q", LONG, 50, 1, 1, TS), (2, "q", "x" * 3000, None, 1, 1, TS), (3, "q", None, 0, 1, 1, None), (4, "q", "", -1, None, None, TS), (5, None, "é" * 1001, 0, 1, 1, TS)],
    "documents": [(1, LONG, "en", "s", 1, "t", "u", TS, TS), (2, None, None, None, None, None, None, None, None), (3, "", "en", "s", 0, "t", "u", TS, TS), (4, "aÃ±o y aÃ±o", "es", "s", 9, "t", "u", TS, TS), (5, "El año pasado", None, "r", 9, "t", "u", TS, TS), (6, "bad �", "es", "r", 9, "t", "u", TS, TS), (7, "El año pasado", None, "s", 9, "t", "u", TS, TS)],
    "speakers": [("s1", "Ann Lee", None), ("s2", "Bo Tall", "x"), ("s3", None, None), ("s4", "Single", None)],
    "split_limits": [("chunks", 512, 32), ("process_request", 1000, 100)],
    "pack_sizes": [("small", 64), ("none", None), ("zero", 0), ("big", 4096)],
    "mix_targets": [("s", 0.7, 1), ("r", 0.3, None), ("gone", 0.0, 2)],
}
KEYS = {"transcript": "entry_id", "chunks": "chunk_id", "search_results": "result_id", "process_request": "request_id", "documents": "doc_id", "speakers": "speaker_key", "split_limits": "item_table", "pack_sizes": "container_kind", "mix_targets": "source"}
EXTRA = ["key", "ord", "rid", "n", "tokens", "_row", "win", "pos", "label", "grp", "form", "kind", "word", "words", "found", "h", "range", "table_name", "record_key", "origin", "piece", "size", "a", "b"]


def put(spark, folder, change=lambda name, rows: rows, extra=()):
    for name, schema in SCHEMAS.items():
        df = spark.createDataFrame(change(name, ROWS[name]), schema)
        for column in extra:
            if column not in df.columns:
                df = df.selectExpr("*", f"'clash' as `{column}`")
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def all_rows(spark, folder):
    return {name: sorted(map(repr, query(spark, folder).collect())) for name, query in llm.queries().items()}


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory):
    return all_rows(spark, put(spark, tmp_path_factory.mktemp("plain")))


def test_empty_tables(spark, tmp_path):
    got = all_rows(spark, put(spark, tmp_path, lambda name, rows: []))
    assert not any(got.values())


def test_nulls_everywhere(spark, tmp_path):
    def change(name, rows):
        return [*rows, (None,) * len(rows[0])]

    all_rows(spark, put(spark, tmp_path, change))


def test_only_keys(spark, tmp_path):
    all_rows(spark, put(spark, tmp_path, lambda name, rows: [(r[0], *(None,) * (len(r) - 1)) for r in rows]))


def test_plain(plain):
    assert [r for r in plain["p5_found"]] == ["Row(video_id='v', entry_id=1, speaker_key='s1')", "Row(video_id='v', entry_id=4, speaker_key='s2')"]
    assert plain["p2_found"] == sorted(f"Row(table_name='{t}', record_key='{k}')" for t, k in (("chunks", "a"), ("chunks", "b"), ("process_request", "1"), ("process_request", "2"), ("process_request", "5")))
    assert plain["p4_found"] == ["Row(chunk_id_a='a', chunk_id_b='b')"]
    assert plain["p8_found"] == ["Row(doc_id=4)", "Row(doc_id=6)"]


def test_repeated_rows(spark, tmp_path, plain):
    """A key counts once; documents have unique ids, so they aren't repeated."""
    def change(name, rows):
        return rows if name == "documents" else rows * 3

    got = all_rows(spark, put(spark, tmp_path, change))
    for name in plain:
        assert got[name] == plain[name], name


def test_clashing_columns(spark, tmp_path, plain):
    assert all_rows(spark, put(spark, tmp_path, extra=EXTRA)) == plain
