"""Splitting oversized items at natural boundaries, by agglomerative merging.

An item starts as atomic segments; all pairs of neighbours wait in a heap, weakest boundary first (then the smallest
pair, then the first one), and are merged while their size plus the overlap fits the limit. Boundaries, from weakest:
between characters, words, clauses, sentences, lines, paragraphs. A sentence or line that fits is an atom at once:
its inner boundaries are weaker than those around it, so merging would put it together first, whatever else happens.

Sizes are in code points. Each piece but the first begins with the last `overlap` code points of the piece before,
and no piece exceeds the limit; without their overlaps the pieces are the item, character for character. No cut
falls before a combining mark or a joiner, but where a run of them is longer than a piece.

Defined results: null or empty texts and items within the limit are not split and give no row; a limit that is null or
below 1 is replaced by the table's default; where the limit is at most twice the overlap, the overlap is cut to half
the limit. A key that occurs again counts once, with its latest row. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.tables import latest

CHARACTER, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)
_BREAK = re.compile(r"\s*\n[^\S\n]*\n\s*|[^\S\n]*\n[^\S\n]*|[.!?…]+[\"”’»')\]]*\s+|[。！？]|[,;:—–][\"”’»')\]]*\s+|[、，；]|\s+")


def strength(found: str, before: str, after: str) -> int:
    """A single line break inside a sentence is no stronger than a clause, and before a small letter than a word."""
    if "\n" in found:
        if found.count("\n") > 1:
            return PARAGRAPH
        if before in ".!?…:;\"”»)" or not after.isalpha():
            return LINE
        return WORD if after.islower() else CLAUSE
    if found[0] in ".!?…。！？":
        return SENTENCE
    return CLAUSE if found[0] in ",;:—–、，；" else WORD


def boundaries(text: str) -> list[tuple[int, int]]:
    """(position after the break, strength) of all natural boundaries inside the text."""
    return [(m.end(), strength(m[0], text[m.start() - 1 : m.start()], text[m.end()])) for m in _BREAK.finditer(text) if m.end() < len(text)]


def _bound(char: str) -> bool:
    return unicodedata.combining(char) != 0 or char in "‍️" or "\U0001f3fb" <= char <= "\U0001f3ff"


def atoms(text: str, size: int) -> list[tuple[int, int]]:
    """(end, strength of the boundary there) of segments of at most `size` characters, each as coarse as fits."""
    marks = boundaries(text)
    out: list[tuple[int, int]] = []

    def cut(begin: int, end: int, edge: int, inner: list[tuple[int, int]], level: int) -> None:
        if end - begin <= size:
            out.append((end, edge))
            return
        if level == CHARACTER:
            at = begin
            while end - at > size:
                stop = at + size
                while stop > at + 1 and (_bound(text[stop]) or text[stop - 1] == "‍"):
                    stop -= 1
                if stop == at + 1 and size > 1:
                    stop = at + size
                out.append((stop, CHARACTER))
                at = stop
            out.append((end, edge))
            return
        at, i = begin, 0
        for j, (pos, s) in enumerate([*inner, (end, PARAGRAPH + 1)]):
            if s >= level:
                cut(at, pos, edge if pos == end else s, inner[i:j], level - 1)
                at, i = pos, j + 1

    cut(0, len(text), PARAGRAPH + 1, marks, PARAGRAPH)
    return out


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(begin, end) of each piece; begins lie `overlap` before the end of the piece before."""
    if len(text) <= limit:
        return [(0, len(text))]
    if limit <= 2 * overlap:
        overlap = limit // 2
    room = limit - overlap
    segs = atoms(text, room)
    n = len(segs)
    begin = [0, *[e for e, _ in segs[:-1]]]
    end = [e for e, _ in segs]
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(segs[i][1], end[i + 1] - begin[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        edge, length, i, j = heapq.heappop(heap)
        if not alive[i] or not alive[j] or after[i] != j or end[j] - begin[i] != length:
            continue  # one of the two has been merged since
        if length > (limit if begin[i] == 0 else room):
            continue
        end[i], after[i], alive[j] = end[j], after[j], False
        segs[i] = segs[j]
        if after[i] < n:
            before[after[i]] = i
            heapq.heappush(heap, (segs[i][1], end[after[i]] - begin[i], i, after[i]))
        if before[i] >= 0:
            p = before[i]
            heapq.heappush(heap, (segs[p][1], end[i] - begin[p], p, i))
    return [(max(0, begin[i] - overlap), end[i]) for i in range(n) if alive[i]]


def items(chunks: DataFrame, requests: DataFrame, limits: DataFrame) -> DataFrame:
    """(table_name, record_key, text, start_seconds, size_limit, overlap): one row per item of both tables longer than its limit."""
    a = latest(chunks, "chunk_id", ["ingested_at"], ["page_content", "start_seconds"])
    a = a.select(F.lit("chunks").alias("table_name"), F.col("chunk_id").alias("record_key"), F.col("page_content").alias("text"), "start_seconds", F.lit(None).cast("int").alias("own"))
    b = latest(requests, "request_id", ["receive_count", "sent_at"], ["text", "chunk_size"])
    b = b.select(F.lit("process_request").alias("table_name"), F.col("request_id").cast("string").alias("record_key"), "text", F.lit(None).cast("double").alias("start_seconds"), F.col("chunk_size").alias("own"))
    by_table = limits.groupBy(F.col("item_table").alias("table_name")).agg(F.max("size_limit").alias("size_limit"), F.max("overlap").alias("overlap"))  # one row per table
    both = a.union(b).join(F.broadcast(by_table.where("table_name in ('chunks', 'process_request')")), "table_name")
    limit = F.when(F.col("own") >= 1, F.col("own")).otherwise(F.col("size_limit"))
    return both.select("table_name", "record_key", "text", "start_seconds", limit.alias("size_limit"), F.coalesce("overlap", F.lit(0)).alias("overlap")).where(F.length("text") > F.col("size_limit"))


def pieces(chunks: DataFrame, requests: DataFrame, limits: DataFrame) -> DataFrame:
    """(table_name, record_key, piece_no, begin, end, text, start_seconds): ordered pieces of each oversized item, numbered from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, no, begins, ends, texts = [], [], [], [], []
            for i, (text, limit, overlap) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 4, 5)), strict=True)):
                for k, (begin, end) in enumerate(split(text, limit, overlap)):
                    at.append(i)
                    no.append(k)
                    begins.append(begin)
                    ends.append(end)
                    texts.append(text[begin:end])
            part = batch.select(["table_name", "record_key", "start_seconds"]).take(pa.array(at, pa.int64()))
            yield pa.record_batch(
                [part.column(0), part.column(1), pa.array(no, pa.int32()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64()), pa.array(texts, pa.string()), part.column(2)],
                names=["table_name", "record_key", "piece_no", "begin", "end", "text", "start_seconds"],
            )

    schema = "table_name string, record_key string, piece_no int, begin long, end long, text string, start_seconds double"
    return items(chunks, requests, limits).mapInArrow(run, schema)
