"""Chunkers against plain restatements of their rules."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.operators import chunking


def test_fixed(spark):
    texts = ["", None, "a" * 10, "a" * 11, "é" * 25, "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {}
    for r in chunking.fixed_chunks(df, "t", 10, "id").orderBy("id", "chunk_no").collect():
        got.setdefault(r["id"], []).append(r["chunk"])
    assert got == {i: [t[k : k + 10] for k in range(0, len(t), 10)] for i, t in enumerate(texts) if t}


def packed(text, n):
    import re

    out, cur = [], None
    for s in (x.strip(" \n\r\t") for x in re.findall(r"[^.!?]+[.!?]*", text)):
        if not s:
            continue
        if cur is not None and len(cur) + len(s) <= n:
            cur += " " + s
        else:
            if cur is not None:
                out.append(cur)
            cur = s
    return out + ([cur] if cur is not None else [])


def test_sentences(spark):
    rng = random.Random(1)
    texts = ["", None, "No end", "One. Two! Three?", "A" * 50 + ". B.", "aaaa. bbbb.", "...", "Hi.\nThere."]
    texts += ["".join(rng.choice("ab .!?\n") for _ in range(rng.randrange(80))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {}
    for r in chunking.sentence_chunks(df, "t", 9, "id").orderBy("id", "chunk_no").collect():
        got.setdefault(r["id"], []).append(r["chunk"])
    assert got == {i: packed(t, 9) for i, t in enumerate(texts) if t and packed(t, 9)}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_recursive(text, size, overlap):
    chunks = chunking.recursive_split(text, size, overlap)
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    # nothing but white space is lost
    assert set("".join(text.split())) == set("".join("".join(chunks).split()))
    if 0 < len(text.strip()) and len(text) < size:
        assert chunks == [text.strip()]


def test_recursive_cases():
    assert chunking.recursive_split("") == []
    assert chunking.recursive_split("w" * 1200, 512, 32)[0] == "w" * 512
    # parts keep their separator in front; up to `overlap` characters of the last parts begin the next chunk
    assert chunking.recursive_split("aaaa bbbb cccc", 10, 5) == ["aaaa bbbb", "bbbb cccc"]
    assert chunking.recursive_split("aaaa bbbb cccc", 9, 4) == ["aaaa bbbb", "cccc"]
    assert chunking.recursive_split("one\n\ntwo\n\nthree", 8, 0) == ["one\n\ntwo", "three"]


def anchored(starts, length):
    out, anchor, held = {}, 0.0, []
    for s in sorted(set(starts)):
        if s - anchor >= length and held:
            anchor, held = s, []
        held.append(s)
        out[s] = anchor
    return out


def test_anchored(spark):
    rng = random.Random(2)
    groups = {"late": [100.0, 101.0, 170.0], "one": [5.0], "exact": [0.0, 60.0, 120.0], "gap": [1.0, 500.0, 501.0], "v": [5.0, 61.0, 130.0]}
    for k in range(6):
        groups[f"r{k}"] = [round(rng.uniform(0, 20000), 1) for _ in range(400)]
    rows = [(g, s) for g, ss in groups.items() for s in ss] + [(None, 1.0), ("null", None), ("nan", float("nan"))]
    df = spark.createDataFrame(rows, "g string, s double")
    got = {}
    for r in chunking.anchored_starts(df, "g", "s", 60.0, window=700.0).collect():
        got.setdefault(r["g"], {})[r["s"]] = r["anchor"]
    assert got == {g: anchored(ss, 60.0) for g, ss in groups.items()}


def test_anchored_chunks(spark):
    df = spark.createDataFrame([("v1", 1, "hello", 5.0), ("v1", 2, "there", 61.0), ("v1", 3, "again", 130.0), ("v1", 4, None, 131.0)], "v string, e long, t string, s double")
    got = [tuple(r) for r in chunking.anchored_chunks(df, "v", "s", "t", "e").orderBy("start_seconds").collect()]
    assert got == [("v1", 0.0, 61.0, "hello"), ("v1", 61.0, 130.0, "there"), ("v1", 130.0, None, "again")]


def grid(rows, length):
    out, held, limit, begin = [], [], length, 0.0
    for s, d, t in sorted(rows):
        if s + d > limit:
            if held:
                out.append((begin, " ".join(held)))
                held = []
            begin = limit
            limit += length
        held.append(t)
    return out + ([(begin, " ".join(held))] if held else [])


def test_grid(spark):
    rng = random.Random(3)
    groups = {k: [(round(rng.uniform(0, 900), 1), round(rng.uniform(0, 9), 1), f"w{i}") for i in range(60)] for k in range(4)}
    groups[9] = [(10.0, 1.0, "a"), (59.0, 5.0, "straddles"), (400.0, 1.0, "late"), (401.0, 1.0, "later")]
    df = spark.createDataFrame([(g, s, d, t, t) for g, rows in groups.items() for s, d, t in rows], "g long, s double, d double, t string, o string")
    got = {}
    for r in chunking.grid_chunks(df, "g", "s", "d", "t", "o").orderBy("g", "chunk_no").collect():
        got.setdefault(r["g"], []).append((r["start_seconds"], r["text"]))
    assert got == {g: grid(rows, 60.0) for g, rows in groups.items()}


def test_empty(spark):
    df = spark.createDataFrame([], "g string, s double, d double, t string, o long")
    for out in (
        chunking.fixed_chunks(df, "t", 5, "g"), chunking.sentence_chunks(df, "t", 5, "g"), chunking.recursive_chunks(df, "t", "g"),
        chunking.anchored_chunks(df, "g", "s", "t", "o"), chunking.grid_chunks(df, "g", "s", "d", "t", "o"), chunking.tumbling_chunks(df, "g", "s", "t", "o"),
    ):
        assert out.count() == 0


def test_metadata_text(spark):
    from larkspur.functions.text import metadata_text

    df = spark.createDataFrame([("T", "u", "d" * 501, None, 125, [str(i) for i in range(12)]), (None, "u", None, "", None, [])], "a string, b string, c string, d string, e long, f array<string>")
    one, two = (r[0].split("\n") for r in df.select(metadata_text(*[F.col(x) for x in "abcdef"])).collect())
    last = "Note: No transcript available for this video."
    assert one == ["YouTube video: T", "URL: u", "Description: " + "d" * 500 + "...", "Duration: 2m 5s", "Tags: " + ", ".join(map(str, range(10))), last]
    assert two == ["YouTube video: Title not found", "URL: u", last]
