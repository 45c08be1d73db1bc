"""Garbled text from wrong character decodings, found and restored by a table of garbled forms.

A word here is a run of ASCII letters and non-ASCII characters with at least one of the latter; garbling never turns
such a character into an ASCII one, so a garbled word is a run, too. The distinct words of the corpus are counted, all
garbled forms of the clean ones are generated under every chain of encodings below, and the corpus words are joined with
the hashes of these forms and then checked. What is met is garbled; it is replaced by the commonest original. Forms that only swap one
single-byte encoding for another can be words of another language, so they must also be rarer than their original, or
mix two alphabets.

An exact check follows for words whose original occurs nowhere: a run that encodes and decodes back as UTF-8 is
garbled. Stretches that were UTF-8 read as UTF-16 have no words left; they are found by reading them back. A
replacement character is a case, restorable or not.

Defined results: null and empty texts aren't garbled; rows without doc_id are dropped; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.bits import bit_table, slots, unpacked
from larkspur.llm.scan_noise import hashed
from larkspur.session import materialize

WORD_BITS = 23
# The encodings of the chains.
READ_AS = ["cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "cp437", "cp850", "cp852", "cp866", "mac_roman", "iso8859-2", "iso8859-15", "koi8-r"]
WRITTEN_IN = list(dict.fromkeys(["cp1252", "cp1250", "mac_roman", "cp437", "cp850", *READ_AS]))
TWICE = ["cp1252", "latin-1", "mac_roman", "cp437", "cp1250", "cp1251"]

RUN = re.compile(r"[A-Za-z]*[^\x00-\x7f][A-Za-z\x80-\U0010ffff]*")
ENTITY = re.compile(r"&[A-Za-z]{2,8};")
FAR = re.compile(r"[ऀ-￿]{2,}")
REPLACED = "�"


@cache
def _characters(encoding: str) -> dict[int, str]:
    """What each byte is read as; undefined ones are the control characters of the same number."""
    return {i: bytes([i]).decode(encoding, "ignore") or chr(i) for i in range(256)}


@cache
def _bytes(encoding: str) -> dict[str, int]:
    defined = {c: i for i in range(256) if (c := bytes([i]).decode(encoding, "ignore"))}
    return {chr(i): i for i in range(0x80, 0xA0)} | defined


def read_as(raw: bytes, encoding: str) -> str:
    """Decode, with bytes the encoding leaves undefined read as the control characters of the same number."""
    return raw.decode("latin-1").translate(_characters(encoding))


def written_in(text: str, encoding: str) -> bytes | None:
    """The inverse of read_as; None if a character is in neither."""
    table = _bytes(encoding)
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


def reversed_once(word: str) -> tuple[str, str] | None:
    """(original, chain) if the word is UTF-8 read in a single-byte encoding."""
    for encoding in READ_AS:
        raw = written_in(word, encoding)
        if raw is None:
            continue
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if text != word and all(c.isprintable() or c in " ­" for c in text):
            return text, f"utf-8>{encoding}"
    return None


def restored_directly(word: str) -> tuple[str, str] | None:
    chain, best = [], None
    for _ in range(3):
        step = reversed_once(word)
        if step is None:
            break
        word = step[0]
        chain.append(step[1])
        best = (word, "+".join(reversed(chain)))
    return best


def scripts(word: str) -> int:
    """Number of alphabets among Latin, Greek and Cyrillic, and drawing characters, in a word."""
    kinds = set()
    for c in word:
        o = ord(c)
        if c.isalpha() and o < 0x250:
            kinds.add("latin")
        elif 0x370 <= o < 0x400:
            kinds.add("greek")
        elif 0x400 <= o < 0x530:
            kinds.add("cyrillic")
        elif 0x2500 <= o < 0x25A0 or 0x2200 <= o < 0x2300:
            kinds.add("drawn")
    return len(kinds)


def garbled_forms(word: str) -> dict[str, tuple[str, bool]]:
    """form -> (chain, whether the chain only swaps single-byte encodings) for every chain."""
    out: dict[str, tuple[str, bool]] = {}
    raw = word.encode("utf-8", "ignore")
    for first in READ_AS:
        once = read_as(raw, first)
        out.setdefault(once, (f"utf-8>{first}", False))
        if first in TWICE:
            again = once.encode("utf-8", "ignore")
            for second in TWICE:
                out.setdefault(read_as(again, second), (f"utf-8>{first}+utf-8>{second}", False))
    for first in WRITTEN_IN:
        try:
            single = word.encode(first)
        except UnicodeEncodeError:
            continue
        out.setdefault(single.decode("utf-8", "replace"), (f"{first}>utf-8", False))
        for second in READ_AS:
            out.setdefault(read_as(single, second), (f"{first}>{second}", True))
    out.setdefault(re.sub(r"[^\x00-\x7f]", REPLACED, word), ("lost", False))
    out.pop(word, None)
    return {f: c for f, c in out.items() if any(ord(x) > 127 for x in f)}


def wide_stretches(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, restored) of stretches that were UTF-8 or ASCII bytes read as UTF-16."""
    out = []
    for m in FAR.finditer(text):
        for encoding in ("utf-16-le", "utf-16-be"):
            try:
                plain = m[0].encode(encoding).decode("utf-8")
            except UnicodeError:
                continue
            usual = sum(c.isalnum() or c in " .,;:?!'\"-()\n\r\t$/&" for c in plain)
            if usual >= 0.9 * len(plain) and sum(c in "aeiouAEIOU" for c in plain) >= 0.1 * len(plain) and sum(ord(c) < 128 for c in plain) >= 0.7 * len(plain):
                out.append((m.start(), m.end(), plain))
                break
    return out


def plain(text: str) -> str:
    """Entities of letters and signs decoded, for a garbled character may have been turned into one."""
    return ENTITY.sub(lambda m: html.unescape(m[0]), text) if "&" in text else text


def count_words(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text.isascii() or "&" in text:
                    words.update(RUN.findall(plain(text)))
            if len(words) > 500_000:
                yield pa.record_batch([pa.array([*words], pa.string()), pa.array([*words.values()], pa.int64())], names=["word", "n"])
                words = Counter()
        yield pa.record_batch([pa.array([*words], pa.string()), pa.array([*words.values()], pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def garbled_words(words: DataFrame) -> DataFrame:
    """(word, original, chain): the corpus words that are garbled; original is null where it can't be restored.

    The table of forms holds hashes, so words of any length take the same room in it; what is met is checked letter by letter.
    """

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for word, n, h in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if REPLACED in word or scripts(word) > 1 or reversed_once(word) or any("\x80" <= c <= "\x9f" for c in word):
                    continue  # not clean itself
                rows += [(f, h, n, swap and scripts(f) < 2) for f, (_, swap) in garbled_forms(word).items()]
                if len(rows) > 50_000:
                    yield out(rows)
                    rows = []
            yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["form", "oh", "of", "swap"])

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chains = [garbled_forms(original).get(word) for word, original in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            keep = pa.array([c is not None for c in chains], pa.bool_())
            yield pa.record_batch([*batch.columns, pa.array([c and c[0] for c in chains], pa.string())], names=["word", "original", "of", "swap", "chain"]).filter(keep)

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word in batch.column(0).to_pylist():
                got = restored_directly(word)
                if got:
                    rows.append((word, *got))
                elif REPLACED in word or any("\x80" <= c <= "\x9f" for c in word):
                    rows.append((word, None, "unknown"))
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.record_batch([pa.array(c, pa.string()) for c in cols], names=["word", "original", "chain"])

    spread = words.repartition(words.sparkSession.sparkContext.defaultParallelism, "h").select("word", "n", "h")
    table = spread.mapInArrow(forms, "form string, oh long, of long, swap boolean").select(F.xxhash64("form").alias("h"), "oh", "of", "swap")
    originals = words.select(F.col("h").alias("oh"), F.col("word").alias("original"))
    met = words.join(table, "h").where(~F.col("swap") | (F.length("word") >= 3) & (F.col("of") >= 3 * F.col("n"))).join(originals, "oh")
    met = met.where(~F.col("swap") | F.col("original").rlike(r"[A-Za-z]{2}")).select("word", "original", "of", "swap").mapInArrow(checked, "word string, original string, of long, swap boolean, chain string")
    best = met.groupBy("word").agg(F.max(F.struct(~F.col("swap"), "of", "original", "chain")).alias("x")).select("word", "x.original", "x.chain")
    best = materialize(best, "best")
    rest = words.join(best.select("word"), "word", "left_anti").select("word").mapInArrow(direct, "word string, original string, chain string")
    return best.union(rest)


def findings(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, findings): findings (doc_id, word, original, chain), one row per garbled word or stretch of a document."""
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    words = materialize(count_words(docs).withColumn("h", F.xxhash64("word")), "words")
    garbled = materialize(garbled_words(words), "garbled")

    def hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(hashed(batch.column(0).to_pylist()), pa.int64())], names=["h"])

    table = bit_table(garbled.select("word").mapInArrow(hash_words, "h long"), WORD_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = unpacked(table)
        for batch in batches:
            rows, maybe = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text.isascii() and "&" not in text:
                    continue
                text = plain(text)
                rows += [(key, text[a:b], p, "utf-8>utf-16", True) for a, b, p in wide_stretches(text)]
                maybe += [(key, w) for w in set(RUN.findall(text))]
                if REPLACED in text:
                    rows.append((key, REPLACED, None, "unknown", True))
            if maybe:
                hit = flags[slots(hashed([w for _, w in maybe]), WORD_BITS)]
                rows += [(key, w, None, None, False) for (key, w), h in zip(maybe, hit.tolist(), strict=True) if h]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "word", "original", "chain", "sure"])

    seen = materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, word string, original string, chain string, sure boolean"), "seen")
    found = seen.where("sure").drop("sure").union(seen.where("not sure").select("doc_id", "word").join(garbled, "word").select("doc_id", "word", "original", "chain"))
    return docs, found


def restored(documents: DataFrame) -> DataFrame:
    """(doc_id, text, words, unrestored): garbled documents with their restored text, counts of garbled words and of those left."""
    docs, found = findings(documents)
    # bounded by the words of one document
    per_doc = found.groupBy("doc_id").agg(F.collect_set(F.struct("word", "original")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, many, left = [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                table = {f["word"]: f["original"] for f in sorted(found, key=lambda f: f["original"] is not None)}
                text = plain(text)
                for a, b, p in reversed(wide_stretches(text)):
                    text = text[:a] + p + text[b:]
                text = RUN.sub(lambda m, t=table: t.get(m[0]) or m[0], text)
                texts.append(text)
                many.append(len(table))
                left.append(sum(v is None for v in table.values()))
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array(many, pa.int32()), pa.array(left, pa.int32())], names=["doc_id", "text", "words", "unrestored"])

    joined = docs.withColumn("doc_id", F.col("doc_id").cast("long")).join(per_doc, "doc_id")
    return joined.select("doc_id", "text", "found").mapInArrow(run, "doc_id long, text string, words int, unrestored int")
