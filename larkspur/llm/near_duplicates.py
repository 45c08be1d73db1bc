"""Near-duplicate records by T-occurrence search (DivideSkip), distributed over Spark.

A record is the set of its sequences of `width` words. Two records whose Jaccard similarity exceeds t share at
least T = t / (1 + t) * (|x| + |y|) sequences. DivideSkip sets a record's longest inverted lists aside, merges the short
ones and probes the long ones by binary search only for records met in the merge. As many lists are set aside as T allows,
so that a record has to be met once:

1. `read_sets`       one pass over the texts: each record's class (a 128-bit hash of its set) and size, and the lengths of
                     all inverted lists in a count-min sketch, sized by the text (32 MB at most, broadcast). It never
                     counts too low, so a list of length 1 is known to be without partner.
2. `short_postings`  the shortest lists of each record, n - ceil(t n) + 1 of its n, each with the record's size, the list's place in
                     the record's order and a bitmap. Lists have one order for all records: by length, then token.
3. `merge_lists`     lists are merged where their token's hash puts them. Of a pair the smaller record must be met in its
                     n - ceil(2t / (1 + t) n) + 1 shortest lists, and the places of the list in both must leave room for T. Pairs
                     whose bitmaps differ too much are dropped. All of this is exact: the first list that two
                     similar records share passes.
4. `divide_skip`     for each candidate the count over the short lists must reach T less the long ones, then the long lists
                     are probed by binary search, and the count must reach T. Done with the tokens' last 16 bits first, which
                     can't count too low, then with whole tokens.

Records with equal sets form one class and are searched once. Lists longer than `block` are cut into blocks and each pair of blocks
is merged by itself, so no list, however long, has to be handled by one task. `block` is at least four times the sketch's mean
error, so that its errors cut no list. The number of merging tasks follows from the number of postings.

Defined results: a null or empty text, or one of fewer than `width` words, has no sequences and is in no pair.
Rows without key are dropped. A key that occurs again counts once, with its latest row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.grams import mix, sequence_hashes
from larkspur.llm.bits import bit_table, keep_marked
from larkspur.session import materialize

SEGMENTS = 64
BITMAP_WORDS = 6
FILTER_BITS = 23
PART_BYTES = 64 << 20
TEXTS = 200
_DOC = np.dtype([("hi", ">u8"), ("lo", ">u8"), ("n", "<u4"), ("map", "<u8", (BITMAP_WORDS,))])
# bytes of each; tokens that only look equal in 5 bytes add a candidate, which is checked with whole tokens
_COLUMNS = (("token", 5), ("pos", 4), ("cell", 4))
_POSTING = 16  # bytes, for the size of parts


def _class_id(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else b""


def _ids(hi: np.ndarray, lo: np.ndarray) -> pa.Array:
    raw = np.empty((len(hi), 2), dtype=">u8")
    raw[:, 0], raw[:, 1] = hi, lo
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(hi), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def source_rows(df: DataFrame, key: str, text: str, order: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(order).alias("ord"))


def sketch_bits(rows: DataFrame) -> int:
    """A slot for about 16 sequences of the text (six characters a word), of which many are repeated; at most 2**24."""
    length = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    return min(24, max(16, math.ceil(math.log2(length / 96 + 1))))


def _slots(tokens: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(tokens)
    mask = np.uint64((1 << bits) - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def read_sets(rows: DataFrame, width: int, bits: int) -> DataFrame:
    """(key, ord, id, n, seg, raw): a row per record, and each task's part of the sketch in rows with a segment."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, 1 << bits), dtype=np.uint32)
        seen: set[bytes] = set()
        names = ["key", "ord", "id", "n", "seg", "raw"]
        like = None
        for batch in batches:
            like = batch.schema
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                sets = sequence_hashes(part.column(1).to_pylist(), width)
                ids = [_class_id(s) for s in sets]
                fresh = []
                for i, s in zip(ids, sets, strict=True):
                    if i and i not in seen:
                        seen.add(i)
                        fresh.append(s)
                if fresh:
                    for row, slot in zip(table, _slots(np.concatenate(fresh), bits), strict=True):
                        np.add.at(row, slot, np.uint32(1))
                none = part.num_rows
                yield pa.record_batch([part.column(0), part.column(2), pa.array(ids, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], names=names)
        if like is not None:
            raw = [zlib.compress(p.tobytes(), 1) for p in table.reshape(SEGMENTS, -1)]
            yield pa.record_batch([pa.nulls(SEGMENTS, like.field(0).type), pa.nulls(SEGMENTS, like.field(2).type), pa.nulls(SEGMENTS, pa.binary()), pa.nulls(SEGMENTS, pa.int32()), pa.array(range(SEGMENTS), pa.int32()), pa.array(raw, pa.binary())], names=names)

    return rows.mapInArrow(run, f"key {kinds['key']}, ord {kinds['ord']}, id binary, n int, seg int, raw binary")


def length_sketch(read: DataFrame, bits: int) -> Broadcast:
    """uint8[2, 2**bits]: lengths of inverted lists, exact up to 32, then in steps of an eighth of a doubling."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for seg, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one = np.frombuffer(zlib.decompress(raw), dtype=np.uint32).astype(np.uint64)
                total[seg] = total[seg] + one if seg in total else one
        small = [np.where(v <= 32, v, np.minimum(255, 32 + np.ceil(8 * np.log2(np.maximum(v, 32) / 32)))).astype(np.uint8) for v in total.values()]
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([s.tobytes() for s in small], pa.binary())], names=["seg", "raw"])

    counted = read.where("seg is not null").select("seg", "raw")
    rows = counted.repartition(min(SEGMENTS, 16), "seg").mapInArrow(add, "seg int, raw binary").collect()  # SEGMENTS rows of fixed size
    out = np.zeros((SEGMENTS, (2 << bits) // SEGMENTS), dtype=np.uint8)
    for seg, raw in rows:
        out[seg] = np.frombuffer(raw, dtype=np.uint8)
    return read.sparkSession.sparkContext.broadcast(out.reshape(2, 1 << bits))


def _length_of(code: np.ndarray) -> np.ndarray:
    """The list length a code of the sketch stands for, rounded up."""
    return np.where(code <= 32, code, np.ceil(32 * 2 ** ((code.astype(np.float64) - 32) / 8))).astype(np.int64)


def _ordered(tokens: np.ndarray, sketch: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, codes) in the order of their lists: by length, then token."""
    a, b = _slots(tokens, bits)
    code = np.minimum(sketch[0][a], sketch[1][b])
    at = np.argsort(code, kind="stable")  # tokens come sorted
    return tokens[at], code[at]


def short_lists(n: int, threshold: float) -> int:
    """How many of a record's n lists are merged."""
    return n - math.ceil(threshold * n - 1e-9) + 1


def part_values(spark: SparkSession, partitions: int) -> np.ndarray:
    """For each partition a value that Spark's hash partitioning puts there, so that parts are spread evenly."""
    found = spark.range(0, 40 * partitions).select(F.col("id").cast("int").alias("v")).groupBy(F.pmod(F.hash("v"), F.lit(partitions)).alias("p")).agg(F.min("v").alias("v")).collect()
    out = np.arange(partitions)
    for r in found:
        out[r["p"]] = r["v"]
    return out


def short_postings(rows: DataFrame, width: int, sketch: Broadcast, bits: int, threshold: float, block: int, partitions: int) -> DataFrame:
    """(part, rows): packed postings of each record's shortest lists, grouped by where they are merged."""
    values = part_values(rows.sparkSession, partitions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sketch.value
        seen: set[bytes] = set()
        docs: list[tuple] = []
        post: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                for tokens in sequence_hashes(batch.column(0).slice(at, TEXTS).to_pylist(), width):
                    i, n = _class_id(tokens), len(tokens)
                    if not n or i in seen:
                        continue
                    seen.add(i)
                    ordered, code = _ordered(tokens, table, bits)
                    # a list of one record has no pair, but it is one of the shortest
                    pos = np.arange(np.searchsorted(code, 2), short_lists(n, threshold))
                    if not len(pos):
                        continue
                    bitmap = np.zeros(64 * BITMAP_WORDS, dtype=np.uint8)
                    bitmap[(mix(tokens) >> np.uint64(20)).astype(np.int64) % (64 * BITMAP_WORDS)] = 1
                    blocks = np.maximum(1, -(-_length_of(code[pos]) // block))
                    at_cell, cell = _cells(pos, blocks, int.from_bytes(i[8:], "big"))
                    listed = ordered[at_cell]
                    where = mix(listed + cell * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(partitions)
                    post.append((listed, np.full(len(listed), len(docs), dtype=np.int64), at_cell, cell, where))
                    docs.append((int.from_bytes(i[:8], "big"), int.from_bytes(i[8:], "big"), n, np.packbits(bitmap).view("<u8")))
            if len(docs) > 5_000:
                yield _packed(docs, post, values)
                docs, post = [], []
        if docs:
            yield _packed(docs, post, values)

    return rows.select("text").mapInArrow(run, "part int, rows binary")


def _cells(pos: np.ndarray, blocks: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """A posting of a list in b blocks goes to each of the b pairs of blocks with its own block in it. Cell 0: a list in one block."""
    if (blocks == 1).all():
        return pos, np.zeros(len(pos), dtype=np.uint64)
    cells = []
    for b in blocks.tolist():
        other, mine = np.arange(b, dtype=np.uint64), np.uint64(number % b)
        cells.append(np.minimum(other, mine) * np.uint64(b) + np.maximum(other, mine) + np.uint64(b > 1))
    return np.repeat(pos, blocks), np.concatenate(cells)


def _planes(x: np.ndarray, width: int) -> bytes:
    """Integers as planes of their low bytes: planes of zeros take no room once compressed."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _integers(raw: bytes, n: int, width: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(raw, dtype=np.uint8, count=n * width, offset=at).reshape(width, n).T
    return out.view("<u8").ravel()


def _packed(docs: list[tuple], post: list[tuple[np.ndarray, ...]], values: np.ndarray) -> pa.RecordBatch:
    """For each part one value: counts, then the records met there once each, with the number of their postings, then these."""
    table = np.zeros(len(docs), dtype=_DOC)
    for i, x in enumerate(docs):
        table[i] = x
    token, doc, pos, cell, where = (np.concatenate(x) for x in zip(*post, strict=True))
    order = np.argsort(where, kind="stable")  # within a part, a record's postings stay together
    cuts = np.searchsorted(where[order], np.arange(len(values) + 1, dtype=np.uint64))
    parts, raw = [], []
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        pick = order[cuts[p] : cuts[p + 1]]
        own, many = np.unique(doc[pick], return_counts=True)
        columns = b"".join(_planes(c[pick], w) for c, (_, w) in zip((token, pos, cell), _COLUMNS, strict=True))
        parts.append(values[p])
        raw.append(np.array([len(own), len(pick)], dtype=np.uint32).tobytes() + table[own].tobytes() + _planes(many, 4) + columns)
    return pa.record_batch([pa.array(parts, pa.int32()), pa.array(raw, pa.binary())], names=["part", "rows"])


def _unpacked(raws: list[bytes]) -> tuple[np.ndarray, ...]:
    """(records, record number, token, place, cell) of the values of one part."""
    docs, doc, columns, base = [], [], [[] for _ in _COLUMNS], 0
    for raw in raws:
        k, n = np.frombuffer(raw, dtype=np.uint32, count=2).tolist()
        docs.append(np.frombuffer(raw, dtype=_DOC, count=k, offset=8))
        at = 8 + k * _DOC.itemsize
        doc.append(np.repeat(np.arange(base, base + k), _integers(raw, k, 4, at).astype(np.int64)))
        at += 4 * k
        for column, (_, width) in zip(columns, _COLUMNS, strict=True):
            column.append(_integers(raw, n, width, at))
            at += n * width
        base += k
    return np.concatenate(docs), np.concatenate(doc), *(np.concatenate(c) for c in columns)


def merge_lists(postings: DataFrame, threshold: float, partitions: int) -> DataFrame:
    """(a, b): pairs of classes, a < b, met in short lists, that may still reach the overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_part.setdefault(part, []).append(raw)
        for part in list(by_part):  # one, but for parts that no value was found for
            for a, b in _pairs(*_unpacked(by_part.pop(part)), threshold):
                yield pa.record_batch([_ids(*a), _ids(*b)], names=["a", "b"])

    return postings.repartition(partitions, "part").mapInArrow(run, "a binary, b binary").distinct()


def _pairs(docs: np.ndarray, doc: np.ndarray, token: np.ndarray, pos: np.ndarray, cell: np.ndarray, threshold: float) -> Iterator[tuple]:
    ratio = threshold / (1 + threshold)
    size, maps = docs["n"].astype(np.int64), np.ascontiguousarray(docs["map"])
    hi, lo = docs["hi"].astype(np.uint64), docs["lo"].astype(np.uint64)
    # one number for each record that orders by size and then by id, the same for a class met in several map tasks
    by_size = np.lexsort((lo, hi, size))
    same = np.concatenate([[False], (hi[by_size][1:] == hi[by_size][:-1]) & (lo[by_size][1:] == lo[by_size][:-1])])
    rank = np.empty(len(docs), dtype=np.int64)
    rank[by_size] = np.cumsum(~same)
    order = np.lexsort((rank[doc], cell, token))
    token, doc, cell, pos = token[order], doc[order], cell[order], pos[order].astype(np.int64)
    turn = (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])
    again = np.concatenate([[False], ~turn & (rank[doc[1:]] == rank[doc[:-1]])])
    group = np.concatenate([[0], np.cumsum(turn)])[~again]
    doc, pos = doc[~again], pos[~again]
    if len(doc) < 2:
        return
    n = size[doc]
    ends = np.searchsorted(group, group, side="right")
    # within a list rows go by size; |y| <= |x| / t ends the run of partners of x, which must be met in x's own shortest lists
    reach = np.minimum(ends, np.searchsorted(group * (1 << 32) + n, group * (1 << 32) + np.floor(n / threshold + 1e-9).astype(np.int64), side="right"))
    index = np.arange(len(doc))
    met = pos <= n - np.ceil(2 * ratio * n - 1e-9).astype(np.int64)
    count = np.where(met, np.maximum(reach - index - 1, 0), 0)
    sums = np.cumsum(count)
    kept: list[np.ndarray] = []
    at = 0
    while at < len(doc):
        stop = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + 1_000_000, side="right")))
        c = count[at:stop]
        begin = np.cumsum(c) - c
        for first in range(0, int(c.sum()), 4_000_000):  # more than one step only for a list's one long run
            steps = np.arange(first, min(int(c.sum()), first + 4_000_000))
            own = np.searchsorted(begin + c, steps, side="right")
            left = index[at:stop][own]
            right = left + 1 + steps - begin[own]
            least = np.ceil(ratio * (n[left] + n[right]) - 1e-9).astype(np.int64)
            room = (n[left] - pos[left] >= least) & (n[right] - pos[right] >= least)
            left, right, least = left[room], right[room], least[room]
            x, y = doc[left], doc[right]
            apart = np.zeros(len(x), dtype=np.int64)
            for word in range(BITMAP_WORDS):
                apart += np.bitwise_count(maps[x, word] ^ maps[y, word])
            # the overlap is at most (|x| + |y| - apart) / 2
            good = size[x] + size[y] - apart >= 2 * least
            kept.append(np.unique(x[good] * np.int64(len(docs)) + y[good]))
        at = stop
        if sum(map(len, kept)) > 4_000_000:
            yield _named(kept, hi, lo)
            kept = []
    if any(map(len, kept)):
        yield _named(kept, hi, lo)


def _named(kept: list[np.ndarray], hi: np.ndarray, lo: np.ndarray) -> tuple:
    x, y = np.divmod(np.unique(np.concatenate(kept)), len(hi))
    turned = (hi[x] > hi[y]) | (hi[x] == hi[y]) & (lo[x] > lo[y])
    x, y = np.where(turned, y, x), np.where(turned, x, y)
    return (hi[x], lo[x]), (hi[y], lo[y])


def divide_skip(x: np.ndarray, y: np.ndarray, threshold: float) -> float:
    """Similarity of two records (tokens in the order of their lists), or 0 if it can't exceed the threshold.

    With tokens cut to fewer bits, so that some look shared that aren't, it is never too low.
    """
    if len(x) > len(y):
        x, y = y, x
    least = math.ceil(threshold / (1 + threshold) * (len(x) + len(y)) - 1e-9)
    short = short_lists(len(x), threshold)
    y = np.sort(y)
    last = len(y) - 1
    met = int((y[np.minimum(np.searchsorted(y, x[:short]), last)] == x[:short]).sum())
    if met < least - (len(x) - short):
        return 0.0
    shared = met + int((y[np.minimum(np.searchsorted(y, x[short:]), last)] == x[short:]).sum())
    return shared / (len(x) + len(y) - shared) if shared >= least else 0.0


def probed(pairs: DataFrame, rows: DataFrame, members: DataFrame, width: int, sketch: Broadcast, bits: int, threshold: float, kind: type) -> DataFrame:
    """(a, b, similarity) of the candidates whose overlap, of tokens cut to the given kind of integer, reaches T."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sketch.value
        seen: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                ids, raw = [], []
                for tokens in sequence_hashes(batch.column(1).slice(at, TEXTS).to_pylist(), width):
                    i = _class_id(tokens)
                    if i and i not in seen:
                        seen.add(i)
                        ids.append(i)
                        raw.append(_ordered(tokens, table, bits)[0].astype(kind).tobytes())
                yield pa.record_batch([pa.array(ids, pa.binary()), pa.array(raw, pa.binary())], names=["id", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similar = [divide_skip(np.frombuffer(x, kind), np.frombuffer(y, kind), threshold) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            keep = [i for i, s in enumerate(similar) if s > threshold]
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.record_batch([part.column(0), part.column(1), pa.array([similar[i] for i in keep], pa.float64())], names=["a", "b", "similarity"])

    # one key of each class in a pair; a filter of 1 MB drops all other texts before they are hashed again
    in_pair = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    keys = materialize(members.join(in_pair, "id", "left_semi").groupBy("id").agg(F.min("key").alias("key"), F.max("n").alias("n")), "keys")
    wanted = bit_table(keys.select(F.xxhash64("key").alias("h")), FILTER_BITS)
    some = keep_marked(rows.select(F.xxhash64("key").alias("h"), "text"), "h", wanted, FILTER_BITS)
    # as many tasks as the sets that meet there need
    mean = keys.agg(F.avg("n")).first()[0] or 0
    partitions = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs.count() * mean * np.dtype(kind).itemsize * 2 / PART_BYTES))
    needed = some.mapInArrow(sets, "id binary, tokens binary").repartition(partitions, "id").groupBy("id").agg(F.min("tokens").alias("tokens"))
    left = needed.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
    right = needed.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.select("a", "b").repartition(partitions, "a").join(left, "a").repartition(partitions, "b").join(right, "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(run, "a binary, b binary, similarity double")


def class_pairs(df: DataFrame, key: str, text: str, order: str, threshold: float, width: int = 3, block: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(pairs of classes with similarity, membership key -> class). Classes are groups of records with equal sets."""
    spark: SparkSession = df.sparkSession
    rows = source_rows(df, key, text, order)
    bits = sketch_bits(rows)
    read = materialize(read_sets(rows, width, bits), "sets")
    sketch = length_sketch(read, bits)
    total, count = read.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    block = max(block, 4 * total // (1 << bits))
    # a record goes once to each part that has postings of it
    least = spark.sparkContext.defaultParallelism
    postings = total * (1 - threshold)
    partitions = max(least, math.ceil((postings * _POSTING + _DOC.itemsize * min(postings, count * least)) / PART_BYTES))
    pairs = materialize(merge_lists(short_postings(rows, width, sketch, bits, threshold, block, partitions), threshold, partitions), "met")
    members = read.where("key is not null").groupBy("key").agg(F.max(F.struct("ord", "id", "n")).alias("x")).where("x.n > 0").select("key", F.col("x.id").alias("id"), F.col("x.n").alias("n"))
    members = materialize(members, "members")
    how = (rows, members, width, sketch, bits, threshold)
    # tokens of 16 bits first: nearly as good, and a quarter of the data to move
    likely = materialize(probed(pairs, *how, np.uint16).select("a", "b"), "likely")
    return probed(likely, *how, np.uint64), members


def similar_pairs(df: DataFrame, key: str, text: str, order: str, threshold: float, **how: float) -> DataFrame:
    """(a, b), a < b: all pairs of different keys with similarity above the threshold, equal texts included."""
    pairs, members = class_pairs(df, key, text, order, threshold, **how)
    left, right = members.select(F.col("key").alias("k1"), F.col("id").alias("a")), members.select(F.col("key").alias("k2"), F.col("id").alias("b"))
    apart = pairs.select("a", "b").join(left, "a").join(right, "b").select("k1", "k2")
    equal = left.join(right, F.col("a") == F.col("b")).where("k1 < k2").select("k1", "k2")
    # each pair of classes is there once and each key in one class, so no pair comes twice
    return apart.union(equal).select(F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): for each node of (a, b) the smallest node of its component.

    Labels spread by the minimum over neighbours and by looking up the label's own label, so rounds grow with the
    logarithm of a component's diameter. Each round is a table in the shared folder; minima are combined before shuffles.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        best = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("best"))
        up = labels.select(F.col("node").alias("best"), F.col("label").alias("up"))
        step = materialize(best.join(up, "best", "left").select("node", F.least("best", F.coalesce("up", "best")).alias("new"), "label"), "labels")
        labels = step.select("node", F.col("new").alias("label"))
        if step.where("new <> label").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def groups(df: DataFrame, key: str, text: str, order: str, threshold: float, **how: float) -> DataFrame:
    """(key, group_id, links): one row per record; group_id is the smallest key of its group, links its similar records.

    Groups are chained: a record is in the group of each record it is similar to. Records without sequences are alone.
    """
    pairs, members = class_pairs(df, key, text, order, threshold, **how)
    pairs = materialize(pairs.select("a", "b"), "pairs")
    sizes = members.groupBy("id").agg(F.count("*").alias("size"))
    both = pairs.union(pairs.select("b", "a")).toDF("id", "other")
    linked = both.join(sizes.withColumnsRenamed({"id": "other"}), "other").groupBy("id").agg(F.sum("size").alias("others"))
    classes = sizes.join(linked, "id", "left").join(components(pairs).withColumnRenamed("node", "id"), "id", "left")
    classes = classes.select("id", F.coalesce("label", "id").alias("label"), (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    labelled = members.join(classes, "id").select("key", "label", "links")
    names = labelled.groupBy("label").agg(F.min("key").alias("group_id"))
    all_keys = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct()
    out = all_keys.join(labelled.join(names, "label"), "key", "left")
    return out.select(F.col("key").alias(key), F.coalesce("group_id", "key").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
