"""Text cut off by field limits, by a backward character n-gram model.

The model reads the last characters of a value (or of a line in it) backward, once as the end of a text and once as a place
where text goes on, and their log-odds tell which of the two it looks like. Both sides are counted over all values of the
same column and language, characters in steps to 1, 2, 3, 5 and 7; each step's probability at ends is smoothed towards that of
going on, so an unseen end tells nothing, and a value's own end is left out. What ends a line in the way of a title, list item, link,
signature or field, or stands on a line of its own, is a class of ends by itself: it is compared with ends of its form, and
with the going on of all text. So a form doesn't decide; a list item cut short is unlike the items' ends.

Ends that were cut can't look more like ends than other text does, so they make a hump of low log-odds of their own. The
threshold lies in the valley beside it, found for each column and language in the histogram of all its log-odds. An explicit mark of
cutting is taken off before the end is read and counts as evidence beside it: an ellipsis MARKED, half a character or entity BROKEN.

Running headers and page numbers of scanned pages are set aside. Their lines are wrapped to a width and have page breaks
between them, so of such a page only the end counts.

Counts are 64-bit, in tables whose sizes follow the amount of text up to about 80 MB.

Defined results: null, empty and blank values are not cut; rows without key are dropped; a key that occurs again
counts once, with its latest row. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.grams import code_points, prefix_hash, window_hash
from larkspur.llm.scan_noise import BARE, BOTH, ROMAN, STRONG
from larkspur.session import materialize
from larkspur.tables import latest

ORDERS = {1: 16, 2: 17, 3: 19, 5: 21, 7: 21}  # context length: bits of its table, at most
SMOOTHING = 4.0
MARKED, BROKEN = 2.0, 8.0
LOW, HIGH, STEP = -4.0, 4.0, 0.25  # bins of the histogram
ENOUGH = 1000  # ends a language must have for a threshold of its own; else its column's is used
SEGMENT = 1 << 15
LANGUAGES = {"en": "en", "eng": "en", "es": "es", "spa": "es", "fr": "fr", "fra": "fr", "fre": "fr", "de": "de", "deu": "de", "ger": "de", "pt": "pt", "por": "pt", "pl": "pl", "pol": "pl"}
GROUPS = ["und", "en", "es", "fr", "de", "pt", "pl", "other"]
FORMS = ["prose", "title", "item", "link", "signature", "field", "own line"]
PAD = "\x02" * max(ORDERS)
_GOLD = np.uint64(0x9E3779B97F4A7C15)

MARK = re.compile(r"(?:\s*(?:…|\.\.\.|\[\s*(?:\.\.\.|…)\s*\]|\((?:more|continued)\)|�+|&#?\w{0,6}))+\s*$")
STRONG_MARK = re.compile(r"(?:�|&#?\w{0,6})\s*$")
END = re.compile(r"[.!?][\"”’»')\]]*\s*$")
BOUNDARY = re.compile(r"(?<=[.!?])[\"”’»')\]]*\s+(?=\S)")
LINK = re.compile(r"(?:https?://|www\.)\S+")
ITEM = re.compile(r"^\s*(?:[-*•‣]|\d+[.)]|\(?[a-z]\))\s+\S")
SIGNED = re.compile(r"^\s*[—–]\s*[^\W\d_]")
FIELD = re.compile(r"^\s*[^\W\d_][\w ]{1,20}:\s+(.*)$")


def at_end(pattern: re.Pattern, text: str) -> re.Match | None:
    """What a pattern for the end of a text finds; only where it reaches far back is the whole text looked through."""
    pos = max(0, len(text) - 60)
    m = pattern.search(text, pos)
    return pattern.search(text) if m and pos and m.start() == pos else m


def is_title(line: str) -> bool:
    """Capitals at most of the longer words, or at all of them."""
    if len(line) >= 120:
        return False
    line = re.sub(r",?\s+no\.\s*\S+", "", line)
    words = [w for w in re.findall(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*", line) if len(w) > 3]
    return bool(words) and (line.upper() == line or sum(w[0].isupper() for w in words) >= 0.8 * len(words) and not re.search(r"[.!?,;] ", line))


def is_furniture(line: str) -> bool:
    """A page number or running header."""
    return bool(STRONG.match(line) or BARE.match(line) or ROMAN.match(line) or BOTH.match(line)) or is_title(line.strip()) and not at_end(END, line)


def form(part: str, own_line: bool) -> int:
    """The class of ends that a text's last part belongs to."""
    x = part.strip()
    if at_end(END, x):
        return 0
    if (m := LINK.search(x)) and m.end() == len(x):
        return 3
    if SIGNED.match(x) and len(x) < 80:
        return 4
    if ITEM.match(x) and len(x) < 90:
        return 2
    if FIELD.match(x) and len(x) < 100:
        return 5
    if is_title(x):
        return 1
    return 6 if own_line and len(x) < 60 else 0


def line_ends(text: str) -> list[tuple[str, bool]]:
    """(stretch, whether it is one of several lines) of a text whose ends count: lines, or a page wrapped to a width; page furniture left out."""
    full = [x for x in text.split("\n") if x.strip()]
    several = len(full) > 1
    while len(full) > 1 and is_furniture(full[-1]):
        full.pop()
    while len(full) > 1 and is_furniture(full[0]):
        full.pop(0)
    if not full:
        return []
    width = max(len(x) for x in full)
    if width > 130 or len(full) <= 2:
        return [(x.strip(), several) for x in full]
    last = full[-1].strip()
    if at_end(END, full[-2]) or ITEM.match(last) or SIGNED.match(last) or FIELD.match(last) or LINK.search(last):
        return [(last, True)]
    return [(" ".join(x.strip() for x in full), False)]


def end_of(stretch: str, several: bool, last_only: bool = False) -> tuple[str, int, bool, bool]:
    """(characters as the model reads them, class, marked, broken) of a stretch; marks of cutting are taken off. Of all or the last 12 characters."""
    m = at_end(MARK, stretch)
    cut = stretch[: m.start()].rstrip() if m else stretch
    last = BOUNDARY.split(cut[-400:])[-1]
    kind = 0 if m or len(last) == 400 else form(last, several and len(last) == len(cut))
    read = LINK.sub("\x03", cut) if "http" in cut or "www." in cut else cut
    return (read[-12:] if last_only else read).lower()[-12 if last_only else 0 :], kind, bool(m), bool(m and at_end(STRONG_MARK, stretch))


def values(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """(table_name, record_key, origin, grp, text): one row per record of both tables."""
    a = latest(chunks, "chunk_id", ["ingested_at"], ["source_method", "language", "page_content"])
    tag = F.element_at(F.split(F.lower(F.trim("language")), "[-_]"), 1)
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    grp = F.when(F.coalesce(F.trim("language"), F.lit("")) == "", "und").otherwise(F.coalesce(F.try_element_at(known, tag), F.lit("other")))
    a = a.select(F.lit("chunks").alias("table_name"), F.col("chunk_id").alias("record_key"), F.col("source_method").alias("origin"), grp.alias("grp"), F.col("page_content").alias("text"))
    b = latest(results, "result_id", ["emitted_at"], ["client", "summary"])
    b = b.select(F.lit("search_results").alias("table_name"), F.col("result_id").cast("string").alias("record_key"), F.col("client").alias("origin"), F.lit("und").alias("grp"), F.col("summary").alias("text"))
    return a.union(b)


def _seed(table: str, grp: str) -> int:
    return GROUPS.index(grp) * 2 + (table == "chunks")


def sizes_for(characters: int) -> dict[int, int]:
    """Slots of each order's table."""
    return {k: 1 << min(most, max(12, math.ceil(math.log2(characters / 32 + 1)))) for k, most in ORDERS.items()}


def _slots(h: np.ndarray, size: int) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) & np.uint64(size - 1)).astype(np.int64)


def _laid_out(stretches: list[str], seeds: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix hash, seed of each character, end positions) of stretches, each after signs that occur nowhere else; digits are all one."""
    points = code_points("".join([PAD + s for s in stretches])).copy()
    points[(points >= 48) & (points <= 57)] = 48
    lengths = np.array([len(s) for s in stretches], dtype=np.int64) + len(PAD)
    return prefix_hash(points), np.repeat(np.array(seeds, dtype=np.uint64), lengths), np.cumsum(lengths) - 1


def _ending(h: np.ndarray, seed: np.ndarray, kinds: np.ndarray, size: int) -> np.ndarray:
    return _slots(h + (seed * np.uint64(len(FORMS)) + kinds + np.uint64(1000)) * _GOLD, size)


def _read(batch: pa.RecordBatch, last_only: bool = False) -> Iterator[tuple]:
    """(index, seed, what end_of tells) of each end in a batch."""
    for i, (table, grp, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("table_name", "grp", "text")), strict=True)):
        for stretch, several in line_ends(text) if text else []:
            yield i, _seed(table, grp), end_of(stretch, several, last_only)


def train(vals: DataFrame) -> dict[int, np.ndarray]:
    """For each order int64[2, slots]: how often texts go on after, and end after, a context. Totals are those of order 0."""
    sizes = sizes_for(vals.agg(F.sum(F.length("text"))).first()[0] or 0) | {0: 256}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: np.zeros((2, n), dtype=np.int64) for k, n in sizes.items()}
        for batch in batches:
            for first in range(0, batch.num_rows, 100):
                got = [x for x in _read(batch.slice(first, 100)) if x[2][0]]
                if not got:
                    continue
                kinds = np.array([x[2][1] for x in got], dtype=np.uint64)
                seeds = np.array([x[1] for x in got])
                prefix, seed, ends = _laid_out([x[2][0] for x in got], [x[1] for x in got])
                for k in ORDERS:
                    h, at = window_hash(prefix, k), ends - (k - 1)
                    on = _slots(h + seed[k - 1 :] * _GOLD, sizes[k])
                    np.add.at(tables[k][0], on, 1)
                    np.subtract.at(tables[k][0], on[at], 1)
                    np.add.at(tables[k][1], _ending(h[at], seed[ends], kinds, sizes[k]), 1)
                np.add.at(tables[0][0], seeds, [len(x[2][0]) - 1 for x in got])
                np.add.at(tables[0][1], seeds * len(FORMS) + kinds.astype(np.int64), 1)
        rows = [(k, i, j, zlib.compress(t[i, j : j + SEGMENT].tobytes(), 1)) for k, t in tables.items() for i in (0, 1) for j in range(0, t.shape[1], SEGMENT) if t[i, j : j + SEGMENT].any()]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["k", "i", "j", "raw"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for *key, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one = np.frombuffer(zlib.decompress(raw), dtype=np.int64)
                total[tuple(key)] = total[tuple(key)] + one if tuple(key) in total else one
        for key, one in total.items():
            raw = zlib.compress(one.tobytes(), 1)
            yield pa.record_batch([*(pa.array([x], pa.int32()) for x in key), pa.array([raw], pa.binary())], names=["k", "i", "j", "raw"])

    schema = "k int, i int, j int, raw binary"
    counted = vals.select("table_name", "grp", "text").mapInArrow(count, schema)
    tables = {k: np.zeros((2, n), dtype=np.int64) for k, n in sizes.items()}
    for k, i, j, raw in counted.repartition(16, "k", "i", "j").mapInArrow(add, schema).collect():  # tables of bounded size
        one = np.frombuffer(zlib.decompress(raw), dtype=np.int64)
        tables[k][i, j : j + len(one)] = one
    return tables


def log_odds(tables: dict[int, np.ndarray], ends: list[tuple[str, int, int]]) -> np.ndarray:
    """For ends (characters, seed, class) that were trained on: how much likelier they are as ends than as places where text goes on."""
    # what is shortened has no beginning of its own, but no order reaches it
    prefix, seed, ends_at = _laid_out([x[0][-12:] for x in ends], [x[1] for x in ends])
    kinds = np.array([x[2] for x in ends], dtype=np.uint64)
    seed = seed[ends_at]
    own = np.array([1 if x[0] else 0 for x in ends])
    ended = tables[0][1][(seed * np.uint64(len(FORMS)) + kinds).astype(np.int64)] - own
    went_on = tables[0][0][seed.astype(np.int64)]
    out = np.zeros(len(ends))
    for k in ORDERS:
        size = tables[k].shape[1]
        h = window_hash(prefix, k)[ends_at - (k - 1)]
        e = tables[k][1][_ending(h, seed, kinds, size)] - own
        o = tables[k][0][_slots(h + seed * _GOLD, size)]
        on = (o + 0.5) / (went_on + (15.0 if k == 1 else 2.0))
        out += np.log((np.maximum(e, 0) + SMOOTHING * on) / (np.maximum(ended, 0) + SMOOTHING) / on)
        ended, went_on = e, o
    return out


SCORED = "table_name string, record_key string, origin string, grp string, lowest double, bin int, n long"


def scored(vals: DataFrame, tables: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(table_name, record_key, origin, grp, lowest, bin, n): a row per record with the lowest log-odds of its ends, marks taken into account.

    Rows with a bin are parts of the histograms, of n ends each.
    """
    shared = vals.sparkSession.sparkContext.broadcast(train(vals) if tables is None else tables)
    bins = round((HIGH - LOW) / STEP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2 * len(GROUPS), bins), dtype=np.int64)
        names = [x.split()[0] for x in SCORED.split(", ")]
        for batch in batches:
            got = list(_read(batch, True))
            if not got:
                continue
            odds = log_odds(shared.value, [(x[2][0], x[1], x[2][1]) for x in got])
            np.add.at(counts, (np.array([x[1] for x in got]), np.clip(np.floor((odds - LOW) / STEP), 0, bins - 1).astype(int)), 1)
            odds -= MARKED * np.array([x[2][2] for x in got]) + BROKEN * np.array([x[2][3] for x in got])
            at, first = np.unique([x[0] for x in got], return_index=True)
            part = batch.select(["table_name", "record_key", "origin", "grp"]).take(pa.array(at, pa.int64()))
            yield pa.record_batch([*part.columns, pa.array(np.minimum.reduceat(odds, first)), pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.int64())], names=names)
        seeds, bin_ = np.nonzero(counts)
        tabled, grp = ["chunks" if s % 2 else "search_results" for s in seeds], [GROUPS[s // 2] for s in seeds]
        none = pa.nulls(len(seeds), pa.string())
        yield pa.record_batch([pa.array(tabled, pa.string()), none, none, pa.array(grp, pa.string()), pa.nulls(len(seeds), pa.float64()), pa.array(bin_, pa.int32()), pa.array(counts[seeds, bin_])], names=names)

    return vals.select("table_name", "record_key", "origin", "grp", "text").mapInArrow(run, SCORED)


def valley(counts: np.ndarray) -> float:
    """The threshold: where the histogram, smoothed the wider the fewer ends it has, is lowest around 0; the middle of the lowest bins."""
    middle = LOW + STEP * (np.arange(len(counts)) + 0.5)
    wide = max(STEP, 4.0 * max(1, counts.sum()) ** -0.2)  # the usual rule for a density estimate, with a spread of about 4
    smooth = np.exp(-0.5 * ((middle[:, None] - middle) / wide) ** 2) @ counts
    near = (middle > -2.5) & (middle < 2)
    low = middle[near][smooth[near] <= smooth[near].min()]
    return float(low[np.abs(low).argmin()])


def thresholds(histogram: DataFrame) -> dict[tuple[str, str], float]:
    """For each column and language, from rows (table_name, grp, bin, n)."""
    counts: dict[tuple[str, str], np.ndarray] = {}
    for r in histogram.groupBy("table_name", "grp", "bin").agg(F.sum("n").alias("n")).collect():  # at most 16 histograms
        counts.setdefault((r["table_name"], r["grp"]), np.zeros(round((HIGH - LOW) / STEP), dtype=np.int64))[r["bin"]] = r["n"]
    whole = {t: sum(c for (u, _), c in counts.items() if u == t) for t, _ in counts}
    return {(t, g): valley(c if c.sum() >= ENOUGH else whole[t]) for (t, g), c in counts.items()}


def cut_records(chunks: DataFrame, results: DataFrame, tables: dict[int, np.ndarray] | None = None) -> tuple[DataFrame, DataFrame]:
    """(values, cut): all records, and (table_name, record_key, origin) of those with a cut end."""
    vals = materialize(values(chunks, results), "values")
    got = materialize(scored(vals, tables), "scored")
    limit: Column = F.lit(0.0)
    for (table, grp), threshold in thresholds(got.where("bin is not null")).items():
        limit = F.when((F.col("table_name") == table) & (F.col("grp") == grp), threshold).otherwise(limit)
    return vals, got.where(F.col("lowest") < limit).select("table_name", "record_key", "origin")


def cut_rates(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """(table_name, origin, records, cut_records, cut_share): by source_method for chunks, by client for search_results. Null origins are a group."""
    vals, cut = cut_records(chunks, results)
    total = vals.groupBy("table_name", "origin").agg(F.count("*").alias("records"))
    some = cut.groupBy("table_name", "origin").agg(F.count("*").alias("cut_records")).select(F.col("table_name").alias("t"), F.col("origin").alias("o"), "cut_records")
    both = total.join(some, (total.table_name == some.t) & total.origin.eqNullSafe(some.o), "left")
    n = F.coalesce("cut_records", F.lit(0))
    return both.select("table_name", "origin", "records", n.alias("cut_records"), F.round(n / F.col("records"), 6).alias("cut_share"))
