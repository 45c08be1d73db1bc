"""Noise in text from scanned pages: lines labelled by a hidden Markov model, words checked against the corpus.

Every line of a page is one of header, page number, both in one line, body, or break: body with which a paragraph ends, or a
blank line. Its features are its place on the page, form, case, end and length, whether it recurs at the source's other pages
or is the page's title, whether the next line's first word would have fitted, and how the next line begins. The model has naive
Bayes emissions and first-order transitions. It is fitted by expectation maximisation (forward-backward, until the likelihood
settles) on a sample of about `train_pages` pages, gathered as bytes of features; labels from plain patterns give the first
model and stay in the counts with weight PRIOR, so that the states keep their meaning. Then the lines of all pages are
labelled by Viterbi, and pages are put together by their labels: body goes on, a break ends its paragraph, the others are left out.

Words divided over two lines are joined where the joined word, or one part of it, shows that they are one word.
Misread words are those that turn into a much commoner word of the corpus when one confusion of a scanner is undone; of
two-letter words only those with a digit, ! or |. How often a word must be seen grows with the corpus.

Recurring lines are counted and joined exactly. What is broadcast has a fixed size: a bit table (1 MB) of misread words, checked by a join
afterwards, and the model.

Defined results: null and empty texts have no noise and stay; a key that occurs again counts once, with its latest
row; rows without key or of another type than `pdf` are left out. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.grams import alnum_table, code_points, prefix_hash, span_hash
from larkspur.llm.bits import bit_table, slots, unpacked
from larkspur.session import materialize
from larkspur.tables import latest

STATES = ("header", "number", "both", "body", "break")
H, N, B, T, K = range(5)
FORMS = ("text", "blank", "both", "strong", "bare", "roman", "heading", "table", "numbered")
CASES = ("lower", "title", "upper", "none")
PLACE, FORM, CASE, END, LENGTH, KNOWN, ROOM, NEXT, WIDE = range(9)
VALUES = (7, 9, 4, 4, 3, 3, 3, 5, 2)  # of each feature
# What a state is: a header is text that ends no sentence or clause, a page number has the form of one.
ALLOWED = {H: {FORM: ("text",), END: (0, 3)}, N: {FORM: ("strong", "bare", "roman")}, B: {FORM: ("both",)}}
PRIOR = 0.5
WORD_BITS = 23

# What a scanner reads for what is printed.
CONFUSIONS = {"c": "e", "0": "o", "5": "s", "!": "i", "1": "l", "cl": "d", "d": "cl", "|": "l", "9": "g", "b": "h", "rn": "m", "n": "ri", "vv": "w", "h": "li", "lt": "tt", "m": "rn", "6": "b", "8": "b"}
ALSO = {"1": "i", "!": "l", "|": "i"}
MARKS = "0123456789!|"

_STRONG = r"(?:[pP][aA][gG][eE]\s+[\dlIOo|!S]+(?:\s+of\s+\d+)?|[-–—]\s*\d+\s*[-–—]|\[\s*\d+\s*\]|p\.\s*\d+|\d+\s*/\s*\d+|\d+\s+of\s+\d+)"
STRONG = re.compile(rf"^\s*{_STRONG}\s*$")
BARE = re.compile(r"^\s*\d{1,4}\s*$")
ROMAN = re.compile(r"^\s*(?=[ivxlcIVXLC])(?:[xX]{0,4}|[xX][lL]|[lL][xX]{0,3})(?:[iI][xX]|[iI][vV]|[vV]?[iI]{0,4})\s*$")
NUMBERED = re.compile(r"^[^\W\d_]+\s+(?:\d[\d.]*|[IVXLC]+)$")
_NUMBER = rf"(?:{_STRONG}|\d{{1,4}}|[ivxl]+)"
BOTH = re.compile(rf"^\s*(?:{_NUMBER}\s{{2,}}(?P<a>\S.*\S)|(?P<b>\S.*\S)\s{{2,}}{_NUMBER})\s*$")
HEADING = re.compile(r"^\s*(?:\d+[.)]\s|[-*•]\s|https?:|[—–]\s)")
ENDS = re.compile(r"[.!?:;,][\"”’')\]]*\s*$")
WORD = re.compile(r"(?:(?<![\w!|])[!|])?[^\W_][\w!|]*")
LINK = re.compile(r"https?://\S+")
BROKEN = re.compile(r"(?<=[\w!|])([-\u00ad\u2010\u00ac])[ \t]*\n[ \t]*(?=[^\W\d_])")
BEFORE = re.compile(r"[^\W\d_][\w!|]*$")
_FOLD = str.maketrans({"0": "o", "1": "l", "!": "l", "|": "l", "i": "l", "5": "s", "9": "g", "c": "e", "b": "h", "6": "h", "8": "h"})


_inside: np.ndarray | None = None
_tables: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    """For each code point, whether a character method is true of it."""
    if name not in _tables:
        _tables[name] = np.fromiter((getattr(chr(i), name)() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _tables[name]


def divided(text: str) -> list[tuple[int, str, str, str, int]]:
    """(begin, first part, hyphen, second part, end) of each word divided over two lines."""
    out = []
    for m in BROKEN.finditer(text):
        a, b = BEFORE.search(text, max(0, m.start() - 60), m.start()), WORD.match(text, m.end())
        if a and b:
            out.append((a.start(), a[0], m[1], b[0], b.end()))
    return out


def without_divided(text: str) -> str:
    out, at = [], 0
    for begin, _, _, _, end in divided(text):
        if begin >= at:
            out.append(text[at:begin])
            at = end
    return " ".join([*out, text[at:]]) if out else text


def word_spans(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all texts in lower case, begin, end, hash, number of the text) of each run of letters, digits, ! and |."""
    global _inside
    if _inside is None:
        _inside = alnum_table().copy()
        _inside[[ord("!"), ord("|"), ord("_")]] = True
    lower = [x.lower() for x in texts]
    whole = "\n".join(lower)
    points = code_points(whole)
    inside = np.zeros(len(points) + 2, dtype=np.int8)
    inside[1:-1] = _inside[points]
    edge = np.diff(inside)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    of = np.searchsorted(np.cumsum([len(x) + 1 for x in lower]), begin, side="right")
    return whole, begin, end, span_hash(prefix_hash(points), begin, end) if len(begin) else np.zeros(0, np.uint64), of


def folded(line: str) -> str:
    """A line without case, digits, spacing and the commonest misreadings, to see it recur."""
    x = re.sub(r"\b\d+\b|\b[ivxl]+\b", "#", line.lower())
    return re.sub(r"[\W_]+", "", x.translate(_FOLD).replace("rn", "m").replace("vv", "w").replace("el", "d"))


def hashed(items: list[str]) -> np.ndarray:
    points = [code_points(x) for x in items]
    ends = np.cumsum([len(p) for p in points], dtype=np.int64)
    starts = ends - np.array([len(p) for p in points], dtype=np.int64)
    return span_hash(prefix_hash(np.concatenate([*points, np.zeros(0, np.uint32)])), starts, ends).view(np.int64)


def recurring(line: str) -> str | None:
    """What must recur for a line to be a running one; None for lines that can't be."""
    line = line.strip()
    m = BOTH.match(line)
    part = (m["a"] or m["b"]) if m else line
    if len(part) > 110 or ENDS.search(part) or STRONG.match(part) or BARE.match(part) or HEADING.match(part):
        return None
    return folded(part) or None


def read_lines(sources: list[str], titles: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
    """(features of each line of all texts, number of lines of each text, lines that may recur, hash of each of these).

    The numpy part looks at all lines at once; only lines that aren't plain running text are looked at one by one.
    """
    whole = "\n".join(texts) + "\n"
    points = code_points(whole)
    stop = np.flatnonzero(points == 10)
    begin = np.concatenate([[0], stop[:-1] + 1])
    page = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begin, side="right")
    many = np.bincount(page, minlength=len(texts))
    space, low = _table("isspace")[points], _table("islower")
    index = np.arange(len(points))
    first = np.minimum.reduceat(np.where(space, len(points), index), begin)
    last = np.maximum.reduceat(np.where(space, -1, index), begin)
    blank = last < 0
    first, last = np.where(blank, begin, first), np.where(blank, begin, last)
    starts = ~space & np.concatenate([[True], space[:-1]])
    words = np.add.reduceat(starts.astype(np.int32), begin)
    small = np.add.reduceat((starts & low[points]).astype(np.int32), begin)
    width = np.maximum.reduceat(stop - begin, np.cumsum(many) - many)[page]
    length = last - first + 1
    out = np.zeros((len(begin), len(VALUES)), dtype=np.uint8)
    full = np.flatnonzero(~blank)
    if len(full):
        of = page[full]
        per = np.bincount(of, minlength=len(texts))
        j = np.arange(len(full)) - (np.cumsum(per) - per)[of]
        left = per[of] - 1 - j
        out[:, PLACE] = 6
        out[full, PLACE] = np.where(np.minimum(j, left) > 2, 6, np.where(j <= left, np.minimum(j, 2), 5 - np.minimum(left, 2)))
        char = points[last[full]]
        inner = points[np.maximum(last[full] - 1, begin[full])]
        char = np.where(np.isin(char, [ord(c) for c in "\"”’')]»"]), inner, char)
        out[full, END] = np.select([np.isin(char, [ord(c) for c in ".?!"]), np.isin(char, [ord(c) for c in ":;,"]), np.isin(char, [ord("-"), 0xAD, 0x2010, 0xAC])], [1, 2, 3])
        out[full, LENGTH] = length[full] >= 0.75 * width[full]
        out[:, WIDE] = width >= 130
        follows = np.concatenate([of[1:] == of[:-1], [False]])
        after = np.concatenate([full[1:], full[-1:]])
        gaps = np.flatnonzero(space)
        word = gaps[np.searchsorted(gaps, first[after])] - first[after]
        out[full, ROOM] = np.where(~follows, 2, length[full] + 1 + word < 0.8 * width[full])
        head = points[first[after]]
        out[full, NEXT] = np.select([~follows, after != full + 1, low[head], _table("isalpha")[head]], [3, 4, 0, 1], 2)
    out[blank, FORM] = FORMS.index("blank")
    plain = (words >= 5) & (small > 0.55 * words)
    lines: list[int] = []
    keys: list[str] = []
    names: dict[int, str] = {}
    for i in full.tolist():
        title = titles[page[i]] or ""
        x = None
        if plain[i]:
            if out[i, PLACE] == 6 or not title:
                continue
            x = whole[first[i] : last[i] + 1]
            if x[:12].lower() != title[:12].lower():
                continue
        x = x or whole[first[i] : last[i] + 1]
        if page[i] not in names:
            names[page[i]] = folded(re.sub(r"(?:,?\s*no\.?\s*\S+.*)$", "", title, flags=re.IGNORECASE))
        form, case, part = line_form(x)
        out[i, FORM], out[i, CASE] = FORMS.index(form), CASES.index(case)
        out[i, LENGTH] = 2 if " " not in part else len(part) >= 0.75 * width[i]
        named, f = names[page[i]], folded(part)
        if len(named) > 8 and f.startswith(named[: max(8, len(named) - 6)]):
            out[i, KNOWN] = 1
        if w := recurring(x):
            lines.append(i)
            keys.append(f"{sources[page[i]]}\n{w}")
    bare = out[:, FORM] == FORMS.index("bare")
    if bare.any():  # numbers one below the other, or below a colon, are a table
        for k in np.flatnonzero(bare[full]).tolist():
            beside = [full[m] for m in (k - 1, k + 1) if 0 <= m < len(full) and of[m] == of[k]]
            if any(bare[m] for m in beside) or beside and beside[0] < full[k] and whole[last[beside[0]]] == ":":
                out[full[k], FORM] = FORMS.index("table")
    return out, many, lines, hashed(keys)


def line_form(line: str) -> tuple[str, str, str]:
    """(form, case, text beside a page number) of a line that isn't plain running text."""
    m = BOTH.match(line)
    part = (m["a"] or m["b"]) if m else line
    form = "both" if m else "strong" if STRONG.match(line) else "bare" if BARE.match(line) else "roman" if ROMAN.match(line) else "heading" if HEADING.match(line) else "numbered" if NUMBERED.match(line) else "text"
    letters = [w for w in re.findall(r"[^\W\d_]+", part) if len(w) > 3]
    case = "none" if not letters else "upper" if part.upper() == part else "title" if sum(w[0].isupper() for w in letters) >= 0.6 * len(letters) else "lower"
    return form, case, part


def first_labels(f: np.ndarray) -> np.ndarray:
    """Labels by plain patterns, which the model starts from."""
    form, edge = f[:, FORM], np.isin(f[:, PLACE], (0, 1, 4, 5))
    is_ = {name: form == i for i, name in enumerate(FORMS)}
    capital = np.isin(f[:, CASE], (CASES.index("upper"), CASES.index("title")))
    heading = is_["heading"] & (f[:, END] != 1)
    ends = is_["blank"] | heading | (f[:, WIDE] == 1) | (f[:, ROOM] == 2) | (f[:, NEXT] == 4) | (f[:, ROOM] == 1) & (f[:, END] == 1)
    out = np.where(ends, K, T)
    out[is_["text"] & edge & np.isin(f[:, END], (0, 3)) & ((f[:, KNOWN] > 0) | (f[:, CASE] == CASES.index("upper")))] = H
    out[is_["strong"] | is_["roman"] | is_["bare"] & edge] = N
    out[is_["both"] & ((f[:, KNOWN] > 0) | capital)] = B
    return out


def steps(many: np.ndarray) -> list[np.ndarray]:
    """The k-th lines of all pages that have one, for each k; pages go by their number of lines, most first."""
    order = np.argsort(-many, kind="stable")
    sizes, first = many[order], (np.cumsum(many) - many)[order]
    return [first[: int(np.searchsorted(-sizes, -k, side="left"))] + k for k in range(int(sizes[0]) if len(sizes) else 0)]


class Model:
    """Naive Bayes emissions over the features and first-order transitions; states 0 to 4, 5 the page's begin, 6 its end."""

    def __init__(self, emitted: list[np.ndarray], moved: np.ndarray) -> None:
        self.emit = [np.log((e + 0.1) / (e + 0.1).sum(axis=0)) for e in emitted]
        for state, features in ALLOWED.items():
            for i, values in features.items():
                never = [v for v in range(VALUES[i]) if v not in [FORMS.index(x) if i == FORM else x for x in values]]
                self.emit[i][never, state] = -50.0
        self.move = np.log((moved + 0.5) / (moved + 0.5).sum(axis=1, keepdims=True))

    def emissions(self, f: np.ndarray) -> np.ndarray:
        return sum(e[f[:, i]] for i, e in enumerate(self.emit))

    def label(self, f: np.ndarray, many: np.ndarray) -> np.ndarray:
        """The likeliest states of the lines of each page, by Viterbi."""
        out = np.full(len(f), T, dtype=np.int64)
        if not len(f):
            return out
        e, move = self.emissions(f), self.move[:5, :5]
        turns = steps(many)
        best, back = None, []
        finals = np.zeros((len(turns[0]), 5))
        for k, at in enumerate(turns):
            n = len(at)
            if best is None:
                best = self.move[5, :5] + e[at]
            else:
                to = best[:n, :, None] + move
                back.append(to.argmax(axis=1))
                best = to.max(axis=1) + e[at]
            done = len(turns[k + 1]) if k + 1 < len(turns) else 0
            finals[done:n] = best[done:]
        state = (finals + self.move[:5, 6]).argmax(axis=1)
        for k in range(len(turns) - 1, -1, -1):
            at, n = turns[k], len(turns[k])
            out[at] = state[:n]
            if k:
                state[:n] = back[k - 1][np.arange(n), state[:n]]
        return out

    def expected(self, f: np.ndarray, many: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, float]:
        """(expected emissions, expected moves, log-likelihood), by forward-backward."""
        e = self.emissions(f)
        top = e.max(axis=1, keepdims=True)
        p, move = np.exp(e - top), np.exp(self.move)
        turns = steps(many)
        moved, like = np.zeros((7, 7)), float(top.sum())
        alphas, scales, alpha = [], [], None
        for at in turns:
            alpha = (move[5, :5] if alpha is None else alpha[: len(at)] @ move[:5, :5]) * p[at]
            scale = alpha.sum(axis=1, keepdims=True)
            alpha = alpha / scale
            alphas.append(alpha)
            scales.append(scale)
            like += float(np.log(scale).sum())
        posterior = np.zeros((len(f), 5))
        beta = np.zeros((0, 5))
        for k in range(len(turns) - 1, -1, -1):
            alpha, m = alphas[k], len(beta)
            now = np.tile(move[:5, 6], (len(alpha), 1))
            if m:
                ahead = p[turns[k + 1]] * beta / scales[k + 1]
                now[:m] = ahead @ move[:5, :5].T
            total = (alpha * now).sum(axis=1, keepdims=True)
            if m:
                moved[:5, :5] += ((alpha[:m] / total[:m]).T @ ahead) * move[:5, :5]
            posterior[turns[k]] = alpha * now / total
            like += float(np.log(total[m:]).sum())
            beta = now
        if turns:
            moved[5, :5] = posterior[turns[0]].sum(axis=0)
            moved[:5, 6] = posterior[np.cumsum(many)[many > 0] - 1].sum(axis=0)
        return counts(f, posterior), moved, like


def counts(f: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    return [np.stack([np.bincount(f[:, i], weights=weight[:, s], minlength=v) for s in range(5)], axis=1) for i, v in enumerate(VALUES)]


def moves(states: np.ndarray, many: np.ndarray) -> np.ndarray:
    out = np.zeros((7, 7))
    ends = np.cumsum(many)[many > 0]
    first = np.zeros(len(states), dtype=bool)
    first[(ends - many[many > 0])] = True
    np.add.at(out, (states[:-1][~first[1:]], states[1:][~first[1:]]), 1)
    np.add.at(out, (5, states[first]), 1)
    np.add.at(out, (states[ends - 1], 6), 1)
    return out


def fit(f: np.ndarray, many: np.ndarray, most_rounds: int = 50, settled: float = 1e-5) -> Model:
    """Expectation maximisation from the first labels, until the likelihood changes by less than `settled` of itself."""
    seeds = first_labels(f)
    emitted, moved = counts(f, np.eye(5)[seeds]), moves(seeds, many)
    model, before = Model(emitted, moved), None
    if not len(f):
        return model
    for _ in range(most_rounds):
        e, m, like = model.expected(f, many)
        model = Model([x + PRIOR * y for x, y in zip(e, emitted, strict=True)], m + PRIOR * moved)
        if before is not None and abs(like - before) <= settled * abs(before):
            break
        before = like
    return model


def pages(chunks: DataFrame) -> DataFrame:
    rows = latest(chunks, "chunk_id", ["ingested_at"], ["type", "source", "title", "page_content"])
    return materialize(rows.where("type = 'pdf' and page_content is not null").drop("type"), "pages")


def read_pages(base: DataFrame) -> DataFrame:
    """Words (item, n) with their counts in a task, and pages (chunk_id, features, lines, hashes): one pass over the texts."""

    names = ["item", "n", "chunk_id", "features", "lines", "hashes"]

    def of_words(words: Counter) -> pa.RecordBatch:
        none = [pa.nulls(len(words), t) for t in (pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()))]
        return pa.record_batch([pa.array([*words], pa.string()), pa.array([*words.values()], pa.int64()), *none], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                keys, sources, titles, texts = (c.to_pylist() for c in part.columns)
                whole, begin, end, h, _ = word_spans([without_divided(LINK.sub(" ", t) if "http" in t else t) for t in texts])
                _, at, n = np.unique(h, return_index=True, return_counts=True)
                for i, j, k in zip(begin[at].tolist(), end[at].tolist(), n.tolist(), strict=True):
                    if m := WORD.search(whole, i, j):
                        words[m[0]] += k
                f, many, lines, hashes = read_lines(sources, titles, texts)
                cuts = np.cumsum(many)
                pick = np.searchsorted(cuts, lines, side="right")
                by_page: list[tuple[list[int], list[int]]] = [([], []) for _ in keys]
                for p, i, x in zip(pick.tolist(), lines, hashes.tolist(), strict=True):
                    by_page[p][0].append(i - int(cuts[p] - many[p]))
                    by_page[p][1].append(x)
                raw = [f[c - m : c].tobytes() for c, m in zip(cuts.tolist(), many.tolist(), strict=True)]
                columns = [pa.nulls(len(keys), pa.string()), pa.nulls(len(keys), pa.int64()), pa.array(keys, pa.string()), pa.array(raw, pa.binary())]
                yield pa.record_batch([*columns, pa.array([x for x, _ in by_page], pa.list_(pa.int32())), pa.array([x for _, x in by_page], pa.list_(pa.int64()))], names=names)
            if len(words) > 500_000:
                yield of_words(words)
                words = Counter()
        yield of_words(words)

    schema = "item string, n long, chunk_id string, features binary, lines array<int>, hashes array<bigint>"
    return base.select("chunk_id", "source", "title", "page_content").mapInArrow(run, schema)


def with_recurring(read: DataFrame) -> DataFrame:
    """(chunk_id, features, again): `again` are the lines of a page that are on other pages of its source, too."""
    some = read.where("chunk_id is not null")
    each = some.select("chunk_id", F.explode(F.arrays_zip("lines", "hashes")).alias("x")).select("chunk_id", F.col("x.lines").alias("line"), F.col("x.hashes").alias("h"))
    # a line twice on one page is on one page
    often = each.groupBy("h").agg(F.min("chunk_id").alias("a"), F.max("chunk_id").alias("b")).where("a <> b").select("h")
    again = each.join(often, "h").groupBy("chunk_id").agg(F.collect_list("line").alias("again"))  # lines of one page
    return some.select("chunk_id", "features").join(again, "chunk_id", "left")


def _features(raws: list[bytes], again: list[list[int] | None]) -> tuple[np.ndarray, np.ndarray]:
    many = np.array([len(r) // len(VALUES) for r in raws], dtype=np.int64)
    f = np.array(bytearray(b"".join(raws)), dtype=np.uint8).reshape(-1, len(VALUES))
    begin = np.cumsum(many) - many
    for b, lines in zip(begin.tolist(), again, strict=True):
        for line in lines or ():
            f[b + line, KNOWN] = 2
    return f, many


def seen(total: int) -> int:
    """How often a word must be there to be one: twice, or once in 50 million words."""
    return max(2, total // 50_000_000)


def restored(word: str) -> list[str]:
    """Forms of a word with one confusion undone, at one place or at all places of it."""
    out = set()
    for table in (CONFUSIONS, ALSO):
        for read, printed in table.items():
            at = word.find(read)
            if at >= 0:
                out.add(word.replace(read, printed))
            while at >= 0:
                out.add(word[:at] + printed + word[at + len(read) :])
                at = word.find(read, at + 1)
    return sorted(out - {word})


def misread_words(words: DataFrame, total: int) -> DataFrame:
    """(word, printed): words that become much commoner when a confusion is undone. `total`: how many words there are in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n, form = [], [], []
            for w, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (len(w) >= 3 or len(w) == 2 and any(c in MARKS for c in w)) and any(c.isalpha() for c in w):
                    for f in restored(w):
                        word.append(w)
                        n.append(k)
                        form.append(f)
            yield pa.record_batch([pa.array(word, pa.string()), pa.array(n, pa.int64()), pa.array(form, pa.string())], names=["word", "n", "form"])

    forms = words.select("item", "n").mapInArrow(run, "word string, n long, form string")
    known = words.select(F.col("item").alias("form"), F.col("n").alias("of"))
    marked = F.col("word").rlike(r"[0-9!|]")
    much = F.when(marked, F.col("of") >= F.greatest(F.lit(seen(total)), F.col("n"))).when(F.length("word") >= 5, F.col("of") >= F.greatest(F.lit(2 * seen(total)), 8 * F.col("n"))).otherwise(F.col("of") >= 40 * F.col("n"))
    pairs = forms.join(known, "form").where(much)
    return pairs.groupBy("word").agg(F.max(F.struct("of", "form"))["form"].alias("printed"))


def word_noise(base: DataFrame, misread) -> DataFrame:  # noqa: ANN001
    """(chunk_id, what, a, b): certain or possible divided words (a, b), possibly misread word a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad = unpacked(misread)
        for batch in batches:
            rows: list[tuple] = []
            keys, texts = (c.to_pylist() for c in batch.columns)
            plain = [LINK.sub(" ", t) if "http" in t else t for t in texts]
            joined: list[tuple[str, str]] = []
            for key, own in zip(keys, plain, strict=True):
                for _, a, mark, b, _ in divided(own):
                    rows.append((key, "maybe" if mark == "-" else "divided", a.lower(), b.lower()))
                    joined.append((key, (a + b).lower()))
            for at in range(0, len(plain), 500):
                whole, begin, end, h, of = word_spans(plain[at : at + 500])
                for i in np.flatnonzero(bad[slots(h.view(np.int64), WORD_BITS)]).tolist():
                    rows.append((keys[at + of[i]], "word", whole[begin[i] : end[i]], None))
            if joined:
                hit = bad[slots(hashed([w for _, w in joined]), WORD_BITS)]
                rows += [(key, "word", w, None) for (key, w), x in zip(joined, hit.tolist(), strict=True) if x]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.record_batch([pa.array(c, pa.string()) for c in cols], names=["chunk_id", "what", "a", "b"])

    return base.select("chunk_id", "page_content").mapInArrow(run, "chunk_id string, what string, a string, b string")


def labelled(read: DataFrame, count: int, train_pages: int) -> DataFrame:
    """(chunk_id, labels): the state of each line of each page, a byte each."""
    lines = materialize(with_recurring(read), "lines")
    share = min(1.0, train_pages / max(1, count))
    sample = lines.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("features", "again").toArrow()
    shared = read.sparkSession.sparkContext.broadcast(fit(*_features(sample.column(0).to_pylist(), sample.column(1).to_pylist())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, many = _features(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            labels, cuts = shared.value.label(f, many).astype(np.uint8), np.cumsum(many)
            raw = [labels[c - m : c].tobytes() for c, m in zip(cuts.tolist(), many.tolist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(raw, pa.binary())], names=["chunk_id", "labels"])

    return lines.select("chunk_id", "features", "again").mapInArrow(run, "chunk_id string, labels binary")


def findings(chunks: DataFrame, train_pages: int = 20_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, labels of their lines, findings): findings (chunk_id, noise_kind, a, b) tell what was found; b is the printed form of a misread a."""
    base = pages(chunks)
    read = materialize(read_pages(base), "read")
    words = materialize(read.where("item is not null").groupBy("item").agg(F.sum("n").alias("n")), "words")
    count, total = base.count(), words.agg(F.sum("n")).first()[0] or 0
    wrong = materialize(misread_words(words, total), "misread")
    labels = materialize(labelled(read, count, train_pages), "labels")

    def hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(hashed(batch.column(0).to_pylist()), pa.int64())], names=["h"])

    misread = bit_table(wrong.select("word").mapInArrow(hash_words, "h long"), WORD_BITS)
    got = materialize(word_noise(base, misread), "noise")

    known = words.where(F.col("n") >= seen(total)).select("item")
    maybe = got.where("what = 'maybe'").select("chunk_id", "a", "b")
    pair = maybe.select("a", "b").distinct()
    pair = pair.join(known.select(F.col("item").alias("a"), F.lit(True).alias("has_a")), "a", "left").join(known.select(F.col("item").alias("b"), F.lit(True).alias("has_b")), "b", "left")
    pair = pair.withColumn("joined", F.concat("a", "b")).join(known.select(F.col("item").alias("joined"), F.lit(True).alias("has_j")), "joined", "left")
    # both parts words of their own and the whole none: a compound broken at its own hyphen
    one = pair.where(F.coalesce("has_j", F.lit(False)) | ~(F.coalesce("has_a", F.lit(False)) & F.coalesce("has_b", F.lit(False)))).select("a", "b")
    kind = F.lit
    hyphen = maybe.join(one, ["a", "b"]).select("chunk_id", "a", "b").union(got.where("what = 'divided'").select("chunk_id", "a", "b")).select("chunk_id", kind("hyphen").alias("noise_kind"), "a", "b")
    words_bad = got.where("what = 'word'").select("chunk_id", F.col("a").alias("word")).join(wrong, "word").select("chunk_id", kind("misread").alias("noise_kind"), F.col("word").alias("a"), F.col("printed").alias("b"))
    hexed, none = F.hex("labels"), F.lit(None).cast("string")
    has = [(hexed.rlike("^(..)*(00|02)"), "header"), (hexed.rlike("^(..)*(01|02)"), "page_number")]
    edges = labels.select("chunk_id", F.explode(F.array_compact(F.array(*[F.when(test, name) for test, name in has]))).alias("noise_kind"), none.alias("a"), none.alias("b"))
    return base, labels, hyphen.union(words_bad).union(edges)


def repaired(chunks: DataFrame, train_pages: int = 20_000) -> DataFrame:
    """(chunk_id, text, changes): pages as continuous paragraphs, without page furniture, divided words joined, misread words restored."""
    base, labels, found = findings(chunks, train_pages)
    per_page = found.where("a is not null").groupBy("chunk_id").agg(F.collect_set(F.struct("noise_kind", "a", "b")).alias("found"))  # bounded by the page itself

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, changes = [], []
            for text, states, found in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                text, n = rebuild(text, states, found or [])
                texts.append(text)
                changes.append(n)
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array(changes, pa.int32())], names=["chunk_id", "text", "changes"])

    joined = base.select("chunk_id", "page_content").join(labels, "chunk_id").join(per_page, "chunk_id", "left")
    return joined.select("chunk_id", "page_content", "labels", "found").mapInArrow(run, "chunk_id string, text string, changes int")


def rebuild(text: str, states: bytes, found: list[dict]) -> tuple[str, int]:
    """A page's text put together by the states of its lines, and how many changes that took."""
    joins = {(f["a"], f["b"]) for f in found if f["noise_kind"] == "hyphen"}
    printed = {f["a"]: f["b"] for f in found if f["noise_kind"] == "misread"}
    kept = [(x, s) for x, s in zip(text.split("\n"), states, strict=True) if s in (T, K)]
    dropped = len(states) - len(kept)
    text, out, at = "\n".join(x for x, _ in kept), [], 0
    for begin, a, _, b, end in divided(text):
        if begin >= at and (a.lower(), b.lower()) in joins:
            out += [text[at:begin], a, b, "\n"]  # the line's end moves behind the word
            at = end
    text = "".join([*out, text[at:]])

    def word(m: re.Match) -> str:
        new = printed.get(m[0].lower())
        if new is None:
            return m[0]
        return new.upper() if m[0].upper() == m[0] and len(new) > 1 else new.capitalize() if m[0][0].isupper() else new

    if printed:
        text = WORD.sub(word, text)
    paragraphs: list[str] = []
    fresh = True
    for line, (_, state) in zip(text.split("\n"), kept, strict=False):
        x = line.strip()
        if x and fresh:
            paragraphs.append(x)
        elif x:
            paragraphs[-1] += ("" if paragraphs[-1].endswith("-") else " ") + x
        fresh = state == K or fresh and not x
    return "\n\n".join(paragraphs), dropped + len(joins) + len(printed)
