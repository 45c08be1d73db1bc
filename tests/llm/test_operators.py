"""The operators against brute force, exact round trips and cases planted here."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.llm import garbled, mixing, near_duplicates, packing, queries, scan_noise, speaker_turns, splitting, tokens, truncation
from larkspur.tables import latest, read


# 1


def some_cut(spark, data, lists):
    """Texts, and lists if wanted, a tenth of the texts cut at random inside a sentence."""
    rng = random.Random(1)
    chunks = latest(read(spark, data.replace("0.001", "0.01"), "chunks"), "chunk_id", ["ingested_at"], ["source_method", "language", "page_content", "type"]).collect()
    whole = [r for r in chunks if r.page_content and ("\n" not in r.page_content and r.page_content.endswith(".") or lists and re.search(r"\n\s*[-*•] [^\n]{4,60}$", r.page_content))]
    rows, cut = [], set()
    for i, r in enumerate(whole):
        text = r.page_content
        if i % 10 == 0 and text.endswith("."):
            at = rng.randrange(len(text) // 2, len(text) - 1)
            if not re.search(r"[.!?]\W*$", text[:at]) and text[at - 1] != " ":
                text = text[:at]
                cut.add(r.chunk_id)
        rows.append((r.chunk_id, text, r.source_method, r.language, None))
    df = spark.createDataFrame(rows, "chunk_id string, page_content string, source_method string, language string, ingested_at timestamp")
    none = spark.createDataFrame([], "result_id long, summary string, client string, emitted_at timestamp")
    return df, none, rows, cut


def test_cut_at_random(spark, data):
    """Whole texts cut at random inside a sentence are found, and texts left whole are not."""
    df, none, rows, cut = some_cut(spark, data, False)
    _, got = truncation.cut_records(df, none)
    found = {r.record_key for r in got.collect()}
    print(len(rows), len(cut), len(found & cut), len(found - cut))
    assert len(cut) > 5 and len(found & cut) >= 0.85 * len(cut) and len(found - cut) <= 0.02 * len(rows)
    rate = truncation.cut_rates(df, none).agg(F.sum("records"), F.sum("cut_records")).first()
    assert tuple(rate) == (len(rows), len(found))


def test_the_model_decides(spark, data):
    """Without the model's counts nearly no cut text is found; by the marks of sentences alone whole lists would be cut."""
    df, none, rows, cut = some_cut(spark, data, True)
    blank = {k: v * 0 for k, v in truncation.train(truncation.values(df, none)).items()}
    _, got = truncation.cut_records(df, none, blank)
    assert len({r.record_key for r in got.collect()} & cut) < 0.1 * len(cut)
    by_marks = {r[0] for r in rows if not truncation.END.search(r[1])} - cut
    _, got = truncation.cut_records(df, none)
    wrong = {r.record_key for r in got.collect()} & by_marks
    print(len(by_marks), len(wrong))
    assert len(by_marks) > 20 and len(wrong) < 0.3 * len(by_marks)


@pytest.mark.parametrize(("line", "kind"), [("It ends here.", "prose"), ("2. Closed sessions", "item"), ("- a press pass", "item"), ("See also: https://a.example/x", "link"), ("— Ann Lee, Officer", "signature"), ("Notes on Fee Disputes in Arbelport", "title"), ("the city auditor wen", "prose"), ("Topic: court access", "field"), ('He said "stop."', "prose")])
def test_forms(line, kind):
    assert truncation.FORMS[truncation.form(line, False)] == kind


def test_marks_of_cutting():
    assert truncation.end_of("the city aud…", False)[0::2] == ("the city aud", True) and truncation.end_of("the fee &am", False)[3]
    assert truncation.end_of("Up 5 % [...]", False)[:3] == ("up 5 %", 0, True) and not truncation.end_of("It is so.", False)[2]


def test_valley():
    import numpy as np

    counts = np.zeros(32, dtype=int)
    counts[[7, 8, 9, 24, 25, 26]] = [20, 50, 20, 200, 900, 200]
    assert -1.5 < truncation.valley(counts) < 2 and abs(truncation.valley(counts * 0)) < 0.2


# 2


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n,é́", max_size=300), st.integers(1, 60), st.integers(0, 40))
def test_split(text, limit, overlap):
    cuts = splitting.split(text, limit, overlap)
    back = overlap if limit > 2 * overlap else limit // 2
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text) and all(e - b <= limit for b, e in cuts)
    assert all(c == b - back and d > b for (_, b), (c, d) in zip(cuts, cuts[1:]))
    assert text[: cuts[0][1]] + "".join(text[b + back : e] for b, e in cuts[1:]) == text


def test_split_at_sentences():
    text = "One sentence here. Another sentence there. " * 20
    cuts = splitting.split(text, 200, 20)
    assert all(text[:e].endswith(". ") for _, e in cuts)
    assert len(splitting.split("x" * 10_000, 512, 32)) == 21


# 3


def test_page(spark):
    title = "Notes on Fee Disputes in Arbelport 2010 No 0d1"
    sentence = "the county auditor released the meeting minutes before the spring session and asked for"
    body = [f"On page {i} {sentence}" for i in range(6)]
    rows = [(f"c{i}", f"Notes on Fee Disputes in Arbelport 2010 — working copy\n{body[i]}\na certified copy of the rele-\nase in Tamselport, where the aud1tor said so again.\nPage {i + 3} of 20", title, "pdf", "s", None) for i in range(6)]
    rows += [(f"d{i}", f"{sentence} release again.\n\nAnother paragraph about the auditor of Tamselport and internal-\naffairs files, with internal affairs in it.", "Other", "pdf", "t", None) for i in range(30)]
    df = spark.createDataFrame(rows, "chunk_id string, page_content string, title string, type string, source string, ingested_at timestamp")
    _, _, found = scan_noise.findings(df)
    got = defaultdict(set)
    for r in found.collect():
        got[r.chunk_id].add(r.noise_kind)
    assert all(got[f"c{i}"] == {"header", "page_number", "hyphen", "misread"} for i in range(6)), got
    assert not any(k.startswith("d") for k in got)
    text = scan_noise.repaired(df).where("chunk_id = 'c2'").first().text
    assert text == f"On page 2 {sentence} a certified copy of the release in Tamselport, where the auditor said so again."


def test_trained_model_beats_its_seeds():
    """A running header that is misread recurs nowhere, so the patterns miss it; what stands beside it tells the model."""
    import numpy as np

    rng = random.Random(3)
    lines, many, truth = [], [], []
    for i in range(600):
        lone = i % 5 == 0  # the header's text is on no other page
        page = [((0, 0, 1, 0, 1, 0 if lone else 2, 1, 2, 0), scan_noise.H), ((1, scan_noise.FORMS.index("bare"), 3, 0, 2, 0, 1, 1, 0), scan_noise.N)]
        body = [((2 if k == 0 else 6, 0, 0, 0, 1, 0, 0, 0, 0), scan_noise.T) for k in range(rng.randrange(2, 9))]
        page += [*body, ((5, 0, 0, 1, 0, 0, 2, 3, 0), scan_noise.K)]
        if i % 3 == 0:  # a title within a page, of the same form
            page.insert(4, ((6, 0, 1, 0, 0, 0, 1, 1, 0), scan_noise.K))
        lines += [f for f, _ in page]
        truth += [t for _, t in page]
        many.append(len(page))
    f, many, truth = np.array(lines, dtype=np.uint8), np.array(many), np.array(truth)
    seeds, model = scan_noise.first_labels(f), scan_noise.fit(f, many).label(f, many)

    def right(labels):
        return sum((labels == truth)[truth == s].sum() for s in (scan_noise.H, scan_noise.N)) / (truth < 2).sum(), (labels[truth > 2] < 3).sum()

    print(right(seeds), right(model))
    assert right(seeds)[0] < 0.93 and right(model)[0] > 0.98 and right(model)[1] == 0
    assert (np.bincount(model, minlength=5)[[scan_noise.T, scan_noise.K]] > 0).all()


def test_likelihood_rises():
    """Forward-backward agrees with a sum over all paths, and a round of it doesn't lower the likelihood."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    many = np.array([3, 1, 2])
    f = np.stack([rng.integers(0, v, 6) for v in scan_noise.VALUES], axis=1).astype(np.uint8)
    model = scan_noise.Model([rng.random((v, 5)) * 9 for v in scan_noise.VALUES], rng.random((7, 7)) * 9)
    e, at, want = model.emissions(f), 0, 0.0
    for n in many:
        paths = [model.move[5, p[0]] + model.move[p[-1], 6] + sum(e[at + i, s] for i, s in enumerate(p)) + sum(model.move[a, b] for a, b in zip(p, p[1:])) for p in itertools.product(range(5), repeat=int(n))]
        best = max(itertools.product(range(5), repeat=int(n)), key=lambda p: model.move[5, p[0]] + model.move[p[-1], 6] + sum(e[at + i, s] for i, s in enumerate(p)) + sum(model.move[a, b] for a, b in zip(p, p[1:])))
        assert tuple(model.label(f, many)[at : at + n]) == best
        want += np.logaddexp.reduce(paths)
        at += n
    emitted, moved, like = model.expected(f, many)
    assert abs(like - want) < 1e-9 and abs(moved.sum() - 9) < 1e-9 and abs(emitted[0].sum() - 6) < 1e-9


def test_lines_are_read():
    """Features of every line, those in the middle and blank ones included."""
    text = "THE COUNTY REPORT\n12\nthe first line of it goes on to\nthe second line, which is long\nand ends here.\n\nChapter 4\nthe next one starts and then it goes\nPage 7\non."
    f, many, lines, hashes = scan_noise.read_lines(["s", "s"], ["T", None], [text, ""])
    forms = [scan_noise.FORMS[x] for x in f[:, scan_noise.FORM]]
    assert many.tolist() == [10, 1] and forms == ["text", "bare", "text", "text", "text", "blank", "numbered", "text", "strong", "text", "blank"]
    assert f[:10, scan_noise.PLACE].tolist() == [0, 1, 2, 6, 6, 6, 6, 3, 4, 5] and f[2, scan_noise.NEXT] == 0 and f[4, scan_noise.NEXT] == 4
    assert 0 in lines and len(hashes) == len(lines)


def test_two_letter_misreads(spark):
    rows = [("a", "This is what the panel read 0N shield statutes in the spring session."), ("b", "This is what the panel gave t0 the editor in the spring session."), ("c", "This is what the panel wrote as draft v2 in the spring session.")]
    rows += [(f"d{i}", f"Notes on the guide to prior restraint, as given to editor number {i} on shield statutes.") for i in range(10)]
    df = spark.createDataFrame(rows, "chunk_id string, page_content string").selectExpr("*", "'T' as title", "'pdf' as type", "'s' as source", "timestamp'2024-01-01' as ingested_at")
    got = {(r.chunk_id, r.a, r.b) for r in scan_noise.findings(df)[2].where("noise_kind = 'misread'").collect()}
    assert got == {("a", "0n", "on"), ("b", "t0", "to")}
    text = {r.chunk_id: r.text for r in scan_noise.repaired(df).collect()}
    assert "read ON shield" in text["a"] and "gave to the" in text["b"] and "v2" in text["c"]


# 4


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


@pytest.fixture(scope="module")
def similar(spark, data):
    rows = latest(read(spark, data, "chunks"), "chunk_id", ["ingested_at"], ["page_content"]).collect()
    sets = {r.chunk_id: s for r in rows if (s := shingles(r.page_content))}
    ids = sorted(sets)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) > 0.6 * len(sets[a] | sets[b])}
    return want, [r.chunk_id for r in rows]


def test_pairs(spark, data, similar):
    want, _ = similar
    assert {tuple(r) for r in queries.p4_found(spark, data).collect()} == want and want


def test_pairs_in_blocks(spark, data, similar):
    """Lists cut into blocks of two give the same pairs."""
    got = near_duplicates.similar_pairs(read(spark, data, "chunks"), "chunk_id", "page_content", "ingested_at", 0.6, block=2)
    assert {tuple(r) for r in got.collect()} == similar[0]


def test_postings_of_13_bytes():
    """Tokens that differ in their upper bytes only make a pair a candidate and lose none; a posting takes no more room than that."""
    n, low = 1_000, np.arange(1_000, dtype=np.uint64)
    docs = [(1, 1, n, np.zeros(6, "<u8")), (2, 2, n, np.zeros(6, "<u8"))]
    tokens = [low, low + np.uint64(1 << 40)]
    place, none = np.arange(n), np.zeros(n, dtype=np.uint64)
    batch = near_duplicates._packed(docs, [(t, np.full(n, i), place, none, none) for i, t in enumerate(tokens)], np.arange(1))
    raw = batch.column(1)[0].as_py()
    assert len(raw) <= 13 * 2 * n + 2 * 72 + 8
    pairs = list(near_duplicates._pairs(*near_duplicates._unpacked([raw]), 0.6))
    assert {(int(a), int(b)) for (a, _), (b, _) in pairs for a, b in zip(a, b, strict=True)} == {(1, 2)}


def test_families(spark):
    """Two families whose shortest lists are private to each: the pairs between them are met in longer lists."""
    common = [f"c{i}" for i in range(162)]
    rows = []
    for f in "ab":
        for i in "xy":
            rows.append((f + i, " ".join([*common, *(f"{f}{j}" for j in range(40)), f"{f}{i}1", f"{f}{i}2"])))
    # 160 common sequences, 40 of the family, 2 that end in words of the record's own
    sets = {k: shingles(t) for k, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) > 0.6 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(rows, "k string, t string").withColumn("o", F.lit(1))
    got = near_duplicates.similar_pairs(df, "k", "t", "o", 0.6)
    assert {tuple(r) for r in got.collect()} == want and len(want) == 6
    assert {(r.group_id, r.links) for r in near_duplicates.groups(df, "k", "t", "o", 0.6).collect()} == {("ax", 3)}


def test_hot_group(spark):
    """A third of all rows are one text; they are one class, and each is in one row of the groups."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    one = " ".join(rng.choice(words) for _ in range(60))
    rows = [(f"h{i:03}", one) for i in range(60)] + [(f"x{i:03}", " ".join(rng.choice(words) for _ in range(60))) for i in range(120)] + [("near", one + " and more")]
    df = spark.createDataFrame(rows, "k string, t string").withColumn("o", F.lit(1))
    got = {r.k: (r.group_id, r.links) for r in near_duplicates.groups(df, "k", "t", "o", 0.6).collect()}
    assert len(got) == len(rows) and got["near"] == ("h000", 60) and got["h010"] == ("h000", 60) and got["x000"] == ("x000", 0)


def test_groups(spark, data, similar):
    want, ids = similar
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in want:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    links = Counter(x for pair in want for x in pair)
    got = {r.chunk_id: (r.group_id, r.links) for r in queries.p4_groups(spark, data).collect()}
    assert got == {i: (find(i), links[i]) for i in ids}


# 5

CAPTIONS = ["[00:00:01] Ann Lee: Thank you uh, Bo, and", "so on. &gt;&gt; BO Tall: As Ann put it: ask", "(laughter) for it. [Ann Lee] right? Fine", "by me. Tall, Bo - That reminds me of what Ann told me - call", "cara m: no punctuation here bt: yes", "Ann Lee: Again. Ann Lee: and again", "Speaker (Cara Moss): hi. Moderator Bo Tlal: My advice: go"]


@pytest.mark.parametrize("window", [600, 2])
def test_turns(spark, window):
    df = spark.createDataFrame([(i, "v", t, float(i), None) for i, t in enumerate(CAPTIONS)], "entry_id long, video_id string, text string, start double, ingested_at timestamp")
    speakers = spark.createDataFrame([("a", "Ann Lee"), ("b", "Bo Tall"), ("c", "Cara Moss")], "speaker_key string, full_name string")
    got = [(r.entry_id, r.speaker_key) for r in speaker_turns.turn_starts(df, speakers, window).collect()]
    assert sorted(got) == [(0, "a"), (1, "b"), (2, "a"), (3, "b"), (4, "b"), (4, "c"), (5, "a"), (6, "b"), (6, "c")]
    text = defaultdict(str)
    for r in speaker_turns.turns(df, speakers, window).orderBy("turn_no", "part_no").collect():
        text[r.turn_no] = f"{text[r.turn_no]} {r.text}".strip()
    assert text[1] == "Thank you Bo, and so on." and text[2] == "As Ann put it: ask for it." and text[7] == "Again. and again"


def test_accented_labels(spark):
    said = ["JOSÉ ÁLVAREZ: Good evening.", "[Żak] I agree.", "José: and so on.", "Naïve: isn't a name."]
    df = spark.createDataFrame([(i, "v", t, float(i), None) for i, t in enumerate(said)], "entry_id long, video_id string, text string, start double, ingested_at timestamp")
    speakers = spark.createDataFrame([("a", "José Álvarez"), ("b", "Ola Żak")], "speaker_key string, full_name string")
    assert sorted((r.entry_id, r.speaker_key) for r in speaker_turns.turn_starts(df, speakers).collect()) == [(0, "a"), (1, "b"), (2, "a")]


# 6 and 7


def test_packing(spark, data):
    done = queries.p6_packed(spark, data).collect()
    fill, got = Counter(), defaultdict(list)
    for r in done:
        fill[r.container_kind, r.container_id, r.capacity] += r.tokens
        got[r.container_kind, r.doc_id].append((r.begin_token, r.tokens))
    assert all(v <= k[2] for k, v in fill.items())
    sizes = {r.doc_id: tokens.count(r.text) for r in read(spark, data, "documents").where("text <> ''").collect()}
    for kind, capacity in {(k[0], k[2]) for k in fill}:
        for doc, n in sizes.items():
            parts = sorted(got[kind, doc])
            assert sum(p for _, p in parts) == n and len(parts) == -(-n // capacity) and [b for b, _ in parts] == [i * capacity for i in range(len(parts))]
        least = -(-sum(sizes.values()) // capacity)
        assert sum(k[0] == kind for k in fill) <= least * 1.03 + 1


def test_crossover_keeps_items():
    rng = random.Random(5)
    sizes = [rng.randrange(1, 60) for _ in range(200)]
    a, b = (packing.evolve(sizes, 100, [], s, 3, 0)[0] for s in (1, 2))
    child = packing.crossed(a, b, rng)
    assert sorted(i for x in child.bins for i in x) == list(range(200)) and max(child.fills) <= 100 and child.fills == [sum(child.sizes[i] for i in x) for x in child.bins]


def test_budgets_move_to_siblings():
    w = {("d", "en", "a"): 0.4, ("d", "en", "b"): 0.2, ("d", "fr", "a"): 0.2, ("d", "fr", "b"): 0.2}
    got = mixing.spread(w, {("d", "en", "a"): 10, ("d", "en", "b"): 100, ("d", "fr", "a"): 100, ("d", "fr", "b"): 100}, 100)
    assert got == pytest.approx({("d", "en", "a"): 10, ("d", "en", "b"): 50, ("d", "fr", "a"): 20, ("d", "fr", "b"): 20})
    got = mixing.spread(w, {("d", "en", "a"): 10, ("d", "en", "b"): 20, ("d", "fr", "a"): 100, ("d", "fr", "b"): 100}, 100)
    assert abs(sum(got.values()) - 100) < 1e-6 and abs(got[("d", "fr", "a")] - 35) < 1e-6


def test_mixing(spark, data):
    docs, targets = read(spark, data, "documents"), read(spark, data, "mix_targets")
    uses, one = mixing.mixed(docs, targets)
    most = {r.source: r.max_repeats for r in targets.collect()}
    rows = uses.collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len({texts[r.doc_id] for r in rows}) == len(rows) and all(1 <= r.uses <= most[r.source] for r in rows)
    shares = mixing.shares(uses, one).collect()
    assert abs(sum(r.actual_share for r in shares) - 1) < 1e-4
    # what is missing of a share is less than a text in each language
    total = sum(r.tokens for r in shares)
    assert all(abs(r.actual_share - r.target_share) < 4000 / total for r in shares)


def test_mixing_all(spark, data):
    """As many tokens as there are: what small sources lack goes to others, and no text is used too often."""
    docs, targets = read(spark, data, "documents"), read(spark, data, "mix_targets")
    uses, told = mixing.mixed(docs, targets, "all")
    rows = {r.source: r for r in mixing.shares(uses, told).collect()}
    default = {r.source: r for r in mixing.shares(*mixing.mixed(docs, targets)).collect()}
    assert sum(r.tokens for r in rows.values()) > sum(r.tokens for r in default.values())
    short = [r for r in rows.values() if r.actual_share < r.target_share - 0.005]
    more = [r for r in rows.values() if r.actual_share > r.target_share + 0.002]
    assert short and more and all(r.most_uses <= max(1, r.max_repeats) for r in rows.values())


# 8

CHAINS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp1251"), ("utf-8", "cp1250")]


def test_garbled_round_trip(spark):
    text = "El comité añadió 12 preguntas según la petición de “Arbelport” — así terminó la sesión"
    foreign = "«Открытые данные» Σας ευχαριστώ NÃO ÂNGULO CHÂTEAU Ω ≤ √ ├── fees"
    rows = [(i, text, "es") for i in range(20)] + [(50, foreign, None)]
    for k, (a, b) in enumerate(CHAINS):
        rows.append((100 + k, garbled.read_as(text.encode(a), b), "es"))
    twice = garbled.read_as(garbled.read_as(text.encode(), "cp1252").encode(), "cp1252")
    rows += [(110, twice, "es"), (111, text.encode("cp1252").decode("utf-8", "replace"), "es"), (112, "Plain text, as it was.".encode().decode("utf-16-le"), "en"), (113, garbled.read_as(text.encode("cp1252"), "cp1251"), "es")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.text for r in garbled.restored(df).collect()}
    assert set(got) == {*range(100, 106), 110, 111, 112, 113}
    assert all(got[k] == text for k in got if k not in (112, 113)), got
    assert got[112] == "Plain text, as it was." and "añadió" in got[113]


@pytest.mark.parametrize("written", ["iso8859-2", "cp852"])
def test_garbled_polish(spark, written):
    text = "Książka została zamknięta, jaśniej: wejście od północy"
    rows = [(i, text) for i in range(20)] + [(50, garbled.read_as(text.encode(written), "cp1252"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in garbled.restored(df).collect()} == {50: text}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, data, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got = queries.queries()[name](spark, data)
    want = con.execute(queries.oracle_sql()[name])
    assert got.columns == [d[0] for d in want.description] and Counter(map(tuple, got.collect())) == Counter(want.fetchall())


def test_registered_names():
    assert {f"p{n}" for n in range(1, 9)} == {name.split("_")[0] for name in queries.queries()}
