"""Speech transcripts into clean speaker turns, in SQL expressions and windows only.

Labels are found by a pattern, resolved by a hash join with the written forms of each speaker's name, filled
forward by windows, and consecutive pieces of one speaker become a turn by gaps-and-islands numbers.

A video of any length is handled in windows of `window_s` seconds: forward filling and numbering run within a
window, and only each window's last speaker and number of turns are carried over a video. So no task sees more of a
video than a window and a summary row for each other one. A turn's text comes in parts, one for each window it
touches, for the same reason.

Defined results: entries without key, video or start are dropped; a null or empty text holds no label and no words;
an entry that occurs again counts once, with its latest row; ties in start go by entry id. Words before a video's
first label belong to turn 0, whose speaker is null. A label that names nobody in `speakers` stays text. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import materialize
from larkspur.tables import latest

# What captions put between the words of speech.
FILLERS = ["uh-huh", "uhm", "um", "uh", "erm", "er", "hmm", "you know", "i mean", "sort of", "kind of", "okay so", "(?<!the )right\\??", "like"]
CLOCK = r"\[\d+:\d\d(?::\d\d)?\]|\(\d+:\d\d(?::\d\d)?\)|(?<!\S)\d+:\d\d(?::\d\d)?(?:\s+[-–]\s)|(?<!\S)\d+:\d\d:\d\d(?!\S)"
SOUND = r"(?i)<i>[^<]*</i>|\*[^*\n]{1,60}\*|♪[^♪]*♪|♪|\[(?:inaudible|crosstalk|unintelligible)[^\]]*\]"
# A label is a name between brackets, a name before a colon, or surname and first name before a dash.
LABEL = (
    r"(?i)(?:(?:>>+|-)\s*)?"
    r"(?:\[\s*([\p{L}][\p{L}.' -]*?)\s*\]|speaker\s*\(\s*([\p{L}][\p{L}.' -]*?)\s*\)\s*:|(?<![\p{L}'-])((?:[\p{L}]+\.?\s+){0,2}[\p{L}]+\.?)\s*:|(?<![\p{L}'-])([\p{L}]+,?\s+[\p{L}]+)\s+[-–](?=\s))(?=\s|$)"
)


def name_forms(speakers: DataFrame) -> DataFrame:
    """(form, speaker_key): how labels write a name, and each form of five letters or more with two neighbours swapped or one letter left out.

    A form that would name two speakers is left out. Speakers without a full name of two words have no forms.
    """
    name = F.split(F.lower(F.trim("full_name")), r"\s+")
    first, last = F.element_at(name, 1), F.element_at(name, -1)
    whole = F.concat_ws(" ", first, last)
    plain = speakers.where(F.size(name) >= 2).select(
        "speaker_key",
        F.explode(
            F.array(
                whole,
                F.concat_ws(" ", last, first),
                F.concat_ws(" ", F.left(first, F.lit(1)), last),
                F.concat_ws(" ", first, F.left(last, F.lit(1))),
                F.concat(F.left(first, F.lit(1)), F.left(last, F.lit(1))),
                first,
                last,
            )
        ).alias("form"),
    )
    n = F.length("form")
    swapped = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.substring("form", F.lit(1), i - 1), F.substring("form", i + 1, F.lit(1)), F.substring("form", i, F.lit(1)), F.substring("form", i + 2, n)))
    dropped = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring("form", F.lit(1), i - 1), F.substring("form", i + 1, n)))
    wrong = plain.where(n >= 5).select("speaker_key", F.explode(F.concat(swapped, dropped)).alias("form")).join(plain.select("form"), "form", "left_anti")
    forms = plain.unionByName(wrong).distinct()
    return forms.groupBy("form").agg(F.min("speaker_key").alias("speaker_key"), F.countDistinct("speaker_key").alias("named")).where("named = 1").drop("named")


def without_noise(text: Column) -> Column:
    """Entities decoded, clock times and sound notes removed; labels and words stay."""
    out = text
    for entity, char in (("&gt;", ">"), ("&lt;", "<"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.regexp_replace(out, f"(?i){entity}", char)
    out = F.regexp_replace(out, CLOCK, " ")
    out = F.regexp_replace(out, SOUND, " ")
    out = F.regexp_replace(out, r"(?i)(?<!speaker)(?<!speaker )\((?=[a-z ]{4,40}\))[a-z]+(?: [a-z]+)*\)", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def clean_words(text: Column) -> Column:
    """Bracketed notes and fillers removed, spacing mended, text all in capitals put into small letters."""
    out = F.regexp_replace(text, r"\[[^\]]*\]", " ")
    out = F.regexp_replace(out, r"(?i)(?<![\w'-])(?:" + "|".join(FILLERS) + r"),?(?![\w'-])", " ")
    out = F.regexp_replace(out, r">>+", " ")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"\s+([,.;:?!])", "$1"))
    out = F.regexp_replace(out, r"^[,;]\s*", "")
    shout = (out == F.upper(out)) & (F.length(out) > 3)
    return F.when(shout, F.concat(F.upper(F.left(out, F.lit(1))), F.lower(F.substring(out, 2, 1_000_000_000)))).otherwise(out)


def pieces(transcript: DataFrame, speakers: DataFrame, window_s: int) -> DataFrame:
    """(video_id, entry_id, start, win, pos, speaker_key, words): each entry cut at its labels; speaker_key only where a label is."""
    rows = latest(transcript, "entry_id", ["ingested_at"], ["video_id", "start", "text"])
    rows = rows.where(F.col("video_id").isNotNull() & F.col("start").isNotNull() & ~F.isnan("start"))
    marked = F.regexp_replace(without_noise(F.coalesce("text", F.lit(""))), LABEL, "\u0001$1$2$3$4\u0002$0\u0003")
    cut = rows.select("video_id", "entry_id", "start", F.floor(F.col("start") / window_s).alias("win"), F.posexplode(F.split(marked, "\u0001")).alias("pos", "raw"))
    has = F.instr("raw", "\u0002") > 0
    cut = cut.select(
        "video_id", "entry_id", "start", "win", "pos",
        F.when(has, F.split(F.trim(F.substring_index("raw", "\u0002", 1)), r"\s+")).alias("said"),
        F.when(has, F.substring_index(F.substring_index("raw", "\u0003", 1), "\u0002", -1)).alias("written"),
        F.when(has, F.substring_index("raw", "\u0003", -1)).otherwise(F.col("raw")).alias("rest"),
    )
    n = F.size("said")
    cut = cut.withColumn("label", F.transform("said", lambda w: F.regexp_replace(F.lower(w), "[.,]", "")))
    forms = name_forms(speakers)
    forms = F.broadcast(forms) if speakers.count() <= 1000 else forms  # about 90 forms a speaker
    for words in (3, 2, 1):
        key = F.when(n >= words, F.array_join(F.slice("label", n - words + 1, words), " "))
        cut = cut.withColumn(f"k{words}", key).join(forms.select(F.col("form").alias(f"k{words}"), F.col("speaker_key").alias(f"s{words}")), f"k{words}", "left")
    speaker = F.when(F.col("s2").isNotNull() | F.col("s3").isNotNull(), F.coalesce("s3", "s2")).otherwise(F.col("s1"))
    used = F.when(F.col("s3").isNotNull(), 3).when(F.col("s2").isNotNull(), 2).otherwise(1)
    # words before the name belong to the speaker before; titles of a label don't
    before = F.when(speaker.isNotNull() & (n > used), F.regexp_replace(F.array_join(F.slice("said", F.lit(1), n - used), " "), r"(?i)(?:^| )(?:moderator|speaker)$", ""))
    cut = cut.select("video_id", "entry_id", "start", "win", "pos", speaker.alias("speaker_key"), before.alias("before"), F.when(speaker.isNotNull(), F.col("rest")).otherwise(F.concat(F.coalesce("written", F.lit("")), "rest")).alias("rest"))
    both = F.array(
        F.struct((F.col("pos") * 2).alias("pos"), F.lit(None).cast("string").alias("speaker_key"), F.col("before").alias("words")),
        F.struct((F.col("pos") * 2 + 1).alias("pos"), F.col("speaker_key").alias("speaker_key"), F.col("rest").alias("words")),
    )
    out = cut.select("video_id", "entry_id", "start", "win", F.explode(both).alias("p")).select("video_id", "entry_id", "start", "win", "p.*")
    return out.where(F.col("speaker_key").isNotNull() | (F.coalesce("words", F.lit("")) != ""))


def turn_pieces(transcript: DataFrame, speakers: DataFrame, window_s: int = 600) -> DataFrame:
    """Pieces with the speaker filled forward, whether a turn starts there, and the turn's number in its video."""
    cut = materialize(pieces(transcript, speakers, window_s), "pieces")
    order = ["start", "entry_id", "pos"]
    inside = Window.partitionBy("video_id", "win").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    over_windows = Window.partitionBy("video_id").orderBy("win").rowsBetween(Window.unboundedPreceding, -1)
    last = cut.where("speaker_key is not null").groupBy("video_id", "win").agg(F.max(F.struct(*order, "speaker_key"))["speaker_key"].alias("last"))
    # within a window, turns as if nobody had spoken before it; the window's first label is set right by the carried speaker
    local = cut.withColumn("prev", F.last("speaker_key", ignorenulls=True).over(before))
    firsts = local.where("speaker_key is not null and prev is null").select("video_id", "win", F.col("speaker_key").alias("first"))
    inner = local.where("speaker_key is not null and prev is not null and speaker_key <> prev").groupBy("video_id", "win").agg(F.count("*").alias("changes"))
    summary = last.join(firsts, ["video_id", "win"]).join(inner, ["video_id", "win"], "left")
    summary = summary.withColumn("carry", F.last("last").over(over_windows))
    summary = summary.withColumn("made", F.coalesce("changes", F.lit(0)) + F.when(F.col("carry") == F.col("first"), 0).otherwise(1))
    summary = summary.withColumn("offset", F.coalesce(F.sum("made").over(over_windows), F.lit(0))).select("video_id", "win", "carry", "offset", "last", "made")
    # windows without any label take what the label before them left
    wins = cut.select("video_id", "win").distinct().join(summary, ["video_id", "win"], "left")
    upto = Window.partitionBy("video_id").orderBy("win").rowsBetween(Window.unboundedPreceding, -1)
    wins = wins.select("video_id", "win", F.last("last", ignorenulls=True).over(upto).alias("carry"), F.coalesce(F.sum("made").over(upto), F.lit(0)).alias("offset"))
    filled = local.join(wins, ["video_id", "win"])
    starts = F.col("speaker_key").isNotNull() & ~F.col("speaker_key").eqNullSafe(F.coalesce("prev", "carry"))
    filled = filled.withColumn("starts", starts)
    return filled.select(
        "video_id", "entry_id", "start", "win", "pos", "words", "starts",
        F.coalesce("speaker_key", "prev", "carry").alias("speaker_key"),
        (F.col("offset") + F.sum(F.col("starts").cast("long")).over(inside)).alias("turn_no"),
    )


def turn_starts(transcript: DataFrame, speakers: DataFrame, window_s: int = 600) -> DataFrame:
    """(video_id, entry_id, speaker_key): one row per turn, with the entry in which its speaker starts."""
    return turn_pieces(transcript, speakers, window_s).where("starts").select("video_id", "entry_id", "speaker_key")


def turns(transcript: DataFrame, speakers: DataFrame, window_s: int = 600) -> DataFrame:
    """(video_id, turn_no, part_no, speaker_key, start, text): clean turns in time order, in parts of one window each."""
    got = turn_pieces(transcript, speakers, window_s).withColumn("words", clean_words(F.col("words")))
    parts = got.groupBy("video_id", "turn_no", "win").agg(
        F.max("speaker_key").alias("speaker_key"),
        F.min("start").alias("start"),
        F.array_sort(F.collect_list(F.when(F.col("words") != "", F.struct("start", "entry_id", "pos", "words")))).alias("list"),
    )
    part_no = F.row_number().over(Window.partitionBy("video_id", "turn_no").orderBy("win"))
    return parts.select("video_id", "turn_no", part_no.cast("int").alias("part_no"), "speaker_key", "start", F.array_join(F.transform("list", lambda x: x["words"]), " ").alias("text"))
