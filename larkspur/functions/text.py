"""Column functions for titles, links, labels and prompts. All stay in the JVM; a null argument gives null unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the client shows, and the words that errors and labels are told by.
SITE_LABEL = "Site"
WAITING = "/waiting_room"
RESTRICTED = ["private", "premium_only", "subscriber_only"]
NO_DOCUMENTS = "No documents available"
NOTHING_FOUND = "No relevant documents found."
UNKNOWN_SOURCE = "Unknown Source"
UNKNOWN_TYPE = "unknown"
NO_TITLE = "Title not found"
NO_TRANSCRIPT_NOTE = "This video does not have transcripts available"
NO_TRANSCRIPT = "Note: No transcript available for this video."
VIDEO_HOSTS = ("www.youtube.com", "youtube.com")
METHODS = ["multiquery", "decompose", "stepback", "hyde", "ragfusion"]
LANGUAGE_ORDER = ["en", "en-US", "en-GB", "en-orig"]


def normal_title(path: Column) -> Column:
    """File name without its last four characters, trimmed, underscores as spaces, one pass of two spaces to one."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.trim(F.substring(name, F.lit(1), F.greatest(F.length(name) - 4, F.lit(0))))
    return F.replace(F.replace(stem, F.lit("_"), F.lit(" ")), F.lit("  "), F.lit(" "))


def is_blank(value: Column) -> Column:
    """True for null and for nothing but white space."""
    return ~F.coalesce(value.rlike(r"\S"), F.lit(False))


def is_url(value: Column) -> Column:
    """False for null."""
    return F.coalesce(value.startswith("http"), F.lit(False))


def video_id(url: Column, hosts: tuple[str, ...] = VIDEO_HOSTS) -> Column:
    """The video a link names: youtu.be/x, and watch?v=x, /embed/x and /v/x on the main hosts; null for any other."""
    host, path = F.try_parse_url(url, F.lit("HOST")), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    main = host.isin(*hosts)
    named = F.when(F.size(F.split(path, "/")) >= 3, F.nullif(F.get(F.split(path, "/"), F.lit(2)), F.lit("")))
    return (
        F.when(host == "youtu.be", F.nullif(F.substring(path, 2, 1_000_000), F.lit("")))
        .when(main & (path == "/watch"), F.nullif(F.try_parse_url(url, F.lit("QUERY"), F.lit("v")), F.lit("")))
        .when(main & (path.startswith("/embed/") | path.startswith("/v/")), named)
    )


def first_removed(text: Column, part: str = WAITING) -> Column:
    """The text without the first occurrence of a part."""
    at = F.instr(text, part)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + len(part), F.length(text)))).otherwise(text)


def deep_link(source: Column, kind: Column, seconds: Column) -> Column:
    """A recording's link with its start, unrounded; plain for other kinds and for a start that is null or 0. A null source is empty."""
    plain = F.coalesce(source, F.lit(""))
    timed = (kind == "youtube") & (F.coalesce(seconds, F.lit(0.0)) != 0)
    return F.when(timed, F.concat(plain, F.lit("&t="), seconds.cast("string"), F.lit("s"))).otherwise(plain)


def source_tag(kind: Column, link: Column) -> Column:
    video = (F.coalesce(kind, F.lit("")) == "youtube") | F.coalesce(F.lower(link).contains("youtube"), F.lit(False))
    return F.when(video, "YouTube").otherwise(SITE_LABEL)


def time_label(seconds: Column) -> Column:
    """m:ss of whole seconds; null for null and 0."""
    whole = F.floor(seconds)
    return F.when(whole > 0, F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0")))


def shown(value: Column) -> Column:
    """Null as the word None, as prompts print it."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def document_block(content: Column, title: Column, kind: Column, link: Column, seconds: Column, summary: Column) -> Column:
    """A document as prompts show it, a line for each field; only recordings have seconds."""
    kind = F.coalesce(kind, F.lit(UNKNOWN_TYPE))
    lines = {"content": content, "title": F.coalesce(title, F.lit(UNKNOWN_SOURCE)), "type": kind, "link": link, "timestamp_seconds": F.when(kind == "youtube", seconds), "summary": summary}
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), shown(v)) for k, v in lines.items()])


def availability(state: Column, error: Column) -> Column:
    """available, restricted, private, unavailable, deleted or access_error, tested in this order of the error's text; a null state without error is available."""
    by_error = F.when(error.contains("Private video"), "private").when(error.contains("Video unavailable"), "unavailable").when(F.lower(error).contains("deleted"), "deleted").otherwise("access_error")
    return F.when(error.isNotNull(), by_error).when(state.isin(*RESTRICTED), "restricted").otherwise("available")


def error_class(error: Column) -> Column:
    low = F.lower(error)
    named = F.when(low.contains("disabled"), "disabled").when(low.contains("unavailable"), "unavailable").when(low.contains("private"), "private").when(low.contains("no element found"), "retry").otherwise("other")
    return F.when(error.isNotNull(), named)


def language_rank(language: Column, generated: Column) -> Column:
    """Smaller is preferred: the four kinds of English, then any manual track, then any generated one."""
    rank = F.when(F.coalesce(generated, F.lit(False)), 5).otherwise(4)
    for i, code in reversed(list(enumerate(LANGUAGE_ORDER))):
        rank = F.when(language == code, i).otherwise(rank)
    return rank


def split_lines(text: Column, drop_blank: bool) -> Column:
    lines = F.split(text, "\n")
    return F.filter(lines, lambda x: F.trim(x) != "") if drop_blank else lines


def method_of(label: Column) -> Column:
    """First strategy whose name is in the label, else multiquery; a null label is multiquery."""
    out = F.lit("multiquery")
    for name in reversed(METHODS):
        out = F.when(label.contains(name), name).otherwise(out)
    return out


def intent_of(label: Column) -> Column:
    return F.when(F.lower(label).contains("document request"), "retrieval").otherwise("general")


def url_component(value: Column) -> Column:
    """Percent-encoding of a query value as browsers do it: all but letters, digits and - _ . ! ~ * ' ( ) is encoded, in UTF-8."""
    out = F.url_encode(value)
    for code, char in {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}.items():
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def metadata_text(title: Column, url: Column, description: Column, uploader: Column, duration: Column, tags: Column) -> Column:
    """The text that stands for a recording without transcript; empty and null parts are left out."""
    def given(value: Column) -> Column:
        return F.coalesce(value, F.lit("")) != ""

    about = F.when(F.length(description) > 500, F.concat(F.left(description, F.lit(500)), F.lit("..."))).otherwise(description)
    minutes = F.concat(F.floor(duration / 60).cast("string"), F.lit("m "), F.pmod(duration, F.lit(60)).cast("string"), F.lit("s"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("YouTube video: "), F.coalesce(title, F.lit(NO_TITLE))),
        F.concat(F.lit("URL: "), url),
        F.when(given(description), F.concat(F.lit("Description: "), about)),
        F.when(given(uploader), F.concat(F.lit("Channel: "), uploader)),
        F.when(F.coalesce(duration, F.lit(0)) != 0, F.concat(F.lit("Duration: "), minutes)),
        F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(F.slice(tags, 1, 10), ", "))),
        F.lit(NO_TRANSCRIPT),
    )
