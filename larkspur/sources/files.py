"""File sources and sinks: PDF pages, URL lists, stored tables, work lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import normal_title
from larkspur.operators.chunking import two_level_chunks
from larkspur.session import materialize


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the PDF files of a folder, not of those below it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", "content")


def form_feed_pages(content: bytes) -> list[str]:
    """Stand-in for a PDF parser: text whose pages are divided by form feeds."""
    return content.decode("utf-8", "replace").split("\f")


def _parsed(files: DataFrame, parse: Callable[[bytes], list[str]]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in frame[["path", "content"]].itertuples(index=False):
                try:
                    rows += [(path, float(i), text, None) for i, text in enumerate(parse(content))]
                except Exception as e:  # noqa: BLE001 - one bad file mustn't end the load
                    rows.append((path, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["source", "page", "page_content", "error"])

    return files.mapInPandas(run, "source string, page double, page_content string, error string")


def pdf_pages(files: DataFrame, parse: Callable[[bytes], list[str]] = form_feed_pages) -> DataFrame:
    """(title, type, source, page, page_content): one row per page, pages from 0. A file that can't be parsed gives none."""
    pages = _parsed(files, parse).where("error is null")
    return pages.select(normal_title(F.col("source")).alias("title"), F.lit("pdf").alias("type"), "source", "page", "page_content")


def pdf_errors(files: DataFrame, parse: Callable[[bytes], list[str]] = form_feed_pages) -> DataFrame:
    """(source, error) of the files that can't be parsed."""
    return _parsed(files, parse).where("error is not null").select("source", "error")


def pdf_chunks(files: DataFrame, parse: Callable[[bytes], list[str]] = form_feed_pages) -> DataFrame:
    """(title, type, source, page, part_no, chunk_no, chunk): pages cut to 4,000 characters for storing, and these to 512 for the index."""
    return two_level_chunks(pdf_pages(files, parse), "page_content", "title", "type", "source", "page")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url): trimmed lines that aren't blank. Lines that are no URL stay and are for the caller to report."""
    return spark.read.text(path).select(F.trim("value", F.lit(" \t\r\n")).alias("url")).where("url <> ''")


def append(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Add immutable files to a table: a load costs what it adds, whatever is there already."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def upsert(df: DataFrame, path: str, key: str, parts: int = 64) -> None:
    """Replace all rows of the keys in df by those of df, the last write of a key winning; other keys' rows stay.

    The table is partitioned by the key's hash, and only the partitions that df falls into are read and written.
    """
    spark = df.sparkSession
    new = df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        touched = [r["part"] for r in new.select("part").distinct().collect()]  # at most `parts`
        stored = spark.read.schema(new.schema).parquet(path).where(F.col("part").isin(touched))
        new = materialize(stored.join(new.select("part", key).distinct(), ["part", key], "left_anti").unionByName(new), "upsert")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def split_outcome(tried: DataFrame, finished: str, waiting: str) -> None:
    """Write URLs that loaded to `finished` and all others, those that are no URL included, to `waiting`."""
    ok = F.coalesce("ok", F.lit(False))
    tried.where(ok).select("url").write.mode("append").text(finished)
    tried.where(~ok).select("url").write.mode("overwrite").text(waiting)


def facets_of_path(df: DataFrame, path: str) -> DataFrame:
    """Adds audience, content and resource from folders named by_<facet>/<value>/ in a path; null where there is none."""
    for name, folder in (("audience", "by_audience"), ("content", "by_content"), ("resource", "by_resource")):
        df = df.withColumn(name, F.nullif(F.regexp_extract(path, f"{folder}/([^/]+)/", 1), F.lit("")))
    return df
