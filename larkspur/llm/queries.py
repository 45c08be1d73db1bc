"""The pN_ queries: callables of (spark, directory of tables), and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import garbled, mixing, near_duplicates, packing, scan_noise, speaker_turns, splitting, truncation
from larkspur.tables import read


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    _, cut = truncation.cut_records(read(spark, directory, "chunks"), read(spark, directory, "search_results"))
    return cut.select("table_name", "record_key")


def p1_rates(spark: SparkSession, directory: str) -> DataFrame:
    return truncation.cut_rates(read(spark, directory, "chunks"), read(spark, directory, "search_results"))


def p2_pieces(spark: SparkSession, directory: str) -> DataFrame:
    return splitting.pieces(read(spark, directory, "chunks"), read(spark, directory, "process_request"), read(spark, directory, "split_limits"))


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    # an item over its limit comes out in two pieces or more, numbered from 0
    return p2_pieces(spark, directory).where("piece_no = 1").select("table_name", "record_key")


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    _, _, found = scan_noise.findings(read(spark, directory, "chunks"))
    return found.select("chunk_id", "noise_kind").distinct()


def p3_repaired(spark: SparkSession, directory: str) -> DataFrame:
    return scan_noise.repaired(read(spark, directory, "chunks"))


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    pairs = near_duplicates.similar_pairs(read(spark, directory, "chunks"), "chunk_id", "page_content", "ingested_at", 0.6)
    return pairs.select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p4_groups(spark: SparkSession, directory: str) -> DataFrame:
    return near_duplicates.groups(read(spark, directory, "chunks"), "chunk_id", "page_content", "ingested_at", 0.6)


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return speaker_turns.turn_starts(read(spark, directory, "transcript"), read(spark, directory, "speakers"))


def p5_turns(spark: SparkSession, directory: str) -> DataFrame:
    return speaker_turns.turns(read(spark, directory, "transcript"), read(spark, directory, "speakers"))


def p6_packed(spark: SparkSession, directory: str) -> DataFrame:
    return packing.packed(read(spark, directory, "documents"), read(spark, directory, "pack_sizes"))


def p6_report(spark: SparkSession, directory: str) -> DataFrame:
    return packing.report(p6_packed(spark, directory))


def p7_mixed(spark: SparkSession, directory: str) -> DataFrame:
    uses, _ = mixing.mixed(read(spark, directory, "documents"), read(spark, directory, "mix_targets"))
    return uses


def p7_shares(spark: SparkSession, directory: str) -> DataFrame:
    return mixing.shares(*mixing.mixed(read(spark, directory, "documents"), read(spark, directory, "mix_targets")))


def p7_all(spark: SparkSession, directory: str) -> DataFrame:
    """The shares of a mix as large as its sources together: small ones fall short, and others fill their place."""
    return mixing.shares(*mixing.mixed(read(spark, directory, "documents"), read(spark, directory, "mix_targets"), "all"))


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    _, found = garbled.findings(read(spark, directory, "documents"))
    return found.select("doc_id").distinct()


def p8_restored(spark: SparkSession, directory: str) -> DataFrame:
    return garbled.restored(read(spark, directory, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [p1_found, p1_rates, p2_found, p2_pieces, p3_found, p3_repaired, p4_found, p4_groups, p5_found, p5_turns, p6_packed, p6_report, p7_mixed, p7_shares, p7_all, p8_found, p8_restored]
    return {query.__name__: query for query in named}


# what SQL can say of the operators' results, in plain terms
P2 = """with a as (select * from chunks where chunk_id is not null qualify row_number() over (partition by chunk_id order by ingested_at desc nulls last, page_content desc nulls last) = 1),
b as (select * from process_request where request_id is not null qualify row_number() over (partition by request_id order by receive_count desc nulls last, sent_at desc nulls last, text desc nulls last) = 1)
select 'chunks' as table_name, chunk_id as record_key from a where length(page_content) > (select max(size_limit) from split_limits where item_table = 'chunks')
union all select 'process_request', request_id::varchar from b where length(text) > case when chunk_size >= 1 then chunk_size else (select max(size_limit) from split_limits where item_table = 'process_request') end"""
P4 = """with c as (select chunk_id, regexp_extract_all(lower(page_content), '[\\p{L}\\p{N}]+') as w from chunks where chunk_id is not null qualify row_number() over (partition by chunk_id order by ingested_at desc nulls last) = 1),
s as (select distinct chunk_id, hash(w[i], w[i + 1], w[i + 2]) as h from (select chunk_id, w, unnest(range(1, len(w) - 1)) as i from c where len(w) > 2)),
n as (select chunk_id, count(*) as n from s group by 1),
m as (select a.chunk_id as x, b.chunk_id as y, count(*) as shared from s a join s b on a.h = b.h and a.chunk_id < b.chunk_id group by all)
select x as chunk_id_a, y as chunk_id_b from m join n p on p.chunk_id = x join n q on q.chunk_id = y where shared > 0.6 * (p.n + q.n - shared)"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2, "p4_found": P4}
