"""Mixing sources to target weights, by hierarchical budgeting.

The tree has the levels domain, language and source; a leaf is one source's texts in one language. Weights go down
from the sources' target shares, a source's share being spread over its languages as its tokens are. A leaf can give
its tokens times its source's repeats; where that is less than its budget, the shortage goes to siblings (sources of the
same language) that can give more, in proportion to their weights, then to other languages of the domain, then to
other domains. From each leaf whole epochs are taken and then a prefix of a last epoch, whose order is a seeded hash.

Without `total_tokens` the total is the largest one at which no source is short, so all shares are met; a larger total
makes small sources fall short, and the report shows it; "all" stands for as many tokens as the targeted sources have. A text counts once, whatever ids it has: it belongs to the
source of its smallest id among sources with a target, and is used at most `max_repeats` times.

The prefix is found in two steps, so that no task sees a whole leaf: sums over 4,096 ranges of the hash tell in which
range a leaf's budget ends, and only that range is ordered.

Defined results: null and empty texts have no tokens and aren't used; null languages are a language; sources without target
or with a target of 0 aren't used; max_repeats that is null or below 1 counts as 1. No text is cut, so a leaf stays
under its budget by less than the shortest text not taken: after the first prefix, a prefix of the texts that still
fit is taken, and so on for `rounds` rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.tokens import RANKS, with_counts
from larkspur.session import materialize

RANGES = 4096


def spread(weights: dict[tuple, float], room: dict[tuple, float], total: float) -> dict[tuple, float]:
    """Budget of each leaf (path of a tree): shortages go to siblings with room, then to those of ancestors."""
    budget = {leaf: min(room[leaf], weights[leaf] * total) for leaf in weights}
    depth = len(next(iter(weights), ()))
    for level in range(depth - 1, -1, -1):
        groups: dict[tuple, list[tuple]] = {}
        for leaf in weights:
            groups.setdefault(leaf[:level], []).append(leaf)
        for leaves in groups.values():
            want = sum(weights[x] for x in leaves) * total
            for _ in range(len(leaves) + 1):
                short = want - sum(budget[x] for x in leaves)
                able = [x for x in leaves if room[x] - budget[x] > 1e-9 and weights[x] > 0]
                if short <= 1e-6 or not able:
                    break
                share = sum(weights[x] for x in able)
                for x in able:
                    budget[x] = min(room[x], budget[x] + short * weights[x] / share)
    return budget


def texts(documents: DataFrame, targets: DataFrame, tokenizer: str) -> DataFrame:
    """(text_hash, doc_id, lang, source, tokens): one row per distinct text of the targeted sources."""
    wanted = targets.where("target_share > 0").select("source").distinct()
    docs = documents.where("doc_id is not null and text <> ''").join(wanted, "source", "left_semi").select("text", F.col("doc_id").cast("long").alias("doc_id"), "lang", "source")
    counted = with_counts(docs, "text", tokenizer)
    one = counted.groupBy("text_hash").agg(F.min(F.struct("doc_id", "source", "lang", "tokens")).alias("x"))
    return one.select("text_hash", "x.doc_id", "x.lang", "x.source", "x.tokens").where("tokens > 0")


def budgets(leaves: list[dict], total: float | str | None) -> list[dict]:
    """leaves: lang, source, tokens, target_share, max_repeats. Adds budget and its whole epochs."""
    by_source: dict[str, float] = {}
    for x in leaves:
        by_source[x["source"]] = by_source.get(x["source"], 0) + x["tokens"]
    shares = {x["source"]: x["target_share"] for x in leaves}
    norm = sum(shares.values()) or 1.0
    repeats = {x["source"]: max(1, x["max_repeats"] or 1) for x in leaves}
    if total is None:
        total = min((by_source[s] * repeats[s] * norm / shares[s] for s in shares), default=0.0)
    elif total == "all":
        total = float(sum(by_source.values()))
    path = {("documents", x["lang"] or "", x["source"]): x for x in leaves}
    weights = {p: shares[x["source"]] / norm * x["tokens"] / by_source[x["source"]] for p, x in path.items()}
    room = {p: float(x["tokens"] * repeats[x["source"]]) for p, x in path.items()}
    got = spread(weights, room, total)
    return [x | {"budget": got[p], "epochs": int((got[p] + 1e-6) // x["tokens"])} for p, x in path.items()]


def mixed(documents: DataFrame, targets: DataFrame, total_tokens: float | str | None = None, tokenizer: str = RANKS, seed: int = 7, rounds: int = 4, max_leaves: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(uses, targets): uses (doc_id, source, lang, tokens, uses), one row per text used."""
    spark = documents.sparkSession
    one_target = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    base = materialize(texts(documents, targets, tokenizer).withColumn("lang", F.coalesce("lang", F.lit(""))), "texts")
    rows = base.groupBy("source", "lang").agg(F.sum("tokens").alias("tokens")).join(one_target, "source").limit(max_leaves + 1).collect()
    if len(rows) > max_leaves:
        raise ValueError(f"more than {max_leaves} leaves")
    plan = budgets([r.asDict() for r in rows], total_tokens)
    schema = "source string, lang string, epochs int, rest double"
    leaf = spark.createDataFrame([(x["source"], x["lang"], x["epochs"], x["budget"] - x["epochs"] * x["tokens"]) for x in plan], schema)
    leaf = F.broadcast(leaf)  # at most max_leaves rows
    # the order of the last epoch
    placed = base.join(leaf, ["source", "lang"]).withColumn("h", F.xxhash64(F.lit(seed), "epochs", "text_hash"))
    placed = placed.withColumn("range", F.floor(F.shiftrightunsigned("h", 52)).cast("int")).withColumn("last", F.lit(0))
    for _ in range(rounds):
        placed = materialize(_prefix(placed), "placed")
        taken = placed.groupBy("source", "lang").agg(F.sum(F.col("tokens") * F.col("last")).alias("taken"))  # one row per leaf
        placed = placed.join(F.broadcast(taken), ["source", "lang"]).withColumn("gap", F.col("rest") - F.col("taken")).drop("taken")
    lang = F.nullif("lang", F.lit("")).alias("lang")
    return placed.select("doc_id", "source", lang, "tokens", (F.col("epochs") + F.col("last")).alias("uses")).where("uses > 0"), one_target


def _prefix(placed: DataFrame) -> DataFrame:
    """Sets `last` for the prefix, in hash order, of each leaf's texts not taken yet that fits into what is left of its budget."""
    gap = F.col("gap") if "gap" in placed.columns else F.col("rest")
    open_ = placed.withColumn("gap", gap).withColumn("can", ((F.col("last") == 0) & (F.col("tokens") <= F.col("gap"))).cast("int"))
    sums = open_.groupBy("source", "lang", "range").agg(F.sum(F.col("tokens") * F.col("can")).alias("n"))
    upto = Window.partitionBy("source", "lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "lang", "range", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), "n")
    open_ = open_.join(sums, ["source", "lang", "range"])
    inside = (F.col("before") < F.col("gap")) & (F.col("before") + F.col("n") > F.col("gap"))
    within = Window.partitionBy("source", "lang").orderBy("h", "doc_id")
    columns = ["text_hash", "doc_id", "source", "lang", "tokens", "epochs", "rest", "h", "range"]
    part = open_.where(inside).withColumn("upto", F.col("before") + F.sum(F.col("tokens") * F.col("can")).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    part = part.select(*columns, F.when((F.col("can") == 1) & (F.col("upto") <= F.col("gap")), 1).otherwise(F.col("last")).alias("last"))
    rest = open_.where(~inside).select(*columns, F.when((F.col("can") == 1) & (F.col("before") + F.col("n") <= F.col("gap")), 1).otherwise(F.col("last")).alias("last"))
    return part.union(rest)


def shares(uses: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, texts, most_uses): the shares reached, one row per source with a target."""
    got = uses.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("texts"), F.max("uses").alias("most_uses"))
    total = Window.partitionBy()
    out = targets.where("target_share > 0").join(got, "source", "left").select("source", "target_share", "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "texts", "most_uses")])
    return out.withColumn("actual_share", F.round(F.try_divide("tokens", F.sum("tokens").over(total)), 6))
