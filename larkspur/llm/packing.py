"""Filling fixed-capacity containers with items, by a grouping genetic algorithm on islands.

Items larger than the capacity fill whole containers of their own, in pieces; what is left of them is an item like any
other. Items are dealt into groups of about `group_items` by hash. A group's packings evolve on `islands` islands: a
chromosome is a packing, crossover injects the other parent's best filled containers, containers that hold an injected
item are dissolved, and their other items are put back where they fit best. After each epoch every island's elite
moves to the next island. A group's best packing keeps its well filled containers; the items of the others are
displaced into fewer, mixed groups for the next level, until one group is left (or most items are displaced once more). Fitness is the mean of (fill / capacity)**2.

A group is bounded by `group_items`, so is each task's work; all groups and islands run at once.

Defined results: null and empty texts have no tokens and are in no container; a capacity that is null or below 1 is
left out; equal texts under different ids are packed each; a doc_id that occurs again is packed once, with its longest text. Container numbers are unique within a kind. Results are
the same for the same input and seed.
"""

from __future__ import annotations

import bisect
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.tokens import RANKS, with_counts
from larkspur.session import materialize


class Packing:
    """Containers (lists of item numbers), which are never changed in place, with what is in each."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[list[int]] | None = None, fills: list[int] | None = None) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.bins = list(bins or [])
        self.fills = [sum(sizes[i] for i in b) for b in self.bins] if fills is None else list(fills)

    def fitness(self) -> float:
        return sum(f * f for f in self.fills) / (self.capacity * self.capacity * max(1, len(self.fills)))

    def insert(self, items: list[int]) -> None:
        """Best fit: each item, largest first, into the fullest container that takes it."""
        sizes, capacity = self.sizes, self.capacity
        items = sorted(items, key=lambda i: (-sizes[i], i))
        # containers too full for the smallest item never take one
        free = sorted((capacity - f, k) for k, f in enumerate(self.fills) if items and capacity - f >= sizes[items[-1]])
        added: dict[int, list[int]] = {}
        for i in items:
            at = bisect.bisect_left(free, (sizes[i], -1))
            if at == len(free):
                room, k = capacity, len(self.bins)
                self.bins.append([])
                self.fills.append(0)
            else:
                room, k = free.pop(at)
            added.setdefault(k, []).append(i)
            self.fills[k] += sizes[i]
            bisect.insort(free, (room - sizes[i], k))
        for k, more in added.items():
            self.bins[k] = self.bins[k] + more


def crossed(a: Packing, b: Packing, rng: random.Random) -> Packing:
    """b's best filled containers injected into a."""
    ranked = sorted(range(len(b.bins)), key=lambda k: (-b.fills[k], b.bins[k]))
    best = ranked[: max(1, len(ranked) // 2)]
    chosen = [k for k in best if rng.random() < 0.5] or [best[0]]
    taken = {i for k in chosen for i in b.bins[k]}
    kept, fills, displaced = [], [], []
    for x, f in zip(a.bins, a.fills, strict=True):
        if taken.isdisjoint(x):
            kept.append(x)
            fills.append(f)
        else:
            displaced += [i for i in x if i not in taken]
    child = Packing(a.sizes, a.capacity, kept + [b.bins[k] for k in chosen], fills + [b.fills[k] for k in chosen])
    child.insert(displaced)
    return child


def mutated(a: Packing, rng: random.Random) -> Packing:
    """Some of the worst filled containers, and one at random, emptied and packed again."""
    order = sorted(range(len(a.bins)), key=lambda k: (a.fills[k], k))
    drop = set(order[: max(2, len(order) // 10)]) | {rng.randrange(len(a.bins))}
    kept = [k for k in range(len(a.bins)) if k not in drop]
    child = Packing(a.sizes, a.capacity, [a.bins[k] for k in kept], [a.fills[k] for k in kept])
    loose = [i for k in sorted(drop) for i in a.bins[k]]
    rng.shuffle(loose)
    split = len(loose) // 3
    child.insert(loose[split:])
    child.insert(loose[:split])
    return child


def evolve(sizes: list[int], capacity: int, given: list[list[list[int]]], seed: int, population: int, generations: int) -> list[Packing]:
    """The population after some generations, best first; `given` packings are in the first one.

    Nothing is done beyond the first packing that has the least possible number of containers.
    """
    rng = random.Random(seed)
    least = -(-sum(sizes) // capacity)
    people: list[Packing] = []

    def finished(p: Packing) -> bool:
        people.append(p)
        return len(p.bins) <= least

    for b in given:
        if finished(Packing(sizes, capacity, b)):
            return people[::-1]
    while len(people) < population:
        p = Packing(sizes, capacity)
        order = list(range(len(sizes)))
        if people:  # the first is best fit decreasing, the others take some items out of order first
            rng.shuffle(order)
            p.insert(order[: len(order) // 4])
            p.insert(order[len(order) // 4 :])
        else:
            p.insert(order)
        if finished(p):
            return people[::-1]
    score = [(p.fitness(), -k) for k, p in enumerate(people)]
    for _ in range(generations):
        a, b = (max(rng.sample(range(len(people)), 2), key=lambda k: score[k]) for _ in range(2))
        child = mutated(people[a], rng) if a == b or rng.random() < 0.3 else crossed(people[a], people[b], rng)
        if finished(child):
            return people[::-1]
        people.pop()
        worst = min(range(len(people)), key=lambda k: score[k])
        people[worst], score[worst] = child, (child.fitness(), -worst)
    return [people[k] for k in sorted(range(len(people)), key=lambda k: (-score[k][0], k))]


def _encoded(p: Packing) -> list[int]:
    out = [0] * len(p.sizes)
    for k, b in enumerate(p.bins):
        for i in b:
            out[i] = k
    return out


def _decoded(code: list[int]) -> list[list[int]]:
    bins: list[list[int]] = [[] for _ in range(max(code, default=-1) + 1)]
    for i, k in enumerate(code):
        bins[k].append(i)
    return [b for b in bins if b]


GROUP = "container_kind string, capacity int, grp int, ids array<struct<doc_id:bigint,piece:int>>, sizes array<int>"


def _epoch(groups: DataFrame, islands: int, epoch: int, seed: int, population: int, generations: int) -> DataFrame:
    """One epoch on every island of every group; `elites` holds the packings of all islands of the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, fit = [], []
            for capacity, grp, sizes, elites, island in zip(*(batch.column(k).to_pylist() for k in ("capacity", "grp", "sizes", "elites", "island")), strict=True):
                # an island goes on from its own elite and from that of the island before it
                given = [_decoded(elites[k % len(elites)]) for k in {island: 0, island - 1: 0}] if elites else []
                best = evolve(sizes, capacity, given, hash((seed, grp, island, epoch)), population, generations)[0]
                code.append(_encoded(best))
                fit.append(best.fitness())
            yield pa.record_batch(
                [*(batch.column(k) for k in ("container_kind", "capacity", "grp", "ids", "sizes", "island")), pa.array(code, pa.list_(pa.int32())), pa.array(fit, pa.float64())],
                names=["container_kind", "capacity", "grp", "ids", "sizes", "island", "elite", "fit"],
            )

    spread = groups.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).repartition("container_kind", "grp", "island")
    return spread.mapInArrow(run, GROUP + ", island int, elite array<int>, fit double")


def _level(items: DataFrame, loss: float, how: dict, level: int, last: bool) -> tuple[DataFrame, DataFrame]:
    """(packed items, displaced items) of one level; items has container_kind, capacity, grp, doc_id, piece, size."""
    groups = items.groupBy("container_kind", "capacity", "grp").agg(F.array_sort(F.collect_list(F.struct("doc_id", "piece", "size"))).alias("x"))
    groups = groups.select("container_kind", "capacity", "grp", F.transform("x", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"))).alias("ids"), F.transform("x", lambda x: x["size"]).alias("sizes"))
    groups = groups.withColumn("elites", F.expr("cast(null as array<array<int>>)"))
    for epoch in range(how["epochs"]):
        done = materialize(_epoch(groups, how["islands"], epoch, how["seed"] + level, how["population"], how["generations"]), "islands")
        gathered = done.groupBy("container_kind", "capacity", "grp").agg(
            F.first("ids").alias("ids"), F.first("sizes").alias("sizes"),
            F.transform(F.array_sort(F.collect_list(F.struct("island", "elite"))), lambda x: x["elite"]).alias("elites"),
            F.max(F.struct("fit", -F.col("island"), "elite"))["elite"].alias("best"),
        )
        groups = gathered
    placed = groups.select("container_kind", "capacity", "grp", F.explode(F.arrays_zip("ids", "sizes", "best")).alias("x"))
    placed = placed.select("container_kind", "capacity", "grp", "x.ids.doc_id", "x.ids.piece", F.col("x.sizes").alias("size"), F.col("x.best").alias("bin"))
    fill = groups.select("container_kind", "capacity", "grp", F.explode(F.arrays_zip("sizes", "best")).alias("x")).groupBy("container_kind", "grp", F.col("x.best").alias("bin")).agg(F.sum("x.sizes").alias("fill"))
    placed = materialize(placed.join(fill, ["container_kind", "grp", "bin"]), "placed")
    # a container stays if it has lost little of its capacity, or no more than two tokens
    good = F.lit(True) if last else F.col("capacity") - F.col("fill") <= F.greatest(F.lit(2.0), loss * F.col("capacity"))
    packed = placed.where(good).select("container_kind", "capacity", F.concat_ws("-", F.lit(f"l{level}"), "grp", "bin").alias("bin"), "doc_id", "piece", "size")
    return packed, placed.where(~good).select("container_kind", "capacity", "doc_id", "piece", "size")


def packed(documents: DataFrame, sizes: DataFrame, tokenizer: str = RANKS, group_items: int = 600, loss: float = 0.001, islands: int = 3, epochs: int = 2, population: int = 8, generations: int = 40, seed: int = 7, max_kinds: int = 100) -> DataFrame:
    """(container_kind, container_id, doc_id, piece_no, begin_token, tokens, capacity): every text in containers of every kind."""
    counted = materialize(with_counts(documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", tokenizer).groupBy("doc_id").agg(F.max("tokens").alias("tokens")).where("tokens > 0"), "tokens")
    kinds = sizes.where("capacity_tokens >= 1").groupBy("container_kind").agg(F.max("capacity_tokens").cast("int").alias("capacity"))
    named = kinds.orderBy("container_kind").limit(max_kinds + 1).collect()
    if len(named) > max_kinds:
        raise ValueError(f"more than {max_kinds} kinds of containers")
    # each text once for each kind of container
    each = F.array(*[F.struct(F.lit(r["container_kind"]).alias("container_kind"), F.lit(r["capacity"]).alias("capacity")) for r in named])
    each = each if named else F.expr("cast(array() as array<struct<container_kind:string,capacity:int>>)")
    pieces = counted.select("doc_id", "tokens", F.inline(each))
    pieces = pieces.select("container_kind", "capacity", "doc_id", "tokens", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / F.col("capacity")).cast("int"))).alias("piece"))
    pieces = pieces.withColumn("size", F.least("capacity", F.col("tokens") - F.col("piece").cast("long") * F.col("capacity")).cast("int"))
    whole = pieces.where("size = capacity").select("container_kind", "capacity", F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("bin"), "doc_id", "piece", "size")
    left = pieces.where("size < capacity").select("container_kind", "capacity", "doc_id", "piece", "size")
    how = {"islands": islands, "epochs": epochs, "population": population, "generations": generations, "seed": seed}
    out, level, before = whole, 0, None
    while True:
        per_kind = left.groupBy("container_kind").agg(F.count("*").alias("n"))
        most, count = per_kind.agg(F.max("n"), F.sum("n")).first()
        # the last level: one group for each kind, or most items displaced again
        last = (most or 0) <= group_items or before is not None and count > 0.5 * before
        groups = F.greatest(F.lit(1), F.ceil(F.col("n") / group_items)).cast("int")
        dealt = left.join(per_kind.withColumn("groups", groups).drop("n"), "container_kind")
        grp = F.pmod(F.xxhash64(F.lit(seed + level), "doc_id", "piece"), F.col("groups")).cast("int")
        done, left = _level(dealt.withColumn("grp", grp).drop("groups"), loss * (1 + level), how, level, last)
        out, level, before = out.union(done), level + 1, count
        if last:
            break
    return out.select("container_kind", F.col("bin").alias("container_id"), "doc_id", F.col("piece").alias("piece_no"), (F.col("piece").cast("long") * F.col("capacity")).alias("begin_token"), F.col("size").alias("tokens"), "capacity")


def report(done: DataFrame) -> DataFrame:
    """(container_kind, capacity, containers, items, tokens, fill_share, least_containers): how well containers of each kind are filled."""
    kinds = done.groupBy("container_kind").agg(F.max("capacity").alias("capacity"), F.countDistinct("container_id").alias("containers"), F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
    return kinds.withColumn("fill_share", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6)).withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity")))
