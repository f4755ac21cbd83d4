"""Filling containers of fixed capacity with whole items: a distributed grouping genetic algorithm.

Items are spread over shards of about ``shard_items``; the containers of a shard are bred on
several islands at once, from founders that fit the items in different orders.  A crossover injects
whole well-filled containers of one parent into the other and drops the containers that now hold
duplicates; before the displaced items are best-fitted, items of the other containers are exchanged
for displaced ones that fill them better.  Between epochs every island takes in the elite of its
neighbour.  A shard is done once it needs no more containers than its total size forces.  The least
filled container of each shard is packed again one level up, until one shard is left, so little
room stays unused however many shards there are.
"""

from __future__ import annotations

import bisect
import itertools
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize, ship

Bins = list[list[int]]


def least_bins(sizes: list[int], capacity: int) -> int:
    """No packing needs fewer containers than this."""
    return max(1, -(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))


def best_fit(bins: Bins, items: list[int], sizes: list[int], capacity: int) -> Bins:
    """Put each item, in order, where it leaves the least room; open a container if none fits."""
    room = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for i in items:
        at = bisect.bisect_left(room, (sizes[i], -1))
        if at == len(room):
            bins.append([i])
            bisect.insort(room, (capacity - sizes[i], len(bins) - 1))
        else:
            left, k = room.pop(at)
            bins[k].append(i)
            bisect.insort(room, (left - sizes[i], k))
    return bins


def score(bins: Bins, sizes: list[int], capacity: int) -> tuple[int, float]:
    """Less is better: the number of containers, then how evenly the unused room is spread over them."""
    return len(bins), -sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def exchange(bins: Bins, loose: list[int], sizes: list[int], capacity: int) -> list[int]:
    """Fill containers with loose items: added, or in exchange for one or two smaller ones of a
    container, whichever fills it best; returns what is loose then."""
    loose = sorted(loose, key=lambda i: sizes[i])
    keys = [sizes[i] for i in loose]
    for b in bins:
        gap = capacity - sum(sizes[i] for i in b)
        while gap > 0 and keys:
            gain, out, at = 0, (), 0
            singles = [(sizes[i], (i,)) for i in b]
            pairs = [(x + y, (i, j)) for (x, (i,)), (y, (j,)) in itertools.combinations(singles, 2)] if len(b) <= 8 else []
            for total, items in [(0, ()), *singles, *pairs]:
                k = bisect.bisect_right(keys, total + gap) - 1
                if k >= 0 and keys[k] - total > gain:
                    gain, out, at = keys[k] - total, items, k
            if not gain:
                break
            b.append(loose.pop(at))
            keys.pop(at)
            for i in out:
                b.remove(i)
                k = bisect.bisect_left(keys, sizes[i])
                keys.insert(k, sizes[i])
                loose.insert(k, i)
            gap -= gain
    return loose


def crossover(a: Bins, b: Bins, sizes: list[int], capacity: int, rng: random.Random) -> Bins:
    """A child of ``b`` into which a share of the best-filled containers of ``a`` is injected."""
    ranked = sorted(a, key=lambda x: -sum(sizes[i] for i in x))
    chosen = [list(x) for x in ranked[: max(1, len(a) * 2 // 3)] if rng.random() < 0.7] or [list(ranked[0])]
    taken = {i for x in chosen for i in x}
    kept, loose = [], []
    for x in b:
        if taken.isdisjoint(x):
            kept.append(list(x))
        else:
            loose += [i for i in x if i not in taken]
    # a mutation: the least filled of the others and some by chance are dissolved as well
    kept.sort(key=lambda x: sum(sizes[i] for i in x))
    gone = {0, *rng.sample(range(len(kept)), min(len(kept), 4))} if kept else set()
    loose += [i for k in gone for i in kept[k]]
    bins = [x for k, x in enumerate(kept) if k not in gone] + chosen
    loose = exchange(bins, loose, sizes, capacity)
    return best_fit(bins, loose[::-1], sizes, capacity)


def found(sizes: list[int], capacity: int, rng: random.Random, spread: float) -> Bins:
    """A best fit in falling order of the sizes, disturbed by up to ``spread``."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i] * rng.uniform(1 - spread, 1.0), i))
    return best_fit([], order, sizes, capacity)


def evolve(sizes: list[int], capacity: int, elites: list[Bins], seed: int, population: int, generations: int) -> list[Bins]:
    """The fittest two packings after some generations, best first."""
    rng = random.Random(seed)
    goal = least_bins(sizes, capacity)
    serial = itertools.count()
    rated = lambda bins: (*score(bins, sizes, capacity), next(serial), bins)
    people = [rated(b) for b in elites]
    for k in range(len(people), population):
        people.append(rated(found(sizes, capacity, rng, k / population)))
        if people[-1][0] <= goal:
            break
    people.sort()
    for _ in range(generations):
        if people[0][0] <= goal:
            break
        for _ in range(max(1, population // 2)):
            pick = lambda: min(rng.sample(people, min(2, len(people))))[3]
            people.append(rated(crossover(pick(), pick(), sizes, capacity, rng)))
        people = sorted(people)[:population]
    return [p[3] for p in people[:2]]


STATE = "shard long, island int, ids array<long>, parts array<int>, sizes array<int>, elites array<array<int>>, n_bins int, done boolean"


def _evolver(capacity: int, seed: int, epoch: int, population: int, generations: int):
    def decode(a: list[int]) -> Bins:
        bins: dict[int, list[int]] = {}
        for i, k in enumerate(a):
            bins.setdefault(int(k), []).append(i)
        return list(bins.values())

    def encode(bins: Bins, n: int) -> list[int]:
        a = [0] * n
        for k, b in enumerate(bins):
            for i in b:
                a[i] = k
        return a

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for j in pdf.index:
                if pdf.at[j, "done"]:
                    continue
                sizes = [int(s) for s in pdf.at[j, "sizes"]]
                best = evolve(
                    sizes, capacity, [decode(a) for a in pdf.at[j, "elites"]],
                    hash((seed, epoch, int(pdf.at[j, "shard"]), int(pdf.at[j, "island"]))), population, generations,
                )
                pdf.at[j, "elites"] = [encode(b, len(sizes)) for b in best]
                pdf.at[j, "n_bins"] = len(best[0])
                pdf.at[j, "done"] = len(best[0]) <= least_bins(sizes, capacity)
            yield pdf

    return run


def _pack_shards(items: DataFrame, capacity: int, seed: int, islands: int, epochs: int, population: int, generations: int) -> DataFrame:
    """(shard, bin, id, part, size) of items (shard, id, part, size)."""
    shards = items.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("id", "part", "size"))).alias("x")).select(
        "shard", F.col("x.id").alias("ids"), F.col("x.part").alias("parts"), F.col("x.size").cast("array<int>").alias("sizes")
    )
    state = shards.select(
        "shard", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), "ids", "parts", "sizes",
        F.array().cast("array<array<int>>").alias("elites"), F.lit(0).alias("n_bins"), F.lit(False).alias("done"),
    )
    ring = Window.partitionBy("shard").orderBy("island")  # `islands` rows
    whole = Window.partitionBy("shard")
    for epoch in range(epochs):
        if epoch:
            # the neighbour's elite comes in; a shard that is done on one island is done
            elite = F.col("elites").getItem(0)
            guest = F.coalesce(F.lag(elite).over(ring), F.last(elite).over(whole))
            state = state.withColumn("elites", F.concat(F.array(guest), "elites")).withColumn(
                "done", F.max("done").over(whole)
            )
        state = state.select(*[c.split()[0] for c in STATE.split(", ")]).mapInPandas(
            _evolver(capacity, seed, epoch, population, generations), STATE
        )
    best = state.withColumn(
        "__first", F.row_number().over(Window.partitionBy("shard").orderBy("n_bins", "island"))
    ).filter("__first = 1")
    # after a migration the guest may lead the list: take the packing with the fewest containers
    fewest = F.array_min(F.transform("elites", lambda a: F.struct(F.array_max(a).alias("n"), a.alias("a")))).getField("a")
    return best.select("shard", F.explode(F.arrays_zip("ids", "parts", "sizes", fewest.alias("bin"))).alias("x")).select(
        "shard", F.col("x.bin").cast("bigint").alias("bin"), F.col("x.ids").alias("id"), F.col("x.parts").alias("part"), F.col("x.sizes").alias("size")
    )


def pack(
    sizes: DataFrame, id_col: str = "doc_id", size_col: str = "tokens", capacity: int = 4096, seed: int = 7,
    shard_items: int = 2000, islands: int = 3, epochs: int = 2, population: int = 8, generations: int = 8,
) -> DataFrame:
    """(container, id, part, size): every item in exactly one container of at most ``capacity``.

    Only an item above the capacity is split: into full parts that are containers of their own,
    and a rest that is packed like an item.  A null size counts as 0; ids must be unique integers.
    Shards hold about ``shard_items`` items by a hash of the id, so no group grows with the data.
    An empty input gives no rows.
    """
    ship(sizes.sparkSession)
    s = materialize(
        sizes.select(F.col(id_col).cast("bigint").alias("id"), F.greatest(F.lit(0), F.coalesce(F.col(size_col), F.lit(0))).cast("bigint").alias("size")),
        "sizes",
    )
    full = s.filter(F.col("size") >= capacity).select(
        "id", F.explode(F.sequence(F.lit(0), (F.floor(F.col("size") / capacity) - 1).cast("int"))).alias("part"),
        F.lit(capacity).cast("bigint").alias("size"),
    )
    rest = s.select("id", F.floor(F.col("size") / capacity).cast("int").alias("part"), (F.col("size") % capacity).alias("size")).filter(
        (F.col("size") > 0) | (F.col("part") == 0)
    )
    placed = [full.select(F.concat_ws("-", F.lit("full"), "id", "part").alias("container"), "id", "part", "size")]
    n, level = rest.count(), 0
    while n:
        shards = max(1, -(-n // shard_items))
        rest = rest.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + level), "id", "part"), F.lit(shards)))
        # a task for few shards, however many there are: the work is in the breeding, not in the bytes
        rest = rest.repartition(max(min(shards, 64), -(-shards // 16)), "shard")
        packed = materialize(_pack_shards(rest, capacity, seed + level, islands, epochs, population, generations), "packed")
        name = F.concat_ws("-", F.lit(f"level{level}"), "shard", "bin")
        if shards == 1:
            placed.append(packed.select(name.alias("container"), "id", "part", "size"))
            break
        fill = packed.groupBy("shard", "bin").agg(F.sum("size").alias("fill"))
        least = fill.groupBy("shard").agg(F.min_by("bin", F.struct("fill", "bin")).alias("bin")).withColumn("open", F.lit(True))
        packed = packed.join(least, ["shard", "bin"], "left")
        placed.append(packed.filter("open IS NULL").select(name.alias("container"), "id", "part", "size"))
        rest = materialize(packed.filter("open").select("id", "part", "size"), "open")
        n, level = rest.count(), level + 1
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("id", id_col)


def containers(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """(container, n_parts, used, unused) of each container."""
    return packed.groupBy("container").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("size").alias("used")).withColumn(
        "unused", F.lit(capacity) - F.col("used")
    )
