"""Filling fixed-capacity containers by a grouping genetic algorithm on islands.

The items are dealt into blocks of about two thousand by a hash; each block is
evolved by several islands, which are tasks of their own, and between epochs each
island sends its best solution to the next.  An island begins with solutions that
fit the items in random orders; all improvement comes from crossovers.  A crossover
injects whole well-filled containers of one parent into the other, removes the
containers that now hold duplicates, and best-fits what was displaced.  The least filled containers of all
blocks are then packed again together, in rounds, until one block holds them.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from veritab.session import written

BLOCK_ITEMS = 2048
ISLANDS = 2
EPOCHS = 4
POPULATION = 6
#: Crossovers of an island in an epoch.
CROSSOVERS = 24
#: Share of the fullest containers that may be injected, and how likely each is.
FULLEST, INJECTED = 0.3, 0.5
#: The most of the worst filled containers that a crossover empties as well, and how
#: far the order of the displaced items strays from decreasing size.
EMPTIED, STRAY = 0.3, 0.02
#: The least filled containers of a block that are packed again with those of others.
SPARE = 16
STATE = "block bigint, island int, docs array<bigint>, parts array<int>, sizes array<int>, genomes array<array<int>>, first int, crossovers int, migrations int"
COLUMNS = [c.split()[0] for c in STATE.split(", ")]
PLACED = "doc_id bigint, part int, n_tokens int, block bigint, bin int, spare boolean"


def best_fit(sizes: np.ndarray, items: np.ndarray, bins: np.ndarray, loads: list[int], capacity: int) -> list[int]:
    """Put ``items`` in the given order where the least space is left; loads of all bins."""
    wide = len(sizes) + 1
    free = sorted((capacity - load) * wide + b for b, load in enumerate(loads))
    for i in items.tolist():
        size = int(sizes[i])
        at = bisect_left(free, size * wide)
        if at < len(free):
            room, b = divmod(free.pop(at), wide)
        else:
            room, b = capacity, len(loads)
            loads.append(0)
        bins[i] = b
        loads[b] += size
        insort(free, (room - size) * wide + b)
    return loads


def fitness(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> float:
    """Mean square of the fill of the containers: fewer and fuller ones are better."""
    loads = np.bincount(bins, sizes)
    return float(np.mean((loads / capacity) ** 2)) if len(loads) else 1.0


def crossed(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of ``a`` with about half of the fullest containers of ``b``."""
    full = np.bincount(b, sizes) / capacity
    chosen = (full >= np.quantile(full, 1 - FULLEST)) & (rng.random(len(full)) < INJECTED)
    injected = chosen[b]
    gone = np.zeros(a.max() + 1, bool)
    gone[a[injected]] = True
    # mutation: some of the worst filled containers are emptied as well
    loads = np.bincount(a, sizes)
    gone[np.argsort(loads)[: max(1, int(len(loads) * EMPTIED * rng.random()))]] = True
    displaced = np.flatnonzero(gone[a] & ~injected)
    child = np.full(len(a), -1, np.int64)
    kept = ~gone[a] & ~injected
    _, child[kept] = np.unique(a[kept], return_inverse=True)
    base = int(child.max()) + 1 if kept.any() else 0
    if injected.any():
        _, own = np.unique(b[injected], return_inverse=True)
        child[injected] = base + own
        base += int(own.max()) + 1
    settled = child >= 0
    loads = np.bincount(child[settled], sizes[settled], minlength=base).astype(np.int64).tolist()
    order = displaced[np.argsort(-sizes[displaced] * (1 + STRAY * rng.random(len(displaced))), kind="stable")]
    best_fit(sizes, order, child, loads, capacity)
    return child


def least(sizes: np.ndarray, capacity: int) -> int:
    """Containers that no solution can do without: tokens, or items over half a container."""
    return max(-(-int(sizes.sum()) // capacity), int((2 * sizes > capacity).sum()))


def evolved(sizes: np.ndarray, population: list[np.ndarray], capacity: int, rng: np.random.Generator, crossovers: int = CROSSOVERS, size: int = POPULATION) -> tuple[list[np.ndarray], int]:
    """The population after the crossovers, best first, and how many there were.

    Newcomers up to ``size`` fit the items in a random order.  Only a best solution
    that is proven to have the fewest containers possible ends the evolution early.
    """
    population = list(population)
    while len(population) < size:
        bins = np.full(len(sizes), -1, np.int64)
        best_fit(sizes, rng.permutation(len(sizes)), bins, [], capacity)
        population.append(bins)
    fewest = least(sizes, capacity)
    scored = sorted(((fitness(p, sizes, capacity), k, p) for k, p in enumerate(population)), key=lambda x: (-x[0], x[1]))
    done = 0
    while done < crossovers and int(scored[0][2].max()) + 1 > fewest:
        # two tournaments of two
        i, j = (int(rng.integers(0, len(scored), 2).min()) for _ in "ab")
        child = crossed(scored[i][2], scored[j if j != i else (i + 1) % len(scored)][2], sizes, capacity, rng)
        scored[-1] = (fitness(child, sizes, capacity), len(population) + done, child)
        scored.sort(key=lambda x: (-x[0], x[1]))
        done += 1
    return [p for _, _, p in scored], done


def _state(key: tuple, docs: list, parts: list, sizes: np.ndarray, best: list[np.ndarray], first: int, crossovers: int, migrations: int) -> pd.DataFrame:
    return pd.DataFrame([(key[0], key[1], docs, parts, sizes.tolist(), [p.tolist() for p in best], first, crossovers, migrations)], columns=COLUMNS)


def _begin(capacity: int, seed: int, crossovers: int, size: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "part"])
        sizes = rows["n_tokens"].to_numpy(np.int64)
        rng = np.random.default_rng([seed, 0, int(key[0]), int(key[1])])
        start, _ = evolved(sizes, [], capacity, rng, 0, size)
        best, done = evolved(sizes, start, capacity, rng, crossovers, size)
        return _state(key, rows["doc_id"].tolist(), rows["part"].tolist(), sizes, best, int(start[0].max()) + 1, done, 0)

    return run


def _go_on(capacity: int, seed: int, epoch: int, crossovers: int, size: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["docs"].notna()].iloc[0]
        sizes = np.array(own["sizes"], np.int64)
        genomes = [np.array(g, np.int64) for g in own["genomes"]]
        guests = [np.array(g, np.int64) for x in rows[rows["docs"].isna()]["genomes"] for g in x]
        # an elite that is no better than what is here would only copy it
        guests = [g for g in guests if fitness(g, sizes, capacity) > fitness(genomes[0], sizes, capacity)]
        rng = np.random.default_rng([seed, epoch, int(key[0]), int(key[1])])
        best, done = evolved(sizes, [*guests, *genomes[: size - len(guests)]], capacity, rng, crossovers, size)
        return _state(key, own["docs"], own["parts"], sizes, best, int(own["first"]), int(own["crossovers"]) + done, int(own["migrations"]) + len(guests))

    return run


def _best(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("island")
        sizes = np.array(rows["sizes"].iloc[0], np.int64)
        bins = max((np.array(g[0], np.int64) for g in rows["genomes"]), key=lambda b: fitness(b, sizes, capacity))
        return pd.DataFrame({"doc_id": rows["docs"].iloc[0], "part": rows["parts"].iloc[0], "n_tokens": sizes, "block": rows["block"].iloc[0], "bin": bins, "spare": spare(bins, sizes, capacity)})

    return run


def spare(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Whether each item is in one of the SPARE least filled containers and that has room."""
    loads = np.bincount(bins, sizes)
    least = np.argsort(loads, kind="stable")[:SPARE]
    chosen = np.zeros(len(loads), bool)
    chosen[least[loads[least] < capacity]] = True
    return chosen[bins]


def _again(capacity: int, seed: int, level: int, crossovers: int, size: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "part"])
        sizes = rows["n_tokens"].to_numpy(np.int64)
        _, present = np.unique(rows["container"].to_numpy(), return_inverse=True)
        # what there is takes part, so the number of containers can't grow
        best, _ = evolved(sizes, [present], capacity, np.random.default_rng([seed, level, int(key[0])]), crossovers, size)
        every = [present, *best]
        bins = min(every, key=lambda b: (int(b.max()), -fitness(b, sizes, capacity)))
        return pd.DataFrame({"doc_id": rows["doc_id"], "part": rows["part"], "n_tokens": sizes, "block": key[0], "bin": bins, "spare": spare(bins, sizes, capacity)})

    return run


def merged(placed: DataFrame, capacity: int, seed: int, block_items: int, crossovers: int, size: int) -> DataFrame:
    """``placed`` with the spare containers of all blocks packed again together.

    Containers stay whole when they are dealt to blocks.  A block gets those of
    four blocks at least, as many as make up ``block_items``, so what is left falls
    to a quarter or less each round.
    """
    done, level = None, 0
    while True:
        level += 1
        kept = placed.where("not spare").drop("spare")
        done = kept if done is None else done.unionByName(kept)
        left = placed.where("spare").drop("spare")
        n, tokens = left.agg(F.count(F.lit(1)), F.sum("n_tokens")).first()
        if not n:
            return done
        blocks = max(1, min(-(-n // block_items), tokens // (4 * SPARE * capacity)))
        left = left.withColumn("block", F.pmod(F.xxhash64("container", F.lit(seed)), F.lit(blocks)))
        placed = written(left.groupBy("block").applyInPandas(_again(capacity, seed, level, crossovers, size), PLACED), "packing")
        placed = placed.select("doc_id", "part", "n_tokens", F.concat_ws(":", F.lit(f"again{level}"), "block", "bin").alias("container"), "spare")
        if blocks == 1:
            return done.unionByName(placed.drop("spare"))


def islands_of(items: DataFrame, capacity: int, seed: int, islands: int, epochs: int, crossovers: int, population: int) -> DataFrame:
    """The islands' state after all epochs, from (doc_id, part, n_tokens, block).

    Each island is a task of its own, however few bytes it holds.
    """
    spark = items.sparkSession
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    items = items.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).repartition(tasks, "block", "island")
    state = written(items.groupBy("block", "island").applyInPandas(_begin(capacity, seed, crossovers, population), STATE), "packing")
    absent = [F.lit(None).cast(t).alias(c) for c, t in (x.split(" ", 1) for x in STATE.split(", ")) if c not in ("block", "island", "genomes")]
    for epoch in range(1, epochs):
        elite = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), *absent, F.slice("genomes", 1, 1).alias("genomes")).where(F.lit(islands > 1))
        both = state.unionByName(elite).repartition(tasks, "block", "island")
        state = written(both.groupBy("block", "island").applyInPandas(_go_on(capacity, seed, epoch, crossovers, population), STATE), "packing")
    return state


def in_blocks(sizes: DataFrame, capacity: int, seed: int, block_items: int) -> tuple[DataFrame, int, DataFrame, DataFrame]:
    """(items with their block, number of blocks, full containers, texts of no tokens)."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    sizes = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n"))
    whole = F.floor(F.col("n") / capacity).cast("int")
    sizes = sizes.withColumn("whole", F.when(F.col("n") > capacity, whole).otherwise(0)).withColumn("rest", (F.col("n") - F.col("whole") * capacity).cast("int"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    none = sizes.where("n = 0").select("doc_id", F.lit(0).alias("part"), F.lit(0).alias("n_tokens"), F.lit(None).cast("string").alias("container"))
    full = sizes.where("whole > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("part"), name.alias("name"))
    full = full.select("doc_id", "part", F.lit(capacity).alias("n_tokens"), F.concat_ws(":", F.lit("full"), "name", "part").alias("container"))
    items = sizes.where("rest > 0").select("doc_id", F.col("whole").alias("part"), F.col("rest").alias("n_tokens"))
    blocks = max(1, -(-items.count() // block_items))
    return items.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(blocks))), blocks, full, none


def packed(
    sizes: DataFrame, capacity: int, seed: int = 73, block_items: int = BLOCK_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS, crossovers: int = CROSSOVERS, population: int = POPULATION
) -> DataFrame:
    """(doc_id, part, n_tokens, container): every text whole in one container.

    ``sizes`` has doc_id and n_tokens; other columns are ignored, a null size
    counts as 0.  A text larger than the capacity, and no other, is split: its
    parts 0, 1, ... fill containers of their own, and the rest is packed like any
    item.  A text of no tokens needs no space: its container is null.  Rows of one
    doc_id must not repeat; a null doc_id is an item like others.  The result
    depends on the sizes and the settings only, not on the partitioning.
    """
    items, blocks, full, none = in_blocks(sizes, capacity, seed, block_items)
    state = islands_of(items, capacity, seed, islands, epochs, crossovers, population)
    placed = state.groupBy("block").applyInPandas(_best(capacity), PLACED)
    placed = placed.select("doc_id", "part", "n_tokens", F.concat_ws(":", "block", "bin").alias("container"), "spare")
    placed = merged(written(placed, "packing"), capacity, seed, block_items, crossovers, population) if blocks > 1 else placed.drop("spare")
    return placed.unionByName(full).unionByName(none)


def evolution(
    sizes: DataFrame, capacity: int, seed: int = 73, block_items: int = BLOCK_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS, crossovers: int = CROSSOVERS, population: int = POPULATION
) -> DataFrame:
    """(block, items, least, first, containers, crossovers, migrations, fill): what evolution did to each block.

    ``least`` is a bound no solution can beat, ``first`` the containers of the best
    random start, ``containers`` those of the best island, ``migrations`` the elites
    that were better than what they met, ``fill`` the filled share of the containers;
    before the least filled containers of the blocks are packed again together.
    """
    items, _, _, _ = in_blocks(sizes, capacity, seed, block_items)
    state = islands_of(items, capacity, seed, islands, epochs, crossovers, population)
    total = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, n: a + n)
    large = F.size(F.filter("sizes", lambda n: n * 2 > capacity))
    found = state.select("block", F.size("sizes").alias("items"), total.alias("tokens"), large.alias("large"), (F.array_max(F.col("genomes")[0]) + 1).alias("containers"), "first", "crossovers", "migrations")
    each = found.groupBy("block").agg(
        F.max("items").alias("items"), F.max("tokens").alias("tokens"), F.max("large").alias("large"), F.min("first").alias("first"), F.min("containers").alias("containers"),
        F.sum("crossovers").alias("crossovers"), F.sum("migrations").alias("migrations"),
    )
    fewest = F.greatest(F.ceil(F.col("tokens") / capacity), F.col("large")).cast("int")
    return each.select("block", "items", fewest.alias("least"), "first", "containers", "crossovers", "migrations", (F.col("tokens") / (F.col("containers") * capacity)).alias("fill"))


def split_documents(placed: DataFrame) -> DataFrame:
    """(doc_id) of the documents that the packing put into more than one container."""
    return placed.groupBy("doc_id").agg(F.max("part").alias("last")).where("last > 0").select("doc_id")
