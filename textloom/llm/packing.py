"""Best-fit packing by a grouping genetic algorithm on islands with elite migration.

Documents become token ids plus an end id. Only longer ones are cut, into pieces of the sequence length. Pieces fall at random
into blocks of bounded size; each block is packed by several islands. An individual is a list of bins. Crossover injects whole
well-filled bins of one parent, removes their items from the other parent's bins, keeps the bins that are not touched and
best-fits the displaced documents. After an epoch each island's elite moves to the next island of its block; after the last
epoch the best elite of the block is taken. Bins that a block could not fill are packed once more, together with those of other
blocks. What is shuffled is lengths and bin numbers, never texts.

A null or empty text is a document of one end id. Repeated rows are packed as rows of their own; null ids are kept. Extra
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, saved
from .tokenizer import encoder

LENGTH = 2048
BLOCK_PIECES = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 3
REFILL_BELOW = 0.98  # bins of a block below this share are packed again with other blocks'


def best_fit(bins: list[list[int]], items: list[int], sizes: list[int], length: int) -> list[list[int]]:
    """Put ``items`` into the fullest bins that have room, in the order given; ``bins`` is extended in place.

    Bins are found by their free room: a bit set of the rooms in use and a stack of bins per room.
    """
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for b, members in enumerate(bins):
        room = length - sum(map(sizes.__getitem__, members))
        by_room.setdefault(room, []).append(b)
        rooms |= 1 << room
    for item in items:
        size = sizes[item]
        fit = rooms >> size
        if fit:
            room = (fit & -fit).bit_length() - 1 + size
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                rooms ^= 1 << room
            bins[b].append(item)
        else:
            b, room = len(bins), length
            bins.append([item])
        left = room - size
        stack = by_room.setdefault(left, [])
        if not stack:
            rooms |= 1 << left
        stack.append(b)
    return bins


def fill(members: list[int], sizes: list[int]) -> int:
    return sum(map(sizes.__getitem__, members))


def fitness(bins: list[list[int]], sizes: list[int], length: int) -> float:
    """Fewer bins first, then fuller full ones: mean of squared fill minus the number of bins."""
    return -len(bins) + sum((fill(b, sizes) / length) ** 2 for b in bins) / max(1, len(bins))


def crossover(a: list, b: list, sizes: list[int], length: int, rng: random.Random) -> list:
    """Child of two packings: whole well-filled bins of ``a`` go into ``b``."""
    ranked = sorted(a, key=lambda m: -fill(m, sizes))
    chosen = [m for m in ranked[: max(1, len(ranked) // 2)] if rng.random() < 0.7]
    taken = {i for m in chosen for i in m}
    child, displaced = [list(m) for m in chosen], []
    for m in b:
        rest = [i for i in m if i not in taken]
        if len(rest) == len(m) and fill(m, sizes) >= length * 0.95:
            child.append(list(m))
        else:
            displaced += rest
    displaced.sort(key=lambda i: (-sizes[i], i))
    return best_fit(child, displaced, sizes, length)


def mutate(bins: list, sizes: list[int], length: int, rng: random.Random) -> list:
    """Empty the least filled bins and a few others, and best-fit what they held."""
    ranked = sorted(bins, key=lambda m: fill(m, sizes))
    n = max(2, len(bins) // 20)
    drop = {id(m) for m in ranked[:n]} | {id(rng.choice(bins)) for _ in range(n)}
    loose = [i for m in bins if id(m) in drop for i in m]
    loose.sort(key=lambda i: (-sizes[i] - rng.random() * length * 0.1, i))
    return best_fit([list(m) for m in bins if id(m) not in drop], loose, sizes, length)


def evolve(sizes: list[int], length: int, seed: int, migrants: list[list]) -> tuple[list, float]:
    """One epoch of one island. Best-fit decreasing is among the first individuals, so no result is worse.

    A packing that meets the lower bound ends the epoch: it can't be improved.
    """
    rng = random.Random(seed)
    bound = -(-sum(sizes) // length)
    down = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    people = [*migrants, best_fit([], down, sizes, length)]
    if min(map(len, people)) > bound:
        while len(people) < POPULATION:
            noisy = sorted(down, key=lambda i: -sizes[i] - rng.random() * length * 0.1)
            people.append(best_fit([], noisy, sizes, length))
    scored = sorted(((fitness(p, sizes, length), k, p) for k, p in enumerate(people)), reverse=True)
    made = len(scored)
    for _ in range(GENERATIONS):
        if len(scored[0][2]) <= bound:
            break
        a, b = scored[0][2], rng.choice(scored[1:])[2]
        for child in (crossover(a, b, sizes, length, rng), mutate(crossover(b, a, sizes, length, rng), sizes, length, rng)):
            made += 1
            scored.append((fitness(child, sizes, length), made, child))
        scored = sorted(scored, reverse=True)[:POPULATION]
    return scored[0][2], scored[0][0]


def _numbers(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for b, members in enumerate(bins):
        out[members] = b
    return out


def pieces(
    docs: DataFrame, tokenizer: str, end_id: int = 0, spaces: bool = False, length: int = LENGTH,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: documents as token ids, long ones cut."""
    bound_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, spaces)
        for b in batches:
            row, piece, start, size, crc = [], [], [], [], []
            for i, data in enumerate(encode.encode(b.column(1).to_pylist())):
                data += end
                for k, at in enumerate(range(0, len(data), 4 * length)):
                    part = data[at : at + 4 * length]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack_blocks(items: DataFrame, length: int, islands: int, epochs: int, name: str) -> DataFrame:
    """Place ``items(rid, length)``: adds ``block, bin, offset, filled`` (the ids in the bin)."""
    total = items.count()
    blocks = max(1, -(-total // BLOCK_PIECES))
    # A block holds about BLOCK_PIECES rows: rid is unique and its hash spreads evenly.
    block = saved(
        items.groupBy(F.pmod(F.xxhash64("rid"), F.lit(blocks)).alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("rid", "length"))).alias("items")
        ).repartition(blocks if blocks < 64 else max(64, blocks // 4), "block"),
        f"{name}-blocks",
    )
    lengths = block.select("block", F.col("items.length").alias("sizes"))

    def epoch(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    migrants = []
                    if row.get("elite") is not None:
                        groups: dict[int, list[int]] = {}
                        for i, g in enumerate(row["elite"]):
                            groups.setdefault(g, []).append(i)
                        migrants = [list(groups.values())]
                    seed = row["block"] * 1_000_003 + row["island"] * 101 + number
                    bins, score = evolve(row["sizes"], length, seed, migrants)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["block"]], pa.int64()), pa.array([row["island"]], pa.int32()),
                         pa.array([_numbers(bins, len(row["sizes"])).tolist()], pa.list_(pa.int32())), pa.array([score], pa.float64())],
                        names=["block", "island", "elite", "score"],
                    )

        return run

    kind = "block bigint, island int, elite array<int>, score double"
    island = F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island")
    homes = lengths.select("block", island, "sizes").repartition("block", "island")
    elites = saved(homes.mapInArrow(epoch(0), kind), f"{name}-elites")
    for number in range(1, epochs):
        moved = elites.select("block", ((F.col("island") + 1) % islands).alias("island"), "elite")
        elites = saved(homes.join(moved, ["block", "island"]).mapInArrow(epoch(number), kind), f"{name}-elites")
    best = elites.groupBy("block").agg(F.max_by("elite", F.struct("score", "island")).alias("elite"))
    placed = block.join(best, "block").select("block", F.explode(F.arrays_zip("items.rid", "items.length", "elite")).alias("x"))
    placed = placed.select("block", "x.rid", "x.length", F.col("x.elite").alias("bin"))
    # A bin holds at most `length` pieces, as each has an id.
    return saved(
        placed.groupBy("block", "bin").agg(F.sort_array(F.collect_list(F.struct("rid", "length"))).alias("members"), F.sum("length").alias("filled"))
        .select(
            "block", "bin", "filled",
            F.posexplode(F.expr("""
                transform(members, (m, i) -> struct(
                    m.rid as rid, m.length as length,
                    aggregate(slice(members, 1, i), 0L, (s, x) -> s + x.length) as offset))
            """)).alias("place", "m"),
        )
        .select("m.rid", "m.length", "block", "bin", "m.offset", "filled"),
        f"{name}-placed",
    )


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 0, spaces: bool = False, length: int = LENGTH,
    islands: int = ISLANDS, epochs: int = EPOCHS, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    # The saved table fixes the row numbers, so a task that runs again sees the same ones.
    rows = saved(
        pieces(docs, tokenizer, end_id, spaces, length, doc_id, text).withColumn("rid", F.monotonically_increasing_id()),
        "pieces",
    )
    # The kind of bin is the number modulo 3. A piece of the full length is a sequence by itself.
    full = rows.where(F.col("length") == length).select(
        "rid", (F.col("rid") * 3).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    number = (F.col("block") * (BLOCK_PIECES * 64) + F.col("bin")) * 3
    first = pack_blocks(rows.where(F.col("length") < length).select("rid", "length"), length, islands, epochs, "pack")
    good = F.col("filled") >= int(length * REFILL_BELOW)
    second = pack_blocks(first.where(~good).select("rid", "length"), length, islands, epochs, "refill")
    placed = full.unionByName(first.where(good).select("rid", (number + 1).alias("sequence_id"), "offset")).unionByName(
        second.select("rid", (number + 2).alias("sequence_id"), "offset")
    )
    return rows.join(placed, "rid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
