"""Near-copy removal by SimHash components, and by exact similarity of shingle sets.

Texts whose fingerprints link in ``simhash`` (meet-in-the-middle ball hashing, two bits) are near copies. At two bits that method misses
most pairs that share four fifths of their shingles, so links by shingle sets are added to its own before components are taken.

A text is the set of its runs of five words (A-Z lower-cased; a shorter text is one run). Two texts are near copies if their sets
have a Jaccard similarity of ``SIMILARITY`` or more. Candidates share one of ``BANDS`` keys, each of ``ROWS`` minima of the set
under random permutations: a pair at similarity s is met with probability ``1 - (1 - s**ROWS)**BANDS``, 0.9999 at 0.8.

No pair of texts ever becomes a row. A key's group is looked through in a task, on sketches of one byte per minimum: its members
fall into clusters of likely copies (``LIKELY`` equal bytes or more; a pair at 0.8 falls below with probability 0.00005), and a member
is sent on once, with its cluster's first one. The clusters of all keys are joined, their texts fetched once, and in
a cluster's task the whole sets decide: only pairs not yet connected are compared, and a tree of verified links leaves it.
So no pair below the threshold links. A group above ``TILE`` members or a cluster above ``SHINGLES`` shingles is cut into buckets,
and every two buckets meet in one task, so no task holds a group of any size.

A null text has no words; texts without words are alike. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import bound_batches, joined, mix, or_empty, partitions, saved, words_of
from .simhash import components

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
LIKELY = 0.65
TILE, SHINGLES = 4096, 1_000_000  # members of a group, and shingles of a cluster, in one bucket
SEED = 42
_PERMUTE = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words."""
    import xxhash

    words = [w.lower() for w in words_of(text)]
    whole, starts, ends = joined(words)
    one = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([one(whole, SEED)], np.uint64)
    runs = zip(starts.tolist(), ends.tolist()[width - 1 :])
    return np.unique(np.fromiter((one(whole[a:b], SEED) for a, b in runs), np.uint64, len(words) - width + 1))


def minima(found: np.ndarray) -> np.ndarray:
    """Least hash of a set under each permutation."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), 1024):
            least = np.minimum(least, mix(found[at : at + 1024] ^ _PERMUTE[:, None]).min(axis=1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of each row of minima."""
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(least), BANDS))
    with np.errstate(over="ignore"):
        for row in np.moveaxis(least.reshape(len(least), BANDS, ROWS), 2, 0):
            key = mix(key ^ row)
    return key.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def text_key(text: str) -> Column:
    return F.unhex(F.md5(or_empty(text)))


def sketched(nodes: DataFrame) -> DataFrame:
    """``(fp, n, keys, sketch)`` of ``nodes(fp, text)``: the set's size, its band keys, and one byte of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            least = np.array([minima(s) for s in sets], np.uint64).reshape(-1, BANDS * ROWS)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(band_keys(least).reshape(-1)))
            sketches = [row.tobytes() for row in (least & np.uint64(255)).astype(np.uint8)]
            sizes = pa.array([len(s) for s in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, keys, pa.array(sketches, pa.binary())], names=["fp", "n", "keys", "sketch"])

    return nodes.select("fp", "text").mapInArrow(run, "fp binary, n int, keys array<bigint>, sketch binary")


def grouped(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[list[list]]:
    """Columns of consecutive rows that agree in their first ``key`` columns."""
    held: list[list] | None = None
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        keys = list(zip(*columns[:key]))
        at = 0
        for k in range(1, len(keys) + 1):
            if k == len(keys) or keys[k] != keys[at]:
                part = [c[at:k] for c in columns]
                if held is not None and tuple(c[0] for c in held[:key]) == keys[at]:
                    for have, more in zip(held, part):
                        have += more
                else:
                    if held is not None:
                        yield held
                    held = part
                at = k
    if held is not None:
        yield held


def likely(n: np.ndarray, sketch: np.ndarray, one: int, rest: np.ndarray) -> np.ndarray:
    """Which of ``rest`` may be copies of ``one``."""
    sized = np.minimum(n[rest], n[one]) >= SIMILARITY * np.maximum(n[rest], n[one])
    return sized & ((sketch[rest] == sketch[one]).mean(axis=1) >= LIKELY)


def spread(n: np.ndarray, sketch: np.ndarray, alike=None) -> Iterator[tuple[int, int]]:
    """A forest over likely copies: from a member reached, all that are not are looked at. ``alike(a, b)`` has the last word."""
    left = np.arange(len(n))
    reached: list[int] = []
    while len(left) or reached:
        if reached:
            one = reached.pop()
        else:
            one, left = int(left[0]), left[1:]
        if not len(left):
            return
        near = likely(n, sketch, one, left)
        if alike is not None:
            for k in np.flatnonzero(near):
                near[k] = alike(one, int(left[k]))
        for other in left[near].tolist():
            yield one, other
            reached.append(other)
        left = left[~near]


def _dealt(rows: DataFrame, size: Column, most: int) -> DataFrame:
    """Rows of groups of ``size`` with ``i, j``: the buckets that meet in one task; one task where one is enough."""
    buckets = F.ceil(size / most).cast("int")
    own = F.pmod(F.xxhash64("fp"), buckets).cast("int")
    return rows.withColumn("o", own).withColumn("m", F.explode(F.sequence(F.lit(0), buckets - 1))).withColumns(
        {"i": F.least("o", "m"), "j": F.greatest("o", "m")}
    )


def clusters(sketches: DataFrame) -> DataFrame:
    """``(a, b)`` of likely copies: each member of a group with its cluster's first one."""
    spark = sketches.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, _, _, fp, n, sketch in grouped(batches, 3):
            root = {}
            for one, other in spread(np.array(n), np.frombuffer(b"".join(sketch), np.uint8).reshape(len(n), -1)):
                root[other] = root.get(one, one)
                a.append(fp[root[other]])
                b.append(fp[other])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    keys = sketches.select("fp", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = _dealt(keys.join(shared, "key"), F.col("c"), TILE).select("key", "i", "j", "fp")
    rows = members.join(sketches.select("fp", "n", "sketch"), "fp").select("key", "i", "j", "fp", "n", "sketch")
    met = rows.repartition(partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    return met.mapInArrow(run, "a binary, b binary").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(roots: DataFrame, nodes: DataFrame, sketches: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that join all near copies of each cluster of ``roots(fp, root)``, compared by their whole sets."""
    spark = nodes.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, fp, n, sketch, text in grouped(batches, 3):
            sets: dict[int, np.ndarray] = {}

            def alike(x: int, y: int) -> bool:
                for k in (x, y):
                    if k not in sets:
                        sets[k] = shingles(text[k])
                return similarity(sets[x], sets[y]) >= SIMILARITY

            links = list(spread(np.array(n), np.frombuffer(b"".join(sketch), np.uint8).reshape(len(n), -1), alike))
            yield pa.RecordBatch.from_arrays([pa.array([fp[link[k]] for link in links], pa.binary()) for k in (0, 1)], names=["a", "b"])

    members = roots.join(sketches.select("fp", "n", "sketch"), "fp")
    sizes = members.groupBy("root").agg(F.sum("n").alias("size"))
    rows = _dealt(members.join(sizes, "root").join(nodes, "fp"), F.col("size"), SHINGLES).select("root", "i", "j", "fp", "n", "sketch", "text")
    met = rows.repartition(partitions(spark), "root", "i", "j").sortWithinPartitions("root", "i", "j", "fp")
    return met.mapInArrow(run, "a binary, b binary")


def hashed(nodes: DataFrame) -> DataFrame:
    """Links ``(a, b)`` of the SimHash components: each text of ``nodes(fp, text)`` with the one its component is named by."""
    named = simhash.near_duplicates(nodes, doc_id="fp").where("doc_id <> component_id")
    return named.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))


def linked(nodes: DataFrame) -> DataFrame:
    """``(fp, root)`` for every text of ``nodes(fp, text)`` that has a near copy: by its SimHash fingerprint, or by shingle sets."""
    sketches = saved(sketched(nodes), "sketches")
    roots = components(saved(clusters(sketches), "clusters"))
    return components(saved(hashed(nodes).union(verified(roots, nodes, sketches)).distinct(), "links"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows with one document of each component: the smallest ``doc_id``; all columns are kept.

    Only the narrow list of rows to drop meets the texts, by id and text, so an id repeated with another text stands for itself.
    A null ``doc_id`` names no document and is kept; of rows that repeat the id that stays, all stay.
    """
    bound_batches(docs.sparkSession)
    keyed = docs.withColumn("_fp", text_key(text))
    rows = saved(keyed.select(F.col(doc_id).alias("id"), F.col("_fp").alias("fp")), "ids")
    nodes = saved(
        keyed.select(F.col("_fp").alias("fp"), or_empty(text).alias("text")).groupBy("fp").agg(F.any_value("text").alias("text")), "texts"
    )
    named = rows.join(linked(nodes), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = named.groupBy("root").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    dropped = named.join(firsts, "root").where("id <> first").select(F.col("id").alias(doc_id), F.col("fp").alias("_fp")).distinct()
    return keyed.join(saved(dropped, "dropped"), [doc_id, "_fp"], "left_anti").select(*docs.columns)
