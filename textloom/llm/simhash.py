"""SimHash near-dedup by meet-in-the-middle ball hashing.

A 64-bit fingerprint emits all variants within half the radius. Two fingerprints within the radius share a
variant, and any two that share a variant are within the radius, so a shuffle on variants and a look at
neighbours in each variant's group find every component. A variant's group holds at most 65 distinct
fingerprints (the ball around it), whatever the data; copies of a text are one fingerprint from the start.

A null text has no words; without words the fingerprint is zero and links like any other. Repeated rows and
ids get equal results; extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, joined, saved, words_of

WIDTH = 3
SEED = 42
RADIUS = 2
BITS = 64
MAX_ROUNDS = 64


def fingerprint_of(text: str | None, width: int = WIDTH) -> int:
    """Fingerprint of one text as a signed 64-bit number."""
    import xxhash

    words = [w.lower() for w in words_of(text)]  # bytes.lower() touches A-Z only
    if not words:
        return 0
    whole, starts, ends = joined(words)
    first, last = starts.tolist(), ends.tolist()[width - 1 :]
    one = xxhash.xxh64_intdigest
    if len(words) <= width:
        return int(np.uint64(one(whole, SEED)).astype(np.int64))
    counts, n = np.zeros(BITS, np.int64), len(last)
    for at in range(0, n, 1 << 16):
        values = [one(whole[a:b], SEED) for a, b in zip(first[at : at + (1 << 16)], last[at : at + (1 << 16)])]
        bits = np.unpackbits(np.array(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``(doc_id, fp)`` for every row."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint_of(t, width) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fp bigint")


def _ball(fp: Column) -> Column:
    """All numbers within one bit of ``fp``."""
    flips = [fp.bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint")) for i in range(BITS)]
    return F.array(fp, *flips)


def links(distinct: DataFrame) -> DataFrame:
    """Edges ``(a, b)``, a < b, of distinct fingerprints ``fp`` whose links give all components at radius 2.

    In a variant's sorted group each member is linked to the one before it; all members are within the radius
    of each other, so no component is lost. Pairs are verified and repeated pairs dropped.
    """
    by_variant = Window.partitionBy("variant").orderBy("fp")
    variants = distinct.select("fp", F.explode(_ball(F.col("fp"))).alias("variant"))
    return (
        variants.withColumn("a", F.lag("fp").over(by_variant))
        .where(F.col("a").isNotNull() & (F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= RADIUS))
        .select("a", F.col("fp").alias("b"))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """``(fp, root)`` for every end of an edge; root is the smallest fingerprint reachable.

    Smallest labels travel along edges and then jump to their label's label, which halves the distance left,
    so rounds grow with the logarithm of a component's width. Each round is a table in the shared folder. An end has
    at most as many edges as its ball has points, so no join key is hot.
    """
    both = saved(edges.union(edges.select("b", "a")).toDF("fp", "other"), "edges")
    labels = saved(both.groupBy("fp").agg(F.min("other").alias("o")).select("fp", F.least("fp", "o").alias("root")), "labels")
    for _ in range(MAX_ROUNDS):
        near = both.join(labels.toDF("other", "near"), "other").groupBy("fp").agg(F.min("near").alias("near"))
        step = labels.join(near, "fp").select("fp", "root", F.least("root", "near").alias("next"))
        # The root is itself a vertex: its own label is at least as good.
        jump = labels.toDF("next", "far")
        new = saved(
            step.join(jump, "next").select("fp", F.least("next", "far").alias("new"), (F.col("root") != F.least("next", "far")).alias("moved")),
            "labels",
        )
        labels = new.select("fp", F.col("new").alias("root"))
        if new.where("moved").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def classes(fps: DataFrame) -> DataFrame:
    """``(fp, component_id, component_size)`` for each distinct fingerprint of ``fps(doc_id, fp)``."""
    distinct = saved(
        fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "fingerprints"
    )
    roots = components(links(distinct.select("fp")))
    labelled = saved(
        distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id", "n"), "roots"
    )
    ids = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("n").alias("component_size"))
    return labelled.join(ids, "root").select("fp", "component_id", "component_size")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id, component_size``."""
    fps = saved(fingerprints(docs, doc_id, text, width), "simhash")
    return fps.join(classes(fps), "fp").select("doc_id", "fp", "component_id", "component_size")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Rows with one document of each component: the smallest ``doc_id``; all columns are kept.

    Only the narrow list of rows to drop meets the texts. A null ``doc_id`` names no document and is kept; of rows
    that repeat the id that stays, all stay (exact copies are the exact dedup's work).
    """
    dropped = near_duplicates(docs, doc_id, text, width).where("doc_id <> component_id").select(
        F.col("doc_id").alias(doc_id)
    ).distinct()
    return docs.join(saved(dropped, "dropped"), doc_id, "left_anti")
